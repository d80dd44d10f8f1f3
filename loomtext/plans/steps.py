"""The engine's steps by name: each takes frames and returns one. A step that would call a model takes candidates as a column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import gates, perturb, provenance, text
from loomtext.functions.contracts import violations
from loomtext.operators import agreement, graph, hypotheses, rank, registry, replies, search, select, summaries
from loomtext.sources import gold, sinks
from loomtext.sources.scratch import written

# Loaders of test sets by name.
TEST_SOURCES = {
    "records": lambda spark, base: gold.records(spark, f"{base}/gold_records/*.json"),
    "published": lambda spark, base: gold.published(spark, f"{base}/published/*.json"),
    "published-trunc": lambda spark, base: gold.published(spark, f"{base}/published/*.json", gold.SOURCE_PREFIX),
    "pairs": lambda spark, base: gold.json_pairs(spark, f"{base}/pairs.jsonl"),
}


def register_lines(name: str, source: str, target: str) -> None:
    """Adds a pair of files that are aligned by line."""
    TEST_SOURCES[f"lines:{name}"] = lambda spark, base: gold.line_pairs(spark, f"{base}/{source}", f"{base}/{target}", name)


def load(spark: SparkSession, name: str, base: str, n: int = 0) -> DataFrame:
    return select.head(TEST_SOURCES[name](spark, base), ["ord"], n)


def proof(pairs: DataFrame) -> DataFrame:
    """Adds blocking, gate, decision and result_id to source and candidate."""
    s, c = F.col("source"), F.col("candidate")
    pairs = pairs.withColumn("blocking", gates.blocking(s, c))
    return pairs.withColumn("gate", gates.gate(F.col("blocking"))).withColumn("decision", gates.decision(F.col("gate"))).withColumn("result_id", gates.result_id(s, c))


def verify(pairs: DataFrame) -> DataFrame:
    """proof, and chrF against gold where there is one: verified if the gate passes and gold does not object."""
    p = text.with_metrics(proof(pairs), "gold", "candidate")
    ok = gates.gold_ok(F.col("chrf"), F.coalesce(F.col("gold"), F.lit("")) != "")
    return p.withColumn("gold_ok", ok).withColumn("verified", (F.col("gate") == "PASS") & F.col("gold_ok"))


def evaluate(rows: DataFrame, by: list[str]) -> DataFrame:
    m = proof(text.with_metrics(rows, "gold", "candidate"))
    return summaries.experiment_summary(m, by, "gate", "chrf", "bleu1", "semantic", "latency")


def meta_evaluate(candidates: DataFrame, passage: str, item: str, judge: str) -> DataFrame:
    """How well each metric ranks the candidates of a passage as the judge does, and whether one beats chrF."""
    m = text.with_metrics(candidates, "gold", "candidate").withColumn("combined", text.combined(F.col("chrf"), F.col("bleu1"), F.col("semantic")))
    m = m.withColumn("semantic", F.coalesce("semantic", F.lit(0.0)))
    order = ["chrf", "bleu1", "semantic", "combined"]
    return rank.best_metric(rank.gamma(m, [passage], item, order, judge), order, "chrf")


def challenge(golds: DataFrame, n: int) -> DataFrame:
    """source, good, bad, error_family, instruction: at most max(4, n // 14) rows of each family."""
    x = golds.withColumn("bad", perturb.all_perturbations(F.col("gold")))
    names = F.array(*[F.lit(f) for f in perturb.FAMILIES])
    x = x.select("source", F.col("gold").alias("good"), "ord", F.posexplode("bad").alias("k", "bad")).withColumn("error_family", F.element_at(names, F.col("k") + 1))
    x = x.filter(F.col("bad").isNotNull() & (F.col("bad") != "") & (F.trim("bad") != F.trim("good")))
    told = F.create_map(*[F.lit(y) for f in perturb.FAMILIES for y in (f, perturb.instruction(f))])
    return select.capped_families(x, "error_family", "k", "ord", n, len(perturb.FAMILIES)).select("source", "good", "bad", "error_family", told[F.col("error_family")].alias("instruction"))


def validate(lines: DataFrame, column: str, contract: str, strict: bool = False) -> DataFrame:
    return lines.withColumn("violations", violations(F.col(column), contract, strict=strict))


def benchmark_registry(texts: DataFrame) -> DataFrame:
    """Passages (source, school, source_id, ...) with their content hash and id."""
    h = provenance.passage_hash(F.col("source"), F.col("school"))
    return texts.withColumn("hash", h).withColumn("passage_id", provenance.passage_id(F.col("school"), F.col("source_id"), F.col("hash")))


def render(candidates: DataFrame, passage: str, item: str) -> DataFrame:
    """Validity of candidates and agreement of the valid ones."""
    p = proof(candidates).withColumn("valid", agreement.is_valid(F.col("gate"), F.col("semantic")))
    return agreement.candidate_disagreement(p, passage, item, "candidate", "valid")


# Shapes of requests.
REQUESTS = {"audit": "source string, candidate string", "translate": "source string, max_tokens int", "bench": "n int"}


def _checks() -> Column:
    """MAP check -> whether it passed, of `blocking`."""
    names = F.array(*map(F.lit, gates.CHECKS))
    return F.map_from_arrays(names, F.transform(names, lambda c: ~F.array_contains("blocking", c)))


def audit(requests: DataFrame) -> DataFrame:
    """Requests of source and candidate with each check, the gate and what blocks."""
    p = proof(requests)
    return p.select("source", "candidate", F.lit("audit").alias("product"), _checks().alias("checks"), "gate", "blocking", F.lit(0).alias("tokens"))


# What a translator is told; tokens of a request that names none, and of a benchmark's.
TRANSLATOR, MAX_TOKENS = "You are a Sanskrit-to-English translator. Output ONLY the English translation, no explanation.", 30


def translate(requests: DataFrame, path: str, call: replies.Call, **how) -> DataFrame:
    """Requests (source, max_tokens) with translation, gate, checks and status: a reply that is kept under `path` is not asked for again; one that failed is empty."""
    asked = requests.withColumn("system", F.lit(TRANSLATOR)).withColumn("max_tokens", F.coalesce("max_tokens", F.lit(MAX_TOKENS)))
    answered = replies.answer(asked, ["system", "source", "max_tokens"], path, call, **how)
    p = proof(answered.withColumn("candidate", text.strip(F.coalesce("reply", F.lit("")))))
    return p.select(*requests.columns, F.lit("translate").alias("product"), F.col("candidate").alias("translation"), "gate", _checks().alias("checks"), "status")


def bench(golds: DataFrame, order: list, n: int, path: str, call: replies.Call, **how) -> DataFrame:
    """product, n, avg_bleu and pass_rate of translating the first n gold rows (source, gold)."""
    head = golds.orderBy(*order).limit(n)
    told = translate(head.withColumn("max_tokens", F.lit(MAX_TOKENS)), path, call, **how)
    return summaries.server_bench(told, order, n)


def try_hypotheses(trials: DataFrame, key: list[str], path: str, call: replies.Call, model: str, **how) -> DataFrame:
    """Trials (key, source, gold, hint) with the candidate that a model gives under the hint, its metrics and its gate."""
    asked = replies.hint_requests(trials, [*key, "source", "gold", "hint"], "source", "hint", model)
    return hypotheses.outcomes(replies.candidates(replies.answer(asked, ["model", "system", "prompt"], path, call, **how)))


def report(experiments: DataFrame) -> DataFrame:
    """Records that have the metric, best first."""
    return experiments.filter("avg_chrF IS NOT NULL").orderBy(F.desc("avg_chrF"), "experiment_id")


def benchmark_report(experiments: DataFrame, prices: DataFrame) -> DataFrame:
    """Experiments (model, avg_semantic, ..) with the cost of their model and quality per cost; without a price both are null."""
    found = summaries.price_lookup(experiments, "model", prices, "id", "ord")
    return summaries.with_cost(experiments.join(found, "model", "left"), "prompt", "completion", "avg_semantic")


def texts(files: DataFrame) -> DataFrame:
    """Passages of benchmark texts (file, text), five a school."""
    return registry.benchmark_rows(files, "file", "file", "text")


def finetune(golds: DataFrame, renders: DataFrame) -> DataFrame:
    """Fine-tuning pairs of gold rows and of rendered candidates (source, gold, candidate, register, semantic)."""
    p = proof(renders).withColumn("valid", agreement.is_valid(F.col("gate"), F.col("semantic")))
    return registry.finetune_build(golds, p)


def hypothesis(results: DataFrame, judgment: str, order: str) -> DataFrame:
    """What to try next, after a run's rows (semantic, chrf and a judgment)."""
    return hypotheses.proposed(hypotheses.low_rows(results, "semantic", "chrf", judgment), judgment, order)


def comet(pairs: DataFrame, scorer: Callable[[list[dict]], list[float | None]] | None = None) -> DataFrame:
    """A learned metric of source, candidate and gold, if a scorer for it is given; its column is else null, and says so."""
    return replies.scored(pairs, "source", "candidate", "gold", scorer)


def gold_summary(rows: DataFrame) -> DataFrame:
    """Rows of each tradition, of all labels."""
    return summaries.counts_with_zeros(rows, "tradition", [r["tradition"] for r in gold.traditions(rows.sparkSession).collect()])


def checkpoints(nodes: DataFrame) -> DataFrame:
    """The graph with what is ready, which checkpoint is next, levels, cycles and how much blocks each."""
    return graph.standing(nodes, "ord").withColumnRenamed("is_next", "next")


def tree_search(rows: DataFrame, by: list[str], depth: int = 2, fanout: int = 2) -> DataFrame:
    """The best strategy of each search, from judged rows (by, strategy, ord, fidelity), against its root's."""
    scores = search.scored_strategies(rows, by, "strategy", ["ord"], "fidelity")
    return search.best_node(search.tree_search(scores, by, depth, fanout), by)


def memory(events: DataFrame, text: str = "") -> DataFrame:
    """The last event of each key (step, key, ts, ord, raw), of those that hold a text."""
    held = events.filter(F.lower("raw").contains(text.lower())) if text else events
    return select.latest(held, ["step", "key"], ["ts", "ord"])


def watchdog(lines: DataFrame, results: DataFrame, by: list[str]) -> DataFrame:
    """One round: how many records are invalid, and the summary of the results."""
    bad = validate(lines, "value", "AGENT_RUN").agg(F.count_if(F.size("violations") > 0).alias("n_invalid"))
    return evaluate(results, by).crossJoin(F.broadcast(bad))


STEPS = {
    "validate": validate, "eval": evaluate, "hypothesis": hypothesis, "proof": proof, "report": report, "watchdog": watchdog, "benchmark": meta_evaluate, "benchmark_registry": benchmark_registry,
    "sanskrit_texts": texts, "benchmark_report": benchmark_report, "gold": gold_summary, "comet": comet, "frontier": gold.line_pairs, "verify": verify, "checkpoints": checkpoints, "render": render,
    "finetune": finetune, "tree_search": tree_search, "memory": memory, "challenge": challenge,
}


def run(ledgers: list[str], name: str, *args, **kwargs) -> DataFrame:
    """Runs a step by name, to its end: its result is written; then each ledger is told that it ran."""
    out = written(STEPS[name](*args, **kwargs))
    entry = out.sparkSession.createDataFrame([(name, ",".join(out.columns))], "step string, columns string")
    for path in ledgers:
        sinks.append_ledger(entry, path)
    return out
