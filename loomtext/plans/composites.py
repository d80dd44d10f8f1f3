"""Queries of composed operators over the given tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import gates, lexicon, perturb, provenance, text
from loomtext.functions.contracts import violations
from loomtext.operators import hypotheses, ledger, registry, replies, select, summaries
from loomtext.plans import evidence, oracle, steps
from loomtext.plans import lexicons as X
from loomtext.plans.queries import gold_hashes, school_index, table, turns
from loomtext.plans.queries import challenges as _challenges
from loomtext.sources import lines, sinks
from loomtext.sources.scratch import scratch


def challenge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _challenges(spark, sf_dir).select("item_id", "family", "bad")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.pmod("event_id", F.lit(5))
    said = F.when(k == 0, F.concat(F.lit("Negation dropped "), "event_id")).when(k == 1, "the scope is too wide").when(k == 2, F.concat(F.lit("new kind "), "event_id")).when(k == 3, "__unread").otherwise("")
    return table(spark, sf_dir, "events").select("event_id", (F.pmod("event_id", F.lit(10)) / 10).alias("fidelity"), (F.col("value") / 100).alias("chrf"), said.alias("judgment"))


def low_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = hypotheses.low_rows(_judged(spark, sf_dir), "fidelity", "chrf", "judgment")
    return low.groupBy("family").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


def hypothesis_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hypotheses.proposed(hypotheses.low_rows(_judged(spark, sf_dir), "fidelity", "chrf", "judgment"), "judgment", "event_id")


def _stand_in(requests: list[dict], attempt: int) -> list[str | None]:
    """Stands in for a model: a piece of the source, which piece the hint decides."""
    said = []
    for r in requests:
        hint, _, source = r["prompt"].partition(replies.ASK_WITH_HINT)
        k = len(hint) % 10
        said.append(source[3 * k : 7 * k + 60])
    return said


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    golds = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("source"), F.col("text").alias("gold"))
    tried = hypotheses.trials(hypothesis_plan(spark, sf_dir), golds)
    return steps.try_hypotheses(tried, ["item_id", "ord", "family"], scratch(spark), _stand_in, "m", pause=None)


def hypothesis_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trials(spark, sf_dir).select("item_id", "family", F.substring("prompt", 1, 20).alias("asked"), text.pair_hash(F.col("candidate")).alias("candidate"), "chrf", "bleu1", "proof_gate", F.array_join("proof_blocking", ",").alias("blocking"))


def hypothesis_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds = _trials(spark, sf_dir).withColumn("round", F.pmod("item_id", F.lit(4)))
    return hypotheses.best_of_round(rounds, ["round"]).select("round", "family", F.round("score", 6).alias("score"), "kept")


def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of users, answered by a stand-in, with their gate."""
    t = turns(spark, sf_dir).select("conv_id", "turn", F.col("ref").alias("source"), F.when(F.pmod("turn", F.lit(2)) == 0, 50).alias("max_tokens"))
    out = steps.translate(t, scratch(spark), _cut_short, size=50, pause=None)
    return out.select("conv_id", "turn", text.pair_hash(F.col("translation")).alias("translation"), "gate", F.col("checks")["COVERAGE"].alias("covered"), "status")


def _cut_short(requests: list[dict], attempt: int) -> list[str | None]:
    return [None if len(r["source"]) % 13 == 4 else r["source"][: 8 * r["max_tokens"]] for r in requests]


def tier_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return school_index(spark, sf_dir).groupBy(registry.model_task(F.col("tier")).alias("task")).agg(F.sum("n").alias("n"), F.count("*").alias("n_schools"))


def finetune_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).select("turn", F.col("ref").alias("source"), F.col("cand").alias("gold"))
    valid = gates.gate(gates.blocking(F.col("source"), F.col("gold"))) == "PASS"
    renders = t.withColumns({"register": select.cyclic(F.col("turn"), list(X.REGISTERS)), "valid": valid, "candidate": F.when(F.pmod("turn", F.lit(3)) == 0, F.col("gold")).otherwise(F.concat("gold", F.lit(" .")))})
    out = registry.finetune_build(t, renders)
    return out.select("instruction", text.pair_hash(F.col("input")).alias("input"), text.pair_hash(F.col("output")).alias("output"), "register", "source")


def annotation_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    golds = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("source"), F.concat(F.lit("gold "), "text").alias("gold"))
    out = registry.annotation_export(golds, "item_id", 150)
    return out.select("passage_id", "source", "candidate_a", "candidate_b", "preference", F.size("errors").alias("n_errors"), F.col("no_major_error").isNull().alias("unjudged"))


def baseline_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = gold_hashes(spark, sf_dir).select("conv_id", "gold_hash")
    changed = F.when(F.pmod("conv_id", F.lit(7)) == 0, F.reverse("gold_hash")).otherwise(F.col("gold_hash"))
    baseline = now.filter(F.pmod("conv_id", F.lit(11)) != 0).withColumn("gold_hash", changed)
    return registry.compare_baseline(now.filter(F.pmod("conv_id", F.lit(13)) != 0), baseline, "conv_id", "gold_hash")


def _record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of 500 JSON lines; some lines are blank, of another kind, mistyped or broken."""
    k = F.col("event_id")
    kind = F.when(F.pmod(k, F.lit(6)) == 0, "  ").when(F.pmod(k, F.lit(10)) == 1, '{"other": 1}').when(F.pmod(k, F.lit(1409)) == 700, "{broken").when(F.pmod(k, F.lit(9)) == 2, '{"step": 1, "ts": "2024-01-01T00:00"}').when(F.pmod(k, F.lit(15)) == 4, '{"step": "s"}')
    return table(spark, sf_dir, "events").select(F.concat(F.lit("runs-"), F.floor(k / 500), F.lit(".jsonl")).alias("file"), F.pmod(k, F.lit(500)).alias("i"), kind.otherwise('{"step": "s", "ts": "2024-01-01T00:00"}').alias("line"))


def file_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.file_violations(_record_lines(spark, sf_dir), "file", "i", "line", "AGENT_RUN", "step")


def file_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.file_totals(_record_lines(spark, sf_dir), "file", file_violations(spark, sf_dir))


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = registry.benchmark_rows(table(spark, sf_dir, "documents"), "doc_id", "source", "text", 3, 2000, X.FRAGMENTS, X.TIERS, X.PERIODS, dict.fromkeys(X.FRAGMENTS, X.TERMS), X.TERM_LETTERS)
    return registry.add_passages(rows)


def registry_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _registry(spark, sf_dir).select("passage_id", "school", "tier", "period", "genre", "license", "source_id", "term_density", "n_terms", F.array_join("school_terms_found", ",").alias("found"), F.size("references").alias("n_references"))


def registry_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = registry.add_sources(spark, [("a", "A", "u", "l", "d"), ("a", "A2", "u", "l", "d"), ("b", "B", "u", "l", "d")])
    m = registry.manifest(_registry(spark, sf_dir), "0.1.0", sources)
    return m.select("version", "n_passages", F.col("n_sources").cast("long").alias("n_sources"), F.array_join("defended", ",").alias("defended"), F.size("lineage_requirements").alias("n_requirements"), "manifest_hash")


def strategy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.pmod("event_id", F.lit(4)) != 0, F.col("value")).alias("fidelity"))
    return select.strategy_score(e, ["user_id"], ["event_id"], "fidelity").select("user_id", F.round("score", 6).alias("score"))


def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.sha2(F.col("event_id").cast("string"), 256).alias("run_signature"), F.concat(F.lit("claim "), "event_id").alias("assertion"))
    x = table(spark, sf_dir, "events").select(F.format_string("EXP-%012d", "event_id").alias("experiment_id"), (F.pmod("event_id", F.lit(3)) / 4).alias("avg_chrF"), (F.pmod("event_id", F.lit(5)) / 8).alias("avg_bleu1"), F.when(F.pmod("event_id", F.lit(2)) == 0, 0.5).alias("avg_semantic"))
    values = sinks.report_values(e, x, "2026")
    return spark.createDataFrame([(sinks.report("@N_RUNS@ runs, @N_EXP@ experiments, @DATE@\n@RUN_SIGNATURES@\n@METRIC_TABLE@\n@ASSERTION_CITATIONS@", values),)], "report string")


def server_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).select("conv_id", "turn", F.col("ref").alias("source"), F.col("ref").alias("gold"), F.col("cand").alias("translation"))
    none = summaries.server_bench(t.filter("conv_id < 0"), ["conv_id", "turn"], 5).withColumn("product", F.lit("bench of nothing"))
    return summaries.server_bench(t, ["conv_id", "turn"], 40).unionByName(none)


def evidence_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence that each pair carries, and what its contract finds in it."""
    t = turns(spark, sf_dir).withColumn("b", gates.blocking(F.col("ref"), F.col("cand")))
    words = F.filter(F.split("cand", " "), lambda w: w != "")
    o = evidence.evidence_object(F.col("ref"), F.col("cand"), gates.gate(F.col("b")), F.col("b"), words, F.array("ref", "cand"), F.sha2(F.col("conv_id").cast("string"), 256))
    t = t.withColumn("o", o)
    return t.select(
        "conv_id", "turn", "o.parallel_evidence.n_parallels", F.size("o.parallel_evidence.parallels").cast("long").alias("n_kept"), F.col("o.candidate.hash").alias("candidate_hash"), "o.provenance.run_signature",
        "o.decision", F.size(violations(F.to_json("o"), "PROOF_EVIDENCE")).cast("long").alias("n_violations"), "o.artifact_hash",
    )


def proof_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.with_metrics(turns(spark, sf_dir), "ref", "cand").withColumn("b", gates.blocking(F.col("ref"), F.col("cand")))
    z = evidence.feature_vector(F.col("chrf"), F.lit("mixed"), F.lit(None), F.lit(0))
    gold = F.when(F.pmod("turn", F.lit(3)) != 0, F.col("ref"))
    t = t.withColumn("s", evidence.proof_score(gates.gate(F.col("b")), gold, F.col("chrf"), z))
    status = [F.col(f"s.{c}.status").alias(c) for c in ("source_semantic_coverage", "morphological_accounting", "critical_errors_detected", "candidate_agreement")]
    return t.select("conv_id", "turn", F.col("s.deterministic_gate").alias("gate"), F.col("s.gold_chrF").alias("gold_chrf"), "s.decision", *status)


def severity_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = select.cyclic(F.col("event_id"), ["minor", "major", "critical", "none"])
    e = table(spark, sf_dir, "events").select("event_type", gates.severity_weight(kind).alias("w"))
    return e.groupBy("event_type").agg(F.sum("w").cast("long").alias("weight"), F.count("w").alias("n"))


def host_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", gates.host_verdict(F.col("s_acctbal") / 4000).alias("verdict"))


def answer_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("raw", F.concat(F.lit(' \n""'), F.col("text"), F.lit('" \t')))
    a = text.clean_answer(F.col("raw"))
    return c.select("conv_id", "turn", text.pair_hash(a).alias("answer"), text.prefix(a, 50).alias("head"), text.word_count(a).cast("long").alias("n_words"))


def validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomtext.operators.agreement import is_valid

    t = turns(spark, sf_dir)
    semantic = F.when(F.pmod("turn", F.lit(4)) != 3, F.pmod("conv_id", F.lit(5)) / 5)
    g = gates.gate(gates.blocking(F.col("ref"), F.col("cand")))
    return t.select("conv_id", "turn", is_valid(g, semantic).alias("valid"), summaries.challenge_verdict(semantic).alias("caught"))


def ledger_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomtext.plans.queries import ledgers

    e = ledgers(spark, sf_dir)
    counts = ledger.ledger_counts(e).select(F.col("ledger").alias("view"), F.col("n").cast("string").alias("value"))
    last = ledger.of_step(e, "EXP-1", 3).select(F.lit("EXP-1").alias("view"), F.col("experiment_id").alias("value"))
    return counts.unionByName(last)


def experiment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    h = provenance.set_hash(e, ["event_type"], ["event_id"], ["event_id", "user_id"], "data_hash")
    at = e.groupBy("event_type").agg(F.min("ts").alias("ts"))
    return h.join(at, "event_type").select("event_type", provenance.experiment_id(F.lit("char"), F.col("event_type"), F.col("data_hash"), F.col("ts")).alias("experiment_id"))


def missing_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("intro\nsee `/data/"), F.pmod("page_id", F.lit(40)), F.lit("` and `/tools/x.py`\n`relative/y` `/data/"), "page_id", F.lit("`")).alias("t"))
    known = table(spark, sf_dir, "nation").select(F.concat(F.lit("/data/"), "n_nationkey").alias("path"))
    return summaries.missing_references(p, "page_id", "t", known, "path")


def ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    w = F.split(F.lower("text"), " ")
    return c.select("conv_id", "turn", F.array_join(select.ordered_union(F.slice(w, 1, 6), F.slice(w, 4, 6)), " ").alias("words"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lines.passage(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "text"), "file", "text", 300)
    return select.head(p.select("file", F.length("source").cast("long").alias("n"), F.sha2("source", 256).alias("sha")), ["file"], 0)


def render_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each conversation with a judge's score: how far those that are valid agree."""
    t = turns(spark, sf_dir).select("conv_id", "turn", F.col("ref").alias("source"), F.col("cand").alias("candidate"), F.when(F.pmod("turn", F.lit(4)) != 3, F.pmod("turn", F.lit(5)) / 4).alias("semantic"))
    return steps.render(t, "conv_id", "turn")


def memory_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("step"), F.col("user_id").cast("string").alias("key"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("event_id").alias("ord"), F.concat(F.lit("Noted "), "event_id").alias("raw"))
    return steps.memory(e, "NOTED 1").select("step", "key", "ord", "raw")


QUERIES = {
    f.__name__: f
    for f in (
        challenge_rows, low_families, hypothesis_plan, hypothesis_trials, hypothesis_rounds, translations, tier_tasks, finetune_build, annotation_export, baseline_audit, file_violations, file_totals, registry_build, registry_manifest,
        strategy_scores, report_text, server_bench, evidence_nested, proof_scores, severity_totals, host_verdicts, answer_cleanup, validity, ledger_views, experiment_ids, missing_references, ordered_union, passages, render_sets, memory_latest,
    )
}

# The rules of controlled errors: t are a text's tokens, g the gaps around them, so that a text is g1 t1 g2 t2 .. g(n + 1).
_WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_''-]*[\p{L}\p{N}_])?"
_STRIP = lambda x: rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def _quoted(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def _put(k: str, word: str) -> str:
    return f"CASE WHEN {k} IS NOT NULL THEN array_to_string(list_transform(range(1, n + 1), lambda i: g[i] || CASE WHEN i = {k} THEN {word} ELSE t[i] END), '') || g[n + 1] END"


def _swap(a: str, b: str) -> str:
    return f"array_to_string(list_transform(range(1, n + 1), lambda i: g[i] || CASE WHEN i = {a} THEN t[{b}] WHEN i = {b} THEN t[{a}] ELSE t[i] END), '') || g[n + 1]"


def _first(condition: str) -> str:
    return f"list_filter(range(1, n + 1), lambda i: {condition})[1]"


def _mapped(table_: dict[str, str]) -> str:
    keys, values = _quoted(table_), _quoted(table_.values())
    k = _first(f"list_contains({keys}, low[i])")
    return _put(k, f"{values}[list_position({keys}, low[i])]")


_NOT = r"(?i)(^|[^\p{L}\p{N}_])(not|no|never|nor)($|[^\p{L}\p{N}_])"
_CONTENT = f"list_filter(range(1, n + 1), lambda i: NOT list_contains({_quoted(sorted(perturb.STOPWORDS))}, low[i]))"
_CAPITAL = _first("left(t[i], 1) <> lower(left(t[i], 1))")
_KEY = "coalesce(" + ", ".join(f"list_position(low, '{w}')" for w in perturb.IMAGES) + ")"
_RULES = {
    "SCOPE_NEGATION": f"CASE WHEN regexp_matches(text, '{_NOT}') THEN {_STRIP(f"regexp_replace(text, '{_NOT}', '\\1\\3')")} ELSE 'not ' || text END",
    "MORPHOLOGY": _put("n", "CASE WHEN ends_with(t[i], 's') THEN left(t[i], -1) ELSE t[i] || 's' END"),
    "TECHNICAL_TERM": f"coalesce({_put(_CAPITAL, f"'{perturb.GENERIC}'")}, '{perturb.GENERIC_PREFIX}' || text)",
    "POETIC_METAPHOR": _put(_KEY, f"{_quoted(perturb.IMAGES.values())}[list_position({_quoted(perturb.IMAGES)}, low[i])]"),
    "TEXTUAL_STRUCTURE": _put(_first(f"list_contains({_quoted(perturb.SPEECH)}, low[i])"), "CASE WHEN low[i] = 'asked' THEN 'said' ELSE 'asked' END"),
    "ACCURACY_OMISSION": rf"""CASE WHEN contains(text, ',') AND {_STRIP(r"regexp_extract(text, ',([^,]*)$', 1)")} <> '' AND n > 3 THEN regexp_replace(regexp_replace(text, ',[^,]*$', ''), '[ ,]+$', '')
        WHEN n > 1 THEN regexp_replace(array_to_string(list_transform(range(1, n), lambda i: g[i] || t[i]), '') || g[n], '[\s\p{{Z}}]+$', '') END""",
    "ACCURACY_ADDITION": _STRIP(f"text || '{perturb.ADDED}'"),
    "ACCURACY_MISTRANSLATION": f"coalesce({_mapped(perturb.ANTONYMS)}, CASE WHEN n > 1 THEN {_put('2', 'reverse(t[i])')} END)",
    "SYNTAX_KARAKA": f"CASE WHEN len({_CONTENT}) > 1 THEN {_swap(f'({_CONTENT})[1]', f'({_CONTENT})[-1]')} WHEN n > 1 THEN {_swap('1', '2')} END",
    "LEXICAL_SENSE": _mapped(perturb.ANTONYMS),
    "COREFERENCE": _mapped(perturb.PRONOUNS),
    "COMPOUND_SAMASA": f"CASE WHEN n > 1 THEN {_swap('1', '2')} END",
    "SEGMENTATION_SANDHI": _put(_first("contains(t[i], '-') AND length(replace(t[i], '-', '')) > 3"), "replace(t[i], '-', '')"),
    "STYLE": f"CASE WHEN left(text, 1) <> lower(left(text, 1)) THEN {_STRIP('lower(left(text, 1)) || substr(text, 2)')} END",
}
_CHALLENGES = f"""tok AS MATERIALIZED (SELECT item_id, text, regexp_extract_all(text, '{_WORD}') AS t, regexp_split_to_array(text, '{_WORD}') AS g FROM benchmark),
    k AS MATERIALIZED (SELECT *, len(t) AS n, list_transform(t, lambda w: lower(w)) AS low FROM tok WHERE len(t) > 0),
    made AS ({" UNION ALL ".join(f"SELECT item_id, {i} AS family_order, '{f}' AS family, text AS good, {rule} AS bad FROM k" for i, (f, rule) in enumerate(_RULES.items()))}),
    challenge AS (SELECT * FROM made WHERE bad IS NOT NULL AND bad <> '' AND trim(bad) <> trim(good))"""
_JUDGED = """j AS (SELECT event_id, event_id % 10 / 10 AS fidelity, value / 100 AS chrf, CASE event_id % 5 WHEN 0 THEN 'Negation dropped ' || event_id WHEN 1 THEN 'the scope is too wide' WHEN 2 THEN 'new kind ' || event_id WHEN 3 THEN '__unread' ELSE '' END AS judgment FROM events),
    low AS (SELECT *, CASE event_id % 5 WHEN 0 THEN 'negation loss' WHEN 1 THEN 'scope loss' ELSE 'novel' END AS family FROM j WHERE (fidelity < 0.7 OR chrf < 0.55) AND judgment <> '' AND NOT starts_with(judgment, '__'))"""
_KNOWN = ", ".join("({}, '{}', '{}')".format(k, f, h.replace("'", "''")) for k, (f, h) in enumerate(hypotheses.KNOWN.items()))
_PLAN = f"""{_JUDGED}, known AS (SELECT * FROM (VALUES {_KNOWN}) t(ord, family, hint)),
    plan AS (SELECT * FROM known WHERE family IN (SELECT family FROM low) UNION ALL SELECT {len(hypotheses.KNOWN)}, '{hypotheses.GENERAL}', '{hypotheses.GENERAL_HINT}' WHERE NOT EXISTS (SELECT 1 FROM known WHERE family IN (SELECT family FROM low))
        UNION ALL SELECT {len(hypotheses.KNOWN) + 1}, 'novel: ' || left(min_by(judgment, event_id), 40), '{hypotheses.NOVEL_HINT}' FROM low WHERE family = 'novel' HAVING count(*) > 0)"""
_CLEAN = lambda x: _STRIP(f"regexp_replace({_STRIP(x)}, '^\"+|\"+$', '', 'g')")
_TRIALS = f"""{_PLAN}, tried AS (SELECT item_id, ord, family, hint, text AS ref, {_CLEAN("substr(text, 1 + 3 * (length(hint) % 10), 60 + 4 * (length(hint) % 10))")} AS cand FROM benchmark, plan),
    f0 AS MATERIALIZED (SELECT *, {oracle.bare('ref')} AS rb, {oracle.bare('cand')} AS cb FROM tried), f1 AS MATERIALIZED (SELECT *, {oracle.all_grams('rb', 'r')}, {oracle.all_grams('cb', 'c')}, {oracle.words('ref')} AS rw, {oracle.words('cand')} AS cw FROM f0),
    f2 AS MATERIALIZED (SELECT item_id, ord, family, hint, ref, cand, {oracle.BLEU} AS bleu1, {oracle.shares('r', 'c')} FROM f1), f3 AS MATERIALIZED (SELECT *, {oracle.CHRF} AS chrf FROM f2), {oracle.default_gate('f3')}"""
_RECORDS = """r AS (SELECT 'runs-' || event_id // 500 || '.jsonl' AS file, event_id % 500 AS i, CASE WHEN event_id % 6 = 0 THEN 'blank' WHEN event_id % 10 = 1 THEN 'other' WHEN event_id % 1409 = 700 THEN 'broken' WHEN event_id % 9 = 2 THEN 'step' WHEN event_id % 15 = 4 THEN 'ts' ELSE 'fine' END AS kind FROM events),
    stop AS (SELECT file, min(i) FILTER (kind = 'broken') AS stop FROM r GROUP BY 1),
    v AS (SELECT r.file, i, CASE kind WHEN 'broken' THEN r.file || ': invalid JSON' WHEN 'step' THEN r.file || ':' || i || ': bad type step' ELSE r.file || ':' || i || ': missing ts' END AS message
          FROM r JOIN stop USING (file) WHERE kind IN ('broken', 'step', 'ts') AND (stop IS NULL OR i <= stop))"""
_REGISTRY = f"""s AS ({oracle.SCHOOL}), c AS (SELECT *, left(array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> '' AND NOT starts_with(x, '#')), chr(10)), 2000) AS body
        FROM (SELECT * FROM s WHERE school <> 'Unclassified' QUALIFY row_number() OVER (PARTITION BY school ORDER BY doc_id) <= 3)),
    p AS (SELECT *, sha256(left(body, 2000) || chr(1) || school) AS hash, regexp_extract_all(lower(body), '{X.TERM_LETTERS}') AS tok, lower(body) AS x FROM c WHERE body <> ''),
    q AS (SELECT *, school || ':' || doc_id || ':' || left(hash, 10) AS passage_id FROM p)"""
_FOUND = "list_filter([" + ", ".join(f"CASE WHEN contains(x, '{t}') THEN '{t}' END" for t in X.TERMS) + "], lambda v: v IS NOT NULL)[1:8]"
_INSTRUCTED = oracle.case([(f"register = '{k}'", v) for k, v in registry.INSTRUCTIONS.items()], "''")
_NONE = lambda k: f"'{k}': {{'status': 'unavailable', 'note': '{evidence.NO_FIELD[k]}'}}"
_EVIDENCE = ", ".join((
    "'source': {'text': ref, 'hash': sha256(ref)}, 'candidate': {'text': cand, 'hash': sha256(cand)}, 'deterministic_gate': gate, 'blocking': blocking", *map(_NONE, ("segmentation", "morphology", "syntax", "alignment", "lexical_evidence")),
    "'parallel_evidence': {'n_parallels': len(par), 'parallels': par[1:5]}", _NONE("intertextual_evidence"), "'candidate_distribution': {'n_candidates': 2, 'candidates': [ref, cand]}", *map(_NONE, ("evaluator_evidence", "terminology", "uncertainty")),
    f"'provenance': {{'run_signature': run_signature, 'method': '{evidence.METHOD}', 'schema_version': '{evidence.VERSION}'}}, 'decision': decision",
))

SQL = {
    "challenge_rows": f"WITH {_CHALLENGES} SELECT item_id, family, bad FROM challenge",
    "challenge_set": f"""WITH {_CHALLENGES}, capped AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY item_id) AS rn FROM challenge)
        SELECT item_id, family, good, bad FROM capped WHERE rn <= 14 ORDER BY item_id, family_order LIMIT 200""",
    "low_families": f"WITH {_JUDGED} SELECT family, count(*) AS n, min(event_id) AS first FROM low GROUP BY 1",
    "hypothesis_plan": f"WITH {_PLAN} SELECT * FROM plan",
    "hypothesis_trials": f"WITH {_TRIALS} SELECT item_id, family, left(hint || chr(10) || chr(10) || 'Translate this Sanskrit:', 20) AS asked, left(sha256(cand), 16) AS candidate, CAST(chrf AS DOUBLE) AS chrf, CAST(bleu1 AS DOUBLE) AS bleu1, gate AS proof_gate, array_to_string(blocking, ',') AS blocking FROM verdicts",
    "hypothesis_rounds": f"""WITH {_TRIALS}, m AS (SELECT item_id % 4 AS round, family, ord, avg(chrf) AS score FROM verdicts GROUP BY ALL), b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY round ORDER BY score DESC, ord) = 1),
        w AS (SELECT *, max(score) OVER (ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b) SELECT round, family, round(score, 6) AS score, before IS NULL OR score > before AS kept FROM w""",
    "translations": f"""WITH {oracle.TURNS}, t AS (SELECT conv_id, turn, ref, CASE WHEN length(ref) % 13 = 4 THEN '' ELSE {_STRIP("left(ref, 8 * CASE WHEN turn % 2 = 0 THEN 50 ELSE 30 END)")} END AS cand FROM turns), {oracle.default_gate('t')}
        SELECT conv_id, turn, left(sha256(cand), 16) AS translation, gate, NOT list_contains(blocking, 'COVERAGE') AS covered, CASE WHEN length(ref) % 13 = 4 THEN 'failed' ELSE 'answered' END AS status FROM verdicts""",
    "tier_tasks": f"WITH x AS ({oracle.SQL['school_index']}) SELECT CASE WHEN tier >= 3 THEN 'reasoning' ELSE 'extraction' END AS task, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_schools FROM x GROUP BY 1",
    "finetune_build": f"""WITH {oracle.TURNS}, {oracle.default_gate('turns')}, r AS (SELECT ref, cand, gate, {_quoted(X.REGISTERS)}[turn % 4 + 1] AS register, CASE WHEN turn % 3 = 0 THEN cand ELSE cand || ' .' END AS candidate FROM verdicts),
        u AS (SELECT '{registry.GOLD_INSTRUCTION}' AS instruction, ref AS input, cand AS output, 'natural' AS register, 'gold' AS source FROM r
              UNION ALL SELECT {_INSTRUCTED}, ref, candidate, register, 'render' FROM r WHERE gate = 'PASS' AND candidate <> cand)
        SELECT instruction, left(sha256(input), 16) AS input, left(sha256(output), 16) AS output, register, source FROM u""",
    "annotation_export": "SELECT 'mitra:' || (row_number() OVER (ORDER BY item_id) - 1) AS passage_id, text AS source, 'gold ' || text AS candidate_a, 'gold ' || text AS candidate_b, '' AS preference, 0 AS n_errors, true AS unjudged FROM benchmark ORDER BY item_id LIMIT 150",
    "baseline_audit": """SELECT DISTINCT conv_id, CASE WHEN conv_id % 11 = 0 THEN 'no baseline' WHEN conv_id % 13 = 0 THEN 'not computed' WHEN conv_id % 7 = 0 THEN 'differs' ELSE 'reproducible' END AS verdict FROM conversations WHERE conv_id % 11 <> 0 OR conv_id % 13 <> 0""",
    "file_violations": f"WITH {_RECORDS} SELECT * FROM v",
    "file_totals": f"WITH {_RECORDS} SELECT s.file, count(v.file) AS n_violations FROM stop s LEFT JOIN v USING (file) GROUP BY 1",
    "registry_build": f"""WITH {_REGISTRY} SELECT passage_id, school, CAST({oracle.case([(f"school = '{k}'", v) for k, v in X.TIERS.items()], "'2'")} AS INTEGER) AS tier, {oracle.case([(f"school = '{k}'", v) for k, v in X.PERIODS.items()], "'Epic'")} AS period,
        '{registry.GENRE}' AS genre, '{registry.LICENSE}' AS license, doc_id AS source_id, CASE WHEN len(tok) > 0 THEN round(len(list_filter(tok, lambda t: {oracle.TERM_HIT})) / len(tok), 4) ELSE 0 END AS term_density,
        len(list_filter(tok, lambda t: {oracle.TERM_HIT})) AS n_terms, array_to_string({_FOUND}, ',') AS found, 0 AS n_references FROM q""",
    "registry_manifest": f"""WITH {_REGISTRY}, r AS (SELECT 1 AS one, row_number() OVER (ORDER BY passage_id) - 1 AS n, sha256(passage_id || chr(1) || body || chr(1) || school) AS h FROM q), {oracle.hash_tree('r', 'one', 'n', 'h')}
        SELECT '0.1.0' AS version, (SELECT count(*) FROM q) AS n_passages, 2::BIGINT AS n_sources, 'exact,near_duplicate' AS defended, 8 AS n_requirements, h AS manifest_hash FROM tree""",
    "strategy_scores": "SELECT user_id, round(avg(CASE WHEN event_id % 4 <> 0 THEN value ELSE 0 END), 6) AS score FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 3) GROUP BY 1",
    "report_text": r"""WITH r AS (SELECT event_id, sha256(CAST(event_id AS VARCHAR)) AS sig FROM events), o AS (SELECT *, row_number() OVER (ORDER BY sig) AS k FROM r),
        x AS (SELECT event_id AS k, right('EXP-' || lpad(CAST(event_id AS VARCHAR), 12, '0'), 12) || ' & ' || printf('%.3f', event_id % 3 / 4) || ' & ' || printf('%.3f', event_id % 5 / 8) || ' & ' || CASE WHEN event_id % 2 = 0 THEN '0.5' ELSE '—' END || ' \\' AS line FROM events)
        SELECT (SELECT count(*) FROM r) || ' runs, ' || (SELECT count(*) FROM x) || ' experiments, 2026' || chr(10) || (SELECT string_agg(left(sig, 12), ', ' ORDER BY k) FROM o WHERE k <= 5) || chr(10) ||
            coalesce((SELECT string_agg('    ' || line, chr(10) ORDER BY k) FROM (SELECT * FROM x ORDER BY k LIMIT 50)), '') || chr(10) || (SELECT string_agg('claim ' || event_id || ' (run ' || left(sig, 12) || ')', '; ' ORDER BY k) FROM o WHERE k <= 3) AS report""",
    "server_bench": f"""WITH {oracle.METRICS}, {oracle.default_gate('m')}, top AS (SELECT * FROM verdicts ORDER BY conv_id, turn LIMIT 40)
        SELECT 'bench' AS product, count(*) AS n, round(avg(bleu1), 4) AS avg_bleu, round(avg(CASE WHEN gate = 'PASS' THEN 1.0::DOUBLE ELSE 0 END), 3) AS pass_rate FROM top UNION ALL SELECT 'bench of nothing', 0, 0, 0""",
    "evidence_nested": f"""WITH {oracle.TURNS}, {oracle.default_gate('turns')}, w AS (SELECT *, list_filter(string_split(cand, ' '), lambda x: x <> '') AS par, sha256(CAST(conv_id AS VARCHAR)) AS run_signature, CASE WHEN gate = 'PASS' THEN 'accepted' ELSE 'review' END AS decision FROM verdicts),
        o AS (SELECT *, CAST(to_json({{{_EVIDENCE}}}) AS VARCHAR) AS body FROM w)
        SELECT conv_id, turn, len(par) AS n_parallels, least(len(par), 5) AS n_kept, sha256(cand) AS candidate_hash, run_signature, decision, 0::BIGINT AS n_violations, sha256(body) AS artifact_hash FROM o""",
    "proof_scores": f"""WITH {oracle.METRICS}, {oracle.default_gate('m')} SELECT conv_id, turn, gate, CASE WHEN turn % 3 <> 0 AND ref <> '' THEN CAST(round(CAST(chrf AS DECIMAL(9, 4)), 3) AS DOUBLE) END AS gold_chrf, CASE WHEN gate = 'PASS' THEN 'accepted' ELSE 'review' END AS decision,
        'unavailable' AS source_semantic_coverage, 'unavailable' AS morphological_accounting, 'unavailable' AS critical_errors_detected, 'available' AS candidate_agreement FROM verdicts""",
    "severity_totals": "SELECT event_type, CAST(sum([1, 5, 25, NULL][event_id % 4 + 1]) AS BIGINT) AS weight, count([1, 5, 25, NULL][event_id % 4 + 1]) AS n FROM events GROUP BY 1",
    "host_verdicts": "SELECT s_suppkey, CASE WHEN s_acctbal / 4000 >= 1 THEN 'SAFE' WHEN s_acctbal / 4000 < 0.4 THEN 'CRITICAL' ELSE 'CAUTION' END AS verdict FROM supplier",
    "answer_cleanup": f"""WITH a AS (SELECT conv_id, turn, {_STRIP(f"regexp_replace(trim(' ' || text || '\"', '\"'), '^\"+|\"+$', '', 'g')")} AS answer FROM conversations)
        SELECT conv_id, turn, left(sha256(answer), 16) AS answer, left(answer, 50) AS head, len({oracle.words('answer')}) AS n_words FROM a""",
    "validity": f"""WITH {oracle.TURNS}, {oracle.default_gate('turns')}, s AS (SELECT *, CASE WHEN turn % 4 <> 3 THEN conv_id % 5 / 5 END AS semantic FROM verdicts)
        SELECT conv_id, turn, coalesce(gate = 'PASS' AND semantic >= 0.5, false) AS valid, coalesce(semantic < 1, false) AS caught FROM s""",
    "ledger_views": f"""WITH {oracle.ENTRIES} SELECT ledger AS view, CAST(count(*) AS VARCHAR) AS value FROM entries GROUP BY 1
        UNION ALL (SELECT 'EXP-1', 'EXP-' || conv_id FROM conversations WHERE conv_id % 9 <> 0 AND contains('EXP-' || conv_id, 'EXP-1') ORDER BY '{{"experiment_id":"EXP-' || conv_id || '","turn":' || turn || '}}' DESC LIMIT 3)""",
    "experiment_ids": f"""WITH r AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS n, sha256(event_id || chr(1) || user_id) AS h FROM events), {oracle.hash_tree('r', 'event_type', 'n', 'h')}
        SELECT event_type, 'EXP-char-' || event_type || '-' || left(h, 12) || '-' || strftime(first, '%Y%m%d%H%M%S') AS experiment_id FROM tree JOIN (SELECT event_type, min(ts) AS first FROM events GROUP BY 1) USING (event_type)""",
    "missing_references": """WITH r AS (SELECT page_id, 1 AS line, '/data/' || page_id % 40 AS path FROM pages UNION ALL SELECT page_id, 1, '/tools/x.py' FROM pages UNION ALL SELECT page_id, 2, '/data/' || page_id FROM pages)
        SELECT * FROM r WHERE path NOT IN (SELECT '/data/' || n_nationkey FROM nation)""",
    "ordered_union": """WITH w AS (SELECT conv_id, turn, string_split(lower(text), ' ') AS w FROM conversations), c AS (SELECT conv_id, turn, w[1:6] || w[4:9] AS u FROM w)
        SELECT conv_id, turn, array_to_string(list_filter(u, lambda x, i: list_position(u, x) = i), ' ') AS words FROM c""",
    "passages": f"WITH l AS ({oracle.LINES}), s AS (SELECT file, left(array_to_string(x, chr(10)), 300) AS source FROM l) SELECT file, length(source) AS n, sha256(source) AS sha FROM s",
    "render_sets": f"""WITH {oracle.TURNS}, {oracle.default_gate('turns')}, q AS (SELECT *, coalesce(gate = 'PASS' AND turn % 4 <> 3 AND turn % 5 / 4 >= 0.5, false) AS valid FROM verdicts),
        o AS MATERIALIZED (SELECT conv_id, turn, {oracle.bare('cand')} AS tb FROM q WHERE valid), v AS MATERIALIZED (SELECT conv_id, turn, {oracle.all_grams('tb', 'g')} FROM o),
        p AS MATERIALIZED (SELECT a.conv_id, a.g1 AS a1, a.g2 AS a2, a.g3 AS a3, b.g1 AS b1, b.g2 AS b2, b.g3 AS b3 FROM v a JOIN v b ON a.conv_id = b.conv_id AND a.turn < b.turn),
        w AS MATERIALIZED (SELECT conv_id, {oracle.shares('a', 'b')} FROM p), s AS (SELECT conv_id, avg({oracle.CHRF}) AS agree FROM w GROUP BY 1), n AS (SELECT conv_id, count(*) FILTER (valid) AS n_valid FROM q GROUP BY 1),
        d AS (SELECT n.conv_id, n_valid, round(coalesce(agree, 1), 3) AS agreement, round(1 - coalesce(agree, 1), 3) AS disagreement FROM n LEFT JOIN s USING (conv_id))
        SELECT *, CASE WHEN n_valid < 2 THEN 'insufficient-candidates' WHEN disagreement < 0.3 THEN 'convergent' WHEN disagreement < 0.55 THEN 'mixed' ELSE 'divergent-review' END AS verdict FROM d""",
    "memory_latest": """SELECT event_type AS step, CAST(user_id AS VARCHAR) AS key, event_id AS ord, 'Noted ' || event_id AS raw FROM events WHERE starts_with(CAST(event_id AS VARCHAR), '1')
        QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY strftime(ts, '%Y-%m-%d %H:%M:%S') DESC, event_id DESC) = 1""",
}
