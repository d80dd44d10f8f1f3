"""One query for each operator or group of operators, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import contracts, gates, lexicon, parsing, perturb, provenance, text
from loomtext.operators import agreement, ledger, parallels, rank, select, summaries
from loomtext.plans import lexicons as X
from loomtext.sources import lines


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent turns of a conversation as reference and candidate."""
    c = table(spark, sf_dir, "conversations")
    a = c.select("conv_id", "turn", "role", F.col("text").alias("ref"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("cand"))
    return a.join(b, ["conv_id", "turn"])


def chrf_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.with_metrics(turns(spark, sf_dir), "ref", "cand").select("conv_id", "turn", F.round("chrf", 4).alias("chrf"))


def bleu1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", "turn", text.bleu1(text.words(F.col("ref")), text.words(F.col("cand"))).alias("bleu1"))


def metrics_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = text.with_metrics(turns(spark, sf_dir), "ref", "cand")
    return m.groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg("chrf"), 4).alias("avg_chrf"), F.round(F.avg("bleu1"), 4).alias("avg_bleu1"), F.round(F.avg(text.combined(F.col("chrf"), F.col("bleu1"), F.lit(None))), 4).alias("avg_combined"))


def ngram_overlap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parallels.shared_grams(table(spark, sf_dir, "benchmark"), "item_id", "text", table(spark, sf_dir, "documents"), "doc_id", "text", 3, 3).select("item_id", "doc_id", "n_shared", "rank")


def gate_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, (s, c) = turns(spark, sf_dir), (F.col("ref"), F.col("cand"))
    t = t.withColumn("b", gates.blocking(s, c, X.RENDERINGS))
    return t.select(
        "conv_id", "turn", F.round(gates.binding_ratio(s, c), 2).alias("binding"), F.round(gates.coverage_ratio(s, c), 2).alias("coverage"), gates.translated(c).alias("translated"),
        F.array_join(gates.ungrounded(s, c, X.RENDERINGS), ",").alias("ungrounded"), F.array_join("b", ",").alias("blocking"), gates.gate(F.col("b")).alias("gate"), gates.decision(gates.gate(F.col("b"))).alias("decision"),
    )


def verify_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = text.with_metrics(turns(spark, sf_dir), "ref", "cand")
    ok = gates.gold_ok(F.col("chrf"), F.pmod("turn", F.lit(2)) == 0)
    g = gates.gate(gates.blocking(F.col("ref"), F.col("cand")))
    return m.select("conv_id", "turn", g.alias("gate"), ok.alias("gold_ok"), ((g == "PASS") & ok).alias("verified"), gates.result_id(F.col("ref"), F.col("cand")).alias("result_id"))


def junk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter(~text.is_junk(F.col("text"))).select("conv_id", "turn", F.length("text").cast("long").alias("n"), text.diacritics(F.col("text")).cast("long").alias("n_diacritics"))


def lexicon_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", lexicon.tag(F.col("text"), X.TONGUES, "english").alias("tongue"))


def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.counts_with_zeros(lexicon_tag(spark, sf_dir), "tongue", [*X.TONGUES, "latin"])


def term_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").withColumn("d", lexicon.term_density(F.col("text"), X.TERMS, X.TERM_LETTERS))
    return t.select("conv_id", "turn", F.col("d.n_terms").cast("long").alias("n_terms"), F.col("d.n_tokens").cast("long").alias("n_tokens"), F.col("d.term_density").alias("density"), F.array_join("d.found", ",").alias("found"))


def school_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("school", lexicon.detect(F.col("source"), X.FRAGMENTS))
    d = d.select(F.coalesce("school", F.lit(lexicon.UNCLASSIFIED)).alias("school"), lexicon.lookup(F.col("school"), X.TIERS, lexicon.DEFAULT_TIER).alias("tier"), lexicon.lookup(F.col("school"), X.PERIODS, lexicon.DEFAULT_PERIOD).alias("period"), "source", "n_chars")
    return d.groupBy("school", "tier", "period").agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_sources"), F.sum("n_chars").alias("chars"))


def _panel(spark: SparkSession, sf_dir: str, passage=None) -> DataFrame:
    """Labelled documents as candidates; a passage is a source, or what is given."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    w = text.words(F.col("text"))
    return d.select((F.col("source") if passage is None else passage).alias("passage"), "doc_id", F.col("n_chars").cast("double").alias("length"), w.alias("w"), F.col("quality").cast("double").alias("judge")).select(
        "passage", "doc_id", "length", F.round(F.size(F.array_distinct("w")) / F.greatest(F.size("w"), F.lit(1)), 6).alias("variety"), "judge"
    )


def gamma_by_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = rank.gamma(_panel(spark, sf_dir), ["passage"], "doc_id", ["length", "variety"], "judge")
    return g.select("passage", "metric", "n_pairs", F.round("gamma", 6).alias("gamma"))


def gamma_by_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.best_metric(rank.gamma(_panel(spark, sf_dir), ["passage"], "doc_id", ["length", "variety"], "judge"), ["length", "variety"], "length")


def pairwise_win_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.margin_wins(_panel(spark, sf_dir), ["passage"], "doc_id", "variety", 0.05)


def candidate_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("valid", (F.col("role") == "assistant") & (F.length("text") >= 8))
    return agreement.candidate_disagreement(c, "conv_id", "turn", "text", "valid")


def token_containment_parallels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parallels.containment_parallels(table(spark, sf_dir, "benchmark"), "item_id", "text", table(spark, sf_dir, "documents"), "doc_id", "text", 3)


def _parallels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parallels.with_texts(token_containment_parallels(spark, sf_dir), table(spark, sf_dir, "documents"), "doc_id", "text", "lang")


def triangulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = parallels.triangulate(_parallels(spark, sf_dir), table(spark, sf_dir, "benchmark"), "item_id")
    shown = F.transform("parallels", lambda p: F.concat_ws("|", p["other_id"], F.coalesce(p["lang"], F.lit("")), F.coalesce(p["text"], F.lit(""))))
    return t.select("item_id", "n_parallels", "available", text.pair_hash(F.array_join(shown, "/")).alias("parallels"))


def crosslingual_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that begin as the items do, with what their parallels in the corpus begin with."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.substring("text", 1, 60).alias("candidate"))
    return parallels.crosslingual(items, "item_id", "candidate", _parallels(spark, sf_dir))


def reference_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "benchmark").select(F.col("text").alias("src"), F.array(F.substring("text", 1, 20)).alias("refs"), F.col("item_id").alias("ord"))
    out = parallels.attach_references(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", refs, "src", "refs", "ord")
    return out.select("doc_id", F.array_join("references", "|").alias("refs"))


def challenges(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").withColumn("bad", perturb.all_perturbations(F.col("text")))
    names = F.array(*[F.lit(f) for f in perturb.FAMILIES])
    x = b.select("item_id", F.col("text").alias("good"), F.posexplode("bad").alias("family_order", "bad")).withColumn("family", F.element_at(names, F.col("family_order") + 1))
    return x.filter(F.col("bad").isNotNull() & (F.col("bad") != "") & (F.trim("bad") != F.trim("good")))


def challenge_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.capped_families(challenges(spark, sf_dir), "family", "family_order", "item_id", 200, len(perturb.FAMILIES)).select("item_id", "family", "good", "bad")


def challenge_simple_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return challenges(spark, sf_dir).filter(F.col("family").isin("ACCURACY_ADDITION", "STYLE", "SCOPE_NEGATION")).select("item_id", "family", "bad")


def challenge_pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", summaries.NOT_SEMANTIC).otherwise(F.col("event_type")).alias("family"), (F.col("value") < 25).alias("ok"))
    return summaries.challenge_rates(e, "family", "ok")


def per_group_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return select.cap_per_group(d, ["source"], ["doc_id"], 5).filter("n_chars > 300")


def capped_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.ascii("lang").alias("lang_order"))
    return select.capped_families(d, "lang", "lang_order", "doc_id", 90, 4).select("doc_id", "lang")


def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.avg("value"), 4).alias("score"))
    return select.running_best(days, ["event_type"], "day", "score").select("event_type", "day", "score", "best_before", "kept")


def best_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return select.best_trial(e, ["event_type"], F.col("value"), "event_id")


def run_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    e = select.latest(e, ["user_id", "event_type"], ["ts", "event_id"])
    kind = gates.epistemic_kind(F.col("event_type") == "purchase", F.col("value") > 50, F.col("event_type") == "view")
    return e.select("user_id", "event_type", "event_id", "value", kind.alias("kind"))


def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.seeded_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 100)


def price_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    prices = p.select(F.regexp_replace("p_name", " ", "-").alias("id"), (F.floor("p_retailprice") / 1e9).alias("prompt"), (F.col("p_size") / 1e7).alias("completion"), F.col("p_partkey").alias("ord"))
    usage = p.select(F.concat(F.when(F.pmod("p_partkey", F.lit(2)) == 0, "vendor/").otherwise(""), F.regexp_replace("p_name", " ", "-"), F.when(F.pmod("p_partkey", F.lit(3)) == 0, "-v2").otherwise("")).alias("model"), F.col("p_size").alias("quality"))
    found = summaries.price_lookup(usage, "model", prices, "id", "ord")
    best = usage.groupBy("model").agg(F.avg("quality").alias("quality"))
    return summaries.with_cost(best.join(found, "model"), "prompt", "completion", "quality").select("model", "id", "match_level", "cost", "cost_per_1000", "quality_per_cost")


def schema_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    raw = F.when(F.pmod("event_id", F.lit(11)) == 0, F.substring("props", 1, 5)).when(F.pmod("event_id", F.lit(7)) == 0, F.regexp_replace("props", ": ", ': "')).otherwise(F.col("props"))
    bad = contracts.violations(F.when(F.pmod("event_id", F.lit(77)) == 7, '{"k": "1"}').otherwise(F.when(F.pmod("event_id", F.lit(13)) == 0, "{}").otherwise(raw)), {"k": "integer"})
    return e.select(F.explode_outer(bad).alias("violation")).groupBy(F.coalesce("violation", F.lit("valid")).alias("violation")).agg(F.count("*").alias("n"))


def annotation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "A").when(F.pmod("doc_id", F.lit(5)) == 0, "neither").otherwise("tie").alias("preference"), F.when(F.col("toxic") == 1, F.lit(None)).otherwise(F.pmod("doc_id", F.lit(2)) == 0).alias("no_major_error"))
    rec = F.to_json(F.struct(F.col("doc_id").cast("string").alias("passage_id"), "preference", "no_major_error"))
    v = contracts.violations(rec, {"passage_id": "text", "preference": "text", "no_major_error": "truth"}, {"preference": ("A", "B", "tie", "")})
    return d.select("doc_id", F.array_join(v, ";").alias("violations"))


def content_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    h = provenance.passage_hash(F.col("text"), F.col("source"))
    return d.select("doc_id", h.alias("hash"), provenance.passage_id(F.col("source"), F.col("doc_id").cast("string"), h).alias("passage_id"), provenance.result_id(F.lit("v1"), F.col("text"), F.col("lang")).alias("result_id"))


def gold_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = provenance.set_hash(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], ["role", "text"], "gold_hash")
    return c.select("conv_id", "gold_hash", provenance.run_signature(F.col("gold_hash"), F.lit("code"), F.lit("config")).alias("run_signature"))


def ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.col("event_type").alias("step"), "event_id")).alias("value"))
    c = table(spark, sf_dir, "conversations").select(F.when(F.pmod("conv_id", F.lit(9)) == 0, "{broken").otherwise(F.to_json(F.struct(F.concat(F.lit("EXP-"), "conv_id").alias("experiment_id"), "turn"))).alias("value"))
    return ledger.union([ledger.read_lines(e, "events"), ledger.read_lines(c, "conversations")])


def ledger_step_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.step_counts(ledgers(spark, sf_dir))


def ledger_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.recent(ledger.search(ledgers(spark, sf_dir), "PURCHASE", 20), 10).select("ledger", "ts", "step")


def experiment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = text.with_metrics(turns(spark, sf_dir), "ref", "cand")
    m = m.withColumn("gate", gates.gate(gates.blocking(F.col("ref"), F.col("cand")))).withColumn("semantic", F.when(F.pmod("turn", F.lit(3)) != 0, F.pmod("conv_id", F.lit(6)) / 5))
    return summaries.experiment_summary(m.withColumn("latency", F.length("cand") / 100), ["role"], "gate", "chrf", "bleu1", "semantic", "latency")


def finetune_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).withColumn("register", select.cyclic(F.col("turn"), list(X.REGISTERS)))
    t = t.filter((gates.gate(gates.blocking(F.col("ref"), F.col("cand"))) == "PASS") & (F.col("ref") != F.col("cand")))
    return t.select("conv_id", "turn", "register", lexicon.lookup(F.col("register"), X.INSTRUCTIONS, "").alias("instruction"), F.lit("render").alias("source"))


def register_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finetune_pairs(spark, sf_dir).groupBy("register").agg(F.count("*").alias("n"))


def evidence_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.with_metrics(turns(spark, sf_dir), "ref", "cand")
    g = gates.gate(gates.blocking(F.col("ref"), F.col("cand")))
    t = t.select("conv_id", "turn", text.pair_hash(F.col("ref")).alias("source_sha"), text.pair_hash(F.col("cand")).alias("candidate_sha"), g.alias("gate"), gates.decision(g).alias("decision"), F.format_string("%.4f", "chrf").alias("chrf_text"))
    return t.withColumn("artifact_hash", provenance.content_hash(*[F.col(c) for c in ("source_sha", "candidate_sha", "gate", "decision", "chrf_text")]))


def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each conversation: the disagreement of its answers; its number stands for the benchmark item that its parallels are of."""
    from loomtext.plans.evidence import feature_vector

    d = candidate_disagreement(spark, sf_dir)
    p = crosslingual_agreement(spark, sf_dir).withColumnRenamed("item_id", "conv_id")
    z = feature_vector(F.col("disagreement"), F.col("verdict"), F.col("crosslingual"), F.col("n_parallels"))
    return d.join(p, "conv_id", "left").select("conv_id", F.explode(z).alias("feature", "z")).select("conv_id", "feature", "z.value", "z.status", "z.note", "z.verdict", "z.n_parallels")


def semantic_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.get_json_object("props", "$.k").cast("long")
    body = F.concat(F.lit('{"fidelity": '), F.pmod(n, F.lit(9)).cast("string"), F.lit(', "judgment": "compound lost '), n.cast("string"), F.lit('"}'))
    reply = F.when(F.pmod(n, F.lit(10)) == 0, "no object").otherwise(F.concat(F.lit("```json\nreply "), body, F.lit("\n```")))
    e = table(spark, sf_dir, "events").select("event_id", reply.alias("reply"))
    return e.select("event_id", parsing.fidelity(F.col("reply")).alias("fidelity"), parsing.judgment(F.col("reply"), 12).alias("judgment"), lexicon.error_family(parsing.judgment(F.col("reply"))).alias("family"))


def balanced_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("before "), F.regexp_replace("props", r"\}", ",}"), F.lit(" after }")).alias("raw"))
    return e.select("event_id", parsing.extract_object(F.col("raw")).alias("object"))


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomtext.operators import hypotheses

    rows = semantic_parse(spark, sf_dir).withColumn("chrf", F.lit(1.0))
    return hypotheses.observations(hypotheses.low_rows(rows, "fidelity", "chrf", "judgment"), "judgment", "event_id")


def file_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.index(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "text"), "file", "text")


def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    a = lines.numbered(d.select(F.col("doc_id").alias("file"), "text"), "file", "text")
    b = lines.numbered(d.select((F.col("doc_id") - 1).alias("file"), "text"), "file", "text")
    return lines.zip_lines(a, b, ["file"]).select("file", "i", F.length("source").cast("long").alias("n_source"), F.length("gold").cast("long").alias("n_gold"))


def path_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("see data/"), F.regexp_replace("url", r"^https?://", ""), F.lit(", and tools/x.py.")).alias("t"))
    return p.select("page_id", F.array_join(summaries.path_tokens(F.col("t"), ["data", "tools"]), "|").alias("paths"))


def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, n = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    return summaries.missing_files(d, "doc_id", n, "doc_id")


def decontamination_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "nation").select("n_nationkey", F.slice(F.array(*[F.lit(x) for x in X.LEVELS]), 1, F.pmod("n_nationkey", F.lit(5)).cast("int")).alias("declared"))
    yes, no = summaries.level_split(F.col("declared"), list(X.LEVELS))
    return d.select("n_nationkey", F.array_join(yes, ",").alias("defended"), F.array_join(no, ",").alias("open"))


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.sha2(F.col("event_id").cast("string"), 256).alias("run_signature"), F.when(F.col("value") > 1, F.col("value")).alias("nanopublication"))


def registry_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.registry_audit(_audited(spark, sf_dir), ["run_signature", "nanopublication"], "run_signature")


def registry_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.incomplete_records(_audited(spark, sf_dir), ["run_signature", "nanopublication"], "run_signature")


QUERIES = {
    f.__name__: f
    for f in (
        chrf_pairs, bleu1_pairs, metrics_by_role, ngram_overlap_topk, gate_checks, verify_pairs, junk_filter, lexicon_tag, tag_counts, term_density, school_index, gamma_by_passage, gamma_by_metric, pairwise_win_rank,
        candidate_disagreement, token_containment_parallels, triangulation, crosslingual_agreement, reference_attach, challenge_set, challenge_simple_rules, challenge_pass_rate, per_group_cap, capped_families, running_best, best_trial, run_upsert,
        seeded_sample, price_lookup, schema_gate, annotation_checks, content_address, gold_hashes, ledger_step_counts, ledger_tail, experiment_summary, finetune_pairs, register_counts,
        evidence_objects, feature_vectors, semantic_parse, balanced_objects, proposals, file_index, positional_zip, path_references, manifest_check, decontamination_levels, registry_audit, registry_missing,
    )
}
