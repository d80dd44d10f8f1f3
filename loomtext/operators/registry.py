"""Registries of benchmark passages, fine-tuning pairs, annotation sheets, baselines and files of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import lexicon, provenance
from loomtext.functions.contracts import violations
from loomtext.operators.select import cap_per_group
from loomtext.sources import lines
from loomtext.sources.scratch import written

# What the default registry says of each passage, what every reported number must carry, and its decontamination levels.
GENRE, SOURCE_DATE, LICENSE = "sastra", "classical", "CC-BY 4.0"
LINEAGE = ("model", "checkpoint", "decoding_config", "metric_version", "test_set_version", "reference_set", "human_gold_split", "date")
DEFENDED = ("exact", "near_duplicate")
# Instructions of fine-tuning pairs by register, and that of a gold pair.
INSTRUCTIONS = {
    "literal": "Translate this Sanskrit literally, preserving word order.",
    "plain": "Translate this Sanskrit into plain, simple modern English.",
    "precise": "Translate this Sanskrit with scholarly precision, keeping terms exact.",
    "natural": "Translate this Sanskrit naturally and idiomatically.",
}
GOLD_INSTRUCTION = "Translate this Sanskrit faithfully into English."


def benchmark_rows(files: DataFrame, file: str, name: str, text: str, n: int = 5, most: int = 2000, fragments=lexicon.SCHOOL_FRAGMENTS, tiers=lexicon.SCHOOL_TIER, periods=lexicon.SCHOOL_PERIOD, terms: dict = lexicon.SCHOOL_TERMS, letters: str = lexicon.LETTERS) -> DataFrame:
    """Passages of texts (file, name, text): the first n files of each school, by file, tagged, then those with any content line.

    The cap comes before the filter; only capped texts are read into passages and have their terms counted.
    """
    tagged = files.select(F.col(file).alias("source_id"), lexicon.detect(F.col(name), fragments).alias("school"), F.col(text).alias("_text")).filter("school IS NOT NULL")
    capped = cap_per_group(tagged, ["school"], ["source_id"], n)
    source = F.substring(F.array_join(lines.content("_text"), "\n"), 1, most)
    rows = capped.withColumn("source", source).filter("source <> ''").drop("_text")
    density = None
    for school, words in terms.items():
        counted = lexicon.term_density(F.col("source"), words, letters)
        density = F.when(F.col("school") == school, counted) if density is None else density.when(F.col("school") == school, counted)
    rows = rows.withColumn("d", density)
    return rows.select("source", "school", lexicon.lookup(F.col("school"), tiers, lexicon.DEFAULT_TIER).alias("tier"), lexicon.lookup(F.col("school"), periods, lexicon.DEFAULT_PERIOD).alias("period"), "source_id", "d.term_density", F.col("d.n_terms").cast("long").alias("n_terms"), F.slice("d.found", 1, 8).alias("school_terms_found"))


def add_passages(rows: DataFrame, genre: str = GENRE, source_date: str = SOURCE_DATE, license: str = LICENSE) -> DataFrame:
    """Rows as passages of a registry: content hash, id, constants, and no references or other senses yet."""
    h = provenance.passage_hash(F.col("source"), F.col("school"))
    out = rows.withColumn("hash", h).withColumn("passage_id", provenance.passage_id(F.col("school"), F.col("source_id").cast("string"), F.col("hash")))
    out = out.withColumns({"genre": F.lit(genre), "source_date": F.lit(source_date), "license": F.lit(license)})
    return out.withColumns({"references": F.array().cast("array<string>"), "alternative_senses": F.create_map().cast("map<string,array<string>>")})


def add_sources(spark, sources: list[tuple[str, str, str, str, str]]) -> DataFrame:
    """The side table of a registry: source_id, name, url, license and date; the last entry of an id stands."""
    return spark.createDataFrame(list({s[0]: s for s in sources}.values()), "source_id string, name string, url string, license string, date string")


def manifest(passages: DataFrame, version: str, sources: DataFrame | None = None, defended: tuple[str, ...] = DEFENDED, lineage: tuple[str, ...] = LINEAGE) -> DataFrame:
    """One row: version, n_passages, n_sources, defended levels, lineage requirements and a hash of the passages' content alone."""
    tagged = passages.withColumn("version", F.lit(version))
    out = tagged.groupBy("version").agg(F.count("*").alias("n_passages")).join(provenance.set_hash(tagged, ["version"], ["passage_id"], ["passage_id", "source", "school"], "manifest_hash"), "version")
    n = F.lit(0 if sources is None else sources.count()).cast("long")
    return out.withColumns({"n_sources": n, "defended": F.array(*map(F.lit, defended)), "lineage_requirements": F.array(*map(F.lit, lineage))})


def model_task(tier: Column) -> Column:
    """What a model is picked for, by difficulty."""
    return F.when(tier >= 3, "reasoning").otherwise("extraction")


def finetune_build(golds: DataFrame, renders: DataFrame) -> DataFrame:
    """instruction, input, output, register, source: each gold row as a natural pair, and each valid render that differs from its gold.

    golds: source, gold. renders: source, gold, candidate, register, valid.
    """
    natural = golds.select(F.lit(GOLD_INSTRUCTION).alias("instruction"), F.col("source").alias("input"), F.col("gold").alias("output"), F.lit("natural").alias("register"), F.lit("gold").alias("source"))
    other = renders.filter(F.col("valid") & (F.col("candidate") != F.col("gold")))
    other = other.select(lexicon.lookup(F.col("register"), INSTRUCTIONS, "").alias("instruction"), F.col("source").alias("input"), F.col("candidate").alias("output"), "register", F.lit("render").alias("source"))
    return natural.unionByName(other)


def annotation_export(golds: DataFrame, order: str, n: int, name: str = "mitra") -> DataFrame:
    """The first n gold rows as sheets to annotate: gold in both slots, the rest left open."""
    head = golds.orderBy(order).limit(n)
    i = F.row_number().over(Window.orderBy(order)) - 1  # n rows
    errors = F.array().cast("array<struct<span:string,family:string,severity:string>>")
    return head.select(
        F.concat(F.lit(f"{name}:"), i.cast("string")).alias("passage_id"), "source", F.col("gold").alias("candidate_a"), F.col("gold").alias("candidate_b"), F.lit("").alias("preference"), F.lit("").alias("preference_reason"),
        errors.alias("errors"), F.lit(None).cast("boolean").alias("no_major_error"), F.lit("").alias("annotator"), F.lit("").alias("ts"),
    )


def compare_baseline(now: DataFrame, baseline: DataFrame, key: str, digest: str) -> DataFrame:
    """key and verdict: whether what was computed again has the baseline's hash; "no baseline" and "not computed" where a side is missing."""
    both = now.select(F.col(key), F.col(digest).alias("_new")).join(baseline.select(F.col(key), F.col(digest).alias("_old")), key, "full")
    verdict = F.when(F.col("_old").isNull(), "no baseline").when(F.col("_new").isNull(), "not computed").when(F.col("_old") == F.col("_new"), "reproducible").otherwise("differs")
    return both.select(key, verdict.alias("verdict"))


def file_violations(lines_: DataFrame, file: str, nth: str, line: str, contract, discriminator: str | None = None) -> DataFrame:
    """file, i and message of each violation in files of JSON lines, as "file:i: what".

    Blank lines are skipped, as are records without the discriminator. A line that is no JSON is the last thing that is said of
    its file, as "file: invalid JSON": what comes after it is not read.
    """
    raw = F.trim(F.col(line))
    rows = lines_.filter(raw != "").select(F.col(file).alias("file"), F.col(nth).alias("i"), raw.alias("raw"), F.try_parse_json(raw).isNull().alias("broken"))
    stop = written(rows.filter("broken").groupBy("file").agg(F.min("i").alias("stop")))  # written, so that a hot file can be split in the join
    rows = rows.join(stop, "file", "left").filter("stop IS NULL OR i <= stop")
    if discriminator:
        rows = rows.filter(F.col("broken") | F.coalesce(F.array_contains(F.json_object_keys("raw"), discriminator), F.lit(False)))
    found = rows.select("file", "i", "broken", F.explode(violations(F.col("raw"), contract)).alias("what"))
    return found.select("file", "i", F.when(F.col("broken"), F.concat("file", F.lit(": invalid JSON"))).otherwise(F.concat("file", F.lit(":"), F.col("i").cast("string"), F.lit(": "), "what")).alias("message"))


def file_totals(files: DataFrame, file: str, found: DataFrame) -> DataFrame:
    """Each file with its number of violations, also of files without any, and the share of all."""
    n = found.groupBy("file").agg(F.count("*").alias("n"))
    return files.select(F.col(file).alias("file")).distinct().join(n, "file", "left").select("file", F.coalesce("n", F.lit(0)).cast("long").alias("n_violations"))


def define(nodes: DataFrame, name: str, effect: str, prereqs: list[str]) -> DataFrame:
    """The graph with a checkpoint that is OPEN, in place of one of that name."""
    spark = nodes.sparkSession
    old = nodes.filter(F.col("name") == name).agg(F.min("ord").alias("o")).first()["o"]
    at = old if old is not None else (nodes.agg(F.max("ord")).first()[0] or 0) + 1
    row = spark.createDataFrame([(at, name, effect, "OPEN", prereqs)], f"ord {nodes.schema['ord'].dataType.simpleString()}, name string, effect string, status string, prereqs array<string>")
    return nodes.filter(F.col("name") != name).select("ord", "name", "effect", "status", "prereqs").unionByName(row)


def mark(nodes: DataFrame, name: str, passed: bool = True) -> DataFrame:
    """The graph after a checkpoint's gate: DONE or FAILED, if all its prerequisites are DONE; else unchanged."""
    from loomtext.operators.summaries import ready

    status = F.when((F.col("name") == name) & F.col("ready"), "DONE" if passed else "FAILED").otherwise(F.col("status"))
    return ready(nodes).withColumn("status", status).drop("ready")
