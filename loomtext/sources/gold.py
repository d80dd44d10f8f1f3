"""Loaders of gold rows: source, gold, passage_id and tags, from record files, published passages, line pairs and JSON lines.

Files are read by Spark, so any store will do. Every loader gives an `ord` column, the order that heads and first matches go by.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.functions.lexicon import TRADITIONS, DEFAULT_TRADITION, tag
from loomtext.functions.text import bleu1, chrf, is_junk, with_grams, words
from loomtext.sources.lines import anything, numbered_files, read_files
from loomtext.sources.scratch import once

# Stages of a record in the order of preference; prefix of a source that the truncating loader keeps.
LAB_STAGES, GOLD_STAGES, SOURCE_PREFIX = ("L2", "l2", "T1", "t1"), ("L2", "l2"), 400


def _files(spark: SparkSession, path: str) -> DataFrame:
    """file and its whole text; malformed ones give null fields later, and no file no row."""
    return read_files(spark, path).withColumnRenamed("text", "raw")


def _fields(df: DataFrame, *kept: str, json: str = "json", **paths: str) -> DataFrame:
    """The columns that are kept, and for each name the field at its path (`$.key`, or `$.key.inner`): its item, text and kind (STRING, OBJECT<..>, ARRAY<..> or another); all null without the field.

    All fields are taken in one pass over the keys that an object has: a path that leads nowhere is left by an exception, which takes several times as long
    as a field that is there. Keys that differ by case alone are told apart by their places. Neither this nor what reads it has lambdas, which Spark interprets, and with them all that is made beside them.
    """
    inner: dict[str, dict[str, str]] = {}
    for name, path in paths.items():
        key, _, below = path.removeprefix("$.").partition(".")
        inner.setdefault(key, {})[name] = below
    shape = lambda fields: f"struct<{', '.join(f'`{k}`: {kind}' for k, kind in fields)}>"
    kinds = [shape((below, "variant") for below in names.values()) if all(names.values()) else "variant" for names in inner.values()]
    keys = [f"_{i}" for i in range(len(kinds))]
    df = df.select(*kept, F.inline(F.array(F.try_variant_get(json, "$", shape(zip(inner, kinds, strict=True)))))).toDF(*kept, *keys)
    df = df.select(*kept, *(key if kind == "variant" else f"{key}.*" for key, kind in zip(keys, kinds, strict=True))).toDF(*kept, *(name for names in inner.values() for name in names))
    return once(df, *kept, **{name: F.expr(f"struct({name} AS item, try_variant_get({name}, '$', 'string') AS text, schema_of_variant({name}) AS kind)") for name in paths})


def _first(*fields: str) -> Column:
    """The first field that says anything, or null: that is not null, not empty text, an empty list or object, zero or false."""
    said = lambda f: f"{f}.kind <> 'VOID' AND {f}.text NOT IN ('', '{{}}', '[]') AND NOT ({f}.kind <> 'STRING' AND {f}.text IN ('0', '0.0', 'false'))"
    return F.expr(f"coalesce({', '.join(f'CASE WHEN {said(f)} THEN {f} END' for f in fields)})")


def _text(field: str, path: str) -> Column:
    """The text of a field, of another kind than text as it stands in the raw text, which is then parsed again."""
    return F.when(F.col(f"{field}.kind") == "STRING", F.col(f"{field}.text")).when(F.col(f"{field}.kind").isNotNull(), F.get_json_object("raw", path))


def _ordered(df: DataFrame, *by: str) -> DataFrame:
    return df.withColumn("ord", F.struct(*by))


def _stage(df: DataFrame, *kept: str, stages: tuple[str, ...]) -> DataFrame:
    """The columns that are kept, and as gold, of the first stage that says anything: of an object its close translation, else its
    translation, else nothing; of a list its parts joined; else its text. stages: fields of df.

    A later stage does not stand in for one that says something else.
    """
    df = once(df, *kept, said=_first(*stages))
    df = once(df, *kept, text=F.col("said.text"), kind=F.col("said.kind"), item=F.col("said.item"))
    df = _fields(df, *kept, "text", "kind", json="item", close="$.close_translation", plain="$.translation")
    of_list = F.array_join(F.from_json("text", "array<string>"), " ")
    told = F.when(F.col("kind").startswith("OBJECT"), _first("close", "plain")["text"]).when(F.col("kind").startswith("ARRAY"), of_list).otherwise(F.col("text"))
    return once(df.select(*kept, told.alias("told")), *kept, gold=F.col("told"))  # a list is parsed by a function that is not compiled, and a generator with it is interpreted as a whole


def records(spark: SparkSession, path: str, stages: tuple[str, ...] = LAB_STAGES, tradition: str | None = None) -> DataFrame:
    """Gold records, one JSON file each. Rows without source or gold, or whose gold is an unread object, are dropped; a record without passage_id goes by its file's name."""
    df = once(_files(spark, path), "file", "raw", json=F.try_parse_json("raw"))
    at = {"source_text": "$.source.source_text", "source": "$.source.text", "id": "$.passage_id"}
    fields = {f"stage{k}": f"$.stages.{s}" for k, s in enumerate(stages)}
    df = _fields(df, "file", "raw", **at, **fields)
    df = once(df, "file", *fields, source=F.coalesce(_text("source_text", at["source_text"]), _text("source", at["source"])), passage_id=F.coalesce(_text("id", at["id"]), "file"))
    df = _stage(df, "source", "passage_id", "file", stages=tuple(fields)).filter((F.coalesce("source", F.lit("")) != "") & (F.coalesce("gold", F.lit("")) != "") & ~F.col("gold").startswith("{"))
    if tradition is None:
        df = once(df, "source", "gold", "passage_id", "file", low=F.lower("source"))
        label = F.when(F.lower("file").contains("krama"), "Krama").otherwise(tag("low", TRADITIONS, DEFAULT_TRADITION))
    else:
        label = F.lit(tradition)
    return _ordered(df.select("source", "gold", "passage_id", "file", label.alias("tradition")), "file").drop("file")


def published(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Published passages, one JSON file each; malformed files are skipped; most: characters of the source that are kept.

    The source is the field `source`, or else `source_text`: an object's text, or plain text. The gold text is l2_text, or
    else l2. A passage without id goes by its file's name.
    """
    df = once(_files(spark, path), "file", "raw", json=F.try_parse_json("raw"))
    df = _fields(df, "file", "raw", id="$.id", source="$.source", source_text="$.source_text", l2_text="$.l2_text", l2="$.l2")
    df = once(df, "file", passage_id=F.coalesce(_text("id", "$.id"), "file"), s=_first("source", "source_text"), gold=_first("l2_text", "l2")["text"])
    source = F.when(F.col("s.kind").startswith("OBJECT"), F.get_json_object("s.text", "$.text")).otherwise(F.col("s.text"))
    df = once(df.filter("gold IS NOT NULL"), "gold", "passage_id", "file", source=F.substring(source, 1, most) if most else source).filter(F.coalesce("source", F.lit("")) != "")
    return _ordered(df.select("source", "gold", "passage_id", "file").withColumn("tradition", tag(F.col("source"))), "file").drop("file")


def json_pairs(spark: SparkSession, path: str, source: str = "sanskrit", gold: str = "english", passage_id: str = "mitra") -> DataFrame:
    """JSON lines of a source and a gold text; blank and malformed lines are skipped, and without a file there is no row."""
    df = numbered_files(spark, path).select(F.get_json_object("line", f"$.{source}").alias("source"), F.get_json_object("line", f"$.{gold}").alias("gold"), F.lit(passage_id).alias("passage_id"), "file", "i")
    df = df.filter("source IS NOT NULL AND gold IS NOT NULL").withColumn("tradition", tag(F.col("source")))
    return _ordered(df, "file", "i").drop("file", "i")


def line_pairs(spark: SparkSession, source_path: str, gold_path: str, name: str, n: int | None = None) -> DataFrame:
    """Two files aligned by line: trimmed, dropped if either side is blank, numbered by the original line; the first n."""
    a, b = numbered_files(spark, source_path), numbered_files(spark, gold_path)
    df = a.select("i", F.trim("line").alias("source")).join(b.select("i", F.trim("line").alias("gold")), "i").filter("source <> '' AND gold <> ''")
    df = df.select("source", "gold", F.concat(F.lit(f"{name}:"), "i").alias("passage_id"), F.lit("test").alias("split"), F.struct("i").alias("ord"))
    return df.orderBy("ord").limit(n) if n else df


def canon_sample(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first n lines of gzip JSON lines, projected to nine fields; malformed lines use up n but give no row."""
    head = spark.read.text(path).withColumn("i", F.monotonically_increasing_id()).orderBy("i").limit(n)  # one gzip file is one partition
    raw = F.col("value")
    get = lambda k: F.coalesce(F.get_json_object(raw, f"$.{k}"), F.lit(""))
    first = lambda k: F.coalesce(F.get_json_object(raw, f"$.{k}[0]"), F.lit(""))
    good = head.filter(F.try_parse_json(raw).isNotNull())
    return good.select(get("id").alias("id"), get("src_lang").alias("src_lang"), get("tgt_lang").alias("tgt_lang"), get("score").alias("score"), get("gemini_score").alias("gemini_score"), get("sanskrit").alias("sanskrit"), get("parallel").alias("parallel"), first("root_segnr").alias("root_id"), first("par_segnr").alias("par_id"), "i")


def exemplars(*parts: DataFrame) -> DataFrame:
    """All parts, in order, with repetitions (a bag union)."""
    out = None
    for k, p in enumerate(parts):
        p = p.select("source", "gold", "passage_id", "tradition", F.lit(k).alias("part"), F.to_json("ord").alias("ord"))
        out = p if out is None else out.unionByName(p)
    return out


def clean(rows: DataFrame, part: int | None = None) -> DataFrame:
    rows = rows.filter(~is_junk(F.col("gold")))
    return rows if part is None else rows.filter(F.col("part") == part)


def first_gold(rows: DataFrame, passage_id: str) -> DataFrame:
    """The first row of an id in load order."""
    return rows.filter(F.col("passage_id") == passage_id).orderBy("part", "ord").limit(1)


def of_tradition(rows: DataFrame, tradition: str) -> DataFrame:
    return rows.filter(F.col("tradition") == tradition)


def traditions(spark: SparkSession) -> DataFrame:
    """The labels, in order."""
    return spark.createDataFrame([(k, t) for k, t in enumerate(TRADITIONS)], "ord int, tradition string")


def score_vs_gold(rows: DataFrame, candidates: DataFrame, metric: str = "chrf") -> DataFrame:
    """Adds score to candidates (passage_id, candidate, ..): a metric against the first gold row of the id; 0 for an unknown id."""
    first = rows.groupBy("passage_id").agg(F.min_by("gold", F.struct("part", "ord")).alias("gold"))
    both = candidates.join(first, "passage_id", "left")
    if metric == "chrf":
        scored = with_grams(with_grams(both, "gold", "_g"), "candidate", "_c").withColumn("score", chrf("_g", "_c"))
    else:
        scored = both.withColumn("score", bleu1(words(F.col("gold")), words(F.col("candidate"))))
    return scored.select(*candidates.columns, F.when(F.col("gold").isNull(), 0.0).otherwise(F.col("score")).alias("score"))


def catalogue(samples: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """name, n and the language pairs of each sample."""
    out = spark.createDataFrame([], "name string, n long, pairs string")
    for name, df in samples.items():
        pairs = F.array_join(F.array_sort(F.collect_set(F.concat_ws("-", "src_lang", "tgt_lang"))), ",")
        out = out.unionByName(df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), pairs.alias("pairs")))
    return out


def available(spark: SparkSession, datasets: dict[str, tuple[str, Callable[[SparkSession, str], DataFrame]]]) -> DataFrame:
    """name, imported (whether there is anything at its path) and n, the number of rows that its loader gives, of each dataset."""
    told = [load(spark, path).agg(F.lit(name).alias("name"), F.lit(anything(spark, path)).alias("imported"), F.count("*").alias("n")) for name, (path, load) in datasets.items()]
    return reduce(DataFrame.unionByName, told) if told else spark.createDataFrame([], "name string, imported boolean, n long")


def price_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """id, prompt, completion and ord of a catalogue that is a list of models or an object by id."""
    raw = _files(spark, path).select(F.coalesce(F.get_json_object("raw", "$.models"), F.col("raw")).alias("m"))
    one = "struct<id:string,prompt_per_token:double,completion_per_token:double>"
    listed = raw.filter(F.col("m").startswith("[")).select(F.posexplode(F.from_json("m", f"array<{one}>")).alias("ord", "e")).select("e.id", "e.prompt_per_token", "e.completion_per_token", "ord")
    keyed = raw.filter(F.col("m").startswith("{")).select(F.posexplode(F.from_json("m", f"map<string,{one}>")).alias("ord", "k", "e")).select(F.col("k").alias("id"), "e.prompt_per_token", "e.completion_per_token", "ord")
    return listed.unionByName(keyed).withColumnsRenamed({"prompt_per_token": "prompt", "completion_per_token": "completion"})


def registry_rows(spark: SparkSession, path: str, key: str = "avg_chrF") -> DataFrame:
    """Lines of a registry that are records of one kind: those with the key."""
    return numbered_files(spark, path).filter(F.array_contains(F.json_object_keys("line"), key)).select("i", F.col("line").alias("raw"))


def run_records(spark: SparkSession, path: str) -> DataFrame:
    """run_signature, kind and raw text of run records, one JSON file each, in the order of their signatures."""
    f = _files(spark, path)
    return f.select(F.get_json_object("raw", "$.run_signature").alias("run_signature"), F.get_json_object("raw", "$.kind").alias("kind"), F.get_json_object("raw", "$.ts").alias("ts"), "raw").filter("run_signature IS NOT NULL").orderBy("run_signature")


def first_per(rows: DataFrame, group: str, n: int) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy("ord"))).filter(F.col("_rn") <= n).drop("_rn")
