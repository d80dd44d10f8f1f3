"""Queries that write files from the given tables, read them by the loaders, and what they give, with their DuckDB SQL over the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import lexicon, provenance, text
from loomtext.operators import ledger
from loomtext.plans import oracle, steps
from loomtext.plans.queries import table, turns
from loomtext.sources import gold, lines, sinks
from loomtext.sources.scratch import scratch, spread, written


def _flat(c) -> object:
    return F.regexp_replace(c, r"[\r\n]+", " ")


def _told(suppliers: DataFrame) -> DataFrame:
    """What files are made of: a key, a name, a region and a note for each supplier. A name that is one capitalised word is left as it is: ICU's change of case takes longer than all else."""
    name = F.when(F.col("s_name").rlike("^[A-Z][a-z0-9#]*$"), F.col("s_name")).otherwise(F.initcap("s_name"))
    note = F.concat(F.lit("The note on "), name, F.lit(" of region "), "s_nationkey", F.when(F.pmod("s_suppkey", F.lit(3)) == 0, ", its trika and mala").otherwise(", its veda"))
    return suppliers.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("entry"), F.col("s_nationkey").alias("region"), note.alias("note"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(table(spark, sf_dir, "supplier"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries that documents are made of: suppliers are dealt out by their keys, and all else is done after that, by all tasks."""
    return _told(spread(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), "s_suppkey"))


def _records(spark: SparkSession, sf_dir: str, path: str | None = None) -> str:
    """One JSON file for each entry; the gold text is in another stage and form in each sixth, one of which has nothing but a late stage behind an object without text; some have no id."""
    n = _documents(spark, sf_dir)
    k, c = F.pmod("id", F.lit(6)), F.col("note")
    stages = (
        F.when(k == 0, F.to_json(F.struct(F.struct(F.concat(F.lit("close "), c).alias("close_translation"), F.lit("t").alias("translation")).alias("L2"))))
        .when(k == 1, F.to_json(F.struct(F.array(F.lit("in"), c).alias("l2"))))
        .when(k == 2, F.to_json(F.struct(c.alias("T1"))))
        .when(k == 3, F.to_json(F.struct(F.struct(F.lit("").alias("close_translation"), c.alias("translation")).alias("t1"), F.lit("").alias("L2"))))
        .when(k == 4, F.to_json(F.struct(F.lit("").alias("L2"))))
        .otherwise(F.to_json(F.struct(F.struct(F.lit("x").alias("other")).alias("L2"), c.alias("T1"))))
    )
    named = F.when(F.pmod("id", F.lit(11)) == 3, "").otherwise(F.concat(F.lit('"passage_id":"'), "entry", F.lit('",')))
    body = F.concat(F.lit("{"), named, F.lit('"source":{"source_text":"'), F.when(F.pmod("id", F.lit(7)) == 0, "").otherwise(F.concat(F.lit("dharma of "), "entry")), F.lit('"},"stages":'), stages, F.lit("}"))
    path = path or scratch(spark)
    sinks.write_files(n.select(F.concat(F.when(F.pmod("id", F.lit(5)) == 0, "krama-").otherwise("x-"), F.lower(F.regexp_replace("entry", " ", "_")), F.lit(".json")).alias("name"), body.alias("text")), path)
    return path


def lab_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.records(spark, _records(spark, sf_dir)).select("passage_id", "source", "gold", "tradition")


def gold_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.records(spark, _records(spark, sf_dir), gold.GOLD_STAGES).select("passage_id", "source", "gold", "tradition")


def _published(spark: SparkSession, sf_dir: str, path: str | None = None) -> str:
    n = _documents(spark, sf_dir)
    k, form = F.pmod("id", F.lit(4)), F.pmod("id", F.lit(5))
    told = F.repeat(F.concat("note", F.lit(" veda ")), 9)
    inner = lambda *fields: F.to_json(F.struct(*fields))
    source = F.when(form == 1, inner(told.alias("source"))).when(form == 2, inner(F.lit("").alias("source"), told.alias("source_text"))).otherwise(inner(F.struct(told.alias("text")).alias("source")))
    gold_text = inner(F.when(k == 1, "").when(k < 3, F.col("note")).alias("l2_text"), F.when(k != 3, F.lower("entry")).alias("l2"), F.when(F.pmod("id", F.lit(11)) != 4, F.col("entry")).alias("id"))
    body = F.concat(F.substring(source, F.lit(1), F.length(source) - 1), F.lit(","), F.substring(gold_text, F.lit(2), F.length(gold_text) - 1))  # one object of both
    path = path or scratch(spark)
    sinks.write_files(n.select(F.concat("id", F.lit(".json")).alias("name"), F.when(F.col("id") == 8, "{broken").otherwise(body).alias("text")), path)
    return path


def published_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = gold.published(spark, _published(spark, sf_dir), gold.SOURCE_PREFIX)
    return p.select("passage_id", F.length("source").cast("long").alias("n_source"), "gold", "tradition")


def _pair_lines(spark: SparkSession, sf_dir: str, path: str | None = None) -> str:
    """JSON lines over several files, some of them blank or broken."""
    b, key = table(spark, sf_dir, "benchmark"), "item_id"
    line = F.when(F.pmod(key, F.lit(9)) == 4, "").when(F.pmod(key, F.lit(13)) == 5, "{broken").otherwise(F.to_json(F.struct(F.concat(F.lit("trika "), key).alias("sanskrit"), F.when(F.pmod(key, F.lit(10)) != 3, F.col("text")).alias("english"))))
    path = path or scratch(spark)
    b.select(line.alias("value")).repartition(3).write.text(path)
    return path


def json_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = gold.json_pairs(spark, _pair_lines(spark, sf_dir))
    return p.select("passage_id", "source", text.pair_hash(F.col("gold")).alias("gold"), "tradition")


def _exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All exemplars, written: queries go over them more than once, and documents are parsed once."""
    return written(gold.exemplars(gold.published(spark, _published(spark, sf_dir)), gold.records(spark, _records(spark, sf_dir), gold.GOLD_STAGES), gold.json_pairs(spark, _pair_lines(spark, sf_dir))))


def exemplar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _exemplars(spark, sf_dir)
    every = e.groupBy("part").agg(F.count("*").alias("n"))
    fine = gold.clean(e).groupBy("part").agg(F.count("*").alias("n_clean"))
    return every.join(fine, "part", "left").select("part", "n", F.coalesce("n_clean", F.lit(0)).cast("long").alias("n_clean"))


def tradition_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = gold.traditions(spark)
    e = _exemplars(spark, sf_dir)
    out = labels.join(e.groupBy("tradition").agg(F.count("*").alias("n")), "tradition", "left").select("ord", "tradition", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    krama = gold.of_tradition(e, "Krama").agg(F.lit(99).alias("ord"), F.lit("of Krama").alias("tradition"), F.count("*").alias("n"))
    return out.unionByName(krama)


def gold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates against the first gold of their id; a few ids are unknown."""
    n = _documents(spark, sf_dir)
    c = n.select(F.when(F.pmod("id", F.lit(8)) == 5, "nowhere").otherwise(F.col("entry")).alias("passage_id"), "id", F.substring("note", 3, 30).alias("candidate"))
    e = _exemplars(spark, sf_dir)
    scored = gold.score_vs_gold(e, c).withColumnRenamed("score", "chrf")
    scored = gold.score_vs_gold(e, scored, "bleu1").withColumnRenamed("score", "bleu1").select("id", "chrf", "bleu1")
    first = gold.first_gold(e, "Supplier#000000006").select(F.lit(-1).alias("id"), F.lit(0.0).alias("chrf"), F.length("gold").cast("double").alias("bleu1"))
    return scored.unionByName(first)


def frontier_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files aligned by line; the second ends after three quarters, and some lines are blank."""
    b = table(spark, sf_dir, "benchmark").orderBy("item_id")
    end = ((b.agg(F.max("item_id")).first()[0] or 0) + 1) * 3 // 4
    s, g = scratch(spark), scratch(spark)
    b.select(F.when(F.pmod("item_id", F.lit(7)) == 2, " ").otherwise(F.concat(F.lit(" "), _flat("text")))).coalesce(1).write.text(s)
    b.filter(F.col("item_id") < end).select(F.when(F.pmod("item_id", F.lit(5)) == 1, "").otherwise(F.concat(F.lit("gold "), "item_id"))).coalesce(1).write.option("lineSep", "\r\n").text(g)
    return gold.line_pairs(spark, s, g, "flores", 60).select("passage_id", text.pair_hash(F.col("source")).alias("source"), "gold", "split")


def canon_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first lines of one gzip file; broken lines use up their share."""
    b = table(spark, sf_dir, "benchmark").orderBy("item_id")
    row = F.to_json(F.struct(F.concat(F.lit("id"), "item_id").alias("id"), F.lit("sa").alias("src_lang"), F.when(F.pmod("item_id", F.lit(2)) == 0, "bo").alias("tgt_lang"), F.col("item_id").alias("score"), F.array(F.concat(F.lit("r"), "item_id"), F.lit("z")).alias("root_segnr")))
    path = scratch(spark)
    b.select(F.when(F.pmod("item_id", F.lit(6)) == 1, "{bad").otherwise(row)).coalesce(1).write.option("compression", "gzip").text(path)
    return gold.canon_sample(spark, path, 90).select("id", "src_lang", "tgt_lang", "score", "gemini_score", "root_id", "par_id")


def canon_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.catalogue({"all": canon_sample(spark, sf_dir), "even": canon_sample(spark, sf_dir).filter("tgt_lang = 'bo'")}, spark)


def dataset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets that are there, and one that is not yet."""
    sets = {"pairs": (_pair_lines(spark, sf_dir), gold.json_pairs), "records": (_records(spark, sf_dir), gold.records), "published": (_published(spark, sf_dir), gold.published)}
    nowhere = scratch(spark)
    return gold.available(spark, {**sets, "no pairs": (nowhere, gold.json_pairs), "no records": (f"{nowhere}/*.json", gold.records)})


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's line numbers, whatever the splits that it is read in."""
    path = scratch(spark)
    table(spark, sf_dir, "conversations").select(F.concat_ws(",", "conv_id", "turn"), "conv_id", "turn").orderBy("conv_id", "turn").drop("conv_id", "turn").coalesce(1).write.text(path)
    return lines.numbered_files(spark, path).select("i", "line")


def dcs_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files by name: index, school, tier and period."""
    n = _documents(spark, sf_dir)
    path = scratch(spark)
    body = F.concat(F.lit("# "), "entry", F.lit("\n\n"), "note", F.lit("\nsecond "), "entry", F.when(F.pmod("id", F.lit(2)) == 0, "\n").otherwise(""))
    sinks.write_files(n.select(F.concat(F.element_at(F.array(*map(F.lit, ("yoga", "krama", "nyAya", "z"))), (F.pmod("id", F.lit(4)) + 1).cast("int")), F.lit("-"), "id", F.lit(".txt")).alias("name"), body.alias("text")), path)
    files = lines.read_files(spark, path)
    i = lines.index(files, "file", "text").withColumn("school", lexicon.detect("file"))
    return i.select("file", "lines", "chars", "school", lexicon.lookup(F.col("school"), lexicon.SCHOOL_TIER, lexicon.DEFAULT_TIER).alias("tier"), lexicon.lookup(F.col("school"), lexicon.SCHOOL_PERIOD, lexicon.DEFAULT_PERIOD).alias("period"))


def run_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records, one file a signature, written twice: point lookup and scan in order."""
    n = _documents(spark, sf_dir)
    path = scratch(spark)
    for version in (1, 2):
        rec = F.to_json(F.struct(F.sha2("entry", 256).alias("run_signature"), F.concat(F.lit("kind "), F.col("region") * version).alias("kind"), F.lit(f"2024-01-0{version}").alias("ts")))
        sinks.write_files(n.select(F.concat(F.sha2("entry", 256), F.lit(".json")).alias("name"), rec.alias("text")), path)
    return gold.run_records(spark, path).select("run_signature", "kind", "ts")


def recorded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs recorded twice in a table: the last of each signature stays; its hash covers all outputs, of which the first are kept."""
    c = table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    runs = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("t"))
    runs = runs.select(F.sha2(F.col("conv_id").cast("string"), 256).alias("run_signature"), "conv_id", F.flatten(F.array_repeat("t", 9)).alias("raw_outputs"))
    path = scratch(spark)
    sinks.record_runs(runs.withColumn("raw_outputs", F.array(F.lit("old"))), path)
    sinks.record_runs(runs, path)
    return sinks.read_runs(spark, path).select("conv_id", F.size("raw_outputs").alias("n_kept"), "out_hash")


def ledger_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to a ledger by day, read back as lines."""
    path = scratch(spark)
    n = _entries(spark, sf_dir).select(F.lower("entry").alias("step"), "id")
    sinks.append_ledger(n, path)
    sinks.append_ledger(n.filter("id < 5"), path)
    e = ledger.read_lines(spark.read.text(f"{path}/*"), "runs")
    return e.groupBy("ledger", "step").agg(F.count("*").alias("n"), F.count_if(F.col("ts").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$")).alias("n_stamped"))


def day_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports by day: a day that is written again replaces that day alone; a file that is overwritten has the last rows alone."""
    path, other = scratch(spark), scratch(spark)
    n = _entries(spark, sf_dir).select("id", "entry")
    sinks.write_day(n, path, "2024-01-01")
    sinks.write_day(n, path, "2024-01-02")
    sinks.write_day(n.filter("id % 3 = 0"), path, "2024-01-01")
    sinks.overwrite_lines(n, other)
    sinks.overwrite_lines(n.filter("id > 20"), other)
    days = spark.read.json(path).groupBy(F.col("day").cast("string").alias("export")).agg(F.count("*").alias("n"))
    return days.unionByName(spark.read.json(other).agg(F.lit("lines").alias("export"), F.count("*").alias("n")))


def frozen_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frozen registry, what is read back of it, and one that was never frozen."""
    path = scratch(spark)
    n = _entries(spark, sf_dir).select(F.col("entry").alias("passage_id"), F.col("note").alias("source"), F.col("region").cast("string").alias("school"))
    frozen = sinks.freeze(n, path, "1.0.0").select("version", "n_passages", "manifest_hash")
    read = sinks.read_registry(spark, path).agg(F.lit("read").alias("version"), F.count("*").alias("n_passages"), F.lit("").alias("manifest_hash"))
    none = sinks.read_registry(spark, path + "-none").agg(F.lit("none").alias("version"), F.count("*").alias("n_passages"), F.lit("").alias("manifest_hash"))
    return frozen.unionByName(read).unionByName(none)


def nested_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with their rows nested, written as lines and read back."""
    path = scratch(spark)
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    sinks.overwrite_lines(sinks.nested(e, ["user_id"], [F.count("*").alias("n"), F.round(F.max("value"), 2).alias("top")], "event_id"), path)
    back = spark.read.schema("user_id long, run struct<n:long,top:double>, rows array<struct<event_id:long,value:double>>").json(path)
    return back.select("user_id", "run.n", "run.top", F.size("rows").alias("n_rows"), F.element_at("rows", 1)["event_id"].alias("first_event"))


def registry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a registry that mixes kinds of records: those with the metric."""
    path = scratch(spark)
    n = _entries(spark, sf_dir).orderBy("id")
    line = F.when(F.pmod("id", F.lit(3)) == 0, F.to_json(F.struct(F.lit(0.5).alias("avg_chrF"), "entry"))).otherwise(F.to_json(F.struct("entry")))
    n.select(line).coalesce(1).write.text(path)
    return gold.registry_rows(spark, path).select("i", F.get_json_object("raw", "$.entry").alias("name"))


def price_catalogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogues in both forms: a list of models, written line by line as one document, and an object by id."""
    path = scratch(spark)
    n = _entries(spark, sf_dir)
    one = F.struct(F.lower("entry").alias("id"), (F.col("id") / 8).alias("prompt_per_token"), (F.col("id") / 4).alias("completion_per_token"))
    ends = spark.createDataFrame([(-1, '{"models": ['), (1 << 62, '{"id": "last"}]}')], "o long, line string")
    listed = n.select(F.col("id").alias("o"), F.concat(F.to_json(one), F.lit(",")).alias("line")).unionByName(ends)
    listed.orderBy("o").select("line").coalesce(1).write.text(f"{path}/name=a.json")
    keyed = spark.createDataFrame([("b.json", '{"m1": {"prompt_per_token": 0.5, "completion_per_token": 1.5}, "m2": {"prompt_per_token": 2.0}}')], "name string, text string")
    sinks.write_files(keyed, path)
    return gold.price_catalogue(spark, path).select("id", "prompt", "completion", "ord")


def code_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of files, one for all of them in order, and a configuration's."""
    path = scratch(spark)
    n = _documents(spark, sf_dir)
    sinks.write_files(n.select(F.concat("id", F.lit(".py")).alias("name"), F.col("note").alias("text")), path)
    f = written(provenance.file_hashes(spark, [path]).select(lines.file_name(F.col("path")).alias("name"), "sha256"))  # documents are read once
    code = provenance.code_hash(f).select(F.lit("code").alias("name"), F.col("code_sha").alias("sha256"))
    config = spark.range(1).select(F.lit("config").alias("name"), provenance.config_hash({"model": "m", "batch": "8"}).alias("sha256"))
    return f.unionByName(code).unionByName(config)


def test_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every registered loader by its name: all rows, and the first three."""
    base = scratch(spark)
    _records(spark, sf_dir, f"{base}/gold_records")
    _published(spark, sf_dir, f"{base}/published")
    _pair_lines(spark, sf_dir, f"{base}/pairs.jsonl")
    b = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("line "), "item_id").alias("value"), "item_id").orderBy("item_id").drop("item_id")
    b.coalesce(1).write.text(f"{base}/left")
    b.coalesce(1).write.text(f"{base}/right")
    steps.register_lines("both", "left", "right")
    told = []
    for name in ("records", "published", "published-trunc", "pairs", "lines:both"):
        every, first = steps.load(spark, name, base), steps.load(spark, name, base, 3)
        told.append(every.agg(F.lit(name).alias("name"), F.count("*").alias("n")).crossJoin(first.agg(F.count("*").alias("n_first"))))
    return reduce(DataFrame.unionByName, told)


def step_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps by name over pairs; each appends to two ledgers that it ran."""
    one, two = scratch(spark), scratch(spark)
    pairs = turns(spark, sf_dir).select("conv_id", "turn", F.col("ref").alias("source"), F.col("cand").alias("candidate"), F.col("ref").alias("gold"))
    ran = {name: steps.run([one, two], name, pairs) for name in ("proof", "verify", "comet")}
    results = [df.agg(F.lit(f"{name} rows").alias("what"), F.count("*").alias("n")) for name, df in ran.items()]
    held = ledger.union([ledger.read_lines(spark.read.text(f"{path}/*"), k) for k, path in (("one", one), ("two", two))])
    out = ledger.step_counts(held).select(F.concat_ws(" ", "ledger", "step").alias("what"), "n")
    for r in results:
        out = out.unionByName(r)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        lab_records, gold_records, published_passages, json_pairs, exemplar_counts, tradition_rows, gold_scores, frontier_pairs, canon_sample, canon_catalogue, dataset_counts, numbered_lines, dcs_files, run_store, recorded_runs,
        ledger_appends, day_exports, frozen_registry, nested_runs, registry_lines, price_catalogues, code_fingerprints, test_sources, step_runs,
    )
}

_ENTRIES = """(SELECT s_suppkey AS id, s_name AS entry, s_nationkey AS region,
    'The note on ' || upper(left(s_name, 1)) || lower(substr(s_name, 2)) || ' of region ' || s_nationkey || CASE WHEN s_suppkey % 3 = 0 THEN ', its trika and mala' ELSE ', its veda' END AS note FROM supplier) n"""


def _hints(x: str, hints: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, '{h}') AS INTEGER)" for h in hints) + ")"


def _tradition(x: str) -> str:
    scores = {k: _hints(f"lower({x})", v) for k, v in lexicon.TRADITIONS.items()}
    top = f"greatest({', '.join(scores.values())})"
    return f"CASE WHEN {top} = 0 THEN '{lexicon.DEFAULT_TRADITION}' " + " ".join(f"WHEN {s} = {top} THEN '{k}'" for k, s in scores.items()) + " END"


_REC = f"""rec0 AS (SELECT id AS k, entry, CASE WHEN id % 7 = 0 THEN '' ELSE 'dharma of ' || entry END AS source, CASE id % 6 WHEN 0 THEN 'close ' || note WHEN 1 THEN 'in ' || note WHEN 2 THEN note WHEN 3 THEN note END AS gold, id % 6 < 2 AS early,
        CASE WHEN id % 5 = 0 THEN 'krama-' ELSE 'x-' END || lower(replace(entry, ' ', '_')) || '.json' AS file FROM {_ENTRIES}),
    rec AS (SELECT *, CASE WHEN k % 11 = 3 THEN file ELSE entry END AS passage_id, CASE WHEN contains(file, 'krama') THEN 'Krama' ELSE {_tradition("source")} END AS tradition FROM rec0 WHERE source <> '' AND gold <> '')"""
_PUB = f"""pub0 AS (SELECT id AS k, CASE WHEN id % 11 = 4 THEN id || '.json' ELSE entry END AS passage_id, repeat(note || ' veda ', 9) AS source, CASE id % 4 WHEN 1 THEN lower(entry) WHEN 3 THEN NULL ELSE note END AS gold FROM {_ENTRIES} WHERE id <> 8),
    pub AS (SELECT *, {_tradition("source")} AS tradition FROM pub0 WHERE gold <> '')"""
_PAIR = f"""pair AS (SELECT item_id AS k, 'mitra' AS passage_id, 'trika ' || item_id AS source, text AS gold, {_tradition("'trika ' || item_id")} AS tradition FROM benchmark WHERE item_id % 9 <> 4 AND item_id % 13 <> 5 AND item_id % 10 <> 3 AND text IS NOT NULL)"""
_EX = f"""{_REC}, {_PUB}, {_PAIR}, ex AS (SELECT 0 AS part, k || '.json' AS ord, passage_id, gold, tradition FROM pub UNION ALL SELECT 1, file, passage_id, gold, tradition FROM rec WHERE early UNION ALL SELECT 2, CAST(k AS VARCHAR), passage_id, gold, tradition FROM pair)"""
_JUNK = f"(length(trim(gold)) < 8 OR length(gold) - length(translate(gold, '{text.DIACRITICS}', '')) > 5)"
_CANON = """canon AS (SELECT 'id' || item_id AS id, 'sa' AS src_lang, CASE WHEN item_id % 2 = 0 THEN 'bo' ELSE '' END AS tgt_lang, CAST(item_id AS VARCHAR) AS score, '' AS gemini_score, 'r' || item_id AS root_id, '' AS par_id
    FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) AS rn FROM benchmark) WHERE rn <= 90 AND item_id % 6 <> 1)"""

SQL = {
    "lab_records": f"WITH {_REC} SELECT passage_id, source, gold, tradition FROM rec",
    "gold_records": f"WITH {_REC} SELECT passage_id, source, gold, tradition FROM rec WHERE early",
    "published_passages": f"WITH {_PUB} SELECT passage_id, least(length(source), 400) AS n_source, gold, {_tradition("left(source, 400)")} AS tradition FROM pub",
    "json_pairs": f"WITH {_PAIR} SELECT passage_id, source, left(sha256(gold), 16) AS gold, tradition FROM pair",
    "exemplar_counts": f"WITH {_EX} SELECT part, count(*) AS n, count(*) FILTER (NOT {_JUNK}) AS n_clean FROM ex GROUP BY 1",
    "tradition_rows": f"""WITH {_EX}, label AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{t}')" for k, t in enumerate(lexicon.TRADITIONS))}) t(ord, tradition))
        SELECT l.ord, l.tradition, count(e.part) AS n FROM label l LEFT JOIN ex e USING (tradition) GROUP BY ALL UNION ALL SELECT 99, 'of Krama', count(*) FROM ex WHERE tradition = 'Krama'""",
    "gold_scores": f"""WITH {_EX}, first AS (SELECT passage_id, gold FROM ex QUALIFY row_number() OVER (PARTITION BY passage_id ORDER BY part, ord) = 1),
        c0 AS (SELECT id, CASE WHEN id % 8 = 5 THEN 'nowhere' ELSE entry END AS passage_id, substr(note, 3, 30) AS cand FROM {_ENTRIES}), c1 AS MATERIALIZED (SELECT c0.*, gold AS ref, {oracle.bare('gold')} AS rb, {oracle.bare('cand')} AS cb FROM c0 LEFT JOIN first USING (passage_id)),
        c2 AS MATERIALIZED (SELECT *, {oracle.all_grams('rb', 'r')}, {oracle.all_grams('cb', 'c')}, {oracle.words('ref')} AS rw, {oracle.words('cand')} AS cw FROM c1), c3 AS (SELECT id, {oracle.BLEU} AS bleu1, {oracle.shares('r', 'c')} FROM c2)
        SELECT id, CAST({oracle.CHRF} AS DOUBLE) AS chrf, CAST(bleu1 AS DOUBLE) AS bleu1 FROM c3 UNION ALL SELECT -1, 0, length(gold) FROM first WHERE passage_id = 'Supplier#000000006'""",
    "frontier_pairs": r"""WITH s AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i, regexp_replace(text, '[\r\n]+', ' ', 'g') AS text FROM benchmark)
        SELECT 'flores:' || i AS passage_id, left(sha256(trim(text)), 16) AS source, 'gold ' || item_id AS gold, 'test' AS split FROM s WHERE item_id < (SELECT (max(item_id) + 1) * 3 // 4 FROM benchmark) AND item_id % 7 <> 2 AND item_id % 5 <> 1 ORDER BY i LIMIT 60""",
    "canon_sample": f"WITH {_CANON} SELECT * FROM canon",
    "canon_catalogue": f"""WITH {_CANON}, u AS (SELECT 'all' AS name, * FROM canon UNION ALL SELECT 'even', * FROM canon WHERE tgt_lang = 'bo') SELECT name, count(*) AS n, array_to_string(list_sort(list(DISTINCT src_lang || '-' || tgt_lang)), ',') AS pairs FROM u GROUP BY 1""",
    "dataset_counts": f"""WITH {_EX} SELECT 'pairs' AS name, true AS imported, count(*) AS n FROM pair UNION ALL SELECT 'records', true, count(*) FROM rec UNION ALL SELECT 'published', true, count(*) FROM pub
        UNION ALL SELECT 'no pairs', false, 0 UNION ALL SELECT 'no records', false, 0""",
    "numbered_lines": "SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS i, conv_id || ',' || turn AS line FROM conversations",
    "dcs_files": f"""SELECT ['yoga', 'krama', 'nyAya', 'z'][id % 4 + 1] || '-' || id || '.txt' AS file, 2::BIGINT AS lines, length(note) + 7 + length(entry) AS chars, ['Yoga', 'Krama', 'Nyāya', NULL][id % 4 + 1] AS school,
        CAST([3, 4, 3, 2][id % 4 + 1] AS INTEGER) AS tier, ['Classical', 'Tantric', 'Classical', 'Epic'][id % 4 + 1] AS period FROM {_ENTRIES}""",
    "run_store": f"SELECT sha256(entry) AS run_signature, 'kind ' || region * 2 AS kind, '2024-01-02' AS ts FROM {_ENTRIES}",
    "recorded_runs": """WITH t AS (SELECT conv_id, list(text ORDER BY turn) AS t FROM conversations WHERE text IS NOT NULL GROUP BY 1), r AS (SELECT conv_id, t || t || t || t || t || t || t || t || t AS o FROM t)
        SELECT conv_id, CAST(least(20, len(o)) AS INTEGER) AS n_kept, sha256(array_to_string(o, chr(1))) AS out_hash FROM r""",
    "ledger_appends": f"SELECT 'runs' AS ledger, lower(entry) AS step, CAST(CASE WHEN id < 5 THEN 2 ELSE 1 END AS BIGINT) AS n, CAST(CASE WHEN id < 5 THEN 2 ELSE 1 END AS BIGINT) AS n_stamped FROM {_ENTRIES}",
    "day_exports": f"SELECT '2024-01-01' AS export, count(*) FILTER (id % 3 = 0) AS n FROM {_ENTRIES} UNION ALL SELECT '2024-01-02', count(*) FROM {_ENTRIES} UNION ALL SELECT 'lines', count(*) FILTER (id > 20) FROM {_ENTRIES}",
    "frozen_registry": f"""WITH r AS (SELECT 1 AS one, row_number() OVER (ORDER BY entry) - 1 AS n, sha256(entry || chr(1) || note || chr(1) || region) AS h FROM {_ENTRIES}), {oracle.hash_tree('r', 'one', 'n', 'h')}
        SELECT '1.0.0' AS version, (SELECT count(*) FROM r) AS n_passages, h AS manifest_hash FROM tree
        UNION ALL SELECT 'read', count(*), '' FROM {_ENTRIES} UNION ALL SELECT 'none', 0, ''""",
    "nested_runs": "SELECT user_id, count(*) AS n, round(max(value), 2) AS top, CAST(count(*) AS INTEGER) AS n_rows, min(event_id) AS first_event FROM events GROUP BY 1",
    "registry_lines": f"SELECT CAST(id AS BIGINT) AS i, entry AS name FROM {_ENTRIES} WHERE id % 3 = 0",
    "price_catalogues": f"""SELECT lower(entry) AS id, id / 8 AS prompt, id / 4 AS completion, CAST(id AS INTEGER) AS ord FROM {_ENTRIES} UNION ALL SELECT 'last', NULL, NULL, CAST(count(*) AS INTEGER) FROM supplier UNION ALL SELECT * FROM (VALUES ('m1', 0.5, 1.5, 0), ('m2', 2.0, NULL, 1))""",
    "code_fingerprints": f"""WITH f AS (SELECT id || '.py' AS name, sha256(note || chr(10)) AS sha256 FROM {_ENTRIES}),
        r AS (SELECT 1 AS one, row_number() OVER (ORDER BY name) - 1 AS n, sha256(name || chr(1) || sha256) AS h FROM f), {oracle.hash_tree('r', 'one', 'n', 'h')}
        SELECT * FROM f UNION ALL SELECT 'code', h FROM tree UNION ALL SELECT 'config', sha256('batch' || chr(1) || '8' || chr(1) || 'model' || chr(1) || 'm')""",
    "test_sources": f"""WITH {_EX}, u AS (SELECT 'records' AS name, count(*) AS n FROM rec UNION ALL SELECT 'published', count(*) FROM pub UNION ALL SELECT 'published-trunc', count(*) FROM pub UNION ALL SELECT 'pairs', count(*) FROM pair
        UNION ALL SELECT 'lines:both', count(*) FROM benchmark) SELECT name, n, least(n, 3) AS n_first FROM u""",
    "step_runs": f"""WITH {oracle.TURNS} SELECT l || ' ' || s AS what, 1::BIGINT AS n FROM (VALUES ('one'), ('two')) a(l), (VALUES ('proof'), ('verify'), ('comet')) b(s)
        UNION ALL SELECT s || ' rows', count(*) FROM turns, (VALUES ('proof'), ('verify'), ('comet')) b(s) GROUP BY 1""",
}
