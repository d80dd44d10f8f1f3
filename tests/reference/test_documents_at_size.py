"""Documents of many rows: what loaders do for each of them is compiled, and no field that is missing costs an exception."""

import re

import pytest
from pyspark.sql import functions as F

from loomtext.functions import lexicon
from loomtext.plans import files
from loomtext.sources import gold, lines, sinks


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_path_leads_nowhere(spark, sf_dir):
    """gold_records: objects are read as a whole, by the keys that they have; a path into one that lacks its field is left by an exception."""
    told = plan(files.gold_records(spark, sf_dir))
    paths = re.findall(r"try_variant_get\(\w+#\d+, ([^,]+),", told)
    assert len(paths) >= 2 and set(paths) == {"$"}


def test_fields_by_place(spark):
    """Keys that differ by case alone, fields within others, and what is no object."""
    texts = ['{"a": {"X": 1, "x": "two", "y": null}, "b": [1]}', '{"a": "X", "b": {"c": 1}, "c": 5}', '{"A": {"X": 1}}', "[]", "{", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, raw string").select("k", F.try_parse_json("raw").alias("json"))
    got = gold._fields(df, "k", low="$.a.x", b="$.b", high="$.a.X", none="$.a.y").orderBy("k").select("low.text", "low.kind", "b.text", "b.kind", "high.text", "high.kind", "none.text", "none.kind").collect()
    none = (None,) * 8
    assert list(map(tuple, got)) == [("two", "STRING", "[1]", "ARRAY<BIGINT>", "1", "BIGINT", None, "VOID"), (None, None, '{"c":1}', "OBJECT<c: BIGINT>", *none[:4]), none, none, none, none]


def test_dcs_files_are_compiled_as_a_whole(spark, sf_dir):
    """dcs_files: no lambda, and no record of its file's data for each row, which `_metadata` makes."""
    told = plan(files.dcs_files(spark, sf_dir))
    steps = [line for line in told.splitlines() if re.search("Generate|Project", line)]
    assert "lambda" not in told and "file_modification_time" not in told and steps and all(re.search(r"\*\(\d+\)", line) for line in steps)


def test_content_lines(spark):
    texts = ["", "\n\n", "#", "# a\n#b\n", "x", "\nx\n", "#c\r\nd\r\n", "a#b\n# c\n d\n\n#", " #x", "a #b\u0085#c\r#d", "\r", "é\n#é\nzz", None]
    got = lines.index(spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "file string, text string"), "file", "text").collect()
    plain = lambda t: [x for x in t.split("\n") if x and not x.startswith("#")]
    want = {str(k): (None, None) if t is None else (len(plain(t)), sum(map(len, plain(t)))) for k, t in enumerate(texts)}
    assert {r.file: (r.lines, r.chars) for r in got} == want


def test_documents_have_no_dictionary(spark, tmp_path):
    import pyarrow.parquet as pq

    sinks.write_files(spark.range(1000).select(F.concat("id", F.lit(".txt")).alias("name"), F.lit("one text").alias("text")).coalesce(1), str(tmp_path / "x"))
    (file,) = (tmp_path / "x").rglob("*.parquet")
    group = pq.ParquetFile(file).metadata.row_group(0)
    held = {c.path_in_schema: c.encodings for c in map(group.column, range(group.num_columns))}
    assert not [x for c in ("name", "text") for x in held[c] if "DICTIONARY" in x]


@pytest.mark.parametrize("name", ["Supplier#000000001", "supplier#1", "SUPPLIER", "two words", "Two Words", "élan vital", "", None, "A", "a b\nc"])
def test_names_are_capitalised(spark, name):
    df = spark.createDataFrame([(1, name, 2)], "s_suppkey long, s_name string, s_nationkey int")
    row = files._told(df).select("note", F.concat(F.lit("The note on "), F.initcap("entry"), F.lit(" of region 2, its veda")).alias("want")).first()
    assert row.note == row.want


def test_lexicons_by_column_and_by_name(spark):
    words = {"A": ("it's", "b\\n", "trika"), "B": ("śiva", "mala")}
    df = spark.createDataFrame([(t,) for t in ("it's", "b\\n trika", "śiva mala trika", "b\n", "", "mala")], "t string")
    for said in (lambda x: lexicon.tag(x, words, "none"), lambda x: lexicon.detect(x, words)):
        assert [r[0] for r in df.select(said("t")).collect()] == [r[0] for r in df.select(said(F.col("t"))).collect()]
    assert [r[0] for r in df.select(lexicon.tag("t", words, "none")).collect()] == ["A", "A", "B", "none", "none", "B"]
