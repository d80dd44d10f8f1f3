"""Documents of many rows: suppliers are dealt out before anything is made of them, and loaders are compiled as a whole."""

import re

import pytest
from pyspark.sql import functions as F

from loomtext.functions import provenance
from loomtext.plans import files
from loomtext.sources import gold, sinks

QUERIES = ["published_passages", "code_fingerprints", "gold_records", "dcs_files"]


@pytest.mark.parametrize("name", QUERIES)
def test_notes_are_made_after_suppliers_are_dealt_out(spark, sf_dir, name, monkeypatch):
    plans, wrote = [], sinks.write_files
    monkeypatch.setattr(sinks, "write_files", lambda rows, path: (plans.append(rows._jdf.queryExecution().optimizedPlan().toString()), wrote(rows, path)))
    files.QUERIES[name](spark, sf_dir)
    for plan in plans:
        above, dealt, below = re.split(r"(Repartition\w* .*)", plan, maxsplit=1)
        assert "s_suppkey" in dealt and "initcap" in above and "initcap" not in below


@pytest.mark.parametrize("load", [gold.published, gold.records])
def test_fields_are_read_by_compiled_code(spark, tmp_path, load):
    sinks.write_files(spark.createDataFrame([("a.json", "{}")], "name string, text string"), str(tmp_path / "a"))
    plan = load(spark, str(tmp_path / "a"))._jdf.queryExecution().executedPlan().toString()
    steps = [line for line in plan.splitlines() if "Generate inline" in line and "from_json" not in line]  # a list is parsed by a function that is not compiled
    assert "lambda" not in plan and steps and all(re.search(r"\*\(\d+\) Generate", line) for line in steps)


def test_odd_fields_of_passages(spark, tmp_path):
    texts = {
        "text": '{"id": "p1", "source": "a", "l2_text": "g"}',
        "object": '{"id": 7, "source": {"text": "b"}, "l2": "g"}',
        "second": '{"id": null, "source": {}, "source_text": "c", "l2_text": [], "l2": ["x", 1]}',
        "numbers": '{"id": 1.50, "source": 0, "source_text": 2, "l2_text": 0.0, "l2": true}',
        "empty id": '{"id": "", "source": "d", "l2": "g"}',
        "odd id": '{"id": {"a": 1}, "source": "\\u0936\\n", "l2": "g"}',
        "no source": '{"id": "p", "source": {"text": ""}, "source_text": "e", "l2": "g"}',
        "no gold": '{"id": "p", "source": "f", "l2_text": false, "l2": null}',
        "broken": '{"id": "p", "source": "f", "l2": "g"',
        "list": '["id"]',
        "nothing": "",
    }
    sinks.write_files(spark.createDataFrame(list(texts.items()), "name string, text string"), str(tmp_path / "p"))
    got = sorted((r.passage_id, r.source, r.gold) for r in gold.published(spark, str(tmp_path / "p")).collect())
    want = [("p1", "a", "g"), ("7", "b", "g"), ("second", "c", '["x",1]'), ("1.5", "2", "true"), ("", "d", "g"), ('{"a":1}', "श\n", "g")]
    assert got == sorted(want)


def test_odd_stages_of_records(spark, tmp_path):
    rec = lambda stages, **more: '{"passage_id": "%s", "source": {%s}, "stages": %s}' % (more.get("id", "r"), more.get("source", '"source_text": "s"'), stages)
    texts = {
        "close": rec('{"L2": {"close_translation": "c", "translation": "t"}}', id="1"),
        "plain": rec('{"L2": {"close_translation": "", "translation": "t"}}', id="2"),
        "list": rec('{"L2": [], "l2": ["a", null, "b"]}', id="3"),
        "text": rec('{"L2": null, "l2": 0, "T1": "x"}', id="4", source='"text": "other"'),
        "number": rec('{"t1": 12}', id="5", source='"source_text": 3'),
        "stopped": rec('{"L2": {"other": "x"}, "T1": "late"}', id="6"),
        "brace": rec('{"L2": "{x"}', id="7"),
        "no stages": rec("[]", id="8"),
        "empty source": rec('{"L2": "x"}', id="9", source='"source_text": "", "text": "y"'),
        "plain source": '{"source": "s", "stages": {"L2": "x"}}',
        "krama.json": '{"source": {"text": "s"}, "stages": {"L2": "x"}}',
    }
    sinks.write_files(spark.createDataFrame(list(texts.items()), "name string, text string"), str(tmp_path / "r"))
    got = sorted((r.passage_id, r.source, r.gold, r.tradition == "Krama") for r in gold.records(spark, str(tmp_path / "r")).collect())
    assert got == [("1", "s", "c", False), ("2", "s", "t", False), ("3", "s", "a b", False), ("4", "other", "x", False), ("5", "3", "12", False), ("krama.json", "s", "x", True)]


def test_a_hash_tree_takes_as_many_files_as_its_rows_need(spark, monkeypatch):
    """Few rows are laid out in fewer files than Spark's number of shuffle partitions, and the hash stays the same."""
    from hashlib import sha256

    from loomtext.operators import ranges

    parts, keep = [], ranges.written
    monkeypatch.setattr(ranges, "written", lambda df: (lambda out: (parts.append(out.rdd.getNumPartitions()), parts.append(len(out.inputFiles())), out)[2])(keep(df)))
    monkeypatch.setattr(provenance, "BLOCK", 8)
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        df = spark.range(100).select(F.format_string("%03d", "id").alias("name"))
        got = provenance.set_hash(df, [], ["name"], ["name"]).first().set_hash
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
    sha = lambda x: sha256(x.encode()).hexdigest()
    level = [sha(f"{i:03}") for i in range(100)]
    while True:
        level = [sha("\u0001".join(level[i : i + 8])) if i or len(level) > 1 else level[0] for i in range(0, len(level), 8)]
        if len(level) == 1:
            break
    assert max(parts) < 20 and got == level[0]


def test_documents_of_fingerprints_are_read_once(spark, sf_dir):
    assert not [f for f in files.code_fingerprints(spark, sf_dir).inputFiles() if "/_packed/" in f]
