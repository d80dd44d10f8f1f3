"""What a query makes of documents is made once for each of them, by all tasks, and without moving texts."""

import re

import pytest
from pyspark.sql import functions as F

from loomtext.functions import lexicon
from loomtext.plans import files
from loomtext.sources import lines, sinks

#: Each query, and how often documents are parsed for it: once by each loader, one of which finds nothing in dataset_counts.
QUERIES = {
    "dataset_counts": 3,
    "gold_scores": 2,
    "test_sources": 6,
    "tradition_rows": 2,
    "published_passages": 1,
    "code_fingerprints": 0,
    "gold_records": 1,
    "dcs_files": 0,
    "lab_records": 1,
}


@pytest.mark.parametrize("name", QUERIES)
def test_documents_are_parsed_once_where_they_lie(spark, sf_dir, name, monkeypatch):
    frames, wrote, split = [], sinks.write_files, []
    monkeypatch.setattr(sinks, "write_files", lambda rows, path: (split.append(rows.rdd.getNumPartitions()), wrote(rows, path)))
    keep = files.written
    monkeypatch.setattr(files, "written", lambda df: (frames.append(df), keep(df))[1])
    frames.append(files.QUERIES[name](spark, sf_dir))
    assert min(split) >= spark.sparkContext.defaultParallelism
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in frames]
    assert sum(len(re.findall(r"parseJson\(", p)) for p in plans) == QUERIES[name]
    assert not [p for p in plans if "_last" in p]


def test_documents_of_several_writes_are_the_last(spark, tmp_path):
    for folder, texts in (("a", ("old", "new")), ("b", ("one",))):
        for t in texts:
            sinks.write_files(spark.createDataFrame([("x.json", t), (f"{t}.json", t)], "name string, text string"), str(tmp_path / folder))
    read = lambda path: sorted((r.file, r.text) for r in lines.read_files(spark, str(path)).collect())
    assert read(tmp_path / "a") == [("new.json", "new\n"), ("old.json", "old\n"), ("x.json", "new\n")]
    assert read(tmp_path / "b") == [("one.json", "one\n"), ("x.json", "one\n")]
    assert read(tmp_path / "*") == [("new.json", "new\n"), ("old.json", "old\n"), ("one.json", "one\n"), ("x.json", "new\n"), ("x.json", "one\n")]


def test_classes_are_scored_once(spark):
    texts = ["", None, "KRAMA", "Śiva Sūtra of mala", "ātman veda", "mala veda", "krama trika", "vimarśa krama ucyate", "tattva vidyā brahma", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", lexicon.tag(F.col("t")).alias("tag"))
    n = sum(map(len, lexicon.TRADITIONS.values()))
    assert df._jdf.queryExecution().optimizedPlan().toString().lower().count("contains(") == n

    def plain(t):
        scores = {k: sum(h in (t or "").lower() for h in hints) for k, hints in lexicon.TRADITIONS.items()}
        best = max(scores.values())
        return next(k for k, v in scores.items() if v == best) if best else lexicon.DEFAULT_TRADITION

    assert [r.tag for r in df.collect()] == [plain(t) for t in texts]
