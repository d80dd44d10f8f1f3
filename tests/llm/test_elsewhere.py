"""Executors that cannot import the package, clashing column names in every stage, and decontamination of monotonous texts."""

import os
import random
import resource
import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from loomtext.llm import langid, minhash, mixing, qgram

REPO = Path(__file__).resolve().parent.parent.parent

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
import corpus_pipeline
from loomtext.llm import queries
for name in ("op4_hmm_scores", "op9_qgram_decontamination", "op11_hard_negatives", "op13_secret_scan"):
    print(name, queries.QUERIES[name](spark, {sf!r}).count())
print("pipeline", corpus_pipeline.run(spark, {sf!r}).count())
"""


def test_workers_need_not_import_the_package(tmp_path, sf_dir):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = SCRIPT.format(repo=str(REPO), shared=str(tmp_path / "shared"), sf=sf_dir)
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert run.returncode == 0, run.stderr[-3000:]
    assert [line.split()[0] for line in run.stdout.splitlines() if line[:2] in ("op", "pi")] == ["op4_hmm_scores", "op9_qgram_decontamination", "op11_hard_negatives", "op13_secret_scan", "pipeline"]


def test_any_column_names_pass_through_every_stage(spark, sf_dir):
    names = ["a.b", "__loom_row", "__loom_copies", "row", "copies", "n", "nth", "c1", "x`y", "target", "key"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    wide = docs.selectExpr("*", *(f"{k} AS `{n.replace('`', '``')}`" for k, n in enumerate(names)))
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    kept = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())
    for stage in (langid.keep_identified, minhash.keep_one, lambda d: qgram.decontaminate(d, bench), mixing.mixed):
        out = stage(wide)
        assert out.columns == wide.columns
        assert [r[n] for r in out.limit(1).collect() for n in names] == list(range(len(names)))
        assert kept(out) == kept(stage(docs))
        assert stage(wide.limit(0)).count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]


def best_match(p, t):
    """(edits, start, end) of the piece of t nearest to p: the fewest edits, then the first to end, then the shortest."""
    row = [(0, -k) for k in range(len(t) + 1)]
    for i, c in enumerate(p, 1):
        new = [(i, 0)]
        for k in range(1, len(t) + 1):
            new.append(min((row[k - 1][0] + (c != t[k - 1]), row[k - 1][1]), (row[k][0] + 1, row[k][1]), (new[k - 1][0] + 1, new[k - 1][1])))
        row = new
    edits = min(x[0] for x in row)
    end = next(k for k, x in enumerate(row) if x[0] == edits)
    return edits, -row[end][1], end


@pytest.mark.parametrize("letters, slice_", [("ab", 1 << 20), ("ab", 5), ("abcdefghij ", 1 << 20), ("a", 40)])
def test_places_and_edits_equal_brute_force(monkeypatch, letters, slice_):
    monkeypatch.setattr(qgram, "SLICE", slice_)
    rnd = random.Random(len(letters) + slice_)
    some = lambda n: bytes(rnd.choice(letters.encode()) for _ in range(n))
    for _ in range(40):
        items = [x for x in (qgram.normal(some(rnd.randrange(8, 60))) for _ in range(3)) if len(x) >= qgram.Q]
        texts = []
        for _ in range(3):
            text = some(rnd.randrange(30))
            for x in map(bytearray, rnd.choices(items, k=rnd.randrange(3)) if items else ()):
                for _ in range(rnd.randrange(5)):
                    k, kind = rnd.randrange(len(x)), rnd.randrange(3)
                    x[k : k + (kind < 2)] = some(kind > 0)
                text += bytes(x) + some(rnd.randrange(20))
            texts.append(qgram.normal(text))
        index = qgram.Index(list(enumerate(items)))
        want = {(d, i): best_match(p, t) for d, t in enumerate(texts) for i, p in enumerate(items)}
        assert {(d, i): tuple(r) for d, i, *r in qgram.find(index, texts)} == {k: m for k, m in want.items() if m[0] <= index.budget[k[1]]}


def test_inserted_bytes_are_part_of_what_is_told(spark):
    item = "the quick brown fox jumps over the lazy dog and then sleeps in the warm sun all day long"
    text = "x" * 17 + item[:40] + "ZZZZ" + item[40:] + " end"
    [r] = qgram.contaminated(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert (r.edits, r.start, r.end) == (4, 17, 17 + len(item) + 4)


def test_monotonous_texts_take_bounded_memory():
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert qgram.find(qgram.Index([(1, b"a" * 100_000)]), [b"a" * 5_000_000]) == [(0, 0, 0, 0, 100_000)]
    assert qgram.find(qgram.Index([(1, b"a" * 1000 + b"b" + b"a" * 1000)]), [b"a" * 300_000]) == [(0, 0, 1, 0, 2000)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20  # KB
