"""Documents that a query writes lie together in files, as many as tasks, and are read as if each had its own."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from loomtext.functions import provenance
from loomtext.plans import files
from loomtext.sources import gold, lines, scratch, sinks

N = 300
QUERIES = [
    "dataset_counts",
    "exemplar_counts",
    "gold_scores",
    "run_store",
    "test_sources",
    "tradition_rows",
    "published_passages",
    "code_fingerprints",
    "gold_records",
    "dcs_files",
    "lab_records",
]


@pytest.fixture(scope="module")
def many(tmp_path_factory, sf_dir):
    """The given tables, with N suppliers."""
    folder = tmp_path_factory.mktemp("many")
    duckdb.sql(f"COPY (SELECT s_suppkey + k * 1000 AS s_suppkey, printf('Supplier#%09d', s_suppkey + k * 1000) AS s_name, s_nationkey, s_acctbal FROM '{sf_dir}/supplier.parquet', range({N}) r(k) LIMIT {N}) TO '{folder}/supplier.parquet' (FORMAT parquet)")
    for f in Path(sf_dir).glob("*.parquet"):
        if f.name != "supplier.parquet":
            (folder / f.name).symlink_to(f)
    return str(folder)


@pytest.mark.parametrize("name", QUERIES)
def test_files_do_not_grow_with_documents(spark, many, name, monkeypatch):
    at, write = [], sinks.write_files
    monkeypatch.setattr(sinks, "write_files", lambda rows, path: (at.append(path), write(rows, path)))
    files.QUERIES[name](spark, many).collect()
    for path in set(at):
        n = len([f for f in Path(path.removeprefix("file:")).rglob("*") if f.is_file() and not f.name.startswith((".", "_"))])
        assert 0 < n <= 2 * at.count(path) * spark.sparkContext.defaultParallelism < N


def test_exemplars_are_parsed_once(spark, many):
    assert not [f for f in files._exemplars(spark, many).inputFiles() if f"/{scratch.PACKED}/" in f or "name=" in f]


def test_documents_by_name_pattern_and_beside_files(spark, tmp_path):
    x = str(tmp_path / "x")
    put = lambda *rows: sinks.write_files(spark.createDataFrame(rows, "name string, text string"), x)
    put(("a.json", "old"), ("b c+1%.txt", "one\r\ntwo\n\n"), ("é.json", None))
    put(("a.json", "new"))
    (tmp_path / "x" / "own.json").write_text("own")
    read = lambda path: {r.file: r.text for r in lines.read_files(spark, path).collect()}
    assert read(x) == {"a.json": "new\n", "b c+1%.txt": "one\r\ntwo\n\n\n", "é.json": "\n", "own.json": "own"}
    assert read(f"{x}/*.json") == {"a.json": "new\n", "é.json": "\n", "own.json": "own"}
    assert read(f"{x}/a.json") == {"a.json": "new\n"} and read(f"{x}/none.json") == {}
    got = sorted((r.file, r.i, r.line) for r in lines.numbered_files(spark, x).collect())
    assert got == [("a.json", 0, "new"), ("b c+1%.txt", 0, "one"), ("b c+1%.txt", 1, "two"), ("b c+1%.txt", 2, ""), ("b c+1%.txt", 3, ""), ("own.json", 0, "own"), ("é.json", 0, "")]
    sha = {r.name: r.sha256 for r in provenance.file_hashes(spark, [x]).select(lines.file_name(F.col("path")).alias("name"), "sha256").collect()}
    from hashlib import sha256

    assert sha == {k: sha256(v.encode()).hexdigest() for k, v in read(x).items()}
    there = gold.available(spark, {"some": (f"{x}/a*.json", gold.records), "none": (f"{x}/z*.json", gold.records)})
    assert {r.name: r.imported for r in there.collect()} == {"some": True, "none": False}
