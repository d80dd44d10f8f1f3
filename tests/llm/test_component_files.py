"""Steps over few rows write few files, however many shuffle partitions there are."""

from loomtext.llm.components import components


def test_few_edges_become_few_files(spark):
    conf, new = spark.conf, {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: conf.get(k) for k in new}
    try:
        for k, v in new.items():
            conf.set(k, v)
        hub = [(0, k) for k in range(1, 300)] + [(k, k + 1) for k in range(1000, 1020)]
        got = components(spark.createDataFrame(hub, "u long, v long"))
        assert 0 < len(set(got.inputFiles())) <= spark.sparkContext.defaultParallelism
        assert {(r.node, r.component) for r in got.collect()} == {(k, 0) for k in range(300)} | {(k, 1000) for k in range(1000, 1021)}
    finally:
        for k, v in old.items():
            conf.set(k, v)
