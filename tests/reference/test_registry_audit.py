"""The audit of a registry names what is incomplete, in order and once."""

import duckdb

from loomtext.operators import summaries
from loomtext.plans import oracle, queries


def test_audit_names_every_incomplete_record(spark, sf_dir):
    rows = [(f"{k * 7 % 40:012d}-{k}", None if k % 2 else "x") for k in range(80)]
    got = summaries.registry_audit(spark.createDataFrame(rows, "sig string, nano string"), ["sig", "nano"], "sig").first()
    assert (got.n, got.valid, got.invalid) == (80, 40, 40) and got.missing == ",".join(sorted({r[0][:12] for r in rows if r[1] is None}))
    none = summaries.registry_audit(spark.createDataFrame([("a", "x")], "sig string, nano string"), ["sig", "nano"], "sig").first()
    assert tuple(none) == (1, 1, 0, None)
    want = duckdb.sql(oracle.SQL["registry_audit"].replace("FROM events", f"FROM '{sf_dir}/events.parquet'"))
    mine = queries.registry_audit(spark, sf_dir)
    assert mine.columns == want.columns and tuple(mine.first()) == want.fetchall()[0] and mine.first().missing
