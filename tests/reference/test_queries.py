"""Queries against their SQL in DuckDB over the smallest tables: composed ones, those that read files they wrote, and a few plain ones."""

import math

import duckdb
import pytest

from loomtext.plans import composites, files, models, oracle, queries, structures

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PLAIN = ("gamma_by_passage", "gamma_by_metric", "pairwise_win_rank", "reference_attach", "ngram_overlap_topk", "token_containment_parallels", "bleu1_pairs", "balanced_objects", "schema_gate", "annotation_checks")
ALL = {**{k: queries.QUERIES[k] for k in (*PLAIN, "challenge_set")}, **composites.QUERIES, **files.QUERIES, **structures.QUERIES, **models.QUERIES}
SQL = {**oracle.SQL, **composites.SQL, **files.SQL, **structures.SQL, **models.SQL}


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    text = lambda v: "" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(text(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ALL)
def test_query_equals_its_sql(spark, sf_dir, db, name):
    got = ALL[name](spark, sf_dir)
    want = db.sql(SQL[name])
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), want.columns)
