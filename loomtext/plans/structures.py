"""Queries of trees and graphs over the given tables, each with its DuckDB SQL: a strategy search for each source, checkpoints made of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.operators import graph, registry, search, summaries
from loomtext.plans.queries import table
from loomtext.sources.scratch import written

DEPTH, FANOUT = 3, 3


def _searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search for each source of documents: a document is a gold row on which one strategy was tried; every fifth was not judged."""
    d = table(spark, sf_dir, "documents")
    fidelity = F.when(F.pmod("doc_id", F.lit(5)) != 0, (F.pmod("n_chars", F.lit(5)) + 1) / 5)
    return d.select("source", "doc_id", (F.pmod("doc_id", F.lit(8)) - 1).cast("int").alias("strategy"), fidelity.alias("fidelity")).filter("strategy < 6")


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = search.scored_strategies(_searches(spark, sf_dir), ["source"], "strategy", ["doc_id"], "fidelity")
    return search.tree_search(scores, ["source"], DEPTH, FANOUT)


def _path(c: str):
    return F.concat_ws(".", F.lit("0"), F.col(c).cast("array<string>"))


def beam_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _trees(spark, sf_dir)
    return t.select("source", _path("path").alias("node_id"), F.when(F.col("depth") > 0, _path("parent")).alias("parent_id"), "depth", "strategy", F.round("score", 6).alias("score"), "kept")


def best_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = search.best_node(_trees(spark, sf_dir), ["source"])
    return b.select("source", _path("path").alias("node_id"), "hint", F.round("root_score", 4).alias("root_score"), F.round("best_score", 4).alias("best_score"), "improved")


_LEVELS = ", ".join(
    f"""l{d} AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, place) <= {FANOUT} AS kept
        FROM (SELECT p.source, list_append(p.path, CAST(i AS INTEGER)) AS path, p.path AS parent, {d} AS depth, CAST(({d * FANOUT} + i) % 6 AS INTEGER) AS strategy, coalesce(s.score, 0.0) AS score, p.r * {FANOUT} + i AS place
              FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, place) - 1 AS r FROM l{d - 1} WHERE kept) p, range({FANOUT}) t(i)
              LEFT JOIN s ON s.source IS NOT DISTINCT FROM p.source AND s.strategy = ({d * FANOUT} + i) % 6))"""
    for d in range(1, DEPTH + 1)
)
_TREES = f"""j AS (SELECT source, doc_id, CAST(doc_id % 8 - 1 AS INTEGER) AS strategy, CASE WHEN doc_id % 5 <> 0 THEN (n_chars % 5 + 1) / 5 END AS fidelity FROM documents WHERE doc_id % 8 < 7),
    s AS (SELECT source, strategy, avg(coalesce(fidelity, 0)) AS score FROM (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY source, strategy ORDER BY doc_id) <= 3) GROUP BY 1, 2),
    x AS (SELECT DISTINCT source FROM j),
    l0 AS (SELECT x.source, CAST([] AS INTEGER[]) AS path, CAST(NULL AS INTEGER[]) AS parent, 0 AS depth, -1 AS strategy, coalesce(score, 0.0) AS score, 0 AS place, true AS kept FROM x LEFT JOIN s ON s.source IS NOT DISTINCT FROM x.source AND strategy = -1),
    {_LEVELS}, nodes AS ({" UNION ALL ".join(f"SELECT * FROM l{d}" for d in range(DEPTH + 1))})"""
_ID = lambda c: f"array_to_string(list_prepend('0', CAST({c} AS VARCHAR[])), '.')"
_HINTS = " ".join(f"WHEN {k} THEN '{h}'" for k, h in enumerate([search.BASE_HINT, *search.MUTATIONS.values()], search.BASE))


def _checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as checkpoints. One requires its customer's order before it of the same priority and the one before it whose first line
    has the same flag; some require one that does not exist, and some the next of their priority, which makes cycles."""
    o = table(spark, sf_dir, "orders")
    flag = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_returnflag").alias("flag"))
    status = F.when(F.col("o_orderstatus") == "F", "DONE").when(F.col("o_orderstatus") == "P", "FAILED").otherwise("OPEN")
    by = lambda c: Window.partitionBy("o_custkey", c).orderBy("o_orderdate", "o_orderkey")
    mod = lambda n: F.pmod("o_orderkey", F.lit(n)) == 0
    key = F.concat(F.lit("o"), "o_orderkey")
    needs = F.array(
        F.lag(key).over(by("o_orderpriority")), F.when(F.col("flag").isNotNull(), F.lag(key).over(by("flag"))), F.when(mod(50), F.lit("gone")), F.when(mod(97), F.lead(key).over(by("o_orderpriority"))),
    )
    return o.join(flag, "o_orderkey", "left").select(F.col("o_orderkey").alias("ord"), key.alias("name"), F.concat(F.lit("ship "), "o_orderkey").alias("effect"), status.alias("status"), F.array_distinct(F.array_compact(needs)).alias("prereqs"))


def dag_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.standing(_checkpoints(spark, sf_dir), "ord").select("name", "status", "ready", "is_next", "level", "on_cycle", "n_blockers")


def dag_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = written(_checkpoints(spark, sf_dir))
    return graph.blockers(nodes, graph.edges_of(nodes))


def checkpoint_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next checkpoint passes its gate and the one after it fails; one that is not ready stays as it is; then two are defined."""
    g = written(_checkpoints(spark, sf_dir))
    name = lambda frame: frame.first()["name"]
    first = name(summaries.next_node(g, "ord"))
    g = written(registry.mark(g, first))
    second = name(summaries.next_node(g, "ord"))
    g = written(registry.mark(g, second, passed=False))
    unready = name(summaries.ready(g).filter("NOT ready").orderBy("ord").limit(1))
    g = registry.define(registry.mark(g, unready), second, "a new effect", [first])
    g = registry.define(g, "audit", "an audit", [first, second])
    return summaries.ready(g).select("ord", "name", "effect", "status", "ready")


_CHECKPOINTS = """f AS (SELECT l_orderkey, min(l_returnflag) AS flag FROM lineitem WHERE l_linenumber = 1 GROUP BY 1),
    o AS (SELECT o_orderkey AS ord, 'o' || o_orderkey AS name, CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'P' THEN 'FAILED' ELSE 'OPEN' END AS status, o_orderdate, o_custkey, o_orderpriority, flag
          FROM orders LEFT JOIN f ON l_orderkey = o_orderkey),
    w AS (SELECT name, ord, lag(name) OVER p AS a, CASE WHEN flag IS NOT NULL THEN lag(name) OVER q END AS b, lead(name) OVER p AS c
          FROM o WINDOW p AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, ord), q AS (PARTITION BY o_custkey, flag ORDER BY o_orderdate, ord)),
    e AS (SELECT DISTINCT name, prereq FROM (SELECT name, a AS prereq FROM w UNION ALL SELECT name, b FROM w UNION ALL SELECT name, 'gone' FROM w WHERE ord % 50 = 0 UNION ALL SELECT name, c FROM w WHERE ord % 97 = 0) WHERE prereq IS NOT NULL)"""
_BLOCKED = """unmet AS (SELECT * FROM e WHERE prereq NOT IN (SELECT name FROM o WHERE status = 'DONE')),
    blocked AS (SELECT name, prereq FROM unmet UNION SELECT k.name, u.prereq FROM blocked k JOIN unmet u ON u.name = k.prereq)"""
_READY = "NOT EXISTS (SELECT 1 FROM {e} x WHERE x.name = {n}.name AND x.prereq NOT IN (SELECT name FROM {n0} WHERE status = 'DONE'))"

QUERIES = {f.__name__: f for f in (beam_search, best_node, dag_ready, dag_blockers, checkpoint_marks)}

SQL = {
    "beam_search": f"WITH {_TREES} SELECT source, {_ID('path')} AS node_id, CASE WHEN depth > 0 THEN {_ID('parent')} END AS parent_id, depth, strategy, round(score, 6) AS score, kept FROM nodes",
    "best_node": f"""WITH {_TREES}, b AS (SELECT source, arg_min(path, CAST(k AS BIGINT)) AS path, arg_min(strategy, CAST(k AS BIGINT)) AS strategy, max(score) AS best, max(score) FILTER (depth = 0) AS root
            FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, path) AS k FROM nodes) GROUP BY source)
        SELECT source, {_ID('path')} AS node_id, CASE strategy {_HINTS} END AS hint, round(root, 4) AS root_score, round(best, 4) AS best_score, best > root AS improved FROM b""",
    "dag_ready": f"""WITH RECURSIVE {_CHECKPOINTS}, {_BLOCKED}, real AS (SELECT * FROM e WHERE prereq IN (SELECT name FROM o)),
        reach AS (SELECT name, prereq FROM real UNION SELECT k.name, x.prereq FROM reach k JOIN real x ON x.name = k.prereq),
        cyclic AS (SELECT name FROM reach WHERE name = prereq),
        sound AS (SELECT name FROM o WHERE name NOT IN (SELECT name FROM cyclic) AND name NOT IN (SELECT name FROM reach WHERE prereq IN (SELECT name FROM cyclic))),
        climb AS (SELECT name, 0 AS level FROM sound UNION SELECT x.name, level + 1 FROM climb JOIN real x ON x.prereq = climb.name WHERE x.name IN (SELECT name FROM sound)),
        high AS (SELECT name, max(level) AS level FROM climb GROUP BY 1), n AS (SELECT name, count(*) AS n FROM blocked GROUP BY 1),
        r AS (SELECT *, name NOT IN (SELECT name FROM unmet) AS ready FROM o)
        SELECT r.name, status, ready, r.ord IS NOT DISTINCT FROM (SELECT min(ord) FROM r WHERE ready AND status <> 'DONE') AS is_next, level, r.name IN (SELECT name FROM cyclic) AS on_cycle, coalesce(n, 0) AS n_blockers
        FROM r LEFT JOIN high ON high.name = r.name LEFT JOIN n ON n.name = r.name""",
    "dag_blockers": f"WITH RECURSIVE {_CHECKPOINTS}, {_BLOCKED} SELECT name, prereq AS blocker FROM blocked",
    "checkpoint_marks": f"""WITH {_CHECKPOINTS}, r0 AS (SELECT *, {_READY.format(e="e", n="o", n0="o")} AS ready FROM o),
        one AS (SELECT min(ord) AS ord FROM r0 WHERE ready AND status <> 'DONE'), o1 AS (SELECT ord, name, CASE WHEN ord = (SELECT ord FROM one) THEN 'DONE' ELSE status END AS status FROM o),
        r1 AS (SELECT *, {_READY.format(e="e", n="o1", n0="o1")} AS ready FROM o1), two AS (SELECT min(ord) AS ord FROM r1 WHERE ready AND status <> 'DONE'),
        a AS (SELECT name FROM o JOIN one USING (ord)), b AS (SELECT name FROM o JOIN two USING (ord)),
        o2 AS (SELECT ord, name, CASE WHEN ord = (SELECT ord FROM two) THEN 'a new effect' ELSE 'ship ' || ord END AS effect, CASE WHEN ord = (SELECT ord FROM two) THEN 'OPEN' ELSE status END AS status FROM o1
               UNION ALL SELECT (SELECT max(ord) FROM o) + 1, 'audit', 'an audit', 'OPEN'),
        e2 AS (SELECT * FROM e WHERE name <> (SELECT name FROM b) UNION ALL SELECT b.name, a.name FROM a, b UNION ALL SELECT 'audit', name FROM a UNION ALL SELECT 'audit', name FROM b)
        SELECT ord, name, effect, status, {_READY.format(e="e2", n="o2", n0="o2")} AS ready FROM o2""",
}
