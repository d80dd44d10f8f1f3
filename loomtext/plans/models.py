"""Queries around a model that is not there: repaired replies, replies that are kept, a memory of facts; each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import repair
from loomtext.functions.text import pair_hash
from loomtext.operators import memory, replies
from loomtext.plans.queries import table
from loomtext.sources.scratch import scratch, written


def repaired_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply for each event, an object around its properties, cut off at any of its characters."""
    e = table(spark, sf_dir, "events")
    body = F.concat(
        F.lit('{"step": "'), "event_type", F.lit('", "k": '), F.get_json_object("props", "$.k"), F.lit(', "tags": ["a", "b\\"'), F.pmod("event_id", F.lit(9)), F.lit('"], "deep": {"x": [1, {"y": null}]}, "ok": true}'),
    )
    e = e.select("event_id", body.alias("body"))
    cut = F.expr("left(body, pmod(event_id, length(body) + 1))")
    return repair.with_objects(e.select("event_id", F.concat(F.lit("Reply: "), cut).alias("reply")), "reply").select("event_id", "object", "status")


_SUFFIXES = "[" + ", ".join(f"'{q}{c}'" for q in ("", '"') for c in ("", "}", "]}", "}}", "]}}", "}]}}")) + "]"
_REPAIRED = f"""b AS (SELECT event_id, '{{"step": "' || event_type || '", "k": ' || json_extract_string(props, '$.k') || ', "tags": ["a", "b\\"' || event_id % 9 || '"], "deep": {{"x": [1, {{"y": null}}]}}, "ok": true}}' AS body FROM events),
    t AS (SELECT event_id, body, left(body, event_id % (length(body) + 1)) AS t FROM b),
    c AS (SELECT event_id, t, body, p, unnest({_SUFFIXES}) AS s FROM (SELECT *, unnest(range(greatest(length(t) - 30, 0) + 1, length(t) + 1)) AS p FROM t)),
    f AS (SELECT event_id, left(t, p) || s AS object, p, t = body AS whole FROM c
          WHERE json_valid(left(t, p) || s) AND (starts_with(s, '"') OR NOT (rtrim(left(t, p)) LIKE '%,' OR regexp_matches(substr(t, p, 1), '[0-9]') AND (p = length(t) OR regexp_matches(substr(t, p + 1, 1), '[0-9]'))))
          QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY p DESC) = 1)"""


def _say(requests: list[dict], attempt: int) -> list[str | None]:
    """Stands in for a model: some requests are answered only when asked again, some never."""
    said = []
    for r in requests:
        n = len(r["prompt"])
        said.append(None if n % 11 == 5 or (n % 7 == 3 and attempt == 1) else f' "{n}:{r["prompt"][:12]}" ')
    return said


def kept_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns are asked about twice, first those of even conversations, then all: what was answered is not sent again."""
    path = scratch(spark)
    c = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("prompt"))
    replies.answer(c.filter("conv_id % 2 = 0"), ["prompt"], path, _say, size=16, pause=None)
    out = replies.candidates(replies.answer(c, ["prompt"], path, _say, size=16, pause=None))
    return out.select("conv_id", "turn", pair_hash(F.col("candidate")).alias("candidate"), "attempts", "waited", "status", "sent")


def candidate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = replies.candidate_requests(table(spark, sf_dir, "benchmark"), ["item_id"], "text", "m", 4)
    return asked.select("item_id", "k", "system", pair_hash(F.col("prompt")).alias("prompt"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A memory of what happened: a fact for each user and kind; errors forget it; an event follows from the one of half its number."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat_ws(":", F.pmod("user_id", F.lit(40)), F.when(F.col("event_type") == "error", "view").otherwise(F.col("event_type"))).alias("key"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") != "error", F.get_json_object("props", "$.k")).alias("value"), F.col("value").alias("metric"), F.when(F.col("event_id") > 0, F.floor(F.col("event_id") / 2)).alias("cause"),
    )


def memory_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.facts(_events(spark, sf_dir)).select("key", "seq", "until", "value")


def memory_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of causes of each fact that still holds."""
    events = written(_events(spark, sf_dir))
    now = memory.facts(events).filter("until IS NULL AND value IS NOT NULL")
    return memory.trace(events, now).select("start", "depth", "seq", "key")


def memory_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = written(memory.facts(_events(spark, sf_dir)))
    last = facts.agg(F.max("seq")).first()[0] or 0
    out = memory.drift(facts, last // 8, last)
    return out.select("same", "changed", "added", "lost", F.round("share", 6).alias("share"), F.round("distance", 6).alias("distance"))


_FACTS = """m AS (SELECT user_id % 40 || ':' || CASE WHEN event_type = 'error' THEN 'view' ELSE event_type END AS key, event_id AS seq, CASE WHEN event_type <> 'error' THEN json_extract_string(props, '$.k') END AS value, value AS metric,
        CASE WHEN event_id > 0 THEN event_id // 2 END AS cause FROM events),
    facts AS (SELECT *, lead(seq) OVER (PARTITION BY key ORDER BY seq) AS until FROM m)"""
_STATE = "(SELECT * FROM facts WHERE seq <= {s} AND (until IS NULL OR until > {s}) AND value IS NOT NULL)"
_Q = "[" + ", ".join(str(q) for q in memory.QUANTILES) + "]"
_STYLES = "[" + ", ".join(f"'{replies.SCHOLAR}{s}{replies.ONLY}'" for s in replies.STYLES) + "]"

QUERIES = {f.__name__: f for f in (repaired_replies, kept_replies, candidate_requests, memory_history, memory_trace, memory_drift)}

SQL = {
    "repaired_replies": f"""WITH {_REPAIRED} SELECT event_id, object, CASE WHEN object IS NULL THEN 'unreadable' WHEN whole THEN 'read' ELSE 'repaired' END AS status FROM t LEFT JOIN f USING (event_id)""",
    "kept_replies": r"""WITH p AS (SELECT conv_id, turn, coalesce(text, '') AS x, length(coalesce(text, '')) AS n FROM conversations WHERE role = 'user')
        SELECT conv_id, turn, left(sha256(CASE WHEN n % 11 = 5 THEN '' ELSE regexp_replace(regexp_replace(n || ':' || left(x, 12), '"+$', ''), '[\s\p{Z}]+$', '') END), 16) AS candidate, CAST(CASE WHEN n % 11 = 5 THEN 3 WHEN n % 7 = 3 THEN 2 ELSE 1 END AS INTEGER) AS attempts,
            CASE WHEN n % 11 = 5 THEN 6.0::DOUBLE WHEN n % 7 = 3 THEN 2.0 ELSE 0.0 END AS waited, CASE WHEN n % 11 = 5 THEN 'failed' ELSE 'answered' END AS status,
            n % 11 = 5 OR x NOT IN (SELECT x FROM p WHERE conv_id % 2 = 0) AS sent FROM p""",
    "candidate_requests": f"SELECT item_id, CAST(k AS INTEGER) AS k, {_STYLES}[k % 3 + 1] AS system, left(sha256('Translate:' || chr(10) || left(coalesce(text, ''), 400)), 16) AS prompt FROM benchmark, range(4) t(k)",
    "memory_history": f"WITH {_FACTS} SELECT key, seq, until, value FROM facts",
    "memory_trace": f"""WITH RECURSIVE {_FACTS}, chain AS (SELECT seq AS start, 0 AS depth, seq, cause, key FROM facts WHERE until IS NULL AND value IS NOT NULL
        UNION ALL SELECT start, depth + 1, m.seq, m.cause, m.key FROM chain JOIN m ON m.seq = chain.cause) SELECT start, depth, seq, key FROM chain""",
    "memory_drift": f"""WITH {_FACTS}, top AS (SELECT max(seq) AS s FROM m), a AS (SELECT * FROM {_STATE.format(s='(SELECT s // 8 FROM top)')}), b AS (SELECT * FROM {_STATE.format(s='(SELECT s FROM top)')}),
        j AS (SELECT a.value AS v1, b.value AS v2, a.key IS NOT NULL AS i1, b.key IS NOT NULL AS i2 FROM a FULL JOIN b USING (key)),
        n AS (SELECT count(*) FILTER (i1 AND i2 AND v1 = v2) AS same, count(*) FILTER (i1 AND i2 AND v1 <> v2) AS changed, count(*) FILTER (NOT i1) AS added, count(*) FILTER (NOT i2) AS lost, count(*) AS total FROM j),
        q AS (SELECT (SELECT quantile_disc(metric, {_Q}) FROM a) AS q1, (SELECT quantile_disc(metric, {_Q}) FROM b) AS q2)
        SELECT same, changed, added, lost, round((total - same) / total, 6) AS share, round(list_sum(list_transform(list_zip(q1, q2), lambda z: abs(z[1] - z[2]))) / {len(memory.QUANTILES)}, 6) AS distance FROM n, q""",
}
