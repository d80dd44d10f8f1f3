"""Calls to an outside model as an operator: requests by content address, replies kept in a table, only what is missing is sent."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions.provenance import content_hash
from loomtext.functions.text import clean_answer
from loomtext.sources.scratch import exists, written

# What candidates are asked for with, in styles that take turns; what a hypothesis is tried with; characters of a
# source that a request holds; longest wait in seconds.
STYLES = ("Translate literally, preserving word order.", "Translate naturally and fluently into modern English.", "Translate faithfully, keeping philosophical terms transliterated.")
SCHOLAR, ONLY, ASK = "You are a Sanskrit scholar-translator. ", " Output only the translation.", "Translate:\n"
CAREFUL = "You are a careful Sanskrit scholar-translator. Translate this Sanskrit into accurate, natural English. Preserve meaning; do not add interpretation. Output only the translation."
ASK_WITH_HINT = "\n\nTranslate this Sanskrit:\n"
MAX_SOURCE, LONGEST_WAIT = 400, 20
_TABLE = "request_sha string, reply string, attempts int, waited double, status string"

#: Takes requests (their fields by name) and the number of the attempt, from 1; returns a reply, or None, for each.
Call = Callable[[list[dict], int], list[str | None]]


def candidate_requests(sources: DataFrame, key: list[str], source: str, model: str, n: int = 3) -> DataFrame:
    """key, k, model, system and prompt: n requests for each source, in one style after the other, over its first characters."""
    style = F.element_at(F.array(*(F.lit(SCHOLAR + s + ONLY) for s in STYLES)), (F.pmod("k", F.lit(len(STYLES))) + 1).cast("int"))
    asked = sources.select(*key, F.concat(F.lit(ASK), F.substring(F.coalesce(source, F.lit("")), 1, MAX_SOURCE)).alias("prompt"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    return asked.select(*key, "k", F.lit(model).alias("model"), style.alias("system"), "prompt")


def hint_requests(trials: DataFrame, key: list[str], source: str, hint: str, model: str) -> DataFrame:
    """key, model, system and prompt: a request for each trial of a hypothesis (source and hint)."""
    prompt = F.concat(F.coalesce(hint, F.lit("")), F.lit(ASK_WITH_HINT), F.coalesce(source, F.lit("")))
    return trials.select(*key, F.lit(model).alias("model"), F.lit(CAREFUL).alias("system"), prompt.alias("prompt"))


def candidates(answered: DataFrame) -> DataFrame:
    """Adds candidate, the cleaned reply; a request that failed has the empty one."""
    return answered.withColumn("candidate", clean_answer(F.coalesce("reply", F.lit(""))))


def backoff(attempt: int) -> float:
    """Seconds to wait after an attempt."""
    return float(min(2**attempt, LONGEST_WAIT))


def _sender(call: Call, fields: list[str], size: int, attempts: int, pause: Callable[[float], None] | None):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for k in range(0, len(rows), size):
                some = rows[k : k + size]
                replies, tried, waited = [None] * len(some), [0] * len(some), [0.0] * len(some)
                for attempt in range(1, attempts + 1):
                    left = [i for i, r in enumerate(replies) if r is None]
                    if not left:
                        break
                    if attempt > 1:
                        if pause:
                            pause(backoff(attempt - 1))
                        for i in left:
                            waited[i] += backoff(attempt - 1)
                    try:
                        got = call([{f: some[i][f] for f in fields} for i in left], attempt)
                    except Exception:  # a failed call is a failed attempt for its whole batch
                        got = [None] * len(left)
                    for i, reply in zip(left, got, strict=True):
                        replies[i], tried[i] = reply, attempt
                status = ["answered" if r is not None else "failed" for r in replies]
                yield pa.RecordBatch.from_arrays([pa.array([r["request_sha"] for r in some], pa.string()), pa.array(replies, pa.string()), pa.array(tried, pa.int32()), pa.array(waited, pa.float64()), pa.array(status)], ["request_sha", "reply", "attempts", "waited", "status"])

    return send


def kept(spark: SparkSession, path: str) -> DataFrame:
    """What has been sent so far, a row for each request: its answer, or else its last failure. Nothing was kept yet: an empty table."""
    sent = spark.read.schema(_TABLE).option("recursiveFileLookup", "true").parquet(path) if exists(spark, path) else spark.createDataFrame([], _TABLE)
    row = F.struct("reply", "attempts", "waited", "status")
    return sent.groupBy("request_sha").agg(F.min_by(row, F.struct("status", "reply")).alias("r")).select("request_sha", "r.*")  # "answered" comes first


def answer(requests: DataFrame, fields: list[str], path: str, call: Call, size: int = 32, attempts: int = 3, pause: Callable[[float], None] | None = time.sleep) -> DataFrame:
    """requests with request_sha, reply, attempts, waited (seconds), status (answered or failed) and sent: whether this call sent it.

    A request is the content of its fields: equal ones are sent once, and never again once they are answered; a failed one is
    sent again by the next call. Missing requests go to `call` in batches of at most `size`, what a batch lacks again after a wait
    that doubles, `attempts` times in all. New replies are committed as one folder whose name is the content of the missing
    set: a task that runs again replaces its own output before the commit, and a job that runs again replaces the folder,
    so that no reply is kept twice. `call` is pickled with its module's by-value rules and must be safe to repeat.
    """
    spark = requests.sparkSession
    keyed = requests.withColumn("request_sha", content_hash(*map(F.col, fields)))
    before = kept(spark, path).filter("status = 'answered'").select("request_sha")
    missing = written(keyed.groupBy("request_sha").agg(*(F.first(f).alias(f) for f in fields)).join(before, "request_sha", "left_anti"))
    n, mark = missing.agg(F.count("*"), F.bit_xor(F.xxhash64("request_sha"))).first()
    if n:
        found = missing.mapInArrow(_sender(call, fields, size, attempts, pause), _TABLE)
        found.write.mode("overwrite").parquet(f"{path}/{n}-{mark & (1 << 64) - 1:016x}")
    sent = missing.select("request_sha", F.lit(True).alias("sent"))
    return keyed.join(kept(spark, path), "request_sha", "left").join(sent, "request_sha", "left").withColumn("sent", F.coalesce("sent", F.lit(False)))


def scored(pairs: DataFrame, source: str, candidate: str, reference: str, scorer: Callable[[list[dict]], list[float | None]] | None, size: int = 32) -> DataFrame:
    """Adds comet, the score of a learned metric to four places, and comet_note.

    scorer takes dicts of src, mt and ref, at most `size` at once. Without one, or where it fails, the score is null and the
    note says so: a number is never invented.
    """
    if scorer is None:
        return pairs.withColumn("comet", F.lit(None).cast("double")).withColumn("comet_note", F.lit("not installed: no learned-metric score"))

    @F.pandas_udf("struct<comet:double,note:string>")
    def score(src: pd.Series, mt: pd.Series, ref: pd.Series) -> pd.DataFrame:
        asked = [{"src": a, "mt": b, "ref": c} for a, b, c in zip(src, mt, ref)]
        scores, notes = [], []
        for k in range(0, len(asked), size):
            some = asked[k : k + size]
            try:
                got = [None if x is None else round(float(x), 4) for x in scorer(some)]
                scores, notes = [*scores, *got], [*notes, *([None] * len(some))]
            except Exception as e:
                scores, notes = [*scores, *([None] * len(some))], [*notes, *([f"failed: {e}"] * len(some))]
        return pd.DataFrame({"comet": pd.array(scores, "Float64"), "note": notes})

    out = pairs.withColumn("_score", score(source, candidate, reference))
    return out.withColumn("comet", F.col("_score.comet")).withColumn("comet_note", F.col("_score.note")).drop("_score")
