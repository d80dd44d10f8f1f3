"""Helpers shared by the training-data operators: durable intermediate tables, tokens, Arrow access."""

from __future__ import annotations

import re

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.sources.scratch import remove, scratch, shared_folder

#: Words of the contracts: runs of anything but space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a small frame with a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(*frames: DataFrame, shuffles: bool = False) -> None:
    """Removes the tables that materialise() wrote for these frames, once nothing reads them any more; with `shuffles` the shuffle
    files of frames that are gone are let go too, which the driver's garbage collector tells their cleaner."""
    spark = frames[0].sparkSession
    for df in frames:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/loomtext-" in path:
                remove(spark, path)
    if shuffles:
        spark.sparkContext._jvm.System.gc()


def materialise(df: DataFrame) -> DataFrame:
    """Writes a frame as Parquet in the shared folder and reads it back: later steps survive lost executors and never recompute it."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Narrow rows that a task writes at least, where there are fewer tasks than shuffle partitions.
TASK_ROWS = 200_000


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """A frame that ends in an aggregate or distinct(), of about so many narrow rows, over no more tasks than these need, but as many as there are
    cores: each of many partitions would else become a file of a few rows. Those ends have no hot partitions, so none are put together."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    return df.coalesce(n) if n < partitions(df.sparkSession) else df


#: Rows and bytes of the Arrow batches that go to and from Python, at most.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def lean(df: DataFrame) -> DataFrame:
    """Bounds the session's Arrow batches, so that long texts don't fill the memory of executors and their Python workers; lower settings stay."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.match(r"\d+$", str(conf.get(key, str(2**31 - 2))))
        if not now or not 0 < int(now[0]) <= most:
            conf.set(key, str(most))
    return df


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def share(spark: SparkSession, value) -> Broadcast:
    """Broadcasts a value that may hold classes of this package: Spark pickles broadcasts by reference, but executors need not be able to import it."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def held(shared: Broadcast):
    """In a task, the value that share() broadcast."""
    return cloudpickle.loads(shared.value)


def plain_names(docs: DataFrame, *kept: str) -> DataFrame:
    """docs with all columns but the kept ones named by their place, so that no name can clash with a helper's or be read as a path; toDF() gives the names back."""
    return docs.toDF(*(c if c in kept else f"c{k}" for k, c in enumerate(docs.columns)))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """A broadcast hint, if a count shows that the frame has at most so many rows; else the frame, for a shuffled join."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def words(text: bytes | None) -> list[bytes]:
    """bytes.lower() folds A-Z alone and bytes.split() cuts at the six white-space bytes of WORD."""
    return text.lower().split() if text else []


def word_lists(text: bytes | None, most_bytes: int = 1 << 20):
    """The words of a text in order, as lists from pieces of about so many bytes that are cut at white space: bounds what a very long text takes."""
    text, at = text or b"", 0
    while at < len(text):
        end = at + most_bytes
        while end < len(text) and text[end] not in _SPACE:
            end += 1
        yield words(text[at:end])
        at = end


_SPACE = b" \t\n\x0b\x0c\r"


def binary(batch, column: str) -> list:
    """A binary column of an Arrow batch as a list of bytes or None."""
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def runs(texts: list, most_bytes: int = 1 << 19):
    """Index ranges of consecutive texts of about so many bytes, one text at least: bounds the memory of vectorised steps."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and total + n > most_bytes:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)
