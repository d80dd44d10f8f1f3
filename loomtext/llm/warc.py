"""WARC archives: writing captures as request, response or revisit, and metadata records, and assembling transactions again."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import lean, materialise, small
from loomtext.sources.scratch import file_system, scratch

CRLF = "\r\n"
END = CRLF * 2
#: Payloads of fewer bytes are never revisits.
LEAST_SHARED = 100
#: Tables of up to so many shared payloads (about 120 bytes each) are broadcast, longer ones joined by a shuffle.
MOST_SHARED = 200_000
#: A gzip member's last byte is 0 if it holds fewer bytes than this: that byte is the text writer's line separator.
_SMALL = 1 << 24
_DATE = "2024-01-01T00:00:00Z"
_RECORDS = pa.schema([("type", pa.string()), ("id", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("digest", pa.string()), ("http", pa.string()), ("block", pa.binary())])
_SQL = "type string, id string, concurrent_to string, refers_to string, uri string, date string, digest string, http string, block binary"


def _record(kind: Column, rec_id: Column, more: list[tuple[str, Column]], content: str, block: Column) -> Column:
    """One record without the blank lines that end it. A header whose value is null is left out."""
    heads = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: <"), rec_id, F.lit(">")), F.lit(f"WARC-Date: {_DATE}")]
    heads += [F.concat(F.lit(f"{name}: "), value) for name, value in more]
    heads += [F.lit(f"Content-Type: {content}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *heads), F.lit(END), block)


def _one_line(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n]+", " ")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record as gzip members without their last byte, which is 0: a record of _SMALL bytes or more is followed by an empty member."""
    for batch in batches:
        out = []
        for text in batch.column(0).cast(pa.binary()).to_pylist():
            record = text + b"\r\n\r\n"
            member = gzip.compress(record, 6, mtime=0)
            if len(record) >= _SMALL:
                member += gzip.compress(b"", mtime=0)
            out.append(member[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def _name_archives(spark: SparkSession, path: str) -> None:
    """Gives the written files the suffix of archives, by which readers know that they are compressed."""
    folder, fs = file_system(spark, path)
    for f in fs.listStatus(folder):
        name = f.getPath().getName()
        if name.startswith("part-") and not name.endswith(".gz"):
            fs.rename(f.getPath(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, name.split(".")[0] + ".warc.gz"))


def write_captures(pages: DataFrame, path: str, least: int = LEAST_SHARED) -> None:
    """Writes three records for each row of pages (page_id, url, html): request, response or revisit, metadata.

    A payload (html in UTF-8; null: empty) of at least `least` bytes is stored once, in the response of the smallest page_id;
    the others with its digest become revisits, which keep the HTTP head and name that response's id. Each record is a gzip
    member of its own, so archives can be read from any record on. Ids are made of the page_id and the digest, so that a
    task that is tried again writes the same ones; only rows that repeat both are numbered by their place in the table.

    Only digests are aggregated; those that several rows share are joined to the pages, by a broadcast up to MOST_SHARED of
    them, else by a shuffle whose hot digests adaptive execution splits. Rows that repeat the smallest page_id are all
    responses. A null page_id never wins over one that is set.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.monotonically_increasing_id().alias("seq"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).alias("n"))
    held = rows.groupBy("digest", "page_id").agg(F.count("*").alias("c"), F.min("seq").alias("lead"), F.min("n").alias("n"))
    held = held.groupBy("digest").agg(F.min("n").alias("n"), F.sum("c").alias("c"), F.max("c").alias("most"), F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "c", "lead")).alias("f"))
    first = held.filter("c > 1").select("digest", "most", (F.col("n") >= least).alias("shared"), F.col("f.page_id").alias("first"), (F.col("f.c") > 1).alias("twice"), "f.lead")
    first = materialise(first)  # so that a shuffled join with it can be split
    rows = rows.join(small(first, MOST_SHARED), "digest", "left")
    revisit = F.coalesce(F.col("shared"), F.lit(False)) & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    rows = rows.withColumn("revisit", revisit)

    def named(page_id: Column, seq: Column, numbered: Column) -> Column:
        return F.concat(F.lit("urn:capture:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(":"), F.substring("digest", 1, 32), F.when(numbered, F.concat(F.lit(":"), seq.cast("string"))).otherwise(""))

    me = named(F.col("page_id"), F.col("seq"), F.coalesce(F.col("most") > 1, F.lit(False)))
    main, target = F.concat(me, F.lit(":response")), ("WARC-Target-URI", F.nullif(_one_line(F.col("url")), F.lit("")))
    joined = ("WARC-Concurrent-To", F.concat(F.lit("<"), main, F.lit(">")))
    path_of = F.regexp_replace(_one_line(F.col("url")), r"^[a-zA-Z]+://[^/?#]*", "")
    host = F.regexp_extract(_one_line(F.col("url")), r"^[a-zA-Z]+://([^/?#]*)", 1)
    asked = F.concat(F.lit("GET "), F.when(path_of == "", "/").otherwise(path_of), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(END))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(END))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    refers = ("WARC-Refers-To", F.when(F.col("revisit"), F.concat(F.lit("<"), named(F.col("first"), F.col("lead"), F.col("most") > 1), F.lit(":response>"))))
    profile = ("WARC-Profile", F.when(F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))
    notes = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))
    records = F.array(
        _record(F.lit("request"), F.concat(me, F.lit(":request")), [target, joined], "application/http;msgtype=request", asked),
        _record(F.when(F.col("revisit"), "revisit").otherwise("response"), main, [target, digest, refers, profile], "application/http;msgtype=response", F.concat(head, F.when(F.col("revisit"), "").otherwise(F.col("html")))),
        _record(F.lit("metadata"), F.concat(me, F.lit(":metadata")), [target, joined], "application/warc-fields", notes),
    )
    members = lean(rows.select(F.explode(records).alias("value"))).mapInArrow(_members, "value binary")
    members.select(F.col("value").cast("string")).write.option("lineSep", "\0").text(path)
    _name_archives(spark, path)


class _Stream:
    """Rebuilds the bytes of archives from pieces cut at blank lines, and reads records by their Content-Length."""

    def __init__(self):
        self.pieces: list[bytes] = []
        self.have = 0
        self.want = 0

    def add(self, piece: bytes) -> Iterator[dict]:
        self.pieces += (piece, b"\r\n\r\n")
        self.have += len(piece) + 4
        if self.have < self.want:
            return
        data = b"".join(self.pieces)
        at = 0
        while True:
            while data[at : at + 2] == b"\r\n":
                at += 2
            end = data.find(b"\r\n\r\n", at)
            if end < 0:
                break
            lines = data[at:end].decode("utf-8", "replace").split("\r\n")
            fields = {}
            for line in lines[1:]:
                name, _, value = line.partition(":")
                fields.setdefault(name.strip().lower(), value.strip())
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no WARC record: {lines[0][:60]!r}")
            upto = end + 4 + int(fields["content-length"])
            if upto > len(data):
                break
            yield fields | {"block": data[end + 4 : upto]}
            at = upto
        self.pieces, self.have = [data[at:]], len(data) - at
        self.want = upto - at if end >= 0 else 0


def _bare(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def _row(r: dict) -> tuple:
    http, block = None, r["block"]
    if r["warc-type"] in ("request", "response", "revisit"):
        top, _, block = block.partition(b"\r\n\r\n")
        http = top.decode("utf-8", "replace")
    digest = r.get("warc-payload-digest", "").partition(":")[2] or None
    return r["warc-type"], _bare(r.get("warc-record-id")), _bare(r.get("warc-concurrent-to")), _bare(r.get("warc-refers-to")), r.get("warc-target-uri"), r.get("warc-date"), digest, http, block


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stream, rows, held = _Stream(), [], 0
    for batch in batches:
        for piece in batch.column(0).to_pylist():
            for r in stream.add(piece):
                rows.append(_row(r))
                held += len(rows[-1][-1]) + 300
                if held > 4 << 20:
                    yield _as_batch(rows)
                    rows, held = [], 0
    if rows:
        yield _as_batch(rows)


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _RECORDS.types)], schema=_RECORDS)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of gzip archives under a path, streamed: a task holds one record at a time. Blocks are split into HTTP head and payload.

    Any cut of the stream will do for that: here at blank lines.
    """
    pieces = spark.read.option("lineSep", END).schema("value string").text(path)
    return lean(pieces).select(F.col("value").cast("binary").alias("value")).mapInArrow(_parse, _SQL)


def transactions(records: DataFrame, payload: bool = False) -> DataFrame:
    """One nested row for each capture: its response or revisit joined with the request and metadata records that are concurrent to it.

    A revisit also has `original`, the response that it refers to by id, which is looked up among the records; null where the
    archive doesn't hold it. A capture without request or metadata has null there; a request or metadata record whose capture
    is missing is left out. payload: whether the stored payload itself is kept, next to its length and SHA-256.
    """
    key = F.coalesce("concurrent_to", "id")
    main = F.col("type").isin("response", "revisit")
    stored = F.struct("type", "id", "refers_to", "uri", "date", "digest", "http", F.octet_length("block").cast("long").alias("n_stored"), F.sha2("block", 256).alias("stored_digest"), *([F.col("block").alias("payload")] if payload else []))
    asked, notes = F.struct("id", "http"), F.struct("id", F.col("block").cast("string").alias("fields"))
    slim = records.select(key.alias("capture"), F.when(main, stored).alias("response"), F.when(F.col("type") == "request", asked).alias("request"), F.when(F.col("type") == "metadata", notes).alias("metadata"))
    whole = slim.groupBy("capture").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("request", "response", "metadata")]).filter(F.col("response").isNotNull())
    whole = materialise(whole)  # read once more for the originals; hot ones are split
    wanted = whole.filter(F.col("response.refers_to").isNotNull()).select(F.col("response.refers_to").alias("capture")).distinct()
    heads = whole.filter("response.type = 'response'").select("capture", F.struct("capture", "response.n_stored", "response.stored_digest", "metadata.fields").alias("original"))
    originals = materialise(heads.join(wanted, "capture", "left_semi").withColumnRenamed("capture", "refers"))
    return whole.withColumn("refers", F.col("response.refers_to")).join(originals, "refers", "left").drop("refers")


def capture_digests(pages: DataFrame, path: str | None = None, least: int = LEAST_SHARED) -> DataFrame:
    """Writes pages to archives (in the shared folder unless a path is given), reads them back and tells of each capture what it stored.

    An empty html gives an empty payload; an empty table an archive without records and an empty result. A revisit's digest,
    length and refers_to are those of the response that its record refers to, as it is found in the archives.
    """
    spark = pages.sparkSession
    path = path or scratch(spark)
    write_captures(pages, path, least)
    t = transactions(read_records(spark, path))
    page = lambda fields: F.nullif(F.regexp_extract(fields, r"page-id: (-?\d+)", 1), F.lit("")).cast("long")
    revisit = F.col("response.type") == "revisit"
    return t.select(
        page("metadata.fields").alias("page_id"),
        F.when(revisit, F.col("original.n_stored")).otherwise(F.col("response.n_stored")).alias("payload_bytes"),
        F.when(revisit, F.col("original.stored_digest")).otherwise(F.col("response.stored_digest")).alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        page("original.fields").alias("refers_to"),
        F.col("response.uri").alias("uri"),
    )
