"""Substring deduplication by content-defined chunks: cuts where a gear rolling hash says so, duplicates by digest; and windows of
words wherever chunks don't tell already, so that no cut can lose a passage or its ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.common import binary, forget, lean, materialise, runs

#: Bytes in a chunk at least and at most; the gear hash cuts at one of 2**CUT_BITS places.
SHORTEST, LONGEST, CUT_BITS = 16, 256, 5
#: Words of a repeated passage: over 50.
PASSAGE_WORDS = 51
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash h = (h << 1) + GEAR[byte] modulo 2**32, which depends on the last 32 bytes; by doubling."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        older = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += older
    return h


def cuts(text: bytes) -> list[int]:
    """The ends of a text's chunks, SHORTEST to LONGEST bytes apart: places where the top CUT_BITS of the gear hash are 0; where
    none is near enough, the first place of the least hash, so that monotonous text too is cut by its content alone."""
    if not text:
        return []
    h = gear(np.frombuffer(text, np.uint8))
    out, last = [], 0
    for p in [*(np.flatnonzero(h < np.uint32(1 << (32 - CUT_BITS))) + 1).tolist(), len(text)]:
        while p - last > LONGEST:
            last += SHORTEST + int(h[last + SHORTEST - 1 : last + LONGEST].argmin())
            out.append(last)
        if p - last >= SHORTEST or p == len(text) > last:
            out.append(p)
            last = p
    return out


#: A digest has 96 bits, so that no two of 10**13 pieces share one by chance.
_DIGEST = ("digest", "check")
_DIGEST_SQL = "digest long, check int"
_PLACES = ("nth", "start_byte", "end_byte", "start_word", "end_word")
#: Where a run begins and ends, in bytes, words and chunks: minima and maxima in turn.
_SPAN = ("start_byte", "end_byte", "start_word", "end_word", "first_chunk", "last_chunk")
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True

def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = binary(batch, "text")
        for a, b in runs(texts):
            digest, nth, begin, end, first_word, last_word, sizes = [], [], [], [], [], [], []
            for t in texts[a:b]:
                ends = cuts(t) if t else []
                sizes.append(len(ends))
                if not ends:
                    continue
                begins = [0, *ends[:-1]]
                digest.append(_digests(t, begins, ends))
                nth += range(len(ends))
                begin += begins
                end += ends
                space = _SPACE[np.frombuffer(t, np.uint8)]
                first = ~space
                first[1:] &= space[:-1]
                begun = np.cumsum(first)[np.array(ends) - 1].tolist()
                first_word += [0, *begun[:-1]]
                last_word += begun
            owner = np.repeat(np.arange(a, b), sizes)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(owner)) for c in (0, 1)), *_joined(digest), *(pa.array(x, pa.int32()) for x in (nth, begin, end, first_word, last_word))], ["doc_id", "part", *_DIGEST, *_PLACES])


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, body (the text's digest), part (a number that tells apart the texts of an id) and text of the rows that have both."""
    texts = lean(docs).filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.withColumn("body", F.unhex(F.md5("text"))).select("doc_id", "body", F.hash("body").alias("part"), "text")


def chunk_table(texts: DataFrame) -> DataFrame:
    """One row for each chunk of each text: doc_id, part, digest, its number, its bytes, and the numbers of words begun before it and up to its end."""
    return texts.select("doc_id", "part", "text").mapInArrow(_chunk, f"doc_id long, part int, {_DIGEST_SQL}, " + ", ".join(f"{c} int" for c in _PLACES))


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes where words begin and where they end."""
    space = _SPACE[data]
    first, last = ~space, ~space
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _least(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least value of each range, by minima over powers of two."""
    level = np.frexp(end - begin)[1] - 1
    out = np.empty(len(begin), values.dtype)
    for k in range(int(level.max(initial=-1)) + 1):
        here = level == k
        out[here] = np.minimum(values[begin[here]], values[end[here] - (1 << k)])
        values = np.minimum(values[: -(1 << k)], values[1 << k :])
    return out


def windows(text: bytes, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and owner of each n_words words in a row. The owner is the end of the gram with the least gear hash in the window,
    the last of equals: it depends on the window's bytes alone, so that equal windows have equal owners wherever they are."""
    data = np.frombuffer(text, np.uint8)
    begin, end = words_of(data)
    begin, end = begin[: max(0, len(begin) - n_words + 1)], end[n_words - 1 :]
    if not len(begin):
        return begin, begin, begin
    gram = _gram(n_words)
    h = gear(data).astype(np.uint64) & np.uint64((1 << gram) - 1)  # the low bits depend on so many bytes
    packed = (h << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(data), dtype=np.uint64))
    owner = np.uint64(0xFFFFFFFF) - (_least(packed, begin + gram - 1, end) & np.uint64(0xFFFFFFFF))
    return begin, end, owner.astype(np.int64) + 1


def _gram(n_words: int) -> int:
    """Bytes of a gram: as many as the gear hash sees, unless n_words words can be shorter."""
    return min(32, 2 * n_words - 1)


def _digests(text: bytes, begin, end) -> np.ndarray:
    """The low and high 64 bits of the digest of each piece of a text."""
    found = b"".join(xxhash.xxh3_128_digest(text[i:j]) for i, j in zip(begin, end))
    return np.frombuffer(found, ">u8").astype(np.uint64).reshape(-1, 2)[:, ::-1]


def _joined(digests: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    found = np.concatenate(digests) if digests else np.zeros((0, 2), np.uint64)
    return pa.array(found[:, 0].astype(np.int64), pa.int64()), pa.array((found[:, 1] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), pa.int32())


def _low(text: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return _digests(text, begin.tolist(), end.tolist())[:, 0].astype(np.int64)


def _grams(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary(batch, "text")
            for a, b in runs(texts):
                places, grams = [], []
                for t in texts[a:b]:
                    begin, end = words_of(np.frombuffer(t, np.uint8))
                    owners = np.unique(windows(t, n_words)[2])
                    grams.append(np.unique(_low(t, owners - _gram(n_words), owners)))
                    ends = cuts(t)
                    places.append((begin[0], end[-1], 0, len(begin), *np.searchsorted(ends, (begin[0], end[-1] - 1), "right")) if len(begin) else (0,) * 6)
                offsets = np.cumsum([0, *map(len, grams)])
                listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(grams), pa.int64()))
                cols = [pa.array(np.array(x), pa.int32()) for x in zip(*places)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *cols, listed], ["doc_id", "body", *_SPAN, "grams"])

    return run


def _within(begin: np.ndarray, end: np.ndarray, spans: list | None) -> np.ndarray:
    """Whether each range lies within one of the spans (start, end)."""
    if not spans:
        return np.zeros(len(begin), bool)
    starts, ends = np.array(sorted((x["start_byte"], x["end_byte"]) for x in spans)).T
    last = np.searchsorted(starts, begin, "right") - 1
    return (last >= 0) & (np.maximum.accumulate(ends)[last] >= end)


def _windows_of(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, hits, known = binary(batch, "text"), batch.column(3), batch.column(4)
            for a, b in runs(texts):
                sizes, digests, places = [], [], []
                for k in range(a, b):
                    t = texts[k]
                    begin, end, owner = windows(t, n_words)
                    owners, which = np.unique(owner, return_inverse=True)
                    hit = np.isin(_low(t, owners - _gram(n_words), owners), hits[k].values.to_numpy())
                    nth = np.flatnonzero(hit[which] & ~_within(begin, end, known[k].as_py()))
                    begin, end, ends = begin[nth], end[nth], cuts(t)
                    sizes.append(len(nth))
                    digests.append(_digests(t, begin.tolist(), end.tolist()))
                    places.append((begin, end, nth, nth + n_words, np.searchsorted(ends, begin, "right"), np.searchsorted(ends, end - 1, "right")))
                owner = pa.array(np.repeat(np.arange(a, b), sizes))
                cols = [pa.array(np.concatenate(x), pa.int32()) for x in zip(*places)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), *_joined(digests), *cols], ["doc_id", "part", *_DIGEST, *_SPAN])

    return run


def _firsts(table: DataFrame, *key: str) -> DataFrame:
    """The smallest id of each key that several documents hold. Written first: a join of the aggregate as it stands would keep its
    partitioning, and hot keys could not be split."""
    return materialise(table.groupBy(*key).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select(*key, "first"))


def _span() -> list:
    return [(F.min if k % 2 == 0 else F.max)(c).alias(c) for k, c in enumerate(_SPAN)]


def _in_step(pieces: DataFrame, nth: str) -> DataFrame:
    """Runs of pieces (chunks or windows) that follow each other both in their document and in the one with the smallest id that
    holds them, so that each run stands there byte by byte. The piece's place in that document is the first one."""
    held = materialise(pieces.join(_firsts(pieces, *_DIGEST), list(_DIGEST)))
    places = materialise(held.filter("doc_id = first").select(*_DIGEST, _place(F.col("part"), F.col("start_byte")).alias("place")).groupBy(*_DIGEST).agg(F.min("place").alias("place")))
    again = held.filter("doc_id > first").join(places, list(_DIGEST)).withColumn("step", F.col("place") - F.col("start_byte"))
    order = Window.partitionBy("doc_id", "part", "first", "step").orderBy(nth)
    again = again.withColumn("run", F.col(nth) - F.dense_rank().over(order))
    out = materialise(again.groupBy("doc_id", "part", "first", "step", "run").agg(*_span()).select(*_RUN, *_SPAN))
    forget(held, places, shuffles=True)
    return out


#: What tells runs apart: where they stand, and by how much the first document's copy is off.
_RUN = ("doc_id", "part", "first", "step")


def _place(part: Column, byte: Column) -> Column:
    """A byte of one of an id's texts as one number."""
    return part.cast("long") * (1 << 32) + byte


def chunk_runs(texts: DataFrame, n_words: int) -> DataFrame:
    """Runs of chunks that follow each other and that one smaller id holds too, of n_words words at least."""
    table = materialise(chunk_table(texts))
    told = _in_step(table.withColumns({"first_chunk": F.col("nth"), "last_chunk": F.col("nth")}), "nth")
    forget(table, shuffles=True)
    return told.filter(F.col("end_word") - F.col("start_word") >= n_words)


def word_runs(texts: DataFrame, n_words: int, known: DataFrame | None = None) -> DataFrame:
    """Runs of windows of n_words words, one word after the other, that one smaller id holds too: every repetition of so many words.

    Windows are compared by digest, but only where they can repeat and what lies within a known run is left out: the smallest
    id that holds a window always deals it. Each is owned by the gram of least gear hash in it, and those whose gram no other
    document holds are left out too. Copies of a whole text are told by its digest, and only the copy with the smallest id
    is cut.
    """
    ints = ", ".join(f"{c} int" for c in _SPAN)
    table = materialise(texts.select("doc_id", "body", "text").mapInArrow(_grams(n_words), f"doc_id long, body binary, {ints}, grams array<long>"))
    bodies = table.filter(F.col("end_word") >= n_words)
    copies = materialise(bodies.drop("grams").join(_firsts(bodies, "body"), "body").filter("doc_id > first").distinct())
    grams = bodies.join(copies, ["doc_id", "body"], "left_anti").select("doc_id", F.hash("body").alias("part"), F.explode("grams").alias("gram"))
    hits = grams.join(_firsts(grams, "gram"), "gram").groupBy("doc_id", "part").agg(F.collect_set("gram").alias("hits"))
    if known is not None:
        hits = hits.join(known.groupBy("doc_id", "part").agg(F.collect_list(F.struct("start_byte", "end_byte")).alias("known")), ["doc_id", "part"], "left")
    hits = materialise(hits if known is not None else hits.withColumn("known", F.lit(None).cast("array<struct<start_byte:int,end_byte:int>>")))
    forget(table, shuffles=True)
    found = texts.join(hits, ["doc_id", "part"]).select("doc_id", "part", "text", "hits", "known")
    dealt = materialise(found.mapInArrow(_windows_of(n_words), f"doc_id long, part int, {_DIGEST_SQL}, {ints}"))
    told = _in_step(dealt, "start_word")
    forget(dealt, hits, shuffles=True)
    return told.unionByName(copies.withColumn("part", F.hash("body")).withColumn("step", _place(F.col("part"), F.lit(0))).select(*_RUN, *_SPAN))


def repeated_passages(docs: DataFrame, n_words: int = PASSAGE_WORDS) -> DataFrame:
    """Passages of n_words words or more of documents (doc_id, text) that a document with a smaller id holds too: what substring deduplication removes.

    Texts are cut into chunks by content, so that an insertion shifts no chunk but its own. A chunk is a duplicate in all
    documents but that with the smallest id, which keeps it. Runs of duplicate chunks that follow each other, in the document
    and in the one that keeps them, are passages. Chunks at a passage's ends also hold foreign text, and can hide all of a
    short one; so outside of those runs and at their ends windows of n_words words are compared as well, which tells every
    repetition of so many words to its first and last one. Runs in step with one document that meet are one passage; a passage
    that lies within another one is not told again. First ids are aggregated by digest before they are joined back, and the
    joins' hot digests are split by adaptive execution.

    Null and empty texts have no chunks; rows that repeat an id are one document, and repetitions within it are no duplicates;
    a null id takes no part; an empty table gives an empty result; other columns play no part.
    Returns doc_id, first_doc_id (a smaller id whose text holds the passage byte by byte), start_byte, end_byte, n_words, n_chunks.
    What is repeated partly from one document and partly from another is told as two passages, which may overlap.
    """
    texts = _texts(docs)
    chunked = chunk_runs(texts, n_words)
    told = chunked.unionByName(word_runs(texts, n_words, chunked))
    order = Window.partitionBy(*_RUN).orderBy("start_byte", "end_byte")
    apart = F.col("start_byte") > F.coalesce(F.max("end_byte").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    merged = told.withColumn("apart", apart.cast("int")).withColumn("passage", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy(*_RUN, "passage").agg(*_span())
    order = Window.partitionBy("doc_id", "part").orderBy("start_byte", F.desc("end_byte"), "first", "step")
    upto = F.max("end_byte").over(order.rowsBetween(Window.unboundedPreceding, -1))
    outer = merged.withColumn("upto", upto).filter(F.col("upto").isNull() | (F.col("upto") < F.col("end_byte")))
    words, chunks = F.col("end_word") - F.col("start_word"), F.col("last_chunk") - F.col("first_chunk") + 1
    return outer.select("doc_id", F.col("first").alias("first_doc_id"), "start_byte", "end_byte", words.cast("long").alias("n_words"), chunks.cast("long").alias("n_chunks"))
