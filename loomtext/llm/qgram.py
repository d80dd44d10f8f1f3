"""Benchmark decontamination by the q-gram lemma: shared q-grams in diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import binary, forget, held, lean, materialise, plain_names, runs, share

#: Bytes in a q-gram; the edits allowed, as a share of an item's length; bits of the first filter's table.
Q, RATE, TABLE_BITS = 8, 0.08, 21
#: Bands that are counted at once, in expectation.
SLICE = 1 << 20
#: Benchmark items are indexed and broadcast in blocks of about so many bytes, with some 24 bytes of index for each.
BLOCK_BYTES = 4 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)


def normal(text: bytes | None) -> bytes:
    """A-Z lower-cased, runs of ASCII white space as one space, none at the ends."""
    return b" ".join(text.lower().split()) if text else b""


def _grams(data: bytes) -> np.ndarray:
    """The Q bytes at each position as one 64-bit number."""
    n = len(data) - Q + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out, padded = np.empty((n + 7) // 8 * 8, np.uint64), data + bytes(16)
    for r in range(8):
        out[r::8] = np.frombuffer(padded, "<u8", len(out) // 8, r)
    return out[:n]


def _slot(grams: np.ndarray) -> np.ndarray:
    return ((grams * _MUL) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


class Index:
    """Of a block of benchmark items: where each q-gram is, and each item's edit budget and least count of shared q-grams.

    Places of a gram in an item that are at most a band's step apart are one run from `low` to `high`: on any diagonal the bands
    of its places follow one another without a gap, so that a gram that repeats in an item costs its bands, not its places.
    Items of fewer than Q bytes have no q-gram and no edit: they are looked up as sequences of whole words.
    """

    def __init__(self, items: list[tuple[int, bytes]]):
        short = [(i, t) for i, t in items if 0 < len(t) < Q]
        items = [(i, t) for i, t in items if len(t) >= Q]
        self.n_long, self.short = len(items), {}
        for k, (_, t) in enumerate(short):
            self.short.setdefault(t, []).append(len(items) + k)
        self.widths = sorted({t.count(b" ") + 1 for t in self.short})
        grams = [_grams(t) for _, t in items]
        items += short
        self.ids, self.texts = [i for i, _ in items], [t for _, t in items]
        lengths = np.array([len(t) for t in self.texts], np.int64)
        self.budget = np.minimum((RATE * lengths).astype(np.int64), (lengths - Q) // Q)  # at least one q-gram survives
        self.least = lengths - Q + 1 - Q * self.budget
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams]) if grams else np.zeros(0, np.int32)
        order = np.argsort(flat, kind="stable")
        flat, item, place = flat[order], item[order], place[order]
        step = self.budget + 1
        fresh = np.ones(len(flat), bool)
        fresh[1:] = (flat[1:] != flat[:-1]) | (item[1:] != item[:-1]) | (place[1:] - place[:-1] > step[item[1:]])
        heads = np.flatnonzero(fresh)
        self.item, self.low, self.high = item[heads], place[heads], place[np.append(heads[1:], len(flat)) - 1] if len(heads) else place
        self.grams, begin, count = np.unique(flat[heads], return_index=True, return_counts=True)
        self.begin, self.count = begin.astype(np.int32), count.astype(np.int32)
        bands = (self.high - self.low) // step[self.item] + 3  # of a run at a position, at most
        self.bands = np.add.reduceat(bands, begin) if len(begin) else np.zeros(0, np.int64)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[_slot(self.grams)] = True


def _last_row(p: np.ndarray, t: np.ndarray, first: int, row: np.ndarray, most: int) -> np.ndarray | None:
    """Edits of all of p against t up to each of the diagonals from `first` on, given those of nothing of p; None if all take more than `most`."""
    far, steps = len(p) + len(t) + 1, np.arange(len(row))
    for i in range(1, len(p) + 1):
        at = i + first + steps  # the text position after this cell
        valid = (at >= 0) & (at <= len(t))
        same = (t[np.clip(at - 1, 0, len(t) - 1)] == p[i - 1]) & (at >= 1) if len(t) else np.zeros(len(row), bool)
        new = np.minimum(np.where(at >= 1, row + ~same, far), np.append(row[1:], far) + 1)
        new = np.where(valid, new, far)
        row = np.where(valid, np.minimum.accumulate(new - steps) + steps, far)
        if row.min() > most:
            return None
    return row


def align(pattern: bytes, text: bytes, low: int, high: int, most: int) -> tuple[int, int] | None:
    """The least edits that turn the pattern into a piece of the text, and where the first such piece ends, looking only at the
    diagonals (text position less pattern position) from low - most to high + most; None if it takes more than `most` edits."""
    exact = text.find(pattern, max(0, low - most), max(0, high + most + len(pattern)))
    if exact >= 0:
        return 0, exact + len(pattern)
    if not most:
        return None
    skip = max(0, low - most)  # what of the text the diagonals don't reach plays no part
    p, t = np.frombuffer(pattern, np.uint8), np.frombuffer(text[skip : max(skip, high + 2 * most + len(pattern))], np.uint8)
    first = low - most - skip
    at = first + np.arange(high - low + 2 * most + 1)
    row = _last_row(p, t, first, np.where((at >= 0) & (at <= len(t)), 0, len(p) + len(t) + 1), most)
    if row is None:
        return None
    best = int(row.argmin())
    return int(row[best]), len(p) + first + best + skip


def begin_of(pattern: bytes, text: bytes, end: int, edits: int) -> int:
    """Where the piece of the text begins that ends at `end` and is so many edits from the pattern; of several the shortest."""
    if not edits:
        return end - len(pattern)
    back = text[max(0, end - len(pattern) - edits) : end][::-1]
    p, t = np.frombuffer(pattern[::-1], np.uint8), np.frombuffer(back, np.uint8)
    at = np.arange(-edits, edits + 1)
    row = _last_row(p, t, -edits, np.where((at >= 0) & (at <= len(t)), at, len(p) + len(t) + 1), edits)
    return end - (len(p) - edits + int(row.argmin()))


def _find_short(index: Index, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
    for d, text in enumerate(texts):
        words, told = text.split(b" "), set()
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        for width in index.widths:
            for k in range(len(words) - width + 1):
                for i in index.short.get(b" ".join(words[k : k + width]), ()):
                    if i not in told:
                        told.add(i)
                        end = int(ends[k + width - 1])
                        yield d, i, 0, end - len(index.texts[i]), end


def find(index: Index, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, edits, start, end) of the best match of each item in each normal text, in order."""
    out = _find_long(index, texts) if index.n_long else []
    return sorted([*out, *_find_short(index, texts)]) if index.short else out


def _full_bands(index: Index, texts: list[bytes]) -> list[tuple[int, int, int]]:
    """(text, item, band) of the bands in which enough of a text's positions share a q-gram with the item, in order.

    Band j holds the diagonals of steps j and j + 1: a match's diagonals, at most `budget` apart, lie together in one. A text
    position counts once in a band. Positions are gone through in slices of about SLICE bands; counts go on from one slice to
    the next and are let go once the text is past their band, so that memory does not grow with a text or with how often it repeats a gram.
    """
    gap = bytes(Q)
    starts = np.cumsum([0] + [len(t) + Q for t in texts])
    grams = _grams(gap.join(texts) + gap)
    hit = np.flatnonzero(index.table[_slot(grams)])
    which = np.minimum(np.searchsorted(index.grams, grams[hit]), len(index.grams) - 1)
    true = index.grams[which] == grams[hit]
    hit, which = hit[true], which[true]
    if not len(hit):
        return []
    steps, lengths = index.budget + 1, np.array([len(t) for t in index.texts], np.int64)
    before = int(lengths.max()) + 4
    span = before + max(map(len, texts)) + 4
    cost = np.cumsum(index.bands[which])
    cuts = np.unique(np.append(np.searchsorted(cost, np.arange(0, cost[-1], SLICE)), len(hit)))
    keys, sizes, out = np.zeros(0, np.int64), np.zeros(0, np.int64), []
    for a, b in zip(np.append(0, cuts), cuts):
        counts = index.count[which[a:b]].astype(np.int64)
        turn = np.repeat(np.arange(b - a), counts)
        run = np.arange(len(turn)) - np.repeat(np.cumsum(counts) - counts, counts) + index.begin[which[a:b]][turn]
        pos, item = hit[a:b][turn], index.item[run]
        doc = np.searchsorted(starts, pos, side="right") - 1
        lower = (pos - starts[doc] - index.high[run]) // steps[item] - 1
        upper = (pos - starts[doc] - index.low[run]) // steps[item]
        again = (turn[1:] == turn[:-1]) & (item[1:] == item[:-1])  # a later run of the gram: its bands lie below the former's
        upper[1:] = np.where(again, np.minimum(upper[1:], lower[:-1] - 1), upper[1:])
        n = np.maximum(upper - lower + 1, 0)
        at = np.repeat(np.arange(len(n)), n)
        band = lower[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        new, times = np.unique((doc[at] * len(lengths) + item[at]) * span + band + before, return_counts=True)
        keys, inverse = np.unique(np.concatenate([keys, new]), return_inverse=True)
        sizes = np.bincount(inverse, np.concatenate([sizes, times]), len(keys)).astype(np.int64)
        pair, band = keys // span, keys % span - before
        doc, item = pair // len(lengths), pair % len(lengths)
        past = np.ones(len(keys), bool)
        if b < len(hit):  # the band's last position in the text lies before the next position
            now = np.searchsorted(starts, hit[b], side="right") - 1
            past = (doc < now) | ((band + 2) * steps[item] + lengths[item] <= hit[b] - starts[now])
        full = past & (sizes >= index.least[item])
        out += zip(doc[full].tolist(), item[full].tolist(), band[full].tolist())
        keys, sizes = keys[~past], sizes[~past]
    return sorted(out)


def _find_long(index: Index, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for d, i, j in _full_bands(index, texts):
        budget, step = int(index.budget[i]), int(index.budget[i]) + 1
        most = best[d, i][0] - 1 if (d, i) in best else budget  # a later band counts only with fewer edits
        got = align(index.texts[i], texts[d], j * step, (j + 2) * step - 1, most) if most >= 0 else None
        if got:
            best[d, i] = got
    return [(d, i, e, begin_of(index.texts[i], texts[d], end, e), end) for (d, i), (e, end) in sorted(best.items())]


def _finder(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held(shared)
        for batch in batches:
            ids, texts = batch.column(0), binary(batch, "text")
            for a, b in runs(texts):
                found = find(index, [normal(t) for t in texts[a:b]])
                if found:
                    d, i, edits, start, end = zip(*found)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.array(d) + a)), pa.array([index.ids[x] for x in i], pa.int64()), pa.array(edits, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["doc_id", "item_id", "edits", "start", "end"])

    return scan


def indexes(benchmark: DataFrame) -> tuple[int, Iterator[Index]]:
    """The number of blocks of the benchmark (item_id, text) of about BLOCK_BYTES each, and their indexes, one made at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).filter("text IS NOT NULL AND item_id IS NOT NULL")
    total = items.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES)
    part = lambda k: items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
    return blocks, (Index(sorted((r["item_id"], normal(bytes(r["text"]))) for r in part(k))) for k in range(blocks))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, start, end): the documents that hold a benchmark item with at most RATE of its length in edits.

    Texts are compared as UTF-8 with A-Z lower-cased and white space as single spaces; start and end count bytes there. By
    the q-gram lemma such a passage shares at least (length - Q + 1) - Q * budget q-grams with its item, on diagonals at
    most `budget` apart; regions with so many are verified by an alignment in the band. Of several passages that
    match an item the one with fewest edits is told, of these the first to end, of these the shortest. Whole texts are searched, without a shuffle. A
    benchmark of several blocks is gone through block by block, each block's result written before the next index is made,
    so that no task and no driver ever holds two.

    Items of fewer than Q bytes are found where their words stand as whole words, without edits; so of a short item the
    first place. Null and empty texts and items match nothing; repeated rows are told each for itself; an empty
    table on either side gives an empty result; other columns play no part.
    """
    spark = docs.sparkSession
    rows = lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    blocks, made = indexes(benchmark)
    out = None
    for index in made:
        shared = share(spark, index)
        part = rows.mapInArrow(_finder(shared), "doc_id long, item_id long, edits long, start long, end long")
        if blocks > 1:
            part = materialise(part)
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id long, edits long, start long, end long")


def _keeper(shared, position: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held(shared)
        for batch in batches:
            texts = batch.column(position).cast(pa.binary()).to_pylist()
            clean = np.ones(len(texts), bool)
            for a, b in runs(texts):
                for d, *_ in find(index, [normal(t) for t in texts[a:b]]):
                    clean[a + d] = False
            yield batch.filter(pa.array(clean))

    return keep


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, columns unchanged, that hold no benchmark item. Between the blocks of a large benchmark what is left is written.

    Null and empty texts stay; rows that repeat an id are judged each for itself; names of other columns may be any; an empty
    table on either side takes nothing away.
    """
    names, position, docs = docs.columns, docs.columns.index("text"), plain_names(docs)
    blocks, made = indexes(benchmark)
    before = None
    for index in made:
        shared = share(docs.sparkSession, index)
        docs = lean(docs).mapInArrow(_keeper(shared, position), docs.schema)
        if blocks > 1:
            docs = materialise(docs)
            shared.destroy()
            if before is not None:
                forget(before)
            before = docs
    return docs.toDF(*names)
