"""Hard negatives by product quantisation: bounded approximate scores leave few candidates, whose exact scores fill each window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.common import checkpoint, materialise
from loomtext.llm.mtree import WIDEST, _Best, _matrix, _products
from loomtext.sources.scratch import scratch

#: Parts of a vector that are quantised apart, centroids of a part at most, distinct vectors that they are fitted to in expectation, steps of fitting.
SUBSPACES, CENTROIDS, SAMPLE, STEPS = 8, 64, 4096, 8
#: Vectors of a page; anchors that are searched for at once, the block that every task holds.
PAGE, ANCHOR_BLOCK = 1024, 1024
_LOWEST, _HIGHEST = -(1 << 63), (1 << 63) - 1
#: Room for rounding in bounds of doubles, relative to the norms.
_SLACK = 1e-9


def labelled_vectors(table: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """id, label and v, an array of floor(scale * x); rows with a null id, label or vector, or a null or non-finite component, are left out.

    A finite component of 2**WIDEST or more is an error that names the row's id, not a row less, since bounds would not hold.
    """
    x = F.col(vector_col)
    fine = x.isNotNull() & F.forall(x, lambda e: F.coalesce(~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")), F.lit(False)))
    told = F.concat(F.lit(f"a component of 2**{WIDEST} or more in the vector of "), F.col(id_col).cast("string"))
    whole = lambda e: F.when(F.abs(e.cast("double")) < float(1 << WIDEST), F.floor(e.cast("double") * scale)).otherwise(F.raise_error(told).cast("long"))
    rows = table.filter(fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(x, whole).alias("v"))
    return rows.filter("label IS NOT NULL")


def _parts(x: np.ndarray) -> np.ndarray:
    """Rows as (row, part, components of the part), filled up with zeros."""
    width = -(-x.shape[1] // SUBSPACES)
    out = np.zeros((len(x), SUBSPACES * width))
    out[:, : x.shape[1]] = x
    return out.reshape(len(x), SUBSPACES, width)


def _nearest(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The nearest centroid of each part of each row, in one book for each part."""
    far = (books * books).sum(axis=2)[None] - 2 * np.einsum("rpw,pcw->rpc", x, books, optimize=True)
    return far.argmin(axis=2)


def fit_books(vectors: DataFrame, dim: int) -> np.ndarray:
    """Centroids (part, centroid, component) by k-means over a sample of distinct vectors, SAMPLE in expectation."""
    n = vectors.count()
    u = F.pmod(F.xxhash64(F.to_json("v")), F.lit(1 << 30)) / float(1 << 30)  # copies of a vector fall together, so that distinct ones are few
    sample = sorted(r["v"] for r in vectors.filter(u < SAMPLE / max(1, n)).select("v").distinct().collect())
    x = _parts(_matrix(sample, dim).astype(np.float64)) if sample else np.zeros((1, SUBSPACES, -(-dim // SUBSPACES)))
    start = np.random.default_rng(17).permutation(len(x))[:CENTROIDS]
    books = x[start].transpose(1, 0, 2).copy()
    for _ in range(STEPS):
        code = _nearest(x, books)
        for p in range(SUBSPACES):
            counts = np.bincount(code[:, p], minlength=books.shape[1])
            sums = np.zeros_like(books[p])
            np.add.at(sums, code[:, p], x[:, p])
            books[p, counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return books


_PAGE_SQL = "ids binary, labels binary, codes binary, residuals binary, reach double, vectors binary"


def _encoder(shared, dim: int):
    def page(ids: list, labels: list, vectors: list) -> list:
        v = _matrix(vectors, dim)
        x, books = _parts(v.astype(np.float64)), shared.value
        code = _nearest(x, books)
        rest = x - books[np.arange(SUBSPACES)[None, :], code]
        residual = np.sqrt((rest * rest).sum(axis=2)) * (1 + _SLACK)
        reach = float(np.sqrt((x * x).sum(axis=(1, 2)).max()) + np.sqrt((residual * residual).sum(axis=1).max()))
        return [np.array(ids, np.int64).tobytes(), np.array(labels, np.int64).tobytes(), code.astype(np.uint8).tobytes(), residual.tobytes(), reach, v.tobytes()]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _PAGE_SQL.split(", ")]
        held: tuple[list, list, list] = ([], [], [])
        for batch in batches:
            for have, column in zip(held, batch.columns):
                have += column.to_pylist()
            while len(held[0]) >= PAGE:
                yield pa.RecordBatch.from_pylist([dict(zip(names, page(*(h[:PAGE] for h in held))))])
                held = tuple(h[PAGE:] for h in held)
        if held[0]:
            yield pa.RecordBatch.from_pylist([dict(zip(names, page(*held)))])

    return encode


class _Pages:
    """A page's columns, and bounds of its scores with anchors."""

    def __init__(self, row: dict, dim: int):
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.codes = np.frombuffer(row["codes"], np.uint8).reshape(-1, SUBSPACES)
        self.residuals = np.frombuffer(row["residuals"]).reshape(-1, SUBSPACES)
        self.reach, self.vectors = row["reach"], np.frombuffer(row["vectors"], np.int64).reshape(-1, dim)

    def bounds(self, tables: np.ndarray, norms: np.ndarray, some: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the scores of some anchors with some rows lie between: what the table of each part says, summed, and on either
        side the anchor's norm in each part times the row's residual there (Cauchy-Schwarz)."""
        near = np.zeros((len(some), len(rows)))
        for p in range(SUBSPACES):
            near += tables[some, p][:, self.codes[rows, p]]
        room = norms[some] @ self.residuals[rows].T + (_SLACK * np.sqrt((norms[some] ** 2).sum(axis=1)) * 2 * self.reach + 1e-6)[:, None]
        return near - room, near + room


def _tables(anchors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each anchor's product with every centroid of every part, and its norm in every part."""
    x = _parts(anchors.astype(np.float64))
    return np.einsum("apw,pcw->apc", x, books, optimize=True), np.sqrt((x * x).sum(axis=2)) * (1 + _SLACK)


def _rerank(page: _Pages, anchors: np.ndarray, some: np.ndarray, rows: np.ndarray, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs that may count, the anchors and rows that have any, their exact scores, and the pairs again."""
    up, across = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
    return some[up], rows[across], _products(anchors[some[up]], page.vectors[rows[across]]), maybe[np.ix_(up, across)]


def _positives(shared, books, dim: int, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, anchors = shared.value
        tables, norms = _tables(anchors, books.value)
        best, bar = [_Best(k, _LOWEST) for _ in ids], np.full(len(ids), _LOWEST, np.int64)
        for batch in batches:
            for page in (_Pages(r, dim) for r in batch.to_pylist()):
                for label in np.intersect1d(page.labels, labels).tolist():
                    some, rows = np.flatnonzero(labels == label), np.flatnonzero(page.labels == label)
                    _, high = page.bounds(tables, norms, some, rows)
                    maybe = (high >= bar[some][:, None]) & (page.ids[rows][None, :] != ids[some][:, None])
                    some, rows, scores, maybe = _rerank(page, anchors, some, rows, maybe)
                    good = maybe & (scores >= bar[some][:, None])
                    for r in np.flatnonzero(good.any(axis=1)).tolist():
                        a = some[r]
                        best[a].add(scores[r, good[r]], page.ids[rows[good[r]]])
                        bar[a] = best[a].bar
        yield from _told([(int(i), 0, b) for i, b in zip(ids, best)])

    return search


def _negatives(shared, books, dim: int, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, anchors, centres, lows, highs = shared.value
        tables, norms = _tables(anchors, books.value)
        windows = range(lows.shape[1])
        best, bars = [[_Best(k, int(low)) for low in row] for row in lows], lows.copy()  # a window's bar rises from its lower end
        for batch in batches:
            for page in (_Pages(r, dim) for r in batch.to_pylist()):
                some, rows = np.arange(len(ids)), np.arange(len(page.ids))
                low, high = page.bounds(tables, norms, some, rows)
                other, maybe = page.labels[None, :] != labels[:, None], np.zeros(low.shape, bool)
                for w in windows:
                    maybe |= (high >= bars[:, w, None]) & (low <= highs[:, w, None]) & (bars[:, w] <= highs[:, w])[:, None]
                some, rows, scores, maybe = _rerank(page, anchors, some, rows, maybe & other & (page.ids[None, :] != ids[:, None]))
                for w in windows:
                    good = maybe & (scores >= bars[some, w][:, None]) & (scores <= highs[some, w][:, None])
                    for r in np.flatnonzero(good.any(axis=1)).tolist():
                        a = some[r]
                        best[a][w].add(scores[r, good[r]], page.ids[rows[good[r]]])
                        bars[a, w] = best[a][w].bar
        yield from _told([(int(i), int(c), b) for i, row, cs in zip(ids, best, centres) for b, c in zip(row, cs)])

    return search


def _told(found: list[tuple[int, int, _Best]]) -> Iterator[pa.RecordBatch]:
    sizes = [len(b.ids) for _, _, b in found]
    if sum(sizes):
        spread = lambda k: pa.array(np.repeat(np.array([f[k] for f in found], np.int64), sizes))
        yield pa.RecordBatch.from_arrays([spread(0), spread(1), pa.array(np.concatenate([b.ids for _, _, b in found])), pa.array(np.concatenate([b.scores for _, _, b in found]))], ["anchor_id", "positive_score", "vec_id", "score"])


_FOUND_SQL = "anchor_id long, positive_score long, vec_id long, score long"


def _first(found: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k best rows of each key by score, then by smaller id, with their rank."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)


def windows_of(scores: list[int], low: int, high: int) -> list[tuple[int, int, int]]:
    """(positive's score, least and greatest score of its negatives) for each of some positives' distinct scores: low to high percent of it. Empty windows go."""
    out = [(p, -(-low * p // 100), high * p // 100) for p in sorted(set(scores))]
    return [w for w in out if w[1] <= w[2]]


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """Negatives that score nearly as high with an anchor as its positives do, among the vectors (id, label, v), for each of some of these.

    An anchor's positives are its `positives` best other rows of its label by inner product. For each of them the `negatives`
    best rows of other labels are told whose score lies between low and high percent of the positive's: anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score. Ties go to the smaller id.

    Vectors are coded once, without a shuffle: for each of 8 parts the nearest of 64 centroids, fitted to a bounded sample,
    and the norm of what it leaves. A task's tables of anchor and centroid products then bound every score from both sides, and
    only rows that may reach a window's k-th best and don't lie surely above the window are scored exactly, in integers. No
    window is cut short: bounds only spare scores that cannot count. Anchors, of any number, go in blocks, each broadcast and
    then destroyed, whose results are written one after another; a task hands on its k best of each anchor or window only.

    Rows that repeat an id: the first by label and vector is the anchor; none of its own id counts; all are candidates of other
    anchors, a row each. Shorter vectors count as filled up with zeros. A score beyond 64 bits is an error. Without other
    rows of its label an anchor has no result. Empty tables and anchors that are no vectors give none.
    """
    spark = vectors.sparkSession
    sc = spark.sparkContext
    dim = max(int(vectors.agg(F.max(F.size("v"))).first()[0] or 0), 1)
    books = sc.broadcast(fit_books(vectors, dim))
    pages = materialise(vectors.select("id", "label", "v").mapInArrow(_encoder(books, dim), _PAGE_SQL))
    chosen = materialise(anchors.groupBy("id").agg(F.min(F.struct("label", "v")).alias("row")).select("id", "row.label", "row.v"))
    blocks = -(-chosen.count() // ANCHOR_BLOCK)
    path, told = scratch(spark), None
    for b in range(blocks):
        part = sorted(chosen.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)) == b).collect(), key=lambda r: r["id"])
        if not part:
            continue
        ids, labels, rows = np.array([r["id"] for r in part], np.int64), np.array([r["label"] for r in part], np.int64), _matrix([r["v"] for r in part], dim)
        first = sc.broadcast((ids, labels, rows))
        near = checkpoint(_first(pages.mapInArrow(_positives(first, books, dim, positives), _FOUND_SQL), positives, "anchor_id").select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
        scores: dict[int, list[int]] = {}
        for r in near.select("anchor_id", "positive_score").distinct().collect():  # at most `positives` for each anchor of the block
            scores.setdefault(r["anchor_id"], []).append(r["positive_score"])
        spans = [windows_of(scores.get(i, []), low, high) for i in ids.tolist()]
        spans = [s + [(0, _HIGHEST, _LOWEST)] * (positives - len(s)) for s in spans]
        centres, lows, highs = (np.array([[w[k] for w in s] for s in spans], np.int64).reshape(len(ids), positives) for k in range(3))
        second = sc.broadcast((ids, labels, rows, centres, lows, highs))
        far = _first(pages.mapInArrow(_negatives(second, books, dim, negatives), _FOUND_SQL), negatives, "anchor_id", "positive_score")
        # A block's negatives are few: at most `positives` times `negatives` for each of its anchors.
        block = near.join(F.broadcast(far), ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        block.write.parquet(f"{path}/block-{b}")
        told = block.schema
        first.destroy()
        second.destroy()
    books.destroy()
    if told is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return spark.read.schema(told).option("recursiveFileLookup", "true").parquet(path)
