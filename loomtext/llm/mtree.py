"""Exact top-k by inner product: best-first search of an M-tree of paged nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.common import materialise
from loomtext.sources.scratch import scratch

#: Objects of a subtree and of a leaf page at most; routing objects below one of the level above; sampled objects that give first bounds.
SUBTREE, PAGE, TOP, SEEDS = 4096, 256, 64, 1024
#: Levels of routing objects above the subtrees at most, and routing objects of a level that are collected and broadcast at most.
LEVELS, MOST_PIVOTS = 6, 65_536
#: Queries that are searched for at once: the block that every task holds.
QUERY_BLOCK = 2048
#: Bits before the point of a component at most.
WIDEST = 40
_LOWEST = -(1 << 63)


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """id and v, an array of floor(scale * x); rows with a null id or vector, or with a null or non-finite component, are left out.

    A finite component of 2**WIDEST or more would not keep products and bounds exact: it is an error that names the row's id, not a row less.
    """
    x = F.col(vector_col)
    fine = x.isNotNull() & F.forall(x, lambda e: F.coalesce(~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")), F.lit(False)))
    told = F.concat(F.lit(f"a component of 2**{WIDEST} or more in the vector of "), F.col(id_col).cast("string"))
    whole = lambda e: F.when(F.abs(e.cast("double")) < float(1 << WIDEST), F.floor(e.cast("double") * scale)).otherwise(F.raise_error(told).cast("long"))
    return table.filter(fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(x, whole).alias("v"))


def _matrix(column: list, dim: int) -> np.ndarray:
    """Integer vectors as rows, shorter ones filled up with zeros."""
    out = np.zeros((len(column), dim), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _lift(vectors: np.ndarray, most: float) -> np.ndarray:
    """Adds a coordinate that makes all norms equal, so that larger inner products with a query are smaller Euclidean distances."""
    x = vectors.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(0.0, most - (x * x).sum(axis=1)))])


def _distances(points: np.ndarray, point: np.ndarray) -> np.ndarray:
    d = points - point
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in doubles where those are exact, in 64 bits where those suffice, else in Python's integers."""
    top = max(int(np.abs(a).max(initial=0)), 1) * max(int(np.abs(b).max(initial=0)), 1) * max(a.shape[1], 1)
    if top < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if top < 1 << 63:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    if exact.size and (exact.max() >= 1 << 63 or exact.min() <= _LOWEST):
        raise OverflowError("an inner product does not fit a 64-bit score")
    return exact.astype(np.int64)


def _assigner(pivots: dict[int, tuple[int, np.ndarray]], most: float, dim: int):
    """Deals the rows of the cells that pivots names, each with its first new cell and its routing objects, to the nearest of these."""
    lifted = {cell: (first, _lift(v, most)) for cell, (first, v) in pivots.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, cells = _lift(_matrix(batch.column(1).to_pylist(), dim), most), batch.column(2).to_numpy(zero_copy_only=False).copy()
            for cell in np.unique(cells).tolist():
                if cell in lifted:
                    first, p = lifted[cell]
                    mine = np.flatnonzero(cells == cell)
                    cells[mine] = first + ((p * p).sum(axis=1)[None, :] - 2 * x[mine] @ p.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.int64())], ["id", "v", "cell"])

    return assign


def _pages(x: np.ndarray) -> list[np.ndarray]:
    """Row numbers of leaf pages: halves around two far objects, until a part fits a page."""
    todo, out = [np.arange(len(x))], []
    while todo:
        part = todo.pop()
        if len(part) <= PAGE:
            out.append(part)
            continue
        a = part[_distances(x[part], x[part[0]]).argmax()]
        da = _distances(x[part], x[a])
        lean = da - _distances(x[part], x[part[da.argmax()]])
        order = np.argsort(lean, kind="stable")
        todo += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
    return out


_PAGE_SQL = "tree long, tree_at binary, tree_radius double, page_at binary, page_radius double, page_parent double, ids binary, vectors binary, parents binary"


def _builder(most: float, dim: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        """A subtree: its routing object is the member nearest to the mean; each page's likewise. Radii cover, distances to the parent are kept."""
        ids, v = pdf["id"].to_numpy(np.int64), _matrix(pdf["v"].tolist(), dim)
        x = _lift(v, most)
        centre = x[_distances(x, x.mean(axis=0)).argmin()]
        radius = float(_distances(x, centre).max())
        rows = []
        for part in _pages(x):
            at = x[part][_distances(x[part], x[part].mean(axis=0)).argmin()]
            d = _distances(x[part], at)
            rows.append((int(pdf["tree"].iloc[0]), centre.tobytes(), radius, at.tobytes(), float(d.max()), float(np.sqrt(((at - centre) ** 2).sum())), ids[part].tobytes(), v[part].tobytes(), d.tobytes()))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _PAGE_SQL.split(", ")])

    return build


class _Best:
    """A query's k best so far, by score and then smaller id; `bar` is the score that a candidate must reach."""

    def __init__(self, k: int, bar: int):
        self.k, self.bar, self.scores, self.ids = k, bar, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((i, np.invert(s)))[: self.k]  # the complement falls as the score rises, without overflow
        self.scores, self.ids = s[order], i[order]
        if len(order) == self.k:
            self.bar = max(self.bar, int(self.scores[-1]))


def _searcher(shared, most: float, dim: int, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Best-first through the pages of each subtree. With a routing object's distance to its parent p and radius r, nothing
        below it is nearer to the query than |d(query, parent) - p| - r, which is known before d(query, object) is computed.
        Each query goes to its pages in the order of that bound, until none can hold a better candidate; queries whose turn
        comes to the same page are taken together."""
        qids, q, bars = shared.value
        lifted = np.column_stack([q.astype(np.float64), np.zeros(len(q))])
        far = (lifted * lifted).sum(axis=1) + most
        best, bar, reach = [_Best(k, int(b)) for b in bars], bars.copy(), np.empty(len(qids))

        def extend(at: np.ndarray) -> None:  # the distance of a candidate that just reaches the bar, with room for rounding
            near = np.sqrt(np.maximum(0.0, far[at] - 2 * bar[at].astype(np.float64)))
            reach[at] = np.where(bar[at] == _LOWEST, np.inf, near * (1 + 1e-9) + 1e-7 * np.sqrt(far[at]) + 1e-6)

        extend(np.arange(len(qids)))

        def page(p: tuple, some: np.ndarray) -> None:
            _, _, at, cover, _, ids, vectors, to_page = p
            d = _distances(lifted[some], at)
            some, d = some[d - cover <= reach[some]], d[d - cover <= reach[some]]
            near = np.abs(d[:, None] - to_page[None, :]) <= reach[some][:, None]
            columns = np.flatnonzero(near.any(axis=0))
            if not len(columns):
                return
            scores, ids = _products(q[some], vectors[columns]), ids[columns]
            good = near[:, columns] & (scores >= bar[some][:, None]) & (ids[None, :] != qids[some][:, None])
            for row in np.flatnonzero(good.any(axis=1)).tolist():
                n = some[row]
                best[n].add(scores[row, good[row]], ids[good[row]])
                bar[n] = best[n].bar
            extend(some)

        def subtree(pages: list[tuple]) -> None:
            from_root = _distances(lifted, pages[0][0])
            some = np.flatnonzero(from_root - pages[0][1] <= reach)
            covers, parents = np.array([p[3] for p in pages]), np.array([p[4] for p in pages])
            bounds = np.maximum(0.0, np.abs(from_root[some, None] - parents[None, :]) - covers[None, :])
            order = np.argsort(bounds, axis=1, kind="stable")
            for turn in range(len(pages)):
                at = order[:, turn]
                live = bounds[np.arange(len(some)), at] <= reach[some]
                some, bounds, order, at = some[live], bounds[live], order[live], at[live]
                for j in np.unique(at).tolist():
                    page(pages[j], some[at == j])

        pages, tree = [], None
        for batch in batches:
            for r in batch.to_pylist():
                if r["tree"] != tree and pages:
                    subtree(pages)
                    pages = []
                tree = r["tree"]
                pages.append((np.frombuffer(r["tree_at"]), r["tree_radius"], np.frombuffer(r["page_at"]), r["page_radius"], r["page_parent"], np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"], np.int64).reshape(-1, dim), np.frombuffer(r["parents"])))
        if pages:
            subtree(pages)
        sizes = [len(b.ids) for b in best]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, sizes)), pa.array(np.concatenate([b.ids for b in best])), pa.array(np.concatenate([b.scores for b in best]))], ["query_id", "vec_id", "score"])

    return search


def _cells(vectors: DataFrame, n: int, most: float, dim: int) -> tuple[DataFrame, dict[int, int]]:
    """Rows with the cell of their nearest routing object, and the sizes of cells that are still larger than a subtree.

    A crowded cell gets routing objects of its own, sampled from its members, level by level, so that every cell is a ball of
    near objects. A cell that they don't part (equal vectors) is left, and so are all once a level would need more than
    MOST_PIVOTS routing objects.
    """
    placed, settled = vectors.select("id", "v", F.lit(0).cast("long").alias("cell")), []
    crowded, flat, first = {0: n} if n > SUBTREE else {}, {}, 1
    for level in range(LEVELS):
        wanted = {c: min(TOP, -(-size // (SUBTREE // 2))) for c, size in crowded.items()}
        if not wanted or sum(wanted.values()) > MOST_PIVOTS:
            break
        shares = F.broadcast(vectors.sparkSession.createDataFrame([(c, wanted[c] / crowded[c]) for c in wanted], "cell long, share double"))
        u = F.pmod(F.xxhash64(F.lit(level), "id", F.to_json("v")), F.lit(1 << 30)) / float(1 << 30)
        by_cell: dict[int, list] = {}
        for r in placed.join(shares, "cell").filter(u < F.col("share")).select("cell", "v").distinct().collect():
            by_cell.setdefault(r["cell"], []).append(r["v"])
        pivots: dict[int, tuple[int, np.ndarray]] = {}
        for c in sorted(by_cell):
            pivots[c] = (first, _matrix(sorted(by_cell[c]), dim))
            first += len(by_cell[c])
        settled.append(placed.join(shares, "cell", "left_anti"))  # only crowded cells are written again
        placed = materialise(placed.join(shares, "cell", "left_semi").select("id", "v", "cell").mapInArrow(_assigner(pivots, most, dim), "id long, v array<long>, cell long"))
        sizes = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > SUBTREE).collect()}
        parent = {f + k: c for c, (f, v) in pivots.items() for k in range(len(v))}
        flat |= {c: size for c, size in sizes.items() if size == crowded[parent.get(c, c)]}  # nothing left the cell
        crowded = {c: size for c, size in sizes.items() if c not in flat}
    for part in settled:
        placed = placed.unionByName(part)
    return placed, crowded | flat


def build(vectors: DataFrame) -> tuple[DataFrame, float, int, np.ndarray]:
    """The pages of an M-tree over id, v: written as a table; with it the largest squared norm, the dimension, and a sample of rows."""
    n, most, dim = vectors.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))), F.max(F.size("v"))).first()
    most, dim = float(most or 0), max(int(dim or 0), 1)
    u = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)  # SEEDS rows in expectation, whatever the number of tasks
    sample = sorted(vectors.filter(u < SEEDS / max(1, n)).collect(), key=lambda r: (r["id"], r["v"]))
    ids, seeds = np.array([r["id"] for r in sample], np.int64), _matrix([r["v"] for r in sample], dim)
    placed, crowded = _cells(vectors, n, most, dim)
    # What distance does not part is dealt by a hash: equal vectors, mostly.
    extra = vectors.sparkSession.createDataFrame([(c, -(-size // SUBTREE)) for c, size in crowded.items()], "cell long, parts long")
    dealt = placed.join(F.broadcast(extra), "cell", "left") if crowded else placed.withColumn("parts", F.lit(1).cast("long"))
    tree = F.xxhash64("cell", F.pmod(F.xxhash64("id", F.lit(1)), F.coalesce("parts", F.lit(1).cast("long"))))
    pages = dealt.select("id", "v", tree.alias("tree")).groupBy("tree").applyInPandas(_builder(most, dim), _PAGE_SQL)
    return materialise(pages), most, dim, (ids, seeds)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """For each query (id, v) the k largest inner products among all vectors (id, v) but those of its own id.

    Queries, of any number, are taken in blocks of QUERY_BLOCK; a block is broadcast and every task searches the subtrees it
    holds, beginning with the bound that a sample of SEEDS vectors gives; the tasks' k best are merged by query and written, and
    the block is let go before the next one is made, so that neither plans nor memory grow with the queries. Scores are
    exact integers, and one that does not fit 64 bits is an error; ties go to the smaller id. Rows that repeat an id: all are candidates, the first by value is the query.
    Shorter vectors count as filled up with zeros. Returns query_id, rank, vec_id, score.
    """
    spark = vectors.sparkSession
    pages, most, dim, (seed_ids, seeds) = build(vectors)
    queries = materialise(queries.groupBy("id").agg(F.min("v").alias("v")))
    blocks = -(-queries.count() // QUERY_BLOCK)
    path, sql = scratch(spark), "query_id long, vec_id long, score long"
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    for b in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)) == b).collect()
        ids, q = np.array([r["id"] for r in rows], np.int64), _matrix([r["v"] for r in rows], dim)
        if not len(ids):
            continue
        first = np.where(ids[:, None] == seed_ids[None, :], _LOWEST, _products(q, seeds))
        bars = np.sort(first, axis=1)[:, -k] if first.shape[1] >= k else np.full(len(ids), _LOWEST, np.int64)
        shared = spark.sparkContext.broadcast((ids, q, bars))
        found = pages.mapInArrow(_searcher(shared, most, dim, k), sql)
        found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.parquet(f"{path}/block-{b}")
        shared.destroy()
    told = "query_id long, rank int, vec_id long, score long"
    return spark.read.schema(told).option("recursiveFileLookup", "true").parquet(path) if blocks else spark.createDataFrame([], told)
