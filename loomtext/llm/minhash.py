"""Near-duplicates: minima of many universal hashes in bands, links confirmed on full shingle sets, star components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.common import binary, forget, gathered, lean, materialise, plain_names, runs, small, words
from loomtext.llm.components import components

#: Words in a shingle; bands and rows: a pair of similarity 0.85 shares no band with probability 8e-8, one of 0.8 with 2e-5.
WIDTH, BANDS, ROWS = 5, 28, 5
#: Members of a bucket that are compared in one task at most; those of larger buckets are dealt by rare shingles, and these groups cut into blocks.
BLOCK = 512
#: Tables of up to so many ids (8 bytes each) are broadcast, longer ones shuffled.
MOST_IDS = 500_000

_MUL = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20240517)
_A = (_RNG.integers(0, 1 << 31, (BANDS * ROWS, 1), dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """Of each text the sorted 64-bit hashes of its distinct shingles; with fewer words than WIDTH, of the whole sequence."""
    tokens = [words(t) for t in texts]
    flat = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in tokens for w in ws), np.uint64, sum(map(len, tokens)))
    out, at = [], 0
    for ws in tokens:
        n = len(ws)
        t, width = flat[at : at + n], min(n, WIDTH)
        at += n
        if not n:
            out.append(t)
            continue
        h = np.full(n - width + 1, width, np.uint64)
        for j in range(width):
            h = h * _MUL + t[j : n - width + 1 + j]
        out.append(np.unique(_mix(h)))
    return out


def _minima(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        v = _A * x[i : i + 1024]
        v += _B
        np.minimum(low, v.min(axis=1), out=low)
    return low


def _keys(low: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of minima."""
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        h = h * _MUL + column
    return _mix(h).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = binary(batch, "text")
        for a, b in runs(texts):
            sets = shingle_sets(texts[a:b])
            marks = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets]
            keys = [_keys(_minima(s)) if len(s) else np.zeros(0, np.int64) for s in sets]
            ends = np.cumsum([0] + [len(k) for k in keys])
            bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), bands], ["doc_id", "n", "d1", "d2", "bands"])


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = binary(batch, "text")
        for a, b in runs(texts):
            sets = shingle_sets(texts[a:b])
            ends = np.cumsum([0] + [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64), pa.int64()))], ["node", "grams"])


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of a block's sets, as products of incidence matrices over slices of the common shingles."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = counts[inverse] > 1
    owner, inverse = owner[keep], (np.cumsum(counts > 1) - 1)[inverse[keep]]
    order = np.argsort(inverse, kind="stable")
    owner, inverse = owner[order], inverse[order]
    out, width = np.zeros((m, m), np.float64), 4096
    for lo in range(0, int(inverse[-1]) + 1 if len(inverse) else 0, width):
        i, j = np.searchsorted(inverse, [lo, lo + width])
        part = np.zeros((m, width), np.float32)
        part[owner[i:j], inverse[i:j] - lo] = 1
        out += part @ part.T
    return out


def _block_links(percent: int):
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        """A spanning forest of a block's links between different components. A node may have several sets."""
        sets = [np.asarray(x) for x in pdf["grams"]]
        fresh = dict.fromkeys(zip(pdf["node"], (x.tobytes() for x in sets)))
        pdf = pdf.drop_duplicates("node").set_index("node").loc[[node for node, _ in fresh]].reset_index()
        sets = [np.frombuffer(x, np.int64) for _, x in fresh]
        nodes, n = pdf["node"].to_numpy(), np.array([len(x) for x in sets])
        shared = _shared(sets)
        linked = 100 * shared >= percent * (n[:, None] + n[None, :] - shared)
        root = {c: c for c in pdf["comp"]}
        comp, out = pdf["comp"].tolist(), []

        def find(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        for i, j in zip(*np.nonzero(np.triu(linked, 1))):
            a, b = find(comp[i]), find(comp[j])
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((nodes[i], nodes[j]))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return links


def _split(entries: DataFrame) -> DataFrame:
    """key and c of the buckets (key, node, comp) whose members lie in several components; of equal buckets one."""
    rows = entries.groupBy("key").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("node")).alias("x"))
    return rows.filter("c > 1 AND lo <> hi").groupBy("c", "s", "x").agg(F.min("key").alias("key")).select("key", "c")


def _compared(entries: DataFrame, buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components among the members of each bucket, block by block, so that no task has more than two blocks."""
    blocks, mine = F.ceil(F.col("c") / F.lit(float(BLOCK))).cast("long"), F.pmod(F.xxhash64("node"), F.col("g"))
    todo = entries.join(buckets.select("key", blocks.alias("g")), "key").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
    todo = todo.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("block"), "node", "comp").distinct().join(sets, "node")
    return todo.groupBy("block").applyInPandas(_block_links(percent), "u long, v long")


def _rarest(crowd: DataFrame, percent: int) -> DataFrame:
    """key, node and comp: the shingles by which members of crowded buckets (node, comp, grams) can still meet.

    Two sets of n shingles, at most, that are similar enough share one of each other's n - ceil(n * percent / 100) + 1 rarest:
    if these were all missed, too few would be left to share. Rarity is counted among the members, so that what crowds a bucket, text
    that they all have, is looked at last.
    """
    rows = crowd.select("node", "comp", F.xxhash64("grams").alias("mark"), F.size("grams").alias("n"), F.explode("grams").alias("key"))
    often = materialise(rows.groupBy("key").agg(F.count("*").alias("f")).filter("f > 1"))
    order = Window.partitionBy("node", "mark").orderBy(F.coalesce("f", F.lit(1)), "key")
    ranked = rows.join(often, "key", "left").withColumn("rank", F.row_number().over(order))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    return ranked.filter(F.col("f").isNotNull() & (F.col("rank") <= prefix)).select("key", "node", "comp").distinct()


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Groups documents (doc_id, text) whose sets of five-word shingles have a Jaccard similarity of percent / 100 or more.

    Texts with equal sets form a class, whose smallest doc_id stands for it. Classes that share a band's minima meet in a
    bucket. First each bucket's most widely shared member is compared with the others, on full sets, and components are
    found. Buckets whose other members still lie in several components are then compared in full, up to BLOCK members at once,
    and only links that join components are emitted. The members of larger ones, which share a passage but mostly little else, are
    dealt anew by their rarest shingles, one of which any two that are similar enough share; those whose rarest shingles are common
    too are near copies mostly, and are compared in pairs of blocks of their bucket. So no pair of classes in a bucket is left out, unless a chain of links joins it anyway, and no step
    emits all pairs of a group.

    Words are runs of anything but ASCII white space, with A-Z lower-cased. A null or empty text has no shingles and no
    links. Rows that repeat an id form one node, linked by each of its texts; a null id is linked with nothing; an empty table gives an empty result;
    other columns play no part. Returns doc_id, n_shingles, component_id (smallest doc_id that can be reached), kept.
    """
    texts = lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    sketch = materialise(texts.mapInArrow(_sketch, "doc_id long, n long, d1 long, d2 long, bands array<long>"))
    n_docs = sketch.count()
    classes = materialise(gathered(sketch.filter("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.count("*").alias("size")), n_docs))
    n_keys = BANDS * classes.count()
    first = sketch.join(classes, ["d1", "d2"]).filter("doc_id = node")
    entries = materialise(gathered(first.select("node", "n", F.explode("bands").alias("key")).distinct(), n_keys))
    # What is joined to a key is written first, so that adaptive execution can split the rows of a hot one.
    sizes = materialise(gathered(entries.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), n_keys))
    met = materialise(entries.join(sizes, "key"))
    forget(entries, sizes)
    wide = met.groupBy("node").agg(F.sum("c").alias("wide"))
    met = materialise(met.join(wide, "node"))
    leaders = met.groupBy("key").agg(F.max(F.struct("wide", (-F.col("node")).alias("minus"), "n")).alias("l")).select("key", (-F.col("l.minus")).alias("leader"), F.col("l.n").alias("leader_n"))
    leaders = materialise(gathered(leaders, n_keys))
    met = materialise(met.join(leaders, "key").select("key", "node", "n", "leader", "leader_n"))
    fits = f"100 * least(n, leader_n) >= {percent} * greatest(n, leader_n)"
    pairs = met.filter(f"node <> leader AND {fits}").select("leader", "node").distinct()

    wanted = met.select("node").distinct()
    full = texts.withColumnRenamed("doc_id", "node").join(small(wanted, MOST_IDS), "node", "left_semi").mapInArrow(_full, "node long, grams array<long>")
    sets = materialise(full)
    a, b = sets.select(F.col("node").alias("leader"), F.col("grams").alias("x")), sets.withColumnRenamed("grams", "y")
    both = pairs.join(a, "leader").join(b, "node").withColumn("i", F.size(F.array_intersect("x", "y")))
    links = materialise(both.filter(f"100 * i >= {percent} * (size(x) + size(y) - i)").select(F.col("leader").alias("u"), F.col("node").alias("v")))
    label = components(links)

    rest = met.filter("node <> leader").join(label, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    rest = materialise(rest.select("key", "node", "comp"))
    buckets = materialise(gathered(_split(rest), n_keys))
    more = _compared(rest, buckets.filter(F.col("c") <= BLOCK), sets, percent)
    crowd = materialise(gathered(rest.join(buckets.filter(F.col("c") > BLOCK).select("key"), "key", "left_semi").select("node", "comp").distinct(), n_docs))
    if not crowd.isEmpty():
        rare = materialise(_rarest(crowd.join(sets, "node"), percent))
        dealt = materialise(gathered(_split(rare), n_keys))
        more = more.unionByName(_compared(rare, dealt.filter(F.col("c") <= BLOCK), sets, percent))
        alike = materialise(gathered(rare.join(dealt.filter(F.col("c") > BLOCK).select("key"), "key", "left_semi").select("node").distinct(), n_docs))
        if not alike.isEmpty():  # near copies, whose rarest shingles are common too
            close = materialise(rest.join(alike, "node", "left_semi"))
            more = more.unionByName(_compared(close, _split(close), sets, percent))
    more = materialise(more)
    label = components(links.unionByName(more))

    named = sketch.select("doc_id", "n", "d1", "d2").join(classes, ["d1", "d2"], "left").select("doc_id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node"))
    named = named.join(label, "node", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")))
    return named.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row, columns unchanged, for each group of documents: that with the smallest doc_id.

    Of the rows that repeat a kept id the first by text, then by all columns, stays; no others are shuffled for it. A row
    with a null id is linked with nothing and stays.
    """
    names, docs = docs.columns, plain_names(docs, "doc_id", "text")
    gone = materialise(near_duplicates(docs, percent).filter("NOT kept").select("doc_id").distinct())
    left = docs.join(small(gone, MOST_IDS), "doc_id", "left_anti").select(*docs.columns)
    again = materialise(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    if again.isEmpty():
        return left.toDF(*names)
    once = left.join(small(again, MOST_IDS), "doc_id", "left_anti").select(*docs.columns)
    order = Window.partitionBy("doc_id").orderBy("text", F.to_json(F.struct(*docs.columns)))
    first = left.join(small(again, MOST_IDS), "doc_id", "left_semi").withColumn("nth", F.row_number().over(order)).filter("nth = 1")
    return once.unionByName(first.select(*docs.columns)).toDF(*names)
