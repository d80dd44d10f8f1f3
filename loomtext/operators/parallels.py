"""Parallels of a small set of source texts in a large corpus: by contained tokens, and by shared word n-grams."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomtext.functions.text import chrf, with_grams, words
from loomtext.sources.scratch import written

#: Texts that are searched for are collected and broadcast in blocks of about so many bytes.
BLOCK_BYTES = 4 << 20
#: Grams of the small side that are broadcast, at most; more are joined by a shuffle.
MOST_GRAMS = 1_000_000
#: Characters of a parallel's text that are shown.
SHOWN = 60
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _matcher(shared, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One pass over each text finds all tokens that it contains; a task keeps the n best texts of each source."""
        tokens, sources = shared.value
        find = ahocorasick.Automaton()
        for k, t in enumerate(tokens):
            find.add_word(t, k)
        if tokens:
            find.make_automaton()
        best: dict[int, list[tuple[int, int]]] = {}
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text or not tokens:
                    continue
                hits: dict[int, int] = {}
                for k in {k for _, k in find.iter(text.lower())}:
                    for s in sources[k]:
                        hits[s] = hits.get(s, 0) + 1
                for s, c in hits.items():
                    top = best.setdefault(s, [])
                    if len(top) < n:
                        heapq.heappush(top, (c, -key))
                    elif (c, -key) > top[0]:
                        heapq.heapreplace(top, (c, -key))
        rows = [(s, -key, c) for s, top in best.items() for c, key in top]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["source_id", "other_id", "overlap"])

    return run


def _blocks(df: DataFrame, text: str) -> int:
    total = df.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 16)).first()[0] or 0
    return max(1, -(-total // BLOCK_BYTES))


def containment_parallels(sources: DataFrame, source_id: str, source: str, corpus: DataFrame, other_id: str, other: str, n: int = 3) -> DataFrame:
    """For each source the n texts that contain most of its distinct lower-cased tokens of four characters or more, as substrings.

    Only sources are collected, in blocks of BLOCK_BYTES; the corpus is scanned once for each block and never shuffled. Equal
    counts go to the smaller other_id; texts without any of the tokens are no parallels. Ids are integers.
    """
    spark = corpus.sparkSession
    blocks = _blocks(sources, source)
    out = None
    for b in range(blocks):
        part = sources.filter(F.pmod(F.xxhash64(source_id), F.lit(blocks)) == b).select(source_id, source).collect()
        owners: dict[str, list[int]] = {}
        for r in part:
            for t in {t for t in re.split(r"\s+", (r[source] or "").lower()) if len(t) >= 4}:
                owners.setdefault(t, []).append(r[source_id])
        shared = spark.sparkContext.broadcast((list(owners), list(owners.values())))
        found = corpus.filter(F.col(other_id).isNotNull()).select(F.col(other_id).cast("long"), F.col(other).cast("string")).mapInArrow(_matcher(shared, n), "source_id long, other_id long, overlap long")
        if blocks > 1:  # a block's best are written, and the block is let go before the next is collected
            found = written(found)
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("overlap"), "other_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= n)


def with_texts(parallels: DataFrame, corpus: DataFrame, other_id: str, other: str, lang: str, most: int = SHOWN) -> DataFrame:
    """parallels with lang and text, the first characters, of what they found: joined by id to the few that were found."""
    found = corpus.select(F.col(other_id).cast("long").alias("other_id"), F.col(lang).alias("lang"), F.substring(other, 1, most).alias("text"))
    return parallels.join(found, "other_id", "left").select(*parallels.columns, "lang", "text")


def triangulate(parallels: DataFrame, sources: DataFrame, source_id: str) -> DataFrame:
    """For each source whether it has parallels, how many of the best, and these in order (other_id, and lang and text where given)."""
    told = [c for c in ("other_id", "overlap", "lang", "text") if c in parallels.columns]
    listed = F.array_sort(F.collect_list(F.struct("rank", *told))).alias("parallels")  # as many as were looked for
    counts = parallels.groupBy(F.col("source_id").alias(source_id)).agg(F.count("*").alias("n_parallels"), listed)
    return sources.select(source_id).join(counts, source_id, "left").select(source_id, F.coalesce("n_parallels", F.lit(0)).cast("long").alias("n_parallels"), F.col("n_parallels").isNotNull().alias("available"), "parallels")


def crosslingual(candidates: DataFrame, key: str, candidate: str, parallels: DataFrame) -> DataFrame:
    """key, crosslingual and n_parallels: the mean chrF of a candidate with the texts of its parallels (source_id, text), to three places.

    Texts that are null or empty are counted as parallels but not compared; without any to compare, the value is null.
    """
    both = candidates.select(F.col(key).alias("source_id"), F.col(candidate).alias("_c")).join(parallels.select("source_id", F.col("text").alias("_t")), "source_id", "left")
    both = with_grams(with_grams(both, "_t", "_g"), "_c", "_h").withColumn("_x", F.when(F.coalesce("_t", F.lit("")) != "", chrf("_g", "_h")))
    listed = parallels.groupBy("source_id").agg(F.count("*").alias("n"))
    out = both.groupBy("source_id").agg(F.round(F.avg("_x"), 3).alias("crosslingual")).join(listed, "source_id", "left")
    return out.select(F.col("source_id").alias(key), "crosslingual", F.coalesce("n", F.lit(0)).cast("long").alias("n_parallels"))


def word_grams(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """key and each n-gram of lower-cased words, as often as it occurs. Longer grams are made from shorter ones, each by one word
    more; lists are bound as lambdas' variables, so that each is made once for a text."""

    def grown(w: Column, grams: Column, k: int) -> Column:
        if k == n:
            return grams
        left = F.greatest(F.size(grams) - 1, F.lit(0))
        longer = F.zip_with(F.slice(grams, F.lit(1), left), F.slice(w, F.lit(k + 1), left), lambda a, b: F.concat_ws(" ", a, b))
        return F.get(F.transform(F.array(longer), lambda x: grown(w, x, k + 1)), F.lit(0))

    made = F.get(F.transform(F.array(words(F.lower(F.col(text)))), lambda w: grown(w, w, 1)), F.lit(0))
    return df.select(F.col(key), F.explode(made).alias("gram"))


def _hashes(lists: pa.ListArray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all n words in a row: a 64-bit hash, the list that they are in, and the place of the first among all words."""
    flat = lists.flatten()
    coded = flat.dictionary_encode() if len(flat) else pa.array([""]).dictionary_encode()[:0]
    of = np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest()) for w in coded.dictionary.to_pylist()] or [0], np.uint64)
    h = of[coded.indices.to_numpy(zero_copy_only=False)]
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    last = max(len(h) - n + 1, 0)
    out = np.zeros(last, np.uint64)
    for k in range(n):
        out = (out ^ (out >> np.uint64(29))) * _MIX + h[k : k + last]
    place = np.flatnonzero(owner[:last] == owner[n - 1 :][:last])
    return out[place], owner[place], place


def _hash_all(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_hashes(batch.column(0), n)[0]).view(np.int64))], ["h"])

    return run


def _prober(shared, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            keys, lists = batch.column(0), batch.column(1)
            h, owner, place = _hashes(lists, n)
            at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            hit = known[at] == h if len(known) else np.zeros(len(h), bool)
            flat = lists.flatten()
            words_ = [flat.take(pa.array(place[hit] + k)).to_pylist() for k in range(n)]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(owner[hit])), pa.array([" ".join(g) for g in zip(*words_)], pa.string())], ["key", "gram"])

    return run


def _probed(corpus: DataFrame, key: str, text: str, small: DataFrame, small_text: str, n: int) -> DataFrame:
    """key and gram of the corpus' n-grams whose hash a gram of the small side has: what is met exactly afterwards, and little more."""
    known = small.select(words(F.lower(F.col(small_text))).alias("_w")).mapInArrow(_hash_all(n), "h long").distinct().toArrow()
    shared = corpus.sparkSession.sparkContext.broadcast(np.sort(known.column(0).to_numpy().view(np.uint64)))
    kind = corpus.schema[key].dataType.simpleString()
    rows = corpus.select(F.col(key).alias("key"), words(F.lower(F.col(text))).alias("_w"))
    return rows.mapInArrow(_prober(shared, n), f"key {kind}, gram string").withColumnRenamed("key", key)


def shared_grams(small: DataFrame, small_key: str, small_text: str, corpus: DataFrame, key: str, text: str, n: int = 3, top: int = 3) -> DataFrame:
    """For each small text the `top` corpus texts that share most distinct word n-grams: an equi-join on the gram, then counts.

    The small side's grams are counted. Up to MOST_GRAMS their hashes, 8 bytes each, are broadcast and the corpus is probed batch
    by batch, so that only grams that match are ever written out as text and moved; beyond, all grams are joined by a shuffle.
    """
    a = word_grams(small, small_key, small_text, n).distinct()
    few = a.limit(MOST_GRAMS + 1).count() <= MOST_GRAMS
    met = _probed(corpus, key, text, small, small_text, n).join(F.broadcast(a), "gram") if few else word_grams(corpus, key, text, n).distinct().join(a, "gram")
    counts = met.groupBy(small_key, key).agg(F.count_distinct("gram").alias("n_shared"))
    rank = F.row_number().over(Window.partitionBy(small_key).orderBy(F.desc("n_shared"), key))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= top)


def _last_contained(shared, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each text the last of the entries that it contains, by one pass of an automaton."""
        entries, always = shared.value
        find = ahocorasick.Automaton()
        for word, order in entries.items():
            find.add_word(word, (order, word))
        if entries:
            find.make_automaton()
        for batch in batches:
            best = []
            for text in batch.column(1).to_pylist():
                found = [(always, "")] if text is not None and always is not None else []
                if text and entries:
                    found += [entry for _, entry in find.iter(text)]
                best.append(max(found, default=(None, None)))
            out = pa.RecordBatch.from_arrays([batch.column(0).cast(kind), pa.array([o for o, _ in best], pa.int64()), pa.array([s for _, s in best], pa.string())], ["key", "_ord", "_s"])
            yield out.filter(pa.array([o is not None for o, _ in best], pa.bool_()))

    return run


def attach_references(passages: DataFrame, key: str, source: str, refs: DataFrame, ref_source: str, references: str, order: str, old: str | None = None) -> DataFrame:
    """Each passage with the references of the last entry, by the integer `order`, whose source is, or is contained in, the passage's; its old ones if there is none. Of equal orders the larger source is the last.

    Entries are collected in blocks of BLOCK_BYTES; for each block an automaton finds all that a passage contains in one pass
    over it, and only the best order leaves the task. Passages are never compared with entries one by one.
    """
    spark = passages.sparkSession
    refs = refs.filter((F.size(references) > 0) & F.col(ref_source).isNotNull()).select(F.col(ref_source).alias("_s"), F.col(references).alias("_refs"), F.col(order).cast("long").alias("_ord"))
    sql, kind = passages.schema[key].dataType.simpleString(), to_arrow_type(passages.schema[key].dataType)
    blocks, hits = _blocks(refs, "_s"), None
    for b in range(blocks):
        part = refs.filter(F.pmod(F.xxhash64("_s"), F.lit(blocks)) == b).groupBy("_s").agg(F.max("_ord").alias("o")).collect()
        entries = {r["_s"]: r["o"] for r in part if r["_s"]}
        always = next((r["o"] for r in part if not r["_s"]), None)
        shared = spark.sparkContext.broadcast((entries, always))
        found = passages.select(F.col(key).alias("key"), F.col(source).cast("string").alias("text")).mapInArrow(_last_contained(shared, kind), f"key {sql}, _ord long, _s string")
        if blocks > 1:
            found = written(found)
            shared.destroy()
        hits = found if hits is None else hits.unionByName(found)
    last = hits.groupBy(F.col("key").alias(key)).agg(F.max(F.struct("_ord", "_s")).alias("e")).select(key, "e._ord", "e._s")
    chosen = refs.groupBy("_ord", "_s").agg(F.max("_refs").alias("_refs"))
    kept = F.col(old) if old else F.array().cast("array<string>")
    attached = last.join(chosen, ["_ord", "_s"]).select(key, "_refs")
    return passages.join(attached, key, "left").withColumn("references", F.coalesce("_refs", kept)).drop("_refs")
