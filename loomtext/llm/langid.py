"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import binary, fold, lean, plain_names, runs

#: Hashed features, n-gram lengths, and how many labelled rows of a language are expected in the training sample at most.
FEATURES, LENGTHS, ROWS_PER_LANG = 1 << 16, (1, 2, 3), 3000
#: Languages at most: each takes 256 KB of the matrix that is broadcast.
MOST_LANGS = 1000
UNKNOWN = "und"


def _grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the lower-cased texts and the index of each one's text. No gram spans two texts."""
    low = [t.decode("utf-8", "replace").lower() if t else "" for t in texts]
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    chars = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(low), dtype=np.int32), sizes)
    feats, owners = [], []
    mixed = chars * np.uint32(0x9E3779B1)
    rolled = mixed
    for n in range(1, max(LENGTHS) + 1):
        if n > 1:
            if len(chars) < n:
                break
            rolled = (rolled[:-1] * np.uint32(0x85EBCA6B)) ^ mixed[n - 1 :]
        if n in LENGTHS:
            same = owner[: len(owner) - n + 1] == owner[n - 1 :]
            h = rolled * np.uint32(0xC2B2AE35) + np.uint32(n)
            feats.append(((h >> np.uint32(32 - int(math.log2(FEATURES)))))[same])
            owners.append(owner[: len(owner) - n + 1][same])
    if not feats:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32)
    return np.concatenate(feats), np.concatenate(owners)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feature counts of each language, one row for each feature seen by the task."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column(1).to_pylist(), binary(batch, "text")
        for a, b in runs(texts):
            feats, owner = _grams(texts[a:b])
            codes = {k: i for i, k in enumerate(dict.fromkeys(langs[a:b]))}
            which = np.array([codes[k] for k in langs[a:b]])[owner]
            for k, i in codes.items():
                counts[k] = counts.get(k, 0) + np.bincount(feats[which == i], minlength=FEATURES)
    for k, c in counts.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], ["lang", "feature", "n"])


def train(labelled: DataFrame, rows_per_lang: int = ROWS_PER_LANG) -> tuple[list[str], np.ndarray]:
    """Fits the classifier on rows of doc_id, lang and text: the languages in order, and a (features, languages) matrix of log probabilities.

    It is fitted on a sample bounded by a documented parameter: of each language, by a hash of doc_id, rows_per_lang rows
    in expectation. Counts are summed by task, then by language and feature; at most languages x 65,536 numbers reach the
    driver, and more than MOST_LANGS languages are an error. Rows with a null text or language teach nothing. No rows at all:
    no languages, and every text is "und".
    """
    rows = lean(labelled).filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGS + 1).collect()}
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages: their matrix would not fit the broadcast")
    if not sizes:
        return [], np.zeros((FEATURES, 0), np.float32)
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, rows_per_lang / n)))])[F.col("lang")]
    u = F.pmod(F.xxhash64(F.lit("langid"), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.filter(u < share).select("doc_id", "lang", F.col("text").cast("binary").alias("text"))
    got = sample.mapInArrow(_count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(sizes)
    table = np.full((FEATURES, len(langs)), 0.5)
    at = {k: i for i, k in enumerate(langs)}
    table[got["feature"].to_numpy(), [at[k] for k in got["lang"].to_pylist()]] += got["n"].to_numpy()
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32)


def _scorer(langs: list[str], table):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp = table.value
        for batch in batches:
            texts = binary(batch, "text")
            best, sure = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for a, b in runs(texts) if langs else ():
                feats, owner = _grams(texts[a:b])
                sums = np.stack([np.bincount(owner, logp[:, k].take(feats), minlength=b - a) for k in range(len(langs))], axis=1)
                top = sums.argmax(axis=1)
                p = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
                for i in range(a, b):
                    if texts[i] and any(map(str.isalpha, texts[i].decode("utf-8", "replace"))):
                        best[i], sure[i] = langs[top[i - a]], p[i - a]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(sure, pa.float64())], ["key", "lang_pred", "score"])

    return score


def predict(docs: DataFrame, key: str, text: str, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """key (as it is), lang_pred and score (the posterior of the best language under even priors) for every whole text.

    A null text or one without a letter is "und" with score 0. Ties go to the first language by code point.
    """
    langs, table = model
    shared = lean(docs).sparkSession.sparkContext.broadcast(table)  # languages x 256 KB
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).mapInArrow(_scorer(langs, shared), f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, 5) == 0


def identify(docs: DataFrame) -> DataFrame:
    """Fits on the rows of docs that are not held out (crc32 of the id modulo 5 is not 0) and predicts the language of every row.

    A null doc_id counts as the empty text in the fold. Rows that repeat an id are each learned from and predicted for itself;
    a null or empty text, or one without a letter, is "und" with score 0; texts of any length are read whole; an empty table
    gives an empty result; columns but doc_id, text and lang play no part.
    Returns doc_id, held_out, lang_pred, score.
    """
    learned = train(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs, "doc_id", "text", learned).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def _keeper(langs: list[str], table, least: float, position: int):
    score = _scorer(langs, table)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for got in score([pa.RecordBatch.from_arrays([batch.column(position), batch.column(position).cast(pa.binary())], ["key", "text"])]):
                sure = got.column(2).to_numpy()
                yield batch.filter(pa.array([k != UNKNOWN and s >= least for k, s in zip(got.column(1).to_pylist(), sure)], pa.bool_()))

    return keep


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs, columns unchanged, whose language is told: not "und", and the best language's posterior at least `least`.

    Null and empty texts and those without a letter go; rows that repeat an id are judged each for itself; names of other
    columns may be any; an empty table stays empty.
    """
    langs, table = train(docs.filter(~held_out(F.col("doc_id"))))
    shared = docs.sparkSession.sparkContext.broadcast(table)
    plain = plain_names(docs)
    return plain.mapInArrow(_keeper(langs, shared, least, docs.columns.index("text")), plain.schema).toDF(*docs.columns)
