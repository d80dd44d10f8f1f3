"""Surface metrics and text predicates as column expressions; sets of character grams are made in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Latin letters with diacritics that mark transliterated text.
DIACRITICS = "āīūṛṝḷḹṃñṅśṣṭḍḥ"
SPACE = r"[\s\p{Z}]+"


def words(text: Column) -> Column:
    """Tokens between white space of any kind; none for a null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda t: t != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


#: Bits of a code point, so that up to three fit a 64-bit gram; code points that are sorted at once.
_POINT, _RUN = 21, 1 << 18


def gram_codes(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each text as sorted numbers, one text after another, and how many each text has."""
    lengths = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    last = max(len(points) - n + 1, 0)
    codes = np.zeros(last, np.int64)
    for k in range(n):
        codes = codes << _POINT | points[k : k + last]
    inside = owner[:last] == owner[n - 1 :][:last]
    codes, owner = codes[inside], owner[:last][inside]
    order = np.lexsort((codes, owner))
    codes, owner = codes[order], owner[order]
    fresh = np.ones(len(codes), bool)
    fresh[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
    return codes[fresh], np.bincount(owner[fresh], minlength=len(texts))


def _gram_lists(texts: list[str], n: int) -> pa.Array:
    codes, sizes, start, held = [], [], 0, 0
    for end, t in enumerate(texts, 1):
        held += len(t)
        if end == len(texts) or held >= _RUN:
            c, s = gram_codes(texts[start:end], n)
            codes, sizes, start, held = [*codes, c], [*sizes, s], end, 0
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(codes) if codes else [], pa.int64()))


def with_grams(df: DataFrame, text: str, name: str, longest: int = 3) -> DataFrame:
    """Adds name_1 .. name_n, n up to 3: the sets of character n-grams of a text without its white space, as arrays of 64-bit codes.

    A gram is its code points side by side. Codes are made and sorted for a whole Arrow batch, in runs of bounded size, which
    takes about a hundredth of the time of strings made gram by gram; sets of numbers are then met by generated code.
    """
    kind = "struct<" + ",".join(f"g{n}:array<bigint>" for n in range(1, longest + 1)) + ">"

    @F.arrow_udf(kind)
    def sets(bare: pa.Array) -> pa.Array:
        texts = bare.to_pylist()
        return pa.StructArray.from_arrays([_gram_lists(texts, n) for n in range(1, longest + 1)], [f"g{n}" for n in range(1, longest + 1)])

    df = df.withColumn(f"{name}_s", sets(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, "")))
    for n in range(1, longest + 1):
        df = df.withColumn(f"{name}_{n}", F.col(f"{name}_s.g{n}"))
    return df.drop(f"{name}_s")


def chrf_value(ref: str, cand: str, longest: int = 3) -> Column:
    """Unrounded set-based character n-gram F score of two texts whose gram sets with_grams added; the divisor stays `longest`.

    The sizes of both sets and of what they share are bound as a lambda's variable, so that sets are met once.
    """
    sizes = F.struct(*(c.alias(f"{k}{n}") for n in range(1, longest + 1) for k, c in (("r", F.size(f"{ref}_{n}")), ("c", F.size(f"{cand}_{n}")), ("b", F.size(F.array_intersect(f"{ref}_{n}", f"{cand}_{n}"))))))

    def score(s: Column) -> Column:
        full = lambda n: (s[f"r{n}"] > 0) & (s[f"c{n}"] > 0)
        share = lambda side: sum((F.when(full(n), s[f"b{n}"] / s[f"{side}{n}"]).otherwise(0.0) for n in range(1, longest + 1)), F.lit(0.0))
        precision, recall = share("c"), share("r")
        return F.when((precision > 0) & (recall > 0), 2 * precision * recall / (precision + recall) / longest).otherwise(0.0)

    return F.get(F.transform(F.array(sizes), score), F.lit(0))


def chrf(ref: str, cand: str, longest: int = 3) -> Column:
    return F.round(chrf_value(ref, cand, longest), 4)


def bleu1(ref_words: Column, cand_words: Column) -> Column:
    """Unclipped unigram precision with a brevity penalty; 0 if either side has no token.

    The distinct words of both are met by hash sets once, bound as a lambda's variable; each candidate word is looked up there.
    """
    common = F.array(F.array_intersect(cand_words, ref_words))
    hits = F.get(F.transform(common, lambda both: F.size(F.filter(cand_words, lambda t: F.array_contains(both, t)))), F.lit(0))
    short = F.exp(F.least(F.lit(0.0), 1 - F.size(ref_words) / F.size(cand_words)))
    return F.when((F.size(ref_words) > 0) & (F.size(cand_words) > 0), F.round(short * hits / F.size(cand_words), 4)).otherwise(0.0)


def with_metrics(df: DataFrame, ref: str, cand: str) -> DataFrame:
    """Adds chrf and bleu1 of two text columns."""
    df = with_grams(with_grams(df, ref, "_r"), cand, "_k")
    df = df.withColumn("chrf", chrf("_r", "_k")).withColumn("_rw", words(F.col(ref))).withColumn("_kw", words(F.col(cand)))
    df = df.withColumn("bleu1", bleu1(F.col("_rw"), F.col("_kw")))
    return df.drop(*[f"_{s}_{n}" for s in "rk" for n in (1, 2, 3)], "_rw", "_kw")


def combined(chrf_col: Column, bleu_col: Column, semantic: Column) -> Column:
    """The judge's score where there is one, else the mean of both surface scores."""
    return F.coalesce(semantic, (chrf_col + bleu_col) / 2)


def diacritics(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, DIACRITICS, ""))


def is_junk(text: Column) -> Column:
    """Too short to be a gold text, or still transliterated."""
    t = F.coalesce(text, F.lit(""))
    return (F.length(F.trim(t)) < 8) | (diacritics(t) > 5)


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, rf"^{SPACE}|{SPACE}$", "")


def clean_answer(text: Column) -> Column:
    """Without white space at the ends, then quotation marks, then white space."""
    return strip(F.regexp_replace(strip(text), '^"+|"+$', ""))


def prefix(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def pair_hash(text: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)
