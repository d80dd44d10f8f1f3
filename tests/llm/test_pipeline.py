"""The pipeline on a small fixture with odd rows: every stage's rows against a brute-force version."""

import math
import random
import struct
import zlib
from collections import Counter

import corpus_pipeline
import xxhash
from test_documents import brute_components, brute_targets, edits, tokens

from loomtext.llm import langid

ITEMS = [(1, "The quick brown fox jumps over the lazy dog while seventeen zebras quietly watch from a hill."), (2, "Another passage of some length that must never be leaked into any of these documents at all."), (3, None)]
VOWELS = {"en": ("ea", "ou", "th"), "de": ("sch", "ei", "ung"), "fr": ("eau", "é", "que")}


def fixture():
    rnd = random.Random(11)
    rows = []
    for d in range(90):
        lang = ("en", "de", "fr")[d % 3]
        words = [rnd.choice("bcdfglmnprst") + rnd.choice(VOWELS[lang]) + rnd.choice("aeiou") + rnd.choice(VOWELS[lang]) for _ in range(20 + rnd.randrange(60))]
        rows.append([d, " ".join(words), lang, ("a", "b", "c", None)[d * 7 % 4 if d % 5 else 0]])
    rows[40][1] = rows[10][1]  # a copy
    rows[50][1] = rows[10][1].upper() + " more"  # a near copy
    rows[60][1] += " " + ITEMS[0][1].replace("quick", "quack").replace("zebras", "ZEBRA")  # a leak with edits
    rows[61][1] += "\n\n " + ITEMS[1][1].replace(" ", "\t ")
    rows[62][1] += " " + ITEMS[0][1][:45]  # half an item is no leak
    rows += [[100, None, "en", "a"], [101, "", None, None], [102, " \t\n", "fr", "b"], [103, "1234 !!", "de", "c"], [104, rows[3][1][::-1], None, "b"], [None, rows[5][1] + " tail of its own", "fr", "c"], [10, rows[10][1], "de", "a"]]
    return [(*r, len(r[1] or "")) for r in rows]


def brute_grams(text):
    """Hashed n-grams, one code point after the other."""
    chars = [ord(c) * 0x9E3779B1 & 0xFFFFFFFF for c in text.lower()]
    for n in (1, 2, 3):
        for i in range(len(chars) - n + 1):
            h = chars[i]
            for x in chars[i + 1 : i + n]:
                h = (h * 0x85EBCA6B & 0xFFFFFFFF) ^ x
            yield ((h * 0xC2B2AE35 + n) & 0xFFFFFFFF) >> 16


def brute_predictions(rows):
    """lang and posterior of each row, or "und"."""
    counts = {}
    for d, text, lang, *_ in rows:
        if lang is not None and text is not None and zlib.crc32(("" if d is None else str(d)).encode()) % 5:
            counts.setdefault(lang, Counter()).update(brute_grams(text))
    sums = {k: sum(c.values()) + 0.5 * 65536 for k, c in counts.items()}
    out = []
    for r in rows:
        best = ("und", 0.0)
        if r[1] and any(map(str.isalpha, r[1])):
            grams = list(brute_grams(r[1]))
            logs = {k: sum(math.log((c[g] + 0.5) / sums[k]) for g in grams) for k, c in sorted(counts.items())}
            top = max(logs, key=logs.get)
            best = (top, 1 / sum(math.exp(x - logs[top]) for x in logs.values()))
        out.append(best)
    return out


def brute_language(rows):
    return [r for r, (lang, sure) in zip(rows, brute_predictions(rows)) if lang != "und" and sure >= 0.5]


def test_languages_equal_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars int, score int, key string").repartition(3)
    got = langid.identify(df).collect()
    want = [(-1 if r[0] is None else r[0], zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 0, k, round(p, 3)) for r, (k, p) in zip(rows, brute_predictions(rows))]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.lang_pred, round(r.score, 3)) for r in got) == sorted(want)


def brute_dedup(rows):
    known = brute_components([r[:2] for r in rows if r[0] is not None], 80)
    kept, seen = [], set()
    for r in sorted(rows, key=lambda r: (r[1], str(r[2:]))):  # one row of an id
        if r[0] is None or known[r[0]][1] == r[0] and r[0] not in seen:
            seen.add(r[0])
            kept.append(r)
    return kept


def brute_decontamination(rows):
    fold = lambda t: " ".join(t.lower().split())
    items = [fold(t) for _, t in ITEMS if t]
    return [r for r in rows if not any(edits(p, fold(r[1])) <= int(0.08 * len(p)) for p in items)]


def brute_mixing(rows):
    def weight(size):
        return 2 ** (math.floor(math.log2(size + 1) * 8) / 16)

    def scale(sizes, rest):
        """By bisection, not by running sums."""
        low, high = 0.0, 1e9
        for _ in range(200):
            c = (low + high) / 2
            low, high = (c, high) if sum(k * min(1, c * weight(k)) for k in sizes) < rest else (low, c)
        return low

    def rank(d, size, text, c):
        h = xxhash.xxh64_intdigest(struct.pack("<i", 7), 42)
        for x in (d, size):
            h = h if x is None else xxhash.xxh64_intdigest(struct.pack("<q", x), h)
        mark = struct.pack("<Q", xxhash.xxh64_intdigest(text.encode(), 42))
        u = (xxhash.xxh64_intdigest(mark, h) % 2**52 + 0.5) / 2**52
        p = min(1, c * weight(size))
        return -1e9 if p > 1 - 1e-9 else 1e9 if p < 1e-12 else math.log(u / (1 - u)) - math.log(p / (1 - p))

    size = [len(tokens(r[1])) for r in rows]
    total = Counter()
    for r, k in zip(rows, size):
        total[r[3]] += k
    out = []
    for s, target in brute_targets(total).items():
        whole = int(target // total[s])
        c = scale([k for r, k in zip(rows, size) if r[3] == s], target - whole * total[s])
        mine = sorted(((rank(r[0], k, r[1], c), -(2**63) if r[0] is None else r[0]), k, r) for r, k in zip(rows, size) if r[3] == s)
        run, left, taken = 0, target - whole * total[s], 0
        for i, (_, k, _) in enumerate(mine, 1):
            run += k
            if left > 0 and run - k / 2 <= left:
                taken = i
        swap = None
        if left > 0:  # the document whose entering or leaving is nearest, of equals the nearest to the cut
            bin_of = lambda x: math.floor(max(-64, min(64, x)) * 2048)
            edge = next(x for i, ((x, _), _, _) in enumerate(mine) if sum(k for _, k, _ in mine[: i + 1]) >= left)
            last = mine[taken - 1][0][0] if taken and bin_of(mine[taken - 1][0][0]) == bin_of(edge) else bin_of(edge) / 2048
            gap = left - sum(k for _, k, _ in mine[:taken])
            choices = [(abs(gap - (-k if i < taken else k)), abs(x - last), x, d, i) for i, ((x, d), k, _) in enumerate(mine) if k and abs(x) < 1e9]
            near = [c for c in choices if c[0] < abs(gap)]
            swap = min(near)[-1] if near else None
        out += [r for i, (_, _, r) in enumerate(mine) for _ in range(whole + (i < taken) * (i != swap) + (i >= taken) * (i == swap))]
    return out


def brute_sharding(rows):
    sized = sorted((-1 if r[0] is None else r[0], zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 1) for r in rows)
    total, at, slots, out = sum(x[2] for x in sized), 0, Counter(), []
    for d, crc, size in sized:
        k = min(7, at * 8 // total)
        out.append((d, size, crc, k, slots[k]))
        slots[k] += 1
        at += size
    return out


def test_every_stage_equals_brute_force(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    rows = fixture()
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    brutes = [brute_language, brute_dedup, brute_decontamination, brute_mixing]
    order = lambda found: sorted(map(tuple, found), key=repr)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for (name, stage), brute in zip(corpus_pipeline.STAGES, brutes):
        rows, before = brute(rows), rows
        docs = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)))
        assert order(docs.collect()) == order(rows), name
        assert 0 < len(rows) != len(before), name  # the stage had something to do
    last = lambda df: sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in df.collect())
    want = sorted(brute_sharding(rows))
    assert last(corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path))) == want
    assert last(corpus_pipeline.run(spark, str(tmp_path))) == want
    assert len(corpus_pipeline.STAGES) == 5 and {r[0] for r in rows} >= {None} and not {r[0] for r in rows} & {40, 50, 60, 61, 100, 101, 102, 103}


def test_the_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "shard", "slot"} <= set(out.columns)


def test_the_pipeline_keeps_more_columns_and_long_texts(spark, tmp_path):
    """Columns whose names the operators use themselves, a very long text, and an id on several rows."""
    rnd = random.Random(5)
    rows = [(d, " ".join("the " + "".join(rnd.choice("aeioustr") for _ in range(5)) for _ in range(60_000 if d == 3 else 40)), "en", "s", 1, d, "k", d % 2) for d in [*range(30), 7]]
    schema = "doc_id long, text string, lang string, source string, n_chars int, size long, key string, copies int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "never to be found anywhere at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)))
        assert docs.columns == [c.split()[0] for c in schema.split(", ")], name
    assert 3 in {r.doc_id for r in docs.select("doc_id").collect()} and corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).count() == docs.count()
