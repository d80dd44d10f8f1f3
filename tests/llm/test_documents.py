"""Operators on documents: brute force on small tables, and every kind of odd row."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loomtext.llm import chunks, hmm, langid, minhash, mixing, qgram, shards
from loomtext.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, size long, rank int, key string, row long, n long"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30000))
BASE = " ".join(f"alpha{i}" for i in range(60))
ROWS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE.replace("alpha30", "changed"), "en", "b"), (4, None, "en", "b"), (5, "", None, None), (6, "  \t\n ", "fr", "a"),
    (7, "one two three", "fr", "a"), (8, "ONE two  THREE", "fr", None), (9, LONG, "en", "a"), (None, BASE, "en", "c"), (10, "1234 5678 !!", "de", "c"), (11, "naïve café über ñandú", None, "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0, 1, 2, 3, "k", 4, 5) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = tokens(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows, percent):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            inter = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * inter >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_equal_brute_force(docs, percent):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, percent).collect()}
    assert got == brute_components(rows, percent)


def test_near_duplicates_of_odd_rows(odd, empty):
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(odd, 80).collect())
    want = brute_components([(d, t) for d, t, *_ in ROWS if d is not None], 80)
    for d, n, c, kept in got:
        if d >= 0:
            assert (n, c) == want[d] and kept == (c == d)
    assert got[0] == (-1, 56, None, True) and len(got) == len(ROWS)
    assert want[3][1] == 1 and want[8][1] == 7 and want[4] == (0, 4)
    assert minhash.near_duplicates(empty, 80).count() == 0
    assert sorted(r.doc_id or -1 for r in minhash.keep_one(odd).collect()) == [-1, 1, 4, 5, 6, 7, 9, 10, 11]


def test_an_id_with_several_texts_is_linked_by_each(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rnd = np.random.default_rng(8)
    word = lambda: f"w{rnd.integers(0, 10**6)}"
    a, b, c = ([word() for _ in range(120)] for _ in range(3))
    near = lambda x: " ".join([*x[:60], word(), *x[61:]])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (5, " ".join(b)), (2, near(a)), (3, near(b)), (9, near(c)), (9, near(b)), (7, " ".join(c)), *((20 + k, near(a)) for k in range(15)), (50, "far from all others")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 80).collect()}
    assert got == {**dict.fromkeys([2, 3, 5, 7, 9, *range(20, 35)], 2), 50: 50}
    assert sorted(r.doc_id for r in minhash.keep_one(df).collect()) == [2, 50]
    assert [r.text for r in minhash.keep_one(df.filter("doc_id = 5")).collect()] == [min(" ".join(a), " ".join(b))]


@pytest.mark.parametrize("percent", [80, 85])
def test_crowded_buckets_lose_no_link(spark, monkeypatch, percent):
    """Documents that share a long passage but little else meet in one bucket; near copies hide among them."""
    monkeypatch.setattr(minhash, "BLOCK", 6)
    rnd = np.random.default_rng(percent)
    word = lambda: f"w{rnd.integers(0, 10**6)}"
    passage, rows = [word() for _ in range(150)], []
    for k in range(40):
        own = [word() for _ in range(45 + k % 7)]
        rows.append((k, " ".join(passage + own)))
        if k % 3 == 0:
            cut = int(rnd.integers(0, len(own)))
            rows.append((100 + k, " ".join(passage + own[:cut] + [word()] + own[cut:])))
        if k % 5 == 0:
            rows.append((200 + k, " ".join(passage + own[: len(own) // 2] + [word() for _ in range(4)])))
    rows += [(300, " ".join(passage)), (301, " ".join(passage[:140]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()}
    assert got == brute_components(rows, percent)


def test_block_links_span_what_brute_force_links():
    import pandas as pd

    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**62, 140)
    sets = [np.sort(rng.choice(pool, rng.integers(115, 130), replace=False)) for _ in range(40)]
    pdf = pd.DataFrame({"node": range(40), "n": [len(s) for s in sets], "comp": range(40), "grams": sets})
    got = minhash._block_links(80)(pdf)

    def groups(pairs):
        root = list(range(40))
        for _ in range(40):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    pairs = [(i, j) for i in range(40) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    assert groups(got[["u", "v"]].values.tolist()) == groups(pairs) and len(got) < 40


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 140), 100)}


def test_components_of_a_hub(spark):
    rnd = np.random.default_rng(6)
    hub = [(5000, int(x)) for x in rnd.permutation(9000) if x != 5000] + [(int(x), int(x) + 10_000) for x in rnd.integers(0, 9000, 3000)]
    got = components(spark.createDataFrame(hub, "u long, v long").repartition(5)).collect()
    assert len(got) == len({x for e in hub for x in e}) and {r.component for r in got} == {0}


def test_shards_equal_brute_force(docs, odd, empty):
    for df in (docs, odd):
        rows = sorted(((r.doc_id if r.doc_id is not None else -1), zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 1) for r in df.collect())
        total, at, slots, want = sum(r[2] for r in rows), 0, Counter(), []
        for d, crc, size in rows:
            k = min(7, at * 8 // total)
            want.append((d, size, crc, k, slots[k]))
            slots[k] += 1
            at += size
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32, r.shard, r.slot) for r in shards.shard_by_bytes(df, 8).collect())
        assert got == sorted(want)
    assert shards.shard_by_bytes(empty, 8).count() == 0


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix_reaches_targets(docs, odd, empty):
    for df in (docs, odd):
        got = mixing.mix(df).collect()
        sizes = Counter()
        for r in df.collect():
            sizes[r.source] += len(tokens(r.text))
        want, taken, largest = brute_targets(sizes), Counter(), Counter()
        for r in got:
            assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9)
            taken[r.source] += r.taken
            largest[r.source] = max(largest[r.source], r.size)
        assert len(got) == df.count()
        for s in sizes:
            assert abs(taken[s] - want[s]) <= largest[s]
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in mixing.mix(docs).collect()}
    assert mixing.mix(empty).count() == 0
    copies = Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert all(copies[r.doc_id] * r.size == r.taken for r in mixing.mix(docs).collect() if r.size)
    assert mixing.mixed(odd).columns == odd.columns


def test_one_exchange_brings_each_source_nearest(docs, monkeypatch):
    told = mixing.mix(docs).collect()
    exchange = mixing._exchange
    monkeypatch.setattr(mixing, "_exchange", lambda ranked, ends: exchange(ranked, ends).limit(0))
    plain = mixing.mix(docs).collect()
    for s in {r.source for r in plain}:
        mine = [r for r in plain if r.source == s]
        target, taken = mine[0].target, sum(r.taken for r in mine)
        base = math.floor(target / mine[0].source_size)
        gaps = [abs(target - taken - (r.size if r.copies == base else -r.size)) for r in mine if r.size and 0 < r.inclusion < 1]
        assert math.isclose(abs(target - sum(r.taken for r in told if r.source == s)), min([*gaps, abs(target - taken)]), abs_tol=1e-6)
    far = lambda rows: sum(abs(sum(r.taken for r in rows if r.source == s) / t - 1) for s, t in {(r.source, r.target) for r in rows})
    assert far(told) < far(plain) / 2


def test_documents_are_included_as_often_as_wanted(spark):
    rnd = np.random.default_rng(3)
    sizes = rnd.choice([1, 5, 40, 400, 9000], 6000, p=[0.3, 0.3, 0.25, 0.14, 0.01])
    rows = [(i, "w " * int(k), "abc"[i % 3]) for i, k in enumerate(sizes)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=0.6).collect()
    for s in "abc":
        mine = [r for r in got if r.source == s]
        rest = mine[0].target - mine[0].source_size * int(mine[0].target // mine[0].source_size)
        assert math.isclose(sum(r.size * r.inclusion for r in mine), rest, rel_tol=1e-6)
        for k in (1, 5, 40, 400):  # of a size, the share that is taken once more is its probability
            same = [r for r in mine if r.size == k]
            p, base = same[0].inclusion, min(r.copies for r in mine)
            hits = sum(r.copies - base for r in same)
            assert abs(hits - p * len(same)) <= 5 * math.sqrt(max(1, len(same) * p * (1 - p))) + 1, (s, k)
    assert any(r.inclusion == 1 for r in got) and all(r.copies >= 1 for r in got if r.inclusion == 1)


def test_equal_rows_of_one_id_reach_their_targets(spark):
    rows = [(None, "a b c d e f g h i j", s) for s in "xyz" for _ in range(400)] + [(7, "k l m", "x")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, target = Counter(), {}
    for r in mixing.mix(df).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 10 for s in "xyz")
    again = Counter(r.source for r in mixing.mixed(df).collect() for _ in r.text.split())
    assert all(abs(again[s] - target[s]) <= 10 for s in "xyz")


def test_language_id_on_held_out_texts(spark, sf_dir, odd, empty):
    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(got[r.doc_id].held_out for r in held)
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.97
    told = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd).collect()}
    assert told[4] == told[5] == told[6] == told[10] == ("und", 0.0) and all(0 <= s <= 1 for _, s in told.values()) and len(told) == 12
    assert langid.identify(empty).count() == 0
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and {4, 5, 6, 10}.isdisjoint(r.doc_id for r in kept.collect())


def test_grams_equal_a_slow_count():
    feats, owner = langid._grams(["abcab".encode(), None, "é".encode()])
    assert Counter(owner.tolist()) == {0: 12, 2: 1} and len(set(feats[owner == 0].tolist())) <= 9


def naive_log10(model, seq):
    alpha = model.start * model.emit[seq[0]]
    for s in seq[1:]:
        alpha = (alpha @ model.move) * model.emit[s]
    return math.log10(alpha.sum())


def test_forward_recursion_and_counts_are_exact():
    rng = np.random.default_rng(5)
    k = hmm.STATES
    emit, move, start = rng.random((6, k)), rng.random((k, k)), rng.random(k)
    model = hmm.Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    seqs = [rng.integers(0, 6, n) for n in (1, 4, 9, 4)]
    assert np.allclose(hmm.log10_likelihoods(model, seqs), [naive_log10(model, s) for s in seqs])
    a, b, c = np.zeros(k), np.zeros((k, k)), np.zeros((6, k))
    hmm.expected_counts(model, seqs, a, b, c)
    assert math.isclose(a.sum(), 4) and math.isclose(b.sum(), 14) and np.allclose(c.sum(axis=1), np.bincount(np.concatenate(seqs), minlength=6))
    hmm_block, hmm.BLOCK = hmm.BLOCK, 4  # a text beyond a block gives the same in blocks
    try:
        for s in (seqs[2], rng.integers(0, 6, 4), rng.integers(0, 6, 5), rng.integers(0, 6, 33)):
            got, want = [[np.zeros(k), np.zeros((k, k)), np.zeros((6, k))] for _ in range(2)]
            assert math.isclose(hmm.log10_likelihoods(model, [s])[0], naive_log10(model, s))
            fits = hmm.expected_counts(model, [s], *got)
            hmm.BLOCK = 100
            assert math.isclose(fits, hmm.expected_counts(model, [s], *want)) and math.isclose(fits, naive_log10(model, s))
            hmm.BLOCK = 4
            assert all(np.allclose(x, y) for x, y in zip(got, want))
    finally:
        hmm.BLOCK = hmm_block
    h = 1e-6  # the expected use of a move is the slope of the log likelihood in its logarithm
    up = hmm.Hmm(model.start, model.move.copy(), model.emit)
    up.move[1, 2] *= 1 + h
    slope = (hmm.log10_likelihoods(up, seqs).sum() - hmm.log10_likelihoods(model, seqs).sum()) / h * math.log(10)
    assert math.isclose(slope, b[1, 2], rel_tol=1e-3)


def test_hmm_scores(docs, odd, empty):
    rows = docs.collect()
    train = Counter(t for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 != 2 for t in [*tokens(r.text), None])
    total, kinds = sum(train.values()), len(train)
    ours = base = 0.0
    for r in hmm.score_texts(docs).collect():
        text = next(x.text for x in rows if x.doc_id == r.doc_id)
        toks = [*tokens(text), None]
        assert r.n_tokens == len(toks) and r.train_tokens == total and r.n_known == sum(t in train for t in toks)
        assert math.isclose(r.base_score, sum(math.log10((train[t] + 1) / (total + kinds + 1)) for t in toks), rel_tol=1e-9)
        assert r.score < 0
        if r.held_out:
            ours, base = ours + r.score, base + r.base_score
    assert ours > base  # the model tells held-out texts better than the counts alone
    got = hmm.score_texts(odd).collect()
    assert len(got) == len(ROWS) and all(math.isfinite(r.score) for r in got) and {r.n_tokens for r in got if r.doc_id in (4, 5, 6)} == {1}
    assert hmm.score_texts(empty).count() == 0


def brute_score(model, lex, counts, text):
    """The score from its definition: a naive chain of symbols, times each word's share of its class."""
    toks = [*(t.encode() for t in tokens(text)), hmm.END]
    group = lambda w: zlib.crc32(w[-3:]) % hmm.CLASSES
    own = {w for w in lex.ids if lex.ids[w] < lex.head}
    room = Counter()
    for w, c in counts.items():
        if w not in own:
            room[group(w)] += c + 1
    alpha, total = None, 0.0
    for w in toks:
        s = lex.ids[w] if w in own else hmm.HEAD + group(w)
        alpha = (model.start if alpha is None else alpha @ model.move) * model.emit[s]
        total += math.log10(alpha.sum())
        alpha = alpha / alpha.sum()
        if w not in own:
            total += math.log10((counts.get(w, 0) + 1) / (room[group(w)] + 1))
    return total


def test_scores_equal_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(hmm, "KNOWN", 300)
    monkeypatch.setattr(hmm, "HEAD", 120)
    kept = {}
    fit, learn = hmm.fit, hmm.learn_words
    monkeypatch.setattr(hmm, "fit", lambda *a: kept.setdefault("model", fit(*a)))
    monkeypatch.setattr(hmm, "learn_words", lambda t: kept.setdefault("words", learn(t)))
    df = docs.filter("doc_id < 80").unionByName(spark.createDataFrame([(1001, "unseen zzqx " * 40), (1002, None), (None, "one two")], "doc_id long, text string"), allowMissingColumns=True)
    got = hmm.score_texts(df).collect()
    rows = df.select("doc_id", "text").collect()
    counts = Counter(t for r in rows if zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 != 2 for t in [*(w.encode() for w in tokens(r.text)), hmm.END])
    want = {r.doc_id: brute_score(kept["model"], kept["words"][1], counts, r.text) for r in rows}
    assert len(got) == len(rows) and all(math.isclose(r.score, want[r.doc_id], rel_tol=1e-9) for r in got)


def test_words_beyond_the_broadcast_are_joined(docs, monkeypatch):
    want = {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in hmm.score_texts(docs).collect()}
    monkeypatch.setattr(hmm, "KNOWN", 50)
    monkeypatch.setattr(hmm, "HEAD", 20)
    got = {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in hmm.score_texts(docs).collect()}
    assert got == want


def test_words_come_in_bounded_lists():
    from loomtext.llm.common import word_lists, words

    for t in (None, b"", b"  ", LONG.encode(), b"a" * 5000, b"x \t\n" * 999):
        assert [w for ws in word_lists(t, 100) for w in ws] == words(t)


ITEM = "The quick brown fox jumps over the lazy dog while seventeen zebras quietly watch from a hill in the pale evening light."


def test_decontamination_finds_edited_items_and_nothing_else(spark, odd, empty):
    bench = spark.createDataFrame([(1, ITEM), (2, "tiny"), (3, None), (4, "Another passage of some length that is never leaked into any of these documents at all.")], "item_id long, text string")
    edited = ITEM.replace("quick", "quack").replace("zebras", "zebra").replace(" hill", " hills")
    far = " ".join(ITEM.split()[::-1])
    rows = [(1, "x " * 500 + ITEM + " y" * 400), (2, "intro " + edited.upper() + " outro"), (3, far), (4, ITEM[:60]), (5, None), (6, ""), (7, "so TINY"), (8, ITEM.replace(" ", "\n\n ") + " tail"), (9, "tinyness")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.edits, r.end - r.start) for r in qgram.contaminated(docs, bench).collect()}
    assert got == {(1, 1): (0, len(ITEM)), (2, 1): (3, len(ITEM)), (8, 1): (0, len(ITEM)), (7, 2): (0, 4)}
    assert sorted(r.doc_id for r in qgram.decontaminate(docs, bench).collect()) == [3, 4, 5, 6, 9]
    assert qgram.contaminated(odd, bench).count() == qgram.contaminated(empty, bench).count() == qgram.contaminated(docs, bench.limit(0)).count() == 0
    assert qgram.decontaminate(odd, bench).count() == len(ROWS)


def edits(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_equals_brute_force(spark, monkeypatch):
    """Random items of 1 to 90 characters, some not ASCII and some repeated, in one block and in many."""
    import random

    rnd = random.Random(9)
    letters = "abcd é  "
    items = [(k, "".join(rnd.choice(letters) for _ in range(rnd.choice([1, 3, 7, 8, 9, 20, 40, 90])))) for k in range(40)]
    items += [(3, items[5][1]), (50, items[38][1]), (51, items[38][1]), (52, ""), (53, None)]
    docs = []
    for d in range(60):
        parts = []
        for _ in range(rnd.randrange(4)):
            q = list(rnd.choice(items)[1] or "")
            for _ in range(rnd.randrange(1 + len(q) // 8)):
                k = rnd.randrange(len(q))
                q[k : k + 1] = rnd.choice([[], ["ü"], [q[k], "z"]])
            parts += ["".join(q), "".join(rnd.choice("xyz ") for _ in range(rnd.randrange(30)))]
        docs.append((d, rnd.choice(["", " "]).join(parts)))
    want = set()
    for d, t in docs:
        text = qgram.normal(t.encode())
        for i, p in items:
            p = qgram.normal((p or "").encode())
            budget = min(int(qgram.RATE * len(p)), (len(p) - qgram.Q) // qgram.Q)
            if (edits(p, text) <= budget) if len(p) >= qgram.Q else p and b" " + p + b" " in b" " + text + b" ":
                want.add((d, i))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (qgram.BLOCK_BYTES, 300):
        monkeypatch.setattr(qgram, "BLOCK_BYTES", block)
        assert {(r.doc_id, r.item_id) for r in qgram.contaminated(frame, bench).collect()} == want
        assert {r.doc_id for r in qgram.decontaminate(frame, bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert len(want) > 60


def test_decontamination_of_a_very_long_text(spark):
    edited = ITEM.replace("fox", "föx").replace("lazy ", "").replace("hill", "hilll")  # two bytes for one, five less, one more
    rows = [(1, LONG + " " + edited + " " + LONG), (2, LONG + LONG), (3, (ITEM[:70] + " cut ") * 400)]
    got = qgram.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, ITEM), (1, ITEM), (2, LONG[:30000])], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.edits) for r in got) == [(1, 1, 8), (1, 1, 8), (1, 2, 0), (2, 2, 0)]
    assert got[0].start >= len(LONG) - 2 or got[0].item_id == 2


def test_alignment_equals_full_dynamic_programming():
    import random

    rnd = random.Random(4)
    for _ in range(60):
        p = "".join(rnd.choice("ab ") for _ in range(30))
        q = list(p)
        for _ in range(rnd.randrange(5)):
            k = rnd.randrange(len(q))
            q[k : k + 1] = rnd.choice([[], [rnd.choice("abc")], [q[k], "z"]])
        pad = rnd.randrange(9)
        t = "".join(rnd.choice("xy") for _ in range(pad)) + "".join(q) + "yx"
        got = qgram.align(p.encode(), t.encode(), pad - 4, pad + 4, 6)
        assert got and got[0] == edits(p, t)


def test_chunks_resist_shifts_and_repeats_are_found(spark, docs, odd, empty):
    passage = " ".join(f"common{i * 7 % 101}" for i in range(60))
    rows = [(d, f"{'own' + str(d)} " + " ".join(f"u{d}v{i}" for i in range(80 + d)) + (" " + passage if d in (3, 5, 8) else "") + f" end{d}") for d in range(10)] + [(20, None), (21, ""), (None, passage)]
    got = {(r.doc_id, r.first_doc_id) for r in chunks.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 3), (8, 3)}
    text = LONG[:20000].encode()
    a, b = {text[i:j] for i, j in zip([0, *chunks.cuts(text)], chunks.cuts(text))}, b"inserted words here " + text
    shifted = {b[i:j] for i, j in zip([0, *chunks.cuts(b)], chunks.cuts(b))}
    assert len(a & shifted) > 0.98 * len(a)
    for t in (text, b"and " * 900, b"x" * 700, b"short"):
        ends = chunks.cuts(t)
        assert ends[-1] == len(t) and all(0 < j - i <= chunks.LONGEST for i, j in zip([0, *ends], ends)) and all(j - i >= chunks.SHORTEST for i, j in zip([0, *ends[:-1]], ends[:-1]))
    same = [{t[i:j] for i, j in zip([0, *chunks.cuts(t)], chunks.cuts(t))} for t in (b"one begins " + b"and " * 300, b"another one begins so " + b"and " * 280)]
    assert same[0] & same[1]  # monotonous text is cut in step
    data = np.frombuffer(text[:500], np.uint8)
    h = 0
    for i, c in enumerate(data):
        h = ((h << 1) + int(chunks._GEAR[c])) & 0xFFFFFFFF
        assert chunks.gear(data)[i] == h
    assert chunks.repeated_passages(empty).count() == 0
    assert {(r.doc_id, r.first_doc_id) for r in chunks.repeated_passages(odd).collect()} == {(2, 1)}  # the halves of 3 around its change are too short
    t = {x.doc_id: (x.text or "").encode() for x in docs.collect()}
    told = chunks.repeated_passages(docs).collect()
    assert told and all(r.first_doc_id < r.doc_id and t[r.doc_id][r.start_byte : r.end_byte] in t[r.first_doc_id] for r in told)  # every passage is really there, whole


def test_passages_of_several_documents_are_told_apart(spark):
    a, b = (" ".join(f"{x}{i * 7 % 103}" for i in range(70)) for x in ("left", "right"))
    rows = [(1, "own one " + a + " x1"), (2, "y2 " + b + " own two"), (3, "own three " + a + " " + b + " end"), (4, a + " " + b), (5, "z " + "and " * 300), (6, "and " * 200), (4, b)]
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append(t.encode())
    told = chunks.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in told:
        assert any(any(t[r.start_byte : r.end_byte] in u for u in texts[r.first_doc_id]) for t in texts[r.doc_id])
    assert {(r.doc_id, r.first_doc_id) for r in told} >= {(3, 1), (3, 2), (4, 1), (4, 2), (4, 3), (6, 5)}


def test_a_passage_that_very_many_documents_hold(spark):
    """A hot digest: one passage in 1,500 documents, a third of them with it at another place; the smallest id keeps it."""
    passage = " ".join(f"hot{i}" for i in range(55))
    rows = [(d, (f"lead{d} " * (d % 3)) + passage + f" tail{d}") for d in range(1500)]
    told = chunks.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert sorted((r.doc_id, r.first_doc_id, r.n_words) for r in told) == [(d, 0, 55) for d in range(1, 1500)]


def brute_passages(rows, n):
    """Every run of windows of n words that one smaller id holds too, in step with its first places there, as (doc_id, first_doc_id, start_byte, end_byte, n_words)."""
    first, cut = {}, []
    for d, t in rows:
        t = (t or "").encode()
        spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)]
        keys = [t[spans[i][0] : spans[i + n - 1][1]] for i in range(len(spans) - n + 1)]
        cut.append((d, spans, keys))
        for i, k in enumerate(keys):
            first[k] = min((d, i), first.get(k, (d, i)))
    out, whole = [], {}
    for d, t in sorted(rows):
        whole.setdefault(t, d)
    for (d, t), (_, spans, keys) in zip(rows, cut):
        if keys and whole[t] < d:  # a copy of a whole text
            out.append((d, whole[t], spans[0][0], spans[-1][1], len(spans)))
            continue
        i = 0
        while i < len(keys):
            j, (f, at) = i, first[keys[i]]
            while f < d and j + 1 < len(keys) and first[keys[j + 1]] == (f, at + j + 1 - i):
                j += 1
            if f < d:
                out.append((d, f, spans[i][0], spans[j + n - 1][1], j - i + n))
            i = j + 1
    return sorted(out)


@pytest.mark.parametrize("least", [chunks.PASSAGE_WORDS, 5])
def test_word_runs_equal_brute_force_and_are_told(spark, docs, odd, least):
    for df in (docs, odd):
        rows = [(r.doc_id, r.text) for r in df.filter("doc_id IS NOT NULL").select("doc_id", "text").distinct().collect()]
        want = brute_passages(rows, least)
        got = chunks.word_runs(chunks._texts(df), least).collect()
        assert sorted((r.doc_id, r.first, r.start_byte, r.end_byte, r.end_word - r.start_word) for r in got) == want
        told = chunks.repeated_passages(df, least).collect()
        texts, rows_of = {}, {}
        for d, t in rows:
            texts.setdefault(d, []).append((t or "").encode())
        for r in told:
            assert any(t[r.start_byte : r.end_byte] in u for t in texts[r.doc_id] for u in texts[r.first_doc_id]) and r.first_doc_id < r.doc_id
            rows_of.setdefault(r.doc_id, []).append((r.start_byte, r.end_byte))
        for d, _, i, j, _ in want:  # each window that repeats is told, within one passage
            if len(texts[d]) == 1:
                spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", texts[d][0]) if i <= m.start() < j]
                assert all(any(a <= x[0] and y[1] <= b for a, b in rows_of[d]) for x, y in zip(spans, spans[least - 1 :]))


def test_no_passage_of_51_words_is_lost(spark, docs):
    words = " ".join(r.text for r in docs.filter("text IS NOT NULL").orderBy("doc_id").limit(60).collect()).split()
    rng = np.random.default_rng(7)
    rows = []
    for k in range(400):  # a passage within foreign text, twice
        at = int(rng.integers(0, len(words) - 51))
        for half in (0, 1):
            own = [f"{half}{k}x{i}" for i in range(80)]
            rows.append((1000 * half + k, " ".join(own[:40] + words[at : at + 51] + own[40:])))
    got = {r.doc_id for r in chunks.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got >= set(range(1000, 1400))
