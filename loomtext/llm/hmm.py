"""A hidden Markov language model with Baum-Welch training by tasks and exact scoring by the scaled forward recursion."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import binary, fold, held, lean, materialise, runs, share, word_lists

#: Hidden states; words that are symbols of their own; classes of the other words, by the crc32 of their last three bytes.
STATES, HEAD, CLASSES = 8, 8192, 512
#: Words whose counts every task holds (a broadcast of fixed size); longer words than LONGEST bytes are looked up by a join.
KNOWN, LONGEST = 65536, 64
#: Baum-Welch over all training texts: rounds at most, and the relative gain in likelihood below which no further one follows.
ROUNDS, LEAST_GAIN = 4, 0.002
#: Before it, so many steps over so many texts of at most so many tokens give the first parameters.
FIRST_STEPS, FIRST_DOCS, FIRST_LONGEST = 12, 400, 20_000
#: Tokens that are taken together: several texts of so many at most, or a longer text block by block.
BLOCK = 600_000
_FLUSH = 200_000
END = b""


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in batches:
        for t in binary(batch, "text"):
            seen[END] += 1
            for ws in word_lists(t):
                seen.update(ws)
                if len(seen) > _FLUSH:
                    yield _counted(seen)
                    seen.clear()
    if seen:
        yield _counted(seen)


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])


class Lexicon:
    """What is known of words: N, V, counts of the commonest ones, and how much of each class lies outside of HEAD."""

    def __init__(self, total: int, kinds: int, tops: list[tuple[bytes, int]], classes: dict[int, tuple[int, int]]):
        self.total, self.kinds = total, kinds
        self.ids = {w: i for i, (w, _) in enumerate(tops)}
        counts = np.array([c for _, c in tops], np.float64)
        self.head = min(HEAD, len(tops))
        self.base = np.log10((counts + 1) / (total + kinds + 1))
        sums = np.array([classes.get(k, (0, 0)) for k in range(CLASSES)], np.float64).reshape(CLASSES, 2)
        for w, c in tops[: self.head]:  # words of their own leave their class
            sums[zlib.crc32(w[-3:]) % CLASSES] -= (c, 1)
        self.room = np.log10(sums[:, 0] + sums[:, 1] + 1)  # a class has one slot for all unseen words
        where = np.array([zlib.crc32(w[-3:]) % CLASSES for w, _ in tops], np.int64)
        self.symbol = np.where(np.arange(len(tops)) < self.head, np.arange(len(tops)), HEAD + where).astype(np.uint16)
        self.inside = np.where(np.arange(len(tops)) < self.head, 0.0, np.log10(counts + 1) - self.room[where] if len(tops) else 0.0)


def learn_words(texts: DataFrame) -> tuple[DataFrame, Lexicon]:
    """Token counts of all training texts, as a table, and the part of them of bounded size that tasks hold."""
    counts = materialise(texts.mapInArrow(_counts, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")))
    kind = F.pmod(F.crc32(F.expr("substring(token, -3, 3)")), F.lit(CLASSES))
    classes = counts.groupBy(kind.alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    # The commonest words, KNOWN at most: those from the first class of counts (a step of 1 %) on from which no more are left.
    size = F.floor(F.log("n") * 100).cast("int")
    steps = sorted(((r["size"], r["c"]) for r in counts.filter(F.length("token") <= LONGEST).groupBy(size.alias("size")).agg(F.count("*").alias("c")).collect()), reverse=True)
    least, held = None, 0
    for step, c in steps:
        if held + c > KNOWN:
            break
        least, held = step, held + c
    tops = counts.filter((F.length("token") <= LONGEST) & (size >= least)).collect() if held else []
    tops.sort(key=lambda r: (-r["n"], bytes(r["token"])))
    by = {r["k"]: (r["n"], r["v"]) for r in classes}
    return counts, Lexicon(sum(n for n, _ in by.values()), sum(v for _, v in by.values()), [(bytes(r["token"]), r["n"]) for r in tops], by)


def _encoder(shared):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = held(shared)
        for batch in batches:
            texts = binary(batch, "text")
            for a, b in runs(texts):
                cols: list[list] = [[] for _ in range(6)]
                for t in texts[a:b]:
                    coded, rare, n_common, base, inside = bytearray(), [], 0, 0.0, 0.0
                    for ws in chain(word_lists(t), [[END]]):
                        ids = np.fromiter((lex.ids.get(w, -1) for w in ws), np.int64, len(ws))
                        known = ids >= 0
                        symbols = np.zeros(len(ws), np.uint16)
                        symbols[known] = lex.symbol[ids[known]]
                        others = [ws[i] for i in np.flatnonzero(~known)]
                        symbols[~known] = [HEAD + zlib.crc32(w[-3:]) % CLASSES for w in others]
                        coded += symbols.tobytes()
                        rare += others
                        n_common, base, inside = n_common + int(known.sum()), base + lex.base[ids[known]].sum(), inside + lex.inside[ids[known]].sum()
                    for col, x in zip(cols, (len(coded) // 2, n_common, base, inside, bytes(coded), rare)):
                        col.append(x)
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(3)), *map(pa.array, cols, kinds)], ["row", "doc_id", "held_out", "n_tokens", "n_common", "base", "inside", "symbols", "rare"])

    return encode


class Hmm:
    """Start, transition and emission probabilities; emit is (symbols, states)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def first(symbols: int, weights: np.ndarray) -> Hmm:
        rng = np.random.default_rng(11)
        emit = (weights + 1)[:, None] * rng.uniform(0.5, 1.5, (symbols, STATES))
        move = np.full((STATES, STATES), 0.1 / (STATES - 1)) + np.eye(STATES) * (0.9 - 0.1 / (STATES - 1))
        return Hmm(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=0))

    @staticmethod
    def of_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Hmm:
        """From expected counts, a little added so that every symbol stays possible in every state."""
        emit = emit + 0.01 + 0.05 * emit.sum(axis=1, keepdims=True) / STATES
        return Hmm((start + 0.1) / (start + 0.1).sum(), (move + 0.1) / (move + 0.1).sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _steps(lengths: np.ndarray) -> np.ndarray:
    """For sequences sorted by falling length: how many of them reach each position."""
    return np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")


def _pack(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sequences by falling length as columns: their order, lengths, how many reach each position, and symbols position by position."""
    lengths = np.array([len(s) for s in seqs])
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    live = _steps(lengths)
    begins = np.concatenate([[0], np.cumsum(live)])
    flat = np.empty(begins[-1], np.int64)
    for k, i in enumerate(order):
        flat[begins[: lengths[k]] + k] = seqs[i]
    return order, lengths, live, flat


def _ahead(model: Hmm, seq: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward probabilities of a block of one sequence and their scales; before: those of the states ahead of its first symbol."""
    b = model.emit[seq]
    alphas, scales = np.empty((len(seq), STATES)), np.empty(len(seq))
    for t in range(len(seq)):
        alpha = before * b[t]
        scales[t] = alpha.sum()
        alphas[t] = alpha / scales[t]
        before = alphas[t] @ model.move
    return alphas, scales


def _blocks(seq: np.ndarray) -> list[slice]:
    return [slice(k, k + BLOCK) for k in range(0, len(seq), BLOCK)]


def _long_likelihood(model: Hmm, seq: np.ndarray) -> float:
    total, before = 0.0, model.start
    for part in _blocks(seq):
        alphas, scales = _ahead(model, seq[part], before)
        total, before = total + float(np.log10(scales).sum()), alphas[-1] @ model.move
    return total


def _long_counts(model: Hmm, seq: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> float:
    """expected_counts of one long sequence. Going forward only what enters each block is kept; going back each block's forward
    probabilities are computed again, so that the memory is that of one block."""
    total, enters, before = 0.0, [], model.start
    for part in _blocks(seq):
        enters.append(before)
        alphas, scales = _ahead(model, seq[part], before)
        total, before = total + float(np.log10(scales).sum()), alphas[-1] @ model.move
    beta, ahead = np.ones(STATES), None
    for part, before in zip(reversed(_blocks(seq)), reversed(enters)):
        mine = seq[part]
        alphas, scales = _ahead(model, mine, before)
        b = model.emit[mine] / scales[:, None]
        betas = np.empty_like(alphas)
        aheads = np.empty_like(alphas)
        for t in range(len(mine) - 1, -1, -1):
            if ahead is not None:
                beta = model.move @ ahead
            betas[t] = beta
            aheads[t] = np.zeros(STATES) if ahead is None else ahead
            ahead = beta * b[t]
        move += (alphas.T @ aheads) * model.move
        gamma = alphas * betas
        for k in range(STATES):
            emit[:, k] += np.bincount(mine, gamma[:, k], minlength=len(emit))
    start += gamma[0]
    return total


def log10_likelihoods(model: Hmm, seqs: list[np.ndarray]) -> np.ndarray:
    """The exact log10 probability of each symbol sequence, by the scaled forward recursion over all of them at once."""
    if len(seqs) == 1 and len(seqs[0]) > BLOCK:
        return np.array([_long_likelihood(model, seqs[0])])
    order, _, live, flat = _pack(seqs)
    begins = np.concatenate([[0], np.cumsum(live)])
    scales, b = np.empty(len(flat)), model.emit[flat]
    for part, scale in _forward(model, live, begins, b):
        scales[part] = scale
    owner = np.arange(len(flat)) - np.repeat(begins[:-1], live)
    out = np.empty(len(seqs))
    out[order] = np.bincount(owner, np.log10(scales), minlength=len(seqs))
    return out


def _forward(model: Hmm, live: np.ndarray, begins: np.ndarray, b: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Puts the scaled forward probabilities in the place of the emissions b, position by position, and gives each position's scales."""
    ones, before = np.ones(STATES), None
    for m, at in zip(live.tolist(), begins.tolist()):
        here = b[at : at + m]
        here *= model.start if before is None else before[:m] @ model.move
        scale = here @ ones
        here /= scale[:, None]
        before = here
        yield slice(at, at + m), scale


def expected_counts(model: Hmm, seqs: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> float:
    """Adds the Baum-Welch counts of the sequences to start, move and emit, and returns their log10 likelihood."""
    if len(seqs) == 1 and len(seqs[0]) > BLOCK:
        return _long_counts(model, seqs[0], start, move, emit)
    _, _, live, flat = _pack(seqs)
    begins = np.concatenate([[0], np.cumsum(live)])
    gamma, scales = model.emit[flat], np.empty(len(flat))
    for part, scale in _forward(model, live, begins, gamma):
        scales[part] = scale
    ahead = model.emit[flat]
    ahead /= scales[:, None]
    back, moved, beta = model.move.T.copy(), np.zeros((STATES, STATES)), np.ones((live[0], STATES))
    live_, begins_ = live.tolist(), begins.tolist()
    for t in range(len(live_) - 2, -1, -1):  # the rows of beta that end later are 1 until their last position comes
        n, at, after = live_[t + 1], begins_[t], begins_[t + 1]
        x, mine = ahead[after : after + n], beta[:n]
        x *= mine
        moved += gamma[at : at + n].T @ x
        gamma[after : after + n] *= mine
        np.matmul(x, back, out=mine)
    move += moved * model.move
    gamma[: live[0]] *= beta
    start += gamma[: live[0]].sum(axis=0)
    for k in range(STATES):
        emit[:, k] += np.bincount(flat, gamma[:, k], minlength=len(emit))
    return float(np.log10(scales).sum())


def _tokens(batch: pa.RecordBatch, column: str) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in binary(batch, column)]


def _groups(seqs: list[np.ndarray]):
    """Slices of at most BLOCK symbols: bounds the memory of a step. A longer sequence is a slice of its own."""
    most = BLOCK
    start = total = 0
    for i, s in enumerate(seqs):
        if i > start and total + len(s) > most:
            yield start, i
            start, total = i, 0
        total += len(s)
    if start < len(seqs):
        yield start, len(seqs)


def _expecter(shared, symbols: int):
    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held(shared)
        start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((symbols, STATES))
        any_row, fit = False, np.zeros(STATES)
        some: list[np.ndarray] = []  # rows of several batches together: the more texts, the fewer steps
        for seqs in chain((_tokens(batch, "symbols") for batch in batches), [None]):
            some += seqs or ()
            groups = list(_groups(some))
            for a, b in groups if seqs is None else groups[:-1]:
                any_row = True
                fit[0] += expected_counts(model, some[a:b], start, move, emit)
            some = some[groups[-1][0] :] if groups else some
        if any_row:
            used = np.flatnonzero(emit.any(axis=1))
            at = np.concatenate([used, symbols + np.arange(STATES + 2)])
            rows = np.concatenate([emit[used], move, start[None], fit[None]])
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(rows[:, k]) for k in range(STATES))], ["at", *(f"s{k}" for k in range(STATES))])

    return expect


def baum_welch(model: Hmm, coded: DataFrame, symbols: int) -> tuple[Hmm, float]:
    """One round over all rows, and the log10 likelihood of the rows under the model it began with: tasks add up expected counts,
    Spark sums them by symbol, and (symbols + states + 2) rows reach the driver."""
    shared = share(coded.sparkSession, model)
    names = [f"s{k}" for k in range(STATES)]
    got = coded.select("symbols").mapInArrow(_expecter(shared, symbols), "at int, " + ", ".join(f"{k} double" for k in names))
    got = got.groupBy("at").agg(*[F.sum(k).alias(k) for k in names]).toArrow()
    sums = np.zeros((symbols + STATES + 2, STATES))
    sums[got["at"].to_numpy()] = np.stack([got[k].to_numpy() for k in names], axis=1) if len(got) else sums[:0]
    return Hmm.of_counts(sums[-2], sums[symbols : symbols + STATES], sums[:symbols]), float(sums[-1, 0])


def fit(model: Hmm, coded: DataFrame, symbols: int) -> Hmm:
    """Rounds over all rows until one gains less than LEAST_GAIN of the likelihood, at most ROUNDS."""
    before = None
    for _ in range(ROUNDS):
        model, now = baum_welch(model, coded, symbols)
        if before is not None and now - before < LEAST_GAIN * abs(before):
            break
        before = now
    return model


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held(shared)
        for batch in batches:
            seqs = _tokens(batch, "symbols")
            values = np.zeros(len(seqs))
            for a, b in _groups(seqs):
                values[a:b] = log10_likelihoods(model, seqs[a:b])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(7)), pa.array(values)], ["row", "doc_id", "held_out", "n_tokens", "n_common", "base", "inside", "chain"])

    return score


def training_row(doc_id: Column) -> Column:
    return fold(doc_id, 7) != 2


def score_texts(docs: DataFrame) -> DataFrame:
    """Trains on the rows of docs (doc_id, text) whose crc32(doc_id) modulo 7 is not 2 and scores every whole text.

    The tokens of a text are its words (A-Z lower-cased) and one end. The model is a hidden Markov chain of STATES states
    over symbols: the HEAD commonest words, and CLASSES classes of the others; within its class a word has the smoothed share
    of its count, one slot being left for all unseen words, the same in each state. So a text's probability is that of its symbols,
    by the forward recursion, times those shares. It is a probability of texts in which all unseen words of a class count as
    one word. Word counts, base scores and the rounds of Baum-Welch cover all training texts, whole; a bounded sample gives
    only their starting point. Counts of the KNOWN commonest words are broadcast; those of all others are joined by the word.
    A text of more than BLOCK tokens is gone through in blocks, exactly, so that its length does not set the memory.

    A null text is empty: it has the end alone. Rows that repeat an id are scored each for itself; a null doc_id counts as
    the empty text in the fold; an empty table gives an empty result; other columns play no part.
    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10 sums).
    """
    spark = docs.sparkSession
    texts = lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), (~training_row(F.col("doc_id"))).alias("held_out"), F.col("text").cast("binary").alias("text"))
    counts, lex = learn_words(texts.filter("NOT held_out").select("text"))
    shared = share(spark, lex)
    rows = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    shape = "row long, doc_id long, held_out boolean, n_tokens long, n_common long, base double, inside double"
    coded = materialise(rows.mapInArrow(_encoder(shared), f"{shape}, symbols binary, rare array<binary>"))

    learn, symbols = coded.filter("NOT held_out"), HEAD + CLASSES
    u = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) / float(1 << 30)  # FIRST_DOCS texts in expectation
    short = F.length("symbols") <= 2 * FIRST_LONGEST
    chosen = learn.filter(short & (u < FIRST_DOCS / max(1, learn.count()))).select("row", "symbols").collect()
    sample = [np.frombuffer(r["symbols"], np.uint16) for r in sorted(chosen, key=lambda r: r["row"])]
    weights = np.bincount(np.concatenate(sample), minlength=symbols).astype(float) if sample else np.zeros(symbols)
    model = Hmm.first(symbols, weights)
    for _ in range(FIRST_STEPS if sample else 0):
        start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((symbols, STATES))
        for a, b in _groups(sample):
            expected_counts(model, sample[a:b], start, move, emit)
        model = Hmm.of_counts(start, move, emit)
    model = fit(model, learn, symbols)

    rare = coded.select("row", F.explode("rare").alias("token")).join(counts, "token", "left")
    kind = F.pmod(F.crc32(F.expr("substring(token, -3, 3)")), F.lit(CLASSES))
    room = F.array(*[F.lit(float(x)) for x in lex.room])
    c = F.coalesce("n", F.lit(0))
    rare = rare.groupBy("row").agg(
        F.count("n").alias("n_rare"),
        F.sum(F.log10(c + 1)).alias("logs"),
        F.count("*").alias("all_rare"),
        F.sum(F.get(room, kind.cast("int"))).alias("rooms"),
    )
    scored = coded.select("row", "doc_id", "held_out", "n_tokens", "n_common", "base", "inside", "symbols").mapInArrow(_scorer(share(spark, model)), f"{shape}, chain double")
    all_log = float(np.log10(lex.total + lex.kinds + 1))
    zero = lambda name: F.coalesce(name, F.lit(0))
    return scored.join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_common") + zero("n_rare")).cast("long").alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("logs") - zero("all_rare") * all_log).alias("base_score"),
        (F.col("chain") + F.col("inside") + zero("logs") - zero("rooms")).alias("score"),
    )
