"""Repair of replies, replies that are kept, a memory of facts, and ids that contain texts, against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomtext.functions import repair
from loomtext.operators import memory, replies, summaries
from loomtext.plans import steps


def closers(text):
    stack, inside, escaped = [], False, False
    for c in text:
        if inside:
            escaped, inside = (c == "\\" and not escaped), not (c == '"' and not escaped)
        elif c == '"':
            inside = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
    return "".join(reversed(stack)), inside


def plain_repair(text):
    """The longest piece of a text from its first brace that a quote, if it ends inside a string, and closing brackets make an object.

    Digits that the cut may have shortened are no end.
    """
    text = text[text.find("{") :] if "{" in text else ""
    for p in range(len(text), 0, -1):
        end, inside = closers(text[:p])
        if not end and not inside and p < len(text):
            continue
        digits = "-+.0123456789eE"
        if not inside and text[p - 1] in "0123456789" and (p == len(text) or text[p] in digits):
            continue
        whole = text[:p] + ('"' if inside else "") + end
        try:
            json.loads(whole)
        except ValueError:
            continue
        return whole
    return None


def some_value(rnd, deep=0):
    kind = rnd.randrange(4 if deep > 2 else 6)
    word = lambda: "".join(rnd.choice('ab"\\{}[],:é \n') for _ in range(rnd.randrange(6)))
    if kind < 2:
        return word()
    if kind < 4:
        return rnd.choice([None, True, False, 0, -1, 12.5, 1e30, 345])
    return [some_value(rnd, deep + 1) for _ in range(rnd.randrange(4))] if kind == 4 else {word(): some_value(rnd, deep + 1) for _ in range(rnd.randrange(4))}


@pytest.mark.parametrize("seed", range(4))
def test_repair_of_every_cut_equals_brute_force(seed):
    rnd = random.Random(seed)
    for _ in range(25):
        whole = "x " + json.dumps({"k": some_value(rnd), "l": some_value(rnd)}, ensure_ascii=rnd.random() < 0.5, indent=rnd.choice([None, 1]))
        for cut in range(len(whole) + 1):
            got, want = repair.close_cut(whole[:cut]), plain_repair(whole[:cut])
            assert (got and json.loads(got)) == (want and json.loads(want)), whole[:cut]


@pytest.mark.parametrize("text", [None, "", "no object", "{'a': 1}", '{"a" 1}', '{"a": 1,}', '{"a": tru}', '{"a": 1x', '{"a": "\x01"}', '{1: 2}', '{"a": [1}'])
def test_what_is_wrong_before_its_end_is_not_repaired(text):
    assert repair.close_cut(text) is None


def test_deep_and_long_replies_are_repaired():
    deep = '{"a":' + "[" * 50_000
    assert repair.close_cut(deep) == deep + "]" * 50_000 + "}"
    assert repair.close_cut('{"a":"' + "x" * 2_000_000) == '{"a":"' + "x" * 2_000_000 + '"}'


def test_replies_are_read_or_repaired_once(spark):
    rows = [(0, '```json\n{"a": 1}\n``` and more'), (1, '{"a": {"b": 2}, "c": "cu'), (2, "prose"), (3, None), (4, '{"a": 1} x {"b": 2'), (5, "[1, 2]")]
    df = spark.createDataFrame(rows, "i int, r string")
    got = {r.i: (r.object, r.status) for r in repair.with_objects(df, "r").collect()}
    assert got == {0: ('{"a": 1}', "read"), 1: ('{"a": {"b": 2}, "c": "cu"}', "repaired"), 2: (None, "unreadable"), 3: (None, "unreadable"), 4: ('{"a": 1}', "read"), 5: (None, "unreadable")}
    tried = repair.with_objects(df, "r", lambda t: "still prose")
    assert {r.status for r in tried.collect()} == {"read", "unreadable"}
    assert repair.with_objects(df, "r", lambda t: '{"fixed": true}').filter("status = 'repaired'").count() == 4
    assert repair.with_objects(df.limit(0), "r").count() == 0


def counted(folder):
    """A model whose calls leave a file each, and which fails now and then."""
    import uuid

    def call(requests, attempt):
        for r in requests:
            (folder / uuid.uuid4().hex).write_text(r["prompt"])
        if any(r["prompt"] == "boom" for r in requests) and attempt == 1:
            raise RuntimeError("down")
        return [None if r["prompt"] == "never" or (r["prompt"] == "later" and attempt < 3) else r["system"] + r["prompt"].upper() for r in requests]

    return call


def test_replies_are_asked_for_once(spark, tmp_path):
    said, path = tmp_path / "said", str(tmp_path / "kept")
    said.mkdir()
    call, asked = counted(said), lambda: sorted(f.read_text() for f in said.iterdir())
    rows = [(k, "s", p) for k, p in enumerate(["one", "two", "two", "later", "never", "boom", None, ""])] + [(9, "t", "two")]
    df = spark.createDataFrame(rows, "k int, system string, prompt string").fillna("", "prompt")
    ask = lambda d, **kw: {r.k: r for r in replies.candidates(replies.answer(d, ["system", "prompt"], path, call, size=1, pause=None, **kw)).collect()}
    first = ask(df.filter("k < 3"))
    assert asked() == ["one", "two"] and [first[k].candidate for k in range(3)] == ["sONE", "sTWO", "sTWO"] and all(r.sent and r.attempts == 1 for r in first.values())
    every = ask(df)
    assert {k: (r.candidate, r.attempts, r.waited, r.status, r.sent) for k, r in every.items()} == {
        0: ("sONE", 1, 0.0, "answered", False), 1: ("sTWO", 1, 0.0, "answered", False), 2: ("sTWO", 1, 0.0, "answered", False), 3: ("sLATER", 3, 6.0, "answered", True), 4: ("", 3, 6.0, "failed", True),
        5: ("sBOOM", 2, 2.0, "answered", True), 6: ("s", 1, 0.0, "answered", True), 7: ("s", 1, 0.0, "answered", True), 9: ("tTWO", 1, 0.0, "answered", True),
    }
    n = len(asked())
    again = ask(df.repartition(5))
    assert asked().count("never") == 6 and len(asked()) == n + 3 and {k for k, r in again.items() if r.sent} == {4}
    assert replies.kept(spark, path).count() == 7  # a row for each request, however often it was sent
    assert ask(df.limit(0)) == {} and replies.kept(spark, str(tmp_path / "none")).count() == 0
    assert [replies.backoff(k) for k in (1, 2, 4, 5, 9)] == [2.0, 4.0, 16.0, 20.0, 20.0]


def test_requests_of_candidates_and_hints(spark):
    s = spark.createDataFrame([(1, "x" * 900), (2, None)], "i int, source string").withColumn("hint", F.lit("Take care."))
    asked = replies.candidate_requests(s, ["i"], "source", "m", 4).orderBy("i", "k").collect()
    assert [r.k for r in asked] == [0, 1, 2, 3] * 2 and asked[0].system == asked[3].system != asked[1].system and asked[0].prompt == "Translate:\n" + "x" * 400 and asked[4].prompt == "Translate:\n"
    assert replies.hint_requests(s, ["i"], "source", "hint", "m").orderBy("i").first().prompt == "Take care.\n\nTranslate this Sanskrit:\n" + "x" * 900


def test_memory_of_facts(spark):
    rnd = random.Random(4)
    keys = ["hot"] * 6 + ["a", "b", "c"]
    rows = [(rnd.choice(keys), k, rnd.choice([None, "x", "Yes", "z"]), float(rnd.randrange(50)), rnd.randrange(k) if k and rnd.random() < 0.7 else None, "step") for k in range(200)]
    df = spark.createDataFrame(rows, "key string, seq long, value string, metric double, cause long, step string")
    facts = memory.facts(df.repartition(7))
    until = {k: next((j for other, j, *_ in rows if other == key and j > k), None) for key, k, *_ in rows}
    assert {r.seq: r.until for r in facts.collect()} == until

    def state(s):
        last = {}
        for key, k, v, m, *_ in rows:
            if k <= s:
                last[key] = (k, v, m)
        return {key: x for key, x in last.items() if x[1] is not None}

    for s in (-1, 0, 17, 120, 199):
        assert {r.key: (r.seq, r.value, r.metric) for r in memory.as_of(facts, s).collect()} == state(s)
    one, two = state(20), state(199)
    r = memory.drift(facts, 20, 199).first()
    both = one.keys() & two.keys()
    assert (r.same, r.changed, r.added, r.lost) == (sum(one[k][1] == two[k][1] for k in both), sum(one[k][1] != two[k][1] for k in both), len(two.keys() - one.keys()), len(one.keys() - two.keys()))
    same = memory.drift(facts, 199, 199).first()
    assert same.distance == 0.0 and same.share == 0.0 and memory.drift(facts, -1, -1).first().share is None
    assert [r.seq for r in memory.history(facts, "a").collect()] == [k for key, k, *_ in rows if key == "a"]
    assert {r.seq for r in memory.search(df, "YES").collect()} == {k for _, k, v, *_ in rows if v == "Yes"}
    cause = {k: c for _, k, _, _, c, _ in rows}
    want = set()
    for start in range(150, 200):
        at, depth = start, 0
        while at is not None:
            want.add((start, depth, at))
            at, depth = cause[at], depth + 1
    assert {(r.start, r.depth, r.seq) for r in memory.trace(df, df.filter("seq >= 150")).collect()} == want
    loop = spark.createDataFrame([("k", 1, "v", 0.0, 2), ("k", 2, "v", 0.0, 1)], "key string, seq long, value string, metric double, cause long")
    assert sorted((r.start, r.depth, r.seq) for r in memory.trace(loop, loop).collect()) == [(1, 0, 1), (1, 1, 2), (2, 0, 2), (2, 1, 1)]
    assert memory.facts(df.limit(0)).count() == 0


def test_first_id_that_contains_two_texts(spark):
    rnd = random.Random(9)
    word = lambda n: "".join(rnd.choice("abcé") for _ in range(rnd.randrange(n)))
    ids = {word(9): k for k in range(150)}
    needles = {(word(5), word(4)) for _ in range(150)} | {("", ""), ("", "a"), ("zz", "a")}
    got = summaries.first_containing(spark.createDataFrame(sorted(needles), "p1 string, p2 string"), spark.createDataFrame(list(ids.items()), "id string, ord int"), "id", "ord")
    want = {n: min((k, i) for i, k in ids.items() if n[0] in i and n[1] in i)[1] for n in needles if any(n[0] in i and n[1] in i for i in ids)}
    assert {(r.p1, r.p2): r.id for r in got.collect()} == want and len(want) > 50


def test_the_last_of_equal_ids_has_the_price_and_the_first_the_place(spark):
    prices = spark.createDataFrame([("big-one-2", 1.0, 0), ("big-one-3", 2.0, 1), ("big-one-2", 9.0, 2)], "id string, prompt double, ord int")
    use = spark.createDataFrame([("big-one-2",), ("v/big-one-3",), ("x/big-one",), ("big",), ("-",)], "model string")
    got = {r.model: (r.id, r.prompt, r.match_level) for r in summaries.price_lookup(use, "model", prices, "id", "ord").collect()}
    assert got == {"big-one-2": ("big-one-2", 9.0, 1), "v/big-one-3": ("big-one-3", 2.0, 2), "x/big-one": ("big-one-2", 9.0, 3), "big": (None, None, None), "-": ("big-one-2", 9.0, 3)}


def test_a_learned_metric_is_never_invented(spark):
    df = spark.createDataFrame([(i, "s", f"c{i}", "g") for i in range(7)], "i int, source string, candidate string, gold string")
    assert {(r.comet, r.comet_note[:13]) for r in steps.comet(df).collect()} == {(None, "not installed")}

    def scorer(pairs):
        if len(pairs) > 3:
            raise ValueError("too many")
        return [None if p["mt"] == "c2" else len(p["mt"] + p["ref"]) / 7 for p in pairs]

    got = {r.i: (r.comet, r.comet_note) for r in replies.scored(df, "source", "candidate", "gold", scorer, 3).collect()}
    assert got == {i: (None if i == 2 else 0.4286, None) for i in range(7)}
    assert {r.comet_note for r in replies.scored(df.coalesce(1), "source", "candidate", "gold", scorer, 7).collect()} == {"failed: too many"}


def test_translations_and_bench_ask_a_model(spark, tmp_path):
    def call(requests, attempt):
        return [None if r["source"] == "lost" else f" {r['source']} {r['max_tokens']} " for r in requests]

    df = spark.createDataFrame([(1, "om namah", 5), (2, "lost", None), (3, "om shanti", None)], "i int, source string, max_tokens int")
    got = {r.i: r for r in steps.translate(df, str(tmp_path / "a"), call, pause=None).collect()}
    assert [got[i].translation for i in (1, 2, 3)] == ["om namah 5", "", "om shanti 30"] and got[2].status == "failed" and got[2].gate == "BLOCKED" and not got[2].checks["COVERAGE"]
    golds = spark.createDataFrame([(k, "alpha beta gamma", "alpha beta gamma 30") for k in range(4)], "k int, source string, gold string")
    b = steps.bench(golds, ["k"], 3, str(tmp_path / "b"), call, pause=None).first()
    assert (b["product"], b.n, b.avg_bleu, b.pass_rate) == ("bench", 3, 1.0, 1.0)
    assert steps.bench(golds.limit(0), ["k"], 3, str(tmp_path / "b"), call, pause=None).first().n == 0
