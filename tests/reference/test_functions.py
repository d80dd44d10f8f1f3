"""Literal cases, properties and round trips of the reference's own operators."""

import json
import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomtext.functions import contracts, gates, lexicon, parsing, perturb, text
from loomtext.operators import agreement, rank, select, summaries
from loomtext.plans import steps
from loomtext.sources import gold, sinks
from loomtext.streaming import ledger as stream

sys.path.insert(0, str(Path(__file__).resolve().parent))
import plain_rules  # noqa: E402

METRICS = [
    ("Homage to Shiva", "Homage to Shiva", 1.0, 1.0), ("Homage to Shiva", "The purple elephant dances", 0.1111, 0.0), ("Homage to Shiva", "The purple elephant dances on the moon", 0.1538, 0.0),
    ("Homage to Shiva", "Obeisance to Lord Shiva", 0.4188, 0.5), ("the cat sat", "the the the", 0.4228, 1.0), ("a b c d", "a b", 0.3922, 0.3679), ("ab", "ab", 0.6667, 1.0), ("a", "a", 0.3333, 1.0),
    ("a b c", "abc", 1.0, 0.0), ("abc", "xyz", 0.0, 0.0), ("x", "  ", 0.0, 0.0), ("", "x", 0.0, 0.0), (None, "x", 0.0, 0.0),
]


@pytest.mark.parametrize("run", [1, 40, 1 << 18])
def test_gram_codes_are_the_grams(monkeypatch, run):
    monkeypatch.setattr(text, "_RUN", run)
    rnd = random.Random(run)
    texts = ["".join(rnd.choice("abcdéū\u3042😀") for _ in range(rnd.randrange(30))) for _ in range(60)] + [""]
    for n in (1, 2, 3):
        told = text._gram_lists(texts, n).to_pylist()
        spelt = [{"".join(chr(x >> 21 * (n - 1 - k) & 0x1FFFFF) for k in range(n)) for x in xs} for xs in told]
        assert spelt == [{t[i : i + n] for i in range(len(t) - n + 1)} for t in texts] and [len(x) for x in told] == [len(x) for x in spelt]
    assert text._gram_lists([], 2).to_pylist() == []


def test_metrics(spark):
    df = spark.createDataFrame([(i, r, c) for i, (r, c, *_) in enumerate(METRICS)], "i int, r string, c string")
    got = {x.i: (x.chrf, x.bleu1) for x in text.with_metrics(df, "r", "c").collect()}
    assert [got[i] for i in range(len(METRICS))] == [m[2:] for m in METRICS]
    back = {x.i: x.chrf for x in text.with_metrics(df, "c", "r").collect()}
    assert all(back[i] == got[i][0] and 0 <= back[i] <= 1 for i in back)


GATES = [
    ("śivāya namaḥ", "Homage to Shiva", []), ("kramasadbhava namaḥ śivāya", "Homage to Shiva, the kramasadbhava", []), ("śivāya namaḥ", "The purple elephant dances on the moon", []),
    ("", "x y", ["SOURCE_BINDING", "COVERAGE"]), ("a word here now", "āāāāāā" + " long text" * 5, ["SOURCE_BINDING", "ABSTENTION"]), ("śiva namaḥ śaṅkara", "Shiva and Śiva", ["TERM_CONSISTENCY"]), ("plain words only", "the power of it", ["CITATION_GROUNDING"]),
]


def test_gates(spark):
    df = spark.createDataFrame([(i, s, c, "Homage to Shiva") for i, (s, c, _) in enumerate(GATES)], "i int, source string, candidate string, gold string")
    got = {r.i: r for r in steps.verify(df).collect()}
    assert [got[i].blocking for i in range(len(GATES))] == [g[2] for g in GATES]
    assert all((r.gate == "PASS") == (not r.blocking) for r in got.values())
    assert got[0].verified and not got[2].verified and not got[2].gold_ok


@pytest.mark.parametrize("a,b,want", [([0.9, 0.5, 0.5, 0.1], [3, 2, 1, 1], 1.0), ([1, 1, 1], [1, 2, 3], 0.0), ([1, 2, 3], [3, 2, 1], -1.0), ([1], [1], 0.0), ([1, 2, 3], [1, 3, 2], 1 / 3)])
def test_gamma(spark, a, b, want):
    df = spark.createDataFrame([("p", i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "p string, i int, m double, j double")
    [r] = rank.gamma(df, ["p"], "i", ["m"], "j").collect()
    assert r.gamma == pytest.approx(want)


LINE = "The divine king did not enter the hall, and his heart was a lamp"
BAD = {
    "SCOPE_NEGATION": LINE.replace("not ", " "), "MORPHOLOGY": LINE + "s", "TECHNICAL_TERM": LINE.replace("The", "the being", 1), "POETIC_METAPHOR": LINE.replace("heart", "organ"), "TEXTUAL_STRUCTURE": None,
    "ACCURACY_OMISSION": "The divine king did not enter the hall", "ACCURACY_ADDITION": LINE + ", and this was not stated in the original text", "ACCURACY_MISTRANSLATION": LINE.replace("divine", "ordinary"),
    "SYNTAX_KARAKA": LINE.replace("divine", "#").replace("lamp", "divine").replace("#", "lamp"), "LEXICAL_SENSE": LINE.replace("divine", "ordinary"), "COREFERENCE": LINE.replace("his", "her"),
    "COMPOUND_SAMASA": LINE.replace("The divine", "divine The"), "SEGMENTATION_SANDHI": None, "STYLE": "t" + LINE[1:],
}


OMITTED = {"a, b c d": "a", "one two, three": "one two,", "one": None, "a b c d,": "a b c", "x, y z w ,, ": "x, y z", "a\tb": "a", "a, b": "a,"}


def perturbed(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return {r.t: dict(zip(perturb.FAMILIES, r.bad)) for r in df.select("t", perturb.all_perturbations(F.col("t")).alias("bad")).collect()}


def test_perturbations_equal_plain_rules(spark):
    rnd = random.Random(3)
    words = [*perturb.ANTONYMS, *perturb.IMAGES, *perturb.PRONOUNS, *perturb.SPEECH, "not", "Never", "the", "of", "King", "Śiva", "well-known", "a-b", "x's", "été", "s", "ss", "10", "Ähre", "nor-", "-no", "''", "_"]
    gaps = [" ", " ", " ", ", ", ",", "\n", "  ", ". ", " — ", "; ", "\u00a0", " ,, "]
    texts = {"".join(rnd.choice([rnd.choice(words), rnd.choice(words).upper(), rnd.choice(words).title()]) + rnd.choice(gaps) for _ in range(rnd.randrange(9))) for _ in range(400)}
    texts |= {t.strip() for t in texts} | {rnd.choice(gaps) + t for t in texts}
    got = perturbed(spark, sorted(texts))
    assert {t: {f: plain_rules.perturb(t, f) for f in perturb.FAMILIES} for t in texts} == got


def test_perturbations(spark):
    told = perturbed(spark, [LINE, *OMITTED, " x y ", None, "", " ,"])
    assert told[LINE] == BAD
    assert {t: told[t]["ACCURACY_OMISSION"] for t in OMITTED} == OMITTED
    assert told[" x y "]["ACCURACY_ADDITION"] == "x y , and this was not stated in the original text"
    assert all(bad is None for t in (None, "", " ,") for bad in told[t].values())
    golds = spark.createDataFrame([(f"s{i}", f"{LINE} and-so number {i}, he said many good things", i) for i in range(30)], "source string, gold string, ord int")
    rows = steps.challenge(golds, 200).collect()
    counts = {}
    for r in rows:
        counts[r.error_family] = counts.get(r.error_family, 0) + 1
        assert r.bad != r.good and "controlled bad translation" in r.instruction
    assert len(rows) == 196 and set(counts.values()) == {14} and steps.challenge(golds, 50).count() == 50


def test_disagreement(spark):
    df = spark.createDataFrame([("p", 0, "Homage to Shiva", True), ("p", 1, "Obeisance to Lord Shiva", True), ("p", 2, "x", False), ("q", 0, "y", True)], "p string, i int, t string, ok boolean")
    got = {r.p: (r.disagreement, r.verdict) for r in agreement.candidate_disagreement(df, "p", "i", "t", "ok").collect()}
    assert got == {"p": (0.581, "divergent-review"), "q": (0.0, "insufficient-candidates")}


def test_lexicons(spark):
    df = spark.createDataFrame([(0, "krama and mātṛkā", "abhinavagupta-x.txt"), (1, "vimarśa krama ānanda", "x"), (2, None, "yoga"), (3, "vimarśa krama", "buddha")], "i int, t string, f string")
    got = {r.i: (r.a, r.b) for r in df.select("i", lexicon.tag(F.col("t")).alias("a"), lexicon.detect(F.col("f")).alias("b")).collect()}
    assert got == {0: ("Krama", "Pratyabhijñā/Trika"), 1: ("Pratyabhijñā/Trika", None), 2: ("Vedic/General", "Yoga"), 3: ("Pratyabhijñā/Trika", "Buddhist")}
    d = spark.createDataFrame([("śambhuṃ yoga word",)], "t string").select(lexicon.term_density(F.col("t"), lexicon.SCHOOL_TERMS["Pratyabhijñā/Trika"]).alias("d")).first().d
    assert (d.n_terms, d.n_tokens, d.term_density, d.found) == (1, 3, 0.3333, ["śambhu"])


def test_contracts(spark):
    good = {"step": "s", "ts": "2024-01-01T00:00:00"}
    rows = [json.dumps(good), json.dumps({"step": 1, "ts": "today"}), json.dumps({"ts": "2024-01-01T"}), "{broken", json.dumps(good | {"more": 1})]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r string")
    got = {r.i: r.v for r in df.select("i", contracts.violations(F.col("r"), "AGENT_RUN").alias("v")).collect()}
    assert got == {0: [], 1: ["bad type step", "bad type ts"], 2: ["missing step"], 3: ["invalid JSON"], 4: []}
    assert df.filter("i = 4").select(contracts.violations(F.col("r"), "AGENT_RUN", strict=True).alias("v")).first().v == ["unknown field"]
    n = spark.createDataFrame([('{"a": 1, "b": 1.5, "c": true, "d": [], "e": {}, "f": null}',)], "r string")
    assert n.select(contracts.violations(F.col("r"), {"a": "number", "b": "integer", "c": "truth", "d": "list", "e": "object", "f": "text or null"}).alias("v")).first().v == ["bad type b"]


def test_parsing(spark):
    df = spark.createDataFrame([(0, '```json\n{"fidelity": 4, "judgment": "negation lost"}\n```'), (1, "none"), (2, '{"fidelity": 9}'), (3, '{"fidelity": "x"}'), (4, None)], "i int, r string")
    got = {r.i: (r.f, r.fam) for r in df.select("i", parsing.fidelity(F.col("r")).alias("f"), lexicon.error_family(parsing.judgment(F.col("r"))).alias("fam")).collect()}
    assert got == {0: (0.8, "negation loss"), 1: (None, "novel"), 2: (1.0, "novel"), 3: (None, "novel"), 4: (None, "novel")}
    assert parsing.first_object('x {"a": {"b": [1,]},} y }') == '{"a": {"b": [1]}}' and parsing.first_object("{") is None
    assert parsing.first_object('```json\n{"a": "}{ ,]", "b": "\\",}"}\n```') == '{"a": "}{ ,]", "b": "\\",}"}' and parsing.first_object(None) is parsing.first_object("none") is None


def test_ready_and_prices(spark):
    g = spark.createDataFrame([(0, "a", "DONE", []), (1, "b", "OPEN", ["a"]), (2, "c", "OPEN", ["b", "x"])], "ord int, name string, status string, prereqs array<string>")
    assert {r.name: r.ready for r in summaries.ready(g).collect()} == {"a": True, "b": True, "c": False} and summaries.next_node(g, "ord").first().name == "b"
    prices = spark.createDataFrame([("m-x", 1.0, 0), ("big-one-2", 2.0, 1), ("big-one-3", 3.0, 2)], "id string, prompt double, ord int")
    use = spark.createDataFrame([("m-x",), ("v/m-x",), ("v/big-one",), ("none",)], "model string")
    assert {r.model: (r.id, r.match_level) for r in summaries.price_lookup(use, "model", prices, "id", "ord").collect()} == {"m-x": ("m-x", 1), "v/m-x": ("m-x", 2), "v/big-one": ("big-one-2", 3), "none": (None, None)}


def brute_prices(models, prices):
    """The best (id, level, prompt) of each model, of prices (id, prompt, ord): the last of equal ids has the price, the first the place."""
    place, price, out = {}, {}, {}
    for i, x, o in sorted(prices, key=lambda p: p[2]):
        place.setdefault(i, o)
        price[i] = x
    prices = [(i, price[i], o) for i, o in place.items()]
    for model in models:
        last = model.split("/")[-1]
        two = last.split("-")[:2]
        found = [(1 if i == model else 2 if i == last else 3, o, i, x) for i, x, o in prices if i in (model, last) or len(two) == 2 and all(t in i for t in two)]
        out[model] = (lambda level, o, i, x: (i, level, x))(*min(found)) if found else (None, None, None)
    return out


def test_prices_equal_brute_force(spark):
    prices = [(f"{a}-{b}{c}", float(k), 90 - k) for k, (a, b, c) in enumerate((a, b, c) for a in ("big", "low", "big") for b in ("one", "two", "x") for c in ("", "-v2", "-old"))] + [("v/big-one", 99.0, 3), ("solo", 98.0, 2)]
    models = [f"{v}{a}-{b}{c}" for v in ("", "v/", "a/b/") for a in ("big", "low", "none") for b in ("one", "two") for c in ("", "-v2", "-v3")] + ["solo", "v/solo", "one-big", "nothing", "", "-"]
    found = summaries.price_lookup(spark.createDataFrame([(m,) for m in models * 2] + [(None,)], "model string"), "model", spark.createDataFrame(prices + [(None, 1.0, 0)], "id string, prompt double, ord int"), "id", "ord").collect()
    assert {r.model: (r.id, r.match_level, r.prompt) for r in found if r.model is not None} == brute_prices(models, prices) and len(found) == len(set(models)) + 1


def test_every_part_is_priced(spark, sf_dir):
    from loomtext.plans import queries

    parts = sorted((r.p_partkey, r.p_name.replace(" ", "-")) for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect())
    models = {("vendor/" if k % 2 == 0 else "") + n + ("-v2" if k % 3 == 0 else "") for k, n in parts}
    want = brute_prices(models, [(n, k, k) for k, n in parts])
    assert {r.model: (r.id, r.match_level) for r in queries.price_lookup(spark, sf_dir).collect()} == {m: b[:2] for m, b in want.items()}


def test_sources_and_sinks(spark, tmp_path):
    for name, body in {"a_krama.json": {"passage_id": "p1", "source": {"source_text": "śiva text"}, "stages": {"T1": {"close_translation": "Homage to the lord"}}}, "b.json": {"passage_id": "p2", "source": {"source_text": "s"}, "stages": {"L2": ["one", "two"]}}, "c.json": {"passage_id": "p3", "source": {"source_text": ""}}}.items():
        (tmp_path / "rec").mkdir(exist_ok=True)
        (tmp_path / "rec" / name).write_text(json.dumps(body))
    got = gold.records(spark, str(tmp_path / "rec"))
    assert [(r.passage_id, r.gold) for r in got.orderBy("ord").collect()] == [("p1", "Homage to the lord"), ("p2", "one two")] and gold.records(spark, str(tmp_path / "rec"), gold.GOLD_STAGES).count() == 1
    (tmp_path / "x.sa").write_text("a\n\nc\nd\n")
    (tmp_path / "x.en").write_text("A\nB\nC\n")
    assert [(r.source, r.passage_id) for r in gold.line_pairs(spark, str(tmp_path / "x.sa"), str(tmp_path / "x.en"), "t").orderBy("ord").collect()] == [("a", "t:0"), ("c", "t:2")]
    (tmp_path / "p.jsonl").write_text('{"sanskrit": "s", "english": "a long enough gold"}\n\n{bad\n{"sanskrit": "t", "english": "short"}\n')
    pairs = gold.json_pairs(spark, str(tmp_path / "p.jsonl"))
    assert pairs.count() == 2 and gold.clean(gold.exemplars(got, pairs)).count() == 2
    runs = spark.createDataFrame([("k", [str(i) for i in range(30)])], "run_signature string, raw_outputs array<string>")
    for _ in range(2):
        sinks.record_runs(runs, str(tmp_path / "runs"))
    [r] = sinks.read_runs(spark, str(tmp_path / "runs")).collect()
    assert len(r.raw_outputs) == 20
    reg = steps.benchmark_registry(spark.createDataFrame([("text", "Yoga", "f1")], "source string, school string, source_id string"))
    assert sinks.freeze(reg, str(tmp_path / "reg"), "1").first() == sinks.freeze(reg, str(tmp_path / "reg2"), "1").first()


def test_choices_do_not_depend_on_partitions(spark):
    df = spark.range(500).select("id", F.pmod("id", F.lit(3)).alias("g"), F.pmod(F.col("id") * 7, F.lit(11)).cast("double").alias("s"))
    for f in (lambda d: select.cap_per_group(d, ["g"], ["id"], 4), lambda d: select.seeded_sample(d, "id", 20), lambda d: select.best_trial(d, ["g"], F.col("s"), "id")):
        assert sorted(map(tuple, f(df.repartition(5)).collect())) == sorted(map(tuple, f(df.coalesce(1)).collect()))


def test_stream_of_a_ledger(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.jsonl").write_text('{"ts": "2024-01-01T00:01:00", "step": "eval"}\n{bad\n{"ts": "2024-01-01T00:02:00", "step": "eval"}\n')
    q = stream.step_windows(stream.read_stream(spark, str(tmp_path / "l"))).writeStream.outputMode("update").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.step, r.n) for r in spark.sql("SELECT * FROM w").collect()] == [("eval", 2)]
