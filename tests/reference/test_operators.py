"""Operators in several forms, or against plain Python."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.functions import provenance, text
from loomtext.operators import graph, hypotheses, parallels, ranges, rank, registry, search, select, summaries
from loomtext.plans import steps
from loomtext.sources import gold, lines, sinks


def plain_gamma(rows, k):
    """rows: (passage, i, m, v, j); k: the metric's place."""
    out = {}
    for p in {r[0] for r in rows}:
        own = [(r[k], r[4]) for r in rows if r[0] == p and r[k] is not None and r[4] is not None]
        signs = [(a - c) * (b - d) for i, (a, b) in enumerate(own) for c, d in own[:i]]
        up, down = sum(s > 0 for s in signs), sum(s < 0 for s in signs)
        out[p] = (up + down, round((up - down) / (up + down), 9) if up + down else 0.0)
    return out


@pytest.mark.parametrize("block", [1 << 16, 64, 17])
@pytest.mark.parametrize("levels", [4, 10_000])
def test_gamma_by_counts_equals_gamma_by_pairs(spark, monkeypatch, block, levels):
    monkeypatch.setattr(rank, "BLOCK", block)
    rnd = random.Random(levels)
    passages = "a" * 12 + "bcdefgh"  # a hot one
    rows = [(rnd.choice(passages), i, rnd.choice([None, 1.0, 2.0, 2.5, 7.0]), float(rnd.randrange(2000)), rnd.choice([None, *map(float, range(levels))])) for i in range(600)]
    rows += [("lone", 900, 1.0, 2.0, 3.0), ("lost", 901, None, 1.0, None), (None, 902, 1.0, 2.0, 3.0), (None, 903, 2.0, 1.0, 4.0)]
    df = spark.createDataFrame(rows, "p string, i int, m double, v double, j double")
    got = {(r.p, r.metric): (r.n_pairs, round(r.gamma, 9)) for r in rank.gamma(df, ["p"], "i", ["m", "v"], "j").collect()}
    assert got == {(p, m): x for m, k in (("m", 2), ("v", 3)) for p, x in plain_gamma(rows, k).items()}
    assert rank.gamma(df.limit(0), ["p"], "i", ["m"], "j").count() == 0


def test_greater_before():
    rnd = random.Random(2)
    for n in (0, 1, 2, 3, 7, 8, 33, 100):
        v, w = np.array([rnd.randrange(9) for _ in range(n)], np.int64), np.array([rnd.randrange(1, 5) for _ in range(n)], np.int64)
        assert rank.greater_before(v, w).tolist() == [int(w[:k][v[:k] > v[k]].sum()) for k in range(n)]


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_running_sums_are_carried_over_ranges(spark, parts):
    rnd = random.Random(parts)
    rows = [(rnd.choice(["hot"] * 8 + ["x", "y", None]), rnd.randrange(50), i, rnd.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, k int, i int, w int")
    laid = ranges.laid_out(df, ["g", "k", "i"], parts)
    assert laid.agg(F.count_distinct("_part")).first()[0] == parts
    got = {r.i: (r.n, r.s) for r in ranges.running(laid, ["g"], {"n": F.lit(1), "s": F.col("w")}).collect()}
    for g in ("hot", "x", "y", None):
        own = sorted((k, i, w) for p, k, i, w in rows if p == g)
        assert [got[i] for _, i, _ in own] == [(n, sum(w for *_, w in own[:n])) for n in range(len(own))]
    order = [r.i for r in ranges.numbered(df, ["k", "i"], parts=parts).orderBy("_n").collect()]
    assert order == [i for _, i in sorted((k, i) for _, k, i, _ in rows)]
    assert ranges.numbered(df.limit(0), ["k", "i"], ["g"]).count() == 0


def test_wins_by_counts_equal_wins_by_pairs(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice("aaaab"), i, rnd.choice([None, round(rnd.random(), 2), 0.5])) for i in range(150)] + [("lone", 900, 0.1), ("none", 901, None)]
    df = spark.createDataFrame(rows, "p string, i int, v double")
    counted = sorted(tuple(r) for r in rank.margin_wins(df, ["p"], "i", "v", 0.05).select("p", "i", "points", "norm").collect())
    some = df.filter("v IS NOT NULL")
    verdict = F.when(F.col("b_v") < F.col("a_v") - 0.05, "A").when(F.col("a_v") < F.col("b_v") - 0.05, "B")
    assert counted == sorted(tuple(r) for r in rank.pairwise_wins(some, ["p"], "i", verdict, ["v"]).select("p", "i", "points", "norm").collect())
    assert ("lone", 900, 0.0, 0.0) in counted and len(counted) == some.count()
    points = {(p, i): sum(1 if w < v - 0.05 else 0 if v < w - 0.05 else 0.5 for q, j, w in rows if q == p and j != i and w is not None) for p, i, v in rows if v is not None}
    assert {(p, i): x for p, i, x, _ in counted} == points
    assert rank.margin_wins(df.limit(0), ["p"], "i", "v", 0.05).count() == 0


def tree(hashes, block):
    while True:
        hashes = [hashlib.sha256("\x01".join(hashes[k : k + block]).encode()).hexdigest() for k in range(0, len(hashes), block)]
        if len(hashes) == 1:
            return hashes[0]


@pytest.mark.parametrize("block", [1024, 5, 2])
def test_set_hash_is_a_tree_of_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(provenance, "BLOCK", block)
    rnd = random.Random(8)
    rows = [(rnd.choice(["hot"] * 9 + ["cold", None]), rnd.randrange(40), f"text {i % 70}", None if i % 9 == 0 else i) for i in range(130)] + [("one", 1, "x", 1)]
    df = spark.createDataFrame(rows, "k string, o int, t string, n int")
    got = {r.k: r.set_hash for r in provenance.set_hash(df.repartition(5), ["k"], ["o"], ["t", "n"]).collect()}
    own = lambda t, n: hashlib.sha256(f"{t}\x01{'' if n is None else n}".encode()).hexdigest()
    assert got == {k: tree([h for _, h in sorted((o, own(t, n)) for p, o, t, n in rows if p == k)], block) for k in {r[0] for r in rows}}
    assert provenance.set_hash(df.limit(0), ["k"], ["o"], ["t"]).count() == 0


@pytest.mark.parametrize("block", [4 << 20, 40])
def test_references_of_the_last_contained_entry(spark, monkeypatch, block):
    monkeypatch.setattr(parallels, "BLOCK_BYTES", block)
    passages = [(1, "a red fox", ["old"]), (2, "nothing", ["kept"]), (3, None, ["none"]), (4, "red", []), (5, "", ["blank"]), (6, "éclair rouge", [])]
    refs = [("red", ["r1"], 1), ("fox", ["r2"], 2), ("ed f", ["r0"], 0), ("red", ["r3", "x"], 3), ("no such", ["r9"], 9), ("fox", [], 8), (None, ["n"], 7), ("clair", ["é"], 4)]
    df = spark.createDataFrame(passages, "id int, source string, old array<string>")
    r = spark.createDataFrame(refs, "s string, refs array<string>, o int")
    got = {x.id: x.references for x in parallels.attach_references(df, "id", "source", r, "s", "refs", "o", "old").collect()}
    assert got == {1: ["r3", "x"], 2: ["kept"], 3: ["none"], 4: ["r3", "x"], 5: ["blank"], 6: ["é"]}
    every = r.unionByName(spark.createDataFrame([("", ["all"], 2), ("Zed", ["z"], 3), ("red", ["r3", "w"], 3)], r.schema))
    got = {x.id: x.references for x in parallels.attach_references(df, "id", "source", every, "s", "refs", "o", "old").collect()}
    assert got[2] == got[5] == ["all"] and got[1] == ["r3", "x"] and got[3] == ["none"]  # of equal orders and sources the larger references


def test_shared_grams_with_and_without_a_broadcast(spark, monkeypatch):
    a = spark.createDataFrame([(1, "one two three four"), (2, "x")], "k int, t string")
    b = spark.createDataFrame([(7, "Zero one two three FOUR"), (8, "one two three"), (9, None)], "d int, t string")
    look = lambda: sorted(tuple(r) for r in parallels.shared_grams(a, "k", "t", b, "d", "t").select("k", "d", "n_shared", "rank").collect())
    want = [(1, 7, 2, 1), (1, 8, 1, 2)]
    assert look() == want
    monkeypatch.setattr(parallels, "MOST_GRAMS", 0)
    assert look() == want


def test_lines_are_numbered_over_splits(spark, tmp_path):
    rows = [f"line {i} " + "x" * (i % 90) + ("\r" if i % 7 == 0 else "") for i in range(4000)]
    (tmp_path / "a b.txt").write_bytes(("\n".join(rows) + "\n").encode())
    (tmp_path / "c.txt").write_bytes(b"only\n\nthird")
    (tmp_path / "none.txt").write_bytes(b"")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        df = lines.numbered_files(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 5
        got = {(r.file, r.i): r.line for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {**{("a b.txt", i): x.rstrip("\r") for i, x in enumerate(rows)}, ("c.txt", 0): "only", ("c.txt", 1): "", ("c.txt", 2): "third"}


def test_bleu_of_long_texts(spark):
    rnd = random.Random(2)
    pairs = [([rnd.choice("abcdef") * rnd.randrange(1, 4) for _ in range(rnd.randrange(60))], [rnd.choice("abcxyz") * rnd.randrange(1, 4) for _ in range(rnd.randrange(60))]) for _ in range(40)]
    import math

    def slow(r, c):
        return round(math.exp(min(0, 1 - len(r) / len(c))) * sum(t in set(r) for t in c) / len(c), 4) if r and c else 0.0

    df = spark.createDataFrame([(i, " ".join(r), " ".join(c)) for i, (r, c) in enumerate(pairs)], "i int, r string, c string")
    got = {x.i: x.b for x in df.select("i", text.bleu1(text.words(F.col("r")), text.words(F.col("c"))).alias("b")).collect()}
    assert got == {i: slow(r, c) for i, (r, c) in enumerate(pairs)}


def test_hypotheses(spark):
    schema = "ord int, semantic double, chrf double, judgment string"
    none = spark.createDataFrame([(1, 0.9, 0.9, "negation lost"), (2, 0.1, 0.1, ""), (3, None, None, "scope")], schema)
    assert [r.family for r in hypotheses.proposed(hypotheses.low_rows(none, "semantic", "chrf", "judgment"), "judgment", "ord").collect()] == [hypotheses.GENERAL]
    some = none.unionByName(spark.createDataFrame([(4, 0.2, 0.9, "NEGATION lost"), (5, 0.9, 0.2, "odd " * 30), (6, 0.1, 0.1, "other")], schema))
    plan = steps.STEPS["hypothesis"](some, "judgment", "ord")
    assert [(r.family, r.hint) for r in plan.orderBy("ord").collect()] == [("negation loss", hypotheses.KNOWN["negation loss"]), ("novel: " + ("odd " * 30)[:40], hypotheses.NOVEL_HINT)]
    golds = spark.createDataFrame([(i, "source text", "gold text here") for i in range(3)], "i int, source string, gold string")
    tried = hypotheses.trials(plan, golds).withColumn("candidate", F.when(F.col("ord") > 5, "gold text here").otherwise("else"))
    best = hypotheses.best_of_round(hypotheses.outcomes(tried).withColumn("round", F.lit(1)), ["round"]).collect()
    assert tried.count() == 6 and [(r.kept, round(r.score, 4)) for r in best] == [(True, 1.0)]


def test_registry_steps(spark, tmp_path):
    golds = spark.createDataFrame([("s", "g")], "source string, gold string")
    renders = spark.createDataFrame([("one two three", "g", "other words here", "plain", 0.9), ("s", "g", "g", "plain", 0.9), ("s", "g", "low", "plain", 0.1)], "source string, gold string, candidate string, register string, semantic double")
    got = sorted((r.register, r.source, r.output) for r in steps.STEPS["finetune"](golds, renders).collect())
    assert got == [("natural", "gold", "g"), ("plain", "render", "other words here")]
    a = spark.createDataFrame([("k", "1"), ("l", "2"), ("m", "3")], "k string, h string")
    b = spark.createDataFrame([("k", "1"), ("l", "9"), ("n", "4")], "k string, h string")
    assert {r.k: r.verdict for r in registry.compare_baseline(a, b, "k", "h").collect()} == {"k": "reproducible", "l": "differs", "m": "no baseline", "n": "not computed"}
    raw = [("f", 0, json.dumps({"step": "s"})), ("f", 1, " "), ("f", 2, "{"), ("f", 3, json.dumps({"step": 1})), ("g", 0, json.dumps({"other": 1})), ("g", 1, json.dumps({"step": 1, "ts": "2024-01-01T0"}))]
    df = spark.createDataFrame(raw, "file string, i int, line string")
    found = registry.file_violations(df, "file", "i", "line", "AGENT_RUN", "step")
    assert sorted(r.message for r in found.collect()) == ["f: invalid JSON", "f:0: missing ts", "g:1: bad type step"]
    assert {r.file: r.n_violations for r in registry.file_totals(df, "file", found).collect()} == {"f": 2, "g": 1}
    written = lambda *rows: sinks.write_files(spark.createDataFrame(rows, "name string, text string"), str(tmp_path / "x"))
    written(("a.json", "x"), ("b c#1%.txt", "two\nlines"), ("d+é=.json", None))
    written(("a.json", "new"))  # replaces that document alone
    assert {r.file: r.text for r in lines.read_files(spark, str(tmp_path / "x")).collect()} == {"a.json": "new\n", "b c#1%.txt": "two\nlines\n", "d+é=.json": "\n"}
    assert sorted((r.file, r.i) for r in lines.numbered_files(spark, str(tmp_path / "x")).collect()) == [("a.json", 0), ("b c#1%.txt", 0), ("b c#1%.txt", 1), ("d+é=.json", 0)]
    assert len(steps.STEPS) == 20 and len(set(steps.STEPS.values())) == 20


def test_reports(spark):
    runs = spark.createDataFrame([(f"{k}" * 64, f"claim {k}") for k in range(7)], "run_signature string, assertion string")
    trials = spark.createDataFrame([("EXP-000000000001", 0.5, 0.25, None)], "experiment_id string, avg_chrF double, avg_bleu1 double, avg_semantic double")
    text_ = sinks.report(None, sinks.report_values(runs, trials, "2026"))
    assert "Runs: 7, experiments: 1 (2026)" in text_ and "000000000001 & 0.500 & 0.250 & —" in text_ and "claim 2 (run 222222222222)" in text_ and "claim 3" not in text_ and "@" not in text_
    none = sinks.report_values(runs.limit(0), trials.limit(0), "2026")
    assert none["RUN_SIGNATURES"] == none["ASSERTION_CITATIONS"] == "—" and none["N_EXP"] == "0"


def test_every_step_runs(spark, tmp_path):
    pairs = spark.createDataFrame([("śivāya namaḥ", "Homage to Shiva", "Homage to Shiva", 1, "m-x", 0.6, 2.0, "p", 1.0)], "source string, candidate string, gold string, i int, model string, semantic double, latency double, passage string, judge double")
    prices = spark.createDataFrame([("m-x", 1e-5, 2e-5, 0)], "id string, prompt double, completion double, ord int")
    lines_ = spark.createDataFrame([('{"step": "s", "ts": "2024-01-01T0"}',), ("{",)], "value string")
    x = steps.STEPS["benchmark_report"](pairs.withColumn("avg_semantic", F.col("semantic")), prices).first()
    assert (x.cost, x.cost_per_1000, x.quality_per_cost) == (0.25, 250.0, 0.0024)
    assert steps.STEPS["watchdog"](lines_, pairs, ["model"]).first().n_invalid == 1
    assert steps.STEPS["comet"](pairs).first().comet is None and steps.STEPS["benchmark"](pairs, "passage", "i", "judge").count() == 4
    assert [r.n for r in steps.STEPS["gold"](spark.createDataFrame([("Krama",)], "tradition string")).orderBy("n").collect()] == [0, 0, 0, 1]
    r = steps.audit(pairs).first()
    assert r.gate == "PASS" and all(r.checks.values()) and len(r.checks) == 5
    nodes = spark.createDataFrame([(0, "a", "DONE", []), (1, "b", "OPEN", ["a"])], "ord int, name string, status string, prereqs array<string>")
    assert {r.name: r.next for r in steps.STEPS["checkpoints"](nodes).collect()} == {"a": False, "b": True}
    events = spark.createDataFrame([("s", "k", "1", 0, "Old"), ("s", "k", "2", 0, "new thing")], "step string, key string, ts string, ord int, raw string")
    assert steps.STEPS["memory"](events).first().raw == "new thing" and steps.STEPS["memory"](events, "OLD").first().ts == "1"
    assert steps.STEPS["report"](spark.createDataFrame([("a", 0.1), ("b", None), ("c", 0.4)], "experiment_id string, avg_chrF double")).first().experiment_id == "c"
    files = spark.createDataFrame([("yoga-1.txt", "# head\nsamādhi and dhyāna"), ("none.txt", "x")], "file string, text string")
    assert [(r.school, r.n_terms) for r in steps.STEPS["sanskrit_texts"](files).collect()] == [("Yoga", 2)]
    assert steps.run([str(tmp_path / "l")], "proof", pairs).count() == 1 and spark.read.json(str(tmp_path / "l")).first().step == "proof"
    assert provenance.state(str(tmp_path)) == {"commit": None, "branch": None, "dirty": None}
    assert summaries.server_health(spark).first().status == "ok"
    tried = spark.createDataFrame([("s", -1, 0, 0.4), ("s", 2, 1, 0.8), ("s", 3, 2, None)], "s string, strategy int, ord int, fidelity double")
    found = steps.STEPS["tree_search"](tried, ["s"]).first()
    assert (found.path, found.strategy, found.root_score, found.best_score, found.improved) == ([0], 2, 0.4, 0.8, True) and "glossary" in found.hint


def plain_tree(scores, depth, fanout, strategies):
    """(path, strategy, score, kept) of every node, by a tree of lists."""
    root = [(), -1, scores.get(-1, 0.0), True]
    nodes, frontier = [root], [root]
    for d in range(1, depth + 1):
        children = [[(*p[0], i), (d * fanout + i) % strategies, scores.get((d * fanout + i) % strategies, 0.0), False] for p in frontier for i in range(fanout)]
        frontier = sorted(children, key=lambda n: -n[2])[:fanout]
        for n in frontier:
            n[3] = True
        nodes += children
    return sorted(map(tuple, nodes))


@pytest.mark.parametrize("depth, fanout", [(0, 2), (1, 1), (2, 2), (4, 3), (2, 7)])
def test_tree_search_of_many_searches(spark, depth, fanout):
    rnd = random.Random(depth * 10 + fanout)
    scores = {s: {k: rnd.choice([0.0, 0.25, 0.5, 1.0]) for k in range(-1, 6) if rnd.random() < 0.8} for s in ("a", "b", "c", None)}
    scores["a"][-1] = 0.5
    df = spark.createDataFrame([(s, k, x) for s, own in scores.items() for k, x in own.items()], "s string, strategy int, score double")
    nodes = search.tree_search(df, ["s"], depth, fanout)
    got = {}
    for r in nodes.collect():
        got.setdefault(r.s, []).append((tuple(r.path), r.strategy, r.score, r.kept))
        assert r.depth == len(r.path) and (r.parent == r.path[:-1] if r.path else r.parent is None)
    want = {s: plain_tree(own, depth, fanout, 6) for s, own in scores.items() if own}
    assert {s: sorted(n) for s, n in got.items()} == want
    for r in search.best_node(nodes, ["s"]).collect():
        best = max(want[r.s], key=lambda n: (n[2], [-x for x in n[0]] + [1] * (9 - len(n[0]))))  # the first in pre-order
        first = min((n for n in want[r.s] if n[2] == best[2]), key=lambda n: n[0])
        assert (tuple(r.path), r.strategy, r.best_score, r.root_score, r.improved) == (*first[:3], want[r.s][0][2], first[2] > want[r.s][0][2])
    assert search.tree_search(df.limit(0), ["s"], depth, fanout).count() == 0


def reaches(edges):
    out = set(edges)
    while True:
        more = {(a, d) for a, b in out for c, d in edges if b == c} - out
        if not more:
            return out
        out |= more


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_graph_of_checkpoints(spark, seed):
    rnd = random.Random(seed)
    names = [f"n{k}" for k in range(40)]
    needs = {n: {rnd.choice(names[:k]) for _ in range(rnd.randrange(3))} if k else set() for k, n in enumerate(names)}
    needs["n5"] |= {"gone"}
    needs["n3"], needs["n2"] = needs["n3"] | {"n2"}, needs["n2"] | {"n3"} if seed == 1 else needs["n2"]
    needs["n9"] |= {"n9"} if seed == 2 else set()
    state = {n: rnd.choice(["DONE", "DONE", "OPEN", "FAILED"]) for n in names}
    nodes = spark.createDataFrame([(k, n, state[n], sorted(needs[n])) for k, n in enumerate(names)], "ord int, name string, status string, prereqs array<string>")
    edges = {(n, p) for n in names for p in needs[n]}
    every = reaches(edges)
    assert {tuple(r) for r in graph.closure(graph.edges_of(nodes)).collect()} == every
    cyclic = {a for a, b in every if a == b}
    behind = cyclic | {a for a, b in every if b in cyclic}
    level = {}
    for n in names * len(names):
        own = [p for p in needs[n] if p in state]
        if n not in behind and all(p in level for p in own):
            level[n] = max((level[p] + 1 for p in own), default=0)
    unmet = reaches({(n, p) for n, p in edges if state.get(p) != "DONE"})
    ready = {n: all(state.get(p) == "DONE" for p in needs[n]) for n in names}
    following = next((n for n in names if ready[n] and state[n] != "DONE"), None)
    got = {r.name: r for r in steps.checkpoints(nodes).collect()}
    assert {n: (r.ready, r.next, r.level, r.on_cycle, r.n_blockers) for n, r in got.items()} == {n: (ready[n], n == following, level.get(n), n in cyclic, sum(a == n for a, _ in unmet)) for n in names}
    assert {tuple(r) for r in graph.blockers(nodes, graph.edges_of(nodes)).collect()} == unmet
    assert steps.checkpoints(nodes.limit(0)).count() == 0


def test_a_long_chain_takes_few_rounds(spark):
    chain = spark.createDataFrame([(f"n{k}", f"n{k - 1}") for k in range(1, 60)], "name string, prereq string")
    assert graph.closure(chain).count() == 59 * 60 // 2


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace as Fake

    from loomtext.sources import scratch

    def session(master, warehouse, folder=None):
        context = Fake(master=master, getConf=lambda: Fake(get=lambda k: folder), getCheckpointDir=lambda: "set")
        return Fake(sparkContext=context, conf=Fake(get=lambda k: warehouse))

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_folder(session("spark://host:7077", "file:/tmp/warehouse"))
    assert scratch.shared_folder(session("yarn", "hdfs://n/w")) == "hdfs://n/w/_loomtext"
    assert scratch.shared_folder(session("yarn", "file:/w", "s3a://b/c")) == "s3a://b/c"


def test_missing_files_are_empty_frames(spark, tmp_path):
    nowhere = str(tmp_path / "none")
    for load in (gold.json_pairs, gold.records, gold.published, gold.run_records, gold.registry_rows, lines.read_files, lines.numbered_files):
        assert load(spark, nowhere).count() == load(spark, f"{nowhere}/*.json").count() == 0


RECORDS = {
    "a.json": ({"source": {"source_text": "src"}, "stages": {"L2": {"other": "x"}, "T1": "late"}, "passage_id": "p"}, None),
    "b.json": ({"source": {"source_text": "src"}, "stages": {"L2": "", "l2": {}, "T1": [], "t1": "last"}}, ("b.json", "last")),
    "c.json": ({"source": {"source_text": "src"}, "stages": {"L2": ["one", 2, "three"]}, "passage_id": "c"}, ("c", "one 2 three")),
    "d.json": ({"source": {"source_text": "src"}, "stages": {"L2": {"close_translation": "", "translation": "t"}}, "passage_id": "d"}, ("d", "t")),
    "e.json": ({"source": {"source_text": ""}, "stages": {"L2": "x"}, "passage_id": "e"}, None),
    "f.json": ({"source": {"source_text": "src"}, "stages": {"L2": "{text}"}, "passage_id": "f"}, None),
    "g.json": ({"source": {"source_text": "src"}, "stages": {"L2": None, "l2": "[text] as it is"}, "passage_id": "g"}, ("g", "[text] as it is")),
}
PUBLISHED = {
    "a.json": ({"source": "plain", "l2_text": "gold", "id": "a"}, ("a", "plain", "gold")),
    "b.json": ({"source": "", "source_text": "other", "l2_text": "", "l2": "gold"}, ("b.json", "other", "gold")),
    "c.json": ({"source": {"text": "inner"}, "l2": "gold", "id": "c"}, ("c", "inner", "gold")),
    "d.json": ({"source": {"note": "x"}, "source_text": "unused", "l2": "gold", "id": "d"}, None),
    "e.json": ({"source": "s", "id": "e"}, None),
}


def test_records_and_passages_of_every_form(spark, tmp_path):
    for folder, files in (("r", RECORDS), ("p", PUBLISHED)):
        (tmp_path / folder).mkdir()
        for name, (body, _) in files.items():
            (tmp_path / folder / name).write_text(json.dumps(body))
        (tmp_path / folder / "z.json").write_text("{broken")
    got = {(r.passage_id, r.gold) for r in gold.records(spark, str(tmp_path / "r")).collect()}
    assert got == {want for _, want in RECORDS.values() if want}
    assert {(r.passage_id, r.gold) for r in gold.records(spark, str(tmp_path / "r"), gold.GOLD_STAGES).collect()} == {("c", "one 2 three"), ("d", "t"), ("g", "[text] as it is")}
    assert {(r.passage_id, r.source, r.gold) for r in gold.published(spark, str(tmp_path / "p"), 5).collect()} == {want for _, want in PUBLISHED.values() if want}
