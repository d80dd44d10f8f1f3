"""Filter audit, hard negatives and secret scans against plain versions, with every kind of odd row."""

import base64
import hashlib
import json
import math
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import audit, negatives, queries, secret_scan

LONG = " ".join(f"w{i % 400}" for i in range(30_000))


# --- filter audit


def plain_masks(docs):
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    out = []
    for d, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), d is not None and d > first[t])
        out.append((d, s or "", "".join(c for c, f in zip("ABCDE", fails) if f)))
    return out


def plain_audit(docs, labels):
    good, toxic = ({d for d, *x in labels if d is not None and x[k] == 1} for k in (0, 1))
    masks, out, shapley = plain_masks(docs), {}, {}
    for part in {p for _, p, _ in masks}:
        own = [(d, m) for d, p, m in masks if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [(d, m) for d, m in left if f in m]
                left = [(d, m) for d, m in left if f not in m]
                past = sum(f in m for _, m in own) - len(gone)
                out[part, order, step] = [len(left), len(gone), past, sum(m == f for _, m in own), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def told(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    rows = df.collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in names) for r in rows}
    assert len(got) == len(rows)
    return got


def test_audit_of_odd_rows(spark):
    docs = [
        (1, None, "a"), (2, "", None), (3, "  \t ", ""), (4, "SHOUTING # words", "a"), (5, "SHOUTING # words", "b"), (5, "SHOUTING # words", "b"), (None, "SHOUTING # words", "b"), (None, None, None),
        (6, LONG, "b"), (7, LONG + " $", "a"), (8, " ".join(f"x{i}" for i in range(300)), "a"), (9, "ñ Ä É " * 120, "a"), (10, "", "a"), (3, "another text", "c"), (11, "one|two", "c"),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (4, 0, 1), (5, 1, None), (6, None, None), (8, 1, 1), (None, 1, 1), (99, 1, 1)]
    frame = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "doc_id long, text string, source string, `a.b` string, mask int, label int")
    told_labels = spark.createDataFrame([(*r, 5) for r in labels], "doc_id long, quality int, toxic int, part int")
    assert told(audit.audit(frame, told_labels)) == plain_audit(docs, labels)
    assert told(audit.audit(frame, told_labels.limit(0))) == plain_audit(docs, [])
    assert audit.audit(frame.limit(0), told_labels).count() == 0


def test_audit_of_random_masks_for_another_number_of_filters(spark):
    rng = random.Random(5)
    rows = [(rng.choice("pq"), rng.randrange(8), rng.randrange(4)) for _ in range(500)]
    sums = audit.parity_sums(spark.createDataFrame(rows, "part string, mask int, label int"), "XYZ")
    assert all(len(r["sums"]) == 8 for r in sums.collect())
    cells = {r["part"]: [tuple(c) for c in r["cells"]] for r in audit.mask_cells(sums, "XYZ").collect()}
    count = lambda p, m, bit: sum(r[0] == p and r[1] == m and (not bit or r[2] & bit != 0) for r in rows)
    assert cells == {p: [(m, *(count(p, m, bit) for bit in (0, 1, 2))) for m in range(8)] for p in "pq"}
    orders = audit.evaluate_orders(audit.mask_cells(sums, "XYZ"), "XYZ")
    assert orders.count() == 2 * 6 * 3
    removed = orders.filter("step = 3").agg(F.sum("kept")).first()[0]
    assert removed == 6 * sum(m == 0 for _, m, _ in rows)


def test_audit_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert told(queries.op12_filter_audit(spark, sf_dir)) == plain_audit(docs, labels)


# --- hard negatives


def plain_negatives(rows, chosen, positives=5, most=10):
    """rows: (id, label, integer vector as tuple), those that take part."""
    dim = max(len(v) for *_, v in rows)
    rows = [(i, c, np.array([*v, *[0] * (dim - len(v))], object)) for i, c, v in rows]
    out = []
    for a in sorted({i for i, *_ in rows} & set(chosen)):
        _, label, v = min((r for r in rows if r[0] == a), key=lambda r: (r[1], tuple(r[2])))
        scored = sorted((-int(np.dot(v, x)), i, c) for i, c, x in rows if i != a)
        for s, i, _ in [r for r in scored if r[2] == label][:positives]:
            fit = [(n, j) for n, j, c in scored if c != label and 30 * -s <= 100 * -n <= 90 * -s][:most]
            out += [(a, i, k, j, -s, -n) for k, (n, j) in enumerate(fit, 1)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("block, page", [(1024, 1024), (3, 7)])
def test_negatives_of_odd_rows(spark, monkeypatch, block, page):
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", block)
    monkeypatch.setattr(negatives, "PAGE", page)
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in rng.normal(0.4, 0.5, 11)]) for i in range(120)]
    rows += [(200 + i, i % 2, [0.5] * 11) for i in range(60)]  # one hot vector, ties
    rows += [(300, None, [1.0] * 11), (301, 1, None), (302, 1, [1.0, None]), (303, 1, [float("nan")] * 11), (304, 1, [float("inf")]), (None, 1, [1.0] * 11), (305, 1, [2.0, 1.0]), (306, 0, []), (10, 2, [0.25] * 11), (10, 0, [0.75] * 11), (307, -1, [0.5] * 11), (308, 9, [0.5] * 11)]
    frame = spark.createDataFrame([(*r, 1, "s") for r in rows], "vec_id long, label int, embedding array<double>, id int, v string")
    whole = negatives.labelled_vectors(frame, "vec_id", "embedding", F.col("label"), 256)
    fine = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    used = [(i, c, tuple(math.floor(256 * x) for x in v)) for i, c, v in rows if i is not None and c is not None and fine(v)]
    assert sorted((r.id, r.label, tuple(r.v)) for r in whole.collect()) == sorted(used)
    got = mined(negatives.hard_negatives(whole, whole.filter("id % 10 = 0 OR id > 304")))
    want = plain_negatives(used, [i for i, *_ in used if i % 10 == 0 or i > 304])
    assert got == want and len({a for a, *_ in want}) > 15
    assert mined(negatives.hard_negatives(whole.limit(0), whole.limit(0))) == [] == mined(negatives.hard_negatives(whole, whole.limit(0)))


def test_bounds_hold_every_score_and_spare_some(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(0, 200, (12, 40))
    v = np.rint(centres[rng.integers(0, 12, 3000)] + rng.normal(0, 12, (3000, 40))).astype(np.int64)
    frame = spark.createDataFrame([(i, 0, row.tolist()) for i, row in enumerate(v)], "id long, label long, v array<long>")
    books = negatives.fit_books(frame, 40)
    assert books.shape == (negatives.SUBSPACES, negatives.CENTROIDS, 5)
    shared = spark.sparkContext.broadcast(books)
    batches = [r for b in negatives._encoder(shared, 40)(iter(_batches(v))) for r in b.to_pylist()]
    assert sum(len(negatives._Pages(r, 40).ids) for r in batches) == 3000
    anchors = v[:50]
    tables, norms = negatives._tables(anchors, books)
    spared = total = 0
    for r in batches:
        p = negatives._Pages(r, 40)
        low, high = p.bounds(tables, norms, np.arange(50), np.arange(len(p.ids)))
        scores = anchors @ p.vectors.T
        assert (low <= scores).all() and (scores <= high).all()
        spared, total = spared + (high < np.sort(scores, axis=1)[:, -10:-9]).sum(), total + scores.size
    assert spared > 0.5 * total  # of clustered vectors most need no exact score


def _batches(v):
    import pyarrow as pa

    yield pa.RecordBatch.from_pylist([{"id": i, "label": 0, "v": row.tolist()} for i, row in enumerate(v)])


def test_a_wide_component_and_a_wide_score_are_errors(spark):
    wide = spark.createDataFrame([(1, 1, [float(2**45)])], "vec_id long, label int, embedding array<double>")
    with pytest.raises(Exception, match="component of 2\\*\\*40"):
        negatives.labelled_vectors(wide, "vec_id", "embedding", F.col("label"), 256).collect()
    big = spark.createDataFrame([(k, 1, [float(2**39)] * 3) for k in range(3)], "vec_id long, label int, embedding array<double>")
    whole = negatives.labelled_vectors(big, "vec_id", "embedding", F.col("label"), 256)
    with pytest.raises(Exception, match="64-bit"):
        negatives.hard_negatives(whole, whole)


def test_negatives_query(spark, sf_dir):
    rows = []
    for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect():
        if r.label is not None and r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding):
            rows.append((r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, tuple(math.floor(256 * x) for x in r.embedding)))
    assert mined(queries.op11_hard_negatives(spark, sf_dir)) == plain_negatives(rows, [i for i, *_ in rows if i % 100 == 0])


# --- secrets


def der(tag, body):
    n = len(body)
    head = bytes([n]) if n < 128 else bytes([128 + (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8)
    return bytes([tag]) + head + body


def integer(x):
    return der(2, x.to_bytes(x.bit_length() // 8 + 1))


def sequence(*parts):
    return der(0x30, b"".join(parts))


def rsa(bits=1024, seed=1):
    rng = random.Random(seed)
    n, p = rng.getrandbits(bits) | 1 << (bits - 1), lambda: rng.getrandbits(bits // 2) | 1 << (bits // 2 - 1)
    return sequence(integer(0), integer(n), integer(65537), integer(rng.getrandbits(bits) | 1 << (bits - 2)), *(integer(p()) for _ in range(5)))


RSA_OID, EC_OID, CURVE, ED_OID, PBES2 = (bytes.fromhex(x) for x in ("06092a864886f70d010101", "06072a8648ce3d0201", "06082a8648ce3d030107", "06032b6570", "06092a864886f70d01050d"))
SEC1 = sequence(integer(1), der(4, bytes(range(32))), der(0xA0, CURVE), der(0xA1, der(3, b"\0\4" + bytes(64))))
KEYS = {
    "pkcs1": rsa(), "pkcs8": sequence(integer(0), sequence(RSA_OID, b"\5\0"), der(4, rsa(2048, 2))), "sec1": SEC1, "dsa": sequence(integer(0), *(integer(1 << b | 1) for b in (1023, 159, 1022, 1021, 158))),
}
MORE_PKCS8 = [sequence(integer(0), sequence(ED_OID), der(4, der(4, bytes(32)))), sequence(integer(0), sequence(EC_OID, CURVE), der(4, SEC1)), sequence(sequence(PBES2, sequence(b"\5\0")), der(4, bytes(64)))]


def ssh_string(x):
    return len(x).to_bytes(4) + x


def openssh(check=b"abcdabcd", cipher=b"none"):
    inner = check + ssh_string(b"ssh-ed25519") + bytes(49)
    inner += bytes(-len(inner) % 8)
    return b"openssh-key-v1\0" + ssh_string(cipher) + ssh_string(b"none") + ssh_string(b"") + (1).to_bytes(4) + ssh_string(ssh_string(b"ssh-ed25519") + ssh_string(bytes(32))) + ssh_string(inner)


def url64(x):
    return base64.urlsafe_b64encode(x).decode().rstrip("=")


def jwt(alg="HS256", size=32, body=b'{"sub":"1"}', head=None):
    return ".".join(map(url64, (head or json.dumps({"alg": alg, "typ": "JWT"}).encode(), body, bytes(range(200, 200 + 32)) * 20))) [: len(url64(head or json.dumps({"alg": alg, "typ": "JWT"}).encode())) + len(url64(body)) + 2 + -(-size * 4 // 3)]


def pem(data, width=64, turn="\n"):
    text = base64.b64encode(data).decode()
    return turn.join(text[k : k + width] for k in range(0, len(text), width))


def confirmed(text):
    return [s for s in secret_scan.secrets(text) if s[0] not in secret_scan.PATTERNS]


@pytest.mark.parametrize("kind, data", [*KEYS.items(), *(("pkcs8", k) for k in MORE_PKCS8), ("openssh", openssh()), ("openssh", openssh(b"abcdefgh", b"aes256-ctr"))])
def test_keys_are_told_in_every_writing(kind, data):
    flat = base64.b64encode(data).decode()
    for before, code, after in (
        ("é -----BEGIN KEY-----\n", pem(data), "\n-----END KEY-----"), ("\r\n", pem(data, 76, "\r\n"), ""), ("k: ", flat, " and more"), ('{"k":"-----BEGIN-----\\n', pem(data, 64, "\\n"), '\\n-----END-----"}'),
        ("  ", url64(data), "\n\nMore"), ("", data.hex(), ""), ("x=", data.hex().upper(), ";"), ("    ", pem(data, 64, "\n    "), "\n"), ("", pem(data, 10_000), "."),
    ):
        assert confirmed(before + code + after) == [(kind, len(before), len(before) + len(code))], (before, after)


@pytest.mark.parametrize("data", [*KEYS.values(), MORE_PKCS8[0], openssh()])
def test_what_does_not_parse_is_not_told(data):
    rng = random.Random(4)
    for _ in range(40):
        cut = rng.randrange(20, len(data) - 3)
        broken = data[:cut]
        assert confirmed(base64.b64encode(broken).decode()) == [] == confirmed(broken.hex())
    longer = bytes([data[0], *data[1:]]) + b"\1\2\3"
    assert confirmed(base64.b64encode(longer).decode()) == [] == confirmed(longer.hex())
    assert confirmed("A" + base64.b64encode(data).decode()) == [] == confirmed("0" + data.hex())
    certificate = sequence(sequence(integer(1), sequence(RSA_OID)), sequence(RSA_OID, b"\5\0"), der(3, bytes(65)))
    public = sequence(sequence(RSA_OID, b"\5\0"), der(3, bytes(140)))
    assert confirmed(base64.b64encode(certificate).decode()) == [] == confirmed(public.hex() + " " + base64.b64encode(public).decode())
    assert confirmed(base64.b64encode(openssh(b"abcdefgh")).decode()) == []  # unencrypted, but the two numbers differ


def test_signed_tokens():
    for alg, size in (("HS256", 32), ("HS384", 48), ("HS512", 64), ("ES256", 64), ("ES512", 132), ("RS256", 256), ("PS512", 512), ("EdDSA", 64)):
        token = jwt(alg, size)
        assert confirmed(f"Bearer {token}, next") == [("jwt", 7, 7 + len(token))]
        assert confirmed(f"example1234.{token}") == [("jwt", 12, 12 + len(token))]
    for wrong in (jwt("HS256", 31), jwt("none", 32), jwt("HS256", 32, b"[1]"), jwt(head=b'{"typ":"JWT"}'), jwt(head=b'{"alg": 5}'), jwt(head=b'{"alg":"HS256"'), jwt(body=b"{" * 50_000), "eyJhbGciOi.a.b", "x" + jwt(), "e." * 1000):
        assert confirmed(wrong) == []


def plain_base(text):
    """The three plain kinds by a walk from place to place."""
    out, at = [], 0
    word = re.compile("password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)
    value = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
    while at < len(text):
        m = word.match(text, at)
        k = m.end() if m else at
        if m:
            k += text[k : k + 1] in ('"', "'") and k < len(text)
            while text[k : k + 1] == " ":
                k += 1
        if m and text[k : k + 1] in (":", "="):
            k += 1
            while text[k : k + 1] == " ":
                k += 1
            k += text[k : k + 1] in ('"', "'") and k < len(text)
            end = k
            while end < len(text) and text[end] in value:
                end += 1
            if end > k:
                out += [("assign", at, end)] if end - k >= 6 else []
                at = end
                continue
        at += 1
    for kind, ok, head, least in (("access", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "AKIA", 20), ("hex", "0123456789abcdef", "", 24)):
        at = 0
        while at < len(text):
            end = at + len(head)
            if text.startswith(head, at):
                while end < len(text) and text[end] in ok:
                    end += 1
            if end > at + len(head):
                out += [(kind, at, end)] if end - at >= least else []
                at = end
            else:
                at += 1
    return out


def told_row(doc_id, text):
    base, order = plain_base(text or ""), {k: i for i, k in enumerate(secret_scan.KINDS)}
    joined = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order[s[0]])))
    extra = confirmed(text or "")
    return (doc_id, *(sum(s[0] == k for s in base) for k in ("assign", "access", "hex")), hashlib.sha256(joined(base).encode()).hexdigest(), joined([*base, *extra]), len(extra))


def scanned(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed")) for r in df.collect()), key=str)


ODD = [
    None, "", " ", "secret=token:abcdefgh", "token=abcde secret = 'abcdef'", 'API_KEY"  :  "ab/c+d.e=-_"', "ſecret=abcdefgh toKen=abcdefg apikey:1234567", "AKIAAKIA" + "A" * 11, "AKIA" + "B" * 16 + "AKIA" + "C" * 15,
    "é" * 5 + "0123456789abcdef01234567" + "ñ", "0123456789abcdef0123456", "password=" + "f" * 40, "token" + " " * 50_000 + "=" + "x" * 9, "f" * 200_000, "password" * 20_000, pem(KEYS["pkcs1"]) + " secret=" + jwt() + " " + KEYS["sec1"].hex(), "á passwd='ünicode' passwd='asciionly'",
]


def test_scan_of_odd_rows(spark, tmp_path):
    rows = [(k, t, "x", "y") for k, t in enumerate(ODD)] + [(None, "secret=abcdefgh", "x", "y"), (3, ODD[3], "x", "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, secrets string")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert scanned(queries.op13_secret_scan(spark, str(tmp_path))) == sorted((told_row(d, t) for d, t, *_ in rows), key=str)
    assert secret_scan.scan(frame.limit(0)).count() == 0
    assert sum(len(confirmed(t or "")) for t in ODD) == 3


def test_secrets_are_found_in_linear_time():
    line = "MIIE" + "A" * 60 + "\n"
    assert confirmed(line * 3000) == []
    key = pem(KEYS["pkcs1"])
    assert len(confirmed("\n\n".join([key] * 50))) == 50


def test_secret_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert scanned(queries.op13_secret_scan(spark, sf_dir)) == sorted((told_row(d, t) for d, t in rows), key=str)
