"""Operators on pages and vectors."""

import gzip
import hashlib
import json
import zlib

import numpy as np
import pytest

from loomtext.llm import mtree, warc, wrappers

PAGE = """<!DOCTYPE html><html><head><title>t &amp; x</title><script>var a="<p>no</p>";</script><style>p{}</style></head><body>
<nav><ul><li><a href="/1">Home</a><li><a href="/2">News</a></ul></nav><div class="sidebar left"><p>Side</div><div class="ad-box">Buy</div>
<%s><h1>Head %d</h1><p>First   para &eacute;&#39;s <b>bold</b><br>line<p>Second%s</p><form><input>Send</form><!-- c --></%s>
<div id="comments"><p>Reader says</p></div><aside>More</aside><footer>&copy; F</footer></body></html>"""


def page(k, box='div class="content"', end="div"):
    return PAGE % (box, k, " word" * k, end)


def test_main_text_of_a_host(spark):
    rows = [(k, f"http://h.example/{k}", page(k)) for k in range(6)] + [(10, "http://a.example/", page(1, "article", "article")), (11, None, None), (12, "x", ""), (13, "http://b.example", "plain < text &lt;b&gt; only"), (13, "http://b.example", "<p>cut <b>off")]
    df = spark.createDataFrame([(*r, 1, "w") for r in rows], "page_id long, url string, html string, salt int, wrapper string")
    got = {(r.page_id, r.n_chars): r.text for r in wrappers.main_texts(df).collect()}
    for k in range(1, 6):
        want = f"Head {k}\n\nFirst para é's bold line\n\nSecond" + " word" * k
        assert got[k, len(want)] == want
    assert "Head 1\n\nFirst para é's bold line\n\nSecond word" in got.values()
    assert got[11, 0] == got[12, 0] == "" and got[13, 7] == "cut off" and "plain < text <b> only" in got.values()
    assert len(got) == len(rows) and wrappers.main_texts(df.limit(0)).count() == 0


def test_copies_of_a_page_make_no_template(spark):
    rows = [(k, "http://h.example/", page(1)) for k in range(200)] + [(200 + k, "http://h.example/", page(k)) for k in range(2, 5)]
    got = {r.page_id: r.text for r in wrappers.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = "Head %d\n\nFirst para é's bold line\n\nSecond"
    assert {got[k] for k in range(200)} == {want % 1 + " word"} and all(got[200 + k] == want % k + " word" * k for k in range(2, 5))


def test_rows_of_one_page_id_are_one_sample(spark, monkeypatch):
    """Many pages under one id, with different texts: a host's sample stays bounded, and every row is cut for itself."""
    rows = [(7, "http://bare.example/", bare(k)) for k in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    seen = wrappers.wrappers(df).collect()
    assert len(seen) == 1 and "(<a (.*) >a)+" in seen[0].expression
    assert sorted(r.text for r in wrappers.main_texts(df).collect()) == sorted(bare_text(k) for k in range(300))


def test_joined_wrappers_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(k, f"http://h.example/{k}", page(k)) for k in range(6)], "page_id long, url string, html string")
    want = sorted(map(tuple, wrappers.main_texts(df).collect()))
    monkeypatch.setattr(wrappers, "MOST_HOSTS", 0)
    assert sorted(map(tuple, wrappers.main_texts(df).collect())) == want


def keys(nodes):
    return [x.key for x in nodes]


def test_wrappers_generalise():
    a = wrappers.stream(wrappers.tokens("<div><p>one</p><p>two</p><i>x</i></div>"))
    assert keys(a) == ["<div", "(<p # >p)+", "<i", "#", ">i", ">div"] and a[1].turn == ("<p", "#", ">p") and a[1].texts == {"one": (2,), "two": (5,)}
    both = wrappers.generalise([x._replace(texts=dict.fromkeys(x.texts, 1)) for x in a], wrappers.stream(wrappers.tokens("<div><p>three</p><i>y</i><b>new</b></div>")))
    assert keys(both) == ["<div", "(<p # >p)+", "<i", "#", ">i", "<b", "#", ">b", ">div"] and [x.pages for x in both] == [2, 2, 2, 2, 2, 1, 1, 1, 2]
    assert wrappers.expression(both, 2) == "<div (<p (.*) >p)+ <i (.*) >i ( <b new >b )? >div"
    assert wrappers.infer([page(k) for k in range(1, 6)])["region"] == "div.content"


def test_differences_of_any_length(monkeypatch):
    rng = np.random.default_rng(4)
    for cells in (1 << 20, 60, 1):
        monkeypatch.setattr(wrappers, "MOST_CELLS", cells)
        for n in (0, 1, 30, 200):
            a = [f"k{x}" for x in rng.integers(0, 40, n)] + ["once"] + [f"u{i}" for i in range(n // 9)]
            b = [x for x in a if rng.random() > 0.1] + ["end"]
            i = k = 0
            for equal, p, q, r, t in wrappers.differences(a, b):
                assert (p, r) == (i, k) and (not equal or a[p:q] == b[r:t])
                i, k = q, t
            assert (i, k) == (len(a), len(b))


BARE = """<html><body><div><a href=1>Start</a><a href=2>Topics</a><a href=3>About us all</a></div>%s<div><h2>Title %d</h2><p>First of %d.</p>%s<p>Always: <b>number %d</b></p></div>
<div><p>%s</p><p>We are a long notice that stands below each and every article of this host, of more than a hundred characters, which only the pages tell.</p></div></body></html>"""


def bare(k, paragraphs=1):
    offer = "<div><p>Offer of the week</p></div>" if k % 2 else ""
    return BARE % (offer, k, k, "".join(f"<p>Paragraph {i} of {k}.</p>" for i in range(paragraphs)), k, "Read more elsewhere")


def bare_text(k, paragraphs=1):
    return "\n\n".join([f"Title {k}", f"First of {k}.", *(f"Paragraph {i} of {k}." for i in range(paragraphs)), f"Always: number {k}"])


def test_the_wrapper_decides_where_no_element_or_class_tells(spark):
    """No article, main, class or telling element: constant, optional and repeated texts of the host are told by its pages alone."""
    rows = [(k, "http://bare.example/", bare(k, 1 + k % 3)) for k in range(12)]
    got = {r.page_id: r.text for r in wrappers.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: bare_text(k, 1 + k % 3) for k in range(12)}
    without = wrappers.extract(bare(3), None)
    assert "Topics" in without and "Offer of the week" in without and "stands below each" in without
    few = wrappers.main_texts(spark.createDataFrame(rows[:3], "page_id long, url string, html string")).first().text
    assert "Topics" in few  # three pages tell nothing yet


def test_long_pages_are_inferred_from_and_cut(spark):
    rows = [(k, "http://bare.example/", bare(k, 3000 + 500 * k).replace("<p>Paragraph 7 ", "<p><i>x</i>Paragraph 7 ")) for k in range(0, 10, 2)]
    rows += [(11, "http://bare.example/", "<div>" * 3000 + "<b>deep</b><i>" + "</div>" * 2000 + "a <p>" * 5000)]
    got = {r.page_id: r.text for r in wrappers.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == bare_text(k, 3000 + 500 * k).replace("Paragraph 7 ", "xParagraph 7 ") for k in range(0, 10, 2)) and got[11].split().count("a") == 5000


def test_pages_equal_a_plain_reading(spark, sf_dir):
    """Of the given pages the article element is known: its blocks, read by the standard parser."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.depth, self.skip, self.parts, self.out = 0, 0, [], []

        def cut(self):
            text = " ".join("".join(self.parts).split())
            if text:
                self.out.append(text)
            self.parts = []

        def handle_starttag(self, tag, attrs):
            if tag == "article":
                self.depth += 1
            if self.depth and tag in wrappers.BLOCK:
                self.cut()
            elif tag == "br":
                self.parts.append(" ")

        def handle_endtag(self, tag):
            if self.depth and tag in wrappers.BLOCK:
                self.cut()
            if tag == "article":
                self.depth -= 1

        def handle_data(self, data):
            if self.depth:
                self.parts.append(data)

    pages = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/pages.parquet")
    simple = {}
    for r in pages.collect():
        body = (r.html or "").partition("<article>")[2].partition("</article>")[0]
        if body and not any(f"<{x}" in body for x in ("div", "aside", "form", "script", "style", "ul", "table", "nav", "header", "footer", "section", "figure", "button", "!--")):
            a = Article()
            a.feed("<article>" + body + "</article>")
            simple[r.page_id] = "\n\n".join(a.out)
    got = {r.page_id: r.text for r in wrappers.main_texts(pages).collect()}
    assert len(simple) > 50 and {k: got[k] for k in simple} == simple


def test_warc_round_trip(spark, sf_dir, tmp_path):
    long = "<p>" + "lorem ipsum " * 40 + "</p>"
    rows = [(5, "http://a/b?c", long), (3, "http://a/", long), (9, None, long), (3, "http://a/", long), (1, "http://x\r\ny", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (None, "u", long), (7, "u", "a\r\n\r\nWARC/1.1\r\n\r\nb\r\n" * 20), (8, "u", "é" * 30000 + "\r\n\r\n")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, salt int")
    got = warc.capture_digests(df, str(tmp_path / "w")).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    for i, _, h in rows:
        body = (h or "").encode()
        assert all(r.payload_bytes == len(body) and r.payload_digest == hashlib.sha256(body).hexdigest() for r in by[i])
    assert {i: [(r.record_type, r.refers_to) for r in by[i]] for i in (3, 5, 9, None, 1, 2)} == {3: [("response", None)] * 2, 5: [("revisit", 3)], 9: [("revisit", 3)], None: [("revisit", 3)], 1: [("response", None)], 2: [("response", None)]}
    t = warc.transactions(warc.read_records(spark, str(tmp_path / "w")), payload=True).collect()
    assert all(r.request and r.metadata and r.request.http.startswith("GET ") for r in t)
    assert sorted(bytes(r.response.payload).decode() for r in t if r.response.type == "response") == sorted([h or "" for i, _, h in rows if i in (1, 2, 3, 4, 6, 7, 8)])
    assert warc.capture_digests(df.limit(0)).count() == 0
    for name in (tmp_path / "w").glob("*.warc.gz"):  # one gzip member for each record, and links that lead to one
        data, heads = name.read_bytes(), []
        while data:
            member = zlib.decompressobj(31)
            record = member.decompress(data)
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            heads.append(record.partition(b"\r\n\r\n")[0].decode())
            data = member.unused_data
        assert heads and sum("WARC-Type: request" in h for h in heads) == sum("WARC-Type: metadata" in h for h in heads)
    records = warc.read_records(spark, str(tmp_path / "w")).collect()
    ids = [r.id for r in records]
    assert len(set(ids)) == len(ids) == 3 * len(rows) and all(r.refers_to in ids for r in records if r.type == "revisit")
    warc.write_captures(df.repartition(5), str(tmp_path / "again"))
    once = {r.id for r in warc.read_records(spark, str(tmp_path / "again")).collect()}
    assert {i for i in ids if i.split(":")[2] not in ("3", "5", "9", "none")} <= once  # ids don't depend on the partitions


def test_records_of_many_megabytes_keep_their_members(spark, tmp_path, monkeypatch):
    html = "".join(chr(97 + i * 7 % 26) for i in range(1000)) * (17 << 10)
    df = spark.createDataFrame([(1, "http://a/", html), (2, "http://a/2", html), (3, "http://a/3", "small")], "page_id long, url string, html string")
    for most in (warc.MOST_SHARED, 0):
        monkeypatch.setattr(warc, "MOST_SHARED", most)
        got = {r.page_id: (r.payload_bytes, r.payload_digest, r.refers_to) for r in warc.capture_digests(df, str(tmp_path / f"m{most}")).collect()}
        sha = hashlib.sha256(html.encode()).hexdigest()
        assert got[1] == (len(html), sha, None) and got[2] == (len(html), sha, 1) and got[3][0] == 5
    for name in (tmp_path / f"m{warc.MOST_SHARED}").glob("*.gz"):
        assert gzip.decompress(name.read_bytes()).count(b"WARC/1.1\r\n") % 3 == 0


def brute(vectors, queries, k=10):
    out = []
    for q, x in queries:
        s = sorted((-int(np.dot(x, y)), i) for i, y in vectors if i != q)[:k]
        out += [(q, r, i, -score) for r, (score, i) in enumerate(s, 1)]
    return out


@pytest.mark.parametrize("page_size", [256, 8])
def test_top_k_equals_brute_force(spark, monkeypatch, page_size):
    monkeypatch.setattr(mtree, "PAGE", page_size)
    monkeypatch.setattr(mtree, "SUBTREE", 100)
    monkeypatch.setattr(mtree, "SEEDS", 40)
    monkeypatch.setattr(mtree, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(600, 5)), 1)  # ties abound
    x[50:250] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [1.0, None, 2.0]), (1002, [float("nan")] * 5), (1003, [float("inf")] * 5), (None, [1.0] * 5)]
    df = spark.createDataFrame([(*r, 3, "p") for r in rows], "vec_id long, embedding array<double>, label int, pivot string")
    v = mtree.integer_vectors(df, "vec_id", "embedding")
    ints = [(i, np.floor(1024 * y).astype(np.int64)) for i, y in enumerate(x)]
    got = sorted(tuple(r) for r in mtree.search(v, v.filter("id % 20 = 0"), 10).collect())
    assert got == sorted(brute(ints, [q for q in ints if q[0] % 20 == 0]))
    twice = v.unionByName(v.filter("id IN (3, 40)")).unionByName(spark.createDataFrame([(40, [9, -9, 0, 5000, 1]), (601, [7000, 1]), (602, [])], "id long, v array<long>"))
    wide = [(i, np.array([*r, 0, 0, 0, 0, 0][:5], np.int64)) for i, r in twice.collect()]
    first = {i: r for i, r in sorted(((i, r) for i, r in wide), key=lambda x: (x[0], x[1].tolist()), reverse=True)}
    got = sorted(tuple(r) for r in mtree.search(twice, twice.filter("id % 20 = 0"), 10).collect())
    assert got == sorted(brute(wide, [(i, r) for i, r in first.items() if i % 20 == 0]))  # repeated ids, and vectors of different lengths
    few = v.filter("id < 4")
    assert mtree.search(few, few, 10).count() == 12 and mtree.search(v.limit(0), v.limit(0), 10).count() == 0


def test_wide_products_are_exact(spark):
    rng = np.random.default_rng(2)
    for wide in (2**30, 2**31 + 12345):  # products of up to 62 bits; those of the second can't be told to fit beforehand
        rows = [(i, [int(rng.integers(-wide, wide)), *(int(x) for x in rng.integers(-9, 9, 5))]) for i in range(300)]
        v = spark.createDataFrame(rows, "id long, v array<long>")
        want = sorted((q, r, i, -s) for q, x in rows[::30] for r, (s, i) in enumerate(sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in rows if i != q)[:10], 1))
        assert sorted(tuple(r) for r in mtree.search(v, v.filter("id % 30 = 0"), 10).collect()) == want
    with pytest.raises(Exception, match="64-bit"):
        huge = spark.createDataFrame([(1, [2**40] * 3), (2, [2**40] * 3)], "id long, v array<long>")
        mtree.search(huge, huge, 1).collect()


def test_wide_vectors_are_not_dropped_in_silence(spark):
    near = 2.0**40 - 1
    df = spark.createDataFrame([(1, [near, -near]), (2, [float("inf"), 0.0]), (3, [float("nan"), 0.0]), (4, None)], "vec_id long, embedding array<double>")
    assert [(r.id, r.v) for r in mtree.integer_vectors(df, "vec_id", "embedding").collect()] == [(1, [1024 * int(near), -1024 * int(near)])]
    for wide in (2.0**40, -1e300):
        with pytest.raises(Exception, match="vector of 5"):
            mtree.integer_vectors(df.union(spark.createDataFrame([(5, [1.0, wide])], df.schema)), "vec_id", "embedding").collect()


def test_expression_is_kept(spark):
    df = spark.createDataFrame([(k, "http://h.example/", page(k)) for k in range(4)], "page_id long, url string, html string")
    [w] = wrappers.wrappers(df).collect()
    assert w.host == "h.example" and json.loads(w.wrapper)["region"] == "div.content" and "(.*)" in w.expression and ")+" in w.expression
