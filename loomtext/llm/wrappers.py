"""Main text of web pages by wrappers: union-free regular expressions inferred from the token streams of a host's pages."""

from __future__ import annotations

import bisect
import difflib
import html as html_lib
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import lean, materialise, small

#: Distinct sample pages of a host at most, and at least for it to have constants; of them so many, and a quarter, must agree on a text for it
#: to be the host's; tokens in one turn of a repeated group at most.
SAMPLES, FEWEST, LEAST_AGREED, TURN = 16, 4, 3, 24
#: Token streams are compared whole while the product of their lengths is at most this, longer ones between tokens that each has once.
MOST_CELLS = 1 << 20
#: Wrappers of up to so many hosts, and bytes, are broadcast; more are joined by host, with pages of a host spread over SALTS.
MOST_HOSTS, MOST_BYTES, SALTS = 20_000, 16 << 20, 16

# HTML elements by role.
RAW = "script|style|noscript|template|textarea|title|iframe|svg|math|xmp|noembed|noframes|object|canvas|audio|video"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("nav header footer aside form menu dialog head button select option datalist fieldset label".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt"}
# Words in a class, id or role that mark what is not the article; those of a head, whose headings are the article's
# inside of it; and words that only say what kind of thing a mark is on. A name with any other word is no mark: social-science, related-work.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside widget rail "
    "comment comments commentlist commentform commentbox commenter disqus reply replies respond responses discussion talkback talkbacks feedback guestbook trackback trackbacks pingback pingbacks notice alert cookie cookies consent gdpr popup modal overlay toast newsletter subscribe subscription signup login search form share sharing social related recommended pagination pager toolbar copyright legal disclaimer announcement complementary contentinfo dialog".split()
)
HEADS = frozenset("header masthead".split())
NEUTRAL = frozenset(
    "box boxes list lists wrap wrapper container block blocks bar bars area section sections item items entry link links icon icons button buttons btn panel pane group holder zone slot unit module top bottom left right site page global primary secondary "
    "inner outer row col column content body post posts article articles story stories text title head heading image images img mobile desktop sticky fixed thread more the and of for us me id js is".split()
)

_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?|([^<]+|<)", re.S | re.I)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


def tokens(html: str) -> list[tuple[str, str, str]]:
    """(kind, tag, text or label): "S" a start tag with its label, "E" an end tag, "T" a text. Comments and raw elements are left out."""
    out = []
    for m in _TOKEN.finditer(html):
        text = m[8]
        if text is not None:
            out.append(("T", "", text))
            continue
        tag = m[3] or m[6]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2] or m[5]:
            out.append(("E", tag, ""))
        else:
            named = m[4] or m[7]
            label = tag
            if named and "=" in named:
                names = [x[1] or x[2] or x[3] for x in _NAMED.findall(named)]
                if names:
                    label = tag + "." + ".".join(" ".join(names).lower().split())
            out.append(("S", tag, label))
    return out


#: Whether an element is the article's, a head whose headings may be, or no part of an article.
ARTICLE, HEAD, OUTSIDE = 0, 1, 2


def _role(tag: str, label: str) -> int:
    if tag == "header":
        return HEAD
    if tag in ASIDE:
        return OUTSIDE
    found = ARTICLE
    if tag not in ("body", "html", "article", "main"):
        for name in label.split(".")[1:]:
            words = set(_WORD.findall(name))
            if words <= MARKS | HEADS | NEUTRAL:
                found = max(found, OUTSIDE if words & MARKS else HEAD if words & HEADS else ARTICLE)
    return found


def _outside(tag: str, label: str) -> bool:
    """Whether an element is no part of an article."""
    return _role(tag, label) != ARTICLE


class _Walk:
    """Follows open elements through a token stream, as far as broken markup allows."""

    def __init__(self, region: str | None):
        self.stack: list[tuple[str, str, int, bool]] = []  # tag, label, role, inside the region or an article
        self.region = region

    def start(self, tag: str, label: str) -> None:
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self._close("p", "button")
        elif tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
            self._close(tag, "ul" if tag == "li" else "table")
        _, _, role, inside = self.stack[-1] if self.stack else ("", "", ARTICLE, False)
        own = _role(tag, label)
        if own == HEAD and not inside and not any(e[0] in ("article", "main") for e in self.stack):
            own = OUTSIDE  # the page's head
        self.stack.append((tag, label, max(role, own), inside or label == self.region))

    def heads(self) -> bool:
        """Whether the innermost element is in a heading."""
        return any(e[0] in HEADINGS for e in self.stack)

    def end(self, tag: str) -> None:
        self._close(tag, "")

    def _close(self, tag: str, barrier: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return
            if self.stack[i][0] == barrier or tag == "p" and self.stack[i][0] in BLOCK:
                return


def blocks(toks: list[tuple[str, str, str]], region: str | None, constant: frozenset[int] | set[int] = frozenset(), most: int = 1 << 30) -> list[str]:
    """The article's blocks: texts outside of what is no article, inside the region if one is named. A block of at most `most` text
    tokens that are all constant (by index) is the host's and no article's, unless it is a heading."""
    walk, out, parts, held = _Walk(region), [], [], []

    def flush(heading: bool = False) -> None:
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text and (heading or len(held) > most or not constant.issuperset(held)):
                out.append(text)
            parts.clear()
        held.clear()

    for i, (kind, tag, x) in enumerate(toks):
        if kind == "T":
            if walk.stack:
                _, _, role, inside = walk.stack[-1]
                taken = (role == ARTICLE or role == HEAD and walk.heads()) and (inside or region is None)
            else:
                taken = region is None
            if taken:
                parts.append(x)
                if not x.isspace():
                    held.append(i)
        elif tag == "br":
            if parts:
                parts.append(" ")
        else:
            if tag in BLOCK:
                flush(kind == "E" and tag in HEADINGS)
            if kind == "S":
                walk.start(tag, x)
            else:
                walk.end(tag)
    flush()
    return out


class Node(NamedTuple):
    """A node of a page's token stream or of a wrapper, a union-free regular expression.

    key: "<label" a start tag, ">tag" an end tag, "#" a text, "(..)+" a repeated group; pages: how many pages have it, so that a
    node of fewer than all is optional; texts: of a page, the index of each text; of a wrapper, how many pages have each text;
    turn: the keys of one turn of a repeated group.
    """

    key: str
    pages: int
    texts: dict
    turn: tuple[str, ...] = ()


def fold(nodes: list[Node]) -> list[Node]:
    """Turns that follow each other with equal keys become one repeated group, inner ones first."""
    changed = True
    while changed:
        changed, keys = False, [x.key for x in nodes]
        for turn in range(1, min(TURN, len(nodes) // 2) + 1):
            out, i, hit = [], 0, False
            while i < len(nodes):
                j = i + turn
                if keys[i] != "#" and not (turn == 1 and keys[i][0] == "("):
                    while keys[j : j + turn] == keys[i : i + turn] and j + turn <= len(nodes):
                        j += turn
                if j > i + turn:
                    texts: dict = {}
                    for x in nodes[i:j]:
                        for t, at in x.texts.items():
                            texts[t] = texts.get(t, ()) + at
                    out.append(Node("(" + " ".join(keys[i : i + turn]) + ")+", 1, texts, tuple(keys[i : i + turn])))
                    i, hit = j, True
                else:
                    out.append(nodes[i])
                    i += 1
            if hit:
                nodes, changed = out, True
                break
    return nodes


def stream(toks: list[tuple[str, str, str]]) -> list[Node]:
    """A page's tokens as the expression that matches it alone, with repeated groups folded."""
    out = []
    for i, (kind, tag, x) in enumerate(toks):
        if kind == "T":
            text = " ".join(html_lib.unescape(x).split())
            if text:
                out.append(Node("#", 1, {text: (i,)}))
        else:
            out.append(Node("<" + x if kind == "S" else ">" + tag, 1, {}))
    return fold(out)


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of pairs, ordered by the first number, that rises in the second."""
    ends: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, y) in enumerate(pairs):
        at = bisect.bisect_left(ends, y)
        before[k] = last[at - 1] if at else -1
        ends[at : at + 1], last[at : at + 1] = [y], [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def differences(a: list[str], b: list[str]) -> Iterator[tuple[bool, int, int, int, int]]:
    """Ranges of a and b in turn, (equal, i, j, k, n). Long lists are first cut at keys that each has once, and where there are
    none in step by length, so that no length is too much."""
    if len(a) * len(b) <= MOST_CELLS:
        for op, i, j, k, n in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            yield op == "equal", i, j, k, n
        return
    once_a, once_b = ({x: i for i, x in enumerate(y) if counts[x] == 1} for y, counts in ((a, Counter(a)), (b, Counter(b))))
    cuts = [(i, k, 1) for i, k in _rising([(i, once_b[x]) for x, i in once_a.items() if x in once_b])]
    if not cuts:
        parts = math.isqrt(len(a) * len(b) // MOST_CELLS) + 2
        cuts = [(len(a) * p // parts, len(b) * p // parts, 0) for p in range(1, parts)]
    i = k = 0
    for end_a, end_b, same in [*cuts, (len(a), len(b), 0)]:
        for equal, p, q, r, t in differences(a[i:end_a], b[k:end_b]):
            yield equal, i + p, i + q, k + r, k + t
        if same:
            yield True, end_a, end_a + 1, end_b, end_b + 1
        i, k = end_a + same, end_b + same


def aligned(wrapper: list[Node], page: list[Node]) -> Iterator[tuple[list[Node], list[Node]]]:
    """Nodes of a wrapper with the nodes of a page that they match, or either side alone. A single turn matches its repeated group."""
    for equal, i, j, k, n in differences([x.key for x in wrapper], [x.key for x in page]):
        left, right = wrapper[i:j], page[k:n]
        if equal:
            yield from (([x], [y]) for x, y in zip(left, right))
        elif any(len(group) == 1 and group[0].turn and group[0].turn == tuple(x.key for x in turn) for group, turn in ((left, right), (right, left))):
            yield left, right
        else:
            if left:
                yield left, []
            if right:
                yield [], right


def generalise(wrapper: list[Node], page: list[Node]) -> list[Node]:
    """The wrapper that also matches the page: nodes that match are merged, the others become optional."""
    out = []
    for left, right in aligned(wrapper, page):
        if not left or not right:
            out += left or [x._replace(texts=dict.fromkeys(x.texts, 1)) for x in right]
            continue
        texts = Counter()
        for x in left:
            texts.update(x.texts)
        texts.update({t for x in right for t in x.texts})
        group = next((x for x in (*left, *right) if x.turn), left[0])
        out.append(Node(group.key, max(x.pages for x in left) + 1, texts, group.turn))
    return out


def expression(wrapper: list[Node], total: int) -> str:
    """A wrapper as a regular expression: a text that all pages share as it is, others as (.*), nodes that not all pages have as (..)?."""
    out, optional = [], False
    for x in wrapper:
        if (x.pages < total) != optional:
            out.append(")?" if optional else "(")
            optional = not optional
        shared = next((t for t, n in x.texts.items() if n == x.pages), None) if x.key == "#" else None
        out.append("(.*)" if x.key == "#" and shared is None else re.escape(shared) if shared else x.key.replace("#", "(.*)"))
    return " ".join(out + [")?"] * optional)


def constants(wrapper: list[Node], total: int) -> list[tuple[Node, frozenset[str], bool]]:
    """Each node with its texts that are the host's, which at least LEAST_AGREED pages and a quarter of all have there, and whether
    the node is a short text that all pages share outside of headings and repeated groups. Fewer than FEWEST pages tell nothing."""
    out, before = [], ""
    for x in wrapper:
        same = frozenset(t for t, n in x.texts.items() if total >= FEWEST and n >= max(LEAST_AGREED, total / 4))
        firm = x.key == "#" and x.pages == total and any(x.texts[t] == total and len(t) <= 100 for t in same) and before[1:].split(".")[0] not in HEADINGS
        out.append((x, same, firm))
        before = x.key
    return out


def constant_texts(known: list[tuple[Node, frozenset[str], bool]], toks: list[tuple[str, str, str]], firm: bool) -> set[int]:
    """Indexes of the page's texts that are constants of the wrapper's nodes that they match; firm: only of such nodes."""
    of = {id(x): same for x, same, sure in known if sure or not firm}
    out: set[int] = set()
    for left, right in aligned([x for x, _, _ in known], stream(toks)):
        same = frozenset().union(*(of.get(id(x), ()) for x in left))
        out.update(i for y in right for t, at in y.texts.items() if t in same for i in at)
    return out


def infer(pages: list[str]) -> dict:
    """The wrapper of a host's distinct sample pages and what extraction needs of it: the element that holds the article (or
    None), and the expression's nodes with their constants, where these change the text of a sample page.

    The article's element is `article` or `main` where the wrapper always has one; else the innermost element that every page
    has and in which four fifths of all texts lie that may be an article's and that are no constants of the host.
    """
    read = [t for t in map(tokens, pages) if t]
    if not read:
        return {"region": None, "nodes": [], "expression": ""}
    wrapper: list[Node] = []
    for k, toks in enumerate(read):
        page = stream(toks)
        wrapper = generalise(wrapper, page) if k else [x._replace(texts=dict.fromkeys(x.texts, 1)) for x in page]
    known = constants(wrapper, len(read))
    fixed = [x.key[1:] for x in wrapper if x.key[0] == "<" and x.pages == len(read)]
    region = next((x for tag in ("article", "main") for x in fixed if x.split(".")[0] == tag and not _outside(tag, x)), None)
    if region is None:
        held: Counter = Counter()
        depth: dict[str, int] = {}
        total = 0
        for toks in read:
            walk, same = _Walk(None), constant_texts(known, toks, False)
            for i, (kind, tag, x) in enumerate(toks):
                if kind == "S":
                    walk.start(tag, x)
                    depth[x] = max(depth.get(x, 0), len(walk.stack))
                elif kind == "E":
                    walk.end(tag)
                elif i not in same and not (walk.stack and walk.stack[-1][2]):
                    n = len(x.strip())
                    total += n
                    held.update({label: n for label in {e[1] for e in walk.stack}})
        good = [x for x in dict.fromkeys(fixed) if x in held and held[x] >= 0.8 * total and x.split(".")[0] not in ("p", *HEADINGS)]
        region = max(good, key=lambda x: depth[x], default=None)
    plain = {"region": region, "nodes": []}
    full = {"region": region, "nodes": known}
    changed = any(same for _, same, _ in known) and any(extract(p, plain) != extract(p, full) for p in pages)
    return (full if changed else plain) | {"expression": expression(wrapper, len(read))}


def extract(html: str | None, wrapper: dict | None) -> str:
    """The main text of a page: what its host's wrapper has as slots, within the article's element.

    Where the wrapper names no element that the page has, the first `article` or `main` will do, else everything that may be
    an article's. Within an `article`, `main` or an element with a name of its own all is the article's but short texts that
    every sample page has at their place, alone in their block; elsewhere all constants of the wrapper, optional and repeated
    ones too, are the host's.
    """
    if not html:
        return ""
    toks = tokens(html)
    region = wrapper and wrapper["region"]
    if region and not any(k == "S" and x == region for k, _, x in toks):
        region = None
    if region is None:
        labels = [x for k, t, x in toks if k == "S" and t in ("article", "main") and not _outside(t, x)]
        region = labels[0] if labels else None
    told = region is not None and (region.split(".")[0] in ("article", "main") or "." in region)
    same = constant_texts(wrapper["nodes"], toks, told) if wrapper and wrapper["nodes"] else set()
    return "\n\n".join(blocks(toks, region, same, 1 if told else 1 << 30))


def _dump(w: dict) -> str:
    """region and nodes as JSON: of a node its key, turn, constants and whether they are firm."""
    return json.dumps({"region": w["region"], "nodes": [[x.key, x.turn, sorted(same), firm] for x, same, firm in w["nodes"]]})


def _load(text: str) -> dict:
    w = json.loads(text)
    return {"region": w["region"], "nodes": [(Node(key, 1, {}, tuple(turn)), frozenset(same), firm) for key, turn, same, firm in w["nodes"]]}


def _infer_host(pdf: pd.DataFrame) -> pd.DataFrame:
    pages = dict.fromkeys(p for p in pdf.sort_values("page_id")["html"] if p)
    w = infer(list(pages)[:SAMPLES])
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [_dump(w)], "expression": [w["expression"]]})


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON: region, nodes) and expression (the regular expression) for each host, from at most SAMPLES of its pages.

    The sample is the smallest page_id of each of SAMPLES hash buckets of the host's payloads, found by a pre-aggregated
    minimum: copies of a page are one payload, and a host with a third of all pages costs no more than another."""
    rows = pages.filter("page_id IS NOT NULL").select(host_of(F.col("url")).alias("host"), "page_id", F.pmod(F.xxhash64("html"), F.lit(SAMPLES)).alias("bucket"), "html")
    chosen = rows.groupBy("host", "bucket").agg(F.min("page_id").alias("page_id")).select("page_id").distinct()
    held = rows.join(small(chosen, 200_000), "page_id", "left_semi")
    # One row of a bucket, also where very many rows repeat its page_id: no host ever has more than SAMPLES rows in a task.
    sample = held.groupBy("host", "bucket").agg(F.min(F.struct("page_id", F.xxhash64("html").alias("mark"), "html")).alias("p")).select("host", "p.page_id", "p.html")
    return sample.groupBy("host").applyInPandas(_infer_host, "host string, wrapper string, expression string")


def _extractor(known: dict[str, dict] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[str, dict] = {}
        for batch in batches:
            col = {k: batch.column(i).to_pylist() for i, k in enumerate(batch.schema.names)}
            texts = []
            for i, page in enumerate(col["html"]):
                if known is not None:
                    w = known.get(col["host"][i])
                else:
                    w = col["wrapper"][i]
                    w = w and (read.get(w) or read.setdefault(w, _load(w)))
                texts.append(extract(page, w))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of the main text of every row of pages (page_id, url, html).

    Wrappers are inferred by host from a bounded sample of its pages; each whole page is then aligned with its host's wrapper
    and cut by it. Pages of any length are inferred from and aligned. A host of fewer than FEWEST distinct pages has no
    constants: its pages are cut by elements and marks alone. Copies of a page count once. A null or empty html has the empty text; a null url is a host of its own; rows that repeat a page_id are cut each for
    itself; broken markup is read as far as it goes; an empty table gives an empty result; other columns play no part.
    """
    pages = lean(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    found = materialise(wrappers(pages).select("host", "wrapper"))
    n, size = found.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("wrapper")), F.lit(0))).first()
    out = "page_id long, url string, text string, n_chars long"
    keyed = pages.withColumn("host", host_of(F.col("url")))
    if n <= MOST_HOSTS and size <= MOST_BYTES:
        known = {r["host"]: _load(r["wrapper"]) for r in found.collect()}
        return keyed.mapInArrow(_extractor(known), out)
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    joined = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS))).join(salted, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "wrapper").mapInArrow(_extractor(None), out)
