"""Source divergence, Merkle manifest and page texts against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import ODD, frame, prose
from tidegraph.llm import divergence, html_text, merkle
from tidegraph.llm.common import crc_part


def audited(rows, top):
    """The audit in plain Python; rows are (text, lang, source)."""
    terms = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        groups[lang or "", source or ""].update(terms(text or ""))
        docs[lang or ""].update(set(terms(text or "")))
    out = []
    share = lambda counts, kept: {t: 1 + 10**9 * (counts[t] + 1) // (sum(counts[k] for k in kept) + len(kept)) for t in kept}
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        mine = {s: groups[x, s] for x, s in groups if x == lang}
        p = {s: share(c, kept) for s, c in mine.items()}
        q = share(sum(mine.values(), Counter()), kept)
        f = lambda a, b: (a - b) ** 2 // b
        for s in mine:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in mine if o != s))
            out += [(lang, s, "pair", o.decode(), -v, r + 1) for r, (v, o) in enumerate(pairs)]
            stand = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if mine[s][t] > 0 and p[s][t] > q[t])[:top]
            out += [(lang, s, "term", t.decode(), -v, r + 1) for r, (v, t) in enumerate(stand)]
    return sorted(out)


def test_quadtree_sums_are_those_of_all_cells():
    rng = np.random.default_rng(1)
    for rows, columns, cross in [(1, 1, 0), (2, 1, 0), (8, 2, 0), (4, 64, 0), (32, 4096, 0), (128, 16, 64), (128, 256, 64)]:
        for fill in (0, 0.02, 0.6):
            filled, unseen = rng.random((rows, columns)) < fill, rng.integers(1, 50, rows)
            shares = np.where(filled, rng.integers(1, 10**9, (rows, columns)), unseen[:, None])
            got = divergence.traverse(shares, filled, unseen, cross)
            for g, h in {(0, rows - 1), (rows - 1, 0), (rows // 2, 0), (0, 0), *map(tuple, rng.integers(0, rows, (30, 2)))}:
                counts = g != h and (not cross or (g < cross) != (h < cross))
                assert got[g, h] == (divergence.distances(shares[g], shares[h]).sum() if counts else 0)


@pytest.mark.parametrize("sources,block_cells", [(3, 1 << 16), (70, 40)])
def test_audit(spark, sources, block_cells):
    rng = random.Random(sources)
    rows = [(i, t.replace("w1", "Wé").replace("w", rng.choice(["w", "W", "x"])).replace("2", "b") + " alpha Ünique",
             rng.choice(["aa", "bb", None]), f"s{i % sources}") for i, t in prose(5, 150)]
    rows += [(2000 + k, t, "cc", "only") for k, (_, t, *_) in enumerate(ODD)] + [(3000, None, "dd", None), (3001, "x", "dd", ""), (3002, "", "dd", "é")]
    got = sorted(map(tuple, divergence.audit(frame(spark, rows), top=5, block_cells=block_cells)
                     .select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == audited([r[1:] for r in rows], 5)


def test_audit_of_nothing(spark):
    assert divergence.audit(frame(spark, [])).collect() == []


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def grown(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([hashlib.sha256("".join(low[k : k + 3]).encode()).hexdigest() for k in range(0, len(low), 3)])
    return levels


def way(levels, k):
    for level in levels[:-1]:
        first = k - k % 3
        yield "".join(level[first:k]), "".join(level[k + 1 : first + 3])
        k //= 3


def proved(rows):
    """The manifest in plain Python; rows are (doc_id, source, lang, n_chars, text)."""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    by_source = defaultdict(list)
    for r in rows:
        odd = zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 2 == 0
        changed = r[4].replace("\n", "") if odd and r[4] is not None else r[4]
        by_source[r[1]].append((r[0], sha("".join(map(field, r))), sha("".join(map(field, (*r[:4], changed))))))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by_source[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: grown([x[1] for x in by_source[s]]) for s in names}
    top = grown([trees[s][-1][0] for s in names])
    out = []
    for j, s in enumerate(names):
        for k, (doc, leaf, other) in enumerate(by_source[s]):
            steps, folded = [*way(trees[s], k), *way(top, j)], other
            for left, right in steps:
                folded = sha(left + folded + right)
            out.append((doc, leaf, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), folded, folded == top[-1][0]))
    return out


@pytest.mark.parametrize("stride", [1, 2, 6])
def test_manifest(spark, stride):
    rng = random.Random(4)
    rows = [(i, t.replace(" ", "\n", rng.randint(0, 2)), "aa", "hot" if i % 2 else f"s{i % 14}") for i, t in prose(9, 120)]
    rows += [(*r, None, None) for r in ODD] + [(5000, "é\nü", None, "é"), (5001, "same", "aa", "twice"), (5001, "same", "aa", "twice"), (5002, "a", "b", "")]
    docs = frame(spark, rows)
    got = merkle.manifest(docs, F.translate("text", "\n", ""), crc_part("doc_id", 2) == 0, stride)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = proved([(i, s, lang, len(t) if t is not None else None, t) for i, t, lang, s in rows])
    key = lambda r: (r[0] is not None, *[str(x) for x in r])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert any(not r[-1] for r in want) and any(r[-1] for r in want)


def test_manifest_of_one_and_of_none(spark):
    one = merkle.manifest(frame(spark, [(1, "a\nb", "x", "s")])).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified and one.proof_sha256 == hashlib.sha256(b"").hexdigest()
    assert merkle.manifest(frame(spark, [])).collect() == []


LONG = "A sentence of the story, with commas, that goes on for a while and says what has happened there. "

PAGES = {
    "article": (f"<html><head><title>T</title><style>p{{}}</style></head><body><header>Site</header><nav><a href=/>Home</a></nav><div class='ad'>Buy, buy, {LONG}</div>"
                f"<article><h1>Head &amp; line</h1><p>{LONG}<p>Second <b>bold</b>\n  text&nbsp;here<br>and on</article><footer>&copy; foot</footer></body></html>",
                f"Head & line\n{LONG.strip()}\nSecond bold text here and on"),
    "divs": (f"<body><div id=top-nav><ul><li><a>One</a><li><a>Two</a></ul></div><div class='content with-sidebar'><h2>Title</h2><p>{LONG}</p><div class=sidebar><p>{LONG}</p></div>"
             f"<p>{LONG}</p><blockquote>Said, he</blockquote></div><div class='site-footer'><p>{LONG}</p></div>", f"Title\n{LONG.strip()}\n{LONG.strip()}\nSaid, he"),
    "no names": (f"<body><table><tr><td><a href=1>Home page</a> <a href=2>All the news of today</a></td></tr></table><div><p>{LONG * 3}</p><p>{LONG}</p></div>"
                 f"<div><a href=x>{LONG}</a><p><a>{LONG}</a></p></div>", f"{(LONG * 3).strip()}\n{LONG.strip()}"),
    "comments": (f"<main><p>{LONG}</p><section id=comments><h3>Comments</h3><p>{LONG * 9}</p></section><article class=comment><p>{LONG * 5}</p></article></main>"
                 f"<div role=dialog>We use cookies</div><div class='cookie-notice'>{LONG}</div><form><p>{LONG}</p></form>", LONG.strip()),
    "in parts": (f"<div id=story><div class=part><p>{LONG * 4}</p></div><div class=advert><p>{LONG * 4}</p></div><div class=part><p>{LONG * 3}</p></div></div>",
                 f"{(LONG * 4).strip()}\n{(LONG * 3).strip()}"),
    "scripts": ("<article><p>Text<script>var t='</p><p>x';</script> goes on<!-- <p>no --></p><noscript><p>off</p></noscript><p hidden>no</p>"
                "<p style='display: none'>no</p><svg><text>no</text></svg><p title='a > b'>a &lt; b &amp;lt; c &#x41;&am</p></article>", "Text goes on\na < b &lt; c A&am"),
    "lists": (f"<article><p>{LONG}</p><ul><li>First</li><li>Second<ul><li>Inner</ul><li>Third</ul><ul><li><a>Go here</a><li><a>Go there</a></ul>"
              "<table><tr><td>a<td>b<tr><td>c</table></article>", f"{LONG.strip()}\nFirst\nSecond\nInner\nThird\na\nb\nc"),
    "short article": (f"<body><article><h1>Yes</h1></article><div><p>{LONG}</p></div>", None),
    "headline only": ("<body><div>Some line, and more</div><article><h1>Yes</h1></article>", None),
    "empty article": (f"<body><article><h1> </h1><p></article><div><p>{LONG}</p></div>", ""),
    "article in two": (f"<body><article><p>{LONG * 2}</p></article><article><p>{LONG * 2}</p></article><article class=teaser><p>{LONG}</p></article>",
                       f"{(LONG * 2).strip()}\n{(LONG * 2).strip()}"),
    "plain": ("no tags &eacute; at\nall", "no tags é at all"), "null": (None, ""), "empty": ("", ""), "menus only": ("<nav>a</nav><footer>b</footer>", ""),
    "broken": (f"<article><p>{LONG}</b></i></div><p <b>x</p", f"{LONG.strip()}\nx</p"),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, want = PAGES[name]
    if want is not None:
        assert html_text.main_text(page) == want


def test_hard_pages():
    deep = "<div>" * 20000 + "text" + "</div>" * 20000
    assert html_text.main_text(deep) == "text"
    assert html_text.main_text("<i>" * 20000 + "</b>" * 20000 + "<a b='" * 20000)
    many = "<article>" + "".join(f"<p>{k} {LONG}</p>" for k in range(5000)) + "</article>"
    assert html_text.main_text(many).count("\n") == 4999


def test_pages_in_spark(spark):
    rows = [(k, f"u{k % 3}", page, "c", "d") for k, (page, _) in enumerate([*PAGES.values(), *list(PAGES.values())[:2]])] + [(None, None, "<p>x", "c", "d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, result string")
    out = html_text.main_texts(pages)
    assert sorted(out.columns) == ["html", "n_chars", "page_id", "result", "text", "url"]
    got = {r.page_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {r[0]: (html_text.main_text(r[2]), len(html_text.main_text(r[2]))) for r in rows}
    assert html_text.main_texts(pages.limit(0)).collect() == []
