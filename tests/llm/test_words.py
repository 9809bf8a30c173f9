"""Decontamination, repeated passages, Jaccard components, lines: against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidegraph.llm import common, decontaminate, jaccard, lines, substrings
from tidegraph.llm.common import alnum_words, space_words, word_hashes

from .cases import ODD, frame, prose


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_words_follow_their_patterns():
    texts = [t or "" for _, t in ODD] + ["A-Z_09 ÄB\x7f\x80c", "".join(map(chr, range(0, 0x250)))]
    for t in texts:
        assert [w.decode() for w in space_words(t.encode())] == re.findall(r"[^\x20\x09-\x0D]+", t)
        assert [w.decode() for w in alnum_words(t.encode())] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def test_word_hashes(monkeypatch):
    rng = random.Random(0)
    texts = [(t or "").encode() for _, t in ODD] + ["".join(rng.choice("ab \n\x0b\xe9\x1c") for _ in range(rng.randint(0, 90))).encode() for _ in range(200)]
    whole = {w: h for t in texts for w, h in zip(space_words(t), word_hashes(t).tolist(), strict=True)}
    assert len(set(whole.values())) == len(whole)
    assert all(word_hashes(b"x " + w).tolist()[1] == h == word_hashes(w + b"\n").tolist()[0] for w, h in whole.items())
    # In small pieces only words longer than a piece have another hash, the same wherever they stand.
    monkeypatch.setattr(common, "_PIECE", 8)
    for t in texts:
        for w, h in zip(space_words(t), word_hashes(t).tolist(), strict=True):
            assert h == whole[w] if len(w) < 8 else h == word_hashes(w).tolist()[0] or len(w) == 8


def hits(text, items, size):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hit, names = set(), set()
    for name, item in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(item))
        for i in range(max(1, len(w) - size + 1)) if w else ():
            win = w[i : i + size]
            for at in range(len(words) - len(win) + 1):
                if words[at : at + len(win)] == win:
                    hit.update(range(at, at + len(win)))
                    names.add(str(name))
    return len(words), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block", [10, 100_000])
def test_contamination(spark, block):
    rng = random.Random(5)
    docs = ODD + prose(1, 40, words=6)
    items = [(10 + k, " ".join(rng.choices([f"W{k}" for k in range(6)], k=rng.randint(1, 9)))) for k in range(8)]
    items += [(30, None), (31, ""), (32, "one"), (32, "One, two!"), (9, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(frame(spark, docs), bench, window=4, keep=["doc_id", "text"], block_windows=block).collect()
    key = lambda x: repr(x)
    assert sorted([(r.doc_id, r.text, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got], key=key) == \
        sorted([(i, t, *hits(t, items, 4)) for i, t in docs], key=key)
    clean = decontaminate.decontaminated(frame(spark, docs), bench, window=4)
    assert clean.columns == frame(spark, docs).columns and clean.count() == sum(not hits(t, items, 4)[3] for _, t in docs)


def test_contamination_of_and_by_nothing(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated or r.n_hit for r in decontaminate.contamination(frame(spark, ODD), bench).collect())
    assert decontaminate.contamination(frame(spark, []), bench).count() == 0


def later_words(rows, size):
    """Kept words by brute force; identical rows are one document, null ids come first."""
    docs = sorted({(i is not None, i or 0, t or "") for i, t in rows}, key=lambda d: (d[0], d[1]))
    # Rows of one id with different texts have an order of their own, so the cases here give each text of an id no repeats.
    seen, out = set(), {}
    for has, i, t in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        gone = [False] * len(words)
        for at in range(len(words) - size + 1):
            win = tuple(words[at : at + size])
            if win in seen:
                gone[at : at + size] = [True] * size
            seen.add(win)
        out[(i if has else None, t)] = (len(words), " ".join(w for w, g in zip(words, gone) if not g))
    return out


@pytest.mark.parametrize("size", [8, 20])
def test_repeated_passages(spark, size):
    rows = [r for r in ODD if r[1] is None or "long" not in r[1]] + prose(2, 120) + [(900, "x " * 60), (901, "a b " * 40 + "c"), (902, "x " * 21), (10, "long " * 5000)]
    want = later_words(rows, size)
    got = substrings.repeated_spans(frame(spark, rows), window=size).collect()
    assert len(got) == len(rows)
    have = sorted(((r.id, r.n_words, r.kept) for r in got), key=repr)
    assert have == sorted(((i, *want[(i, t or "")]) for i, t in rows), key=repr)
    for r in got:
        assert r.n_words - sum(s.end - s.start for s in r.spans) == len(space_words(r.kept.encode()))
        assert all(s.end - s.start >= size for s in r.spans)


def test_repeated_passages_of_nothing(spark):
    assert substrings.repeated_spans(frame(spark, [])).count() == 0


def components(rows, percent=90, shingle=3):
    sets, parent = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[(i, t)] = {tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set()
    keys = list(sets)
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for x in keys:
        for y in keys:
            a, b = sets[x], sets[y]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(x)] = find(y)
    least = {}
    for k in keys:
        ids = [q[0] for q in keys if find(q) == find(k) and q[0] is not None]
        least[k] = (len(sets[k]), min(ids, default=None) if sets[k] else k[0])
    return least


def family(seed, n, words=150, edits=10):
    """Copies of one text with their own edits, and copies of one of these: many pairs just above and below the threshold."""
    rng = random.Random(seed)
    base = [f"b{k}" for k in range(words)]
    out = [base]
    for k in range(n):
        new = list(rng.choice(out[:3]) if k > 5 else base)
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(new))
            new[at : at + 1] = [[f"e{rng.randrange(50)}"], [], [new[at], f"e{rng.randrange(9)}"]][rng.randrange(3)]
        out.append(new)
    return [(5000 + k, " ".join(w)) for k, w in enumerate(out)]


@pytest.mark.parametrize("rows", [ODD + prose(3, 150), family(1, 80, 150, 7) + family(1, 80, 150, 7)[:4] + family(2, 60, 40, 3) + family(3, 40, 12, 2)], ids=["mixed", "families"])
def test_components(spark, rows):
    want = components(rows)
    got = jaccard.linked_components(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted(((i, *want[(i, t)]) for i, t in rows), key=repr)


def test_pairs_share_a_block():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in [9, 10, 11, 19, 20, 40, 100, 333, 2000]:
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            # The furthest set that is still linked: some elements out, some in.
            out = rng.integers(0, len(a) // 10 + 1)
            most = 0
            while 100 * (len(a) - out) >= 90 * (len(a) + most + 1):
                most += 1
            b = np.unique(np.concatenate([rng.permutation(a)[out:], rng.integers(0, 1 << 63, most, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 90 * (len(a) + len(b) - both) and len(np.setxor1d(a, b)):
                assert len(np.intersect1d(jaccard.block_keys(a), jaccard.block_keys(b)))


def test_pairs_share_a_block_that_neither_leaves_out():
    """Whatever keys are common: by an order that all sets agree on, the first ones go and a linked pair still meets."""
    import numpy as np

    rng = np.random.default_rng(4)

    def indexed(elements, percent, spare):
        out = set()
        for keys, leave in jaccard.blocks(elements, percent, spare):
            # Small remainders stand for common keys; many keys are equally common.
            out.update(sorted(keys.tolist(), key=lambda k: (k // 8 % 7, k))[leave:])
        return out

    met = 0
    for n in [5, 9, 20, 40, 100, 333, 1000]:
        for percent, spare in [(80, 0.25), (80, 1.0), (90, 0.5), (60, 0.25)]:
            for _ in range(25):
                a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
                out = rng.integers(0, len(a) * (100 - percent) // 100 + 1)
                most = 0
                while 100 * (len(a) - out) >= percent * (len(a) + most + 1):
                    most += 1
                b = np.unique(np.concatenate([rng.permutation(a)[out:], rng.integers(0, 1 << 63, most, dtype=np.uint64)]))
                both = len(np.intersect1d(a, b))
                if 100 * both >= percent * (len(a) + len(b) - both) and len(np.setxor1d(a, b)):
                    assert indexed(a, percent, spare) & indexed(b, percent, spare)
                    met += 1
    assert met > 300


@pytest.mark.parametrize("spare", [0.002, 0.25, 1.0])
def test_components_at_lower_similarity(spark, spare):
    """Shared passages of half a text and copies of copies, with common keys left out."""
    rows = ODD + prose(5, 200) + family(4, 60, 60, 14)
    want = components(rows, 80, 5)
    got = jaccard.linked_components(frame(spark, rows), shingle=5, percent=80, spare=spare).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted(((i, *want[(i, t)]) for i, t in rows), key=repr)


def test_representatives(spark):
    rows = ODD + [(100, "q w e r t y"), (101, "q w e r t y"), (102, "q w e r t z u")]
    docs = frame(spark, rows)
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 100 in ids and 101 not in ids and 102 in ids and {1, 2, 3, 9} <= set(ids)
    assert jaccard.linked_components(frame(spark, [])).count() == 0 and jaccard.representatives(frame(spark, [])).count() == 0


def test_lines(spark):
    rng = random.Random(8)
    common = [f"this line is on many sites {k}" for k in range(6)]
    rows = []
    for i in range(90):
        body = [f"own line of document {i} here", "", "The.", "short one"] + rng.sample(common[:4], 2) + ([common[4]] if i % 30 == 0 else []) + ["  " + common[5]] * (i < 12)
        rng.shuffle(body)
        rows.append((i, "\n".join(body), "en", f"site{i % 15}"))
    rows += [(i, t, None, None) for i, t in ODD] + [(95, common[0], "en", "site1"), (95, common[0], "en", "site1"), (96, common[0], "en", None)]
    places = sorted((((i is not None, i or 0), k, line.strip(" "), s) for i, t, _, s in rows for k, line in enumerate((t or "").split("\n")) if line.strip(" ")),
                    key=lambda x: (x[0], x[1]))
    sites, first = {}, {}
    for at, k, line, s in places:
        if len(re.split(r"[ \t]+", line)) >= 3:
            sites.setdefault(line, set()).add(s)
            first.setdefault(line, (at, k))
    boiler = {x for x, s in sites.items() if len(s - {None}) >= 10}
    assert boiler == set(common[:4]) | {common[5]}
    got = {(r["row"]["doc_id"], r["row"]["text"]): r["removed"] for r in lines.marked(frame(spark, rows)).collect()}
    for i, t, _, _ in rows:
        gone = [k for k, line in enumerate((t or "").split("\n")) if line.strip(" ") in boiler and first[line.strip(" ")] != ((i is not None, i or 0), k)]
        assert got[(i, t)] == gone
    out = lines.deduplicated(frame(spark, rows))
    assert out.columns == frame(spark, rows).columns
    ids = [r.doc_id for r in out.collect()]
    assert 95 not in ids and 96 not in ids and ids.count(7) == 3 and 1 in ids
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())
    assert lines.marked(frame(spark, [])).count() == 0


def test_sites_counted_exactly_near_the_threshold(spark):
    rows = [(k, f"on {n} sites exactly", f"s{k}") for n in (3, 9, 10, 11, 19, 20, 21, 60) for k in range(n) for _ in range(2)]
    df = spark.createDataFrame(rows, "id long, line string, site string").select(
        "site", F.xxhash64("line").alias("line_hash"), F.xxhash64(F.lit("line"), "line").alias("line_check"))
    sites = sorted((r.sites or 0) for r in lines.spread(df).collect())
    assert len(sites) == 6 and [s for s in sites if s] == [10, 11, 19, 20]




def test_passes_over_many_blocks_of_windows(spark, capsys):
    """Whatever the number of blocks, the plan that is left has one search, and an item without an id counts for hits."""
    docs = frame(spark, prose(21, 60) + ODD)
    items = spark.createDataFrame([(str(k) if k else None, t) for k, (_, t) in enumerate(prose(21, 8))], "item_id string, text string")
    once = decontaminate.contamination(docs, items, keep=["doc_id"])
    many = decontaminate.contamination(docs, items, keep=["doc_id"], block_windows=40)
    many.explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
    key = lambda r: str(tuple(r))
    assert sorted(once.collect(), key=key) == sorted(many.collect(), key=key)
    assert not once.where("n_hit > 0").isEmpty()


def test_block_keys_are_made_and_shuffled_once(spark, monkeypatch):
    plans, settle = [], jaccard.settle

    def seen(df, label="step"):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return settle(df, label)

    monkeypatch.setattr(jaccard, "settle", seen)
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "A b c d e"), (3, "v w x y z")], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in jaccard.linked_components(docs).collect()}
    assert found == {1: 1, 2: 1, 3: 3}
    assert sum("MapInArrow" in p for p in plans) == 1
