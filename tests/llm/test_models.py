"""Language models, fingerprints and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidegraph.llm import class_lm, language, spotsigs
from tidegraph.llm.common import crc_part

from .cases import ODD, frame, prose
from .test_words import components, hits


def spoken(seed, n):
    """Two invented languages and their labels."""
    rng = random.Random(seed)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "er", "ung", "zt"]}
    rows = []
    for i in range(n):
        lang = rng.choice(["aa", "bb"])
        text = " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(3, 40)))
        rows.append((i, text.capitalize() + ".", lang if rng.random() < 0.9 else None))
    return rows


def test_models_are_distributions():
    words = ["abab", "abc", "b", "cab", "abab"]
    names, counts = np.unique(words, return_counts=True)
    models = language.Models({"x": language.fit(list(names), counts)})
    seen = "abc\x02"
    for prefix in ["", "a", "ab", "aba", "zz", "bca"]:
        total = 0.0
        for c in seen:
            codes = np.frombuffer(("\x01" * (language.ORDER - 1) + prefix + c).encode("utf-32-le"), np.uint32).astype(np.uint64)
            at, p = np.array([len(codes) - 1]), np.full((1, 1), language.UNSEEN, np.float32)
            for k, (grams, share, contexts, left) in enumerate(models.tables):
                context = np.zeros(1, np.uint64) if k == 0 else language._grams(codes, at - 1, k)
                p = p * models._find(contexts, left, context, 1.0) + models._find(grams, share, language._grams(codes, at, k + 1), 0.0)
            total += float(p[0, 0])
        # What is left to characters never seen is no more than the discount of the lowest order.
        assert 0.5 < total <= 1.0 + 1e-5


def test_language(spark):
    rows = spoken(1, 400) + [(1000 + (i or 0), t, "aa") for i, t in ODD if t is None or not re.search(r"[^\W\d_]", t)]
    rows += [(2001, "qwrtz xvbnm " * 20, None), (2002, "12 ² ½ _", "bb"), (2002, "12 ² ½ _", "bb")]
    docs = frame(spark, rows)
    identifier = language.trained_on(docs)
    got = [(r["row"], r["result"]) for r in language.identify(docs, identifier).collect()]
    assert len(got) == len(rows)
    for row, r in got:
        assert 0 <= r.score <= 1
        if row.text is None or not any(c.isalpha() for c in row.text):
            assert (r.lang, r.score, r.rejected) == ("und", 0, True)
        elif row.doc_id < 1000:
            assert not r.rejected and (row.lang is None or r.lang == row.lang)
    assert [r.rejected for row, r in got if row.doc_id == 2001] == [True]
    kept = language.accepted(docs, identifier)
    assert kept.columns == docs.columns and kept.count() == 400
    # The same text has the same result whatever its other columns say.
    other = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("s"))
    assert sorted(map(repr, language.identify(other, identifier, keep=["doc_id"]).collect())) == sorted(map(repr, language.identify(docs, identifier, keep=["doc_id"]).collect()))


def test_language_without_labels(spark):
    docs = frame(spark, [(1, "abc", None), (2, None, "aa")])
    found = language.identify(docs, language.trained_on(docs)).collect()
    assert [r.result.lang for r in found] == ["und", "und"]
    assert language.identify(frame(spark, []), language.trained_on(docs)).count() == 0


def test_class_model(spark):
    rows = ODD + prose(7, 80) + [(5000 + i, t) for i, t, _ in spoken(2, 120)]
    docs = frame(spark, rows)
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 10 == 0
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").encode().lower().decode())) for i, t in rows]
    counts = Counter(w for i, ws in words if not held(i) for w in ws)
    ends = sum(not held(i) for i, _ in words)
    total, distinct = sum(counts.values()) + ends, len(counts) + 1
    blocks = class_lm.coded(docs, crc_part("doc_id", 10) == 0)
    model = class_lm.fit(blocks, class_lm.vocabulary(blocks))
    assert (model.tokens, model.distinct, model.texts) == (total, distinct, ends)
    assert np.allclose(np.exp(class_lm.transitions(model.pairs)).sum(axis=1), 1)
    class_of = lambda w: int(model.classes[class_lm._buckets([w.encode()])[0]])
    sizes = Counter(class_of(w) for w in counts for _ in range(counts[w]))
    assert all(model.class_tokens[c] == n for c, n in sizes.items())
    pairs = np.zeros_like(model.pairs)
    for i, ws in words:
        if not held(i):
            path = [class_lm.END, *map(class_of, ws), class_lm.END]
            np.add.at(pairs, (path[:-1], path[1:]), 1)
    assert (pairs == model.pairs).all()
    step = class_lm.transitions(pairs) / math.log(10)
    want = []
    for i, ws in words:
        base = score = 0.0
        before = class_lm.END
        for w in [*ws, None]:
            n, c = (ends, class_lm.END) if w is None else (counts[w], class_of(w))
            base += math.log10((n + 0.1) / (total + 0.1 * (distinct + 1)))
            score += step[before, c] + math.log10((n + 0.1) / (model.class_tokens[c] + 0.1 * (model.class_words[c] + 1)))
            before = c
        want.append((repr(i), held(i), len(ws) + 1, sum(counts[w] > 0 for w in ws) + (ends > 0), total, round(base, 6), round(score, 6)))
    got = class_lm.scores(docs, crc_part("doc_id", 10) == 0).collect()
    have = [(repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got]
    for a, b in zip(sorted(have), sorted(want), strict=True):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], atol=2e-5)
    held_rows = [r for r in got if r.held_out and r.doc_id and r.doc_id >= 5000]
    assert sum(r.score for r in held_rows) > sum(r.base_score for r in held_rows)


def test_exchange_never_makes_one_word_worse():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 5, (50, 2 * class_lm.WIDE))
    classes = rng.integers(0, class_lm.CLASSES, 50).astype(np.uint8)
    pairs = rng.integers(1, 50, (class_lm.WIDE, class_lm.WIDE))
    moved = class_lm.exchange(counts, classes, pairs, np.arange(50) % 2 == 0)
    assert (moved[1::2] == classes[1::2]).all() and (moved != classes).any()


def test_words_have_their_own_class(spark):
    """Two words whose hashes have the same low 18 bits differ in class when their neighbours do."""
    seen, k = {}, 0
    while (low := xxhash.xxh3_64_intdigest(f"v{k}".encode()) % (1 << 18)) not in seen:
        seen[low] = k
        k += 1
    one, two = f"v{seen[low]}", f"v{k}"
    docs = frame(spark, [(i, f"p {one} q" if i % 2 else f"r {two} s") for i in range(40)])
    blocks = class_lm.coded(docs, F.lit(False))
    classes = class_lm.fit(blocks, class_lm.vocabulary(blocks)).classes
    assert classes[class_lm._buckets([one.encode()])[0]] != classes[class_lm._buckets([two.encode()])[0]]


def test_exchange_sweeps_until_the_gain_is_small(spark, monkeypatch):
    docs = frame(spark, [(i, t) for i, t, _ in spoken(5, 150)] + prose(8, 60))
    blocks = class_lm.coded(docs, F.lit(False))
    seen, count = [], class_lm._class_bigrams
    monkeypatch.setattr(class_lm, "_class_bigrams", lambda *a: seen.append(count(*a)) or seen[-1])
    model = class_lm.fit(blocks, class_lm.vocabulary(blocks))
    values = [class_lm.likelihood(p) for p in seen]
    best = np.maximum.accumulate(values)
    paid = np.diff(values) + values[:-1] - best[:-1] > class_lm.TOLERANCE * seen[0].sum()
    assert len(paid) > 3 and paid[-3] and not paid[-2:].any() and not any(not a and not b for a, b in zip(paid[:-2], paid[1:-1]))
    assert class_lm.likelihood(model.pairs) == max(values)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(20, "held out")]])
def test_class_model_of_little(spark, rows):
    docs = frame(spark, rows)
    got = class_lm.scores(docs, F.col("doc_id") == 20).collect()
    assert len(got) == len(rows) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)


def signatures(text):
    words = [w for w in re.split(r"[^0-9A-Za-zÀ-ɏ぀-鿿]+", (text or "").lower()) if w]
    common = set(spotsigs.COMMON_WORDS)
    content = [w for w in words if w not in common]
    out, before = set(), 0
    for w in words:
        if w in common and before + spotsigs.CHAIN <= len(content):
            out.add((w, *content[before : before + spotsigs.CHAIN]))
        before += w not in common
    return out


def test_signatures(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choices(["The", "of", "und", "red", "green", "blue", "tall", "é"], k=rng.randint(0, 40))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(100 + k, t) for k, (_, t) in enumerate(ODD)]
    got = spotsigs.with_signatures(frame(spark, rows), "text", "s").collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        assert len(set(r.s)) == len(r.s) and bool(r.s) == bool(r.text)
        assert by_text.setdefault(r.text, set(r.s)) == set(r.s)
        if r.doc_id < 100:
            # Stand-in anchors add to the signatures of common words.
            assert len(r.s) >= len(signatures(r.text))
    for a in got[:40]:
        for b in got[:40]:
            if a.doc_id < 100 and b.doc_id < 100:
                assert len(set(a.s) & set(b.s)) >= len(signatures(a.text) & signatures(b.text))


def test_edited_neighbours(spark):
    rows = [r for r in ODD if r[0] != 7] + [(20 + 3 * k, f"The cat number {k} sat on the mat of house {k} and saw a bird fly over the roof " * 3) for k in range(30)]
    got = spotsigs.edited_neighbours(frame(spark, rows)).collect()
    ordered = sorted(((i is not None, i or 0, t or "") for i, t in rows))
    want = set()
    for k, (has, i, t) in enumerate(ordered):
        following, q = ordered[(k + 1) % len(ordered)][2], len(t) // 4
        want.add((i if has else None, t, t[: len(t) - q] + following[:q], following))
    assert {(r.doc_id, r.text, r.edited, r.next_text) for r in got} == want and len(got) == len(rows)
    near = lambda a, b: 1.0 if not (a or b) else len(set(a) & set(b)) / len(set(a) | set(b))
    frame_ = spark.createDataFrame([(r.signatures, r.edited_signatures) for r in got], "a array<long>, b array<long>")
    for r in frame_.withColumn("near", spotsigs.likeness(F.col("a"), F.col("b"))).collect():
        assert abs(r.near - near(r.a, r.b)) < 1e-12
    one = spotsigs.edited_neighbours(frame(spark, [(5, "abcdefgh")])).collect()
    assert [(r.edited, r.next_text) for r in one] == [("abcdefab", "abcdefgh")]
    assert spotsigs.edited_neighbours(frame(spark, [])).count() == 0


def test_similar_pairs(spark):
    rng = random.Random(4)
    sets = [sorted(rng.sample(range(60), rng.randint(1, 30))) for _ in range(60)]
    sets += [sorted({*s[:-1], 99}) for s in sets[:20]] + sets[:10]
    prints = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sets)], "doc_id long, signatures array<long>, likeness string")
    got = {(r.a, r.b) for r in spotsigs.similar_pairs(prints).collect()}
    first = {tuple(s): i for i, s in reversed(list(enumerate(sets)))}
    classes = sorted((i, set(s)) for s, i in first.items())
    assert got == {(i, j) for i, a in classes for j, b in classes if i < j and len(a & b) >= 0.8 * len(a | b)}


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    body = spoken(3, 160)
    boiler = "kalo mitu tulo kami lokatu"
    passage = " ".join("".join(rng.choices(["ka", "lo", "mi", "tu"], k=3)) for _ in range(20))
    rows = [(i, t + ("\n" + boiler if i % 4 == 0 else "") + ("\n" + passage if i % 31 == 5 else ""), lang, f"site{i % 11}") for i, t, lang in body]
    rows += [(900 + i, rows[i][1], rows[i][2], rows[i][3]) for i in range(0, 40, 3)]
    rows += [(950, None), (951, "0123 99"), (952, boiler, "aa", "site1"), (953, "xqzw jjvq " * 30, None, "site2")]
    sf = str(tmp_path)
    docs = frame(spark, rows).drop("row", "result", "text2")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    seen, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf).cache()
        seen[name] = now.collect()
        if name != "encoding":
            assert now.columns == docs.columns
    ids = {name: [r.doc_id for r in out] for name, out in seen.items()}
    assert set(ids["language_id"]) == {r[0] for r in rows} - {950, 951, 953}
    assert sum(boiler in (r.text or "") for r in seen["line_dedup"]) == 1 and 952 not in ids["line_dedup"]
    want = components([(r.doc_id, r.text) for r in seen["line_dedup"]], 80, 5)
    assert sorted(ids["near_copies"]) == sorted(i for (i, _), (_, c) in want.items() if i == c)
    clean = [r.doc_id for r in seen["near_copies"] if not hits(r.text, [(1, passage)], 13)[3]]
    assert sorted(ids["decontamination"]) == sorted(clean) == sorted(ids["encoding"]) and len(clean) < len(ids["near_copies"])
    assert all(r.ids[-1] == 2 and len(r.ids) == r.n_tokens for r in seen["encoding"])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == sorted(clean)


def test_near_copies_by_five_words_and_four_fifths(spark):
    rng = random.Random(12)
    pick = lambda n: rng.choices([f"t{k}" for k in range(900)], k=n)
    texts = []
    for changed in (5, 15, 35, 45, 50, 60, 90, 120):
        words = pick(500)
        # The same text with one passage replaced: a similarity of 0.98 down to 0.6 on five words.
        texts += [words, words[:200] + pick(changed) + words[200 + changed :]]
    texts += [["a"], ["a"], [], ["a", "b", "c", "d", "e", "f"], ["a", "b", "c", "d", "e", "g"]]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in texts]
    root = list(range(len(sets)))
    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if a and 100 * len(a & b) >= 80 * len(a | b):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    docs = frame(spark, [(i, " ".join(w)) for i, w in enumerate(texts)])
    kept = sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect())
    assert kept == [i for i, r in enumerate(root) if i == r] and 7 not in kept and 15 in kept
