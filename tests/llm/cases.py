"""Small document tables with everything that may go wrong in them."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, result string, text2 string"


def frame(spark, rows, parts=3):
    """Documents from (doc_id, text[, lang[, source]]) with columns whose names clash with those of the operators."""
    full = [(*r, *[None] * (4 - len(r)), len(r[1]) if r[1] is not None else None, "x", None, "y") for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts) if full else spark.createDataFrame([], SCHEMA)


ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "One two"), (6, "a b c"), (7, "a b c"), (7, "a b d"), (8, "é ñ 日本 😀 \u2581 x"),
       (None, "no id here at all"), (None, None), (9, "\x00 \x0b\x1c \x85 \xa0 .,;"), (9, "\x00 \x0b\x1c \x85 \xa0 .,;"), (10, "long " * 5000 + "end")]


def prose(seed, n, words=60, length=80):
    """Random texts over few words, with copies, near copies and shared passages."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)]
    passage = " ".join(rng.choices(vocabulary, k=30))
    out = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.3 and out:
            old = rng.choice(out)[1].split(" ")
            for _ in range(rng.randint(0, 3)):
                old[rng.randrange(len(old))] = rng.choice(vocabulary)
            text = " ".join(old)
        else:
            text = " ".join(rng.choices(vocabulary, k=rng.randint(1, length)))
            if kind > 0.8:
                text += " " + passage
        out.append((i * 3 + 1, text))
    rng.shuffle(out)
    return out
