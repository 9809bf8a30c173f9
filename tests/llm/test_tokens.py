"""Token store, SentencePiece, chat formatting: exact round trips against the libraries and the source."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidegraph.llm import chat, pieces, token_store
from tidegraph.llm.common import flat

from .cases import ODD, frame, prose

WORDS = open(public_tokenizers.path("word_bpe_49k.json")).read()
MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
BITS = [*" \n\tabcthe.,'’▁é́ñ中日😀<>|/sÉÑßœŒĲǅK", "<s>", "</s>", "K̲", "H̱", "<|endoftext|>", "<|ENDOFTEXT|>", "  ", "\u3000", "\x85", "\x1c",
        "\x00", "ﬁ", "'re", "'S", "İ", "Σ", "ª", "It's", "l'ö", "word,", "Word)."]


def noise(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_chunks_give_the_ids_of_the_tokenizer():
    chunks = token_store.ChunkIds(WORDS)
    assert chunks.by_word
    texts = noise(1, 3000)
    want = [np.array(chunks.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert chunks.of([t.encode() for t in texts]) == want


@pytest.mark.parametrize("shard_bytes", [200, 1 << 20])
def test_store(spark, tmp_path, shard_bytes):
    rows = ODD + prose(4, 60) + [(5000 + i, t) for i, t in enumerate(noise(2, 60))]
    path = str(tmp_path / "store")
    token_store.write_store(frame(spark, rows), path, WORDS, end_id=1, shard_bytes=shard_bytes)
    tokenizer = token_store.ChunkIds(WORDS).tokenizer
    ids = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows]
    got = token_store.read_store(spark, path, "ids_crc32 long", token_store.crc).collect()
    want = sorted(((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids), key=repr)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == list(np.cumsum([0, *[r.n_tokens for r in ordered]])[:-1])
    assert [(r.doc_id is not None, r.doc_id or 0) for r in ordered] == sorted((r.doc_id is not None, r.doc_id or 0) for r in ordered)
    one = token_store.read_store(spark, path, "ids array<long>", token_store.id_list, ids=[5, 5003, 77777]).collect()
    assert {r.doc_id: r.ids for r in one} == {i: x for i, x in ids if i in (5, 5003)}


def test_empty_store(spark, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_store(frame(spark, []), path, WORDS, end_id=1)
    assert token_store.read_store(spark, path, "ids_crc32 long", token_store.crc).count() == 0


def test_pieces(spark):
    table = pieces.ChunkTable(MODEL)
    assert table.by_chunk
    for t in noise(3, 3000) + [" ", "  ", "a ", " a", "\u2581", "a\u2581\u2581b "]:
        assert table.encode(t) == [*table.library.encode(t), 2]
    rows = ODD + prose(5, 30)
    got = flat(pieces.encoded(frame(spark, rows), MODEL, decode=True)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = [*table.library.encode(r.text or ""), 2]
        assert (r.ids, r.decoded) == (want, table.library.decode(want))
    assert pieces.digests(frame(spark, []), MODEL).count() == 0


def test_pieces_of_other_models_go_text_by_text():
    table = pieces.ChunkTable(MODEL)
    table.by_chunk = False
    assert table.encode("a  b") == [*table.library.encode("a  b"), 2]


def test_chat_round_trip(spark):
    rng = random.Random(6)
    bits = ["\\", "\\s", "\\e", "\\h", "\\c", "### ", "###", "</turn>", "\n</turn>\n", "</turn", ">", ":\n", ":", "\n", "user", "ok", " ", "é", "😀", "### assistant:\n", "\\:\n"]
    say = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a:\nb", "r\\", "", None, "### x"]), rng.choice([say(), None, "plain text"]))
            for c in range(150) for t in range(rng.randint(1, 6))]
    rows += [(None, 0, "assistant", "no id"), (500, None, "assistant", "first"), (500, 1, "user", "tie b"), (500, 1, "user", "tie a"), (500, 1, "user", "tie a"),
             (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, n long").repartition(3)
    out = chat.formatted(turns).withColumn("turns", chat.parse(F.col("formatted"))).withColumn("loss", chat.masked_texts(F.col("formatted"), F.col("mask")))
    got = {r.conv_id: r for r in out.collect()}
    assert len(got) == 153
    for c, r in got.items():
        said = sorted(((t is not None, t or 0, role or "", text or "") for i, t, role, text in rows if i == c))
        assert r.identical and [(t.role, t.text) for t in r.turns] == [(x[2], x[3]) for x in said]
        assert r.loss == [x[3] for x in said if x[2] == "assistant"]
        assert r.formatted.count("</turn>") == len(said)
    assert "\\### Assistant: </turn> ok" not in got[-7].formatted and not got[500].turns[0].escaped
    assert chat.formatted(turns.limit(0)).count() == 0
