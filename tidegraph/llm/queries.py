"""Named queries of the operators and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from . import (chat, class_lm, decontaminate, divergence, html_text, jaccard, language, lines, merkle, pieces, spotsigs, substrings,
               token_store)
from .common import crc_part, flat

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def file_bytes(name: str) -> bytes:
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


@query("op1_token_store")
def op1(spark, sf):
    path = scratch_path(spark, "tokens")
    token_store.write_store(table(spark, sf, "documents"), path, file_bytes("word_bpe_49k.json").decode(), end_id=1)
    return token_store.read_store(spark, path, "ids_crc32 long", token_store.crc)


@query("op2_language_id")
def op2(spark, sf):
    docs = table(spark, sf, "documents")
    found = language.identify(docs.select("doc_id", "text"), language.trained_on(docs), keep=["doc_id"])
    return found.select("row.doc_id", (crc_part("row.doc_id", 3) == 1).alias("held_out"), F.col("result.lang").alias("lang_pred"),
                        "result.score", "result.entropy", "result.n_letters", "result.rejected")


@query("op3_spot_signatures")
def op3(spark, sf):
    prints = spotsigs.edited_neighbours(table(spark, sf, "documents"))
    own, edited, following = F.col("signatures"), F.col("edited_signatures"), F.col("next_signatures")
    return prints.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                         spotsigs.digest(own).alias("fingerprint"), spotsigs.digest(edited).alias("edited_fingerprint"),
                         spotsigs.likeness(own, edited).alias("near_edited"), spotsigs.likeness(own, following).alias("near_next"))


@query("op5_sentencepiece")
def op5(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return flat(pieces.digests(docs, file_bytes("piece_bpe_32k.model"), keep=["doc_id"]))


CONTAMINATION_SQL = """WITH
docs AS (SELECT doc_id, list_filter(string_split_regex(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
items AS (SELECT item_id, list_filter(string_split_regex(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + 12], ' ') AS win FROM
    (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
starts AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM docs, sizes WHERE len(w) >= n),
places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM starts),
found AS (SELECT doc_id, item_id, p.n, i FROM places p JOIN wins USING (win) WHERE p.n = wins.n),
hits AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) FROM found) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
    FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)"""


@query("op8_decontaminate", CONTAMINATION_SQL)
def op8(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return decontaminate.contamination(docs, table(spark, sf, "benchmark"), keep=["doc_id"]).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


LINES_SQL = """WITH
docs AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS l FROM documents),
each AS (SELECT doc_id, source, unnest(l) AS raw, unnest(generate_series(1, len(l))) AS i FROM docs),
lines AS (SELECT *, trim(raw) AS line FROM each),
common AS (SELECT line FROM lines WHERE line <> '' AND len(string_split_regex(line, '[ \\t]+')) >= 3
           GROUP BY line HAVING count(DISTINCT source) >= 10),
ranked AS (SELECT doc_id, i, raw, common.line IS NOT NULL AND row_number() OVER (PARTITION BY lines.line ORDER BY doc_id, i) > 1 AS gone
           FROM lines LEFT JOIN common USING (line)),
kept AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
                string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS body FROM ranked GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM kept"""


@query("op6_line_dedup", LINES_SQL)
def op6(spark, sf):
    found = lines.marked(table(spark, sf, "documents").select("doc_id", "source", "text"))
    return found.select("row.doc_id", F.coalesce(F.size(F.split("row.text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
                        F.size("removed").cast("long").alias("n_removed"), F.sha2(F.coalesce(lines.kept_text("row.text"), F.lit("")), 256).alias("kept_sha256"))


CHAT_SQL = """WITH
turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + length(body) + 15) AS BIGINT) AS formatted_chars, true AS identical
FROM (SELECT *, CASE WHEN contains(text, '</turn>') OR contains(text, '### ')
      THEN replace(replace(replace(text, '\\', '\\s'), '</turn>', '\\e'), '### ', '\\h') || '!' ELSE text END AS body FROM turns) GROUP BY conv_id"""


@query("op7_chat_format", CHAT_SQL)
def op7(spark, sf):
    odd = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    out = chat.formatted(turns).withColumn("turns", chat.parse(F.col("formatted"))).withColumn(
        "loss", F.array_join(chat.masked_texts(F.col("formatted"), F.col("mask")), ""))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
                      F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"), "identical")


@query("op10_class_lm")
def op10(spark, sf):
    return class_lm.scores(table(spark, sf, "documents"), crc_part("doc_id", 10) == 0)


REPEATS_SQL = """WITH
docs AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM docs WHERE len(w) >= 20),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS win FROM starts),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM wins) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS i FROM late),
words AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM docs),
kept AS (SELECT words.doc_id, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY words.i) FILTER (WHERE gone.i IS NULL) AS body
         FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.i = words.i GROUP BY words.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)"""


@query("op9_lempel_ziv_dedup", REPEATS_SQL)
def op9(spark, sf):
    found = substrings.repeated_spans(table(spark, sf, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select(F.col("id").alias("doc_id"), "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


LINKS_SQL = """WITH RECURSIVE
docs AS (SELECT doc_id, list_filter(string_split_regex(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM docs WHERE len(w) > 0),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
both_in AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_in JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM docs UNION SELECT r.doc_id, w.b FROM reach r JOIN ways w ON w.a = r.other),
least_of AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM least_of LEFT JOIN sizes USING (doc_id)"""


@query("op4_ngram_jaccard", LINKS_SQL)
def op4(spark, sf):
    return jaccard.linked_components(table(spark, sf, "documents"))


AUDIT_SQL = """WITH
docs AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS d,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
words AS (SELECT lang, source, d, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS c FROM words GROUP BY 1, 2 HAVING count(DISTINCT d) >= 3),
counts AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
langs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY 1),
sums AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY 1, 2),
groups AS (SELECT DISTINCT lang, source FROM docs),
cells AS (SELECT lang, source, term, coalesce(x.c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(x.c, 0) + 1) // (coalesce(s.n, 0) + v) AS p,
          1 + 1000000000::HUGEINT * (k.c + 1) // (l.n + v) AS q
    FROM groups JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN sums s USING (lang, source) LEFT JOIN counts x USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
every_pair AS (SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
parts AS (SELECT lang, source, 'pair' AS part, item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM every_pair LEFT JOIN pairs USING (lang, source, item)
    UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM cells WHERE c > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200"""


@query("op11_divergence_audit", AUDIT_SQL)
def op11(spark, sf):
    return divergence.audit(table(spark, sf, "documents"))


MANIFEST_SQL = """WITH RECURSIVE
docs AS (SELECT *, coalesce('v' || source, '-') AS k, replace(text, chr(10), '') AS text2,
    xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''),
        lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 2 = 0 AS odd FROM documents),
fields AS (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM docs),
leaves AS (SELECT doc_id, k, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN odd THEN sha256(head || coalesce(strlen(text2) || ':' || text2, '-')) END AS other FROM fields),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM leaves),
tree AS (SELECT k, 0 AS lvl, i, n, leaf AS node FROM placed
    UNION ALL SELECT k, lvl + 1, i // 3, (max(n) + 2) // 3, sha256(string_agg(node, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY k, lvl, i // 3),
subroots AS (SELECT k, node, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
over_tree AS (SELECT 0 AS lvl, i, n, node FROM subroots
    UNION ALL SELECT lvl + 1, i // 3, (max(n) + 2) // 3, sha256(string_agg(node, '' ORDER BY i)) FROM over_tree WHERE n > 1 GROUP BY lvl, i // 3),
all_nodes AS (SELECT k, lvl, i, n, node FROM tree UNION ALL SELECT '', 1000 + lvl, i, n, node FROM over_tree),
sides AS (SELECT a.k, a.lvl, a.i, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l,
    coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r
    FROM all_nodes a JOIN all_nodes b ON a.k = b.k AND a.lvl = b.lvl AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY 1, 2, 3),
low(doc_id, own, k, lvl, i, proof, h) AS (SELECT doc_id, i, k, 0, i, '', coalesce(other, leaf) FROM placed
    UNION ALL SELECT doc_id, own, low.k, low.lvl + 1, low.i // 3, proof || l || r, sha256(l || h || r) FROM low JOIN sides s ON s.k = low.k AND s.lvl = low.lvl AND s.i = low.i),
low_end AS (SELECT * FROM low QUALIFY row_number() OVER (PARTITION BY k, own ORDER BY lvl DESC) = 1),
high(doc_id, own, source, lvl, i, proof, h) AS (SELECT doc_id, own, low_end.k, 1000, s.i, proof, h FROM low_end JOIN subroots s ON s.k = low_end.k
    UNION ALL SELECT doc_id, own, source, high.lvl + 1, high.i // 3, proof || l || r, sha256(l || h || r) FROM high JOIN sides s ON s.k = '' AND s.lvl = high.lvl AND s.i = high.i),
high_end AS (SELECT * FROM high QUALIFY row_number() OVER (PARTITION BY source, own ORDER BY lvl DESC) = 1)
SELECT p.doc_id, p.leaf, s.node AS subroot, t.node AS root, sha256(h.proof) AS proof_sha256, h.h AS folded_root, h.h = t.node AS verified
FROM placed p JOIN subroots s ON s.k = p.k JOIN high_end h ON h.source = p.k AND h.own = p.i CROSS JOIN (SELECT node FROM over_tree WHERE n = 1) t"""


@query("op12_merkle_manifest", MANIFEST_SQL)
def op12(spark, sf):
    return merkle.manifest(table(spark, sf, "documents"), F.translate("text", "\n", ""), crc_part("doc_id", 2) == 0)


PAGES_SQL = """WITH
bodies AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS body FROM pages),
blocks AS (SELECT page_id, url, list_transform(string_split_regex(body, '</?(?:p|h1)>'), lambda b:
    trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(b, '</?(?:b|br)>', ' ', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', ''''),
        '&amp;?', '&', 'g'), '\\s+', ' ', 'g'))) AS b FROM bodies),
texts AS (SELECT page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10)) AS text FROM blocks)
SELECT page_id, url, text, length(text) AS n_chars FROM texts"""
"""For pages whose article is an ``article`` element of paragraphs and a heading, as in the given tables."""


@query("op13_html_extraction", PAGES_SQL)
def op13(spark, sf):
    return html_text.main_texts(table(spark, sf, "pages"), keep=["page_id", "url"])
