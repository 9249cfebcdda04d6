"""The registered queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noisefleet.llm import backoff_langid, boilerplate_crf, chat_format, fptree_search, golay_simhash, license_scan, line_dedup, merge_dropout, mixing, onebit_search, prefix_trie, quality_trees, warc
from noisefleet.llm.common import table

# Where the tokenizer model lies; read on the driver.
MODEL = os.environ.get("NOISEFLEET_PIECE_MODEL", merge_dropout.MODEL)

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_trees.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def _op2_sql() -> str:
    quoted = ", ".join(f"('{name}', [{', '.join(repr(b) for b in bigrams)}])" for name, bigrams in license_scan.template_bigrams())
    return rf"""
WITH t(id, b) AS (VALUES {quoted}),
u AS (SELECT doc_id, unnest(list_distinct(list_concat(string_split(text, chr(10)), string_split_regex(text, '\n[\x20\x09-\x0D]*\n'), [text]))) AS unit
      FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(unit), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM u),
g AS (SELECT doc_id, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS g FROM w WHERE len(w) > 1),
s AS (SELECT row_number() OVER () AS k, doc_id, g FROM g),
x AS (SELECT k, doc_id, id, len(list_intersect(g, b)) * 2.0::DOUBLE / (len(g) + len(b)) AS dice FROM s, t),
y AS (SELECT doc_id, split_part(id, '#', 1) AS license_id, dice FROM x WHERE dice >= {license_scan.LEAST}
      QUALIFY row_number() OVER (PARTITION BY k ORDER BY dice DESC, id) = 1)
SELECT doc_id, license_id, max(dice) AS score, count(*)::BIGINT AS n_units FROM y GROUP BY ALL"""


OP2_SQL = _op2_sql()


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(table(spark, sf_dir, "documents"), carried=["doc_id"])
    first = F.when(F.col("taken") > 0, mixing.position(F.lit(0)))
    return plan.withColumn("first_position", first).orderBy("first_position", "row.doc_id").select(
        "row.doc_id", "size", "source_size", "target", "taken", "first_position")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5(concat('42:', doc_id)) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM d GROUP BY source),
w AS (SELECT *, ([3, 1, 2])[rk % 3 + 1] AS w, 2 * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER f, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS lv
      FROM w WINDOW f AS (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT arg_min(lv, (cap / w, rk)) AS lv FROM l WHERE lv * w <= cap),
t AS (SELECT source, source_size, rk, least(cap::DOUBLE, g.lv * w) AS target FROM l, g),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.rk, round(t.target)::BIGINT AS demand,
             (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, (greatest(0, least(size, demand - start)) + greatest(0, least(size, demand - source_size - start)))::BIGINT AS taken,
             CASE WHEN demand > 0 THEN start::DOUBLE / demand ELSE 0.0 END AS u,
             CASE WHEN rk % 2 = 0 THEN 1.5 ELSE 0.5 END::DOUBLE AS w0, CASE WHEN rk % 2 = 0 THEN -1.0 ELSE 1.0 END::DOUBLE AS sl FROM p)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN u * 2.0::DOUBLE / (w0 + sqrt(greatest(w0 * w0 + sl * 2.0::DOUBLE * u, 0.0))) END AS first_position
FROM k"""


def op5_onebit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = onebit_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.orderBy("query_id", "rank")


def op6_boilerplate_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return boilerplate_crf.judge(docs, boilerplate_crf.train(docs, table(spark, sf_dir, "labels")))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    # conversation -7: texts that look like the template's own marks
    said = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(said)
    read = chat_format.format_chat(turns).select(
        "conv_id", "formatted", "valid", chat_format.parse_chat(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("segments")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
                       F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("bigint").alias("formatted_chars"), "valid")


OP7_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
l AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
             lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NULL AS last FROM c),
m AS (SELECT *, length(text) + len(regexp_extract_all(text, '\[\\*(?:/?SYS|/?INST|/?ROLE)\]|<\\*/?s>')) AS chars FROM l)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE 21 + length(role) END)::BIGINT AS formatted_chars,
       coalesce(bool_and(CASE role WHEN 'system' THEN before IS NULL WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant')
                                   WHEN 'assistant' THEN before = 'user' ELSE false END)
                AND bool_or(last AND role = 'assistant'), false) AS valid
FROM m GROUP BY conv_id"""


def op8_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = golay_simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_dropout.encode(table(spark, sf_dir, "documents"), merge_dropout.read_model(MODEL))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return records.select(warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest",
                          F.col("warc_type").alias("record_type"), warc.page_of(F.col("refers_to")).alias("refers_to"))


OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS kept FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND kept <> page_id THEN kept END AS refers_to FROM m"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.branched(table(spark, sf_dir, "conversations")))


# CRC-32 of the decimal digits, by half bytes; the table is made by the polynomial.
OP11_SQL = r"""
WITH ids AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base FROM conversations WHERE conv_id IS NOT NULL),
b AS (SELECT unnest(range(16)) AS i),
b1 AS (SELECT i, CASE WHEN i & 1 = 1 THEN xor(i >> 1, 3988292384) ELSE i >> 1 END AS x FROM b),
b2 AS (SELECT i, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END AS x FROM b1),
b3 AS (SELECT i, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END AS x FROM b2),
b4 AS (SELECT i, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END AS x FROM b3),
t AS (SELECT list(x ORDER BY i) AS t FROM b4),
c AS (SELECT conv_id, base, xor(list_reduce(list_prepend(4294967295, flatten([[ord(d) & 15, ord(d) >> 4] FOR d IN string_split(conv_id::VARCHAR, '')])),
             lambda a, n: xor(a >> 4, t[(xor(a, n) & 15) + 1])), 4294967295) % 6 AS h FROM ids, t),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
             coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
g AS (SELECT c.conv_id, o.pos, o.role, o.text FROM c JOIN o ON o.conv_id = c.base WHERE o.pos < c.h),
m AS (SELECT c.conv_id, c.h, count(g.pos) AS taken FROM c LEFT JOIN g USING (conv_id) GROUP BY ALL),
s AS (SELECT * FROM g UNION ALL SELECT o.conv_id, m.taken + o.pos - m.h, o.role, o.text FROM o JOIN m USING (conv_id) WHERE o.pos >= m.h),
k AS (SELECT conv_id, pos + 1 AS depth, length(text) AS chars,
             md5(string_agg(md5(length(role)::VARCHAR || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY pos)) AS k FROM s
      UNION ALL SELECT conv_id, 0, 0, '' FROM m),
e AS (SELECT conv_id, max(depth) AS depth FROM k GROUP BY conv_id),
n AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM k GROUP BY k, depth),
x AS (SELECT k.k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM k JOIN e USING (conv_id, depth) GROUP BY k.k),
p AS (SELECT n.k, up.k AS parent_k, upn.conv_id AS parent_conv_id FROM n JOIN k up ON up.conv_id = n.conv_id AND up.depth = n.depth - 1
      JOIN n upn ON upn.k = up.k),
q AS (SELECT parent_k AS k, count(*) AS n_children FROM p GROUP BY ALL),
w AS (SELECT a.k, sum((n.n_convs - 1) * n.chars) AS saved, count(*) FILTER (q.k IS NULL) AS leaves
      FROM n JOIN k a ON a.conv_id = n.conv_id AND a.depth <= n.depth LEFT JOIN q ON q.k = n.k GROUP BY a.k)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(q.n_children, 0)::BIGINT AS n_children,
       w.leaves::BIGINT AS n_leaves, w.saved::BIGINT AS saved_tokens, coalesce(x.ends, sha256('')) AS ends_sha256
FROM n JOIN w USING (k) LEFT JOIN p USING (k) LEFT JOIN q USING (k) LEFT JOIN x USING (k)"""


def op12_backoff_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return backoff_langid.predict(docs, backoff_langid.train(docs))


def op13_fptree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fptree_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, row_number() OVER () AS q, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
s AS (SELECT count(*)::BIGINT AS nn, sum(len(t))::BIGINT AS ll FROM d WHERE len(t) > 0),
f AS (SELECT k, any_value(doc_id) AS doc_id, any_value(n) AS n, t, count(*)::BIGINT AS tf
      FROM (SELECT k, doc_id, len(t)::BIGINT AS n, unnest(t) AS t FROM d) GROUP BY k, t),
w AS (SELECT t, floor(1000::DOUBLE * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, s GROUP BY t),
a AS (SELECT q, any_value(item_id) AS item_id, t, count(*)::BIGINT AS times FROM i GROUP BY q, t),
r AS (SELECT q, any_value(item_id) AS item_id, any_value(doc_id) AS doc_id,
             sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))))::BIGINT AS score
      FROM a JOIN w USING (t) JOIN f USING (t), s GROUP BY q, k)
SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY rank <= 20"""


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {n: f for n, f in globals().items() if n.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracles() -> dict[str, str]:
    by_number = {n.split("_")[0].upper() + "_SQL": n for n in queries()}
    return {by_number[k]: v for k, v in globals().items() if k in by_number}
