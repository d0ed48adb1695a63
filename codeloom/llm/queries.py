"""The registered queries of this subpackage, each an operator over its whole table, and their SQL where there is any."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25_search, conversation_repair, decontamination, extendible_hashing, fair_mix, importance, jaccard_join, line_dedup, substring_dedup, token_files, toxicity, warc, whitening
from .common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), window=50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), phrase=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents"), run=3)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    found = importance.resample(table(spark, sf_dir, "documents"), labels.where("quality = 1"), importance.target_share(labels))
    return found.select("doc_id", "n_grams", "log_weight", "gumbel_key", "kept")


def op6_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", F.size("offending").alias("n_offending"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op9_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = bm25_search.top_k(docs, docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text"), k=10)
    return found.withColumn("score", F.round("score", 6))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_hashing.shard(table(spark, sf_dir, "documents"), extendible_hashing.QUERY_SHARD_BYTES).select("doc_id", "n_bytes", "depth", "prefix", "page", "shard")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=2)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), k=16)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.damage_and_repair(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_decontamination, op3_line_dedup, op4_warc, op5_importance, op6_fair_mix, op7_toxicity, op8_jaccard_join, op9_search, op10_sharding, op11_token_files, op12_whitening, op13_conversation_repair)}

_SPACED = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op1_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_SPACED.format("text")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
first AS (SELECT k, min(doc_id) AS owner FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT win.doc_id, win.i FROM win JOIN first USING (k) WHERE owner < doc_id), range(0, 50) AS r(j)),
kept AS (SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.p) AS t, count(*) AS n
         FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) AS w ANTI JOIN gone ON gone.doc_id = w.doc_id AND gone.p = w.p GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op2_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS k
      FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
win AS (SELECT doc_id, i, n, array_to_string(w[i:i+n-1], ' ') AS k
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p))),
hit AS (SELECT DISTINCT doc_id, i, win.n, item_id FROM win JOIN p USING (n, k)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS t FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op3_line_dedup": """
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
c AS (SELECT doc_id, i, trim(line) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM l WHERE trim(line) <> ''),
win AS (SELECT doc_id, p, {'a': t, 'b': lead(t) OVER o, 'c': lead(t, 2) OVER o} AS k, lead(t, 2) OVER o IS NOT NULL AS whole FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
first AS (SELECT k, min({'d': doc_id, 'p': p}) AS f FROM win WHERE whole GROUP BY k),
later AS (SELECT doc_id, p FROM win JOIN first USING (k) WHERE whole AND {'d': doc_id, 'p': p} > f),
gone AS (SELECT DISTINCT c.doc_id, c.i FROM c JOIN (SELECT doc_id, unnest(range(p, p + 3)) AS p FROM later) AS x ON c.doc_id = x.doc_id AND c.p = x.p),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) AS t, count(*) AS n FROM l ANTI JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op4_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, coalesce(html, '') AS h FROM pages),
best AS (SELECT h, max(page_id) AS top FROM p WHERE octet_length(b) >= 1000 GROUP BY h)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN best USING (h)""",
    "op6_fair_mix": f"""
WITH d AS (SELECT doc_id, source, CAST(len({_SPACED.format("text")}) AS BIGINT) AS size, CAST('0x' || substr(md5('{fair_mix.SEED}|' || doc_id || '|' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS turn FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT source, source_size, CAST([5, 2, 1][(place - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * CAST(3 AS DOUBLE) AS most FROM s),
-- sources fill up one after the other as the level of words for each unit of weight rises
levels AS (SELECT ((SELECT sum(source_size) FROM w) - coalesce(sum(w.most) FILTER (w.most / w.weight <= c.full_at), 0)) / sum(w.weight) FILTER (w.most / w.weight > c.full_at) AS level
           FROM (SELECT most / weight AS full_at FROM w UNION SELECT -1) AS c, w GROUP BY c.full_at),
t AS (SELECT source, source_size, least(most, weight * (SELECT max(level) FROM levels)) AS target FROM w),
q AS (SELECT d.doc_id, d.size, d.source, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY turn, doc_id) AS through FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CAST(through + epoch * source_size AS DOUBLE) / target AS finish FROM q, range(0, 3) AS r(epoch) WHERE size > 0 AND target > 0),
v AS (SELECT doc_id, count(*) AS copies FROM (SELECT doc_id, sum(size) OVER (ORDER BY finish, source NULLS FIRST, doc_id, epoch) AS served FROM c) WHERE served <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT doc_id, size, source_size, target, CAST(size * coalesce(copies, 0) AS BIGINT) AS taken, source FROM q LEFT JOIN v USING (doc_id)""",
    "op8_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED.format(_LOWER.format("text"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s AS a JOIN s AS b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, x.b FROM reach AS r JOIN both_ways AS x ON r.b = x.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(least(d.doc_id, coalesce(m.m, d.doc_id)) AS BIGINT) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) AS m USING (doc_id)""",
    "op9_search": rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents),
tf AS (SELECT doc_id, w, count(*) AS tf FROM t GROUP BY ALL),
size AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY doc_id),
df AS (SELECT w, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY w),
average AS (SELECT sum(n) / (SELECT count(*) FROM documents) AS a FROM size),
hit AS (SELECT q.doc_id AS query_id, d.doc_id, round(sum(q.tf * idf * d.tf * {bm25_search.K1 + 1} / (d.tf + {bm25_search.K1} * ({1 - bm25_search.B} + {bm25_search.B} * n / a))), 6) AS score
        FROM tf AS q JOIN df USING (w) JOIN tf AS d USING (w) JOIN size ON size.doc_id = d.doc_id, average WHERE q.doc_id % 20 = 0 GROUP BY ALL),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM hit WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10""",
    "op10_sharding": f"""
WITH d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 10) AS BIGINT) AS h FROM documents),
p AS (SELECT doc_id, n_bytes, CAST(r.depth AS INTEGER) AS depth, h >> (40 - CAST(r.depth AS INTEGER)) AS prefix FROM d, range(0, 41) AS r(depth)),
b AS (SELECT depth, prefix, sum(n_bytes) AS total FROM p WHERE n_bytes <= {extendible_hashing.QUERY_SHARD_BYTES} GROUP BY ALL),
leaf AS (SELECT doc_id, n_bytes, min(depth) AS depth FROM p JOIN b USING (depth, prefix) WHERE total <= {extendible_hashing.QUERY_SHARD_BYTES} AND n_bytes <= {extendible_hashing.QUERY_SHARD_BYTES} GROUP BY ALL)
SELECT doc_id, leaf.n_bytes, depth, p.prefix, CAST(0 AS BIGINT) AS page, concat_ws(':', depth, p.prefix, 0) AS shard FROM leaf JOIN p USING (doc_id, n_bytes, depth)
UNION ALL SELECT doc_id, n_bytes, 40, h, CAST(0 AS BIGINT), concat_ws(':', 'big', h, 0) FROM d WHERE n_bytes > {extendible_hashing.QUERY_SHARD_BYTES}""",
    "op13_conversation_repair": r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations),
m AS (SELECT h.*, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(id, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS hurt FROM h, crc),
d AS (SELECT conv_id, turn, CASE hurt WHEN 4 THEN 'user' ELSE role END AS role, CASE hurt WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE hurt WHEN 3 THEN [0, 1] ELSE [0] END) AS again FROM m WHERE hurt <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i FROM d),
f AS (SELECT *, left(role, 1) AS own, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
             WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault FROM o),
-- states: 0 nothing yet, 1 system, 2 user, 3 assistant; and the turn that may come next
nx AS (SELECT * FROM (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')) AS v(q, nxt, name)),
ins AS (SELECT q, 0 AS n, q AS here, '' AS pre FROM nx UNION ALL SELECT q, 1, nxt, chr(10) || name || ':' FROM nx
        UNION ALL SELECT a.q, 2, b.nxt, chr(10) || a.name || ':' || chr(10) || b.name || ':' FROM nx AS a JOIN nx AS b ON b.q = a.nxt),
edit AS (SELECT unnest(['D', 'K', 'R']) AS e),
s(conv_id, i, q, v) AS (
    SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, {'c': CAST(0 AS BIGINT), 'a': '', 'r': ''} FROM f
    UNION ALL
    SELECT s.conv_id, s.i + 1, CASE WHEN e = 'D' THEN ins.here WHEN e = 'K' AND own = 's' THEN 1 ELSE nxt END AS nq,
           min({'c': CAST(v.c + 5 * n + CASE e WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN e <> 'D' AND fault = 't' THEN 5 ELSE 0 END AS BIGINT), 'a': v.a || repeat('I', n) || e,
                'r': v.r || pre || CASE e WHEN 'D' THEN '' WHEN 'R' THEN chr(10) || name || ':' || text ELSE chr(10) || role || ':' || text END})
    FROM s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1 JOIN ins ON ins.q = s.q JOIN nx ON nx.q = ins.here, edit
    WHERE e = 'D' OR fault NOT IN ('b', 'd') AND (e = 'R' OR own = 's' AND ins.here = 0 OR own = left(name, 1))
    GROUP BY ALL),
fin AS (SELECT conv_id, max(i) AS i, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
                count(*) FILTER (fault = 't') AS truncated FROM f GROUP BY conv_id),
pairs AS (SELECT conv_id, own || lead(own) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM f),
illegal AS (SELECT conv_id, count(*) AS illegal FROM pairs WHERE p NOT IN ('su', 'ua', 'au') GROUP BY conv_id),
ended AS (SELECT s.conv_id, min({'c': v.c + 5 * n, 'a': v.a || repeat('I', n), 'r': v.r || pre}) AS v FROM s JOIN fin ON fin.conv_id IS NOT DISTINCT FROM s.conv_id AND fin.i = s.i JOIN ins USING (q) WHERE here IN (0, 3) GROUP BY s.conv_id),
convs AS (SELECT DISTINCT conv_id FROM conversations)
SELECT convs.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(v.c, 0) AS cost, coalesce(v.a, '') AS audit, sha256(coalesce(substr(v.r, 2), '')) AS repaired_sha256
FROM convs LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM convs.conv_id LEFT JOIN illegal ON illegal.conv_id IS NOT DISTINCT FROM convs.conv_id LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM convs.conv_id""",
}
