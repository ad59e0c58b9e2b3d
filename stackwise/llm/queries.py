"""The registered queries of this package: thin callers of the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from stackwise.llm import decontaminate, extract, langid, mixing, packing, quality, repair, resample, simhash, tokencount, topk, vecdedup, warc
from stackwise.session import table


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.by_position(mixed.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position")))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.detect(table(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair.repaired(repair.damaged(conversations), conversations)


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_quality": op2_quality,
    "op3_mix": op3_mix,
    "op4_language": op4_language,
    "op5_warc": op5_warc,
    "op6_simhash": op6_simhash,
    "op7_topk": op7_topk,
    "op8_near_vectors": op8_near_vectors,
    "op9_count_tokens": op9_count_tokens,
    "op10_extract": op10_extract,
    "op11_repair": op11_repair,
    "op12_resample": op12_resample,
    "op13_decontaminate": op13_decontaminate,
}

WORDS_SQL = "len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))"


def crc32_sql(text: str) -> str:
    """CRC-32 of a string's UTF-8 bytes."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::INT, 2))::BIGINT)"
    bits = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: {bits}), 4294967295)"


LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PLAIN_WORDS_SQL = f"regexp_extract_all({LOWER_SQL}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_BARE = "rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
#: The cheapest suffix (cost, audit) after role ``t`` if the row is kept or reroled to ``r`` behind ``x`` inserts.
_RETAIN = lambda r, x: f"[{{'c': f[{r}].c + own[{r}] + {2 * x}, 'a': '{'I' * x}' || CASE WHEN code = {r} THEN 'K' ELSE 'R' END || f[{r}].a}}]"
_WAYS = {0: [(1, 0), (2, 0), (3, 1)], 1: [(2, 0), (3, 1)], 2: [(3, 0), (2, 1)], 3: [(2, 0), (3, 1)]}
_BEST = lambda t: f"list_min([{{'c': f[{t or 4}].c + 3, 'a': 'D' || f[{t or 4}].a}}] || " + " || ".join(_RETAIN(*w) for w in _WAYS[t]) + ")"

ORACLES: dict[str, str] = {
    "op11_repair": f"""
WITH RECURSIVE k AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substr(text, 1, 100), sha256(text)) AS pos FROM d),
g AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n,
    CASE WHEN {_BARE} = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2 WHEN right({_BARE}, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS code,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair FROM o),
w AS MATERIALIZED (SELECT *, list_transform([1, 2, 3], lambda r: CASE WHEN fault IN (1, 2) OR (r = 1 AND code <> 1) THEN 1000000000 WHEN code = r THEN 0 ELSE 2 END + CASE fault WHEN 3 THEN 1 ELSE 0 END) AS own FROM g),
f AS (SELECT DISTINCT conv_id, n + 1 AS pos, [{{'c': 4::BIGINT, 'a': 'II'}}, {{'c': 2::BIGINT, 'a': 'I'}}, {{'c': 0::BIGINT, 'a': ''}}, {{'c': 0::BIGINT, 'a': ''}}] AS f FROM g
  UNION ALL SELECT w.conv_id, w.pos, [{_BEST(1)}, {_BEST(2)}, {_BEST(3)}, {_BEST(0)}]
  FROM f JOIN w ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.pos = f.pos - 1),
b AS (SELECT conv_id, f[4].c AS cost, f[4].a AS audit FROM f WHERE pos = 1),
e AS (SELECT conv_id, i, audit[i] AS op, i - length(replace(audit[:i], 'I', '')) AS inserted FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS i FROM b)),
l AS (SELECT e.conv_id, e.i, e.op, w.role, w.text, w.code, row_number() OVER (PARTITION BY e.conv_id ORDER BY e.i) AS line,
    first_value(CASE WHEN e.op = 'K' AND w.code = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id ORDER BY e.i) AS system
  FROM e LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM e.conv_id AND e.op <> 'I' AND w.pos = e.i - e.inserted WHERE e.op <> 'D'),
r AS (SELECT conv_id, sha256(string_agg(CASE op WHEN 'K' THEN role ELSE CASE (line - system) % 2 WHEN 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE op WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY line)) AS h FROM l GROUP BY conv_id),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
SELECT c.conv_id, coalesce(s.gaps, 0)::BIGINT AS gaps, coalesce(s.blank, 0)::BIGINT AS blank, coalesce(s.duplicate, 0)::BIGINT AS duplicate, coalesce(s.truncated, 0)::BIGINT AS truncated, coalesce(s.illegal, 0)::BIGINT AS illegal,
  coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, coalesce(r.h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id""",
    "op12_resample": f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, {PLAIN_WORDS_SQL} AS w FROM documents),
x AS MATERIALIZED (SELECT id, unnest(w) AS word FROM d), y AS (SELECT unnest({PLAIN_WORDS_SQL}) AS word FROM benchmark),
v AS MATERIALIZED (SELECT word, {crc32_sql("word")} % 10000 AS bucket FROM (SELECT word FROM x UNION SELECT word FROM y)),
c AS (SELECT b.bucket, coalesce(s.n, 0)::DOUBLE AS s, coalesce(t.n, 0)::DOUBLE AS t FROM range(10000) b(bucket)
  LEFT JOIN (SELECT bucket, count(*) AS n FROM x JOIN v USING (word) GROUP BY bucket) s USING (bucket) LEFT JOIN (SELECT bucket, count(*) AS n FROM y JOIN v USING (word) GROUP BY bucket) t USING (bucket)),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM c),
w AS (SELECT id, sum(gain)::BIGINT AS weight FROM x JOIN v USING (word) JOIN g USING (bucket) GROUP BY id),
p AS (SELECT id, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (id)),
q AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM q)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= floor(10 * n / 100) THEN place END AS rank FROM r""",
    "op13_decontaminate": f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, {PLAIN_WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, {PLAIN_WORDS_SQL} AS w FROM benchmark),
v AS MATERIALIZED (SELECT DISTINCT coalesce(item_id, '') AS item_id, w[i:i + 9] AS g FROM b, range(1, greatest(1, len(w) - 9) + 1) r(i) WHERE len(w) > 0),
m AS MATERIALIZED (SELECT DISTINCT len(g) AS n FROM v),
x AS MATERIALIZED (SELECT id, i, n, w[i:i + n - 1] AS g FROM d, m, range(1, len(w) - n + 2) r(i)),
h AS MATERIALIZED (SELECT DISTINCT id, i, n, g FROM x WHERE g IN (SELECT g FROM v)),
c AS (SELECT id, count(DISTINCT i + k) AS n_hit FROM h, range(n) r(k) GROUP BY id),
t AS (SELECT id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT id, item_id FROM h JOIN v USING (g)) GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (id) LEFT JOIN t USING (id)""",
    "op3_mix": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {WORDS_SQL}::BIGINT AS size, md5(doc_id::VARCHAR) AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s AS (SELECT source, source_size, 3 * source_size AS cap,
        CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s0),
lv AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
          / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
       FROM s WINDOW o AS (ORDER BY cap / weight, source IS NULL, source)),
lf AS (SELECT *, first_value(CASE WHEN level * weight < cap THEN level END IGNORE NULLS) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS free FROM lv),
t AS (SELECT source, source_size, weight, coalesce(free * weight, cap::DOUBLE) AS target FROM lf),
u AS (SELECT *, target / sum(target) OVER () AS share, weight::DOUBLE / max(weight) OVER () AS l0 FROM t),
v AS (SELECT *, 0.5 * (l0 - sum(share * l0) OVER ()) AS lean FROM u),
q AS (SELECT d.*, t.source_size, t.target, t.lean, round(t.target)::BIGINT AS due,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin
      FROM d JOIN v t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CASE WHEN source_size > 0 THEN due // source_size ELSE 0 END AS rounds FROM q),
p AS (SELECT *, greatest(0, least(size, due - rounds * source_size - begin)) AS last FROM k)
SELECT doc_id, size, source_size, target, (rounds * size + last)::BIGINT AS taken,
  CASE WHEN size = 0 OR rounds + (last > 0)::INT = 0 THEN NULL ELSE round(2 * (begin / target) / ((1 - lean) + sqrt((1 - lean) * (1 - lean) + 4 * lean * (begin / target))), 9) END AS position
FROM p""",
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS top FROM p GROUP BY h),
d AS (SELECT DISTINCT h, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS digest FROM p)
SELECT p.page_id, strlen(p.body)::BIGINT AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN g.top IS NULL OR p.page_id IS NOT DISTINCT FROM g.top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN g.top IS NULL OR p.page_id IS NOT DISTINCT FROM g.top THEN NULL ELSE g.top END AS refers_to
FROM p JOIN g USING (h) JOIN d USING (h)""",
    "op7_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
