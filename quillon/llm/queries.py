"""The queries of the training-data operators and, where SQL expresses them, their SQL.

Each query applies its operator to its whole table and derives digest columns from what it returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, clusters, decontaminate, licenses, mixing, pii, quality, repeats, simhash, tokens, urls, warc
from .common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_output(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, width=64, radius=2)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


ORACLES["op1_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), CAST([] AS VARCHAR[])) AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item, pos.n, i FROM pos JOIN win USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed_sizes(table(spark, sf_dir, "documents"), weights=(5, 2, 1), budget=1.5, cap=2.0)
    return found.select("doc_id", "size", "source_size", "target", "taken", "shards")


#: (verdict, host, path)
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list is the URLs of the pages whose id is divisible by 50."""
    pages = table(spark, sf_dir, "pages")
    return urls.judge_urls(pages, URL_RULES, pages.where("page_id % 50 = 0")).drop("listed")


_HOST = r"translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op7_url_filter"] = rf"""
WITH p AS (SELECT page_id, url, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, {_HOST} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
c AS (SELECT *, CASE WHEN url LIKE '%://%' THEN
        regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(regexp_replace(path, '/+$', ''), '\.html?$', '')
        || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[a-z]+|ref|fbclid|gclid)='))), '&'), ''), '') END AS key FROM h),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT page_id, c.url AS u, max_by(struct_pack(v := verdict, t := rhost || rpath), length(rhost || rpath)) AS best FROM c JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id, c.url)
SELECT c.page_id, host, path, best.t AS rule,
       coalesce(best.v, CASE WHEN key IN (SELECT key FROM c WHERE page_id % 50 = 0 AND key IS NOT NULL) THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN m ON c.page_id = m.page_id AND c.url = m.u
"""


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find_personal_data(table(spark, sf_dir, "documents")))


@query
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return chat.report(chat.format_conversations(rows.unionByName(more)))


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url", "payload")


ORACLES["op8_chat_format"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, length(role) + length(regexp_replace(role, '[^\\#<\[]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\#<\[]', '', 'g')) + 14 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLES["op10_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
g AS (SELECT s, max(page_id) AS top FROM p GROUP BY s),
b AS (SELECT page_id, h, s, array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', s[i])]), '') AS bits FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT) + 4 * CAST(bits[5 * i + 3] AS INT) + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT)]), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM b JOIN g USING (s)
"""


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.find_licenses(table(spark, sf_dir, "documents")))


_LICENSES = ", ".join(f"({n!r}, {ok}, '" + t.replace("'", "''") + "')" for n, ok, t in licenses.TEMPLATES)
_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLES["op5_license_scan"] = f"""
WITH t(name, allowed, text) AS (VALUES {_LICENSES}),
tw AS (SELECT name, allowed, {_WORDS} AS w FROM t),
ts AS (SELECT DISTINCT name, allowed, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT name, allowed, w, unnest(range(1, len(w) - 3)) AS i FROM tw)),
dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
ds AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw)),
m AS (SELECT doc_id, name, allowed, count(DISTINCT s) AS n, min(pos) AS first_word, max(pos) + 5 AS last_word FROM ds JOIN ts USING (s) GROUP BY ALL),
ok AS (SELECT m.* FROM m JOIN (SELECT name, count(*) AS all_n FROM ts GROUP BY name) USING (name) WHERE n / all_n >= 0.8),
a AS (SELECT doc_id, count(*) AS n_licenses, string_agg(name || ':' || first_word || ':' || last_word, ',' ORDER BY name) AS licenses, bool_and(allowed) AS good FROM ok GROUP BY doc_id)
SELECT doc_id, coalesce(n_licenses, 0) AS n_licenses, coalesce(licenses, '') AS licenses, CASE WHEN n_licenses IS NULL THEN 'none' WHEN good THEN 'allowed' ELSE 'denied' END AS verdict
FROM documents LEFT JOIN a USING (doc_id)
"""


@query
def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.report(clusters.cluster(table(spark, sf_dir, "embeddings"), 40, 5, dims=64, scale=256, seed="2"))


def _rounds(n: int) -> str:
    """Centroids c0 are given; a0, c1, a1 and so on follow, to a{n}."""
    dot = lambda a, b: f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
    out = []
    for i in range(n + 1):
        far = f"CAST({dot('k.v', 'k.v')} - 2 * {dot('k.v', 'c.v')} + {dot('c.v', 'c.v')} AS BIGINT)"
        out.append(f"a{i} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, arg_min(c, struct_pack(d := d, c := c)) AS c, min(d) AS d FROM (SELECT k.vec_id, k.v, c.c, {far} AS d FROM kept k, c{i} c) GROUP BY vec_id)")
        out.append(
            f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM (SELECT c, j, sum(v[j]) AS s, count(*) AS n FROM (SELECT c, v, unnest(range(1, 65)) AS j FROM a{i}) GROUP BY c, j) GROUP BY c) m USING (c))"
        )
    return ",\n".join(out)


ORACLES["op11_clustering"] = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v FROM kept ORDER BY c LIMIT 40),
{_rounds(5)},
i AS (SELECT c, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a5 GROUP BY c)
SELECT vec_id, CAST(a5.c AS INTEGER) AS cluster, d AS distance, cluster_inertia, CAST((SELECT sum(d) FROM a5) AS BIGINT) AS inertia,
       sha256(array_to_string(c5.v, ',')) AS centroid_sha256
FROM a5 JOIN c5 USING (c) JOIN i USING (c)
"""


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).documents


@query
def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(repeats.remove_repeats(table(spark, sf_dir, "documents"), 50))


ORACLES["op12_repeats"] = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, h[2 * i + 1:2 * i + 100] AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
hit AS (SELECT w.doc_id, i FROM w JOIN (SELECT s, min(doc_id) AS low FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)) USING (s) WHERE w.doc_id > low),
far AS (SELECT *, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 50, true) AS new FROM hit),
n AS (SELECT doc_id, i, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM far),
spans AS (SELECT doc_id, span, min(i) AS a, max(i) + 50 AS b FROM n GROUP BY doc_id, span),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t, a, b FROM spans
         UNION ALL SELECT doc_id, max(b), NULL, NULL, NULL FROM spans GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(h[2 * f + 1:CASE WHEN t IS NULL THEN length(h) ELSE 2 * t END], '' ORDER BY f) AS kept, CAST(sum(b - a) AS BIGINT) AS n_removed, count(a) AS n_spans FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
