"""The thirteen operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.bitslice import top_k
from gleaner.llm.decontaminate import leaks
from gleaner.llm.divergence import source_divergence
from gleaner.llm.jaccard_join import jaccard_classes
from gleaner.llm.kneser_ney import perplexities
from gleaner.llm.lexical import ranked_search
from gleaner.llm.line_dedup import line_report
from gleaner.llm.media import text_media
from gleaner.llm.mixing import label_domains, mixture
from gleaner.llm.substring_dedup import substring_dedup
from gleaner.llm.toxicity import severities
from gleaner.llm.url_filter import filter_urls
from gleaner.llm.warc import archive_pages, read_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(_table(spark, sf_dir, "documents"), min_docs=3, min_chars=20)


@_query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severities(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), max_labelled=8000)


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@_query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(_table(spark, sf_dir, "pages"), rules, default="allow")


@_query
def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(_table(spark, sf_dir, "documents"))


@_query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = archive_pages(_table(spark, sf_dir, "pages"), min_revisit_bytes=0)
    return read_pages(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query
def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_table(spark, sf_dir, "documents"), n=4, percent=85)


@_query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = {"clean": 0.90, "junk": 0.07, "toxic": 0.03}
    mixed = mixture(_table(spark, sf_dir, "documents"), label_domains(_table(spark, sf_dir, "labels")), targets)
    return mixed.select("doc_id", "n_tokens", *(mixed.p[i].alias(f"p_{name}") for i, name in enumerate(targets)), "rate", "residual")


@_query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexities(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"), stable=True)


@_query
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op11_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


@_query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"), min_docs=3, most=200)


@_query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


_KEY = "translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op1_line_dedup"] = f"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM parts),
keyed AS (SELECT *, {_KEY} AS key FROM lines),
often AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT k.doc_id, k.line, k.pos, coalesce(k.doc_id < o.keeper, false) AS gone FROM keyed k LEFT JOIN often o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""

ORACLES["op3_url_filter"] = r"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
bare AS (SELECT page_id, regexp_extract(rest, '^[^?#]*') AS rest FROM cut),
urls AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM bare),
rules(rhost, rpath, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (SELECT page_id, host, path, rhost || rpath AS rule, v,
                row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS r
         FROM urls JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.v, 'allow') AS verdict FROM urls u LEFT JOIN (SELECT * FROM fits WHERE r = 1) f USING (page_id)"""

ORACLES["op5_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS keeper FROM p)
SELECT page_id, octet_length(encode(body)) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INT), 5))::INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM k"""

_WORD = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES["op9_substring_dedup"] = f"""
WITH d AS (SELECT doc_id, {_WORD} AS w FROM documents),
wins AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
keyed AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS r FROM wins JOIN d USING (doc_id)),
cover AS (SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, unnest(range(i, i + 20)) AS pos FROM keyed WHERE r > 1)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
judged AS (SELECT x.doc_id, x.word, x.pos, c.pos IS NOT NULL AS gone FROM words x LEFT JOIN cover c ON x.doc_id = c.doc_id AND x.pos = c.pos),
kept AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS m, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS t FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(m, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

ORACLES["op6_ngram_jaccard_join"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORD.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                                              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * c >= 85 * (s.n + t.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT b.y, r.c FROM reach r JOIN edges b ON b.x = r.doc_id)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(c) AS component_id
FROM d JOIN reach USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id"""

# the last 64 bytes through the bitwise CRC; exact areas in whole units, halves rounded up; the tile as an NPY file
ORACLES["op4_media_columns"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS raw FROM documents),
p AS (SELECT *, length(raw) // 2 AS n_bytes, greatest(1, (length(raw) + 127) // 128) AS h FROM d),
f AS (SELECT doc_id, n_bytes, h, rpad(raw, CAST(h * 128 AS INT), '0') AS full_hex FROM p),
lines AS (SELECT doc_id, h, j, substr(full_hex, j * 128 + 1, 128) AS line FROM (SELECT *, unnest(range(h)) AS j FROM f)),
px AS (SELECT doc_id, h, j, list_transform(range(64), lambda i: ('0x' || substr(line, i * 2 + 1, 2))::BIGINT) AS v FROM lines),
wide AS (SELECT doc_id, h, j, c, list_sum(list_transform(range(64), lambda i: v[i + 1] * greatest(0, least(9 * (i + 1), 64 * (c + 1)) - greatest(9 * i, 64 * c)))) AS s
         FROM (SELECT *, unnest(range(9)) AS c FROM px)),
cells AS (SELECT doc_id, h, r, c, sum(s * greatest(0, least(8 * (j + 1), h * (r + 1)) - greatest(8 * j, h * r)))::BIGINT AS t
          FROM wide, range(8) AS x(r) WHERE 8 * (j + 1) > h * r AND 8 * j < h * (r + 1) GROUP BY ALL),
tiles AS (SELECT doc_id, list((2 * t + 64 * h) // (128 * h) ORDER BY r, c) AS q FROM cells GROUP BY doc_id),
bits AS (SELECT doc_id, q, list_transform(range(64), lambda i: CASE WHEN q[i // 8 * 9 + i % 8 + 2] > q[i // 8 * 9 + i % 8 + 1] THEN 1 ELSE 0 END) AS b FROM tiles),
crc AS (SELECT doc_id, list_reduce(list_concat([4294967295::BIGINT], v), lambda a, x:
               list_reduce(list_concat([xor(a, x)], [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]), lambda y, k: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END)) AS a
        FROM px WHERE j = h - 1)
SELECT f.doc_id, n_bytes::BIGINT AS n_bytes, (64 * h)::BIGINT AS payload_bytes, sha256(unhex(full_hex)) AS payload_sha256, xor(a, 4294967295::BIGINT) AS tail_crc32,
       octet_length(encode('P5' || chr(10) || '64 ' || h || chr(10) || '255' || chr(10)) || unhex(full_hex)) AS media_bytes,
       sha256(encode('P5' || chr(10) || '64 ' || h || chr(10) || '255' || chr(10)) || unhex(full_hex)) AS media_sha256,
       array_to_string(list_transform(range(8), lambda r: printf('%02x', list_sum(list_transform(range(8), lambda i: b[r * 8 + i + 1] * (1 << (7 - i))))::INT)), '') AS feature,
       sha256(unhex('934E554D505901007600') || encode(rpad('{''descr'': ''|u1'', ''fortran_order'': False, ''shape'': (8, 9), }', 117, ' ') || chr(10))
              || unhex(array_to_string(list_transform(q, lambda t: printf('%02X', t::INT)), ''))) AS tile_sha256
FROM f JOIN bits USING (doc_id) JOIN crc USING (doc_id)"""

_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

ORACLES["op11_bitsliced_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""

ORACLES["op12_source_divergence"] = rf"""
WITH d AS (SELECT row_number() OVER () AS no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT no, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT no) >= 3),
sizes AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM kept GROUP BY lang),
groups AS (SELECT g.lang, g.source, coalesce(s.v, 0) AS v, coalesce(s.total, 0) AS lang_total FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN sizes s USING (lang)),
counted AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT g.*, coalesce(t.total, 0) AS total FROM groups g LEFT JOIN (SELECT lang, source, sum(n)::BIGINT AS total FROM counted GROUP BY ALL) t USING (lang, source)),
dense AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (t.total + t.v) AS p, 1 + 1000000000 * (k.n + 1) // (t.lang_total + t.v) AS q
          FROM totals t JOIN kept k USING (lang) LEFT JOIN counted c USING (lang, source, term)),
others AS (SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
far AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM dense a JOIN dense b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
both_parts AS (SELECT o.lang, o.source, 'pair' AS part, o.item, coalesce(f.value, 0) AS value FROM others o LEFT JOIN far f USING (lang, source, item)
          UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM dense WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM both_parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200"""

_ALNUM = rf"regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES["op13_ranked_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS no, doc_id, {_ALNUM} AS w FROM documents),
words AS (SELECT no, doc_id, len(w) AS n, unnest(w) AS term FROM d),
tf AS (SELECT no, doc_id, n, term, count(*) AS tf FROM words GROUP BY ALL),
corpus AS (SELECT count(*) FILTER (len(w) > 0) AS docs, sum(len(w))::BIGINT AS terms FROM d),
df AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, corpus GROUP BY term),
items AS (SELECT row_number() OVER () AS item, item_id, {_ALNUM} AS t FROM benchmark),
asked AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(t) AS term FROM items) GROUP BY ALL),
scores AS (SELECT item, item_id, no, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
           FROM asked JOIN df USING (term) JOIN tf USING (term), corpus GROUP BY item, item_id, no, doc_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INT) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""
