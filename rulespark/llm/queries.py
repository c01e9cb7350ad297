"""The registered queries of this subpackage: thin digests over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blockmax, bytebpe, decontaminate, licenses, pieces, pivots, quality, sortmeans, tokencounts, toxicity, urls
from .neardup import near_duplicates
from .suffixdedup import remove_repeats


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.judged(quality.score(docs, model), 0.3)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), shingle=3, per_cent=85)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.round_trip(_documents(spark, sf_dir))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256", "lossless")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "item_tokens", "matched_tokens", F.round("coverage", 6).alias("coverage"), F.size("tiles").alias("n_tiles"), F.array_min("tiles.doc_start").alias("first_token"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_documents(spark, sf_dir))
    return found.withColumn("coverage", F.round("coverage", 6))


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return pivots.search(vectors, F.col("vec_id") % 20 == 0, k=20)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(_documents(spark, sf_dir))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokencounts.count_tokens(_documents(spark, sf_dir))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_pretokens", "n_tokens")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.judged(toxicity.score(docs, model), 0.5)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sortmeans.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blockmax.search(blockmax.build(_documents(spark, sf_dir)), table(spark, sf_dir, "benchmark"), k=10)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bytebpe.round_trip(_documents(spark, sf_dir))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_classifier, op2_minhash_near_dedup, op3_sentencepiece, op4_decontamination, op5_license_scan, op6_permutation_index, op7_suffix_array_dedup, op8_token_counts, op9_toxicity, op10_url_filters, op11_centroid_clustering, op12_block_max_search, op13_byte_bpe)}

def _lloyd(rounds: int) -> str:
    """The rounds of plain k-means, one after the other."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT r, vec_id, k.q, c, list_sum(list_transform(list_zip(k.q, c{r}.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM kept k, c{r} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1
), c{r + 1} AS MATERIALIZED (
  SELECT c, list(v ORDER BY i) AS q FROM (
    SELECT c, i, ((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS v
    FROM (SELECT c, unnest(q) AS v, generate_subscripts(q, 1) AS i FROM a{r}) GROUP BY c, i) GROUP BY c
  UNION ALL SELECT c, q FROM c{r} WHERE c NOT IN (SELECT c FROM a{r})
)""")
    return ",".join(steps)


def _resolved(base: str, link: str) -> str:
    origin, path = f"regexp_extract({base}, '(?s)^(.*?://[^/?#]*)', 1)", f"regexp_extract({base}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    return rf"""CASE
    WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {link} WHEN {link} LIKE '//%' THEN regexp_extract({base}, '(?s)^(.*?:)//', 1) || {link} WHEN {link} LIKE '/%' THEN {origin} || {link}
    WHEN {link} LIKE '?%' THEN {origin} || {path} || {link} WHEN {link} LIKE '#%' THEN {base} ELSE {origin} || coalesce(nullif(regexp_extract({path}, '(?s)^(.*/)', 1), ''), '/') || {link} END"""


def _dots(x: str) -> str:
    path = f"regexp_extract({x}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    kept = f"list_reduce(list_transform(string_split({path}, '/')[2:], lambda s: [s]), lambda k, s: CASE WHEN s[1] = '.' THEN k WHEN s[1] = '..' THEN k[1:len(k) - 1] ELSE list_concat(k, s) END, []::VARCHAR[])"
    return rf"""CASE WHEN regexp_matches({path}, '/\.{{1,2}}(/|$)') THEN regexp_extract({x}, '(?s)^(.*?://[^/?#]*)', 1) || '/' || array_to_string(list_concat({kept}, CASE WHEN regexp_matches({path}, '/\.{{1,2}}$') THEN [''] ELSE [] END), '/')
    || regexp_extract({x}, '(?s)^.*?://[^?#]*(.*)$', 1) ELSE {x} END"""


def _spelled_out(sql: str) -> str:
    """The SQL of links with its patterns, and its steps of addresses, filled in."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    code = "(CASE WHEN lower(p[3]) = 'x' THEN ('0x' || regexp_extract(p, '(?i)x([0-9a-f]+)', 1))::INT ELSE regexp_extract(p, '[0-9]+')::INT END)"
    named = {"UNREAD": quoted(urls._UNREAD), "ATTRIBUTE": quoted(urls._ATTRIBUTE), "REFERENCE": quoted(urls._REFERENCE), "TARGET": quoted(urls._TARGET), "CODE": code}
    named |= {"RESOLVED(url, base)": _resolved("url", "base"), "RESOLVED(url, link)": _resolved("url", "link"), "DOTS(x)": _dots("x")}
    for name, text in named.items():
        sql = sql.replace(name, text)
    return sql


#: Exact nearest neighbours are not the index's answer, and the other queries train models, compare
#: sets, rewrite bytes or cut words: brute-force versions in tests/llm hold those.
ORACLES: dict[str, str] = {
    "op10_url_filters": _spelled_out(r"""
WITH RECURSIVE parts AS (
  SELECT page_id, url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    translate(regexp_extract(regexp_replace(url, '(?s)#.*$', ''), '(?s)^(.*?://[^/?]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_replace(regexp_replace(url, '(?s)#.*$', ''), '(?s)^.*?://[^/?]*', '') AS address,
    regexp_replace(html, UNREAD, ' ', 'g') AS html
  FROM (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages)
), tags AS (
  SELECT row_number() OVER () AS t, * FROM (
    SELECT page_id, url, address, kind, unnest(regexp_extract_all(html, pattern, 1)) AS written, generate_subscripts(regexp_extract_all(html, pattern, 1), 1) AS nth
    FROM (SELECT parts.*, 'link' AS kind, '(?is)<link[\s/]([^>]*)>' AS pattern FROM parts WHERE url <> '') UNION ALL
    SELECT page_id, url, address, kind, unnest(regexp_extract_all(html, '(?is)<meta[\s/]([^>]*)>', 1)), 0 FROM (SELECT *, 'meta' AS kind FROM parts WHERE url <> '') UNION ALL
    SELECT page_id, url, address, kind, unnest(regexp_extract_all(html, '(?is)<base[\s/]([^>]*)>', 1)), generate_subscripts(regexp_extract_all(html, '(?is)<base[\s/]([^>]*)>', 1), 1) FROM (SELECT *, 'base' AS kind FROM parts WHERE url <> ''))
), named AS (
  SELECT t, n, first(v ORDER BY i) AS v FROM (
    SELECT t, translate(unnest(regexp_extract_all(written, ATTRIBUTE, 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n, unnest(regexp_extract_all(written, ATTRIBUTE, 2)) AS v, generate_subscripts(regexp_extract_all(written, ATTRIBUTE, 1), 1) AS i FROM tags)
  GROUP BY t, n
), pieces AS (
  SELECT t, n, regexp_extract_all(CASE WHEN v[1] IN ('"', chr(39)) THEN substr(v, 2, length(v) - 2) ELSE v END, REFERENCE) AS ps FROM named
), spelled AS (
  SELECT t, n, regexp_replace(array_to_string(list_transform(ps, lambda p: CASE lower(p) WHEN '&amp;' THEN '&' WHEN '&lt;' THEN '<' WHEN '&gt;' THEN '>' WHEN '&quot;' THEN '"' WHEN '&apos;' THEN chr(39) ELSE
    CASE WHEN regexp_matches(p, '(?i)^&#(x[0-9a-f]+|[0-9]+);$') AND (CODE BETWEEN 1 AND 55295 OR CODE BETWEEN 57344 AND 1114111) THEN chr(CODE) ELSE p END END), ''), '^\s+|\s+$', '', 'g') AS v
  FROM pieces
), read AS (
  SELECT g.t, g.page_id, g.url, g.address, g.kind, g.nth, coalesce(max(v) FILTER (n = 'href'), '') AS href, coalesce(max(v) FILTER (n = 'rel'), '') AS rel, coalesce(max(v) FILTER (n = 'http-equiv'), '') AS equiv, coalesce(max(v) FILTER (n = 'content'), '') AS content
  FROM tags g LEFT JOIN spelled USING (t) GROUP BY ALL
), bases AS (
  SELECT page_id, url, arg_min(href, nth) AS base FROM read WHERE kind = 'base' AND href <> '' GROUP BY ALL
), links AS (
  SELECT address, r.url, base, link FROM (
    SELECT address, url, page_id, CASE WHEN kind = 'link' AND list_contains(string_split_regex(translate(rel, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\s+'), 'canonical') THEN href
      WHEN kind = 'meta' AND translate(equiv, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = 'refresh' THEN regexp_extract(content, TARGET, 1) ELSE '' END AS link FROM read) r LEFT JOIN bases b ON b.page_id IS NOT DISTINCT FROM r.page_id AND b.url = r.url WHERE link <> ''
), based_at AS (
  SELECT address, link, CASE WHEN base IS NULL THEN url ELSE RESOLVED(url, base) END AS x FROM links
), based AS (
  SELECT address, link, DOTS(x) AS url FROM based_at
), targets AS (
  SELECT address, RESOLVED(url, link) AS x FROM based
), edges AS (
  SELECT address AS a, translate(regexp_extract(regexp_replace(b, '(?s)#.*$', ''), '(?s)^(.*?://[^/?]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_replace(regexp_replace(b, '(?s)#.*$', ''), '(?s)^.*?://[^/?]*', '') AS b
  FROM (SELECT address, DOTS(x) AS b FROM targets)
), both_ways AS (
  SELECT a, b FROM edges WHERE a <> b AND a <> '' AND b <> '' UNION SELECT b, a FROM edges WHERE a <> b AND a <> '' AND b <> ''
), reach AS (
  SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a
), ruled AS (
  SELECT x AS address, h, q, CASE
    WHEN (h = 'example.net' OR h LIKE '%.example.net') AND q LIKE '/en/%' THEN 'example.net/en/'
    WHEN (h = 'example.com' OR h LIKE '%.example.com') AND q LIKE '/de/%' THEN 'example.com/de/'
    WHEN (h = 'org' OR h LIKE '%.org') AND q LIKE '/fr/%' THEN 'org/fr/'
    WHEN (h = 'net' OR h LIKE '%.net') AND q LIKE '/%' THEN 'net/' END AS rule
  FROM (SELECT x, translate(regexp_extract(x, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h, regexp_extract(x, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS q
        FROM (SELECT address AS x FROM parts UNION SELECT b FROM both_ways))
), classes AS (
  SELECT r.node, bool_or(coalesce(u.rule IN ('example.net/en/', 'org/fr/'), false)) AS allowed, bool_or(coalesce(u.rule IN ('net/', 'example.com/de/'), false)) AS blocked
  FROM reach r JOIN ruled u ON u.address = r.other GROUP BY r.node
)
SELECT page_id, parts.host, parts.path, u.rule,
  CASE WHEN u.rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN u.rule IS NOT NULL THEN 'block'
       WHEN c.allowed THEN 'allow' WHEN c.blocked THEN 'block' ELSE 'allow' END AS verdict
FROM parts JOIN ruled u USING (address) LEFT JOIN classes c ON c.node = parts.address
"""),
    "op11_centroid_clustering": f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, q FROM kept ORDER BY c LIMIT 8
),{_lloyd(10)}
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c10.q, ',')) AS centroid_sha256
FROM a10 JOIN c10 USING (c)
""",
    "op12_block_max_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
), s AS (
  SELECT count(*) FILTER (len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), tf AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, n, term
), w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s
), scored AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term), s GROUP BY item_id, r, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
""",
}
