"""The ten queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import fingerprints, mixing, near_dups, pieces, quality_rules, substring_dups, token_counts, token_files, url_filters, warc
from loomspark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.measure(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOP = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
ORACLE_SQL["op8_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
c AS (SELECT doc_id, w, len(w)::BIGINT AS n_words,
  length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(t)::BIGINT - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  length(t)::BIGINT - length(replace(t, '!', '')) AS n_exclaims,
  len(list_filter(w, lambda x: lower(x) IN ({_STOP})))::BIGINT AS n_stop_words,
  len(l)::BIGINT AS n_lines, len(l)::BIGINT - len(list_distinct(l))::BIGINT AS n_dup_lines FROM w),
g AS (SELECT doc_id, unnest(range(1, n_words - 1)) AS p, unnest(list_transform(range(1, n_words - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM c WHERE n_words >= 3),
h AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g),
r AS (SELECT doc_id, count(DISTINCT q)::BIGINT AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM h WHERE k > 1) GROUP BY doc_id),
m AS (SELECT c.*, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM c LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars >= 2.0 * n_words AND word_chars <= 16.0 * n_words AND n_symbols <= 0.3 * n_words
  AND n_exclaims <= 0.4 * n_words AND n_stop_words >= 0.04 * n_words AND n_dup_lines <= 0.6 * n_lines AS kept
FROM b
"""


@query
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"))


_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
_WORDS = "cheap-pills spam-farm free-bets casino-win adult-x ads-track".split()
ORACLE_SQL["op1_url_filters"] = rf"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r(h, p, v) AS (VALUES {", ".join(str(x) for x in _RULES)}),
f AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM b JOIN r
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN regexp_matches(host || path, '(^|[^a-zA-Z0-9])({"|".join(_WORDS)})($|[^a-zA-Z0-9])')
  THEN 'block' ELSE 'allow' END) AS verdict
FROM b LEFT JOIN f USING (page_id)
"""


@query
def op2_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = warc.archive(table(spark, sf_dir, "pages"))
    read = warc.read_bundles(spark, folder, index)
    return read.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL["op2_warc_archives"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < keeper THEN keeper END AS refers_to
FROM k
"""


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query
def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query
def op10_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.components(table(spark, sf_dir, "documents"), width=4, percent=80)


# Candidates share a shingle that is rare enough: of a set of n, any partner has one of the n - ceil(0.8 n) + 1 rarest.
ORACLE_SQL["op10_near_dups"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g FROM w),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
f AS (SELECT g, count(*) AS k FROM s GROUP BY g),
r AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY k, g) AS i FROM s JOIN f USING (g)),
p AS (SELECT r.doc_id, g FROM r JOIN n USING (doc_id) WHERE i <= n - ceil(0.8 * n) + 1),
c AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM p x JOIN p y USING (g) WHERE x.doc_id < y.doc_id),
j AS (SELECT a, b, count(*) AS k FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND x.g = y.g GROUP BY a, b),
l AS (SELECT a, b FROM j JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
t(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, t.c FROM t JOIN e ON e.a = t.doc_id WHERE t.c < e.b)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept
FROM t LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


@query
def op9_substring_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dups.digest(table(spark, sf_dir, "documents"))


ORACLE_SQL["op9_substring_dups"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS p, w FROM d WHERE len(w) >= 20),
h AS (SELECT doc_id, p, array_to_string(w[p : p + 19], ' ') AS g FROM s),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS k FROM h),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS q FROM r WHERE k > 1),
x AS (SELECT d.doc_id, q, d.w[q] AS v, c.doc_id IS NOT NULL AS gone FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS q FROM d) d LEFT JOIN c USING (doc_id, q)),
a AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(v, ' ' ORDER BY q) FILTER (NOT gone), '') AS t FROM x GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.takes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = token_files.store(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)
    return token_files.read_files(spark, folder, manifest)


@query
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_neighbours(table(spark, sf_dir, "documents"))
