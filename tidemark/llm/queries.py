"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, decontam, exact_dedup, language_id, minhash, pii, prefix_trie, shared, sharding, suffix_dedup, token_counts, token_store, url_filter

#: The site rules of the URL query; the method's own patterns are in ``url_rules.txt``.
SITE_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), "word_bpe_49k.json")


def url_rules() -> list[url_filter.Rule]:
    return [url_filter.site_rule(*r) for r in SITE_RULES] + url_filter.read_rules()


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_rules()).select("page_id", "host", "path", "rule", "verdict", "patterns")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.learn(docs)).select("doc_id", "held_out", "lang_pred", "score", "n_words", "n_switches")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents")).drop("key")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"), words=3, percent=85)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("items", F.array_join("items", ","))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed_digests(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.new_path(spark, "token-store")
    token_store.write(table(spark, sf_dir, "documents"), path, "byte_bpe_50k.json")
    return token_store.places(spark, path)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_url_filters, op3_language_id, op4_pii, op5_minhash, op6_decontamination, op7_bpe, op8_suffix_dedup, op9_exact_dedup, op10_sharding, op11_collocations, op12_prefix_trie, op13_token_store)}


_CAPITALS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SITES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in SITE_RULES)
_PATTERNS = ", ".join("('{}', '{}', '{}')".format(*(x.replace("'", "''") for x in (r.name, url_filter.regex(r.pattern), r.verdict))) for r in url_filter.read_rules())

#: Site rules by length; the method's patterns, each tried on each URL, where none fits.
URL_SQL = f"""
WITH rest AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), {_CAPITALS}) AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules AS (SELECT * FROM (VALUES {_SITES}) AS v(h, p, v)),
best AS (SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS verdict FROM parts, rules
         WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
patterns AS (SELECT * FROM (VALUES {_PATTERNS}) AS x(name, re, v)),
fits AS (SELECT page_id, string_agg(name, ',' ORDER BY name) AS names, bool_or(x.v = 'block') AND NOT bool_or(x.v = 'allow') AS bad FROM parts, patterns x
         WHERE regexp_matches(translate(host || path, {_CAPITALS}), re) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict, coalesce(names, '') AS patterns
FROM parts LEFT JOIN best USING (page_id) LEFT JOIN fits USING (page_id)"""

NEAR_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_CAPITALS}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM w),
items AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS g FROM sets),
links AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM items a JOIN items b USING (g) WHERE a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT DISTINCT x AS doc_id, x AS other FROM links UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(m, doc_id) AS component_id, coalesce(m, doc_id) = doc_id AS kept
FROM sets LEFT JOIN (SELECT doc_id, min(other) AS m FROM reach GROUP BY 1) USING (doc_id)"""

EXACT_SQL = """
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY t ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY t ORDER BY points DESC, doc_id) AS kept, sha256(t) AS text_sha256 FROM n"""

#: All phrases of one to five words are counted; cuts, and phrases inside longer ones, by joins.
PHRASE_SQL = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_CAPITALS}), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces),
f AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k)) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100),
cuts AS (SELECT c.*, cut, n.n, l.f AS l, r.f AS r FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c JOIN n USING (lang)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:cut], ' ') AND l.k = cut JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1:], ' ') AND r.k = c.k - cut),
best AS (SELECT lang, phrase, a, l, r, n, CAST(CAST(1000 AS HUGEINT) * a * n // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY CAST(1000 AS HUGEINT) * a * n // (CAST(l AS HUGEINT) * r), cut) = 1),
longer AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most FROM (SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest(range(2, 5)) AS m) WHERE m < k) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM best LEFT JOIN longer USING (lang, phrase)
WHERE most IS NULL OR 100 * most < 100 * a QUALIFY rank <= 2000"""

#: CRC-32 of a decimal: 256 more than a byte is taken in, then a zero shifts one bit.
_CRC = """xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
  lambda ch: list_concat([CAST(ascii(ch) AS BIGINT) + 256], [0, 0, 0, 0, 0, 0, 0, 0])))), lambda a, b: CASE WHEN b > 0 THEN xor(a, b - 256) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"""

#: Nodes are groups of prefixes; a subtree is summed over all nodes below, found by the prefixes of each one's smallest member.
TRIE_SQL = f"""
WITH turns AS (SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'m': m, 'w': w}} ORDER BY turn NULLS FIRST, m, w) AS own, {_CRC} % 4 AS h FROM turns GROUP BY conv_id),
convs AS MATERIALIZED (SELECT a.conv_id, list_concat(coalesce(b.own, [])[1:a.h], a.own[a.h + 1:]) AS t FROM own a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % {prefix_trie.GROUP}),
pre AS MATERIALIZED (SELECT conv_id, d, len(t) AS size, md5(array_to_string(list_transform(t[1:d], lambda x: x.m), '')) AS p, md5(array_to_string(list_transform(t[1:d - 1], lambda x: x.m), '')) AS above, coalesce(t[d].w, 0) AS w
  FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM convs)),
nodes AS MATERIALIZED (SELECT d, p, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * any_value(w) AS save,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends FROM pre GROUP BY d, p),
kids AS MATERIALIZED (SELECT d - 1 AS d, above AS p, count(*) AS kids FROM nodes WHERE d > 0 GROUP BY ALL),
sums AS (SELECT x.d, x.p, sum(u.save) AS saved, count(*) FILTER (k.kids IS NULL) AS leaves FROM nodes u LEFT JOIN kids k USING (d, p) JOIN pre x ON x.conv_id = u.conv_id AND x.d <= u.d GROUP BY ALL)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(kids, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN sums USING (d, p) LEFT JOIN kids USING (d, p) LEFT JOIN nodes up ON up.d = n.d - 1 AND up.p = n.above AND n.d > 0"""


def oracle_sql() -> dict[str, str]:
    """Tokenizers, the random field, term statistics, templates, CRC-32 and hashes of bytes are beyond DuckDB's SQL: tests hold those against brute force."""
    return {"op2_url_filters": URL_SQL, "op5_minhash": NEAR_SQL, "op9_exact_dedup": EXACT_SQL, "op11_collocations": PHRASE_SQL, "op12_prefix_trie": TRIE_SQL}
