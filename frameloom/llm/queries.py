"""The queries opN_<name> of this subpackage, each over its whole table, and SQL where SQL can say the same.

Nulls, ties, repeated rows, very long texts and the empty table: as the operator that a query calls says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm import divergence, fim, langid, matroska, packing, quality, secrets, sentencepiece, simhash, spotsigs, token_counts, toxicity, url_filter
from frameloom.llm.common import documents, new_path


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose fingerprints link at two differing bits or fewer."""
    return simhash.near_duplicates(documents(spark, sf_dir))


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts, likenesses, and groups of near duplicates."""
    return spotsigs.grouped_fingerprints(documents(spark, sf_dir))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of all pages."""
    return url_filter.judge(documents(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a classifier that learns from the folds that are not held out."""
    return toxicity.classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents by prototypes that are learnt from the folds that are not held out."""
    return langid.identify(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 1024 ids."""
    return packing.pack(documents(spark, sf_dir))


def op7_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comes back from all documents' texts stored as audio."""
    return matroska.store_and_read(documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a classifier that learns from the folds that are not held out."""
    return quality.classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled segmentations of all documents, and whether they give the texts back."""
    return sentencepiece.round_trip(documents(spark, sf_dir))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of all documents, by way of a ledger that begins empty and is kept for the session."""
    found = secrets.scan_versions(documents(spark, sf_dir), new_path(spark, "secrets"))
    joined = secrets.joined(F.col("spans"))
    counts = [secrets.count_kind(F.col("spans"), k).alias(f"n_{k}") for k in secrets.RULES]
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of all documents' languages differ, and their most typical terms."""
    return divergence.audit(documents(spark, sf_dir))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, by way of a cache that begins empty and is kept for the session."""
    return token_counts.token_counts(documents(spark, sf_dir), new_path(spark, "tokens"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How all documents are cut for filling in the middle, and digests of what comes out and of what that gives back."""
    return fim.digested(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_spotsigs": op2_spotsigs,
    "op3_url_filter": op3_url_filter,
    "op4_toxicity": op4_toxicity,
    "op5_langid": op5_langid,
    "op6_packing": op6_packing,
    "op7_matroska": op7_matroska,
    "op8_quality": op8_quality,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_secrets": op10_secrets,
    "op11_divergence": op11_divergence,
    "op12_token_counts": op12_token_counts,
    "op13_fill_in_middle": op13_fill_in_middle,
}

#: The texts between matches have the matches' places, as in the operator; alternatives and letter case are spelled out.
_OP10_ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?)([A-Za-z0-9+/_.=-]+)"""
_OP10 = f"""
WITH rules(kind, kind_no, pattern, least) AS (VALUES
  ('assign', 0, '{_OP10_ASSIGN}', 8), ('access', 1, '()(AKIA[A-Z0-9]+)', 16), ('hex', 2, '()([0-9a-f]+)', 32)),
matched AS (
  SELECT doc_id, kind, kind_no, least, regexp_extract_all(coalesce(text, ''), pattern, 0) AS whole,
    regexp_extract_all(coalesce(text, ''), pattern, 2) AS part, string_split_regex(coalesce(text, ''), pattern) AS gaps
  FROM documents, rules),
spans AS (
  SELECT doc_id, kind, kind_no, len(part[i]) AS n, least,
    list_sum(list_transform(gaps[1:i], lambda x: len(x)))::BIGINT + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: len(x))), 0)::BIGINT AS s,
    len(whole[i]) AS w
  FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM matched)),
kept AS (SELECT doc_id, kind, kind_no, s, s + w AS e FROM spans WHERE n >= least),
joined AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no) AS spans FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN joined j ON d.doc_id = j.doc_id
"""

_OP3 = """
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(rule, h, p, v) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block'))
SELECT page_id, host, path, (SELECT arg_max(rule, len(rule)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
  coalesce((SELECT arg_max(v, len(rule)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)), 'allow') AS verdict
FROM parts
"""

_OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (
  SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
per_document AS (SELECT id, lang, source, term, count(*) AS n FROM w GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM per_document GROUP BY ALL HAVING count(*) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY ALL),
counts AS (SELECT lang, source, term, sum(n) AS n FROM per_document SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sources AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN counts USING (lang, source) GROUP BY ALL),
p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
    1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5)::HUGEINT // (s.total + 5 * l.v)::HUGEINT AS p,
    1 + 1000000000::HUGEINT * (k.n + 5)::HUGEINT // (l.total + 5 * l.v)::HUGEINT AS q
  FROM sources s JOIN langs l ON s.lang = l.lang JOIN kept k ON s.lang = k.lang LEFT JOIN counts c ON s.lang = c.lang AND s.source = c.source AND k.term = c.term),
differ AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
items AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN differ x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM items)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""

_OP13 = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
  SELECT doc_id, text, units, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cut),
ends AS (SELECT doc_id, text, units, n, form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM drawn),
parts AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM ends)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN len(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN len(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM parts
"""

ORACLE_SQL: dict[str, str] = {"op3_url_filter": _OP3, "op10_secrets": _OP10, "op11_divergence": _OP11, "op13_fill_in_middle": _OP13}
