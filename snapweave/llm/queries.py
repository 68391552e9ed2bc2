"""The corpus operators as queries over whole tables, with DuckDB SQL where it can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import DecontaminationConfig, contaminated
from .embedding_dedup import EmbeddingDedupConfig, embedding_duplicates
from .language_id import LanguageConfig, language_mixture
from .license_scan import LicenseScanConfig, scan_licenses
from .line_dedup import dedup_lines
from .near_dedup import NearDedupConfig, near_duplicates
from .packing import PackingConfig, pack
from .periodic_runs import RunConfig, find_runs
from .quality import QualityConfig, quality
from .substring_dedup import SubstringDedupConfig, remove_repeats
from .source_audit import AuditConfig, audit_sources
from .token_files import TokenFileConfig, write_token_files
from .toxicity import ToxicityConfig, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents"), least=10)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"), config=LicenseScanConfig(width=5, containment=0.8, tell_apart=True))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_mixture(_table(spark, sf_dir, "documents"), LanguageConfig(modulus=4, held_out=2))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), QualityConfig(modulus=3, held_out=1))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(_table(spark, sf_dir, "embeddings"), EmbeddingDedupConfig(threshold=0.98))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"), SubstringDedupConfig(length=200, seed=100))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), DecontaminationConfig(seed_words=3, threshold=0.5))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ToxicityConfig(modulus=4, held_out=2, threshold=0.3))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), NearDedupConfig(width=4))


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), PackingConfig(tokenizer_path("word_bpe_49k.json"), end_id=2, window=4096))


def packing_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `op10_packing`, but with stated shares of three sources, one of them under a token a window."""
    weights = {"src0": 0.5, "src1": 0.3, "src2": 0.0001, "rest": 0.01}
    return pack(_table(spark, sf_dir, "documents"), PackingConfig(tokenizer_path("word_bpe_49k.json"), end_id=2, window=4096, weights=weights))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(_table(spark, sf_dir, "documents"), AuditConfig(least_documents=30, added=5, units=1_000_000_000, terms=50))


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Of one document in ten, by the checksum of its id, the words from a place on repeat with a period; None for the others and for a null id."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    first, places = h // 10 % n, np.arange(n)
    period = 1 + (n - first) // (3 + h // 10 % 8)
    return np.where(places < first, places, first + (places - first) % period)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(_table(spark, sf_dir, "documents"), RunConfig(least=6, exponent=4), repeated_tail)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    top = found.select("*", longest.alias("top"))
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", (-F.col("top.n")).alias("length"), "top.period",
        F.expr("-1000 * top.n div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(_table(spark, sf_dir, "documents"), TokenFileConfig(tokenizer_path("byte_bpe_50k.json"), end_id=0))
    return files.documents().select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_license_scan": op2_license_scan,
        "op3_language_id": op3_language_id,
        "op4_quality": op4_quality,
        "op5_embedding_dedup": op5_embedding_dedup,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_decontamination": op7_decontamination,
        "op8_toxicity": op8_toxicity,
        "op9_near_dedup": op9_near_dedup,
        "op10_packing": op10_packing,
        "packing_mixture": packing_mixture,
        "op11_source_audit": op11_source_audit,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_token_files": op13_token_files,
    }


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, n, len(parts) AS n_lines, parts[n] AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d, unnest(range(1, len(parts) + 1)) AS u(n)
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[ \x09-\x0D]+|[ \x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), owners AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT k.*, o.first IS NOT NULL AND k.doc_id <> o.first AS gone FROM keyed k LEFT JOIN owners o USING (key)
)
SELECT doc_id, CAST(any_value(n_lines) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98
), reach AS (
  SELECT vec_id AS id, vec_id AS seen FROM embeddings
  UNION
  SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.seen
), comp AS (SELECT id, min(seen) AS component_id FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN comp c ON c.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""

OP6_SQL = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, s, md5(substr(x, 2 * s + 1, 400)) AS k FROM (SELECT doc_id, x, unnest(range(0, n - 199)) AS s FROM h) u),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY k) AS c FROM w) q WHERE c > 1),
g AS (SELECT doc_id, s, sum(CASE WHEN s <= p + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM (SELECT doc_id, s, coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s), -1000) AS p FROM r) l),
spans AS (SELECT doc_id, min(s) AS a, max(s) + 200 AS b FROM g GROUP BY doc_id, run),
cuts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans UNION ALL SELECT h.doc_id, n, n, coalesce(e, 0) FROM h LEFT JOIN (SELECT doc_id, max(b) AS e FROM spans GROUP BY doc_id) m ON m.doc_id = h.doc_id),
kept AS (SELECT c.doc_id, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a, b) AS k, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) - 1 AS n_spans FROM cuts c JOIN h ON h.doc_id = c.doc_id GROUP BY c.doc_id)
SELECT h.doc_id, n AS n_bytes, n_removed, n_spans, sha256(unhex(k)) AS kept_sha256 FROM h JOIN kept USING (doc_id)
"""

OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS id, doc_id AS seen FROM documents
  UNION
  SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.seen
)
SELECT d.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN s ON s.doc_id = d.doc_id JOIN (SELECT id, min(seen) AS component_id FROM reach GROUP BY id) c ON c.id = d.doc_id
"""


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), tok AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM tok GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM tok JOIN kept USING (lang, term) GROUP BY lang, source, term),
cells AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)
), p AS (
  SELECT lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // CAST(sum(n) OVER (PARTITION BY lang, source) + 5 * v AS HUGEINT) AS p FROM cells JOIN v USING (lang)
), l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
q AS (
  SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // CAST(sum(n) OVER (PARTITION BY lang) + 5 * v AS HUGEINT) AS q FROM l JOIN v USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, 0 AS f FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  UNION ALL
  SELECT a.lang, a.source, b.source, abs(a.p - b.p) FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
), found AS (
  SELECT lang, source, 'pair' AS part, item, sum(f) AS value FROM pairs GROUP BY lang, source, item
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
) r WHERE part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": OP1_SQL,
        "op5_embedding_dedup": OP5_SQL,
        "op6_substring_dedup": OP6_SQL,
        "op9_near_dedup": OP9_SQL,
        "op11_source_audit": OP11_SQL,
    }
