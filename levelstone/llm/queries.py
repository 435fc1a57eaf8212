"""The registered queries of the corpus operators, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, dac, licenses, matroska, minhash, mixing, mtree, quality, secrets, suffixes
from .common import table

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


def op4_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary_path())


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.token_index(table(spark, sf_dir, "documents"), vocabulary_path())


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, sources and training positions (to nine digits, as the SQL has them), in the order of training."""
    return mixing.mix(table(spark, sf_dir, "documents"), schedule=mixing.CURRICULUM).withColumn("position", F.round("position", 9))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"), dictionary=vocabulary_path())


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.read_back(matroska.store(table(spark, sf_dir, "documents")))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_minhash_near_dedup, op3_suffix_array_dedup, op4_bpe_encoding, op5_token_ids, op6_source_mixing, op7_quality_classifier, op8_secret_scan, op9_media_columns, op10_top_k)}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: The SQL takes every line that begins with a mark of copyright for a notice, and has no texts but ``known_texts``.
_SQL_COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"


def _canonical_sql(text: str) -> str:
    c = f"regexp_replace(lower({text}), {_quoted(_SQL_COPYRIGHT_LINE)}, '', 'g')"
    for a, b in licenses.EQUIVALENT:
        c = f"replace({c}, {_quoted(a)}, {_quoted(b)})"
    c = f"regexp_replace({c}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    return f"regexp_replace({c}, ' ?\\n ?', chr(10), 'g')"


def _op1_sql() -> str:
    known = ", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in licenses.known_texts())
    whole = "trim(regexp_replace({}, '\\n+', ' ', 'g'))"
    return f"""
WITH known AS (SELECT md5({whole.format(_canonical_sql('t'))}) AS digest, min(k) AS license_id FROM (VALUES {known}) AS v(k, t) GROUP BY 1),
docs AS (SELECT doc_id, {_canonical_sql("coalesce(text, '')")} AS c FROM documents),
units AS (
  SELECT doc_id, true AS whole, md5({whole.format('c')}) AS digest FROM docs
  UNION ALL SELECT doc_id, false, md5(trim(line)) FROM (SELECT doc_id, unnest(string_split(c, chr(10))) AS line FROM docs))
SELECT doc_id, min(CASE WHEN whole THEN digest END) AS digest, min(CASE WHEN whole THEN license_id END) AS license_id,
  count(CASE WHEN NOT whole THEN license_id END) AS n_license_lines,
  coalesce(string_agg(DISTINCT CASE WHEN NOT whole THEN license_id END, ',' ORDER BY CASE WHEN NOT whole THEN license_id END), '') AS line_licenses
FROM units LEFT JOIN known USING (digest) GROUP BY doc_id"""


#: Links by prefix filtering: near sets share one of the first n - ceil(0.75 n) + 1 shingles in any one order of all shingles.
_OP2_SQL = """
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingled AS (SELECT doc_id, list_sort(CASE WHEN len(w) < 5 THEN list_filter([array_to_string(w, ' ')], lambda x: x <> '') ELSE list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(list_slice(w, i + 1, i + 5), ' '))) END) AS s FROM docs),
keyed AS (SELECT doc_id, s, CAST(len(s) AS BIGINT) AS n, CASE WHEN len(s) > 0 AND doc_id IS NOT NULL THEN md5(array_to_string(s, chr(10))) END AS key FROM shingled),
classes AS (SELECT key, min(doc_id) AS node, any_value(s) AS s, any_value(n) AS n FROM keyed WHERE key IS NOT NULL GROUP BY key),
held AS (SELECT node, n, unnest(s) AS shingle FROM classes),
counted AS (SELECT shingle, count(*) AS k FROM held GROUP BY shingle),
ranked AS (SELECT node, n, shingle, row_number() OVER (PARTITION BY node ORDER BY k, shingle) AS place FROM held JOIN counted USING (shingle)),
firsts AS (SELECT node, n, shingle FROM ranked WHERE place <= n - (3 * n + 3) // 4 + 1),
candidates AS (SELECT DISTINCT a.node AS a, b.node AS b, a.n AS na, b.n AS nb FROM firsts a JOIN firsts b ON a.shingle = b.shingle AND a.node < b.node WHERE 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)),
links AS (SELECT a, b FROM candidates JOIN held x ON x.node = a JOIN held y ON y.node = b AND y.shingle = x.shingle GROUP BY a, b, na, nb HAVING 100 * count(*) >= 75 * (na + nb - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT node, node AS label FROM classes UNION SELECT e.b, r.label FROM reach r JOIN edges e ON e.a = r.node WHERE r.label < e.b),
named AS (SELECT node, min(label) AS component_id FROM reach GROUP BY node)
SELECT k.doc_id, k.n AS n_shingles, coalesce(named.component_id, k.doc_id) AS component_id, coalesce(coalesce(named.component_id, k.doc_id) = k.doc_id, true) AS kept
FROM keyed k LEFT JOIN classes c ON c.key = k.key LEFT JOIN named ON named.node = c.node"""

_OP3_SQL = """
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, w, unnest(range(len(w) - 49)) AS pos FROM docs WHERE len(w) >= 50),
keyed AS (SELECT doc_id, pos, md5(array_to_string(list_slice(w, pos + 1, pos + 50), ' ')) AS key FROM windows),
shared AS (SELECT key FROM keyed GROUP BY key HAVING min(doc_id) <> max(doc_id)),
hits AS (SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50 THEN 0 ELSE 1 END AS fresh FROM keyed SEMI JOIN shared USING (key)),
spans AS (SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM hits)
SELECT doc_id, CAST(min(pos) AS INTEGER) AS start_word, CAST(max(pos) + 50 AS INTEGER) AS end_word, CAST(max(pos) + 50 - min(pos) AS INTEGER) AS n_words
FROM spans GROUP BY doc_id, span"""

_OP6_SQL = """
WITH docs AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 3 AS cap FROM sources),
filled AS (SELECT *,
  coalesce(sum(cap) OVER before, 0) AS capped, coalesce(sum(weight) OVER before, 0) AS spent,
  sum(CAST(source_size AS DOUBLE)) OVER () AS total, sum(weight) OVER () AS weights
  FROM weighed WINDOW before AS (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (total - capped) / (weights - spent) AS level FROM filled),
targets AS (SELECT source, source_size, CAST(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS BIGINT) % 3 AS turn, CASE WHEN source_size = 0 THEN 0 ELSE least(cap, coalesce((SELECT min_by(level, capped) FROM levels WHERE cap > level * weight) * weight, cap)) END AS target FROM levels),
placed AS (SELECT doc_id, d.source AS source, size, source_size, target, turn, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS turns,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
dealt AS (SELECT *, floor(target - turns * source_size) AS rest, CAST(turns * size + greatest(0, least(size, floor(target - turns * source_size) - start)) AS BIGINT) AS taken FROM placed),
shared AS (SELECT *, least(CAST(1 AS DOUBLE), (turns * start + least(start, rest) + taken / CAST(2 AS DOUBLE)) / greatest(target, CAST(1 AS DOUBLE))) AS share FROM dealt)
SELECT doc_id, source, size, source_size, CAST(target AS DOUBLE) AS target, taken,
  CASE WHEN taken > 0 THEN round(CASE turn WHEN 0 THEN (CAST(1.75 AS DOUBLE) - sqrt(greatest(CAST(0 AS DOUBLE), CAST(3.0625 AS DOUBLE) - 3 * share))) / CAST(1.5 AS DOUBLE) WHEN 1 THEN share ELSE (sqrt(CAST(0.0625 AS DOUBLE) + 3 * share) - CAST(0.25 AS DOUBLE)) / CAST(1.5 AS DOUBLE) END, 9) END AS position
FROM shared"""

_OP10_SQL = """
WITH raw AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
good AS (SELECT vec_id, list_transform(e, lambda x: CAST(floor(1024 * x) AS BIGINT)) AS v FROM raw WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10"""

ORACLE_SQL = {"op1_license_scan": _op1_sql(), "op2_minhash_near_dedup": _OP2_SQL, "op3_suffix_array_dedup": _OP3_SQL, "op6_source_mixing": _OP6_SQL, "op10_top_k": _OP10_SQL}
