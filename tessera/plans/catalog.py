"""The registered queries over the reference operators, with their SQL.

Every query runs over its whole tables. Tables lack some shapes the operators need (boxes, numbered headings,
footers), so those are derived from columns by fixed rules, stated beside each query and repeated in its SQL.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.operators import chunking, correction, dedup, dense, elements, evaluate, hybrid, images, index, layout, lexical, sessions, tables, telemetry
from tessera.session import table
from tessera.sources import files, html

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
#: Questions for dense search: every vector whose id this divides.
EVERY = 50
THRESHOLD = 0.5


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


WORDS = r"unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term"

# ---------------------------------------------------------------- lexical


@query(f"WITH w AS (SELECT doc_id, {WORDS} FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM w GROUP BY term")
def term_stats(spark, sf):
    return lexical.term_stats(lexical.postings(table(spark, sf, "documents")))


@query(r"SELECT count(*) AS n_docs, sum(len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) / count(*) AS avgdl FROM documents")
def corpus_stats(spark, sf):
    return lexical.corpus_stats(lexical.document_lengths(table(spark, sf, "documents")))


def _questions(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def _index(spark, sf) -> index.Generation:
    """The published index of the folder's documents (one chunk each); built and published first where it is missing or the files have changed."""
    root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tessera-documents-{zlib.crc32(sf.encode()):08x}"
    docs = table(spark, sf, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("text").alias("content"), F.lit("text").alias("type"), F.concat(F.col("source"), F.lit(".txt")).alias("file_name"), F.lit(None).cast("int").alias("page"))
    return index.published(spark, root, index.fingerprint(spark, f"{sf}/documents.parquet"), chunks)


_BM25 = rf"""
words AS (SELECT doc_id, {WORDS} FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
dl AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS dl FROM documents),
n AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id AS question_id, {WORDS} FROM benchmark),
bm25 AS (SELECT question_id, doc_id, round(sum(greatest(0, ln((n - df + 0.5) / (df + 0.5) + 1)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS bm25
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), n GROUP BY ALL)"""


def _bm25(spark, sf) -> DataFrame:
    """Rounded before ranking, so that copies of a text tie exactly whatever the order of summation."""
    made = _index(spark, sf)
    return lexical.scores_from_index(_questions(spark, sf), made.postings, made.lengths).withColumn("bm25", F.round("bm25", 9))


@query(f"WITH {_BM25} SELECT question_id, doc_id, bm25, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY bm25 DESC, doc_id) AS rank FROM bm25) WHERE rank <= 10")
def bm25_topk(spark, sf):
    return lexical.top(_bm25(spark, sf), "bm25", 10, key="chunk_id").withColumnRenamed("chunk_id", "doc_id")


# ---------------------------------------------------------------- vectors

_COS = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x))) / sqrt(list_sum(list_transform({b}, lambda x: x::DOUBLE * x)))"


def _first_vector(vectors: DataFrame):
    row = vectors.where("vec_id = 0").select("embedding").first()
    return F.array(*[F.lit(float(x)) for x in (row[0] if row else [])])


@query(f"SELECT e.vec_id, round({_COS.format(a='e.embedding', b='q.embedding')}, 9) AS dense FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_COS.format(a='e.embedding', b='q.embedding')} DESC, e.vec_id LIMIT 10")
def dense_topk(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return dense.one_query_top(vectors, _first_vector(vectors), 10).withColumn("dense", F.round("dense", 9))


@query(f"SELECT e.vec_id, round({_COS.format(a='e.embedding', b='q.embedding')}, 9) AS dense FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label = 3 ORDER BY {_COS.format(a='e.embedding', b='q.embedding')} DESC, e.vec_id LIMIT 10")
def dense_topk_filtered(spark, sf):
    vectors = table(spark, sf, "embeddings")
    kept = vectors.withColumnRenamed("label", "type").where(dense.payload_filter(type=3))
    return dense.one_query_top(kept, _first_vector(vectors), 10).withColumn("dense", F.round("dense", 9))


@query(f"""WITH s AS (SELECT q.vec_id AS question_id, e.vec_id, round({_COS.format(a='e.embedding', b='q.embedding')}, 9) AS dense FROM embeddings e, embeddings q WHERE q.vec_id % {EVERY} = 0)
SELECT question_id, vec_id, dense, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY dense DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def dense_batch_topk(spark, sf):
    vectors = table(spark, sf, "embeddings")
    asked = vectors.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("question_id"), "embedding")
    return dense.dense_top(asked, vectors, 5, key="vec_id")


def _hash_sql(dim: int, key: str, source: str) -> str:
    return f"SELECT {key}, (('0x' || substr(sha256(t), 62, 3))::BIGINT % {dim})::INTEGER AS idx, count(*)::DOUBLE AS weight FROM (SELECT {key}, unnest(string_split_regex(lower(text), '\\s+')) AS t FROM {source}) WHERE t <> '' GROUP BY ALL"


@query(_hash_sql(1024, "doc_id", "documents"))
def hash_embed_sparse(spark, sf):
    return V.sparse_hash(table(spark, sf, "documents"), "doc_id", "text")


@query(f"""WITH d AS ({_hash_sql(1024, 'doc_id', 'documents')}), q AS ({_hash_sql(1024, 'item_id', 'benchmark')}),
s AS (SELECT item_id AS question_id, doc_id, sum(d.weight * q.weight) AS sparse FROM d JOIN q USING (idx) GROUP BY ALL)
SELECT question_id, doc_id, sparse, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY sparse DESC, doc_id) AS rank FROM s) WHERE rank <= 5""")
def sparse_dot_topk(spark, sf):
    q = V.sparse_hash(_questions(spark, sf), "question_id", "question")
    d = V.sparse_hash(table(spark, sf, "documents"), "doc_id", "text")
    return lexical.top(dense.sparse_scores(q, d, key="doc_id"), "sparse", 5)


# ---------------------------------------------------------------- hybrid retrieval


_HYBRID = f"""WITH {_BM25},
dh AS ({_hash_sql(64, 'doc_id', 'documents')}), qh AS ({_hash_sql(64, 'item_id', 'benchmark')}),
dn AS (SELECT doc_id, sqrt(sum(weight * weight)) AS n FROM dh GROUP BY doc_id), qn AS (SELECT item_id, sqrt(sum(weight * weight)) AS n FROM qh GROUP BY item_id),
dots AS (SELECT item_id, doc_id, sum(dh.weight * qh.weight) AS dot FROM dh JOIN qh USING (idx) GROUP BY ALL),
dense AS (SELECT b.item_id AS question_id, d.doc_id, round(coalesce(dot / dn.n / qn.n, 0), 9) AS dense FROM benchmark b CROSS JOIN documents d LEFT JOIN dots ON dots.item_id = b.item_id AND dots.doc_id = d.doc_id LEFT JOIN dn ON dn.doc_id = d.doc_id LEFT JOIN qn ON qn.item_id = b.item_id),
dr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY dense DESC, doc_id) AS rank FROM dense) WHERE rank <= 10),
sr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY bm25 DESC, doc_id) AS rank FROM bm25) WHERE rank <= 10),
fused AS (SELECT question_id, doc_id, sum(1.0 / (60 + rank)) AS fused, min(list * 1000 + rank) AS place FROM (SELECT question_id, doc_id, rank, 0 AS list FROM dr UNION ALL SELECT question_id, doc_id, rank, 1 FROM sr) GROUP BY ALL),
pool AS (SELECT * FROM (SELECT f.*, dense.dense, row_number() OVER (PARTITION BY question_id ORDER BY round(fused, 12) DESC, place) AS pool_rank FROM fused f JOIN dense USING (question_id, doc_id)) WHERE pool_rank <= 10),
outcomes AS (SELECT question_id, max(dense) AS best_score, count(*) FILTER (dense > 0 AND dense >= {THRESHOLD}) AS passing FROM pool GROUP BY question_id),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY pool_rank) AS rank FROM pool WHERE dense > 0 AND dense >= {THRESHOLD}) WHERE rank <= 5)
"""


def _asked(spark, sf) -> DataFrame:
    return V.dense_hash(_questions(spark, sf), "question_id", "question")


def _retrieved(spark, sf) -> tuple[DataFrame, DataFrame]:
    made = _index(spark, sf)
    return hybrid.retrieve(_questions(spark, sf), _asked(spark, sf), made.payload, made.vectors, _bm25(spark, sf), THRESHOLD)


@query(_HYBRID + "SELECT question_id, doc_id, round(fused, 9) AS fused FROM fused")
def hybrid_rrf(spark, sf):
    d = dense.dense_top(_asked(spark, sf), _index(spark, sf).vectors, 10)
    fused = hybrid.fuse([d, lexical.top(_bm25(spark, sf), "bm25", 10, key="chunk_id")])
    return fused.select("question_id", F.col("chunk_id").alias("doc_id"), F.round("fused", 9).alias("fused"))


@query(_HYBRID + "SELECT question_id, kept.doc_id, rank::INTEGER AS rank, dense, round(fused, 9) AS fused, '[' || source || '.txt]' AS citation FROM kept JOIN documents USING (doc_id)")
def hybrid_gated(spark, sf):
    kept, _ = _retrieved(spark, sf)
    return kept.select("question_id", "doc_id", "rank", "dense", F.round("fused", 9).alias("fused"), X.citation(F.col("file_name"), F.col("page")).alias("citation"))


@query(_HYBRID + "SELECT b.item_id AS question_id, coalesce(passing, 0) = 0 AS fallback, CASE WHEN trim(b.text) = '' THEN 'empty query' WHEN o.question_id IS NULL THEN 'no matching chunks' WHEN passing = 0 THEN 'below relevance threshold' ELSE '' END AS reason, coalesce(best_score, 0) AS best_score FROM benchmark b LEFT JOIN outcomes o ON o.question_id = b.item_id")
def retrieval_outcomes(spark, sf):
    return _retrieved(spark, sf)[1]


def _expected(spark, sf) -> DataFrame:
    """A question whose passage occurs in some document expects it; the others must fall back."""
    q = _questions(spark, sf)
    made = _index(spark, sf)
    seen = lexical.containing(q, made.postings, made.payload).withColumn("seen", F.lit(True))
    return q.join(seen, "question_id", "left").select("question_id", F.col("question").alias("expect_contains"), F.lit("text").alias("expect_type"), F.lit(None).cast("long").alias("source_doc"), F.col("seen").isNull().alias("expect_fallback"))


_EXPECTED = ", e AS (SELECT item_id AS question_id, text AS want, NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text)) AS expect_fallback FROM benchmark b)\n"


@query(_HYBRID + _EXPECTED + """SELECT e.question_id, coalesce(passing, 0) = 0 AS fallback, count(*) FILTER (contains(d.text, want)) > 0 AS has_text, count(d.doc_id) > 0 AS has_type,
CASE WHEN expect_fallback THEN coalesce(passing, 0) = 0 ELSE coalesce(passing, 0) > 0 AND count(*) FILTER (contains(d.text, want)) > 0 END AS passed
FROM e LEFT JOIN outcomes o USING (question_id) LEFT JOIN kept k USING (question_id) LEFT JOIN documents d USING (doc_id) GROUP BY e.question_id, passing, expect_fallback""")
def retrieval_grades(spark, sf):
    kept, outcomes = _retrieved(spark, sf)
    return evaluate.grades(_expected(spark, sf), kept, outcomes)


@query(_HYBRID + _EXPECTED + """, p AS (SELECT e.question_id, max(dense) FILTER (contains(d.text, want)) AS best FROM e LEFT JOIN kept k USING (question_id) LEFT JOIN documents d USING (doc_id) WHERE NOT expect_fallback GROUP BY e.question_id),
c AS (SELECT (SELECT min(best) FROM p) AS lowest_supported_score, (SELECT count(*) FROM p) AS supported_questions, (SELECT count(*) FROM p WHERE best IS NULL) AS unseen,
 (SELECT max(coalesce(best_score, 0)) FROM e LEFT JOIN outcomes USING (question_id) WHERE expect_fallback) AS highest_unsupported_score, (SELECT count(*) FROM e WHERE expect_fallback) AS unsupported_questions),
r AS (SELECT *, CASE WHEN supported_questions = 0 OR unsupported_questions = 0 THEN 'calibration requires supported and unsupported questions' WHEN unseen > 0 THEN 'no expected source evidence retrieved' WHEN highest_unsupported_score >= lowest_supported_score THEN 'no threshold separates the labeled questions' END AS error FROM c)
SELECT CASE WHEN error IS NULL THEN (greatest(0, highest_unsupported_score) + lowest_supported_score) / 2 END AS threshold, error, highest_unsupported_score, lowest_supported_score, supported_questions, unsupported_questions FROM r""")
def calibrate_threshold(spark, sf):
    kept, outcomes = _retrieved(spark, sf)
    return evaluate.calibration(_expected(spark, sf), kept, outcomes)


@query()
def answered_questions(spark, sf):
    from tessera.operators import answer

    kept, outcomes = _retrieved(spark, sf)
    return answer.answers(_questions(spark, sf), kept, outcomes)


# ---------------------------------------------------------------- identity and upserts


def _chunks(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.concat(F.col("source"), F.lit("-"), F.col("lang")).alias("chunk_id"), dedup.content_hash(F.col("text")).alias("content_hash"))


_CHUNKS = "WITH c AS (SELECT doc_id AS seq, source || '-' || lang AS chunk_id, sha256(text) AS content_hash FROM documents)\n"


@query("SELECT doc_id, md5(m) [1:8] || '-' || md5(m) [9:12] || '-' || md5(m) [13:16] || '-' || md5(m) [17:20] || '-' || md5(m) [21:32] AS point_id, sha256(text) AS content_hash FROM (SELECT *, doc_id::VARCHAR AS m FROM documents)")
def point_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", dedup.point_id(F.col("doc_id").cast("string")).alias("point_id"), dedup.content_hash(F.col("text")).alias("content_hash"))


@query(_CHUNKS + "SELECT min(seq) AS seq, content_hash FROM c GROUP BY content_hash")
def content_dedup_first_wins(spark, sf):
    return dedup.first_wins(_chunks(spark, sf)).select("seq", "content_hash")


@query(_CHUNKS + "SELECT seq, content_hash FROM c WHERE chunk_id NOT LIKE 'src0-%' AND content_hash NOT IN (SELECT content_hash FROM c WHERE chunk_id LIKE 'src0-%')")
def fresh_chunks_anti(spark, sf):
    c = _chunks(spark, sf)
    old = F.col("chunk_id").startswith("src0-")
    return dedup.fresh(c.where(~old), c.where(old)).select("seq", "content_hash")


@query(_CHUNKS + "SELECT chunk_id, arg_max(seq, (seq % 2, seq)) AS seq, arg_max(content_hash, (seq % 2, seq)) AS content_hash FROM c GROUP BY chunk_id")
def upsert_last_wins(spark, sf):
    c = _chunks(spark, sf)
    # The store holds the even rows; the odd ones overwrite by id, whatever their hashes.
    return dedup.upsert_hybrid(dedup.last_wins(c.where("seq % 2 = 0"), "chunk_id"), c.where("seq % 2 = 1")).select("chunk_id", "seq", "content_hash")


@query(_CHUNKS + """, old AS (SELECT chunk_id, max(seq) AS seq, arg_max(content_hash, seq) AS content_hash FROM c WHERE seq % 2 = 0 GROUP BY chunk_id),
new AS (SELECT chunk_id, max(seq) AS seq, arg_max(content_hash, seq) AS content_hash FROM c WHERE seq % 2 = 1 AND content_hash NOT IN (SELECT content_hash FROM old) GROUP BY chunk_id)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE chunk_id NOT IN (SELECT chunk_id FROM new)""")
def upsert_new_hashes(spark, sf):
    c = _chunks(spark, sf)
    return dedup.upsert_dense(dedup.last_wins(c.where("seq % 2 = 0"), "chunk_id"), c.where("seq % 2 = 1")).select("chunk_id", "seq", "content_hash")


@query(_CHUNKS + """, old AS (SELECT chunk_id, max(seq) AS seq, arg_max(content_hash, seq) AS content_hash FROM c WHERE seq % 2 = 0 GROUP BY chunk_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY fresh, seq) AS n FROM (SELECT *, 0 AS fresh FROM old UNION ALL SELECT chunk_id, seq, content_hash, 1 FROM c WHERE seq % 2 = 1)),
kept AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY fresh DESC, seq DESC) AS k FROM ranked WHERE fresh = 0 OR n = 1)
SELECT chunk_id, seq, content_hash FROM kept WHERE k = 1""")
def upsert_unseen(spark, sf):
    c = _chunks(spark, sf).select("chunk_id", "seq", "content_hash")
    return dedup.upsert_local(dedup.last_wins(c.where("seq % 2 = 0"), "chunk_id"), c.where("seq % 2 = 1"))


@query("SELECT page_id, lower(regexp_replace(regexp_extract(url, '([^/\\\\]+)$', 1), '\\.[^.]*$', '')) AS stem, count(*) OVER (PARTITION BY lower(regexp_replace(regexp_extract(url, '([^/\\\\]+)$', 1), '\\.[^.]*$', ''))) AS n_same_stem FROM pages")
def stem_collisions(spark, sf):
    return dedup.collisions(table(spark, sf, "pages"), "url").select("page_id", "stem", "n_same_stem")


# ---------------------------------------------------------------- text and elements

_INVALID, _UNPRINTABLE = r"[\x{FFFD}\p{Co}\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}-\x{9F}]", r"[\p{Cf}\p{Co}\p{Zl}\p{Zp}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}-\x{9F}]"
_METRICS = f"""m AS (SELECT doc_id, text, CASE WHEN text = '' THEN 1.0 ELSE 1 - (length(text) - length(regexp_replace(text, '{_UNPRINTABLE}', '', 'g'))) / length(text) END AS printable_ratio,
 CASE WHEN text = '' THEN 0.0 ELSE (length(text) - length(regexp_replace(text, '{_INVALID}', '', 'g'))) / length(text) END AS invalid_ratio FROM documents)"""


@query(f"WITH {_METRICS} SELECT doc_id, round(printable_ratio, 9) AS printable_ratio, round(invalid_ratio, 9) AS invalid_ratio, round(greatest(0, printable_ratio * (1 - invalid_ratio)), 9) AS quality FROM m")
def text_quality(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *[F.round(c, 9).alias(k) for k, c in X.text_metrics(F.col("text")).items()])


@query(f"""WITH {_METRICS}, p AS (SELECT m.*, length(trim(m.text)) AS chars, m.doc_id % 3 AS images, m.doc_id % 10 / 10.0 AS coverage, greatest(0, printable_ratio * (1 - invalid_ratio)) >= 0.85 AND invalid_ratio <= 0.03 AS sound FROM m)
SELECT doc_id, CASE WHEN chars = 0 AND images = 0 THEN 'digital' WHEN NOT (chars >= 40 AND printable_ratio >= 0.95 AND sound AND chars / 500000.0 >= 5e-5) AND (NOT (chars > 0 AND sound) OR coverage >= 0.70) THEN 'scanned' WHEN images > 0 AND coverage >= 0.08 THEN 'hybrid' ELSE 'digital' END AS page_type, chars = 0 AND images = 0 AS blank FROM p""")
def page_types(spark, sf):
    """A document is a page of 500,000 square points with doc_id % 3 images over doc_id % 10 tenths of it."""
    d = table(spark, sf, "documents")
    c = elements.page_type(F.col("text"), F.lit(1), F.col("doc_id") % 3, F.col("doc_id") % 10 / 10.0, F.lit(500000.0))
    return d.select("doc_id", c["page_type"].alias("page_type"), c["blank"].alias("blank"))


_ELEMENTS = r"""lines AS (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
el AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY line) - 1 AS "order", CASE WHEN (line = 1 OR (regexp_matches(text, '\p{L}') AND NOT regexp_matches(text, '\p{Ll}'))) AND length(trim(text, ' ')) <= 120 THEN 'heading' ELSE 'paragraph' END AS element_type, trim(text, ' ') AS text FROM lines WHERE trim(text, ' ') <> '')"""


@query(rf"""WITH {_ELEMENTS}, s AS (SELECT *, regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_-]+', '-', 'g'), '^-+|-+$', '', 'g') [1:80] AS slug FROM el)
SELECT document_id, "order"::INTEGER AS "order", element_type, last_value(CASE WHEN element_type = 'heading' THEN CASE WHEN slug = '' THEN 'section' ELSE slug END || '-' || ("order" + 1) END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY "order") AS section_id FROM s""")
def section_carry_forward(spark, sf):
    return elements.with_sections(elements.from_text(table(spark, sf, "documents"))).select("document_id", "order", "element_type", "section_id")


@query(f"""WITH {_ELEMENTS} SELECT document_id, string_agg(CASE WHEN element_type = 'heading' THEN '# ' || text ELSE text END, chr(10) || chr(10) ORDER BY "order") || chr(10) AS markdown FROM el GROUP BY document_id""")
def markdown_export(spark, sf):
    return elements.markdown(elements.from_text(table(spark, sf, "documents")))


@query(f"""WITH {_ELEMENTS}, j AS (SELECT document_id, string_agg(text, chr(10) ORDER BY "order") AS text, count(*) AS element_count FROM el GROUP BY document_id),
q AS (SELECT *, (length(text) - length(regexp_replace(text, '{_INVALID}', '', 'g'))) / length(text) AS invalid, 1 - (length(text) - length(regexp_replace(text, '{_UNPRINTABLE}', '', 'g'))) / length(text) AS printable FROM j)
SELECT document_id, element_count, length(text) AS text_length, round(invalid, 9) AS invalid_char_ratio, round(greatest(0, printable * (1 - invalid)), 9) AS text_quality_score, CASE WHEN invalid > 0.03 THEN 'partial' ELSE 'ok' END AS status FROM q""")
def document_quality_report(spark, sf):
    report = elements.quality_report(elements.from_text(table(spark, sf, "documents")))
    return report.select("document_id", "element_count", "text_length", F.round("invalid_char_ratio", 9).alias("invalid_char_ratio"), F.round("text_quality_score", 9).alias("text_quality_score"), "status")


@query("""WITH h AS (SELECT o_custkey AS document_id, o_orderkey AS "order", row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS number FROM orders),
w AS (SELECT *, row_number() OVER w AS nth, first_value(number) OVER w + row_number() OVER w - 1 AS expected FROM h WINDOW w AS (PARTITION BY document_id ORDER BY "order"))
SELECT document_id, "order", 'article' AS kind, number::INTEGER AS number, expected::INTEGER AS expected, expected::VARCHAR AS suggested FROM w WHERE nth > 1 AND number <> expected""")
def numbering_review(spark, sf):
    """Customers are documents, their orders numbered articles; where the order's key divides by 7 the number is one too high."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) + F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0)
    return elements.numbering_review(table(spark, sf, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("order"), F.concat(F.lit("Điều "), n.cast("string"), F.lit(" quy định")).alias("text")))


@query("""SELECT p_partkey, ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][p_partkey // 100 % 10 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][p_partkey // 10 % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][p_partkey % 10 + 1] AS roman, (p_partkey % 1000)::INTEGER AS value FROM part WHERE p_partkey % 1000 > 0""")
def roman_numbers(spark, sf):
    roman = X.roman_text(F.col("p_partkey") % 1000)
    return table(spark, sf, "part").where("p_partkey % 1000 > 0").select("p_partkey", roman.alias("roman"), X.roman_value(roman).alias("value"))


@query(r"""WITH l AS (SELECT source, doc_id, unnest(list_distinct([string_split(text, chr(10))[1], string_split(text, chr(10))[-1]])) AS t FROM documents),
k AS (SELECT source, doc_id, lower(regexp_replace(trim(t), '\s+', ' ', 'g')) AS key FROM l WHERE trim(t) <> '')
SELECT source AS document_id, key, count(DISTINCT doc_id) AS n_pages FROM k GROUP BY ALL HAVING count(DISTINCT doc_id) >= 2""")
def repeating_noise(spark, sf):
    """A source is a document, its texts are pages; first lines are headers, last lines footers."""
    lines = F.split("text", "\n")
    ends = F.array(F.struct(F.lit("header").alias("element_type"), F.element_at(lines, 1).alias("text")), F.struct(F.lit("footer").alias("element_type"), F.element_at(lines, -1).alias("text")))
    return elements.repeated_noise(table(spark, sf, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("page_number"), F.inline(ends)))


@query("""WITH g AS (SELECT DISTINCT o_orderstatus, o_orderkey, o_orderkey - dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS run FROM orders)
SELECT o_orderstatus, min(o_orderkey) AS first, max(o_orderkey) AS last FROM g GROUP BY o_orderstatus, run""")
def contiguous_bands(spark, sf):
    return tables.bands(table(spark, sf, "orders"), ["o_orderstatus"], "o_orderkey")


@query("SELECT p_partkey, levenshtein(p_name, p_brand || ' ' || p_type) / greatest(length(p_name), 1) AS edit_ratio FROM part")
def edit_ratio(spark, sf):
    return table(spark, sf, "part").select("p_partkey", correction.edit_ratio(F.col("p_name"), F.concat_ws(" ", "p_brand", "p_type")).alias("edit_ratio"))


@query("""SELECT CASE l_returnflag WHEN 'N' THEN 's' || l_suppkey ELSE 'p' || l_partkey END AS owner, l_partkey % 10 AS page, l_linenumber % 4 AS picture, min(l_orderkey) AS first_order, arg_min(l_linenumber, (l_orderkey, l_linenumber)) AS first_line
FROM lineitem GROUP BY ALL""")
def images_shown_once(spark, sf):
    """A line is an image shown: of a supplier's document, or where its flag is not N of a part's file; known by hash, path or id."""
    flag, picture = F.col("l_returnflag"), F.col("l_linenumber") % 4
    rows = table(spark, sf, "lineitem").select(
        F.when(flag == "N", F.concat(F.lit("s"), "l_suppkey")).otherwise("").alias("doc_id"), F.concat(F.lit("p"), "l_partkey").alias("file_name"), (F.col("l_partkey") % 10).alias("page"),
        F.when(picture == 0, "0").alias("image_hash"), F.when(picture == 1, "1").otherwise(" ").alias("path"), picture.cast("string").alias("element_id"), F.col("l_orderkey").alias("first_order"), F.col("l_linenumber").alias("first_line"),
    )
    owner = F.when(F.col("doc_id") != "", F.col("doc_id")).otherwise(F.col("file_name")).alias("owner")
    return images.shown_once(rows, ["first_order", "first_line"]).select(owner, "page", F.col("element_id").cast("int").alias("picture"), "first_order", "first_line")


@query("""SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN text WHEN 1 THEN text || role WHEN 2 THEN text || role END AS text,
CASE turn % 5 WHEN 3 THEN 'clipped: MAX_TOKENS' WHEN 4 THEN 'no candidates: SAFETY' END AS error FROM conversations""")
def caption_answers(spark, sf):
    """Turns as the answers of two vision services: a plain text, a list of contents, parts, a clipped answer and a blocked one."""
    part = lambda c: F.struct(F.lit("text").alias("type"), F.col(c).alias("text"))
    plain = F.struct(F.col("text").alias("output_text"))
    listed = F.struct(F.array(F.struct(F.array(part("text"), F.struct(F.lit("refusal").alias("type"), F.lit("x").alias("text")), part("role")).alias("content"))).alias("output"))
    parts = lambda reason: F.struct(F.array(F.struct(F.lit(reason).alias("finishReason"), F.struct(F.array(part("text"), part("role")).alias("parts")).alias("content"))).alias("candidates"))
    blocked = F.struct(F.struct(F.lit("SAFETY").alias("blockReason")).alias("promptFeedback"))
    kind = F.col("turn") % 5
    json = F.when(kind == 0, F.to_json(plain)).when(kind == 1, F.to_json(listed)).when(kind == 2, F.to_json(parts("STOP"))).when(kind == 3, F.to_json(parts("MAX_TOKENS"))).otherwise(F.to_json(blocked))
    told = table(spark, sf, "conversations").select("conv_id", "turn", kind.alias("kind"), json.alias("json"))
    answer = F.when(F.col("kind") >= 2, images.answer_text(F.col("json"), True)).otherwise(images.answer_text(F.col("json"), False))
    return told.select("conv_id", "turn", answer.alias("a")).select("conv_id", "turn", "a.text", "a.error")


@query("""SELECT o_custkey AS document_id, count(*) FILTER (o_orderkey % 3 = 0) AS changed_elements, count(*) FILTER (o_orderkey % 5 = 0) AS excluded_page_numbers, sum(o_orderkey % 4)::BIGINT AS review_issue_count
FROM orders GROUP BY o_custkey""")
def postprocessing_stats(spark, sf):
    """An order is an element of its customer's document: every third changed, every fifth a page number, with up to three issues open and one settled."""
    key = F.col("o_orderkey")
    issue = lambda s: F.struct(F.lit(s).alias("status"))
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("document_id"), F.when(key % 3 == 0, F.array(F.col("o_orderpriority"))).alias("changes"), F.when(key % 5 == 0, "page_number").when(key % 5 == 1, "noise").alias("exclusion_reason"),
        F.concat(F.array_repeat(issue("needs_review"), (key % 4).cast("int")), F.array(issue("corrected_by_crop_ocr"))).alias("issues"),
    )
    return elements.postprocessing_stats(rows)


@query("SELECT o_orderkey, o_orderpriority, o_totalprice, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS ordered_at, strftime(o_orderdate, '%Y-%m-%d') AS ordered_on, o_totalprice > 1000 AS large, (o_orderkey * 1.50)::DECIMAL(20, 2)::VARCHAR AS amount FROM orders")
def json_safe_values(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", F.col("o_orderdate").alias("ordered_at"), F.to_date("o_orderdate").alias("ordered_on"), (F.col("o_totalprice") > 1000).alias("large"), (F.col("o_orderkey") * F.lit(1.5)).cast("decimal(20,2)").alias("amount"))
    return files.json_safe(rows)


@query()
def protected_tokens(spark, sf):
    t = correction.protected_tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", *[F.size(t[k]).alias(k) for k in correction.PROTECTED])


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang FROM r WHERE n <= 5 OR i = 0 OR floor(i * 5 / n) <> floor((i - 1) * 5 / n)""")
def stratified_sample(spark, sf):
    return images.pilot_sample(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 5)


# ---------------------------------------------------------------- geometry: boxes from order lines

_BOX = "l_partkey % 100 * 5.0 AS x0, l_suppkey % 50 * 10.0 AS y0, l_partkey % 100 * 5.0 + l_quantity * 4 AS x1, l_suppkey % 50 * 10.0 + l_quantity * 2 AS y1"


def _boxes(spark, sf) -> DataFrame:
    """An order is a page of 600 x 800, each line a block: place by part and supplier, size by quantity."""
    p, s, q = F.col("l_partkey") % 100 * 5.0, F.col("l_suppkey") % 50 * 10.0, F.col("l_quantity")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").cast("long").alias("block_id"), G.box(p, s, p + q * 4, s + q * 2).alias("bbox"), F.when(F.col("l_linenumber") % 4 == 0, "table").otherwise("paragraph").alias("element_type"), F.col("l_returnflag").alias("text"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))


@query(f"""WITH b AS (SELECT l_orderkey AS page_id, l_linenumber AS n, {_BOX} FROM lineitem),
p AS (SELECT a.page_id, a.n AS a, b.n AS b, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) AS s, (b.x1 - b.x0) * (b.y1 - b.y0) AS t FROM b a JOIN b ON a.page_id = b.page_id AND a.n < b.n)
SELECT page_id, a::BIGINT AS a, b::BIGINT AS b, round(i / (s + t - i), 9) AS iou, round(i / least(s, t), 9) AS containment FROM p WHERE i > 0""")
def overlapping_pairs(spark, sf):
    l, r = _boxes(spark, sf).alias("l"), _boxes(spark, sf).alias("r")
    a, b = F.col("l.bbox"), F.col("r.bbox")
    pairs = l.join(r, (F.col("l.page_id") == F.col("r.page_id")) & (F.col("l.block_id") < F.col("r.block_id")) & (G.intersection(a, b) > 0))
    return pairs.select(F.col("l.page_id").alias("page_id"), F.col("l.block_id").alias("a"), F.col("r.block_id").alias("b"), F.round(G.iou(a, b), 9).alias("iou"), F.round(G.containment(a, b), 9).alias("containment"))


@query(f"""WITH b AS (SELECT l_orderkey AS page_id, l_linenumber AS n, l_linenumber % 4 <> 0 AND l_quantity * 4 >= 600 * 0.18 AS wide, {_BOX} FROM lineitem),
two AS (SELECT DISTINCT a.page_id FROM b a JOIN b ON a.page_id = b.page_id AND a.n < b.n AND a.wide AND b.wide AND greatest(b.x0 - a.x1, a.x0 - b.x1) > 30 AND least(a.y1 - a.y0, b.y1 - b.y0) > 0 AND least(a.y1, b.y1) - greatest(a.y0, b.y0) > 0.5 * least(a.y1 - a.y0, b.y1 - b.y0))
SELECT page_id, n::BIGINT AS block_id, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN page_id NOT IN (SELECT page_id FROM two) THEN y0 END, CASE WHEN page_id NOT IN (SELECT page_id FROM two) THEN x0 END, n)::INTEGER - 1 AS "order" FROM b""")
def reading_order(spark, sf):
    return layout.reading_order(_boxes(spark, sf)).select("page_id", "block_id", "order")


@query(f"""WITH b AS (SELECT l_orderkey AS page_id, l_linenumber AS n, {_BOX} FROM lineitem), c AS (SELECT l.page_id, l.n AS line_id, k.n AS block_id,
 greatest(0, least(l.x1, k.x1) - greatest(l.x0, k.x0)) * greatest(0, least(l.y1, k.y1) - greatest(l.y0, k.y0)) / ((l.x1 - l.x0) * (l.y1 - l.y0)) AS coverage FROM b l JOIN b k ON l.page_id = k.page_id WHERE l.n % 2 = 1 AND k.n % 2 = 0)
SELECT page_id, line_id::BIGINT AS line_id, block_id::BIGINT AS block_id, round(coverage, 9) AS coverage FROM (SELECT *, row_number() OVER (PARTITION BY page_id, line_id ORDER BY coverage DESC, block_id DESC) AS k FROM c) WHERE k = 1 AND coverage >= 0.5""")
def lines_in_blocks(spark, sf):
    b = _boxes(spark, sf)
    return layout.line_blocks(b.where("block_id % 2 = 1").withColumnRenamed("block_id", "line_id"), b.where("block_id % 2 = 0")).withColumn("coverage", F.round("coverage", 9))


@query(f"""WITH b AS (SELECT l_orderkey AS page_id, {_BOX} FROM lineitem), e AS (SELECT page_id, x0 AS x FROM b UNION SELECT page_id, x1 FROM b),
s AS (SELECT page_id, x AS l, lead(x) OVER (PARTITION BY page_id ORDER BY x) AS r FROM e),
c AS (SELECT s.page_id, l, r, y0, y1, max(y1) OVER (PARTITION BY s.page_id, l ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM s JOIN b ON s.page_id = b.page_id AND b.x0 < s.r AND b.x1 > s.l)
SELECT page_id, sum((r - l) * greatest(0, y1 - greatest(y0, coalesce(reached, y0)))) AS area FROM c GROUP BY page_id""")
def covered_area(spark, sf):
    grouped = _boxes(spark, sf).groupBy("page_id").agg(F.collect_list("bbox").alias("boxes"))
    return grouped.select("page_id", G.union_area("boxes").alias("area"))


@query(f"""WITH RECURSIVE b AS (SELECT l_orderkey AS page_id, l_linenumber AS n, l_returnflag AS key, {_BOX}, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, x0, y0, x1, y1) AS k FROM lineitem),
w AS (SELECT page_id, key, k, n, NULL::INTEGER AS first, [{{'n': n, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}] AS kept FROM b WHERE k = 1
UNION ALL SELECT page_id, key, k, n, first, CASE WHEN first IS NULL THEN list_append(kept, {{'n': n, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}) ELSE kept END FROM (SELECT b.*, kept,
 list_filter(kept, lambda o: greatest(0, least(o.x1, b.x1) - greatest(o.x0, b.x0)) * greatest(0, least(o.y1, b.y1) - greatest(o.y0, b.y0)) / least((o.x1 - o.x0) * (o.y1 - o.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) >= {layout.DUPLICATE})[1].n AS first FROM w JOIN b ON b.page_id = w.page_id AND b.key = w.key AND b.k = w.k + 1))
SELECT page_id, n::BIGINT AS block_id, coalesce(first, -1)::BIGINT AS duplicate_of FROM w""")
def page_duplicates(spark, sf):
    """duplicate_of is -1 for a block that is kept."""
    return layout.without_duplicates(_boxes(spark, sf)).fillna(-1, "duplicate_of")


@query("""WITH u AS (SELECT DISTINCT l_orderkey AS sheet, l_partkey % 12 AS r, l_suppkey % 8 AS c FROM lineitem),
rb AS (SELECT *, r - dense_rank() OVER (PARTITION BY sheet ORDER BY r) AS run FROM u), rr AS (SELECT *, min(r) OVER (PARTITION BY sheet, run) AS r1 FROM rb),
cb AS (SELECT *, c - dense_rank() OVER (PARTITION BY sheet, r1 ORDER BY c) AS crun FROM rr)
SELECT sheet, min(r) AS row1, min(c) AS column1, max(r) AS row2, max(c) AS column2 FROM cb GROUP BY sheet, r1, crun""")
def table_regions(spark, sf):
    """An order is a sheet; each line fills the cell (part % 12, supplier % 8)."""
    return tables.table_regions(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sheet"), (F.col("l_partkey") % 12).alias("row"), (F.col("l_suppkey") % 8).alias("column")).distinct())


# ---------------------------------------------------------------- telemetry

_REQ = """r AS (SELECT event_id AS id, user_id AS session_id, ts AS started_at, event_type, CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'search' AND (props ->> '$.k')::INTEGER % 2 = 0 THEN 'fallback' ELSE 'success' END AS status,
 value AS runtime_ms, CASE WHEN (props ->> '$.k')::INTEGER % 3 <> 0 THEN value / 2 END AS ttft_ms FROM events)"""


def _requests(spark, sf) -> DataFrame:
    return telemetry.from_events(table(spark, sf, "events"))


@query(f"WITH {_REQ} SELECT event_type, count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'fallback') AS fallback, count(*) FILTER (status = 'error') AS error, count(*) FILTER (status = 'running') AS running, round(avg(runtime_ms), 6) AS avg_runtime_ms, round(avg(ttft_ms), 6) AS avg_ttft_ms, count(ttft_ms) AS ttft_count FROM r GROUP BY event_type")
def request_summary(spark, sf):
    return telemetry.summary(_requests(spark, sf), "event_type").withColumn("avg_runtime_ms", F.round("avg_runtime_ms", 6)).withColumn("avg_ttft_ms", F.round("avg_ttft_ms", 6))


@query(f"WITH {_REQ} SELECT id, session_id, started_at, status, runtime_ms FROM r WHERE status = 'success' ORDER BY started_at DESC, id DESC LIMIT 50 OFFSET 10")
def request_page(spark, sf):
    return telemetry.page(telemetry.matching(_requests(spark, sf), status="success"), 50, 10).select("id", "session_id", "started_at", "status", "runtime_ms")


@query(f"WITH {_REQ} SELECT session_id AS id, max(started_at) AS at, arg_max(status, (started_at, id)) AS status FROM r GROUP BY session_id")
def latest_states(spark, sf):
    log = _requests(spark, sf).select(F.col("session_id").alias("id"), F.col("started_at").alias("at"), F.col("id").alias("entry"), "status")
    return telemetry.latest_state(log).select("id", "at", "status")


@query(f"WITH {_REQ} SELECT id, measure, value FROM (SELECT id, runtime_ms / 1000 AS runtime_s, ttft_ms / 1000 AS ttft_s FROM r) UNPIVOT INCLUDE NULLS (value FOR measure IN (runtime_s, ttft_s))")
def chart_rows(spark, sf):
    return telemetry.chart_rows(_requests(spark, sf)).select("id", "measure", "value")


# ---------------------------------------------------------------- conversations


def _messages(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations")


@query("SELECT c.conv_id AS id, c.updated_at, count(m.conv_id) AS message_count FROM (SELECT conv_id, max(turn) AS updated_at FROM conversations GROUP BY conv_id) c LEFT JOIN (SELECT * FROM conversations WHERE role <> 'system') m USING (conv_id) GROUP BY c.conv_id, c.updated_at")
def conversation_list(spark, sf):
    m = _messages(spark, sf)
    return sessions.conversation_list(m.groupBy(F.col("conv_id").alias("id")).agg(F.max("turn").alias("updated_at")), m.where("role <> 'system'").withColumnRenamed("conv_id", "session_id"))


_HINT = r"(^|[^\p{L}\p{N}_])(còn|thì sao|thế còn|vậy|nó|đó|này|tiếp|sao ạ|sao\?)($|[^\p{L}\p{N}_])"
_TOPIC = r"""t AS (SELECT *, last_value(CASE WHEN role = 'user' AND len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) > 4 THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS topic FROM conversations)"""


@query(f"WITH {_TOPIC} SELECT conv_id, turn, topic, CASE WHEN trim(text) <> '' AND topic IS NOT NULL AND regexp_matches(lower(trim(text)), '{_HINT}') THEN topic || ' (' || trim(text) || ')' ELSE trim(text) END AS rewritten FROM t")
def last_substantive_turn(spark, sf):
    return sessions.last_substantive(_messages(spark, sf)).select("conv_id", "turn", "topic", sessions.rewritten(F.col("text"), F.col("topic")).alias("rewritten"))


@query(r"""SELECT conv_id, turn, length(t) > 0 AND length(t) <= 2000 AS ok, CASE WHEN length(t) = 0 THEN 'empty question' WHEN length(t) > 2000 THEN 'question too long (' || length(t) || ' > 2000)' ELSE '' END AS reason,
 length(t) > 0 AND length(t) <= 2000 AND regexp_matches(t, '(?i)bỏ qua (mọi )?chỉ dẫn|ignore (all )?instructions|system prompt|jailbreak|do anything now') AS strict FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations)""")
def input_guard(spark, sf):
    g = X.input_guard(F.col("text"))
    return _messages(spark, sf).select("conv_id", "turn", *[c.alias(k) for k, c in g.items()])


# A turn is kept until the turns after it pass a limit, and a turn too long is cut to its end at once; so what is kept is a
# suffix, and the summary is the traces of what went, in the order in which it went.
@query(r"""WITH m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM conversations),
p AS (SELECT *, sum(least(n, 2000)) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM m),
fits AS (SELECT t.conv_id, t.i AS t, min(j.i) AS s FROM p t JOIN p j ON j.conv_id = t.conv_id AND j.i BETWEEN t.i - 5 AND t.i AND (j.i = t.i OR (t.n <= 2000 AND t.upto - j.upto + least(j.n, 2000) <= 2000)) GROUP BY ALL),
suffix AS (SELECT conv_id, t, max(s) OVER (PARTITION BY conv_id ORDER BY t) AS s FROM fits),
gone AS (SELECT p.conv_id, min(suffix.t) AS went, 0 AS phase, p.i, p.role, right(p.text, 2000) AS text FROM p JOIN suffix ON suffix.conv_id = p.conv_id AND suffix.s > p.i GROUP BY ALL
 UNION ALL SELECT conv_id, i, 1, i, role, text FROM p WHERE n > 2000),
told AS (SELECT conv_id, right(string_agg(rtrim('- ' || role || ': ' || left(text, 200), ' ' || chr(9) || chr(10) || chr(13)), chr(10) ORDER BY went, phase, i), 2000) AS summary FROM gone GROUP BY conv_id)
SELECT p.conv_id, count(*) AS n_turns, sum(least(n, 2000))::BIGINT AS n_chars, coalesce(any_value(summary), '') AS summary FROM p JOIN (SELECT conv_id, max(s) AS s FROM suffix GROUP BY conv_id) k ON k.conv_id = p.conv_id AND p.i >= k.s LEFT JOIN told ON told.conv_id = p.conv_id GROUP BY p.conv_id""")
def session_memory(spark, sf):
    m = sessions.session_memory(_messages(spark, sf), max_chars=2000)
    return m.select("conv_id", "n_turns", "n_chars", "summary")


# ---------------------------------------------------------------- folds


def _retrieval_rows(spark, sf) -> DataFrame:
    rows = elements.element_ids(elements.from_text(table(spark, sf, "documents")))
    return elements.retrieval_elements(elements.with_sections(rows))


@query(rf"""WITH RECURSIVE {_ELEMENTS}, h AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY "order") AS k, lead("order") OVER (PARTITION BY document_id ORDER BY "order") AS until,
 CASE WHEN regexp_matches(text, '^\s*(?i:CHƯƠNG)\s+[IVXLCDMivxlcdm]+([^\p{{L}}\p{{N}}_]|$)') THEN 'chapter' WHEN regexp_matches(text, '^\s*(?i:Điều)\s+\d+[A-Za-z]?([^\p{{L}}\p{{N}}_]|$)') THEN 'article' END AS kind,
 regexp_matches(text, '\p{{L}}') AND NOT regexp_matches(text, '\p{{Ll}}') AS capitals FROM el WHERE element_type = 'heading'),
w AS (SELECT document_id, k, "order", until, [{{'kind': coalesce(kind, 'heading'), 'text': text}}] AS path FROM h WHERE k = 1
UNION ALL SELECT h.document_id, h.k, h."order", h.until, CASE WHEN h.kind = 'chapter' THEN [{{'kind': 'chapter', 'text': h.text}}]
 WHEN h.kind = 'article' THEN list_append(list_filter(path, lambda p: p.kind NOT IN ('article', 'heading')), {{'kind': 'article', 'text': h.text}})
 WHEN path[1].kind = 'chapter' AND h.capitals THEN list_append(list_filter(path, lambda p: p.kind <> 'chapter_title'), {{'kind': 'chapter_title', 'text': h.text}})
 ELSE [{{'kind': 'heading', 'text': h.text}}] END FROM w JOIN h ON h.document_id = w.document_id AND h.k = w.k + 1)
SELECT el.document_id, el."order"::INTEGER AS "order", coalesce(list_transform(path, lambda p: p.text), []) AS heading_path FROM el LEFT JOIN w ON w.document_id = el.document_id AND el."order" >= w."order" AND (w.until IS NULL OR el."order" < w.until)""")
def heading_paths(spark, sf):
    return elements.with_heading_paths(elements.from_text(table(spark, sf, "documents")))


@query()
def fallback_chunks(spark, sf):
    rows = elements.element_ids(elements.from_text(table(spark, sf, "documents")))
    return chunking.chunk(rows, chunking.by_characters)


@query()
def type_aware_chunks(spark, sf):
    return chunking.chunk(_retrieval_rows(spark, sf), chunking.type_aware)


@query()
def table_chunks(spark, sf):
    """Sixty-four neighbouring orders are a table, however many there are: a header and a row a line."""
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_quantity")]), F.lit(" |"))
    lines = table(spark, sf, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 64).alias("document_id")).agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", row.alias("r")))).alias("rows"))
    text = F.concat(F.lit("| line | part | quantity |\n| --- | --- | --- |\n"), F.array_join(F.transform("rows", lambda r: r["r"]), "\n"))
    rows = lines.select("document_id", F.concat(F.col("document_id").cast("string"), F.lit("-e1")).alias("element_id"), F.lit(0).alias("order"), F.lit("table").alias("element_type"), text.alias("text"), F.array(F.lit("Orders")).alias("heading_path"))
    return chunking.chunk(rows, chunking.type_aware)


@query()
def html_elements(spark, sf):
    return html.elements(table(spark, sf, "pages"))


@query()
def image_contexts(spark, sf):
    """Every tenth element of a page stands for an image."""
    rows = html.elements(table(spark, sf, "pages")).withColumnRenamed("page_id", "document_id")
    kind = F.when(F.col("order") % 10 == 9, "image").otherwise(F.col("element_type"))
    return images.contexts(elements.element_ids(rows).withColumn("element_type", kind))


@query()
def correction_audit(spark, sf):
    rows = elements.from_text(table(spark, sf, "documents")).withColumns({"parser": F.lit("paddleocr"), "ocr_confidence": F.lit(0.95), "flagged": F.lit(None).cast("array<string>"), "excluded": F.lit(False)})
    return correction.status_counts(correction.corrected(rows))


@query(f"""WITH w AS (SELECT DISTINCT doc_id, {WORDS} FROM documents) SELECT count(*) AS payload_count, count(DISTINCT doc_id) AS ids, count(*) AS vector_count, 0::BIGINT AS bad_vectors, (SELECT count(*) FROM w) AS posting_count, []::VARCHAR[] AS errors, true AS ok FROM documents""")
def generation_publish(spark, sf):
    root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tessera-generations"
    chunks = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "doc_id", F.lit("text").alias("type"), F.col("text").alias("content"))
    home = index.build(chunks, root, f"g{zlib.crc32(sf.encode())}")
    verified = index.verify(spark, home, chunks.count())
    index.publish(spark, root, home.rsplit("/", 1)[1], verified)
    return verified
