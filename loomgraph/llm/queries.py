"""The operators' queries over whole tables, with the result columns their contracts fix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.binary_search import binary_search
from loomgraph.llm.exact_search import exact_search
from loomgraph.llm.line_dedup import line_dedup
from loomgraph.llm.secret_scan import secret_scan
from loomgraph.llm.sentencepiece_codec import sentencepiece_codec
from loomgraph.llm.simhash_dedup import simhash_dedup
from loomgraph.llm.source_mix import source_mix
from loomgraph.llm.token_counts import token_counts
from loomgraph.llm.toxicity import fit, toxicity
from loomgraph.llm.warc_table import warc_round_trip

#: The tokenizer file of the token counter and the codec.
PIECE_MODEL = "piece_bpe_32k.model"


def model_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(PIECE_MODEL))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (what is left of it)."""
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; a null text is empty, repeated rows are counted each."""
    return token_counts(table(spark, sf_dir, "documents"), model_path()).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score of the 5 highest inner products; rows of equal id and vector count once, bad vectors take no part, an empty table has no rows."""
    return exact_search(table(spark, sf_dir, "embeddings"), F.expr("_id % 50 = 0"))


def op4_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score of the 5 nearest by cosine; rows of equal id and vector count once, bad or zero vectors take no part."""
    return binary_search(table(spark, sf_dir, "embeddings"), F.expr("_id % 50 = 0"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip, parity."""
    return sentencepiece_codec(table(spark, sf_dir, "documents"), model_path(), ids=False)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; null and empty texts get the score of no words, long texts are scored a part at a time."""
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every row, read back from the archives; null html is an empty payload."""
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row; null and repeated ids are rows of their own, null is a source."""
    return source_mix(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row; a null text has no spans."""
    found = secret_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.encode("base_spans", "UTF-8"), 256).alias("base_sha256"), "spans")


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every row; texts without words have fingerprint zero and are linked like any other."""
    return simhash_dedup(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_token_counts, op3_exact_topk, op4_ann_search, op5_sentencepiece, op6_toxicity, op7_warc, op8_source_mix, op9_secret_scan, op10_simhash_dedup)}

LINES_SQL = """
parts AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, i, trim(ls[i], ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS s FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM parts WHERE text IS NOT NULL)),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id, i) AS rn FROM lines WHERE s <> ''),
firsts AS (SELECT s, min(rn) AS rn, length(s) AS n FROM numbered GROUP BY s),
halves AS (
  SELECT s, rn, n - less AS n, left(s, ((n - less) // 2)::BIGINT) AS half, 0 AS side FROM firsts, (VALUES (0), (1)) v(less) WHERE n >= 20
  UNION ALL SELECT s, rn, n - less, right(s, (n - less - (n - less) // 2)::BIGINT), 1 FROM firsts, (VALUES (0), (1)) v(less) WHERE n >= 20),
near AS (SELECT DISTINCT b.s FROM halves a JOIN halves b ON a.n = b.n AND a.side = b.side AND a.half = b.half AND a.rn < b.rn WHERE abs(length(a.s) - length(b.s)) <= 1 AND levenshtein(a.s, b.s) = 1),
gone AS (SELECT l.doc_id, l.i FROM numbered l JOIN firsts f ON f.s = l.s LEFT JOIN near x ON x.s = l.s WHERE l.rn <> f.rn OR x.s IS NOT NULL),
per_doc AS (SELECT doc_id, list(i) AS drops FROM gone GROUP BY doc_id)
"""

WORDS_SQL = "coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT"

ORACLE_SQL = {
    "op1_line_dedup": f"""WITH {LINES_SQL}
SELECT p.doc_id, coalesce(len(p.ls), 0)::BIGINT AS n_lines, coalesce(len(d.drops), 0)::BIGINT AS n_dropped,
  CASE WHEN d.drops IS NULL THEN p.text ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(p.ls) + 1), lambda i: NOT list_contains(d.drops, i)), lambda i: p.ls[i]), chr(10)), '') END AS text
FROM parts p LEFT JOIN per_doc d ON d.doc_id = p.doc_id""",
    "op3_exact_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op7_warc": """WITH y AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM y WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, y.d AS payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM y LEFT JOIN f ON f.d = y.d""",
}
