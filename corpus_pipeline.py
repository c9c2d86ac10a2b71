"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.line_dedup import line_dedup
from loomgraph.llm.queries import model_path, table
from loomgraph.llm.sentencepiece_codec import sentencepiece_codec
from loomgraph.llm.simhash_dedup import simhash_dedup
from loomgraph.llm.source_mix import source_mix
from loomgraph.llm.toxicity import fit, toxicity
from loomgraph.plans.shared import shared_dir, written

#: A word, as written inside a SQL string.
WORD_SQL = r"[^\\x20\\x09-\\x0D]+"


def packed(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, text, _doc)``: all columns but the text in one, with which no name can clash."""
    return docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_doc"))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again; n_chars follows the text."""
    own = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[own.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])


def with_keys(docs: DataFrame) -> DataFrame:
    """:func:`packed` rows, written, and their ``_key``: null ids last, then the id, a hash of the row, and a number that tells equal rows apart."""
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64("_doc", "text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    return written(packed(docs).withColumn("_key", key))[0]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, gives 0.5 or more go. Each row is judged by its own text, whatever its id; null and empty texts get the score of no words."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity(packed(docs).select("_doc", "text"), model, id_col="_doc", with_text=True)
    return scored.where("predicted = 0").select(*[F.col("text") if c == "text" else F.col(f"_doc.`{c}`") for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; documents that lose their last words so go too. n_chars follows the text. Null and empty texts stay."""
    return unpacked(line_dedup(packed(docs)).where(f"n_dropped = 0 OR text RLIKE '{WORD_SQL}'"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word Jaccard 0.8 or more) one row stays, that of the smallest id; ids may repeat or be null, null ids come last. Documents without words aren't copies of each other."""
    rows = with_keys(docs)
    marked = simhash_dedup(rows, id_col="_key", shingle=5, least=Fraction(4, 5)).where("_key.row != component_id.row").select(F.col("_key.row").alias("_gone"))
    return unpacked(rows.join(marked, F.col("_key.row") == F.col("_gone"), "left_anti"), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows by the words the mix takes of each: none, the row goes; up to its size, a row; beyond that a second row. A part taken is the document's first words. Rows without words stay."""
    rows = with_keys(docs)
    mixed = source_mix(rows, key_col="_key").select(F.col("_key.row").alias("_row"), F.col("size").alias("_size"), F.col("taken").alias("_taken"))
    held = rows.join(mixed, F.col("_key.row") == F.col("_row")).where("_taken > 0 OR _size = 0")
    held = held.select("_doc", "text", "_size", F.explode(F.expr("CASE WHEN _taken > _size THEN array(_size, _taken - _size) ELSE array(_taken) END")).alias("_words"))
    text = r"CASE WHEN _words >= _size THEN text ELSE array_join(slice(regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+', 0), 1, cast(_words AS int)), '') END"
    return unpacked(held.select("_doc", F.expr(text).alias("text")), docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token ids: doc_id, n_tokens, token_ids, round_trip, parity."""
    return sentencepiece_codec(docs, model_path()).select("doc_id", "n_tokens", "token_ids", "round_trip", "parity")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: A trained classifier and a tokenizer aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what is between them is written in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    where = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        path = f"{where}/{i}-{re.sub(r'[^A-Za-z]+', '-', name)}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
