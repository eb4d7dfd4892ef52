"""A corpus pipeline: toxicity, line dedup, near-dedup, mixing and tokens, each stage over all that is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idlens.llm import bpe, line_dedup, minhash_dedup, mixing, toxicity
from idlens.llm.common import materialize
from idlens.llm.queries import table, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.

    Null and empty texts are scored as empty ones and stay unless empty texts are labelled toxic; rows with null or
    repeated ids are judged each on its own, equal texts alike; a score of exactly 0.5 goes. No rows in, none out.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of later occurrences of three-line windows go; n_chars follows the text.

    Null texts stay null, empty ones empty, and texts of fewer than three lines stay as they are. A row without an id
    is a document of its own, after all others; rows that share an id lose the same places. Of equal windows the one
    of the smallest id and place stays. No rows in, none out; extra columns pass through.
    """
    cut = line_dedup.dedup_lines(docs)
    if "n_chars" not in docs.columns:
        return cut.select(*docs.columns)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id.

    Null and empty texts link with nothing and stay. Rows of one id stay or go together; rows without an id stay, as
    nothing names them. No rows in, none out; extra columns pass through.
    """
    return minhash_dedup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Texts without words, null ones included, and rows without an id have no share and go; a null source is a source;
    rows of one id are taken alike. No rows in, none out; extra columns pass through.
    """
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, and the digest of what they decode to.

    Null and empty texts have no ids and decode to an empty text. One row for each row, repeated ones too; extra
    columns go, whatever their names. No rows in, none out.
    """
    both = bpe.encode_decode(docs, tokenizer_path(), keep=("doc_id", "source"))
    return both.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("MinHash near-dedup", drop_copies),
    ("mixing", mix),
    ("BPE", tokens),
]

#: The toxicity model has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's output is a written table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return docs
