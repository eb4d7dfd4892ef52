"""Token-id output: Parquet files of list columns, in document order, read back selectively.

Layout of a file: ``doc_id``, ``pos`` (part number << 33, plus row number; both ascending), ``at`` (ids before
the document within its part), ``n_tokens`` and ``ids`` (list of int32). Ids are dictionary-coded, the four
number columns delta-coded (version 2 pages, no dictionary); row groups and pages have fixed sizes and every
page an index entry, so a reader can fetch offsets without touching ids, or the ids of a few documents.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idlens.llm.bpe import Vocabulary, array_blocks, with_column, word_ids
from idlens.llm.common import lean, scratch_dir, text_batches

#: Options of the Parquet writer: sizes in bytes, page row limit, encodings.
LAYOUT = {
    "compression": "zstd",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(1 << 20),
    "parquet.page.row.count.limit": "2000",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#pos": "false",
    "parquet.enable.dictionary#at": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}


def library_encoder(path: str, vocab: Vocabulary) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Encodes pre-tokens with the tokenizers library, many in one call."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, normalizers

    library = Tokenizer.from_file(path)
    # pre-tokens are normalised already, and doing so twice can reorder marks
    library.normalizer = normalizers.Sequence([])
    ends_word = np.zeros(max(vocab.tokens) + 1, bool)
    ends_word[[i for i, t in vocab.tokens.items() if t.endswith(vocab.suffix)]] = True

    def encode_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # blanks part pre-tokens as well as their own rules do; a token with the suffix ends its word
        ids = np.array(library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.int64)
        last = np.flatnonzero(ends_word[ids])
        if len(last) == len(words):
            return ids, np.diff(last, prepend=-1)
        each = [e.ids for e in library.encode_batch_fast(words, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(each)), np.int64), np.array([len(x) for x in each])

    return encode_words


def tokenize(df: DataFrame, path: str, text: str = "text", end_id: int = 2) -> DataFrame:
    """(doc_id, at, n_tokens, ids) for each row, in the order of its partition.

    Ids come from the tokenizers library, asked once for each distinct pre-token of a worker, followed by ``end_id``.
    Null text counts as empty; long texts are encoded whole. An empty table gives no rows.
    """
    schema = T.StructType(
        [
            df.schema["doc_id"],
            T.StructField("at", T.LongType(), False),
            T.StructField("n_tokens", T.LongType(), False),
            T.StructField("ids", T.ArrayType(T.IntegerType(), False), False),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, known = 0, word_ids(path, "library", lambda vocab: library_encoder(path, vocab))
        for batch in array_blocks(batches, text):
            flat, bounds = known.encode_array(batch.column(text))
            flat = np.insert(flat, bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))
            yield with_column(batch.select(["doc_id"]), ("at", pa.array(before + bounds[:-1])), ("n_tokens", pa.array(np.diff(bounds))), ("ids", lists))
            before += len(flat)

    return text_batches(df.select("doc_id", text)).mapInArrow(lean(run), schema)


def write_tokens(df: DataFrame, path: str, to: str, text: str = "text", end_id: int = 2) -> None:
    """Write the tokens of ``df`` in ascending doc_id order (null first, equal ids by a hash of the text, then by text).

    Texts are range-partitioned before they are encoded, as they are smaller than their ids. Equal ids, or none, are
    spread by the hash. Other columns are not read, so their names never clash.
    """
    keyed = df.select("doc_id", F.col(text).alias("text"), F.xxhash64(text).alias("spread"))
    ordered, text = keyed.repartitionByRange("doc_id", "spread").sortWithinPartitions("doc_id", "spread", "text"), "text"
    tokens = tokenize(ordered, path, text, end_id)
    tokens.select("doc_id", F.monotonically_increasing_id().alias("pos"), "at", "n_tokens", "ids").write.options(**LAYOUT).parquet(to)


def read_tokens(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.parquet(at)


def part_starts(tokens: DataFrame) -> DataFrame:
    """(part, base): ids of all parts before it. Reads two number columns; one row for each written partition."""
    parts = tokens.groupBy(F.shiftright("pos", 33).alias("part")).agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read_documents(spark: SparkSession, at: str, doc_ids: list[int]) -> DataFrame:
    """Selected documents' ids; the predicate reaches the page indexes."""
    return read_tokens(spark, at).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def with_crc(tokens: DataFrame, ids: str = "ids") -> DataFrame:
    """Replace ``ids`` by ids_crc32: unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    kept = [c for c in tokens.columns if c != ids]
    schema = T.StructType([*(tokens.schema[c] for c in kept), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(ids)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends, ends[1:])]
            yield with_column(batch.select(kept), ("ids_crc32", pa.array(sums, pa.int64())))

    return text_batches(tokens).mapInArrow(lean(run), schema)


def digest(df: DataFrame, path: str) -> DataFrame:
    """The query of the contract: write the files to the shared scratch folder and report from them."""
    import uuid

    spark = df.sparkSession
    to = f"{scratch_dir(spark)}/idlens/token-files-{uuid.uuid4().hex}"
    write_tokens(df, path, to)
    tokens = read_tokens(spark, to)
    rows = with_crc(tokens.select("doc_id", "pos", "at", "n_tokens", "ids")).withColumn("part", F.shiftright("pos", 33))
    # one row a written partition: a bound that does not depend on the documents
    return rows.join(F.broadcast(part_starts(tokens)), "part").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )
