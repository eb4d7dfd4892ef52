"""Fill-in-the-middle transformation of documents, as a pyarrow.compute pipeline.

Texts are split into units (lines with their LF). A batch at a time the units become one list array, flattened beside
their documents' indices; a unit's ordinal in its document gives it the role prefix, middle or suffix; units are filtered
by role, the lists rebuilt from the roles' counts and joined to pieces, and the pieces joined in the document's form. No
step runs over single rows in Python. The draws come from a hash of seed and id, so runs agree and no order matters.

Null and empty texts are plain and come back empty. Rows of one id draw the same numbers; rows without an id draw those of
an empty one. A text that holds a mark is plain, so an output can be taken apart at its marks again. Very long
texts go whole, in batches of bounded bytes. An empty table gives no rows; columns of the results' names are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idlens.llm.bpe import with_column
from idlens.llm.common import lean, text_batches

#: Characters of texts that one step works on: a batch with longer ones has one text a step.
STEP_BYTES = 8 << 20


@dataclass(frozen=True)
class Marks:
    """What stands before each piece, and how often documents are cut and how."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    #: Documents of a hundred that are cut, and of those how many have the suffix first.
    rate: int = 100
    suffix_first: int = 50
    seed: int = 7

    @property
    def pattern(self) -> str:
        return "|".join(map(re.escape, (self.prefix, self.suffix, self.middle)))


def draws(doc_id: str, seed: int) -> list[Column]:
    """h1 to h4: the first four groups of eight hex digits of the sha256 of seed and id, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"_h{i + 1}") for i in range(4)]


def list_of(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def cut(texts: pa.Array, h: list[np.ndarray], marks: Marks) -> list[tuple[str, pa.Array]]:
    """The result columns of a batch of texts without nulls and their draws."""
    lines = pc.split_pattern(texts, "\n")
    line, parent = pc.list_flatten(lines), pc.list_parent_indices(lines).to_numpy()
    size = pc.list_value_length(lines).to_numpy()
    ordinal = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size)
    last = ordinal == size[parent] - 1
    # the last piece of a split has no LF, and is no unit where it is empty
    unit = pc.binary_join_element_wise(line, pc.if_else(pa.array(last), "", "\n"), "")
    real = ~(last & (pc.binary_length(line).to_numpy() == 0))
    unit, parent, ordinal = unit.filter(pa.array(real)), parent[real], ordinal[real]
    n = np.bincount(parent, minlength=len(texts)).astype(np.int64)
    a, b = np.minimum(h[0] % (n + 1), h[1] % (n + 1)), np.maximum(h[0] % (n + 1), h[1] % (n + 1))
    role = (ordinal >= a[parent]).astype(np.int8) + (ordinal >= b[parent])
    prefix, middle, suffix = (
        pc.binary_join(list_of(unit.filter(pa.array(role == r)), count), "") for r, count in enumerate((a, b - a, n - b))
    )
    marked = pc.match_substring_regex(texts, marks.pattern).to_numpy(zero_copy_only=False)
    plain = (n == 0) | marked | (h[2] % 100 >= marks.rate)
    spm = h[3] % 100 < marks.suffix_first
    as_psm = pc.binary_join_element_wise(marks.prefix, prefix, marks.suffix, suffix, marks.middle, middle, "")
    as_spm = pc.binary_join_element_wise(marks.suffix, suffix, marks.prefix, prefix, marks.middle, middle, "")
    plain, spm = pa.array(plain), pa.array(spm)
    chars = lambda piece: pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(piece).cast(pa.int64()))
    return [
        ("n", pa.array(n)),
        ("form", pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))),
        ("prefix_chars", chars(prefix)),
        ("middle_chars", chars(middle)),
        ("output", pc.if_else(plain, texts, pc.if_else(spm, as_spm, as_psm))),
    ]


def rebuild(output: pa.Array, form: pa.Array, marks: Marks) -> pa.Array:
    """The texts that outputs of the given forms were made of."""
    cut_up = pc.and_(pc.is_valid(form), pc.is_in(form, pa.array(["psm", "spm"])))
    # a plain output may hold marks of its own, so it is not split
    pieces = pc.split_pattern_regex(pc.if_else(cut_up, output, f"{marks.prefix}{marks.suffix}{marks.middle}"), marks.pattern)
    first, second, middle = (pc.list_element(pieces, i) for i in (1, 2, 3))
    psm = pc.fill_null(pc.equal(form, "psm"), False)
    prefix, suffix = pc.if_else(psm, first, second), pc.if_else(psm, second, first)
    return pc.if_else(cut_up, pc.binary_join_element_wise(prefix, middle, suffix, ""), output)


def steps(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of batches of about ``STEP_BYTES`` of text, with their texts (null: empty)."""
    for batch in batches:
        texts = pc.fill_null(batch.column(column), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        at = 0
        while at < len(texts):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + STEP_BYTES, "right")))
            # an array of its own, as kernels of lists read offsets from zero
            yield batch.slice(at, to - at), pa.concat_arrays([texts.slice(at, to - at)])
            at = to


HASHES = ["_h1", "_h2", "_h3", "_h4"]
MADE = [T.StructField("n", T.LongType(), False), T.StructField("form", T.StringType(), False), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType(), False)]


def transformer(text: str, kept: list[str], marks: Marks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches, text):
            drawn = [batch.column(h).to_numpy() for h in HASHES]
            yield with_column(batch.select(kept), *cut(texts, drawn, marks))

    return run


def restorer(output: str, form: str, to: str, marks: Marks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches, output):
            yield with_column(batch, (to, rebuild(texts, batch.column(form), marks)))

    return run


def _source(df: DataFrame, text: str, marks: Marks, keep: tuple[str, ...] | None) -> tuple[DataFrame, list[str], T.StructType]:
    names = {f.name for f in MADE} | {"restored", *HASHES}
    kept = [c for c in (keep or df.columns) if c not in names]
    source = df.select(*kept, *([] if text in kept else [text]), *draws("doc_id", marks.seed))
    return text_batches(source), kept, T.StructType([*(source.schema[c] for c in kept), *MADE])


def transform(df: DataFrame, text: str = "text", marks: Marks = Marks(), keep: tuple[str, ...] | None = None) -> DataFrame:
    """Add to ``df`` n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output.

    Prefix ends after the smaller of two drawn numbers of units, middle after the larger. ``keep`` names the columns
    passed through (default: all). Narrow: one pass, no shuffle.
    """
    source, kept, schema = _source(df, text, marks, keep)
    return source.mapInArrow(lean(transformer(text, kept, marks)), schema)


def restore(df: DataFrame, output: str = "output", form: str = "form", to: str = "restored", marks: Marks = Marks()) -> DataFrame:
    """Add ``to``: the text rebuilt from ``output`` and ``form`` alone. A null form counts as plain, a null output as empty."""
    source = df.select(*(c for c in df.columns if c != to))
    schema = T.StructType([*source.schema.fields, T.StructField(to, T.StringType(), False)])
    return text_batches(source).mapInArrow(lean(restorer(output, form, to, marks)), schema)


def transform_restore(df: DataFrame, text: str = "text", marks: Marks = Marks(), keep: tuple[str, ...] | None = None) -> DataFrame:
    """``transform``, then ``restore`` from what it gave, through one Python worker a task."""
    source, kept, schema = _source(df, text, marks, keep)
    first, second = transformer(text, kept, marks), restorer("output", "form", "restored", marks)
    return source.mapInArrow(lean(lambda batches: second(first(batches))), T.StructType([*schema.fields, T.StructField("restored", T.StringType(), False)]))


def digest(df: DataFrame) -> DataFrame:
    """The query of the contract."""
    both = transform_restore(df.select("doc_id", "text"), keep=("doc_id",))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output"), sha("restored"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
        ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
p AS (SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM u),
q AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
             WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM q
"""
