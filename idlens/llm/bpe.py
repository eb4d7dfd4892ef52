"""BPE encoding and decoding with a pair occurrence index.

Within a partition the words not seen before are laid out in one flat symbol list. An index maps each
adjacent pair to all its positions; active ranks are taken in ascending order, every position of the pair is
merged at once and the lists of the neighbouring pairs are updated. Each distinct word is thus encoded once a
partition, together with all the others, and documents are put together from the words' ids.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idlens.llm.common import lean, text_batches

#: Distinct words a worker remembers before it starts afresh; bounds its memory.
CACHE_WORDS = 300_000

# Fixed values of the vocabulary file's pre-tokenizer: contractions, letters, single numbers, other signs.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# The same for texts in Latin-1 without the signs of ``NOT_LATIN``.
SPLIT_LATIN = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\t-\r\x20a-z0-9\xdf-\xf6\xf8-\xff]+"
)
# Signs of Latin-1 that ``SPLIT_LATIN`` would take for punctuation: separators, blanks, letters and numbers.
NOT_LATIN = bytes([*range(0x1C, 0x20), 0x85, 0xA0, 0xAA, 0xB2, 0xB3, 0xB5, 0xB9, 0xBA, 0xBC, 0xBD, 0xBE])
#: ``SPLIT_LATIN`` over many texts, each ended by LF; and what a text must not hold for that.
SPLIT_LINES = re.compile(SPLIT_LATIN.pattern + r"|\n")
NOT_LINES = r"[^\x00-\xff]|[" + "".join(rf"\x{b:02x}" for b in NOT_LATIN) + r"]|<\|"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


class Vocabulary:
    """Ids, merges and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.suffix = suffix
        signs = byte_symbols()
        self.inner = np.array([vocab[s] for s in signs], np.int64)
        self.last = np.array([vocab[s + suffix] for s in signs], np.int64)
        self.made: dict[int, tuple[int, int, int]] = {}
        first: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            x, y = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = vocab[x], vocab[y], vocab[x + y]
            if max(first.get(x, -1), first.get(y, -1)) >= rank:
                raise ValueError("a merge precedes the one that makes its parts")
            first.setdefault(z, rank)
            self.made[rank] = x, y, z
        keys = np.array([x << 32 | y for x, y, _ in self.made.values()], np.int64)
        self.keys, at = np.unique(keys, return_index=True)
        self.ranks = np.array(list(self.made), np.int64)[at]
        self.special_at = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text, special tokens as they stand."""
        if self.special_at and "<|" in text and self.special_at.search(text):
            out, at = [], 0
            for m in self.special_at.finditer(text):
                out += [*self.plain_words(text[at : m.start()]), m[0]]
                at = m.end()
            return out + self.plain_words(text[at:])
        return self.plain_words(text)

    @staticmethod
    def plain_words(text: str) -> list[str]:
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            text = unicodedata.normalize("NFC", text)
        else:
            if len(raw.translate(None, NOT_LATIN)) == len(raw):
                return SPLIT_LATIN.findall(text.lower())
        # final sigma has no rule of its own here
        return SPLIT.findall(text.replace("Σ", "σ").lower())

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs can merge, and the ranks of those."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return hit, self.ranks[at[hit]]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids in one array, and how many each has, by the pair occurrence index over all of them."""
        raw = [w.encode("utf-8") for w in words]
        ends = np.cumsum([len(b) for b in raw])
        symbols = np.frombuffer(b"".join(raw), np.uint8)
        ids = self.inner[symbols]
        n = len(ids)
        if not n:
            return ids, np.zeros(len(words), np.int64)
        ids[ends - 1] = self.last[symbols[ends - 1]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends[:-1]] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(left: np.ndarray, right: np.ndarray) -> None:
            hit, rank = self.pairs(ids[left], ids[right])
            if not len(rank):
                return
            order = rank.argsort(kind="stable")
            rank, spots = rank[order], left[hit][order]
            cuts = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(rank)]
            for a, b in zip(cuts, cuts[1:]):
                r = int(rank[a])
                if r in index:
                    index[r].append(spots[a:b])
                else:
                    index[r] = [spots[a:b]]
                    heapq.heappush(active, r)

        first = np.flatnonzero(after >= 0)
        note(first, first + 1)
        while active:
            rank = heapq.heappop(active)
            x, y, z = self.made[rank]
            lists = index.pop(rank)
            i = lists[0] if len(lists) == 1 else np.concatenate(lists)
            j = after[i]
            good = (ids[i] == x) & (j >= 0) & (ids[j] == y)
            i = i[good]
            if x == y:
                i = self.apart(np.unique(i), after)
            j = after[i]
            k = after[j]
            ids[i], ids[j], after[i] = z, -1, k
            inner = k >= 0
            before[k[inner]] = i[inner]
            p = before[i]
            led = p >= 0
            note(np.concatenate([p[led], i[inner]]), np.concatenate([i[led], k[inner]]))
        bounds = np.concatenate([[0], np.cumsum(ids >= 0)])[np.concatenate([[0], ends])]
        return ids[ids >= 0], np.diff(bounds)

    @staticmethod
    def apart(i: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Of ascending places of a pair of equal symbols, those left once each merge takes its second one."""
        out, taken = [], -1
        for a, b in zip(i.tolist(), after[i].tolist()):
            if a != taken:
                out.append(a)
                taken = b
        return np.array(out, np.int64)


class Places(dict):
    """Word to its place; a new word gets the next one."""

    def __init__(self, words):
        super().__init__(zip(words, range(len(words))))
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        self.new.append(word)
        return place


class WordIds:
    """Ids of the words seen so far; beyond ``CACHE_WORDS`` of them it starts afresh, or keeps the frequent ones.

    One object serves all tasks that a Python worker runs, so a word is encoded once a worker.
    """

    def __init__(self, vocab: Vocabulary, encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.vocab, self.encode_words = vocab, encode_words
        self.clear()

    def clear(self) -> None:
        special = self.vocab.special
        # LF, which no word holds, has no ids: it marks ends
        self.place = Places([*special, "\n"])
        self.pool = np.array(list(special.values()), np.int32)
        self.size = np.array([1] * len(special) + [0], np.int32)
        self.start = np.arange(len(special) + 1, dtype=np.int64)
        self.uses = np.zeros(0, np.int64)

    def renew(self) -> None:
        """Forget the words met once, and the rarer ones beyond half of ``CACHE_WORDS``."""
        uses = np.concatenate([self.uses, np.zeros(len(self.place) - len(self.uses), np.int64)])
        uses[: len(self.vocab.special) + 1] = np.iinfo(np.int64).max
        kept = np.flatnonzero(uses > 1)
        if len(kept) > CACHE_WORDS // 2:
            kept = np.sort(kept[np.argsort(-uses[kept], kind="stable")[: CACHE_WORDS // 2]])
        words = list(self.place)
        self.place = Places([words[i] for i in kept.tolist()])
        self.pool, upto = gather(self.pool, self.start[kept], self.size[kept])
        self.start, self.size, self.uses = upto[:-1], self.size[kept], uses[kept] // 2

    def places(self, words: Iterator[str], n: int) -> np.ndarray:
        """Where the ids of ``n`` words are, once those of new words are there too."""
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, n)
        if new := self.place.new:
            flat, size = self.encode_words(new)
            self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size.astype(np.int32)])
            self.pool = np.concatenate([self.pool, flat.astype(np.int32)])
            self.place.new = []
        return at

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's begin (and the end)."""
        if len(self.place) > CACHE_WORDS:
            self.clear()
        docs = [self.vocab.words(t) for t in texts]
        count = [len(d) for d in docs]
        at = self.places(chain.from_iterable(docs), sum(count))
        ids, upto = gather(self.pool, self.start[at], self.size[at])
        return ids, upto[np.concatenate([[0], np.cumsum(count)]).astype(np.int64)]

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, of an Arrow array (null: empty).

        No word holds a blank, so texts are cut at blanks in Arrow and each distinct piece is split into words once.
        """
        if any(len(t.split()) != 1 or t != t.strip() for t in self.vocab.special):
            return self.encode([t or "" for t in texts.to_pylist()])
        if len(self.place) > CACHE_WORDS:
            self.renew()
        pieces = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        met = pieces.flatten().dictionary_encode()
        odd = pc.match_substring_regex(met.dictionary, NOT_LINES).to_numpy(zero_copy_only=False).astype(bool)
        lines = met.dictionary.filter(pa.array(~odd))
        words: list[str] = []
        if len(lines):
            words = SPLIT_LINES.findall(pc.binary_join(pa.ListArray.from_arrays([0, len(lines)], lines), "\n")[0].as_py().lower())
            words.append("\n")
        for piece in met.dictionary.filter(pa.array(odd)).to_pylist():
            words += self.vocab.words(piece)
            words.append("\n")
        at = self.places(iter(words), len(words))
        flat, upto = gather(self.pool, self.start[at], self.size[at])
        marks = np.flatnonzero(at == self.place["\n"])
        ends = upto[marks]
        order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
        start, size = np.empty(len(ends), np.int64), np.empty(len(ends), np.int64)
        start[order], size[order] = np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0)
        each = met.indices.to_numpy(zero_copy_only=False)
        times = np.bincount(each, minlength=len(ends))[order]
        uses = np.bincount(at, np.repeat(times, np.diff(marks, prepend=-1)), len(self.place)).astype(np.int64)
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        ids, upto = gather(flat, start[each], size[each])
        return ids, upto[np.concatenate([[0], np.cumsum(pieces.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)]


def gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``pool`` one after the other, and where each begins (and the end)."""
    upto = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    return pool[np.repeat(start - upto[:-1], size) + np.arange(upto[-1])], upto


_words: dict[tuple[str, str], WordIds] = {}


def word_ids(path: str, kind: str, make: Callable[[Vocabulary], Callable]) -> WordIds:
    """The worker's ``WordIds`` of a vocabulary file and a way to encode."""
    if (path, kind) not in _words:
        _words[path, kind] = WordIds(vocabulary(path), make(vocabulary(path)))
    return _words[path, kind]


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def text_blocks(batches: Iterator[pa.RecordBatch], column: str, chars: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of Arrow batches of about ``chars`` characters, with their texts (null: empty).

    ``column`` may be a field of a struct, as ``row.text``.
    """
    name, _, field = column.partition(".")
    for batch in batches:
        values = batch.column(name).field(field) if field else batch.column(name)
        texts: list[str] = []
        at = size = 0
        for i, t in enumerate(values):
            texts.append(t.as_py() or "")
            size += len(texts[-1])
            if size >= chars or i + 1 == len(values):
                yield batch.slice(at, i + 1 - at), texts
                texts, at, size = [], i + 1, 0


def array_blocks(batches: Iterator[pa.RecordBatch], column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with about ``size`` bytes of text."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(upto // size)) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if a < b)


def with_column(batch: pa.RecordBatch, *columns: tuple[str, pa.Array]) -> pa.RecordBatch:
    names = [*batch.schema.names, *(n for n, _ in columns)]
    return pa.RecordBatch.from_arrays([*batch.columns, *(c for _, c in columns)], names=names)


def encoder(path: str, text: str, kept: list[str], ids: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(path, "index", lambda vocab: vocab.encode_words)
        for batch, texts in text_blocks(batches, text):
            flat, ends = known.encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
            yield with_column(batch.select(kept), (ids, lists))

    return run


def decoder(path: str, ids: str, out: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(path).tokens
        size = max(tokens) + 1
        table = [tokens.get(i) for i in range(size)]
        whole = None not in table
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            lists = batch.column(ids)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(int)
            texts = []
            for a, b in zip(ends, ends[1:]):
                part = flat[a:b].tolist()
                if not whole or part and (min(part) < 0 or max(part) >= size):
                    part = [i for i in part if 0 <= i < size and table[i] is not None]
                texts.append(" ".join([table[i] for i in part]))
            yield with_column(batch, (out, pa.array(texts, pa.string())))

    return run


IDS = T.ArrayType(T.IntegerType(), False)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Add ``ids`` (array<int>) to ``df``: the whole text's token ids; null or blank text has none.

    ``keep`` names the columns passed through (default: all; a column named as ``ids`` is replaced). Narrow:
    one pass, no shuffle; rows may repeat, ids may be null. An empty table gives no rows.
    """
    kept = [c for c in (keep or df.columns) if c != ids]
    source = df.select(*kept, *([] if text in kept else [text]))
    schema = T.StructType([*(source.schema[c] for c in kept), T.StructField(ids, IDS, False)])
    return text_batches(source).mapInArrow(lean(encoder(path, text, kept, ids)), schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the tokens of ``ids`` joined by blanks, as a file without a decoder asks; null ids: empty.

    Unknown ids are left out. A column named as ``out`` is replaced.
    """
    others = [c for c in df.columns if c != out]
    source = df.select(*others)
    schema = T.StructType([*source.schema.fields, T.StructField(out, T.StringType(), False)])
    return text_batches(source).mapInArrow(lean(decoder(path, ids, out)), schema)


def encode_decode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", out: str = "decoded", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``encode`` and ``decode`` in one pass through one Python worker a task: the ids it decodes are those it made."""
    kept = [c for c in (keep or df.columns) if c not in (ids, out)]
    source = df.select(*kept, *([] if text in kept else [text]))
    schema = T.StructType([*(source.schema[c] for c in kept), T.StructField(ids, IDS, False), T.StructField(out, T.StringType(), False)])
    first, second = encoder(path, text, kept, ids), decoder(path, ids, out)
    return text_batches(source).mapInArrow(lean(lambda batches: second(first(batches))), schema)


def digest(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The query of the contract: encode, decode, and digests of both."""
    return encode_decode(df, path, text, keep=("doc_id",)).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
