"""Packing, ranked search and fill-in-the-middle against brute force and exact round trips."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from idlens.llm import fill_in_middle, lexical_search, packing
from idlens.llm.queries import tokenizer_path

from ..conftest import SF

LONG = "one two three. \n" * 20_000
EXTRA = [
    (None, None), (None, "no id\nat all"), (None, "no id\nat all"), (7000, None), (7001, ""), (7002, "\n"), (7003, "\n\n\n"), (7004, "no line end"), (7005, "a\nb"), (7005, "a\nb"), (7006, "has <S> inside\nand more"),
    (7007, "ends <\n<P\n<M"), (7008, LONG), (7009, "İΣΑΣ ﬁ ½ ² é\r\nx\x00y\n"), (7010, "<|endoftext|> x"), (7011, " \t "),
]
CLASH = ("n", "form", "output", "restored", "_h1", "_h2", "pos", "part", "nth", "length", "ids", "piece", "score", "rank", "t", "term", "query")


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return base.union(spark.createDataFrame(EXTRA, base.schema)).withColumns({c: F.lit("x") for c in CLASH}).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def cut_by_hand(doc_id, text, rate=100, spm=50):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(docs, rows):
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in fill_in_middle.transform_restore(docs.select("doc_id", "text")).collect())
    assert got == Counter((i, *cut_by_hand(i, t), t) for i, t in rows)
    made = fill_in_middle.transform(docs)
    assert set(made.columns) == {*docs.columns} - {"restored", "_h1", "_h2"} | {"prefix_chars", "middle_chars"}
    back = fill_in_middle.restore(made, to="text2")
    assert back.where(~F.coalesce("text", F.lit("")).eqNullSafe(F.col("text2"))).count() == 0 and back.count() == len(rows)
    assert {f for _, _, f, *_ in got} == {"plain", "psm", "spm"} and fill_in_middle.digest(docs.limit(0)).count() == 0


def test_fill_in_middle_with_other_settings(docs, rows):
    marks = fill_in_middle.Marks("[pre|", "[suf|", "[mid|", rate=40, suffix_first=0)
    got = fill_in_middle.restore(fill_in_middle.transform(docs.select("doc_id", "text"), marks=marks), marks=marks).collect()
    assert {r.form for r in got} == {"plain", "psm"} and Counter((r.doc_id, r.restored) for r in got) == Counter(rows)
    assert {(r.doc_id, r.restored, r.form) for r in got if "<" not in r.restored} == {(i, t, cut_by_hand(i, t, 40, 0)[1]) for i, t in rows if "<" not in t}


def test_fill_in_middle_of_one_batch_with_long_texts(spark):
    """Batches are cut at their bytes; a text beyond the bound is a step of its own."""
    texts = [(i, ("line %d\n" % i) * (200_000 if i in (2, 3) else i)) for i in range(8)]
    got = fill_in_middle.transform_restore(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)).collect()
    assert {r.doc_id: (r.n, r.restored) for r in got} == {i: (t.count("\n"), t) for i, t in texts}


def one_by_one(sizes, room):
    """Best-two-fit over single documents: fill greedily, then trade the smallest for the two that fit tightest."""
    left, bins = sorted(sizes, reverse=True), 0
    while left:
        bin_, free = [], room
        for s in list(left):
            if s <= free:
                bin_.append(s)
                left.remove(s)
                free -= s
        if free and len(bin_):
            small = min(bin_)
            best = max(((x + y, max(x, y)) for k, x in enumerate(left) for y in left[k + 1 :] if x + y <= free + small), default=(0, 0))
            if best[0] > small:
                bin_.remove(small)
                for s in (best[1], best[0] - best[1]):
                    bin_.append(s)
                    left.remove(s)
                left = sorted([*left, small], reverse=True)
        assert sum(bin_) <= room
        bins += 1
    return bins


def first_fit_decreasing(sizes, room):
    free = []
    for s in sorted(sizes, reverse=True):
        k = next((k for k, f in enumerate(free) if f >= s), None)
        if k is None:
            free.append(room - s)
        else:
            free[k] -= s
    return len(free)


@pytest.mark.parametrize("seed", range(60))
def test_plan_packs_as_one_by_one(seed):
    rnd = random.Random(seed)
    room = rnd.choice([10, 30, 60])
    sizes = [rnd.choice([rnd.randint(1, room), rnd.randint(1, max(1, room // 3)), room // 2]) for _ in range(rnd.choice([3, 40, 150]))]
    entries = packing.plan(dict(Counter(sizes)), room)
    assert max(e.sequence + e.repeats for e in entries) == one_by_one(sizes, room) <= first_fit_decreasing(sizes, room) + 1
    held = {}
    for e in entries:
        for k in range(e.repeats):
            held.setdefault(e.sequence + k, []).append((e.offset, e.each * e.length))
    for parts in held.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= room
    assert Counter(s for e in entries for s in [e.length] * (e.repeats * e.each)) == Counter(sizes) and packing.plan({}, room) == []


def test_packing(spark, docs, rows):
    from tokenizers import Tokenizer

    library, want = Tokenizer.from_file(tokenizer_path()), Counter()
    for i, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[i, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    # many partitions, so that a length's pieces are numbered across parts
    packed = packing.pack(docs.repartition(7, F.xxhash64("text")), tokenizer_path()).cache()
    got = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert parts[-1][0] + parts[-1][1] <= 2048 and all(b == sum(n for _, n in parts[:k]) for k, (b, _) in enumerate(parts))
    sizes = [k[3] for k, n in want.items() for _ in range(n)]
    assert -(-sum(sizes) // 2048) <= len(bins) <= first_fit_decreasing(sizes, 2048)
    by = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert set(by) == set(bins) and sum(r.n_tokens for r in by.values()) == sum(sizes)
    for r in got:
        assert by[r.sequence_id].ids[r.offset : r.offset + r.length] == list(r.ids)
    assert packing.digest(docs.limit(0), tokenizer_path()).count() == 0


def test_packing_of_one_length(spark):
    """Copies of one text, a third of them without an id, fill sequences side by side."""
    d = spark.createDataFrame([(None if i % 3 == 0 else i, "a b c") for i in range(3000)], "doc_id long, text string").repartition(11)
    got = packing.digest(d, tokenizer_path()).collect()
    assert len(got) == 3000 and {r.length for r in got} == {4} and len({(r.sequence_id, r.offset) for r in got}) == 3000 and len({r.sequence_id for r in got}) == 6


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def folded(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranking(rows, items, top=10):
    counts = [(i, Counter(folded(t))) for i, t in rows]
    counts = [(i, c) for i, c in counts if c]
    n_docs, words = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = set()
    for item, text in items.items():
        scores = []
        for i, c in counts:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(folded(text)) if c[t])
            scores += [(-s, i is None, i or 0)] if s > 0 else []
        for rank, (s, none, i) in enumerate(sorted(scores)[:top], 1):
            out.add((item, rank, None if none else i, -s))
    return out


def test_lexical_search(spark, docs, rows):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    more = [(900, None), (901, ""), (902, "..."), (903, "İΣΑΣ É x one"), (904, LONG), (905, "nowhere-to-be-found")]
    asked = items.union(spark.createDataFrame(more, items.schema)).withColumns({c: F.lit(0) for c in ("query_id", "query", "rank", "term", "terms", "score")})
    got = {(r.item_id, r["rank"], r.doc_id, r.score) for r in lexical_search.search(docs, asked).collect()}
    assert got == ranking(rows, {r.item_id: r.text for r in asked.collect()})
    assert lexical_search.search(docs.limit(0), asked).count() == lexical_search.search(docs, asked.limit(0)).count() == 0


@pytest.mark.parametrize("shard, window, pairs, top", [(40, 16, 100, 10), (300, 64, 10**6, 3), (7, 4, 37, 1)])
def test_lexical_search_in_many_shards_windows_and_blocks(spark, monkeypatch, shard, window, pairs, top):
    """Ties, copies, common and rare words: any size of shards, windows and blocks gives the plain ranking."""
    rnd = random.Random(shard)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rnd.choices(words, [1 / (k + 1) for k in range(200)], k=rnd.choice([0, 1, 5, 40, 300])))) for i in range(900)]
    rows += [(2000 + i, "w1 w2 w190") for i in range(50)] + [(None, "w199 w199 w0")] * 2
    items = {i: " ".join(rnd.choices(words, k=rnd.choice([1, 3, 12, 40]))) for i in range(25)} | {77: "w0", 78: "w0 w1 w2", 79: "w190 w2"}
    for name, value in (("SHARD_DOCS", shard), ("WINDOW", window)):
        monkeypatch.setattr(lexical_search, name, value)
    block = next(lexical_search.blocks(lexical_search.query_terms(spark.createDataFrame(list(items.items()), "item_id long, text string")), 10**6))
    assert len(block.ids) == len(items)
    # the search itself, as workers do not see changed settings
    index = [lexical_search._pack(*part) for part in shards(rows, block.vocabulary, shard)]
    known = known_of(rows, block.vocabulary)
    best = [lexical_search.Best(top) for _ in block.ids]
    for batch in index:
        held = lexical_search.Shard(batch.to_pylist()[0], known)
        for numbers, own in zip(block.terms, best):
            held.search(numbers, own)
    got = {(item, k, None if own.no_id[k - 1] else int(own.doc[k - 1]), int(own.score[k - 1])) for item, own in zip(block.ids, best) for k in range(1, len(own.score) + 1)}
    assert got == ranking(rows, items, top)
    many = list(lexical_search.blocks(lexical_search.query_terms(spark.createDataFrame(list(items.items()), "item_id long, text string")), pairs))
    assert sorted(i for b in many for i in b.ids) == sorted(items) and (pairs > 1000 or len(many) > 1)


def shards(rows, vocabulary, size):
    for at in range(0, len(rows), size):
        part = ([], [], [], [], [])
        for k, (i, t) in enumerate(rows[at : at + size]):
            found = lexical_search.terms(t.encode())
            part[0].append(i)
            part[1].append(len(found))
            for w, c in Counter(found).items():
                if w in vocabulary:
                    part[2].append(vocabulary[w])
                    part[3].append(k)
                    part[4].append(c)
        yield part


def known_of(rows, vocabulary):
    counts = [c for _, t in rows if (c := Counter(folded(t)))]
    df = Counter(t for c in counts for t in c)
    weights = [math.floor(1000 * math.log((2 * len(counts) + 2) / (2 * df[t.decode()] + 1))) for t in vocabulary]
    return lexical_search.Collection(len(counts), sum(sum(c.values()) for c in counts), np.array(weights, np.int64))


def test_lexical_search_of_repeated_items_in_blocks(spark, monkeypatch):
    """Rows of one item are one query; several blocks give what one gives."""
    rows = [(1, "Apple pie"), (2, "apple-tart and pie"), (3, "pear"), (4, None), (5, "apple apple apple")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    q = spark.createDataFrame([(1, "apple"), (1, "PIE"), (None, "pear"), (2, "apple"), (3, None)], "item_id int, text string")
    whole = sorted(map(tuple, lexical_search.search(d, q).collect()), key=str)
    assert {(r[0], r[1], r[2]) for r in whole} >= {(1, 1, 1), (None, 1, 3), (2, 1, 5)} and {r[0] for r in whole} == {1, 2, None}
    plain = lexical_search.blocks
    monkeypatch.setattr(lexical_search, "blocks", lambda asked: plain(asked, 1))
    assert sorted(map(tuple, lexical_search.search(d, q).collect()), key=str) == whole


def test_length_norm_beyond_64_bits():
    known = lexical_search.Collection(3 * 10**10, 10**14, np.array([1]))
    assert known.norm(np.array([10, 4 * 10**9])).tolist() == [10 + 90 * n * 3 * 10**10 // 10**14 for n in (10, 4 * 10**9)]
