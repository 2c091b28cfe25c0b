"""Suffix buckets, the conversation trie and ranked search against plain Python, on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from tissuelake.llm import conversation_trie, lexical_search, suffix_dedup


def _cut(texts, length):
    """Per text: bytes, removed, spans, digest of the rest."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, dtype=bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=False) if not g)).hexdigest()))
    return out


def _texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, source = prose(90), prose(400)
    texts = [None, "", "x" * 127, "y" * 128, "y" * 129, "ab" * 400, "z" * 900, "z" * 300 + prose(20) + "z" * 300]
    texts += [prose(30) + passage + prose(30) for _ in range(40)]
    for _ in range(40):
        words = source.split(" ")
        for _ in range(3):
            words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words))
    texts += [source] * 6 + [source[:700], source[350:], passage, passage + passage]
    return texts


@pytest.mark.parametrize("hot", [512, 1])
def test_suffix_dedup_is_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = _texts(hot)
    rows = [(i if i != 11 else None, t, "r", 1, b"q", 7, "e") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, start int, kept binary, bucket int, `a.b` string")
    got = suffix_dedup.remove_repeats(docs, 128)
    found = {r.row.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got.collect()}
    assert found == {r[0]: e for r, e in zip(rows, _cut(texts, 128), strict=True)}
    one = got.where("row.doc_id = 3").first().row
    assert (one.row, one.start, bytes(one.kept), one.bucket, one["a.b"]) == ("r", 1, b"q", 7, "e")


def test_a_document_given_twice_goes(spark):
    text = " ".join(str(i) for i in range(200))
    got = suffix_dedup.remove_repeats(spark.createDataFrame([(1, text), (1, text), (None, text[:90]), (None, text[:90])], "doc_id long, text string"), 128).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in got) == [(90, 0), (90, 0), (len(text), len(text)), (len(text), len(text))]
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_blocks_of_suffixes_with_long_ties(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 100)
    rng = np.random.default_rng(5)
    piece = rng.integers(97, 99, 700, dtype=np.uint8)
    data = np.concatenate([piece, piece[100:600], rng.integers(97, 99, 300, dtype=np.uint8), np.full(500, 97, np.uint8), piece[:500]])
    at = np.arange(len(data) - 200)
    bucket = (at % 3).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    at, bucket = at[order], bucket[order]
    got = suffix_dedup.repeated_suffixes(data, at, bucket, 200)
    seen = Counter((b, data[a : a + 200].tobytes()) for a, b in zip(at, bucket, strict=True))
    assert got.tolist() == [seen[b, data[a : a + 200].tobytes()] > 1 for a, b in zip(at, bucket, strict=True)]


def test_suffixes_alike_beyond_the_depth_of_ranks_are_all_found():
    rng = np.random.default_rng(11)
    source = rng.integers(97, 105, 800, dtype=np.uint8)
    parts = [np.concatenate([source[a : a + k], rng.integers(97, 105, 60, dtype=np.uint8)]) for a, k in zip(rng.integers(0, 40, 300), rng.integers(380, 760, 300), strict=True)]
    data = np.concatenate(parts)
    first = np.cumsum([0, *(len(p) for p in parts)])[:-1]
    at = np.concatenate([np.arange(a, a + len(p) - 400 + 1) for a, p in zip(first, parts, strict=True) if len(p) >= 400])
    got = suffix_dedup.repeated_suffixes(data, at, np.zeros(len(at), np.int64), 400)
    seen = Counter(data[a : a + 400].tobytes() for a in at)
    assert got.tolist() == [seen[data[a : a + 400].tobytes()] > 1 for a in at]


def test_cover_has_every_difference():
    for period in (7, 32, 64, 128):
        cover = suffix_dedup.difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
        assert len(cover) < 2.5 * period**0.5 + 2


def _trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {c: [*own.get(c - c % 100, [])[: zlib.crc32(str(c).encode()) % 6], *v[zlib.crc32(str(c).encode()) % 6 :]] for c, v in own.items()}
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = Counter(p[:-1] for p in members if p)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], sum(q not in kids for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def _conversations(seed):
    rng = random.Random(seed)
    rows = [(None, 0, "user", "nobody"), (300, None, None, "first"), (300, None, "user", None), (300, 0, "user", "é"), (300, 0, "user", "é"), (300, 1, "a", "b")]
    rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "yes", "", None, "ñandú"])) for c in range(0, 60) for t in range(rng.randint(1, 5))]
    rows += [(c, t, "user", f"turn {t}") for c in (301, 305, 306, 402, 403, 404) for t in range(7)]
    return rows + [(500, t, "user", f"long {t % 9}") for t in range(150)] + [(501, t, "user", f"long {t % 9}") for t in range(90)]


def _nodes(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(((*r,) for r in df.select(*columns).collect()), key=repr)


def test_trie_is_brute_force(spark):
    conv = F.col("conv_id")
    head = F.crc32(conv.cast("string")) % 6
    schema = "conv_id long, turn long, role string, text string, depth string, h1 int, node string, `a.b` int"
    rows = _conversations(3)
    df = spark.createDataFrame([(*r, "d", 1, "n", 2) for r in rows], schema).repartition(5)
    assert _nodes(conversation_trie.trie(df, conv - conv % 100, head)) == sorted(_trie(rows), key=repr)
    assert conversation_trie.trie(spark.createDataFrame([], schema), conv - conv % 100, head).count() == 0


def test_empty_parts_are_no_arcs():
    assert list(conversation_trie._shorten(iter([]))) == []


def test_list_over_several_parts(spark):
    order = list(range(400))
    random.Random(2).shuffle(order)
    arcs = [(a, b, 1, a, a // 40) for a, b in zip(order, [*order[1:], None], strict=True)]
    got = {r.arc: (r.leaves, r.saved) for r in conversation_trie.list_rank(spark.createDataFrame(arcs, "arc long, next long, leaves long, saved long, part long")).collect()}
    assert got == {a: (400 - i, sum(order[i:])) for i, a in enumerate(order)}


def _search(docs, items, top):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    bags = [(d, terms(t)) for d, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = Counter(x for _, b in bags for x in set(b))
    out = []
    for item, text in items:
        scored = []
        for d, b in bags:
            tf = Counter(b)
            if b:
                m = 75 + 25 * len(b) * n_docs // n_terms
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1000000000 * tf[x] // (1000 * tf[x] + 12 * m)) for x in terms(text) if tf[x])
                scored.append((-score, d is not None, d or 0))
        out += [(item, k + 1, d if known else None, -s) for k, (s, known, d) in enumerate(sorted(s for s in scored if s[0] < 0)[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("pairs", [1 << 17, 6])
def test_search_is_brute_force(spark, monkeypatch, pairs):
    monkeypatch.setattr(lexical_search, "BLOCK_PAIRS", pairs)
    rng = random.Random(4)
    words = ["the", "Cell", "cell-wall", "Ñandú", "x1", "no_one", "a.b", "rare", "tab\tnul\x00z"]
    docs = [(i, " ".join(rng.choice(words[: 2 + i % 8]) for _ in range(rng.randint(1, 9)))) for i in range(150)]
    docs += [(200 + i, "the cell the cell") for i in range(30)] + [(None, "the cell the cell"), (None, None), (7, ""), (8, " - "), (200, "the cell the cell"), (900, "rare " * 3000)]
    items = [(1, "the cell"), (2, "RARE ñandú Ñandú x1 x1"), (3, ""), (4, None), (5, "nowhere"), (None, "no one the a b"), (6, "cell wall tab nul z")]
    got = lexical_search.search(spark.createDataFrame([(*d, 1, "b", 2) for d in docs], "doc_id long, text string, n int, bag string, `a.b` int").repartition(3), spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, term int"), top=9)
    assert sorted(((*r,) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == _search(docs, items, 9)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lexical_search.search(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert lexical_search.search(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
