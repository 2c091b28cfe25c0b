"""Ranked lexical search by bag deduplication.

A document matters to a query set only through its bag: how often it holds each term of the items, and its length factor m. So texts are
reduced to bags over the items' vocabulary, documents with an identical (bag, m) make one class, each class is scored once against all items,
and only then are the classes that can reach a list expanded into their documents, by ascending doc_id.

Terms are matches of TERM_PATTERN, A-Z lower-cased. With N documents that have a term, L terms in all of them, n terms in the document, df
documents with the term and tf its occurrences: w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 75 + (25 n N) div L, and a document's score is
the sum of w ((10^9 tf) div (1000 tf + 12 m)) over the item's terms with repeats, in 64-bit integers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Words, byte_slices, materialise

TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes as they are compared: terms in lower case, all else a blank.
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[128:] = np.arange(128, 256)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _FOLD[_c] = _c
for _c in _UPPER.encode():
    _FOLD[_c] = _c + 32
#: Pairs of item and term in one block of the query set, on average; a block's vocabulary goes to every task.
BLOCK_PAIRS = 1 << 17
_SLICE = 4 << 20
_ADDS = 1 << 21


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, q): how often each item holds each of its terms. Rows with one item_id are one item, repeated rows count once."""
    folded = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    terms = items.select("item_id", "text").distinct().select("item_id", F.explode(F.regexp_extract_all(folded, F.lit(TERM_PATTERN), F.lit(0))).alias("term"))
    return terms.groupBy("item_id", "term").agg(F.count("*").alias("q"))


class Vocabulary:
    """The terms of one block of items, known by the hash and the length of their bytes, and the items that hold each."""

    def __init__(self, rows: list):
        self.terms = sorted({r["term"] for r in rows})
        [(_, data, offsets)] = list(byte_slices(pa.array(self.terms, pa.string()), 1 << 40))
        hashed = np.concatenate([Words(data[a:b], np.array([0, b - a])).hash for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        order = np.argsort(hashed)
        self.hash, self.length = hashed[order], np.diff(offsets)[order]
        if (self.hash[1:] == self.hash[:-1]).any():
            raise ValueError("two terms of the items have one hash")
        place = {self.terms[t]: i for i, t in enumerate(order)}
        self.items = sorted({r["item_id"] for r in rows}, key=lambda i: (i is not None, i))
        number = {item: k for k, item in enumerate(self.items)}
        pairs = sorted((place[r["term"]], number[r["item_id"]], r["q"]) for r in rows)
        self.term, self.item, self.q = (np.array(c, dtype=np.int64) for c in zip(*pairs, strict=True))

    def bags(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, n and the bag: (term, tf) as pairs of 32-bit integers, by term."""
        for batch in batches:
            for at, data, offsets in byte_slices(batch["text"], _SLICE):
                words = Words(_FOLD[data], offsets)
                n = np.diff(words.bounds)
                where = np.minimum(np.searchsorted(self.hash, words.hash), len(self.hash) - 1)
                known = (self.hash[where] == words.hash) & (self.length[where] == words.ends - words.starts)
                code = np.repeat(np.arange(len(n)), n)[known] * len(self.hash) + where[known]
                code, tf = np.unique(code, return_counts=True)
                doc, term = np.divmod(code, len(self.hash))
                bag = np.column_stack([term, tf]).astype("<u4").tobytes()
                ends = np.searchsorted(doc, np.arange(len(n) + 1)) * 8
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(bag)])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, len(n)), pa.array(n), column.cast(pa.binary())], ["doc_id", "n", "bag"])

    def holders(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents of the task that hold each term."""
        counts = np.zeros(len(self.hash), dtype=np.int64)
        for batch in batches:
            for bag in batch["bag"]:
                counts[np.frombuffer(bag.as_buffer(), "<u4")[::2]] += 1
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["term", "df"])

    def best(self, weight: np.ndarray, top: int):
        """Classes of a task that can reach a list: for each item the `top` ones by score and first document."""
        first = np.searchsorted(self.term, np.arange(len(self.hash) + 1))
        worth = weight[self.term] * self.q
        n_items = len(self.items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lists: list[list] = [[] for _ in range(n_items)]
            floor = np.zeros(n_items, dtype=np.int64)
            serial = 0
            for batch in batches:
                bags = [np.frombuffer(b.as_buffer(), "<u4").astype(np.int64) for b in batch["bag"]]
                cost = np.array([(first[b[::2] + 1] - first[b[::2]]).sum() for b in bags])
                m = batch["m"].to_numpy()
                at = 0
                while at < len(bags):
                    end = max(at + 1, int(np.searchsorted(np.cumsum(cost[at:]), max(_ADDS, n_items), side="right")) + at)
                    end = min(end, at + max(1, (_ADDS << 2) // n_items))
                    score = np.zeros((end - at) * n_items, dtype=np.int64)
                    flat = np.concatenate(bags[at:end])
                    term, tf = flat[::2], flat[1::2]
                    row = np.repeat(np.arange(end - at), [len(b) // 2 for b in bags[at:end]])
                    part = (1_000_000_000 * tf) // (1000 * tf + 12 * m[at:end][row])
                    each = first[term + 1] - first[term]
                    posting = np.arange(each.sum()) + np.repeat(first[term] - (np.cumsum(each) - each), each)
                    np.add.at(score, np.repeat(row, each) * n_items + self.item[posting], worth[posting] * np.repeat(part, each))
                    score = score.reshape(end - at, n_items)
                    # a class equal to an item's last one may still have a smaller first document
                    for r, k in zip(*np.nonzero((score >= floor) & (score > 0)), strict=True):
                        docs = batch["docs"][at + int(r)].as_py()
                        serial += 1
                        least = docs[0]["doc_id"]
                        entry = (int(score[r, k]), least is None, -(least or 0), -serial, docs)
                        if len(lists[k]) < top:
                            heapq.heappush(lists[k], entry)
                        else:
                            heapq.heappushpop(lists[k], entry)
                        if len(lists[k]) == top:
                            floor[k] = lists[k][0][0]
                    at = end
            rows = [(k, e[0], [d["doc_id"] for d in e[-1]]) for k, entries in enumerate(lists) for e in entries]
            columns = [pa.array([self.items[k] for k, _, _ in rows], pa.int64()), pa.array([s for _, s, _ in rows], pa.int64()), pa.array([d for _, _, d in rows], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "score", "docs"])

        return run


def _block(docs: DataFrame, vocabulary: Vocabulary, top: int) -> DataFrame:
    bags = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(vocabulary.bags, "doc_id long, n long, bag binary"))
    total = bags.agg(F.count_if(F.col("n") > 0).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    found = bags.where(F.length("bag") > 0)
    held = found.select("bag").mapInArrow(vocabulary.holders, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    weight = np.zeros(len(vocabulary.hash), dtype=np.int64)
    for r in held:
        weight[r["term"]] = math.floor(1000 * math.log((2 * total["N"] + 2) / (2 * r["df"] + 1)))
    m = F.expr(f"75L + (25L * n * {total['N']}L) div {max(total['L'], 1)}L")
    keyed = found.select("doc_id", "bag", m.alias("m")).withColumn("print", F.xxhash64("bag", "m"))
    # classes meet by hash and are told apart by the bags themselves; no task keeps more than `top` documents of a class
    same = ["print", "bag", "m"]
    place = F.row_number().over(W.partitionBy(*same).orderBy("doc_id"))
    classes = keyed.withColumn("place", place).where(F.col("place") <= top).groupBy(*same).agg(F.sort_array(F.collect_list(F.struct("doc_id"))).alias("docs"))
    scored = classes.select("bag", "m", "docs").mapInArrow(vocabulary.best(weight, top), "item_id long, score long, docs array<long>")
    return scored.select("item_id", "score", F.explode("docs").alias("doc_id"))


def search(docs: DataFrame, items: DataFrame, top: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of the highest score above 0 for each item, equal scores by ascending doc_id.

    docs has (doc_id, text), items has (item_id, text), both with any other columns. Null and empty texts have no term: such documents are in
    no list and not in N, such items have no list. Documents without doc_id come first among equals; rows given twice are two documents. Ranks
    are unique. Empty tables give an empty one. The query set is taken in blocks of about BLOCK_PAIRS terms (one item at least), each against
    all documents; one block's vocabulary is what is collected and sent to tasks.
    """
    terms = materialise(item_terms(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))))
    blocks = -(-terms.count() // BLOCK_PAIRS)
    found = None
    for b in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        if rows:
            part = _block(docs, Vocabulary(rows), top)
            found = part if found is None else found.union(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    place = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
