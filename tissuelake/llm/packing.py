"""Best-fit packing of token sequences with large-item matching.

Lengths are integers up to the capacity, so all there is to decide is how many pieces of each length go where. One Spark pass
tokenises whole texts into pieces; a count by length (at most `capacity` rows) goes to the driver, which plans on counts: pieces of over a third of
the capacity are matched greedily, largest with the largest that fits, two to a bin at most; smaller ones then go, largest first, to the
tightest gap that takes them. The plan says for each length which ranks go to which bins; its size depends on the capacity alone. Ranks within a
length are dealt by a salt, so that a length which a third of all pieces share is ranked in parallel.
"""

from __future__ import annotations

import json
import zlib
from codecs import charmap_decode
from collections.abc import Iterator
from pathlib import PurePath

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialise, text_or_empty

CAPACITY = 2048
#: Entries that a worker's table of encoded text chunks, and its table of pre-tokens, may hold before it is emptied.
CACHE_ENTRIES = 400_000


class ChunkEncoder:
    """Token ids of whole texts by the model of a byte-level BPE tokenizer, remembering the ids of recurring chunks and of their pre-tokens.

    A space after a character that is no white space always starts a pre-token, so texts are cut there and chunks encoded apart.
    A chunk that ends in white space would hide such a run of spaces; texts with one, or with one of the tokenizer's own tokens as a string,
    are encoded whole by the tokenizer itself, as are all texts if it splits them in another way than the one assumed here.
    """

    #: The public pattern by which byte-level BPE splits texts, and its order of bytes that stand for themselves.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    PRINTABLE = (*range(33, 127), *range(161, 173), *range(174, 256))

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        text = {b: chr(b) for b in self.PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in self.PRINTABLE)}
        self.bytes_to_text = "".join(text[b] for b in range(256))
        self.pieces = regex.compile(self.SPLIT)
        own = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.own = regex.compile("|".join(map(regex.escape, own))) if own else None
        self.known: dict[str, bytes | None] = {}
        self.parts: dict[str, bytes] = {}
        parts = json.loads(self.whole.to_str())
        pre = parts["pre_tokenizer"] or {}
        self.plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not parts["normalizer"]

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """The ids of one pre-token."""
        known = charmap_decode(piece.encode(), "strict", self.bytes_to_text)[0]
        self.parts[piece] = out = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(known)])
        return out

    def _pieces(self, text: str) -> tuple[list[str], list[bytes]]:
        """The pre-tokens of a text with their ids."""
        found, parts = self.pieces.findall(text), self.parts
        if len(parts) >= CACHE_ENTRIES:
            parts.clear()
        return found, [parts[x] if x in parts else self._piece(x) for x in found]

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.plain or self.own is not None and self.own.search(text):
            return self._whole(text)
        first, *rest = text.split(" ")
        try:
            ids = list(map(self.known.__getitem__, rest))
        except KeyError:
            self._learn(rest)
            ids = list(map(self.known.__getitem__, rest))
        if None in ids:
            return self._whole(text)
        return b"".join(self._pieces(first)[1]) + b"".join(ids)

    def _learn(self, chunks: list[str]) -> None:
        """Remember the ids of chunks with the space before them; None for those that cannot stand alone."""
        if len(self.known) >= CACHE_ENTRIES:
            self.known.clear()
        new = set(chunks).difference(self.known)
        self.known.update(dict.fromkeys(new))
        alone = [x for x in new if x and not x[-1].isspace()]
        if not alone:
            return
        # all of them are split at once: a chunk begins where a pre-token begins with a space, as it has no other
        found, ids = self._pieces(" " + " ".join(alone))
        at = [i for i, x in enumerate(found) if x[0] == " "]
        for chunk, i, j in zip(alone, at, [*at[1:], len(found)], strict=True):
            self.known[chunk] = ids[i] if j == i + 1 else b"".join(ids[i:j])


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder a worker process and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Cut each document (its ids, then id 0) into pieces of `capacity` from its end; only the first piece is shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(str(PurePath(tokenizer))).encode
        for batch in batches:
            rows = []
            for i, text in enumerate(batch["text"]):
                ids = encode(text.as_py()) + b"\0\0\0\0"
                n = len(ids) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((i, p, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
            table = np.array(rows, dtype=np.int64).reshape(-1, 5)
            keys = batch.select(["doc_id", "print"]).take(pa.array(table[:, 0]))
            yield pa.RecordBatch.from_arrays([keys["doc_id"], keys["print"], pa.array(table[:, 1].astype(np.int32)), *(pa.array(table[:, c]) for c in (2, 3, 4))], names=["doc_id", "print", "piece", "start", "length", "ids_crc32"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("print"), text_or_empty().alias("text"))
    return read.mapInArrow(run, "doc_id long, print long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, pieces a bin, first bin, offset): from that rank on, pieces of that length fill bins in turn, from that offset. Sorted."""
    left = {s: c for s, c in counts.items() if c}
    used = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    bins = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs of bins (first, number)
    open_gaps = 0  # bit g: some bin has gap g

    def put(size: int, each: int, first: int, number: int, offset: int) -> None:
        """number pieces of a size into bins from first on, `each` to a bin."""
        rows.append((size, used[size], each, first, offset))
        used[size] += number
        left[size] -= number

    def leave(gap: int, first: int, number: int) -> None:
        nonlocal open_gaps
        if gap and number:
            gaps.setdefault(gap, []).append((first, number))
            open_gaps |= 1 << gap

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for size in large:
        while left[size]:
            partner = next((t for t in large if t <= min(size, capacity - size) and left[t] - (t == size) > 0), None)
            n = left[size] if partner is None else left[size] // 2 if partner == size else min(left[size], left[partner])
            put(size, 1, bins, n, 0)
            if partner is not None:
                put(partner, 1, bins, n, size)
            leave(capacity - size - (partner or 0), bins, n)
            bins += n
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            fits = open_gaps >> size
            if not fits:
                each = capacity // size
                leave(capacity, bins, n := -(-left[size] // each))
                bins += n
                continue
            gap = size + (fits & -fits).bit_length() - 1
            first, number = gaps[gap].pop()
            if not gaps[gap]:
                open_gaps &= ~(1 << gap)
            each = gap // size
            full = min(number, left[size] // each)
            if not full:
                full, each = 1, left[size]
            put(size, each, first, full * each, capacity - gap)
            leave(gap - full // full * each * size, first, full)
            leave(gap, first + full, number - full)
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pack whole documents into few sequences of at most `capacity` tokens.

    docs needs doc_id and text; other columns are ignored. Returns a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset;
    sequences have no gap from 0 on. Null and empty texts are one end token. Repeated rows are packed each for itself; which of them comes first
    is open, as they are equal. Strings that are tokens of the tokenizer's own in a text are these tokens, as it has them. A null doc_id is passed through. An empty table gives an empty one.
    """
    cut = materialise(pieces(docs, tokenizer or tokenizer_path(), capacity))
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().toLocalIterator()}  # capacity rows at most
    rows = plan(counts, capacity)
    salts = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "print", "piece"), F.lit(salts)))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    order = W.partitionBy("length", "salt").orderBy("doc_id", "print", "piece")
    ranked = salted.withColumn("rank", F.row_number().over(order) - 1).join(offsets, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.int64(1 << 44)
        keys = rows[:, 0] * width + rows[:, 1]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            size, first, each, first_bin, offset = rows[np.searchsorted(keys, length * width + rank, side="right") - 1].T
            sequence, slot = first_bin + (rank - first) // each, offset + (rank - first) % each * size
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(slot)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
