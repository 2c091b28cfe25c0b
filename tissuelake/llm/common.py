"""Helpers shared by the text operators: scratch tables, whole-text word hashing, native word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
SPACE_RE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

_WS = np.zeros(256, dtype=bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(0x5EED)
#: A random 64-bit value for each byte (none for white space) and an odd base: words hash as polynomials mod 2**64.
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[_WS] = 0
_BASE = 0xD1342543DE82EF95
_SLICE_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: what spark.checkpoint.dir names. Where that is unset, local mode (tests) gets a folder of its own, and a cluster an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir().rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text, JVM-side."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RE))


def bind(value: Column, body) -> Column:
    """body(value) with value computed once per row (a lambda variable), however often body mentions it."""
    return F.transform(F.array(value), body)[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, dtype=np.uint64)


def powers_of_base(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers), 4096), _BASE, dtype=np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def byte_slices(texts: pa.Array, size: int = _SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a column of texts into runs of whole documents of about `size` bytes: (first row, bytes, offsets of len rows + 1). Null counts as empty."""
    col = texts.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(col):
        end = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        end = min(max(end, at + 1), len(col))
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


class Words:
    """Words of a slice of documents: hash, byte range, and the first word of each document (bounds has rows + 1 entries)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data, self.offsets = data, offsets
        inside = ~_WS[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        starts_of_docs = offsets[:-1][offsets[:-1] < len(data)]
        first[starts_of_docs] = inside[starts_of_docs]
        self.starts = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        if len(self.starts):
            length = self.ends - self.starts
            values = _BYTE[_LOWER[data]] if lower else _BYTE[data]
            gaps = np.diff(np.append(self.starts, len(data)))
            place = np.arange(self.starts[0], len(data)) - np.repeat(self.starts, gaps)
            # white space after a word has value 0, so its place does not matter
            np.minimum(place, int(length.max()), out=place)
            values = values[self.starts[0] :] * powers_of_base(int(length.max()) + 1)[place]
            sums = np.add.reduceat(values, self.starts - self.starts[0])
            self.hash = mix64(sums + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        else:
            self.hash = np.zeros(0, dtype=np.uint64)

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """The word range of each document."""
        return zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True)


def run_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values over [bounds[i], bounds[i + 1])."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def word_count(text: Column) -> Column:
    """Number of words of a text as a long, JVM-side; 0 for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE_RE))).cast("long")
