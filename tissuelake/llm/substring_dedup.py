"""Removal of repeated passages, found by recompression.

Recompression rewrites each document's words in rounds: runs of one symbol become one symbol, then a hash splits all symbols into left and
right ones and every left symbol followed by a right one becomes a new symbol. A name is a 64-bit hash of the names it was made from,
so equal runs and pairs have equal names in all tasks. Spark rounds then find out which names are shared, the longest symbols first:

1. Whole texts. Every later copy of a text is settled.
2. Long symbols. Neighbouring symbols of about 30 words go to Spark as named pairs, with a check sum of their words beside the name. A
   pair that stands earlier too (same name, length and check sum) is a repeat from end to end: all windows inside it are settled, without
   any window being looked at. Only what is not settled goes on, so that near copies of long texts cost a few rows each.
3. Interior symbols. For each short symbol we also keep the range of words that decided it: wherever those words stand, the symbol stands.
   Equal windows of `window` words therefore have the same interior symbols, those whose deciding range lies within the window, and
   choose the same one of them (the longest, then the smallest hash). Spark keeps the names that stand in two texts, or twice in one.
4. Windows whose chosen interior symbol is shared (or that have none) are all that is left: each task hashes those (96 bits), drops
   repeats that it sees itself and sends the rest; the first place of each window stays, every other start is a repeat.

In every round a task sends a name once for each slice of a few megabytes, so a name that a third of all texts share meets
itself once a slice, not once a text. At last each document is cut by what was settled and the starts found for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from .common import Words, byte_slices, materialise, mix64

#: Rounds that make interior symbols of LONGEST words at most, and further rounds that make long ones.
ROUNDS, LONGEST = 4, 8
LONG_ROUNDS, LONG_WORDS = 9, 64
_WINDOWS = "h1 long, h2 int, id long, print int, place int, places array<int>"
_WINDOW_NAMES = ["h1", "h2", "id", "print", "place", "places"]
_PAIRS = "name long, sum int, id long, print int, start int, stop int, ranges array<int>"
_PAIR_NAMES = ["name", "sum", "id", "print", "start", "stop", "ranges"]
#: End of a range that takes in the whole document.
_ALL = 2**31 - 1
#: Bytes of text whose windows a task compares by itself before it sends them.
_WINDOW_BYTES = 8 << 20
_NO_ID = -(2**63)
_MUL, _MUL2 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def _of_pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix64(first * _MUL + second * _MUL2 + np.uint64(1))


def _of_run(name: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.where(count > 1, mix64(name * _MUL + count.astype(np.uint64)), name)


def _right(name: np.ndarray, r: int) -> np.ndarray:
    """Whether a symbol is a right one in round r."""
    return (mix64(name ^ np.uint64(0x1F83D9ABFB41BD6B + r)) & np.uint64(1)).astype(bool)


def parse(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Interior symbols of a slice of documents: name, length in words, and the range [lo, hi) of words that decides each; lo and hi never fall."""
    n = len(hashes)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(fresh)
    counts = np.diff(np.append(starts, n))
    each = np.repeat(counts, counts)
    # a run is decided by the words on both sides of it; a long one stays as single words
    lo, hi = np.repeat(starts - 1, counts), np.repeat(starts + counts + 1, counts)
    begins = fresh | (each > LONGEST)
    length = np.where(each > LONGEST, 1, each)[begins]
    name, lo, hi, doc = hashes[begins], lo[begins], hi[begins], doc[begins]
    name = _of_run(name, length)
    for r in range(ROUNDS):
        right = _right(name, r)
        same = doc[1:] == doc[:-1]
        pair = ~right[:-1] & right[1:] & same & (length[:-1] + length[1:] <= LONGEST)
        first = np.append(pair, False)
        second = np.insert(pair, 0, False)
        next_hi = np.append(np.where(same, hi[1:], bounds[1:][doc[:-1]] + 1), n + 1)
        prev_lo = np.insert(np.where(same, lo[:-1], bounds[:-1][doc[1:]] - 1), 0, -1)
        new_hi = np.where(first | ~right, np.maximum(hi, next_hi), hi)
        new_lo = np.where(right & ~second, np.minimum(lo, prev_lo), lo)
        at = np.flatnonzero(pair)
        name, length = name.copy(), length.copy()
        name[at] = _of_pair(name[at], name[at + 1])
        length[at] += length[at + 1]
        stay = ~second
        name, length, lo, hi, doc = name[stay], length[stay], new_lo[stay], new_hi[stay], doc[stay]
    return name, length, lo, hi


def long_symbols(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name, length in words and document of the symbols that all rounds leave; together they are the documents, in order."""
    name, doc = hashes, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    length = np.ones(len(name), dtype=np.int64)
    for r in range(ROUNDS + LONG_ROUNDS):
        most = LONGEST if r < ROUNDS else LONG_WORDS
        if not len(name):
            break
        fresh = np.ones(len(name), dtype=bool)
        fresh[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1]) | (length[1:] != length[:-1])
        lead = np.flatnonzero(fresh)
        counts = np.diff(np.append(lead, len(name)))
        fresh |= np.repeat(counts, counts) * length > most  # runs too long for one symbol stay as they are
        lead = np.flatnonzero(fresh)
        counts = np.diff(np.append(lead, len(name)))
        name, length, doc = _of_run(name[lead], counts), length[lead] * counts, doc[lead]
        right = _right(name, r)
        pair = ~right[:-1] & right[1:] & (doc[1:] == doc[:-1]) & (length[:-1] + length[1:] <= most)
        at = np.flatnonzero(pair)
        name[at] = _of_pair(name[at], name[at + 1])
        length[at] += length[at + 1]
        stay = ~np.insert(pair, 0, False)
        name, length, doc = name[stay], length[stay], doc[stay]
    return name, length, doc


def window_starts(bounds: np.ndarray, window: int) -> np.ndarray:
    """The first word of each window of a slice of documents."""
    n = np.maximum(np.diff(bounds) - window + 1, 0)
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(bounds[:-1] - (ends - n), n)


def anchors(hashes: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, the index of each window's anchor (-1: none), and the names of all symbols."""
    starts = window_starts(bounds, window)
    if not len(starts):
        return starts, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    name, length, lo, hi = parse(hashes, bounds)
    n = len(hashes) + window + 2
    a, b = np.cumsum(np.bincount(lo + 2, minlength=n))[starts + 1], np.cumsum(np.bincount(hi, minlength=n))[starts + window]
    rank = ((np.uint64(63) - length.astype(np.uint64)) << np.uint64(58)) | (mix64(name) >> np.uint64(6))
    where = np.where(a < b, a, -1)
    open_ = np.flatnonzero(a + 1 < b)
    at, stop, best = a[open_], b[open_], rank[a[open_]]
    while len(open_):
        at = at + 1
        r = rank[at]
        better = r < best
        best = np.where(better, r, best)
        where[open_[better]] = at[better]
        more = at + 1 < stop
        open_, at, stop, best = open_[more], at[more], stop[more], best[more]
    return starts, where, name


def window_hashes(hashes: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each window: polynomials of the words' hashes."""
    one = two = np.zeros(len(starts), dtype=np.uint64)
    for j in range(window):
        w = hashes[starts + j]
        one, two = one * _MUL + w, two * _MUL2 + (w ^ (w >> np.uint64(32)))
    return mix64(one), mix64(two)


def _doc_of(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.searchsorted(bounds, starts, side="right") - 1


class _Lists:
    """An array<int> or array<long> column as numpy values and the ends of each row's part; null counts as empty."""

    def __init__(self, column: pa.Array):
        self.flat = column.flatten().to_numpy()
        self.ends = np.cumsum([0, *(0 if x is None else x for x in column.value_lengths().to_pylist())])

    def __getitem__(self, i: int) -> np.ndarray:
        return self.flat[self.ends[i] : self.ends[i + 1]]

    def rows(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Values of rows lo to hi, and for each the row it is from, counted from lo."""
        return self.flat[self.ends[lo] : self.ends[hi]], np.repeat(np.arange(hi - lo), np.diff(self.ends[lo : hi + 1]))


def _lists(values: np.ndarray, lead: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(lead, len(values)), pa.int32()), pa.array(values, pa.int32()))


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before it."""
    fresh = np.ones(len(columns[0]), dtype=bool)
    if len(fresh):
        fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return fresh


def _settled(ranges: _Lists, at: int, bounds: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """For each window start of a slice (row `at` on), whether the window lies within a settled range of its document."""
    values, row = ranges.rows(at, at + len(bounds) - 1)
    if not len(values):
        return np.zeros(len(starts), dtype=bool)
    row, size = row[::2], np.diff(bounds)
    first, last = values[::2].astype(np.int64), np.minimum(values[1::2].astype(np.int64), size[row]) - window
    some = last >= first
    row, first, last = row[some], first[some], last[some]
    depth = np.zeros(bounds[-1] + 1, dtype=np.int32)
    np.add.at(depth, bounds[row] + first, 1)
    np.add.at(depth, bounds[row] + last + 1, -1)
    return np.cumsum(depth)[starts] > 0


def _merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges sorted by document and start, those that overlap by window - 1 words or more made one: no window is then lost or won."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    width = int(stop.max(initial=0)) + 1
    reach = np.maximum.accumulate(stop + doc * width) - doc * width if len(doc) else stop
    fresh = np.ones(len(doc), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1] - (window - 1))
    lead = np.flatnonzero(fresh)
    return doc[lead], start[lead], np.maximum.reduceat(stop, lead) if len(lead) else stop


def _pair_rows(window: int):
    """Neighbouring long symbols of a slice as named pairs: the first place of each name goes to Spark; the others are settled here, as ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints = batch["id"].to_numpy(), batch["print"].to_numpy()
            for at, data, offsets in byte_slices(batch["text"], _WINDOW_BYTES):
                words = Words(data, offsets)
                if not len(words.hash):
                    continue
                name, length, doc = long_symbols(words.hash, words.bounds)
                ends = np.cumsum(length)
                place = np.arange(len(words.hash)) - np.repeat(ends - length, length)
                sums = np.add.reduceat(mix64(words.hash + place.astype(np.uint64) * _MUL2), ends - length)
                i = np.flatnonzero((doc[1:] == doc[:-1]) & (length[1:] + length[:-1] >= window))
                key, check = _of_pair(name[i], name[i + 1]), mix64(sums[i] + mix64(sums[i + 1]) * _MUL + length[i].astype(np.uint64))
                doc, start = doc[i], ends[i] - length[i] - words.bounds[doc[i]]
                stop = start + length[i] + length[i + 1]
                check = (check >> np.uint64(32)).astype(np.uint32).view(np.int32)
                row = doc + at
                order = np.lexsort((start, prints[row], ids[row], check, key))
                key, check, row, start, stop = key[order], check[order], row[order], start[order], stop[order]
                new = _changes(key, check)
                # the same document given twice is one document
                lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
                first = new | ((ids[row] == ids[row[lead]]) & (prints[row] == prints[row[lead]]) & (start == start[lead]))
                columns = [pa.array(x[first]) for x in (key.view(np.int64), check, ids[row], prints[row], start.astype(np.int32), stop.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(int(first.sum()), pa.list_(pa.int32()))], _PAIR_NAMES)
                row, start, stop = _merged(row[~first], start[~first], stop[~first], window)
                lead = np.flatnonzero(_changes(row))
                ranges = _lists(np.column_stack([start, stop]).ravel(), 2 * lead)
                row = row[lead]
                none = [pa.nulls(len(row), pa.int32())] * 2
                spread = mix64(ids[row].view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(spread), none[0], pa.array(ids[row]), pa.array(prints[row]), *none, ranges], _PAIR_NAMES)

    return run


def _anchor_rows(window: int):
    """A row for each name of a slice: the documents that have it, and whether it stands twice in one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints, ranges = batch["id"].to_numpy(), batch["print"].to_numpy(), _Lists(batch["ranges"])
            for at, data, offsets in byte_slices(batch["text"]):
                words = Words(data, offsets)
                starts, anchor, name = anchors(words.hash, words.bounds, window)
                open_ = (anchor >= 0) & ~_settled(ranges, at, words.bounds, starts, window)
                doc, anchor = _doc_of(starts[open_], words.bounds), anchor[open_]
                # each symbol once, then each name once a document, with whether it stands there twice
                once = np.unique(anchor, return_index=True)[1]
                doc, names = doc[once], name[anchor[once]]
                order = np.lexsort((doc, names))
                doc, names = doc[order], names[order]
                of_doc = np.flatnonzero(_changes(names, doc))
                twice = np.diff(np.append(of_doc, len(doc))) > 1
                doc, names = doc[of_doc] + at, names[of_doc]
                lead = np.flatnonzero(_changes(names))
                twice = np.logical_or.reduceat(twice, lead) if len(lead) else twice
                ends = pa.array(np.append(lead, len(doc)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x[doc])) for x in (ids, prints)]
                yield pa.RecordBatch.from_arrays([pa.array(names[lead].view(np.int64)), pa.array(twice), *lists], ["name", "twice", "ids", "prints"])

    return run


def _window_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints = batch["id"].to_numpy(), batch["print"].to_numpy()
            known, ranges = _Lists(batch["names"]), _Lists(batch["ranges"])
            for at, data, offsets in byte_slices(batch["text"], _WINDOW_BYTES):
                words = Words(data, offsets)
                starts, anchor, name = anchors(words.hash, words.bounds, window)
                doc = _doc_of(starts, words.bounds)
                hit = anchor < 0
                edges = np.searchsorted(doc, np.arange(len(offsets)))
                for d in range(len(offsets) - 1):
                    names = known[at + d]
                    if len(names) and edges[d] < edges[d + 1]:
                        part = slice(edges[d], edges[d + 1])
                        hit[part] |= np.isin(name.view(np.int64)[anchor[part]], names)
                hit &= ~_settled(ranges, at, words.bounds, starts, window)
                starts, doc = starts[hit], doc[hit]
                one, two = window_hashes(words.hash, starts, window)
                place = starts - words.bounds[doc]
                doc = doc + at
                two &= np.uint64(0xFFFFFFFF00000000)
                order = np.lexsort((place, prints[doc], ids[doc], two, one))
                one, two, doc, place = one[order], two[order], doc[order], place[order]
                new = _changes(one, two)
                # the same document given twice is one document
                lead = np.maximum.accumulate(np.where(new, np.arange(len(one)), 0))
                first = new | ((ids[doc] == ids[doc[lead]]) & (prints[doc] == prints[doc[lead]]) & (place == place[lead]))
                short = (two >> np.uint64(32)).astype(np.uint32).view(np.int32)
                columns = [pa.array(x[first]) for x in (one.view(np.int64), short, ids[doc], prints[doc], place.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(int(first.sum()), pa.list_(pa.int32()))], _WINDOW_NAMES)
                # repeats seen here need no comparison: a document's places travel in one row
                doc, place = doc[~first], place[~first]
                order = np.argsort(doc, kind="stable")
                doc, place = doc[order], place[order]
                lead = np.flatnonzero(_changes(doc))
                lists = _lists(place, lead)
                doc = doc[lead]
                spread = mix64(ids[doc].view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(spread), pa.nulls(len(doc), pa.int32()), pa.array(ids[doc]), pa.array(prints[doc]), pa.nulls(len(doc), pa.int32()), lists], _WINDOW_NAMES)

    return run


def _cut(window: int, separators: bool, keep: list[str]):
    """One row for each document, cut; with separators, what stands between kept words stays as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            repeats, ranges = _Lists(batch["repeats"]), _Lists(batch["ranges"])
            for at, data, offsets in byte_slices(batch["text"]):
                words = Words(data, offsets)
                raw, texts, removed, totals = data.tobytes(), [], [], []
                starts, stops = words.starts.tolist(), words.ends.tolist()
                for d, (lo, hi) in enumerate(words):
                    n = hi - lo
                    gone = np.zeros(n + 1, dtype=np.int32)
                    places = np.unique(repeats[at + d])
                    gone[places] += 1
                    gone[places + window] -= 1
                    settled = np.minimum(ranges[at + d], n)
                    some = settled[1::2] - settled[::2] >= window
                    np.add.at(gone, settled[::2][some], 1)
                    np.add.at(gone, settled[1::2][some], -1)
                    gone = np.cumsum(gone)[:-1] > 0
                    kept = np.flatnonzero(~gone) + lo
                    if separators and len(kept) < n:
                        pieces = []
                        for i in kept.tolist():
                            pieces.append(raw[starts[i] : starts[i + 1] if i + 1 < hi else offsets[d + 1]])
                        texts.append(b"".join(pieces).rstrip())
                    elif separators:
                        texts.append(raw[offsets[d] : offsets[d + 1]])
                    else:
                        texts.append(b" ".join([raw[starts[i] : stops[i]] for i in kept.tolist()]))
                    totals.append(n)
                    removed.append(n - len(kept))
                rows = batch.slice(at, len(texts))
                kept_text = pa.array(texts, pa.binary()).cast(pa.string())
                counts = [pa.array(x, pa.int64()) for x in (totals, removed)]
                yield pa.RecordBatch.from_arrays([rows["id"], *counts, kept_text, *(rows[c] for c in keep)], ["id", "n_words", "n_removed", "kept_text", *keep])

    return run


def settled_ranges(texts: DataFrame, window: int) -> DataFrame:
    """(id, print, ranges): of each document the ranges [from, to) that repeat from end to end, by rounds 1 and 2."""
    prints = texts.select("id", "print", F.md5("text").alias("md5"))
    firsts = prints.groupBy("md5").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("md5", "first")
    copies = prints.join(firsts, "md5").where("id > first").select("id", "print", F.array(F.lit(0), F.lit(_ALL)).alias("ranges"))
    pairs = texts.select("id", "print", "text").mapInArrow(_pair_rows(window), _PAIRS)
    rank = F.rank().over(W.partitionBy("name", "sum", F.col("stop") - F.col("start")).orderBy("id", "print", "start"))
    later = pairs.withColumn("rank", rank).where("ranges is not null or rank > 1").select("id", "print", F.coalesce("ranges", F.array("start", "stop")).alias("ranges"))
    return later.union(copies).groupBy("id", "print").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def remove_repeats(docs: DataFrame, window: int = 20, separators: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Cut from each text every word covered by a window of `window` words that starts earlier too: in a document of smaller doc_id, or before in its own.

    docs needs doc_id and text; keep names other columns to return. Returns doc_id, kept_text, n_words, n_removed and those: a row for each
    row. With separators, kept words keep the white space that follows them; else one space joins them. Null and empty texts have no word, and
    come back empty. Rows of the same doc_id and text are one document, and get the same result; rows of the same doc_id with other texts
    come in order of a 31-bit text hash. A missing doc_id counts as the smallest. Windows are judged on the input, not on what is left.
    An empty table gives an empty one.
    """
    keep = keep or []
    own = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"), *(F.col(c).alias(f"keep{i}") for i, c in enumerate(keep))
    ).withColumn("print", F.xxhash64("text").bitwiseAND(F.lit(_ALL)).cast("int"))
    settled = materialise(settled_ranges(own, window))
    # all three uses below read every column, so that they share one exchange of the texts
    kept = [f"keep{i}" for i in range(len(keep))]
    base = own.join(settled, ["id", "print"], "left").select("id", "print", "text", "ranges", *kept)
    found = base.mapInArrow(_anchor_rows(window), "name long, twice boolean, ids array<long>, prints array<int>")
    n = F.sum(F.size("ids")).over(W.partitionBy("name"))
    shared = found.withColumn("n", n).where("n > 1 or twice").select("name", F.explode(F.arrays_zip("ids", "prints")).alias("d"))
    names = shared.groupBy(F.col("d.ids").alias("id"), F.col("d.prints").alias("print")).agg(F.collect_set("name").alias("names"))
    windows = base.join(names, ["id", "print"], "left").select("id", "print", "text", "ranges", *kept, "names").mapInArrow(_window_rows(window), _WINDOWS)
    rank = F.rank().over(W.partitionBy("h1", "h2").orderBy("id", "print", "place"))
    later = windows.withColumn("rank", rank).where("places is not null or rank > 1").select("id", "print", "places", "place")
    repeats = later.groupBy("id", "print").agg(F.concat(F.collect_list("place"), F.flatten(F.collect_list("places"))).alias("repeats"))
    schema = StructType().add("id", "long").add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    for c in kept:
        schema = schema.add(c, own.schema[c].dataType)
    whole = base.join(repeats, ["id", "print"], "left").select("id", "print", "text", "ranges", *kept, "repeats")
    cut = whole.mapInArrow(_cut(window, separators, kept), schema)
    return cut.select(F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id"), "kept_text", "n_words", "n_removed", *(F.col(c).alias(name) for c, name in zip(kept, keep, strict=True)))
