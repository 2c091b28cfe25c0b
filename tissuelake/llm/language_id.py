"""Language identification by bit-sliced Bloom filters of character n-grams.

All languages share one filter: each slot is a mask with a bit for each language (one mask for each 63 of them), so one lookup gives all
languages whose n-grams include a given one. Training counts 2- to 4-grams of letters (with word ends) by language in Spark and gives each to the languages where it is at least
KEEP as frequent as where it is most frequent. A text's n-grams are looked up, hits are counted for each language and corrected for that
language's false-positive rate, and the most hits win.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, mix64

SLOTS, HASHES, KEEP, LEAST = 1 << 20, 3, 0.5, 3
#: Expected number of labelled documents that a fit takes; all of them if there are fewer.
FIT_ROWS = 8192
CACHE_WORDS = 400_000
UNKNOWN = "und"
MASK_BITS = 63


def _letters(word: bytes) -> list[str]:
    text = word.decode().lower()
    return [text] if text.isalpha() else "".join(c if c.isalpha() else " " for c in text).split()


def gram_hashes(runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 2- to 4-grams of letter runs with their ends, and the run that each is from."""
    points = np.frombuffer(("_" + "_".join(runs) + "_").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    ends = np.flatnonzero(points == ord("_"))
    run = np.searchsorted(ends, np.arange(len(points)), side="right") - 1
    hashes, owner = [], []
    h = points.copy()
    for n in range(2, 5):
        h = h[:-1] * np.uint64(0x100000001B3) + points[n - 1 :]
        # a gram may start at a run's opening end and reach its closing one, no further
        inside = np.arange(len(h)) + n - 1 <= ends[np.minimum(run[: len(h)] + 1, len(ends) - 1)]
        hashes.append(mix64(h[inside] + np.uint64(n << 56)))
        owner.append(run[: len(h)][inside])
    return np.concatenate(hashes), np.concatenate(owner)


def _slots(hashes: np.ndarray) -> list[np.ndarray]:
    return [(mix64(hashes + np.uint64(j * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(SLOTS)).astype(np.int64) for j in range(HASHES)]


def _texts(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Slices of a column as (first row, texts), so that a task holds the words of one slice and not of a whole batch."""
    for at, data, offsets in byte_slices(column):
        raw = data.tobytes()
        yield at, [raw[lo:hi] for lo, hi in pairwise(offsets.tolist())]


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch["lang"].to_pylist()
        words: dict[str, dict[bytes, int]] = {lang: {} for lang in sorted(set(langs))}
        for at, texts in _texts(batch["text"]):
            for i, text in enumerate(texts, at):
                seen = words[langs[i]]
                for w in text.split():
                    seen[w] = seen.get(w, 0) + 1
        for lang, seen in words.items():
            runs, times = [], []
            for w, c in seen.items():
                for r in _letters(w):
                    runs.append(r)
                    times.append(c)
            if runs:
                hashes, owner = gram_hashes(runs)
                grams, back = np.unique(hashes, return_inverse=True)
                counts = np.bincount(back, weights=np.array(times)[owner]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array([lang] * len(grams)), pa.array(counts)], ["gram", "lang", "n"])


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blocks, masks = batch["block"].to_numpy(), batch["mask"].to_numpy()
        slots = _slots(batch["gram"].to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(slots)), pa.array(np.tile(blocks, HASHES)), pa.array(np.tile(masks, HASHES))], ["slot", "block", "mask"])


class Filters:
    """The bit-sliced filter: masks by block of languages and slot, the languages in bit order, and each language's false-positive rate."""

    def __init__(self, masks: np.ndarray, languages: list[str]):
        self.masks, self.languages = masks, languages
        fill = np.array([np.count_nonzero(masks[i // MASK_BITS] >> i % MASK_BITS & 1) for i in range(len(languages))]) / SLOTS
        self.false = fill**HASHES

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """By block, the mask of languages that contain each n-gram."""
        found = np.full((len(self.masks), len(hashes)), -1, dtype=self.masks.dtype)
        for slots in _slots(hashes):
            found &= self.masks[:, slots]
        return found

    def hits(self, words: list[bytes]) -> np.ndarray:
        """For each word, hits by language and, last, its number of n-grams."""
        split = [_letters(w) for w in words]
        out = np.zeros((len(words), len(self.languages) + 1))
        if any(split):
            hashes, owner = gram_hashes([r for rs in split for r in rs])
            owner = np.repeat(np.arange(len(words)), [len(rs) for rs in split])[owner]
            found = self.lookup(hashes)
            for i in range(len(self.languages)):
                out[:, i] = np.bincount(owner, weights=(found[i // MASK_BITS] >> i % MASK_BITS & 1), minlength=len(words))
            out[:, -1] = np.bincount(owner, minlength=len(words))
        return out


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Filters:
    """Filters from docs (text, lang) without null texts or languages; about fit_rows of them, chosen by a hash of doc_id.

    n-gram counts are summed in Spark; what reaches the driver are the languages and the filter's slots, SLOTS at most for each MASK_BITS languages.
    """
    known = docs.where("text is not null and lang is not null")
    share = min(1.0, fit_rows / max(1, known.count()))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)).select("text", "lang")
    counts = sample.mapInArrow(_gram_counts, "gram long, lang string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n")).cache()
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).toLocalIterator()}
    languages = sorted(totals)
    masks = np.zeros((-(-len(languages) // MASK_BITS), SLOTS), dtype=np.int64)
    if languages:
        place = F.create_map(*(F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)))[F.col("lang")]
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place") % MASK_BITS)
        rate = F.col("n") / F.create_map(*(F.lit(x) for lang in languages for x in (lang, float(totals[lang]))))[F.col("lang")]
        rated = counts.where(F.col("n") >= LEAST).select("gram", rate.alias("rate"), place.alias("place")).select("gram", "rate", F.floor(F.col("place") / MASK_BITS).alias("block"), bit.alias("bit"))
        best = rated.groupBy("gram").agg(F.max("rate").alias("best"))
        kept = rated.join(best, "gram").where(F.col("rate") >= KEEP * F.col("best")).groupBy("gram", "block").agg(F.bit_or("bit").alias("mask"))
        slots = kept.mapInArrow(_filled, "slot long, block long, mask long").groupBy("slot", "block").agg(F.bit_or("mask").alias("mask")).toArrow()
        masks[slots["block"].to_numpy(), slots["slot"].to_numpy()] = slots["mask"].to_numpy()
    counts.unpersist()
    return Filters(masks, languages)


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, lang_pred, score) for every row, by its whole text: the language with the most corrected hits and its share of all of them.

    `und` with score 0 if the text is null or has no letter. Ties go to the first language in order; without any language all is `und`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        n_langs = len(f.languages)
        known: dict[bytes, int] = {}
        table = np.zeros((0, n_langs + 1))
        slices = ((batch["doc_id"].slice(at, len(raw)), raw) for batch in batches for at, raw in _texts(batch["text"]))
        for ids, raw in slices:
            texts = [t.split() for t in raw]
            if len(known) > CACHE_WORDS:
                known, table = {}, table[:0]
            fresh = list(dict.fromkeys(w for t in texts for w in t if w not in known))
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
            table = np.concatenate([table, f.hits(fresh)])
            langs, scores = [], []
            for words in texts:
                sums = table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(axis=0)
                n, hits = sums[-1], sums[:-1]
                if not n or not n_langs:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                hits = np.maximum(0, (hits - n * f.false) / (1 - f.false + 1e-12))
                best = int(np.argmax(hits))
                langs.append(f.languages[best])
                scores.append(float(hits[best] / hits.sum()) if hits.sum() else 0.0)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
