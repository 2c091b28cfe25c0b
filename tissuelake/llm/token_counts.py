"""Token counts of whole texts under a unigram vocabulary, by dynamic programming over a trie of pre-tokens.

Each task keeps the token counts of pre-tokens it has met. The new ones of a batch are sorted, which is the depth-first order of
their trie: forward scores along the path are kept, so that a prefix which many pre-tokens share is scored once, and a pre-token's
end stores its count. Texts are not shuffled, and a document costs one lookup a word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices

#: Pre-tokens that a worker may remember before it forgets all.
CACHE_WORDS = 400_000
SPACE = "▁"


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary(path: str) -> dict[str, float]:
    """Pieces of a public vocabulary file with unigram scores: Zipf log-probabilities of the pieces' ranks. Control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(plain))))
    return {piece: -math.log(r + 1) - total for r, piece in enumerate(plain)}


class Counter:
    """Counts of tokens of the best segmentation: highest score, then fewest tokens. A character that no piece covers is one token for each byte, at a price below any piece."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - 10.0
        self.known: dict[bytes, int] = {}

    def _step(self, word: str, end: int, path: list[tuple[float, int]]) -> tuple[float, int]:
        """Forward score and minus the token count of word[:end], given those of its shorter prefixes."""
        n_bytes = len(word[end - 1].encode())
        best = (path[end - 1][0] + self.unknown * n_bytes, path[end - 1][1] - n_bytes)
        for start in range(max(0, end - self.longest), end):
            score = self.pieces.get(word[start:end])
            if score is not None:
                best = max(best, (path[start][0] + score, path[start][1] - 1))
        return best

    def learn(self, words: list[bytes]) -> None:
        before, path = "", [(0.0, 0)]
        for raw, word in sorted((w, SPACE + w.decode()) for w in words):
            del path[len(commonprefix((before, word))) + 1 :]
            for end in range(len(path), len(word) + 1):
                path.append(self._step(word, end, path))
            self.known[raw] = -path[-1][1]
            before = word

    def counts(self, texts: list[bytes]) -> list[tuple[int, int]]:
        """(tokens, words) of each text."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        split = [t.split() for t in texts]
        self.learn(list({w for words in split for w in words if w not in self.known}))
        return [(sum(map(self.known.__getitem__, words)), len(words)) for words in split]


def count_tokens(docs: DataFrame, pieces: dict[str, float]) -> DataFrame:
    """(doc_id, n_words, n_tokens) for every row, of its whole text.

    docs needs doc_id and text; other columns are ignored. Words are runs of anything but ASCII white space and begin with a word mark. Null and
    empty texts have no words. A null doc_id is passed through. An empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            for at, data, offsets in byte_slices(batch["text"]):
                raw = data.tobytes()
                table = np.array(counter.counts([raw[lo:hi] for lo, hi in pairwise(offsets.tolist())]), dtype=np.int64).reshape(-1, 2)
                ids = batch["doc_id"].slice(at, len(table)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(table[:, 1]), pa.array(table[:, 0])], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")
