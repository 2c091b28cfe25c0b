"""Document fingerprints: bottom-k sketches of word shingles, in DataFrame functions alone.

A sketch is the sorted array of the k smallest distinct 31-bit hashes of a text's shingles. Sketches of parts merge into that of the whole, and two
sketches estimate resemblance, containment and the number of distinct shingles. A text with fewer than k shingles is kept whole, and its figures are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import bind, materialise, text_or_empty, words_of

K, SHINGLE_WORDS = 128, 5
_RANGE = float(2**31)
_NO_ID = -(2**63)
#: Rows without doc_id are dealt over so many keys.
_SALTS = 64


def _shifted(array: Column, by: int, n: Column) -> Column:
    return F.slice(array, F.lit(by + 1), n)


def sketch(text: Column, k: int = K, shingle_words: int = SHINGLE_WORDS) -> Column:
    """Bottom-k sketch of a text's shingles of shingle_words words; of all its words together if they are fewer. No word: an empty sketch."""

    def of_words(words: Column) -> Column:
        n = F.size(words) - (shingle_words - 1)
        hashed = F.transform(_shifted(words, 0, n), lambda w: F.xxhash64(w))
        for j in range(1, shingle_words):
            hashed = F.zip_with(hashed, _shifted(words, j, n), lambda h, w: F.xxhash64(h, w))
        short = F.transform(F.array(F.array_join(words, " ")), lambda w: F.xxhash64(w))
        hashes = F.when(n > 0, hashed).when(F.size(words) > 0, short).otherwise(F.array().cast("array<bigint>"))
        return smallest(F.transform(hashes, lambda h: F.shiftrightunsigned(h, 33).cast("int")), k)

    return bind(words_of(text), of_words)


def smallest(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_parts(parts: DataFrame, keys: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """Sketches of groups of parts. Each is merged into a running sketch, so no group is gathered beyond k hashes a row of the aggregation's input."""
    hashes = parts.select(*keys, F.explode(column).alias("h")).distinct()
    place = F.row_number().over(W.partitionBy(*keys).orderBy("h"))
    return hashes.withColumn("p", place).where(F.col("p") <= k).groupBy(*keys).agg(F.sort_array(F.collect_list("h")).alias(column))


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Number of distinct shingles: exact below k, else (k - 1) / the k-th smallest hash as a share of the range."""
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) * _RANGE / (F.element_at(s, -1) + 1.0))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the k smallest hashes of the union that both have; of all if both sketches are whole. Two empty texts resemble each other wholly."""
    whole = (F.size(a) < k) & (F.size(b) < k)
    both = F.array_intersect(a, b)

    def of_union(u: Column) -> Column:
        return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(u, both)) / F.size(u))

    return bind(F.when(whole, F.array_union(a, b)).otherwise(merge(a, b, k)), of_union)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    r, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(na == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), r * (na + nb) / (1 + r) / na))


def as_text(s: Column) -> Column:
    """A sketch as a string: base64 of its hashes, four bytes each."""
    return F.translate(F.base64(F.unhex(F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), 8, "0")), ""))), "\r\n", "")


def next_descending(ids: DataFrame) -> DataFrame:
    """(id, next_id) for distinct long ids: the largest smaller id, and for the smallest the largest of all.

    Ids are grouped by their high bits, 1,024 at most to a group; a group's first id takes the greatest of the group before, found in the
    same way one level up. No step sees more than 1,024 rows of one group, and nothing is sorted as a whole.
    """
    low, high = ids.agg(F.min("id"), F.max("id")).first()
    if low is None:
        return ids.select("id", F.col("id").alias("next_id"))
    levels = 1
    while levels < 7 and low >> (10 * levels) != high >> (10 * levels):  # with ids of both signs the highest level keeps 16 groups at most
        levels += 1
    tables = [ids.select("id", F.col("id").alias("top"))]
    for level in range(1, levels):
        tables.append(tables[-1].groupBy(F.shiftright("id", 10).alias("id")).agg(F.max("top").alias("top")))
    above = None
    for table in reversed(tables):
        up = F.lit(0).cast("long") if above is None else F.shiftright("id", 10)
        found = table.select("id", up.alias("up"), F.lag("top").over(W.partitionBy(up).orderBy("id")).alias("before"))
        if above is not None:
            found = found.join(above.select(F.col("id").alias("up"), F.col("before").alias("of_group")), "up", "left").select("id", F.coalesce("before", "of_group").alias("before"))
        above = found.select("id", "before")
    return above.select("id", F.coalesce("before", F.lit(high)).alias("next_id"))


def with_edited(docs: DataFrame, k: int = K, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Each text with an edited one, its last third replaced by the start of the next document's text, and the sketches of both and of the next.

    docs needs doc_id and text; other columns are ignored. Returns doc_id, text, edited, n_chars, sketch, edited_sketch, next_sketch, a row for each
    row. Next is by descending doc_id, after the last the first; a single document is its own next. Null texts count as empty. A missing
    doc_id counts as the smallest. Of rows with the same doc_id, the one with the smallest text hash is next to others. Repeated rows are rows each; an
    empty table gives an empty one.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), text_or_empty().alias("text"))
    thirds = rows.groupBy("id").agg(F.max(F.floor(F.length("text") / 3)).alias("third"), F.min(F.xxhash64("text")).alias("lead"))
    thirds = materialise(thirds)
    order = materialise(next_descending(thirds.select("id")))
    wanted = order.join(thirds.select("id", "third"), "id").select(F.col("next_id").alias("id"), F.col("id").alias("for_id"), "third").join(thirds.select("id", "lead"), "id")

    def salt(print_: Column) -> Column:
        return F.coalesce(F.when(F.col("id") == _NO_ID, F.pmod(print_, F.lit(_SALTS))), F.lit(0)).cast("int").alias("salt")

    # Both uses below read this one exchange (they need the same columns of it), so that texts are shuffled and sketched once. Rows without doc_id are spread by their text.
    placed = rows.select("id", "text", sketch(F.col("text"), k, shingle_words).alias("sketch"), salt(F.xxhash64("text"))).repartition("id", "salt")
    lead = F.row_number().over(W.partitionBy("id", "salt").orderBy(F.xxhash64("text")))
    heads = placed.withColumn("first", lead).where("first = 1").join(wanted.withColumn("salt", salt(F.col("lead"))), ["id", "salt"])
    heads = heads.where(F.xxhash64("text").bitwiseXOR(F.col("lead")) == 0)  # not ==, which would become a key of the join and shuffle texts again
    head = F.substring("text", F.lit(1), F.col("third").cast("int"))
    salts = F.when(F.col("for_id") == _NO_ID, F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(F.array(F.lit(0)))
    heads = heads.select(F.col("for_id").alias("id"), head.alias("head"), F.col("sketch").alias("next_sketch"), salts.alias("salts")).withColumn("salt", F.explode("salts")).drop("salts")
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("head", F.lit(1), cut))
    joined = placed.join(heads, ["id", "salt"]).select("id", "text", edited.alias("edited"), n.cast("long").alias("n_chars"), "sketch", "next_sketch")
    return joined.select(F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id"), "text", "edited", "n_chars", "sketch", sketch(F.col("edited"), k, shingle_words).alias("edited_sketch"), "next_sketch")
