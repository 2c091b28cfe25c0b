"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sources share all words by weight, but none gets more than `most` times its own (the excess goes to the others by weight). The words
to take are cut into blocks of BLOCK words (of fewer, if a source has fewer than sixteen blocks: a sixteenth of the smallest source with words), which go to sources by highest quotients target / (2 k + 1). A source's documents are dealt by
a seeded hash over shards of about SHARD words, and its blocks go to its shards by highest quotients again. Within a shard documents stand in
seeded order and their words form equal blocks; the shard takes all its blocks as often as its quota says and then the first ones once more, so at
most one document of a shard is taken in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialise, text_or_empty, word_count, words_of

BLOCK, SHARD = 64, 1 << 18
WEIGHTS = (5.0, 2.0, 1.0)


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """(source, source_size) with weight and target. One row a source: the windows below see the table of sources, not of documents.

    Sources in code-point order, null last, take the weights in turn. Water-filling in order of cap / weight: a source is capped
    if an equal share of what the sources before it leave would lift it over its cap.
    """
    place = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place + 1)).withColumn("cap", (most * F.col("source_size")).cast("double"))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    total = F.sum(F.col("source_size").cast("double")).over(W.partitionBy())
    filled = weighed.withColumn("total", total).withColumn("used", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("left", F.sum("weight").over(after))
    capped = filled.withColumn("capped", (F.col("total") - F.col("used")) / F.col("left") * F.col("weight") > F.col("cap"))
    rest = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(W.partitionBy())
    shared = F.sum(F.when(F.col("capped"), F.lit(0.0)).otherwise(F.col("weight"))).over(W.partitionBy())
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * (F.col("total") - rest) / shared)
    return capped.withColumn("target", target).select("source", "source_size", "weight", "target")


def apportion(parties: DataFrame, group: list[str], key: list[str], votes: str, seats: str, name: str) -> DataFrame:
    """Sainte-Laguë: column `name` with each party's share of its group's seats, by highest quotients votes / (2 k + 1).

    Parties first get their share rounded; at most half a seat a party is then missing or over, and goes to (or comes from) those
    with the next highest (or last lowest) quotients. No party can gain or lose more than (missing + parties) * its share + 1 of
    these, so the quotients compared number a few a party. Groups without votes get no seats. Ties go by key.
    """
    of_group = W.partitionBy(*group)
    total, n = F.sum(votes).over(of_group), F.count("*").over(of_group)
    base = parties.withColumn("_share", F.coalesce(F.try_divide(F.col(votes), total), F.lit(0.0))).withColumn("_n", n)
    base = base.withColumn("_base", F.floor(F.col(seats) * F.col("_share") + 0.5).cast("long"))
    base = base.withColumn("_gap", F.when(total > 0, F.col(seats) - F.sum("_base").over(of_group)).otherwise(0).cast("long"))
    reach = (F.ceil((F.abs("_gap") + F.col("_n")) * F.col("_share")) + 1).cast("long")
    up = F.sequence(F.col("_base"), F.col("_base") + reach - 1)
    down = F.sequence(F.greatest(F.lit(0), F.col("_base") - reach).cast("long"), F.col("_base") - 1)
    none = F.array().cast("array<bigint>")
    seat = F.when((F.col("_gap") > 0) & (F.col(votes) > 0), up).when((F.col("_gap") < 0) & (F.col("_base") > 0), down).otherwise(none)
    tried = base.select(*group, *key, "_gap", F.explode(seat).alias("_k"), votes)
    quotient = F.col(votes) / (2 * F.col("_k") + 1)
    signed = F.when(F.col("_gap") > 0, -quotient).otherwise(quotient)
    ranked = tried.withColumn("_r", F.row_number().over(of_group.orderBy(signed, *key, "_k"))).where("_r <= abs(_gap)")
    moved = ranked.groupBy(*group, *key).agg(F.sum(F.signum("_gap")).cast("long").alias("_moved"))
    moved = moved.select(*(F.col(c).alias(f"_{c}") for c in [*group, *key]), "_moved")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*group, *key]]
    return base.join(moved, same, "left").select(*parties.columns, (F.col("_base") + F.coalesce("_moved", F.lit(0))).alias(name))


def _draw(seed: int) -> Column:
    """A seeded draw for each document; md5, so that any engine can repeat it."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def plan(docs: DataFrame, seed: int = 0, weights: tuple[float, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """How much of each document the mix takes.

    docs needs doc_id, source and text; other columns are ignored. Returns a row for each row: doc_id, print (a hash of the text), source, size,
    source_size, target, repeats (whole copies) and extra (words of one more copy, from its start), taken. Null texts have size 0 and
    nothing of them is taken; null is a source like any other; repeated rows count each. Same input and seed, same result. An empty table gives an empty one.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), F.xxhash64(text_or_empty()).alias("print"))
    sized = materialise(sized)  # the text is split once; three small passes follow
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    every = W.partitionBy()
    least = F.min(F.when(F.col("source_size") > 0, F.col("source_size"))).over(every)
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(least / 16))).cast("long")
    targets = targets.withColumn("block", block).withColumn("blocks", F.round(F.sum("source_size").over(every) / F.col("block")).cast("long"))
    quotas = apportion(targets, [], ["source"], "target", "blocks", "quota").select(
        F.col("source").alias("of"), "source_size", "target", "block", "quota", F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD)).cast("long").alias("shards")
    )
    draw = F.conv(F.substring(_draw(seed), 1, 12), 16, 10).cast("long")
    dealt = sized.join(quotas, sized.source.eqNullSafe(quotas.of)).withColumn("shard", F.pmod(draw, F.col("shards")))
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("quota").alias("quota"), F.first("block").alias("block"))
    shards = apportion(shards.withColumn("votes", F.col("words").cast("double")), ["source"], ["shard"], "votes", "quota", "taken_blocks")
    blocks = F.greatest(F.lit(1), F.round(F.col("words") / F.col("block"))).cast("long")
    taken = F.least(F.col("taken_blocks"), most * blocks)
    shards = shards.select(F.col("source").alias("s"), F.col("shard").alias("sh"), "words", F.floor(taken / blocks).cast("long").alias("repeats"), ((taken % blocks) * F.col("words") / blocks).cast("long").alias("cut"))
    order = W.partitionBy("source", "shard").orderBy(_draw(seed), "doc_id", "print").rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.withColumn("at", F.coalesce(F.sum("size").over(order), F.lit(0)))
    joined = placed.join(shards, placed.source.eqNullSafe(shards.s) & (placed.shard == shards.sh))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("cut") - F.col("at"))).cast("long")
    return joined.select("doc_id", "print", "source", "size", "source_size", "target", "repeats", extra.alias("extra"), (F.col("repeats") * F.col("size") + extra).alias("taken"))


def mix(docs: DataFrame, seed: int = 0, weights: tuple[float, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """docs as the mix takes them: a row for each copy, under the same columns and doc_id; a copy taken in part has its first words, joined by single spaces.

    Documents without words carry nothing into the mix and go. Rows with the same doc_id and text share what the mix takes of them, to a word evenly.
    n_chars, if there, is counted anew. An empty table gives an empty one.
    """
    chosen = plan(docs, seed, weights, most).where("size > 0").groupBy("doc_id", "print").agg(F.sum("taken").alias("all"), F.count("*").alias("n"), F.max("size").alias("size"))
    chosen = chosen.select(F.col("doc_id").alias("of"), F.col("print").alias("of_print"), "all", "n", "size")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_or_empty()).alias("print"))
    joined = rows.join(chosen, F.col("id").eqNullSafe(F.col("of")) & (F.col("print") == F.col("of_print")))
    place = F.when(F.col("n") > 1, F.row_number().over(W.partitionBy("id", "print").orderBy("all"))).otherwise(1)
    share = joined.withColumn("place", place).withColumn("share", F.floor(F.col("all") / F.col("n")) + (F.col("place") <= F.col("all") % F.col("n")).cast("long")).where("share > 0")
    left = F.col("share") - (F.col("copy") - 1) * F.col("size")
    copies = share.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("share") / F.col("size")))))
    text = F.when(left < F.col("size"), F.array_join(F.slice(words_of(F.col("row.text")), F.lit(1), left.cast("int")), " ")).otherwise(F.col("row.text"))
    new = copies.withColumn("new", text)
    changed = {"text": F.col("new").alias("text"), "n_chars": F.length("new").cast("long").alias("n_chars")}
    return new.select(*(changed.get(c, F.col(f"row.`{c}`").alias(c)) for c in docs.columns))
