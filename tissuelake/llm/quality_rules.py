"""Quality rules as a bitmask ledger.

ledger() evaluates every rule once for each document and stores its measurements and one long of failure bits. Everything
after that reads the ledger alone: a policy is a version with a mask of the rules that it enforces, a verdict is one bitwise AND, and
ablations (what would come back if one rule were dropped) are counts over masked bits in a single aggregation. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, bind, text_or_empty, words_of

SYMBOLS = "#*$%&|<>"

#: Rules in bit order: name and the SQL condition on the measurements under which a document fails.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
    "capitals": "100 * n_upper > 50 * word_chars",
}
#: Versioned policies: the rules that each enforces. "base" is the floor of all later versions.
POLICIES = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "symbols", "repeated_lines", "word_length", "capitals"],
}


def mask(version: str) -> int:
    return sum(1 << list(RULES).index(rule) for rule in POLICIES[version])


def _covered(places: Column) -> Column:
    """Words covered by 3-word windows at these ascending places."""
    return F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last")),
        lambda s, p: F.struct((s["n"] + F.least(p - s["last"], F.lit(3))).alias("n"), p.alias("last")),
        lambda s: s["n"],
    )


def _later(array: Column, by: int) -> Column:
    """The array without its first elements. Shifted arrays and zip_with are several times cheaper than indexing inside a lambda."""
    return F.slice(array, F.lit(by + 1), F.size(array) - by)


def _by_place(windows: Column, distinct: Column) -> Column:
    """Words in repeated windows, by sorting hash and place together.

    One long holds as many high bits of the hash as the place leaves room for. Shortened hashes could only merge windows, so if they
    give as many distinct values as whole ones do, they agree; else (about never) whole hashes are sorted with their places.
    """

    def of_bits(bits: Column) -> Column:
        low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        key = F.transform(windows, lambda h, i: h.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))

        def of_sorted(s: Column) -> Column:
            ends = F.zip_with(
                F.slice(s, 1, F.size(s) - 1),
                _later(s, 1),
                lambda a, b: F.when(F.call_function("shiftrightunsigned", a.bitwiseXOR(b), bits) == 0, F.array(a.bitwiseAND(low), b.bitwiseAND(low))),
            )
            return bind(F.array_compact(ends), lambda e: F.when(F.size(e) == F.size(windows) - distinct, _covered(F.sort_array(F.array_distinct(F.flatten(e))))))

        return bind(F.sort_array(key), of_sorted)

    bits = F.ceil(F.log2(F.size(windows) + 1)).cast("int")
    return F.coalesce(bind(bits, of_bits), _by_whole_hash(windows))


def _by_whole_hash(windows: Column) -> Column:
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))

    def of_sorted(s: Column) -> Column:
        ends = F.zip_with(F.slice(s, 1, F.size(s) - 1), _later(s, 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return _covered(F.sort_array(F.array_distinct(F.flatten(F.array_compact(ends)))))

    return bind(placed, of_sorted)


def _repeat_words(words: Column) -> Column:
    """Number of words in 3-word windows that occur twice or more. Windows are 64-bit hashes."""
    two = F.zip_with(F.slice(words, F.lit(1), F.size(words) - 2), F.slice(words, F.lit(2), F.size(words) - 2), lambda a, b: F.xxhash64(a, b))
    windows = F.zip_with(two, _later(words, 2), lambda a, b: F.xxhash64(a, b))
    none = F.lit(0).cast("long")
    of_windows = lambda w: bind(F.size(F.array_distinct(w)), lambda n: F.when(n == F.size(w), none).otherwise(_by_place(w, n)))
    return F.when(F.size(words) < 3, none).otherwise(bind(windows, of_windows))


def _count(text: Column, others: str) -> Column:
    """Characters of a text that are not of the class `others`."""
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and one long for each measurement of the whole text."""
    text = text_or_empty()

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), _repeat_words(words).alias("n_repeat_words"))

    lines = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    read = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        bind(words_of(F.col("text")), of_words).alias("w"),
        bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        _count(F.col("text"), f"[^{SYMBOLS}]+").alias("n_symbols"),
        _count(F.col("text"), r"\P{Lu}+").alias("n_upper"),
    )
    return read.select("doc_id", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "n_upper")


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and `failures`, a long with a bit for each rule that a document fails.

    docs needs doc_id and text; other columns are ignored. A row for each row, in no order: null and empty texts have no words and fail
    few_words; repeated rows are measured each for itself; a null doc_id is passed through. An empty table gives an empty ledger.
    """
    bits = [F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)) for i, condition in enumerate(RULES.values())]
    failures = bits[0]
    for bit in bits[1:]:
        failures = failures.bitwiseOR(bit)
    return measure(docs).withColumn("failures", failures.cast("long"))


def verdict(version: str, failures: str = "failures") -> Column:
    """True for documents that the policy keeps."""
    return F.col(failures).bitwiseAND(F.lit(mask(version))) == 0


def ablations(entries: DataFrame, version: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that fail it alone, which would come back without it. One pass, one row of counts a task."""
    enforced = F.col("failures").bitwiseAND(F.lit(mask(version)))
    bit = {rule: F.lit(1 << list(RULES).index(rule)) for rule in POLICIES[version]}
    rows = [F.struct(F.lit(rule).alias("rule"), F.col(f"f{i}").alias("failed"), F.col(f"o{i}").alias("failed_alone")) for i, rule in enumerate(bit)]
    counts = [F.count_if(enforced.bitwiseAND(b) != 0).alias(f"f{i}") for i, b in enumerate(bit.values())]
    alone = [F.count_if(enforced == b).alias(f"o{i}") for i, b in enumerate(bit.values())]
    return entries.agg(*counts, *alone).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def keep_good(docs: DataFrame, version: str = "v1") -> DataFrame:
    """The rows of docs that a policy keeps, as they are."""
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    return _with_ledger(held).where(verdict(version)).select("row.*")


def _with_ledger(held: DataFrame) -> DataFrame:
    """ledger() beside a struct of the original row, without a join."""
    measured = ledger(held.select(F.struct("row", "doc_id").alias("doc_id"), "text"))
    return measured.select("doc_id.row", *(c for c in measured.columns if c != "doc_id"))
