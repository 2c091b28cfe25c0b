"""License scan in DataFrame functions: sparse TF-IDF cosine of headers and license files to templates, then inheritance from the nearest directory above.

A file's pieces are its whole text, its paragraphs (between blank lines), its runs of comment lines and its single lines, so license files, wrapped
headers and one-line notices are each met whole. A vector has (1 + ln count) * idf for each term; inverse document frequencies are counted over all
files, and terms of no template count as unseen. A piece can only reach the threshold if it has enough of a template's terms, for even its heaviest
ones make up only so much of its vector (Cauchy-Schwarz); so whole texts are tested for their distinct template terms first, pieces next, and only the few
that pass become rows of terms, joined with the templates' terms and summed by piece. Licenses of like wording differ in single words: a piece only
counts for a template if it has the words and the version that decide (`marks`). Files named like a license, or whose nearest piece is the whole text,
speak for their directory; other files without a license of their own take that of the nearest directory at or above theirs. Paths are joined
directory by directory, not file by file.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_or_empty
from .license_texts import DECISIVE, FAMILIES, RIVALS, TEMPLATES

LEAST = 0.6
LICENSE_NAMES = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"
_SPLIT = "[^a-z0-9]+"
#: Lines that begin with a comment mark.
_COMMENTS = r"(?m)((?:^[ \t]*(?:#|//|/\*|\*|--|;|%|<!--|\"\"\")[^\n]*(?:\n|\z))+)"
#: Weight of a term that all files have.
_FLOOR = 0.1


def terms_of(text: str) -> list[str]:
    return [t for t in re.split(_SPLIT, text.lower()) if t]


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _SPLIT), lambda t: t != "")


def template_weights(idf: dict[str, float], templates: dict[str, list[str]]) -> list[tuple[str, dict[str, float]]]:
    """Each template's identifier and unit vector."""
    out = []
    for name, texts in templates.items():
        for text in texts:
            terms = terms_of(text)
            vector = {t: (1 + math.log(terms.count(t))) * idf[t] for t in set(terms)}
            norm = math.sqrt(sum(v * v for v in vector.values()))
            out.append((name, {t: v / norm for t, v in sorted(vector.items())}))
    return out


def needed_terms(vector: dict[str, float], least: float = LEAST) -> tuple[list[str], int]:
    """A template's heavy terms, and the number of them without which no text reaches `least`.

    The light ones make up less than half of what is needed; even the heaviest of the others have to bring the rest.
    """
    light, heavy = 0.0, []
    for term, w in sorted(vector.items(), key=lambda x: x[1]):
        if heavy or light + w * w >= least * least / 2:
            heavy.append((w * w, term))
        else:
            light += w * w
    total, n = light, 0
    for square, _ in sorted(heavy, reverse=True):
        if total >= least * least - 1e-9:
            break
        total, n = total + square, n + 1
    return sorted(t for _, t in heavy), n


def marks(name: str, text: str) -> tuple[set[str], set[str]]:
    """The terms that a piece must have, and those it must not have, to be text with the license `name`.

    Must: the template's decisive words and the numbers of the license's version, as far as the template has them; of a tag, all terms of the identifier.
    Must not: words that would make it a license next to this one, if the template is of a family of such.
    """
    own = set(terms_of(text))
    named = {t for t in terms_of(name) if t.isdigit() or ("spdx" in own and t != "or")}
    return own & (named | set(DECISIVE)), set(RIVALS) - own if own & set(FAMILIES) else set()


def _may_match(met: Column, weights: list[tuple[str, dict[str, float]]], least: float) -> Column:
    """Whether a text with these distinct terms can reach `least` with a template. Templates with the same needs are one test."""
    needs = {(tuple(terms), n) for terms, n in (needed_terms(v, least) for _, v in weights)}
    tests = [F.size(F.array_intersect(met, F.array(*map(F.lit, terms)))) >= n for terms, n in sorted(needs)]
    return reduce(or_, tests)


def scan(files: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST) -> DataFrame:
    """Licenses of files (path, text).

    Returns a row for each row: path, license, score (cosine of the nearest piece if it reaches `least`), inherited_from (the directory that gave the
    license; null if it is the file's own). A tag `SPDX-License-Identifier:` with an identifier of no template gives none. license is null where neither the file nor a directory above has one. Rows of one path count as one
    file. Rows without path are files of their own, scanned but without inheritance. Null texts have no pieces; ties go to the last identifier;
    other columns are ignored. An empty table gives an empty one.
    """
    templates = templates or TEMPLATES
    key = F.coalesce(F.concat(F.lit("p"), "path"), F.concat(F.lit("t"), F.md5(text_or_empty())))  # equal texts without path share their result
    files = files.select("path", text_or_empty().alias("text"), key.alias("key"))
    terms = sorted({t for texts in templates.values() for text in texts for t in terms_of(text)})
    vocabulary = F.array(*map(F.lit, terms))
    counted = files.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(_terms(F.col("text")), vocabulary))).alias("term")).groupBy("term").count()
    df = {r["term"]: r["count"] for r in counted.toLocalIterator()}  # a row a template term
    n = df.get("", 0)
    idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + _FLOOR for t in terms}
    weights = template_weights(idf, templates)
    spark = files.sparkSession
    idfs = F.broadcast(spark.createDataFrame(list(idf.items()), "term string, idf double"))
    decided = [marks(name, text) for name, texts in templates.items() for text in texts]
    bits = {t: 1 << i for i, t in enumerate(sorted(set().union(*(m | n for m, n in decided))))}
    if len(bits) > 63:
        raise ValueError(f"templates with {len(bits)} deciding terms; 63 at most")
    mask = lambda terms: sum(bits[t] for t in terms)
    flat = [(name, i, t, w, mask(decided[i][0]), mask(decided[i][1])) for i, (name, v) in enumerate(weights) for t, w in v.items()]
    vectors = F.broadcast(spark.createDataFrame(flat, "license string, template int, term string, weight double, must long, must_not long"))
    held = reduce(add, (F.when(F.array_contains("terms", t), F.lit(bit).cast("long")).otherwise(0) for t, bit in bits.items()), F.lit(0).cast("long"))

    passing = files.where(_may_match(F.array_intersect(_terms(F.col("text")), vocabulary), weights, least))
    blocks = F.concat(F.split("text", r"\n[ \t\r]*\n"), F.regexp_extract_all("text", F.lit(_COMMENTS), 1), F.split("text", "\n"))
    piece = F.explode(F.array_distinct(F.concat(F.array(F.col("text")), blocks))).alias("piece")
    pieces = passing.select("key", "text", piece).withColumn("terms", _terms(F.col("piece")))
    pieces = pieces.where(_may_match(F.array_intersect("terms", vocabulary), weights, least))
    pieces = pieces.select("key", F.md5("piece").alias("part"), (F.col("piece") == F.col("text")).alias("whole"), held.alias("held"), "terms").dropDuplicates(["key", "part"])
    rows = pieces.select("key", "part", "whole", "held", F.explode("terms").alias("term")).groupBy("key", "part", "whole", "held", "term").agg(F.count("*").alias("c"))
    weighed = materialise(rows.join(idfs, "term", "left").select("key", "part", "whole", "held", "term", ((1 + F.log("c")) * F.coalesce("idf", F.lit(math.log(1 + n) + _FLOOR))).alias("w")))
    norms = weighed.groupBy("key", "part").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    decides = (F.col("held").bitwiseAND(F.col("must")) == F.col("must")) & (F.col("held").bitwiseAND(F.col("must_not")) == 0)
    dots = weighed.join(vectors, "term").where(decides).groupBy("key", "part", "whole", "license", "template").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scores = dots.join(norms, ["key", "part"]).withColumn("score", F.col("dot") / F.col("norm")).where(F.col("score") >= least)
    best = scores.groupBy("key").agg(F.max(F.struct(F.round("score", 9).alias("score"), "license", "whole")).alias("best"))
    best = materialise(best.select("key", "best.license", "best.score", F.col("best.whole").alias("is_text")))

    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")
    own = files.select("path", "key", folder).join(best, "key", "left")
    speaks = F.col("license").isNotNull() & F.col("path").isNotNull() & (F.col("is_text") | F.col("path").rlike(LICENSE_NAMES))
    speakers = own.where(speaks).groupBy("folder").agg(F.max_by("license", F.struct("score", "path")).alias("folder_license"))
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    above = F.when(F.col("folder") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), above))
    steps = own.where("license is null and folder is not null").select("folder").distinct().select("folder", F.posexplode(above).alias("depth", "ancestor"))
    near = steps.join(speakers.withColumnRenamed("folder", "ancestor"), "ancestor").groupBy("folder").agg(F.max_by(F.struct("ancestor", "folder_license"), "depth").alias("near"))
    joined = own.join(near, "folder", "left")
    inherits = F.col("license").isNull() & F.col("near").isNotNull()
    return joined.select("path", F.coalesce("license", "near.folder_license").alias("license"), "score", F.when(inherits, F.col("near.ancestor")).alias("inherited_from"))
