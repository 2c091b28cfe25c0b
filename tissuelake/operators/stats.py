"""Population statistics of measurements by condition and stage."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .components import saved
from .pair_sums import pair_sums
from .spatial import grid_join
from .zonal import FRAME


def boxes(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Count, quartiles and extremes of a value by group; NaN does not count."""
    v = F.when(~F.isnan(value), F.col(value))
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = rows.groupBy(*groups).agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), q.alias("q"))
    return out.select(*groups, "n", "low", *(F.col("q")[i].alias(f"q{p}") for i, p in enumerate((25, 50, 75))), "high")


def quantiles(rows: DataFrame, value: str, shares: list[float], margin: float = 0.002) -> list[float] | None:
    """Exact percentiles of a column as percentile() has them (null does not count); None without values.

    Approximate ones bracket each; what lies below a bracket is counted, and only the values within, about twice the margin of all, are put in order. A
    bracket that misses its ranks is widened, at last to all values, so that the result is exact whatever the approximation.
    """
    known = rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    n, least, greatest = known.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    places = [(n - 1) * s for s in shares]
    while True:
        ends = [e for s in shares for e in (s - margin, s + margin)]
        marks = known.agg(F.percentile_approx("v", [min(max(e, 0.0), 1.0) for e in ends], 10000)).first()[0]
        marks = [least if e <= 0 else greatest if e >= 1 else m for e, m in zip(ends, marks, strict=True)]
        brackets = list(zip(marks[::2], marks[1::2], strict=True))
        counted = known.agg(*(F.count(F.when(c, 1)) for lo, hi in brackets for c in (F.col("v") < lo, F.col("v") <= hi))).first()
        sure = all(below <= math.floor(p) and math.ceil(p) < upto for p, below, upto in zip(places, counted[::2], counted[1::2], strict=True))
        if sure or margin >= 1:
            break
        margin *= 4
    out = []
    for p, (lo, hi), below in zip(places, brackets, counted[::2], strict=True):
        within = known.where(F.col("v").between(lo, hi)).groupBy("v").agg(F.count("*").alias("c"))
        upto = F.sum("c").over(W.orderBy("v").rowsBetween(W.unboundedPreceding, 0)) + below
        at = [F.min(F.when(F.col("upto") > rank, F.col("v"))) for rank in (math.floor(p), math.ceil(p))]
        first, second = within.withColumn("upto", upto).agg(*at).first()
        out.append(first if first == second else (math.ceil(p) - p) * first + (p - math.floor(p)) * second)
    return out


def histogram(rows: DataFrame, value: str) -> DataFrame:
    """Density histogram with the bin width 2 * IQR / n ** (1/3) of Freedman and Diaconis; the last bin is closed. Bounds are one row.

    Null and NaN do not count. Where the width is 0 there is one bin; where all values are equal it reaches half a unit to both sides.
    """
    known = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    q = F.array(*map(F.lit, quantiles(known, value, [0.25, 0.75]) or [None, None])).cast("array<double>")
    bounds = known.agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n")).withColumn("q", q)
    flat = F.col("low") == F.col("high")
    bounds = bounds.select("n", "q", F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"), F.when(flat, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"))
    width = 2 * (F.col("q")[1] - F.col("q")[0]) / F.pow("n", F.lit(1 / 3))
    bins = F.when(width > 0, F.greatest(F.lit(1), F.ceil(F.try_divide(F.col("high") - F.col("low"), width)))).otherwise(F.lit(1))
    bounds = bounds.select("low", "n", bins.cast("long").alias("bins"), ((F.col("high") - F.col("low")) / bins).alias("width"))
    placed = known.crossJoin(F.broadcast(bounds))
    bin_ = F.least(F.floor((F.col(value) - F.col("low")) / F.col("width")), F.col("bins") - 1).cast("long")
    counts = placed.groupBy(bin_.alias("bin")).agg(F.count("*").alias("count"), F.first("n").alias("n"), F.first("width").alias("width"), F.first("low").alias("low"))
    return counts.select("bin", "count", (F.col("low") + F.col("bin") * F.col("width")).alias("start"), (F.col("count") / (F.col("n") * F.col("width"))).alias("density"))


def _with_group(rows: DataFrame, whole: DataFrame, groups: list[str]) -> DataFrame:
    """rows with the columns of their group, a row of whole; null is a group like any other."""
    named = whole.withColumnsRenamed({g: f"_{g}" for g in groups})
    return rows.join(named, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups]).drop(*(f"_{g}" for g in groups))


def group_histograms(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """histogram() of each group by itself, such as of each frame, with its own bounds and bin width. A group without values has no row."""
    known = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))
    bounds = known.groupBy(*groups).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"), q.alias("_q"))
    flat = F.col("_lo") == F.col("_hi")
    bounds = bounds.withColumns({"_lo": F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")), "_hi": F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi"))})
    width = 2 * (F.col("_q")[1] - F.col("_q")[0]) / F.pow("_n", F.lit(1 / 3))
    bins = F.when(width > 0, F.greatest(F.lit(1), F.ceil(F.try_divide(F.col("_hi") - F.col("_lo"), width)))).otherwise(F.lit(1)).cast("long")
    bounds = bounds.withColumn("_bins", bins).select(*groups, "_lo", "_n", "_bins", ((F.col("_hi") - F.col("_lo")) / F.col("_bins")).alias("_w"))
    place = F.least(F.floor((F.col(value) - F.col("_lo")) / F.col("_w")), F.col("_bins") - 1).cast("long")
    counts = _with_group(known, bounds, groups).groupBy(*groups, place.alias("bin")).agg(F.count("*").alias("count"), *(F.first(c).alias(c) for c in ("_lo", "_n", "_w")))
    return counts.select(*groups, "bin", "count", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("start"), (F.col("count") / (F.col("_n") * F.col("_w"))).alias("density"))


def weighted_histogram(rows: DataFrame, groups: list[str], value: str, bins: int, low: float, high: float) -> DataFrame:
    """Share of a group's values in each bin of a fixed range, the last bin closed, and whether the median is there. Values outside count in the total."""
    width = (high - low) / bins
    place = lambda v: F.when(v == high, bins - 1).otherwise(F.floor((v - low) / width)).cast("long")
    v = F.col(value)
    rows = rows.where(v.isNull() | ~F.isnan(v))
    whole = rows.groupBy(*groups).agg(F.count(v).alias("n"), F.percentile(v, F.lit(0.5)).alias("median"))
    counts = rows.where((v >= low) & (v <= high)).groupBy(*groups, place(v).alias("bin")).agg(F.count("*").alias("count"))
    return _with_group(counts, whole, groups).select(*groups, "bin", (F.col("count") / F.col("n")).alias("share"), (place(F.col("median")) == F.col("bin")).alias("has_median"))


def kernel_density(rows: DataFrame, groups: list[str], value: str, bins: int, low: float, high: float) -> DataFrame:
    """Gaussian density of each group's values at `bins` points of a fixed range, bandwidth std * n ** (-1/5). Equal values are counted first."""
    rows = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    v = rows.groupBy(*groups, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    whole = rows.groupBy(*groups).agg(F.count(value).alias("n"), F.stddev_samp(value).alias("s")).select(*groups, "n", (F.col("s") * F.pow("n", F.lit(-0.2))).alias("h"))
    points = [low + i * ((high - low) / (bins - 1)) for i in range(bins)]
    z = [(F.lit(at) - F.col("v")) / F.col("h") for at in points]
    # a sum for each point in every task: values meet their group's row where they are and are not spread over the points
    sums = _with_group(v, F.broadcast(whole), groups).groupBy(*groups).agg(F.first("n").alias("n"), F.first("h").alias("h"), *(F.sum(F.col("c") * F.exp(-x * x / 2)).alias(f"_p{i}") for i, x in enumerate(z)))
    rows_ = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(at).alias("at"), F.col(f"_p{i}").alias("s")) for i, at in enumerate(points)))).alias("p")
    return sums.select(*groups, "n", "h", rows_).select(*groups, "p.i", "p.at", (F.col("p.s") / F.col("n") / F.col("h") / F.sqrt(2 * F.pi())).alias("density"))


def tiles(stage: DataFrame, spacing: float) -> DataFrame:
    """Every four stage positions in order bound a colony: its box, mean z, and tiles of the given spacing in each direction."""
    box = stage.groupBy(F.floor(F.col("place") / 4).cast("long").alias("colony")).agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.avg("current_z").alias("z")
    )
    count = lambda lo, hi: F.greatest(F.lit(0), F.ceil((F.col(hi) - F.col(lo)) / spacing) - 1).cast("long")
    return box.withColumn("nx", count("x0", "x1")).withColumn("ny", count("y0", "y1"))


def range_parameters(rows: DataFrame, value: str) -> DataFrame:
    """Least, greatest and step of a column for a slider: the step is the smallest gap between different values; a constant is widened by 0.5 to both sides.

    Distinct values are put in buckets of 1,024th parts of the range; gaps are taken within buckets, and between their ends in a table of that size.
    """
    v = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).select(F.col(value).cast("double").alias("v")).distinct()
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    placed = v.crossJoin(F.broadcast(ends)).withColumn("b", F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 1024)).otherwise(0))
    inner = placed.withColumn("gap", F.col("v") - F.lag("v").over(W.partitionBy("b").orderBy("v")))
    of_bucket = inner.groupBy("b").agg(F.min("gap").alias("gap"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    outer = of_bucket.withColumn("gap", F.least("gap", F.col("lo") - F.lag("hi").over(W.orderBy("b"))))
    found = outer.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("gap").alias("step"))
    flat = F.col("lo") == F.col("hi")
    return found.select(F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"), "step")


def _pair_sums(points: DataFrame, keys: list[str], radius: float, bins: int) -> DataFrame:
    """Per stack and bin of distances: number of pairs of points(keys, x, y, c) with equal keys within the radius, of those with a product of c, and sums of products and of their squares. Points alike in all are counted first."""
    places = points.groupBy(*keys, "x", "y", "c").agg(F.count("*").alias("w"))
    side = lambda s: places.select(*keys, *(F.col(o).alias(f"{s}{o}") for o in ("x", "y", "c", "w")))
    place = lambda s: F.struct(f"{s}x", f"{s}y", f"{s}c")
    apart = grid_join(side("l"), side("r"), keys, radius, by_root=True).where(place("l") < place("r"))
    apart = apart.select("stack_id", "distance", (F.col("lw") * F.col("rw")).alias("w"), (F.col("lc") * F.col("rc")).alias("p"))
    # a point without a place, or at none, has no pair
    together = places.where("w > 1 and abs(x) < double('infinity') and abs(y) < double('infinity')").select("stack_id", F.lit(0.0).alias("distance"), F.expr("w * (w - 1) div 2").alias("w"), (F.col("c") * F.col("c")).alias("p"))
    bin_ = F.least(F.floor(F.col("distance") / (radius / bins)), F.lit(bins - 1)).cast("long")
    sums = {"n": F.col("w"), "m": F.when(F.col("p").isNotNull(), F.col("w")).otherwise(0), "p": F.coalesce(F.col("w") * F.col("p"), F.lit(0.0)), "pp": F.coalesce(F.col("w") * F.col("p") * F.col("p"), F.lit(0.0))}
    return apart.union(together).groupBy("stack_id", bin_.alias("bin")).agg(*(F.sum(v).alias(c) for c, v in sums.items()))


def autocorrelation(points: DataFrame, value: str, radius: float, bins: int, by_frame: bool = True) -> DataFrame:
    """Spatial autocorrelation of a value over points(stack_id, frame, particle, x, y): for each bin of distances, the mean product of centred values by the mean variance, its standard error and n.

    Values are centred in their frame, or else in their stack (the variance is the stack's, too). Pairs within the radius are summed by tiles of a frame, see
    pair_sums; the last bin is closed. Frames' means are a row a frame. Pairs of one particle do not count: they are made by a grid join and taken off.
    """
    within = FRAME if by_frame else ["stack_id"]
    whole = points.groupBy(*within).agg(F.avg(value).alias("_m"), F.var_pop(value).alias("_v"))
    whole = saved(whole)
    # broadcast, so that no task gets all points of a stack; read three times
    centred = saved(points.where("particle is not null").join(F.broadcast(whole), within).select(*FRAME, "particle", "x", "y", (F.col(value) - F.col("_m")).alias("c")))
    twice = centred.withColumn("_k", F.count("*").over(W.partitionBy(*FRAME, "particle"))).where("_k > 1").drop("_k")
    own = _pair_sums(twice, [*FRAME, "particle"], radius, bins)
    sums = pair_sums(centred, FRAME, radius, bins).union(own.select("stack_id", "bin", *(-F.col(c) for c in ("n", "m", "p", "pp"))))
    sums = sums.groupBy("stack_id", "bin").agg(*(F.sum(c).alias(c) for c in ("n", "m", "p", "pp"))).where("n > 0")
    mean = F.try_divide("p", "m")
    sums = sums.withColumn("mean", mean).withColumn("dev", F.sqrt(F.greatest(F.try_divide("pp", "m") - F.col("mean") * F.col("mean"), F.lit(0.0))))
    sums = sums.withColumn("dev", F.when(F.col("m") > 0, F.col("dev")))
    variance = whole.groupBy("stack_id").agg(F.avg("_v").alias("variance"))
    both = sums.join(variance, "stack_id")
    return both.select("stack_id", "bin", "n", F.try_divide("mean", "variance").alias("correlation"), F.try_divide(F.col("dev") / F.sqrt("n"), F.col("variance")).alias("error"))


def characteristic_length(acf: DataFrame, width: float, threshold: float = 0.36787944117144233) -> DataFrame:
    """The least distance (middle of a bin) at which the correlation is below the threshold, 1 / e."""
    return acf.where(F.col("correlation") < threshold).groupBy("stack_id").agg(F.min((F.col("bin") + 0.5) * width).alias("length"))


def first_below(bins: DataFrame, value: str, threshold: float, keys: list[str]) -> DataFrame:
    """First bin whose value is below the threshold, and the bin with the greatest value (the first, if equal)."""
    below = F.min(F.when(F.col(value) < threshold, F.col("bin"))).alias("first_below")
    return bins.groupBy(*keys).agg(below, F.max_by("bin", F.struct(F.col(value), -F.col("bin"))).alias("peak"))
