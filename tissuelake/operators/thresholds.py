"""Components of all thresholds of a plane at once, and the threshold that keeps most large components apart.

A plane is cut into strips of rows. Each task builds the component tree of its strip: a node for each part of pixels at or above a grey level, below
it the parts that it was made of. What does not reach a strip's border is settled there and leaves the task as changes of two counts; only the rest
goes on, and strips are joined a few at a time until a plane is one strip. No threshold is labelled anew.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .components import saved
from .zonal import FRAME

#: Pixels of a strip, about.
STRIP = 1 << 17
#: Strips that one task joins.
JOINED = 8
# kind 0: from level `value` on, `count` more parts and `large` more large ones; 1: an open node with its parent and own pixels; 2: a border pixel's node
_ROWS = "stack_id long, frame long, strip long, kind int, node long, parent long, value double, count long, large long, y long, x long"
_NAMES = [part.split()[0] for part in _ROWS.split(", ")]


def _tree(value: np.ndarray, count: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(top, parent, size) of a graph's nodes: the one node that stands for a level part, the next part that holds it (itself at a root) and the pixels from it upwards."""
    order = np.argsort(-value, kind="stable")
    rank = np.empty(len(value), np.int64)
    rank[order] = np.arange(len(value))
    # nodes are called by rank from here on: from the highest to the lowest
    ends = np.sort(rank[links], axis=1)
    ends = ends[np.argsort(ends[:, 1], kind="stable")].tolist()
    parent, up = list(range(len(value))), list(range(len(value)))
    for early, late in ends:
        root = early
        while up[root] != root:
            up[root] = up[up[root]]
            root = up[root]
        if root != late:
            parent[root] = up[root] = late
    size, level = count[order].tolist(), value[order].tolist()
    for n, p in enumerate(parent):
        if p != n:
            size[p] += size[n]
    top = list(range(len(parent)))
    for n in range(len(parent) - 1, -1, -1):
        p = parent[n]
        if p != n:
            parent[n] = top[p]
            if level[n] == level[p]:
                top[n] = top[p]
    back = lambda ranks: order[np.asarray(ranks, np.int64)][rank]
    return back(top), back(parent), np.asarray(size, np.int64)[rank]


def _settled(value: np.ndarray, count: np.ndarray, links: np.ndarray, border: np.ndarray, least: float) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray]:
    """Changes of counts from what no border node reaches, the nodes left (node, parent, value, count), and the nodes that stand for the border's."""
    top, parent, size = _tree(value, count, links)
    standing = top == np.arange(len(value))
    open_ = np.zeros(len(value), bool)
    for n in np.unique(top[border]).tolist():
        while not open_[n]:
            open_[n] = True
            n = parent[n]
    gone = standing & ~open_
    root = parent == np.arange(len(value))
    floor = np.where(root, -np.inf, value[parent])
    large = (size[gone] > least).astype(np.int64)
    changes = pd.DataFrame({"value": np.concatenate([floor[gone], value[gone]]), "count": np.repeat([1, -1], gone.sum()), "large": np.concatenate([large, -large])})
    changes = changes.groupby("value", as_index=False).sum()
    changes = changes[(changes["count"] != 0) | (changes["large"] != 0)]
    # own pixels of an open node: all above it but those above its open children
    kept = np.flatnonzero(open_)
    own = size.copy()
    below = kept[~root[kept]]
    np.subtract.at(own, parent[below], size[below])
    nodes = pd.DataFrame({"node": kept, "parent": parent[kept], "value": value[kept], "count": own[kept]})
    return changes, nodes, top[border]


def _packed(key: tuple, changes: pd.DataFrame, nodes: pd.DataFrame, border: pd.DataFrame) -> pd.DataFrame:
    parts = pd.concat([changes.assign(kind=0), nodes.assign(kind=1), border.assign(kind=2)], ignore_index=True)
    out = parts.assign(stack_id=key[0], frame=key[1], strip=key[2]).reindex(columns=_NAMES)
    whole = ["node", "parent", "count", "large", "y", "x"]
    return out.astype({c: "Int64" for c in whole})


def _first(rows: int, height: int, least: float):
    def build(key: tuple, pixels: pd.DataFrame) -> pd.DataFrame:
        pixels = pixels.sort_values(["y", "x"]).drop_duplicates(["y", "x"])
        y, x, value = (pixels[c].to_numpy() for c in ("y", "x", "value"))
        grid = np.full((y.max() - y.min() + 1, x.max() - x.min() + 1), -1)
        grid[y - y.min(), x - x.min()] = np.arange(len(y))
        sides = [np.stack([a.ravel(), b.ravel()], 1) for a, b in ((grid[:-1], grid[1:]), (grid[:, :-1], grid[:, 1:]))]
        links = np.concatenate(sides)
        links = links[(links >= 0).all(axis=1)]
        at = np.flatnonzero(((y % rows == 0) & (y > 0)) | ((y % rows == rows - 1) & (y < height - 1)))
        changes, nodes, stands = _settled(value, np.ones(len(y), np.int64), links, at, least)
        name = y * (1 << 31) + x
        nodes = nodes.assign(node=name[nodes["node"]], parent=name[nodes["parent"]])
        return _packed(key, changes, nodes, pd.DataFrame({"node": name[stands], "y": y[at], "x": x[at]}))

    return build


def _next(rows: int, height: int, least: float):
    def build(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        nodes, border = parts[parts["kind"] == 1], parts[parts["kind"] == 2]
        name = np.sort(nodes["node"].to_numpy(np.int64))
        nodes = nodes.sort_values("node")
        place = lambda c: np.searchsorted(name, c.to_numpy(np.int64))
        met = border.merge(border.assign(y=border["y"] - 1), on=["y", "x"])
        links = np.concatenate([np.stack([place(nodes["node"]), place(nodes["parent"])], 1), np.stack([place(met["node_x"]), place(met["node_y"])], 1)])
        y = border["y"].to_numpy(np.int64)
        outer = border[((y % rows == 0) & (y > 0)) | ((y % rows == rows - 1) & (y < height - 1))]
        changes, left, stands = _settled(nodes["value"].to_numpy(float), nodes["count"].to_numpy(np.int64), links, place(outer["node"]), least)
        left = left.assign(node=name[left["node"]], parent=name[left["parent"]])
        return _packed(key, changes, left, pd.DataFrame({"node": name[stands], "y": outer["y"].to_numpy(np.int64), "x": outer["x"].to_numpy(np.int64)}))

    return build


def levels(pixels: DataFrame, channel: str, least: float, strip: int = STRIP, joined: int = JOINED) -> DataFrame:
    """(stack_id, frame, level, n_parts, n_large): parts (joined by sides) of the pixels above each level at which the numbers change, and those of more than `least` pixels.

    A row holds from its level up to the next one. The lowest level is -infinity, all pixels. Pixels that are null, NaN or missing are above no
    level; of repeated pixels the first counts; planes begin at y = 0. An empty table gives an empty one.

    Strips have about `strip` pixels, and each round joins `joined` of them, so that a task holds a strip or the open nodes of a few borders.
    """
    whole = lambda c: F.col(c).cast("long").alias(c)
    own = pixels.select(*(whole(c) for c in (*FRAME, "y", "x")), F.col(channel).cast("double").alias("value")).where("value is not null and not isnan(value)")
    top, width = own.agg(F.max("y"), F.max("x") - F.min("x") + 1).first()
    height, rows = (top or 0) + 1, max(1, strip // (width or 1))
    found = saved(own.withColumn("strip", F.floor(F.col("y") / rows)).groupBy(*FRAME, "strip").applyInPandas(_first(rows, height, least), _ROWS))
    changes = found.where("kind = 0")
    while rows < height:
        rows *= joined
        up = found.where("kind <> 0").withColumn("strip", F.floor(F.col("strip") / joined))
        found = saved(up.groupBy(*FRAME, "strip").applyInPandas(_next(rows, height, least), _ROWS))
        changes = changes.union(found.where("kind = 0"))
    steps = changes.groupBy(*FRAME, F.col("value").alias("level")).agg(F.sum("count").alias("c"), F.sum("large").alias("l")).where("c <> 0 or l <> 0")
    upto = W.partitionBy(*FRAME).orderBy("level").rowsBetween(W.unboundedPreceding, 0)
    kinds = dict(pixels.dtypes)
    return steps.select(*(F.col(c).cast(kinds[c]).alias(c) for c in FRAME), "level", F.sum("c").over(upto).alias("n_parts"), F.sum("l").over(upto).alias("n_large"))


def automatic(pixels: DataFrame, channel: str, least: float, noise: float = 0.02, percentiles: tuple[float, float] = (0.5, 0.95), strip: int = STRIP) -> DataFrame:
    """(stack_id, frame, threshold, score): the threshold between two percentiles (0 to 100) of a plane at which large parts less `noise` times all parts are most; the lowest of several.

    Parts are those of the pixels above the threshold. The score is constant between two levels, so that trying each level is exact. A plane without
    values has no row.
    """
    value = F.col(channel).cast("double")
    known = pixels.where(value.isNotNull() & ~F.isnan(value))
    bounds = known.groupBy(*FRAME).agg(F.percentile(value, F.array(*(F.lit(p / 100) for p in percentiles))).alias("q"))
    spans = levels(pixels, channel, least, strip).withColumn("upto", F.lead("level").over(W.partitionBy(*FRAME).orderBy("level")))
    within = spans.join(bounds, FRAME).where("level <= q[1] and (upto is null or upto > q[0])")
    # parts and large parts as whole numbers, so that equal scores are equal
    scored = within.select(*FRAME, F.greatest("level", F.col("q")[0]).alias("threshold"), F.round(F.col("n_large") - noise * F.col("n_parts"), 9).alias("score"))
    return scored.groupBy(*FRAME).agg(F.max_by(F.struct("threshold", "score"), F.struct("score", -F.col("threshold"))).alias("b")).select(*FRAME, "b.threshold", "b.score")
