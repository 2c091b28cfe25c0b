"""Colours of graphs and heaviest sets without conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import dropped, saved


def colours(nodes: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """nodes(keys..., id) with a colour from 0 that no neighbour has; links are pairs (keys..., a, b) of different ids, either way round.

    The colours are those of the greedy rule that takes nodes by falling degree, then id, and gives each the smallest colour free: a node is
    coloured as soon as all its neighbours before it are, so that a round colours all nodes that wait for none. At most greatest degree + 1
    colours; null ends and self-links are ignored. Rounds are as many as the longest chain of falling degrees, and each table goes once the
    next is written.
    """
    both = links.where("a <> b").select(*keys, "a", "b").union(links.where("a <> b").select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    degrees = both.groupBy(*keys, F.col("a").alias("id")).agg(F.count("*").alias("degree"))
    own = saved(nodes.select(*keys, "id").distinct().join(degrees, [*keys, "id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0))))
    side = lambda name: own.select(*keys, F.col("id").alias(name), F.struct(-F.col("degree"), "id").alias(f"at_{name}"))
    # each node with the neighbours that come before it
    waits = saved(both.join(side("a"), [*keys, "a"]).join(side("b"), [*keys, "b"]).where("at_b < at_a").select(*keys, F.col("a").alias("id"), F.col("b").alias("before")))
    state = saved(own.select(*keys, "id", F.lit(None).cast("int").alias("colour")))
    while not state.where("colour is null").isEmpty():
        known = state.select(*keys, F.col("id").alias("before"), F.col("colour").alias("c"))
        met = waits.join(state.where("colour is null").select(*keys, "id"), [*keys, "id"], "left_semi").join(known, [*keys, "before"])
        met = met.groupBy(*keys, "id").agg(F.count_if(F.col("c").isNull()).alias("open"), F.collect_set("c").alias("taken"))
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("taken")), "taken"))
        new = F.coalesce("colour", F.when(F.coalesce("open", F.lit(0)) == 0, F.coalesce(free, F.lit(0))))
        step = saved(state.join(met, [*keys, "id"], "left").select(*keys, "id", new.cast("int").alias("colour")))
        dropped(state)
        state = step
    return state


def heaviest(options: list[list[tuple[float, frozenset]]]) -> list[tuple[int, int]]:
    """One option at most of each list, no two with a member in common, with the greatest sum of weights: (list, option) of the chosen ones.

    The lists are taken in an order that keeps few members open, that is, met by a list before and one to come. For each set of open
    members in use only the best choice so far is kept, and none that another one with fewer members in use outweighs. So chains of any
    length cost their length times the choices at one link.
    """
    last: dict = {}
    order, rest, open_ = [], set(range(len(options))), set()
    members = [frozenset().union(*(m for _, m in o)) if o else frozenset() for o in options]
    holders: dict = {}
    for i, m in enumerate(members):
        for x in m:
            holders.setdefault(x, set()).add(i)
    while rest:
        near = {j for x in open_ for j in holders[x] if j in rest} or rest
        grows = lambda i: (sum(bool((holders[x] & rest) - {i}) for x in open_ | members[i]), i)
        best = min(near, key=grows)
        rest.discard(best)
        order.append(best)
        open_ = {x for x in open_ | members[best] if holders[x] & rest}
    for place, i in enumerate(order):
        for x in members[i]:
            last[x] = place
    states: dict[frozenset, tuple[float, tuple | None]] = {frozenset(): (0.0, None)}
    for place, i in enumerate(order):
        after: dict[frozenset, tuple[float, tuple | None]] = {}
        for used, (weight, chain) in states.items():
            choices = [(weight, used, chain)] + [(weight + w, used | m, ((i, k), chain)) for k, (w, m) in enumerate(options[i]) if not m & used]
            for total, now, path in choices:
                now = frozenset(x for x in now if last[x] > place)
                if now not in after or total > after[now][0]:
                    after[now] = (total, path)
        kept: list[tuple[frozenset, float]] = []
        for used in sorted(after, key=lambda s: (len(s), -after[s][0], sorted(map(repr, s)))):
            if not any(w >= after[used][0] and s <= used for s, w in kept):
                kept.append((used, after[used][0]))
        states = {s: after[s] for s, _ in kept}
    chain = max(states.values(), key=lambda v: v[0])[1]
    chosen = []
    while chain is not None:
        chosen.append(chain[0])
        chain = chain[1]
    return chosen
