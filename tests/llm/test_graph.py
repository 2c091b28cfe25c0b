"""Components of link tables against plain union-find, and how many jobs they take."""

import random
import uuid

import pytest

from tissuelake.llm import graph


def _plain(links):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up if root(x) != x}


def _links():
    """A chain out of order, a hub, small parts, self-links and null ends."""
    rng = random.Random(7)
    chain = list(range(0, 600, 2))
    rng.shuffle(chain)
    links = list(zip(chain, chain[1:], strict=False))
    links += [(5001, 10_001 + 2 * i) for i in range(400)]
    links += [(rng.randrange(100_000, 100_300), rng.randrange(100_000, 100_300)) for _ in range(120)]
    links += [(7, 7), (None, 3), (3, None), (-4, 900_001)]
    rng.shuffle(links)
    return links


def _found(spark, links):
    """(components, number of jobs) with each of 16 tasks holding a few links."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        rows = graph.components(spark.createDataFrame(links, "a long, b long").repartition(16)).collect()
        return rows, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("one_task", [graph.ONE_TASK, 0])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    links = _links()
    rows, _ = _found(spark, links)
    assert len(rows) == len({r["node"] for r in rows})
    assert {r["node"]: r["component"] for r in rows} == _plain(links)
    assert _found(spark, [])[0] == []


def test_few_links_take_few_jobs(spark):
    # by rounds this chain takes several times as many, each with a dozen shuffles
    assert _found(spark, _links())[1] <= 12


def test_hubs_take_one_job_and_not_one_a_partition(spark, monkeypatch):
    monkeypatch.setattr(graph, "ONE_TASK", 0)
    monkeypatch.setattr(graph, "_local_forest", lambda batches: (b.rename_columns(["u", "v"]) for b in batches))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        links = [(i, 1_000) for i in range(200)]
        rows, jobs = _found(spark, links)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r["node"]: r["component"] for r in rows} == _plain(links)
    assert jobs < 100
