"""Bit masks, contracted chains, components and labels against plain searches."""

import random

import pytest
from pyspark.sql import functions as F

from assay.operators import graph, lineage, reachability
from test_graph import EDGE, adjacency, bfs, random_edges


def jobs_of(spark, name, run):
    """Result of ``run`` and how many Spark jobs it took."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = run()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def depths(edges, start):
    adj, seen, level, depth = adjacency(edges), {}, {start}, 0
    while level:
        depth += 1
        level = {t for n in level for t in adj.get(n, ())} - set(seen)
        seen.update({n: depth for n in level})
    return seen


def bushy_chains(seed):
    """Random edges among a few nodes, some of them drawn out into chains, and a circle of its own."""
    rng, out = random.Random(seed), []
    for i, (a, b) in enumerate(random_edges(seed, 12, 20, False)):
        way = [a, *[f"c{i}_{k}" for k in range(rng.choice([0, 0, 1, 5, 17]))], b]
        out += zip(way, way[1:])
    return out + [("loop1", "loop2"), ("loop2", "loop1")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_reach_over_contracted_chains(spark, monkeypatch, seed):
    monkeypatch.setattr(graph, "COMPACT_STEPS", 1)
    edges = bushy_chains(seed)
    starts = ["n0", "n5", edges[20][0], "loop1", "nowhere"]
    found = graph.reach(spark.createDataFrame(edges, EDGE), spark.createDataFrame([(s,) for s in starts], "start string"))
    got = {s: {} for s in starts}
    for r in found.collect():
        assert r.node not in got[r.start]
        got[r.start][r.node] = r.depth
    assert got == {s: depths(edges, s) for s in starts}


def test_chain_of_two_thousand_in_few_jobs(spark):
    chain = spark.range(2000).select(F.col("id").cast("string").alias("source"), (F.col("id") + 1).cast("string").alias("target"))
    found, jobs = jobs_of(spark, "chain", lambda: graph.reach(chain, spark.createDataFrame([("0",)], "start string")).agg(
        F.count("*").alias("n"), F.max("depth").alias("far"), F.count_if(F.col("depth") == F.col("node").cast("int")).alias("right")).first())
    assert tuple(found) == (2000, 2000, 2000)
    assert jobs < 400


def test_ten_thousand_failing_roots(spark):
    roots = spark.range(10_000).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("source"), F.concat(F.lit("m"), (F.col("id") % 100).cast("string")).alias("target"))
    mids = spark.range(100).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("source"), F.lit("end").alias("target"))
    edges = roots.unionByName(mids)
    nodes = roots.select(F.col("source").alias("external_id"), F.lit("fail").alias("health_status")).unionByName(
        mids.select(F.col("source").alias("external_id"), F.lit("ok").alias("health_status")))
    out = graph.root_causes(nodes, edges)
    assert out.count() == 10_000 and out.filter("downstream_impact_count <> 2").count() == 0
    starts = reachability.numbered(roots.select(F.col("source").alias("start")))
    masks, ended = reachability.masks_from(graph.edge_set(edges), starts)
    assert ended and masks.agg(F.sum(F.bit_count("mask"))).first()[0] == 20_000
    assert masks.filter("node = 'end'").count() <= 10_000 / 64 + 8


@pytest.mark.parametrize("seed,count", [(1, 14), (2, 30), (3, 60)])
def test_components_equal_mutual_reach(spark, seed, count):
    edges = random_edges(seed, 24, count, False)
    found = {r.node: r.component for r in reachability.strong_components(spark.createDataFrame(edges, EDGE)).collect()}
    reach = {n: bfs(adjacency(edges), n) for n in {x for e in edges for x in e}}
    together = {(a, b) for a in reach for b in reach if a != b and b in reach[a] and a in reach[b]}
    assert {(a, b) for a in found for b in found if a != b and found[a] == found[b]} == together


@pytest.mark.parametrize("seed,steps", [(1, 0), (2, 1)])
def test_reaching_pairs_by_search_and_by_index(spark, monkeypatch, seed, steps):
    monkeypatch.setattr(reachability, "SHALLOW_STEPS", steps)
    edges = bushy_chains(seed) + [("n3", "n3")]
    every = sorted({x for e in edges for x in e})
    names = [n for n in every if n.startswith("n")] + ["loop1", *random.Random(seed).sample(every, 3)]
    rng = random.Random(seed)
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(120)] + [(n, n) for n in names] + [("n1", "nowhere"), ("nowhere", "n1")]
    got = {tuple(r) for r in reachability.reaching_pairs(spark.createDataFrame(edges, EDGE), spark.createDataFrame(pairs, "start string, node string")).collect()}
    reach = {n: bfs(adjacency(edges), n) for n in names}
    assert got == {(a, b) for a, b in pairs if b in reach.get(a, ())}


def test_dense_core_in_a_bounded_number_of_jobs(spark):
    """100 000 edges in eight blocks, each strongly connected and feeding the next, and 100 000 candidates."""
    rng = random.Random(7)
    node = lambda block: f"{block * 250 + rng.randrange(250):04d}"
    edges = [(f"{b * 250 + i:04d}", f"{b * 250 + (i + 1) % 250:04d}") for b in range(8) for i in range(250)]
    edges += [(node(b), node(b)) for b in range(8) for _ in range(9000)] + [(node(b), node(b + 1)) for b in range(7) for _ in range(3800)]
    candidates = {(f"{rng.randrange(2000):04d}", f"{rng.randrange(2000):04d}") for _ in range(100_000)}
    closing, jobs = jobs_of(spark, "dense", lambda: {tuple(r) for r in graph.closes_cycle(spark.createDataFrame(edges, EDGE), spark.createDataFrame(sorted(candidates), EDGE)).collect()})
    assert closing == {(s, t) for s, t in candidates if int(t) // 250 <= int(s) // 250}
    assert jobs < 900


@pytest.mark.parametrize("shown", [2, 5, None])
def test_impact_names_the_nearest(spark, shown):
    edges = random_edges(4, 40, 70, False)
    names = [f"n{i}" for i in range(36)]  # four nodes of the graph are not listed
    nodes = spark.createDataFrame([(n, n.upper(), "fail") for n in names], "external_id string, label string, health_status string")
    e = spark.createDataFrame(edges, EDGE).withColumn("status", F.lit("confirmed"))
    for r in lineage.impact(nodes, e, nodes, shown).collect():
        far = depths(edges, r.external_id)
        near = [n for _, n in sorted((d, n) for n, d in far.items() if n in names and n != r.external_id)]
        assert r.downstream_count == len(near)
        if near:
            listed = near if shown is None else near[:shown]
            more = f" and further ones: {len(near) - shown}" if shown is not None and len(near) > shown else ""
            assert r.bullets[1] == f"Dependents: {len(near)}, namely {', '.join(n.upper() for n in listed)}{more}"


def slow_paths(names, edges):
    adj, entered = adjacency(sorted(set(edges))), {t for _, t in edges}

    def down(n):
        if n not in adj:
            yield (n,)
        for t in adj.get(n, ()):
            if t in names:
                for rest in down(t):
                    yield (n, *rest)

    return [p for n in sorted(names) if n not in entered for p in down(n)]


@pytest.mark.parametrize("first,number", [(0, 10_000), (7, 9), (500, 3)])
def test_numbered_paths(spark, first, number):
    edges = random_edges(9, 15, 34, True) + [("n2", "unlisted"), ("n9", "dead end")]
    names = {f"n{i}" for i in range(16)}
    expected = slow_paths(names, edges)
    nodes = spark.createDataFrame([(n,) for n in names], "external_id string")
    found = graph.numbered_paths(nodes, spark.createDataFrame(edges, EDGE), first, number).collect()
    assert sorted((r.no, tuple(r.path)) for r in found) == list(enumerate(expected))[first:first + number]


def test_numbered_paths_beyond_counting(spark):
    """2 to the power of 60 paths, of which three from the middle are made."""
    edges = [(f"{i:03d}{a}", f"{i + 1:03d}{b}") for i in range(60) for a in "ab" for b in "ab"]
    nodes = spark.createDataFrame(sorted({(x,) for e in edges for x in e}), "external_id string")
    total = 1 << 61
    found = graph.numbered_paths(nodes, spark.createDataFrame(edges, EDGE), total - 3, 10).orderBy("no").collect()
    assert [r.no for r in found] == [total - 3, total - 2, total - 1]
    assert [r.path[-2:] for r in found] == [["059a", "060b"], ["059b", "060a"], ["059b", "060b"]]
    assert all(r.path[:59] == [f"{i:03d}b" for i in range(59)] for r in found)


def test_numbered_paths_refuse_cycles(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "external_id string")
    with pytest.raises(ValueError, match="cycle"):
        graph.numbered_paths(nodes, spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], EDGE), 0, 5)
