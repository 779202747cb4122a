import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from assay.operators import graph, lineage

EDGE = "source string, target string"


def bfs(adj, start):
    seen, queue = set(), deque(adj.get(start, ()))
    while queue:
        cur = queue.popleft()
        if cur not in seen:
            seen.add(cur)
            queue.extend(adj.get(cur, ()))
    return seen


def adjacency(edges):
    adj = {}
    for s, t in edges:
        adj.setdefault(s, []).append(t)
    return adj


def random_edges(seed, nodes, count, acyclic):
    rng = random.Random(seed)
    out = set()
    while len(out) < count:
        a, b = rng.randrange(nodes), rng.randrange(nodes)
        if not acyclic or a < b:
            out.add((f"n{a}", f"n{b}"))
    return sorted(out)


@pytest.mark.parametrize("seed,acyclic", [(1, True), (2, False)])
def test_reach_equals_bfs(spark, seed, acyclic):
    edges = random_edges(seed, 14, 22, acyclic)
    starts = [f"n{i}" for i in range(0, 14, 3)]
    got = {}
    for r in graph.reach(spark.createDataFrame(edges, EDGE), spark.createDataFrame([(s,) for s in starts], "start string")).collect():
        assert r.node not in got.setdefault(r.start, set())
        got[r.start].add(r.node)
    for s in starts:
        assert got.get(s, set()) == bfs(adjacency(edges), s)


@pytest.mark.parametrize("seed,acyclic", [(3, True), (4, False)])
def test_root_causes_equal_search(spark, seed, acyclic):
    edges = random_edges(seed, 16, 22, acyclic)
    rng = random.Random(seed)
    health = {f"n{i}": rng.choice(["fail", "ok", "warn"]) for i in range(16)}
    down, up = adjacency(edges), adjacency([(t, s) for s, t in edges])
    failing = {n for n, h in health.items() if h == "fail"}
    expected = {n: len(bfs(down, n)) for n in failing if not ((bfs(up, n) - {n}) & failing)}
    nodes = spark.createDataFrame(list(health.items()), "external_id string, health_status string")
    got = {r.external_id: r.downstream_impact_count for r in graph.root_causes(nodes, spark.createDataFrame(edges, EDGE)).collect()}
    assert got == expected


def one_by_one(existing, candidates):
    confirmed = {(s, t) for s, t, st in existing if st == "confirmed"}
    known, out = {(s, t) for s, t, _ in existing}, {}
    for s, t, st, rank in sorted(candidates, key=lambda c: c[3]):
        if (s, t) in known:
            out[rank] = "existed"
        elif st != "confirmed":
            known.add((s, t))
            out[rank] = "suggested"
        elif s == t or s in bfs(adjacency(confirmed), t):
            # A rejected edge is not stored, so a later copy is tried and rejected again.
            out[rank] = "cycle"
        else:
            known.add((s, t))
            confirmed.add((s, t))
            out[rank] = "confirmed"
    return out


@pytest.mark.parametrize("seed", [5, 6])
def test_accepting_edges_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    pairs = random_edges(seed, 8, 26, False)
    rng.shuffle(pairs)
    existing = [(s, t, "confirmed") for s, t in random_edges(seed + 50, 8, 5, True)]
    candidates = [(s, t, "suggested" if rng.random() < 0.1 else "confirmed", i) for i, (s, t) in enumerate(pairs)]
    schema = EDGE + ", status string"
    got = {r["rank"]: r.outcome for r in graph.accept_edges(
        spark.createDataFrame(existing, schema), spark.createDataFrame(candidates, schema + ", rank int")).collect()}
    assert got == one_by_one(existing, candidates)


def test_conflicts_on_separate_cycles_take_no_further_rounds(spark, monkeypatch):
    """Pairs of siblings that exclude each other, down a tree: those above reach those below, but share no cycle with them."""
    existing = [(f"n{i // 3}", f"n{i}", "confirmed") for i in range(1, 27)]
    pairs = [p for i in range(3, 26, 3) for p in ((f"n{i}", f"n{i + 1}"), (f"n{i + 1}", f"n{i}"))] + [("n26", "n0"), ("n0", "n12")]
    candidates = [(*p, "confirmed", i) for i, p in enumerate(pairs)]
    calls, search = [], graph.closes_cycle
    monkeypatch.setattr(graph, "closes_cycle", lambda *args, **kwargs: calls.append(1) or search(*args, **kwargs))
    schema = EDGE + ", status string"
    got = {r["rank"]: r.outcome for r in graph.accept_edges(
        spark.createDataFrame(existing, schema), spark.createDataFrame(candidates, schema + ", rank int")).collect()}
    assert got == one_by_one(existing, candidates) and len(calls) == 4


def test_demo_graph(spark):
    nodes = [("s", "SILVER", "table", "fail"), ("g1", "GOLD", "table", "fail"), ("g2", "GOLD", "table", "warn"), ("r1", "GOLD", "report", "fail"),
             ("r2", "GOLD", "report", "warn"), ("m1", "GOLD", "model", "fail"), ("m2", "GOLD", "model", "warn"), ("m3", "GOLD", "model", "warn"),
             ("alone", "RAW", "table", "fail")]
    edges = [("s", "g1"), ("s", "g2"), ("g1", "r1"), ("g1", "r2"), ("g1", "m1"), ("g1", "m2"), ("g2", "m3")]
    n = spark.createDataFrame(nodes, "external_id string, layer string, node_type string, health_status string").selectExpr("*", "external_id AS label")
    e = spark.createDataFrame(edges, EDGE).selectExpr("*", "'confirmed' AS status")
    roots = [(r.external_id, r.downstream_impact_count) for r in graph.root_causes(n, e).collect()]
    assert roots == [("s", 7), ("alone", 0)]
    hops = {r.depth: (r.downstream, r.reports) for r in graph.blast_radius(e, n, spark.createDataFrame([("s",), ("nowhere",)], "start string")).collect()}
    assert hops == {1: (2, 0), 2: (5, 2)}
    sources = {r.external_id for r in lineage.mark_sources(n, e).filter("is_source").collect()}
    assert sources == {"s", "alone"}
    imp = {r.external_id: (r.severity, r.downstream_count) for r in lineage.impact(n, e, n).collect()}
    assert imp["s"] == ("critical", 7) and imp["g2"] == ("medium", 1) and imp["r1"] == ("high", 0) and imp["r2"] == ("low", 0)
    unknown_nodes, unknown_edges = graph.downstream_graph(e, n, "nowhere")
    assert unknown_nodes.count() == 0 and unknown_edges.count() == 0


def test_paths_stop_before_repeating(spark):
    n = spark.createDataFrame([(x,) for x in "abcdx"], "external_id string")
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("a", "d"), ("c", "unlisted")], EDGE)
    got = sorted("".join(r.path) for r in graph.paths(n, e).collect())
    assert got == ["abc", "ad", "x"]


def test_fk_and_log_edges(spark):
    c = spark.createDataFrame([("k", "p", "c", ["id"], ["pid"]), ("self", "p", "p", ["id"], ["up"])],
                              "constraint_name string, parent_fqn string, child_fqn string, parent_columns array<string>, child_columns array<string>")
    assert [(r.source, r.target, r.evidence) for r in lineage.fk_edges(c).collect()] == [("p", "c", "declared key k, c(pid) refers to p(id)")]
    log = spark.createDataFrame([("a", "b", 1, "x"), ("a", "c", 2, "x"), ("a", "c", 2, "y"), ("b", "c", 5, "z"), ("a", "zz", 9, "z"), ("a", "a", 9, "z")],
                                EDGE + ", execution_count int, query_text string")
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "table_fqn string")
    assert sorted((r.source, r.target, r.confidence) for r in lineage.query_log_edges(log, known).collect()) == [
        ("a", "b", 0.6), ("a", "c", 0.75), ("b", "c", 0.9)]


def test_equal_names_of_two_connections_are_different_nodes(spark):
    nodes = spark.createDataFrame([(c, n, h) for c in "xy" for n, h in (("a", "fail" if c == "x" else "ok"), ("b", "fail"), ("c", "ok"))], "connection_id string, external_id string, health_status string")
    edges = spark.createDataFrame([("x", "a", "b"), ("y", "b", "c")], "connection_id string, source string, target string")
    e, n = graph.qualified(edges, "source", "target"), graph.qualified(nodes, "external_id")
    roots = graph.unqualified(graph.root_causes(n, e), "external_id")
    assert {(r.connection_id, r.external_id, r.downstream_impact_count) for r in roots.collect()} == {("x", "a", 1), ("y", "b", 1)}
    want = graph.qualified(spark.createDataFrame([("x", "c", "a"), ("x", "b", "a"), ("y", "c", "b"), ("y", "b", "a")], "connection_id string, source string, target string"), "source", "target")
    cycles = graph.unqualified(graph.closes_cycle(e, want), "source", "target")
    assert {(r.connection_id, r.source, r.target) for r in cycles.collect()} == {("x", "b", "a"), ("y", "c", "b")}
    down = graph.unqualified(graph.reach(e, n.select(F.col("external_id").alias("start"))), "start", "node")
    assert {(r.connection_id, r.start, r.node) for r in down.collect()} == {("x", "a", "b"), ("y", "b", "c")}


def test_cycles_of_a_wide_graph_are_found_among_what_is_left(spark):
    """A tree of 30 000 edges with as many candidates, three of which close a cycle."""
    tree = spark.range(1, 30_000).select((F.floor(F.col("id") / 30)).cast("string").alias("source"), F.col("id").cast("string").alias("target"))
    side = spark.range(1, 30_000).select(F.col("id").cast("string").alias("source"), F.concat(F.lit("leaf"), F.col("id").cast("string")).alias("target"))
    back = spark.createDataFrame([("29999", "0"), ("31", "1"), ("5", "5")], "source string, target string")
    assert {(r.source, r.target) for r in graph.closes_cycle(tree, side.unionByName(back)).collect()} == {("29999", "0"), ("31", "1"), ("5", "5")}


def test_long_chain_in_few_tables(spark):
    chain = spark.range(40).select(F.col("id").cast("string").alias("source"), (F.col("id") + 1).cast("string").alias("target"))
    found = graph.reach(chain, spark.createDataFrame([("0",)], "start string"))
    assert found.count() == 40 and found.agg(F.max("depth")).first()[0] == 40
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= graph.COMPACT_STEPS + 1


@pytest.mark.parametrize("seed", [7, 8])
def test_root_causes_of_copied_edges_send_each_label_once(spark, monkeypatch, seed):
    """One search for both labels; nodes that lead nowhere take part in none. Copies of edges and cycles change nothing."""
    rng = random.Random(seed)
    inner = random_edges(seed, 12, 15, False) + [("n0", "n0")]
    edges = inner + [(f"n{rng.randrange(12)}", f"leaf{i % 20}") for i in range(40)]
    health = {n: rng.choice(["fail", "ok"]) for n in [*(f"n{i}" for i in range(12)), *(f"leaf{i}" for i in range(22))]}
    down, up = adjacency(edges), adjacency([(t, s) for s, t in edges])
    failing = {n for n, h in health.items() if h == "fail"}
    expected = {n: len(bfs(down, n)) for n in failing if not ((bfs(up, n) - {n}) & failing)}
    searches, begun = [], []
    search, number = graph.spread, graph.numbered
    monkeypatch.setattr(graph, "spread", lambda *args, **kwargs: searches.append(1) or search(*args, **kwargs))
    monkeypatch.setattr(graph, "numbered", lambda starts: begun.extend(r.start for r in starts.collect()) or number(starts))
    nodes = spark.createDataFrame(list(health.items()), "external_id string, health_status string")
    got = {r.external_id: r.downstream_impact_count for r in graph.root_causes(nodes, spark.createDataFrame(edges + edges, EDGE)).collect()}
    assert got == expected
    assert len(searches) == 1 and set(begun) == {n for n in expected if n in down}


def test_candidates_that_one_edge_answers_are_not_searched(spark, monkeypatch):
    """Orders that would feed their own customer or another one: no edge leaves an order, so nothing is left to search for."""
    edges = spark.createDataFrame([("c1", "o1"), ("c1", "o2"), ("c2", "o3"), ("root", "c1"), ("root", "c2"), ("c2", "o3")], EDGE)
    wanted = [("o1", "c1"), ("o2", "c2"), ("o3", "c2"), ("o3", "c3"), ("o9", "o9"), ("o1", "c1"), (None, "c1"), ("o1", None)]

    def search(*_):
        raise AssertionError("searched")

    with monkeypatch.context() as patched:
        patched.setattr(graph, "reaching_pairs", search)
        got = [(r.source, r.target) for r in graph.closes_cycle(edges, spark.createDataFrame(wanted, EDGE)).collect()]
    assert sorted(got) == [("o1", "c1"), ("o3", "c2"), ("o9", "o9")]
    both = [(r.source, r.target) for r in graph.closes_cycle(edges, spark.createDataFrame([("o2", "root"), ("o1", "c1"), ("c1", "c2")], EDGE)).collect()]
    assert sorted(both) == [("o1", "c1"), ("o2", "root")]


@pytest.mark.parametrize("seed", [9, 10])
def test_closing_candidates_equal_search(spark, seed):
    edges, wanted = random_edges(seed, 12, 16, False), random_edges(seed + 20, 12, 40, False)
    down = adjacency(edges)
    got = [(r.source, r.target) for r in graph.closes_cycle(spark.createDataFrame(edges, EDGE), spark.createDataFrame(wanted, EDGE)).collect()]
    assert sorted(got) == sorted((s, t) for s, t in wanted if s == t or s in bfs(down, t))
