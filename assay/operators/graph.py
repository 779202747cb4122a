"""Reachability over lineage edges.

Edges are (source, target) and may contain cycles, diamonds and self loops.
How values travel along edges stands in :mod:`assay.operators.reachability`.

Starts are always restricted to what a question needs: all-pairs closure is
quadratic and no operator here computes it.  Where only counts or decisions are
asked for, no table of (start, node) rows is made either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assay.operators.reachability import (COMPACT_STEPS, contracted, counts_per_start, masks_from, measured, numbered, reaching_pairs, reversed_edges, spread, trimmed, union,
                                          without_own)
from assay.session import staged_table

_SEPARATOR = "\u001f"
_WIDE = "decimal(38,0)"


def edge_set(edges: DataFrame) -> DataFrame:
    """Distinct (source, target), materialised once for the following steps.

    The rows stay spread by both ends: a hub's edges are not put into one
    partition.
    """
    return staged_table(edges.select("source", "target").distinct())


def qualified(df: DataFrame, *ids: str) -> DataFrame:
    """Ids with their connection in front, so that equal names of two connections are different nodes."""
    return df.withColumns({c: F.concat_ws(_SEPARATOR, F.coalesce("connection_id", F.lit("")), F.col(c)) for c in ids})


def unqualified(df: DataFrame, *ids: str) -> DataFrame:
    """Undo :func:`qualified`: plain ids and their ``connection_id``."""
    part = lambda c, n: F.split(F.col(c), _SEPARATOR, 2)[n]
    named = df.withColumn("connection_id", F.nullif(part(ids[0], 0), F.lit("")))
    return named.withColumns({c: part(c, 1) for c in ids})


def reach(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, ready: bool = False) -> DataFrame:
    """(start, node, depth) for every node reachable in one step or more.

    ``starts`` has a column ``start``; ``depth`` is the first step at which the
    node is seen.  A start that lies on a cycle reaches itself.  ``ready`` says
    that ``edges`` is an :func:`edge_set` already.  What is not found in a few
    steps is reached over contracted chains, whose nodes are filled in afterwards.
    """
    e = edges if ready else edge_set(edges)
    frontier, sent, going = measured(starts.select(F.col("start"), F.col("start").alias("node")).distinct())
    found: list[DataFrame] = []
    depth = 0
    while going and (max_depth is None or depth < max_depth):
        if max_depth is None and depth == COMPACT_STEPS:
            return _reach_further(e, staged_table(union(found)), frontier, depth)
        depth += 1
        step = e.join(sent, F.col("node") == F.col("source")).select("start", F.col("target").alias("node")).distinct()
        if found:
            step = step.join(union(found).select("start", "node"), ["start", "node"], "left_anti")
        frontier, sent, going = measured(step.select("start", "node"))
        if going:
            found.append(frontier.withColumn("depth", F.lit(depth)))
        if len(found) > COMPACT_STEPS:
            found = [staged_table(union(found))]
    if not found:
        return frontier.filter(F.lit(False)).withColumn("depth", F.lit(0))
    return union(found)


def _reach_further(e: DataFrame, found: DataFrame, frontier: DataFrame, depth: int) -> DataFrame:
    """``found`` (start, node, depth) and all that lies beyond ``frontier`` (start, node), its nodes at ``depth``."""
    ways, passed = contracted(e, frontier.select("node").distinct())
    known = staged_table(found.withColumn("depth", F.col("depth").cast("long")))
    step, sent, going = measured(frontier.withColumn("depth", F.lit(depth).cast("long")))
    left = [step]
    while going:
        longer = ways.join(sent, F.col("node") == F.col("source")).groupBy("start", F.col("target").alias("node")).agg(F.min(F.col("depth") + F.col("length")).alias("depth"))
        before = known.withColumnRenamed("depth", "_depth")
        better = longer.join(before, ["start", "node"], "left").filter(F.col("_depth").isNull() | (F.col("depth") < F.col("_depth"))).select("start", "node", "depth")
        step, sent, going = measured(better)
        if going:
            left.append(step)
            known = staged_table(known.unionByName(step).groupBy("start", "node").agg(F.min("depth").alias("depth")))
    inside = union(left).join(passed.select(F.col("node").alias("_node"), F.col("head").alias("node"), "position"), "node").select(
        "start", F.col("_node").alias("node"), (F.col("depth") + F.col("position")).alias("depth"))
    return known.unionByName(inside).groupBy("start", "node").agg(F.min("depth").cast("int").alias("depth"))


def reach_both(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Everything upstream and downstream of each start."""
    down = reach(edges, starts).withColumn("direction", F.lit("down"))
    up = reach(reversed_edges(edges), starts).withColumn("direction", F.lit("up"))
    return down.unionByName(up)


def blast_radius(edges: DataFrame, nodes: DataFrame, starts: DataFrame, hops: int = 3) -> DataFrame:
    """Nodes and reports per hop, up to ``hops``; unknown starts give nothing."""
    known = numbered(starts.join(nodes.select(F.col("external_id").alias("start")).distinct(), "start", "left_semi"))
    masks = without_own(masks_from(edge_set(edges), known, hops)[0], known)
    kinds = nodes.select(F.col("external_id").alias("node"), "node_type")
    counts = {"downstream": F.lit(True), "reports": F.coalesce(F.col("node_type") == "report", F.lit(False))}
    return counts_per_start(masks.join(kinds, "node", "left"), known, counts, ("depth",))


def downstream_graph(edges: DataFrame, nodes: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges reachable from ``root``, both empty if it is unknown."""
    start = nodes.filter(F.col("external_id") == root).select(F.col("external_id").alias("start")).distinct()
    reached = reach(edges, start).select(F.col("node").alias("external_id"), "depth")
    first = start.select(F.col("start").alias("external_id"), F.lit(0).alias("depth"))
    ids = first.unionByName(reached).groupBy("external_id").agg(F.min("depth").alias("depth"))
    inside = nodes.join(ids, "external_id")
    kept = (edges.join(ids.select(F.col("external_id").alias("source")), "source", "left_semi")
            .join(ids.select(F.col("external_id").alias("target")), "target", "left_semi"))
    return inside, kept


def root_causes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Failing nodes without another failing node upstream, by downstream count.

    Whether a failing node has a failing ancestor is found by spreading the least
    and the greatest label from failing nodes up to the next failing node, which
    is linear in the edges.  What the roots reach is counted 64 roots at a time.
    Nodes that lead nowhere, which are often most of them, send nothing.
    """
    e = staged_table(edges.select("source", "target"))
    leading = staged_table(e.select(F.col("source").alias("node")).distinct())
    failing = staged_table(nodes.filter("health_status = 'fail'").select(F.col("external_id").alias("node")).distinct())
    ill = staged_table(failing.join(leading, "node", "left_semi"))
    labelled = ill.select("node", F.col("node").alias("lo"), F.col("node").alias("hi"))
    labels = spread(e, labelled, {"lo": "min", "hi": "max"}, ["lo", "hi"], through=leading.join(ill, "node", "left_anti"))[0]
    roots = staged_table(failing.join(labels.filter((F.col("lo") != F.col("node")) | (F.col("hi") != F.col("node"))), "node", "left_anti"))
    starts = numbered(roots.join(ill, "node", "left_semi").select(F.col("node").alias("start")))
    counted = counts_per_start(masks_from(e, starts, through=leading)[0], starts, {"downstream_impact_count": F.lit(True)})
    return roots.join(counted.withColumnRenamed("start", "node"), "node", "left").select(
        F.col("node").alias("external_id"), F.coalesce("downstream_impact_count", F.lit(0)).alias("downstream_impact_count"),
    ).orderBy(F.desc("downstream_impact_count"), "external_id")


def closes_cycle(edges: DataFrame, candidates: DataFrame, ready: bool = False) -> DataFrame:
    """Candidates (source, target) whose target already reaches their source.

    A self loop always closes a cycle.  Edges and candidates meet once, by the
    edge's target: that tells which candidates a single edge answers, and which
    edges lead to a node that leads further.  A target without such an edge
    reaches nothing else.  Only if some are left, the graph of edges and these
    candidates is trimmed to what may lie on cycles and searched.  ``ready``
    says that ``edges`` is a table already.
    """
    pair = ["source", "target"]
    pairs = staged_table(candidates.select(*pair).distinct())
    proper = pairs.filter(F.col("source") != F.col("target"))
    e = edges.select(*pair) if ready else staged_table(edges.select(*pair))
    leading = e.select(F.col("source").alias("target")).distinct().withColumn("_leading", F.lit(True))
    both = e.withColumns({"old": F.lit(True), "asked": F.lit(False)}).unionByName(reversed_edges(proper).withColumns({"old": F.lit(False), "asked": F.lit(True)}))
    met = both.repartition("target").groupBy(*pair).agg(F.max("old").alias("old"), F.max("asked").alias("asked"))
    met = staged_table(met.join(leading, "target", "left").select(*pair, "old", "asked", F.col("_leading").isNotNull().alias("onward")))
    old = met.filter("old")
    left, _, going = measured(met.filter("asked AND NOT old").select(*pair).join(old.filter("onward").select("source").distinct(), "source", "left_semi"))
    hits = [reversed_edges(old.filter("asked")), pairs.filter(F.col("source") == F.col("target"))]
    if going:
        core = trimmed(old.select(*pair, "old").unionByName(reversed_edges(left).withColumn("old", F.lit(False))))
        found = reaching_pairs(core.filter("old").select(*pair), left.select(F.col("source").alias("start"), F.col("target").alias("node")))
        hits.append(found.select(F.col("node").alias("source"), F.col("start").alias("target")).distinct())
    return union(hits)


def accept_edges(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """Outcome of adding candidates one after another, in order of ``rank``.

    ``existing`` has (source, target, status), ``candidates`` (source, target,
    status, rank) with unique ranks.  Outcomes are ``existed``, ``suggested``,
    ``confirmed`` and ``cycle``.  Instead of one search per candidate, a round

    1. rejects candidates that close a cycle with the confirmed edges,
    2. confirms those on no cycle even if all others were confirmed,
    3. confirms, among the rest, each candidate that no lower-ranked one
       reaches along cycles, which is the first one of its cycles to arrive.

    This gives the one-by-one result; rounds are needed only while candidates
    form cycles among themselves, and go on with edges that lie on such cycles:
    no others can close one later.
    """
    pair = ["source", "target"]
    old = existing.select(*pair).distinct().withColumn("_old", F.lit(True))
    first = candidates.groupBy(*pair).agg(F.min("rank").alias("_first"))
    todo = staged_table(candidates.join(first, pair).join(old, pair, "left"))
    known = todo.filter(F.col("_old").isNotNull() | (F.col("rank") != F.col("_first")))
    outcomes = [known.select(*pair, "rank", F.lit("existed").alias("outcome"))]
    fresh = todo.filter(F.col("_old").isNull() & (F.col("rank") == F.col("_first")))
    outcomes.append(fresh.filter("status <> 'confirmed'").select(*pair, "rank", F.lit("suggested").alias("outcome")))
    # A suggested copy that came first keeps its pair out of the confirmed set.
    confirmed = staged_table(existing.filter("status = 'confirmed'").select(*pair).distinct())
    pending = fresh.filter("status = 'confirmed'").select(*pair, "rank")
    while not pending.isEmpty():
        closing = closes_cycle(confirmed, pending, ready=True)
        rejected = staged_table(pending.join(closing, pair, "left_semi"))
        outcomes.append(rejected.withColumn("outcome", F.lit("cycle")))
        open_ = staged_table(pending.join(rejected, pair, "left_anti"))
        if open_.isEmpty():
            break
        together = staged_table(confirmed.unionByName(open_.select(*pair)))
        conflicted = staged_table(open_.join(closes_cycle(together, open_, ready=True), pair, "left_semi"))
        safe = open_.join(conflicted, pair, "left_anti")
        winners = safe
        if not conflicted.isEmpty():
            together = staged_table(closes_cycle(together, together, ready=True))
            seeds = conflicted.select(F.col("target").alias("node"), "rank")
            lowest = spread(together, seeds, "min", ["rank"], own=True)[0].select(F.col("node").alias("source"), F.col("rank").alias("lowest"))
            leading = conflicted.join(lowest, "source", "left").filter(F.coalesce(F.col("lowest") >= F.col("rank"), F.lit(True)))
            winners = safe.unionByName(leading.select(*pair, "rank"))
        winners = staged_table(winners)
        outcomes.append(winners.withColumn("outcome", F.lit("confirmed")))
        confirmed = staged_table(confirmed.unionByName(winners.select(*pair)).join(together, pair, "left_semi"))
        pending = staged_table(open_.join(winners, pair, "left_anti"))
    return union(outcomes)


def _marked(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct ids of ``nodes`` (external_id), and the distinct (source, target) with whether the target is ``listed`` among them.

    Edges are moved once, by target, to be made distinct and to be looked up.
    """
    known = staged_table(nodes.select("external_id").distinct())
    listed = known.select(F.col("external_id").alias("target"), F.lit(True).alias("_listed"))
    distinct = edges.select("source", "target").repartition("target").distinct()
    return known, staged_table(distinct.join(listed, "target", "left").select("source", "target", F.col("_listed").isNotNull().alias("listed")))


def paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every root-to-leaf path, as an array of node ids.

    Roots have no incoming edge.  A path that would repeat one of its own nodes
    ends before the repetition.  Only beginnings of paths are written; their last
    steps, which are most of them, are left to whoever reads the result.
    """
    known, e = _marked(nodes, edges)
    sources = staged_table(e.select(F.col("source").alias("node")).distinct())
    roots = known.join(edges.select(F.col("target").alias("external_id")).distinct(), "external_id", "left_anti")
    first = staged_table(roots.select(F.array("external_id").alias("path"), F.col("external_id").alias("node")))
    leading = sources.select(F.col("node").alias("target"))
    listed = e.filter("listed").select("source", "target")
    inner, last = staged_table(listed.join(leading, "target", "left_semi")), listed.join(leading, "target", "left_anti")
    frontier, begun, done = first, [first], [first.join(sources, "node", "left_anti").select("path")]
    while not frontier.isEmpty():
        grown = staged_table(frontier.join(inner, F.col("node") == F.col("source")).withColumn("again", F.array_contains("path", F.col("target"))))
        done.append(grown.filter("again").select("path"))
        frontier = grown.filter(~F.col("again")).select(F.array_append("path", F.col("target")).alias("path"), F.col("target").alias("node"))
        begun.append(frontier)
        if len(begun) > COMPACT_STEPS:
            begun, done = [staged_table(union(begun))], [staged_table(union(done))]
    ends = union(begun).join(last, F.col("node") == F.col("source"))
    return union([*done, ends.select(F.array_append("path", F.col("target")).alias("path"))])


def _before(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over the rows of the same ``keys`` that come earlier by ``order``.

    Rows are range-sorted, so that a key with most of the rows is spread over
    many tasks; only sums for each key and range are added up at once.
    """
    ranged = staged_table(df.repartitionByRange(*keys, order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inside = W.partitionBy("_range", *keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    total = F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return ranged.join(offsets, [*keys, "_range"]).withColumn("before", total.cast(_WIDE)).drop("_range", "_offset")


def count_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, paths): how many ways lead from each node to a leaf, counted from the leaves upwards.

    Ways through nodes that are not listed do not count.  A cycle is an error;
    so is a number beyond 38 digits.
    """
    return _counted(*_marked(nodes, edges))


def _counted(known: DataFrame, e: DataFrame) -> DataFrame:
    """:func:`count_paths` of what :func:`_marked` gives."""
    known = known.withColumnRenamed("external_id", "node")
    inner = e.filter("listed").select("source", "target")
    leaves = known.join(e.select(F.col("source").alias("node")).distinct(), "node", "left_anti").select("node", F.lit(1).cast(_WIDE).alias("paths"))
    dead = known.join(inner.select(F.col("source").alias("node")).distinct(), "node", "left_anti").join(leaves, "node", "left_anti").select("node", F.lit(0).cast(_WIDE).alias("paths"))
    ways = inner.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("out")).join(known, "node", "left_semi")
    step, sent, going = measured(leaves.unionByName(dead))
    done, waiting = [step], ways.select("node", "out", F.lit(0).cast(_WIDE).alias("paths"))
    while going:
        arrived = inner.join(sent.withColumnRenamed("node", "target"), "target").groupBy(F.col("source").alias("node")).agg(F.sum("paths").cast(_WIDE).alias("more"), F.count("*").alias("n"))
        now = staged_table(waiting.join(arrived, "node", "left").select("node", (F.col("out") - F.coalesce("n", F.lit(0))).alias("out"), (F.col("paths") + F.coalesce("more", F.lit(0))).cast(_WIDE).alias("paths")))
        step, sent, going = measured(now.filter("out = 0").select("node", "paths"))
        waiting = now.filter("out > 0")
        if going:
            done.append(step)
        if len(done) > COMPACT_STEPS:
            done = [staged_table(union(done))]
    if not waiting.isEmpty():
        raise ValueError("paths through a cycle cannot be numbered")
    return union(done)


def numbered_paths(nodes: DataFrame, edges: DataFrame, first: int, number: int) -> DataFrame:
    """(no, path) of ``number`` paths from the ``first`` on, counted from 0 in the order of their node ids; the others are not made.

    Every path finds its next node by its number among those that start with the
    same nodes; only edges of nodes that the paths have come to are put in order.  The graph has to be free of cycles.
    """
    known, e = _marked(nodes, edges)
    counts = staged_table(_counted(known, e))
    roots = counts.join(e.select(F.col("target").alias("node")).distinct(), "node", "left_anti").filter("paths > 0")
    begun = _before(roots.withColumn("_all", F.lit(0)), ["_all"], "node", "paths")
    low, high = F.greatest(F.col("before"), F.lit(first).cast(_WIDE)), F.least(F.col("before") + F.col("paths"), F.lit(first + number).cast(_WIDE))
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), (high - low).cast("long") - 1))
    opened = begun.filter(low < high).select("node", low.alias("low"), "before", numbers.alias("_i"))
    rows = opened.select((F.col("low") + F.col("_i")).cast(_WIDE).alias("no"), F.array("node").alias("path"), "node", (F.col("low") + F.col("_i") - F.col("before")).cast(_WIDE).alias("left"))
    ahead = counts.filter("paths > 0").withColumnRenamed("node", "target")
    done = []
    rows, sent, going = measured(rows)
    while going:
        near = staged_table(e.join(sent.select(F.col("node").alias("source")), "source", "left_semi").select("source", "target"))
        ways = _before(near.join(ahead, "target"), ["source"], "target", "paths")
        on = (F.col("node") == F.col("source")) & (F.col("left") >= F.col("before")) & (F.col("left") < F.col("before") + F.col("paths"))
        grown = staged_table(rows.join(ways, on, "left"))
        done.append(grown.filter("source IS NULL").select("no", "path"))
        if len(done) > COMPACT_STEPS:
            done = [staged_table(union(done))]
        rows, sent, going = measured(grown.filter("source IS NOT NULL").select(
            "no", F.array_append("path", F.col("target")).alias("path"), F.col("target").alias("node"), (F.col("left") - F.col("before")).cast(_WIDE).alias("left")))
    return union(done) if done else rows.select("no", "path")
