"""How reachability is computed: values spread along edges, chains contracted, cycles condensed.

Many starts travel together as bits of one long, so what they reach is a table
of (group of 64 starts, node, mask), and counts for each start are sums of bits.
Every step is written to the shared checkpoint folder; a lost executor costs one
step.  Only counts come back to the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from assay.session import staged_table

# Steps after which what was found so far is put into one table, and trimming rounds before a search for cycles.
COMPACT_STEPS, TRIM_ROUNDS = 8, 1
# Steps in which a search for cycles may end before an index is built for it; label pairs of that index.
SHALLOW_STEPS, LABELS = 4, 4
# A search that stays narrow goes on: up to so many times these steps, while it has found no more than so many rows for each pair.
NARROW_STEPS, NARROW_ROWS = 5, 16
# A frontier is broadcast up to this measured size.
BROADCAST_BYTES = 4 << 20

_MERGE = {"min": F.min, "max": F.max, "or": F.bit_or}


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"))


def measured(df: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``df`` written to the shared folder, the same to be joined (broadcast if rows and ids are small together), and its number of rows."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 24 for c in df.columns), F.lit(0))
    seen = Observation()
    table = staged_table(df.observe(seen, F.sum(size).alias("bytes"), F.count("*").alias("rows")))
    return table, (F.broadcast(table) if (seen.get["bytes"] or 0) <= BROADCAST_BYTES else table), seen.get["rows"]


def spread(edges: DataFrame, seeds: DataFrame, how: str | dict[str, str], columns: list[str], keys: tuple[str, ...] = (), through: DataFrame | None = None, own: bool = False,
           max_depth: int | None = None, most: int = 0) -> tuple[DataFrame, bool]:
    """Values of ``seeds`` (keys, node, columns) at every node that edges lead them to, and whether they have gone all the way.

    ``how`` merges values that meet: ``min``, ``max`` (or one of them for each column), or ``or`` for masks, whose
    result has a row for each ``depth`` with the bits that came first then.  Only
    changed values are sent on, and if ``through`` (node) is given only from its nodes; seeds always send.  Copies of an edge change nothing.  A seed's own values
    count for its node if ``own``, or if they come back around a cycle.  Beyond
    ``max_depth`` it goes on for ``NARROW_STEPS`` times as long while no more than
    ``most`` rows were found.
    """
    by, masks = [*keys, "node"], how == "or"
    hows = how if isinstance(how, dict) else dict.fromkeys(columns, how)
    merge = lambda c: _MERGE[hows[c]](c)
    onward = lambda df: df if through is None else df.join(through, "node", "left_semi")
    shown = [*by, *columns, *(["depth"] if masks else [])]
    first, sent, going = measured(seeds.groupBy(*by).agg(*[merge(c).alias(c) for c in columns]))
    known = first if own else None
    found = [first.withColumn("depth", F.lit(0)).select(*shown)] if own and masks else []
    depth, rows = 0, 0
    while going and (max_depth is None or depth < max_depth or (rows <= most and depth < NARROW_STEPS * max_depth)):
        depth += 1
        step = edges.join(sent, F.col("node") == F.col("source")).groupBy(*keys, F.col("target").alias("node")).agg(*[merge(c).alias(c) for c in columns])
        if masks:
            if found:
                before = union(found).groupBy(*by).agg(*[merge(c).alias(f"_{c}") for c in columns])
                step = step.join(before, by, "left").withColumns({c: F.col(c).bitwiseAND(F.bitwise_not(F.coalesce(f"_{c}", F.lit(0).cast("long")))) for c in columns})
                step = step.filter(" OR ".join(f"`{c}` != 0" for c in columns))
            step, sent, going = measured(step.select(*by, *columns))
            rows += going
            if going:
                found.append(step.withColumn("depth", F.lit(depth)).select(*shown))
            if len(found) > COMPACT_STEPS:
                found = [staged_table(union(found))]
            if through is not None and going:
                _, sent, going = measured(onward(step))
        elif known is None:
            known = staged_table(step.select(*by, *columns))
            _, sent, going = measured(onward(known))
        else:
            best = lambda c: (F.least if hows[c] == "min" else F.greatest)(c, f"_{c}")
            arrived = step.select(*by, *[F.col(c).alias(f"_{c}") for c in columns])
            changed = F.lit(False)
            for c in columns:
                changed = changed | F.coalesce(best(c) != F.col(c), F.col(f"_{c}").isNotNull())
            known = staged_table(known.join(arrived, by, "full").select(*by, *[best(c).alias(c) for c in columns], changed.alias("_changed")))
            _, sent, going = measured(onward(known.filter("_changed").select(*by, *columns)))
            known = known.drop("_changed")
    if masks:
        return (union(found) if found else first.withColumn("depth", F.lit(0)).select(*shown).filter(F.lit(False))), not going
    return (first.limit(0) if known is None else known), not going


def numbered(starts: DataFrame) -> DataFrame:
    """(start, group, bit, mask) of the distinct values of ``start``, 64 to a group; groups at the ends of partitions may have fewer."""
    rows = starts.select("start").distinct().withColumn("no", F.monotonically_increasing_id())
    bit = F.col("no").bitwiseAND(F.lit(63)).cast("int")
    return staged_table(rows.select("start", F.shiftright("no", 6).alias("group"), bit.alias("bit"), F.expr("shiftleft(1L, CAST(no & 63 AS INT))").alias("mask")))


def masks_from(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, most: int = 0, through: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """(group, node, mask, depth) of what ``starts`` (of :func:`numbered`) reach in one step or more, and whether that is all."""
    seeds = starts.select("group", F.col("start").alias("node"), "mask")
    return spread(edges, seeds, "or", ["mask"], ("group",), through, max_depth=max_depth, most=most)


def without_own(masks: DataFrame, starts: DataFrame) -> DataFrame:
    """``masks`` without the starts that come back to themselves."""
    own = starts.select("group", F.col("start").alias("node"), F.col("mask").alias("_own"))
    return masks.join(own, ["group", "node"], "left").withColumn("mask", F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("_own", F.lit(0).cast("long"))))).drop("_own").filter("mask != 0")


def counts_per_start(masks: DataFrame, starts: DataFrame, counts: dict[str, Column], by: tuple[str, ...] = ()) -> DataFrame:
    """(start, by, counts): for each start the nodes with its bit for which each of ``counts`` holds; only starts with any."""
    bit = lambda b: F.shiftrightunsigned("mask", b).bitwiseAND(F.lit(1).cast("long"))
    rows = masks.withColumns({f"_{n}": c for n, c in counts.items()})
    sums = rows.groupBy("group", *by).agg(*[F.array(*[F.sum(F.when(F.col(f"_{n}"), bit(b)).otherwise(0)) for b in range(64)]).alias(n) for n in counts])
    each = sums.select("group", *by, F.posexplode(F.arrays_zip(*counts)).alias("bit", "n")).select("group", *by, "bit", "n.*")
    return each.join(starts.select("start", "group", "bit"), ["group", "bit"]).select("start", *by, *counts).filter(" OR ".join(f"`{n}` > 0" for n in counts))


def pairs_in(masks: DataFrame, starts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (start, node) whose start reaches the node."""
    wanted = pairs.join(starts.select("start", "group", F.col("mask").alias("_bit")), "start")
    reached = masks.groupBy("group", "node").agg(F.bit_or("mask").alias("mask"))
    return wanted.join(reached, ["group", "node"]).filter(F.col("mask").bitwiseAND(F.col("_bit")) != 0).select("start", "node")


def _followed(inner: DataFrame, way: str) -> DataFrame:
    """(node, end, steps): the first node outside ``inner`` (node, ``way``) that each of its nodes leads to; the steps double in each round.

    Nodes of a circle that leads nowhere are left out.
    """
    inside = inner.select(F.col("node").alias("end"), F.lit(True).alias("open"))
    now, _, size = measured(inner.select("node", F.col(way).alias("end"), F.lit(1).cast("long").alias("steps")).join(inside, "end", "left").select(
        "node", "end", "steps", F.col("open").isNotNull().alias("open")))
    for _ in range(math.ceil(math.log2(size + 1)) + 1 if size else 0):
        if now.filter("open").isEmpty():
            break
        beyond = now.select(F.col("node").alias("end"), F.col("end").alias("further"), F.col("steps").alias("more"), F.col("open").alias("still"))
        moved = now.filter("open").join(beyond, "end").select("node", F.col("further").alias("end"), (F.col("steps") + F.col("more")).alias("steps"), F.col("still").alias("open"))
        now = staged_table(now.filter("NOT open").unionByName(moved))
    return now.filter("NOT open").select("node", "end", "steps")


def contracted(edges: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, target, length) between the nodes of ``keep`` and those where ways meet, part or end, and the (head, node, position) passed on the way.

    A node with one edge in and one out lies on a chain; chains become one edge
    by pointers that double, so a chain of n takes about log n rounds.  ``edges``
    is distinct; circles of such nodes alone vanish.
    """
    ins = edges.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("n"), F.min("source").alias("before")).filter("n = 1").drop("n")
    outs = edges.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("n"), F.min("target").alias("after")).filter("n = 1").drop("n")
    inner = staged_table(ins.join(outs, "node").join(keep.select("node"), "node", "left_anti"))
    ahead, behind = _followed(inner, "after"), _followed(inner, "before").select("node", F.col("end").alias("head"), F.col("steps").alias("position"))
    chains = behind.filter("position = 1").join(ahead, "node").select(F.col("head").alias("source"), F.col("end").alias("target"), (F.col("steps") + 1).alias("length"))
    inside = inner.select("node")
    direct = edges.join(inside.withColumnRenamed("node", "source"), "source", "left_anti").join(inside.withColumnRenamed("node", "target"), "target", "left_anti")
    return staged_table(direct.select("source", "target", F.lit(1).cast("long").alias("length")).unionByName(chains)), behind


def trimmed(edges: DataFrame, rounds: int = TRIM_ROUNDS) -> DataFrame:
    """``edges`` without those whose source nothing enters or whose target nothing leaves, again and again.

    No cycle loses an edge.  Few rounds remove most of a graph that is nearly a tree.
    """
    edges, _, before = measured(edges)
    for _ in range(rounds):
        if not before:
            break
        ends = edges.select(F.col("target").alias("source")).distinct(), edges.select(F.col("source").alias("target")).distinct()
        edges, _, now = measured(edges.join(ends[0], "source", "left_semi").join(ends[1], "target", "left_semi"))
        if now == before:
            break
        before = now
    return edges


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("target").alias("node"))).distinct()


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes that lie on a common cycle, by forward and backward colouring.

    Every node takes the largest id that reaches it; the component of a colour is
    what reaches back to that id within the colour.  Edges between colours belong
    to no cycle, so the rest falls apart and is coloured again.  Nodes on no cycle
    are components of their own, or left out.
    """
    left, found = edges.filter(F.col("source") != F.col("target")).select("source", "target").distinct(), []
    while True:
        left = trimmed(left, COMPACT_STEPS // 2)
        if left.isEmpty():
            break
        colours = staged_table(spread(left, _ends(left).withColumn("colour", F.col("node")), "max", ["colour"], own=True)[0])
        at = lambda side, name: colours.select(F.col("node").alias(side), F.col("colour").alias(name))
        same = staged_table(left.join(at("source", "colour"), "source").join(at("target", "other"), "target").filter("colour = other").select("source", "target", "colour"))
        roots = _ends(same).join(colours, "node").filter(F.col("node") == F.col("colour"))
        done = staged_table(spread(reversed_edges(same), roots, "max", ["colour"], own=True)[0])
        found.append(done.select("node", F.col("colour").alias("component")))
        gone = done.select("node")
        left = same.select("source", "target").join(gone.withColumnRenamed("node", "source"), "source", "left_anti").join(
            gone.withColumnRenamed("node", "target"), "target", "left_anti")
    if not found:
        return edges.select(F.col("source").alias("node"), F.col("source").alias("component")).filter(F.lit(False))
    return union(found)


def may_reach(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (start, node) without those that labels of the acyclic ``edges`` refuse.

    A node's labels are the least of several hashes over itself and all that it
    reaches, and over all that reach it.  What a node reaches contains what its
    descendants reach, so the labels of a start are at most those of a node that
    it reaches, and the other way round upwards.
    """
    names = [f"l{i}" for i in range(LABELS)]
    ends = pairs.select(F.col("start").alias("node")).unionByName(pairs.select("node"))
    seeds = _ends(edges).unionByName(ends).distinct().select("node", *[F.xxhash64("node", F.lit(i)).alias(n) for i, n in enumerate(names)])
    down = staged_table(spread(reversed_edges(edges), seeds, "min", names, own=True)[0])
    up = staged_table(spread(edges, seeds, "min", names, own=True)[0])
    named = lambda df, key, mark: df.select(F.col("node").alias(key), *[F.col(n).alias(f"{mark}{n}") for n in names])
    j = pairs.join(named(down, "start", "sd"), "start").join(named(down, "node", "nd"), "node").join(named(up, "start", "su"), "start").join(named(up, "node", "nu"), "node")
    fits = F.lit(True)
    for n in names:
        fits = fits & (F.col(f"sd{n}") <= F.col(f"nd{n}")) & (F.col(f"nu{n}") <= F.col(f"su{n}"))
    return j.filter(fits).select("start", "node")


def reaching_pairs(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (start, node) whose start reaches the node in one step or more.

    Shallow graphs are searched at once, 64 starts at a time, and deeper ones where
    the starts lead to few nodes.  Where that does not come to an end, chains are contracted, cycles condensed, and only pairs that
    the labels let through are searched in the condensed graph.
    """
    pairs = staged_table(pairs.select("start", "node").distinct())
    starts = numbered(pairs)
    masks, ended = masks_from(edges, starts, SHALLOW_STEPS, NARROW_ROWS * pairs.count())
    hits = staged_table(pairs_in(masks, starts, pairs))
    if ended:
        return hits
    rest = staged_table(pairs.join(hits, ["start", "node"], "left_anti"))
    keep = rest.select(F.col("start").alias("node")).unionByName(rest.select("node")).distinct()
    ways = contracted(edges, keep)[0].select("source", "target").distinct()
    parts = staged_table(strong_components(ways))

    def condensed(df: DataFrame, *sides: str) -> DataFrame:
        for side in sides:
            df = df.join(parts.select(F.col("node").alias(side), F.col("component").alias("_component")), side, "left").withColumn(f"_{side}", F.coalesce("_component", side)).drop("_component")
        return df

    placed = staged_table(condensed(rest, "start", "node"))
    together = placed.filter((F.col("_start") == F.col("_node")) & (F.col("start") != F.col("node")))
    cycles = parts.groupBy("component").count().filter("count > 1").select(F.col("component").alias("_start")).unionByName(
        ways.filter("source = target").select(F.col("source").alias("_start"))).distinct()
    circled = placed.filter(F.col("start") == F.col("node")).join(cycles, "_start", "left_semi")
    apart = placed.filter(F.col("_start") != F.col("_node")).select(F.col("_start").alias("start"), F.col("_node").alias("node")).distinct()
    acyclic = staged_table(condensed(ways, "source", "target").select(F.col("_source").alias("source"), F.col("_target").alias("target")).filter("source != target").distinct())
    likely = staged_table(may_reach(acyclic, apart))
    some = numbered(likely)
    sure = pairs_in(masks_from(acyclic, some)[0], some, likely).select(F.col("start").alias("_start"), F.col("node").alias("_node"))
    return union([df.select("start", "node") for df in (hits, together, circled, placed.join(sure, ["_start", "_node"], "left_semi"))])
