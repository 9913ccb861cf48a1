"""Graphs as edge tables: downstream traces, upstream sets, components, shortest paths within a limit, neighbourhood sums.

Loops over rounds read each round once, from a table written to the shared folder, so plans do not grow with the rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.tables import written


def _large(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the graph: it is shuffled and never sent through the driver, however small its files are."""
    return side.hint("merge")


def pointer_doubling(pointers: DataFrame, start: Column | None = None, add: Column | None = None, combine=lambda a, b: a + b) -> DataFrame:
    """(node, outlet, steps) along next-pointers, by squaring the pointer table until every node is at its outlet.

    ``pointers`` is (node, to), at most one row a node and no circle; nodes without a pointer are outlets. ``add`` is what
    each step adds to ``steps``, 1 by default, and ``combine`` how (``F.greatest`` gives the largest on the way). Nodes that have
    come to their outlet are set aside and join no more; the others only look up where they point.
    """
    active = written(pointers.select("node", "to", (F.lit(1) if add is None else add).alias("steps")), "pointers")
    settled: list[DataFrame] = []
    while True:
        every = active
        for part in settled:
            every = every.unionByName(part)
        ahead = every.select(F.col("node").alias("to"), F.col("to").alias("far"), F.col("steps").alias("more"))
        moved = active.join(_large(ahead), "to", "left")
        steps = F.when(F.col("far").isNull(), F.col("steps")).otherwise(combine(F.col("steps"), F.col("more"))).alias("steps")
        moved = written(moved.select("node", F.coalesce("far", "to").alias("to"), steps, F.col("far").isNotNull().alias("moved")), "pointers")
        settled.append(moved.where("NOT moved").drop("moved"))
        active = moved.where("moved").drop("moved")
        if active.isEmpty():
            return reduce(DataFrame.unionByName, settled).withColumnRenamed("to", "outlet")


def upstream(pointers: DataFrame, targets: DataFrame) -> DataFrame:
    """(node, target): the nodes that drain into each target, the target with itself; only these are ever looked at.

    Where ways fork and meet again a node counts once: a round keeps what no round before has found, so circles end, too.
    """
    edge = pointers.select("node", F.col("to").alias("at"))
    found = [written(targets.select("node", F.col("node").alias("target")).distinct(), "front")]
    while not found[-1].isEmpty():
        front = found[-1].select(F.col("node").alias("at"), "target").join(_large(edge), "at").select("node", "target").distinct()
        known = reduce(DataFrame.unionByName, found)
        found.append(written(front.join(_large(known), ["node", "target"], "left_anti"), "front"))
    return reduce(DataFrame.unionByName, found)


def _cheapest(sources: DataFrame, edges: DataFrame, keys: list[str], limit: float) -> DataFrame:
    """(keys, node, cost): cheapest cost of each key's own sources within a limit. What becomes cheaper is added, nothing is rewritten.

    Edges are made once, not once a round, and a round compares what is new with what is known in one grouping, without a join.
    """
    on = [*keys, "node"]
    own = [k for k in keys if k in edges.columns]
    edges = written(edges.select(*own, "a", "b", "cost"), "edges")
    front = written(sources.select(*keys, "node", F.lit(0.0).alias("cost")).distinct(), "costs")
    parts = [front]
    while not front.isEmpty():
        step = front.select(*keys, F.col("node").alias("a"), F.col("cost").alias("so_far")).join(_large(edges), ["a", *own])
        new = step.select(*keys, F.col("b").alias("node"), (F.col("so_far") + F.col("cost")).alias("cost")).where(F.col("cost") <= limit)
        known = reduce(DataFrame.unionByName, parts).withColumn("known", F.lit(True))
        both = new.withColumn("known", F.lit(False)).unionByName(known).groupBy(*on)
        both = both.agg(F.min(F.when(~F.col("known"), F.col("cost"))).alias("cost"), F.min(F.when(F.col("known"), F.col("cost"))).alias("old"))
        front = written(both.where("cost IS NOT NULL AND (old IS NULL OR cost < old)").select(*on, "cost"), "costs")
        parts.append(front)
    return reduce(DataFrame.unionByName, parts).groupBy(*on).agg(F.min("cost").alias("cost"))


def reach_within(edges: DataFrame, sources: DataFrame, limit: float) -> DataFrame:
    """(node, cost): cheapest cost from any source within a limit, over any number of edges.

    ``edges`` is (a, b, cost) with costs above 0, ``sources`` (node). Each round relaxes the edges of what became cheaper.
    """
    return _cheapest(sources, edges, [], limit)


def flooded_edges(edges: DataFrame, wet: DataFrame, cell: float) -> DataFrame:
    """Edges (a, b, x1, y1, x2, y2, bridge) with ``flooded``: two of both ends and the middle lie on wet cells (row, col), and it is no bridge."""
    points = [(F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2")), ((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2)]
    at = edges.select("a", "b", F.explode(F.array(*[F.struct(F.floor(y / cell).alias("row"), F.floor(x / cell).alias("col")) for x, y in points])).alias("p")).select("a", "b", "p.*")
    hits = at.join(wet.select("row", "col").distinct(), ["row", "col"]).groupBy("a", "b").agg(F.count("*").alias("_hits"))
    found = edges.join(_large(hits), ["a", "b"], "left")
    return found.withColumn("flooded", (F.coalesce("_hits", F.lit(0)) >= 2) & ~F.coalesce("bridge", F.lit(False))).drop("_hits")


def served(edges: DataFrame, sources: DataFrame, houses: DataFrame, limit: float) -> DataFrame:
    """(source, houses, houses_dry, route_dry, mean_dry): what each source serves within a limit of cost, with and without flooded edges.

    ``edges`` is (a, b, cost, flooded), given both ways, ``sources`` (source, node), ``houses`` (node, houses). All sources and both
    states go through the graph together, a key of its own each: edges are read once a round, whatever there are.
    """
    states = edges.select("a", "b", "cost", F.explode(F.when(F.col("flooded"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("dry"))
    starts = sources.select("source", "node", F.explode(F.array(F.lit(False), F.lit(True))).alias("dry"))
    reached = _cheapest(starts, states, ["source", "dry"], limit).join(_large(houses), "node")
    total = lambda dry, v: F.coalesce(F.sum(F.when(F.col("dry") == dry, v)), F.lit(0))
    sums = reached.groupBy("source").agg(
        total(False, F.col("houses")).alias("houses"), total(True, F.col("houses")).alias("houses_dry"), total(True, F.col("houses") * F.col("cost")).alias("_cost")
    )
    sums = sources.select("source").distinct().join(_large(sums), "source", "left").na.fill(0, ["houses", "houses_dry", "_cost"])
    share = F.when(F.col("houses") >= 1, F.round(F.try_divide(F.col("houses_dry"), F.col("houses")), 3))
    mean = F.when(F.col("houses_dry") >= 1, F.round(F.try_divide(F.col("_cost"), F.col("houses_dry")), 4))
    return sums.select("source", "houses", "houses_dry", share.alias("route_dry"), mean.alias("mean_dry"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected ``edges`` (u, v); root is the smallest node of its component.

    Every node that is no local minimum, in an order by hash, hooks to its smallest neighbour; edges are rewritten to what
    their ends hooked to, and loops and repeats are dropped, so edges shrink by a constant factor a round and what is
    settled is not read again.
    """
    named = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("node"))
    pairs = edges.where("u <> v").select(named("u").alias("u"), named("v").alias("v"))
    left = written(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    hooks: list[DataFrame] = []
    while not left.isEmpty():
        step = written(left.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("to")), "hooks")
        hooks.append(step)
        for end in ("u", "v"):
            left = left.join(_large(step.withColumnRenamed("node", end)), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        left = written(left.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    if not hooks:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).limit(0)
    # where a node is after all rounds: its target of each round is looked up in the next ones, put together from the last back
    top = hooks[-1].select("node", "to")
    for step in reversed(hooks[:-1]):
        known = top.select(F.col("node").alias("to"), F.col("to").alias("up"))
        first = step.join(_large(known), "to", "left").select("node", F.coalesce("up", "to").alias("to"))
        top = written(top.join(_large(step.select("node")), "node", "left_anti").unionByName(first), "hooked")
    heads = top.select(F.col("to").alias("node"), "to").distinct().join(_large(top.select("node")), "node", "left_anti")
    every = top.unionByName(heads)
    smallest = every.groupBy("to").agg(F.min("node.node").alias("root"))
    return every.join(_large(smallest), "to").select(F.col("node.node").alias("node"), "root")


def patches(cells: DataFrame, least: int = 1) -> DataFrame:
    """(row, col, patch) of the cells whose patch of side neighbours has ``least`` cells or more; patch is its smallest (row, col)."""
    at = F.struct("row", "col")
    near = cells.select(at.alias("u"), F.explode(F.array(F.struct((F.col("row") + 1).alias("row"), "col"), F.struct("row", (F.col("col") + 1).alias("col")))).alias("v"))
    edges = near.join(cells.select(at.alias("v")), "v", "left_semi")
    placed = cells.join(components(edges).select("node.row", "node.col", F.col("root").alias("patch")), ["row", "col"], "left")
    placed = placed.select("row", "col", F.coalesce("patch", at).alias("patch"))
    large = placed.groupBy("patch").count().where(F.col("count") >= least).select("patch")
    return placed.join(large, "patch")


def above_drainage(flow: DataFrame, channel: Column) -> DataFrame:
    """(node, hand): height of each node above the channel that it drains to; NULL where it reaches none.

    ``flow`` is (node, to, height). The trace ends in the first channel node, as channel nodes have no pointer in it.
    """
    marked = flow.withColumn("is_channel", channel)
    trace = pointer_doubling(marked.where("NOT is_channel AND to IS NOT NULL").select("node", "to"))
    ends = marked.where("is_channel").select(F.col("node").alias("outlet"), F.col("height").alias("base"))
    outlet = marked.join(trace.select("node", "outlet"), "node", "left").withColumn("outlet", F.coalesce("outlet", "node"))
    return outlet.join(ends, "outlet", "left").select("node", F.greatest(F.col("height") - F.col("base"), F.lit(0.0)).alias("hand"))


def chains(ways: DataFrame) -> DataFrame:
    """(way, chain) of ways (way, a, b): ways that meet at a place where exactly two of them end are one chain."""
    ends = ways.select("way", F.explode(F.array("a", "b")).alias("place"))
    meet = ends.groupBy("place").agg(F.count("*").alias("n"), F.min("way").alias("u"), F.max("way").alias("v")).where("n = 2 AND u <> v")
    found = ways.select("way").join(components(meet.select("u", "v")).withColumnRenamed("node", "way"), "way", "left")
    return found.select("way", F.coalesce("root", "way").alias("chain"))


def coarsened(cells: DataFrame, side: int, least: float) -> DataFrame:
    """(row, col, cls) of blocks: the highest class of which, with those above it, the block has a share of ``least``."""
    block = [F.floor(F.col(c) / side).alias(c) for c in ("row", "col")]
    counts = cells.groupBy(*block, "cls").agg(F.count("*").alias("n"))
    at = Window.partitionBy("row", "col")
    upward = at.orderBy(F.col("cls").desc()).rowsBetween(Window.unboundedPreceding, 0)
    shares = counts.withColumn("share", F.sum("n").over(upward) / F.sum("n").over(at))
    return shares.where(F.col("share") >= least).groupBy("row", "col").agg(F.max("cls").alias("cls"))


def box_sum(cells: DataFrame, radius: int) -> DataFrame:
    """Sum over the square of cells around each one, from running sums along rows and then columns.

    ``cells`` is a full grid (row, col, value).
    """
    along = Window.partitionBy("row").orderBy("col").rangeBetween(-radius, radius)
    down = Window.partitionBy("col").orderBy("row").rangeBetween(-radius, radius)
    return cells.withColumn("_s", F.sum("value").over(along)).withColumn("box", F.sum("_s").over(down)).drop("_s")


def dilated(cells: DataFrame, radius: int) -> DataFrame:
    """(row, col) of every cell within a square radius of the given ones."""
    offsets = F.sequence(F.lit(-radius), F.lit(radius))
    wide = cells.select(F.col("row"), F.col("col"), F.explode(offsets).alias("i")).select((F.col("row") + F.col("i")).alias("row"), "col")
    return wide.distinct().select("row", "col", F.explode(offsets).alias("j")).select("row", (F.col("col") + F.col("j")).alias("col")).distinct()


def edge(cells: DataFrame) -> DataFrame:
    """The cells of which some side neighbour is not among the given ones."""
    sides = F.array(*[F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")) for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0))])
    near = cells.select("row", "col", F.explode(sides).alias("x")).select("row", "col", F.col("x.row").alias("r"), F.col("x.col").alias("c"))
    return near.join(cells.select(F.col("row").alias("r"), F.col("col").alias("c")), ["r", "c"], "left_anti").select("row", "col").distinct()


def harmonics(df: DataFrame, group: str, hours: str, value: str, periods: tuple[float, ...], least_hours: float = 400 * 24) -> DataFrame:
    """(group, period, amplitude, n) by least squares: normal equations are summed by group, each small system solved alone.

    ``hours`` counts from the group's first row. Amplitudes are NULL where the record spans less than ``least_hours``.
    """
    import numpy as np

    size = 1 + 2 * len(periods)
    t = F.col(hours)
    base = [F.lit(1.0)] + [f(2 * np.pi / p * t) for p in periods for f in (F.cos, F.sin)]
    sums = [F.sum(base[i] * base[j]).alias(f"a{i}_{j}") for i in range(size) for j in range(i, size)]
    sums += [F.sum(base[i] * F.col(value)).alias(f"b{i}") for i in range(size)]
    summed = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), (F.max(t) - F.min(t)).alias("span"), *sums)

    def solve(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for _, r in frame.iterrows():
                a = np.zeros((size, size))
                for i in range(size):
                    for j in range(i, size):
                        a[i, j] = a[j, i] = r[f"a{i}_{j}"]
                x = np.linalg.lstsq(a, np.array([r[f"b{i}"] for i in range(size)]), rcond=None)[0]
                long = r["span"] >= least_hours
                rows += [(r[group], p, float(np.hypot(x[1 + 2 * k], x[2 + 2 * k])) if long else None, int(r["n"])) for k, p in enumerate(periods)]
            yield pd.DataFrame(rows, columns=["grp", "period", "amplitude", "n"])

    return summed.mapInPandas(solve, f"grp {dict(df.dtypes)[group]}, period double, amplitude double, n long").withColumnRenamed("grp", group)


def filled(cells: DataFrame, volume: float, area: float, steps: int = 24) -> DataFrame:
    """(reach, level, volume, cells): the water level at which the cells of a reach hold a volume.

    ``cells`` is (reach, row, col, height, channel). Wet are cells under the level that join the channel over wet cells. The
    level is found by halving; one reach is one task's work.
    """
    import numpy as np
    import pandas as pd

    def fill(frame):
        at = {rc: i for i, rc in enumerate(zip(frame["row"], frame["col"], strict=True))}
        height, channel = frame["height"].to_numpy(float), frame["channel"].to_numpy(bool)
        near = [[at[n] for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)) if n in at] for r, c in at]

        def wet_at(level):
            wet = channel & (height < level)
            open_ = np.flatnonzero(wet).tolist()
            while open_:
                for n in near[open_.pop()]:
                    if not wet[n] and height[n] < level:
                        wet[n] = True
                        open_.append(n)
            return wet

        held = lambda level: float((level - height[wet_at(level)]).sum() * area)
        low = float(height[channel].min()) if channel.any() else float(height.min())
        high = float(height.max()) + volume / area
        for _ in range(steps if channel.any() else 0):
            middle = (low + high) / 2
            low, high = (middle, high) if held(middle) < volume else (low, middle)
        return pd.DataFrame({"reach": [frame["reach"].iloc[0]], "level": [high if channel.any() else None], "volume": [held(high)], "cells": [int(wet_at(high).sum())]})

    kind = dict(cells.dtypes)["reach"]
    return cells.select("reach", "row", "col", F.col("height").cast("double").alias("height"), "channel").groupBy("reach").applyInPandas(fill, f"reach {kind}, level double, volume double, cells long")


def join_levels(cells: DataFrame) -> DataFrame:
    """(reach, row, col, height, level): the lowest water level at which each cell joins its reach's channel, over side neighbours.

    ``cells`` is (reach, row, col, height, channel). The level is the smallest possible maximum height on a way to the channel, both
    ends included; NULL where no way leads there. Found over a bottleneck spanning forest in rounds: each part that the channel is
    not yet in takes its lowest exit (ties by place), which every way out of it has to pass or exceed; of two parts that
    take the same exit one stays open. Cells and edges go by numbers, edges' in the order of their levels, so rows are narrow
    and what is least is found by hash. Parts at least halve in number a round, and no round gathers a reach.
    """
    rows = cells.where(F.col("height").isNotNull()).select("reach", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("height").cast("double").alias("h"), "channel")
    rows = written(rows, "cells")
    place = ["reach", "row", "col"]
    numbered = rows.groupBy(*place).agg(F.min("h").alias("h"), F.coalesce(F.max("channel"), F.lit(False)).alias("channel"))
    numbered = written(numbered.withColumn("id", F.monotonically_increasing_id()), "numbered")
    # all channel cells of a reach are one node, with a number below 0
    wet = numbered.where("channel")
    sea = wet.groupBy("reach").agg((-1 - F.min("id")).alias("node"))
    nodes = wet.join(_large(sea), "reach").select(*place, "h", "node").unionByName(numbered.where("NOT channel").select(*place, "h", F.col("id").alias("node")))
    nodes = written(nodes, "nodes")
    steps = F.array(F.struct((F.col("row") + 1).alias("row"), "col"), F.struct("row", (F.col("col") + 1).alias("col")))
    near = nodes.select("reach", F.col("node").alias("u"), F.col("h").alias("hu"), F.explode(steps).alias("_n")).select("reach", "u", "hu", "_n.row", "_n.col")
    edges = near.join(_large(nodes.select(*place, F.col("node").alias("v"), F.col("h").alias("hv"))), place).where("u <> v")
    edges = written(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.greatest("hu", "hv").alias("w")), "edges")
    left = written(edges.orderBy("w", "u", "v").withColumn("e", F.monotonically_increasing_id()), "exits")

    rounds: list[DataFrame] = []
    while not left.isEmpty():
        both = left.select(F.col("u").alias("c"), F.col("v").alias("d"), "e", "w").unionByName(left.select(F.col("v").alias("c"), F.col("u").alias("d"), "e", "w"))
        exits = both.where("c >= 0").groupBy("c").agg(F.min_by("d", "e").alias("d"), F.min("e").alias("e"), F.min("w").alias("w"))
        closed = exits.groupBy("e").agg(F.max("c").alias("node"), F.max_by("d", "c").alias("to"), F.min("w").alias("w"))
        merged = pointer_doubling(closed.select("node", "to", "w"), add=F.col("w"), combine=F.greatest)
        rounds.append(merged.select("node", "outlet", F.col("steps").alias("w")))
        for end in ("u", "v"):
            left = left.join(_large(merged.select(F.col("node").alias(end), "outlet")), end, "left").withColumn(end, F.coalesce("outlet", end)).drop("outlet")
        left = left.where("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("w").alias("w"), F.min("e").alias("e"))
        left = written(left, "exits")
    # what a part was joined to is open then and closes in a later round, so levels are known from the last round back
    known = None
    for merged in reversed(rounds):
        found = merged.where("outlet < 0").select("node", F.col("w").alias("level"))
        if known is not None:
            later = known.select(F.col("node").alias("outlet"), "level")
            up = merged.where("outlet >= 0").join(_large(later), "outlet").select("node", F.greatest("w", "level").alias("level"))
            found = known.unionByName(found.unionByName(up))
        known = written(found, "levels")
    levels = numbered.select(*place, "id", "channel")
    if known is None:
        levels = levels.withColumn("level", F.lit(None).cast("double"))
    else:
        levels = levels.join(_large(known.withColumnRenamed("node", "id")), "id", "left")
    found = rows.drop("channel").join(_large(levels.drop("id")), place)
    return found.select(*place, F.col("h").alias("height"), F.when(F.col("channel"), F.col("h")).otherwise(F.col("level")).alias("level"))


def filled_by_levels(cells: DataFrame, volume: float, area: float, steps: int = 4096) -> DataFrame:
    """(reach, level, volume, cells): the water level at which the cells of each reach hold a volume, from the levels at which they join.

    What is under water at a level are the cells that have joined below it, so the volume is a running sum over join levels. Levels
    fall into steps, whose sums are added up before they move; only the step in which the volume is reached is read cell by
    cell. Where a basin that joins holds more than what is missing, the level is where it joins. NULL without a channel.
    """
    joined = written(join_levels(cells), "joined")
    rows = joined.where("level IS NOT NULL")
    ends = rows.groupBy("reach").agg(F.min("level").alias("low"), F.max("level").alias("high"))
    step = F.least(F.floor(F.coalesce(F.try_divide(F.col("level") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0)) * steps), F.lit(steps - 1))
    rows = rows.join(ends, "reach").withColumn("step", step)
    sums = rows.groupBy("reach", "step").agg(F.count("*").alias("n"), F.sum("height").alias("h"), F.max("level").alias("top"))
    along = Window.partitionBy("reach").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("k", F.sum("n").over(along)).withColumn("s", F.sum("h").over(along))
    # the first step at whose top the volume is there; without one, all cells are under water
    full = F.min(F.when((F.col("k") * F.col("top") - F.col("s")) * area >= volume, F.struct("step", (F.col("k") - F.col("n")).alias("k"), (F.col("s") - F.col("h")).alias("s"))))
    every = sums.groupBy("reach").agg(full.alias("at"), F.sum("n").alias("k"), F.sum("h").alias("s"))
    every = written(every, "fills")
    inside = rows.select("reach", "step", "level", "height").join(every.where("at IS NOT NULL").select("reach", F.col("at.step").alias("step"), F.col("at.k").alias("k"), F.col("at.s").alias("s")), ["reach", "step"])
    by_level = inside.groupBy("reach", "level").agg(F.count("*").alias("n"), F.sum("height").alias("h"), F.first("k").alias("k0"), F.first("s").alias("s0"))
    rising = Window.partitionBy("reach").orderBy("level")
    upto = rising.rowsBetween(Window.unboundedPreceding, 0)
    by_level = by_level.withColumn("k", F.col("k0") + F.sum("n").over(upto)).withColumn("s", F.col("s0") + F.sum("h").over(upto)).withColumn("next", F.lead("level").over(rising))
    # before the step's first cell, too, the volume may be reached
    first = by_level.groupBy("reach").agg(F.min("level").alias("next"), F.first("k0").alias("k"), F.first("s0").alias("s")).where("k > 0").withColumn("level", F.lit(None).cast("double"))
    states = by_level.select("reach", "level", "k", "s", "next").unionByName(first.select("reach", "level", "k", "s", "next"))
    wanted = F.try_divide(F.lit(volume / area) + F.col("s"), F.col("k"))
    hit = states.withColumn("at", F.greatest(wanted, "level")).where("next IS NULL OR at <= next")
    hit = hit.groupBy("reach").agg(F.min(F.struct("at", "k", "s")).alias("f")).select("reach", "f.at", "f.k", "f.s")
    whole = every.where("at IS NULL").select("reach", wanted.alias("at"), "k", "s")
    found = hit.unionByName(whole).select("reach", F.col("at").alias("level"), ((F.col("k") * F.col("at") - F.col("s")) * area).alias("volume"), F.col("k").cast("long").alias("cells"))
    reaches = cells.select("reach").distinct().join(found, "reach", "left")
    return reaches.select("reach", "level", F.coalesce("volume", F.lit(0.0)).alias("volume"), F.coalesce("cells", F.lit(0).cast("long")).alias("cells"))


def successors(ways: DataFrame) -> DataFrame:
    """(node, to): of each way (way, a, b, cls, km) the one it flows on into, the lowest class that begins where it ends, then the longest.

    Where ways run in a circle, the pointer back to the circle's smallest way is cut, so every walk ends.
    """
    best = Window.partitionBy("node").orderBy("cls", F.desc("km"), "to")
    heads = ways.select(F.col("a").alias("b"), F.col("way").alias("to"), "cls", "km")
    pointers = ways.select(F.col("way").alias("node"), "b").join(_large(heads), "b").where("node <> to")
    pointers = written(pointers.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("node", "to"), "successors")
    # who still goes on after more steps than there are ways goes round; where they are then is the circles
    far, steps, n = pointers, 1, pointers.count()
    while steps < n and not far.isEmpty():
        ahead = far.select(F.col("node").alias("to"), F.col("to").alias("next"))
        far, steps = written(far.join(_large(ahead), "to").select("node", F.col("next").alias("to")), "jumps"), 2 * steps
    circles = far.select(F.col("to").alias("node")).distinct()
    around = written(pointers.join(_large(circles), "node", "left_semi"), "circles")
    if around.isEmpty():
        return pointers
    first = components(around.select(F.col("node").alias("u"), F.col("to").alias("v"))).select("node", "root")
    back = around.join(_large(first), "node").where("to = root").select("node")
    return written(pointers.join(_large(back), "node", "left_anti"), "successors")


def walks(ways: DataFrame, pointers: DataFrame) -> DataFrame:
    """(way, outlet, ways, km): where each way's water ends, over how many ways and how far, both ends included."""
    own = ways.select(F.col("way").alias("node"), "km")
    add = F.struct(F.lit(1).cast("long").alias("n"), F.col("km").cast("double").alias("km"))
    sums = lambda a, b: F.struct((a["n"] + b["n"]).alias("n"), (a["km"] + b["km"]).alias("km"))
    found = pointer_doubling(pointers.join(_large(own), "node"), add=add, combine=sums)
    found = own.join(_large(found), "node", "left").select("node", F.coalesce("outlet", "node").alias("outlet"), "steps", "km")
    last = own.select(F.col("node").alias("outlet"), F.col("km").cast("double").alias("_last"))
    found = found.join(_large(last), "outlet")
    return found.select(
        F.col("node").alias("way"), "outlet", (F.coalesce("steps.n", F.lit(0).cast("long")) + 1).alias("ways"), (F.coalesce("steps.km", F.lit(0.0)) + F.col("_last")).alias("km")
    )


def lower_reaches(ways: DataFrame, main: DataFrame, least_km: float, reach_km: float) -> DataFrame:
    """(way, at, network_km, reach_km, ways): of each way that ends on the main stem its lower reach, followed back up the largest channel.

    ``main`` is (way). Left out are mouths with less than ``least_km`` of network above them, themselves included. The reach ends after
    ``reach_km`` or where nothing comes in any more.
    """
    stem = ways.join(main, "way", "left_semi")
    rest = written(ways.join(main, "way", "left_anti"), "streams")
    on_stem = stem.select(F.col("a").alias("b")).union(stem.select("b")).distinct()
    mouths = rest.join(on_stem, "b", "left_semi").select("way", F.col("b").alias("at"), "km")
    # the network above: every way that ends where a way of it begins
    flow = rest.select(F.col("way").alias("node"), "b").join(_large(rest.select(F.col("a").alias("b"), F.col("way").alias("to"))), "b").where("node <> to").select("node", "to")
    above = upstream(flow, mouths.select(F.col("way").alias("node"))).join(_large(rest.select(F.col("way").alias("node"), "km")), "node")
    network = above.groupBy(F.col("target").alias("way")).agg(F.sum("km").alias("network_km")).where(F.col("network_km") >= least_km)
    best = Window.partitionBy("to").orderBy("cls", F.desc("km"), "node")
    back = flow.join(_large(rest.select(F.col("way").alias("node"), "cls", "km")), "node").withColumn("_r", F.row_number().over(best)).where("_r = 1")
    back = written(back.select(F.col("to").alias("at_way"), F.col("node").alias("next"), F.col("km").alias("more")), "inflows")
    large = written(mouths.join(network, "way"), "mouths")
    front = written(large.select("way", F.col("way").alias("at_way"), F.col("km").alias("have"), F.lit(1).cast("long").alias("n"), F.array("way").alias("seen")), "front")
    done = []
    while not front.isEmpty():
        going = front.where(F.col("have") < reach_km).join(_large(back), "at_way", "left").withColumn("_on", F.col("next").isNotNull() & ~F.coalesce(F.array_contains("seen", F.col("next")), F.lit(False)))
        going = written(going, "going")
        done += [front.where(F.col("have") >= reach_km).select("way", "have", "n"), going.where("NOT _on").select("way", "have", "n")]
        on = going.where("_on").select("way", F.col("next").alias("at_way"), (F.col("have") + F.col("more")).alias("have"), (F.col("n") + 1).alias("n"), F.concat("seen", F.array("next")).alias("seen"))
        front = written(on, "front")
    if not done:
        return large.select("way", "at", "network_km", F.col("km").alias("reach_km"), F.lit(1).cast("long").alias("ways"))
    found = reduce(DataFrame.unionByName, done)
    return large.join(found, "way").select("way", "at", "network_km", F.least("have", F.lit(float(reach_km))).alias("reach_km"), F.col("n").alias("ways"))
