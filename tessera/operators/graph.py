"""Graph operators on DataFrames of any size: nothing is collected, each round is a join and a grouped aggregate.

Edges are (src, dst, ...) between string ids. An adjacency is (u, v, n): both directions, n parallel edges,
without loops. Rounds that go on write their state to the shared folder, so lineage stays short.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.components import components
from tessera.operators.ranking import numbered
from tessera.session import reachable
from tessera.storage import forget, stored


def project(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations that aren't rejected between active entities.

    The ids are merged: by its columns' share of a compressed file Spark takes a table of them for far smaller than it is,
    and broadcasts it through the driver.
    """
    active = entities.where("active").select("uid").hint("merge")
    live = relations.where("status <> 'REJECTED'")
    live = live.join(active.withColumnRenamed("uid", "src"), "src", "left_semi")
    return live.join(active.withColumnRenamed("uid", "dst"), "dst", "left_semi")


def adjacency(edges: DataFrame) -> DataFrame:
    e = edges.where("src <> dst")
    both = e.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(e.select("dst", "src"))
    return both.groupBy("u", "v").agg(F.count("*").alias("n"))


def degrees(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """(uid, degree, weighted, centrality) of all nodes (uid); centrality is degree over the number of other nodes."""
    own = adj.groupBy(F.col("u").alias("uid")).agg(F.count("*").alias("degree"), F.sum("n").alias("weighted"))
    size = nodes.agg(F.count("*").alias("size"))
    out = nodes.select("uid").join(own, "uid", "left").crossJoin(F.broadcast(size))  # one row
    degree = F.coalesce("degree", F.lit(0))
    return out.select("uid", degree.alias("degree"), F.coalesce("weighted", F.lit(0)).alias("weighted"), F.when(F.col("size") > 1, degree / (F.col("size") - 1)).otherwise(0.0).alias("centrality"))


def k_hop(adj: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, hop) of all nodes within depth of each start (column start)."""
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hop"))
    last = seen
    for hop in range(1, depth + 1):
        step = last.join(adj, last["node"] == adj["u"]).select("start", F.col("v").alias("node")).distinct()
        last = step.join(seen, ["start", "node"], "left_anti").withColumn("hop", F.lit(hop))
        if hop < depth:  # read again by the next hop and by the result
            last = stored(last, "hop")
        seen = seen.union(last)
    return seen


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (uid)."""
    own = nodes.select("uid").distinct()
    return edges.join(own.withColumnRenamed("uid", "dst"), "dst", "left_semi").join(own.withColumnRenamed("uid", "src"), "src", "left_semi")


def shortest_paths(adj: DataFrame, pairs: DataFrame, longest: int) -> DataFrame:
    """(src, dst, path) of each pair (src, dst) within `longest` steps; of equal ones the first in order of ids."""
    last = pairs.select("src", "dst", F.col("src").alias("node"), F.array("src").alias("path"))
    seen, done = last.select("src", "dst", "node"), last.where("src = dst").select("src", "dst", "path")
    for _ in range(longest):
        step = last.where("node <> dst").join(adj, last["node"] == adj["u"])
        step = step.groupBy("src", "dst", F.col("v").alias("node")).agg(F.min(F.concat("path", F.array("v"))).alias("path"))
        last = stored(step.join(seen, ["src", "dst", "node"], "left_anti"), "paths")
        found = last.where("node = dst").select("src", "dst", "path")
        done = done.union(found)
        last = last.join(found.select("src", "dst"), ["src", "dst"], "left_anti")
        seen = seen.union(last.select("src", "dst", "node"))
    return done


def simple_paths(adj: DataFrame, pairs: DataFrame, longest: int, cost: Column | None = None) -> DataFrame:
    """(src, dst, path, cost) of all loopless paths of at most `longest` steps; cost: of an adjacency row, else 1."""
    steps = adj.select("u", "v", (cost if cost is not None else F.lit(1.0)).cast("double").alias("w"))
    last = pairs.select("src", "dst", F.array("src").alias("path"), F.lit(0.0).alias("cost"))
    done = last.where("src = dst")
    for _ in range(longest):
        open_paths = last.where("element_at(path, -1) <> dst")
        grown = open_paths.join(steps, F.element_at("path", -1) == steps["u"]).where(~F.array_contains("path", F.col("v")))
        last = stored(grown.select("src", "dst", F.concat("path", F.array("v")).alias("path"), (F.col("cost") + F.col("w")).alias("cost")), "walks")
        done = done.union(last.where("element_at(path, -1) = dst"))
    return done


def least_costs(steps: DataFrame, ends: DataFrame) -> DataFrame:
    """(dst, node, least): the cost of the cheapest way from each node to each of ends (dst); steps: (u, v, w), w >= 0."""
    best = stored(ends.select("dst", F.col("dst").alias("node"), F.lit(0.0).alias("least"), F.lit(True).alias("fresh")), "costs")
    while True:
        step = best.where("fresh").join(steps, F.col("node") == F.col("v"))
        offers = best.select("dst", "node", "least", F.col("least").alias("had")).union(step.select("dst", "u", F.col("least") + F.col("w"), F.lit(None).cast("double")))
        offers = offers.groupBy("dst", "node").agg(F.min("least").alias("least"), F.max("had").alias("had"))
        after = stored(offers.select("dst", "node", "least", F.coalesce(F.col("least") < F.col("had"), F.lit(True)).alias("fresh")), "costs")
        forget(best)
        best = after
        if best.where("fresh").isEmpty():
            return best.drop("fresh")


def _cheapest(steps: DataFrame, rest: DataFrame, start: DataFrame, bound: DataFrame, k: int, beam: bool) -> DataFrame:
    """The k cheapest loopless paths of each pair whose cost stays within its bound (src, dst, bound).

    A path goes on if its cost and the least rest to the end are within the bound and the cost of the k-th path
    found. With beam only k of the paths that stand at a node in a round go on, so some are missed, but all is small.
    """
    order = Window.partitionBy("src", "dst").orderBy("cost", F.size("path"), "path")
    last, done = start.where("src <> dst"), start.where("src = dst").select("src", "dst", "path", "cost")
    limits = bound.select("src", "dst", F.col("bound").alias("limit"))
    while True:
        grown = last.join(steps, F.element_at("path", -1) == steps["u"]).where(~F.array_contains("path", F.col("v")))
        grown = grown.select("src", "dst", F.concat("path", F.array("v")).alias("path"), (F.col("cost") + F.col("w")).alias("cost"), F.col("v").alias("node"))
        grown = grown.join(rest, ["dst", "node"]).join(limits, ["src", "dst"], "left")
        grown = grown.where("limit is null or cost + least <= limit * (1 + 1e-9)")
        if beam:
            grown = grown.withColumn("place", F.row_number().over(Window.partitionBy("src", "dst", "node").orderBy("cost", "path"))).where(F.col("place") <= k)
        grown = stored(grown.select("src", "dst", "path", "cost", "node"), "routes")
        rows, ended = grown.agg(F.count("*"), F.count_if(F.col("node") == F.col("dst"))).first()
        if not rows:
            return done
        if ended:
            whole = grown.where("node = dst").select("src", "dst", "path", "cost")
            done = stored(done.union(whole).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place"), "routes")
            full = done.groupBy("src", "dst").agg(F.max("cost").alias("found"), F.count("*").alias("n")).where(F.col("n") == k).drop("n")
            limits = stored(bound.join(full, ["src", "dst"], "full").select("src", "dst", F.least("bound", "found").alias("limit")), "limits")
        last = grown.where("node <> dst")


def cheapest_paths(adj: DataFrame, pairs: DataFrame, k: int, cost: Column) -> DataFrame:
    """(src, dst, path, cost): the k cheapest loopless paths of each pair (src, dst), of any number of steps.

    Ties go by the number of steps, then by the path. cost: of an adjacency row, not negative. A beam finds k paths of
    each pair first; their largest cost then bounds the whole search, which misses none.
    """
    steps = stored(adj.select("u", "v", cost.cast("double").alias("w")), "steps")
    rest = least_costs(steps, pairs.select("dst").distinct())
    start = stored(pairs.select("src", "dst", F.array("src").alias("path"), F.lit(0.0).alias("cost")).distinct(), "routes")
    none = start.select("src", "dst", F.lit(None).cast("double").alias("bound")).limit(0)
    soon = _cheapest(steps, rest, start, none, k, True)
    full = soon.groupBy("src", "dst").agg(F.max("cost").alias("bound"), F.count("*").alias("n")).where(F.col("n") == k).drop("n")
    return _cheapest(steps, rest, start, stored(full, "limits"), k, False)


#: Neighbours of a middle that meet as one block; a middle with more is cut into blocks, and each pair of them is a row of its own.
BLOCK = 512


def pair_sums(adj: DataFrame, ends: DataFrame | None = None, values: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b, shared, ...) for a < b that share neighbours and aren't neighbours, with sums over the shared ones.

    ends: adjacency rows whose u may be a or b (all by default). values: (mid, ...) numbers of each middle that counts;
    their sums follow under the same names. A hub's neighbours are dealt to blocks by hash, and its pairs of blocks to
    tasks, so no task holds all pairs round a hub; a task adds up its pairs before they are shuffled.
    """
    own = (adj if ends is None else ends).select(F.col("v").alias("mid"), "u")
    names = [] if values is None else [c for c in values.columns if c != "mid"]
    mids = own.groupBy("mid").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    if values is not None:
        mids = mids.join(values, "mid")
    mids = stored(mids, "middles")
    dealt = own.join(mids.select("mid", "blocks"), "mid").groupBy("mid", F.pmod(F.xxhash64("u"), "blocks").cast("int").alias("i")).agg(F.sort_array(F.collect_list("u")).alias("us"))
    dealt = stored(dealt, "blocks")
    within = dealt.join(mids, "mid").select("us", *names, F.posexplode("us").alias("at", "a")).select("a", F.explode(F.slice("us", F.col("at") + 2, F.size("us"))).alias("b"), *names)
    two = mids.where("blocks > 1").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 2))).withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.col("blocks") - 1)))
    two = two.join(dealt.withColumnRenamed("us", "xs"), ["mid", "i"]).join(dealt.withColumnsRenamed({"i": "j", "us": "ys"}), ["mid", "j"])
    across = two.select("ys", *names, F.explode("xs").alias("x")).select("x", F.explode("ys").alias("y"), *names)
    pairs = within.union(across.select(F.least("x", "y"), F.greatest("x", "y"), *names))
    sums = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), *(F.sum(c).alias(c) for c in names))
    return sums.join(adj.select(F.col("u").alias("a"), F.col("v").alias("b")), ["a", "b"], "left_anti")


def rarity(degree: str = "degree") -> Column:
    """What a shared neighbour of that degree counts: 1 / ln(degree), nothing up to degree 1."""
    return F.when(F.col(degree) > 1, 1 / F.log(F.col(degree))).otherwise(0.0)


def adamic_adar(adj: DataFrame) -> DataFrame:
    """(a, b, shared, score) of pairs that aren't linked: the sum of 1 / ln(degree) over shared neighbours."""
    degree = adj.groupBy(F.col("u").alias("mid")).agg(F.count("*").alias("degree"))
    return pair_sums(adj, values=degree.select("mid", rarity().alias("score")))


def pivots(nodes: DataFrame, k: int) -> DataFrame:
    """k nodes by the smallest hash, a sample that doesn't depend on partitions."""
    return nodes.select("uid").orderBy(F.sha2("uid", 256), "uid").limit(k)


#: Nodes up to which a centrality may ask for all sources, and the pivots that estimate it above.
EXACT_NODES, CENTRALITY_PIVOTS = 700, 220


def centrality_sources(nodes: DataFrame) -> DataFrame | None:
    """None, for an exact centrality, of a small graph; else its pivots."""
    return None if nodes.limit(EXACT_NODES + 1).count() <= EXACT_NODES else pivots(nodes, CENTRALITY_PIVOTS)


#: Sources that are searched together, as the bits of a number.
WIDTH = 64


def _numbered(adj: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(uid, id) of the linked nodes, (u, v) by id, and the linked sources as (block, node, slot)."""
    names = stored(numbered(adj.select(F.col("u").alias("uid")).distinct(), [F.col("uid")], "id"), "names")
    by = lambda c: names.select(F.col("uid").alias(c), F.col("id").alias(f"{c}_id")).hint("merge")
    steps = stored(adj.select("u", "v").join(by("u"), "u").join(by("v"), "v").select(F.col("u_id").alias("u"), F.col("v_id").alias("v")), "steps")
    own = numbered(sources.select("uid").distinct().join(names, "uid"), [F.col("id")], "turn")
    turn = F.col("turn") - 1
    return names, steps, stored(own.select(F.floor(turn / WIDTH).alias("block"), F.col("id").alias("node"), F.pmod(turn, F.lit(WIDTH)).cast("int").alias("slot")), "sources")


#: Adjacency rows of a graph that a task may hold to search from its share of the sources; larger ones go level by level.
WHOLE_GRAPH = 200_000


def _near(steps: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, and the neighbours of node i (by place) at near[first[i]:first[i + 1]]."""
    ids, flat = np.unique(steps[["u", "v"]].to_numpy().T, return_inverse=True)
    u, v = flat.reshape(2, -1)
    order = np.argsort(u, kind="stable")
    return ids, v[order], np.searchsorted(u[order], np.arange(len(ids) + 1))


#: Adjacency rows times sources that _searches() holds at once, and that a task of _dealt_sums() goes through, about.
AT_ONCE, TASK_STEPS = 2_000_000, 50_000_000


def _searches(near: np.ndarray, first: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By (start, node): distances (-1: not reached), and each node's dependency on the start; all starts take a level at once."""
    size = len(first) - 1
    distance, paths, depend = np.full(len(starts) * size, -1), np.zeros(len(starts) * size), np.zeros(len(starts) * size)
    begin, mark = np.arange(len(starts)) * size + starts, np.zeros(len(starts) * size, dtype=np.int64)
    level, steps = begin, []
    distance[begin], paths[begin] = 0, 1.0
    while len(level):
        node = level % size
        n = first[node + 1] - first[node]
        a, own = np.repeat(level, n), np.repeat(node, n)
        b = a - own + near[np.repeat(first[node] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        new = distance[b] < 0
        a, b = a[new], b[new]
        distance[b] = len(steps) + 1
        steps.append((a, b))
        np.add.at(paths, b, paths[a])
        places = np.arange(len(b))
        mark[b] = places  # the last one of equal nodes stays
        level = b[mark[b] == places]
    for a, b in reversed(steps):
        np.add.at(depend, a, paths[a] / paths[b] * (1 + depend[b]))
    depend[begin] = 0
    return distance.reshape(len(starts), size), depend.reshape(len(starts), size)


def _shared_search(key: tuple, sources: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
    ids, near, first = _near(steps)
    delta, r, d = (np.zeros(len(ids)) for _ in range(3))
    starts, width = np.searchsorted(ids, sources["node"].to_numpy()), max(1, AT_ONCE // len(near)) if len(near) else 1
    for i in range(0, len(starts), width):
        distance, depend = _searches(near, first, starts[i : i + width])
        delta, r, d = delta + depend.sum(axis=0), r + (distance > 0).sum(axis=0), d + np.maximum(distance, 0).sum(axis=0)
    return pd.DataFrame({"node": ids, "delta": delta, "r": r, "d": d})


def _in_tasks(own: DataFrame, steps: DataFrame, key: list[str], tasks: int) -> DataFrame:
    """(node, delta, r, d): each key's sources (node) over its copy of a graph (u, v)."""
    reachable(own.sparkSession)
    steps = steps.select(*(F.col(c).alias(c) for c in steps.columns))  # both may come from one table
    rows = own.repartition(tasks, *key).groupBy(*key).cogroup(steps.repartition(tasks, *key).groupBy(*key))
    sums = rows.applyInPandas(_shared_search, "node long, delta double, r double, d double")
    return sums.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("delta", "r", "d"))).where("r > 0")


def _small_sums(steps: DataFrame, own: DataFrame) -> DataFrame:
    """(node, delta, r, d) of a graph of at most WHOLE_GRAPH rows: the shuffle deals a copy of it to each share of the sources."""
    shares = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = own.select(F.pmod(F.col("block") * WIDTH + F.col("slot"), F.lit(shares)).alias("share"), "node")
    return _in_tasks(own, steps.withColumn("share", F.explode(F.expr(f"sequence(0L, {shares - 1}L)"))), ["share"], shares)


#: Adjacency rows of a component up to which it shares a task with others, and rows that such components of a task have about.
TINY, TOGETHER = 2_000, 20_000


def _parted(steps: DataFrame, own: DataFrame, whole: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node, delta, r, d) of components of at most `whole` rows, and the steps and sources of the larger ones.

    A component's copies are dealt to shares of its sources, by the steps that their searches take; tiny ones go together.
    """
    label = components(steps.select(F.col("u").alias("src"), F.col("v").alias("dst"))).hint("merge")
    steps = stored(steps.join(label, F.col("u") == F.col("node")).select("component", "u", "v"), "steps")
    own = stored(own.join(label, "node").select("component", "node", "block", "slot"), "sources")
    parts = steps.groupBy("component").agg(F.count("*").alias("rows")).join(own.groupBy("component").agg(F.count("*").alias("sources")).hint("merge"), "component")
    parts = stored(parts, "parts")
    low = F.col("rows") <= TINY
    bins = parts.where(low).agg(F.ceil(F.sum("rows") / TOGETHER)).first()[0] or 1
    group = F.when(low, -1 - F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(F.col("component"))
    shares = F.when(low, 1).otherwise(F.ceil(F.col("rows") * F.col("sources") / TASK_STEPS))
    dealt = parts.where(F.col("rows") <= whole).select("component", group.alias("group"), shares.cast("int").alias("shares")).hint("merge")
    tasks = max(int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions")), dealt.groupBy("group").agg(F.max("shares").alias("n")).agg(F.sum("n")).first()[0] or 0)
    small = _in_tasks(
        own.join(dealt, "component").select("group", F.pmod(F.xxhash64("node"), "shares").cast("int").alias("share"), "node"),
        steps.join(dealt, "component").select("group", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "u", "v"),
        ["group", "share"], tasks,
    )
    large = parts.where(F.col("rows") > whole).select("component").hint("merge")
    return small, steps.join(large, "component", "left_semi").drop("component"), own.join(large, "component", "left_semi").drop("component")


#: Rows of all levels of a pass by levels, about.
LEVEL_ROWS = 200_000_000


def _passes(steps: DataFrame, own: DataFrame, rows: int, by_levels: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame | None:
    """Sums by node over all sources, some blocks of them in a pass, so that its levels stay within LEVEL_ROWS; rows: of a block at a node."""
    last = own.agg(F.max("block")).first()[0]
    if last is None:
        return None
    width = max(1, LEVEL_ROWS // (rows * steps.select("u").distinct().count()))
    sums = None
    for i in range(0, last + 1, width):
        more = by_levels(steps, own.where(F.col("block").between(i, i + width - 1)))
        if more is not None and sums is not None:
            before, values = sums, [F.sum(c).alias(c) for c in sums.columns if c != "node"]
            sums = stored(before.union(more).groupBy("node").agg(*values), "sums")
            forget(before, more)
        elif more is not None:
            sums = more
    return sums


def _sums(adj: DataFrame, sources: DataFrame, whole: int, rows: int, by_levels: Callable[[DataFrame, DataFrame], DataFrame], columns: list[str]) -> DataFrame:
    """(uid, ...) sums over sources: in tasks that hold a graph, or its components, of at most `whole` rows, else by levels."""
    names, steps, own = _numbered(adj, sources)
    large = None
    if _is_small(adj, whole):
        small = _small_sums(steps, own)
    elif whole:
        small, steps, own = _parted(steps, own, whole)
        large = None if steps.isEmpty() else _passes(stored(steps, "steps"), stored(own, "sources"), rows, by_levels)
    else:
        small, large = None, _passes(steps, own, rows, by_levels)
    both = [f.select("node", *columns) for f in (small, large) if f is not None]
    if not both:
        return names.select("uid", *(F.lit(0.0).alias(c) for c in columns)).limit(0)
    sums = both[0] if len(both) == 1 else both[0].union(both[1])
    return sums.join(names, F.col("node") == F.col("id")).select("uid", *columns)


def _is_small(adj: DataFrame, whole: int) -> bool:
    return adj.limit(whole + 1).count() <= whole


def reach_sums(steps: DataFrame, own: DataFrame) -> DataFrame | None:
    """(node, r, d), stored: how many sources reach a node, and the sum of their distances, 64 sources a row.

    A level is (block, node, bits); neighbours take the bits of those before them, but for the ones that they had.
    Levels are merged with the steps: a level's file looks small, and broadcasting each would send them all through the driver.
    """
    last = stored(own.select("block", "node", F.expr("shiftleft(1L, slot)").alias("bits")), "level")
    before, parts, hop, made = None, [], 0, [last]
    while True:
        hop += 1
        seen = last if before is None else last.union(before)  # a neighbour lies one level before, in the same level, or after
        step = last.hint("merge").join(steps, last["node"] == steps["u"]).select("block", F.col("v").alias("node"), "bits", F.lit(0).cast("long").alias("had"))
        step = step.union(seen.select("block", "node", F.lit(0).cast("long"), "bits")).groupBy("block", "node").agg(F.bit_or("bits").alias("bits"), F.bit_or("had").alias("had"))
        level = stored(step.select("block", "node", F.col("bits").bitwiseAND(F.bitwise_not("had")).alias("bits")).where("bits <> 0"), "level")
        made.append(level)
        if level.isEmpty():
            break
        parts.append(level.select("node", F.bit_count("bits").alias("r"), F.lit(hop).alias("hop")))
        before, last = last, level
    if not parts:
        return None
    rows = reduce(DataFrame.union, parts)
    sums = stored(rows.groupBy("node").agg(F.sum("r").cast("double").alias("r"), F.sum(F.col("r") * F.col("hop")).cast("double").alias("d")), "sums")
    forget(*made)
    return sums


def dependency_sums(steps: DataFrame, own: DataFrame) -> DataFrame | None:
    """(node, delta), stored: the sum of a node's dependencies over the sources.

    Forwards, a level is (source, node, paths), the number of shortest paths; backwards, each node's share goes to the
    neighbours one level nearer. A step is a join with the steps and one grouped sum, in which the rows of the
    level that it meets (or of those that it must not go back to) take part, so each level is shuffled once. No level is broadcast.
    """
    levels = [stored(own.select((F.col("block") * WIDTH + F.col("slot")).alias("source"), "node", F.lit(1.0).alias("paths")), "level")]
    while True:
        step = levels[-1].hint("merge").join(steps, levels[-1]["node"] == steps["u"]).select("source", F.col("v").alias("node"), "paths", F.lit(False).alias("had"))
        for back in levels[-2:]:  # a neighbour lies one level before, in the same level, or after
            step = step.union(back.select("source", "node", F.lit(0.0), F.lit(True)))
        step = step.groupBy("source", "node").agg(F.sum("paths").alias("paths"), F.max("had").alias("had"))
        level = stored(step.where("not had").drop("had"), "level")
        if level.isEmpty():
            forget(level)
            break
        levels.append(level)
    below, parts, made = None, None, []
    for level in reversed(levels[1:]):
        own = level.select("source", "node", "paths", F.lit(0.0).alias("share"))
        if below is not None:
            shares = below.select("source", "node", ((1 + F.col("delta")) / F.col("paths")).alias("share"))
            shares = shares.hint("merge").join(steps, shares["node"] == steps["u"]).select("source", F.col("v").alias("node"), F.lit(None).cast("double").alias("paths"), "share")
            own = own.union(shares).groupBy("source", "node").agg(F.max("paths").alias("paths"), F.sum("share").alias("share")).where("paths is not null")
        below = stored(own.select("source", "node", "paths", (F.col("paths") * F.col("share")).alias("delta")), "delta")
        made.append(below)
        part = below.select("node", "delta")
        parts = part if parts is None else parts.union(part)
    sums = None if parts is None else stored(parts.groupBy("node").agg(F.sum("delta").alias("delta")), "sums")
    forget(*levels, *made)
    return sums


def betweenness(nodes: DataFrame, adj: DataFrame, sources: DataFrame | None = None, whole: int = WHOLE_GRAPH) -> DataFrame:
    """(uid, betweenness) by Brandes' sums from all nodes, or from sources scaled to all; normalised for pairs."""
    n = nodes.count()
    k = n if sources is None else sources.count()
    scale = (n / max(k, 1)) / 2 * (2 / ((n - 1) * (n - 2)) if n > 2 else 1)
    sums = _sums(adj, nodes if sources is None else sources, whole, WIDTH, dependency_sums, ["delta"])
    return nodes.select("uid").join(sums, "uid", "left").select("uid", (F.coalesce("delta", F.lit(0.0)) * scale).alias("betweenness"))


def closeness(nodes: DataFrame, adj: DataFrame, sources: DataFrame | None = None, whole: int = WHOLE_GRAPH) -> DataFrame:
    """(uid, closeness): reached over the sum of distances, times reached over all others (or over the sources)."""
    denominator = nodes.count() - 1 if sources is None else sources.count()
    sums = _sums(adj, nodes if sources is None else sources, whole, 1, reach_sums, ["r", "d"])
    value = (F.col("r") / F.col("d")) * (F.col("r") / F.lit(max(denominator, 1)))
    return nodes.select("uid").join(sums, "uid", "left").select("uid", F.coalesce(value, F.lit(0.0)).alias("closeness"))


def modularity(adj: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the modularity of labels (node, community) on an adjacency weighted by n."""
    l1, l2 = labels.select(F.col("node").alias("u"), F.col("community").alias("cu")), labels.select(F.col("node").alias("v"), F.col("community").alias("cv"))
    e = adj.join(l1, "u").join(l2, "v")
    by = e.groupBy("cu").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("cu") == F.col("cv"), F.col("n")).otherwise(0)).alias("inside"))
    two_m = F.sum("total").cast("double")
    return by.agg((F.sum("inside") / two_m - F.sum(F.pow("total", F.lit(2))) / (two_m * two_m)).alias("modularity"))


#: Levels and rounds a level at most, the least gain of modularity that goes on, and of a node's move.
LEVELS, ROUNDS, LEAST_GAIN, LEAST_MOVE = 10, 200, 1e-9, 1e-12


def moves(adj: DataFrame, labels: DataFrame, two_m: float, turn: int) -> DataFrame:
    """(node, to, gain, some, single) of nodes that may move at once; labels: (node, community, k), adj: (u, v, n).

    A node wants the neighbouring community of the largest gain. Of wants, those go whose number drawn for this turn is larger than
    all their wanting neighbours', so movers have no common edge. Their gains then add up but for what movers to (or
    from) the same community do to its total: some marks moves whose gain covers half of that for all of them, so
    they can't lower modularity together; single marks the best move to and from each community, whose gains add up exactly.
    """
    totals = labels.groupBy("community").agg(F.sum("k").alias("total"))
    own = labels.join(totals, "community").select(F.col("node").alias("u"), F.col("community").alias("own"), "k", F.col("total").alias("own_total"))
    link = adj.where("u <> v").join(labels.select(F.col("node").alias("v"), F.col("community").alias("to")), "v").groupBy("u", "to").agg(F.sum("n").alias("link"))
    option = link.join(own, "u").join(totals.select(F.col("community").alias("to"), F.col("total").alias("to_total")), "to")
    here = F.col("to") == F.col("own")
    value = F.col("link") - F.col("k") * F.col("to_total") / two_m
    best = option.groupBy("u").agg(
        F.max(F.when(~here, F.struct(value.alias("value"), "to"))).alias("best"), F.coalesce(F.max(F.when(here, F.col("link"))), F.lit(0)).alias("stay"),
        F.first("own").alias("own"), F.first("k").alias("k"), F.first("own_total").alias("own_total"),
    )
    gain = F.col("best.value") - (F.col("stay") - F.col("k") * (F.col("own_total") - F.col("k")) / two_m)
    wants = best.select("u", "own", "k", F.col("best.to").alias("to"), gain.alias("gain"), F.xxhash64("u", F.lit(turn)).alias("drawn")).where(F.col("gain") > LEAST_MOVE)
    wants = stored(wants, "wants")
    rival = wants.select(F.col("u").alias("v"), F.col("drawn").alias("other"))
    beaten = adj.where("u <> v").join(wants.select("u", "drawn"), "u").join(rival, "v").where("other > drawn or other = drawn and v > u").select("u").distinct()
    going = stored(wants.join(beaten, "u", "left_anti").drop("drawn"), "going")
    first = F.max(F.struct("gain", "u"))
    arriving = going.groupBy("to").agg(F.sum("k").alias("arriving"), first.alias("first_to"))
    leaving = going.groupBy("own").agg(F.sum("k").alias("leaving"), first.alias("first_from"))
    both = going.join(arriving, "to").join(leaving, "own")
    shared = F.col("k") * (F.col("arriving") + F.col("leaving") - 2 * F.col("k")) / 2 / two_m
    single = (F.col("first_to.u") == F.col("u")) & (F.col("first_from.u") == F.col("u"))
    return both.select(F.col("u").alias("node"), "to", "gain", (F.col("gain") >= shared).alias("some"), single.alias("single"))


def local_moving(adj: DataFrame, two_m: float) -> DataFrame:
    """(node, community, k) after rounds of moves from one community a node, until none gains; modularity never falls."""
    weight = adj.groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("k"))
    labels = stored(weight.select("node", F.col("node").alias("community"), "k"), "labels")
    for turn in range(ROUNDS):
        found = stored(moves(adj, labels, two_m, turn), "moves")
        some, single = found.agg(F.coalesce(F.sum(F.when(F.col("some"), F.col("gain"))), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("single"), F.col("gain"))), F.lit(0.0))).first()
        if 2 * max(some, single) / two_m <= LEAST_GAIN:
            break
        chosen = found.where("some" if some >= single else "single").select("node", "to")
        after = stored(labels.join(chosen, "node", "left").select("node", F.coalesce("to", "community").alias("community"), "k"), "labels")
        forget(labels, found)
        labels = after
    return labels


def _one_visit_each(u: np.ndarray, v: np.ndarray, n: np.ndarray, two_m: int) -> np.ndarray:
    """The community of each node (0, 1, ...) after visits in order; a node is visited again when a neighbour has left it.

    Gains are compared times two_m, as whole numbers, so each move raises modularity and the visits end.
    """
    size, order = int(u.max()) + 1, np.argsort(u, kind="stable")
    first = np.searchsorted(u[order], np.arange(size + 1)).tolist()
    near, links = v[order].tolist(), n[order].tolist()
    k = np.bincount(u, weights=n, minlength=size).astype(np.int64).tolist()
    total, label, queue, waits = list(k), list(range(size)), deque(range(size)), [True] * size
    while queue:
        node = queue.popleft()
        waits[node], own, link = False, label[node], {}
        for i in range(first[node], first[node + 1]):
            if near[i] != node:
                link[label[near[i]]] = link.get(label[near[i]], 0) + links[i]
        total[own] -= k[node]
        best, to = two_m * link.get(own, 0) - k[node] * total[own], own
        for c in sorted(link):
            if (value := two_m * link[c] - k[node] * total[c]) > best:
                best, to = value, c
        total[to] += k[node]
        if to != own:
            label[node] = to
            for other in near[first[node] : first[node + 1]]:
                if label[other] != to and not waits[other]:
                    waits[other] = True
                    queue.append(other)
    return np.array(label)


def _visited(rows: pd.DataFrame, two_m: int) -> pd.DataFrame:
    """(community, top) of whole components with rows (u, v, n): visits of nodes, then of communities, until nothing merges."""
    names, flat = np.unique(rows[["u", "v"]].to_numpy().T, return_inverse=True)
    u, v = flat.reshape(2, -1)
    n, label = rows["n"].to_numpy(), np.arange(len(names))
    while True:
        tops, to = np.unique(_one_visit_each(u, v, n, two_m), return_inverse=True)
        label = to[label]
        if len(tops) == len(to):
            break
        pairs, at = np.unique(to[u] * len(tops) + to[v], return_inverse=True)
        u, v, n = pairs // len(tops), pairs % len(tops), np.bincount(at, weights=n).astype(np.int64)
    _, one = np.unique(label, return_index=True)
    return pd.DataFrame({"community": names, "top": names[one[label]]})


#: Adjacency rows of small components that a task visits together, about.
SHARE_ROWS = 10_000


def _visits(graph: DataFrame, two_m: int) -> DataFrame:
    """(community, top) of components of a bounded size: graph has (component, u, v, n); tasks take a share of the components each."""
    reachable(graph.sparkSession)
    shares = math.ceil(graph.count() / SHARE_ROWS) or 1
    dealt = graph.select(F.pmod(F.xxhash64("component"), F.lit(shares)).alias("share"), "u", "v", "n")
    return dealt.groupBy("share").applyInPandas(lambda rows: _visited(rows, two_m), "community string, top string")


def modularity_communities(adj: DataFrame, whole: int = 0) -> DataFrame:
    """(node, community) by distributed local moving on nodes, then on communities, until modularity gains no more.

    In place of a sequential visit of one node after another, many nodes without a common edge move at once (moves()).
    A level merges each community into one node; up to LEVELS, and it ends when nothing merges or the gain is under LEAST_GAIN.
    No community goes beyond a component and a move's gain depends on nothing outside it but two_m, so components of at
    most `whole` adjacency rows are visited one node after another, each in a task; larger ones as soon as their levels
    have become so small. Rounds are for those only.
    """
    graph = stored(adj, "communities")
    two_m = graph.agg(F.sum("n")).first()[0]
    result = stored(graph.select(F.col("u").alias("node")).distinct().select("node", F.col("node").alias("community")), "communities")
    if not two_m:
        return result
    parts = components(graph.select(F.col("u").alias("src"), F.col("v").alias("dst"))) if whole else None
    before, settled = float("-inf"), None
    for _ in range(LEVELS):
        if whole:
            named = stored(graph.join(parts, F.col("u") == F.col("node")).select("component", "u", "v", "n"), "communities")
            large = named.groupBy("component").count().where(F.col("count") > whole).select("component")
            large = stored(large, "large")
            small = named.join(large, "component", "left_anti")
            own = stored(_visits(small, two_m), "visited")
            done = result.join(own, "community").select("node", F.col("top").alias("community"))
            settled = done if settled is None else settled.union(done)
            if large.isEmpty():
                return stored(settled, "communities")
            result = stored(result.join(own, "community", "left_anti").select("node", "community"), "communities")
            graph = stored(named.join(large, "component", "left_semi").select("u", "v", "n"), "communities")
        labels = local_moving(graph, float(two_m))
        up = labels.select(F.col("node").alias("community"), F.col("community").alias("top"))
        merged = stored(result.join(up, "community").select("node", F.col("top").alias("community")), "communities")
        size, communities = labels.agg(F.count("*"), F.count_distinct("community")).first()
        a, b = labels.select(F.col("node").alias("u"), F.col("community").alias("cu")), labels.select(F.col("node").alias("v"), F.col("community").alias("cv"))
        graph = stored(graph.join(a, "u").join(b, "v").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("n").alias("n")), "communities")
        own = graph.groupBy("u").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("u") == F.col("v"), F.col("n")).otherwise(0)).alias("inside"))
        now = own.agg(F.sum("inside") / two_m - F.sum(F.pow(F.col("total") / two_m, F.lit(2)))).first()[0]
        result = merged
        if communities == size or (not whole and now <= before + LEAST_GAIN):
            break
        before = now
    return result if settled is None else stored(settled.union(result), "communities")


def compact(labels: DataFrame) -> DataFrame:
    """(node, community) with communities numbered by size from the largest, then by name."""
    sizes = labels.groupBy("community").agg(F.count("*").alias("size"))
    number = numbered(sizes, [F.desc("size"), F.col("community")], "number").select("community", (F.col("number") - 1).alias("number"))
    return labels.join(number, "community").select("node", F.col("number").alias("community"))


def explained(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """(src, dst, hop, a, b, rid, status, all_observed): the most certain edge of each hop of a path."""
    steps = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(i.alias("hop"), F.element_at("path", i).alias("a"), F.element_at("path", i + 1).alias("b")))
    hops = paths.where(F.size("path") > 1).select("src", "dst", F.explode(steps).alias("s")).select("src", "dst", "s.*")
    ends = edges.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y"), "rid", "status", "confidence")
    best = ends.groupBy("x", "y").agg(F.max(F.struct("confidence", (-F.col("rid")).alias("order"), "rid", "status")).alias("e"))
    joined = hops.join(best, (F.least("a", "b") == best["x"]) & (F.greatest("a", "b") == best["y"]))
    whole = joined.groupBy("src", "dst").agg(F.every(F.col("e")["status"] == "OBSERVED").alias("all_observed"))
    return joined.select("src", "dst", "hop", "a", "b", F.col("e")["rid"].alias("rid"), F.col("e")["status"].alias("status")).join(whole, ["src", "dst"])
