"""Connected components of a large undirected graph by alternating stars, all in DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.sources.scratch import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to its smallest neighbour (itself included)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(smallest, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the smallest of them. Edges have ``a < b``."""
    smallest = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(smallest, "b").select(F.col("m").alias("x"), F.col("a").alias("y"))
    own = smallest.select(F.col("m").alias("x"), F.col("b").alias("y"))
    return moved.union(own).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a < b)``; ``root`` is the component's smallest node.

    Each round is two joins over the edges that are left, written to the shared folder; the number of rounds grows
    with the logarithm of the longest path. Only a count and a checksum reach the driver. Stars share their centre as a
    key: the joins' other side has one row a key, so adaptive execution can split a hot centre.
    """
    now, mark = edges, _mark(edges)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        now = materialize(_small_star(_large_star(now)), "components")
        new = _mark(now)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def component_of(edges: DataFrame, seeds: DataFrame, rounds: int = 8) -> DataFrame:
    """``(node)``: everything reachable from ``seeds(node)`` over the undirected ``edges(a, b)``, seeds included.

    Breadth first: only the frontier joins the edges, and what is visited never comes back. What is not exhausted in a few rounds has long paths: then
    components of all edges, which take rounds by the logarithm, are joined with the seeds.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "reach-edges")
    visited = frontier = materialize(seeds.select("node").distinct(), "reach")
    for _ in range(rounds):
        step = both.join(frontier, both["a"] == frontier["node"], "left_semi").select(F.col("b").alias("node")).distinct()
        frontier = materialize(step.join(visited, "node", "left_anti"), "reach")
        if frontier.isEmpty():
            return visited
        visited = visited.unionByName(frontier)
    found = materialize(connected_components(both.where("a < b")), "reach-components")
    roots = found.join(visited, "node", "left_semi").select("root").distinct()
    return found.join(roots, "root", "left_semi").select("node").union(visited.select("node")).distinct()


def ancestors(nodes: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(start, ancestor, depth)`` up the parent pointers of ``nodes(node_id, parent_id)``, each start itself at depth 0.

    Levels are joined one by one, for all starts together, until none has a parent left, or to ``max_depth`` where one is asked for. Each level is written once
    and joins only the level before. Parent pointers that run in a circle never end, so a level that is deeper than there are nodes raises.
    """
    parents = nodes.where("parent_id is not null").select(F.col("node_id").alias("child"), F.col("parent_id").alias("parent"))
    level = starts.select(F.col("node_id").alias("start"), F.col("node_id").alias("ancestor")).distinct().withColumn("depth", F.lit(0))
    level = materialize(level, "ancestors")
    found, depth, bound = [level], 0, None
    while max_depth is None or depth < max_depth:
        depth += 1
        level = materialize(level.join(parents, F.col("ancestor") == F.col("child")).select("start", F.col("parent").alias("ancestor"), F.lit(depth).alias("depth")), "ancestors")
        if level.isEmpty():
            break
        found.append(level)
        if depth % 64 == 0:
            bound = bound if bound is not None else nodes.count()
            if depth > bound:
                raise ValueError("the parent pointers run in a circle")
            found = [materialize(reduce(DataFrame.unionByName, found), "ancestors-so-far")]
    return reduce(DataFrame.unionByName, found)


def reached_above(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """``starts(node_id, ...)`` for each of their nodes and all ancestors of these in ``nodes(node_id, parent_id)``: ``node_id`` becomes the ancestor; rows may repeat.

    Rows that meet at a node with the same other columns go on as one. Each round doubles the height, with pointers made of two of the round before, so the
    number of rounds grows with the logarithm of the depth. Parent pointers that run in a circle above a start never end, so a height beyond the number of nodes raises.
    """
    others = [c for c in starts.columns if c != "node_id"]
    pointers = materialize(nodes.where("parent_id is not null").select(F.col("node_id").alias("_from"), F.col("parent_id").alias("_to")), "pointers")
    found, height, bound = materialize(starts.where("node_id is not null").distinct(), "reached"), 1, None
    while True:
        step = found.join(pointers, F.col("node_id") == F.col("_from")).select(F.col("_to").alias("node_id"), *others).distinct()
        step = materialize(step, "reached")
        if step.isEmpty():
            return found
        if height >= 64:
            bound = bound if bound is not None else nodes.count()
            if height >= bound:
                raise ValueError("the parent pointers run in a circle")
        found, height = found.unionByName(step), 2 * height
        further = pointers.select(F.col("_from").alias("_middle"), F.col("_to").alias("_top"))
        pointers = materialize(pointers.join(further, F.col("_to") == F.col("_middle")).select("_from", F.col("_top").alias("_to")), "pointers")


def nearest_ancestor(closure: DataFrame, kinds: DataFrame, wanted: list[str], prefixes: list[str] = ()) -> DataFrame:
    """``(start, ancestor, depth)``: of each start the nearest ancestor of a wanted kind, or of one that begins with a wanted prefix; ``kinds(node_id, kind)``."""
    fits = reduce(lambda a, p: a | F.col("kind").startswith(p), prefixes, F.col("kind").isin(list(wanted)))
    marked = closure.join(kinds.where(fits), F.col("ancestor") == F.col("node_id"), "left_semi")
    return marked.groupBy("start").agg(F.min_by("ancestor", "depth").alias("ancestor"), F.min("depth").alias("depth"))


def closures(edges: DataFrame, starts: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """``(start, node)``: all nodes that each start reaches along the directed ``edges(a, b)``, itself included, for all starts together.

    Breadth first: a round joins only what the round before reached for the first time; it ends when nothing new comes, so circles are harmless.
    """
    seen = frontier = materialize(starts.select(F.col("node").alias("start"), "node").distinct(), "closures")
    steps = materialize(edges.select("a", "b").distinct(), "closure-edges")
    for number in range(1, max_rounds + 1):
        new = frontier.join(steps, F.col("node") == F.col("a")).select("start", F.col("b").alias("node")).distinct()
        frontier = materialize(new.join(seen, ["start", "node"], "left_anti"), "closures")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if number % 16 == 0:
            seen = materialize(seen, "closures-so-far")
    raise RuntimeError(f"the closure was not exhausted in {max_rounds} rounds")
