"""Topological order of graphs of any size, first in, first out, without one group a graph.

A node's depth is the longest way to it from a node without predecessors. A queue that starts with the latter, in order of ids, gives nodes by
depth, within a depth by the place of the predecessor that comes last, then by id. Depths come by elimination: a node that waits for one
other at most is expressed by it, in chains of any length at once by doubling, so a chain of bubbles, nested or not, is gone in as many rounds as they are
nested. Only what is tangled goes level by level. Places follow from the ids on the way to a node through last
predecessors, compared by doubling too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, kept
from .order import numbered

CYCLE = "the graph contains cycles; a DAG is required"


def depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(g, v, d)`` of ``nodes (g, v)`` and ``edges (g, a, b)``; a cycle is an error.

    An undecided node has ``least``, what decided predecessors ask of it, and edges ``(a, b, w)`` from undecided ones.
    """
    e = kept(edges.select("g", "a", "b", F.lit(1).cast("long").alias("w")).distinct())
    open_ = kept(nodes.select("g", "v", F.lit(0).cast("long").alias("least")))
    known, records = [], []
    size = open_.count()
    while not open_.isEmpty():
        into = e.groupBy("g", F.col("b").alias("v")).agg(F.count("*").alias("n"), F.first("a").alias("p"), F.first("w").alias("w"))
        state = kept(open_.join(into, ["g", "v"], "left"))
        done = state.where("n IS NULL").select("g", "v", F.col("least").alias("d"))
        one = kept(state.where("n = 1").select("g", "v", "p", "least", "w"))
        if done.isEmpty():
            raise ValueError(CYCLE)
        for step in range(size.bit_length() + 2):
            # v is at least `least`, and w after p; where p is expressed by another node itself, by that one
            q = one.select("g", F.col("v").alias("p"), F.col("p").alias("q"), F.col("least").alias("l2"), F.col("w").alias("w2"))
            far = one.join(q, ["g", "p"], "left")
            if not far.where("q IS NOT NULL").isEmpty():
                one = kept(far.select("g", "v", F.coalesce("q", "p").alias("p"), F.greatest("least", F.col("l2") + F.col("w")).alias("least"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w")))
            else:
                break
        else:
            raise ValueError(CYCLE)
        ends = done.select("g", F.col("v").alias("p"), "d")
        met = one.join(ends, ["g", "p"], "left")
        found = kept(done.unionByName(met.where("d IS NOT NULL").select("g", "v", F.greatest("least", F.col("d") + F.col("w")).alias("d"))))
        waits = kept(met.where("d IS NULL").select("g", "v", "p", "least", "w"))
        known.append(found)
        records.append(waits)
        gone = found.select("g", F.col("v").alias("a"), "d", F.lit(None).cast("long").alias("p"), F.lit(None).cast("long").alias("off")).unionByName(waits.select("g", F.col("v").alias("a"), F.col("least").alias("d"), "p", F.col("w").alias("off")))
        passed = e.join(gone, ["g", "a"], "left")
        rest = state.where("n > 1").select("g", "v", "least")
        asked = passed.where("d IS NOT NULL").groupBy("g", F.col("b").alias("v")).agg(F.max(F.col("d") + F.col("w")).alias("asked"))
        after = kept(rest.join(asked, ["g", "v"], "left").select("g", "v", F.greatest("least", "asked").alias("least")))
        # what leads to nodes that are gone isn't needed any more
        kept_edges = passed.where("d IS NULL OR p IS NOT NULL").select("g", F.coalesce("p", "a").alias("a"), "b", (F.col("w") + F.coalesce("off", F.lit(0))).alias("w"))
        left = kept(kept_edges.join(rest.select("g", F.col("v").alias("b")), ["g", "b"], "left_semi").groupBy("g", "a", "b").agg(F.max("w").alias("w")))
        dropped(e, open_, state)
        e, open_ = left, after
    out = known[0]
    for found in known[1:]:
        out = out.unionByName(found)
    for waits in reversed(records):
        at = out.select("g", F.col("v").alias("p"), "d")
        out = kept(out.unionByName(waits.join(at, ["g", "p"]).select("g", "v", F.greatest("least", F.col("d") + F.col("w")).alias("d"))))
    return out


def _placed(tree: DataFrame) -> DataFrame:
    """``(g, v, d, key)``: the order of nodes of one depth, by the ids on the way to them through ``tree (g, v, d, up)``."""
    at = kept(tree.select("g", "v", "d", "up", F.col("v").alias("key")))
    while not at.groupBy("g", "d").agg(F.count_distinct("up").alias("n")).where("n > 1").isEmpty():
        above = at.select("g", F.col("v").alias("up"), F.col("up").alias("further"), F.col("key").alias("first"))
        both = at.join(above, ["g", "up"], "left").select("g", "v", "d", F.col("further").alias("up"), "first", "key")
        after = kept(numbered(both.withColumnRenamed("key", "second"), ["first", "second"], ["g", "d"], "key").select("g", "v", "d", "up", "key"))
        dropped(at)
        at = after
    return at.select("g", "v", "d", "key")


def ranked(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(graph_id, node_id, rank)`` of ``nodes (graph_id, node_id)`` and ``edges (graph_id, src, dst)``, ranks from 0."""
    v, e = nodes.select(F.col("graph_id").alias("g"), F.col("node_id").alias("v")), edges.select(F.col("graph_id").alias("g"), F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    d = kept(depths(v, e))
    # who may come last before a node is one level up
    last = e.join(d.select("g", F.col("v").alias("a"), F.col("d").alias("da")), ["g", "a"]).join(d.select("g", F.col("v").alias("b"), F.col("d").alias("db")), ["g", "b"]).where("db = da + 1")
    last = kept(last.select("g", "a", "b"))
    tree = kept(d.join(last.groupBy("g", F.col("b").alias("v")).agg(F.max("a").alias("up")), ["g", "v"], "left"))
    while True:
        place = _placed(tree)
        best = last.join(place.select("g", F.col("v").alias("a"), "key"), ["g", "a"]).groupBy("g", F.col("b").alias("v")).agg(F.max_by("a", "key").alias("up"))
        now = kept(d.join(best, ["g", "v"], "left"))
        if now.join(tree.withColumnRenamed("up", "was"), ["g", "v", "d"]).where("NOT up <=> was").isEmpty():
            break
        tree = now
    out = numbered(place, ["d", "key"], ["g"], "rank", 0)
    return out.select(F.col("g").alias("graph_id"), F.col("v").alias("node_id"), "rank")
