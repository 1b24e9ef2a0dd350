"""Anchors: nodes of the backbones of two graphs that are nearly equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import minimizers, similar, similarity
from ..model import AnchorParams, GraphSet
from ..storage import kept
from . import greedy
from .near import met_in_blocks
from .topology import backbone


#: With so many edits or fewer, two pieces of a sequence are looked up at once: one of eight letters or so is met by chance in any large table.
_TWO_PIECES = 3
#: Where more edits are allowed and pieces would be shorter, nearly all sequences would meet; a kernel holds them against each other.
_PIECE = 6


def similar_pairs(a: DataFrame, b: DataFrame, p: AnchorParams) -> DataFrame:
    """``(l, r, score)`` of all pairs of ``(node_id, seq)`` with similarity ``min_sim`` or more, without comparing all with all.

    Sequences of b are cut into pieces, of which some stand unchanged in any similar sequence. These meet by equality, of the length of b's sequence too;
    lengths and a banded edit distance decide. Sequences too short to be cut meet by length. Where pieces would be too short for that, blocks meet in a kernel.
    """
    s = p.min_sim
    most = lambda n: F.floor((1 - s) * F.floor(n / s) + 1e-9).cast("int")  # noqa: E731  edits allowed with a sequence of n
    right = b.select(F.col("node_id").alias("r"), F.col("seq").alias("sb"), F.length("seq").alias("m")).withColumn("t", most(F.col("m")))
    there = F.broadcast(right.select("m", "t").distinct())
    lengths = F.sequence(F.ceil(F.length("seq") * s - 1e-9).cast("int"), F.floor(F.length("seq") / s + 1e-9).cast("int"))
    left = a.select(F.col("node_id").alias("l"), F.col("seq").alias("sa"), F.explode(lengths).alias("m")).join(there, "m").withColumn("d", F.length("sa") - F.col("m"))
    few, more = (lambda x: x.where(f"t <= {_TWO_PIECES}")), (lambda x: x.where(f"t > {_TWO_PIECES} AND m >= {_PIECE} * (t + 1)"))
    met = _met_by_two(few(left), few(right), s, p.strict).unionByName(_met_by_one(more(left), more(right), s, p.strict))
    if any((t := int((1 - s) * int(m / s) + 1e-9)) > _TWO_PIECES and m < _PIECE * (t + 1) for m in range(1, 1000)):
        short = lambda x: x.where(f"t > {_TWO_PIECES} AND m < {_PIECE} * (t + 1)")
        x, y = kept(short(left).select("l", "sa").distinct()), kept(short(right).select("r", "sb"))
        near = met_in_blocks(x.select(F.col("sa").alias("seq")), y.select(F.col("sb").alias("seq")), s, p.strict)
        met = met.unionByName(near.join(x, "sa").join(y, "sb").select("l", "sa", "r", "sb"))
    return met.distinct().select("l", "r", similarity("sa", "sb").alias("score"))


def _met_by_one(left: DataFrame, right: DataFrame, s: float, strict: bool) -> DataFrame:
    """``(l, sa, r, sb)``, similar: b's sequence is cut into one piece more than edits are allowed.

    One piece stands unchanged in any similar sequence with no more edits before it than pieces, and after it likewise, which bounds how far it moves.
    """
    cut = "transform(sequence(0, t), i -> named_struct('i', i, 'p', CAST(floor(m * i / (t + 1)) AS INT), 'n', CAST(floor(m * (i + 1) / (t + 1)) - floor(m * i / (t + 1)) AS INT)))"
    right = right.select("r", "sb", "m", F.explode(F.expr(cut)).alias("x")).select("r", "sb", "m", "x.i", F.expr("substring(sb, x.p + 1, x.n)").alias("piece"))
    left = left.select("l", "sa", "m", "t", "d", F.explode(F.expr(cut)).alias("x"))
    low, high = "greatest(0, x.p - x.i, x.p + d - (t - x.i))", "least(length(sa) - x.n, x.p + x.i, x.p + d + (t - x.i))"
    left = left.where(F.expr(f"{low} <= {high}")).select("l", "sa", "m", "x.i", "x.n", F.explode(F.expr(f"sequence({low}, {high})")).alias("at"))
    left = left.select("l", "sa", "m", "i", F.expr("substring(sa, at + 1, n)").alias("piece")).distinct()
    return left.join(right, ["m", "i", "piece"]).where(similar("sa", "sb", s, strict)).select("l", "sa", "r", "sb")


def _met_by_two(left: DataFrame, right: DataFrame, s: float, strict: bool) -> DataFrame:
    """``(l, sa, r, sb)``, similar: b's sequence is cut into two pieces more than edits are allowed, so two of them at least stand unchanged, in order.

    How far they move is bounded: the edits before the first, between the two and behind the second add up to no more than are allowed. Both meet as one hash.
    """
    at = lambda i: f"CAST(floor(m * ({i}) / (t + 2)) AS INT)"
    two = f"flatten(transform(sequence(0, t), i -> transform(sequence(i + 1, t + 1), j -> named_struct('i', i, 'j', j, 'p', {at('i')}, 'n', {at('i + 1')} - {at('i')}, 'q', {at('j')}, 'k', {at('j + 1')} - {at('j')}))))"
    # v and w: how far the first and the second piece have moved; the places are the same for all sequences of two lengths, so a table has them
    moves = "filter(flatten(transform(sequence(-t, t), v -> transform(sequence(-t, t), w -> named_struct('v', v, 'w', w)))), y -> abs(y.v) + abs(y.w - y.v) + abs(d - y.w) <= t)"
    kinds = left.select("m", "t", "d").distinct().withColumn("x", F.explode(F.expr(two))).withColumn("y", F.explode(F.expr(moves))).where("x.p + y.v >= 0 AND x.p + y.v + x.n <= x.q + y.w AND x.q + y.w + x.k <= m + d")
    kinds = kinds.select("m", "d", "x.i", "x.j", (F.col("x.p") + F.col("y.v") + 1).alias("p"), "x.n", (F.col("x.q") + F.col("y.w") + 1).alias("q"), "x.k")
    still = right.select("m", "t").distinct().withColumn("x", F.explode(F.expr(two))).select("m", "x.i", "x.j", (F.col("x.p") + 1).alias("p"), "x.n", (F.col("x.q") + 1).alias("q"), "x.k")
    key = lambda seq: F.expr(f"xxhash64(m, i, j, substring({seq}, p, n), substring({seq}, q, k))").alias("key")
    right = right.select("r", "sb", "m").join(F.broadcast(still), "m").select("r", "sb", key("sb"))
    left = left.select("l", "sa", "m", "d").join(F.broadcast(kinds), ["m", "d"]).select("l", "sa", key("sa"))
    return left.join(right, "key").where(similar("sa", "sb", s, strict)).select("l", "sa", "r", "sb")


def similar_sequences(a: DataFrame, b: DataFrame, p: AnchorParams) -> DataFrame:
    """``(sa, sb, score)`` of the different sequences of the columns ``seq`` that are similar; equal ones aren't paired."""
    x, y = (f.select("seq").distinct().select(F.col("seq").alias("node_id"), "seq") for f in (a, b))
    return similar_pairs(x, y, p).where("l <> r").withColumnsRenamed({"l": "sa", "r": "sb"})


def _counted(nodes: DataFrame) -> DataFrame:
    """``(node_id, seq, nth)``: of the nodes of one sequence the first, the second and so on, by a range sort and the sizes of its partitions, so that a frequent sequence spreads."""
    at = F.monotonically_increasing_id()
    rows = kept(nodes.select("node_id", "seq").orderBy("seq", "node_id").withColumn("at", at))
    part = F.shiftright("at", 33)
    own = rows.groupBy(part.alias("part"), "seq").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("seq").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = own.select("part", "seq", "low", before.alias("before"))
    return rows.withColumn("part", part).join(own, ["part", "seq"]).select("node_id", "seq", (F.col("at") - F.col("low") + F.col("before")).alias("nth"))


def _equal_first(a: DataFrame, b: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(edges taken, a left, b left)``: where a sequence has no similar other one on either side, its nodes pair off in order, as both greedy choices do."""
    mixed = near.select(F.explode(F.array("sa", "sb")).alias("seq")).distinct()
    x, y = (_counted(f.join(mixed, "seq", "left_anti")) for f in (a, b))
    zipped = x.withColumnRenamed("node_id", "l").join(y.withColumnRenamed("node_id", "r"), ["seq", "nth"]).select("l", "r", F.lit(1.0).alias("score"))
    return zipped, a.join(mixed, "seq", "left_semi"), b.join(mixed, "seq", "left_semi")


def minimizer_index(nodes: DataFrame, p: AnchorParams) -> DataFrame:
    """``(h, node_id)``, distinct; sequences shorter than a k-mer have none."""
    return nodes.select("node_id", F.explode(minimizers("seq", p.kmer_len, p.window)).alias("h")).distinct()


def minimizer_candidates(a: DataFrame, b: DataFrame, p: AnchorParams) -> DataFrame:
    """``(l, r)`` of nodes that share a minimizer."""
    return minimizer_index(a, p).withColumnRenamed("node_id", "l").join(minimizer_index(b, p).withColumnRenamed("node_id", "r"), "h").select("l", "r").distinct()


def find_anchors(ga: GraphSet, gb: GraphSet, p: AnchorParams) -> DataFrame:
    """``(node_a, node_b, sim)``: exact, each A node in order takes its best free B node; by minimizers, the most similar pair comes first.

    Nodes of sequences that no other sequence is similar to pair off in order; only the others compete, by classes of equal sequences.
    """
    a, b = kept(backbone(ga).select("node_id", "seq")), kept(backbone(gb).select("node_id", "seq"))
    exact = p.strategy == "exact" or p.strategy == "auto" and a.count() * b.count() <= p.exact_pairs
    if exact:
        near = kept(similar_sequences(a, b, p))
        if p.strict and p.min_sim >= 1:
            return near.select(F.lit(0).cast("long").alias("node_a"), F.lit(0).cast("long").alias("node_b"), F.col("score").alias("sim")).limit(0)
    else:
        a, b = (f.where(F.length("seq") >= p.kmer_len) for f in (a, b))
        x, y = (f.select("seq").distinct().select(F.col("seq").alias("node_id"), "seq") for f in (a, b))
        met = minimizer_candidates(x, y, p).where("l <> r").select(F.col("l").alias("sa"), F.col("r").alias("sb"))
        near = kept(met.where(similar("sa", "sb", p.min_sim)).select("sa", "sb", similarity("sa", "sb").alias("score")))
    found, a, b = _equal_first(a, b, near)
    if not near.isEmpty():
        same = a.select("seq").distinct().join(b.select("seq").distinct(), "seq").select(F.col("seq").alias("cl"), F.col("seq").alias("cr"), F.lit(1.0).alias("score"))
        scores = same.unionByName(near.select(F.col("sa").alias("cl"), F.col("sb").alias("cr"), "score"))
        choose = greedy.serial_classes if exact else greedy.best_first_classes
        rest = choose(a.select(F.col("node_id").alias("l"), F.col("seq").alias("cl")), b.select(F.col("node_id").alias("r"), F.col("seq").alias("cr")), scores)
        found = found.unionByName(rest.select("l", "r", "score"))
    return found.select(F.col("l").alias("node_a"), F.col("r").alias("node_b"), F.col("score").alias("sim"))
