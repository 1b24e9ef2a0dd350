"""Synthetic graph pairs: chains of bubbles with known shared and private alleles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import GraphSet


def dna(key: Column, length: int = 32) -> Column:
    """Letters that a key determines, 32 for each hash."""
    parts = [F.translate(F.md5(F.concat(key, F.lit(f"/{i}")) if i else key), "0123456789abcdef", "ACGTACGTACGTACGT") for i in range(-(-length // 32))]
    return F.substring(F.concat(*parts), 1, length)


def mutated(seq: Column, key: Column, rate: float) -> Column:
    """``seq`` with each letter drawn anew, which may give the same one, at ``rate``, as ``key`` and its place determine."""
    draw = lambda i: F.xxhash64(key, i)
    new = lambda i: F.substring(F.lit("ACGT"), F.pmod(F.shiftright(draw(i), 24), F.lit(4)).cast("int") + 1, F.lit(1))
    letters = F.transform(F.sequence(F.lit(1), F.length(seq)), lambda i: F.when(F.pmod(draw(i), F.lit(1 << 24)) < rate * (1 << 24), new(i)).otherwise(F.substring(seq, i, F.lit(1))))
    return F.when(F.length(seq) == 0, "").otherwise(F.array_join(letters, ""))


def zipf(u: Column, low: int = 2, high: int = 12, power: float = 2.2) -> Column:
    """A draw of low..high with weights i ** -power, from a uniform column."""
    w = [i**-power for i in range(low, high + 1)]
    total, upto, out = sum(w), 0.0, F.lit(high)
    for i, x in reversed(list(enumerate(w[:-1]))):
        upto = sum(w[: i + 1]) / total
        out = F.when(u < upto, low + i).otherwise(out)
    return out.cast("int")


def bubble_pair(spark: SparkSession, n: int, seed: int = 42, anchor: int = 20, allele: int = 50, shared: float = 0.7, most: int = 12, power: float = 2.2, divergence: float = 0.0) -> tuple[GraphSet, GraphSet, DataFrame]:
    """Two chains of ``n`` bubbles and ``truth (snarl, type, seq, node_a, node_b)``, made by the executors from hashes of ``seed``.

    Alleles that both graphs have are mutated in B at the rate ``divergence``; ``node_a`` and ``node_b`` are the names of their nodes.

    A bubble has k alleles, up to ``most``, by ``zipf``: the rounded share, one at least, is in both graphs, half the rest
    in each, and each graph has two at least.
    """
    b = spark.range(n).select(F.col("id").alias("snarl"))
    u = F.pmod(F.xxhash64(F.lit(seed), "snarl"), F.lit(1 << 30)) / float(1 << 30)
    b = b.withColumn("k", zipf(u, high=most, power=power)).withColumn("s", F.greatest(F.lit(1), F.round(shared * F.col("k")).cast("int")))
    b = b.withColumn("a", F.greatest(F.ceil((F.col("k") - F.col("s")) / 2), 2 - F.col("s")).cast("int")).withColumn("b", F.greatest(F.floor((F.col("k") - F.col("s")) / 2), 2 - F.col("s")).cast("int"))
    kinds = F.concat(F.array_repeat(F.lit("shared"), F.col("s")), F.array_repeat(F.lit("a_only"), F.col("a")), F.array_repeat(F.lit("b_only"), F.col("b")))
    t = b.select("snarl", F.posexplode(kinds).alias("i", "type"))
    t = t.withColumn("seq", dna(F.concat_ws(":", F.lit(str(seed)), "snarl", "i"), allele)).withColumn("node_id", F.col("snarl") * 4096 + F.col("i") + 1)
    chain = spark.range(n + 1).select((F.col("id") * 4096).alias("node_id"), F.concat(F.lit("anc"), F.col("id")).alias("name"), dna(F.concat_ws(":", F.lit(f"anchor{seed}"), "id"), anchor).alias("seq"))
    out, name = [], F.concat_ws("_", F.lit("al"), "snarl", "i")
    for g, own in (("A", "a_only"), ("B", "b_only")):
        mine = t.where(F.col("type").isin("shared", own))
        if g == "B" and divergence:
            mine = mine.withColumn("seq", mutated(F.col("seq"), F.concat_ws(":", F.lit(f"mutated{seed}"), "snarl", "i"), divergence))
        nodes = chain.unionByName(mine.select("node_id", name.alias("name"), "seq")).select(F.lit(g).alias("graph_id"), "node_id", "name", "seq")
        edges = mine.select(F.lit(g).alias("graph_id"), (F.col("snarl") * 4096).alias("src"), F.col("node_id").alias("dst")).unionByName(mine.select(F.lit(g).alias("graph_id"), F.col("node_id").alias("src"), ((F.col("snarl") + 1) * 4096).alias("dst")))
        first = mine.groupBy("snarl").agg(F.min("node_id").alias("x"))
        steps = first.select(F.explode(F.array(F.struct((F.col("snarl") * 2).alias("step"), (F.col("snarl") * 4096).alias("node_id")), F.struct((F.col("snarl") * 2 + 1).alias("step"), F.col("x").alias("node_id")))).alias("e")).select("e.*")
        steps = steps.unionByName(spark.range(1).select(F.lit(2 * n).cast("long").alias("step"), F.lit(n * 4096).cast("long").alias("node_id")))
        out.append(GraphSet(nodes, edges, steps.select(F.lit(g).alias("graph_id"), F.lit("hap").alias("path_name"), F.col("step").cast("int"), "node_id")))
    truth = t.select("snarl", "type", "seq", F.when(F.col("type") != "b_only", name).alias("node_a"), F.when(F.col("type") != "a_only", name).alias("node_b"))
    return out[0], out[1], truth


def planted_pair(spark: SparkSession, n: int, shared: int = 2, a_only: int = 1, b_only: int = 1, seed: int = 99) -> tuple[GraphSet, GraphSet, DataFrame]:
    """Two chains of ``n`` bubbles with so many shared and private alleles of 12 letters between anchors of 8, and ``truth (snarl, type, seq)``."""
    kinds = F.concat(*(F.array_repeat(F.lit(k), c) for k, c in (("shared", shared), ("a_only", a_only), ("b_only", b_only))))
    t = spark.range(n).select(F.col("id").alias("snarl"), F.posexplode(kinds).alias("i", "type")).withColumn("seq", dna(F.concat_ws(":", F.lit(f"planted{seed}"), "snarl", "i"), 12))
    chain = spark.range(n + 1).select((F.col("id") * 64).alias("node_id"), F.concat(F.lit("p"), F.col("id")).alias("name"), dna(F.concat_ws(":", F.lit(f"end{seed}"), "id"), 8).alias("seq"))
    out = []
    for g, own in (("A", "a_only"), ("B", "b_only")):
        mine = t.where(F.col("type").isin("shared", own)).withColumn("node_id", F.col("snarl") * 64 + F.col("i") + 1)
        nodes = chain.unionByName(mine.select("node_id", F.concat_ws("_", F.lit("q"), "snarl", "i").alias("name"), "seq")).select(F.lit(g).alias("graph_id"), "node_id", "name", "seq")
        into = mine.select(F.lit(g).alias("graph_id"), (F.col("snarl") * 64).alias("src"), F.col("node_id").alias("dst"))
        onward = mine.select(F.lit(g).alias("graph_id"), F.col("node_id").alias("src"), ((F.col("snarl") + 1) * 64).alias("dst"))
        out.append(GraphSet(nodes, into.unionByName(onward), spark.createDataFrame([], "graph_id string, path_name string, step int, node_id long")))
    return out[0], out[1], t.select("snarl", "type", "seq")


def demo_pair(spark: SparkSession) -> tuple[GraphSet, GraphSet]:
    """Two small graphs with two bubbles each; fixed values."""
    base = [("s0", "TTAGC"), ("b1a", "ACGT"), ("b1b", "ATGT"), ("m1", "CCCG"), ("b2a", "GATTACA"), ("b2b", "GA")]
    out = []
    for g, (last, seq) in (("A", ("b2c", "CTTAGGAATCG")), ("B", ("b2d", "GATTAC"))):
        paths = {"h1": ["s0", "b1a", "m1", "b2a", "s_end"], "h2": ["s0", "b1b", "m1", "b2b", "s_end"], "h3": ["s0", "b1a", "m1", last, "s_end"]}
        out.append(GraphSet.build(spark, g, [*base, (last, seq), ("s_end", "TTAAG")], paths=paths))
    return out[0], out[1]
