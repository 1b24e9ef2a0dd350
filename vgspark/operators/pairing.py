"""Scores of bubble pairs, the pairing of bubbles, and what is left over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import similarity
from ..model import AlignParams, AnchorParams, GraphSet
from . import greedy
from .anchors import similar_sequences
from .matching import allele_lists, match_pairs
from .order import numbered


def _ends(g: GraphSet, snarls: DataFrame, alleles: DataFrame, side: str) -> DataFrame:
    seq = g.nodes.select("node_id", "seq")
    s = snarls.join(seq.withColumnsRenamed({"node_id": "source", "seq": "src"}), "source").join(seq.withColumnsRenamed({"node_id": "sink", "seq": "snk"}), "sink")
    s = s.join(allele_lists(alleles).select("snarl_idx", "seqs"), "snarl_idx")
    return s.select(F.col("snarl_idx").alias(f"snarl_{side}"), F.col("src").alias(f"src_{side}"), F.col("snk").alias(f"snk_{side}"), F.col("seqs").alias(f"seqs_{side}"))


def candidates(alleles_a: DataFrame, alleles_b: DataFrame, min_sim: float = 0.9) -> DataFrame:
    """``(snarl_a, snarl_b)`` of bubbles that share an allele of similarity ``min_sim``.

    At the similarity at which alleles match this is every pair that can have a positive score. Equality joins need long
    pieces, though: at 0.75 nearly all short alleles would meet, and a kernel compares them block by block, which grows with the square.
    """
    a = alleles_a.select(F.col("snarl_idx").alias("snarl_a"), F.col("seq").alias("sa")).distinct()
    b = alleles_b.select(F.col("snarl_idx").alias("snarl_b"), F.col("seq").alias("sb")).distinct()
    found = a.join(b, a["sa"] == b["sb"]).select("snarl_a", "snarl_b")
    if min_sim < 1:
        near = similar_sequences(alleles_a, alleles_b, AnchorParams(min_sim=min_sim)).select("sa", "sb")
        found = found.unionByName(a.join(near, "sa").join(b, "sb").select("snarl_a", "snarl_b"))
    return found.distinct()


def scored(ga: GraphSet, gb: GraphSet, da: tuple[DataFrame, DataFrame], db: tuple[DataFrame, DataFrame], p: AlignParams, pairs: DataFrame | None = None, how: str = "auto") -> DataFrame:
    """``(snarl_a, snarl_b, w_seq, w_topo, w_struct, score, matches, a_only, b_only)`` of ``pairs``.

    Without ``pairs`` all are scored whose allele counts leave a positive score possible,
    as small graphs allow.
    """
    a, b = _ends(ga, *da, "a"), _ends(gb, *db, "b")
    if pairs is None:
        ka, kb = F.size("seqs_a"), F.size("seqs_b")
        bound = p.alpha + p.beta + p.gamma * (F.least(ka, kb) - p.match.gap_cost * F.abs(ka - kb))
        both = a.join(b, bound > 0)
    else:
        both = pairs.select("snarl_a", "snarl_b").join(a, "snarl_a").join(b, "snarl_b")
    w_seq = p.alpha * (similarity("src_a", "src_b") + similarity("snk_a", "snk_b")) / 2
    m = match_pairs(both.select("snarl_a", "snarl_b", "seqs_a", "seqs_b", w_seq.alias("w_seq")), p.match, how)
    m = m.select("snarl_a", "snarl_b", "w_seq", F.lit(float(p.beta)).alias("w_topo"), (p.gamma * F.col("m_score")).alias("w_struct"), "matches", "a_only", "b_only")
    return m.withColumn("score", F.col("w_seq") + F.col("w_topo") + F.col("w_struct"))


def by_score(scores: DataFrame) -> DataFrame:
    """Each A bubble in order takes the best free B bubble with a positive score."""
    edges = scores.where("score > 0").select(F.col("snarl_a").alias("l"), F.col("snarl_b").alias("r"), "score")
    taken = greedy.serial(edges).select(F.col("l").alias("snarl_a"), F.col("r").alias("snarl_b"))
    return scores.join(taken, ["snarl_a", "snarl_b"])


def classes(g: GraphSet, d: tuple[DataFrame, DataFrame], side: str) -> DataFrame:
    """``(snarl_a, class_a)`` (or b): bubbles with equal ends and equal alleles are a class, named by its least bubble."""
    rows = _ends(g, *d, side).select(f"snarl_{side}", F.sha2(F.to_json(F.struct(f"src_{side}", f"snk_{side}", f"seqs_{side}")), 256).alias("same"))
    first = rows.groupBy("same").agg(F.min(f"snarl_{side}").alias(f"class_{side}"))
    return rows.join(first, "same").select(f"snarl_{side}", f"class_{side}")


def by_score_classes(scores: DataFrame, classes_a: DataFrame, classes_b: DataFrame) -> DataFrame:
    """As ``by_score``, where ``scores`` has a row for each two classes, under the names of their least bubbles."""
    a, b = classes_a.select(F.col("snarl_a").alias("l"), F.col("class_a").alias("cl")), classes_b.select(F.col("snarl_b").alias("r"), F.col("class_b").alias("cr"))
    edges = scores.where("score > 0").select(F.col("snarl_a").alias("cl"), F.col("snarl_b").alias("cr"), "score")
    taken = greedy.serial_classes(a, b, edges).select(F.col("l").alias("own_a"), F.col("r").alias("own_b"), F.col("cl").alias("snarl_a")).join(b.select(F.col("r").alias("own_b"), F.col("cr").alias("snarl_b")), "own_b")
    rest = [c for c in scores.columns if c not in ("snarl_a", "snarl_b")]
    return scores.join(taken, ["snarl_a", "snarl_b"]).select(F.col("own_a").alias("snarl_a"), F.col("own_b").alias("snarl_b"), *rest)


def by_work(snarls_a: DataFrame, snarls_b: DataFrame) -> DataFrame:
    """``(snarl_a, snarl_b)``: the A bubbles in order with the B bubbles from the most alleles down."""
    a = numbered(snarls_a.select(F.col("snarl_idx").alias("snarl_a")), ["snarl_a"], name="n")
    b = numbered(snarls_b.select(F.col("snarl_idx").alias("snarl_b"), "subtree_work"), [F.col("subtree_work").desc(), "snarl_b"], name="n")
    return a.join(b, "n").select("snarl_a", "snarl_b")


def delta(alignments: DataFrame, snarls: DataFrame, alleles: DataFrame, side: str, include_unpaired: bool = False) -> DataFrame:
    """``(side, snarl_id, allele_idx, path, seq)`` of the alleles that only one graph has, in paired bubbles (and the others)."""
    s = f"snarl_{side.lower()}"
    only = alignments.select(F.col(s).alias("snarl_idx"), F.explode(f"{side.lower()}_only").alias("allele_idx"))
    out = alleles.join(only, ["snarl_idx", "allele_idx"])
    if include_unpaired:
        out = out.unionByName(alleles.join(alignments.select(F.col(s).alias("snarl_idx")), "snarl_idx", "left_anti").select(*out.columns))
    return out.join(snarls.select("snarl_idx", "snarl_id"), "snarl_idx").select(F.lit(side).alias("side"), "snarl_id", "allele_idx", "path", "seq")


def total_score(anchors: DataFrame, alignments: DataFrame, alpha: float = 1.0) -> DataFrame:
    """``(n_anchors, n_pairs, total)``, one row."""
    both = anchors.select(F.lit(1).alias("a"), F.lit(0).alias("p"), (alpha * F.col("sim")).alias("x")).unionByName(alignments.select(F.lit(0).alias("a"), F.lit(1).alias("p"), F.col("score").alias("x")))
    return both.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("n_anchors"), F.coalesce(F.sum("p"), F.lit(0)).alias("n_pairs"), F.coalesce(F.sum("x"), F.lit(0.0)).alias("total"))
