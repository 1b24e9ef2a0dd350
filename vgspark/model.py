"""Schemas, parameters and the set of tables that a graph is."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "graph_id string, node_id long, name string, seq string"
EDGES = "graph_id string, src long, dst long"
PATHS = "graph_id string, path_name string, step int, node_id long"


@dataclass(frozen=True)
class AnchorParams:
    min_sim: float = 0.90
    kmer_len: int = 15
    window: int = 10
    #: exact, minimizer, or auto: exact up to ``exact_pairs`` candidate pairs.
    strategy: str = "auto"
    exact_pairs: int = 1_000_000
    strict: bool = False


@dataclass(frozen=True)
class MatchParams:
    gap_cost: float = 0.5
    min_sim: float = 0.75
    lap_limit: int = 30
    #: reference: the cost 1 - similarity, or the gap; optimal: the best score.
    objective: str = "reference"


@dataclass(frozen=True)
class AlignParams:
    alpha: float = 1.0
    beta: float = 0.5
    gamma: float = 2.0
    #: score: best positive score first come; work: by order of allele counts.
    pairing: str = "score"
    nested: str = "drop"
    include_unpaired: bool = False
    max_alleles: int = 100_000
    #: Bubbles are scored if they share an allele of this similarity, found by equality joins, for large graphs; None: all that could score above zero.
    candidate_sim: float | None = None
    anchor: AnchorParams = field(default_factory=AnchorParams)
    match: MatchParams = field(default_factory=MatchParams)


@dataclass
class GraphSet:
    """A graph's nodes, edges (distinct, those that its paths imply among them) and haplotype paths."""

    nodes: DataFrame
    edges: DataFrame
    paths: DataFrame

    @classmethod
    def build(cls, spark: SparkSession, graph_id: str, nodes: list[tuple[str, str]], edges: list[tuple[str, str]] = (), paths: dict[str, list[str]] | None = None) -> GraphSet:
        """From names; ids follow the order of ``nodes``. An unknown name is an error."""
        ids = {name: i for i, (name, _) in enumerate(nodes)}
        steps = [(graph_id, p, i, ids[n]) for p, ns in (paths or {}).items() for i, n in enumerate(ns)]
        pairs = {(ids[a], ids[b]) for a, b in edges} | {(ids[a], ids[b]) for ns in (paths or {}).values() for a, b in zip(ns, ns[1:])}
        return cls(
            spark.createDataFrame([(graph_id, ids[n], n, s) for n, s in nodes], NODES),
            spark.createDataFrame([(graph_id, a, b) for a, b in sorted(pairs)], EDGES),
            spark.createDataFrame(steps, PATHS),
        )

    def describe(self) -> DataFrame:
        """``(rank, name, seq, successors)``: the nodes in topological order, each with the names of its successors."""
        from .operators.topology import topological_rank

        names = self.nodes.select("node_id", F.col("name").alias("succ"))
        out = self.edges.join(names, self.edges["dst"] == names["node_id"]).groupBy("src").agg(F.array_sort(F.collect_list("succ")).alias("successors"))
        rank = topological_rank(self).select("node_id", "rank")
        return self.nodes.join(rank, "node_id").join(out, F.col("node_id") == F.col("src"), "left").select("rank", "name", "seq", F.coalesce("successors", F.array().cast("array<string>")).alias("successors"))

    def described_paths(self) -> DataFrame:
        """``(path_name, nodes, seq)``: each haplotype with the names of its nodes and its sequence."""
        from .operators.topology import path_sequences

        names = self.paths.join(self.nodes.select("node_id", "name"), "node_id").groupBy("path_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "name"))), lambda x: x["name"]).alias("nodes"))
        return names.join(path_sequences(self.paths, self.nodes).select("path_name", "seq"), "path_name")
