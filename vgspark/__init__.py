"""Graph-to-graph pangenome alignment on Spark DataFrames."""

from .model import AlignParams, AnchorParams, GraphSet, MatchParams
from .operators.anchors import find_anchors
from .operators.matching import matched
from .operators.snarls import decompose
from .plans.aligner import Alignment, align
from .sources.gfa import parse, read_gfa

__all__ = ["AlignParams", "Alignment", "AnchorParams", "GraphSet", "MatchParams", "align", "decompose", "find_anchors", "matched", "parse", "read_gfa"]
