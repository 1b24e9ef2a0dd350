"""python -m vgspark A.gfa B.gfa: align two graphs. Exit code 0; 1: bad arguments or files; 2: no pairs."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .model import AlignParams, AnchorParams, MatchParams
from .plans.aligner import align
from .sinks import writers
from .sources.gfa import read_gfa


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="vgspark", description=__doc__)
    p.add_argument("graphs", nargs="*")
    p.add_argument("--gaf")
    p.add_argument("--vcf")
    p.add_argument("--threads", type=int, default=0)
    for name, default in (("alpha", 1.0), ("beta", 0.5), ("gamma", 2.0), ("gap", 0.5), ("min-sim", 0.75), ("anchor-sim", 0.9)):
        p.add_argument(f"--{name}", type=float, default=default)
    p.add_argument("--pairing", choices=("score", "work"), default="score")
    p.add_argument("--sequential", dest="pairing", action="store_const", const="score", help="the same as --pairing score")
    p.add_argument("--candidate-sim", type=float, help="score only bubbles that share an allele this similar")
    p.add_argument("--report", action="store_true", help="print a summary")
    try:
        a = p.parse_args(args)
    except SystemExit as e:
        return 1 if e.code else 0
    if len(a.graphs) != 2 or not all(map(os.path.exists, a.graphs)):
        p.print_help()
        return 1
    spark = SparkSession.builder.master(f"local[{a.threads or os.environ.get('VGSPARK_THREADS') or '*'}]").config("spark.ui.enabled", "false").getOrCreate()
    params = AlignParams(alpha=a.alpha, beta=a.beta, gamma=a.gamma, pairing=a.pairing, candidate_sim=a.candidate_sim, anchor=AnchorParams(min_sim=a.anchor_sim), match=MatchParams(gap_cost=a.gap, min_sim=a.min_sim))
    ga, gb = (read_gfa(spark, x) for x in a.graphs)
    r = align(ga, gb, params)
    names = [os.path.splitext(os.path.basename(x))[0] for x in a.graphs]
    lines = writers.gaf_lines(r.anchors, r.alignments, r.total, ga, gb, r.snarls_a, r.snarls_b, *names)
    if a.gaf:
        writers.write_text(lines, a.gaf, "part", "a", "b")
    else:
        for row in lines.orderBy("part", "a", "b").toLocalIterator():
            print(row["value"])
    if a.report:
        print(writers.report(r, ga, gb))
    if a.vcf:
        writers.write_text(writers.delta_vcf_lines(r.delta_a, ga, r.snarls_a, names[0]), a.vcf, "part", "id", "idx")
    return 0 if r.alignments.limit(1).count() else 2


if __name__ == "__main__":
    sys.exit(main())
