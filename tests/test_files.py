import gzip
import random

import pytest
from pyspark.sql import functions as F

from vgspark.__main__ import main
from vgspark.functions import sequences as q
from vgspark.functions.sequences import register
from vgspark.model import AnchorParams, GraphSet, MatchParams
from vgspark.operators import matching, metrics, snarls, topology
from vgspark.operators.anchors import find_anchors
from vgspark.plans.aligner import align
from vgspark.sinks import writers
from vgspark.sources import gfa, synth
from vgspark.streaming.gfa import segment_stream, segment_totals


def test_gfa_files_round_trip(spark, tmp_path):
    """Several graphs in one folder, one of them packed, are read, written and read again."""
    one = "H\tVN:Z:1.0\nS\ta\tACGT\nS\tb\t*\nS\tc\tGG\nL\ta\t+\tb\t+\t0M\nL\ta\t+\tc\t-\t0M\nP\tp\ta+,b+\t*\n"
    two = "S\tx\tTT\nS\ty\tA\nW\tN\t1\tchr\t0\t3\t>x>y\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.gfa").write_text(one)
    with gzip.open(tmp_path / "in/two.gfa.gz", "wt") as f:
        f.write(two)
    g = gfa.read_gfa(spark, str(tmp_path / "in"))
    names = lambda g: {(r.graph_id, r.name, r.seq) for r in g.nodes.collect()}
    assert names(g) == {("one", "a", "ACGT"), ("one", "b", ""), ("one", "c", "GG"), ("one", "c_rc", "CC"), ("two", "x", "TT"), ("two", "y", "A")}
    assert {(r.graph_id, r.path_name, r.step) for r in g.paths.collect()} == {("one", "p", 0), ("one", "p", 1), ("two", "N#1#chr:0-3", 0), ("two", "N#1#chr:0-3", 1)}
    lines = gfa.to_lines(g).where("graph_id = 'one'")
    writers.write_text(lines, str(tmp_path / "one.gfa"), "part", "a", "b")
    again = gfa.parse(spark.read.text(str(tmp_path / "one.gfa")).select(F.lit("one").alias("graph_id"), F.monotonically_increasing_id().alias("line_no"), "value"))
    assert names(again) == {x for x in names(g) if x[0] == "one"}
    assert again.edges.count() == g.edges.where("graph_id = 'one'").count() == 2


def test_segments_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    ask = segment_totals(segment_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("segments_seen").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True)
    for i, (name, text) in enumerate([("a.gfa", "S\tx\tACG\nS\ty\t*\nL\tx\t+\ty\t+\t0M\n"), ("b.gfa", "S\tz\tAA\nS\tshort\n")]):
        (tmp_path / "in" / name).write_text(text)
        ask.start().awaitTermination()
        got = {(r.graph_id, r.n_segments, r.n_bases) for r in spark.table("segments_seen").collect()}
        assert got == {("a", 2, 3), ("b", 1, 2)} if i else got == {("a", 2, 3)}


def test_paf_and_tables(spark, tmp_path):
    (tmp_path / "x.paf").write_text("q1\t100\t5\t50\t+\tt1\t200\t10\t60\t40\t50\t60\ttp:A:P\nshort\tline\n")
    assert [tuple(r) for r in gfa.paf(spark, str(tmp_path / "x.paf")).collect()] == [("q1", 5, 50, "t1", 10, 60, 0.8)]
    df = spark.createDataFrame([(1, 2.5), (2, None)], "n int, x double")
    writers.write_table(df, str(tmp_path / "t"))
    assert sorted(map(tuple, gfa.measurements(spark, str(tmp_path / "t"), "n int, x double").collect())) == [(1, 2.5), (2, None)]


def test_sql_functions(spark):
    register(spark)
    rng = random.Random(8)
    seqs = spark.createDataFrame([("".join(rng.choice("ACGTé") for _ in range(n)),) for n in (0, 1, 14, 15, 16, 24, 25, 80)], "s string")
    got = seqs.selectExpr("s", "seq_similarity(s, 'GATTACA') AS sim", "rev_comp(s) AS rc", "kmer_hash(s) AS h", "minimizers(s, 15, 10) AS m")
    want = seqs.select("s", q.similarity("s", F.lit("GATTACA")).alias("sim"), q.reverse_complement("s").alias("rc"), q.kmer_hash("s").alias("h"), q.minimizers("s").alias("m"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_planted_alleles_are_found(spark):
    a, b, truth = synth.planted_pair(spark, 5)
    r = align(a, b)
    for side, df in (("a_only", r.delta_a), ("b_only", r.delta_b)):
        score = metrics.precision_recall(df, truth.where(F.col("type") == side)).first()
        assert (score.prec, score.rec, score.n_truth) == (1.0, 1.0, 5)
    assert r.stats["pairs"] == 5 and r.stats["pairs_scored"] >= 5 and r.stats["cores"] >= 1
    text = writers.report(r, a, b)
    assert text.count("<->") == r.anchors.count() + 5 + 10 and "TOTAL ALIGNMENT SCORE" in text and text.count("snarl p") == 10
    assert "... and 3 more" in writers.report(r, a, b, most=2)


def test_generated_pairs(spark):
    a, b, truth = synth.bubble_pair(spark, 200, most=50, power=1.1, divergence=0.1)
    rows = truth.collect()
    k = {}
    for r in rows:
        k[r.snarl] = k.get(r.snarl, 0) + 1
        assert (r.node_a is None) == (r.type == "b_only") and (r.node_b is None) == (r.type == "a_only")
    assert max(k.values()) > 12 and len(k) == 200
    seqs = [{r.name: r.seq for r in g.nodes.collect()} for g in (a, b)]
    both = [r for r in rows if r.type == "shared"]
    assert all(seqs[0][r.node_a] == r.seq for r in both)
    turned = sum(x != y for r in both for x, y in zip(r.seq, seqs[1][r.node_b]))
    assert 0.06 < turned / sum(len(r.seq) for r in both) < 0.09  # a quarter of the letters drawn are the same again
    assert all(len(seqs[1][r.node_b]) == len(r.seq) for r in both)


def test_covering_paths(spark):
    g = GraphSet.build(spark, "g", [(n, n.upper()) for n in "sabtx"], [("s", "a"), ("s", "b"), ("a", "t"), ("b", "t")])
    paths = [tuple(r.path) for r in topology.covering_paths(g).orderBy("path_idx").collect()]
    assert paths == [(0, 1, 3), (0, 2, 3), (4,)]
    with pytest.raises(Exception, match="cycle"):
        topology.covering_paths(GraphSet.build(spark, "g", [("a", "A"), ("b", "C")], [("a", "b"), ("b", "a")])).collect()
    h = GraphSet.build(spark, "g", [("a", "AC"), ("b", "G")], paths={"p": ["a", "b"]})
    assert [(r.path_name, r.nodes, r.seq) for r in h.described_paths().collect()] == [("p", ["a", "b"], "ACG")]


def test_forest(spark):
    """Bubbles four deep and one beside: parents, depths and work, summed from the leaves."""
    edges, names = [], []
    for d in range(4):  # s_d > (s_{d+1} ... t_{d+1} | m_d) > t_d
        edges += [(f"s{d}", f"m{d}"), (f"m{d}", f"t{d}"), (f"s{d}", f"s{d + 1}"), (f"t{d + 1}", f"t{d}")]
        names += [f"s{d}", f"m{d}", f"t{d}"]
    edges += [("s4", "t4"), ("t0", "x"), ("t0", "y"), ("x", "z"), ("y", "z")]
    names += ["s4", "t4", "x", "y", "z"]
    g = GraphSet.build(spark, "g", [(n, "A") for n in names], edges)
    s, a = snarls.decompose(g, "keep")
    ids = {r.snarl_idx: (r.snarl_id, r.allele_count) for r in s.collect()}
    got = {ids[r.snarl_idx][0]: (ids[r.parent_idx][0] if r.parent_idx >= 0 else None, r.depth, r.subtree_work) for r in snarls.forest(s, a).collect()}
    k = {name: n for name, n in ids.values()}
    work = lambda d: sum(k[f"s{i}>t{i}"] ** 3 for i in range(d, 4))
    assert got == {f"s{d}>t{d}": (f"s{d - 1}>t{d - 1}" if d else None, d, work(d)) for d in range(4)} | {"t0>z": (None, 0, 8)}


def test_intervals_against_all_pairs(spark):
    rng = random.Random(6)
    spans, found = {}, []
    for side in "ab":
        spans[side] = []
        for p in ("p", "q"):
            at = 0
            for i in range(40):
                n = rng.choice([0, 1, 3, 500, 9000])
                spans[side].append((p, i, rng.randrange(30), at, at + n))
                at += n
    records = [(rng.choice("pq"), x := rng.randrange(0, 60_000), x + rng.choice([0, 1, 50, 20_000]), rng.choice("pq"), y := rng.randrange(0, 60_000), y + rng.choice([0, 7, 20_000])) for _ in range(25)]
    hit = lambda side, p, lo, hi: {n for q, _, n, s, e in spans[side] if q == p and e > lo and s < hi}
    want = {(a, b) for qp, q0, q1, tp, t0, t1 in records for a in hit("a", qp, q0, q1) for b in hit("b", tp, t0, t1)}
    df = spark.createDataFrame(records, "q_name string, q_start long, q_end long, t_name string, t_start long, t_end long")
    sa, sb = (spark.createDataFrame(spans[x], 'path_name string, step int, node_id int, start long, "end" long'.replace('"', "`")) for x in "ab")
    got = [tuple(r) for r in metrics.coverage(df, sa, sb).collect()]
    assert set(got) == want and len(got) == len(want)
    pairs = [(rng.randrange(30), rng.randrange(30)) for _ in range(200)]
    r = metrics.consistency(spark.createDataFrame(pairs, "node_a int, node_b int"), df, sa, sb).first()
    assert (r.n, r.covered) == (200, sum(p in want for p in pairs))


def test_kernel_of_competing_alleles(spark):
    """What is put together from the similarities of many pairs equals what each pair gives alone, beyond the limit too."""
    rng = random.Random(7)
    near = lambda: "ACGTTGCA" + "".join(rng.choice("AC") for _ in range(6))
    rows = [(i, [near() for _ in range(rng.choice([0, 1, 2, 5]))], [near() for _ in range(rng.choice([1, 3, 6]))]) for i in range(30)] + [(30, [near() for _ in range(33)], [near() for _ in range(31)])]
    df = spark.createDataFrame(rows, "n int, seqs_a array<string>, seqs_b array<string>")
    for how, p in (("auto", MatchParams()), ("greedy", MatchParams()), ("auto", MatchParams(objective="optimal"))):
        for r in matching.match_pairs(df, p, how).collect():
            score, pairs, a_only, b_only = matching.matched(r.seqs_a, r.seqs_b, p, how)
            assert r.m_score == pytest.approx(score) and (list(r.a_only), list(r.b_only)) == (a_only, b_only)
            assert sorted((m.i, m.j) for m in r.matches) == sorted((i, j) for i, j, _ in pairs)


def test_exit_codes(spark, tmp_path, capsys):
    text = "S\ts\tTTAGC\nS\ta\tACGT\nS\tb\tATGT\nS\tt\tCCCG\nL\ts\t+\ta\t+\t0M\nL\ts\t+\tb\t+\t0M\nL\ta\t+\tt\t+\t0M\nL\tb\t+\tt\t+\t0M\n"
    (tmp_path / "a.gfa").write_text(text)
    (tmp_path / "flat.gfa").write_text("S\tx\tACGT\n")
    a, flat = str(tmp_path / "a.gfa"), str(tmp_path / "flat.gfa")
    assert main([]) == 1 and main([a, str(tmp_path / "none.gfa")]) == 1 and main(["--pairing", "none"]) == 1
    capsys.readouterr()
    assert main([a, a, "--report", "--vcf", str(tmp_path / "out.vcf")]) == 0
    said = capsys.readouterr().out
    assert "# snarl_alignments\t1" in said and "TOTAL ALIGNMENT SCORE" in said and (tmp_path / "out.vcf").is_dir()
    assert main([flat, flat, "--gaf", str(tmp_path / "out.gaf")]) == 2 and (tmp_path / "out.gaf").is_dir()


def test_large_pairs_choose_the_same_anchors(spark):
    """Where each sequence is similar to itself alone, the strategies agree."""
    a, b, _ = synth.bubble_pair(spark, 40)
    x = [{tuple(r) for r in find_anchors(a, b, AnchorParams(strategy=s)).select("node_a", "node_b").collect()} for s in ("exact", "minimizer")]
    assert x[0] == x[1] and len(x[0]) > 40


def test_lines_are_made_once(spark):
    """However often a graph's tables ask for them; types of lines have folders of their own."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    text = ["H\tVN:Z:1.0", "S\ta\tAC", "S\tb\tGGT", "# x", "L\ta\t+\tb\t-\t0M", "P\tp\ta+,b-\t*", "W\ts\t1\tc\t0\t5\t>a<b"]
    lines = gfa.from_lines(spark, "g", text)
    g = gfa.parse(lines.mapInArrow(count, lines.schema))
    assert {(r.node_id, r.name, r.seq) for r in g.nodes.collect()} == {(0, "a", "AC"), (1, "b", "GGT"), (2, "b_rc", "ACC")}
    assert {(r.src, r.dst) for r in g.edges.collect()} == {(0, 2)}
    assert {(r.path_name, r.step, r.node_id) for r in g.paths.collect()} == {("p", 0, 0), ("p", 1, 2), ("s#1#c:0-5", 0, 0), ("s#1#c:0-5", 1, 2)}
    assert seen.value == len(text)
    with pytest.raises(Exception, match="unknown segment z, line 1"):
        gfa.parse(gfa.from_lines(spark, "g", ["S\ta\tAC", "L\ta\t+\tz\t+\t0M"])).edges.collect()
    assert gfa.parse(gfa.from_lines(spark, "g", ["H\tVN:Z:1.0"])).edges.count() == 0
