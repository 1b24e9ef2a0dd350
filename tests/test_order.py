import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vgspark.functions import sequences as q
from vgspark.model import GraphSet
from vgspark import storage
from vgspark.operators import greedy, metrics, order, snarls, topology


def test_numbers_and_totals_over_ranges(spark):
    """Groups that end within a range, that span ranges, and a null one, against loops."""
    rng = random.Random(1)
    rows = [(g, rng.randrange(10**6), rng.randrange(-9, 9) if rng.random() < 0.9 else None) for g in ["a"] * 400 + ["b"] * 3 + [None] * 60 + ["c"]]
    rows = list({(g, t): (g, t, v) for g, t, v in rows}.values())
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, t int, v int").repartition(7)
    number = {(r.g, r.t): r.nth for r in order.numbered(df, ["t"], ["g"]).collect()}
    top = {(r.g, r.t): r.x for r in order.running(df, ["t"], "v", "x", ["g"], "max", itself=False).collect()}
    total = {(r.g, r.t): r.x for r in order.running(df, ["t"], "v", "x", ["g"]).collect()}
    after = {(r.g, r.t): r.x for r in order.following(df, ["t"], "t", "x", ["g"]).collect()}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        for i, (_, t, _) in enumerate(own):
            values = [v for *_, v in own[: i + 1] if v is not None]
            assert number[g, t] == i + 1
            assert total[g, t] == (sum(values) if values else None)
            assert top[g, t] == max((v for *_, v in own[:i] if v is not None), default=None)
            assert after[g, t] == (own[i + 1][1] if i + 1 < len(own) else None)
    whole = sorted(r[1] for r in rows)
    assert {(r.t, r.n) for r in order.numbered(df.select("t"), ["t"], name="n", start=0).collect()} >= {(t, i) for i, t in enumerate(whole) if whole.count(t) == 1}
    assert not order.numbered(df.limit(0), ["t"], ["g"]).collect() and not order.following(df.limit(0), ["t"], "v", "x").collect()


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, rng.randrange(60), rng.randrange(60)) for k in "xy" for _ in range(35)] + [("z", i, i + 1) for i in range(100, 130)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for k, a, b in edges:
        x, y = sorted((find((k, a)), find((k, b))))
        root[y] = x
    want = {(k, n): find((k, n))[1] for k, a, b in edges if a != b for n in (a, b)}
    got = order.components(spark.createDataFrame(edges, "k string, a int, b int"), ["k"]).collect()
    assert {(r.k, r.node): r.root for r in got} == want and len(got) == len(want)


def dag(rng, n, first=0):
    """Edges of a graph in stretches that meet in one node, some of them tangled."""
    edges, at = set(), first
    while at < first + n:
        size = rng.choice([1, 2, 3, 6])
        inner = list(range(at + 1, at + 1 + size))
        for i, v in enumerate(inner):
            for _ in range(rng.randrange(1, 3)):
                edges.add((rng.choice([at, *inner[:i]]), v))
            if rng.random() < 0.9:
                edges.add((v, rng.choice([*inner[i + 1 :], at + size + 1])))
        at += size + 1
    return edges


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_bubbles_by_region_equal_those_of_whole_graphs(spark, most):
    rng = random.Random(3)
    names, rows = [], []
    for k in range(8):
        edges = dag(rng, 25) | (dag(rng, 20, 1000) if k % 2 else set())  # two parts that aren't joined
        rows += [(f"g{k}", a, b) for a, b in edges]
        names += [(f"g{k}", v, str(v), "A") for v in {x for e in edges for x in e}]
    g = GraphSet(spark.createDataFrame(names, "graph_id string, node_id long, name string, seq string"), spark.createDataFrame(rows, "graph_id string, src long, dst long"), None)
    rank = topology.topological_rank(g)
    got = {(r.graph_id, r.source, r.sink, tuple(r.path)) for r in snarls.raw_alleles(g, rank, region=most).collect()}
    at = {(r.graph_id, r.node_id): r["rank"] for r in rank.collect()}
    want, regions = set(), {(r.graph_id, r.node_id): str(r.region) for r in topology.regions(g.edges, rank, most).collect()}
    for k in {r[0] for r in rows}:
        nodes = sorted({x for i, a, b in rows if i == k for x in (a, b)})
        succ = [[] for _ in nodes]
        for i, a, b in sorted(rows):
            if i == k:
                succ[nodes.index(a)].append(nodes.index(b))
        ranks = [at[k, v] for v in nodes]
        ordered = sorted(range(len(nodes)), key=ranks.__getitem__)
        where = {r: i for i, r in enumerate(ranks)}
        for s in range(len(nodes)):
            t = snarls.find_sink(s, succ, ranks, [where[i] for i in range(len(nodes))])
            paths = snarls.allele_paths(s, t, succ, ranks, 10**6) if t is not None else []
            want |= {(k, nodes[s], nodes[t], tuple(nodes[x] for x in p)) for p in paths if len(paths) > 1}
        assert len(ordered) == len(nodes)
    assert got == want and len(want) > 50
    sizes = {}
    for v, r in regions.items():
        sizes[v[0], r] = sizes.get((v[0], r), 0) + 1
    assert len(sizes) > 20 and (most > 3 or max(sizes.values()) < 25), "parts that are not joined are told apart where regions are large"


def loop(a, b, score):
    free, out = sorted(b), []
    for l, x in sorted(a):
        best = min(((-score[x, y], r) for r, y in free if (x, y) in score), default=None)
        if best:
            r = best[1]
            free = [f for f in free if f[0] != r]
            out.append((l, r))
    return set(out)


def best(a, b, score):
    """The best edge first, of equal ones that with the least l, then the least r."""
    left, right, out = set(), set(), set()
    for _, l, r in sorted((-score[x, y], l, r) for l, x in a for r, y in b if (x, y) in score):
        if l not in left and r not in right:
            left.add(l)
            right.add(r)
            out.add((l, r))
    return out


def test_choice_by_classes_equals_the_loop(spark):
    rng = random.Random(4)
    for case in range(2):
        na, nb, values = rng.randrange(1, 5), rng.randrange(1, 5), [[1.0, 0.9, 0.8, 0.7], [1.0, 0.9]][case % 2]
        score = {(f"x{i}", f"y{j}"): rng.choice(values) for i in range(na) for j in range(nb) if rng.random() < 0.8}
        a = [(l, f"x{rng.randrange(na)}") for l in rng.sample(range(1000), 60)]
        b = [(r, f"y{rng.randrange(nb)}") for r in rng.sample(range(1000), 50)]
        df = spark.createDataFrame([(*k, s) for k, s in score.items()], "cl string, cr string, score double")
        kinds = dict(a), dict(b)
        for choose, want in ((greedy.serial_classes, loop), (greedy.best_first_classes, best)):
            got = choose(spark.createDataFrame(a, "l int, cl string"), spark.createDataFrame(b, "r int, cr string"), df).collect()
            assert {(r.l, r.r) for r in got} == want(a, b, score), (case, want)
            assert all(r.score == score[kinds[0][r.l], kinds[1][r.r]] for r in got)


def test_many_copies_take_few_rounds(spark, monkeypatch):
    calls = []
    kept = greedy.numbered
    monkeypatch.setattr(greedy, "numbered", lambda *x, **y: calls.append(1) or kept(*x, **y))
    n = 100_000
    a = spark.range(n).selectExpr("id AS l", "CASE WHEN pmod(xxhash64(id), 3) > 0 THEN 'x1' ELSE 'x2' END AS cl")
    b = spark.range(n).selectExpr("id AS r", "CASE WHEN pmod(xxhash64(id, 7), 2) > 0 THEN 'y1' ELSE 'y2' END AS cr")
    df = spark.createDataFrame([("x1", "y1", 1.0), ("x1", "y2", 0.97), ("x2", "y2", 1.0), ("x2", "y1", 0.97)], "cl string, cr string, score double")
    found = greedy.serial_classes(a, b, df)
    assert found.count() == n and len(calls) <= 8
    assert found.agg(F.countDistinct("l"), F.countDistinct("r")).first() == (n, n)


def test_order_in_rounds_equals_that_of_a_queue(spark):
    """Tangled stretches, parts that aren't joined, loose ends, single nodes and long chains of nested bubbles."""
    rng = random.Random(5)
    rows, names = [], []
    for k in range(5):
        edges = dag(rng, 30) | (dag(rng, 25, 500) if k % 2 else set())
        edges |= {(700 + i, 701 + i) for i in range(40)} if k == 3 else set()
        if k == 4:  # bubbles within bubbles, and ids against the order
            edges = {(5000 - 10 * i - a, 5000 - 10 * i - b) for i in range(12) for a, b in ((0, 1), (0, 5), (1, 2), (1, 3), (2, 4), (3, 4), (4, 10), (5, 10))}
        ids = {x for e in edges for x in e} | {9000 + k}
        turn = dict(zip(sorted(ids), rng.sample(range(10_000), len(ids)))) if k == 2 else {x: x for x in ids}
        rows += [(f"g{k}", turn[a], turn[b]) for a, b in edges]
        names += [(f"g{k}", turn[v], str(v), "A") for v in ids]
    g = GraphSet(spark.createDataFrame(names, "graph_id string, node_id long, name string, seq string"), spark.createDataFrame(rows, "graph_id string, src long, dst long"), None)
    want = {tuple(r) for r in topology.topological_rank(g).collect()}
    assert {tuple(r) for r in topology.topological_rank(g, most=0).collect()} == want and len(want) == len(names)
    assert {tuple(r) for r in topology.topological_rank(g, most=60).collect()} == want


@pytest.mark.parametrize("ring", [[("a", "b"), ("b", "c"), ("c", "b")], [("a", "b"), ("c", "d"), ("d", "c")], [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("a", "d")]])
def test_cycles_are_errors_in_rounds(spark, ring):
    names = sorted({x for e in ring for x in e})
    with pytest.raises(ValueError, match="cycle"):
        topology.topological_rank(GraphSet.build(spark, "g", [(n, "A") for n in names], ring), most=0)


def test_order_of_ids_is_told_without_ordering(spark, monkeypatch):
    """Chains of bubbles with ids in order need no group or rounds; any other graph is told from them, by loops."""
    rng = random.Random(5)
    graphs = {f"g{k}": {(4 * i, 4 * i + j) for i in range(30) for j in (1, 2, 3)} | {(4 * i + j, 4 * i + 4) for i in range(30) for j in (1, 2, 3)} for k in range(6)}
    graphs["g1"] = {(a * 7 % 121, b * 7 % 121) for a, b in graphs["g1"]}  # ids against the order
    graphs["g2"] |= {(0, 119)}  # released later still
    graphs["g3"] |= {(200, 120)}  # starts late
    graphs["g4"] |= {(2, 4), (60, 64)}
    for k in range(6, 30):
        n = rng.randrange(3, 7)
        graphs[f"g{k}"] = {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5} | {(0, 1)}
    rows = [(g, a, b) for g, es in graphs.items() for a, b in es]
    names = [(g, v, str(v), "A") for g, es in graphs.items() for v in {x for e in es for x in e}]
    g = GraphSet(spark.createDataFrame(names, "graph_id string, node_id long, name string, seq string"), spark.createDataFrame(rows, "graph_id string, src long, dst long").repartition(3), None)
    want = set()
    for name, es in graphs.items():
        nodes = np.array(sorted({x for e in es for x in e}))
        if (np.diff(topology.kahn(nodes, *(np.array(x) for x in zip(*es)))) == 1).all():
            want.add(name)
    got = {r.graph_id for r in topology.in_order_of_ids(topology.node_table(g)).collect()}
    assert got == want and {"g0", "g2", "g4", "g5"} & got and not {"g1", "g3"} & got
    monkeypatch.setattr(topology.levels, "ranked", None)
    only = GraphSet(g.nodes.where("graph_id = 'g0'"), g.edges.where("graph_id = 'g0'"), None)
    assert [r["rank"] for r in topology.topological_rank(only, most=0).orderBy("node_id").collect()] == list(range(121))


def test_minimizers_against_loops(spark):
    """Sequences shorter than a k-mer, than a window, long ones, repeats, letters beyond ASCII, none and null; many slices a batch."""

    def loop(s, k, w):
        h = []
        for i in range(len(s) - k + 1):
            x = 2166136261
            for c in s[i : i + k]:
                x = (x ^ ord(c)) * 16777619 & 0xFFFFFFFF
            h.append(x)
        return sorted({min(h[i : i + w]) for i in range(max(len(h) - w + 1, 1))}) if h else []

    rng = random.Random(8)
    texts = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (*range(0, 70, 3), 14, 15, 24, 25, 26)] + ["A" * 40, "né\U0001d11e" * 9, "ACGTNacgt" * 200_000, "G" * 16, None, ""]
    for k, w in ((15, 10), (3, 4), (1, 1)):
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string").coalesce(1).select("i", q.minimizers("s", k, w).alias("m")).collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert r.m == (None if texts[r.i] is None else loop(texts[r.i], k, w)), (r.i, k, w)


def test_minimizers_leave_the_lambdas(spark):
    """Of a letter of a k-mer no expression is interpreted: the plan has one Arrow step and no aggregate over an array."""
    plan = spark.createDataFrame([("A" * 32,)], "s string").select(q.minimizers("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan


def test_partitions_follow_rows(spark, monkeypatch):
    """What groups edges is dealt out by the number of rows, not to a fixed number of tasks; results are as of loops, with repeats and cycles."""
    monkeypatch.setattr(storage, "ROWS", 10)
    rng = random.Random(9)
    rows = [("g", rng.randrange(60), rng.randrange(60)) for _ in range(200)]
    edges, after = spark.createDataFrame(rows, "graph_id string, src long, dst long"), {}
    for _, a, b in rows:
        after.setdefault(a, set()).add(b)
    near = topology.neighbours(edges, direction="in")
    assert near.rdd.getNumPartitions() >= 20 and {(r.node_id, r.neighbour) for r in near.collect()} == {(b, a) for _, a, b in rows}
    out = topology.adjacency(edges)
    assert out.rdd.getNumPartitions() >= 20 and {r.node_id: r.successors for r in out.collect()} == {a: sorted(bs) for a, bs in after.items()}
    paths = spark.createDataFrame([("g", "p", i, rng.randrange(60)) for i in range(50)], "graph_id string, path_name string, step int, node_id long")
    whole = topology.all_edges(GraphSet(None, edges, paths))
    steps = [r.node_id for r in sorted(paths.collect(), key=lambda r: r.step)]
    assert whole.rdd.getNumPartitions() >= 20 and sorted((r.src, r.dst) for r in whole.collect()) == sorted({(a, b) for _, a, b in rows} | set(zip(steps, steps[1:])))
    for hops in (1, 3):
        found, want, front = topology.reachable(edges, hops), {}, {(a, b) for _, a, b in rows}
        for n in range(1, hops + 1):
            want = {p: n for p in front} | want
            front = {(a, c) for a, b in front for c in after.get(b, ())}
        assert found.rdd.getNumPartitions() >= 20
        got = [((r.src, r.dst), r.hops) for r in found.collect()]
        assert dict(got) == want and len(got) == len(want)


def test_coverage_tells_apart_only_pairs_that_may_repeat(spark):
    spans = lambda n: spark.createDataFrame([("p", n + i, 10 * i, 10 * i + 10) for i in range(6)], "path_name string, node_id long, start long, end long")
    of = lambda rows: spark.createDataFrame([("p", a, b, "p", a, b) for a, b in rows], "q_name string, q_start long, q_end long, t_name string, t_start long, t_end long")
    for rows, distinct in (([(0, 20), (30, 60)], False), ([(0, 40), (20, 60)], True)):
        found = metrics.coverage(of(rows), spans(0), spans(100))
        want = {(i, 100 + j) for a, b in rows for i in range(a // 10, b // 10) for j in range(a // 10, b // 10)}
        got = [(r.node_a, r.node_b) for r in found.collect()]
        assert set(got) == want and len(got) == len(want)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert ("Aggregate [node_a" in plan) == distinct
