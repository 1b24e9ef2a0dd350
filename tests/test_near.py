"""Pairs of bubbles whose alleles match at 0.75 but not at 0.9, and the kernel that finds such alleles."""

import random

import duckdb
import pytest

import __spark_entry__ as entry
from vgspark.model import AnchorParams
from vgspark.operators import anchors, near
from vgspark.operators.matching import edit_distance


def _word(rng, n, letters="ACGT"):
    return "".join(rng.choice(letters) for _ in range(n))


def _turned(rng, x, edits, n, letters):
    for _ in range(edits):
        if not x:
            break
        i = rng.randrange(len(x))
        x = x[:i] + rng.choice([_word(rng, 1, letters), "", x[i] + _word(rng, 1, letters)]) + x[i + 1 :]
    return (x + _word(rng, n, letters))[:n]


@pytest.mark.parametrize("n,m,letters,s", [(32, 32, "ACGT", 0.75), (30, 33, "ACGT", 0.75), (24, 28, "ACG", 0.75), (96, 90, "ACGT", 0.75), (64, 65, "ACGTNé", 0.6)])
def test_kernel_against_all_pairs(n, m, letters, s):
    """By quarters, and by all pairs of one word and of several."""
    rng = random.Random(n)
    a = sorted({_word(rng, n, letters) for _ in range(60)})
    b = sorted({_turned(rng, rng.choice(a), rng.randrange(1, 14), m, letters) for _ in range(120)})
    sim = lambda x, y: 1 - edit_distance(x, y) / max(len(x), len(y))
    for strict in (False, True):
        want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if (sim(x, y) > s + 1e-9 if strict else sim(x, y) >= s - 1e-9)}
        i, j = near.similar_rows(a, b, s, strict)
        assert sorted(zip(i.tolist(), j.tolist())) == sorted(want) and len(want) > 20


def test_similar_pairs_with_many_edits(spark, monkeypatch):
    """Sequences of several lengths in many blocks, some of which are longer or shorter than what the kernel takes; none meets by short pieces."""
    monkeypatch.setattr(near, "LEFT", 16)
    monkeypatch.setattr(near, "RIGHT", 16)
    rng = random.Random(6)
    base = [_word(rng, rng.choice([0, 3, 9, 14, 31, 32, 33, 70])) for _ in range(80)]
    other = [_turned(rng, x, rng.randrange(0, 12), max(len(x) + rng.randrange(-3, 4), 0), "ACGT") if x else x for x in base] + base[:5]
    frame = lambda xs: spark.createDataFrame(list(enumerate(xs)), "node_id int, seq string")
    sim = lambda x, y: 1 - edit_distance(x, y) / max(len(x), len(y), 1)
    want = sorted((i, j) for i, x in enumerate(base) for j, y in enumerate(other) if sim(x, y) >= 0.75 - 1e-9)
    assert sorted((x.l, x.r) for x in anchors.similar_pairs(frame(base), frame(other), AnchorParams(min_sim=0.75)).collect()) == want


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Order 101 has equal lines in both graphs; line 3 of order 7728 (graph A) and line 7 of order 11482 (graph B) are alike at 0.75 to 0.9."""
    folder, con = tmp_path_factory.mktemp("near"), duckdb.connect()
    con.sql(f"COPY (SELECT unnest([101, 102, 7728, 7729, 11482, 11483])::BIGINT AS o_orderkey) TO '{folder}/orders.parquet'")
    con.sql(f"""COPY (SELECT * FROM (VALUES (101::BIGINT, 1, 'N'), (101, 2, 'N'), (7728, 1, 'A'), (7728, 3, 'A'), (11482, 2, 'R'), (11482, 7, 'R')) x(l_orderkey, l_linenumber, l_returnflag)) TO '{folder}/lineitem.parquet'""")
    return str(folder)


A, B = "anc_7728>anc_7729", "anc_11482>anc_11483"
#: What tells in a query's rows that the pair is there.
TOLD = {
    "allele_match_lap": lambda r: r[:2] == (1, 1) and r[3:] == (1, "1:1", "0", "0"),
    "allele_match_greedy": lambda r: r[:2] == (1, 1) and r[3:] == (1, "1:1", "0", "0"),
    "allele_match_optimal": lambda r: r[:2] == (1, 1) and r[3:] == (1, "1:1", "0", "0"),
    "total_score": lambda r: r[1] == 2,
    "pairing_score": lambda r: r[:2] == (1, 1),
    "delta_a_only": lambda r: r[:2] == (A, 0),
    "delta_b_only": lambda r: r[:2] == (B, 0),
    "delta_vcf_lines": lambda r: r[0].startswith(A) and r[0].endswith("ALLELE_IDX=0"),
    "gaf_lines": lambda r: r[0].startswith(f"snarl\t{A}\t{B}\t") and "\t1:1:0.7" in r[0],
    "matched_nodes": lambda r: r == (7728 * 16 + 3, 11482 * 16 + 7),
    "variant_match_lap": lambda r: r[:2] == (1, 1) and r[3:] == (1, "1:1", "0", "0"),
    "job1_delta_report": lambda r: r[0] == A and r[3] == B and r[6] == "shared",
}


@pytest.mark.parametrize("query", TOLD)
def test_pairs_that_match_at_three_quarters(spark, tables, query):
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    rows = lambda xs: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in x) for x in xs), key=repr)
    found = entry.queries()[query](spark, tables)
    want = con.sql(entry.oracle_sql()[query])
    got = rows(tuple(r[c] for c in want.columns) for r in found.collect())
    assert got == rows(want.fetchall()) and any(TOLD[query](r) for r in got)
