import random

import numpy as np

from vgspark.llm import partenum

SCHEMA = "doc_id long, text string, node long, sig string, root long, n long"


def brute(rows, size=4, percent=85):
    """(id, number of shingles, component) by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        k = min(size, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def rows_of(seed=4, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 6))) for _ in range(40)]
    out = []
    for _ in range(n):
        w = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 4, 8, 9, 10, 11, 12, 20, 45, 120, 400]))]
        for _ in range(rng.randrange(1, 5)):
            v = list(w)
            for _ in range(rng.randrange(0, max(1, len(w) // 25) + 1)):
                v[rng.randrange(len(v))] = rng.choice(vocab)
            out.append(" ".join(v + w[:3] * rng.randrange(2)))
    out += [None, "", " \t\n", out[0].upper(), out[1], "x" * 40_000, " ".join(["same"] * 5000)]
    ids = list(range(len(out)))
    rng.shuffle(ids)
    return [*zip(ids, out), (ids[3], out[3]), (None, out[5]), (None, "alone here")]


def test_groups_equal_all_pairs(spark):
    rows = rows_of()
    docs = spark.createDataFrame([(i, t, 1, "s", 2, 3) for i, t in rows], SCHEMA)
    got = sorted(map(tuple, partenum.jaccard_groups(docs).collect()), key=repr)
    assert got == brute(rows)
    assert not partenum.jaccard_groups(docs.limit(0)).collect()
    named = docs.withColumnsRenamed({"doc_id": "k", "text": "body"}).selectExpr("CAST(k AS string) AS k", "body", "node")
    assert {(r.doc_id, r.n_shingles) for r in partenum.jaccard_groups(named, "k", "body").collect()} == {(None if i is None else str(i), n) for i, n, _ in brute(rows)}


def test_large_group_meets_by_few_pairs(spark):
    """Near copies of one text, a sixth of them equal, and a passage that many other texts hold."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    rows = []
    for i in range(150):
        w = list(base)
        if i % 6:
            w[rng.randrange(200)] = f"new{i}"
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(base[:60] + [f"own{i}-{k}" for k in range(60)])) for i in range(150, 260)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, partenum.jaccard_groups(docs).collect()), key=repr) == brute(rows)


def flat(h, low):
    return np.concatenate([h[:0], *(s for _, s in partenum.signatures(h, low))])


def allowed(a, b, low):
    """The parities in an instance that both have differ in no more bits than there are features that only one set has."""
    x, y = (dict(zip(reversed(partenum.instances(len(h), low)), partenum.parities(h, low))) for h in (a, b))
    return all(sum(map(int.bit_count, (p ^ q).view(np.uint64).tolist())) <= len(np.setxor1d(a, b)) for p, q in ((x[i], y[i]) for i in x.keys() & y.keys()))


def test_words_across_blocks(monkeypatch):
    rng = random.Random(10)
    text = "".join(rng.choice("ab c\nÉ") for _ in range(2000))
    whole = partenum.Shingles().words(text)
    assert len(whole) == len(text.encode().split()) and len(set(whole.tolist())) == len({w.lower() for w in text.encode().split()})
    for block in (1, 2, 5, 64, 999):
        monkeypatch.setattr(partenum, "BLOCK", block)
        assert (partenum.Shingles().words(text) == whole).all()


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(6)
    low = partenum.bands()
    for n in [*range(2, 60), 100, 333, 1000]:
        for _ in range(20):
            a = rng.integers(0, 1 << 63, n).astype(np.uint64)
            gone, new = rng.integers(0, n), rng.integers(0, n)
            b = np.unique(np.concatenate([a[gone // 4 :], rng.integers(0, 1 << 63, new // 4).astype(np.uint64)]))
            a = np.unique(a)
            common = len(np.intersect1d(a, b))
            if 100 * common >= 85 * (len(a) + len(b) - common) and common < max(len(a), len(b)):
                assert len(np.intersect1d(flat(a, low), flat(b, low)))
                assert allowed(a, b, low)


def test_empty_projections_are_refined():
    """Sets that share an empty subset of cells don't all meet."""
    rng = np.random.default_rng(7)
    low, seen = partenum.bands(), {}
    for i in range(4000):
        for s in flat(np.unique(rng.integers(0, 1 << 63, 7).astype(np.uint64)), low):
            seen.setdefault(int(s), set()).add(i)
    assert max(map(len, seen.values())) < 4
