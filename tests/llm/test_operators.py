import random
import tracemalloc
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vgspark.llm import decontaminate, hamming, lines, mixing, pitman_yor, secrets, simhash, suffixes, surrogates, toxicity
from vgspark.llm.common import components, is_remainder, words

SCHEMA = "doc_id long, text string, lang string, source string, score double"


def frame(spark, rows):
    """Rows of (id, text, source) with columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "en", s, 1.0) for i, t, s in rows], SCHEMA)


def texts(seed=1, n=30):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(60)]
    out = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 60))) for _ in range(n)]
    out += [out[3], out[4], out[5] + " tail", None, "", "  \n\t", "\n".join(out[6:9]), "x" * 5000]
    return [(i, t, f"s{i % 3}" if i % 7 else None) for i, t in enumerate(out)] + [(2, out[2], "s2"), (None, "lone", "s1")]


def test_mixing(spark):
    rows = texts()
    r = mixing.mixed(frame(spark, rows)).collect()
    assert len(r) == len(rows) and all(x.taken <= 3 * x.size for x in r)
    total = sum(x.size for x in r)
    by = {}
    for x in r:
        by.setdefault(x.source, []).append(x)
    assert sum(v[0].target for v in by.values()) == pytest.approx(total)
    for v in by.values():
        assert v[0].source_size == sum(x.size for x in v) and v[0].target <= 3 * v[0].source_size + 1e-6
    for v in by.values():  # a few documents can't be nearer than the largest one's words
        assert abs(sum(x.taken for x in v) - v[0].target) <= max(x.size for x in v)
    again = mixing.mixed(frame(spark, rows[::-1]).repartition(5)).collect()
    key = lambda x: (x.doc_id is None, x.doc_id or 0, x.size, x.taken)
    assert [tuple(x) for x in sorted(again, key=key)] == [tuple(x) for x in sorted(r, key=key)]
    assert not mixing.mixed(frame(spark, rows).limit(0)).collect()


def test_mixing_is_near_its_targets(spark):
    rng = random.Random(21)
    rows = [(i, "w " * rng.randrange(1, 200), rng.choice(["a", "b", "b", "b", "c", None])) for i in range(900)]
    r = mixing.mixed(frame(spark, rows)).collect()
    for s in ("a", "b", "c", None):
        v = [x for x in r if x.source == s]
        assert abs(sum(x.taken for x in v) - v[0].target) <= 0.02 * v[0].target


def test_lines(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefghijklmnop") * 2 + str(rng.randrange(30)) for _ in range(12)) for _ in range(12)]
    docs = []
    for i in range(20):
        ls = []
        for _ in range(5):
            w = rng.choice(base).split()
            if rng.random() < 0.6:
                w[rng.randrange(len(w))] = "new" + str(rng.randrange(1000))
            ls.append(" ".join(w))
        docs.append((i, "\n".join([*ls, "", "Hi."]), "s"))
    docs += [(3, docs[3][1], "s"), (50, None, "s"), (51, "", "s")]
    order = sorted(docs, key=lambda x: x[0])
    seen, want = [], {}
    for i, t, _ in order:
        gone = []
        for k, line in enumerate(t.split("\n") if t is not None else []):  # a null text has no line
            s = set(line.lower().split())
            if s:
                if any(len(s & o) >= 0.8 * len(s | o) - 1e-9 for o in seen):
                    gone.append(k)
                seen.append(s)
        want.setdefault(i, []).append(gone)
    got = {}
    for x in lines.removed_lines(frame(spark, docs)).orderBy("doc_id", "copy").collect():
        got.setdefault(x.doc_id, []).append(list(x.removed))
    assert got == want
    kept = lines.without_lines(frame(spark, docs))
    assert kept.count() == len(docs) and kept.columns == frame(spark, docs).columns
    assert {x.text for x in kept.where("doc_id = 50").collect()} == {None}


@pytest.mark.parametrize("similarity", (0.5, 0.7))
def test_short_lines(spark, similarity):
    rng = random.Random(3)
    docs = [(i, "\n".join(" ".join(rng.sample("abcdefghijklmnopqrstuvwxyz", rng.randrange(1, 6))) for _ in range(6)), "s") for i in range(12)]
    docs += [(20, "one two three\nred green", "s"), (21, "one two three four\nred green blue\nblack", "s")]
    seen, want = [], {}
    for i, t, _ in docs:
        want[i] = []
        for k, line in enumerate(t.split("\n")):
            s = set(line.split())
            if any(len(s & o) >= similarity * len(s | o) - 1e-9 for o in seen):
                want[i].append(k)
            seen.append(s)
    assert {x.doc_id: list(x.removed) for x in lines.removed_lines(frame(spark, docs), similarity=similarity).collect()} == want and want[21][0] == 0


def test_groups_of_similar_lines_meet_once(spark, monkeypatch):
    """Pairs grow with the lines of a group of near copies, not with their square."""
    groups = [[f"g{g}w{i}" for i in range(30)] for g in range(4)]
    docs = [(g * 100 + i, " ".join([*groups[g][:29], f"own{g}x{i}"]), "s") for g in range(4) for i in range(60)]
    pairs, keep = [], lines.stored

    def spy(df, what="part"):
        out = keep(df, what)
        pairs.extend([out.count()] if what == "pairs" else [])
        return out

    monkeypatch.setattr(lines, "stored", spy)
    got = {x.doc_id: list(x.removed) for x in lines.removed_lines(frame(spark, docs)).collect()}
    assert got == {i: [0] if i % 100 else [] for i, _, _ in docs}
    assert sum(pairs) <= 4 * len(docs)


def test_groups_of_similar_lines_meet_once_where_others_have_their_words(spark, monkeypatch):
    """The first line of a word may be another's; pairs still grow with the group, in long lines and in short ones whose own word comes first."""
    long, short = [f"word{i:02d}" for i in range(30)], [f"part{i}" for i in range(8)]
    docs = [(i, " ".join([w, *(f"other{i}x{k}" for k in range(9))]), "s") for i, w in enumerate(long)]
    docs += [(100 + i, " ".join([*long[:29], f"o{i}"]), "s") for i in range(80)] + [(200 + i, " ".join([*short, f"anotherword{i}"]), "s") for i in range(80)]
    pairs, keep = [], lines.stored

    def spy(df, what="part"):
        out = keep(df, what)
        pairs.extend([out.count()] if what == "pairs" else [])
        return out

    monkeypatch.setattr(lines, "stored", spy)
    got = {x.doc_id: list(x.removed) for x in lines.removed_lines(frame(spark, docs)).collect()}
    assert got == {i: [0] if i > 100 and i != 200 else [] for i, _, _ in docs}
    assert sum(pairs) <= 6 * len(docs)


def test_simhash_variants_are_not_broadcast(spark):
    """Variants are 64 rows a print, which Spark's sizes don't show; they met by a broadcast where the prints were small."""
    prints = spark.range(5000).select(F.xxhash64("id").alias("fp"))
    found = simhash.fingerprint_links(prints)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert found.count() == 0


def test_simhash(spark):
    rows = texts()

    def print_of(t):
        w = words(t)
        sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0

    want = [print_of(t) for _, t, _ in rows]
    assert [simhash.fingerprint(t) & (2**64 - 1) for _, t, _ in rows] == want
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(60)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))) for f in fps]
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    got = {(x.a & (2**64 - 1), x.b & (2**64 - 1)) for x in simhash.fingerprint_links(df).collect()}
    assert {frozenset(x) for x in got} == {frozenset((a, b)) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 3}
    r = simhash.simhash_groups(frame(spark, rows)).collect()
    assert len(r) == len(rows) and {x.component_id for x in r if x.doc_id in (3, 30)} == {3}


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9), (3, 7)], "a long, b long")
    assert {(x.node, x.root) for x in components(e).collect()} == {(1, 1), (2, 1), (3, 1), (7, 1), (5, 4), (4, 4)}


def test_near_copies(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(120)), "s") for i in range(10)]
    w = rows[0][1].split()
    rows += [(20, " ".join(w[:60] + ["zz"] + w[61:]), "s"), (21, rows[1][1], "s"), (22, None, "s"), (23, "", "s")]
    r = {x.doc_id: x.group for x in simhash.near_copies(frame(spark, rows)).collect()}
    assert r[0] == r[20] and r[1] == r[21] and r[22] == r[23] and len(set(r.values())) == 11


def test_near_copies_whole(spark):
    rng = random.Random(17)
    rows, want = [], {}
    for n in (4, 5, 9, 20, 45, 90, 300, 1000):
        for _ in range(12 if n < 100 else 3):
            a = [f"w{rng.randrange(10**6)}" for _ in range(n + 4 + n // 4 + 1)]
            i = len(rows)
            # n shingles against n + n // 4, which is 0.8 or just above, and with one more just below
            rows += [(i, " ".join(a[: n + 4]), "s"), (i + 1, " ".join(a[:-1]), "s")]
            b = [f"v{x}" for x in a]
            rows += [(i + 2, " ".join(b[: n + 4]), "s"), (i + 3, " ".join(b), "s")]
            want |= {i: i, i + 1: i, i + 2: i + 2, i + 3: i + 3}
    license = " ".join(f"l{k}" for k in range(40))
    for k in range(60):  # a common passage makes no copies
        want[len(rows)] = len(rows)
        rows.append((len(rows), license + " " + " ".join(f"u{k}x{x}" for x in range(20)), "s"))
    first = {}
    for x in simhash.near_copies(frame(spark, rows)).orderBy("doc_id").collect():
        assert first.setdefault(x.group, x.doc_id) == want[x.doc_id], rows[x.doc_id]
    assert len(first) == len(set(want.values()))


def test_near_copies_brute_force(spark):
    rng = random.Random(18)
    base = [[f"w{rng.randrange(40)}" for _ in range(rng.choice((1, 4, 8, 9, 12, 30, 80)))] for _ in range(25)]
    docs = []
    for _ in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            w.insert(rng.randrange(len(w) + 1), f"w{rng.randrange(40)}") if rng.random() < 0.5 else w.pop(rng.randrange(len(w))) if len(w) > 1 else None
        docs.append(w)
    sets = [{tuple(w[i : i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1)} for w in docs]
    root = list(range(len(docs)))
    for i, x in enumerate(sets):
        for j in range(i):
            if docs[i] == docs[j] or len(x & sets[j]) >= 0.8 * len(x | sets[j]) - 1e-9:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    group = {x.doc_id: x.group for x in simhash.near_copies(frame(spark, [(i, " ".join(w), "s") for i, w in enumerate(docs)])).collect()}
    assert all((group[i] == group[j]) == (root[i] == root[j]) for i in range(len(docs)) for j in range(i))


def test_decontamination(spark):
    rows = texts()
    items = [(1, "What is abra cadabra of the seven hills in spring? The answer is forty two."), (2, rows[6][1]), (3, None), (4, "")]
    rows.append((70, "foo bar " + items[0][1].upper().replace("TWO.", "two!!") + " baz", "s"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(frame(spark, rows), bench).collect()}
    assert (70, 1) in got and (6, 2) in got and not any(d == 70 and i != 1 for d, i in got)
    assert not decontaminate.contaminated(frame(spark, rows), bench.limit(0)).collect()


def test_decontamination_brute_force(spark):
    rng = random.Random(21)
    vocab = [f"w{i}" for i in range(400)]
    sentence = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, sentence(rng.choice((3, 6, 10, 25, 70))).capitalize() + "? " + sentence(rng.choice((1, 4, 8))) + ".") for i in range(60)]
    rows = [(i, sentence(rng.randrange(0, 300)), "s") for i in range(30)]
    for i in range(30, 70):
        planted = [x if rng.random() > 0.04 else "zz" for x in rng.choice(items)[1].split()]
        rows.append((i, " ".join([sentence(rng.randrange(150)), *planted, sentence(rng.randrange(150))]), "s"))
    parts = [decontaminate.question_answer(t) for _, t in items]
    df = {}
    for q, a in parts:
        for t in {*q, *a}:
            df[t] = df.get(t, 0) + 1
    mean = sum(len(q) + len(a) for q, a in parts) / len(parts)
    want = {}
    for d, text, _ in rows:
        w = decontaminate.terms(text)
        for i, (q, a) in enumerate(parts):
            bag, n = q + a, len(q) + len(a)
            own = {t: np.log(1 + (len(items) - df[t] + 0.5) / (df[t] + 0.5)) * bag.count(t) * 2.2 / (bag.count(t) + 1.2 * (0.25 + 0.75 * n / mean)) for t in bag}
            step = 8
            while step < n:
                step *= 2
            for p in range(0, len(w), step):
                passage = w[p : p + 2 * step]
                score = sum(own[t] for t in own if t in passage) / sum(own.values())
                grams = lambda x: {tuple(x[k : k + 5]) for k in range(max(1, len(x) - 4))}
                qs = len(grams(q) & grams(passage)) / len(grams(q)) if len(q) >= 5 else float(b" ".join(q) in b" ".join(passage))
                hits = sum(min(a.count(t), passage.count(t)) for t in set(a)) / len(a)
                if score >= 0.5 and qs >= 0.6 and hits >= 0.6:
                    want[d, i] = max(score, want.get((d, i), 0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.score for x in decontaminate.contaminated(frame(spark, rows), bench).collect()}
    assert len(want) > 20 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    # neither other items nor the size of an index change what is found
    some = list(decontaminate.indexes(bench, 0.5, limit=1000))
    texts_ = [t for _, t, _ in rows]
    apart = {(d, x["item"]) for index in some for d, found in enumerate(index.searched(texts_, 0.6)) for x in found}
    assert len(some) > 1 and apart == set(want)


def test_leaks_without_ids(spark, tmp_path):
    import corpus_pipeline

    a, b = "What is abra cadabra of the seven hills in spring? The answer is forty two.", "Who sailed round the cold northern cape before winter came? It was old captain Brandt."
    spark.createDataFrame([(1, a), (None, b)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, "foo " + a, "s"), (5, "bar " + b, "s"), (7, "baz " + a, "s"), (7, "clean text of the same id", "s"), (None, "clean text without an id", "s"), (8, None, "s")]
    out = corpus_pipeline.leaks_out(spark, frame(spark, rows), str(tmp_path))
    assert sorted(str(x.text) for x in out.collect()) == sorted(str(rows[i][1]) for i in (3, 4, 5)) and out.columns == frame(spark, rows).columns
    found = decontaminate.contaminated(frame(spark, rows), spark.read.parquet(str(tmp_path / "benchmark.parquet")))
    assert {(x.doc_id, x.item_id) for x in found.collect()} == {(None, 1), (5, None), (7, 1)}


def test_hamming(spark):
    rng = random.Random(8)
    codes = [rng.getrandbits(64) for _ in range(300)]
    codes += [codes[0]] * 20 + [c ^ 1 for c in codes[:10]]
    rows = [(i, int(np.uint64(c).view(np.int64))) for i, c in enumerate(codes)] + [(None, 5), (999, None)]
    df = spark.createDataFrame(rows, "id long, code long")
    got = {}
    for x in hamming.top_k(df, df.where("id % 20 = 0")).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.distance, x.id))
    for qid, v in got.items():
        want = sorted(((codes[qid] ^ c).bit_count(), i) for i, c in enumerate(codes))[:10]
        assert [(d, i) for _, d, i in sorted(v)] == want
    assert len(got) == len(range(0, len(codes), 20))


def test_secrets():
    t = 'x Password: "abcdef" token=ab secret = Zz09+/ and AKIA' + "A" * 16 + " then deadbeef" * 4 + " " + "0a" * 12
    base = [(k, t[s:e]) for s, e, k in secrets.base_spans(t)]
    assert ("assign", 'Password: "abcdef') in base and ("hex", "0a" * 12) in base and not any("token" in x for _, x in base)
    key = "aB3" * 13 + "z"
    assert not secrets.linked_spans(f"alone {key} here", [], 300)
    linked = f"user: bob\nhttps://db.example.com/x {key}"
    assert {k for *_, k in secrets.linked_spans(linked, secrets.base_spans(linked), 300)} == {"linked_id", "linked_key", "linked_endpoint"}
    assert not secrets.linked_spans(f"user: bob\n\n{key}", [], 300)


def linked_by_pairs(text, gap):
    """The linked spans by holding all pairs of parts of a scope against each other."""
    base = secrets.base_spans(text)
    mixed = lambda x: any(c.isdigit() for c in x) and any("a" <= c <= "z" for c in x) and any("A" <= c <= "Z" for c in x)
    weak = [(*m.span(), k) for k, p in (("linked_id", secrets.WEAK_ID), ("linked_key", secrets.WEAK_KEY), ("linked_endpoint", secrets.ENDPOINT)) for m in p.finditer(text) if k != "linked_key" or mixed(m[0])]
    parts = base + [w for w in weak if not any(s < w[1] and e > w[0] for s, e, _ in base)]
    breaks = [m.start() for m in secrets.BREAK.finditer(text)]
    scope = lambda x: sum(b < x[0] for b in breaks)
    is_key = lambda x: x[2] in ("assign", "hex", "linked_key")
    near = lambda x, y: scope(x) == scope(y) and max(x[0], y[0]) - (x[1] if x <= y else y[1]) <= gap
    return sorted(x for x in parts if x[2].startswith("linked") and any(is_key(x) != is_key(y) and near(x, y) for y in parts))


def test_secrets_brute_force(spark):
    rng = random.Random(41)
    letters = "abcdefghXYZKLM0123456789"
    pieces = [
        lambda: "AKIA" + "".join(rng.choice("ABC123") for _ in range(16)),
        lambda: "user: bob" + str(rng.randrange(9)),
        lambda: f"https://db{rng.randrange(9)}.example.com/x",
        lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(30, 50))),
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(30)),
        lambda: 'token="' + "-".join("0a" * 12 for _ in range(4)) + "-" + "aB3" * 12 + '"',
        lambda: "filler words here " * rng.randrange(1, 12),
        lambda: "\n \n",
    ]
    rows = [(i, " ".join(rng.choice(pieces)() for _ in range(rng.randrange(14))), "s") for i in range(150)]
    rows += [(500, None, "s"), (501, "", "s"), (3, rows[3][1], "s"), (502, "pad " * 50_000 + "user: bob " + "aB3" * 12, "s")]
    docs = frame(spark, rows).withColumn("spans", F.lit("clash"))
    got = {x.doc_id: [(s.start, s.end, s.kind) for s in x.spans] for x in secrets.find_secrets(docs, gap=60).collect()}
    n = 0
    for i, t, _ in rows:
        base, linked = (secrets.base_spans(t), linked_by_pairs(t, 60)) if t else ([], [])
        assert sorted(got[i]) == sorted(base + linked)
        n += len(linked)
    assert n > 100 and got[502] and not got[500] and not got[501]
    clean = {x.doc_id: x.text for x in secrets.redact(docs, gap=60).collect()}
    for i, t, _ in rows:
        keep = bytearray(b"\1" * len(t or ""))
        for s, e, _ in got[i]:
            keep[s:e] = bytes(e - s)
        assert (clean[i] or "").replace("[SECRET]", "") == "".join(c for c, k in zip(t or "", keep) if k)
    assert not secrets.find_secrets(docs.limit(0)).collect() and clean[500] is None


def test_suffixes(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefé") for _ in range(rng.randrange(1, 9)))
    parts = [" ".join(word() for _ in range(rng.randrange(10, 60))) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(parts)[rng.randrange(40) :] if rng.random() < 0.6 else word() for _ in range(rng.randrange(1, 8))), "s") for i in range(40)]
    rows += [(100, None, "s"), (101, "", "s"), (102, "ab" * 300, "s"), (103, rows[0][1], "s")]
    seen, want = set(), {}
    for i, t, _ in rows:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - 99):
            s = b[p : p + 100]
            if s in seen:
                cover[p : p + 100] = b"\1" * 100
            seen.add(s)
        want[i] = bytes(x for x, c in zip(b, cover) if not c)
    got = {x.doc_id: bytes(x.kept) for x in suffixes.without_repeats(frame(spark, rows)).collect()}
    assert got == want


def test_pitman_yor(spark):
    rows = texts()
    r = pitman_yor.scored(frame(spark, rows), is_remainder("doc_id", 10, 0)).collect()
    learnt = [[*words(t), b"\n"] for i, t, _ in rows if i is None or zlib.crc32(str(i).encode()) % 10]
    count = {}
    for t in learnt:
        for w in t:
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    want = sorted(sum(np.log10((count.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(t), b"\n"]) for _, t, _ in rows)
    assert len(r) == len(rows) and sorted(x.base_score for x in r) == pytest.approx(want) and all(x.train_tokens == n and x.score < 0 for x in r)


def test_toxicity(spark):
    rng = random.Random(12)
    plain = [f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}" for _ in range(80)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 3 == 0
        rows.append((i, " ".join(rng.choice(plain) if not bad or rng.random() > 0.15 else rng.choice(["zukkerhead", "vilescum", "wretchfool"]) for _ in range(60)), "s"))
        labels.append((i, int(bad)))
    rows += [(900, None, "s"), (901, "", "s")]
    docs, known = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, known.where(~is_remainder("doc_id", 4, 2)))
    got = {x.doc_id: x.score for x in toxicity.score(docs, model).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= 0.3) == (i % 3 == 0) for i in held]) > 0.9 and all(0 <= x <= 1 for x in got.values())
    named = toxicity.fit(docs.withColumn("doc_id", F.col("doc_id").cast("string")), known.withColumn("doc_id", F.concat(F.col("doc_id").cast("string"))))
    assert named.weights
    again = toxicity.fit(docs.unionByName(docs.where("doc_id % 2 = 0")).repartition(7), known.where(~is_remainder("doc_id", 4, 2)))
    assert (again.toxic, again.ordinary, again.shared) == (model.toxic, model.ordinary, model.shared)  # copies teach once, in any order
    other = docs.select(F.col("doc_id").alias("n"), F.col("text").alias("body"), F.lit("x").alias("toxic"), F.lit("y").alias("half"))
    assert toxicity.fit(other, known.where(~is_remainder("doc_id", 4, 2)), id_col="n", text_col="body") == model
    assert not toxicity.fit(docs.limit(0), known).weights and not toxicity.score(docs.limit(0), model).collect()
    none = toxicity.fit(docs, known.where("toxic = 0"))
    assert set(x.score for x in toxicity.score(docs, none).collect()) == {0.0}


def test_toxic_ngrams_are_counted_by_executors(spark):
    rng = random.Random(13)
    plain = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(5000)]
    rows = [(i, " ".join(rng.choice(plain) if i % 2 or rng.random() > 0.02 else "zukkerhead vilescum" for _ in range(600)), "s") for i in range(300)]
    docs, known = frame(spark, rows), spark.createDataFrame([(i, 1 - i % 2) for i, _, _ in rows], "doc_id long, toxic int")
    s = toxicity.Settings()
    ws = [(1 - i % 2, toxicity.windows(t)) for i, t, _ in rows]
    seen = {y: [set(toxicity._packed(b"\n".join(w)).tolist()) for toxic, w in ws if toxic == y] for y in (0, 1)}
    want = []
    for x in set().union(*seen[1]):
        n, m = (sum(x in t for t in seen[y]) for y in (1, 0))
        p, q, both = n / 150, (m + 1) / 150, (n + m + 1) / 301
        spread = np.sqrt(both * (1 - both) + 1e-12)
        if n >= s.least_docs and p > s.contrast * q and (p - q) / (spread * np.sqrt(2 / 150)) > s.deviations and p - q > s.effect * spread:
            want.append(x)
    found = spark.createDataFrame(ws, "toxic int, windows array<binary>").repartition(5)
    assert toxicity.telling(found, s).tolist() == sorted(want) and want
    tracemalloc.start()
    toxicity.fit(docs, known)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * sum(len(t) for _, t, _ in rows) / 2  # half of the rows teach; their n-grams alone would take 16 times their text and more


def test_toxic_ngrams_do_not_follow_the_mix_of_labels(spark):
    toxic = ["zukkerhead" if i < 30 else "vilescum" if i < 42 else "plain words" for i in range(1000)]
    found = []
    for n in (1000, 8000):
        rows = [(1, [x.encode()]) for x in toxic] + [(0, [b"plain words"])] * n
        found.append(toxicity.telling(spark.createDataFrame(rows, "toxic int, windows array<binary>"), toxicity.Settings()).tolist())
    assert found[0] == found[1] == sorted(toxicity._packed(b"zukkerhead").tolist())


def test_surrogates(spark):
    t = "Mr John Smith (john.s@mail.example.com, +1 (017) 555-7713) met Mrs Anna Smith. SMITH pays 4111 1111 1111 1111 from 10.0.0.7."
    r = surrogates.with_surrogates(frame(spark, [(1, t, "s"), (2, "Mail john.s@mail.example.com or jane@mail.example.com", "s"), (3, None, "s"), (4, "", "s")])).orderBy("doc_id").collect()
    one, two = surrogates.entities(r[0].text), surrogates.entities(r[1].text)
    assert r[2].text is None and r[3].text == "" and r[0].kinds.count("family") == 3
    assert "Smith" not in r[0].text and one[2][3] == two[0][3] != two[1][3]
    card = next(n for _, _, k, n in one if k == "card")
    assert surrogates.luhn(card) and len(card) == 16
    assert len({surrogates.permuted(i, 1000, "t") for i in range(1000)}) == 1000


def test_surrogates_of_ranges_and_genders(spark):
    text = "Mr Kim Lee met Mrs Kim Park. Kim laughed. From 10.0.0.7, 127.0.0.1, 192.168.3.4, 172.20.1.1, 100.64.0.9 and 8.8.8.8."
    docs = frame(spark, [(1, text, "s"), (1, text, "s"), (2, "Kim knows Mr Kim Lee. " * 3000, "s")])
    one, same, long = [x.text for x in surrogates.with_surrogates(docs.select("*", F.lit(1).alias("row"), F.lit("k").alias("kinds"))).orderBy("doc_id").collect()]
    words = one.split()
    he, she = words[1], words[5]
    assert one == same and he != she and words[7] == she and words[2] != words[6].strip(".") and set(long.split()) == {he, "knows", "Mr", words[2] + "."}
    ends = surrogates.SPELLING["LATIN"][2]
    assert he.endswith(ends["m"]) and she.endswith(ends["f"])
    spans = [x[3] for x in surrogates.entities(text) if x[2] == "ip"]
    new = [x[3] for x in surrogates.entities(one) if x[2] == "ip"]
    assert [surrogates._range(surrogates._address(x)) for x in spans] == [surrogates._range(surrogates._address(x)) for x in new] and not set(spans) & set(new)
    assert not surrogates.with_surrogates(docs.limit(0)).collect()


def test_surrogates_are_one_to_one(spark):
    """All entities of a corpus against a brute-force reading: one surrogate each, none shared, none of the corpus, in the same form."""
    rng = random.Random(31)
    pick = lambda *xs: rng.choice(xs)
    mention = lambda: pick(f"{rng.randrange(3)}.x@m{rng.randrange(9)}.com", f"10.0.{rng.randrange(3)}.{rng.randrange(9)}", f"{rng.randrange(900, 905)}-{rng.randrange(10, 14)}-0001", f"+1 (017) 555-77{rng.randrange(10, 30)}", "4111 1111 1111 1111")
    rows = [(i, " and ".join(f"see {mention()} now" for _ in range(rng.randrange(6))), "s") for i in range(60)]
    got = {x.doc_id: x for x in surrogates.with_surrogates(frame(spark, rows)).collect()}
    stands = {}
    for i, t, _ in rows:
        old, new = (surrogates.entities(x) for x in (t, got[i].text))
        assert [x[2] for x in old] == [x[2] for x in new] == list(got[i].kinds)
        shape = lambda x: "".join("0" if c.isdigit() else c for c in x)
        for (s, e, kind, a), (u, v, _, b) in zip(old, new):
            stands.setdefault((kind, a), set()).add(b)
            assert kind in ("email", "ip") or shape(t[s:e]) == shape(got[i].text[u:v])
    assert all(len(v) == 1 for v in stands.values())
    out = [(k, *v) for (k, _), v in stands.items()]
    assert len(set(out)) == len(out) and not set(out) & set(stands)


def test_surrogates_full_shapes(spark):
    mails = [f"{a}@{b}.de" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    people = [("Mr", "Fotia Nabad"), ("Mrs", "Fotia Nabad"), ("Dr", "Fotia Kulan")]
    docs = frame(spark, [(i, f"from {m} on", "s") for i, m in enumerate(mails)] + [(1000 + i, f"{t} {n} came", "s") for i, (t, n) in enumerate(people)])
    r = {x.doc_id: x.text for x in surrogates.with_surrogates(docs).collect()}
    new = [r[i].split()[1] for i in range(len(mails))]
    assert len(set(new)) == len(mails) and not set(new) & set(mails)
    given = [r[1000 + i].split()[1] for i in range(3)]
    assert len(set(given)) == 3 and not set(given) & {"Fotia", "Nabad", "Kulan"}
    assert r[1000].split()[2] == r[1001].split()[2] != r[1002].split()[2]


def test_surrogate_forms_widen():
    for kind, norm in (("email", "x@y.de"), ("card", "4111111111111111"), ("iban", "GB82WEST12345698765432"), ("phone", "+1|0175557713"), ("ssn", "123456789"), ("ip", "10.0.0.7"), ("given", "m|john"), ("family", "n|иванов")):
        narrow, wide = (surrogates.surrogate(kind, norm, a) for a in (surrogates.WIDER - 1, surrogates.WIDER + 2))
        assert len(wide) > len(narrow)
    assert surrogates.luhn(surrogates.surrogate("card", "4111111111111111", surrogates.WIDER + 1))
    assert surrogates._iban_ok(surrogates.surrogate("iban", "GB82WEST12345698765432", surrogates.WIDER + 1))


def test_long_lines(spark):
    rng = random.Random(5)
    docs = []
    for i in range(40):
        w = [f"t{rng.randrange(60)}" for _ in range(rng.choice((20, 24, 30, 60)))]
        again = [x if rng.random() > 0.12 else f"u{rng.randrange(9)}" for x in w]
        docs.append((i, " ".join(w) + "\n" + " ".join(again), "s"))
    seen, want = [], {}
    for i, t, _ in docs:
        want[i] = []
        for k, line in enumerate(t.split("\n")):
            s = set(line.split())
            if any(len(s & o) >= 0.8 * len(s | o) - 1e-9 for o in seen):
                want[i].append(k)
            seen.append(s)
    got = {x.doc_id: list(x.removed) for x in lines.removed_lines(frame(spark, docs)).collect()}
    assert got == want and any(want.values()) and not all(want.values())


def test_pipeline_small(spark, tmp_path):
    import corpus_pipeline

    rows = texts()
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, rows[9][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 0 < len(out) < len(rows) and 9 not in {x.doc_id for x in out}
