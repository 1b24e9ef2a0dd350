import random
import re
import zlib
from hashlib import sha256

import pytest

from vgspark.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string, n long, audit string, c long, k long"


def least(rows):
    """The least (cost, audit) and the rows it gives, by trying every way, cheapest first."""
    end, todo = len(rows), {(0, ""): [(0, "", ())]}
    best = {}
    order = [(0, "", 0, "")]
    found = {}
    while order:
        order.sort()
        cost, audit, i, roles = order.pop(0)
        if found.get((i, roles[-2:], "s" in roles), (cost, audit)) < (cost, audit):
            continue
        found[(i, roles[-2:], "s" in roles)] = (cost, audit)
        if i == end and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit
        if len(roles) < end + 4:
            for r in "ua":
                order.append((cost + 5, audit + "I", i, roles + r))
        if i < end:
            role, fault = rows[i]
            order.append((cost + 2, audit + "D", i + 1, roles))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault else 0
                order.append((cost + more, audit + "K", i + 1, roles + (role[:1] or "?")))
                for r in "ua":
                    order.append((cost + 1 + more, audit + "R", i + 1, roles + r))
        order = [x for x in order if re.fullmatch("(s?(ua)*u?)?", x[3])]


def brute(table, damage=True):
    out = {}
    for c in {x[0] for x in table}:
        rows = []
        for _, t, role, text in sorted((x for x in table if x[0] == c), key=repr):
            role, text = " " if role is None else role, " " if text is None else text
            k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 if damage else 9
            if k:
                rows += [(t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)] * (2 if k == 3 else 1)
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, faults = set(), []
        for _, role, text in rows:
            s = text.encode().strip().decode()
            faults.append("blank" if not s else "duplicate" if (role, text) in seen else "truncated" if s[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, *_ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit = least([(r, f) for (_, r, _), f in zip(rows, faults)])
        said, left = [], iter(rows)
        for e in audit:
            _, role, text = next(left) if e != "I" else (None, None, "")
            if e != "D":
                if e != "K":
                    role = "assistant" if said and said[-1][0] == "u" else "user"
                said.append(f"{role}:{text}")
        out[c] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha256("\n".join(said).encode()).hexdigest())
    return out


def rows_of(seed=3):
    rng = random.Random(seed)
    rows = []
    for c in range(60):
        t = rng.randrange(-2, 3)
        for _ in range(rng.randrange(1, 9)):
            t += rng.choice([0, 1, 1, 1, 2, 5])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User", None])
            rows.append((c, rng.choice([t, t, t, t, None]), role, rng.choice(["Yes.", "No!\n ", "and so", "Well?", "", "\t ", None, "Ü.", "…", "Yes."])))
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (70, 1, "user", "x" * 30_000 + "."), (70, 2, "assistant", "Fine.")]
    return rows + [rows[5], rows[5], rows[9]]


def frame(spark, rows):
    return spark.createDataFrame([(*x, 7, "a", 8, 9) for x in rows], SCHEMA)


def result(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


@pytest.mark.parametrize("damage", [True, False])
def test_repair_equals_every_way_tried(spark, damage):
    rows = rows_of()
    assert result(cv.repaired(frame(spark, rows), damage=damage)) == brute(rows, damage)
    assert not result(cv.repaired(frame(spark, rows).limit(0)))


def test_pieces_give_what_the_whole_gives():
    rng = random.Random(8)
    for _ in range(150):
        rows = "".join(rng.choice("xsuaoSUAO") for _ in range(rng.randrange(0, 40)))
        whole = cv.cheapest(rows, "")
        cut = sorted(rng.sample(range(len(rows) + 1), min(len(rows), 3)))
        parts = [rows[i:j] for i, j in zip([0, *cut], [*cut, len(rows)])]
        assert cv.folded([{s: cv.cheapest(p, s) for s in cv.STATES} for p in parts])[""] == whole


def test_long_conversation_is_spread(spark, monkeypatch):
    """Most rows are one conversation's, in pieces, spread over tasks, streamed to its hash."""
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"Row {rng.randrange(900)}{rng.choice('.!? ')}") for t in range(700)]
    rows += [(2, t, "user", "Same.") for t in range(300)] + [(c, 0, "user", "Hi.") for c in range(3, 40)]
    assert result(cv.repaired(frame(spark, rows), damage=True)) == brute_long(rows)


def brute_long(rows):
    """As brute, with the least ways of long conversations row by row."""
    global least
    kept = least

    def stepwise(rows):
        ways = {"": (0, ""), "u": (5, "I"), "a": (10, "II")}
        for role, fault in rows:
            new, r, must, more = {}, role[:1], fault in ("blank", "duplicate"), 5 if fault == "truncated" else 0

            def put(s, way):
                new[s] = min(new.get(s, way), way)

            for s, (c, a) in ways.items():
                put(s, (c + 2, a + "D"))
                for to in {"": "su", "s": "u", "u": "a", "a": "u"}[s] if not must else "":
                    if to == r:
                        put(to, (c + more, a + "K"))
                    if to != "s":
                        put(to, (c + 1 + more, a + "R"))
            for s, to in [("", "u"), ("s", "u"), ("a", "u"), ("u", "a")]:
                if s in new:
                    put(to, (new[s][0] + 5, new[s][1] + "I"))
            ways = new
        return min(ways[s] for s in ("", "a") if s in ways)

    least = stepwise
    try:
        return brute(rows)
    finally:
        least = kept
