"""Conversation structure repair: A* on the edit lattice."""

from __future__ import annotations

import heapq
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, partitions, stored, table

#: Costs of the edits; a truncated row that isn't deleted costs UNENDED more.
REROLE, DELETE, INSERT, UNENDED = 1, 2, 5, 5
#: What may come next: of the roles (s?(ua)+)?, by the role before ("" at the start).
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}
STATES, ENDS = tuple(NEXT), ("", "a")
ROLE = {"u": "user", "a": "assistant"}
#: Rows that are searched at once; longer conversations are put together from such pieces. Rows and bytes of a conversation that a task holds.
PIECE, HELD_ROWS, HELD_BYTES = 64, 4096, 1 << 23
#: ASCII white space, as SQL's TRIM takes it.
SPACE = " \t\n\x0b\x0c\r"


@lru_cache(1 << 16)
def cheapest(rows: str, start: str) -> dict[str, tuple[int, str]]:
    """The least ``(cost, audit)`` by which ``rows`` lead from the role ``start`` to each role.

    A row is a letter: x must go; s, u, a or o (any other) is its role's initial, in upper case if it is truncated. A* over (rows passed, last
    role): what is left costs at least its mandatory deletions, and each truncated row its deletion or its charge. States leave the queue by
    cost plus this bound, then by audit, so the first to reach a state is its cheapest and, of these, the least.
    """
    bound = [0] * (len(rows) + 1)
    for i in range(len(rows) - 1, -1, -1):
        bound[i] = bound[i + 1] + (DELETE if rows[i] == "x" else min(DELETE, UNENDED) if rows[i].isupper() else 0)
    queue, done, out = [(bound[0], "", 0, start)], set(), {}
    while queue:
        known, audit, i, role = heapq.heappop(queue)
        if (i, role) in done:
            continue
        done.add((i, role))
        cost = known - bound[i]
        if i == len(rows):
            out[role] = (cost, audit)
        steps = [(INSERT, "I", i, to) for to in NEXT[role] if to in ROLE]
        if i < len(rows):
            row = rows[i]
            steps.append((DELETE, "D", i + 1, role))
            if row != "x":
                charge = UNENDED if row.isupper() else 0
                steps += [(charge, "K", i + 1, to) for to in NEXT[role] if to == row.lower()]
                steps += [(REROLE + charge, "R", i + 1, to) for to in NEXT[role] if to in ROLE]
        for price, edit, j, to in steps:
            if (j, to) not in done:
                heapq.heappush(queue, (cost + price + bound[j], audit + edit, j, to))
    return out


def joined(first: dict, second: dict) -> dict:
    """Two tables ``{start: {end: (cost, audit)}}`` of pieces that follow each other as one."""
    out = {}
    for start, ways in first.items():
        best = {}
        for mid, (cost, audit) in ways.items():
            for end, (more, rest) in second[mid].items():
                if end not in best or cost + more <= best[end][0]:
                    way = (cost + more, audit + rest)
                    best[end] = min(best.get(end, way), way)
        out[start] = best
    return out


def folded(tables: list[dict]) -> dict:
    """Tables that follow each other as one, joined in pairs."""
    while len(tables) > 1:
        tables = [joined(*tables[i : i + 2]) if i + 1 < len(tables) else tables[i] for i in range(0, len(tables), 2)]
    return tables[0]


def pieced(rows: str) -> dict:
    """The table of ``rows``: pieces of PIECE rows are searched from each role and joined in pairs."""
    found = [{s: cheapest(rows[i : i + PIECE], s) for s in STATES} for i in range(0, max(len(rows), 1), PIECE)]
    return folded(found)


def best(ways: dict[str, tuple[int, str]]) -> tuple[int, str]:
    """Of the ways from the start the least one that ends well."""
    return min(ways[e] for e in ENDS if e in ways)


class Repaired:
    """The hash of a conversation's repaired rows, fed with the rows in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.role, self.hash, self.any = audit, 0, "", sha256(), False

    def _put(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.role = "a" if self.role == "u" else "u"
            self._put(ROLE[self.role], "")
            self.at += 1

    def row(self, role: str, text: str, n: int) -> None:
        """``n`` equal rows that follow each other."""
        for _ in range(n):
            self._inserts()
            edit, self.at = self.audit[self.at], self.at + 1
            if edit == "K":
                self.role = role[0]
                self._put(role, text)
            elif edit == "R":
                self.role = "a" if self.role == "u" else "u"
                self._put(ROLE[self.role], text)

    def digest(self) -> str:
        self._inserts()
        return self.hash.hexdigest()


def written(turns: DataFrame) -> DataFrame:
    """``turns`` with nulls of role and text as one space."""
    return turns.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text")})


def damaged(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, n)``: ``n`` equal rows of what is left of ``turns`` after damage by the crc32 of ``conv_id:turn`` modulo 20.

    0 drops a row (n = 0), 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it the user's. Nulls are written as one space.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind, turns = F.crc32(key) % 20, written(turns)
    said = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    n = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long")
    return turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), n.alias("n"))


def faults(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn as one, and its first fault: ``again`` (seen in an earlier turn), ``blank``, ``unended`` (truncated), ``letter``.

    Only what comes in more than one turn of a conversation is joined back, so no conversation is gathered.
    """
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    words = F.array(F.xxhash64("role", "text"), F.xxhash64(F.lit(7), F.length("role"), "text", "role"))
    rows = stored(rows.withColumn("same", words), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("held"), "turn")
    seen = rows.where("n > 0").groupBy(F.col("conv_id").alias("c"), F.col("same").alias("s")).agg(F.min(place).alias("first"), F.count("*").alias("k")).where("k > 1").drop("k")
    rows = rows.join(seen, rows["conv_id"].eqNullSafe(seen["c"]) & (rows["same"] == seen["s"]), "left")
    again = F.col("first").isNotNull() & ~place.eqNullSafe(F.col("first"))
    end = F.expr(f"right(rtrim('{SPACE.encode('unicode_escape').decode()}', text), 1)")
    return rows.select("conv_id", "turn", "role", "text", "n", (~F.col("text").rlike(WORD)).alias("blank"), again.alias("again"), (~end.isin(".", "!", "?")).alias("unended"))


COUNTS = ("blank", "duplicate", "truncated", "illegal")
LEGAL = ("su", "ua", "au")


def _letters(role: str, n: int, blank: bool, again: bool, unended: bool) -> str:
    """``n`` equal rows, of which all but the first repeat it."""
    own = role[0] if role[:1] and role[0] in "sua" else "o"
    return ("x" if blank or again else own.upper() if unended else own) + "x" * (n - 1)


class Tally:
    """What is counted of rows in order; runs of rows that follow each other can be added."""

    FIELDS = (*COUNTS, "turns", "low", "high", "first", "last")

    def __init__(self, values=(0, 0, 0, 0, 0, None, None, None, None)):
        for name, x in zip(self.FIELDS, values):
            setattr(self, name, x)

    def row(self, turn: int | None, role: str, n: int, blank: bool, again: bool, unended: bool) -> None:
        """``n`` equal rows, of which all but the first repeat it."""
        one = [0, n - (not again), int(unended and not again), n - 1]
        self.add(Tally((*([n, 0, 0, n - 1] if blank else one), int(turn is not None), turn, turn, role[:1], role[:1])))

    def add(self, x: Tally) -> None:
        """Add what comes after."""
        if x.first is None:
            return
        for c in (*COUNTS, "turns"):
            setattr(self, c, getattr(self, c) + getattr(x, c))
        self.illegal += self.last is not None and self.last + x.first not in LEGAL
        self.turns -= x.low is not None and x.low == self.high
        self.first, self.last = x.first if self.first is None else self.first, x.last
        self.low, self.high = x.low if self.low is None else self.low, self.high if x.high is None else x.high

    def values(self) -> list[int]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [gaps, *(getattr(self, c) for c in COUNTS)]

    def state(self) -> tuple:
        return tuple(getattr(self, x) for x in self.FIELDS)


class _Turns:
    """What a task has of one conversation."""

    def __init__(self, conv):
        self.conv, self.tally, self.letters, self.held, self.size = conv, Tally(), [], [], 0

    def row(self, turn, role, text, n, blank, again, unended) -> None:
        if not n:
            return
        self.tally.row(turn, role, n, blank, again, unended)
        self.letters.append(_letters(role, n, blank, again, unended))
        if self.held is not None:
            self.held.append((role, text, n))
            self.size += len(text)
            if len(self.held) > HELD_ROWS or self.size > HELD_BYTES:
                self.held = None

    def result(self) -> tuple:
        cost, audit = best(pieced("".join(self.letters))[""])
        out = Repaired(audit)
        for row in self.held:
            out.row(*row)
        return (*self.tally.values(), cost, audit, out.digest())


#: What a task says of a conversation: its result, or, where other tasks may have more of it, a table of ways.
PIECES = pa.schema(
    [(x, pa.int64()) for x in ("gaps", *COUNTS, "cost")]
    + [("audit", pa.string()), ("repaired_sha256", pa.string()), ("part", pa.int64())]
    + [(f"t_{x}", pa.string() if x in ("first", "last") else pa.int64()) for x in Tally.FIELDS]
    + [("ways", pa.list_(pa.struct([("start", pa.string()), ("end", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])))]
)
KINDS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, part long, t_blank long, t_duplicate long, t_truncated long, t_illegal long, t_turns long, t_low long, t_high long, t_first string, t_last string, ways array<struct<start: string, end: string, cost: long, audit: string>>"


def _searched(batches):
    """Conversations that lie in this task alone are finished; of the first, the last and long ones all ways are handed on."""
    part, now, first, kind, out = TaskContext.get().partitionId(), None, True, None, []

    def closed(x: _Turns, last: bool) -> None:
        if first or last or x.held is None:
            ways = [{"start": s, "end": e, "cost": c, "audit": a} for s, found in pieced("".join(x.letters)).items() for e, (c, a) in found.items()]
            out.append((x.conv, *[None] * 8, part, *x.tally.state(), ways))
        else:
            out.append((x.conv, *x.result(), None, *[None] * len(Tally.FIELDS), None))

    def batch():
        columns = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, f.type) for c, f in zip(columns[1:], PIECES))], ["conv_id", *PIECES.names])

    for b in batches:
        kind = b.column(0).type
        for conv, *row in zip(*(c.to_pylist() for c in b.columns)):
            if now is None or conv != now.conv:
                if now is not None:
                    closed(now, False)
                    first = False
                now = _Turns(conv)
            now.row(*row)
        if out:
            yield batch()
    if now is not None:
        closed(now, True)
        yield batch()


def _decided(pieces: pa.Table) -> pa.Table:
    """The least way through the pieces of one conversation, a row for each task that has a part of it."""
    rows = sorted(pieces.to_pylist(), key=lambda x: x["part"])
    tally, tables = Tally(), []
    for x in rows:
        tally.add(Tally([x[f"t_{name}"] for name in Tally.FIELDS]))
        found = {s: {} for s in STATES}
        for w in x["ways"]:
            found[w["start"]][w["end"]] = (w["cost"], w["audit"])
        tables.append(found)
    cost, audit = best(folded(tables)[""])
    values = [*tally.values(), cost, audit]
    return pa.Table.from_arrays([pieces.column("conv_id").slice(0, 1), *(pa.array([v], f.type) for v, f in zip(values, PIECES))], ["conv_id", *PIECES.names[:7]])


def _hashed(batches):
    """The hash of each conversation's repaired rows, which come in order after a row with the audit."""
    conv, now, kind = None, None, None

    def batch(x):
        return pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([x.digest()])], ["c", "repaired_sha256"])

    for b in batches:
        kind = b.column(0).type
        for own, audit, role, text, n in zip(*(c.to_pylist() for c in b.columns)):
            if audit is not None:
                if now is not None:
                    yield batch(now)
                conv, now = own, Repaired(audit)
            else:
                now.row(role, text, n)
    if now is not None:
        yield batch(now)


def repaired(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage: bool = False) -> DataFrame:
    """One row for each conversation: ``gaps``, counts of faults, the cheapest ``cost`` and ``audit`` of edits, and the hash of what they give.

    Rows are taken by turn, nulls first, and those of one turn by role and text. Nulls of role and text are one space. Repeated rows are
    duplicates; a conversation without rows has zeros, an empty audit and the hash of nothing; a null id is a conversation too; an empty table
    gives no rows; other columns are ignored. Texts are taken whole, and may be of any length.

    Rows are dealt by ranges of (conversation, turn, role, text), so a long conversation is spread. A task searches what it has of it from every
    role that may stand before, and only these tables (at most 16 costs and audits each) are put together. A conversation that lies in one task
    alone is finished there. SHA-256 takes bytes in order, so the rows of the others (at most two a task, and those of over HELD_ROWS rows or
    HELD_BYTES) stream through one task each, which keeps the hash and the audit only.
    """
    spark = turns.sparkSession
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    kind = rows.schema["conv_id"].dataType
    of = lambda names: T.StructType([T.StructField("conv_id", kind), *(T._parse_datatype_string(KINDS)[x] for x in names)])
    rows = faults(damaged(rows) if damage else written(rows).withColumn("n", F.lit(1).cast("long")))
    order = ["conv_id", "turn", "role", "text"]
    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    found = stored(dealt.select("conv_id", F.col("turn").cast("long"), "role", "text", "n", "blank", "again", "unended").mapInArrow(_searched, of(PIECES.names)), "pieces")
    result = ["conv_id", *PIECES.names[:8]]
    closed = found.where("part IS NULL").select(*result)
    decided = stored(found.where("part IS NOT NULL").groupBy("conv_id").applyInArrow(_decided, of(PIECES.names[:7])), "decided")
    wanted = decided.select(F.col("conv_id").alias("c"))
    null = lambda c: F.lit(None).cast("string").alias(c)
    rest = rows.where("n > 0").join(wanted, rows["conv_id"].eqNullSafe(wanted["c"]), "left_semi").select("conv_id", null("audit"), "role", "text", "n", F.lit(1).alias("k"), "turn")
    lead = decided.select("conv_id", "audit", null("role"), null("text"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("k"), F.lit(None).cast(rest.schema["turn"].dataType).alias("turn"))
    stream = lead.unionByName(rest).repartition("conv_id").sortWithinPartitions("conv_id", "k", "turn", "role", "text")
    digest = T.StructType([T.StructField("c", kind), T.StructField("repaired_sha256", T.StringType())])
    hashed = stream.select("conv_id", "audit", "role", "text", "n").mapInArrow(_hashed, digest)
    return closed.unionByName(decided.join(hashed, decided["conv_id"].eqNullSafe(hashed["c"])).select(*result))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"), damage=True)


#: The least way to each role, row by row, in place of A*. A role that can't be reached costs 10^9.
OP11_SQL = r"""
WITH RECURSIVE kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ord(ch)::BIGINT),
      lambda crc, b: list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), xor(crc, b)), 4294967295), 4294967295) % 20 AS kind
  FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM kinds, LATERAL (SELECT unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)))),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM d),
f AS (
  SELECT *, left(role, 1) AS r, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd'
    WHEN right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal
  FROM o),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (illegal) AS illegal, count(*) AS n
  FROM f GROUP BY conv_id),
ways AS (
  SELECT conv_id, 0::BIGINT AS pos, {c: 0::BIGINT, a: ''} AS w, {c: 1000000000::BIGINT, a: ''} AS s, {c: 5::BIGINT, a: 'I'} AS u, {c: 10::BIGINT, a: 'II'} AS a FROM counts
  UNION ALL
  SELECT conv_id, pos, w, s, u2, list_min([a1, {c: u2.c + 5, a: u2.a || 'I'}])
  FROM (
    SELECT conv_id, pos, w, s, a1, list_min([u1, {c: w.c + 5, a: w.a || 'I'}, {c: s.c + 5, a: s.a || 'I'}, {c: a1.c + 5, a: a1.a || 'I'}]) AS u2
    FROM (
      SELECT conv_id, pos, {c: w.c + 2, a: w.a || 'D'} AS w,
        list_min([{c: s.c + 2, a: s.a || 'D'}, {c: w.c + ks, a: w.a || 'K'}]) AS s,
        list_min([{c: u.c + 2, a: u.a || 'D'}, {c: w.c + ku, a: w.a || 'K'}, {c: s.c + ku, a: s.a || 'K'}, {c: a.c + ku, a: a.a || 'K'},
          {c: w.c + re, a: w.a || 'R'}, {c: s.c + re, a: s.a || 'R'}, {c: a.c + re, a: a.a || 'R'}]) AS u1,
        list_min([{c: a.c + 2, a: a.a || 'D'}, {c: u.c + ka, a: u.a || 'K'}, {c: u.c + re, a: u.a || 'R'}]) AS a1
      FROM (
        SELECT ways.*  REPLACE (ways.pos + 1 AS pos), keep + CASE r WHEN 's' THEN 0 ELSE 1000000000 END AS ks, keep + CASE r WHEN 'u' THEN 0 ELSE 1000000000 END AS ku,
          keep + CASE r WHEN 'a' THEN 0 ELSE 1000000000 END AS ka, keep + 1 AS re
        FROM ways JOIN (SELECT *, CASE fault WHEN '' THEN 0 WHEN 't' THEN 5 ELSE 1000000000 END AS keep FROM f) AS g ON g.conv_id IS NOT DISTINCT FROM ways.conv_id AND g.pos = ways.pos + 1) AS x) AS y) AS z),
best AS (
  SELECT counts.*, list_min([w, a]).c AS cost, list_min([w, a]).a AS audit
  FROM ways JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ways.conv_id AND counts.n = ways.pos),
edits AS (SELECT conv_id, k, substr(audit, k, 1) AS e FROM best, LATERAL (SELECT unnest(range(1, length(audit) + 1)) AS k)),
ran AS (SELECT *, count(*) FILTER (e <> 'I') OVER h AS pos, count(*) FILTER (e <> 'D') OVER h AS placed FROM edits WINDOW h AS (PARTITION BY conv_id ORDER BY k)),
kept AS (SELECT ran.*, f.role, f.text, bool_or(e = 'K' AND placed = 1 AND f.r = 's') OVER (PARTITION BY ran.conv_id) AS led FROM ran JOIN f ON f.conv_id IS NOT DISTINCT FROM ran.conv_id AND f.pos = greatest(ran.pos, 1)),
said AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (placed - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS whole
  FROM kept WHERE e <> 'D' GROUP BY conv_id)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS i LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN said ON said.conv_id IS NOT DISTINCT FROM i.conv_id
"""
