"""Line dedup by an exact set-similarity join, in DataFrame functions alone."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, freed, settled, stored, table

SIMILARITY = 0.8
#: Token counts are kept for so many buckets of token hashes: a table of this size however many tokens there are.
BUCKETS = 1 << 18
#: Lines with prefix tokens that more lines than this have meet the first line of the MET - 1 rarest of these, and of the PAIRED first pairs of neighbours among them, before they meet the others.
HEAVY = 16
MET = 3
PAIRED = 2
#: Bits of the filters that spare rows which no join wants.
FILTER = 1 << 20
#: From so many tokens on, the parities of 64 bits are held apart for two halves of the tokens, 128 bits in all.
LONG = 24


def _least(s: float) -> int:
    """Below so many tokens only lines with the same tokens are similar enough: n and n + 1 tokens have n / (n + 1)."""
    return math.ceil(s / (1 - s) - 1e-9) if s < 1 else 1 << 30


def _spaced(text: str) -> Column:
    """Lower case, with a space for each white space but line ends; texts that have none of these aren't looked through for them."""
    odd = [F.contains(F.col(text), F.lit(x)) for x in "\t\x0b\x0c\r"]
    return F.lower(F.when(odd[0] | odd[1] | odd[2] | odd[3], F.translate(text, "\t\x0b\x0c\r", "    ")).otherwise(F.col(text)))


def _table(values: list[int]) -> Column:
    return F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), "array<int>")


def _rarity(docs: DataFrame) -> Column:
    """A literal array: for each bucket, in thirds, log2 of how many tokens of all lines fall in it (127 at most, of which the JVM has one object each)."""
    words = docs.select(F.explode(F.split(F.replace(_spaced("text"), F.lit("\n"), F.lit(" ")), " ")).alias("w")).where("w <> ''")
    rank = [0] * BUCKETS
    for b, n in words.groupBy(F.xxhash64("w").bitwiseAND(BUCKETS - 1).alias("b")).count().collect():
        rank[b] = min(127, int(3 * math.log2(n)))
    return _table(rank)


def _hashes(line: str) -> Column:
    """The distinct tokens of a line, as hashes of 64 bits."""
    return F.array_distinct(F.array_remove(F.transform(F.split(line, " "), lambda x: F.xxhash64(x)), F.xxhash64(F.lit(""))))


def _ordered(h: str, rank: Column) -> Column:
    """Hashes in order of rarity, as numbers: the rank of their bucket, then 56 bits of the hash."""
    return F.sort_array(F.transform(h, lambda x: F.shiftleft(F.coalesce(F.get(rank, x.bitwiseAND(BUCKETS - 1).cast("int")), F.lit(0)).cast("long"), 56).bitwiseOR(F.shiftrightunsigned(x, 8))))


def _parity(h: str) -> Column:
    """64 bits, each telling whether an odd number of tokens falls on it: lines differ by at least as many tokens as bits."""
    return F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))))


def _half(h: str) -> Column:
    """The parities of one half of the tokens; those of the other are what is left of ``_parity``. Zero below LONG tokens."""
    own = lambda x: 1 - F.shiftrightunsigned(x, 6).bitwiseAND(1)
    bits = F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", own(x), x.bitwiseAND(63).cast("int"))))
    return F.when(F.size(h) >= LONG, bits).otherwise(F.lit(0).cast("long"))


def _longest_prefix(n: Column, s: float) -> Column:
    """So many of its rarest tokens that a similar line, if it has fewer, has one of them among its ``_shortest_prefix``."""
    return n - F.ceil(n * s - 1e-9).cast("int") + 1


def _shortest_prefix(n: Column, s: float) -> Column:
    """The same for the line that has fewer tokens, or as many."""
    return n - F.ceil(n * (2 * s / (1 + s)) - 1e-9).cast("int") + 1


def _may_hold(hashes: DataFrame, x: Column) -> Column:
    return _filter(hashes)(x)


def _filter(hashes: DataFrame) -> Callable[[Column], Column]:
    """Whether a number may be among ``hashes``: a filter of FILTER bits as a literal array. It spares work; a join decides."""
    i = F.col("x").bitwiseAND(FILTER - 1)
    found = hashes.groupBy(F.shiftright(i, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(x & 63 AS INT))")).alias("v")).collect()
    bits = [0] * (FILTER // 64)
    for w, v in found:
        bits[w] = v
    table = F.from_json(F.lit(json.dumps(bits)), "array<bigint>")

    def holds(x: Column) -> Column:
        word = F.get(table, F.shiftright(x.bitwiseAND(FILTER - 1), 6).cast("int"))
        return word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))) != 0

    return holds


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("row"), "text")


def tokenised(docs: DataFrame, similarity: float, rank: Column) -> DataFrame:
    """``(doc_id, text_hash, row, line_no, k, n, parity, half, p)``: of each line its class (lines with equal tokens agree in k, n and parity), its number of tokens and its rarest tokens."""
    place = ["doc_id", "text_hash", "row", "line_no"]
    rows = _numbered(docs).select(*place[:3], F.posexplode(F.split(_spaced("text"), "\n")).alias("line_no", "line"))
    rows = rows.select(*place, _hashes("line").alias("h"))
    rows = rows.select(*place, F.size("h").alias("n"), _parity("h").alias("parity"), _half("h").alias("half"), _ordered("h", rank).alias("t"))
    return rows.select(*place, F.when(F.col("n") > 0, F.xxhash64("t")).alias("k"), "n", "parity", "half", F.when(F.col("n") >= _least(similarity), F.slice("t", F.lit(1), _longest_prefix(F.col("n"), similarity))).alias("p"))


def similar_classes(docs: DataFrame, classes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(c)``: classes whose first line has an earlier line, of another class, that is similar. ``c`` grows with the first line.

    Of two similar lines the one with fewer tokens has one of its shorter prefix in the
    longer prefix of the other. Pairs that meet so, and whose lengths, positions and
    parities allow the similarity, are candidates, verified on all their tokens. A class
    needs one earlier match only: the candidate that differs in the fewest bits is verified
    first, the others if that one fails. Groups of similar lines would meet in all
    pairs: of its tokens that more than HEAVY classes have, each class first meets the earliest class
    of the MET - 1 rarest that is about as long, and of PAIRED pairs of neighbours among them, as the earliest line of one word may be no member of the group. Only classes without a match there meet the others, by all their tokens.
    """
    s = similarity
    numbered = _numbered(docs)
    some = classes.where("p IS NOT NULL").withColumn("c", F.coalesce("c", F.lit(0).cast("long")))

    # counted by token: buckets of a fixed number would all be full in a large table
    counts = some.select(F.explode("p").alias("token")).groupBy("token").count().where(F.col("count") > HEAVY)
    counts = counts.select(F.col("token").alias("x"))
    n, m = F.col("l.n"), F.col("r.n")
    need = F.ceil((n + m) * (s / (1 + s)) - 1e-9)
    half = F.when(F.least(n, m) >= LONG, F.col("l.half").bitwiseXOR(F.col("r.half"))).otherwise(F.lit(0).cast("long"))
    differ = F.bit_count(half) + F.bit_count(F.col("l.parity").bitwiseXOR(F.col("r.parity")).bitwiseXOR(half))
    # l is the later class; ``late`` is the class, or -1 if it needs no earlier one any more
    near = (F.col("l.token") == F.col("r.token")) & (F.col("l.late") > F.col("r.c")) & (F.col("l.c") > F.col("r.late")) & (F.least(n, m) >= F.ceil(F.greatest(n, m) * s - 1e-9)) & (differ <= n + m - 2 * need)
    # of the two lines that with fewer tokens (of equals the earlier one) has the token in its shorter prefix
    fits = near & (F.least(n - F.col("l.pos"), m - F.col("r.pos")) + F.least("l.pos", "r.pos") >= need)
    fits &= F.when(n < m, F.col("l.pos")).otherwise(F.col("r.pos")) < _shortest_prefix(F.least(n, m), s)

    def met(later: DataFrame, earlier: DataFrame, fits: Column) -> DataFrame:
        """``(a, b, differ)``, the later class first, of the candidates; each side is dealt out by token once."""
        pairs = later.alias("l").join(earlier.alias("r"), fits)
        return pairs.select(F.col("l.c").alias("a"), F.col("r.c").alias("b"), differ.cast("tinyint").alias("differ"))

    def verified(pairs: DataFrame) -> DataFrame:
        """The ``a`` of the pairs whose token sets are similar."""
        best = pairs.groupBy("a").agg(F.min(F.struct("differ", "b")).alias("x"), F.max("b").alias("high"), F.min("b").alias("low"))
        best = stored(best.select("a", F.col("x.b").alias("b"), (F.col("low") < F.col("high")).alias("more")), "best")
        freed(docs.sparkSession)
        wanted = best.select(F.explode(F.array("a", "b")).alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
        wanted = stored(wanted.join(classes.select("c", "first.row", "first.line_no"), "c"), "wanted")
        freed(docs.sparkSession)
        found = numbered.where(_may_hold(wanted.select(F.xxhash64("row").alias("x")), F.xxhash64("row")))
        lines = found.select("row", F.posexplode(F.split(_spaced("text"), "\n")).alias("line_no", "line"))
        lines = lines.where(_may_hold(wanted.select(F.xxhash64("row", "line_no").alias("x")), F.xxhash64("row", "line_no")))
        sets = stored(lines.join(wanted, ["row", "line_no"]).select("c", _hashes("line").alias("t")), "sets")
        dropped(wanted)
        freed(docs.sparkSession)

        def alike(pairs: DataFrame) -> DataFrame:
            both = pairs.join(sets.select(F.col("c").alias("a"), F.col("t").alias("ta")), "a").join(sets.select(F.col("c").alias("b"), F.col("t").alias("tb")), "b")
            common = F.size(F.array_intersect("ta", "tb"))
            return stored(both.where(common >= F.ceil((F.size("ta") + F.size("tb") - common) * s - 1e-9)).select(F.col("a").alias("c")).distinct(), "matched")

        first = alike(best.select("a", "b"))
        freed(docs.sparkSession)
        open_ = best.where("more").join(first, F.col("a") == F.col("c"), "left_anti").select("a", F.col("b").alias("tried"))
        rest = stored(pairs.join(open_, "a").where("b <> tried").select("a", "b").distinct(), "rest")
        dropped(pairs, best)
        freed(docs.sparkSession)
        every, rest = rest, alike(rest)
        dropped(every, sets)
        freed(docs.sparkSession)
        return first.unionByName(rest)

    heavy = _filter(counts)
    often = some.select("c", "n", "parity", "half", F.slice(F.filter("p", heavy), 1, MET).alias("t")).where(F.size("t") > 0)
    often = often.select("c", F.col("c").alias("late"), "n", "parity", "half", *(F.get("t", F.lit(i)).alias(f"t{i}") for i in range(MET)))
    size = F.floor(10 * F.log("n"))  # the first line of a word is more often similar where it is as long
    keys = [*(F.when(F.col(f"t{i}").isNotNull(), F.xxhash64(f"t{i}", size)) for i in range(MET - 1)), *(F.when(F.col(f"t{i + 1}").isNotNull(), F.xxhash64(f"t{i}", f"t{i + 1}")) for i in range(PAIRED))]
    often = stored(often.select("c", "late", "n", "parity", "half", F.explode(F.array(*keys)).alias("token")).where("token IS NOT NULL"), "often")
    freed(docs.sparkSession)
    first = often.groupBy("token").agg(F.min("c").alias("c"), F.max("c").alias("last")).where("c < last").select("token", "c")
    first = stored(first.join(some.select("c", F.col("c").alias("late"), "n", "parity", "half"), "c"), "heads")
    heads = verified(stored(met(often, first, near), "pairs"))
    dropped(often, first)
    freed(docs.sparkSession)
    # what has a match is done: of a pair the later class is open
    late = F.when(F.col("done").isNull(), F.col("c")).otherwise(F.lit(-1).cast("long"))
    rows = some.join(heads.select("c", F.lit(True).alias("done")), "c", "left")
    rows = rows.select("c", late.alias("late"), "n", "parity", "half", F.posexplode("p").alias("pos", "token"))  # no null: both sides of the join are dealt out as one
    rest = stored(met(rows, rows, fits), "pairs")
    freed(docs.sparkSession)
    return heads.unionByName(verified(rest)).distinct()


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, text_hash, copy, n_lines, removed)``: for each row the numbers, from 0, of the lines that go.

    A line goes if an earlier line, in order of document id (null first), hash of the
    text, repeated row and line number, has a token set of Jaccard similarity
    ``similarity`` or more; earlier lines count whether they stay or go. Tokens are the
    lower-cased words of a line, each once, told apart by hashes of 64 bits; classes of lines by 128 bits and their length.
    Lines without tokens stay. A null text has no line (n_lines is 0, removed empty), an empty one has one. ``copy`` numbers
    rows that agree in id and text, from 1; ids may be of any type that has an order. Texts may be of any length: after the
    first split, rows are lines. Other columns, of whatever name, are ignored; an empty table gives none.
    """
    docs = settled(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    rank = _rarity(docs)
    lines = stored(tokenised(docs, similarity, rank), "lines")
    at = F.struct("doc_id", "text_hash", "row", "line_no")
    classes = lines.where("n > 0").groupBy("k", "n", "parity").agg(F.min(F.struct(at.alias("at"), "half", "p")).alias("x"), F.count("*").alias("copies"))
    classes = classes.select("k", "n", "parity", F.col("x.at").alias("first"), "x.half", "x.p", "copies").orderBy("first").withColumn("c", F.monotonically_increasing_id())
    classes = stored(classes, "classes")
    whole, lines = lines, stored(lines.drop("p", "half"), "lines")
    dropped(whole)
    freed(docs.sparkSession)
    gone = similar_classes(docs, classes, similarity).withColumn("gone", F.lit(True))
    # lines of classes that lose none: seen once, without a match
    loss = classes.select("c", "k", "n", "parity", "first", "copies").join(gone, "c", "left").where("copies > 1 OR gone").select("k", "n", "parity", "first", F.coalesce("gone", F.lit(False)).alias("gone"))
    loss = stored(loss, "loss")
    dropped(classes)
    freed(docs.sparkSession)
    out = lines.where("n > 0").join(loss, ["k", "n", "parity"]).where((at > F.col("first")) | F.col("gone")).groupBy("doc_id", "text_hash", "row").agg(F.sort_array(F.collect_list("line_no")).alias("removed"))
    every = lines.groupBy("doc_id", "text_hash", "row").agg(F.count("*").alias("n_lines"))
    every = every.unionByName(_numbered(docs).where("text IS NULL").select("doc_id", "text_hash", "row", F.lit(0).cast("long").alias("n_lines")))
    found = every.alias("e").join(out.alias("o"), F.expr("e.row = o.row AND e.text_hash = o.text_hash AND e.doc_id <=> o.doc_id"), "left")
    found = found.select("e.doc_id", "e.text_hash", "e.row", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
    copy = F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy("row"))
    return found.select("doc_id", "text_hash", copy.alias("copy"), "n_lines", "removed")


def without_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the text of each row rebuilt from the lines that stay; all other columns, of whatever names, as they were. Null texts stay null."""
    lost = removed_lines(docs, id_col, text_col, similarity).where(F.size("removed") > 0)
    lost = stored(lost.groupBy("doc_id", "text_hash").agg(F.map_from_entries(F.collect_list(F.struct("copy", "removed"))).alias("lost")), "lost")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("own"), docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("hash"), docs[text_col].alias("body"))
    rows = rows.join(lost, rows["id"].eqNullSafe(lost["doc_id"]) & (F.col("hash") == F.col("text_hash")), "left")
    alone = rows.where("lost IS NULL").select("own", "body")
    some = rows.where("lost IS NOT NULL").withColumn("at", F.row_number().over(Window.partitionBy("id", "hash").orderBy(F.lit(0))))
    some = some.withColumn("gone", F.coalesce(F.get(F.array(F.col("lost")[F.col("at")]), F.lit(0)), F.array().cast("array<int>")))
    kept = F.array_join(F.transform(F.filter(F.transform(F.split("body", "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda y: ~F.array_contains(F.col("gone"), y["i"])), lambda y: y["x"]), "\n")
    both = alone.unionByName(some.select("own", kept.alias("body")))
    return both.select(*(F.col("body").alias(c) if c == text_col else F.col("own")[c].alias(c) for c in docs.columns))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = removed_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.concat_ws(",", F.col("removed").cast("array<string>")).alias("removed"))


OP3_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL),
toks AS (
  SELECT doc_id, line_no, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(line), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))) AS t FROM lines),
classes AS (
  SELECT t, len(t) AS n, min(doc_id * 10000000 + line_no) AS first, row_number() OVER () AS c FROM toks WHERE len(t) > 0 GROUP BY t),
words AS (SELECT c, n, first, unnest(t) AS w FROM classes),
rarity AS (SELECT w, count(*) AS f FROM words GROUP BY w),
ranked AS (SELECT c, n, first, w, row_number() OVER (PARTITION BY c ORDER BY f, w) AS pos FROM words JOIN rarity USING (w)),
prefix AS (SELECT * FROM ranked WHERE pos <= n - ceil(n * 0.8 - 1e-9) + 1),
pairs AS (
  SELECT DISTINCT a.c AS a, b.c AS b FROM prefix a JOIN prefix b ON a.w = b.w AND b.first < a.first
  WHERE least(a.n, b.n) >= ceil(greatest(a.n, b.n) * 0.8 - 1e-9)),
matched AS (
  SELECT DISTINCT a.c FROM pairs JOIN classes a ON a.c = pairs.a JOIN classes b ON b.c = pairs.b
  WHERE len(list_intersect(a.t, b.t)) >= ceil((a.n + b.n - len(list_intersect(a.t, b.t))) * 0.8 - 1e-9)),
gone AS (
  SELECT doc_id, line_no FROM toks JOIN classes USING (t)
  WHERE doc_id * 10000000 + line_no > classes.first OR classes.c IN (SELECT c FROM matched))
SELECT doc_id, 0 AS n_lines, 0 AS n_removed, '' AS removed FROM documents WHERE text IS NULL
UNION ALL SELECT l.doc_id, count(*) AS n_lines, count(g.line_no) AS n_removed,
       coalesce(string_agg(CAST(g.line_no AS VARCHAR), ',' ORDER BY g.line_no), '') AS removed
FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line_no = l.line_no GROUP BY l.doc_id
"""
