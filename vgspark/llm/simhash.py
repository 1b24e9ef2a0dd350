"""SimHash near-duplicates through deletion-variant signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, components, dropped, freed, in_bitmap, settled, stored, table, words

SHINGLE = 3
#: Near copies: words a shingle, and the Jaccard similarity of the sets of shingles.
WORDS, SIMILARITY = 5, 0.8
#: A task's tally of shingles keeps so many distinct ones; beyond that those seen once in it are let go. FREQUENT of those that OFTEN documents hold come last in the order. Any order is exact.
KEPT, OFTEN, FREQUENT = 1_000_000, 64, 1 << 18


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of the word shingles of ``text``; no words give zero."""
    found = words(text)
    n = len(found)
    if not n:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    k = min(shingle, n)
    total = np.zeros(64, np.int64)
    for at in range(0, n - k + 1, 1 << 16):
        s, e = starts[at : min(at + (1 << 16), n - k + 1)].tolist(), ends[at + k - 1 : at + k - 1 + (1 << 16)].tolist()
        h = np.fromiter((digest(joined[i:j], 42) for i, j in zip(s, e)), np.uint64, len(s))
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * total > n - k + 1).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def _fingerprints(batches, shingle):
    for b in batches:
        prints = [fingerprint(x, shingle) for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])


def cuts(bits: int, max_bits: int) -> list[tuple[int, int]]:
    """``(shift, width)`` of the fewest segments of which one differs by at most one bit, for prints at most ``max_bits`` apart."""
    n = max_bits // 2 + 1
    edges = [bits * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def fingerprint_links(prints: DataFrame, max_bits: int = 3, bits: int = 64) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of the distinct ``fp`` of ``prints`` that differ by at most ``max_bits`` bits.

    Every segment is indexed under each of its one-wildcard variants; pairs meet by
    equality and are verified in the join itself, once: in the first segment that
    differs by at most one bit, at the position where it differs.
    """
    segments = cuts(bits, max_bits)
    variants = []
    for s, (shift, width) in enumerate(segments):
        part = f"(shiftrightunsigned(fp, {shift}) & {(1 << width) - 1}L)"
        variants.append(f"transform(sequence(0, {width - 1}), p -> named_struct('seg', {s}, 'pos', p, 'rest', {part} & ~shiftleft(1L, p)))")
    sig = prints.selectExpr("fp", f"explode(concat({', '.join(variants)})) AS v").selectExpr("fp", "v.seg", "v.pos", "v.rest")
    l, r = sig.alias("l"), sig.alias("r")
    first, before = [], []
    for s, (shift, width) in enumerate(segments):
        diff = f"(shiftrightunsigned(l.fp ^ r.fp, {shift}) & {(1 << width) - 1}L)"
        first.append(" AND ".join([*before, f"l.seg = {s}", f"({diff} = shiftleft(1L, l.pos) OR ({diff} = 0 AND l.pos = 0))"]))
        before.append(f"bit_count({diff}) > 1")
    on = f"l.seg = r.seg AND l.pos = r.pos AND l.rest = r.rest AND l.fp < r.fp AND bit_count(l.fp ^ r.fp) <= {max_bits} AND ({' OR '.join(f'({x})' for x in first)})"
    # Spark sizes the variants by the prints, of which they are 64 times as many rows, and would broadcast them
    return l.join(r.hint("merge"), F.expr(on)).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp, component_id, component_size)``: documents whose fingerprints are linked through steps of ``max_bits`` bits.

    Copies share one fingerprint and are never paired. A null text counts as empty, with
    fingerprint zero. Repeated rows each give a row. A component's id is its smallest
    non-null document id (null if it has none). Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = stored(rows.mapInArrow(lambda it: _fingerprints(it, shingle), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long"), "prints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    roots = components(fingerprint_links(prints.select("fp").distinct(), max_bits))
    placed = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    placed = stored(placed, "placed")
    groups = placed.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("n").alias("component_size"))
    by_print = placed.select("fp", "root").join(groups, "root").select("fp", "component_id", "component_size")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id", "component_size")


def _majority(h: np.ndarray) -> int:
    """The signed 64-bit SimHash of a set of hashes."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        total += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * total > len(h)).astype(np.uint8), bitorder="little").view(np.int64)[0])


def shingle_hashes(found: list[bytes], size: int = WORDS) -> np.ndarray:
    """The distinct hashes of the shingles; fewer words than a shingle are one, and no words none."""
    if not found:
        return np.zeros(0, np.uint64)
    k = min(size, len(found))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(found[i : i + k])) for i in range(len(found) - k + 1)), np.uint64, len(found) - k + 1))


def prefix(h: np.ndarray, keys: np.ndarray, ranks: np.ndarray, similarity: float) -> np.ndarray:
    """So many of the distinct ``h``, frequent ones last, that a similar set has one of them among as many of its own."""
    n = len(h)
    if not n:
        return h
    rank = np.zeros(n, np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        rank = np.where(keys[at] == h, ranks[at], 0)
    return h[np.lexsort((h, rank))][: n - int(np.ceil(n * similarity - 1e-9)) + 1]


def _frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of all texts, sorted, and their ranks from the rarest, 1, up.

    Each task tallies the shingles of its texts and hands on those it saw twice or more, so what is shuffled is little; the counts are
    lower bounds.
    """

    def tallied(batches):
        key, n, waiting, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def merged():
            u, c = np.unique(np.concatenate(waiting or [key[:0]]), return_counts=True)
            at = np.searchsorted(key, u)
            old = np.zeros(len(u), bool)
            old[at < len(key)] = key[at[at < len(key)]] == u[at < len(key)]
            n[at[old]] += c[old]
            return np.insert(key, at[~old], u[~old]), np.insert(n, at[~old], c[~old])

        for b in batches:
            for text in b.column(0).to_pylist():
                waiting.append(shingle_hashes(words(text)))
                size += len(waiting[-1])
                if size > KEPT:
                    key, n = merged()
                    waiting, size = [], 0
                    if len(key) > KEPT:
                        key, n = key[n > 1], n[n > 1]
        key, n = merged()
        key, n = key[n > 1], n[n > 1]
        for i in range(0, len(key), 500_000):
            yield pa.RecordBatch.from_arrays([pa.array(key[i : i + 500_000].view(np.int64)), pa.array(n[i : i + 500_000])], ["key", "n"])

    found = rows.select("text").mapInArrow(tallied, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = found.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()
    key = found["key"].to_numpy().view(np.uint64)
    order = np.argsort(key)
    return key[order], (len(key) - order).astype(np.int64)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, max_bits: int = 3) -> DataFrame:
    """``(row, doc_id, group)``: documents linked through steps of Jaccard similarity ``similarity`` or more of their five-word shingles.

    ``row`` numbers the input's rows (as monotonically_increasing_id does). Rows with equal words are one node and never paired, so repeated
    rows and ids are rows of their own in one group. Nodes whose SimHash prints differ by at most ``max_bits`` bits meet by
    one-wildcard variants of the segments and are verified. Bits can't promise to find all pairs at the similarity, so what is not yet
    linked then meets by shingles: similar nodes share one of their rarest. A node first
    meets one node of each of its shingles; after that only nodes that aren't yet
    linked meet, so groups of near copies don't meet in all pairs. Pairs whose sizes and
    positions allow the similarity are verified on their whole sets of shingles. Shingles are told apart by
    64-bit hashes. A null text counts as empty; texts without words are one node. Texts of any length are taken
    whole. Other columns, of whatever names, are ignored; an empty table gives none. ``group`` is a number shared by the rows of a group.
    """
    spark = docs.sparkSession
    freed(spark)
    docs = settled(docs)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    frequent = spark.sparkContext.broadcast(_frequent(rows))

    def prefixes(batches):
        for b in batches:
            node, size, fp, out = [], [], [], []
            for text in b.column(1).to_pylist():
                found = words(text)
                node.append(xxhash.xxh3_64_intdigest(b" ".join(found)))
                h = shingle_hashes(found)
                size.append(len(h))
                fp.append(_majority(h))
                out.append(prefix(h, *frequent.value, similarity).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(size, pa.int32()), pa.array(fp, pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["row", "node", "n", "fp", "p"])

    prints = stored(rows.select("row", "text").mapInArrow(prefixes, "row long, node long, n int, fp long, p array<long>"), "prints")
    nodes = stored(prints.groupBy("node").agg(F.min("row").alias("row")), "nodes")

    def fits(n: str, m: str, before: Column, i: str, j: str) -> Column:
        """Whether sizes allow the similarity when ``before`` shingles at most are shared up to positions ``i`` and ``j``."""
        n, m = F.col(n), F.col(m)
        need = F.ceil((n + m) * (similarity / (1 + similarity)) - 1e-9)
        return (F.least(n, m) >= F.ceil(F.greatest(n, m) * similarity - 1e-9)) & (before + F.least(n - 1 - F.col(i), m - 1 - F.col(j)) >= need)

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs.distinct(), "pairs")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node")
        held = spark.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64("row").alias("h")), "h"))
        freed(spark)

        def sets(batches):
            """The whole sets of wanted nodes; the filter may let others pass, which no pair has. The words of one text at a time are in memory, and some sets."""

            def out(node, sets):
                return pa.RecordBatch.from_arrays([pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(sets, pa.list_(pa.int64()))], ["node", "s"])

            for b in batches:
                b = b.filter(pa.array(in_bitmap(held.value, b.column(0).to_numpy().view(np.uint64))))
                node, sets, n = [], [], 0
                for text in b.column(1):
                    found = words(text.as_py())
                    node.append(xxhash.xxh3_64_intdigest(b" ".join(found)))
                    sets.append(shingle_hashes(found).view(np.int64))
                    n += len(sets[-1])
                    if n > KEPT:
                        yield out(node, sets)
                        node, sets, n = [], [], 0
                yield out(node, sets)

        found = stored(rows.select(F.xxhash64("row").alias("h"), "text").mapInArrow(sets, "node long, s array<long>"), "sets")
        both = pairs.join(found.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(found.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        links = stored(both.where(common >= (F.size("sa") + F.size("sb") - common) * similarity - 1e-9).select("a", "b"), "links")
        dropped(pairs, found)
        freed(spark)
        return links

    # operator's own links first: prints that differ by few bits
    same = prints.groupBy("fp").agg(F.min("node").alias("node"), F.max("node").alias("other"))
    same = stored(same, "same")
    groups = components(fingerprint_links(same.select("fp"), max_bits))
    # of each group of prints all nodes are held against one, so that pairs don't grow with its square; who differs from that one meets others below
    of = prints.select("fp", "node").distinct().join(groups.withColumnRenamed("node", "print"), F.col("fp") == F.col("print"), "left").select("node", F.coalesce("root", "fp").alias("fp"))
    close = of.join(same.select("fp", F.col("node").alias("head")), "fp").where("node <> head")
    links = verified(close.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")))
    dropped(same)
    known = stored(components(links), "known")
    # then what bits can't promise: similar sets share one of their rarest shingles
    spread = prints.select("node", "n", F.posexplode("p").alias("pos", "key"))
    low = spread.groupBy("key").agg(F.min(F.struct("node", "n", "pos")).alias("x"), F.max("node").alias("z")).where("x.node < z")
    low = stored(low.select("key", F.col("x.node").alias("a"), F.col("x.n").alias("m"), F.col("x.pos").alias("at")), "low")
    freed(spark)
    at = stored(spread.join(low.select("key"), "key", "left_semi").distinct(), "shared")
    freed(spark)
    first = at.join(low, "key").where("node <> a").where(fits("n", "m", F.least("pos", "at") + 1, "pos", "at")).select("a", F.col("node").alias("b")).distinct()
    for end in "ab":
        first = first.join(known.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    found = verified(first.where("root_a IS NULL OR root_b IS NULL OR root_a <> root_b").select("a", "b"))
    links = links.unionByName(found)
    dropped(known)
    roots = stored(components(links), "roots")
    placed = at.join(roots, "node", "left").select("node", "n", "pos", "key", F.coalesce("root", "node").alias("root"))
    placed = stored(placed, "placed")
    dropped(at, low)
    open_ = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
    open_ = stored(placed.join(stored(open_, "open"), "key", "left_semi"), "placed")
    l, r = open_.alias("l"), open_.alias("r")
    # a pair that isn't linked meets in each shingle that both have among their rarest, which come first of all they share
    rest = l.join(r, (F.col("l.key") == F.col("r.key")) & (F.col("l.node") < F.col("r.node")) & (F.col("l.root") != F.col("r.root")) & fits("l.n", "r.n", F.least("l.pos", "r.pos") + 1, "l.pos", "r.pos"))
    rest = rest.groupBy(F.col("l.node").alias("a"), F.col("r.node").alias("b"), F.col("l.n").alias("n"), F.col("r.n").alias("m")).agg(F.count("*").alias("found"), F.max("l.pos").alias("i"), F.max("r.pos").alias("j"))
    more = verified(rest.where(fits("n", "m", F.col("found"), "i", "j")).select("a", "b"))
    dropped(placed, open_)
    roots = stored(components(links.unionByName(more)), "roots")
    grouped = prints.select("row", "node").join(roots, "node", "left").select("row", F.coalesce("root", "node").alias("group"))
    grouped = stored(grouped, "grouped")
    dropped(prints, nodes)
    freed(spark)
    return rows.select("row", "doc_id").join(grouped, "row")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")
