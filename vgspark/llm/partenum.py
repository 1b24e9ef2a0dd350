"""N-gram Jaccard join through PartEnum signatures."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import bitmap, components, dropped, freed, in_bitmap, settled, stored, table

#: Words a shingle, and the similarity in hundredths.
SHINGLE, PERCENT = 4, 85
#: Of each first-level partition's CELLS, subsets that leave out MISSED are enumerated.
CELLS, MISSED = 3, 1
#: Rows a batch that is handed on holds; hashes of words and sets that a task remembers.
BATCH, REMEMBERED = 100_000, 200_000

_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


#: A byte's place in a word counts by powers of BASE; texts are read by so many bytes at a time.
BASE, BLOCK = 0x5851F42D4C957F2D, 1 << 18
_FULL = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit word of ``x`` scattered, one to one."""
    x = x ^ (x >> np.uint64(30))
    x *= _MUL[1]
    x ^= x >> np.uint64(27)
    x *= _MUL[3]
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Shingles:
    """The distinct 64-bit hashes of a text's word n-grams, A-Z lower-cased; words are runs of anything but ASCII white space."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.up, self.down = size, _powers(BASE), _powers(pow(BASE, -1, 1 << 64))
        odd = np.random.default_rng(size).integers(0, 1 << 63, size).astype(np.uint64)
        self.factors = odd * np.uint64(2) + np.uint64(1)

    def words(self, text: str) -> np.ndarray:
        """A hash of each word: a polynomial in its bytes, so that words that lie in two blocks can be put together."""
        data = np.frombuffer(text.encode().lower(), np.uint8)
        out, open_, n_open = [], 0, 0
        for at in range(0, len(data), BLOCK):
            block = data[at : at + BLOCK]
            edge = np.diff(np.concatenate(([True], _SPACE[block], [True])).view(np.int8))
            starts, ends = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((block.astype(np.uint64) + np.uint64(1)) * self.up[: len(block)], dtype=np.uint64)))
            h = (sums[ends] - sums[starts]) * self.down[starts]
            if n_open:
                if len(starts) and starts[0] == 0:
                    open_, n_open = (open_ + int(h[0]) * pow(BASE, n_open, 1 << 64)) & _FULL, n_open + int(ends[0])
                    h, starts, ends = h[1:], starts[1:], ends[1:]
                    whole = n_open and (len(ends) > 0 or _SPACE[block[-1]])
                else:
                    whole = True
                if whole:
                    out.append(np.array([open_], np.uint64))
                    open_, n_open = 0, 0
            if len(ends) and ends[-1] == len(block) and at + BLOCK < len(data):
                open_, n_open, h = int(h[-1]), int(ends[-1] - starts[-1]), h[:-1]
            out.append(h)
        if n_open:
            out.append(np.array([open_], np.uint64))
        return _mixed(np.concatenate(out)) if out else np.zeros(0, np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            h = self.words(text)
            if not len(h):
                return h
            k = min(self.size, len(h))
            total = np.full(len(h) - k + 1, k, np.uint64)
            for i in range(k):
                total += h[i : len(h) - k + 1 + i] * self.factors[i]
            return np.unique(total)


def bands(percent: int = PERCENT, largest: int = 1 << 40) -> np.ndarray:
    """The least sizes of the bands; similar sets are in one band or in neighbouring ones."""
    low = [1]
    while low[-1] <= largest:
        low.append(low[-1] * 100 // percent + 1)
    return np.array(low, np.int64)


def signatures(h: np.ndarray, low: np.ndarray, percent: int = PERCENT) -> list[tuple[int, np.ndarray]]:
    """``(band, signatures)`` of the set ``h`` for each of its instances: similar sets that aren't equal share one.

    Two sets, the smaller one of size a, differ in at most ``a * (1 - s) / s`` features. An instance belongs to the band of the smaller set,
    so a set has signatures for its own band and the one below. In an instance features fall into first-level partitions, so many that at
    least one holds at most MISSED of the k that differ; that one's cells without the MISSED that hold them are equal, and all such subsets
    of cells are enumerated. A subset without features says nothing. Where there are many first-level partitions some more are made, so that one
    more of each of them has an equal subset, and a set with empty subsets in no more than these leaves them out; any other set that has
    one gets signatures by another partitioning below it.
    """
    scattered = _mixed(h)
    return [(b, np.concatenate(_enumerated(h, scattered, (int(low[b + 1]) - 1) * (100 - percent) // percent, np.uint64(b + 1), 0))) for b in instances(len(h), low, percent)]


def instances(n: int, low: np.ndarray, percent: int = PERCENT) -> list[int]:
    """The bands whose instances a set of ``n`` belongs to: those in which unequal sets can be similar."""
    band = int(np.searchsorted(low, n, "right")) - 1
    return [b for b in (band - 1, band) if b >= 0 and (int(low[b + 1]) - 1) * (100 - percent) >= percent]


def _enumerated(h: np.ndarray, scattered: np.ndarray, differ: int, tag: np.uint64, depth: int) -> list[np.ndarray]:
    missed = min(MISSED, differ)
    parts = differ // (missed + 1) + 1
    spare = parts // 64 + 1 if parts >= 24 else 0
    parts += spare
    with np.errstate(over="ignore"):
        tag = _mixed(np.array([tag + np.uint64(depth)]) * _MUL[2])
        cell = _mixed(h ^ tag)
        cell >>= np.uint64(32)
        cell *= np.uint64(parts * CELLS)
        cell = (cell >> np.uint64(32)).astype(np.int64)
        sums, held = np.zeros(parts * CELLS, np.uint64), np.bincount(cell, minlength=parts * CELLS).reshape(parts, CELLS)
        np.add.at(sums, cell, scattered)
        sums = sums.reshape(parts, CELLS)
        chosen = list(combinations(range(CELLS), CELLS - missed))
        empty = np.stack([held[:, c].sum(1) == 0 for c in chosen])
        refined = empty.any(0).sum() > spare
        place = np.arange(parts, dtype=np.uint64) * _MUL[0] + tag
        out = []
        for j, c in enumerate(chosen):
            sig = _mixed(sums[:, c].sum(1, dtype=np.uint64) + place + np.uint64(j) * _MUL[1])
            out.append(sig[~empty[j]])
            for x in sig[empty[j]] if refined else ():
                out += [np.array([x], np.uint64)] if depth == 3 else _enumerated(h, scattered, differ, x, depth + 1)
    return out


def node_of(h: np.ndarray) -> int | None:
    """A number for the set; the empty set has none."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).astype(np.int64)) if len(h) else None


def parities(h: np.ndarray, low: np.ndarray, percent: int = PERCENT) -> list[np.ndarray]:
    """For each instance of the set, from its own band down, the parities of how many features fall on each of some bits.

    A feature that only one of two sets has turns one bit, so bits that differ are no more than such features.
    """
    out, spread = [], _mixed(h)
    for b in reversed(instances(len(h), low, percent)):
        bits = max(64, 1 << (2 * int(low[b + 1]) - 1).bit_length())
        at = (spread >> np.uint64(65 - bits.bit_length())).astype(np.int64)
        out.append(np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1, bitorder="little").view(np.int64))
    return out


def near_enough(a: str, b: str, percent: int) -> Column:
    """Whether the parities of ``a`` and ``b`` in the instance ``band`` of the row allow their similarity."""
    at = lambda x: f"CASE WHEN {x}.top = l.band THEN {x}.own ELSE {x}.below END"
    turned = f"aggregate(zip_with({at(a)}, {at(b)}, (x, y) -> bit_count(x ^ y)), 0, (t, x) -> t + x)"
    return F.expr(f"{turned} * {100 + percent} <= ({a}.n + {b}.n) * {100 - percent}")


def fits(n: str, m: str, percent: int) -> Column:
    """Whether sets of these sizes can be similar."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _verified(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of the pairs of nodes ``(a, b)`` whose whole sets are similar."""
    spark = rows.sparkSession
    pairs = stored(pairs.distinct(), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "row"), "node")
    held = spark.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64("row").alias("h")), "h"))

    def sets(batches):
        """The sets of wanted rows; the filter may let others pass, which no pair has."""
        of, node, found, size = Shingles(shingle), [], [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["node", "s"])

        for b in batches:
            b = b.filter(pa.array(in_bitmap(held.value, b.column(0).to_numpy().view(np.uint64))))
            for text in b.column(1):
                h = of(text.as_py())
                node.append(node_of(h))
                found.append(h.view(np.int64))
                size += len(h)
                if size > BATCH * 5:
                    yield out()
                    node, found, size = [], [], 0
        yield out()

    found = stored(rows.select(F.xxhash64("row").alias("h"), "text").mapInArrow(sets, "node long, s array<long>"), "sets")
    once = found.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.first("s").alias("s"))
    both = pairs.join(once.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(once.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    links = stored(both.where(common * 100 >= (F.size("sa") + F.size("sb") - common) * percent).select("a", "b"), "links")
    dropped(pairs, found)
    freed(spark)
    return links


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: documents linked through steps of Jaccard similarity ``percent`` / 100 or more of their n-gram sets.

    Documents with equal sets are one node, so copies are never paired. Nodes that share a signature are candidates: if their sizes and the
    parities of their features allow the similarity, they are verified on their whole sets. Of the nodes with one signature each is first held
    against the one that shares most signatures; after that only nodes that aren't linked yet meet, so groups of near copies don't meet in all
    pairs, and still no pair that isn't linked through others is left out.

    A null text, or one without words, has an empty set, which is linked with nothing: its component is its own id. A text with fewer words than
    a shingle has its whole sequence as one. Repeated rows each give a row; a component's id is its smallest non-null document id, null where it
    has none. Texts of any length are taken whole, by blocks. Other columns are ignored; an empty table gives no rows. Sets and shingles are told
    apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    freed(spark)
    docs = settled(docs)
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    low = bands(percent)

    def sized(batches):
        of, longs = Shingles(shingle), pa.list_(pa.int64())
        for b in batches:
            node, n, top, own, below = [], [], [], [], []
            for text in b.column(2):
                h = of(text.as_py())
                found = parities(h, low, percent)
                node.append(node_of(h))
                n.append(len(h))
                top.append(int(np.searchsorted(low, len(h), "right")) - 1)
                own.append(found[0] if found else None)
                below.append(found[1] if len(found) > 1 else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(top, pa.int32()), pa.array(own, longs), pa.array(below, longs)], ["row", "doc_id", "node", "n", "top", "own", "below"])

    def signed(batches):
        of, seen, waiting, size = Shingles(shingle), set(), [], 0

        def out():
            column = lambda i, kind: pa.array(np.concatenate([np.full(len(s), x[i], kind) for *x, s in waiting]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([s for *_, s in waiting]).view(np.int64)), column(0, np.int32), column(1, np.int64), column(2, np.int64)], ["sig", "band", "node", "n"])

        for b in batches:
            for text in b.column(0):
                h = of(text.as_py())
                x = node_of(h)
                if x is None or x in seen:
                    continue
                if len(seen) > REMEMBERED:
                    seen.clear()
                seen.add(x)
                for band, s in signatures(h, low, percent):
                    waiting.append((band, x, len(h), s))
                    size += len(s)
                if size > BATCH:
                    yield out()
                    waiting, size = [], 0
        if waiting:
            yield out()

    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", kind), T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("top", T.IntegerType()), T.StructField("own", longs), T.StructField("below", longs)])
    prints = stored(rows.mapInArrow(sized, schema), "prints")
    nodes = stored(prints.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("row", "n", "top", "own", "below")).alias("x")).select("node", "x.*"), "nodes")
    # one shuffle brings equal signatures together; only those of two nodes and more go on
    every = Window.partitionBy("sig")
    met = rows.select("text").mapInArrow(signed, "sig long, band int, node long, n long")
    met = met.select("*", F.lag("node").over(every.orderBy("node")).alias("before"), F.min("node").over(every).alias("first"), F.max("node").over(every).alias("last"), F.count("*").over(every).alias("size"))
    shared = stored(met.where("first <> last AND (before IS NULL OR before <> node)").select("sig", "band", "node", "n", "size"), "shared")
    freed(spark)
    # of each signature's nodes that which shares most leads
    weight = shared.groupBy("node").agg(F.sum("size").alias("weight"))
    heads = shared.join(weight, "node").groupBy("sig").agg(F.max(F.struct("weight", "node", "n")).alias("x")).select("sig", "x.weight", F.col("x.node").alias("head"), F.col("x.n").alias("m"))
    star = shared.join(heads, "sig").where("node <> head").where(fits("n", "m", percent)).groupBy("node", "head").agg(F.min("band").alias("band"), F.first("weight").alias("weight"))
    parts = nodes.select("node", "n", "top", "own", "below")
    l = star.join(parts, "node").withColumn("x", F.struct("n", "top", "own", "below")).select("node", "head", "band", "weight", "x").alias("l")
    r = parts.select(F.col("node").alias("head"), F.struct("n", "top", "own", "below").alias("y"))
    star = l.join(r, "head").selectExpr("node", "head", "band", "weight", "x", "y").alias("l").where(near_enough("l.x", "l.y", percent))
    star = stored(star.select("node", "head", "weight"), "star")
    freed(spark)
    # each node first meets one other node only
    best = star.groupBy(F.col("node").alias("b")).agg(F.max(F.struct("weight", "head")).alias("x")).select(F.col("x.head").alias("a"), "b")
    links = _verified(rows, nodes, best, shingle, percent)
    for step in ("star", "rest"):
        roots = stored(components(links), "roots")
        if step == "star":
            own, to = roots.select("node", "root"), roots.select(F.col("node").alias("head"), F.col("root").alias("head_root"))
            pairs = star.join(own, "node", "left").join(to, "head", "left").where("coalesce(root, node) <> coalesce(head_root, head)")
            pairs = pairs.select(F.col("head").alias("a"), F.col("node").alias("b"))
        else:
            placed = shared.join(roots, "node", "left").select("sig", "band", "node", F.coalesce("root", "node").alias("root"))
            open_ = placed.groupBy("sig").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("sig")
            placed = stored(placed.join(open_, "sig", "left_semi").join(parts, "node"), "placed")
            l, r = placed.alias("l"), placed.alias("r")
            on = (F.col("l.sig") == F.col("r.sig")) & (F.col("l.node") < F.col("r.node")) & (F.col("l.root") != F.col("r.root")) & fits("l.n", "r.n", percent) & near_enough("l", "r", percent)
            pairs = l.join(r, on).select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))
        more = _verified(rows, nodes, pairs, shingle, percent)
        both = stored(links.unionByName(more), "links")
        dropped(roots, links, more)
        links = both
    roots = stored(components(links), "roots")
    dropped(shared, star, placed, links)
    freed(spark)
    grouped = stored(prints.select("doc_id", "node", "n").join(roots, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "node").alias("root")), "grouped")
    least = grouped.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    dropped(prints, nodes, roots)
    none = grouped.where("root IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return grouped.join(least, "root").select("doc_id", "n_shingles", "component_id").unionByName(none)


def op12_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


#: Every shingle of every text, all pairs that share one, and what can be reached over the links.
OP12_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 OR ws IS NULL THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
m AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id
"""
