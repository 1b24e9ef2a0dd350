"""Pairs of similar sequences where so many edits are allowed that pieces would meet nearly all others: blocks of sequences against blocks, in an Arrow kernel."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import kept

#: Sequences of a block of either side, at most about.
LEFT, RIGHT = 1 << 14, 1 << 17
#: Pairs that the kernel takes a step for at once.
LANES = 1 << 15


def edit_limit(n: int, m: int, s: float, strict: bool = False) -> int:
    """Edits that sequences of lengths n and m may have at similarity ``s`` or more (``strict``: above)."""
    room = (1 - s) * max(n, m)
    return int(np.ceil(room - 1e-9)) - 1 if strict else int(np.floor(room + 1e-9))


def coded(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Both lists, each of sequences of one length, as rows of small numbers, and how many letters there are."""
    x, y = (np.frombuffer("".join(z).encode("utf-32-le"), np.uint32) for z in (a, b))
    letters = np.unique(np.concatenate([np.unique(x), np.unique(y)]))
    return *(np.searchsorted(letters, z).reshape(len(of), -1) for z, of in ((x, a), (y, b))), len(letters)


def planes(codes: np.ndarray, letters: int, word: type) -> list[list[np.ndarray]]:
    """Bit p of the letters of each row, packed into words: a list of words for each p."""
    bits = np.dtype(word).itemsize * 8
    n, size = codes.shape
    out = []
    for p in range(max(int(letters - 1).bit_length(), 1)):
        plane = np.zeros((n, -(-size // bits) * bits), np.uint8)
        plane[:, :size] = codes >> p & 1
        out.append(list(np.packbits(plane, axis=1, bitorder="little").view(word).T.copy()))
    return out


def edits(a: list[list[np.ndarray]], b: list[list[np.ndarray]], n: int, m: int) -> np.ndarray:
    """Edit distances of the i-th sequence of a, of n letters, and the i-th of b, of m, for all i at once: Myers' columns of differences as bits."""
    word = a[0][0].dtype.type
    bits, one, words = np.dtype(word).itemsize * 8, word(1), range(len(a[0]))
    pv, mv = [np.full(len(a[0][0]), ~word(0)) for _ in words], [np.zeros(len(a[0][0]), word) for _ in words]
    for j in range(m):
        letter = [np.negative(p[j // bits] >> word(j % bits) & one) for p in b]
        hp, hm = one, word(0)
        for w in words:
            eq = a[0][w] ^ letter[0]
            for p, of in zip(a[1:], letter[1:]):
                eq |= p[w] ^ of
            np.invert(eq, out=eq)
            xv = eq | mv[w]
            if w:
                eq |= hm
            xh = eq & pv[w]
            xh += pv[w]
            xh ^= pv[w]
            xh |= eq
            mh = pv[w] & xh
            xh |= pv[w]
            ph = np.invert(xh, out=xh)
            ph |= mv[w]
            up, down = hp, hm
            if w + 1 < len(words):
                hp, hm = ph >> word(bits - 1), mh >> word(bits - 1)
            ph <<= one
            ph |= up
            mh <<= one
            if w:
                mh |= down
            mv[w] = ph & xv
            xv |= ph
            pv[w] = np.invert(xv, out=xv)
            pv[w] |= mh
    last = word((1 << (n - bits * (len(words) - 1))) - 1)
    out = np.full(len(a[0][0]), m, np.int64)
    for w in words:
        own = last if w + 1 == len(words) else ~word(0)
        out += np.bitwise_count(pv[w] & own)
        out -= np.bitwise_count(mv[w] & own)
    return out


@lru_cache
def scripts(size: int, errors: int) -> frozenset[tuple[int, ...]]:
    """Ways to write ``size`` letters by copying from a place on with so many errors: an index of each letter copied, or -1 to -4 for any of four letters."""
    out = set()

    def go(t: tuple[int, ...], i: int, left: int) -> None:
        if len(t) == size:
            out.add(t)
            return
        go((*t, i), i + 1, left)
        if left:
            go(t, i + 1, left - 1)
            for c in range(-4, 0):
                go((*t, c), i + 1, left - 1)
                go((*t, c), i, left - 1)

    go((), 0, errors)
    return frozenset(out)


@lru_cache
def seeds(n: int, m: int, t: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(begin, end, weights, constants)`` for quarters of a sequence of m letters: what a quarter may be, as a number to the base 4, in one of n letters within t edits.

    Quarters may have so many edits each that one of them has no more in any such pair, as their numbers and one each add up to t + 1. The first starts
    where the other sequence does and the last ends with it; those between have moved by no more than the edits before and after leave.
    """
    out, cuts = [], [m * i // 4 for i in range(5)]
    for k in range(4):
        errors = (t + 1) // 4 + ((t + 1) % 4 > (0, 2, 3, 1)[k]) - 1
        if errors < 0:
            continue
        lo, hi = cuts[k], cuts[k + 1]
        moved = [0] if k in (0, 3) else [x for x in range(-t, t + 1) if abs(x) + abs(n - m - x) <= t]
        found = set()
        for x in moved:
            for way in scripts(hi - lo, errors):
                at = [i if i < 0 else n - 1 - i if k == 3 else lo + x + i for i in way]
                if all(j < 0 if i < 0 else 0 <= j < n for i, j in zip(way, at)):
                    found.add(tuple(at[::-1] if k == 3 else at))
        weights, constants = np.zeros((n, len(found))), np.zeros(len(found))
        for c, way in enumerate(found):
            for p, i in enumerate(way):
                if i < 0:
                    constants[c] += (i + 4) * 4**p
                else:
                    weights[i, c] += 4**p
        out.append((lo, hi, weights, constants))
    return out


def _candidates(x: np.ndarray, y: np.ndarray, t: int):
    """``(i, j)`` of rows of x and y that share what a quarter may be, some twice; of many rows of x at once."""
    n, m = x.shape[1], y.shape[1]
    index = []
    for lo, hi, weights, constants in seeds(n, m, t):
        key = y[:, lo:hi] @ 4 ** np.arange(hi - lo)
        index.append((weights, constants, np.argsort(key, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(key, minlength=4 ** (hi - lo)))))))
    for at in range(0, len(x), 64):
        rows, found = x[at : at + 64].astype(float), []
        for weights, constants, order, upto in index:
            if not weights.shape[1]:
                continue
            key = (rows @ weights + constants).astype(np.int32)
            key.sort(axis=1)
            low = upto[key]
            count = upto[key + 1] - low
            count[:, 1:][key[:, 1:] == key[:, :-1]] = 0
            hit = np.flatnonzero(count)
            c = count.ravel()[hit]
            j = np.repeat(low.ravel()[hit] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            found.append((np.repeat(hit // key.shape[1], c) + at, order[j]))
        yield tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, int) for k in (0, 1))


def _all(x: np.ndarray, y: np.ndarray):
    """``(i, j)`` of all rows of x and y, of many at once."""
    for at in range(0, len(x) * len(y), LANES):
        yield np.divmod(np.arange(at, min(at + LANES, len(x) * len(y))), len(y))


def similar_rows(a: list[str], b: list[str], s: float, strict: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """``(i, j)`` of all similar sequences of two lists, each of sequences of one length, none of them empty."""
    n, m = len(a[0]), len(b[0])
    t = edit_limit(n, m, s, strict)
    if abs(n - m) > t:
        return np.zeros(0, int), np.zeros(0, int)
    x, y, letters = coded(a, b)
    word = np.uint32 if n <= 32 else np.uint64
    px, py = planes(x, letters, word), planes(y, letters, word)
    # quarters help where they are long enough and few edits are allowed in each
    tell = _candidates(x, y, t) if letters <= 4 and m >= 24 and 3 <= t < 12 else _all(x, y)
    found = [np.zeros(0, int)]
    for i, j in tell:
        for at in range(0, len(i), LANES):
            p, q = i[at : at + LANES], j[at : at + LANES]
            near = edits([[w[p] for w in z] for z in px], [[w[q] for w in z] for z in py], n, m) <= t
            found.append(p[near] * len(y) + q[near])
    return np.divmod(np.unique(np.concatenate(found)), len(y))


def _blocks(rows: DataFrame, size: int, side: str) -> DataFrame:
    """``(n, seqs)`` of the column ``seq``: sequences of one length in blocks, dealt out to as many partitions as there are rows for."""
    rows = kept(rows.select("seq").distinct().withColumn("n", F.length("seq")))
    counts = rows.groupBy("n").agg(F.count("*").alias("c"))
    blocks = rows.join(F.broadcast(counts), "n").groupBy("n", F.pmod(F.xxhash64("seq"), F.ceil(F.col("c") / size)).alias("block"))
    blocks = kept(blocks.agg(F.collect_list("seq").alias("seqs")).select(F.col("n").alias(f"n_{side}"), F.col("seqs").alias(f"seqs_{side}")))
    return blocks.repartition(max(1, min(blocks.count(), -(-2 * rows.count() // size))))


def met_in_blocks(a: DataFrame, b: DataFrame, s: float, strict: bool = False) -> DataFrame:
    """``(sa, sb)``: the similar ones of the sequences in the columns ``seq``, none of them empty.

    Every block of a is held against every block of b of lengths that allow the similarity; blocks are read again for each task and never copied by a shuffle.
    """
    spark = a.sparkSession
    a = kept(a.select("seq").distinct())
    size = min(LEFT, max(256, -(-a.count() // (3 * spark.sparkContext.defaultParallelism))))
    pairs = _blocks(a, size, "a").join(_blocks(b, RIGHT, "b").hint("shuffle_replicate_nl"), F.expr(f"n_a >= ceil(n_b * {s!r}D - 1e-9) AND n_a <= floor(n_b / {s!r}D + 1e-9)"))

    def run(batches):
        for batch in batches:
            for x, y in zip(batch.column("seqs_a"), batch.column("seqs_b")):
                x, y = x.as_py(), y.as_py()
                i, j = similar_rows(x, y, s, strict)
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for k in i], pa.string()), pa.array([y[k] for k in j], pa.string())], ["sa", "sb"])

    return pairs.select("seqs_a", "seqs_b").mapInArrow(run, "sa string, sb string")
