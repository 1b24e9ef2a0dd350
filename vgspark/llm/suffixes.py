"""Removal of repeated byte strings by bucket-pointer refinement of sampled suffixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bitmap, dropped, freed, in_bitmap, settled, stored, table

LENGTH = 100
#: Bytes of the first buckets' strings: a power of two from 8, built by doubling.
Q = 32
#: Places taken at a time, so that memory is bounded for texts of any length and stays in a CPU's cache.
BLOCK = 1 << 16
#: Buckets of so many different contexts at most are held against each other byte by byte; larger ones are split further by strings.
PAIRWISE = 128
#: Bits of the filters.
FILTER = 27

_A, _B, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def _refined(x: np.ndarray, later: np.ndarray) -> np.ndarray:
    """New bucket ids from those of a place and of a later offset."""
    x = x * _A + later * _B
    x ^= x >> np.uint64(29)
    x *= _M
    x ^= x >> np.uint64(32)
    return x


def buckets(a: np.ndarray) -> np.ndarray:
    """Bucket identifiers of all Q-byte strings: those of 8 bytes are the bytes, those of 2n come from the pair at a place and n further on."""
    x = a.astype(np.uint64)
    for n in (1, 2, 4):
        x = x[:-n] | x[n:] << np.uint64(8 * n)
    n = 8
    while n < Q:
        x = _refined(x[:-n], x[n:])
        n *= 2
    return x


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """``(positions, bucket ids)`` in ``data`` such that every ``length`` bytes inside a text hold one, chosen by those bytes alone.

    Of the buckets that start in the first ``length - Q + 1`` places the least, and of equal ones the last, is taken.
    """
    width, at, ids = length - Q + 1, [], []
    first, end = int(offsets[0]), int(offsets[-1])
    for s in range(first, end - length + 1, BLOCK):
        e = min(s + BLOCK, end - length + 1)
        i, j = np.searchsorted(offsets, s, "right") - 1, np.searchsorted(offsets, e, "left")
        stops = np.repeat(offsets[i + 1 : j + 1], np.minimum(offsets[i + 1 : j + 1], e) - np.maximum(offsets[i:j], s))
        whole = np.arange(s, e) + length <= stops
        if not whole.any():
            continue
        x = buckets(data[s : e + length - 1])
        key = (x & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(x), dtype=np.uint64))
        n = 1
        while 2 * n <= width:
            key = np.minimum(key[:-n], key[n:])
            n *= 2
        if n < width:
            key = np.minimum(key[: n - width], key[width - n :])
        p = (np.uint64(0xFFFFFFFF) - (key[whole] & np.uint64(0xFFFFFFFF))).astype(np.int64)
        p = p[np.flatnonzero(np.diff(p, prepend=-1))]
        at.append(p + s)
        ids.append(x[p])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, ids = np.concatenate(at), np.concatenate(ids)
    keep = np.diff(at, prepend=-1) > 0
    return at[keep], ids[keep]


def contexts(data: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> np.ndarray:
    """Identifiers of the contexts ``lo..hi`` of the suffixes ``at``: their buckets, refined by the bucket ids at later offsets, Q bytes further on
    each, then at earlier ones; the last of each side ends with the context. Contexts cut short by an end of their text differ from whole ones.
    """
    out = np.zeros(len(at), np.uint64)
    for i in range(0, len(at), BLOCK):
        a, x, y = at[i : i + BLOCK], lo[i : i + BLOCK], hi[i : i + BLOCK]
        first = int(x.min())
        ids = buckets(data[first : int(y.max())])
        got = (a - x).astype(np.uint64) << np.uint64(32) | (y - a).astype(np.uint64)
        for k in range(0, length, Q):
            got = _refined(got, ids[np.minimum(a + k, y - Q) - first])
        for k in range(Q, length, Q):
            got = _refined(got, ids[np.maximum(a - k, x) - first])
        out[i : i + BLOCK] = got
    return out


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch of texts and where each begins and ends."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def _count(batches, length):
    for b in batches:
        ids, n = np.unique(anchors(*_buffers(b.column(0)), length)[1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(n)], ["key", "n"])


def _row_id(row: np.ndarray, at: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """A mixed number for a place, for filters."""
    x = (row.astype(np.uint64) * _A + at.astype(np.uint64)) * _B ^ cls.view(np.uint64)
    x ^= x >> np.uint64(31)
    x *= _M
    return x ^ (x >> np.uint64(29))


def _sampled(batch, length, repeated):
    """``(data, row, bucket id, place, lo, hi)`` of the suffixes of a batch whose bucket is in the filter; lo..hi is their context."""
    data, offsets = _buffers(batch.column(2))
    at, ids = anchors(data, offsets, length)
    keep = in_bitmap(repeated.value, ids)
    at, ids = at[keep], ids[keep]
    row = np.searchsorted(offsets, at, "right") - 1
    start, stop = offsets[row], offsets[row + 1]
    return data, row, ids, at, start, stop, np.maximum(start, at - (length - Q)), np.minimum(stop, at + length)


def _suffixes(batches, length, repeated):
    """Suffixes with bucket and context ids. Of those of a batch that agree in both only the first goes on; for the others ``b`` and ``cls`` are null."""
    for batch in batches:
        data, row, ids, at, start, stop, lo, hi = _sampled(batch, length, repeated)
        cls = contexts(data, at, lo, hi, length)
        docs = pa.table({"id": batch.column(0), "row": batch.column(1)})
        rank = np.empty(len(batch), np.int64)
        rank[pc.sort_indices(docs, sort_keys=[("id", "ascending"), ("row", "ascending")], null_placement="at_start").to_numpy()] = np.arange(len(batch))
        order = np.lexsort((at, rank[row], cls, ids))
        same = np.zeros(len(at), bool)
        same[order[1:]] = (ids[order[1:]] == ids[order[:-1]]) & (cls[order[1:]] == cls[order[:-1]])
        for i in range(0, len(at), 100_000):
            part = slice(i, i + 100_000)
            r = pa.array(row[part])
            columns = [batch.column(0).take(r), batch.column(1).take(r), pa.array(ids[part].view(np.int64), mask=same[part]), pa.array(cls[part].view(np.int64), mask=same[part])]
            columns += [pa.array((x[part] - start[part])) for x in (lo, np.minimum(at, stop - length), at)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "b", "cls", "lo", "hi", "at"])


def _contexts(batches, length, repeated, firsts):
    """Suffixes whose place is in the filter ``firsts``, each with the bytes of its context."""
    for batch in batches:
        data, row, ids, at, start, stop, lo, hi = _sampled(batch, length, repeated)
        keep = in_bitmap(firsts.value, _row_id(batch.column(1).to_numpy()[row], at - start, np.zeros(len(at), np.int64)))
        row, ids, at, start, stop, lo, hi = (x[keep] for x in (row, ids, at, start, stop, lo, hi))
        view = memoryview(data)
        for i in range(0, len(at), 50_000):
            part = slice(i, i + 50_000)
            r = pa.array(row[part])
            columns = [batch.column(0).take(r), batch.column(1).take(r), pa.array(ids[part].view(np.int64))]
            columns += [pa.array(x[part] - start[part]) for x in (lo, np.minimum(at, stop - length), at)]
            columns.append(pa.array([view[x:y].tobytes() for x, y in zip(lo[part].tolist(), hi[part].tolist())], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "b", "lo", "hi", "at", "context"])


def _held(b: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, context: list[bytes], length: int):
    """``(row, lo, hi)``: the starts of strings that an earlier suffix of the same bucket has as well, by comparing bytes. Rows are sorted by bucket, then place."""
    left, n = length - Q, len(b)
    text = np.zeros((n, left + length), np.uint8)
    size = np.fromiter(map(len, context), np.int64, n)
    before = at - lo
    flat = np.frombuffer(b"".join(context), np.uint8)
    own = np.repeat(np.arange(n), size)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(left - before, size)
    text[own, col] = flat
    after = size - before
    cover = np.zeros((n, left + 2), np.int32)
    for d in range(1, n):
        i = np.flatnonzero(b[d:] == b[:-d])
        if not len(i):
            break
        for k in range(0, len(i), 20_000):
            x = i[k : k + 20_000]
            y = x + d  # the later one
            same = text[x] == text[y]
            back = np.argmin(np.concatenate([same[:, :left][:, ::-1], np.zeros((len(x), 1), bool)], axis=1), axis=1)
            on = np.argmin(np.concatenate([same[:, left:], np.zeros((len(x), 1), bool)], axis=1), axis=1)
            back, on = np.minimum(back, np.minimum(before[x], before[y])), np.minimum(on, np.minimum(after[x], after[y]))
            ok = back + on >= length
            np.add.at(cover, (y[ok], left - back[ok]), 1)
            np.add.at(cover, (y[ok], on[ok] - length + left + 1), -1)
    inside = np.cumsum(cover, axis=1) > 0
    edge = np.diff(np.concatenate([np.zeros((n, 1), np.int8), inside.astype(np.int8)], axis=1), axis=1)
    who, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1] - 1
    return row[who], at[who] - left + first, at[who] - left + last


def _pairwise(batches, length):
    """``_held`` of rows sorted by bucket, a run of whole buckets at a time."""
    rest = None

    def out(t):
        cols = [t.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        found = _held(*cols, t.column(5).to_pylist(), length)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["row", "lo", "hi"])

    for batch in batches:
        t = batch if rest is None else pa.concat_batches([rest, batch])
        b = t.column(0).to_numpy()
        whole = int(np.searchsorted(b, b[-1])) if len(b) else 0
        rest = t.slice(whole)
        for i in _blocks(b[:whole]):
            yield out(t.slice(*i))
    if rest is not None and len(rest):
        yield out(rest)


def _blocks(b: np.ndarray, most: int = 20_000):
    """``(offset, length)`` of runs of whole buckets of some ``most`` rows."""
    i = 0
    while i < len(b):
        j = len(b) if i + most >= len(b) else int(np.searchsorted(b, b[i + most], "right"))
        yield i, j - i
        i = j


def _ids(batches):
    for b in batches:
        x = _row_id(*(b.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64))], ["x"])


#: Starts that are looked at together: what their strings have in common is looked up first.
STEP = 6


def _runs(lo: int, hi: int, at: int, length: int):
    """Runs of starts by how far before the suffix they are: ``(first, last, from, to)``, the latter two what all strings of a whole run share."""
    for g in range((at - hi) // STEP, (at - lo) // STEP + 1):
        least, most = at - (g + 1) * STEP + 1, at - g * STEP
        yield max(lo, least), min(hi, most), most - lo, least + length - lo


def _common(batches, length):
    """For each run of STEP starts in a context the identifier of what all its strings have in common."""
    digest = xxhash.xxh3_64_intdigest
    for b in batches:
        found = [(digest(c[i:j]), r, x + i) for r, x, y, z, c in zip(*(b.column(i).to_pylist() for i in range(5))) for _, _, i, j in _runs(x, y, z, length)]
        key = np.array([f[0] for f in found], np.uint64).view(np.int64)
        row, at = (np.array([f[i] for f in found], np.int64) for i in (1, 2))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(_row_id(row, at, key).view(np.int64))], ["key", "x"])


def _spans(batches, length, repeated, firsts=None, again=None):
    """Runs whose common part is in the filter ``repeated``, each with the identifier of all the bytes of its strings.

    With ``firsts``: the single strings of the runs in that filter, and with ``again`` those of them in it.
    """
    digest = xxhash.xxh3_64_intdigest
    for b in batches:
        rows = b.column(1).to_numpy()
        lo, hi, at, context = (b.column(i).to_pylist() for i in range(2, 6))
        runs = [(k, *r) for k, (x, y, z) in enumerate(zip(lo, hi, at)) for r in _runs(x, y, z, length)]
        common = np.fromiter((digest(context[k][i:j]) for k, _, _, i, j in runs), np.uint64, len(runs))
        runs = [runs[i] for i in np.flatnonzero(in_bitmap(repeated.value, common)).tolist()]
        of = np.array([r[0] for r in runs], np.int64)
        first, last = (np.array([r[i] for r in runs], np.int64) for i in (1, 2))
        key = np.fromiter((digest(context[k][x - lo[k] : y - lo[k] + length]) for k, x, y, _, _ in runs), np.uint64, len(runs))
        if firsts is not None:
            some = np.flatnonzero(in_bitmap(firsts.value, _row_id(rows[of], first, key.view(np.int64)))) if len(of) else of
            of, first, last = of[some], first[some], last[some]
            n = last - first + 1
            of, first = np.repeat(of, n), np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else first, n) + np.arange(n.sum())
            some = np.unique(_row_id(rows[of], first, np.zeros(len(of), np.int64)), return_index=True)[1]  # several suffixes reach the same string
            of, first = of[some], first[some]
            last = first
            key = np.fromiter((digest(context[k][x - lo[k] : x - lo[k] + length]) for k, x in zip(of.tolist(), first.tolist())), np.uint64, len(of))
            if again is not None:
                some = in_bitmap(again.value, key)
                of, first, last, key = of[some], first[some], last[some], key[some]
        for i in range(0, len(of), 500_000):
            r = pa.array(of[i : i + 500_000])
            part = [x[i : i + 500_000] for x in (first, last, key.view(np.int64))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(r), b.column(1).take(r), *map(pa.array, part), pa.array(_row_id(rows[of[i : i + 500_000]], part[0], part[2]).view(np.int64))], ["doc_id", "row", "lo", "hi", "key", "x"])


def repeated_starts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(row, lo, hi)``: every ``length``-byte string of the row that starts in lo..hi also starts earlier. ``docs`` has doc_id, row and text.

    1. Sampled suffixes fall into buckets by their first Q bytes, whose identifiers come by doubling; buckets of one suffix end here.
    2. Buckets are refined by the identifiers of the buckets at later offsets, and at earlier ones, up to all bytes that a
       string with this suffix can reach: a sort by bucket, refined bucket and place. All but the first of a refined bucket only hold strings of the first.
    3. Firsts that share a bucket of PAIRWISE refined ones at most are held against each other byte by byte.
    4. Larger buckets are refined by runs of STEP neighbouring strings: by the identifiers of
       what these have in common, then of all their bytes. All but the first of equal runs
       repeat it; firsts that still share a common part are refined by their single strings.

    What agrees within a batch is settled before any shuffle, so that a frequent passage is few rows in it. Refined
    buckets are told apart by 128 bits, runs and strings of large buckets by 64. Filters of fixed size spare rows;
    they let some others through, and an exact join or sort decides.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    share = spark.sparkContext.broadcast
    own = docs.select("doc_id", "row", "text")

    def repeats(keys: DataFrame) -> np.ndarray:
        """A filter of the keys that stand at different places ``x``."""
        found = bitmap(keys.groupBy("key").agg(F.min("x").alias("a"), F.max("x").alias("b")).where("a < b"), "key")
        freed(spark)
        return found

    counts = docs.select("text").mapInArrow(lambda it: _count(it, length), "key long, n long")
    many = share(bitmap(counts.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"), "key", FILTER))
    freed(spark)
    at = F.struct("doc_id", "row", "lo")
    found = own.mapInArrow(lambda it: _suffixes(it, length, many), f"doc_id {kind}, row long, b long, cls long, lo long, hi long, at long")
    found = stored(found, "suffixes")
    later = found.where("b IS NULL").select("row", "lo", "hi")
    nth = F.row_number().over(Window.partitionBy("b", "cls").orderBy(F.col("doc_id").asc_nulls_first(), "row", "at"))
    ranked = stored(found.where("b IS NOT NULL").withColumn("nth", nth).select("row", "b", "lo", "hi", "at", "nth"), "ranked")
    later = stored(later.unionByName(ranked.where("nth > 1").select("row", "lo", "hi")), "later")
    dropped(found)
    freed(spark)
    mixed = stored(ranked.where("nth = 1").groupBy("b").agg(F.count("*").alias("m")).where("m > 1"), "mixed")
    firsts = ranked.where("nth = 1").join(mixed.select("b"), "b", "left_semi").select("row", "at", F.lit(0).cast("long").alias("z"))
    firsts = share(bitmap(firsts.mapInArrow(_ids, "x long"), "x", FILTER))
    freed(spark)
    source = own.mapInArrow(lambda it: _contexts(it, length, many, firsts), f"doc_id {kind}, row long, b long, lo long, hi long, at long, context binary")
    source = stored(source, "contexts")
    dropped(ranked)
    many.destroy()
    firsts.destroy()
    freed(spark)
    # the window keeps a bucket together and sorted
    small = source.join(mixed.where(F.col("m") <= PAIRWISE).select("b"), "b").withColumn("nth", F.row_number().over(Window.partitionBy("b").orderBy(F.col("doc_id").asc_nulls_first(), "row", "at")))
    held = stored(small.select("b", "row", "lo", "hi", "at", "context", "nth").mapInArrow(lambda it: _pairwise(it, length), "row long, lo long, hi long"), "held")
    freed(spark)
    large = mixed.where(F.col("m") > PAIRWISE).select("b")
    if large.isEmpty():
        dropped(source, mixed)
        return later.unionByName(held)
    every, source = source, stored(source.join(large, "b", "left_semi").select("doc_id", "row", "lo", "hi", "at", "context"), "contexts")
    dropped(every, mixed)
    freed(spark)
    common = source.select("row", "lo", "hi", "at", "context").mapInArrow(lambda it: _common(it, length), "key long, x long")
    common = share(repeats(common))
    schema = f"doc_id {kind}, row long, lo long, hi long, key long, x long"

    def after_first(found: DataFrame, first: DataFrame) -> DataFrame:
        return found.join(first, "key").where(at > F.col("first")).select("row", "lo", "hi")

    spans = stored(source.mapInArrow(lambda it: _spans(it, length, common), schema).drop("x"), "spans")
    first = stored(spans.groupBy("key").agg(F.min(at).alias("first"), F.count("*").alias("n")), "firsts")
    freed(spark)
    equal = stored(after_first(spans, first.where("n > 1").select("key", "first")), "later")
    dropped(spans)
    heads = share(bitmap(first.select("first.row", "first.lo", "key").mapInArrow(_ids, "x long"), "x"))
    dropped(first)
    freed(spark)
    again = share(repeats(source.mapInArrow(lambda it: _spans(it, length, common, heads), schema).select("key", "x")))
    strings = stored(source.mapInArrow(lambda it: _spans(it, length, common, heads, again), schema).drop("x"), "strings")
    dropped(source)
    for x in (common, heads, again):
        x.destroy()
    freed(spark)
    first = stored(strings.groupBy("key").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first < last").select("key", "first"), "firsts")
    single = stored(after_first(strings, first), "later")
    dropped(strings, first)
    freed(spark)
    return later.unionByName(held).unionByName(equal).unionByName(single)


def _merged(starts: list, length: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes that the strings starting in the given ranges cover."""
    out: list[list[int]] = []
    for lo, hi in sorted(starts):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + length)
        else:
            out.append([lo, hi + length])
    return [(a, b) for a, b in out]


def _cut(batches, length):
    for b in batches:
        out, spans = [], []
        for text, starts in zip(b.column(1).cast(pa.large_binary()).to_pylist(), b.column(2).to_pylist()):
            runs = _merged([(x["lo"], x["hi"]) for x in starts or []], length)
            at, kept = 0, []
            for x, y in runs:
                kept.append((text or b"")[at:x])
                at = y
            out.append(b"".join([*kept, (text or b"")[at:]]))
            spans.append([{"start": x, "end": y} for x, y in runs])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t or b"") for t in b.column(1).cast(pa.large_binary()).to_pylist()], pa.int64()), pa.array(out, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "n_bytes", "kept", "spans"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``(doc_id, n_bytes, kept binary, spans array<struct<start, end>>)``, one row per input row.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document
    before (by id, null first; rows of one id in the order of the input) or in the same
    one. Texts are UTF-8 bytes, null is empty; strings never cross documents, and are judged on the
    input, so a run may cut a character in two. Texts shorter than ``length`` are kept. Texts of any length are read whole, a block at a time. Other columns,
    of whatever names, are ignored; an empty table gives none.
    """
    docs = settled(docs).select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    starts = repeated_starts(docs, length).groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("starts"))
    starts = stored(starts.withColumnRenamed("row", "at"), "starts")
    freed(docs.sparkSession)
    touched = docs.sparkSession.sparkContext.broadcast(bitmap(starts.select(F.xxhash64("at").alias("h")), "h"))
    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, kept binary, spans array<struct<start:long,end:long>>"

    def whole(batches):
        """Texts that lose nothing aren't shuffled."""
        for b in batches:
            b = b.filter(pa.array(~in_bitmap(touched.value, b.column(2).to_numpy().view(np.uint64))))
            yield from _cut([pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.nulls(len(b))], ["doc_id", "text", "starts"])], length)

    def others(batches):
        for b in batches:
            yield b.filter(pa.array(in_bitmap(touched.value, b.column(2).to_numpy().view(np.uint64))))

    hashed = docs.select("doc_id", "text", F.xxhash64("row").alias("h"), "row")
    some = hashed.mapInArrow(others, hashed.schema)
    both = some.join(starts, F.col("row") == F.col("at"), "left").select("doc_id", "text", "starts")
    return hashed.mapInArrow(whole, out).unionByName(both.mapInArrow(lambda it: _cut(it, length), out))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
