"""Sequence functions as column expressions; only minimizers leave the JVM, as Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: FNV-1a, 32 bits.
FNV_BASIS, FNV_PRIME = 2166136261, 16777619


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def edit_distance(a: str | Column, b: str | Column) -> Column:
    return F.levenshtein(_col(a), _col(b))


def similarity(a: str | Column, b: str | Column) -> Column:
    """1 - edit distance / longer length; two empty sequences are equal."""
    a, b = _col(a), _col(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def similar(a: str | Column, b: str | Column, least: float, strict: bool = False) -> Column:
    """Whether the similarity is ``least`` or more (``strict``: more), by lengths first, then by a banded edit distance."""
    a, b = _col(a), _col(b)
    longest = F.greatest(F.length(a), F.length(b))
    room = (1 - least) * longest
    most = (F.ceil(room - 1e-9) - 1 if strict else F.floor(room + 1e-9)).cast("int")
    return (most >= 0) & (F.abs(F.length(a) - F.length(b)) <= most) & (F.call_function("levenshtein", a, b, most) >= 0)


def reverse_complement(seq: str | Column, keep_unknown: bool = False) -> Column:
    """Upper-case reverse complement; other letters become N, or stay as they are."""
    turned = F.translate(F.reverse(_col(seq)), "ACGTacgt", "TGCATGCA")
    return turned if keep_unknown else F.regexp_replace(turned, "[^ACGT]", "N")


def kmer_hash(kmer: str | Column) -> Column:
    """FNV-1a of the characters, as an unsigned 32-bit number in a long."""
    chars = F.transform(F.filter(F.split(_col(kmer), ""), lambda c: c != ""), F.ascii)
    return F.aggregate(chars, F.lit(FNV_BASIS).cast("long"), lambda h, c: (h.bitwiseXOR(c.cast("long")) * FNV_PRIME).bitwiseAND(0xFFFFFFFF))


def minimizers(seq: str | Column, k: int = 15, window: int = 10) -> Column:
    """Distinct window minima of the k-mer hashes, sorted; fewer k-mers than a window give their least, none gives an empty array, null gives null.

    An Arrow kernel: a letter's step of the hash is taken for all k-mers of many sequences at once, of up to ``letters`` (or one sequence).
    """

    def some(seq: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        code = np.frombuffer("".join(seq.to_pylist()).encode("utf-32-le"), np.uint32)
        size = pc.utf8_length(seq).to_numpy(zero_copy_only=False).astype(np.int64)
        first, n, m = np.cumsum(size) - size, np.maximum(size - k + 1, 0), len(code) - k + 1
        if m < 1:
            return np.zeros(0, np.int64), np.zeros(len(seq), np.int64)
        h = np.full(m, FNV_BASIS, np.uint32)
        for j in range(k):
            h = (h ^ code[j : j + m]) * np.uint32(FNV_PRIME)
        low, ends = h.copy(), np.concatenate([h, np.full(window, 0xFFFFFFFF, np.uint32)])
        for j in range(1, window):
            np.minimum(low, ends[j : j + m], out=low)
        few = np.flatnonzero((n > 0) & (n < window))
        for j in range(window if len(few) else 0):
            least = h[first[few] + np.minimum(j, n[few] - 1)] if not j else np.minimum(least, h[first[few] + np.minimum(j, n[few] - 1)])
        if len(few):
            low[first[few]] = least
        count = np.where(n > 0, np.maximum(n - window + 1, 1), 0)
        row = np.repeat(np.arange(len(seq)), count)
        at = np.arange(len(row)) + np.repeat(first - (np.cumsum(count) - count), count)
        key = np.unique(row.astype(np.uint64) << np.uint64(32) | low[at].astype(np.uint64))
        return (key & np.uint64(0xFFFFFFFF)).astype(np.int64), np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=len(seq))

    @F.arrow_udf("array<bigint>")
    def minima(seq: pa.Array) -> pa.Array:
        text, letters = pc.fill_null(seq, ""), 1 << 22
        upto = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(upto // letters)) + 1).tolist(), len(text)]
        parts = [some(text[i:j]) for i, j in zip(cuts, cuts[1:]) if i < j]
        counts = np.concatenate([np.zeros(1, np.int64), *(c for _, c in parts)])
        values = np.concatenate([np.zeros(0, np.int64), *(v for v, _ in parts)])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(counts).astype(np.int32)), pa.array(values), mask=seq.is_null() if seq.null_count else None)

    return minima(_col(seq))


def register(spark) -> None:
    """The same as SQL functions: seq_similarity, rev_comp, kmer_hash, minimizers."""
    fnv = f"aggregate(transform(sequence({{}}, {{}}), j -> CAST(ascii(substring(s, j, 1)) AS BIGINT)), {FNV_BASIS}L, (h, c) -> ((h ^ c) * {FNV_PRIME}L) & 4294967295L)"
    hashes = f"transform(sequence(1, length(s) - k + 1), i -> {fnv.format('i', 'i + k - 1')})"
    minima = "array_sort(array_distinct(transform(sequence(1, greatest(size(x) - w + 1, 1)), i -> array_min(slice(x, i, w)))))"
    for name, body in (
        ("seq_similarity(a STRING, b STRING) RETURNS DOUBLE", "CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0D ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END"),
        ("rev_comp(s STRING) RETURNS STRING", "regexp_replace(translate(reverse(s), 'ACGTacgt', 'TGCATGCA'), '[^ACGT]', 'N')"),
        ("kmer_hash(s STRING) RETURNS BIGINT", f"CASE WHEN length(s) = 0 THEN {FNV_BASIS}L ELSE {fnv.format('1', 'length(s)')} END"),
        ("minimizers(s STRING, k INT, w INT) RETURNS ARRAY<BIGINT>", f"CASE WHEN length(s) < k THEN array() ELSE transform(array({hashes}), x -> {minima})[0] END"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURN {body}")
