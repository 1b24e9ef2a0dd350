"""Language-model scoring by a hierarchical Pitman-Yor model of spelled-out tokens.

Tokens are words, lower-cased, and an end. Words are drawn byte by byte, so that words never seen
have a probability too: a text is its words with a space after each but the last, then
the end, and each byte is drawn from the restaurant of the ORDER bytes before it. A context's
restaurant shares its parent, the context without its first byte, with all contexts that
end alike; the empty context draws from the uniform distribution.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import is_remainder, stored, table, words

ORDER = 5
END = 10
#: Contexts are dealt out by their last two bytes; restaurants of fewer bytes are few enough for the driver.
UPPER = 2
#: Below this many customers the number of a dish's tables is drawn from its exact conditional.
EXACT = 64
#: Entries of the tables of frequent keys that each scoring task holds.
SLOTS = 1 << 21
#: Rounds between the restaurants below and above, sweeps in each before a sample counts, and samples.
ROUNDS, BURN, SAMPLES = 3, 3, 4
#: Bytes, or distinct keys, that a task works on at a time.
CHUNK, KEPT = 1 << 22, 2_000_000


def spelled(text: str | None) -> bytes:
    return b" ".join(words(text)) + b"\n"


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of the texts with the ORDER bytes before it (ends, before a text) as one number, and where texts begin."""
    pad = b"\n" * ORDER
    a = np.frombuffer(pad + pad.join(texts), np.uint8)
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    key = np.zeros(len(a) - ORDER, np.int64)
    for i in range(ORDER + 1):
        key = (key << 8) | a[i : len(a) - ORDER + i]
    first = np.concatenate(([0], np.cumsum(n + ORDER)[:-1]))
    keep = np.ones(len(key), bool)
    for i in range(ORDER):
        keep[first[1:] - 1 - i] = False
    return key[keep], np.concatenate(([0], np.cumsum(n)[:-1]))


def word_keys(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)).view(np.int64)


def _stirling(d: float) -> np.ndarray:
    """Logs of the generalised Stirling numbers: ways, by weight, to seat c customers at t tables."""
    s = np.full((EXACT + 1, EXACT + 1), -np.inf)
    s[0, 0] = 0.0
    for c in range(EXACT):
        t = np.arange(1, c + 2)
        s[c + 1, 1 : c + 2] = np.logaddexp(s[c, 0 : c + 1], np.log(np.maximum(c - t * d, 1e-300)) + s[c, 1 : c + 2])
    return s


def seat(c: np.ndarray, base: np.ndarray, others: np.ndarray, d: float, theta: float, stirling: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The number of tables of dishes with ``c`` customers, given the parent's probabilities and the other tables of the restaurant.

    Up to EXACT customers it is a Gibbs draw of the whole seating of a dish, whose
    arrangements the Stirling numbers sum up. The customers beyond come in after those, in
    groups of a twentieth of those seated, each to a new table or not.
    """
    t = np.minimum(c, 1).astype(np.int64)
    small = np.minimum(c, EXACT)
    order = np.argsort(small, kind="stable")
    edges = np.searchsorted(small[order], np.arange(2, EXACT + 2))
    for n, a, b in zip(range(2, EXACT + 1), edges, edges[1:]):
        for i in range(a, b, 200_000):
            at = order[i : min(b, i + 200_000)]
            j = np.arange(n)
            w = np.cumsum(np.log(theta + d * (others[at, None] + j)) + np.log(base[at, None]), axis=1) + stirling[n, 1 : n + 1]
            w = np.cumsum(np.exp(w - w.max(1, keepdims=True)), axis=1)
            t[at] = 1 + (w < rng.random(len(at))[:, None] * w[:, -1:]).sum(1)
    at = np.flatnonzero(c > EXACT)
    seated = np.full(len(at), EXACT, np.int64)
    while len(at):
        new = np.minimum(np.maximum(1, seated // 20), c[at] - seated)
        fresh = (theta + d * (others[at] + t[at])) * base[at]
        t[at] += rng.binomial(new, fresh / (fresh + seated - d * t[at]))
        seated += new
        more = seated < c[at]
        at, seated = at[more], seated[more]
    return t


class Level:
    """Dishes of the contexts of one length: ``key`` holds the context and the dish; ``up`` is a dish's place in the level above."""

    def __init__(self, key: np.ndarray, order: int) -> None:
        self.key, self.order = key, order
        self.context, self.of = np.unique(key >> 8, return_inverse=True)

    def link(self, upper: Level) -> None:
        self.up = np.searchsorted(upper.key, self.key & ((1 << (8 * self.order)) - 1))

    def totals(self) -> None:
        self.c_all = np.bincount(self.of, self.c, len(self.context))
        self.t_all = np.bincount(self.of, self.t, len(self.context))

    def predictive(self, base: np.ndarray, d: float, theta: float) -> np.ndarray:
        return (self.c - d * self.t + (theta + d * self.t_all[self.of]) * base) / (theta + self.c_all[self.of])


class Restaurants:
    """The restaurants of contexts from ``top`` bytes up to ``order``, under a parent whose probabilities are given."""

    def __init__(self, key: np.ndarray, n: np.ndarray, order: int, top: int, discounts: list[float], theta: float = 1.0, seed: int = 0) -> None:
        o = np.argsort(key)
        self.levels = [Level(key[o], order)]
        for m in range(order - 1, top - 1, -1):
            self.levels.append(Level(np.unique(self.levels[-1].key & ((1 << (8 * (m + 1))) - 1)), m))
            self.levels[-2].link(self.levels[-1])
        self.n, self.d, self.theta, self.rng = n[o].astype(np.int64), discounts, theta, np.random.default_rng(seed)
        self.stirling = {m: _stirling(discounts[m]) for m in range(top, order + 1)}
        c = self.n
        for level in self.levels:  # at first one table for each dish
            level.c, level.t = c, np.minimum(c, 1)
            level.totals()
            if level is not self.levels[-1]:
                c = np.bincount(level.up, level.t, len(self.levels[self.levels.index(level) + 1].key)).astype(np.int64)

    def predictive(self, base: np.ndarray) -> list[np.ndarray]:
        """Probabilities of all dishes, from the longest contexts up; ``base`` has the parent's for the last level."""
        out = []
        for level in reversed(self.levels):
            base = level.predictive(base if not out else out[-1][level.up], self.d[level.order], self.theta)
            out.append(base)
        return out[::-1]

    def sweep(self, base: np.ndarray) -> None:
        """Seat the customers of all dishes anew, those of longer contexts first: each of their tables is a customer above."""
        p = [*self.predictive(base)[1:], base]
        for i, level in enumerate(self.levels):
            above = p[i][level.up] if i + 1 < len(self.levels) else base
            level.t = seat(level.c, np.maximum(above, 1e-300), level.t_all[level.of] - level.t, self.d[level.order], self.theta, self.stirling[level.order], self.rng)
            level.totals()
            if i + 1 < len(self.levels):
                upper = self.levels[i + 1]
                upper.c = np.bincount(level.up, level.t, len(upper.key)).astype(np.int64)
                upper.t = np.minimum(np.maximum(upper.t, np.minimum(upper.c, 1)), upper.c)
                upper.totals()


def sample(key: np.ndarray, n: np.ndarray, order: int, top: int, base_of, discounts: list[float], seed: int) -> tuple[np.ndarray, np.ndarray, Restaurants]:
    """Averages over samples: the probability of each key (in sorted order), and the customers that the top level sends above."""
    r = Restaurants(key, n, order, top, discounts, seed=seed)
    base = base_of(r.levels[-1].key)
    for _ in range(BURN):
        r.sweep(base)
    p, t = np.zeros(len(key)), np.zeros(len(r.levels[-1].key))
    for _ in range(SAMPLES):
        r.sweep(base)
        p += r.predictive(base)[0] / SAMPLES
        t += r.levels[-1].t / SAMPLES
    return p, t, r


def upper_model(sent: np.ndarray, discounts: list[float], seed: int) -> np.ndarray:
    """Averaged probabilities of a byte after a byte, from the customers sent by longer contexts (both 256 x 256)."""
    key = np.arange(1 << 16)
    p, _, _ = sample(key, np.rint(sent).astype(np.int64).ravel(), 1, 0, lambda k: np.full(len(k), 1 / 256), discounts, seed)
    return p.reshape(256, 256)


class Tally:
    """Sums by key that are handed on whenever more than KEPT keys have come together."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, key: np.ndarray, n: np.ndarray | None = None) -> None:
        u, i = np.unique(key, return_inverse=True)
        self.parts.append((u, np.bincount(i, n, len(u)).astype(np.int64)))
        self.size += len(u)
        if self.size > KEPT:
            self.merge()

    def merge(self) -> None:
        if len(self.parts) > 1:
            key, n = (np.concatenate(x) for x in zip(*self.parts))
            u, i = np.unique(key, return_inverse=True)
            self.parts = [(u, np.bincount(i, n, len(u)).astype(np.int64))]
        self.size = sum(len(k) for k, _ in self.parts)

    def taken(self, least: int = 0):
        self.merge()
        if self.size > least:
            for k, n in self.parts:
                for i in range(0, len(k), 500_000):
                    yield k[i : i + 500_000], n[i : i + 500_000]
            self.parts, self.size = [], 0


def _pieces(texts: list[str | None]):
    """Runs of texts of CHUNK bytes together, as ``(from, to)``; a longer text is a run of its own."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > CHUNK:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _counts(batches):
    kinds = (Tally(), Tally())

    def out(least):
        for kind, tally in enumerate(kinds):
            for k, n in tally.taken(least):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n)], ["kind", "key", "n"])

    for b in batches:
        held, texts = np.array(b.column(0).to_pylist(), bool), b.column(1).to_pylist()
        for i, j in _pieces(texts):
            found = [spelled(t) for t in texts[i:j]]
            key, first = grams(found)
            learnt = np.repeat(~held[i:j], np.diff(np.concatenate((first, [len(key)]))))
            kinds[0].add(key, learnt)
            kinds[1].add(np.concatenate([word_keys([*x.split(), b"\n"]) for x, h in zip(found, held[i:j]) if not h] or [np.zeros(0, np.int64)]))
            yield from out(KEPT)
    yield from out(0)


def _slot(key: np.ndarray) -> np.ndarray:
    x = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def _frequent(df: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
    """In each of SLOTS slots the most frequent key that falls there, and its value: a table of fixed size."""

    def slots(batches):
        for b in batches:
            k = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(_slot(k)), b.column(0), b.column(1), b.column(2)], ["slot", "key", "value", "n"])

    kind = df.schema[value].dataType.simpleString()
    rows = df.select("key", value, "n").mapInArrow(slots, f"slot long, key long, value {kind}, n long")
    best = rows.groupBy("slot").agg(F.max(F.struct("n", "key", "value")).alias("x")).select("slot", "x.key", "x.value").toArrow()
    key, out = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, np.float64)
    at = best["slot"].to_numpy()
    key[at], out[at] = best["key"].to_numpy(), best["value"].to_numpy()
    return key, out


def _looked_up(batches, frequent):
    """A row for each document, and a row for each of its keys that isn't in the tables of frequent ones."""
    (gram_key, gram_value), (word_key, word_count), end = frequent.value
    names = ["row", "doc_id", "held_out", "n_tokens", "kind", "key", "n", "known", "base", "score"]
    total = end["total"]
    for b in batches:
        texts = b.column(3).to_pylist()
        for i, j in _pieces(texts):
            found = [spelled(t) for t in texts[i:j]]
            key, first = grams(found)
            size = np.diff(np.concatenate((first, [len(key)])))
            sums = np.zeros((j - i, 3))
            n_tokens = np.zeros(j - i, np.int64)
            cold_doc, cold_kind, cold_key = [], [], []
            slot = _slot(key)
            hit = gram_key[slot] == key
            doc = np.repeat(np.arange(j - i), size)
            sums[:, 2] = np.bincount(doc, np.where(hit, gram_value[slot], 0.0), j - i)
            cold_doc.append(doc[~hit])
            cold_key.append(key[~hit])
            cold_kind.append(np.zeros((~hit).sum(), np.int32))
            each = [word_keys([*x.split(), b"\n"]) for x in found]
            n_tokens[:] = list(map(len, each))
            key, doc = np.concatenate(each), np.repeat(np.arange(j - i), n_tokens)
            slot = _slot(key)
            hit = word_key[slot] == key
            c = word_count[slot]
            sums[:, 0] = np.bincount(doc, hit & (c > 0), j - i)
            sums[:, 1] = np.bincount(doc, np.where(hit, np.log10((c + 0.1) / total), 0.0), j - i)
            cold_doc.append(doc[~hit])
            cold_key.append(key[~hit])
            cold_kind.append(np.ones((~hit).sum(), np.int32))
            some = pa.array(np.arange(i, j))
            none = pa.nulls(j - i, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(some), b.column(1).take(some), b.column(2).take(some), pa.array(n_tokens), pa.nulls(j - i, pa.int32()), none, none, pa.array(sums[:, 0].astype(np.int64)), pa.array(sums[:, 1]), pa.array(sums[:, 2])], names)
            at = pd.DataFrame({"doc": np.concatenate(cold_doc), "kind": np.concatenate(cold_kind), "key": np.concatenate(cold_key)}).value_counts(sort=False).reset_index()
            for k in range(0, len(at), 500_000):
                x = at.iloc[k : k + 500_000]
                n = len(x)
                rows = pa.array(x["doc"].to_numpy() + i)
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pa.nulls(n, b.schema.types[1]), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.int64()), pa.array(x["kind"].to_numpy(np.int32)), pa.array(x["key"].to_numpy()), pa.array(x["count"].to_numpy(np.int64)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64())], names)


def train(keys: DataFrame) -> DataFrame:
    """``(key, n, value)`` with the log10 of each key's averaged probability, from ``(key, n)`` of ORDER + 1 bytes.

    Keys are dealt out by the last two bytes of their contexts, whole restaurants and their
    ancestors down to two bytes together, in groups of some 250,000. In each round the groups
    sample their seatings, given the restaurants above; these take their customers at
    the driver (256 x 256 dishes at most) and sample theirs. Discounts follow the numbers of dishes with one and two customers.
    """
    n = keys.count()
    dealt = stored(keys.withColumn("deal", F.pmod(F.xxhash64(F.shiftright("key", 8).bitwiseAND((1 << (8 * UPPER)) - 1)), F.lit(max(1, n // 250_000 + 1)))), "dealt")
    discounts, above = [0.5] * (ORDER + 1), np.full((256, 256), 1 / 256)
    for turn in range(ROUNDS):
        last = turn == ROUNDS - 1
        held = dealt.sparkSession.sparkContext.broadcast((list(discounts), above))

        def seated(pdf: pd.DataFrame) -> pd.DataFrame:
            discounts, above = held.value
            key, n = pdf["key"].to_numpy(), pdf["n"].to_numpy()
            p, t, r = sample(key, n, ORDER, UPPER, lambda k: above.ravel()[k & 0xFFFF], discounts, int(pdf["deal"].iloc[0]) * 100 + turn)
            if last:
                return pd.DataFrame({"kind": 0, "key": r.levels[0].key, "n": r.n, "value": np.log10(p)})
            sent = np.bincount(r.levels[-1].key & 0xFFFF, t, 1 << 16)
            at = np.flatnonzero(sent)
            ones = [(x.order * 2 + k, float((x.c == k + 1).sum())) for x in r.levels for k in (0, 1)]
            return pd.DataFrame({"kind": [1] * len(at) + [2] * len(ones), "key": [*at.tolist(), *(k for k, _ in ones)], "n": 0, "value": [*sent[at].tolist(), *(v for _, v in ones)]})

        out = dealt.groupBy("deal").applyInPandas(seated, "kind int, key long, n long, value double")
        if last:
            return stored(out.select("key", "n", "value"), "scored")
        sent, ones = np.zeros(1 << 16), np.zeros((ORDER + 1, 2))
        for kind, key, value in out.groupBy("kind", "key").agg(F.sum("value")).collect():
            if kind == 1:
                sent[key] = value
            else:
                ones[key // 2, key % 2] = value
        for m in range(UPPER, ORDER + 1):
            discounts[m] = float(np.clip(ones[m, 0] / (ones[m, 0] + 2 * ones[m, 1] + 1), 0.05, 0.95))
        above = upper_model(sent.reshape(256, 256), discounts, turn)


def scored(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row.

    The model learns from all rows for which the boolean column ``held_out`` is false, whole
    texts; counts of words and of byte strings are sums over all of them. ``score`` is the
    log10 probability of the text's tokens, averaged over samples; ``base_score`` that of
    single tokens, with 0.1 added. A null text is an empty one: an end alone. Without rows to learn
    from, the model is the uniform distribution over bytes. Words are told apart by 64-bit
    hashes. Repeated rows are rows of their own; other columns are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    counts = stored(rows.select("held_out", "text").mapInArrow(_counts, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    model = train(counts.where("kind = 0").select("key", "n"))
    single = counts.where("kind = 1").select("key", "n", F.col("n").cast("double").alias("value"))
    n, v = single.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total = n + 0.1 * (v + 1)
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast((_frequent(model, "value"), _frequent(single, "value"), {"total": total}))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(lambda it: _looked_up(it, frequent), f"row long, doc_id {kind}, held_out boolean, n_tokens long, kind int, key long, n long, known long, base double, score double")
    found = stored(found, "looked-up")
    values = model.select(F.lit(0).alias("kind"), "key", "value").unionByName(single.select(F.lit(1).alias("kind"), "key", "value"))
    cold = found.where("kind IS NOT NULL").select("row", "kind", "key", "n").join(values, ["kind", "key"], "left")
    word = F.col("kind") == 1
    cold = cold.groupBy("row").agg(
        F.sum(F.when(word & (F.col("value") > 0), F.col("n")).otherwise(0)).alias("k"),
        F.sum(F.when(word, F.col("n") * F.log10((F.coalesce("value", F.lit(0.0)) + 0.1) / total)).otherwise(0.0)).alias("b"),
        F.sum(F.when(~word, F.col("n") * F.col("value")).otherwise(0.0)).alias("s"),
    )
    own = found.where("kind IS NULL").drop("kind", "key", "n")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return own.join(cold, "row", "left").select("doc_id", "held_out", "n_tokens", plus("known", "k").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), plus("base", "b").alias("base_score"), plus("score", "s").alias("score"))


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(table(spark, sf_dir, "documents"), is_remainder("doc_id", 10, 0))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
