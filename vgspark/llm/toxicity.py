"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, is_remainder, stored, table, words

WINDOW = 48
#: Bytes of the n-grams whose document frequency picks what the dictionaries learn from.
GRAM = 7
#: A task counts the n-grams of so many bytes of text at a time (or of one text).
COUNTED = 1 << 20


@dataclass
class Settings:
    """``fit_rows``: labelled rows of each label at most that each dictionary, and the calibration, learns from.

    That is the only bound: the dictionaries learn from all windows of the rows' whole texts, and calibration and scoring read whole texts.
    The bars for n-grams are the same at every size: ``effect`` is of the difference of the classes' shares, in units of the spread of
    one row where both labels are as frequent, so that it doesn't follow their mix in the sample; ``deviations`` is how sure that difference must be.
    """

    fit_rows: int = 4000
    shared_bytes: int = 16384
    class_bytes: int = 3072
    contrast: float = 2.5
    least_docs: int = 6
    deviations: float = 3.5
    effect: float = 0.2
    threshold: float = 0.3


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    shared: bytes
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """The whole text, lower-cased and single-spaced, cut at spaces into windows of ``size`` bytes at most."""
    b = b" ".join(words(text))
    out, i, n = [], 0, len(b)
    while i < n:
        j = i + size
        if j < n:
            k = b.rfind(b" ", i, j + 1)
            j = k if k > i else j
        out.append(b[i:j])
        i = j
    return out


def _packed(b: bytes) -> np.ndarray:
    """Every GRAM-byte string of ``b`` as a number."""
    a = np.frombuffer(b, np.uint8).astype(np.uint64)
    n = len(a) - GRAM + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(GRAM if n > 0 else 0):
        out = (out << np.uint64(8)) | a[i : i + n]
    return out


def _counted(texts: list[tuple[bool, bytes]]) -> pa.RecordBatch:
    """The n-grams of ``texts``, and in how many toxic and how many other ones each is."""
    parts: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]]
    for toxic, b in texts:
        parts[not toxic].append(np.unique(_packed(b)))
    (x, n), (y, m) = (np.unique(np.concatenate(p), return_counts=True) for p in parts)
    grams = np.union1d(x, y)
    counts = [np.zeros(len(grams), np.int64) for _ in parts]
    for c, g, k in zip(counts, (x, y), (n, m)):
        c[np.searchsorted(grams, g)] = k
    return pa.RecordBatch.from_arrays([pa.array(grams.astype(np.int64)), *map(pa.array, counts)], ["gram", "n", "m"])


def telling(found: DataFrame, s: Settings) -> np.ndarray:
    """The n-grams, sorted, that tell toxic from other texts, of ``(toxic int, windows array<binary>)``.

    They are ``contrast`` times as frequent, by documents, in toxic text as in ordinary text, by ``effect`` and surely so (by ``deviations`` of the
    difference). The executors count them, some texts at a time; only those that pass leave them. As these are in a share of the toxic
    texts that ``effect`` bounds from below, they are few however many n-grams there are.
    """

    def count(batches):
        texts, size = [], 0
        for b in batches:
            for toxic, ws in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                texts.append((bool(toxic), b"\n".join(ws)))
                size += len(texts[-1][1])
                if size >= COUNTED:
                    yield _counted(texts)
                    texts, size = [], 0
        if texts:
            yield _counted(texts)

    of = {bool(r["toxic"]): r["count"] for r in found.groupBy("toxic").count().collect()}
    t, o = of.get(True, 0), of.get(False, 0)
    grams = found.select("toxic", "windows").mapInArrow(count, "gram long, n long, m long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    grams = grams.where(F.col("n") >= s.least_docs)
    p, q, both = F.col("n") / F.lit(float(max(1, t))), (F.col("m") + 1) / F.lit(float(max(1, o))), (F.col("n") + F.col("m") + 1) / F.lit(float(t + o + 1))
    spread = lambda x: F.sqrt(x * (1 - x) + 1e-12)
    grams = grams.select("gram", p.alias("p"), q.alias("q"), spread(both).alias("pooled"), spread((p + q) / 2).alias("spread"))
    sure = (F.col("p") - F.col("q")) / (F.col("pooled") * F.lit(float(np.sqrt(1 / max(1, t) + 1 / max(1, o)))))
    good = grams.where((F.col("p") > s.contrast * F.col("q")) & (sure > s.deviations) & (F.col("p") - F.col("q") > s.effect * F.col("spread")))
    return np.sort(good.select("gram").toArrow()["gram"].to_numpy().astype(np.uint64))


def _fragments(texts: list[bytes], good: np.ndarray) -> list[bytes]:
    """The runs of ``good`` n-grams (sorted) in ``texts``, with one more byte at either end."""
    out = []
    for b in texts if len(good) else []:
        p = _packed(b)
        at = np.flatnonzero(good[np.minimum(np.searchsorted(good, p), len(good) - 1)] == p)
        if len(at):
            cut = np.flatnonzero(np.diff(at) > 1)
            for i, j in zip(at[np.concatenate(([0], cut + 1))].tolist(), at[np.concatenate((cut, [len(at) - 1]))].tolist()):
                out.append(b[max(0, i - 1) : j + GRAM + 1])
    return out


def _dictionary(size: int, samples: list[bytes], **how) -> bytes:
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zs.train_dictionary(size, samples, **how).as_bytes()
    except zs.ZstdError:  # too few samples for training: they are the dictionary
        return b"".join(dict.fromkeys(samples))[-size:]


def train(toxic: list[list[bytes]], ordinary: list[list[bytes]], good: np.ndarray, s: Settings) -> Model:
    """Separate dictionaries of the two classes, of one size, in front of one dictionary of ordinary text that both share.

    The toxic one learns from the stretches of toxic text whose n-grams are ``good``, those of ``telling``. The ordinary one learns from ordinary
    windows, so that length alone favours neither.
    """
    plain = [w for ws in ordinary for w in ws]
    fragments = _fragments([b"\n".join(ws) for ws in toxic], good)
    return Model(_dictionary(s.class_bytes, fragments, k=16, d=8), _dictionary(s.class_bytes, plain, k=16, d=8), _dictionary(s.shared_bytes, plain, k=64, d=8))


def _compressor(data: bytes) -> zs.ZstdCompressor:
    how = zs.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=15, search_log=4, min_match=5, target_length=32, strategy=zs.STRATEGY_DFAST, write_content_size=False, write_checksum=False, write_dict_id=False)
    d = zs.ZstdCompressionDict(data or b"\x00" * 8, dict_type=zs.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=how)
    return zs.ZstdCompressor(dict_data=d, compression_params=how)


class Scorer:
    """Features and scores of texts under a model."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.toxic, self.ordinary = (_compressor(x + model.shared).compress for x in (model.toxic, model.ordinary))

    def features(self, text: str | None) -> list[float]:
        """Of the gains (ordinary less toxic compressed length of a window): mean, largest, mean of three largest, shares, and their sum by sqrt(n). The length of the text is none of them."""
        ws = windows(text)
        if not ws:
            return [0.0] * 7
        a, b = self.ordinary, self.toxic
        g = np.fromiter((len(a(w)) - len(b(w)) for w in ws), np.float64, len(ws))
        top = np.sort(g)[-3:]
        return [g.mean(), min(top[-1], 12), min(top.mean(), 10), (g > 2).mean(), (g > 4).mean(), g.sum() / np.sqrt(len(g)), (g < -2).mean()]

    def score(self, text: str | None) -> float:
        m = self.model
        if not m.weights:
            return 0.0
        x = (np.array(self.features(text)) - m.mean) / m.scale
        x = _expanded(x[None])[0]
        return float(1 / (1 + np.exp(-np.clip(x @ m.weights, -30, 30))))


def _expanded(x: np.ndarray) -> np.ndarray:
    """With a constant and the products of the first six features."""
    x = np.clip(x, -6, 6)
    pairs = [x[:, i] * x[:, j] for i in range(6) for j in range(i, 6)]
    return np.column_stack([np.ones(len(x)), x, *pairs])


def calibrate(model: Model, features: np.ndarray, labels: np.ndarray) -> None:
    """A logistic curve over the features, by Newton steps with a small ridge; no positive or no negative rows leave no weights."""
    if not 0 < labels.sum() < len(labels):
        return
    mean, scale = features.mean(0), features.std(0) + 1e-9
    x = _expanded((features - mean) / scale)
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 2.0)
    ridge[0] = 0.01
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (labels - p) - ridge * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    model.mean, model.scale, model.weights = mean.tolist(), scale.tolist(), w.tolist()


def fit(docs: DataFrame, labels: DataFrame, s: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Dictionaries from one half of a bounded sample of labelled rows, calibration from the other.

    ``labels`` has ``doc_id`` and ``toxic`` (0 or 1; others don't count; a document with
    both is toxic). The sample is the ``2 * fit_rows`` rows of each label with the
    smallest hash of the id, so reruns agree and its size is bounded. Copies of a text
    within a class teach the dictionaries once. Null and empty texts have no windows; an
    empty table, or one label only, gives a model without weights. Other columns are ignored.
    """
    s = s or Settings()
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.select("doc_id", "toxic", F.xxhash64("doc_id", F.lit("toxicity")).alias("h"))
    rows = [r for y in (0, 1) for r in known.where(F.col("toxic") == y).orderBy("h", "doc_id").limit(2 * s.fit_rows).collect()]
    kind = known.schema["doc_id"].dataType.simpleString()
    sample = docs.sparkSession.createDataFrame([(r["doc_id"], int(r["toxic"]), bool(r["h"] & 1)) for r in rows], f"id {kind}, toxic int, half boolean")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    texts = rows.join(F.broadcast(sample), F.col("doc_id") == F.col("id")).select("doc_id", "toxic", "half", "text")

    def pick(batches):
        for b in batches:
            out = [windows(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.binary()))], ["toxic", "windows"])

    taught = stored(texts.where("half").select("toxic", "text").distinct().mapInArrow(pick, "toxic int, windows array<binary>"), "taught")
    good = telling(taught, s)
    found = {y: sorted(taught.where(F.col("toxic") == y).select("windows").toArrow()["windows"].to_pylist()) for y in (1, 0)}  # the order of partitions may differ
    dropped(taught)
    model = train(found.pop(1), found.pop(0), good, s)

    def measure(batches):
        scorer = Scorer(model)
        for b in batches:
            out = [scorer.features(x) for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.float64()))], ["doc_id", "toxic", "features"])

    seen = texts.where("NOT half").mapInArrow(measure, f"doc_id {kind}, toxic int, features array<double>").toArrow().to_pylist()
    seen.sort(key=lambda r: (r["doc_id"], r["features"]))
    if seen:
        calibrate(model, np.array([r["features"] for r in seen]), np.array([float(r["toxic"]) for r in seen]))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)``: how likely the whole text is toxic, 0 to 1; null and empty texts have the score of no windows.

    Every row gives a row, repeated ones too; very long texts are scored window by window. A model fitted without both labels scores all rows 0. Other columns are ignored.
    """

    def run(batches):
        scorer = Scorer(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([scorer.score(x) for x in b.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~is_remainder("doc_id", 4, 2))
    s = Settings()
    scored = score(docs, fit(docs, labels, s))
    return scored.select("doc_id", is_remainder("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= s.threshold).cast("int").alias("predicted"))
