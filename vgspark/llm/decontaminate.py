"""Benchmark decontamination: a BM25 inverted index of test items, block-max WAND and overlap checks."""

from __future__ import annotations

import math
import re
import string
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, words

K1, B = 1.2, 0.75
#: Items of one block share the maxima by which passages are pruned before cursors move inside it.
BLOCK = 4
#: Bytes of item texts that one index holds; larger benchmarks take a pass over the documents for each such part.
INDEX_BYTES = 8_000_000
#: Words of documents that are searched together, and sums of block maxima held at a time.
TOGETHER, SUMS = 1 << 17, 4_000_000
SHINGLE = 5
#: Steps have at least so many words.
SHORTEST = 8
EPS = 1e-9
PUNCTUATION = string.punctuation.encode()
SENTENCE = re.compile(r"(?<=[.?!])\s+")


def terms(text: str | None) -> list[bytes]:
    """The words of a text without ASCII punctuation at their ends."""
    return [t for w in words(text) if (t := w.strip(PUNCTUATION))]


def question_answer(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The answer is the last sentence, or the last quarter of a text that has one sentence; the question is the rest."""
    parts = [x for p in SENTENCE.split((text or "").strip()) if (x := terms(p))]
    if len(parts) > 1:
        return [t for p in parts[:-1] for t in p], parts[-1]
    all_terms = parts[0] if parts else []
    cut = len(all_terms) - len(all_terms) // 4
    return all_terms[:cut], all_terms[cut:]


def shingles(found: list[bytes], size: int = SHINGLE) -> set[bytes]:
    return {b" ".join(found[i : i + size]) for i in range(max(1, len(found) - size + 1))} if found else set()


def step_of(n_terms: int) -> int:
    """The step, in words, between the passages that an item of ``n_terms`` is searched in: the next power of two."""
    return max(SHORTEST, 1 << max(0, n_terms - 1).bit_length())


class Shelf:
    """Postings of the items of one step, with the maxima of their blocks. Passages are two steps long and a step apart, so each item lies whole in one."""

    def __init__(self, step: int, items: list[int], impacts: list[dict[int, float]], n_terms: int, threshold: float) -> None:
        self.step, self.items, self.threshold = step, items, threshold
        rows = sorted((t, k, x) for k, i in enumerate(items) for t, x in impacts[i].items())
        term, item = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
        x = np.array([r[2] for r in rows])
        self.docs, self.x = item.tolist(), x.tolist()
        self.n_blocks = -(-len(items) // BLOCK)
        key = term * self.n_blocks + item // BLOCK
        self.begin = np.flatnonzero(np.diff(key, prepend=-1))
        self.end = np.append(self.begin[1:], len(key))
        self.key, self.most = key[self.begin], np.maximum.reduceat(x, self.begin)
        # terms whose maxima together stay far below the threshold can't make a block live
        of = self.key // self.n_blocks
        upper = np.zeros(n_terms)
        np.maximum.at(upper, of, self.most)
        count = np.bincount(of, minlength=n_terms)
        self.rest, light = 0.0, np.zeros(n_terms, bool)
        for t in np.lexsort((upper, -count)):
            if self.rest + upper[t] > 0.2 * threshold:
                break
            self.rest += upper[t]
            light[t] = True
        keep = ~light[of]
        self.heavy, self.heavy_most = self.key[keep] % self.n_blocks, self.most[keep]
        self.starts = np.searchsorted(of[keep], np.arange(n_terms + 1))

    def live(self, at: np.ndarray, ids: np.ndarray, n_steps: int) -> Iterator[tuple[int, int]]:
        """``(passage, block)`` whose summed block maxima can reach the threshold; a passage is named by the first of its two steps."""
        n_terms = len(self.starts) - 1
        pair = np.unique(at * n_terms + ids)  # a term counts once in a step
        at, ids = pair // n_terms, pair % n_terms
        first, count = self.starts[ids], self.starts[ids + 1] - self.starts[ids]
        posting = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        at, block, x = np.repeat(at, count), self.heavy[posting], self.heavy_most[posting]
        per = max(1, SUMS // self.n_blocks)
        for low in range(0, n_steps, per):
            i, j = np.searchsorted(at, (low, low + per + 1))
            if i == j:
                continue
            wide = min(per + 1, n_steps - low)
            sums = np.bincount((at[i:j] - low) * self.n_blocks + block[i:j], weights=x[i:j], minlength=wide * self.n_blocks).reshape(wide, self.n_blocks)
            both = sums[:-1] + sums[1:]
            for p, b in zip(*(y.tolist() for y in np.nonzero(both >= self.threshold - self.rest - EPS))):
                yield p + low, b

    def wand(self, have: np.ndarray, block: int) -> Iterator[tuple[int, float]]:
        """``(place on the shelf, score)`` of the block's items that reach the threshold on the distinct terms ``have``.

        Cursors stand on the terms' postings, in order of items. The pivot is the item at
        which the maxima of the cursors up to it can reach the threshold; cursors
        before it skip to it, and an item is scored when all cursors that matter stand on it.
        """
        key = have * self.n_blocks + block
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        at = at[self.key[at] == key]
        docs, x = self.docs, self.x
        cursors = [[docs[i], i, j, m] for i, j, m in zip(self.begin[at].tolist(), self.end[at].tolist(), self.most[at].tolist())]
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, None
            for c in cursors:
                bound += c[3]
                if bound >= self.threshold - EPS:
                    pivot = c[0]
                    break
            if pivot is None:
                return
            to = pivot
            if cursors[0][0] == pivot:
                score = math.fsum(x[c[1]] for c in cursors if c[0] == pivot)
                if score >= self.threshold - EPS:
                    yield pivot, score
                to = pivot + 1
            left = []
            for c in cursors:
                if c[0] < to:
                    c[1] = bisect_left(docs, to, c[1], c[2])
                    if c[1] == c[2]:
                        continue
                    c[0] = docs[c[1]]
                left.append(c)
            cursors = left


class Index:
    """Impacts of terms on items, each a share of what the item scores against itself, on shelves by the items' lengths."""

    def __init__(self, items: list[tuple], n_items: int, mean_length: float, df: dict[bytes, int], threshold: float) -> None:
        self.ids = [i for i, _ in items]
        self.parts = [question_answer(t) for _, t in items]
        self.shingles = [shingles(q) for q, _ in self.parts]
        self.vocabulary: dict[bytes, int] = {}
        impacts: list[dict[int, float]] = []
        by_step: dict[int, list[int]] = {}
        for i, (q, a) in enumerate(self.parts):
            bag, n = Counter(q + a), len(q) + len(a)
            own = {t: math.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * n / mean_length)) for t, c in bag.items()}
            total = math.fsum(own.values())
            impacts.append({self.vocabulary.setdefault(t, len(self.vocabulary)): x / total for t, x in own.items()})
            by_step.setdefault(step_of(n), []).append(i)
        self.shelves = [Shelf(step, found, impacts, len(self.vocabulary), threshold) for step, found in sorted(by_step.items())]

    def verified(self, i: int, passage: list[bytes], own: list) -> tuple[float, float]:
        """The shares of the item's question shingles and answer words that the passage has; ``own`` keeps the passage's sets."""
        if not own:
            own += [shingles(passage), Counter(passage)]
        question, answer = self.parts[i]
        q = len(self.shingles[i] & own[0]) / len(self.shingles[i]) if question else 1.0
        if 0 < len(question) < SHINGLE:  # shorter than a shingle: its words in sequence
            q = float(b" ".join(question) in b" ".join(passage))
        return q, sum((Counter(answer) & own[1]).values()) / len(answer) if answer else 1.0

    def search(self, texts: list[list[bytes]], overlap: float) -> list[list[dict]]:
        """For each text its verified items, each with its best passage (the first of equal ones)."""
        get = self.vocabulary.get
        each = [np.fromiter((get(t, -1) for t in found), np.int64, len(found)) for found in texts]
        size = np.array([len(x) for x in each], np.int64)
        ids = np.concatenate([*each, np.zeros(0, np.int64)])
        known = np.flatnonzero(ids >= 0)
        text = np.repeat(np.arange(len(texts)), size)[known]
        place = known - np.repeat(np.cumsum(size) - size, size)[known]
        best: list[dict[int, dict]] = [{} for _ in texts]
        for shelf in self.shelves if len(known) else []:
            n_steps = size // shelf.step + 2  # the last of a text is empty
            first = np.cumsum(n_steps) - n_steps
            last, have, own = None, None, []
            for p, b in shelf.live(first[text] + place // shelf.step, ids[known], int(n_steps.sum())):
                k = int(np.searchsorted(first, p, "right")) - 1
                p -= int(first[k])
                if p == n_steps[k] - 1:
                    continue
                start, end = p * shelf.step, (p + 2) * shelf.step
                if last != (k, p):
                    last, own = (k, p), []
                    have = np.unique(each[k][start:end])
                    have = have[have >= 0]
                for at, score in shelf.wand(have, b):
                    i = shelf.items[at]
                    if i in best[k] and best[k][i]["score"] >= score:
                        continue
                    q, a = self.verified(i, texts[k][start:end], own)
                    if q >= overlap and a >= overlap:
                        best[k][i] = {"item": self.ids[i], "score": score, "question": q, "answer": a, "start": start, "end": min(len(texts[k]), end)}
        return [[x[i] for i in sorted(x)] for x in best]

    def searched(self, texts: list[str | None], overlap: float) -> Iterator[list[dict]]:
        """``search`` of texts, some of them together."""
        waiting, n = [], 0
        for text in texts:
            waiting.append(terms(text))
            n += len(waiting[-1])
            if n >= TOGETHER:
                yield from self.search(waiting, overlap)
                waiting, n = [], 0
        yield from self.search(waiting, overlap)


def indexes(benchmark: DataFrame, threshold: float, limit: int = INDEX_BYTES) -> Iterator[Index]:
    """Indexes over all items, of ``limit`` bytes of text each or one item, one after the other; counts for BM25 are over all of them.

    The driver holds the items of one index, and a count for each distinct term of the benchmark.
    """
    items = benchmark.select(F.col("item_id").alias("id"), "text").where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // limit)

    def chunk(i: int) -> list[tuple]:
        found = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == i).orderBy("id", "text").collect()
        return [(r[0], r[1]) for r in found if terms(r[1])]

    n, length, df, held = 0, 0, Counter(), []
    for i in range(parts):
        held = chunk(i)
        for _, t in held:
            found = [y for x in question_answer(t) for y in x]
            n, length = n + 1, length + len(found)
            df.update(set(found))
    for i in range(parts):
        if found := held if parts == 1 else chunk(i):
            yield Index(found, n, length / n, df, threshold)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, overlap: float = 0.6) -> DataFrame:
    """``(doc_id, item_id, score, question_overlap, answer_overlap, start_word, end_word)``: a row for each item that a document holds.

    Every passage of every document is a query. An item is searched in passages of two steps, a
    step apart; the step is the power of two from its own length, so it lies whole in
    one and what else the benchmark holds doesn't matter. Scores are BM25 as a share of
    the item's score against itself; all items at ``threshold`` or more are retrieved, and
    kept if the passage has at least ``overlap`` of the question's five-word shingles
    and of the answer's words. Null and empty texts and items match nothing; repeated
    rows and items give repeated results, of equal passages the first is told. Texts of any
    length are searched whole. Null ids are kept; other columns, of whatever names, are ignored. Without items or documents the result is empty.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    whole = item_kind in ("bigint", "int", "smallint", "tinyint")
    hit = pa.list_(pa.struct([("item", pa.int64() if whole else pa.string()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
    out = docs.sparkSession.createDataFrame([], f"doc_id {kind}, item_id {item_kind}, score double, question_overlap double, answer_overlap double, start_word long, end_word long")
    parts = None
    for index in indexes(benchmark, threshold):
        index = docs.sparkSession.sparkContext.broadcast(index)  # INDEX_BYTES of text at most

        def run(batches, index=index):
            for b in batches:
                found = list(index.value.searched(b.column(1).to_pylist(), overlap))
                some = [i for i, x in enumerate(found) if x]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some, pa.int64())), pa.array([found[i] for i in some], hit)], ["doc_id", "hits"])

        part = rows.mapInArrow(run, f"doc_id {kind}, hits array<struct<item:{'bigint' if whole else 'string'},score:double,question:double,answer:double,start:bigint,end:bigint>>")
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return out
    found = parts.select("doc_id", F.explode("hits").alias("h"))
    return found.select("doc_id", F.col("h.item").cast(item_kind).alias("item_id"), "h.score", F.col("h.question").alias("question_overlap"), F.col("h.answer").alias("answer_overlap"), F.col("h.start").alias("start_word"), F.col("h.end").alias("end_word"))


def without_items(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = 0.5, overlap: float = 0.6) -> DataFrame:
    """The rows of ``docs`` that hold no item, as ``contaminated`` finds them; rows are judged by their text, whatever their id."""
    at = docs.columns.index(text_col)
    for index in indexes(benchmark, threshold):
        index = docs.sparkSession.sparkContext.broadcast(index)  # INDEX_BYTES of text at most

        def clean(batches, index=index):
            for b in batches:
                yield b.filter(pa.array([not x for x in index.value.searched(b.column(at).to_pylist(), overlap)], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", *(F.round(c, 6).alias(c) for c in ("score", "question_overlap", "answer_overlap")), "start_word", "end_word")
