"""A cleaning pipeline over ``documents``, each stage one of the operators of ``vgspark.llm``."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vgspark.llm import decontaminate, lines, mixing, simhash, toxicity
from vgspark.llm.common import is_remainder, settled, stored, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    s = toxicity.Settings()
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~is_remainder("doc_id", 4, 2)), s)
    at = docs.columns.index("text")

    def kept(batches):
        scorer = toxicity.Scorer(model)
        for b in batches:
            yield b.filter(pa.array([scorer.score(x) < s.threshold for x in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are similar to an earlier one go; ``n_chars`` follows the text."""
    return lines.without_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays (of equal ids one row)."""
    docs = settled(docs)
    found = simhash.near_copies(docs)
    first = stored(found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("x")).select(F.col("x.row").alias("row")), "first")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("own"), F.monotonically_increasing_id().alias("at"))
    return rows.join(first, F.col("at") == F.col("row"), "left_semi").select(*(F.col("own")[c].alias(c) for c in docs.columns))


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, row by row."""
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document that is left; those with no copies aren't in it."""
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("line dedup", lines_out),
    ("near copies", copies_out),
    ("decontamination", leaks_out),
    ("mixing", mixture),
]

#: The classifier and the candidate search can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
