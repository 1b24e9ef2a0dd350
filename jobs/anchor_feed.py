"""Anchors between a catalogue of texts and documents that arrive over time.

``python -m jobs.anchor_feed --config jobs/anchor_feed.json --documents DIR --catalogue DIR --output DIR --checkpoint DIR``

A streaming run over what is new: files of documents that no earlier run has taken are read, cut into sentences, and held against the
sentences of the catalogue by shared minimizers and edit distance, as nodes of two graphs are. Then it ends. The stream's checkpoint says which files
were taken, so a run without new files writes nothing. A batch writes a folder of its own, named by the batch's number, whole: one that was
broken off is written over when the stream repeats it.
"""

from __future__ import annotations

import logging
import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vgspark.functions.sequences import minimizers, similar, similarity

from .settings import main

log = logging.getLogger(__name__)

DOCUMENTS = "doc_id long, text string, source string"
SCHEMA = "doc_id long, sentence int, item_id long, item_sentence int, sim double, batch long, source string"


@dataclass
class Settings:
    #: Documents (a folder that files come to, or a pattern of files and folders), the catalogue, the folder to write, and that of the stream's checkpoint.
    documents: str = ""
    catalogue: str = ""
    output: str = ""
    checkpoint: str = ""
    #: Letters a k-mer, k-mers a window, least similarity; files a batch takes.
    kmer_len: int = 15
    window: int = 10
    min_sim: float = 0.75
    files: int = 1000


def sentences(text: str | Column) -> Column:
    """``[(at, seq)]``: what stands between ``.``, ``!``, ``?`` and line ends, without blanks around, numbered from 0."""
    cut = F.split(text, "[.!?\n]")
    return F.filter(F.transform(cut, lambda x, i: F.struct(i.alias("at"), F.trim(x).alias("seq"))), lambda x: x["seq"] != "")


def anchored(documents: DataFrame, catalogue: DataFrame, s: Settings) -> DataFrame:
    """``(doc_id, source, sentence, item_id, item_sentence, sim)`` of sentences that share a minimizer and are similar.

    Equal sentences are held against the catalogue once, however many documents have them. A null text has no sentence, nor has one shorter than
    a k-mer a minimizer; repeated rows give repeated anchors.
    """
    own = documents.select("doc_id", "source", F.explode(sentences("text")).alias("x")).select("doc_id", "source", F.col("x.at").alias("sentence"), "x.seq")
    items = catalogue.select("item_id", F.explode(sentences("text")).alias("x")).select("item_id", F.col("x.at").alias("item_sentence"), F.col("x.seq").alias("item_seq"))
    index = lambda df, seq: df.select(seq).distinct().select(seq, F.explode(minimizers(seq, s.kmer_len, s.window)).alias("h"))
    met = index(own, "seq").join(index(items, "item_seq"), "h").select("seq", "item_seq").distinct()
    near = met.where(similar("seq", "item_seq", s.min_sim)).withColumn("sim", similarity("seq", "item_seq"))
    return own.join(near, "seq").join(items, "item_seq").select("doc_id", "source", "sentence", "item_id", "item_sentence", "sim")


def read(spark: SparkSession, output: str, batch: int | None = None) -> DataFrame:
    """The anchors found so far, or those of one batch; none before the first batch."""
    return spark.read.schema(SCHEMA).option("basePath", output).parquet(output if batch is None else f"{output}/batch={batch}")


def run(spark: SparkSession, s: Settings) -> DataFrame:
    """Take what is new in ``s.documents``, wait for it to be done, and return the whole output as it stands."""

    def batch(documents: DataFrame, n: int) -> None:
        session, out = documents.sparkSession, f"{s.output}/batch={n}"
        found = anchored(documents, session.read.parquet(s.catalogue).select("item_id", "text"), s)
        found.hint("rebalance", "source").write.partitionBy("source").mode("overwrite").parquet(out)
        log.info("batch %d: read %d documents of %s, wrote %d anchors to %s", n, documents.count(), s.documents, read(session, s.output, n).count(), out)

    # a folder without files, so that the output can be read before there is a batch
    spark.createDataFrame([], SCHEMA).drop("batch").write.partitionBy("source").mode("overwrite").parquet(f"{s.output}/batch=-1")
    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", s.files).parquet(s.documents)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", s.checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("taken in this run: %d batches", len([p for p in query.recentProgress if p["numInputRows"]]))
    return read(spark, s.output)


if __name__ == "__main__":
    sys.exit(main(Settings, run, "anchor feed"))
