"""The jobs as queries, each run twice into one new folder, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vgspark.queries import _CHOSEN, BASE_SQL, FNV_SQL, MINIMA_SQL, _near
from vgspark.storage import new_folder

from . import anchor_feed, delta_report


def job1_delta_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = delta_report.Settings(tables=sf_dir, output=new_folder(spark, "delta-report"))
    delta_report.run(spark, s)
    return delta_report.run(spark, s).withColumns({"sim": F.round("sim", 6), "other_idx": F.coalesce("other_idx", F.lit(-1))})


def job2_anchor_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "anchor-feed")
    s = anchor_feed.Settings(documents=f"{sf_dir}/documents.parquet*", catalogue=f"{sf_dir}/benchmark.parquet", output=f"{folder}/anchors", checkpoint=f"{folder}/checkpoint")
    anchor_feed.run(spark, s)
    return anchor_feed.run(spark, s).drop("batch").withColumn("sim", F.round("sim", 6))


#: DuckDB's edit distance counts bytes, so letters beyond ASCII are first turned into control characters, which texts don't hold.
LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_CODES = "||".join(f"chr({i})" for i in [*range(1, 9), *range(14, 27)])
_BYTES = f"translate({{}}, '{LETTERS}', {_CODES})"

QUERIES = {"job1_delta_report": job1_delta_report, "job2_anchor_feed": job2_anchor_feed}

_LEFT = """SELECT am.snarl_id, am.ai AS allele_idx, am.seq, NULL AS other_snarl, -1 AS other_idx, NULL AS sim,
    lower(am.g) || CASE WHEN p.met IS NULL THEN '_unpaired' ELSE '_only' END AS status, am.ok * 16 // 1000000 AS stretch
  FROM am LEFT JOIN (SELECT 'A' AS g, snarl_a AS idx, li AS met FROM chosen UNION ALL SELECT 'B', snarl_b, lj FROM chosen) p ON p.g = am.g AND p.idx = am.idx
  WHERE p.met IS NULL OR NOT list_contains(p.met, am.ai)"""
_ANCHORS = """WITH cut AS (SELECT doc_id, source, regexp_split_to_array(text, '[.!?\\n]') AS p FROM documents),
own AS (SELECT doc_id, source, CAST(i AS INTEGER) AS sentence, trim(p[i + 1]) AS seq FROM cut, LATERAL (SELECT unnest(range(len(p))) AS i)),
cat AS (SELECT item_id, regexp_split_to_array(text, '[.!?\\n]') AS p FROM benchmark),
items AS (SELECT item_id, CAST(i AS INTEGER) AS item_sentence, trim(p[i + 1]) AS item_seq FROM cat, LATERAL (SELECT unnest(range(len(p))) AS i)),"""

ORACLE_SQL = {
    "job1_delta_report": _near(BASE_SQL, "am")
    + _CHOSEN
    + f"""SELECT a.snarl_id, a.ai AS allele_idx, a.seq, b.snarl_id AS other_snarl, b.ai AS other_idx, CAST(round(m.s, 6) AS DOUBLE) AS sim, 'shared' AS status, a.ok * 16 // 1000000 AS stretch
  FROM (SELECT snarl_a, snarl_b, unnest(took) AS m FROM chosen) JOIN am a ON a.g = 'A' AND a.idx = snarl_a AND a.ai = m.i JOIN am b ON b.g = 'B' AND b.idx = snarl_b AND b.ai = m.j UNION ALL {_LEFT}""",
    "job2_anchor_feed": _ANCHORS
    + f"""
texts AS MATERIALIZED (SELECT DISTINCT 'd' AS g, seq FROM own WHERE length(seq) >= 15 UNION ALL SELECT DISTINCT 'i', item_seq FROM items WHERE length(item_seq) >= 15),
hs AS (SELECT g, seq, list_transform(range(1, length(seq) - 15 + 2), lambda p: {FNV_SQL.format('substring(seq, p, 15)')}) AS hs FROM texts),
ix AS (SELECT g, seq, unnest({MINIMA_SQL}) AS h FROM hs),
met AS (SELECT DISTINCT a.seq, b.seq AS item_seq FROM ix a JOIN ix b ON a.g = 'd' AND b.g = 'i' AND a.h = b.h),
near AS (SELECT seq, item_seq, 1 - levenshtein({_BYTES.format('seq')}, {_BYTES.format('item_seq')}) / greatest(length(seq), length(item_seq)) AS sim FROM met)
SELECT doc_id, sentence, item_id, item_sentence, round(sim, 6) AS sim, source FROM own JOIN near USING (seq) JOIN items USING (item_seq) WHERE sim >= 0.75 - 1e-9""",
}
