"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, dropped, stored, table

#: No document is taken more often than this, and no source beyond this multiple of its size.
CAP = 3
#: Cells of equal source and size are dealt over so many parts, so that no window holds a hot one alone.
PARTS = 256


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank`` from 0 by code point, null last.

    Range partitions are ranked each alone; only their row counts, one a partition, meet at the driver.
    """
    parts = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    parts = stored(parts, "sources")
    before, at = [], 0
    for part, n in sorted(parts.groupBy("part").count().collect()):
        before += [F.lit(part), F.lit(at)]
        at += n
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return parts.withColumn("rank", own + F.create_map(*before)[F.col("part")] if before else own).drop("part")


def targets(sized: DataFrame, weights: Column | None = None) -> DataFrame:
    """``(source, source_size, weight, target)``.

    By default sources weigh 1, 2, 3, repeating, in order of code point, null last. Targets
    share the sum of all sizes by weight. Those above CAP times their source stop there
    and the excess goes to the others by weight, until none is above.
    """
    state = ranked(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    state = stored(state.withColumn("weight", (weights if weights is not None else F.col("rank") % 3 + 1).cast("double")), "targets")
    level = 0.0
    while True:  # each round is a sum over sources; the level only rises
        full = F.col("weight") * level >= CAP * F.col("source_size")
        r = state.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, CAP * F.col("source_size"))).alias("stopped"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        now = ((r["all"] or 0) - (r["stopped"] or 0)) / r["open"] if r["open"] else level
        if now <= level:
            break
        level = now
    return state.withColumn("target", F.least(F.col("weight") * level, (CAP * F.col("source_size")).cast("double")))


def _exact(x: Column) -> Column:
    """The sum of ``x``, the same in whatever order rows come."""
    return F.sum(x.cast("decimal(28,8)")).cast("double")


def balanced(cells: DataFrame, goals: DataFrame, tolerance: float = 1e-9, rounds: int = 60) -> DataFrame:
    """``(source, tilt, mean, target, source_size)``: of each source, the tilt that meets its token target.

    Rates of least relative entropy to 1, at most CAP, whose tokens sum to the target are
    ``least(CAP, exp(tilt * size / mean))``. The tilt solves the convex dual, one dimension a
    source: Newton steps over the sums of all cells, kept inside a bracket (``low``, ``high``).
    A target of CAP times the source needs no tilt (null stands for rate CAP).
    """
    means = cells.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    g = goals.alias("g").join(means.alias("m"), F.expr("g.source <=> m.source")).select("g.source", "source_size", "target", "mean", "least")
    # at the upper end all documents are at CAP; at the lower end less than one word is taken
    state = g.select(
        "source", "source_size", "target", "mean",
        F.lit(0.0).alias("tilt"),
        (-F.col("mean") / F.col("least") * (F.log(F.greatest("source_size", F.lit(1))) + 40)).alias("low"),
        (F.col("mean") / F.col("least") * F.log(F.lit(float(CAP)))).alias("high"),
        ((F.col("source_size") == 0) | (F.col("target") >= CAP * F.col("source_size"))).alias("done"),
    )
    state = stored(state, "dual")
    for _ in range(rounds):
        x = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("tilt") * x, F.lit(60.0)))
        held = cells.alias("c").join(state.where("NOT done").alias("s"), F.expr("c.source <=> s.source"))
        sums = held.select("s.source", "n", "size", x.alias("x"), rate.alias("rate")).groupBy("source").agg(
            _exact(F.col("n") * F.col("size") * F.least("rate", F.lit(float(CAP)))).alias("got"),
            _exact(F.when(F.col("rate") < CAP, F.col("n") * F.col("size") * F.col("x") * F.col("rate")).otherwise(0.0)).alias("slope"),
        )
        s = state.alias("s").join(sums.alias("u"), F.expr("s.source <=> u.source"), "left")
        gap = F.col("got") - F.col("target")
        low, high = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low")), F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - gap / F.col("slope")
        inside = (F.col("slope") > 0) & (step > low) & (step < high)
        done = F.col("done") | (F.abs(gap) <= tolerance * F.col("target") + 0.01)
        after = stored(s.select("s.source", "source_size", "target", "mean", F.when(done, F.col("tilt")).when(inside, step).otherwise((low + high) / 2).alias("tilt"), F.when(done, F.col("low")).otherwise(low).alias("low"), F.when(done, F.col("high")).otherwise(high).alias("high"), done.alias("done")), "dual")
        dropped(state)
        state = after
        if not state.where("NOT done").limit(1).count():
            break
    return state.select("source", "source_size", "target", "mean", F.when(F.col("target") < CAP * F.col("source_size"), F.col("tilt")).alias("tilt"))


def settled(cells: DataFrame, passes: int = 4) -> DataFrame:
    """``cells`` with ``all_copies`` moved so that each source's taken words come nearer its target.

    Each pass spends a source's gap on its cells from the largest size that fits, within
    what rounding leaves open there: no document leaves the whole numbers next to its rate.
    """
    every, down = Window.partitionBy("source"), Window.partitionBy("source").orderBy(F.col("size").desc())
    for _ in range(passes):
        c = cells.withColumn("gap", F.col("target") - F.sum(F.col("all_copies") * F.col("size")).over(every))
        open_ = F.when(F.col("gap") > 0, F.col("n") * F.ceil("rate") - F.col("all_copies")).otherwise(F.col("all_copies") - F.col("n") * F.floor("rate"))
        c = c.withColumn("open", F.when((F.col("size") > 0) & (F.col("size") <= F.abs("gap")), open_).otherwise(0))
        spent = F.coalesce(F.sum(F.col("open") * F.col("size")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        c = c.withColumn("move", F.when(F.col("open") > 0, F.greatest(F.lit(0), F.least("open", F.floor((F.abs("gap") - spent) / F.col("size"))))).otherwise(0))
        cells = c.withColumn("all_copies", F.col("all_copies") + F.signum("gap").cast("long") * F.col("move")).drop("gap", "open", "move")
    return cells


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, size, source_size, target, rate, copies, taken)``: how often the mix takes each document.

    Rates depend on source and size alone, so all steps work on cells: counts by source
    and size. Rates become copies by systematic rounding along the sizes of a
    source, and what then is missing or too much is moved onto documents that fit. Within a cell the documents taken once more are those first by part and id, so
    reruns agree. A null text has size 0, a null source is a source of its own, last
    in order; documents of size 0 get the copies of their rate and take no words. Repeated
    rows are rows of their own. Other columns are ignored.
    """
    base = stored(sizes(docs, id_col, text_col, source_col).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))), "sizes")
    parts = stored(base.groupBy("source", "size", "part").agg(F.count("*").alias("n")), "parts")
    cells = stored(parts.groupBy("source", "size").agg(F.sum("n").alias("n")), "cells")
    dual = balanced(cells, targets(cells.select("source", (F.col("size") * F.col("n")).alias("size"))))
    rated = cells.alias("c").join(dual.alias("d"), F.expr("c.source <=> d.source")).select(
        "c.source", "size", "n", "source_size", "target",
        F.when(F.col("tilt").isNull(), float(CAP)).otherwise(F.least(F.lit(float(CAP)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(60.0))))).alias("rate"),
    )
    upto = F.sum(F.col("n") * F.col("rate")).over(Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    rounded = rated.withColumn("upto", F.floor(upto + 0.5))
    copies = F.col("upto") - F.coalesce(F.lag("upto").over(Window.partitionBy("source").orderBy("size")), F.lit(0))
    rounded = settled(rounded.withColumn("all_copies", F.greatest(F.lit(0), F.least(copies, CAP * F.col("n")))))
    before = F.sum("n").over(Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    p = parts.withColumn("before", before).alias("p").join(rounded.alias("r"), F.expr("p.source <=> r.source AND p.size = r.size"))
    p = p.select("p.source", "p.size", "part", "before", "r.n", "source_size", "target", "rate", "all_copies")
    own = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("doc_id"))
    rows = base.withColumn("own", own).alias("b").join(p.alias("p"), F.expr("b.source <=> p.source AND b.size = p.size AND b.part = p.part"))
    more = (F.col("p.before") + F.col("own") <= F.col("all_copies") % F.col("n")).cast("long")
    copies = F.floor(F.col("all_copies") / F.col("n")) + more
    return rows.select("doc_id", "b.source", "b.size", "source_size", "target", "rate", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", F.round("rate", 6).alias("rate"))
