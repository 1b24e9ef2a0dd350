"""GFA 1.0/1.1 text to tables: one scan, one filter for each type of line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import reverse_complement
from ..model import GraphSet
from ..operators.order import numbered
from ..storage import kept


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``(graph_id, line_no, value)`` of the files at ``path``; the graph is named by its file's stem; .gz is read as it is."""
    raw = spark.read.text(path).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.gfa)?(\.gz)?$", 1).alias("graph_id"))
    return raw.select("graph_id", F.monotonically_increasing_id().alias("line_no"), "value")


def from_lines(spark: SparkSession, graph_id: str, text: list[str]) -> DataFrame:
    return spark.createDataFrame([(graph_id, i, x) for i, x in enumerate(text)], "graph_id string, line_no long, value string")


def _fields(df: DataFrame, kind: str, least: int) -> DataFrame:
    """The tab-separated fields of one type of line; empty fields are dropped, a line with too few is an error."""
    value = F.rtrim(F.col("value"), F.lit("\r"))
    f = F.filter(F.split(value, "\t"), lambda x: x != "")
    rows = df.where(F.substring("value", 1, 1) == kind).select("graph_id", "line_no", "value", f.alias("f"))
    short = F.concat(F.lit(f"{kind} line with fewer than {least} fields, line "), F.col("line_no").cast("string"), F.lit(": "), F.col("value"))
    # the kind is asked again, as the check may be moved before the filter
    return rows.withColumn("f", F.when((F.size("f") >= least) | (F.substring("value", 1, 1) != kind), F.col("f")).otherwise(F.raise_error(short)))


def _steps(df: DataFrame) -> DataFrame:
    """Oriented mentions of segments: ``(graph_id, line_no, path_name, step, name, rev)``."""
    p = _fields(df, "P", 3).select("graph_id", "line_no", F.get("f", F.lit(1)).alias("path_name"), F.posexplode(F.filter(F.split(F.get("f", F.lit(2)), ","), lambda x: x != "")).alias("step", "s"))
    last = F.substring("s", -1, 1)
    p = p.select("graph_id", "line_no", "path_name", "step", F.when(last.isin("+", "-"), F.expr("substring(s, 1, length(s) - 1)")).otherwise(F.col("s")).alias("name"), (last == "-").alias("rev"))
    f = lambda i: F.get("f", F.lit(i))
    w = _fields(df, "W", 7).select("graph_id", "line_no", F.concat(f(1), F.lit("#"), f(2), F.lit("#"), f(3), F.lit(":"), f(4), F.lit("-"), f(5)).alias("path_name"), F.posexplode(F.regexp_extract_all(f(6), F.lit("([<>])([^<>]+)"), F.lit(0))).alias("step", "s"))
    return p.unionByName(w.select("graph_id", "line_no", "path_name", "step", F.expr("substring(s, 2)").alias("name"), F.col("s").startswith("<").alias("rev")))


def parse(df: DataFrame) -> GraphSet:
    """Tables of all graphs in ``(graph_id, line_no, value)``.

    Ids follow the S lines, then the reverse complements that L, P and W lines mention, in
    order of first mention. Of segments with one name the last is meant by others. Header,
    comment and unknown lines are skipped; an unknown segment is an error.
    """
    # the lines are asked for by type several times, and may be dear to make
    kinds = df.select("graph_id", "line_no", "value", F.substring("value", 1, 1).alias("kind")).where(F.col("kind").isin("S", "L", "P", "W"))
    df = kept(kinds, "kind")
    s = _fields(df, "S", 3).select("graph_id", "line_no", F.get("f", F.lit(1)).alias("name"), F.get("f", F.lit(2)).alias("seq"))
    s = numbered(s.withColumn("seq", F.when(F.col("seq") == "*", "").otherwise(F.col("seq"))), ["line_no"], ["graph_id"], "node_id", 0).drop("line_no")
    named = s.groupBy("graph_id", "name").agg(F.max("node_id").alias("node_id"))
    at = lambda i: F.get("f", F.lit(i))
    links = _fields(df, "L", 5).select("graph_id", "line_no", at(1).alias("u"), (at(2) != "+").alias("u_rev"), at(3).alias("v"), (at(4) != "+").alias("v_rev"))
    steps = _steps(df)
    ends = links.select("graph_id", "line_no", F.posexplode(F.array(F.struct(F.col("u").alias("name"), F.col("u_rev").alias("rev")), F.struct(F.col("v").alias("name"), F.col("v_rev").alias("rev")))).alias("step", "x"))
    mentions = ends.select("graph_id", "line_no", "step", "x.name", "x.rev").unionByName(steps.drop("path_name"))
    first = mentions.where("rev").groupBy("graph_id", "name").agg(F.min(F.struct("line_no", "step")).alias("at")).join(named, ["graph_id", "name"])
    size = s.groupBy("graph_id").agg(F.count("*").alias("size"))
    turned = first.join(s.select("graph_id", "node_id", "seq"), ["graph_id", "node_id"]).drop("node_id").join(F.broadcast(size), "graph_id")
    turned = numbered(turned, ["at"], ["graph_id"], "nth", 0)
    turned = turned.select("graph_id", F.concat("name", F.lit("_rc")).alias("name"), reverse_complement("seq").alias("seq"), (F.col("nth") + F.col("size")).alias("node_id"))
    nodes, known = s, named
    if not turned.isEmpty():
        nodes = s.unionByName(turned)
        # a segment that is itself called <name>_rc is the reverse of <name>
        known = named.unionByName(turned.select("graph_id", "name", "node_id")).groupBy("graph_id", "name").agg(F.min("node_id").alias("node_id"))

    def meant(rows: DataFrame, name: str, rev: str, node: str) -> DataFrame:
        rows = rows.withColumn("full", F.when(F.col(rev), F.concat(name, F.lit("_rc"))).otherwise(F.col(name)))
        rows = rows.join(known.select("graph_id", F.col("name").alias("full"), F.col("node_id").alias(node)), ["graph_id", "full"], "left").drop("full")
        unknown = F.concat(F.lit("unknown segment "), F.col(name), F.lit(", line "), F.col("line_no").cast("string"))
        return rows.withColumn(node, F.coalesce(node, F.raise_error(unknown).cast("long"))).drop(name, rev)

    edges = meant(meant(links, "u", "u_rev", "src"), "v", "v_rev", "dst").select("graph_id", "src", "dst")
    paths = meant(steps, "name", "rev", "node_id").select("graph_id", "path_name", F.col("step").cast("int").alias("step"), "node_id")
    from ..operators.topology import path_edges

    return GraphSet(nodes.select("graph_id", "node_id", "name", "seq"), edges.unionByName(path_edges(paths)).distinct(), paths)


def read_gfa(spark: SparkSession, path: str) -> GraphSet:
    return parse(lines(spark, path))


def to_lines(g: GraphSet) -> DataFrame:
    """``(graph_id, part, a, b, value)``: GFA text in the order of part, a, b."""
    head = g.nodes.select("graph_id").distinct().select("graph_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit("H\tVN:Z:1.0").alias("value"))
    seg = g.nodes.select("graph_id", F.lit(1), "node_id", F.lit(0).cast("long"), F.concat_ws("\t", F.lit("S"), "name", F.when(F.col("seq") == "", "*").otherwise(F.col("seq"))))
    names = g.nodes.select("graph_id", "node_id", "name")
    l = g.edges.join(names.withColumnsRenamed({"node_id": "src", "name": "u"}), ["graph_id", "src"]).join(names.withColumnsRenamed({"node_id": "dst", "name": "v"}), ["graph_id", "dst"])
    link = l.select("graph_id", F.lit(2), "src", "dst", F.concat_ws("\t", F.lit("L"), "u", F.lit("+"), "v", F.lit("+"), F.lit("0M")))
    p = g.paths.join(names, ["graph_id", "node_id"]).groupBy("graph_id", "path_name").agg(F.array_sort(F.collect_list(F.struct("step", "name"))).alias("x"))
    path = p.select("graph_id", F.lit(3), F.xxhash64("path_name"), F.lit(0).cast("long"), F.concat_ws("\t", F.lit("P"), "path_name", F.array_join(F.transform("x", lambda s: F.concat(s["name"], F.lit("+"))), ","), F.lit("*")))
    return head.union(seg).union(link).union(path)


def paf(spark: SparkSession, path: str) -> DataFrame:
    """``(q_name, q_start, q_end, t_name, t_start, t_end, identity)`` of the lines with twelve columns or more."""
    f = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).where(F.size("f") >= 12)
    c = lambda i, kind: F.get("f", F.lit(i)).cast(kind)
    return f.select(c(0, "string").alias("q_name"), c(2, "long").alias("q_start"), c(3, "long").alias("q_end"), c(5, "string").alias("t_name"), c(7, "long").alias("t_start"), c(8, "long").alias("t_end"), (c(9, "double") / c(10, "double")).alias("identity"))


def measurements(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """A table of measurements with a header."""
    return spark.read.option("sep", sep).option("header", True).schema(schema).csv(path)
