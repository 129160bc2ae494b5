"""What the operators of this subpackage share: tables in the shared folder, gapless numbering, sets of links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidelake import paths

#: The white space of the contracts, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"


#: Tables written within settled(), the innermost last.
_open: list[list[str]] = []


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = paths.scratch(spark, "table")
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidelake_path = path
    for tables in _open[-1:]:
        tables.append(path)
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that written() made and that nothing reads any more."""
    path = getattr(df, "_tidelake_path", None)
    if path:
        paths.delete(df.sparkSession, path)


def settled(build: Callable[[], DataFrame], keep: tuple[DataFrame, ...] = ()) -> DataFrame:
    """build()'s result as a table; the tables that build() wrote on its way are deleted, but for those in keep."""
    _open.append([])
    try:
        out = written(build())
    finally:
        tables = _open.pop()
    held = {getattr(d, "_tidelake_path", None) for d in (out, *keep)}
    for path in tables:
        if path not in held:
            paths.delete(out.sparkSession, path)
        elif _open:
            _open[-1].append(path)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, group: list[str], block: list[str], order: list[Column], name: str) -> DataFrame:
    """Gapless numbers from 0 in each group, in the order of `block` and then of `order`.

    `block` splits a group into parts that are each numbered by one task; the parts' starts come from their
    counts, so a group that holds most rows is still numbered by many tasks. Columns of group and block may be null.
    """
    # Keys as strings with a mark for null, so that the join back can use plain equality
    marks = {f"_k{i}": F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for i, c in enumerate([*group, *block])}
    keyed = df.withColumns(marks)
    keys = list(marks)
    of_group = keys[: len(group)]
    counts = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *(F.first(c).alias(c) for c in block))
    before = W.partitionBy(*of_group).orderBy(*(F.col(c).asc_nulls_last() for c in block)).rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = W.partitionBy(*keys).orderBy(*order)
    return (
        keyed.withColumn("_rn", F.row_number().over(within).cast("long"))
        .join(starts, keys)
        .withColumn(name, F.col("_start") + F.col("_rn") - 1)
        .drop(*keys, "_rn", "_start")
    )


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of `links` (a long, b long) reaches.

    Each round every node takes its smallest neighbour, two jumps along these pointers shorten the chains, and the
    links are drawn anew between what their ends point to, until none is left. The pointers' minima are combined
    before the shuffle and the joins are plain equi-joins whose large partitions AQE can split, so a node with very
    many links does not bind a single task. Empty links give an empty table.
    """
    spark = links.sparkSession
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = None
    while not edges.isEmpty():
        least = (
            edges.select("a", "b").union(edges.select("b", "a")).toDF("u", "v")
            .groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("l"))
        )
        hop = written(least)
        far = hop.select(F.col("u").alias("l"), F.col("l").alias("l2"))
        step = written(hop.join(far, "l", "left").select("u", F.coalesce("l2", "l").alias("l")))
        at = step.select(F.col("u").alias("a"), F.col("l").alias("la"))
        bt = step.select(F.col("u").alias("b"), F.col("l").alias("lb"))
        moved = edges.join(at, "a").join(bt, "b").filter("la <> lb")
        new = written(moved.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
        if nodes is None:
            joined = step.select(F.col("u").alias("node"), F.col("l").alias("component"))
        else:
            joined = written(nodes.join(step.withColumnRenamed("u", "component"), "component", "left").select("node", F.coalesce("l", "component").alias("component")))
            discard(nodes)
            discard(step)
        discard(hop)
        discard(edges)
        nodes, edges = joined, new
        nodes._tidelake_path = getattr(joined, "_tidelake_path", getattr(step, "_tidelake_path", None))
    return nodes if nodes is not None else spark.createDataFrame([], T.StructType([T.StructField("node", T.LongType()), T.StructField("component", T.LongType())]))


#: Words of 64 bits, with a key each, that are sent to all tasks at most: 16 MB, for 2^26 rows of a bit, 2^24 of four.
WORDS = 1 << 20


def copied(read: DataFrame, row: str, plan: DataFrame, bits: int = 4, words: int = WORDS) -> DataFrame:
    """read's rows, all columns, each as many times as plan (row, copies) says: not at all where it has none.

    row is a column of read that monotonically_increasing_id() has made, so rows that lie together share a word of 64
    bits, `bits` a row. The words, at most `words` of them, are sent to all tasks and no row of read is moved; a plan
    with more words, or more copies than the bits hold, is joined by row. Both give the same rows.
    """
    word, held, copies = fresh(read, "word", "held", "copies")
    each = 64 // bits
    place = lambda c: ((F.col(c) % each) * bits).cast("int")
    at = lambda c: F.call_function("shiftright", F.col(c), F.lit(each.bit_length() - 1))
    most, n = plan.agg(F.max("copies"), F.countDistinct(at("row"))).first()
    if not n:
        return read.filter(F.lit(False))
    if n <= words and most < 1 << bits:
        table = written(plan.groupBy(at("row").alias(word)).agg(F.bit_or(F.call_function("shiftleft", F.col("copies").cast("long"), place("row"))).alias(held)))
        found = read.withColumn(word, at(row)).join(F.broadcast(table), word)
        found = found.withColumn(copies, F.call_function("shiftrightunsigned", F.col(held), place(row)).bitwiseAND((1 << bits) - 1).cast("int")).filter(F.col(copies) > 0)
    else:
        found = read.join(plan.select(F.col("row").alias(word), F.col("copies").cast("int").alias(copies)), F.col(row) == F.col(word))
    if most > 1:
        found = found.withColumn(held, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return found.select(*(F.col(f"`{c}`") for c in read.columns))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that df has already."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out
