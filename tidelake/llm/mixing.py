"""Mixing of sources to target weights, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidelake.llm.common import copied, fresh, numbered, settled, written

#: Weights of the sources by code point, repeated; the mix's share of all sizes; the most that a source is repeated.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: The largest documents of a source whose draws may be turned to meet the target; parts in which rows that are
#: alike in all that a draw looks at are numbered.
TURNED, PARTS = 256, 64


def words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in the text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def unit(text: Column) -> Column:
    """A number in [0, 1) from a string's MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) of sizes (source, size).

    Targets share `share` times all sizes by weight. A target stops at `most` times its source's size, and what
    others may take of the excess is shared by weight again. In the order of most * size / weight the stopped sources
    come first, so sums over that order decide in one pass. One row a source is sorted: a table of sources, not rows.
    """
    of = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    of = of.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    line = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = line.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    of = of.withColumns({
        "capped_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "weight_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "total": F.lit(share) * F.sum("source_size").over(everything),
    })
    of = of.withColumn("stopped", F.col("cap") * F.col("weight_left") <= F.col("weight") * (F.col("total") - F.col("capped_before")))
    left = F.col("total") - F.sum(F.when(F.col("stopped"), F.col("cap")).otherwise(0.0)).over(everything)
    free = F.sum(F.when(F.col("stopped"), 0.0).otherwise(F.col("weight"))).over(everything)
    return of.select("source", "source_size", F.when(F.col("stopped"), F.col("cap")).otherwise(left * F.col("weight") / free).alias("target"))


def mix_plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, turned: int = TURNED, row: str | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for each row of docs (doc_id, text, source, ...).

    A source's rate is its target over its size. Each document is taken floor(rate) times and once more by a
    Bernoulli draw with the fraction as its probability: a hash of the document's source, doc_id and text is the
    draw's uniform number, so one document's draw does not depend on others. Then the draws of some of a source's
    `turned` largest documents are turned, in order of size from the largest, each where that makes up for what the
    source's taken words miss, or overshoots by less than half as much. What is left of the miss is at most two
    thirds of the smallest of these documents where they suffice; beyond (a source of n documents of like size needs about sqrt(n) / 2) it is what a plain draw of
    many documents misses, less theirs: relative to the target below 1 / sqrt(n).

    A source of size 0 has target 0 and its documents are taken once. Null text: size 0. Null source: a source of its
    own, last in order. Rows alike in source, doc_id and text are numbered and drawn each for itself; which of them
    is which does not show. Reruns agree: draws use only what the rows hold. An empty table gives an empty table.
    Other columns are not read. row names a column of docs that tells rows apart; it comes with the plan as row.
    """
    known = {} if row is None else {"row": F.col(row)}
    mark = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n"))
    rows = written(
        docs.select(
            "doc_id", "source", words(F.col("text")).alias("size"),
            F.md5(F.concat_ws("|", F.md5(mark("source")), mark("doc_id"), F.md5(mark("text")))).alias("lot"),
            F.monotonically_increasing_id().alias("place"), *(c.alias(name) for name, c in known.items()),
        )
    )
    names = ["doc_id", "source", "size", "lot", *known]
    # rows that are alike: few, but a group of them may hold most rows
    alike = written(rows.groupBy("lot").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("lot"))
    if not alike.isEmpty():
        single = rows.join(alike, "lot", "left_anti").select(*names, F.col("lot").alias("seed"))
        part = F.pmod(F.xxhash64("place"), F.lit(PARTS)).cast("int")
        many = numbered(rows.join(alike, "lot", "left_semi").withColumn("part", part), ["lot"], ["part"], [F.col("place")], "turn")
        rows = written(single.unionByName(many.select(*names, F.md5(F.concat_ws("#", "lot", F.col("turn").cast("string"))).alias("seed"))))
    else:
        rows = rows.select(*names, F.col("lot").alias("seed"))
    targets = written(source_targets(rows, weights, share, most).withColumnRenamed("source", "_s"))
    few = targets.count() <= 10_000  # the table of sources is sent to all tasks; beyond, a join
    of = F.broadcast(targets) if few else targets
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    drawn = rows.join(of, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("rate", rate)
    drawn = drawn.withColumn("extra", (unit(F.col("seed")) < F.col("rate") - F.floor("rate")).cast("long"))
    flips = written(turns(drawn, turned))
    out = drawn.join(F.broadcast(flips) if few else flips, "seed", "left")
    copies = F.floor("rate") + F.coalesce("now", "extra")
    return out.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size")).select("doc_id", "size", "source_size", "target", "copies", "taken", "source", *known)


def turns(drawn: DataFrame, turned: int = TURNED) -> DataFrame:
    """(seed, now) of the draws that are turned, of drawn (seed, source, size, target, rate, extra); see mix_plan().

    A source's taken words are summed before the shuffle, and its largest documents are limited before it too; a
    list of at most `turned` of them is folded with what the source's words miss.
    """
    free = drawn.filter("size > 0 and rate > floor(rate)")
    miss = drawn.groupBy("source").agg((F.sum((F.floor("rate") + F.col("extra")) * F.col("size")).cast("double") - F.first("target")).alias("miss"))
    w = W.partitionBy("source").orderBy(F.desc("size"), "seed")
    largest = free.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= turned)
    line = largest.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("rank", "size", "extra", "seed"))).alias("line"))
    line = line.join(miss.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))

    def step(state: Column, doc: Column) -> Column:
        size = doc["size"].cast("double")
        less = (doc["extra"] == 1) & (state["miss"] * 3 > size * 2)
        more = (doc["extra"] == 0) & (state["miss"] * -3 > size * 2)
        left = F.when(less, state["miss"] - size).when(more, state["miss"] + size).otherwise(state["miss"])
        flip = F.when(less | more, F.array(F.struct(doc["seed"].alias("seed"), (1 - doc["extra"]).alias("now")))).otherwise(F.array().cast("array<struct<seed:string,now:bigint>>"))
        return F.struct(left.alias("miss"), F.concat(state["flips"], flip).alias("flips"))

    start = F.struct(F.col("miss").alias("miss"), F.array().cast("array<struct<seed:string,now:bigint>>").alias("flips"))
    return line.select(F.explode(F.aggregate("line", start, step)["flips"]).alias("flip")).select("flip.seed", "flip.now")


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs, all columns, each as many times as mix_plan() takes it.

    docs is written once with a number for each row, which the plan carries and by which the copies are joined, so
    rows with equal or null doc_ids each get the copies that were drawn for them. Nulls, empty texts, repeated rows
    and an empty table are as in mix_plan(); names that clash with ours are left as they are.
    """
    (row,) = fresh(docs, "row")
    read = written(docs.withColumn(row, F.monotonically_increasing_id()))
    plan = settled(lambda: mix_plan(read, row=row, **parameters).filter("copies > 0").select("row", F.col("copies").cast("int").alias("copies")))
    return copied(read, row, plan).drop(row)
