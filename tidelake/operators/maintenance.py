"""Upkeep of measurements: dedup, compaction, retention, deletion, tiers, reconciliation."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidelake import paths
from tidelake.catalog import COLD, DAY, HOT, HOUR, PARQUET, SEQUENCE, WHOLE_DAY, Lake

#: Files of an hour from which it is compacted, and of a day; rows that one deletion may take.
LEAST_FILES, LEAST_DAY_FILES, MOST_DELETED = 10, 12, 1_000_000
#: Files that one job of compaction reads, about; bytes of a file that holds a whole day, about.
FILES_AT_ONCE, DAY_BYTES = 5_000, 512 << 20


def dedup(df: DataFrame, tags: list[str], dedup_time: bool = False, newest: str = SEQUENCE) -> DataFrame:
    """One row of each time and tags: the one written last. Without tags and mark nothing is a duplicate.

    Of rows of one write the largest by their columns stays, so reruns agree.
    """
    keys = ["time", *(t for t in tags if t in df.columns)] if not dedup_time else ["time"]
    if len(keys) == 1 and not dedup_time:
        return df
    rest = [F.col(f"`{c}`").desc_nulls_last() for c in df.columns if c not in keys and c != newest and df.schema[c].dataType.typeName() != "map"]
    first = [F.col(newest).desc_nulls_last()] if newest in df.columns else []
    w = W.partitionBy(*keys).orderBy(*first, *rest) if first or rest else W.partitionBy(*keys).orderBy(F.lit(1))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def swap(lake: Lake, df: DataFrame, path: str, old: list[str], known: dict, parts: int | None = None) -> None:
    """Replaces the files `old` below path by df's rows: written aside first, then moved in, then the old ones go.

    A failure in between leaves rows twice, never none. Each swap has a folder of its own, so others may run beside it.
    parts: the files that a folder's rows are dealt to by time; the measurement's files_per_hour by hash unless stated.
    """
    spark = lake.spark
    aside = f"{path}/_swap-{uuid.uuid4().hex}"
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    share = F.floor((F.hour("time") * 60 + F.minute("time")) * F.lit(parts) / 1440) if parts else F.pmod(F.hash("time"), F.lit(known["files_per_hour"]))
    dealt = df.repartition(tasks, DAY, HOUR, share)
    keys = [k for k in known["sort_keys"] if k in df.columns and k != "time"]
    dealt.sortWithinPartitions(DAY, HOUR, *keys, "time").write.partitionBy(DAY, HOUR).options(**PARQUET).parquet(aside)
    mark = f"/{aside.rsplit('/', 1)[1]}/"
    paths.each(lambda f: paths.move(spark, f, f"{path}/{f[f.index(mark) + len(mark) :]}"), [f for f, _, _ in paths.files(spark, aside)])
    paths.each(lambda f: paths.delete(spark, f), old)
    paths.delete(spark, aside)


def by_folder(lake: Lake, path: str) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for f, _, _ in paths.files(lake.spark, path):
        if (folder := folder_of(f)).startswith(f"{DAY}="):
            found.setdefault(folder, []).append(f)
    return found


def folder_of(file: str) -> str:
    """dt=.../hr=... of a file."""
    return "/".join(file.split("/")[-3:-1])


def folder_ends(folder: str) -> datetime:
    """The end of the hour, or the day, that a folder holds."""
    if folder.endswith(f"{HOUR}={WHOLE_DAY}"):
        return datetime.strptime(folder.split("/")[0], f"{DAY}=%Y-%m-%d") + timedelta(days=1)
    return datetime.strptime(folder.replace(f"{DAY}=", "").replace(f"/{HOUR}=", " "), "%Y-%m-%d %H") + timedelta(hours=1)


def compact(lake: Lake, db: str, name: str, least: int = LEAST_FILES, older_than: datetime | None = None, daily: bool = False, at_once: int = FILES_AT_ONCE) -> dict:
    """Rewrites hours with at least `least` files: sorted, deduplicated by tags and time, few files.

    daily: rewrites days, whose hours' files become the day's own, in a folder beside the hours, one for about each
    DAY_BYTES; hours that come later are united with them by the next run. Only hours (days) that end before
    older_than are taken, and only their files are read, about `at_once` in one job; none is split over two. Files that
    are no Parquet are left where they are; one that breaks later fails its job before anything is deleted. Where
    writes differed in a column's type and all files have been rewritten alike, reads open single files no more.
    """
    spark, path, known = lake.spark, lake.path(db, name), lake.properties(db, name)
    sizes = {f: n for f, n, _ in paths.files(spark, path)} if daily else {}
    folders = by_folder(lake, path)
    groups: dict[str, list[str]] = {}
    for folder in folders:
        groups.setdefault(folder.split("/")[0] if daily else folder, []).append(folder)
    chosen, before, batch = [], 0, []

    def flush() -> None:
        if batch:
            rows = dedup(lake._scan(path, batch), known["tags"], known["dedup_time"])
            days = len({f.split("/")[-3] for f in batch})
            parts = max(1, round(sum(sizes[f] for f in batch) / days / DAY_BYTES)) if daily else None
            swap(lake, rows.withColumn(HOUR, F.lit(WHOLE_DAY)) if daily else rows, path, batch, known, parts)
            batch.clear()

    for group, fs in groups.items():
        ends = folder_ends(f"{group}/{HOUR}={WHOLE_DAY}" if daily else group)
        if sum(len(folders[f]) for f in fs) < least or (older_than is not None and ends > older_than):
            continue
        sound = paths.parquet_only(spark, [f for folder in fs for f in folders[folder]])
        if len(sound) < least:
            continue
        chosen += fs
        before += len(sound)
        batch += sound
        if len(batch) >= at_once:
            flush()
    flush()
    after = by_folder(lake, path)
    now = {*chosen, *(f"{f.split('/')[0]}/{HOUR}={WHOLE_DAY}" for f in chosen if daily)}
    left = sum(len(folders[f]) for f in chosen) - before
    if known["mixed"] and not lake.cold and set(chosen) == set(folders) and not left:
        lake.settle(db, name)
    return {"folders": len(chosen), "files_before": before, "files_after": sum(len(after.get(f, [])) for f in now) - left}


def retain(lake: Lake, db: str, name: str, days: float, now: datetime, buffer_days: float = 0, dry_run: bool = False) -> list[str]:
    """Deletes whole files whose latest time is older than the limit; never single rows."""
    limit = now - timedelta(days=days + buffer_days)
    gone = []
    for tier in lake.tiers():
        df = lake._scan(lake.path(db, name, tier))
        if df is None:
            continue
        # folders of later days cannot hold such files, and are pruned
        of = df.filter(F.col(DAY) <= limit.strftime("%Y-%m-%d")).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.max("time").alias("last"))
        gone += [unquote(r["file"]) for r in of.filter(F.col("last") < F.lit(str(limit)).cast("timestamp_ntz")).collect()]  # one row a file
    if not dry_run:
        paths.each(lambda f: paths.delete(lake.spark, f), gone)
    return sorted(gone)


def always(df: DataFrame, condition: str) -> bool:
    """Whether the optimiser leaves nothing of a condition but that columns are known, or equal to themselves."""

    def holds(e) -> bool:
        kind = e.getClass().getSimpleName()
        if kind == "And":
            return holds(e.left()) and holds(e.right())
        if kind == "Or":
            return holds(e.left()) or holds(e.right())
        if kind in ("EqualTo", "EqualNullSafe", "GreaterThanOrEqual", "LessThanOrEqual"):
            return e.left().semanticEquals(e.right())
        if kind == "In":
            values = e.list()
            return any(values.apply(i).semanticEquals(e.value()) for i in range(values.size()))
        return kind == "IsNotNull" or kind in ("Literal", "TrueLiteral$") and str(e) == "true"

    plan = df.filter(condition)._jdf.queryExecution().optimizedPlan()
    todo, left = [plan], []
    while todo:
        p = todo.pop()
        if p.nodeName() == "Filter":
            left.append(p.condition())
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return plan.nodeName() != "LocalRelation" and all(map(holds, left))  # the former: it never holds


def delete_where(lake: Lake, db: str, name: str, condition: str, confirm: bool = False, dry_run: bool = False, most: int = MOST_DELETED) -> dict:
    """Deletes the rows for which the condition holds, in all tiers; rows for which it is unknown stay.

    Only files with such rows are read again and rewritten. A condition that always holds, however it is written, needs
    confirm; more rows than `most` are refused.
    """
    predicate = F.coalesce(F.expr(condition), F.lit(False))
    if not confirm and always(lake.read(db, name, planned=True), condition):
        raise ValueError("the condition holds for all rows; confirm=True is needed")
    hit: dict[str, dict[str, int]] = {}
    for tier in lake.tiers():
        path = lake.path(db, name, tier)
        if (df := lake._scan(path)) is not None:
            per_file = df.filter(predicate).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
            hit[path] = {unquote(r["file"]): r["n"] for r in per_file.collect()}  # one row a file
    n = sum(sum(found.values()) for found in hit.values())
    if n > most:
        raise ValueError(f"{n} rows match; at most {most} may be deleted at once")
    for path, found in hit.items():
        if found and not dry_run:
            swap(lake, lake._scan(path, list(found)).filter(~predicate), path, list(found), lake.properties(db, name))
    return {"rows": n, "files": sum(map(len, hit.values()))}


def migrate(lake: Lake, db: str, name: str, max_age_days: float, now: datetime, hot_only: bool = False) -> list[str]:
    """Moves whole hours that ended more than max_age_days ago to the cold tier."""
    if hot_only or not lake.cold:
        return []
    limit, moved, old = now - timedelta(days=max_age_days), [], []
    for folder, files in by_folder(lake, lake.path(db, name, HOT)).items():
        if folder_ends(folder) <= limit:
            old += files
            moved.append(folder)

    def move(f: str) -> None:
        # copied before it is deleted: a failure leaves a second copy, never none
        target = f"{lake.path(db, name, COLD)}/{'/'.join(f.split('/')[-3:])}"
        if not paths.exists(lake.spark, target):
            paths.copy(lake.spark, f, target)
        paths.delete(lake.spark, f)

    paths.each(move, old)
    return sorted(moved)


def reconcile(stored: DataFrame, listed: DataFrame, key: str = "path", grace_ms: int = 0, now_ms: int = 0) -> DataFrame:
    """(path, problem) of files that a store or its list lacks: 'orphan' (not listed, older than the grace), 'missing'."""
    orphan = stored.join(listed, key, "left_anti")
    if "modified" in stored.columns:
        orphan = orphan.filter(F.col("modified") <= now_ms - grace_ms)
    return orphan.select(key, F.lit("orphan").alias("problem")).unionByName(listed.join(stored, key, "left_anti").select(key, F.lit("missing").alias("problem")))


def normalised_time(c: Column) -> Column:
    """A time kept as text of either form."""
    return F.coalesce(c.try_cast("timestamp_ntz"), F.timestamp_add("MICROSECOND", c.try_cast("long"), F.lit("1970-01-01").cast("timestamp_ntz")))
