"""Balanced shards that keep equal texts together, by label propagation under quotas, with DataFrame functions alone."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import discard, numbered, written

SHARDS = 40
#: Rows that one task numbers, about; parts of a numbering at least.
PART_ROWS, LEAST_PARTS = 20_000, 256


def at_index(values: list[int], index: Column) -> Column:
    """values[index]: an array of one entry a shard."""
    return F.element_at(F.array(*(F.lit(int(v)) for v in values)), (index + 1).cast("int"))


def interval(starts: list[int], index: Column) -> Column:
    """Number of the interval that holds index, of intervals that begin at starts (sorted, the first at 0)."""
    return F.size(F.filter(F.array(*(F.lit(int(v)) for v in starts)), lambda s: s <= index)) - 1


def let_in(asks: dict[tuple[int, int], int], capacity: list[int], heed: bool) -> tuple[dict, list, list[int], int]:
    """Where groups go that ask for a shard, the largest first: (runs, cut, room, cost).

    asks has the number of groups by (size, shard asked for). A shard's quota is its room: all its rows but those of
    groups let in before. runs has for each key of asks [(first group, shard)], or [(first group, -1 - i)] for a group
    that fits no shard and is cut into cut[i], [(rows, shard)]. Groups that their shard refuses go where the room is
    tightest; with heed=False they don't ask at all. A cut group fills the largest rooms, each but its last wholly, so
    at most one group a shard is cut. room is what is left for rows without links, cost the number of cut links.
    """
    room, runs, cut, cost = list(capacity), defaultdict(list), [], 0
    of_size = defaultdict(dict)
    for (size, shard), n in asks.items():
        of_size[size][shard] = n
    for size in sorted(of_size, reverse=True):
        refused = []
        for shard, n in sorted(of_size[size].items()):
            k = min(n, room[shard] // size) if heed else 0
            if k:
                runs[size, shard].append((0, shard))
                room[shard] -= k * size
            if k < n:
                refused.append((shard, k, n))
        for shard, first, n in refused:
            for to in sorted((s for s, r in enumerate(room) if r >= size), key=lambda s: (room[s], s != shard, s)):
                k = min(n - first, room[to] // size)
                if not k:
                    break
                runs[size, shard].append((first, to))
                room[to] -= k * size
                first += k
            while first < n:
                left, pieces = size, []
                for to in sorted(range(len(room)), key=lambda s: (-room[s], s != shard, s)):
                    k = min(left, room[to])
                    if not k:
                        break
                    pieces.append((k, to))
                    room[to] -= k
                    left -= k
                runs[size, shard].append((first, -1 - len(cut)))
                cut.append(pieces)
                cost += (size * size - sum(k * k for k, _ in pieces)) // 2
                first += 1
    return dict(runs), cut, room, cost


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, group, group_size) for each row of docs (doc_id, text, ...).

    Law `rows`: shards' counts of rows differ by one at most. Documents with equal texts are linked; a link between
    two shards is cut. Rows start in the shards by turns. A group takes the label of the shard where most of its rows
    are and asks to be let in there as a whole, large groups first (let_in). A shard's quota counts all room that its
    rows leave that are not let in: rows without links and rows of groups that go elsewhere, so shards exchange rows.
    A refused group takes the label of a shard that has room for all of it; it is cut only if none has, which at most
    one group a shard can be. After that each group's label is that of the shard where all its rows are, so another
    round would move nothing. Rows without links fill the room that is left. Should asking cut more links than
    packing the groups without regard to where they started, they are packed.

    size is the text's UTF-8 bytes (null: none) plus 16; text_crc32 is of the UTF-8 bytes, null as empty; null and
    empty texts are equal. slot is gapless from 0 in each shard. Repeated rows are rows of their own. Shards without
    rows don't occur; an empty table gives an empty table. Other columns are not read. Texts are read once; joins
    move slim rows, hot groups are split by AQE or counted before the shuffle, and to the driver come only counts of
    groups by size and shard: n rows have at most sqrt(2n) sizes.
    """
    text = F.coalesce("text", F.lit(""))
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.substring(F.sha2(text, 256), 1, 32).alias("g"), F.monotonically_increasing_id().alias("row"),
    )
    rows = written(read)
    n = rows.count()
    parts = max(LEAST_PARTS, -(-n // PART_ROWS))
    capacity = [n // shards + (s < n % shards) for s in range(shards)]
    counts = rows.groupBy("g", F.pmod("row", F.lit(shards)).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    # the hash breaks ties evenly
    most = F.max(F.struct("n", F.xxhash64("g", "shard").alias("tie"), "shard"))["shard"]
    groups = written(counts.groupBy("g").agg(F.sum("n").alias("group_size"), most.alias("asked")).filter("group_size > 1"))
    asks = {(r["group_size"], r["asked"]): r["n"] for r in groups.groupBy("group_size", "asked").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, cut, room, _ = min((let_in(asks, capacity, heed) for heed in (True, False)), key=lambda p: p[-1])
    labelled = written(labels(groups, runs, parts))
    discard(groups)
    # a table of its own: joined to the plain aggregate, a hot group's rows could not be split over tasks
    state = written(rows.join(labelled, "g", "left"))
    discard(rows)
    discard(labelled)
    part = F.pmod(F.xxhash64("g", "row"), F.lit(parts)).cast("int")
    single = state.filter("label is null").withColumns({"all": F.lit(0), "part": part, "group_size": F.lit(1).cast("long")})
    single = numbered(single, ["all"], ["part"], [F.col("row")], "place").withColumn("shard", filled([(k, s) for s, k in enumerate(room) if k], F.col("place")))
    out = state.filter("label >= 0").withColumn("shard", F.col("label")).unionByName(single.drop("all", "part", "place"))
    if cut:
        pieces = numbered(state.filter("label < 0").withColumn("part", part), ["g"], ["part"], [F.col("row")], "place")
        # the cut groups' pieces one after another, as one line of intervals: a group and shard at most each
        before, line = [], []
        for of in cut:
            before.append(sum(k for k, _ in line))
            line += of
        pieces = pieces.withColumn("shard", filled(line, F.col("place") + at_index(before, -1 - F.col("label"))))
        out = out.unionByName(pieces.drop("part", "place"))
    out = written(out.drop("label"))
    discard(state)
    slots = numbered(out.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(max(1, parts // shards + 1))).cast("int")), ["shard"], ["part"], [F.col("row")], "slot")
    return slots.select("doc_id", "size", "text_crc32", "shard", "slot", F.col("g").alias("group"), "group_size")


def filled(line: list[tuple[int, int]], index: Column) -> Column:
    """Shard of the row at index, where rows fill a line of (rows, shard)."""
    starts, total = [], 0
    for k, _ in line:
        starts.append(total)
        total += k
    return at_index([s for _, s in line], interval(starts, index)) if line else F.lit(None).cast("int")


def labels(groups: DataFrame, runs: dict[tuple[int, int], list[tuple[int, int]]], parts: int) -> DataFrame:
    """(g, group_size, label) of groups (g, group_size, asked): the shard that let_in() found, or -1 - i if cut."""
    of = groups.sparkSession.createDataFrame(
        [(size, asked, [a for a, _ in run], [b for _, b in run]) for (size, asked), run in runs.items()],
        "group_size long, asked int, firsts array<long>, tos array<int>",
    )
    turns = numbered(groups.withColumn("part", F.pmod(F.xxhash64("g"), F.lit(parts)).cast("int")), ["group_size", "asked"], ["part"], [F.col("g")], "turn")
    last = F.size(F.filter("firsts", lambda first: first <= F.col("turn")))
    # one row a size and shard, not a row
    return turns.join(F.broadcast(of), ["group_size", "asked"]).select("g", "group_size", F.element_at("tos", last).alias("label"))
