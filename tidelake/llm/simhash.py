"""Near-duplicates by SimHash, found by Golay-code fuzzy hashing.

The binary Golay code of length 23 is perfect: each 23-bit word lies within 3 bits of one codeword. A fingerprint's
segments are decoded to nearby codewords, whose 12-bit indices make the keys under which fingerprints meet.

Two ways to decode are used. Links of at most 4 bits between 64-bit fingerprints are found without loss (see
exact_keys). Links by similarity of the shingle sets use wider fingerprints, decoded by the margins of their bits
(see soft_keys), and then verify each link on the sets themselves.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import components, copied, fresh, partitions, settled, written

#: Members of a bucket that are compared in one piece; larger buckets are compared in pairs of blocks.
BLOCK = 4096
#: Parts of the keys that are counted before single keys are.
CELLS = 1 << 20
#: Distinct fingerprints from which on longer keys are cheaper than the pairs that shorter ones bring together.
MANY = 1 << 30
#: Documents of a group whose shingle sets are compared in one piece.
SET_BLOCK = 128
SEED = 42


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 (UTF-8, seed 42) of each k-word shingle, repeats included; fewer words: of the whole sequence."""
    # bytes.lower() changes A-Z alone and bytes.split() splits at [\x20\x09-\x0D] alone
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    pieces = map(joined.__getitem__, map(slice, starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, itertools.repeat(SEED)), np.uint64, len(words) - k + 1)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, highest first."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return counts


def widened(hashes: np.ndarray, part: int) -> np.ndarray:
    """The hashes for 64 more bits of a wide fingerprint: themselves for part 0, else mixed anew."""
    if not part:
        return hashes
    h = hashes + np.uint64(part * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: str | None, k: int = 4) -> int:
    """64 bits; one is 1 if set in over half the shingles' hashes. No words: 0."""
    h = shingle_hashes(text, k)
    return int.from_bytes(np.packbits(bit_counts(h) * 2 > len(h)).tobytes(), "big") if len(h) else 0


# ---------------------------------------------------------------- the Golay code


@functools.cache
def codewords() -> np.ndarray:
    """The 4096 codewords by index: the index, and 11 check bits from the generator polynomial x^11+x^9+x^7+x^6+x^5+x+1."""
    index = np.arange(4096, dtype=np.uint32)
    rest = index << np.uint32(11)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> np.uint32(bit) & np.uint32(1), rest ^ np.uint32(0b101011100011 << (bit - 11)), rest)
    return index << np.uint32(11) | rest


@functools.cache
def near_codewords() -> tuple[np.ndarray, np.ndarray]:
    """For each 23-bit word: how many codewords are within 4 bits (1 or 6), and their indices (2^23 x 6 of 16 bits).

    Two words at most 2 bits apart have a word between them, at most 1 bit from both, and its codeword is within 3
    bits of it and so within 4 bits of both: their lists share an index.
    """
    lists = np.zeros((1 << 23, 6), np.uint16)
    filled = np.zeros(1 << 23, np.uint8)
    words = codewords()
    for weight in range(5):
        for bits in itertools.combinations(range(23), weight):
            at = words ^ np.uint32(sum(1 << b for b in bits))
            lists[at, filled[at]] = np.arange(4096, dtype=np.uint16)
            filled[at] += 1
    return filled, lists


#: Bits of a 64-bit fingerprint that its three segments take; each is padded with zeros to 23.
SEGMENTS = ((42, 22), (21, 21), (0, 21))


def exact_keys(prints: np.ndarray, three: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(key, position) such that fingerprints at most 4 bits apart share a key.

    With the errors of the three segments adding up to 4 at most, either a segment has none and one of the two others
    has at most 2: keys of one exact segment and one decoded segment, 33 or 34 bits. Or all have at least one, so all
    have at most 2: keys of the first two decoded, 24 bits, or, where three is set, of all three, 36 bits. The latter
    are about 150 keys a fingerprint instead of 28 and meet by chance 4,096 times as seldom.
    """
    filled, lists = near_codewords()
    seg = [(prints >> np.uint64(lo)) & np.uint64((1 << n) - 1) for lo, n in SEGMENTS]
    near = [(filled[s], lists[s].astype(np.uint64)) for s in seg]
    keys, rows, at = [], [], np.arange(len(prints))
    for kind, (i, j) in enumerate(itertools.permutations(range(3), 2), 1):
        n, ids = near[j]
        for c in range(6):
            have = n > c
            keys.append((np.uint64(kind) << np.uint64(60) | seg[i] << np.uint64(12) | ids[:, c])[have])
            rows.append(at[have])
    decoded = range(3 if three else 2)
    for choice in itertools.product(range(6), repeat=len(decoded)):
        have = np.logical_and.reduce([near[i][0] > c for i, c in zip(decoded, choice)])
        key = np.zeros(int(have.sum()), np.uint64)
        for i, c in zip(decoded, choice):
            key = key << np.uint64(12) | near[i][1][have, c]
        keys.append(key)
        rows.append(at[have])
    return np.concatenate(keys).view(np.int64), np.concatenate(rows)


#: A wide fingerprint: 5 x 64 bits, 12 segments of 23 bits (the last bits are left over). Candidates are compared by
#: the first COMPARED x 64 bits, so that the rows of the buckets stay short. PROBES: keys with a second-nearest codeword.
WIDE, WIDE_SEGMENTS, COMPARED, PROBES = 5, 12, 2, 114


@functools.cache
def code_signs() -> np.ndarray:
    bits = codewords()[None, :] >> np.arange(22, -1, -1, dtype=np.uint32)[:, None] & np.uint32(1)
    return bits.astype(np.float32) * 2 - 1


def soft_codes(margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two nearest codewords of each segment (rows x segments x 2), and by how much the second is further off.

    Nearest weighs a bit by its margin: the bits in which similar texts differ are those with a small margin, so they
    seldom change the codeword.
    """
    signs = code_signs()
    near = np.empty((len(margins), WIDE_SEGMENTS, 2), np.uint16)
    gap = np.empty((len(margins), WIDE_SEGMENTS), np.float32)
    for s in range(WIDE_SEGMENTS):
        for i in range(0, len(margins), 2048):
            scores = margins[i : i + 2048, s * 23 : s * 23 + 23] @ signs
            rows = np.arange(len(scores))
            best = np.argmax(scores, axis=1)
            top = scores[rows, best]
            scores[rows, best] = -np.inf
            second = np.argmax(scores, axis=1)
            near[i : i + 2048, s, 0], near[i : i + 2048, s, 1] = best, second
            gap[i : i + 2048, s] = top - scores[rows, second]
    return near, gap


def soft_keys(near: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Keys (rows x 180): of each two segments' nearest codewords, and PROBES with a second-nearest one in them.

    The probes are those with the smallest gaps, which are likeliest to be a similar text's own. Of pairs of texts
    whose shingles have a Jaccard similarity of 0.8, all but 5 to 9 in 1,000 share a key in simulations, at 0.85 all.
    """
    i, j = np.array(list(itertools.combinations(range(WIDE_SEGMENTS), 2))).T
    codes = near.astype(np.int64)
    key = lambda a, b: np.arange(len(i)) << 24 | codes[:, i, a] << 12 | codes[:, j, b]
    probes = np.concatenate((key(1, 0), key(0, 1), key(1, 1)), axis=1)
    cost = np.concatenate((gap[:, i], gap[:, j], gap[:, i] + gap[:, j]), axis=1)
    best = np.argpartition(cost, PROBES - 1, axis=1)[:, :PROBES]
    return np.concatenate((key(0, 0), np.take_along_axis(probes, best, axis=1)), axis=1)


# ---------------------------------------------------------------- links within buckets


def distances(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.bitwise_count(many ^ one).sum(-1, dtype=np.int32)


def forest(prints: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links (positions) that join all of prints (n x words of 64 bits) that links of at most `most` bits join."""
    links, left = [], np.arange(len(prints))
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            hit = distances(prints[at], prints[left]) <= most
            if hit.any():
                links += [(at, x) for x in left[hit]]
                todo += left[hit].tolist()
                left = left[~hit]
    return links


class Sets:
    """Union-find over the nodes that one task has linked: at most one link a node leaves a task."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while (y := up.get(x, x)) != root:
            up[x] = root
            x = y
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Batches of sorted rows, cut so that rows equal in the first `keys` columns stay together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        if held:
            change[0] = any(held[-1].column(i)[-1].as_py() != cols[i][0].item() for i in range(keys))
        cuts = np.flatnonzero(change)
        if len(cuts):
            if out := held + ([batch.slice(0, cuts[-1])] if cuts[-1] else []):
                yield pa.Table.from_batches(out)
            held = [batch.slice(cuts[-1])]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def words_of(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """n x width words of 64 bits from a column of binary fingerprints, all of one length."""
    arr = column.combine_chunks()
    arr = arr.chunk(0) if isinstance(arr, pa.ChunkedArray) else arr
    data = np.frombuffer(arr.buffers()[2], np.uint8) if len(arr) else np.empty(0, np.uint8)
    start = arr.offset * width * 8
    first = np.frombuffer(arr.buffers()[1], np.int32)[arr.offset] if len(arr) else start
    return data[first : first + len(arr) * width * 8].view(np.uint64).reshape(-1, width)


def hot_keys(keyed: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, blocks) of the keys that more than `block` rows hold.

    Cells, each a part of the keys by their hash, are counted first, which pre-aggregates well; only keys in cells with
    more than `block` rows are then counted themselves. However full the cells are, the keys found are the same.
    """
    cell = F.pmod(F.hash("key"), F.lit(CELLS))
    full = written(keyed.select(cell.alias("cell")).groupBy("cell").count().filter(F.col("count") > block).select("cell"))
    if full.isEmpty():
        return keyed.sparkSession.createDataFrame([], "key long, blocks int")
    some = keyed.select("key", cell.alias("cell")).join(F.broadcast(full), "cell", "left_semi")  # at most CELLS rows
    return written(some.groupBy("key").count().filter(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks")))


def bucket_links(keyed: DataFrame, most: int, width: int, block: int = BLOCK) -> DataFrame:
    """(a, b) links of keyed (key, node, print) that join what shared keys and at most `most` differing bits join.

    Buckets are sorted runs within a task. Where a key is held by more than `block` rows, its nodes are dealt to
    blocks by their hash and each two blocks meet in a task of their own, so no task holds a large bucket and no pair
    is left out; rows of other keys are never copied. The links of a task are a forest.
    """
    spark = keyed.sparkSession
    hot = hot_keys(keyed, block)
    n_hot = hot.count()
    if n_hot:
        side = F.broadcast(hot) if n_hot <= 100_000 else hot
        met = keyed.join(side, "key", "left")
        own = F.pmod(F.hash("node"), F.col("blocks"))
        each = F.when(F.col("blocks") > 1, F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(own, j).cast("long") * F.col("blocks") + F.greatest(own, j))).otherwise(F.array(F.lit(0).cast("long")))
        met = met.select("key", F.explode(each).alias("part"), "node", "print")
    else:
        met = keyed.select("key", F.lit(0).cast("long").alias("part"), "node", "print")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets()
        for table in runs(batches, 2):
            key, part = (table.column(i).to_numpy() for i in range(2))
            start = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]))))
            size = np.diff(np.concatenate((start, [len(key)])))
            if size.max() < 2:
                continue
            node, prints = table.column(2).to_numpy(), words_of(table.column(3), width)
            found: list[tuple[int, int]] = []
            small = np.repeat(size <= 32, size)
            last = np.repeat(start + size, size)
            at = np.flatnonzero(small & (last - np.arange(len(key)) > 1))
            step = 1
            while len(at):
                hit = at[np.bitwise_count(prints[at] ^ prints[at + step]).sum(-1) <= most]
                found += zip(hit.tolist(), (hit + step).tolist())
                step += 1
                at = at[last[at] - at > step]
            for s, n in zip(start[size > 32].tolist(), size[size > 32].tolist()):
                found += [(s + a, s + b) for a, b in forest(prints[s : s + n], most)]
            out = [(x, y) for a, b in found if (x := int(node[a])) != (y := int(node[b])) and sets.join(x, y)]
            if out:
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return met.repartition(partitions(spark), "key", "part").sortWithinPartitions("key", "part").mapInArrow(links, "a long, b long")


# ---------------------------------------------------------------- the operator by fingerprints


def fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """(doc_id, print): the 64-bit fingerprint as a long, of each row's whole text."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.fromiter((fingerprint(t.as_py(), k) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out.view(np.int64))], ["doc_id", "print"])

    return docs.select("doc_id", "text").mapInArrow(prints, "doc_id long, print long")


def simhash_components(docs: DataFrame, k: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs (doc_id, text, ...): links of at most 4 bits.

    component_id is the smallest doc_id reachable by links, itself included. Null and empty texts and texts of white
    space have fingerprint zero and are linked like any other. Equal fingerprints are one node, so groups of copies
    cost one row from there on. A null doc_id counts as larger than others: its row has the component of its group,
    null if the group has no other doc_id. Repeated rows stay. An empty table gives an empty table. Other columns are
    not read.
    """
    prints = written(fingerprints(docs, k))
    return prints.join(settled(lambda: _components_of(prints)), "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _components_of(prints: DataFrame) -> DataFrame:
    """(print, component_id) of each distinct fingerprint of prints (doc_id, print)."""
    # a group's node is its fingerprint; doc_ids come in at the end
    nodes = written(prints.groupBy("print").agg(F.min("doc_id").alias("least")))

    three = nodes.count() >= MANY  # both kinds of keys find the same links

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(p), 2000):
                key, row = exact_keys(p[i : i + 2000], three)
                node = p[i : i + 2000][row]
                raw = pa.Array.from_buffers(pa.binary(), len(node), [None, pa.py_buffer(np.arange(0, 8 * len(node) + 1, 8, dtype=np.int32)), pa.py_buffer(node)])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node.view(np.int64)), raw], ["key", "node", "print"])

    keyed = nodes.select("print").mapInArrow(keys, "key long, node long, print binary")
    joined = components(written(bucket_links(keyed, 4, 1)))
    of = nodes.join(joined, nodes["print"] == joined["node"], "left").select("print", "least", F.coalesce("component", "print").alias("component"))
    # a table of its own: joined to the plain aggregate, a large component's rows could not be split over tasks
    least = written(of.groupBy("component").agg(F.min("least").alias("component_id")))
    return of.join(least, "component").select("print", "component_id")


# ---------------------------------------------------------------- the operator by similarity


def similar_groups(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """(row, node, group) of docs (row, doc_id, text): see near_kept() for links, nulls, empty texts and repeated rows.

    node is the row that stands for all with the same set of shingles, group the smallest node that links reach. An
    empty table gives an empty table.
    """

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, raw = np.empty((batch.num_rows, 64 * WIDE), np.float32), []
            sets = []
            for i, t in enumerate(batch.column(1)):
                h = np.unique(shingle_hashes(t.as_py(), k))
                for part in range(WIDE):
                    counts[i, 64 * part : 64 * part + 64] = bit_counts(widened(h, part)) * 2 - len(h)
                counts[i] /= max(1, len(h)) ** 0.5
                raw.append(np.packbits(counts[i, : 64 * COMPARED] > 0).tobytes())
                sets.append(h.tobytes())
            near, gap = soft_codes(counts)
            sketch = [a.tobytes() + b.tobytes() for a, b in zip(near, gap)]
            sizes = pa.array([len(s) // 8 for s in sets], pa.int64())
            sums = pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array(sketch, pa.binary()), sizes, sums], ["row", "print", "sketch", "n", "set_hash"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = 4 * WIDE_SEGMENTS
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                n = batch.num_rows
                sketch = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(n, -1)
                near = np.ascontiguousarray(sketch[:, :cut]).view(np.uint16).reshape(n, WIDE_SEGMENTS, 2)
                key = soft_keys(near, np.ascontiguousarray(sketch[:, cut:]).view(np.float32))
                each = key.shape[1]
                prints = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, -1)
                ends = np.arange(n * each + 1, dtype=np.int32) * prints.shape[1]
                raw = pa.Array.from_buffers(pa.binary(), n * each, [None, pa.py_buffer(ends), pa.py_buffer(np.repeat(prints, each, axis=0))])
                node = batch.column(0).to_numpy().repeat(each)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(node), raw], ["key", "node", "print"])

    prints = written(docs.select("row", "text").mapInArrow(wide, "row long, print binary, sketch binary, n long, set_hash binary"))
    # texts with equal sets of shingles are one node
    nodes = written(prints.groupBy("set_hash").agg(F.min(F.struct("row", "print", "sketch")).alias("x")).select("set_hash", F.col("x.row").alias("node"), F.col("x.print").alias("print"), F.col("x.sketch").alias("sketch")))
    # bits differ for 15 of 100 at a similarity of 0.8; five deviations more are let through and verified on the sets
    angle = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    bits = 64 * COMPARED
    most = int(bits * angle + 5 * (bits * angle * (1 - angle)) ** 0.5)
    keyed = nodes.select("node", "print", "sketch").mapInArrow(keys, "key long, node long, print binary")
    near = settled(lambda: components(written(bucket_links(keyed, most, COMPARED))))
    exact = settled(lambda: components(written(set_links(docs, near, k, similarity))))
    of = nodes.join(exact, "node", "left").select("set_hash", "node", F.coalesce("component", "node").alias("group"))
    out = prints.select("row", "set_hash").join(of, "set_hash").select("row", "node", "group")
    return out


def set_links(docs: DataFrame, near: DataFrame, k: int, similarity: float) -> DataFrame:
    """(a, b) links of at least `similarity` between the shingle sets of near (node, component)'s documents.

    A component is dealt to blocks of about SET_BLOCK documents and each two blocks meet in one piece, which finds
    the links by the shingles that they share; so a large component is spread over many tasks. docs (row, doc_id,
    text) may have null and empty texts, which are sets without shingles; no near, no links.
    """
    sizes = near.groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    sizes = written(sizes.withColumn("blocks", F.ceil(F.col("m") / SET_BLOCK).cast("int")).select("component", "blocks"))
    own = F.pmod(F.hash("node"), F.col("blocks"))
    each = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(own, j).cast("long") * F.col("blocks") + F.greatest(own, j))
    placed = near.join(sizes, "component").select(F.col("node").alias("row"), "component", each.alias("parts"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.unique(shingle_hashes(t.as_py(), k)).tobytes() for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(raw, pa.binary())], ["row", "component", "parts", "hashes"])

    shingled = docs.select("row", "text").join(placed, "row").select("row", "component", "parts", "text").mapInArrow(sets, "row long, component long, parts array<long>, hashes binary")
    pieces = shingled.select("component", F.explode("parts").alias("part"), "row", "hashes")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = Sets()
        for table in runs(batches, 2):
            key, part = (table.column(i).to_numpy() for i in range(2))
            start = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]))))
            out = []
            for s, e in zip(start.tolist(), [*start[1:].tolist(), len(key)]):
                if e - s > 1:
                    rows = table.column(2).slice(s, e - s).to_pylist()
                    for a, b in similar_pairs([np.frombuffer(x.as_py(), np.uint64) for x in table.column(3).slice(s, e - s)], similarity):
                        if joined.join(rows[a], rows[b]):
                            out.append((rows[a], rows[b]))
            if out:
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return pieces.repartition(partitions(docs.sparkSession), "component", "part").sortWithinPartitions("component", "part").mapInArrow(links, "a long, b long")


def similar_pairs(sets: list[np.ndarray], similarity: float) -> Iterator[tuple[int, int]]:
    """Positions of sets (sorted, no repeats) with a Jaccard similarity of at least `similarity`."""
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    for i, a in enumerate(order):
        others = order[i + 1 :]
        others = others[n[others] * similarity <= n[a] + 1e-9] if n[a] else others[n[others] == 0]
        if not len(others):
            continue
        if not n[a]:
            yield from ((int(a), int(b)) for b in others)
            continue
        # all shingles of the others, looked up in a's
        flat = np.concatenate([sets[b] for b in others])
        found = sets[a][np.minimum(np.searchsorted(sets[a], flat), n[a] - 1)] == flat
        both = np.add.reduceat(found, np.concatenate(([0], np.cumsum(n[others])[:-1])), dtype=np.int64)
        union = n[a] + n[others] - both
        for b in others[both >= similarity * union - 1e-9]:
            yield int(a), int(b)


def near_kept(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs (doc_id, text, ...), all columns, without near copies: one row of each group stays.

    Rows are linked if the sets of their k-word shingles have a Jaccard similarity of at least `similarity`; groups
    are what links join. The row with the most code points stays, of those the smallest doc_id (null last). Texts
    without words are one group; null counts as empty. Fingerprints of 5 x 64 bits give the candidates: those that
    share a key (soft_keys) and differ in few bits are near, and sets decide within what is near. A link can be
    missed only where all its keys differ: see soft_keys for how often.
    """
    (row,) = fresh(docs, "row")
    read = written(docs.withColumn(row, F.monotonically_increasing_id()))
    slim = read.select(F.col(row).alias("row"), "doc_id", "text")
    # bitwise not turns the order round and, unlike a minus, holds for every long
    rank = F.struct(F.coalesce(F.char_length("text"), F.lit(0)).alias("n"), F.col("doc_id").isNotNull().alias("known"), F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).alias("low"), F.bitwise_not("row").alias("first"))

    def staying() -> DataFrame:
        ranked = similar_groups(slim, k, similarity).join(slim.select("row", rank.alias("rank")), "row")
        return ranked.groupBy("group").agg(F.bitwise_not(F.max("rank")["first"]).alias("row")).select("row", F.lit(1).alias("copies"))

    return copied(read, row, settled(staying), bits=1).drop(row)
