"""A quality classifier: supervised subword embeddings, trained by numpy stochastic gradient descent."""

from __future__ import annotations

import collections
import dataclasses
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on at most, taken by the hash of their doc_id, whole texts each.
FIT_ROWS = 4000
#: Hash buckets of the embedding table (their numbers take 16 bits), its width, lengths of the character n-grams.
BUCKETS, WIDTH, GRAMS = 1 << 16, 8, (3, 4)
EPOCHS, RATE, SMALL_BATCH = 8, 0.5, 16
THRESHOLD = 0.7
#: The last buckets are kept for words that repeat the word before, or the one before that: averages of single words
#: cannot tell a text of one sentence from the sentence said often. Each counts like a word with all its n-grams.
REPEATS = 2
#: Distinct words whose sums a task remembers; beyond it starts anew.
REMEMBERED = 300_000


def held_out(doc_id: Column) -> Column:
    """Rows that no model sees labels of: crc32 of the doc_id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words' features one after another, features of each word): the word, and its n-grams.

    n-grams are of characters (code points) of the word between two marks.
    """
    framed = [f"<{w.decode('utf-8', 'surrogatepass')}>" for w in words]
    lengths = np.fromiter(map(len, framed), np.int64, len(framed))
    data = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    word = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(data))  # characters up to the word's end
    ids = [np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)]
    of = [np.arange(len(words))]
    for n in GRAMS:
        if len(data) >= n:
            h = np.zeros(len(data) - n + 1, np.uint64)
            for i in range(n):
                h = (h ^ data[i : i + len(h)]) * np.uint64(0x100000001B3) + np.uint64(n)
            whole = np.flatnonzero(left[: len(h)] >= n)
            ids.append((h[whole] ^ h[whole] >> np.uint64(23)) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(20))
            of.append(word[whole])
    ids, of = np.concatenate(ids) % np.uint64(BUCKETS - REPEATS), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return ids[order].astype(np.int64), np.bincount(of, minlength=len(words))


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def repeats(words: list[bytes]) -> tuple[int, int]:
    """Words equal to the one before, and words equal to the one before that."""
    return sum(map(bytes.__eq__, words[1:], words)), sum(map(bytes.__eq__, words[2:], words))


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares) of a document: each bucket's share of its features, the weights of the average."""
    words = split(text)
    distinct = collections.Counter(words)
    r1, r2 = repeats(words)
    ids, n = word_features(list(distinct)) if distinct else (np.empty(0, np.int64), np.empty(0, np.int64))
    counts = np.repeat(np.fromiter(distinct.values(), np.float64, len(distinct)), n)
    each = len(GRAMS) + 1
    counts = np.bincount(np.append(ids, [BUCKETS - 1, BUCKETS - 2]), np.append(counts, [each * r1, each * r2]))
    bucket = np.flatnonzero(counts)
    return bucket.astype(np.uint16), (counts[bucket] / max(1.0, counts.sum())).astype(np.float32)


@dataclasses.dataclass
class Model:
    """score(document) = softmax of the averaged vectors times the output layer.

    The average's product with the output layer is the average of the vectors' products, so scoring keeps one number
    a bucket: the difference of the two classes.
    """

    weight: np.ndarray  # BUCKETS
    bias: float

    def words(self, known: dict[bytes, int], sums: list[np.ndarray], new: list[bytes]) -> None:
        ids, n = word_features(new)
        start = np.cumsum(n) - n
        total = np.add.reduceat(self.weight[ids], start)
        base = len(known)
        known.update(zip(new, range(base, base + len(new))))
        sums.append(np.stack([total, n.astype(np.float64)], 1))


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = 5) -> Model:
    """Stochastic gradient descent on the softmax loss over document_features(), both classes with equal weight in sum."""
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)  # nothing to tell apart
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.5, (BUCKETS, WIDTH)).astype(np.float32)
    out = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    balance = len(y) / (2 * np.bincount(y, minlength=2))
    steps, step = EPOCHS * (len(docs) // SMALL_BATCH + 1), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for i in range(0, len(order), SMALL_BATCH):
            part = order[i : i + SMALL_BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            sizes = [len(docs[d][0]) for d in part]
            ids = np.concatenate([docs[d][0] for d in part]).astype(np.int64)
            share = np.concatenate([docs[d][1] for d in part])
            mean = np.zeros((len(part), WIDTH), np.float32)
            if len(full := np.flatnonzero(sizes)):  # a text without words has no features
                mean[full] = np.add.reduceat(table[ids] * share[:, None], (np.cumsum(sizes) - sizes)[full])
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            g = (p * balance[y[part], None]).astype(np.float32)
            back = g @ out.T
            out -= rate / len(part) * (mean.T @ g)
            bias -= rate / len(part) * g.sum(0)
            # a feature's step is scaled by the features of a usual document, which the average has divided it by
            change = np.repeat(back, sizes, axis=0) * (share * (rate * 30 / len(part)))[:, None]
            np.add.at(table, ids, -change)
    logit = np.log(balance[0] / balance[1])  # back from equal weights to the classes' own shares
    return Model((table @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0] + logit))


def scorer(model: Model):
    """Scores of lists of texts, with a memory of words."""
    known: dict[bytes, int] = {}
    sums: list[np.ndarray] = []
    table = np.zeros((0, 2))

    def score(texts: list[str | None]) -> np.ndarray:
        nonlocal table
        if len(known) > REMEMBERED:
            known.clear()
            sums.clear()
            table = np.zeros((0, 2))
        split_texts = [split(t) for t in texts]
        new = list({w for ws in split_texts for w in ws} - known.keys())
        if new:
            model.words(known, sums, new)
            table = np.concatenate([table, sums.pop()])
        out = np.empty(len(texts))
        for i, words in enumerate(split_texts):
            if words:
                at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                total, n = table[at].sum(0)
                r1, r2 = int((at[1:] == at[:-1]).sum()), int((at[2:] == at[:-2]).sum())
                k = len(GRAMS) + 1
                total += k * (r1 * model.weight[BUCKETS - 1] + r2 * model.weight[BUCKETS - 2])
                out[i] = model.bias + total / (n + k * (r1 + r2))
            else:
                out[i] = model.bias
        return 1 / (1 + np.exp(-out))

    return score


def trained(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model from at most fit_rows labelled rows of docs that are not held out; only text and quality are looked at.

    Of rows that share a doc_id the one with the smallest text is taken, so repeated rows don't add to what is fetched.
    Whole texts, however long, become features where they are read; to the driver come at most BUCKETS shares a row.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    some = (
        known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
        .select(F.col("doc_id").cast("long").alias("labelled"), F.col("quality").cast("int").alias("quality"))
    )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = [document_features(t.as_py()) for t in batch.column(2)]
            raw = [pa.array([x[i].tobytes() for x in of], pa.binary()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *raw], ["labelled", "quality", "buckets", "shares"])

    texts = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("labelled"))
    one = texts.groupBy("labelled").agg(F.first("quality").alias("quality"), F.min("text").alias("text"))  # rows may share a doc_id
    found = one.select("labelled", "quality", "text").mapInArrow(features, "labelled long, quality int, buckets binary, shares binary").collect()  # bounded by fit_rows
    rows = sorted((r["labelled"], r["quality"], r["buckets"], r["shares"]) for r in found)
    return fit([(np.frombuffer(b, np.uint16), np.frombuffer(s, np.float32)) for _, _, b, s in rows], [q for _, q, _, _ in rows])


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text, ...), all columns, with score and predicted; see quality_scores().

    Columns of those names that docs has are replaced. The model, one number a bucket, goes to all tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = scorer(shared.value)
        for texts in parts:
            values = texts.tolist()
            yield pd.Series(np.concatenate([of(values[i : i + 500]) for i in range(0, len(values), 500)]) if values else np.empty(0))

    out = docs.withColumn("score", score("text"))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def quality_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text, ...), by labels (doc_id, quality, ...).

    score is from 0 to 1, higher where label 1 is likelier; a whole text is scored whatever its length. Null and empty
    texts have the score of a text without words. Labels other than 0 and 1 are not used; of repeated labels the
    larger counts, and of rows that share a doc_id one is fitted on. Without labels, or with labels of one class, all
    scores are the class's smoothed share. Repeated rows are scored alike; a null doc_id is not held out. An empty table gives an empty table. Other columns are not
    read, and doc_id, lang and source are no inputs.
    """
    rows = docs.select("doc_id", "text")
    out = scored(rows, trained(rows, labels, fit_rows), threshold)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
