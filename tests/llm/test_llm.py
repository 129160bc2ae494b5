"""Each operator against brute force, round trips or held-out labels, and on odd rows."""

import gzip
import hashlib
import itertools
import math
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelake.llm import chat, common, exact_dedup, mixing, order_minhash, packing, quality, queries, sharding, simhash, token_counts, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in any column, empty and very long texts, ties, repeated rows; copies that differ in white space.
ODD = [
    (1, None, "en", "a", 0), (2, "", None, None, None), (None, "no id at all", "en", "b", 12), (3, " \t\n", "en", "a", 3),
    (4, "one two three four five six seven", "en", "a", 1), (5, "one  two three four five six\nseven", "en", "b", 1),
    (5, "one  two three four five six\nseven", "en", "b", 1), (6, "x" * 70_000, "de", "b", 1), (7, "word " * 30_000, "de", None, 1),
    (8, "é" * 10 + " <|endoftext|> 日本 🙂", "fr", "c", 1), (9, "tiny", "en", "c", 4), (10, None, None, "c", None), (11, "tiny", "en", "zero", 4), (12, "", "en", "empty", 0),
]
LAB = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def odd(spark):
    # columns whose names clash with the operators' own
    return spark.createDataFrame(ODD, DOCS).withColumns({"row": F.lit(1), "size": F.lit("s"), "score": F.lit(0), "print": F.lit(2), "key": F.lit(3), "_copies": F.lit(4), "part": F.lit(5), "g": F.lit(6), "near_row": F.lit(7)})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(df):
    return {r["doc_id"]: r["text"] or "" for r in df.collect()}


def same(got, sql, tables):
    c = duckdb.connect()
    for name, df in tables.items():
        c.register(name, df.toArrow())
    cur = c.execute(sql)
    names = [d[0] for d in cur.description]
    want = Counter(tuple(None if v != v else v for v in r) for r in cur.fetchall())
    assert Counter(tuple(None if isinstance(v, float) and v != v else v for v in r) for r in got.select(*names).collect()) == want


def test_components(spark):
    rnd = random.Random(3)
    links = [(i, i + 1) for i in range(300, 420)] + [(500, x) for x in range(501, 900)] + [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(7, 7)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r[0]: r[1] for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_numbered(spark):
    df = spark.range(1000).selectExpr("id", "case when id % 3 = 0 then null else id % 2 end g", "cast(id % 5 as int) p")
    got = common.numbered(df, ["g"], ["p"], [F.col("id")], "n").collect()
    by = defaultdict(list)
    for r in got:
        by[r["g"]].append((r["n"], r["p"], r["id"]))
    for rows in by.values():
        assert [n for n, _, _ in sorted(rows)] == list(range(len(rows)))
        assert sorted(rows) == sorted(rows, key=lambda r: (r[1], r[2]))


def test_copied(spark):
    read = common.written(spark.range(3000, numPartitions=3).select("id", F.lit("x").alias("word"), F.lit(1).alias("held")).withColumn("n", F.monotonically_increasing_id()))
    rows = [(r["id"], r["n"]) for r in read.collect()]
    for most, bits in ((1, 1), (2, 4), (3, 4), (9, 4), (20, 4)):
        copies = {i: (i * 7919) % (most + 1) for i, _ in rows if i % 3}
        plan = spark.createDataFrame([(n, copies[i]) for i, n in rows if copies.get(i)], "row long, copies int")
        for words in (common.WORDS, 10):  # by words, and by a join
            out = common.copied(read, "n", plan, bits, words)
            assert out.columns == read.columns and Counter(r["id"] for r in out.collect()) == Counter({i: c for i, c in copies.items() if c})
    assert common.copied(read, "n", plan.limit(0)).count() == 0


# ---------------------------------------------------------------- 1


def test_quality_held_out(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    got = queries.op1_quality_classifier(spark, sf).collect()
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [(r["predicted"], label[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in label]
    assert len(held) > 80 and np.mean([p == q for p, q in held]) > 0.95


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (4, 0, None), (7, None, 1), (6, 1, 1), (4, 1, 1), (9, 0, 0)], LAB)
    got = quality.quality_scores(odd, labels).collect()
    assert len(got) == len(ODD) and len({r["score"] for r in got if r["doc_id"] in (1, 2, 3, 10, 12)}) == 1
    assert {r["score"] for r in quality.quality_scores(odd, spark.createDataFrame([], LAB)).collect()} == {0.5}
    assert quality.quality_scores(none, labels).count() == 0


def test_quality_fetches_one_row_a_label(spark, odd, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda docs, labels: seen.append(([(b.tolist(), s.tolist()) for b, s in docs], labels)))
    rows = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(4, "a smaller text")] * 3, "doc_id long, text string"))
    quality.trained(rows, spark.createDataFrame([(4, 0, 0), (4, 1, 1), (5, 0, 0), (9, 0, 0)], LAB))  # 5 is held out
    want = [tuple(x.tolist() for x in quality.document_features(t)) for t in ("a smaller text", "tiny")]
    assert seen == [(want, [1, 0])]


def slow_score(model, text):
    """The score by the method's words: the average of all features' numbers, one feature after another."""
    mask, found = (1 << 64) - 1, []
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    for w in words:
        found.append((zlib.crc32(w.encode()) * 0x9E3779B97F4A7C15 & mask) >> 20)
        for n in (3, 4):
            for i in range(len(w) + 3 - n):
                h = 0
                for c in f"<{w}>"[i : i + n]:
                    h = (h ^ ord(c)) * 0x100000001B3 + n & mask
                found.append(((h ^ h >> 23) * 0xFF51AFD7ED558CCD & mask) >> 20)
    found = [f % (quality.BUCKETS - 2) for f in found]
    found += [quality.BUCKETS - 1] * 3 * sum(a == b for a, b in zip(words, words[1:])) + [quality.BUCKETS - 2] * 3 * sum(a == b for a, b in zip(words, words[2:]))
    return 1 / (1 + math.exp(-model.bias - (sum(model.weight[f] for f in found) / len(found) if found else 0)))


def test_quality_score_slowly(spark, docs, odd):
    rng = np.random.default_rng(3)
    model = quality.Model(rng.normal(0, 1, quality.BUCKETS), 0.25)
    texts = [r["text"] for r in docs.collect()][:60] + [r["text"] for r in odd.collect() if not r["text"] or len(r["text"]) < 10_000] + ["ночь ночь улица", "日本 語 語 語", "é", "\U0001f600\U0001f600 x"]
    assert np.allclose(quality.scorer(model)(texts), [slow_score(model, t) for t in texts], rtol=0, atol=1e-9)
    for t in texts:  # what is fitted on is what is scored by
        b, s = quality.document_features(t)
        assert abs(1 / (1 + math.exp(-model.bias - float(model.weight[b] @ s.astype(float)))) - slow_score(model, t)) < 1e-5


def test_quality_long_documents_are_learned_from(spark):
    long = " ".join(f"w{i}" for i in range(9000))
    rows = [(i, ("good " if i % 2 else "bad ") * 3 + long) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.trained(docs, spark.createDataFrame([(i, i % 2, 0) for i in range(60)], LAB))
    good, bad = quality.scorer(model)(["good good good", "bad bad bad"])
    assert good > bad


# ---------------------------------------------------------------- 2


PAGES = "page_id long, url string, html string"


def test_warc_round_trip(spark, tmp_path):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    long = "<p>é</p>\n" * 50_000
    rows = [(1, "u", "x" * 100), (0, "u\r\nX: y", "x" * 100), (2, None, "x" * 99), (3, "u", "x" * 99), (4, "u", fake * 3), (5, "u", fake * 3), (6, "u", None), (7, "u", ""), (8, "u", long), (9, "u", long), (9, "u", long), (None, "u", "y" * 200), (10, "u", "y" * 200), (11, "u", "tail\r\n\r\nWARC/1.0\r\n"), (12, "u", "\r\n")]
    pages = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit(1)).repartition(3)
    warc.write_archives(pages, str(tmp_path / "w"), per_file=3)
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    want = Counter()
    for p, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 100 and p != first[h]
        want[p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h] if again else None] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    assert all(bytes(r["payload"]).decode() in {h or "" for _, _, h in rows} for r in got)
    same(warc.read_archives(spark, str(tmp_path / "w")).filter("page_id is not null"), queries.OP2_SQL, {"pages": spark.createDataFrame([r for r in rows if r[0] is not None], PAGES)})


def test_warc_foreign_and_broken(spark, tmp_path):
    rec = lambda i, p: warc.MAGIC + f"WARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(p)}\r\n\r\n".encode() + p + b"\r\n\r\n"
    payloads = [b"a", warc.MAGIC, rec(99, b"inside"), b"\xff\x00\r\n\r\n"] * 20
    whole = b"".join(rec(i, p) for i, p in enumerate(payloads))
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.warc").write_bytes(whole)
    assert warc.candidates(spark, str(tmp_path / "w")).count() > len(payloads) + 1
    read = lambda folder, **k: sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["payload"] and bytes(r["payload"])) for r in warc.read_archives(spark, str(tmp_path / folder), **k).collect())
    want = [(i, len(x), hashlib.sha256(x).hexdigest(), x) for i, x in enumerate(payloads)]
    assert read("w") == want and read("w", with_payload=False) == [(*x[:3], None) for x in want]
    # members one after another, as archives are compressed
    (tmp_path / "z").mkdir()
    (tmp_path / "z/a.warc.gz").write_bytes(b"".join(gzip.compress(rec(i, x)) for i, x in enumerate(payloads)))
    assert read("z") == want
    cut = rec(1, b"x" * 200)
    for i, broken in enumerate([whole[:-10], b"x" + whole, whole + warc.MAGIC, b"no archive", cut + cut.replace(b"200", b"999999999999"), rec(1, warc.MAGIC + b"x").replace(b"Length: 11", b"Length: 9")]):
        (tmp_path / f"b{i}").mkdir()
        (tmp_path / f"b{i}/a.warc").write_bytes(broken)
        with pytest.raises(Exception, match="chain"):
            warc.read_archives(spark, str(tmp_path / f"b{i}")).collect()
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.warc").write_bytes(cut.replace(b"Content-Length", b"WARC-Payload-Digest: sha256:00ff\r\nContent-Length"))
    with pytest.raises(Exception, match="digest"):
        warc.read_archives(spark, str(tmp_path / "d")).collect()
    assert len(warc.reachable(np.array([], np.int64), np.array([], np.int64))) == 0


def test_warc_over_many_ranges(spark, tmp_path):
    """A file cut into ranges at any place: in headers, in magic strings, in payloads longer than a range."""
    fake = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    texts = ["short", fake * 40, "x" * 5000, "WARC/1.0\r\n" * 300, "", fake + "y" * 1500 + fake, "é" * 700] * 6
    pages = spark.createDataFrame([(i, f"http://u/{i}", t + str(i // 3)) for i, t in enumerate(texts)], PAGES)
    warc.write_archives(pages.coalesce(2), str(tmp_path / "w"))
    for size in ("700", "4096"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            assert warc.segments(spark, str(tmp_path / "w")).select("file", "block").distinct().count() > 10
            for with_payload in (True, False):
                got = warc.read_archives(spark, str(tmp_path / "w"), with_payload)
                same(got, queries.OP2_SQL, {"pages": pages})
            assert got.count() == len(texts)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_warc_hostile_page(spark, tmp_path):
    """A page of nothing but magic strings costs a short row each, not the rest of the page each."""
    pages = spark.createDataFrame([(1, "u", "WARC/1.0\r\n" * 100_000), (2, "u", "plain")], PAGES)
    warc.write_archives(pages, str(tmp_path / "w"))
    cand = common.written(warc.candidates(spark, str(tmp_path / "w")))
    assert cand.count() > 100_000 and cand.agg(F.max(F.length(F.concat_ws("", "kind", "id", "refers", "stated", "url")))).first()[0] < 100
    same(warc.read_archives(spark, str(tmp_path / "w")), queries.OP2_SQL, {"pages": pages})


def test_leaving():
    rng = np.random.default_rng(0)
    for _ in range(200):
        sizes = rng.integers(1, 9, rng.integers(1, 30))
        place, total = np.cumsum(sizes) - sizes, int(sizes.sum())
        follow = np.where(rng.random(len(place)) < 0.9, place + rng.integers(1, 20, len(place)), -1)
        after = dict(zip(place.tolist(), follow.tolist()))
        for p, got in zip(place.tolist(), warc.leaving(place, follow, total).tolist()):
            while p in after and 0 <= p < total:
                p = after[p]
            assert got == (p if p >= total else -1)


def test_warc_no_pages(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], PAGES), str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0


# ---------------------------------------------------------------- 3


def test_mixing_targets(spark):
    sizes = [("b", 100), ("a", 10), (None, 50), ("c", 1000), ("d", 0), ("e", 7)]
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, size long")).collect()}
    order = ["a", "b", "c", "d", "e", None]
    size, weight = dict(sizes), dict(zip(order, itertools.cycle([3, 1, 2])))
    stopped, target = set(), {}
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in stopped)
        free = sum(weight[s] for s in order if s not in stopped)
        target = {s: 2 * size[s] if s in stopped else left * weight[s] / free for s in order}
        new = {s for s in order if target[s] > 2 * size[s]}
        if not new:
            break
        stopped |= new
    assert got == pytest.approx(target)


def test_mixing_sql_and_nearness(spark, odd, none, docs, sf_dir):
    same(mixing.mix_plan(odd), queries.OP3_SQL, {"documents": odd.select("doc_id", "text", "source")})
    assert mixing.mix_plan(none).count() == 0
    big = spark.read.parquet(sf_dir.replace("0.001", "0.1") + "/documents.parquet")
    rows = mixing.mix_plan(big).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert max(abs(r["taken"] / r["target"] - 1) for r in rows) < 0.001
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({d: n for d, n in plan.items() if n})
    assert mixing.mixed(odd).columns == odd.columns and mixing.mixed(none).count() == 0


def test_mixing_draws_are_the_documents_own(spark, docs):
    """A draw depends on its document alone: more documents turn only some of the largest ones' draws."""
    plan = lambda df, n: {r["doc_id"]: r["copies"] for r in mixing.mix_plan(df, turned=n).collect()}
    big = docs.select(F.explode(F.array(*(F.struct((F.col("doc_id") + i * 10_000_000).alias("doc_id"), "text", F.lit(s).alias("source")) for i, s in enumerate("abc")))).alias("d")).select("d.*")
    for n in (0, 256):
        rows = plan(big, n)
        rate = {s: r["target"] / r["source_size"] for r in mixing.source_targets(big.select("source", mixing.words(F.col("text")).alias("size"))).collect() for s in [r["source"]]}
        drawn = lambda d, s, t: int(hashlib.md5(hashlib.md5("|".join([hashlib.md5(f"v{s}".encode()).hexdigest(), f"v{d}", hashlib.md5(f"v{t}".encode() if t is not None else b"n").hexdigest()]).encode()).hexdigest().encode()).hexdigest()[:8], 16) / 2**32
        want = {r["doc_id"]: int(rate[r["source"]]) + (drawn(r["doc_id"], r["source"], r["text"]) < rate[r["source"]] % 1) for r in big.collect()}
        differ = sum(rows[d] != want[d] for d in want)
        assert differ == 0 if not n else 0 < differ < 25, (n, differ, rate)
    assert max(plan(big, 256).values()) <= 2


def test_mixing_rows_that_are_alike(spark):
    """A third of all rows are one row, without an id: they are drawn each for itself and the target is met."""
    df = spark.createDataFrame([(None, "one text of five words", "en", "b", 1)] * 500 + [(i, "w " * (i % 60), "en", "ab"[i % 2], 1) for i in range(1000)], DOCS)
    same(mixing.mix_plan(df), queries.OP3_SQL, {"documents": df.select("doc_id", "text", "source")})
    got = mixing.mix_plan(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 40 for r in got)  # two thirds of the largest document
    assert mixing.mix_plan(df).filter("doc_id is null").select("copies").distinct().count() == 2


def test_mixed_draws_each_row_where_ids_repeat_or_are_null(spark, odd):
    rows = [(None if i % 3 == 0 else i, f"{s} {i} " + "word " * (i % 40), "en", s, 1) for s, n in (("a", 900), ("b", 300), ("c", 600)) for i in range(n)]
    for df in (spark.createDataFrame(rows, DOCS), odd):
        plan = mixing.mix_plan(df).groupBy("source", "doc_id", "size").agg(F.sum("copies").alias("n")).filter("n > 0").collect()
        got = mixing.mixed(df).groupBy("source", "doc_id", mixing.words(F.col("text")).alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()
        assert Counter(map(tuple, got)) == Counter(map(tuple, plan))
    df = spark.createDataFrame(rows, DOCS)
    of = mixing.source_targets(df.select("source", mixing.words(F.col("text")).alias("size"))).select("source", "target").collect()
    taken = dict(map(tuple, mixing.mixed(df).groupBy("source").agg(F.sum(mixing.words(F.col("text")))).collect()))
    assert all(abs(taken[s] / target - 1) < 0.001 for s, target in of)


# ---------------------------------------------------------------- 4


TURNS = "conv_id long, turn long, role string, text string"


def test_chat(spark):
    strings = ["", "###", "### user: ", "</turn>", "\\", "\\</turn>\n### assistant: x", "é🙂", ":", None, "####</turn></turn>\\"]
    rnd = random.Random(1)
    rows = [(c, t, rnd.choice(["user", "assistant", "a: b", None, "###"]), "".join(rnd.choice(strings) or "" for _ in range(rnd.randrange(4)))) for c in range(30) for t in range(rnd.randrange(1, 5))]
    rows += [(99, 1, "assistant", None), (99, 1, "assistant", "b"), (99, 1, "assistant", "b"), (99, None, "user", "first"), (None, 0, "user", "x"), (None, 1, "assistant", "y" * 300_000)]
    turns = spark.createDataFrame(rows, TURNS).withColumn("formatted", F.lit(1))
    same(chat.digests(chat.formatted(turns)).filter("conv_id <> -7 or conv_id is null"), queries.OP4_SQL.replace("UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'\n    UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'", ""), {"conversations": turns})
    assert chat.digests(chat.formatted(spark.createDataFrame([], TURNS))).count() == 0


def test_unescaping_by_pieces(monkeypatch):
    rnd = random.Random(3)
    for piece in (1, 2, 3, 5, 1 << 20):
        monkeypatch.setattr(chat, "PIECE", piece)
        for _ in range(400):
            plain = "".join(rnd.choice(["\\", "\\", "a", "###", "</turn>", ": "]) for _ in range(rnd.randrange(14)))
            text = chat.escaped(pa.array([plain]))[0].as_py().encode()
            assert chat.unescaped(text) == plain.encode() and chat.code_points(f"{plain}é🙂".encode()) == len(plain) + 2


def test_chat_memory_of_a_hostile_turn():
    """A turn of 20 MB: what a process takes for assembling and reading it back, over what it has before."""
    run = subprocess.run([sys.executable, "-c", """
import resource, pyarrow as pa
from tidelake.llm import chat
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for text in ("<" * 20_000_000, "</turn>" * 2_800_000, "\\\\" * 20_000_000):
    before = peak()
    out = chat.assemble(pa.array(["user"]), pa.array([text]))[0].tobytes()
    assert list(chat.read_back(out)) == [(b"user", text.encode())]
    print((peak() - before) // 1024)
"""], capture_output=True, text=True, timeout=300)  # fmt: skip
    assert max(map(int, run.stdout.split())) < 500 and len(run.stdout.split()) == 3, run.stderr


def test_chat_pieces_out_of_order_fail(spark):
    df = spark.createDataFrame([(1, 0, "### user: a</turn>\n", []), (1, 2, "### user: b</turn>\n", [])], chat.FORMATTED).coalesce(1)
    with pytest.raises(Exception, match="does not follow"):
        chat.digests(df).collect()


def test_chat_long_conversation_is_pieces(spark, monkeypatch):
    rows = [(5, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(500)] + [(6, 0, "assistant", "z")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        pieces = chat.formatted(spark.createDataFrame(rows, TURNS))
        assert pieces.filter("conv_id = 5").count() > 3
        r = {x["conv_id"]: x for x in chat.digests(pieces).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert r[5]["n_turns"] == 500 and r[5]["loss_sha256"] == hashlib.sha256("".join(f"t{t}" for t in range(1, 500, 2)).encode()).hexdigest() and r[6]["loss_chars"] == 1


# ---------------------------------------------------------------- 5


VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def check_packing(rows, ids_of):
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 1024 and at & (at - 1) == 0  # no padding at all
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    assert by_doc.keys() == ids_of.keys()
    for doc, pieces in by_doc.items():
        spans = Counter((r["start"], r["length"]) for r in pieces)
        assert sum(s[1] * n for s, n in spans.items()) == sum(len(x) for x in ids_of[doc])
        if len(ids_of[doc]) == 1:
            ids = np.array(ids_of[doc][0], "<u4")
            at = 0
            for r in sorted(pieces, key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(ids)
                assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
                at += r["length"]


def test_packing(spark, docs, odd, none):
    library = Tokenizer.from_file(VOCABULARY)
    for df in (docs, odd):
        ids = defaultdict(list)
        for r in df.collect():
            ids[r["doc_id"]].append(library.encode(r["text"] or "", add_special_tokens=False).ids + [0])
        check_packing(packing.packed(df, VOCABULARY).collect(), ids)
    assert packing.packed(none, VOCABULARY).count() == 0


def test_encoder_is_the_librarys():
    library, ours = Tokenizer.from_file(VOCABULARY), packing.byte_encoder(VOCABULARY)
    rnd = random.Random(2)
    some = ["", " " * 5000, "a" * 3000, "<|endoftext|><|endoftext|> x", "it's\n\n  they'LL", "日本語" * 50]
    some += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(1, 0x3000), rnd.randrange(0x1F300, 0x1F9FF)])) for _ in range(80)) for _ in range(200)]
    assert all(ours(t) == library.encode(t, add_special_tokens=False).ids for t in some)


def test_hilbert_neighbours_touch():
    pts = np.array(list(itertools.product(range(8), repeat=3)))
    key = packing.hilbert(pts, 3)
    assert sorted(key) == list(range(512)) and (np.abs(np.diff(pts[np.argsort(key)], axis=0)).sum(1) == 1).all()


# ---------------------------------------------------------------- 6


def test_exact_dedup(spark, docs, odd, none):
    for df in (docs, odd.filter("doc_id is not null")):
        for counters in (1, 2, 1024):
            got = exact_dedup.exact_groups(df, counters)
            same(got.drop("row"), queries.OP6_SQL, {"documents": df.select("doc_id", "text")})
    r = [x for x in exact_dedup.exact_groups(odd).collect() if x["doc_id"] is None]
    assert len(r) == 1 and r[0]["kept"] and exact_dedup.exact_groups(none).count() == 0
    least = spark.createDataFrame([(-(1 << 63), "a b"), (5, "a b"), ((1 << 63) - 1, "a b")] * 40 + [(1, "other")], "doc_id long, text string")
    for counters in (1, 1024):  # as a rare and as a frequent digest
        assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(least, counters).collect()} == {(d, -(1 << 63), 120) for d in (-(1 << 63), 5, (1 << 63) - 1)} | {(1, 1, 1)}
        assert sorted(r["doc_id"] for r in exact_dedup.distinct_texts(least, counters).collect()) == [-(1 << 63), 1]
    kept = exact_dedup.distinct_texts(odd)
    assert kept.columns == odd.columns and kept.count() == len({"".join((t or "").split()) for _, t, *_ in ODD})


def test_misra_gries():
    import pyarrow as pa

    values = ["a"] * 300 + ["b"] * 200 + [str(i) for i in range(500)]
    random.Random(1).shuffle(values)
    held = exact_dedup.misra_gries((pa.RecordBatch.from_pydict({"d": values[i : i + 50]}) for i in range(0, 1000, 50)), 4)
    assert len(held) <= 4 and 300 - 200 <= held["a"] <= 300 and "b" in held or held.get("b", 0) >= 0


# ---------------------------------------------------------------- 7


def test_edit_likeness(spark, docs, odd, none):
    hashed = lambda t: int(np.array(xxhash.xxh64_intdigest(t.encode(), 42), np.uint64).view(np.int64)) if t is not None else 42
    alike = spark.createDataFrame([(None, "the same text of all " * 3)] * 900 + [(7, f"text {i} " * 5) for i in range(900)], "doc_id long, text string")
    for df, size in ((docs, 20), (docs, 1), (odd, 3), (docs.limit(1), 10), (alike, 16)):
        rows = sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0, hashed(x[1])))
        rows = [(d, t or "") for d, t in rows]
        want = Counter()
        for (d, t), (_, f) in zip(rows, rows[1:] + rows[:1]):
            n = len(t) // 4
            e = t[: len(t) - n] + f[:n]
            a, b, c = order_minhash.signatures([t]), order_minhash.signatures([e]), order_minhash.signatures([f])
            want[d, len(t), hashlib.sha256(e.encode()).hexdigest(), order_minhash.shown(a)[0], order_minhash.shown(b)[0], float(order_minhash.likeness(a, b)[0]), float(order_minhash.likeness(a, c)[0])] += 1
        assert Counter(map(tuple, order_minhash.edit_likeness(df, size).collect())) == want
    assert order_minhash.edit_likeness(none).count() == 0
    assert order_minhash.fingerprints(odd).count() == len(ODD)


def brute_signature(text, k=8, tuples=32, each=2):
    mask = (1 << 64) - 1

    def mix(h):
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & mask
        h = (h ^ h >> 27) * 0x94D049BB133111EB & mask
        return h ^ h >> 31

    def kmer(points, factor):
        if len(points) == 1:
            return ord(points) + 1
        half = len(points) // 2
        return kmer(points[:half], factor - 1) * FACTORS[factor] + kmer(points[half:], factor - 1) & mask

    FACTORS = [0, 0x9E3779B97F4A7C15]
    for _ in range(2):
        FACTORS.append(FACTORS[-1] ** 2 + 2 & mask)
    if 0 < len(text) < k:
        h = [int.from_bytes(hashlib.blake2b(text.encode("utf-32-le"), digest_size=8).digest(), "little")]
    else:
        h = [x ^ x >> 29 for i in range(len(text) - k + 1) for x in [kmer(text[i : i + k], 3)]]
    seen, bins = Counter(), defaultdict(list)
    for i, x in enumerate(h):
        v = mix(x + seen[x] * 0x9E3779B97F4A7C15 & mask)
        seen[x] += 1
        bins[v >> 59].append((v & (1 << 59) - 1, i))
    out = np.zeros(tuples, np.uint32)
    for b, found in bins.items():
        pick = sorted(i for _, i in sorted(found)[:each])
        out[b] = max(1, mix(sum(mix(h[i] + (j + 1) * 0xD6E8FEB86659FD93 & mask) for j, i in enumerate(pick)) & mask) >> 32)
    return out


def test_signatures_by_hand(docs):
    some = [*list(texts(docs).values())[:25], "ab ab ab ab ab ab ab ab", "short", "abcdefgh", "x" * 3000, ""]
    got = order_minhash.signatures(some)
    for t, s in zip(some[:-1], got):
        assert (s == brute_signature(t)).all(), t[:40]
    assert (got[-1] == 0).all()


def test_signature_heeds_order():
    words = [f"w{i:05d}" for i in range(2000)]
    a, b = " ".join(words), " ".join(words[1000:] + words[:1000])
    near = order_minhash.likeness(order_minhash.signatures([a]), order_minhash.signatures([b]))[0]
    assert near < 0.8  # nearly the same k-mers, in another order


# ---------------------------------------------------------------- 8


def test_token_counts(spark, docs, odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for df in (docs, odd):
        want = Counter()
        for r in df.collect():
            n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
            want[r["doc_id"], len((r["text"] or "").encode()), n, n > 2048] += 1
        assert Counter(map(tuple, token_counts.token_counts(df, path).collect())) == want
    assert token_counts.token_counts(none, path).count() == 0
    bpe = token_counts.WordBpe(path)
    rnd = random.Random(4)
    some = ["ΑΣ ΟΔΥΣΣΕΥΣ İx ǅ", "<|ENDOFTEXT|><|startoftext|>", "é \x85　\x1cq", "a" * 5000, "aaaa aaa aa a"]
    some += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(1, 0xD000), rnd.randrange(0x10000, 0x1F9FF)])) for _ in range(100)) for _ in range(200)]
    some += ["".join(rnd.choice("abtheinco'") for _ in range(200)) for _ in range(100)]
    assert bpe.counts(some) == [len(library.encode(t, add_special_tokens=False).ids) for t in some]


# ---------------------------------------------------------------- 9


def check_shards(rows, n, shards):
    count = Counter(r["shard"] for r in rows)
    assert len(rows) == n and all(0 <= s < shards for s in count)
    assert not n or max(count.values()) - min(count[s] for s in range(shards)) <= 1
    for s in count:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(count[s]))


def test_sharding(spark, docs, odd, none, monkeypatch):
    hot = [(i, "hot copy" if i % 3 == 0 else f"pair {i // 2 % 100}" if i % 2 else f"single {i}", "en", "s", 1) for i in range(1500)]
    for df, shards in ((docs, 40), (odd, 40), (spark.createDataFrame(hot, DOCS), 7)):
        rows = sharding.sharded(df, shards).collect()
        check_shards(rows, df.count(), shards)
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
    spread = defaultdict(set)
    size = Counter(r["group"] for r in rows)
    for r in rows:
        spread[r["group"]].add(r["shard"])
    split = [g for g in size if 1 < size[g] < 100 and len(spread[g]) > 1]
    assert len(spread[max(size, key=size.get)]) <= 4 and len(split) <= 10  # 500 copies in shards of 214; few pairs are cut
    assert sharding.sharded(none).count() == 0


def test_sharding_cuts_no_group_that_fits(spark):
    rnd = random.Random(5)
    sizes = [1333, 90, 70, 50, 30, 20, *(rnd.randint(2, 5) for _ in range(170))]
    copies = [f"group {i}" for i, n in enumerate(sizes) for _ in range(n)]
    copies += [f"single {i}" for i in range(4000 - len(copies))]
    rnd.shuffle(copies)
    rows = sharding.sharded(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(copies)], DOCS)).collect()
    check_shards(rows, 4000, 40)
    spread = defaultdict(Counter)
    for r in rows:
        spread[r["group"], r["group_size"]][r["shard"]] += 1
    assert Counter(n for _, n in spread) == Counter(sizes) + Counter({1: 4000 - sum(sizes)})
    assert all(len(c) == 1 for (_, n), c in spread.items() if n <= 100)
    assert all(len(c) == 14 for (_, n), c in spread.items() if n > 100)


@pytest.mark.parametrize("sizes,shards,most_cut", [([2] * 2000, 40, 0), ([501] * 79, 40, 39), ([3] * 1333, 40, 14), ([600] * 20 + [400] * 20, 20, 0), ([2] * 9 + [30], 50, 10), ([], 7, 0)])
def test_sharding_quotas(sizes, shards, most_cut):
    rnd = random.Random(len(sizes))
    n = max(sum(sizes), 20_000 if 600 in sizes else 0)
    capacity = [n // shards + (s < n % shards) for s in range(shards)]
    asks = Counter((z, rnd.randrange(shards)) for z in sizes)
    runs, cut, room, cost = min((sharding.let_in(asks, capacity, heed) for heed in (True, False)), key=lambda p: p[-1])
    held = [0] * shards
    for (size, shard), run in runs.items():
        for (first, to), end in zip(run, [a for a, _ in run[1:]] + [asks[size, shard]]):
            assert end > first
            for k, s in [(size * (end - first), to)] if to >= 0 else cut[-1 - to]:
                held[s] += k
    assert [h + r for h, r in zip(held, room)] == capacity and min(room, default=0) >= 0
    assert sum(held) == sum(sizes) and len(cut) <= most_cut and (cost > 0) == (len(cut) > 0)


# ---------------------------------------------------------------- 10


def brute_print(text, k=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    ids = list(prints)
    up = {i: i for i in range(len(ids))}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    v = np.array([p for _, p in prints], np.uint64)
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= 4) + i + 1:
            a, b = find(i), find(int(j))
            up[max(a, b)] = min(a, b)
    low = {}
    for i in range(len(ids)):
        d = ids[i][0]
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(ids))]


def test_simhash(spark, docs, odd, none):
    for df in (docs, odd):
        rows = [(r["doc_id"], brute_print(r["text"] or "")) for r in df.collect()]
        want = Counter((d, f"{p:016x}", c) for (d, p), c in zip(rows, brute_components(rows)))
        assert Counter(map(tuple, simhash.simhash_components(df).collect())) == want
    assert simhash.simhash_components(none).count() == 0


@pytest.mark.parametrize("three", [False, True])
def test_golay_keys_lose_no_link(three):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, 4, replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    keys = []
    for v in (a, b):
        of = defaultdict(set)
        for k, r in zip(*simhash.exact_keys(v, three)):
            of[int(r)].add(int(k))
        keys.append(of)
    assert all(keys[0][i] & keys[1][i] for i in range(3000))
    words = simhash.codewords()
    assert min(np.bitwise_count(words[1:] ^ words[0])) == 7


def test_only_hot_keys_are_copied(spark, monkeypatch):
    """However many keys share a cell, rows of keys that few rows hold are not copied."""
    keyed = spark.range(20_000).select((F.col("id") % 5000).alias("key"), F.col("id").alias("node"))
    monkeypatch.setattr(simhash, "CELLS", 8)
    assert simhash.hot_keys(keyed, 50).count() == 0
    hot = keyed.unionByName(spark.range(120).select(F.lit(77).cast("long").alias("key"), (-F.col("id")).alias("node")))
    assert [tuple(r) for r in simhash.hot_keys(hot, 50).collect()] == [(77, 3)]


def test_hot_bucket_in_blocks(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = np.unique(np.concatenate([v, *(v ^ np.uint64(1 << b) for b in range(12))]))
    rows = [(1, int(i), bytes(np.array([p]).tobytes())) for i, p in enumerate(prints)]
    links = simhash.bucket_links(spark.createDataFrame(rows, "key long, node long, print binary"), 4, 1, block=50)
    got = {r["node"]: r["component"] for r in common.components(links).collect()}
    want = brute_components([(i, int(p)) for i, p in enumerate(prints)])
    assert [got.get(i, i) for i in range(len(prints))] == want


def near_copies(spark, base):
    rnd = random.Random(5)
    rows, pairs = [], []
    for i, t in enumerate(base):
        words = t.split()
        n = len(words)
        rows.append((2 * i, t, "en", "a", 1))
        changed = words[:]
        for _ in range(max(1, n // 60)):
            changed[rnd.randrange(n)] = "edited"
        rows.append((2 * i + 1, " ".join(changed), "en", "a", 1))
    return spark.createDataFrame(rows, DOCS)


def shingle_sets(df):
    out = {}
    for r in df.collect():
        w = (r["text"] or "").lower().split()
        out[r["doc_id"]] = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return out


def test_soft_keys_meet_at_the_threshold():
    rng = np.random.default_rng(3)
    sides = ([], [])
    for i in range(400):
        n = (30, 100, 400)[i % 3]
        both = -(-8 * 2 * n // 18)  # a similarity of 0.8, or just above it
        h = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
        for side, part in zip(sides, (h[:n], h[n - both :])):
            side.append(np.concatenate([simhash.bit_counts(simhash.widened(part, p)) * 2 - n for p in range(simhash.WIDE)]) / n**0.5)
    a, b = (simhash.soft_keys(*simhash.soft_codes(np.array(x, np.float32))) for x in sides)
    assert a.shape == (400, 180) and all(len(set(x)) == 180 for x in a.tolist())
    assert np.mean([bool(set(x) & set(y)) for x, y in zip(a.tolist(), b.tolist())]) >= 0.98


def test_near_kept(spark, docs, odd, none):
    df = near_copies(spark, [t for t in dict.fromkeys(texts(docs).values()) if len(t.split()) > 120][:100])
    sets = shingle_sets(df)
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    pairs = [(2 * i, 2 * i + 1) for i in range(len(sets) // 2) if near(2 * i, 2 * i + 1)]
    kept = {r["doc_id"] for r in simhash.near_kept(df).collect()}
    missed = [p for p in pairs if set(p) <= kept]
    assert len(pairs) > 40 and len(missed) <= 0.02 * len(pairs)
    gone = sets.keys() - kept  # whoever goes has a near copy
    assert all(any(near(d, o) for o in sets if o != d) for d in gone)
    out = simhash.near_kept(odd)
    assert out.columns == odd.columns and simhash.near_kept(none).count() == 0
    least = spark.createDataFrame([(-(1 << 63), "one two three four five six"), ((1 << 63) - 1, "one two three four five six"), (0, "one two three four five six")], "doc_id long, text string")
    assert [r["doc_id"] for r in simhash.near_kept(least).collect()] == [-(1 << 63)]
    ids = Counter(r["doc_id"] for r in out.collect())
    assert ids[5] + ids[4] == 1 and ids[9] + ids[11] == 1 and ids[6] == ids[8] == 1 and sum(ids[i] for i in (1, 2, 3, 10, 12)) == 1


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages_by_brute_force(spark, sf_dir, monkeypatch):
    """Each stage on what the one before kept, against a plain recomputation; then run() as a whole."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # rows that share a doc_id, have none or no text go through all stages too
    docs = docs.unionByName(docs.filter("doc_id % 9 = 0").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.filter("doc_id % 50 = 1").withColumn("text", F.lit(None).cast("string")))
    docs = docs.withColumn("row", F.lit("a name that clashes"))
    out, seen = docs, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, out = out, common.written(stage(spark, out, sf_dir))
        seen.append((before, out))
        assert i == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
    row = lambda r: tuple(r.asDict().values())
    # quality: all rows that the model accepts
    before, kept = seen[0]
    model = quality.trained(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert Counter(map(row, kept.collect())) == Counter(row(r) for r in before.collect() if slow_score(model, r["text"]) >= 0.7) and 0 < kept.count() < before.count()
    # exact copies: one of each text, the longest
    before, kept = seen[1]
    plain = lambda t: "".join((t or "").split(" ")).translate({c: None for c in range(9, 14)})
    longest = defaultdict(int)
    for r in before.collect():
        longest[plain(r["text"])] = max(longest[plain(r["text"])], len(r["text"] or ""))
    assert Counter((plain(r["text"]), len(r["text"] or "")) for r in kept.collect()) == Counter(longest.items())
    # near copies: one row of each group that links of brute force join
    before, kept = seen[2]
    rows = before.collect()
    sets = []
    for r in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "").split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    up = list(range(len(rows)))
    for _ in up:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    best = {}
    for g, r in zip(up, rows):
        best[g] = max(best.get(g, (-1,)), (len(r["text"] or ""), r["doc_id"] is not None, -(r["doc_id"] or 0)))
    assert Counter((len(r["text"] or ""), r["doc_id"] is not None, -(r["doc_id"] or 0)) for r in kept.collect()) == Counter(best.values())
    # mixing: rows as they were, none more than twice, sources at their targets
    before, kept = seen[3]
    n, copies = Counter(map(row, before.collect())), Counter(map(row, kept.collect()))
    assert copies.keys() <= n.keys() and all(copies[r] <= 2 * n[r] for r in copies)
    targets = mixing.source_targets(before.select("source", mixing.words(F.col("text")).alias("size"))).collect()
    taken = {r["source"]: r["n"] for r in kept.groupBy("source").agg(F.sum(mixing.words(F.col("text"))).alias("n")).collect()}
    largest = {r["source"]: r["n"] for r in before.groupBy("source").agg(F.max(mixing.words(F.col("text"))).alias("n")).collect()}
    assert all(abs(taken.get(r["source"], 0) - r["target"]) <= largest[r["source"]] * 2 / 3 for r in targets)  # sources of a dozen documents
    # packing: each copy's ids once, gapless
    before, pieces = seen[4]
    check = [packing.byte_encoder(VOCABULARY)(r["text"] or "") for r in before.collect()]
    assert pieces.agg(F.sum("length")).first()[0] == sum(len(c) + 1 for c in check)
    assert all(r["used"] == r["top"] and r["used"] <= 1024 for r in pieces.groupBy("sequence_id").agg(F.sum("length").alias("used"), F.max(F.col("offset") + F.col("length")).alias("top")).collect())
    whole = lambda df: Counter(map(tuple, df.groupBy("doc_id", "start", "length", "ids_crc32").count().collect()))
    monkeypatch.setattr(corpus_pipeline, "table", lambda s, d, name: docs if name == "documents" else s.read.parquet(f"{d}/{name}.parquet"))
    ran = corpus_pipeline.run(spark, sf_dir)
    assert ran.agg(F.sum("length")).first()[0] == sum(len(c) + 1 for c in check) and sum(whole(ran).values()) > 0
