"""Hard negatives, the quality classifier and importance resampling."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.llm import hard_negatives, quality, resampling, spans
from lattica.llm.common import Scratch

SF = "/root/testdata/sf0.001"


def same(got, sql, keys, *tables, **frames):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, frame in frames.items():
        con.register(name, frame)
    got, want = got.toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    order = lambda df: df[sorted(df.columns)].astype(float).sort_values(keys, ignore_index=True)
    pd.testing.assert_frame_equal(order(got), order(want))


# Hard negatives

VECTORS = "vec_id long, embedding array<float>, label int, rank int, score double"


@pytest.fixture
def vectors(spark):
    return lambda rows: spark.createDataFrame([(*r, 1, 0.5) for r in rows], VECTORS)


@pytest.mark.parametrize("high", [2, 100, 1 << 30])
def test_scores_are_inner_products(high):
    r = np.random.default_rng(high)
    v, a = r.integers(-high, high, (50, 16)), r.integers(-high, high, (20, 16))
    assert (hard_negatives.scores(hard_negatives.subset_sums(a, np.int64), hard_negatives.bit_planes(v)) == v @ a.T).all()


def test_hard_negatives_on_given_vectors(spark):
    same(hard_negatives.op11_hard_negatives(spark, SF), hard_negatives.SQL, ["anchor_id", "positive_id", "rank"], "embeddings")


def odd_vectors():
    """Equal vectors, shorter ones, one label for half of the rows."""
    r = np.random.default_rng(1)
    rows = [(k, [float(x) for x in r.integers(-3, 6, 5 if k % 4 else 9) / 4], int(r.integers(0, 10)) if k % 2 else 1) for k in range(0, 2000, 20)]
    return rows + [(k, [0.5] * 9, 3) for k in range(3, 400, 13)]


def test_hard_negatives_blocks_ties_and_lengths(spark, vectors, monkeypatch):
    """Several anchor blocks and stripes."""
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    df = vectors(odd_vectors()).repartition(5)
    padded = df.select("vec_id", "embedding", "label").toPandas()
    padded["embedding"] = [list(x) + [0.0] * (9 - len(x)) for x in padded.embedding]
    same(hard_negatives.mine(df), hard_negatives.SQL, ["anchor_id", "positive_id", "rank"], embeddings=padded)


@pytest.mark.parametrize("size", [2, 7, 4096])
def test_hard_negatives_of_one_task(monkeypatch, size):
    """Any cut into blocks finds the same rows."""
    for name in ("BLOCK", "AT_ONCE_ANCHORS", "AT_ONCE_ROWS"):
        monkeypatch.setattr(hard_negatives, name, size)
    rows = [(i, l, [int(256 * x) for x in v]) for i, v, l in odd_vectors()]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["vec_id", "label", "v"])
    stripe = pa.Table.from_batches(list(hard_negatives._pack([batch])))
    product = lambda a, b: sum(x * y for x, y in zip(a, b))
    anchors = [r for r in rows if r[0] % 100 == 0]
    table = pa.table([pa.array(c) for c in zip(*anchors, strict=True)], names=["vec_id", "label", "v"])
    want = [(a[0], 0, s, -i) for a in anchors for s, i in sorted(((product(a[2], c[2]), -c[0]) for c in rows if c[1] == a[1] and c[0] != a[0]), reverse=True)[:5]]
    order = lambda t: sorted((r["anchor_id"], r["slot"], r["score"], r["vec_id"]) for r in t.to_pylist())
    assert order(hard_negatives._mine(table, stripe, 5)) == sorted(want)
    bounds = [[(10_000, 90_000), (0, 200_000)][: k % 3] for k in range(len(anchors))]
    bounded = table.append_column("low", pa.array([[x for x, _ in b] for b in bounds], pa.list_(pa.int64()))).append_column("high", pa.array([[x for _, x in b] for b in bounds], pa.list_(pa.int64())))
    others = lambda a: ((product(a[2], c[2]), -c[0]) for c in rows if c[1] != a[1])
    want = [(a[0], slot, s, -i) for a, b in zip(anchors, bounds) for slot, (low, high) in enumerate(b) for s, i in sorted((x for x in others(a) if low <= x[0] <= high), reverse=True)[:10]]
    assert order(hard_negatives._mine(bounded, stripe, 10)) == sorted(want)


def test_hard_negatives_hard_rows(spark, vectors):
    good = [(100, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.5], 2), (5, [0.4, 0.0], 2), (3, [0.95, 0.0], 2)]
    bad = [(4, None, 1), (6, [1.0, None], 1), (8, [float("nan"), 1.0], 1), (9, [float("inf"), 1.0], 2), (10, [1.0, 1.0], None), (None, [1.0, 0.0], 1)]
    rows = lambda df: [tuple(r) for r in df.orderBy("anchor_id", "positive_id", "rank").collect()]
    want = [(100, 1, 1, 2, 65536, 32768), (100, 1, 2, 5, 65536, 26112)]
    assert rows(hard_negatives.mine(vectors(good + bad))) == want
    assert rows(hard_negatives.mine(vectors(good + bad + good + good))) == want
    assert rows(hard_negatives.mine(vectors([(100, [3e38], 1), (1, [2e38], 1), (2, [1.0], 2), (3, [], 4)]))) == []
    assert rows(hard_negatives.mine(vectors([]))) == []
    assert hard_negatives.mine(vectors(bad)).count() == 0


# Quality


def plain_statistics(text):
    """The statistics of a text below a piece, one by one."""
    data = (text or "").encode()
    kinds = Counter(quality.KINDS[quality.KIND[b]] for b in data)
    tokens, size, lines = data.split(), len(data), sum(b in b"\n\r\x0b\x0c" for b in data) + 1
    n = len(tokens)
    kind = lambda b: quality.KINDS[quality.KIND[b]]
    letters = ("lower", "upper", "beyond ASCII")
    marks = ("mark", "bracket", "symbol", "bar")
    doubled = sum(a == b and kind(a) in ("stop", *marks) for a, b in zip(data, data[1:]))
    loud = sum(sum(kind(b) == "upper" for b in t) > 1 and not any(kind(b) in ("lower", "beyond ASCII") for b in t) for t in tokens)
    lone = sum(len(line.split()) == 1 and line.strip() == line for line in re.split(rb"[\n\r\x0b\x0c]", data))
    over = lambda a, b: a / max(b, 1)
    return [
        *(over(kinds[k], size) for k in quality.KINDS), math.log1p(size), math.log1p(n), math.log1p(lines), over(size, n), over(n, lines),
        over(sum(a == b for a, b in zip(tokens, tokens[1:])), n), over(len(set(tokens)), n), over(sum(kind(t[0]) == "upper" for t in tokens), n), over(loud, n),
        over(sum(kind(t[-1]) in letters for t in tokens), n), over(sum(kind(t[-1]) in marks for t in tokens), n), over(doubled, size), over(lone, lines),
    ]


def test_statistics_against_plain_ones(hard):
    texts = [t for _, t in hard] + ["A", "a\nb", " x ", "AB CD!! ef\n\nGH\n", "..", "é é", "a b\rc", "|".join("abc"), "tail\n", "\tlead"]
    got = quality.statistics(pa.array(texts, pa.string()))
    np.testing.assert_allclose(got, np.array([plain_statistics(t) for t in texts]), rtol=1e-5)
    sliced = quality.statistics(pa.array(["gone", *texts], pa.string()).slice(1))
    np.testing.assert_array_equal(got, sliced)


def test_pieces_cut_no_word(monkeypatch):
    r = np.random.default_rng(3)
    texts = ["".join(r.choice(list("ab \n"), int(n))) for n in r.integers(0, 60, 200)] + ["x" * 100, "", "y " * 90]
    data, offsets = spans.text_buffer(pa.array(texts))
    found = Counter()
    for piece in spans.pieces(data, offsets, ~quality.BLANK, 16):
        before, index, distinct = spans.words(piece, ~quality.BLANK)
        names = distinct.to_pylist()
        for k in range(piece.texts):
            found.update((piece.first + k, names[x]) for x in index[before[k] : before[k + 1]])
    assert found == Counter((k, w) for k, t in enumerate(texts) for w in t.encode().split())


def test_forest_walks_like_one_row_at_a_time():
    r = np.random.default_rng(5)
    x = r.random((400, 6)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    forest = quality.fit(x, y, trees=12, depth=3)
    assert ((forest.score(x) >= 0.5) == y).mean() > 0.95
    for row, got in zip(x[:40], forest.raw(x)[:40], strict=True):
        want = forest.prior
        for statistic, threshold, leaf in zip(forest.statistic, forest.threshold, forest.leaf, strict=True):
            k = 0
            while k < len(statistic):
                k = 2 * k + (2 if row[statistic[k]] > threshold[k] else 1)
            want += leaf[k - len(statistic)]
        assert got == pytest.approx(want)


def test_best_split_against_all_splits():
    r = np.random.default_rng(6)
    codes, node, g, h = r.integers(0, 5, (80, 3)), r.integers(0, 2, 80), r.normal(size=80), r.random(80)
    gain, which, at = quality.best_splits(*quality.histograms(codes, node, 2, 5, g, h))
    for k in range(2):
        one = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + quality.RIDGE)
        rows = node == k
        tried = {(f, b): one(rows & (codes[:, f] <= b)) + one(rows & (codes[:, f] > b)) - one(rows) for f in range(3) for b in range(4) if min(h[rows & (codes[:, f] <= b)].sum(), h[rows & (codes[:, f] > b)].sum()) >= quality.LEAST_WEIGHT}
        assert gain[k] == pytest.approx(max(tried.values()))
        assert tried[which[k], at[k]] == pytest.approx(gain[k])


def test_quality_on_rows_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op12_quality(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 3 == 1 for d in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.5)).all() and got.score.between(0, 1).all()
    test = got[got.held_out].merge(labels, on="doc_id")
    assert len(got) == got.doc_id.nunique() == 1000 and len(test) > 80
    assert (test.predicted == test.quality).mean() >= 0.97
    assert test[test.quality == 1].score.min() > test[test.quality == 0].score.max() - 0.2


LABELS = "doc_id long, quality int, toxic int, x string, text string"


def test_quality_hard_rows(spark, docs, hard):
    junk = [(100 + k, "BUY NOW!! " * (k + 1)) for k in range(60)]
    fine = [(200 + k, "a calm line of words that says something, " * (k + 1)) for k in range(60)]
    rows = docs(hard + junk + fine)
    given = [(d, 0, 0, "", "") for d, _ in junk] + [(d, 1, 0, "", "") for d, _ in fine]
    odd = [(None, 0, 0, "", ""), (1, None, 0, "", ""), (2, 7, 0, "", ""), (9999, 1, 0, "", ""), (200, 0, 0, "", ""), (200, 1, 0, "", ""), (200, 1, 0, "", "")]
    labels = spark.createDataFrame(given + odd, LABELS)
    got = quality.classify(rows, labels).toPandas()
    assert len(got) == len(hard) + 120 and got.score.notna().all()
    assert not got[got.doc_id.isna()].held_out.any()
    assert got[got.doc_id.between(100, 159)].predicted.sum() == 0 and got[got.doc_id.between(201, 259)].predicted.all()
    again = quality.classify(rows.withColumnRenamed("lang", "held_out"), labels.unionByName(labels)).toPandas()
    assert sorted(again.score) == pytest.approx(sorted(got.score), abs=1e-9)
    none = quality.classify(rows, labels.where("false")).toPandas()
    assert (none.score == 0.5).all() and none.predicted.all()
    assert quality.classify(rows, labels.where("quality = 1")).toPandas().predicted.all()
    assert quality.classify(docs([]), labels).count() == 0
    assert len(quality.learned(quality.described(rows), labels, Scratch(spark, "test"), sample=30).leaf) == quality.TREES


def test_sample_is_of_the_smallest_hashes(spark, docs, monkeypatch):
    seen = {}
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.update(x=x, y=y))
    rows = docs([(k, "a " * k) for k in range(5000)])
    labels = rows.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    stats = quality.described(rows)
    quality.learned(stats, labels, Scratch(spark, "test"), sample=500)
    first = stats.where(~quality.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id")).limit(500).collect()
    np.testing.assert_array_equal(seen["x"], np.array([r.x for r in first], np.float32))
    assert seen["y"].tolist() == [r.doc_id % 2 for r in first]


# Resampling


def drawn(rows, target, share=10, buckets=10_000, least=20, seed=2024):
    """A plain restatement; ranks of equal rows are any."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    of = lambda t: [zlib.crc32(w.encode()) % buckets for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))]
    s, t = (Counter(b for x in texts for b in of(x)) for texts in ([x for _, x in rows], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for d, text in rows:
        found = of(text)
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for k, r in enumerate(fit[: share * len(fit) // 100], 1):
        r[4] = k
    return sorted(map(str, out))


def test_crcs_by_length():
    r = np.random.default_rng(7)
    texts = [bytes(r.integers(0, 256, int(n), dtype=np.uint8)) for n in [*r.integers(0, 40, 300), 255, 256, 257, 5000]]
    assert resampling.crcs(pa.array(texts, pa.large_binary())).tolist() == [zlib.crc32(t) for t in texts]
    assert resampling.crcs(pa.array([b"x", *texts], pa.large_binary()).slice(1)).tolist() == [zlib.crc32(t) for t in texts]


def test_resampling_on_given_documents(spark):
    same(resampling.op13_resampling(spark, SF), resampling.SQL, ["doc_id"], "documents", "benchmark")


@pytest.mark.parametrize("share", [10, 45, 100])
def test_resampling_hard_rows(spark, docs, hard, monkeypatch, share):
    monkeypatch.setattr(resampling, "DEAL", 3)
    rows = hard + [(50, "Word WORD " * 15)] * 9 + [(51 + k, f"word{k} été Straße {k} " * 9) for k in range(20)]
    target = ["word one two", None, "", "été 3 WORD"]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(docs(rows), bench, share=share).collect()
    assert sorted(str(list(r)) for r in got) == drawn(rows, target, share)
    empty = resampling.resample(docs(rows), bench.where("false"), share=share).collect()
    assert sorted(str(list(r)) for r in empty) == drawn(rows, [], share)
    assert resampling.resample(docs([]), bench).count() == 0


def test_resampling_runs_of_two_words(spark, docs):
    bench = spark.createDataFrame([(1, "b c d")], "item_id long, text string")
    got = {r.doc_id: r.n_features for r in resampling.resample(docs([(1, "a b c"), (2, "a"), (3, None), (4, "B-c d")]), bench, longest=2).collect()}
    assert got == {1: 5, 2: 1, 3: 0, 4: 5}


def test_weights_do_not_depend_on_pieces(hard, monkeypatch):
    gain = np.random.default_rng(8).integers(-900, 900, 50)
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in hard]), pa.array([t for _, t in hard])], ["doc_id", "text"])
    weigh = lambda: next(resampling._weighed(gain, 50, 1, ["doc_id", "n", "weight"])([batch])).to_pylist()
    whole = weigh()
    monkeypatch.setattr(spans.pieces, "__defaults__", (40,))
    assert weigh() == whole
