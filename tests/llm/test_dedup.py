import hashlib
import random
import re

import brute
import duckdb
import pandas as pd
import pytest
from conftest import TEXT
from pyspark.sql import functions as F

from lattica.llm import exact_dedup, language, line_dedup, ngram_join, substring_dedup


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def exact_brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(d)
    return {k: (min((x for x in v if x is not None), default=None), len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("weak", [False, True])
def test_exact(docs, hard, weak):
    """A weak digest puts different texts under one key; their bytes tell them apart."""
    digest = (lambda c: F.unhex(F.lpad(F.hex(F.crc32(c.cast("binary")) % 3), 4, "0"))) if weak else exact_dedup.sha256
    found = rows_of(exact_dedup.exact_duplicates(docs(hard), digest))
    want = sorted((str(d), *map(str, exact_brute(hard)[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")])) for d, t in hard)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), str(r["group_size"])) for r in found) == want
    # One row of each text stays, the one with the smallest doc_id, repeated rows included.
    assert sorted(str(r["doc_id"]) for r in found if r["kept"]) == sorted(str(d) for d, _ in exact_brute(hard).values())


@pytest.mark.parametrize("bits", [exact_dedup.HIT_BITS, 1 << 12])
def test_filter_before_the_comparison_misses_no_digest(spark, monkeypatch, bits):
    """A filter that is far too small lets more rows through, and never fewer."""
    monkeypatch.setattr(exact_dedup, "HIT_BITS", bits)
    rows = spark.range(20_000).select("id", F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    found = {r.id for r in exact_dedup.may_hit(rows, rows.where("id % 10 = 0").select("digest")).collect()}
    assert found >= set(range(0, 20_000, 10))
    assert len(found) < 2_010 if bits > 1 << 20 else len(found) < 20_000
    assert exact_dedup.may_hit(rows, rows.limit(0)).count() == 0


def test_drop_exact_keeps_one_row_of_each_text_and_all_columns(docs, hard):
    df = docs(hard)
    out = exact_dedup.drop_exact_duplicates(df)
    assert out.columns == df.columns
    assert out.count() == len(exact_brute(hard))
    assert exact_dedup.drop_exact_duplicates(df.limit(0)).count() == 0


def test_repeated_rows_of_a_digest_that_collides(docs):
    rows = [(1, "aa"), (1, "aa"), (2, "b"), (2, "b"), (3, "aa"), (None, "c"), (None, "c")]
    found = rows_of(exact_dedup.exact_duplicates(docs(rows), lambda c: F.unhex(F.lit("00"))))
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in found) == [("1", "1", 3, False), ("1", "1", 3, True), ("2", "2", 2, False), ("2", "2", 2, True), ("3", "1", 3, False), ("None", "None", 2, False), ("None", "None", 2, True)]


def clashing(df):
    """A table with the names that the operators use inside, and others that users have."""
    for name in ("_id", "_hash", "_op3_digest", "row_mark", "row", "hits", "Times"):
        df = df.withColumn(name, F.lit(name))
    return df


@pytest.mark.parametrize("drop", [exact_dedup.drop_exact_duplicates, ngram_join.drop_near_duplicates, language.drop_unidentified])
def test_stages_keep_columns_with_clashing_names(docs, hard, drop):
    df = clashing(docs([(d, t) for d, t in hard if d != 9]))
    out = drop(df)
    assert out.columns == df.columns and 0 < out.count() < df.count()
    assert all(r[c] == c for r in out.collect() for c in ("_id", "_hash", "_op3_digest", "row_mark", "row", "hits", "Times"))
    assert drop(df.limit(0)).count() == 0


def line_brute(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(brute.LOWER)
    held = {}
    for d, t in rows:
        for x in {key(x) for x in (t or "").split("\n")}:
            held.setdefault(x, set()).add(d)
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(key(x)) >= 40 and len(held[key(x)]) >= 5 and max(held[key(x)]) != d)]
        out[d] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    return out


def test_lines(docs):
    common, other = "A line that many of the documents hold, é " + "x" * 10, "Another long line that five documents share among them"
    rows = [(d, "\n".join([f"own line {d}", f"  {common.upper() if d % 2 else common.lower()}\t", common.lower(), "short", "", other if d < 5 else "z" * 45 + str(d), ""])) for d in range(9)] + [(20, None), (21, ""), (22, "\n")]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept"]) for r in rows_of(line_dedup.kept_lines(docs(rows)))}
    assert got == line_brute(rows)
    bitmap = rows_of(line_dedup.keep_bitmaps(docs(rows)).where("doc_id = 0"))[0]
    assert sum(bitmap["keep_runs"]) == 7 and sum(bitmap["keep_runs"][1::2]) == bitmap["n_dropped"] == 3
    assert line_dedup.kept_lines(docs(rows).limit(0)).count() == 0


def test_lines_hard_rows(docs, hard):
    rows = hard + [(None, "x" * 50), (None, "x" * 50), (20, "y\n" + "x" * 50), (21, "x" * 50 + "\n" + "x" * 50), (2, TEXT), (30, "\n".join(["x" * 50, "z"] * 20_000)), (31, "x" * 50)]
    got = sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept"]) for r in rows_of(line_dedup.kept_lines(docs(rows))))
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(brute.LOWER)
    held = {}
    for d, t in rows:  # a null comes before all ids
        for x in {key(x) for x in (t or "").split("\n")}:
            held.setdefault(x, set()).add(-1 if d is None else d)
    want = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(key(x)) >= 40 and len(held[key(x)]) >= 5 and max(held[key(x)]) != (-1 if d is None else d))]
        want.append((str(d), len(lines), len(lines) - len(stay), "\n".join(stay)))
    assert got == sorted(want)


def test_lines_of_repeated_rows_against_sql(docs):
    """Five rows of three documents keep their line, nine rows of five lose it but in the last."""
    few, many = "a line of forty characters or more, number one", "a line of forty characters or more, number two"
    ids = [1, 1, 1, 2, 3], [1, 1, 1, 2, 2, 3, 4, 4, 5]
    rows = sorted({(d, "\n".join([few] * (d <= 3) + [many, f"own {d}"])) for d in ids[1]})
    repeated = [r for d in ids[1] for r in rows if r[0] == d]
    got = {(r["doc_id"], r["n_dropped"]) for r in rows_of(line_dedup.kept_lines(docs(repeated)))}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert got == {(d, n) for d, n in con.execute(f"SELECT doc_id, n_dropped FROM ({line_dedup.SQL})").fetchall()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 0)}


def near_copies(seed=3, n=40):
    rnd = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    bases = [[rnd.choice(vocabulary) for _ in range(rnd.choice([3, 6, 40, 90, 200]))] for _ in range(6)]
    rows = []
    for d in range(n):
        words = list(rnd.choice(bases))
        for _ in range(rnd.randrange(4)):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        rows.append((d, " ".join(words).upper() if d % 7 == 0 else "  ".join(words)))
    return rows


@pytest.mark.parametrize("block", [None, 400, 90])
def test_near(docs, monkeypatch, block):
    """Small blocks cut clusters, so that links are found between components as well."""
    if block:
        monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", block)
    rows = near_copies() + [(100, None), (101, ""), (102, "a b"), (103, "A b"), (104, " ")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows_of(ngram_join.linked(docs(rows)))}
    assert got == brute.near(rows)


def test_near_in_a_chain(docs, monkeypatch):
    """One cluster of texts that each share much with the next: few link, all are chained."""
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 500)
    searched = []
    monkeypatch.setattr(ngram_join, "_links", lambda groups, *keys, links=ngram_join._links: searched.append((keys, groups.count())) or links(groups, *keys))
    rows, words = [], [f"c{i}" for i in range(3000)]
    for d in range(60):
        shift = 0 if d % 6 == 5 else 3
        start = sum(0 if k % 6 == 5 else 11 + 3 for k in range(d)) + shift
        rows.append((d, " ".join(words[start : start + 60])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows_of(ngram_join.linked(docs(rows)))}
    assert got == brute.near(rows)
    assert [len(k) for k, _ in searched] == [3, 2, 4]  # blocks, firsts, runs between components


def test_near_hard_rows(docs, hard):
    df = docs(hard)
    found = rows_of(ngram_join.linked(df))
    assert len(found) == len(hard)
    sizes = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in found)
    want = brute.near([(d, t) for d, t in hard if d is not None and t != hard[-1][1]])
    # Rows with a null doc_id link by their text; a text of no words links with nothing.
    want = [(str(d), *map(str, want[d])) for d, t in hard if d is not None and t != hard[-1][1]] + [("None", "56", "1"), ("None", "0", "None"), ("2", "3", "2")]
    assert sorted((d, str(n), c) for d, n, c in sizes) == sorted(want)
    assert ngram_join.linked(df.limit(0)).count() == 0
    out = ngram_join.drop_near_duplicates(df)
    assert out.columns == df.columns and {r.doc_id for r in out.select("doc_id").collect()} >= {1, 3, 4, 5, 6, 9, 10}


def passages(seed=5, n=30):
    rnd = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(300)]
    shared = [[rnd.choice(vocabulary) for _ in range(rnd.choice([12, 13, 14, 30, 70]))] for _ in range(6)]
    rows = []
    for d in range(n):
        words = []
        for _ in range(rnd.randrange(1, 5)):
            words += rnd.choice(shared) if rnd.random() < 0.6 else [rnd.choice(vocabulary) for _ in range(rnd.randrange(30))]
        rows.append((d, " \n".join(words)))
    return rows


@pytest.mark.parametrize("stretch", [None, 5])
def test_passages(docs, monkeypatch, stretch):
    """Short stretches, and many shards of several parts."""
    if stretch:
        for name, value in (("STRETCH", stretch), ("SHARD_CHARS", 500), ("STREAM_ROWS", 3)):
            monkeypatch.setattr(substring_dedup, name, value)
    rows = passages() + [(100, None), (101, "short text"), (102, "the same " * 40), (103, "the same " * 30)]
    base, lost = substring_dedup.repeated_passages(docs(rows))
    want = brute.repeated(rows)
    assert {r["doc_id"]: r["n_words"] for r in rows_of(base)} == {d: w[0] for d, w in want.items()}
    assert {r["doc_id"]: (r["n_removed"], r["kept"]) for r in rows_of(lost)} == {d: w[1:] for d, w in want.items() if w[1]}
    whole = {r["doc_id"]: r["sha256"] for r in rows_of(base)}
    assert whole[101] == hashlib.sha256(b"short text").hexdigest()


def test_passages_hard_rows(docs, hard):
    base, lost = substring_dedup.repeated_passages(docs(hard))
    counts = sorted((str(r["doc_id"]), r["n_words"]) for r in rows_of(base))
    assert counts == sorted((str(d), len(brute.words(t))) for d, t in hard)
    # Repeated rows of one doc_id lose the same words, once; rows without one lose none.
    want = brute.repeated([(d, t) for d, t in hard if d is not None and t != hard[-1][1]])
    assert {r["doc_id"]: (r["n_removed"], r["kept"]) for r in rows_of(lost)} == {d: w[1:] for d, w in want.items() if w[1]}
    base, lost = substring_dedup.repeated_passages(docs(hard).limit(0))
    assert base.count() == 0 and lost.count() == 0
