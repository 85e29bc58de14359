import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import packing
from lattica.llm.common import Scratch

ENGLISH = "the people of the town were walking through the old streets and they spoke of the weather while the children ran home"
GERMAN = "die leute der stadt gingen durch die alten strassen und sie sprachen über das wetter während die kinder nach hause liefen"
ITEM = "seven wizards mix potions quietly at dawn while the lazy dog sleeps under a tall green tree"


def test_pipeline_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, []
    scratch = Scratch(spark, "test")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = scratch.write(stage(spark, docs, sf), f"stage-{k}")
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 150
    pieces = corpus_pipeline.run(spark, sf)
    assert pieces.select("doc_id").distinct().count() == counts[-1]


def varied(d, text):
    return f"{text} {' '.join(f'street{d} number{d} {w}' for w in text.split())}"


@pytest.fixture
def corpus(spark, tmp_path):
    """Tables of hard rows: nulls, repeats, ties, a long text and columns of clashing names."""
    rows = [(d, varied(d, ENGLISH if d % 2 else GERMAN), "en" if d % 2 else "de") for d in range(30)]
    rows += [(40, None, "en"), (41, "", "en"), (42, "12 34 !!", None)]  # no language
    rows += [(50, rows[3][1].replace(" ", "\n "), "en"), (3, rows[3][1], "en"), (None, rows[4][1], "de"), (None, varied(99, ENGLISH), "en")]  # copies, repeats
    rows += [(60, rows[5][1] + " indeed", "en"), (61, rows[5][1] + " surely so", "en")]  # near copies
    rows += [(70, f"{ENGLISH} {ITEM} and so on", "en")]  # contaminated
    rows += [(80, " ".join(f"{w}{i}" for i in range(3000) for w in "these words went on and on".split()), "en")]
    made = spark.createDataFrame([(d, t, lang, "src", len(t or "")) for d, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("_id", "_hash", "row_mark", "node", "Row"):
        made = made.withColumn(name, F.lit(name))
    made.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    made.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").limit(0).write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    return str(tmp_path), {d: t for d, t, _ in rows}, rows


def test_pipeline_by_value(spark, corpus):
    from tokenizers import Tokenizer

    sf, _, rows = corpus
    want = {(d, t) for d, t, _ in rows} - {(40, None), (41, ""), (42, "12 34 !!"), (50, rows[33][1]), (None, rows[4][1])}
    want = {(d, t) for d, t in want if d not in (60, 61, 70)}
    assert brute.near([(d, t) for d, t, _ in rows if d in (5, 60, 61)])[61][1] == 5
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    ids = sorted((str(d), np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for d, t in want)
    pieces = sorted(corpus_pipeline.run(spark, sf).collect(), key=lambda p: (p.sequence_id, p.offset))
    got, open_ = [], b""
    for k, p in enumerate(pieces):
        assert p.sequence_id * packing.WINDOW + p.offset == sum(x.length for x in pieces[:k])
        open_ += p.ids
        if p.start + p.length == p.doc_tokens:
            got.append((str(p.doc_id), open_))
            open_ = b""
    assert sorted(got) == ids


def test_stages_keep_columns(spark, corpus):
    sf, _, rows = corpus
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
    gone = corpus_pipeline.decontaminate(spark, docs, sf)
    assert docs.count() - gone.count() == 1 and gone.where("doc_id = 70").isEmpty()


def test_pipeline_of_nothing(spark, corpus):
    assert corpus_pipeline.run(spark, corpus[0] + "/none").count() == 0
