"""Language ID by fusing evidence in Bayes' rule.

A text gives likelihoods under byte-pair counts of the declared languages, counted
over all rows in one grouped aggregation. What a row declares (its markup's or its
table's language), its address suffix and its host give the rest: the chance of a
declaration under each language comes from counts, and the prior of a host is
smoothed towards its suffix's, and that towards the prior of all rows. Counts take
each row's language from its text alone, so no evidence is used twice.

Text counts of neighbouring bytes are not independent, so their log likelihood is
scaled down (``TEMPER``). Beside the learned languages stands an unknown one, which takes
every byte pair of the model to be equally likely. It competes with the learned ones as a
whole, each BLOCK pairs of the text under the one that suits them best, so that neither
their number nor a second language in the text counts against them. A row is rejected if it has
no letter, or if its best language stays under ``LEAST`` after all evidence, the unknown
one's share included.

Every language whose declared rows have LEAST_PAIRS byte pairs is learned, however many
there are and however small their share. The model has a count for each language and
byte pair that occurs; a row carries one number for each language. Hosts meet their rows
through ``common.lookup``, so a hot host is no burden.

Defined results: a null or empty text has no letters and is rejected; a missing
declaration, host or suffix is evidence of its own kind ("unknown"); repeated rows
get the same answer; without rows the result is empty; where no row declares a
language nothing can be learned and every row is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, documents, lookup, row_mark, without

#: A language is learned from as many byte pairs (a few sentences), whatever its share of the rows.
LEAST_PAIRS = 200
#: UNKNOWN is the prior of a language that is not declared anywhere.
TEMPER, SMOOTH, PRIOR_ROWS, LEAST, UNKNOWN, BLOCK = 0.25, 0.5, 20.0, 0.45, 0.001, 64
PAIRS = 1 << 16
#: Tables of counts in a worker at once; one more sends the last one's counts on.
TABLES = 256

COUNTS = T.StructType([T.StructField("declared", T.StringType()), T.StructField("pair", T.IntegerType()), T.StructField("n", T.LongType())])
_LETTERS = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))


def _pairs(text: str | None) -> np.ndarray:
    """Codes of neighbouring bytes of a text in lower case; other characters than letters are blanks."""
    raw = np.frombuffer(b" " + (text or "").lower().encode("utf-8", "replace").translate(_LETTERS) + b" ", np.uint8).astype(np.uint16)
    codes = (raw[:-1] << 8) | raw[1:]
    return codes[codes != 0x2020]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of byte pairs by declaration; a declaration's counts are a table only while they fill one."""
    totals: dict[str, np.ndarray] = {}

    def rows(declared: str, n: np.ndarray) -> pa.RecordBatch:
        seen = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array([declared] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(n[seen])], COUNTS.names)

    for batch in batches:
        for text, declared in zip(batch.column("text").to_pylist(), batch.column("declared").to_pylist(), strict=True):
            if declared is None:
                continue
            if declared not in totals:
                if len(totals) >= TABLES:
                    yield rows(*totals.popitem())
                totals[declared] = np.zeros(PAIRS, np.int64)
            totals[declared] += np.bincount(_pairs(text), minlength=PAIRS)
    for declared, n in totals.items():
        yield rows(declared, n)


def _score(sent, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, column = sent.value
        flat = -np.log(len(table))
        for batch in batches:
            scores, unknown, letters = [], [], []
            for text in batch.column("text").to_pylist():
                codes = _pairs(text)
                letters.append(len(codes))
                blocks = np.add.reduceat(table[column[codes]], np.arange(0, len(codes), BLOCK), axis=0) if len(codes) else table[:0]
                scores.append(blocks.sum(axis=0, dtype=np.float64).tolist())
                unknown.append(len(codes) * flat - blocks.max(axis=1).sum(dtype=np.float64))
            kept = [batch.column(k) for k in keys]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.list_(pa.float64())), pa.array(unknown, pa.float64()), pa.array(letters, pa.int64())], [*keys, "likelihood", "unknown", "letters"])

    return run


def _tally(scored: DataFrame, keys: list[str], languages: int) -> DataFrame:
    """The keys, how many rows with letters have each language by their text (c), and all rows (uses)."""
    cells = scored.groupBy(*keys, F.when(F.col("letters") > 0, F.col("by_text")).alias("_i")).agg(F.count("*").alias("_n"))
    pairs = F.collect_list(F.when(F.col("_i").isNotNull(), F.struct("_i", F.col("_n").cast("double").alias("_n"))))
    rows = cells.groupBy(*keys).agg(F.map_from_entries(pairs).alias("_m"), F.sum("_n").alias("uses"))
    c = F.transform(F.sequence(F.lit(0), F.lit(languages - 1)), lambda i: F.coalesce(F.element_at("_m", i), F.lit(0.0)))
    return rows.select(*keys, c.alias("c"), "uses")


def identify(rows: DataFrame, key: list[str]) -> DataFrame:
    """The key columns, language, posterior, text_language and kept, for rows with text, declared, host and suffix."""
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "language")
    unknown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = rows.select(*key, F.col("text").cast("string").alias("text"), "declared", unknown("host"), unknown("suffix"))
    pairs = rows.select("text", "declared").mapInArrow(_count, COUNTS).groupBy("declared", "pair").agg(F.sum("n").alias("n"))
    pairs = scratch.write(pairs, "pairs")
    enough = pairs.groupBy("declared").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_PAIRS)
    names = sorted(r.declared for r in enough.select("declared").collect())
    if not names:
        empty = F.lit(None).cast("string")
        return rows.select(*key, empty.alias("language"), F.lit(0.0).alias("posterior"), empty.alias("text_language"), F.lit(False).alias("kept"))

    model = pairs.join(F.broadcast(enough.select("declared")), "declared").toPandas()
    seen, at = np.unique(model["pair"].to_numpy(), return_inverse=True)
    counts = np.full((len(seen) + 1, len(names)), SMOOTH)  # the last row is of all other pairs
    np.add.at(counts, (at, np.searchsorted(np.array(names, dtype=object), model["declared"].to_numpy())), model["n"].to_numpy())
    table = np.log(counts / counts.sum(axis=0, keepdims=True)).astype(np.float32)
    column = np.full(PAIRS, len(seen), np.int32)
    column[seen] = np.arange(len(seen))
    sent = spark.sparkContext.broadcast((table, column))

    keys = [*key, "declared", "host", "suffix"]
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField("likelihood", T.ArrayType(T.DoubleType())), T.StructField("unknown", T.DoubleType()), T.StructField("letters", T.LongType())])
    place = F.coalesce(F.array_position(F.lit(names), F.col("declared")).cast("int"), F.lit(0))
    scored = rows.select(*keys, "text").mapInArrow(_score(sent, keys), schema)
    scored = scored.withColumn("said", place).withColumn("by_text", F.array_position("likelihood", F.array_max("likelihood")).cast("int") - 1)
    scored = scratch.write(scored, "scored")

    # Counts of languages by what the texts say: of hosts, suffixes, all rows, and declarations.
    hosts = scratch.write(_tally(scored, ["suffix", "host"], len(names)), "hosts")
    of_said = {r.said: r for r in _tally(scored, ["said"], len(names)).collect()}
    total = sum(r.uses for r in of_said.values())

    def smooth(own: Column, wide: Column) -> Column:
        n = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(own, wide, lambda x, p: (x + PRIOR_ROWS * p) / (n + PRIOR_ROWS))

    every = np.sum([r.c for r in of_said.values()], axis=0) if of_said else np.zeros(len(names))
    wide = (every + SMOOTH) / (every.sum() + SMOOTH * len(names))
    suffixes = _tally(scored, ["suffix"], len(names)).select("suffix", smooth(F.col("c"), F.lit(wide.tolist())).alias("wide"))
    priors = hosts.join(suffixes, "suffix").select("suffix", "host", smooth(F.col("c"), F.col("wide")).alias("prior"), "uses")
    priors = scratch.write(priors, "priors")

    table_said = np.array([of_said[i].c if i in of_said else [0.0] * len(names) for i in range(len(names) + 1)]) + SMOOTH
    said_given = np.log(table_said / table_said.sum(axis=0, keepdims=True))
    fused = lookup(scored, priors, ["suffix", "host"], "uses", total, [*key, "letters"])
    fused = fused.join(F.broadcast(spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(said_given)], "said int, told array<double>")), "said")
    logs = F.transform(F.arrays_zip(F.col("likelihood").alias("t"), F.col("prior").alias("p"), F.col("told").alias("d")), lambda x: TEMPER * x["t"] + F.log(x["p"]) + x["d"])
    fused = fused.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    share = 1.0 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    posterior = share / (1.0 + UNKNOWN * F.exp(F.least(TEMPER * F.col("unknown"), F.lit(700.0))))
    name = lambda i: F.element_at(F.lit(names), i)
    best = F.array_position("logs", F.col("top")).cast("int")
    found = fused.select(*key, name(best).alias("language"), posterior.alias("posterior"), F.when(F.col("letters") > 0, name(F.col("by_text") + 1)).alias("text_language"), "letters")
    return found.select(*key, "language", "posterior", "text_language", ((F.col("letters") > 0) & (F.col("posterior") >= LEAST)).alias("kept"))


def documents_evidence(docs: DataFrame) -> DataFrame:
    """Documents declare a language in ``lang``; their source stands for the host."""
    return docs.select("doc_id", "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.regexp_replace(F.coalesce(F.col("source"), F.lit("")), "[0-9]+$", "").alias("suffix"))


def pages_evidence(pages: DataFrame) -> DataFrame:
    """Pages declare a language in their markup; host and suffix come from the address."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>|&[#A-Za-z0-9]+;", " ")
    declared = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    return pages.select("page_id", text.alias("text"), F.when(declared != "", declared).alias("declared"), host.alias("host"), F.regexp_extract(host, r"([^.]+)$", 1).alias("suffix"))


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, whose language is told.

    The rejected rows, which are few, are looked up, by doc_id and a hash of the text."""
    rows = documents_evidence(docs).withColumn("row_mark", row_mark(F.col("text")))
    rejected = identify(rows, ["doc_id", "row_mark"]).where(~F.col("kept")).select(F.col("doc_id").cast("long").alias("doc_id"), "row_mark").distinct()
    return without(docs, Scratch(docs.sparkSession, "rejected").write(rejected, "rejected"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents_evidence(documents(spark, sf_dir)), ["doc_id"])


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(pages_evidence(spark.read.parquet(f"{sf_dir}/pages.parquet")), ["page_id"])
