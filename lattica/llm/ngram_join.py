"""Similarity join on word shingles by T-occurrence search.

Two texts link when the Jaccard similarity of their sets of five-word shingles is
0.8 or more. Texts with equal sets are one node. A fixed share of all
hashes (``SAMPLE``) picks the same shingles in every text; of n shingles, a linked
text misses n / 5 at most, so it shares all but n / 5 of those picked. A text that
has too few picked for that to tell much posts all its shingles as well.

Postings are range-partitioned by (shingle, node), which splits hot shingles over
tasks, and streamed; those of one node only end there. The others are counted, and a
node keeps its n / 5 + 1 rarest, or none if it has more unshared ones than that: no
node it links with can be missed, and a passage in a third of all documents is never
among the rarest of a document that has others. What is kept is sorted by (shingle,
set size, node) and chained where sizes stay within the threshold, which leaves
clusters of possible links. Small clusters are searched whole, many to a task.

A cluster of more than BLOCK_SHINGLES is cut into blocks, which are searched by themselves;
then one set of each component found so far is searched for among the others. What can
still be missing are links between components that share a kept shingle, so only runs of
one shingle that hold several components are searched, the sets outside a run's largest
component against all of the run. A cluster of many chained but different texts thus costs
its runs, and a group of near copies about one search a copy; neither costs its square.

A search divides a query's inverted lists: the longest are set aside, the short ones are
merged into counts, list by list without a copy of them, and what can still reach the
threshold T is probed in the long lists by binary search (DivideSkip). A link inside a
component that is already known is not looked for, and no pairs are listed.

Defined results: a null text or one without words has no shingles and links with
nothing; fewer than five words are one shingle; repeated rows and equal texts share
a component; a null doc_id counts for nothing when the smallest is taken; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, documents, gram_hashes, lookup, mix, text_bytes, without, word_hashes
from .graphs import components

WORDS, PERCENT = 5, 80
#: The share of hashes that is posted, and the share of its shingles under which a text posts all.
SAMPLE, THIN = 0.3, 0.25
#: Shingles that one search holds, of one block of a cluster.
BLOCK_SHINGLES = 250_000

SETS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("picked", T.IntegerType()), T.StructField("all", T.BooleanType()), T.StructField("tokens", T.ArrayType(T.LongType()))])
POSTINGS = T.StructType([T.StructField("token", T.LongType()), T.StructField("node", T.LongType())])
CHAIN = T.StructType([T.StructField(n, T.LongType()) for n in ("a", "b", "token", "n")])
SEARCHED = T.StructType([T.StructField("node", T.LongType()), T.StructField("cluster", T.LongType()), T.StructField("blocks", T.IntegerType()), T.StructField("shingles", T.BinaryType())])
LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def shingles(text: bytes, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = word_hashes(text.lower().split())
    if not len(words):
        return words
    if len(words) < size:
        return mix(gram_hashes(words, len(words)) + np.uint64(len(words)))
    return np.unique(gram_hashes(words, size))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes and digests of the sets, and their posted tokens: even ones for picked
    shingles, odd ones where all are posted."""
    limit, odd = np.uint64(int(SAMPLE * 2**64)), np.uint64(1)
    for batch in batches:
        sizes, digests, picks, wholes, tokens = [], [], [], [], []
        for text in text_bytes(batch.column("text")):
            found = shingles(text)
            n, some = len(found), found[: np.searchsorted(found, limit)]
            whole = len(some) < THIN * n
            sizes.append(n)
            digests.append(xxhash.xxh3_128_digest(found.tobytes()))
            picks.append(len(some))
            wholes.append(whole)
            tokens.append(some & ~odd)
            if whole:
                tokens[-1] = np.concatenate((tokens[-1], found | odd))
        ends = np.concatenate(([0], np.cumsum([len(x) for x in tokens])))
        flat = np.concatenate(tokens).view(np.int64) if tokens else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(picks, pa.int32()), pa.array(wholes, pa.bool_()), lists], SETS.names)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (token, node), those whose token another node has too. The first and the
    last token of a stretch of rows may go on elsewhere, so they always pass."""
    held, passed = None, True  # the last row, and whether it was passed on
    for batch in batches:
        if not batch.num_rows:
            continue
        token, node = batch.column("token").to_numpy(), batch.column("node").to_numpy()
        if held is not None and not passed:
            token, node = np.concatenate(([held[0]], token)), np.concatenate(([held[1]], node))
        again = token[1:] == token[:-1]
        out = np.concatenate(([held is None or (passed and token[0] == held[0])], again)) | np.concatenate((again, [False]))
        held, passed = (int(token[-1]), int(node[-1])), bool(out[-1])
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(token[out]), pa.array(node[out])], POSTINGS.names)
    if held is not None and not passed:
        yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1]])], POSTINGS.names)


def rarest_shared(postings: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """node, n and prefix: the shared tokens by which a node must meet each node it links with."""
    found = postings.repartitionByRange("token", "node").sortWithinPartitions("token", "node").mapInArrow(_shared, POSTINGS)
    found = scratch.write(found.join(nodes.select("node"), "node", "left_semi"), "shared")
    counts = found.groupBy("token").agg(F.count("*").alias("nodes")).where("nodes > 1")
    counted = lookup(found, counts, ["token"], "nodes", found.count(), ["node"]).where("nodes is not null")
    lists = counted.groupBy("node", (F.col("token").bitwiseAND(1) == 1).alias("odd")).agg(F.array_sort(F.collect_list(F.struct("nodes", "token"))).alias("tokens"))
    lists = lists.join(nodes.select("node", "n", "picked", "all"), "node")
    missed = F.floor(F.col("n") * F.lit(100 - PERCENT) / F.lit(100))
    posted = F.when(F.col("odd"), F.col("n")).otherwise(F.col("picked"))
    # Where so few are picked that all may be missed, every shared one counts.
    room = F.when((posted <= missed) | (F.col("all") & ~F.col("odd")), F.size("tokens")).otherwise(missed + 1 - (posted - F.size("tokens")))
    kept = lists.withColumn("room", room.cast("int")).where("room > 0").select("node", "n", F.transform(F.slice("tokens", 1, F.col("room")), lambda x: x["token"]).alias("prefix"))
    return kept.groupBy("node", "n").agg(F.flatten(F.collect_list("prefix")).alias("prefix"))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (first of a run, node) of sorted postings, then the ends of this stretch of them.

    A run is one token's postings as long as each size is within the threshold of
    the one before. Edges have token and n null; ends have b null.
    """
    head = tail = None  # tail: token, size and first node of the run that is open
    for batch in batches:
        if not batch.num_rows:
            continue
        token, n, node = (batch.column(c).to_numpy() for c in ("token", "n", "node"))
        if head is None:
            head = (int(token[0]), int(n[0]), int(node[0]))
        before_token = np.concatenate(([tail[0] if tail else token[0]], token[:-1]))
        before_n = np.concatenate(([tail[1] if tail else -1], n[:-1]))
        starts = (token != before_token) | (100 * before_n < PERCENT * n)
        place = np.maximum.accumulate(np.where(starts, np.arange(len(node)), -1))
        first = np.where(place >= 0, node[place], tail[2] if tail else 0)
        some = ~starts & (first != node)
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array(first[some]), pa.array(node[some]), pa.nulls(int(some.sum()), pa.int64()), pa.nulls(int(some.sum()), pa.int64())], CHAIN.names)
        tail = (int(token[-1]), int(n[-1]), int(first[-1]))
    if head is not None:
        yield pa.RecordBatch.from_arrays([pa.array([head[2], tail[2]]), pa.nulls(2, pa.int64()), pa.array([head[0], tail[0]]), pa.array([head[1], tail[1]])], CHAIN.names)


def candidate_edges(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b) whose components hold every pair of nodes that can link."""
    postings = nodes.select("node", "n", F.explode("prefix").alias("token"))
    order = ["token", "n", "node"]
    found = postings.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_chained, CHAIN)
    # An edge is found once for each shared token; a task's copies of it are enough once.
    found = scratch.write(found.groupBy(CHAIN.names).agg(F.count("*").alias("times")).drop("times"), "chains")
    # Runs that go over from one stretch to the next: two ends for each.
    ends = found.where("b is null").select("token", "n", F.col("a").alias("node"))
    over = ends.repartition("token").sortWithinPartitions(*order).mapInArrow(_chained, CHAIN)
    return found.where("b is not null").select("a", "b").unionByName(over.where("b is not null").select("a", "b")).distinct()


class Forest:
    """Union by smallest root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        self.up[max(a, b)] = min(a, b)


def divide_skip(sets: list[np.ndarray], index_of: np.ndarray, queries: list[int], forest: Forest) -> list[tuple[int, int]]:
    """Links between queries and indexed sets that join components; sets hold sorted hashes.

    index_of marks the sets that are indexed. A pair is looked at from one side: a
    query meets indexed sets of lower number, or any if it is not indexed itself.
    """
    indexed = np.flatnonzero(index_of)
    sizes = np.array([len(s) for s in sets])
    every = np.concatenate([sets[i] for i in indexed]) if len(indexed) else np.empty(0, np.uint64)
    owner = np.repeat(indexed, sizes[indexed])
    order = np.lexsort((owner, every))
    every, owner = every[order], owner[order]
    tally = np.zeros(len(sets), np.int32)
    out: list[tuple[int, int]] = []
    for q in queries:
        own, n = sets[q], len(sets[q])
        least = -(-PERCENT * n // 100)  # T: a linked set shares at least this many
        low, high = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
        lengths = high - low
        rank = np.argsort(lengths, kind="stable")
        long_ = rank[n - least + 1 :]  # the T - 1 longest lists; a result is in one of the others
        short = rank[: n - least + 1]
        short = short[lengths[short] > 0]
        if not len(short):
            continue
        # The short lists are merged into a count for each set, which holds no copy of them.
        tally[:] = 0
        for first, last in zip(low[short].tolist(), high[short].tolist(), strict=True):
            tally[owner[first:last]] += 1
        merged = np.flatnonzero(tally)
        counts = tally[merged]
        ok = (merged < q) if index_of[q] else merged != q
        ok &= (100 * sizes[merged] >= PERCENT * n) & (100 * n >= PERCENT * sizes[merged])
        merged, counts = merged[ok], counts[ok]
        best_first = np.argsort(-counts, kind="stable")
        merged, counts = merged[best_first], counts[best_first]
        step = 8
        while len(merged):
            # Only sets of other components, a few at first, then more at a time.
            mine = forest.root(q)
            other = np.array([forest.root(int(x)) != mine for x in merged], bool)
            merged, counts = merged[other], counts[other]
            now, have = merged[:step], counts[:step].copy()
            merged, counts = merged[step:], counts[step:]
            need = np.maximum(-(-PERCENT * (n + sizes[now]) // (100 + PERCENT)), least)
            left = len(long_)
            for k in long_:
                if not len(now):
                    break
                some = owner[low[k] : high[k]]
                place = np.searchsorted(some, now)
                have += (place < len(some)) & (some[np.minimum(place, len(some) - 1)] == now) if len(some) else 0
                left -= 1
                if left % 16 == 0:
                    able = have + left >= need
                    now, have, need = now[able], have[able], need[able]
            for x, shared in zip(now.tolist(), have.tolist(), strict=True):
                if 100 * shared >= PERCENT * (n + int(sizes[x]) - shared) and forest.root(x) != forest.root(q):
                    forest.join(x, q)
                    out.append((q, x))
            step = min(4 * step, 4096)
    return out


def _searched(rows: pa.Table) -> pa.Table:
    """Links of a group of sets (node, indexed, known, shingles): every set is searched for
    among the indexed ones. Sets whose component (known) is the same are not linked again."""
    held: dict[int, tuple] = {}
    for node, indexed, known, raw in zip(*[rows.column(c).to_pylist() for c in ("node", "indexed", "known", "shingles")], strict=True):
        held[node] = (indexed or (node in held and held[node][0]), known, raw)
    # By size, so that a query meets the sets that are no larger first.
    nodes = sorted(held, key=lambda k: (len(held[k][2]), k))
    forest, first_of = Forest(len(nodes)), {}
    for k, node in enumerate(nodes):
        forest.join(k, first_of.setdefault(held[node][1], k))
    sets = [np.frombuffer(held[node][2], np.uint64) for node in nodes]
    links = divide_skip(sets, np.array([held[node][0] for node in nodes], bool), list(range(len(sets))), forest)
    return pa.table([pa.array([nodes[x] for x, _ in links], pa.int64()), pa.array([nodes[y] for _, y in links], pa.int64())], names=LINKS.names)


def _payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            some = batch.slice(k, 256)
            sets = [shingles(t).tobytes() for t in text_bytes(some.column("text"))]
            yield pa.RecordBatch.from_arrays([some.column("node"), some.column("cluster"), some.column("blocks"), pa.array(sets, pa.binary())], SEARCHED.names)


def _links(groups: DataFrame, *keys: str) -> DataFrame:
    return groups.select(*keys, "node", "indexed", "known", "shingles").groupBy(*keys).applyInArrow(lambda t: _searched(t), LINKS)


def between_components(large: DataFrame, prefixes: DataFrame, payload: DataFrame, scratch: Scratch) -> DataFrame:
    """Links between different components of large clusters (node, n, cluster, known).

    Only runs of one kept shingle that hold several components can have such links. In a run,
    the sets outside its largest component are indexed, and all of the run are searched for
    among them. A cluster is searched run by run, or as one run of all sets that are in any of
    them, whichever sends fewer shingles. A run beyond BLOCK_SHINGLES is cut on both sides;
    small runs go many to a group."""
    cut = lambda load: F.ceil(load / F.lit(BLOCK_SHINGLES)).cast("int")

    def several(posts: DataFrame) -> DataFrame:
        """The runs (cluster, token) of several components, with what searching them sends."""
        sides = posts.groupBy("cluster", "token", "known").agg(F.sum("n").alias("load"), F.count("*").alias("rows"))
        runs = sides.groupBy("cluster", "token").agg(F.max(F.struct("load", "known")).alias("most"), F.sum("load").alias("load"), F.sum("rows").alias("rows"), F.count("*").alias("components"))
        rest = F.col("load") - F.col("most.load")
        runs = runs.where("components > 1").select("cluster", "token", F.col("most.known").alias("most"), cut(F.col("load")).alias("parts"), cut(rest).alias("index_parts"), "rows", "load", rest.alias("rest"))
        return runs.withColumn("sent", F.col("load") * F.col("index_parts") + F.col("rest") * F.col("parts")).drop("rest")

    def of_runs(posts: DataFrame, runs: DataFrame) -> DataFrame:
        return lookup(posts, runs.drop("load", "sent"), ["cluster", "token"], "rows", max(1, posts.count()), ["node"]).where("rows is not null")

    posts = large.join(prefixes.select("node", F.explode("prefix").alias("token")), "node")
    posts = scratch.write(posts.select("cluster", "token", "node", "known", "n"), "posts")
    runs = scratch.write(several(posts), "runs")
    once = scratch.write(of_runs(posts, runs).select("cluster", F.lit(0).cast("long").alias("token"), "node", "known", "n").distinct(), "once")
    whole = several(once)
    costs = runs.groupBy("cluster").agg(F.sum("sent").alias("by_run")).join(whole.select("cluster", F.col("sent").alias("at_once")), "cluster")
    costs = scratch.write(costs.select("cluster", (F.col("at_once") <= F.col("by_run")).alias("whole")), "costs")
    pick = lambda df, which: df.join(costs.where(F.col("whole") == which), "cluster").drop("whole")
    runs = scratch.write(pick(runs, False).unionByName(pick(whole, True)), "searched")
    total = runs.agg(F.coalesce(F.sum("load"), F.lit(0))).first()[0]
    found = of_runs(scratch.write(pick(posts, False).unionByName(pick(once, True)), "searched-posts"), runs)

    part = lambda n: F.pmod(F.xxhash64("node"), n.cast("long")).cast("int")
    found = found.withColumn("indexed", F.col("known") != F.col("most")).withColumn("small", (F.col("parts") == 1) & (F.col("index_parts") == 1))
    found = found.withColumn("bundle", F.when(F.col("small"), F.pmod(F.xxhash64("token"), F.lit(max(1, -(-total // BLOCK_SHINGLES))))).otherwise(F.xxhash64("cluster", "token")))
    role = lambda i, j, indexed: F.struct(i.alias("i"), j.alias("j"), F.lit(indexed).alias("indexed"))
    asks = F.transform(F.sequence(F.lit(0), F.col("index_parts") - 1), lambda i: role(i, part(F.col("parts")), False))
    answers = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: role(part(F.col("index_parts")), j, True))
    dealt = found.select("small", "bundle", "node", "known", F.explode(F.when(F.col("indexed"), F.concat(asks, answers)).otherwise(asks)).alias("r"))
    dealt = dealt.groupBy("small", "bundle", "r.i", "r.j", "node", "known").agg(F.max("r.indexed").alias("indexed"))
    return _links(dealt.join(payload, "node"), "small", "bundle", "i", "j")


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, node, n_shingles and component_id for each row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram")
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sets = body.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_sets, SETS)
    sets = scratch.write(sets.withColumn("node", F.monotonically_increasing_id()), "sets")

    # One node, the first row, for each distinct set.
    classes = sets.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_min"), F.count("*").alias("docs"), F.min(F.struct("node", "doc_id", "text_hash", "n", "picked", "all")).alias("one"))
    nodes = scratch.write(classes.select("digest", "doc_min", "docs", "one.*"), "nodes")
    prefixes = scratch.write(rarest_shared(sets.select(F.explode("tokens").alias("token"), "node"), nodes, scratch), "prefixes")
    rows = scratch.write(sets.select("doc_id", "text_hash", "n", "digest", "node"), "rows")
    scratch.drop("sets")
    sets = rows

    clusters = components(candidate_edges(prefixes, scratch), scratch, "cluster")
    held = clusters.join(nodes.select("node", "n", "doc_id", "text_hash"), "node")
    loads = held.groupBy("root").agg(F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)).cast("int").alias("blocks"), F.count("*").alias("size"))
    held = scratch.write(lookup(held, loads, ["root"], "size", clusters.count(), ["node"]), "held")
    chosen = held.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "node", F.col("root").alias("cluster"), "blocks")
    # Rows that repeat doc_id and text would give a node twice, which a search takes once. The
    # chosen rows grow with the input, so they are shuffled at every size.
    texts = body.join(chosen.hint("merge"), body["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(body["text"]) == F.col("_hash")))
    payload = scratch.write(texts.select("text", "node", "cluster", "blocks").mapInArrow(_payload, SEARCHED), "payload")

    # Small clusters are searched together, a block of a large one by itself.
    total = held.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bundles = max(1, spark.sparkContext.defaultParallelism, -(-total // BLOCK_SHINGLES))
    key = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(bundles))).otherwise(F.col("cluster"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long"))
    whole = payload.select((F.col("blocks") == 1).alias("small"), key.alias("bundle"), block.alias("block"), "node", F.lit(True).alias("indexed"), F.col("node").alias("known"), "shingles")
    links = scratch.write(_links(whole, "small", "bundle", "block"), "links")

    large = held.where("blocks > 1").select("node", "n", F.col("root").alias("cluster"))
    large_sets = payload.where("blocks > 1").select("node", "shingles")
    if not large.isEmpty():
        own = links.join(large.select(F.col("node").alias("a")), "a", "left_semi")
        for step in ("firsts", "between"):
            known = components(own, scratch, f"{step}-known")
            named = large.join(known, "node", "left").select("node", "n", "cluster", F.coalesce("root", "node").alias("known"))
            named = scratch.write(named, f"{step}-named")
            if step == "firsts":  # one set of each component, in blocks
                one = named.where("node = known")
                blocks = one.groupBy("cluster").agg(F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)).alias("blocks"))
                one = one.join(blocks, "cluster").select("cluster", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("blocks")).alias("block"), "node", "known", F.lit(True).alias("indexed"))
                more = _links(one.join(large_sets, "node"), "cluster", "block")
            else:
                more = between_components(named, prefixes, large_sets, scratch)
            more = scratch.write(more, f"{step}-links")
            own, links = own.unionByName(more), links.unionByName(more)

    roots = components(links, scratch, "linked")
    joined = nodes.select("node", "digest", "doc_min", "docs").join(roots, "node", "left")
    joined = joined.select("digest", "docs", "doc_min", F.coalesce("root", "node").alias("root"))
    least = joined.groupBy("root").agg(F.min("doc_min").alias("component_id"), F.count("*").alias("size"), F.sum("docs").alias("all"))
    many_sets = joined.join(least.where("size > 1 or all > 1"), "root", "left_semi")
    placed = lookup(many_sets, least.where("size > 1 or all > 1").select("root", "component_id", "size"), ["root"], "size", nodes.count(), ["digest"])
    placed = scratch.write(placed.select("digest", "component_id", "docs"), "placed")
    out = lookup(sets, placed, ["digest"], "docs", sets.count(), ["node"])
    return out.select("doc_id", "text_hash", "node", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, whose doc_id is the smallest of their component.

    The other rows, which are few, are looked up by doc_id and a hash of the text."""
    gone = linked(docs).where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", F.col("text_hash").alias("row_mark")).distinct()
    return without(docs, Scratch(docs.sparkSession, "near").write(gone, "gone"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS shingle FROM w
), n AS MATERIALIZED (SELECT doc_id, count(shingle) AS n FROM documents LEFT JOIN s USING (doc_id) GROUP BY 1
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)
), r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
SELECT doc_id, n AS n_shingles, component_id FROM n JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1) USING (doc_id)
"""
