"""Personal data: base patterns, and contextual extraction bootstrapped from them.

Four base patterns give spans. Their spans are the seed entities. Candidates are tokens
with two digits, an at sign or a plus sign before a digit, with the digit groups that
follow after single blanks, of any length. A candidate that a base span touches is
trusted; one that has the form of a card, phone or address but fails its test is
refuted; the others are undecided.

A candidate's neighbours form its lexical patterns, in two views. The left view has the
word before it, the word before that (a skip), both, and the word with the candidate's
shape; the right view likewise. Words are in lower case with digits folded; what is
between two candidates belongs to both. Patterns and candidate values are a bipartite
graph, scored in rounds. A pattern's score is the share of trusted values among its
decided ones; undecided ones count a quarter, and few values are shrunk towards the
share in the whole graph, so where most numbers identify nobody nothing is found. An
undecided value is worth the mean score of its patterns in the other view. A pattern of
two words, or a word and a shape, is reliable if its values are worth RELIABLE on average
and there are MIN_INSTANCES of them. Reliable patterns make their undecided values
trusted, which changes the scores of all their other patterns, until a round finds none.
Every occurrence of a value so found becomes a span, of its pattern's kind: the one that
most of its values have, else ``id``.

The patterns are matched possessively, or from a run's first character, so that one
pass takes time linear in the text. Matches are found by ``regexp_extract_all``; where
they are follows from sums over the lengths of what ``split`` leaves between them.

Only DataFrame functions run here. Defined results: a null text is empty and has no
spans; repeated rows each get the spans and count once in the graph; a null doc_id is
allowed; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NOT_WS, Scratch, documents, lookup, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Kind of what is found by patterns of no base kind.
OTHER = "id"
#: A match begins at a run's first character or where the match before it ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold before a pattern is tried.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: White space (all but it is \S) and digits, one by one: Java tests a class of single characters by a table, ranges call by
#: call, which is slower still in the tasks of one JVM beside each other.
_WS, _DIGITS = r"\x20\x09\x0A\x0B\x0C\x0D", "0123456789"
#: What one of a candidate's forms needs, so that most words are passed over once and not for each form.
_RARE = rf"(?=[^{_WS}{_DIGITS}@(+]*+[{_DIGITS}@(+])"
_FORMS = (rf"(?=(?:[^{_WS}{_DIGITS}]*+[0-9]){{2}})", rf"(?=[^{_WS}@]*+@)", rf"(?=[^{_WS}(]*+\(at\))", r"(?=\+[0-9])")
CANDIDATE = rf"(?<!\S){_RARE}(?:{'|'.join(_FORMS)})\S++(?:\x20(?=[^{_WS}{_DIGITS}A-Za-z]*+[0-9])[^{_WS}A-Za-z]++(?!\S))*+"
#: Forms of which a base pattern is the test, ten digits at least for cards and phones.
REFUTABLE = r"^[0-9+][0-9 ().+-]*$"

LEAST_CHARS, MIN_INSTANCES, RELIABLE = 6, 5, 0.6
#: Weight of an undecided value against a refuted one, and of the whole graph's share against values.
UNDECIDED, SHRINK = 0.25, 2.0
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn's check of a string of digits."""
    backwards = F.transform(F.split(F.reverse(digits), ""), lambda c: F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0)))
    doubled = F.transform(backwards, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255")
        return F.forall(F.split(match, r"\."), small)
    if kind == "card":
        digits = _digits(match)
        return F.when((F.length(match) <= 40) & F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


def _words(gap: Column, forward: bool) -> list[Column]:
    """The two words of a gap next to the match before it (forward) or after it; empty if there are none."""
    side = gap if forward else F.reverse(gap)
    found = [F.regexp_extract(side, rf"^[\x20\x09-\x0D]++({NOT_WS}++)", 1), F.regexp_extract(side, rf"^[\x20\x09-\x0D]++{NOT_WS}++[\x20\x09-\x0D]++({NOT_WS}++)", 1)]
    return found if forward else [F.reverse(w) for w in found]


def _folded(word: Column) -> Column:
    """A word in lower case, digits as 0, without what is around its letters if it has any."""
    low = F.regexp_replace(F.lower(word), "[0-9]", "0")
    bare = F.reverse(F.regexp_replace(F.reverse(F.regexp_replace(low, r"^[^\p{L}\p{N}]++", "")), r"^[^\p{L}\p{N}]++", ""))
    return F.when(bare != "", bare).otherwise(low)


def matches(docs: DataFrame) -> DataFrame:
    """row, doc_id and hits: matches of all patterns with what is between them, in order.

    A hit has kind (-1: candidate), pos, gap (characters before it), match (null after
    the last one) and, of candidates, the words of the gap: l1, l2 nearest to its end, r1,
    r2 nearest to its begin."""
    body = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), text_or_empty().alias("text"))
    every = {**PATTERNS, "candidate": CANDIDATE}
    for name, pattern in every.items():
        hits = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        need = NEEDS.get(name)
        body = body.withColumn(f"m_{name}", F.when(F.contains("text", F.lit(need)), hits) if need else hits)
    nothing = [F.lit(None).cast("string")] * 4

    def hit(kind, found):
        def made(gap, pos):
            words = nothing if kind >= 0 else [*_words(gap, False), *_words(gap, True)]
            return F.struct(F.lit(kind).alias("kind"), pos.alias("pos"), F.char_length(gap).alias("gap"), F.get(found, pos).alias("match"), *[w.alias(c) for w, c in zip(words, ("l1", "l2", "r1", "r2"), strict=True)])

        return made

    parts = []
    for i, (name, pattern) in enumerate(every.items()):
        found = F.col(f"m_{name}")
        parts.append(F.when(F.size(found) > 0, F.transform(F.split("text", pattern, -1), hit(i if name in KINDS else -1, found))).otherwise(F.array()))
    return body.select("row", "doc_id", F.concat(*parts).alias("hits"))


def located(found: DataFrame) -> DataFrame:
    """row, kind, start, end of all base spans and candidates; of candidates also value, words
    and state: 1 touched by a base span (of base_kind), 0 refuted, null undecided."""
    hits = found.where(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", "h.*").repartition("row")
    along = W.partitionBy("row", "kind").orderBy("pos")
    end = F.sum(F.col("gap") + F.coalesce(F.char_length("match"), F.lit(0))).over(along.rowsBetween(W.unboundedPreceding, 0))
    hits = hits.withColumn("end", end.cast("int")).withColumn("next", F.lead(F.struct("r1", "r2")).over(along)).where("match is not null")
    test = reduce(lambda out, i: out.when(F.col("kind") == i, _valid(KINDS[i], F.col("match"))), range(1, len(KINDS)), F.when(F.col("kind") == 0, _valid(KINDS[0], F.col("match")))).otherwise(True)
    hits = hits.where(test).withColumn("start", F.col("end") - F.char_length("match"))
    # A candidate's value is without what surrounds its letters, digits and leading plus sign.
    lead = F.when(F.col("kind") < 0, F.regexp_replace("match", r"^[^\p{L}\p{N}+]++", "")).otherwise(F.col("match"))
    value = F.when(F.col("kind") < 0, F.reverse(F.regexp_replace(F.reverse("lead"), r"^[^\p{L}\p{N}]++", ""))).otherwise(F.col("lead"))
    hits = hits.withColumn("lead", lead).withColumn("value", value).withColumn("start", F.col("end") - F.char_length("lead")).withColumn("end", F.col("start") + F.char_length("value"))
    hits = hits.where((F.col("kind") >= 0) | (F.char_length("value") >= LEAST_CHARS))
    # The base span that reaches farthest of those that begin before, and the next to begin.
    is_base = F.col("kind") >= 0
    in_text = W.partitionBy("row").orderBy("start")
    before = F.max(F.when(is_base, F.struct("end", "kind"))).over(in_text.rangeBetween(W.unboundedPreceding, 0))
    after = F.min(F.when(is_base, F.struct("start", "kind"))).over(in_text.rangeBetween(0, W.unboundedFollowing))
    hits = hits.withColumn("before", before).withColumn("after", after)
    touched = F.when(F.col("before.end") > F.col("start"), F.col("before.kind")).when(F.col("after.start") < F.col("end"), F.col("after.kind"))
    dotted = F.col("value").rlike(r"^[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++$")
    refuted = dotted | (F.col("value").rlike(REFUTABLE) & (F.length(_digits(F.col("value"))) >= 10))
    state = F.when(touched.isNotNull(), 1).when(refuted, 0)
    return hits.select("row", "kind", "start", "end", "value", "l1", "l2", "next.r1", "next.r2", F.when(~is_base, state).alias("state"), F.when(~is_base, touched).alias("base_kind"))


def lexical_patterns(candidates: DataFrame) -> DataFrame:
    """v, pattern, view (0 left, 1 right) and specific, once each. The candidate is written as _."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[0-9]", "0"), r"\p{L}", "a"), r"(.)\1++", "$1")
    words = candidates.select("v", shape.alias("shape"), *[_folded(F.coalesce(c, F.lit(""))).alias(c) for c in ("l1", "l2", "r1", "r2")])
    made = []
    for view, near, far in ((0, "l1", "l2"), (1, "r1", "r2")):
        side = lambda *parts, view=view: F.concat_ws(" ", *(parts if view == 0 else reversed(parts)))
        one, two, slot = F.col(near), F.col(far), F.lit("_")
        made += [(view, False, side(one, slot), one), (view, False, side(two, F.lit("*"), slot), two), (view, True, side(two, one, slot), two), (view, True, side(one, F.concat(F.lit("_"), F.col("shape"))), one)]
    structs = [F.when(needed != "", F.struct(F.lit(view).alias("view"), F.lit(specific).alias("specific"), text.alias("pattern"))) for view, specific, text, needed in made]
    return words.select("v", F.explode(F.array_compact(F.array(*structs))).alias("p")).select("v", "p.*").distinct()


def bootstrap(edges: DataFrame, values: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(v and kind of the values found, reliable patterns with kind and score).

    edges: v, view, specific, pattern; values: v, trust (1, 0 or null), kind. Hot values and
    hot patterns meet through ``lookup``; every score is a sum over all its edges."""
    uses = edges.groupBy("v").agg(F.count("*").alias("edges"))
    values = scratch.write(values.join(uses, "v"), "values-0")
    total, share = edges.count(), None
    parts = values.agg(F.count(F.when(F.col("trust") == 1, 1)), F.count(F.when(F.col("trust") == 0, 1)), F.count(F.when(F.col("trust").isNull(), 1))).first()
    share = parts[0] / max(1.0, parts[0] + parts[1] + UNDECIDED * parts[2])
    patterns = found = None
    for k in count(1):
        now = scratch.write(lookup(edges, values, ["v"], "edges", total, ["pattern"]), f"edges-{k}")
        n = lambda c: F.count(F.when(c, 1))
        good, bad, unsure = n(F.col("trust") == 1), n(F.col("trust") == 0), n(F.col("trust").isNull())
        score = (good + SHRINK * share) / (good + bad + UNDECIDED * unsure + SHRINK)
        scores = scratch.write(now.groupBy("pattern").agg(score.alias("score"), F.count("*").alias("n")), f"scores-{k}")
        told = lookup(now.select("v", "view", "pattern"), scores, ["pattern"], "n", total, ["v"])
        worth = told.groupBy("v").agg(F.avg(F.when(F.col("view") == 1, F.col("score"))).alias("right"), F.avg(F.when(F.col("view") == 0, F.col("score"))).alias("left"), F.count("*").alias("n"))
        worth = scratch.write(worth, f"worth-{k}")
        judged = lookup(now.where("specific"), worth.withColumnRenamed("n", "edges_of"), ["v"], "edges_of", total, ["pattern"])
        other = F.when(F.col("view") == 0, F.col("right")).otherwise(F.col("left"))
        of_kind = [n(F.col("kind") == i).alias(f"k{i}") for i in range(len(KINDS))]
        mean = (F.sum(F.coalesce(F.col("trust").cast("double"), other, F.lit(share))) + SHRINK * share) / (F.count("*") + SHRINK)
        able = judged.groupBy("pattern").agg(mean.alias("score"), F.count("*").alias("n"), unsure.alias("open"), *of_kind)
        able = able.where((F.col("n") >= MIN_INSTANCES) & (F.col("score") >= RELIABLE) & (F.col("open") > 0))
        kind = reduce(lambda out, i: out.when(2 * F.col(f"k{i}") >= F.col("n"), i), range(1, len(KINDS)), F.when(2 * F.col("k0") >= F.col("n"), 0)).otherwise(len(KINDS))
        able = scratch.write(able.select("pattern", "score", "n", kind.alias("pattern_kind")), f"patterns-{k}")
        patterns = able if patterns is None else patterns.unionByName(able)
        if able.isEmpty():
            break
        hit = lookup(now.where("specific and trust is null").select("v", "pattern"), able, ["pattern"], "n", total, ["v"]).where("score is not null")
        new = scratch.write(hit.groupBy("v").agg(F.max(F.struct("score", "pattern_kind")).alias("best")).select("v", F.col("best.pattern_kind").alias("new_kind")), f"new-{k}")
        found = new if found is None else found.unionByName(new)
        values = values.join(new, "v", "left").select("v", F.when(F.col("new_kind").isNotNull(), 1).otherwise(F.col("trust")).alias("trust"), F.coalesce("new_kind", "kind").alias("kind"), "edges")
        values = scratch.write(values, f"values-{k}")
    if found is None:
        found = values.where("false").select("v", F.col("kind").alias("new_kind"))
    return found.withColumnRenamed("new_kind", "kind"), patterns.select("pattern", F.col("pattern_kind").alias("kind"), "score")


def find_pii(docs: DataFrame) -> DataFrame:
    """Each row with its base spans and all spans, sorted by start."""
    scratch = Scratch(docs.sparkSession, "pii")
    rows = scratch.write(matches(docs), "matches")
    spans = scratch.write(located(rows).withColumn("v", F.xxhash64("value")), "spans")
    candidates = spans.where("kind < 0")
    edges = scratch.write(lexical_patterns(candidates), "edges")
    values = candidates.groupBy("v").agg(F.max("state").alias("trust"), F.min("base_kind").alias("kind"))
    found, _ = bootstrap(edges, values, scratch)
    open_ = candidates.where("state is null").select("row", "start", "end", "v")
    known = scratch.write(found.join(open_.groupBy("v").agg(F.count("*").alias("uses")), "v"), "known")
    added = lookup(open_, known, ["v"], "uses", max(1, open_.count()), ["row", "start"]).where("uses is not null")
    span = F.struct("start", "kind", "end").alias("span")
    base = spans.where("kind >= 0").select("row", F.lit(True).alias("base"), span)
    every = base.unionByName(added.select("row", F.lit(False).alias("base"), span))
    by_row = every.groupBy("row").agg(F.array_sort(F.collect_list(F.when(F.col("base"), F.col("span")))).alias("base"), F.array_sort(F.collect_list("span")).alias("spans"))
    out = rows.select("row", "doc_id").join(by_row, "row", "left")
    return out.select("doc_id", *[F.coalesce(c, F.array().cast(SPAN)).alias(c) for c in ("base", "spans")])


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = [*KINDS, OTHER]
    name = lambda k: reduce(lambda out, i: out.when(k == i, names[i]), range(1, len(names)), F.when(k == 0, names[0]))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(documents(spark, sf_dir))
    of = lambda i: lambda x: x["kind"] == i
    counts = [F.size(F.filter("base", of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    n_added = (F.size("spans") - F.size("base")).cast("long").alias("n_added")
    return out.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), n_added)


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the operator's result SQL can express."""
    return op4_pii(spark, sf_dir).drop("spans", "n_added")


BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (
  SELECT doc_id, 0 AS kind, 'email' AS name, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS hits, regexp_split_to_array(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS gaps FROM d
  UNION ALL SELECT doc_id, 1, 'ip', regexp_extract_all(text, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), regexp_split_to_array(text, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') FROM d
  UNION ALL SELECT doc_id, 2, 'card', regexp_extract_all(text, '[0-9](?:[\x20-]?[0-9])+'), regexp_split_to_array(text, '[0-9](?:[\x20-]?[0-9])+') FROM d
  UNION ALL SELECT doc_id, 3, 'phone', regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), regexp_split_to_array(text, '\+[0-9][\x20().0-9-]+[0-9]') FROM d
), x AS (SELECT *, unnest(range(1, len(hits) + 1)) AS n FROM m WHERE len(hits) > 0
), s AS (
  SELECT doc_id, kind, name, hits[n] AS hit, regexp_replace(hits[n], '[^0-9]', '', 'g') AS digits,
    CAST(list_sum(list_transform(gaps[1:n], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:n - 1], lambda h: length(h))), 0) AS BIGINT) AS pos FROM x
), v AS (
  SELECT *, CASE kind WHEN 0 THEN true
    WHEN 1 THEN list_bool_and(list_transform(string_split(hit, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND CAST(right('00' || ltrim(p, '0'), 3) AS INT) <= 255))
    WHEN 2 THEN length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse(digits)[i] AS INT) WHEN CAST(reverse(digits)[i] AS INT) > 4 THEN 2 * CAST(reverse(digits)[i] AS INT) - 9 ELSE 2 * CAST(reverse(digits)[i] AS INT) END)) % 10 = 0
    ELSE length(digits) BETWEEN 10 AND 15 END AS ok FROM s
), g AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_email, count(*) FILTER (WHERE kind = 1) AS n_ip, count(*) FILTER (WHERE kind = 2) AS n_card, count(*) FILTER (WHERE kind = 3) AS n_phone,
    string_agg(name || ':' || pos || ':' || (pos + length(hit)), ',' ORDER BY pos, kind) AS spans FROM v WHERE ok GROUP BY 1
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(spans, '')) AS base_sha256 FROM documents LEFT JOIN g USING (doc_id)
"""
