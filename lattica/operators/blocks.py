"""Sparse volumes: blocks of 8 x 8 x 8 values, of which only the active ones are kept.

A block is one row: its place (bi, bj, bk), a bit mask of eight longs, one for each layer in k with bit 8 j + i,
and the active values in the order of their bits. Everything else has the background's value, so a
volume costs what is active in it. A probe joins samples with the one to eight blocks that their corners are
in, whose contributions are summed; what no block has is background.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import ImageGrid

SIDE, LAYERS = 8, 8
PLACE = ["bi", "bj", "bk"]


def _place(ijk: list[Column]) -> list[Column]:
    return [F.floor(c / SIDE).alias(b) for c, b in zip(ijk, PLACE, strict=True)]


def _bit(ijk: list[Column]) -> tuple[Column, Column]:
    """(layer, bit in it) of a node."""
    i, j, k = (F.pmod(c, F.lit(SIDE)) for c in ijk)
    return k.cast("int"), (j * SIDE + i).cast("int")


def to_blocks(nodes: DataFrame, background: float = 0.0) -> DataFrame:
    """Blocks (bi, bj, bk, mask, values) of nodes (i, j, k, value); the background's value and nulls are not active."""
    ijk = [F.col(c).cast("long") for c in "ijk"]
    layer, bit = _bit(ijk)
    some = nodes.where(F.col("value").isNotNull() & (F.col("value") != F.lit(float(background)))).select(*_place(ijk), layer.alias("layer"), bit.alias("bit"), F.col("value").cast("double").alias("value"))
    one = F.expr("shiftleft(1L, bit)")
    masks = [F.coalesce(F.bit_or(F.when(F.col("layer") == n, one)), F.lit(0).cast("long")) for n in range(LAYERS)]
    held = F.sort_array(F.collect_list(F.struct((F.col("layer") * SIDE * SIDE + F.col("bit")).alias("at"), "value")))
    return some.groupBy(*PLACE).agg(F.array(*masks).alias("mask"), F.transform(held, lambda x: x["value"]).alias("values"))


def to_nodes(blocks: DataFrame) -> DataFrame:
    """The active nodes (i, j, k, value) of blocks."""
    numbers = F.sequence(F.lit(0), F.lit(SIDE**3 - 1))
    on = F.filter(numbers, lambda n: F.getbit(F.get("mask", F.floor(n / (SIDE * SIDE)).cast("int")), (n % (SIDE * SIDE)).cast("int")) == 1)
    flat = blocks.select(*PLACE, F.explode(F.arrays_zip(on.alias("at"), F.col("values").alias("value"))).alias("v")).select(*PLACE, "v.at", "v.value")
    place = [F.col("bi") * SIDE + F.col("at") % SIDE, F.col("bj") * SIDE + F.floor(F.col("at") / SIDE) % SIDE, F.col("bk") * SIDE + F.floor(F.col("at") / (SIDE * SIDE))]
    return flat.select(*[p.cast("long").alias(c) for p, c in zip(place, "ijk", strict=True)], "value")


def probe(samples: DataFrame, key: str, blocks: DataFrame, grid: ImageGrid, background: float = 0.0) -> DataFrame:
    """Samples with the value interpolated between the eight nodes around them; grid gives origin and spacing only."""
    at = [(F.col(a) - F.lit(o)) / F.lit(s) for a, o, s in zip("xyz", grid.origin, grid.spacing, strict=True)]
    base = samples.select(key, *[F.floor(c).alias(f"_{n}") for c, n in zip(at, "ijk", strict=True)], *[(c - F.floor(c)).alias(f"_f{n}") for c, n in zip(at, "ijk", strict=True)])
    corners = [(a, b, c) for c in (0, 1) for b in (0, 1) for a in (0, 1)]
    place = F.array_distinct(F.array(*[F.struct(*_place([F.col(f"_{n}") + d for n, d in zip("ijk", step, strict=True)])) for step in corners]))
    spread = base.withColumn("_b", F.explode(place)).select(key, "_i", "_j", "_k", "_fi", "_fj", "_fk", "_b.*")
    met = spread.join(blocks, PLACE)
    weights, sums = [], []
    for step in corners:
        ijk = [F.col(f"_{n}") + d for n, d in zip("ijk", step, strict=True)]
        here = F.lit(True)
        for own, b in zip(_place(ijk), PLACE, strict=True):
            here &= own == F.col(b)
        layer, bit = _bit(ijk)
        word = F.get("mask", layer)
        active = here & (F.getbit(word, bit) == 1)
        # Bits below: the word shifted so that they alone are left; a shift by 64 would be none.
        lower = F.when(bit == 0, F.lit(0)).otherwise(F.bit_count(F.call_function("shiftleft", word, 64 - bit)))
        earlier = F.aggregate(F.slice("mask", F.lit(1), layer), F.lit(0), lambda n, w: n + F.bit_count(w))
        weight = F.lit(1.0)
        for n, d in zip("ijk", step, strict=True):
            weight *= F.col(f"_f{n}") if d else 1 - F.col(f"_f{n}")
        weights.append(F.when(active, weight).otherwise(0.0))
        sums.append(F.when(active, weight * F.get("values", (earlier + lower).cast("int"))).otherwise(0.0))
    found = met.groupBy(key).agg(F.sum(sum(weights[1:], weights[0])).alias("_w"), F.sum(sum(sums[1:], sums[0])).alias("_s"))
    value = F.coalesce("_s", F.lit(0.0)) + (1 - F.coalesce("_w", F.lit(0.0))) * F.lit(float(background))
    return samples.join(found, key, "left").select(*samples.columns, value.alias("value"))
