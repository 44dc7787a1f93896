"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

DataFrame functions only. A source's documents are placed by a hash, and equal ranges of
places are its blocks: a block is a random subset, and the block order a random
permutation. A source's target gives whole copies of all its blocks and a quota of one
further copy: the documents before a cut, which a search by digits of the place finds, but
for a few exchanges, each of the document whose words bring the quota nearest: one beyond
the cut is drawn too, or one before it is not.

The units (copy, block) are only numbers: of each source a quota of them. A binary tree
over the output shards splits the quotas: a node draws how many units of each source its
left half takes from the multivariate hypergeometric distribution, and the rest goes right,
so quotas are kept exactly. A leaf's counts are runs of the source's permuted units, so
shards hold disjoint blocks. Rows find their units by arithmetic, go to their shards, and
are shuffled there by a hash.

A source may hold any share of the rows: sums are partial aggregates by source and digit,
and rows meet one row a source. Tables of sources times shards are all that is planned.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, drop, let, stored, table

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
ROWS_PER_BLOCK = 1024
#: Fewest output shards, and rows drawn for which there is a further one.
SHARDS, ROWS_PER_SHARD = 8, 1 << 18
SEED = 20260408
#: Most exchanges at a cut, and the part of a target off which there is none.
EXCHANGES, NEAR = 8, 0.001
#: A place is DIGITS digits of BITS bits of a hash.
DIGITS, BITS = 5, 12
TOP = 1 << DIGITS * BITS
#: Standard deviations from the mode beyond which a draw has no weight in double precision; odd step of the permutation.
REACH, STEP = 12, (1 << 31) - 1


def size_of(text: str = "text") -> Column:
    """Words of the text; 0 of a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """sizes (source, source_size, ...) with the words each source is to give.

    Sources by code point, null last, take the weights in turn and share the total. With
    sources by rising cap per weight, those whose cap is under the level that the rest
    would share are capped, and the others share what is left by weight. `at` numbers the
    sources. This and the tree are tables of a row or an entry a source, whatever the rows.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("at", F.row_number().over(order) - 1).withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    rising = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    after = rising.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    levels = ranked.withColumn("level", left / F.sum("weight").over(after))
    capped = F.col("cap") / F.col("weight") < F.col("level")
    levels = levels.withColumn("open", F.first(F.when(~capped, F.col("level")), ignorenulls=True).over(rising.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.when(capped, F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("open"))
    return levels.withColumn("target", target).drop("level", "open", "cap")


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of `draws` of `total` units are among `good` ones, for a uniform u, by inversion.

    Weights follow from the mode by the ratios of neighbours; values are tried from the mode
    up and then down, so the walk ends where the weights have met the share u of their sum.
    """
    given = F.struct(*(c.cast("double").alias(n) for n, c in (("total", total), ("good", good), ("draws", draws), ("u", u))))

    def bounds(g: Column) -> Column:
        part = g["good"] / F.greatest(g["total"], F.lit(1.0))
        low, high = F.greatest(F.lit(0.0), g["draws"] - (g["total"] - g["good"])), F.least(g["draws"], g["good"])
        mode = F.least(high, F.greatest(low, F.floor((g["draws"] + 1) * (g["good"] + 1) / (g["total"] + 2)).cast("double")))
        spread = F.sqrt(g["draws"] * part * (1 - part) * (g["total"] - g["draws"]) / F.greatest(g["total"] - 1, F.lit(1.0)))
        reach = F.ceil(REACH * spread).cast("double") + REACH
        long_ = lambda c, n: c.cast("long").alias(n)
        return F.struct(g.alias("g"), long_(mode, "mode"), long_(F.greatest(low, mode - reach), "low"), long_(F.least(high, mode + reach), "high"))

    nothing = F.expr("cast(array() as array<bigint>)")

    def walk(b: Column, goal: Column) -> Column:
        g = b["g"]
        up = lambda x: (g["good"] - x) * (g["draws"] - x) / ((x + 1) * (g["total"] - g["good"] - g["draws"] + x + 1))
        down = lambda x: x * (g["total"] - g["good"] - g["draws"] + x) / ((g["good"] - x + 1) * (g["draws"] - x + 1))

        def step(ratio, by):
            def go(acc: Column, x: Column) -> Column:
                w = acc["w"] * ratio(x)
                found = F.coalesce(acc["found"], F.when(acc["sum"] + w >= goal, x + by))
                return F.struct(w.alias("w"), (acc["sum"] + w).alias("sum"), found.alias("found"))

            return go

        first = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"), F.when(goal <= 1, b["mode"]).alias("found"))
        above = F.when(b["high"] > b["mode"], F.sequence(b["mode"], b["high"] - 1)).otherwise(nothing)
        below = F.when(b["low"] < b["mode"], F.sequence(b["mode"], b["low"] + 1, F.lit(-1).cast("long"))).otherwise(nothing)
        half = F.aggregate(above, first, step(up, 1))
        return let(half, lambda h: F.aggregate(below, F.struct(F.lit(1.0).alias("w"), h["sum"].alias("sum"), h["found"].alias("found")), step(down, -1)))

    def drawn_of(b: Column) -> Column:
        all_ = walk(b, F.lit(float("inf")))["sum"]
        return let(all_, lambda s: F.coalesce(walk(b, b["g"]["u"] * s)["found"], b["mode"]))

    return let(given, lambda g: let(bounds(g), drawn_of))


def uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def left_half(counts: Column, share: Column, *key: Column) -> Column:
    """Of units by source, how many of each are among `share` drawn ones: draws in turn, each given those before."""
    every = F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c)
    first = F.struct(every.alias("rest"), share.alias("draws"), F.lit(0).alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        x = hypergeometric(acc["rest"], c, acc["draws"], uniform(*key, acc["at"]))
        return let(x, lambda n: F.struct((acc["rest"] - c).alias("rest"), (acc["draws"] - n).alias("draws"), (acc["at"] + 1).alias("at"), F.concat(acc["out"], F.array(n)).alias("out")))

    return F.aggregate(counts, first, step, lambda acc: acc["out"])


def split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, counts) of one row (counts array<long>): each node hands its left shards their exact share of its units."""
    tree = quotas.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "counts")
    for level in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        every = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)
        share = F.ceil(every * (F.col("middle") - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("long")
        tree = tree.withColumn("middle", middle).withColumn("left", left_half(F.col("counts"), share, F.lit(seed), F.lit(level), F.col("lo")))
        node = lambda lo, hi, counts: F.struct(lo.alias("lo"), hi.alias("hi"), counts.alias("counts"))
        right = F.zip_with("counts", "left", lambda c, x: c - x)
        both = F.array(node(F.col("lo"), F.col("middle"), F.col("left")), node(F.col("middle"), F.col("hi"), right))
        same = F.array(node(F.col("lo"), F.col("hi"), F.col("counts")))
        tree = tree.select(F.explode(F.when(F.col("hi") - F.col("lo") > 1, both).otherwise(same)).alias("n")).select("n.*")
    return tree.select(F.col("lo").alias("shard"), "counts")


def place_of(seed: int) -> Column:
    """A document's place among those of its source: by its id and text, so reruns agree and only equal rows share it."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text")), 64 - DIGITS * BITS)


def block_of(place: Column, n_blocks: Column) -> Column:
    return F.least(F.floor(place.cast("double") / float(TOP) * n_blocks), n_blocks - 1)


def by_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows and the columns of their source's row."""
    others = [f"s.{c}" for c in sources.columns if c != "source"]
    return rows.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", *others)


def cuts(spark: SparkSession, sized: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, cut, swaps): documents before cut, but at the swapped places those on its other side, have about the words `rest`.

    Each round looks at one more digit of the places, in sums by source and digit, and goes on
    inside the digit in which the words are reached, until that holds one document a source.
    """
    state = sources.select("source", F.col("rest").alias("missing"), F.lit(0).cast("long").alias("cut"), F.lit(False).alias("all"))
    path = None
    for digit in range(DIGITS):
        shift = (DIGITS - 1 - digit) * BITS
        inside = by_source(sized.select("source", "place", "size"), state).where(~F.col("all") & (F.shiftright("place", shift + BITS) == F.shiftright("cut", shift + BITS)))
        sums = inside.groupBy("source", F.shiftright("place", shift).bitwiseAND(F.lit((1 << BITS) - 1)).alias("digit")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
        before = F.sum("words").over(W.partitionBy("source").orderBy("digit"))
        reached = by_source(sums.withColumn("end", before), state.select("source", "missing")).where(F.col("end") > F.col("missing"))
        first = reached.groupBy("source").agg(F.min_by(F.struct("digit", (F.col("end") - F.col("words")).alias("start"), "rows"), "digit").alias("x"))
        met = state.alias("s").join(first.alias("f"), F.col("s.source").eqNullSafe(F.col("f.source")), "left")
        cut = F.col("s.cut") + F.coalesce(F.shiftleft(F.col("f.x.digit").cast("long"), shift), F.lit(0))
        new = met.select("s.source", (F.col("s.missing") - F.coalesce("f.x.start", F.lit(0))).alias("missing"), cut.alias("cut"), (F.col("s.all") | F.col("f.x").isNull()).alias("all"), F.coalesce("f.x.rows", F.lit(0)).alias("rows"))
        new, new_path = stored(spark, new, "cuts")
        if path:
            drop(spark, path)
        state, path = new.drop("rows"), new_path
        if new.where("rows > 1").isEmpty():
            break
    # Words that no digit reaches are those of all documents.
    state = state.withColumn("cut", F.when(F.col("all"), F.lit(TOP)).otherwise(F.col("cut")))
    state = state.withColumn("swaps", F.expr("cast(array() as array<bigint>)")).withColumn("open", F.lit(True))
    near = by_source(state, sources.select("source", (F.col("target") * NEAR).alias("near")))
    for _ in range(EXCHANGES):
        gain = F.when(F.col("place") < F.col("cut"), -F.col("size")).otherwise(F.col("size"))
        off = F.abs(F.col("missing") - gain)
        every = by_source(sized.select("source", "place", "size"), near.where("open and abs(missing) > near"))
        better = every.where((off < F.abs("missing")) & ~F.array_contains("swaps", F.col("place")))
        best = better.groupBy("source").agg(F.min_by(F.struct("place", gain.alias("gain")), F.struct(off, "place")).alias("x"))
        met = near.alias("s").join(best.alias("f"), F.col("s.source").eqNullSafe(F.col("f.source")), "left")
        some = F.col("f.x").isNotNull()
        new = met.select("s.source", (F.col("s.missing") - F.coalesce("f.x.gain", F.lit(0))).alias("missing"), "s.cut", F.when(some, F.concat("s.swaps", F.array("f.x.place"))).otherwise(F.col("s.swaps")).alias("swaps"), some.alias("open"), "s.near")
        near, new_path = stored(spark, new, "cuts")
        drop(spark, path)
        path = new_path
        if near.where("open").isEmpty():
            break
    return near.select("source", "cut", "swaps")


@dataclass
class Plan:
    """sources: a row a source with totals, target, copies, cut and the ends of the shards' runs of its units."""

    sources: DataFrame
    shards: int
    seed: int


def plan(spark: SparkSession, docs: DataFrame, shards: int | None = None, rows_per_block: int = ROWS_PER_BLOCK, seed: int = SEED) -> tuple[Plan, DataFrame]:
    """The draws for docs (doc_id, source, text), and docs as (row, doc_id, source, place, size)."""
    sized = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", place_of(seed).alias("place"), size_of().alias("size"))
    sized, _ = stored(spark, sized, "sizes")
    totals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    totals = totals.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    totals, _ = stored(spark, totals.withColumn("n_blocks", F.ceil(F.col("rows") / rows_per_block)), "sources")
    if shards is None:
        shares = totals.where("source_size > 0").agg(F.sum(F.col("rows") * F.col("target") / F.col("source_size"))).first()[0]
        shards = max(SHARDS, math.ceil((shares or 0) / ROWS_PER_SHARD))

    last = block_of(F.col("cut"), F.col("n_blocks"))
    part = F.when((F.col("cut") > 0) | (F.size("swaps") > 0), last + 1).otherwise(0)
    units = by_source(totals, cuts(spark, sized, totals)).withColumn("last", last).withColumn("quota", (F.col("whole") * F.col("n_blocks") + part).cast("long"))
    units, _ = stored(spark, units, "quotas")
    counts = F.transform(F.array_sort(F.collect_list(F.struct("at", "quota"))), lambda x: x["quota"])
    leaves = split_tree(units.agg(counts.alias("counts")), shards, seed).select("shard", F.posexplode("counts").alias("at", "n"))
    end = F.sum("n").over(W.partitionBy("at").orderBy("shard"))
    runs = leaves.withColumn("end", end).groupBy("at").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "end"))), lambda x: x["end"]).alias("ends"))
    sources, _ = stored(spark, units.join(runs, "at"), "draws")
    return Plan(sources.select("source", "source_size", "target", "whole", "n_blocks", "cut", "swaps", "last", "quota", "ends"), shards, seed), sized


def drawn(rows: DataFrame, made: Plan) -> DataFrame:
    """rows (source, place, ...) with source_size, target and the units (copy, shard) that draw the row."""
    names = rows.columns
    met = by_source(rows, made.sources)
    block = block_of(F.col("place"), F.col("n_blocks"))
    further = (F.col("place") < F.col("cut")) != F.array_contains("swaps", F.col("place"))
    copies = F.col("whole") + further.cast("int")
    # Blocks of the last copy end with that of the cut, which also has the documents beyond it.
    number = lambda c: (c * F.col("n_blocks") + F.when(c < F.col("whole"), block).otherwise(F.least(block, F.col("last")))).cast("long")
    permuted = lambda c: F.pmod(number(c) * STEP + F.lit(made.seed), F.col("quota"))
    shard = lambda c: let(permuted(c), lambda p: F.size(F.filter("ends", lambda e: e <= p)))
    units = F.when(copies > 0, F.transform(F.sequence(F.lit(0), copies - 1), lambda c: F.struct(c.alias("copy"), shard(c).alias("shard"))))
    return met.select(*names, "source_size", "target", F.coalesce(units, F.expr("cast(array() as array<struct<copy:int,shard:int>>)")).alias("units"))


def dealt(rows: DataFrame, made: Plan) -> DataFrame:
    """rows (source, place, ...) once for each unit, with its shard and copy: each in its shard, in an order by hash."""
    names = rows.columns
    out = drawn(rows, made).select(*names, F.explode("units").alias("u")).select(*names, "u.shard", "u.copy")
    out = out.repartitionById(made.shards, F.col("shard"))
    return out.sortWithinPartitions("shard", F.xxhash64(F.lit(made.seed + 1), "place", "copy"), "place", "copy")


def mix(spark: SparkSession, docs: DataFrame, shards: int | None = None, rows_per_block: int = ROWS_PER_BLOCK, seed: int = SEED) -> DataFrame:
    """The mixed rows: the columns of docs, and the shard and copy of each drawn row, shuffled inside shards.

    A null source is a source, a null text has no words; rows of one id and text are drawn
    alike. Sources without words give nothing, and an empty table gives no rows. Columns
    shard and copy that docs has are replaced.
    """
    made, _ = plan(spark, docs, shards, rows_per_block, seed)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("source"), place_of(seed).alias("place"))
    names = [F.col(f"doc.{c}") for c in docs.columns if c not in ("shard", "copy")]
    return dealt(rows, made).select(*names, "shard", "copy")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mixed rows hold of each document: rows are dealt to shards without their texts, and counted back."""
    made, sized = plan(spark, table(spark, sf_dir, "documents"))
    mixed_rows = dealt(sized.select("row", "source", "place", "size"), made)
    taken = mixed_rows.groupBy("row").agg(F.sum("size").alias("taken"), F.array_sort(F.collect_list("shard")).alias("shards"))
    found = by_source(sized, made.sources.select("source", "source_size", "target")).join(taken, "row", "left")
    return found.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "shards")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mixed rows in their shards and order, a document as often as it is drawn.

    Columns stay as they are, whatever their names. Nulls, repeats and empty tables are as in
    `mix`: a null text has no words, equal rows are drawn alike, no rows give none.
    """
    made, _ = plan(spark, docs)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("source"), place_of(made.seed).alias("place"))
    return dealt(rows, made).select("doc.*")
