"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, in a shuffled order, are laid on a line of words and cut into blocks of equal
size. Slots of the mix are points of the golden-ratio sequence; a point falls into one source's share
of the cumulative weights, so that any stretch of slots holds the sources in their proportions. The
r-th slot of a source takes the r-th block of its line, and begins again after the last. Slots that a
source has beyond its aim are left out, and those that it lacks follow the last slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataforge.storage import keep

#: No source is taken more often than this.
MOST = 3
WEIGHTS = (1, 2, 3)
#: Slots of the schedule aimed at, as long as blocks don't get longer than LONGEST words; they do where there would be over MOST_SLOTS.
SLOTS, LONGEST, MOST_SLOTS = 1 << 19, 1024, 1 << 31
#: Each source has blocks enough that its target takes so many of them, as far as it has words.
LEAST = 64
#: The golden ratio's fraction of a circle of 2**62 points, in two halves of 31 bits: the points stay golden over 2**60 slots.
STEP, HALF = 2850178704830799621, 1 << 31
#: Parts of a slot that shares of the circle are told apart by.
FINE = 1 << 20
#: Parts of a source's shuffled line that are summed apart, so that no task holds a whole source.
PARTS = 1024


def _size(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")


def running(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """rows with the sums (of longs) over all rows up to each in some order, itself included; no task has them all.

    Rows are dealt out by ranges of the first column of the order and written; only one row a range is brought together.
    """
    dealt = keep(rows.withColumns({f"_{k}": v for k, v in sums.items()}).repartitionByRange(order[0]).withColumn("_range", F.spark_partition_id()), "ranges")
    ranges = dealt.groupBy("_range").agg(*(F.sum(f"_{k}").alias(f"_all_{k}") for k in sums))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = keep(ranges.select("_range", *(F.coalesce(F.sum(f"_all_{k}").over(before), F.lit(0)).alias(f"_base_{k}") for k in sums)), "bases")
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    told = dealt.join(base, "_range").withColumns({k: F.col(f"_base_{k}") + F.sum(f"_{k}").over(inside) for k in sums})
    return told.drop("_range", *(f"{x}_{k}" for k in sums for x in ("", "_base")))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, size) to (source, source_size, target): one row for each source.

    Sources by code point, null last, weigh WEIGHTS in turn and share all words; targets stop at MOST
    times the source's words and the rest goes to the others by weight. Sources are ranked by ranges: there
    may be as many as there are hosts.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running(by_source, [F.col("source").asc_nulls_last()], rank=F.lit(1).cast("long"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    weighed = ranked.withColumn("weight", weight.cast("long")).drop("rank").withColumn("most", MOST * F.col("source_size")).withColumn("fill", F.col("most") / F.col("weight"))
    # sources that fill first come first: those up to here have all they can, the rest share what is left by weight
    filled = keep(running(weighed, [F.col("fill"), F.col("source").asc_nulls_last()], held=F.col("most"), passed=F.col("weight")), "filled")
    every = filled.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    left = F.lit(every["words"] or 0) - (F.col("held") - F.col("most"))
    share = left / (F.lit(every["weight"] or 0) - (F.col("passed") - F.col("weight")))
    level = filled.withColumn("share", share.cast("double")).withColumn("full", F.col("share") * F.col("weight") >= F.col("most"))
    # the first source that isn't full sets the level of all after it; counted on as if full, those only have lower shares
    common = level.agg(F.max(F.when(~F.col("full"), F.col("share")))).first()[0] or 0.0
    return level.select("source", "source_size", F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.lit(common) * F.col("weight")).alias("target"))


def _place(slot: Column) -> Column:
    """slot * STEP on the circle of HALF**2 points, for slots below HALF. Whole numbers only, none over 2**63."""
    high = slot * (STEP // HALF) % HALF * HALF
    return (high + slot * (STEP % HALF) % (HALF * HALF)) % (HALF * HALF)


def point(slot: Column) -> Column:
    """Where a slot (below 2**62) lies on the circle, from 0 to under 1, to 52 bits."""
    far, near = F.shiftright(slot, 31), slot.bitwiseAND(F.lit(HALF - 1))
    # of far's place only the low half is left when it goes round HALF times
    place = (_place(far).bitwiseAND(F.lit(HALF - 1)) * HALF + _place(near)) % (HALF * HALF)
    return F.shiftright(place, 10) / F.lit(float(1 << 52))


def schedule(sources: DataFrame) -> DataFrame:
    """(slot, source_key, turn, block): which block each slot takes. sources: one row a source (source_key, blocks, aim, low, high, total).

    Turns count a source's slots from 0, by slices of the schedule, so that no task ranks a whole source.
    Each source has as many slots as its aim; those that its share of the circle lacks come last.
    """
    spark = sources.sparkSession
    n = sources.agg(F.max("total")).first()[0] or 0
    slots = spark.range(n).select(F.col("id").alias("slot"), point(F.col("id")).alias("x"), F.shiftright("id", 14).alias("slice"))
    # cells of equal width turn the search of an interval into an equality
    cells = 1 << 10
    cut = sources.select("source_key", "low", "high", "blocks", "aim", F.explode(F.sequence(F.floor(F.col("low") * cells), F.floor(F.col("high") * cells))).alias("cell"))
    dealt = slots.withColumn("cell", F.floor(F.col("x") * cells)).join(cut, "cell").filter((F.col("x") >= F.col("low")) & (F.col("x") < F.col("high")))
    counts = keep(dealt.groupBy("source_key", "slice").agg(F.count("*").alias("n")), "slices")
    earlier = Window.partitionBy("source_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("source_key", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    turn = F.col("base") + F.row_number().over(Window.partitionBy("source_key", "slice").orderBy("slot")) - 1
    ranked = dealt.join(base, ["source_key", "slice"]).select("slot", "source_key", turn.alias("turn"), "blocks", "aim").filter(F.col("turn") < F.col("aim"))
    have = sources.join(counts.groupBy("source_key").agg(F.sum("n").alias("n")), "source_key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    lacking = have.filter(F.col("n") < F.col("aim")).select("source_key", F.explode(F.sequence("n", F.col("aim") - 1)).alias("turn"), "blocks", "aim")
    last = running(lacking, [F.col("turn"), F.col("source_key")], place=F.lit(1).cast("long")).select((F.col("place") - 1 + n).alias("slot"), "source_key", "turn", "blocks", "aim")
    return ranked.unionByName(last).select("slot", "source_key", "turn", (F.col("turn") % F.col("blocks")).alias("block"))


def _taken(docs: DataFrame, seed: int) -> DataFrame:
    """mix() with a name of each row: doc_id, print and source_key."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("print"), "source", _size(F.col("text")).alias("size"))
    # null gets a key of its own, apart from all strings
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source"))
    sized = keep(sized.withColumns({"source_key": key, "order": F.xxhash64("doc_id", F.lit(seed))}), "sizes")
    aims = keep(targets(sized).withColumn("source_key", key), "targets")
    total = aims.agg(F.sum("source_size")).first()[0] or 0
    block = max(1, min(LONGEST, total // SLOTS), -(-total // MOST_SLOTS))
    # a slot more or less is a small part of any source's target, however long the others' blocks
    fine = F.when(F.col("target") > 0, F.ceil(LEAST * F.col("source_size") / F.col("target"))).otherwise(0)
    blocks = F.greatest(F.lit(1), F.least("source_size", F.greatest(F.floor(F.col("source_size") / block), fine)))
    slots = F.when(F.col("source_size") > 0, F.col("target") * blocks / F.col("source_size")).otherwise(0.0)
    planned = aims.select("source_key", "source_size", blocks.alias("blocks"), slots.alias("slots"))
    aim = F.least(F.round("slots").cast("long"), MOST * F.col("blocks"))
    # in parts of a slot, so that sums are the same in any order
    planned = running(planned.withColumn("parts", F.round(F.col("slots") * FINE).cast("long")), [F.col("source_key")], high=F.col("parts"))
    planned = keep(planned, "shares")
    every = planned.agg(F.sum("parts")).first()[0] or 1
    planned = planned.select("source_key", "source_size", "blocks", aim.alias("aim"), ((F.col("high") - F.col("parts")) / every).alias("low"), (F.col("high") / every).alias("high"), F.lit(round(every / FINE)).cast("long").alias("total"))
    planned = keep(planned.filter("source_size > 0"), "plan")
    taken = schedule(planned).groupBy("source_key", "block").agg(F.count("*").alias("times"))

    part = F.pmod("order", F.lit(PARTS)).alias("part")
    lined = sized.filter("size > 0").select("doc_id", "print", "source_key", "order", "size", part)
    sums = lined.groupBy("source_key", "part").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("source_key", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source_key", "part").orderBy("order", "doc_id", "print", "size").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("base") + F.sum("size").over(inside)
    placed = lined.join(base, ["source_key", "part"]).withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    held = placed.join(planned.select("source_key", "source_size", "blocks"), "source_key")
    # the first blocks are one word longer if the words don't divide evenly
    held = held.withColumn("length", F.floor(F.col("source_size") / F.col("blocks"))).withColumn("longer", F.col("source_size") - F.col("length") * F.col("blocks"))
    edge = F.col("longer") * (F.col("length") + 1)
    of = lambda word: F.when(word < edge, F.floor(word / (F.col("length") + 1))).otherwise(F.col("longer") + F.floor((word - edge) / F.col("length")))
    each = held.withColumn("block", F.explode(F.sequence(of(F.col("start")), of(F.col("end") - 1))))
    first = F.col("block") * F.col("length") + F.least("block", "longer")
    last = first + F.col("length") + F.when(F.col("block") < F.col("longer"), 1).otherwise(0)
    words = F.least("end", last) - F.greatest("start", first)
    got = each.join(taken, ["source_key", "block"], "left").groupBy("doc_id", "print", "source_key", "size", "end").agg(F.sum(words * F.coalesce("times", F.lit(0))).alias("taken"))
    none = sized.filter("size = 0").select("doc_id", "print", "source_key", "size", F.lit(0).cast("long").alias("taken"))
    return got.drop("end").union(none).join(aims.select("source_key", "source_size", "target"), "source_key").select("doc_id", "print", "source_key", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, seed: int = 1) -> DataFrame:
    """How many words of each document the mix takes.

    docs needs doc_id, text and source; other columns are ignored. Returns doc_id, size, source_size,
    target and taken (repeats counted, at most MOST times size), one row for each input row. A null text
    has size 0 and nothing is taken of it; null is a source of its own. Rows that repeat an id are rows of
    their own; equal rows may change places, which changes nothing. An empty table gives an empty result.
    """
    return _taken(docs, seed).drop("print", "source_key")


def mix_rows(docs: DataFrame, seed: int = 1) -> DataFrame:
    """docs with size, source_size, target and taken, which replace columns called so. Rows that agree in id, text and source share what the mix takes of them evenly, to a word."""
    names = ["_id", "_print", "_source"]
    told = _taken(docs, seed).groupBy(F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.col("print").alias("_print"), F.col("source_key").alias("_source"))
    # written first: a row many times repeated is then split over tasks
    told = keep(told.agg(F.count("*").alias("_rows"), F.any_value("size").alias("size"), F.any_value("source_size").alias("source_size"), F.any_value("target").alias("target"), F.sum("taken").alias("taken")), "taken")
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source"))
    named = docs.drop("size", "source_size", "target", "taken").withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "_print": F.xxhash64("text"), "_source": key})
    return named.join(told, names).withColumn("taken", F.floor(F.col("taken") / F.col("_rows"))).drop(*names, "_rows")
