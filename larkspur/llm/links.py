"""Pairs of rows that share a group key: all of them in bounded blocks, or links that stay linear for hot groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups up to this size come out as all their pairs; larger ones as one link per member.
ALL_PAIRS_UP_TO = 64
#: Items of a group that are paired in one block; larger groups are split into blocks of about this size.
BLOCK = 256
#: The largest groups, at most so many and each over ``HOT`` items, are told to every task; all others are met by a shuffle, and
#: none of them holds more than a thousandth of the rows.
HOTTEST, HOT, SALTS = 1000, 100_000, 64


def all_pairs(rows: DataFrame, group: list[str], item: str, variant: str | None = None) -> DataFrame:
    """Distinct pairs ``(a, b)`` with ``a < b`` of all items that share ``group`` and differ in ``variant``.

    rows: one row per item; ``variant`` as in ``linked_pairs``.  No pair of a group is left out, however
    large it is: the items of a large group are spread over salted blocks, and every two blocks are paired in a
    cell of bounded size, so that no task gathers the group.  The few hottest groups are told to every task, which
    salts their items before they are shuffled.  Null group keys give nothing.
    """
    rows = rows.select(*group, F.col(item).alias("_item"), F.col(variant or item).alias("_variant"))
    # The same filter on every use of the rows lets them share one shuffle.
    rows = rows.where(reduce(lambda a, b: a & b, (F.col(g).isNotNull() for g in group)))
    stats = rows.groupBy(*group).agg(F.count("*").alias("_n"), F.min("_variant").alias("_lo"), F.max("_variant").alias("_hi")).where("_n > 1 and _lo <> _hi")
    # The rows of the hottest groups are salted before they meet their group's size.
    hottest = stats.where(F.col("_n") > HOT).orderBy(F.desc("_n")).limit(HOTTEST).select(*group, F.lit(True).alias("_hot"))
    salted = rows.join(F.broadcast(hottest), group, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("_item"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))).drop("_hot")
    salts = F.when(F.col("_n") > HOT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    sized = stats.select(*group, F.expr(f"cast(ceil(_n / {BLOCK}) as int)").alias("_blocks"), F.explode(salts).alias("_salt"))
    members = salted.join(sized, [*group, "_salt"])
    members = members.withColumn("_own", F.expr("cast(pmod(xxhash64(_item), _blocks) as int)"))
    spread = members.select(*group, "_item", "_variant", "_own", F.explode(F.expr("sequence(0, _blocks - 1)")).alias("_other"))
    cells = spread.groupBy(*group, F.least("_own", "_other").alias("_from"), F.greatest("_own", "_other").alias("_to")).agg(F.array_sort(F.collect_list(F.struct("_item", "_variant", "_own"))).alias("_xs")).where("size(_xs) > 1")
    left = cells.select("_from", "_to", "_xs", F.posexplode("_xs").alias("_i", "_a"))
    pairs = left.select("_from", "_to", "_a", F.explode(F.expr("slice(_xs, _i + 2, size(_xs))")).alias("_b")).where("(_from = _to or _a._own <> _b._own) and _a._variant <> _b._variant and _a._item <> _b._item")
    return pairs.select(F.col("_a._item").alias("a"), F.col("_b._item").alias("b")).distinct()


def linked_pairs(rows: DataFrame, group: list[str], item: str, variant: str | None = None, all_pairs_up_to: int = ALL_PAIRS_UP_TO) -> DataFrame:
    """Distinct pairs ``(a, b)`` with ``a < b`` of items that share ``group`` and differ in ``variant``.

    rows: one row per item.  ``variant`` (default: the item) tells different items of a group apart; items
    of the same variant are not paired.  A group of at most ``all_pairs_up_to`` items gives all its pairs.
    A larger one, which may hold a third of all rows, gives one link per item to a fixed item of another
    variant, so that every member stays connected while the output stays linear and no task gathers the
    group.  Null group keys give nothing.
    """
    rows = rows.select(*group, F.col(item).alias("_item"), F.col(variant or item).alias("_variant"))
    tagged = F.struct("_variant", "_item")
    stats = rows.groupBy(*group).agg(F.count("*").alias("_n"), F.min(tagged).alias("_lo"), F.max(tagged).alias("_hi")).where("_n > 1 and _lo._variant <> _hi._variant")
    members = rows.join(stats, group)
    small = F.col("_n") <= all_pairs_up_to
    # Members of a large group are spread by a salt; each only needs the group's two fixed items.
    gathered = members.groupBy(*group, "_n", "_lo", "_hi", F.when(small, F.lit(0)).otherwise(F.xxhash64("_item")).alias("_salt")).agg(F.array_sort(F.collect_list(F.struct("_item", "_variant"))).alias("_xs"))
    left = gathered.select("_n", "_lo", "_hi", "_xs", F.posexplode("_xs").alias("_i", "_a"))
    far = F.when(F.col("_a._variant") != F.col("_lo._variant"), F.col("_lo")).otherwise(F.col("_hi"))
    others = F.when(small, F.expr("slice(_xs, _i + 2, size(_xs))")).otherwise(F.array(F.struct(far["_item"].alias("_item"), far["_variant"].alias("_variant"))))
    pairs = left.select("_a", F.explode(others).alias("_b")).where("_a._variant <> _b._variant")
    a: Column = F.col("_a._item")
    b: Column = F.col("_b._item")
    # Only the links of a large group can repeat (the two fixed items name each other).
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
