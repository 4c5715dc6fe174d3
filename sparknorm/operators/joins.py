"""Joins that keep a hot key out of a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, how: str = "inner", parts: int = 4096) -> DataFrame:
    """Joins ``rows`` with a table of one row a key, whose column ``weight`` counts the key's rows there.

    A key with more than 1 / ``parts`` of all rows would fill a task. There are
    fewer than ``parts`` of them, whatever the data, so they are broadcast;
    all others are shuffled. Rows with a null key only stay in a left join, and
    are not shuffled. ``rows`` is read twice and should be saved or cheap.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) > max(1000, total // parts)
    few = F.broadcast(table.where(hot).drop(weight))
    near = rows.join(few, keys, "left_semi" if how == "left_semi" else "inner")
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    far = rows.where(~null).join(few.select(*keys), keys, "left_anti").join(table.where(~hot).drop(weight), keys, how)
    both = near.unionByName(far)
    return both.unionByName(rows.where(null), allowMissingColumns=True) if how == "left" else both


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, how: str = "left", parts: int = 4096) -> DataFrame:
    """The join of ``spread_join`` with one reading of ``rows``: a key with more than 1 / ``parts`` of all rows is dealt to several seats, its row of the table standing at each.

    ``table`` is read twice and should be saved. Rows with a null key only stay
    in a left join, spread over many seats that no row of the table has.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    limit = max(1000, total // parts)
    copies = F.ceil(F.col(weight) / limit)
    hot = table.where(F.col(weight) > limit).select(*keys, copies.alias("_copies"))  # fewer than ``parts``
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    order = F.monotonically_increasing_id()
    seat = F.when(null, -1 - order % 1024).when(F.col("_copies").isNotNull(), order % F.col("_copies")).otherwise(0)
    seated = rows.join(F.broadcast(hot), keys, "left").withColumn("_seat", seat.cast("long")).drop("_copies")
    last = F.when(F.col(weight) > limit, copies - 1).otherwise(0).cast("long")
    dealt = table.withColumn("_seat", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop(weight)
    return seated.join(dealt, [*keys, "_seat"], how).drop("_seat")
