"""Looking up a value per key for every row, whatever the key sizes are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelway.session import planned_bytes

# A staged table below this file size is broadcast.
BROADCAST_BYTES = 8 << 20
# Beyond it, a key is hot when it holds more than 1/HOT_SHARE of the rows, so
# there are at most HOT_SHARE hot keys and as many extra salted copies.
HOT_SHARE = 50_000


def attach(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    weight: str,
    salt_on: list[str],
    how: str = "left",
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """Join ``table`` (one row per key, nulls match nulls) to ``rows``.

    ``weight`` is the column of ``table`` with the number of rows per key. A
    table of checked small size is broadcast, so the rows do not move. A larger
    one is joined by shuffle; keys too big for one task are first cut into
    salts in proportion to their weight.
    """
    limit = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    payload = [c for c in table.columns if c not in keys and c != weight]
    right = table.select(*[F.col(k).alias(f"__k_{k}") for k in keys], weight, *payload)

    def matches(left: DataFrame, other: DataFrame, names: list[str]):
        cond = F.lit(True)
        for k in names:
            cond = cond & left[k].eqNullSafe(other[f"__k_{k}"])
        return cond

    if planned_bytes(table) <= limit:
        right = right.drop(weight)
        joined = rows.join(F.broadcast(right), matches(rows, right, keys), how)
        return joined.select(*rows.columns, *payload)

    total = table.agg(F.sum(weight)).first()[0] or 0
    salts = F.ceil(F.col(weight) * F.lit(float(HOT_SHARE)) / F.lit(float(max(total, 1)))).cast("int")
    right = right.withColumn("__salts", F.greatest(salts, F.lit(1)))
    hot = right.where("__salts > 1").select(*[f"__k_{k}" for k in keys], "__salts")
    salted = rows.join(F.broadcast(hot), matches(rows, hot, keys), "left").select(
        *rows.columns,
        F.when(
            F.col("__salts").isNotNull(), F.pmod(F.xxhash64(*salt_on), F.col("__salts"))
        ).otherwise(F.lit(0)).cast("int").alias("__salt"),
    )
    copies = right.withColumn(
        "__k___salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))
    ).drop("__salts", weight)
    joined = salted.join(copies, matches(salted, copies, [*keys, "__salt"]), how)
    return joined.select(*rows.columns, *payload)
