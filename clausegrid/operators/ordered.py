"""Ordered scans that keep working when one key holds most of the rows.

A plain window over a key puts the whole key into one task. Here each key is cut into
blocks of the (unique, integral) order column, so a block never holds more than
``block_rows`` rows. The scan runs inside the blocks; one summary row per block is then
scanned per key, and its carry is joined back. Keys of a single block need no carry: the
carry table is empty for them.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausegrid.functions.stages import materialise

BLOCK_ROWS = 1 << 18
BLOCK = "_block"


def numbered(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """``df`` with a unique increasing integer in the order of keys and ``order``, of any type.

    Rows are sorted by range, so no task holds a whole key, and the numbers within a task
    are dense; they are stored, as sorting again might deal rows out in another way.
    """
    placed = df.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order)
    return materialise(placed.withColumn(name, F.monotonically_increasing_id()))


def dense(df: DataFrame, order: str, name: str) -> DataFrame:
    """``df`` with the numbers 0, 1, 2, ... in the order of ``order``: the rows of the parts
    before, of which there is one count per part, and the place within the part."""
    rows = numbered(df, [], order, "_number").withColumn("_part", F.shiftright("_number", 33))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_number").alias("_first"))
    parts = parts.select("_part", "_first", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    placed = rows.join(F.broadcast(parts), "_part").withColumn(name, F.col("_number") - F.col("_first") + F.col("_before"))
    return placed.select(*df.columns, name)


def with_block(df: DataFrame, order: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    return df.withColumn(BLOCK, F.floor(F.col(order) / block_rows).cast("long"))


def inside(keys: list[str], order: str):
    """Rows of one block up to and including the current one."""
    return Window.partitionBy(*keys, BLOCK).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def earlier_blocks(keys: list[str]):
    return Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add running totals (``sums``) and last non-null values (``lasts``), both inclusive."""
    sums, lasts = sums or {}, lasts or {}
    within = inside(keys, order)
    blocked = with_block(df, order, block_rows)
    local = blocked.withColumns(
        {**{n: F.coalesce(F.sum(e).over(within), F.lit(0)) for n, e in sums.items()},
         **{n: F.last(e, ignorenulls=True).over(within) for n, e in lasts.items()}}
    )
    names = [*sums, *lasts]
    ends = local.groupBy(*keys, BLOCK).agg(F.max_by(F.struct(*names), order).alias("_end"))
    before = earlier_blocks(keys)
    carry = ends.select(
        *keys, BLOCK,
        F.count("*").over(before).alias("_blocks"),
        *[F.sum(f"_end.{n}").over(before).alias(f"_c_{n}") for n in sums],
        *[F.last(f"_end.{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in lasts],
    ).filter("_blocks > 0").drop("_blocks")
    joined = local.join(carry, [*keys, BLOCK], "left").withColumns(
        {**{n: F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in sums},
         **{n: F.coalesce(F.col(n), F.col(f"_c_{n}")) for n in lasts}}
    )
    return joined.select(*[c for c in df.columns if c not in names], *names)


def with_neighbours(
    df: DataFrame,
    keys: list[str],
    order: str,
    payload: list[str],
    before: int = 0,
    after: int = 0,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``prev`` (up to ``before`` rows, nearest last) and ``next`` (up to ``after``
    rows, nearest first): arrays of structs of ``payload`` columns."""
    base = Window.partitionBy(*keys, BLOCK).orderBy(order)
    # The payload is moved once, within the item of its row.
    own = [c for c in df.columns if c not in payload or c in (*keys, order)]
    blocked = with_block(df.select(*own, F.struct(*payload).alias("_item")), order, block_rows)
    none = F.slice(F.array("_item"), 1, 0)
    local = blocked.withColumns({
        "prev": F.collect_list("_item").over(base.rowsBetween(-before, -1)) if before else none,
        "next": F.collect_list("_item").over(base.rowsBetween(1, after)) if after else none,
        "_n": F.row_number().over(base),
        "_last": F.lead(F.lit(False), 1, True).over(base),
    })
    # The edges of each block: its first `after` and last `before` rows.
    edges = local.filter("_n = 1 or _last").groupBy(*keys, BLOCK).agg(
        F.max(F.when(F.col("_n") == 1, F.slice(F.concat(F.array("_item"), "next"), 1, max(after, 1)))).alias("_first"),
        F.max(F.when(F.col("_last"), F.concat("prev", F.array("_item")))).alias("_tail"),
    )
    per_key = Window.partitionBy(*keys).orderBy(BLOCK)
    carry = edges.select(
        *keys, BLOCK,
        F.flatten(F.collect_list("_tail").over(per_key.rowsBetween(-max(before, 1), -1))).alias("_before"),
        F.flatten(F.collect_list("_first").over(per_key.rowsBetween(1, max(after, 1)))).alias("_after"),
    ).filter((F.size("_before") > 0) | (F.size("_after") > 0))
    joined = local.join(carry, [*keys, BLOCK], "left")

    def last_n(array: Column, n: int) -> Column:
        return F.slice(array, F.greatest(F.size(array) - n + 1, F.lit(1)), n)

    def completed(own: str, carried: str, n: int, front: bool) -> Column:
        short = (F.size(own) < n) & F.col(carried).isNotNull()
        parts = F.concat(carried, own) if front else F.concat(own, carried)
        return F.when(short, last_n(parts, n) if front else F.slice(parts, 1, n)).otherwise(F.col(own))

    out = joined
    if before:
        out = out.withColumn("prev", completed("prev", "_before", before, True))
    if after:
        out = out.withColumn("next", completed("next", "_after", after, False))
    return out.select(*[F.col(c) if c in own else F.col("_item")[c].alias(c) for c in df.columns], "prev", "next")
