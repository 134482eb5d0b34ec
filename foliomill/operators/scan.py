"""Running sums and last values along a book of any size: two-level prefix scans.

The rows of a book are cut into ranges of an integer (a page or an entry number), SPAN numbers each. What comes before a range is the scan of one summary row for
each range before it; what comes before a row within its range is a window over (book, range). So no task sorts a whole book, and the summaries of a book
number its rows divided by SPAN if the numbers are about consecutive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Consecutive numbers in one range.
SPAN = 1 << 16


def scanned(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], *, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, inclusive: bool = False, span: int | None = None) -> DataFrame:
    """rows with the running sum, or the last value that isn't null, of columns over the rows before (and with, if inclusive) each row of its keys.

    order[0] is the integer that is cut into ranges; order as a whole has to tell the rows of a key apart. A sum over no rows is 0.
    """
    sums, lasts = sums or {}, lasts or {}
    keyed = rows.select("*", F.floor(F.col(order[0]) / F.lit(span or SPAN)).alias("range__"), *[v.alias(f"v__{n}") for n, v in [*sums.items(), *lasts.items()]])
    place = F.struct(*order)
    value = lambda n: F.col(f"v__{n}")
    tails = keyed.groupBy(*keys, "range__").agg(
        F.count(F.lit(1)).alias("n__"), *[F.sum(value(n)).alias(f"t__{n}") for n in sums], *[F.max_by(value(n), F.when(value(n).isNotNull(), place)).alias(f"t__{n}") for n in lasts]
    )
    before = Window.partitionBy(*keys).orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.sum(f"t__{n}").over(before).alias(f"c__{n}") for n in sums] + [F.last(f"t__{n}", ignorenulls=True).over(before).alias(f"c__{n}") for n in lasts]
    carry = tails.select(*[F.col(k).alias(f"k__{k}") for k in keys], F.col("range__").alias("r__"), *carry)
    near = Window.partitionBy(*keys, "range__").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = keyed.select("*", *[F.sum(value(n)).over(near).alias(f"l__{n}") for n in sums], *[F.last(value(n), ignorenulls=True).over(near).alias(f"l__{n}") for n in lasts])
    same = F.col("range__").eqNullSafe(F.col("r__"))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"k__{k}"))
    out = local.join(carry, same, "left")
    done = [(F.coalesce(F.col(f"l__{n}"), F.lit(0)) + F.coalesce(F.col(f"c__{n}"), F.lit(0))).alias(n) for n in sums]
    return out.select(*rows.columns, *done, *[F.coalesce(F.col(f"l__{n}"), F.col(f"c__{n}")).alias(n) for n in lasts])


def numbered(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], name: str, start: int = 0, span: int | None = None) -> DataFrame:
    """rows with their number among those of their keys, from `start`, in the order of `order`."""
    return scanned(rows, keys, order, sums={name: F.lit(1)}, span=span).withColumn(name, F.col(name) + start)
