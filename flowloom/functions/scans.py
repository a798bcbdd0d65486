"""Running maxima over long ordered groups, without putting a group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_max(df: DataFrame, group: Sequence[str], order: str, value: str, output: str, span: int,
                inclusive: bool = True, tie: Column | None = None) -> DataFrame:
    """Largest ``value`` among a group's rows up to each row (or before it) in ``order``.

    The group is cut into stretches of ``order``, ``span`` long.  Each stretch takes the maximum of the
    earlier ones from a table with one row per stretch, and runs its own window: no window sees more than a
    stretch.
    """
    cut = df.withColumn("_stretch", F.call_function("div", F.col(order), F.lit(span)))
    place = [*group, "_stretch"]
    earlier = Window.partitionBy(*group).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = (cut.groupBy(*place).agg(F.max(value).alias("_top"))
               .select(*place, F.max("_top").over(earlier).alias("_carried")))
    within = (Window.partitionBy(*place).orderBy(F.col(order), *([] if tie is None else [tie]))
              .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    return (cut.join(carried, place)
            .withColumn(output, F.greatest(F.max(value).over(within), F.col("_carried")))
            .drop("_stretch", "_carried"))
