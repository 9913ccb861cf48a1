"""Verdicts put together from several sources: upstream sides, totals that agree or not, passes over one ground."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEFT, RIGHT = 0, 1
#: Codes of a pass. Up to 3 the bits say which of two signals showed water; the others that the pass saw nothing.
MASKED, WATER, NO_DATA = 250, 251, 255


def side_of(left: Column, right: Column, margin: float) -> Column:
    """The side with more, where both are known and at least a margin apart."""
    known = left.isNotNull() & right.isNotNull() & ~F.isnan(left) & ~F.isnan(right) & (F.abs(left - right) >= margin)
    return F.when(known, F.when(left > right, LEFT).otherwise(RIGHT))


def upstream_vote(flow: tuple[Column, Column], height: tuple[Column, Column], crossing: Column, flow_margin: float, height_margin: float) -> Column:
    """(side, decided_by, agree): the upstream side by the land that drains towards the road, else by where a crossing stream comes from, else
    by height; ``agree`` says whether flow and height do, where both speak."""
    by_flow, by_height = side_of(*flow, flow_margin), side_of(*height, height_margin)
    by = F.when(by_flow.isNotNull(), "flow").when(crossing.isNotNull(), "crossing").when(by_height.isNotNull(), "height").otherwise("unclear")
    return F.struct(F.coalesce(by_flow, crossing, by_height).alias("side"), by.alias("decided_by"), (by_flow == by_height).alias("agree"))


def totals_agree(a: Column, b: Column, quiet: float = 5.0) -> Column:
    """Whether two totals would make a reader act alike: agree, differ or far apart."""
    low, high = F.least(a, b), F.greatest(a, b)
    near = (high < quiet) | (high - low < 10) | (high < low * 1.5)
    word = F.when(near, "agree").when((high > low * 3) & (high - low >= 30), "far apart").otherwise("differ")
    return F.when(a.isNotNull() & b.isNotNull(), word)


def passes_combined(passes: DataFrame, *cell: str, both: bool = False) -> DataFrame:
    """(cell, extent, valid, flooded) of all passes (cell, code): how many saw a cell, in how many it was flooded, and the union of signals.

    Flooded is a pass with either signal, or with ``both``. A cell that no pass saw has the code of open water, else masked, else none.
    """
    code, seen = F.col("code"), F.col("code") <= 3
    one, two = seen & (code.bitwiseAND(1) == 1), seen & (code.bitwiseAND(2) == 2)
    sums = passes.groupBy(*cell).agg(
        F.count_if(seen).alias("valid"), F.count_if(one & two if both else one | two).alias("flooded"),
        (F.max(one.cast("int")) + 2 * F.max(two.cast("int"))).alias("_bits"), F.max(code == WATER).alias("_water"), F.max(code == MASKED).alias("_masked"),
    )
    extent = F.when(F.col("valid") > 0, F.col("_bits")).when(F.col("_water"), WATER).when(F.col("_masked"), MASKED).otherwise(NO_DATA)
    return sums.select(*cell, extent.alias("extent"), "valid", "flooded")
