"""What a search for parameters minimises, from the spread of replicates (see bootstrap.spread)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.operators.efficiency import nan_median

NAN = float("nan")


def relative_error(sampen: str = "sampen", error: str = "se_sampen") -> Column:
    """The larger of the error and its share of the entropy; the error where the entropy is 0 or NaN."""
    share = F.greatest(F.col(error), F.try_divide(F.col(error), F.col(sampen)))
    return F.when((F.col(sampen) == 0) | F.isnan(sampen), F.col(error)).otherwise(share)


def mse_objective(spread: DataFrame, by: tuple[str, ...], lam: float, r: str = "r") -> DataFrame:
    """(by, value): the mean over signals of the squared error, and lam times the root of r (a column of `by`)."""
    found = spread.groupBy(*by).agg(F.avg(F.coalesce("mse", F.lit(NAN))).alias("value"))
    return found.withColumn("value", F.col("value") + F.lit(float(lam)) * F.sqrt(r))


def efficiency_objective(spread: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, value): the median over signals of the relative error; NaN if one is."""
    return spread.withColumn("worse", relative_error()).groupBy(*by).agg(nan_median("worse").alias("value"))
