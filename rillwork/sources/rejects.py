"""The reject channel: a parser gives every input row a value or a reason, and no row vanishes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tag(df: DataFrame, reasons: Mapping[str, Column]) -> DataFrame:
    """``df`` with the ``reason`` why a row cannot be used: the first whose condition holds, null for a good row."""
    reason = F.lit(None).cast("string")
    for name, cond in reversed(list(reasons.items())):
        reason = F.when(F.coalesce(cond, F.lit(False)), F.lit(name)).otherwise(reason)
    return df.withColumn("reason", reason)


def split(tagged: DataFrame, line: str) -> tuple[DataFrame, DataFrame]:
    """``(good, rejects)``: good rows without the raw ``line``, rejects as ``line, reason``."""
    good = tagged.filter(F.col("reason").isNull()).drop("reason", line)
    return good, tagged.filter(F.col("reason").isNotNull()).select(F.col(line).alias("line"), "reason")


def account(tagged: DataFrame) -> DataFrame:
    """``outcome, n``: rows that were read, ``accepted`` or by reason; their sum is the number of input rows."""
    return tagged.groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
