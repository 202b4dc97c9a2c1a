"""Small summaries over tagged rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ReconConfig
from ..functions.predicates import col, is_canceled, money, numeric


def only_tax_split(only_tax: DataFrame, cfg: ReconConfig) -> DataFrame:
    """Tax-only rows split into valid and canceled, with the valid amount."""
    c = (is_canceled(col(cfg.tax.status), cfg.valid_status)
         if cfg.tax.status in only_tax.columns else F.lit(False))
    amt = money(numeric(only_tax, cfg.tax.amount))
    return only_tax.agg(
        F.count(F.when(~c, 1)).cast("bigint").alias("only_tax_valid_count"),
        F.count(F.when(c, 1)).cast("bigint").alias("only_tax_canceled_count"),
        F.coalesce(F.sum(F.when(~c, amt)), F.lit(0).cast("decimal(24,4)")).alias("only_tax_valid_amount"))
