"""The text functions for use in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from memlake.functions.text import HAN


def register(spark: SparkSession) -> None:
    """Create the temporary SQL function ``tokenize_cjk(text)``: plain SQL, no Python."""
    before = f"regexp_replace(text, r'([^ ])(?=[{HAN}])', '$1 ')"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION tokenize_cjk(text STRING) RETURNS STRING "
        f"RETURN regexp_replace({before}, r'([{HAN}])(?=[^ {HAN}])', '$1 ')"
    )
