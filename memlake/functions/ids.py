"""Random ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def random_id() -> Column:
    """A random UUID per row. It changes when a row is computed again: store it before use as a key."""
    return F.uuid()
