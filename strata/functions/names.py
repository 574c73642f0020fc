"""Names of table files: level and number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def table_level(name: Column) -> Column:
    """2 of sstable-L2-000017.sst; 0 if there is none."""
    return F.coalesce(F.regexp_extract(name, r"^sstable-L(\d+)[^-]*-", 1).try_cast("int"), F.lit(0))


def table_number(name: Column) -> Column:
    """17 of sstable-L2-000017.sst and of sstable-000017.sst; 0 if there is none."""
    number = F.regexp_extract(name, r"^sstable-(?:L[^-]*-)?(\d+)", 1)
    return F.coalesce(number.try_cast("long"), F.lit(0)).cast("long")


def table_name(level: int, number: int) -> str:
    return f"sstable-L{level}-{number:06d}.sst"
