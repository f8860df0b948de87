"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import drop_path, fresh_path, kept, temporary, write, written  # noqa: F401  for the operators

#: Words of the near-duplicate and quality operators: everything between ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows are sampled if a hash modulo this is under a share of it; so fine that no number of rows makes a share of 0.
SHARE = 1 << 62


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, although ``body`` uses it inside lambdas."""
    return F.transform(F.array(value), body).getItem(0)


def share_of(wanted: int, rows: int) -> int:
    """The bound of hashes modulo SHARE under which about ``wanted`` of ``rows`` rows lie, all if there are no more."""
    return SHARE if rows <= wanted else SHARE * wanted // rows


def plan_bytes(df: DataFrame) -> int:
    """About how many bytes ``df`` has, as Spark's statistics tell without reading it; 0 where they can't."""
    found = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return found if found < 1 << 60 else 0


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
