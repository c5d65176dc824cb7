"""Column detection by name, and tables stacked with differing columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names under which a label column is looked for, in this order.
LABEL_NAMES = ["label", "class", "rating", "category", "type"]


def find_column(columns: Sequence[str], wanted: str) -> str | None:
    """Exact name in any case, else the first name that contains it."""
    for c in columns:
        if c.lower().strip() == wanted.lower():
            return c
    return next((c for c in columns if wanted.lower() in c.lower()), None)


def find_exact(columns: Sequence[str], wanted: str) -> str | None:
    return next((c for c in columns if c.lower() == wanted.lower()), None)


def find_label(columns: Sequence[str]) -> str | None:
    return next((hit for name in LABEL_NAMES if (hit := find_exact(columns, name))), None)


def find_rank(columns: Sequence[str]) -> str | None:
    return next((c for c in columns if "rank" in c.lower()), None)


def find_score(columns: Sequence[str]) -> str | None:
    """First name with "score" but not "rank", else any with "score"."""
    named = [c for c in columns if "score" in c.lower()]
    return next((c for c in named if "rank" not in c.lower()), named[0] if named else None)


def drop_index_columns(df: DataFrame) -> DataFrame:
    """Without columns an earlier export saved as its row index."""
    return df.drop(*[c for c in df.columns if c.startswith("Unnamed:") or c == "_c0"])


def first_available(df: DataFrame, *names: str) -> Column:
    """First non-NULL of those named columns that exist."""
    present = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Select and rename to a common schema."""
    return df.select(*[F.col(old).alias(new) for old, new in names.items()])


def stacked(tables: Sequence[DataFrame]) -> DataFrame:
    """Vertical concatenation; a column absent from a table is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def lenient_double(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numbers where a column can be read as one, NULL elsewhere."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in columns if c in df.columns})
