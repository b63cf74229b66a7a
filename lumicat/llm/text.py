"""Column helpers on text that several operators share.

White space means the ASCII characters U+0020 and U+0009 to U+000D everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
SPACE_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores put before it as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only; ``lower`` does that faster where all characters are ASCII."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def strip_space(col: Column) -> Column:
    return F.btrim(col, F.lit(" \t\n\x0b\x0c\r"))


def words(col: Column) -> Column:
    """The words of a text in order; null gives no words."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), SPACE_RE), lambda w: w != "")


def bind(value: Column, body) -> Column:
    """Evaluates ``value`` once and hands it to ``body`` as a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hash128(col: Column) -> Column:
    """A struct of two independent 64-bit hashes of a column."""
    return F.struct(F.xxhash64(col).alias("a"), F.xxhash64(F.lit(1), col).alias("b"))


def staged(df: DataFrame, columns: dict[str, Column], drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without some columns and with others, behind a generator.

    The optimizer neither evaluates these expressions again where they are used
    several times nor moves filters on them below.
    """
    own = [F.col(f"`{c}`") for c in df.columns if c not in drop]
    return df.select(*own, F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))
