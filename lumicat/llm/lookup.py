"""Rows by a set of ids, and rows beside one row of their key, where one key may hold much of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicat.llm.text import unused
from lumicat.session import checkpointed, few_files

#: Ids are broadcast up to this many (8 bytes each, about 40 in a hash table), else both sides are shuffled.
BROADCAST_IDS = 1_000_000
#: Rows of a few numbers are broadcast up to this many (about 100 bytes each), else a key is dealt to ``SALTS`` tasks.
BROADCAST_ROWS, SALTS = 500_000, 16


def matching(rows: DataFrame, ids: DataFrame, key: str, how: str = "left_semi", most: int | None = None) -> DataFrame:
    """The ``rows`` whose ``key`` is in the only column of ``ids``, or is not with ``how="left_anti"``.

    The ids are written to the checkpoint folder first and counted there. Columns
    and their order stay; a null key is in no set.
    """
    (name,) = unused(rows, "_key")
    known = checkpointed(few_files(ids.toDF(name).where(F.col(name).isNotNull()).distinct()))
    few = known.limit((limit := BROADCAST_IDS if most is None else most) + 1).count() <= limit
    return rows.join(F.broadcast(known) if few else known, rows[key] == known[name], how)


def beside(rows: DataFrame, one: DataFrame, key: str, by: str, most: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``one``, which has one row per key: no task gathers all rows of a key.

    ``one`` is written and counted first. Where it is too large to broadcast, rows
    of a key are dealt by a hash of the column ``by`` and its row is copied to each part.
    """
    known = checkpointed(one)
    if known.limit((limit := BROADCAST_ROWS if most is None else most) + 1).count() <= limit:
        return rows.join(F.broadcast(known), key)
    (salt,) = unused(rows, "_salt")
    copies = known.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(copies, [key, salt]).drop(salt)
