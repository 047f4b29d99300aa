"""Shared helpers: table access, white space, let-binding, joins on hot groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all contracts: space and the controls 9 to 13.
SPACE_CHARS = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A group is heavy when it holds over one of so many parts of all rows, so
#: there are at most so many heavy groups, whatever the size of the input.
HEAVY_PARTS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` so that ``body`` may use it often: it is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def words(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that do not clash with those of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "left") -> DataFrame:
    """Join each row to its group's row by ``key`` without a hot partition.

    Groups above ``total / HEAVY_PARTS`` rows are at most HEAVY_PARTS many, so
    they are broadcast; no key of the shuffled rest holds more than that share.
    """
    limit = max(total // HEAVY_PARTS, 1000)
    heavy = groups.where(F.col(size) > limit)
    light = groups.where(F.col(size) <= limit)
    hot, cold = free_names(rows.select("*", *[F.lit(None).alias(c) for c in groups.columns if c not in rows.columns]), "is_heavy", "_unused")
    marked = rows.join(F.broadcast(heavy.select(F.col(key), F.lit(True).alias(hot))), key, "left")
    big = marked.where(F.col(hot)).drop(hot).join(F.broadcast(heavy), key, "inner")
    rest = marked.where(F.col(hot).isNull()).drop(hot).join(light, key, how)
    return big.unionByName(rest)
