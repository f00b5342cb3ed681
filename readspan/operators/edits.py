"""Edits of books, notes and values as whole-table rewrites that keep tombstones and before-images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_columns(rows: DataFrame, which: Column, values: dict[str, Column]) -> DataFrame:
    """UPDATE: ``values`` where ``which`` holds; null conditions leave a row as it is."""
    hit = F.coalesce(which, F.lit(False))
    return rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def bank_reading(books: DataFrame, which: Column, day: Column) -> DataFrame:
    """A finished reading is banked: its day joins ``restarted_on``, progress and the finished flag start anew."""
    return set_columns(books, which, {"restarted_on": F.array_append("restarted_on", day), "percent": F.lit(0.0), "finished": F.lit(False)})


def set_progress(books: DataFrame, percent: str) -> DataFrame:
    """Progress never falls back under a restart's place; at 99.5 and above a book is finished."""
    told = F.greatest(F.col(percent), F.coalesce("restart", F.lit(0.0)))
    return books.withColumns({"percent": told, "finished": F.col("finished") | (told >= 99.5)})


def clear(sittings: DataFrame, cleared: DataFrame, keys: DataFrame, key: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """DELETE of the ``keys``' rows, and the tombstones that keep a later pass from deriving them again."""
    left = sittings.join(keys.select(key).distinct(), key, "left_anti")
    return left, cleared.unionByName(keys.select(key).distinct().withColumn("at", at))


def patch(rows: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """MERGE: stated values of ``patches`` over ``rows``; also the before-images of the rows it changes."""
    p = patches.select(key, *(F.col(c).alias(f"__p_{c}") for c in columns))
    both = rows.join(p, key, "left")
    changed = None
    for c in columns:
        this = F.col(f"__p_{c}").isNotNull() & ~F.col(f"__p_{c}").eqNullSafe(F.col(c))
        changed = this if changed is None else changed | this
    after = both.withColumns({c: F.coalesce(f"__p_{c}", c) for c in columns}).select(rows.columns)
    return after, both.where(changed).select(rows.columns)


def rename_value(rows: DataFrame, array: str, old: str, new: str) -> DataFrame:
    """A value respelled wherever it stands, kept once; an empty ``new`` removes it."""
    moved = F.transform(array, lambda x: F.when(x == old, new).otherwise(x))
    return rows.withColumn(array, F.array_distinct(F.filter(moved, lambda x: x != "")))


def edit_stamp(held: Column, now: Column) -> Column:
    """A stamp later than what is held, whatever the clock says."""
    return F.greatest(now, held + F.expr("interval 1 second"))


def take_mark(books: DataFrame, marks: DataFrame, key: str = "cde_key") -> DataFrame:
    """``books`` (read_state, finished, percent) with the states that the catalogue has now (``marks``: key, read_state).

    A state speaks when it changes: read finishes a book, unread takes that back unless its progress says read through; a
    state that says neither only is remembered.
    """
    from readspan.sources.catalog import says_read

    rows = books.join(marks.select(key, F.col("read_state").alias("__s")), key, "left")
    says = F.when(F.col("__s").isNotNull() & ~F.equal_null("__s", "read_state"), says_read(F.col("__s")))
    through = F.coalesce(F.col("percent") >= 99.5, F.lit(False))
    finished = F.when(says, True).when(~says, through).otherwise(F.col("finished"))
    return rows.withColumns({"finished": finished, "read_state": F.coalesce("__s", "read_state")}).select(books.columns)


def stronger(held: DataFrame, other: DataFrame, keys: list[str], most: list[str], either: list[str]) -> DataFrame:
    """Two records' books as one: the greater of ``most`` columns, the or of ``either``, and what is held, else the other's, of the rest."""
    columns = [c for c in held.columns if c not in keys]
    both = held.select(*keys, F.struct(*columns).alias("h")).join(other.select(*keys, F.struct(*columns).alias("o")), keys, "full")

    def one(c: str) -> Column:
        h, o = F.col(f"h.{c}"), F.col(f"o.{c}")
        if c in most:
            return F.greatest(h, o).alias(c)
        if c in either:
            return (F.coalesce(h, F.lit(False)) | F.coalesce(o, F.lit(False))).alias(c)
        return F.when(h.isNull() | (h.cast("string") == ""), F.coalesce(o, h)).otherwise(h).alias(c)

    return both.select(*keys, *(one(c) for c in columns))
