"""What changed between two versions of a table: reported, applied, undone, and folded into a third."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ADDED, CHANGED, GONE = "added", "changed", "gone"


def _same(keys: list[str], a: str = "b", b: str = "a") -> Column:
    return reduce(Column.__and__, (F.equal_null(F.col(f"{a}.{k}"), F.col(f"{b}.{k}")) for k in keys))


def diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, what, before, after)``: each row that was added, changed or is gone, with its other columns as they were and as they are.

    Both versions have the same columns and one row a key; nulls are equal, in keys too. One shuffle join by the keys.
    """
    rest = [c for c in before.columns if c not in keys]
    side = lambda df, name: df.select(*keys, F.struct(*rest, F.lit(True).alias("__in")).alias(name))
    b, a = side(before, "before").alias("b"), side(after, "after").alias("a")
    both = b.join(a, _same(keys), "full").select(*(F.coalesce(F.col(f"b.{k}"), F.col(f"a.{k}")).alias(k) for k in keys), "before", "after")
    what = F.when(F.col("before").isNull(), ADDED).when(F.col("after").isNull(), GONE).when(~F.equal_null("before", "after"), CHANGED)
    return both.withColumn("what", what).where("what is not null").select(*keys, "what", F.col("before").dropFields("__in").alias("before"), F.col("after").dropFields("__in").alias("after"))


def _laid(rows: DataFrame, changes: DataFrame, keys: list[str], to: str, stays: str) -> DataFrame:
    """``rows`` without the keys of ``changes``, and the images ``to`` of those but of kind ``stays``."""
    kept = rows.alias("b").join(changes.select(*keys).alias("a"), _same(keys), "left_anti")
    put = changes.where(F.col("what") != stays).select(*keys, f"{to}.*")
    return kept.select(rows.columns).unionByName(put.select(rows.columns))


def apply(before: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The version after ``changes``; a change whose key isn't there is laid all the same, so laying it twice is laying it once."""
    return _laid(before, changes, keys, "after", GONE)


def undo(after: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The version before ``changes``."""
    return _laid(after, changes, keys, "before", ADDED)


def report(changes: DataFrame) -> DataFrame:
    """One row: how many were ``added``, ``changed`` and are ``gone``, and whether anything ``moved``."""
    n = lambda what: F.count_if(F.col("what") == what).alias(what)
    return changes.agg(n(ADDED), n(CHANGED), n(GONE), (F.count("*") > 0).alias("moved"))


def fields_changed(changes: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, field, was, now)``: the fields of changed rows that differ, as text."""
    fields = changes.schema["before"].dataType.fieldNames()
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"before.{f}").cast("string").alias("was"), F.col(f"after.{f}").cast("string").alias("now")) for f in fields))
    differ = F.filter(each, lambda x: ~F.equal_null(x["was"], x["now"]))
    return changes.where(F.col("what") == CHANGED).select(*keys, F.explode(differ).alias("x")).select(*keys, "x.*")


def restored(held: DataFrame, backup: DataFrame, keys: list[str], edited: str | None = None) -> DataFrame:
    """Fold a backup into what is held: rows that only one side has stay; of a key's two the held one, or the later ``edited`` where the rows say when."""
    rank = F.struct(F.col(edited), F.col("__held")) if edited else F.struct(F.col("__held"))
    both = held.withColumn("__held", F.lit(1)).unionByName(backup.withColumn("__held", F.lit(0)))
    w = Window.partitionBy(*keys).orderBy(rank.desc())
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(held.columns)


def latest(held: DataFrame, backups: DataFrame, keys: list[str], stamp: str, written: Column, edited: str) -> DataFrame:
    """The newest backup's rows in place of what is held, but for rows that the reader wrote (``written``): of those both sides' later ones.

    ``backups`` are whole versions, told apart by ``stamp``; the newest takes the place of all others.
    """
    last = backups.agg(F.max(stamp)).first()[0]
    pick = backups.where(F.equal_null(stamp, F.lit(last))).drop(stamp).select(held.columns)
    own = restored(held.where(written), pick.where(written), keys, edited)
    return pick.where(~F.coalesce(written, F.lit(False))).unionByName(own)


def superseded(backups: DataFrame, record: DataFrame, stamp: str) -> DataFrame:
    """``(stamp)``: the backups all of whose rows ``record`` holds, which may go; one with a row it lacks stays."""
    digest = lambda df: F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c != stamp)), {"ignoreNullFields": "false"}), 256)
    rows = backups.select(stamp, digest(backups).alias("__d"))
    known = record.select(digest(record).alias("__d")).distinct().withColumn("__k", F.lit(True))
    return rows.join(known, "__d", "left").groupBy(stamp).agg(F.bool_and(F.coalesce("__k", F.lit(False))).alias("__all")).where("__all").select(stamp)
