"""The reader's own notes and corrections: inserts, edits and tombstones by last writer, as whole-table rewrites.

``notes`` have the columns of the record's ``w`` rows and are named by the second they were written in; ``corrections`` those of its
``r`` rows. Every edit is stamped later than what it replaces, whatever the clock says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readspan.operators.edits import edit_stamp
from readspan.operators.highlights import identity
from readspan.operators.lineage import pinned

LIVE, DELETED = "live", "deleted"


def add_notes(notes: DataFrame, new: DataFrame, device: str = "device") -> DataFrame:
    """``notes`` and ``new`` ones, each at the first second from its own on in which its ``device`` has none yet.

    Seconds are given out in order of what is asked for. Counted in free seconds, the n-th note of a device goes to its own
    place or to that after the note before it, whichever is later, so its place less n is a running maximum; and a free
    second is its number plus the taken ones before it. Both are windows over one device's sorted seconds, which spill; no
    list of them is built. Notes that ask for the same second go in any order.
    """
    second = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    w = Window.partitionBy(device).orderBy("s", "what")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = notes.select(device, second("written").alias("s")).distinct().select(device, "s", F.lit(1).alias("what"), F.lit(None).cast("long").alias("id"))
    asked = pinned(new.withColumn("__id", F.monotonically_increasing_id()))
    asks = asked.select(device, second("written").alias("s"), F.lit(0).alias("what"), F.col("__id").alias("id"))
    lines = taken.unionByName(asks).withColumn("full", F.coalesce(F.sum("what").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    order = Window.partitionBy(device).orderBy("s", "id")
    queue = lines.where("what = 0").select(device, "id", "s", (F.col("s") - F.col("full")).alias("free")).withColumn("n", F.row_number().over(order))
    queue = queue.withColumn("free", F.col("n") + F.max(F.col("free") - F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # a taken second is passed by every free place from its own number on
    passed = lines.where("what = 1").select(device, (F.col("s") - F.col("full")).alias("s"), F.lit(0).alias("what"), F.lit(None).cast("long").alias("id"))
    both = passed.unionByName(queue.select(device, F.col("free").alias("s"), F.lit(1).alias("what"), "id"))
    found = both.withColumn("at", F.col("s") + F.sum(1 - F.col("what")).over(upto)).where("what = 1").select(F.col("id").alias("__id"), F.timestamp_seconds("at").cast("timestamp_ntz").alias("__at"))
    own = asked.join(found, "__id").withColumns({"written": F.col("__at"), "edited": F.col("__at"), "state": F.lit(LIVE)})
    return notes.unionByName(own.select(notes.columns))


def reword(notes: DataFrame, edits: DataFrame, now: Column) -> DataFrame:
    """``notes`` with the texts of ``edits`` (written, text); deleted notes and unknown ones stay as they are."""
    rows = notes.join(edits.select("written", F.col("text").alias("__t")), "written", "left")
    hit = F.col("__t").isNotNull() & (F.col("state") == LIVE) & ~F.equal_null("__t", "text")
    stamped = {"edited": F.when(hit, edit_stamp(F.col("edited"), now)).otherwise(F.col("edited")), "text": F.when(hit, F.col("__t")).otherwise(F.col("text"))}
    return rows.withColumns(stamped).select(notes.columns)


def delete(notes: DataFrame, which: DataFrame, now: Column) -> DataFrame:
    """``notes`` with tombstones for ``which`` (written): without text, but kept, so that another device's copy doesn't come back."""
    rows = notes.join(which.select("written", F.lit(True).alias("__d")).distinct(), "written", "left")
    hit = F.coalesce(F.col("__d"), F.lit(False)) & (F.col("state") == LIVE)
    gone = {"edited": F.when(hit, edit_stamp(F.col("edited"), now)).otherwise(F.col("edited")), "state": F.when(hit, DELETED).otherwise(F.col("state")), "text": F.when(hit, "").otherwise(F.col("text"))}
    return rows.withColumns(gone).select(notes.columns)


def set_words(corrections: DataFrame, highlights: DataFrame, words: DataFrame, now: Column) -> DataFrame:
    """``corrections`` after the reader set ``words`` (at, kind, title, location, start, text): one row a highlight, the latest.

    A null text, or the words the highlight has anyway, takes a correction back and stays as a tombstone if there was
    one; words for a highlight that isn't there are left out.
    """
    body = highlights.select(identity(highlights).alias("__id"), F.col("body").alias("__body")).groupBy("__id").agg(F.min("__body").alias("__body"))
    asked = words.withColumn("__id", identity(words)).join(body, "__id")
    held = corrections.withColumn("__id", identity(corrections)).groupBy("__id").agg(F.max(F.struct("edited", "was", "text")).alias("__h"))
    rows = asked.join(held, "__id", "left")
    text = F.when(F.col("text") != F.col("__body"), F.col("text"))
    rows = rows.where(text.isNotNull() | F.col("__h.text").isNotNull())
    new = rows.select(
        F.coalesce(edit_stamp(F.col("__h.edited"), now), now).alias("edited"), *(F.col(f"__id.{c}").alias(c) for c in ("at", "kind", "title", "location", "start")),
        F.when(text.isNotNull(), F.col("__body")).alias("was"), text.alias("text"),
    )
    left = corrections.withColumn("__id", identity(corrections)).join(rows.select("__id"), "__id", "left_anti")
    return left.select(corrections.columns).unionByName(new.select(corrections.columns))


def drop_highlights(highlights: DataFrame, extents: DataFrame) -> DataFrame:
    """``highlights`` without those of ``extents``."""
    return highlights.join(extents.select("extent").distinct(), "extent", "left_anti").select(highlights.columns)
