"""The device's catalogue of books and its list of looked-up words, as typed tables.

Both are tables of a database; a Spark reader (JDBC, or a Parquet snapshot) loads them, and these functions type them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readspan.functions.text import unpadded

# What a state of reading says, a type that is no book, endings of launchers and the clippings' own file.
READ, UNREAD = (1, 2, 4), (3, 5, 6)
NO_BOOKS = ("AUDI",)
LAUNCHERS = ("sh", "run_hotfix", "run_emergency", "kual")
CLIPPINGS = "My Clippings.txt"


def says_read(state: Column) -> Column:
    """Whether a state of reading says read; null where it says nothing."""
    return F.when(state.isin(*READ), True).when(state.isin(*UNREAD), False)


def json_text(json: Column, key: str) -> Column:
    """The first text that a JSON object states for ``key``; null without one."""
    found = F.regexp_extract(json, rf'"{key}":"((?:\\.|[^"\\])*)"', 1)
    return F.when(json.rlike(rf'"{key}":"(?:\\.|[^"\\])*"'), F.regexp_replace(found, r"\\(.)", "$1"))


def author_name(credits: Column, collation: Column) -> Column:
    """The name that is shown, else the one that is sorted by without its padding."""
    return F.coalesce(F.nullif(json_text(credits, "display"), F.lit("")), unpadded(F.coalesce(collation, F.lit(""))))


def is_reading(location: Column) -> Column:
    """Whether a file is something that is read: neither a launcher nor the clippings."""
    name = F.substring_index(location, "/", -1)
    ending = F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")
    return (name != CLIPPINGS) & ~ending.isin(*LAUNCHERS)


def is_book(key: Column) -> Column:
    """Keys that start with a star are no books."""
    return ~key.startswith("*")


def stem_of(location: Column) -> Column:
    """A file's name without its folder and its last ending."""
    name = F.substring_index(location, "/", -1)
    return F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def books(entries: DataFrame) -> DataFrame:
    """The books of the catalogue's rows, of the device and of the cloud; rows without a key and audio are left out.

    A cloud row has neither a place nor an extent; unstated progress and states are null. An older catalogue has no
    column for the state.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    state = F.col("p_readState").try_cast("int") if "p_readState" in entries.columns else F.lit(None).cast("int")
    rows = entries.where((text("p_cdeKey") != "") & ~text("p_cdeType").isin(*NO_BOOKS))
    percent = F.col("p_percentFinished").try_cast("double")
    return rows.select(
        F.coalesce(F.col("p_contentSize").try_cast("long"), F.lit(0)).alias("extent"),
        F.col("p_cdeKey").alias("cde_key"), text("p_cdeType").alias("cde_type"), text("p_titles_0_nominal").alias("title"),
        author_name(F.replace(text("j_credits"), F.lit("\n"), F.lit(" ")), F.col("p_credits_0_name_collation")).alias("author"),
        F.when(percent >= 0, percent).alias("percent"), text("p_thumbnail").alias("thumbnail"), F.coalesce(F.col("p_lastAccess").try_cast("long"), F.lit(0)).alias("last_access"),
        text("p_languages_0").alias("language"), text("p_location").alias("location"), (text("p_location") != "").alias("on_device"), state.alias("read_state"),
    )


def place(position: Column) -> Column:
    """The number behind a place's last colon; null for other places."""
    return F.trim(F.substring_index(position, ":", -1)).try_cast("long")


def lookups(looked_up: DataFrame, infos: DataFrame) -> DataFrame:
    """``(epoch, title, author, key, pos)``: words looked up (book_key, pos, timestamp in ms) in books (id, asin, title, authors).

    Lookups without a time or in a book without a title are left out.
    """
    info = infos.select(F.col("id").alias("book_key"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("authors", F.lit("")).alias("author"), F.coalesce("asin", F.lit("")).alias("key"))
    rows = looked_up.where(F.col("timestamp") > 0).join(info.where("title <> ''"), "book_key")
    return rows.select(F.floor(F.col("timestamp") / 1000).cast("long").alias("epoch"), "title", "author", "key", place(F.coalesce("pos", F.lit(""))).alias("pos"))


def merged(held: DataFrame, listed: DataFrame) -> DataFrame:
    """``held`` books with what the catalogue lists: a listed field that states something wins, books not listed are only off the device.

    Rows meet by key and extent; a listed row whose extent no held row of its key has meets the one held row of its key.
    ``change`` is added, changed or same.
    """
    columns = held.columns
    new = listed.select(*(F.col(c).alias(f"__n_{c}") for c in listed.columns)).withColumn("__id", F.monotonically_increasing_id())
    old = held.withColumn("__h", F.lit(True))
    exact = old.join(new, (old["cde_key"] == new["__n_cde_key"]) & (old["extent"] == new["__n_extent"]), "left")
    met = exact.where("__id is not null")
    rest = exact.where("__id is null").select(*columns, "__h")
    left = new.join(met.select("__id"), "__id", "left_anti")
    single = left.groupBy("__n_cde_key").agg(F.count("*").alias("__c"), F.min("__id").alias("__one")).where("__c = 1").drop("__c")
    lone = rest.groupBy("cde_key").agg(F.count("*").alias("__k")).where("__k = 1").drop("__k")
    pairs = lone.join(single, lone["cde_key"] == single["__n_cde_key"]).select("cde_key", "__one")
    by_key = rest.join(pairs, "cde_key", "left").join(left, F.col("__one") == left["__id"], "left").drop("__one")
    added = left.join(pairs, F.col("__id") == pairs["__one"], "left_anti")
    both = met.unionByName(by_key, allowMissingColumns=True).unionByName(added, allowMissingColumns=True)

    def taken(c: str) -> Column:
        if c == "on_device":
            return F.coalesce(F.col("__n_on_device"), F.lit(False))
        if f"__n_{c}" not in new.columns:
            return F.col(c)
        n = F.col(f"__n_{c}")
        states = n.isNotNull() & (n.cast("string") != "") & (n.cast("string") != "0")
        return F.when(states, n).otherwise(F.coalesce(F.col(c), n))

    out = both.select("__h", F.struct(*columns).alias("__was"), *(taken(c).alias(c) for c in columns))
    same = F.col("__was").eqNullSafe(F.struct(*columns))
    return out.withColumn("change", F.when(F.col("__h").isNull(), "added").when(same, "same").otherwise("changed")).drop("__h", "__was")
