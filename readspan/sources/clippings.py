"""Clippings: blocks of lines ended by a separator, parsed to typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The separator, the cap on a block's lines, and label words of each kind in the order they are tried.
SEPARATOR, BLOCK_CAP = "==========", 64
KINDS = {
    "underline": "underline", "circle": "circle", "asterisk": "asterisk",
    "article": "clip this article|artikel|artículo|articolo|artigo|extrait|вырезка|記事クリップ|文章剪切",
    "bookmark": "bookmark|lesezeichen|marcador|signet|segnalibro|bladwijzer|закладка|ブックマーク|书签",
    "highlight": "highlight|markierung|subrayado|surlignement|evidenziazione|destaque|выделенный|ハイライト|标注",
    "note": "note|notiz|nota|notitie|заметка|メモ|笔记",
}


def read_blocks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``block``, one row a block: the separator ends a record, so a file is split over tasks; what follows the last one is a block too."""
    return spark.read.text(paths, lineSep=SEPARATOR).select(F.col("value").alias("block"))


def parse_blocks(blocks: DataFrame, block: str = "block") -> DataFrame:
    """``blocks`` with title, author, kind, page, start, end, at and body; blocks of under three or over 64 lines are dropped."""
    text = F.regexp_replace(F.regexp_replace(F.col(block), "[\\uFEFF\\r]", ""), r"^\n|\n$", "")
    lines = F.split(text, "\n")
    rows = blocks.withColumn("__l", lines).where((F.size("__l") >= 3) & (F.size("__l") <= BLOCK_CAP))
    head, label = F.trim(F.get("__l", F.lit(0))), F.get("__l", F.lit(1))
    author = F.regexp_extract(head, r"(?<!  )\(([^()]*(?:\([^()]*\)[^()]*)*)\)$", 1)
    body = F.regexp_replace(F.array_join(F.slice("__l", 3, BLOCK_CAP), "\n"), r"^\s+|\s+$", "")
    what = F.lower(F.substring_index(label, "|", 1))
    kind = None
    for name, pattern in KINDS.items():
        kind = F.when(what.rlike(pattern), name) if kind is None else kind.when(what.rlike(pattern), name)
    place = F.regexp_extract(label, r"(?i)location[s]? (\d+)(?:[-–](\d+))?", 1).try_cast("long")
    upto = F.regexp_extract(label, r"(?i)location[s]? (\d+)(?:[-–](\d+))?", 2)
    said = F.regexp_replace(F.regexp_extract(label, r"Added on (.*)$", 1), r"[\x{202F}\x{00A0}]", " ")
    said = F.regexp_replace(F.regexp_replace(said, r"^[A-Za-z]+, ", ""), ",", "")
    at = F.coalesce(*(F.try_to_timestamp(said, F.lit(f)) for f in ("MMMM d yyyy h:mm:ss a", "MMMM d yyyy HH:mm:ss", "d MMMM yyyy h:mm:ss a", "d MMMM yyyy HH:mm:ss")))
    return rows.select(
        "*",
        F.trim(F.when(author != "", F.regexp_replace(head, r"\s*\([^()]*(?:\([^()]*\)[^()]*)*\)$", "")).otherwise(head)).alias("title"),
        author.alias("author"),
        kind.otherwise(F.when(body == "", "bookmark").otherwise("highlight")).alias("kind"),
        F.nullif(F.regexp_extract(label, r"(?i)page ([0-9A-Za-z]+)", 1), F.lit("")).alias("page"),
        place.alias("start"),
        F.coalesce(F.nullif(upto, F.lit("")).try_cast("long"), place).alias("end"),
        at.cast("timestamp_ntz").alias("at"),
        body.alias("body"),
    ).drop("__l")
