"""Device logs: files chosen by the time in their name, marker lines, typed observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readspan.functions import logline


def file_stamp(path: Column) -> Column:
    """The instant in a file's name as ``YYMMDD:HHMMSS``; null for names without one, which are always read."""
    name = F.substring_index(path, "/", -1)
    dump = F.regexp_extract(name, r"^log_backup_(\d{6})(\d{6})", 0)
    chunk = F.regexp_extract(name, r"^messages_\d+_\d{2}(\d{6})(\d{6})", 0)
    parts = lambda c, lo: F.concat(F.substring(c, lo, 6), F.lit(":"), F.substring(c, lo + 6, 6))
    digits = F.regexp_extract(chunk, r"_(\d{14})$", 1)
    return F.when(dump != "", parts(F.regexp_extract(dump, r"(\d{12})$", 1), 1)).when(digits != "", parts(digits, 3))


def read_lines(spark: SparkSession, paths: list[str], watermark: str = "") -> DataFrame:
    """``(line, path)`` of marker lines at or after ``watermark``; lines without a stamp are kept, equal lines are one.

    Files whose name tells that they end before the watermark are left out before they are read, but for the
    newest of them, which may straddle it. Plain and gzip files are read alike.
    """
    files = spark.read.format("binaryFile").load(paths).select("path").withColumn("at", file_stamp(F.col("path")))
    before = files.where(F.col("at") <= watermark).agg(F.max("at")).first()[0] if watermark else None
    chosen = [r.path for r in files.where(F.col("at").isNull() | (F.col("at") >= (before or ""))).collect()]  # paths only
    if not chosen:
        return spark.createDataFrame([], "line string, path string")
    rows = spark.read.text(chosen).select(F.left("value", F.lit(logline.LINE_CAP)).alias("line"), F.input_file_name().alias("path"))
    return kept(rows, watermark).groupBy("line").agg(F.min("path").alias("path"))


def kept(lines: DataFrame, watermark: str = "") -> DataFrame:
    text = F.left("line", F.lit(13))
    return lines.where(logline.family(F.col("line")).isNotNull() & (~F.col("line").rlike(r"^\d{6}:\d{6}") | (text >= watermark)))


def observations(lines: DataFrame) -> DataFrame:
    """``lines`` with the columns that the sessioniser reads; what a line doesn't state is null.

    Of a timer line's payloads one is read: the first that states a counter and a book's end; else, where the line
    names a page event, the first that states a book's end; else the first that also states where the reader is.
    Fields are parsed only for lines of the family that can hold them.
    """
    line = F.col("line")
    rows = lines.select("*", logline.stamp(line).alias("ts"), logline.family(line).alias("family"))
    timer, other = F.col("family") == "timer", F.col("family") != "timer"
    event = lambda p: F.struct(
        p.alias("p"), logline.end_position(p).alias("position"), p.rlike(r"(?:^|[,:])TotalTime:\d").alias("counts"), p.rlike(r"(?:^|[,:])CurrentPos:[^:,;]*Position:").alias("stands")
    )
    parts = F.when(timer, logline.payloads(line))
    rows = rows.withColumn("events", F.transform(F.transform(parts, logline.last_event), event))
    named = logline.names(line, "(?:NextPage|PreviousPage|CloseBook|GoToPosition)")
    some = lambda test: F.try_element_at(F.filter("events", lambda x: x["position"].isNotNull() & test(x)), F.lit(1))
    rows = rows.withColumn("pay", F.coalesce(some(lambda x: x["counts"]), F.when(named, some(lambda x: F.lit(True))), some(lambda x: x["stands"])))
    rows = rows.withColumn("position", F.col("pay.position"))
    p = F.col("pay.p")
    of_book = F.transform(F.filter("events", lambda x: x["position"] == F.col("position")), lambda x: x["p"])
    first = lambda read: F.try_element_at(F.filter(F.transform(of_book, read), lambda x: x.isNotNull()), F.lit(1))
    in_group = F.filter(parts, lambda x: x.contains("NextTOCEntry"))
    observed = F.col("position").isNotNull()
    return rows.select(
        *lines.columns, "ts", "family", "position",
        F.flatten(F.transform(in_group, logline.chapter_positions)).alias("chapters"),
        F.transform(F.transform(in_group, logline.last_event), logline.end_position).alias("chapter_books"),
        logline.number(p, "TotalTime").alias("total_ms"),
        logline.number(p, "TotalWords").alias("words"),
        logline.number(p, "IntervalTime").alias("interval_ms"),
        logline.number(p, "IntervalWords").alias("interval_words"),
        F.when(observed, first(logline.share_left)).alias("left_share"),
        F.when(observed, first(logline.seconds_left)).alias("time_left"),
        F.when(observed, first(logline.words_a_minute)).alias("stated_wpm"),
        (timer & logline.names(line, "NextPage")).alias("page_turn"),
        (timer & logline.names(line, "CloseBook")).alias("closes"),
        (timer & logline.names(line, "(?:GoToPosition|TapOnFooter)")).alias("jumped"),
        p.rlike(r"(?:^|[,:])SkipAvgReason:").alias("refused"),
        F.when(timer, logline.opened_at(line)).alias("opened_ms"),
        (timer & logline.wakes(line)).alias("wakes"),
        F.when(timer, logline.from_book(line)).alias("from_book"),
        F.when(F.col("family") == "metric", logline.metric(line)).alias("metric"),
        F.when(other & line.contains("SchemaName["), logline.content_key(line)).alias("content_key"),
        F.when(other, logline.power(line)).alias("power"),
        (other & line.contains(logline.POWER_CHANGE)).alias("power_metric"),
    )
