"""Sittings from parsed log lines, in batch and in micro-batches over a growing log."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readspan.functions import logline
from readspan.functions.scores import GAP, broken, credits, dwell, intdiv, share
from readspan.operators.figures import busiest, spread_over
from readspan.operators.intervals import seconds_in, shared_over, spans_inside
from readspan.operators.lineage import pinned, tasks
from readspan.sources.logs import kept, observations

# Seconds by which a counter may outrun the clock, and by which a power line may trail a wake.
SLACK, WAKE_LAG = 60, 5
#: Lines that a task sorts.
LINES_A_TASK = 150_000


#: What ``sittings`` returns.
SITTING = (
    "device string, started_at timestamp_ntz, ended_at timestamp_ntz, end_position long, seconds long, page_turns long, words long, measure string, content_key string, progress double, "
    "start_counter_ms long, end_counter_ms long, start_words long, end_words long, time_left long, stated_wpm long, awake_seconds long, paged_seconds long, paged_words long, "
    "timed_seconds long, timed_words long, covered double, stretches array<struct<from:double,to:double>>, hours array<struct<h:int,s:bigint>>"
)


def _secs(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def _midnight(ts: Column) -> Column:
    return F.to_date(ts).cast("timestamp_ntz")


def beside(rows: DataFrame, few: DataFrame, keys: list[str], n: int, device: str) -> DataFrame:
    """``rows`` with what ``few`` has for their ``keys``, in ``n`` tasks by device; where ``few`` has nothing, nothing is moved for it."""
    few = pinned(few)
    if few.isEmpty():
        return rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in few.schema if f.name not in keys})
    return rows.repartition(n, *keys).join(few.repartition(n, *keys), keys, "left").repartition(n, device)


def without_chapters(lines: DataFrame, device: str = "device", n: int | None = None) -> DataFrame:
    """``lines`` with a stamp; an end position that only ever ends a chapter is none. With ``n`` they stay in as many tasks by device."""
    rows = lines.where("ts is not null")
    group = rows.where("chapters is not null")
    said = lambda column, book: F.transform(F.coalesce(column, F.array()), lambda x: F.struct(x.cast("long").alias("position"), F.lit(book).alias("book")))
    ends = group.select(device, F.explode(F.concat(said("chapters", False), said("chapter_books", True))).alias("x")).select(device, "x.*")
    only = ends.where(F.col("position").isNotNull()).groupBy(device, "position").agg(F.max("book").alias("chapter_only")).where("not chapter_only")
    keys = [device, "position"]
    rows = (rows.join(only, keys, "left") if n is None else beside(rows, only, keys, n, device)).withColumn("position", F.when(F.col("chapter_only").isNull(), F.col("position")))
    return rows.drop("chapter_only", "chapters", "chapter_books")


def last_statements(rows: DataFrame, *keys: str) -> DataFrame:
    """``(keys, position, total_ms, words, ts)``: the last counter that lines (of ``without_chapters``) state of each book."""
    stated = rows.where("position is not null and total_ms is not null and words is not null")
    last = F.max_by(F.struct("total_ms", "words", "ts"), F.struct("ts", "line"))
    return stated.groupBy(*keys, "position").agg(last.alias("s")).select(*keys, "position", "s.*")


def named_opens(rows: DataFrame, counters: DataFrame | None, device: str) -> DataFrame:
    """``(device, open_no, named)``: opens that no observation takes before the next, and the one book whose counter stands at what they state.

    Every statement of a book is in force until the book's next one; ``counters`` are in force before the first. An open and the
    statements of its second are joined by that second, and those count that are in force when the open is given up,
    at the next open or the log's end. Two books with such a counter name none.
    """
    w = Window.partitionBy(device, "position").orderBy("ts", "line")
    columns = [device, "position", "total_ms", "ts", "line"]
    said = rows.where("observed and total_ms is not null and words is not null").select(columns)
    if counters is not None:
        said = said.unionByName(counters.select(device, "position", "total_ms", F.lit("0001-01-01").cast("timestamp_ntz").alias("ts"), F.lit("").alias("line")))
    said = said.withColumns({"from": F.struct("ts", "line"), "until": F.lead(F.struct("ts", "line")).over(w), "second": intdiv(F.col("total_ms"), 1000)})
    opens = rows.where("open_no > 0").groupBy(device, "open_no").agg(
        F.max("takes").alias("taken"), F.min(F.when(F.col("opened_ms").isNotNull(), F.struct("ts", "line", "opened_ms"))).alias("open"), F.max(F.col("metric.kind") == "page").alias("paged")
    )
    nxt = F.lead(F.struct("open.ts", "open.line")).over(Window.partitionBy(device).orderBy("open_no"))
    opens = opens.withColumn("given_up", nxt).where("not taken and paged and open.opened_ms > 0").withColumn("second", intdiv(F.col("open.opened_ms"), 1000))
    met = opens.join(said.select(device, "second", "position", "from", "until"), [device, "second"])
    in_force = (F.col("given_up").isNull() | (F.col("from") < F.col("given_up"))) & (F.col("until").isNull() | (F.col("given_up").isNotNull() & (F.col("until") >= F.col("given_up"))))
    return met.where(in_force).groupBy(device, "open_no").agg(F.min("position").alias("named"), F.max("position").alias("__last")).where("named = __last").drop("__last")


def read_rows(lines: DataFrame, device: str = "device", held: DataFrame | None = None, counters: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """``lines`` (see ``sources.logs.observations``) with what stands around each in its device's log, by stamp and line.

    ``observed`` and ``reads`` (a page or turn metric) tell what a line is; ``gap_no`` counts the jumps of the clock (over
    30 minutes on or 60 seconds back) between any lines but power changes; ``asleep`` is the seconds slept so far, over
    sleeps that end, ``sleeps`` how many began; ``opened`` and ``wake`` are the open and the wake that no observation
    has taken yet. All windows share one shuffle by device, into ``n`` tasks (as many as give each
    LINES_A_TASK lines), as a task's sorts keep its lines in memory while they can.
    """
    n = n or tasks(lines, LINES_A_TASK)
    w = Window.partitionBy(device).orderBy("ts", "line")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    rows = without_chapters(lines.repartition(n, device), device, n)
    rows = rows.withColumn("held_book", F.lit(None).cast("long"))
    if held is not None:
        at_wake = held.groupBy(device, F.col("started_at").alias("ts")).agg(F.min("end_position").alias("of"))
        rows = beside(rows, at_wake, [device, "ts"], n, device).withColumn("held_book", F.when(F.col("wakes"), F.col("of"))).drop("of")
    kind = F.col("metric.kind")
    rows = rows.withColumns({"observed": F.col("position").isNotNull(), "reads": F.coalesce(kind.isin("page", "forward", "back"), F.lit(False)), "t": _secs(F.col("ts"))})
    moves = F.when(F.col("power").isNull(), F.col("t"))
    gap = F.coalesce(broken(F.col("t") - F.last(moves, True).over(before)), F.lit(False)) & F.col("power").isNull()
    # one family of power lines: the metrics where the device has any
    whole = Window.partitionBy(device)
    family = F.max(F.when(F.col("power").isNotNull(), F.col("power_metric"))).over(whole)
    rows = rows.withColumns({"gap_no": F.sum(gap.cast("long")).over(upto), "state": F.when(F.col("power_metric") == family, F.col("power"))})
    was = F.last("state", True).over(before)
    turns = F.col("state").isNotNull() & (was.isNull() | (was != F.col("state")))
    rows = rows.withColumns({"turned": F.when(turns, F.struct("state", "t"))}).withColumn("since", F.last("turned", True).over(upto))
    last_turn = F.last("turned", True).over(before)
    slept = F.when(F.col("turned.state") == "active", F.when(last_turn["state"] == "idle", F.greatest(F.col("t") - last_turn["t"], F.lit(0))))
    rows = rows.withColumns({"slept": slept, "ends": F.max(F.when(F.col("turned.state") == "active", F.col("t"))).over(w.rowsBetween(1, Window.unboundedFollowing))})
    sleeping = (F.col("since.state") == "idle") & F.col("ends").isNotNull()
    rows = rows.withColumns({
        "asleep": F.coalesce(F.sum("slept").over(upto), F.lit(0)) + F.when(sleeping, F.greatest(F.col("t") - F.col("since.t"), F.lit(0))).otherwise(0),
        "sleeps": F.sum(F.coalesce((F.col("turned.state") == "idle") & F.col("ends").isNotNull(), F.lit(False)).cast("long")).over(upto),
        "obs_no": F.coalesce(F.sum(F.col("observed").cast("long")).over(before), F.lit(0)), "open_no": F.sum(F.col("opened_ms").isNotNull().cast("long")).over(upto), "wake_no": F.sum(F.col("wakes").cast("long")).over(upto),
    })
    # an observation takes the last open: with a counter always, without one on the same day within a gap
    last_open = F.last(F.when(F.col("opened_ms").isNotNull(), F.struct("opened_ms", "ts", "t", "asleep", "open_no")), True).over(upto)
    rows = rows.withColumn("open", last_open)
    since = F.col("t") - F.col("open.t")
    takes = F.col("observed") & F.col("open").isNotNull() & (F.col("total_ms").isNotNull() | ((F.to_date("open.ts") == F.to_date("ts")) & since.between(0, GAP)))
    rows = rows.withColumn("takes", F.coalesce(takes, F.lit(False)))
    taken = F.max(F.when(F.col("takes"), F.col("open_no"))).over(before)
    rows = rows.withColumn("opened", F.when(taken.isNull() | (taken < F.col("open_no")), F.col("open")))
    rows = beside(rows, named_opens(rows, counters, device), [device, "open_no"], n, device)
    # a wake stands until an observation or an open; it lapses if the clock jumps once something was read after it
    last_wake = F.last(F.when(F.col("wakes"), F.struct("ts", "t", "asleep", "sleeps", "obs_no", "open_no", "gap_no", "held_book")), True).over(upto)
    after = Window.partitionBy(device, "wake_no").orderBy("ts", "line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"last_wake": last_wake, "read_gap": F.first(F.when(F.col("reads"), F.col("gap_no")), True).over(after)})
    k = F.col("last_wake")
    stands = (
        (k["obs_no"] == F.col("obs_no")) & (k["open_no"] == F.col("open_no")) & (F.to_date(k["ts"]) == F.to_date("ts")) & (F.col("t") >= k["t"])
        & (k["sleeps"] == F.col("sleeps")) & (F.col("asleep") - k["asleep"] <= WAKE_LAG) & F.coalesce(F.col("gap_no") == F.col("read_gap"), F.lit(True))
    )
    return rows.withColumn("wake", F.when(stands, k)).drop("open", "last_wake", "read_gap", "turned", "since", "slept", "ends", "wake_no")


def numbered(rows: DataFrame, device: str = "device") -> DataFrame:
    """``rows`` with ``no``, the sitting that each belongs to, and on a sitting's first row how it ``starts`` and when it ``began``.

    A sitting ends where the book changes, the book was closed, the clock jumped or the day changes. It begins at the
    open or the wake that stands before it, at midnight if it goes on from the day before, else at its first line.
    Metrics name no book: they go to the sitting that is read on within a gap, else to the next that begins before them.
    A page metric after midnight cuts the sitting it goes to, and one after a wake begins a sitting of the book left open.
    Metrics after an open that no line takes are a sitting of the book that the open's counter names, if there is one.
    """
    w = Window.partitionBy(device).orderBy("ts", "line")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    reading = F.col("observed") | F.col("reads")
    far = F.coalesce(broken(F.col("t") - F.last(F.when(reading, F.col("t")), True).over(before)), F.lit(False))
    last_obs = F.last(F.when(F.col("observed"), F.struct("position", "closes", "gap_no", "open_no", "total_ms")), True).over(before)
    since_open = Window.partitionBy(device, "open_no").orderBy("ts", "line")
    named = F.col("reads") & F.col("named").isNotNull()
    at_counter = named & (F.sum(named.cast("long")).over(since_open.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    rows = rows.withColumns({"far": far, "at_counter": F.coalesce(at_counter, F.lit(False)), "counted_on": F.coalesce(named & ~at_counter, F.lit(False))})
    rows = rows.withColumns({"chain": F.sum((reading & F.col("far")).cast("long")).over(upto), "left": last_obs})
    held = F.col("left").isNotNull() & ~F.col("left.closes") & (F.col("left.open_no") == F.col("open_no"))
    lent = F.col("left").isNull() & F.col("wake.held_book").isNotNull()  # a batch that reads from a wake on knows its book from the held sitting
    begins = F.col("reads") & F.col("wake").isNotNull() & F.coalesce((held & (F.col("left.gap_no") < F.col("gap_no"))) | lent, F.lit(False))
    rows = rows.withColumns({"held": F.coalesce(held, F.lit(False)), "begins": (F.coalesce(begins, F.lit(False)) & F.col("named").isNull()) | F.col("at_counter")})
    inside = Window.partitionBy(device, "chain").orderBy("ts", "line").rowsBetween(Window.unboundedPreceding, -1)
    joined = F.coalesce(F.max(F.col("observed") | F.col("begins")).over(inside), F.lit(False))
    day_before = F.last(F.when(reading, F.to_date("ts")), True).over(inside)
    begun = F.coalesce(F.max("begins").over(inside), F.lit(False)) & F.col("left").isNull()
    rows = rows.withColumn("live", F.when(F.col("named").isNotNull(), F.col("counted_on")).otherwise(((F.col("held") & joined) | begun) & ~F.col("far")))
    rows = rows.withColumns({"begins": F.col("begins") & ~F.col("live"), "passes": F.col("reads") & F.col("live") & ~F.col("counted_on") & (day_before < F.to_date("ts"))})
    anchors = F.col("observed") | F.col("begins") | F.col("passes")
    book = F.coalesce("position", F.when(F.col("reads"), F.col("named")), "left.position", "wake.held_book", F.last("wake.held_book", True).over(inside))
    anchor = F.last(F.when(anchors, F.struct(book.alias("position"), F.when(F.col("observed"), F.col("closes")).otherwise(False).alias("closes"), "gap_no", F.to_date("ts").alias("day"))), True).over(before)
    rows = rows.withColumns({"book": book, "anchor": anchor})
    p = F.col("anchor")
    left = p.isNull() | p["closes"] | (p["position"] != F.col("position")) | (p["gap_no"] != F.col("gap_no"))
    goes_on = ~left & (p["day"] != F.to_date("ts"))
    starts = F.col("begins") | F.col("passes") | (F.col("observed") & (left | goes_on))
    rows = rows.withColumns({"starts": F.coalesce(starts, F.lit(False)), "goes_on": F.coalesce(F.col("observed") & goes_on, F.lit(False))}).withColumn("own_no", F.sum(F.col("starts").cast("long")).over(upto))
    # a counter before and after midnight is shared out; without one the day's change is an end like others
    counter = F.last(F.when(F.col("observed"), F.struct("own_no", "total_ms")), True).over(before)
    stated = F.last(F.when(F.col("observed") & F.col("total_ms").isNotNull(), F.struct("own_no", "total_ms", "words", "t")), True).over(before)
    rows = rows.withColumn("before", F.when(stated["own_no"] == counter["own_no"], stated))
    midnight = F.col("goes_on") & F.col("before").isNotNull() & F.col("total_ms").isNotNull()
    o = F.col("opened")
    gain = F.col("total_ms") - o["opened_ms"]
    vouched = F.col("observed") & (F.to_date(o["ts"]) == F.to_date("ts")) & gain.between(0, (F.col("t") - o["t"] + SLACK) * 1000)
    floored = F.col("observed") & F.col("total_ms").isNull() & F.col("takes") & o.isNotNull()
    how = (
        F.when(midnight, "midnight").when(F.col("passes"), "passed").when(F.col("at_counter"), "floor").when(F.col("begins"), "wake").when(vouched, "open").when(floored, "floor")
        .when(F.col("observed") & F.col("wake").isNotNull(), "wake").otherwise("line")
    )
    rows = rows.withColumn("how", F.when(F.col("starts"), how))
    at_open, at_wake = F.col("how").isin("open", "floor"), F.col("how") == "wake"
    at_midnight = F.col("how").isin("midnight", "passed")
    began = F.when(at_open, o["ts"]).when(at_wake, F.col("wake.ts")).when(at_midnight, _midnight(F.col("ts"))).otherwise(F.col("ts"))
    slept = F.when(at_open, o["asleep"]).when(at_wake, F.col("wake.asleep")).otherwise(F.col("asleep"))
    rows = rows.withColumns({"began": F.when(F.col("starts"), began), "began_asleep": F.when(F.col("starts"), slept), "read_ms": F.when(at_open, o["opened_ms"]), "read_t": F.when(at_open, o["t"])})
    event = F.when(F.col("observed") | F.col("begins"), F.struct("own_no", "starts", "began"))
    nxt = F.first(event, True).over(w.rowsBetween(1, Window.unboundedFollowing))
    pended = F.when(~nxt["starts"] | (F.col("ts") >= nxt["began"]), nxt["own_no"])
    no = F.when(F.col("observed") | F.col("begins") | F.col("live"), F.col("own_no")).otherwise(pended)
    rows = rows.withColumn("no", no).where("no > 0")
    rows = rows.withColumn("book", F.max(F.when(F.col("starts"), F.col("book"))).over(Window.partitionBy(device, "no")))
    return rows.drop("far", "own_no", "live", "held", "left", "anchor", "goes_on", "opened", "wake", "chain", "begins", "passes", "named", "at_counter", "counted_on")


def _pages(rows: DataFrame, device: str) -> DataFrame:
    """``rows`` with what the page that a metric opened earned, until the next page of the sitting closes it.

    A page counts as long as it stood less what was slept meanwhile, with floor and cap; a close earns nothing, and a
    page that is drawn again leaves its words to the next.
    """
    inside = Window.partitionBy(device, "no").orderBy("ts", "line").rowsBetween(1, Window.unboundedFollowing)
    page = F.col("metric.kind") == "page"
    closing = F.first(F.when(F.col("metric.kind").isin("page", "close"), F.struct("metric", "t", "asleep")), True).over(inside)
    rows = rows.withColumn("closing", F.when(page, closing))
    c = F.col("closing")
    stood = F.greatest(c["t"] - F.col("t") - (c["asleep"] - F.col("asleep")), F.lit(0))
    earned = F.when(page & (c["metric"]["kind"] == "page"), dwell(stood)).otherwise(0)
    rows = rows.withColumns({"page_secs": earned, "page_end": c["t"]})
    again = F.coalesce((c["metric"]["start"] >= 0) & (c["metric"]["start"] == F.col("metric.start")), F.lit(False))
    counts = (F.col("page_secs") > 0) & ~again
    span = F.abs(F.col("metric.end") - F.col("metric.start")) / F.col("book")
    sized = (F.col("book") > 0) & (F.col("metric.start") >= 0) & (F.col("metric.end") >= 0)
    return rows.withColumns({"page_words": F.when(counts, F.col("metric.words")).otherwise(0), "page_span": F.when(counts & sized, span).otherwise(0.0)}).drop("closing")


def stretches(points: Column) -> Column:
    """``array<struct<from,to>>`` of ordered ``points`` (at, jumped): a jump ends a stretch where the reader was; one without a turn is none."""
    none = F.expr("named_struct('done', cast(array() as array<struct<from:double,to:double>>), 'from', cast(null as double), 'to', cast(null as double), 'turned', false)")

    def step(acc: Column, x: Column) -> Column:
        ended = F.when(acc["turned"], F.concat(acc["done"], F.array(F.struct(acc["from"].alias("from"), acc["to"].alias("to"))))).otherwise(acc["done"])
        fresh = acc["from"].isNull() | x["jumped"]
        return F.struct(
            F.when(x["jumped"], ended).otherwise(acc["done"]).alias("done"), F.when(fresh, x["at"]).otherwise(acc["from"]).alias("from"), x["at"].alias("to"),
            (~x["jumped"]).alias("turned"),
        )

    return F.aggregate(points, none, step, lambda acc: F.when(acc["turned"], F.concat(acc["done"], F.array(F.struct(acc["from"].alias("from"), acc["to"].alias("to"))))).otherwise(acc["done"]))


def _folded(rows: DataFrame, device: str) -> DataFrame:
    """One row a sitting: everything that its own lines state."""
    inside = Window.partitionBy(device, "no").orderBy("ts", "line")
    rows = rows.withColumn("seen", F.sum(F.col("observed").cast("long")).over(inside))
    how = F.first("how", True).over(inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    credit = credits(F.col("total_ms"), F.col("interval_ms"), F.col("interval_words"), F.col("refused"), F.col("closes"))
    first = F.col("observed") & (F.col("seen") == 1)
    rows = rows.withColumn("credit", F.when(F.col("observed") & ~(first & (how == "line")), credit))
    obs, counted = F.col("observed"), F.col("observed") & F.col("total_ms").isNotNull()
    c = lambda name: F.coalesce(F.col(f"credit.{name}"), F.lit(0))
    timed = c("counted_ms") + c("refused_ms")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    last_t = F.last(F.when(obs, F.col("t")), True).over(before)
    last_ms = F.last(F.when(counted, F.col("total_ms")), True).over(before)
    rows = rows.withColumns({"last_t": last_t, "gained": F.when(counted, F.col("total_ms") - last_ms), "turned": F.when(obs, timed)})
    order = F.struct("ts", "line")
    span = lambda a, b, ms: F.struct(a.alias("a"), b.alias("b"), ms.cast("long").alias("ms"))
    start_t = F.coalesce(F.col("last_t"), _secs(F.col("began")), F.col("t"))
    at = F.struct("total_ms", "words", "t", "asleep", c("counted_ms").alias("credit_ms"), c("counted_words").alias("credit_words"))
    when = lambda test, x: F.when(test, x)
    point = F.struct("ts", "line", (1 - F.col("left_share")).alias("at"), "jumped")
    last = lambda name: F.max_by(name, F.when(F.col(name).isNotNull(), order))
    return rows.groupBy(device, "no").agg(
        F.first("book", True).alias("end_position"), F.first("how", True).alias("how"), F.min("began").alias("began"), F.first("began_asleep", True).alias("began_asleep"),
        F.first("read_ms", True).alias("read_ms"), F.first("read_t", True).alias("read_t"),
        F.min_by(at, when(counted, order)).alias("first_stated"), F.max_by(at, when(counted, order)).alias("last_stated"),
        F.min(when(counted, F.col("total_ms"))).alias("lo"), F.max(when(counted, F.col("total_ms"))).alias("hi"),
        F.min(when(obs, F.col("words"))).alias("words_lo"), F.max(when(obs, F.col("words"))).alias("words_hi"),
        F.max_by(F.struct("ts", "t", "asleep"), when(obs, order)).alias("last_obs"), F.max_by(F.struct("ts", "t", "asleep"), when(obs | F.col("reads"), order)).alias("last_seen"),
        F.min_by(F.struct("t", timed.alias("timed")), when(obs, order)).alias("first_obs"),
        F.count_if(obs & F.col("page_turn")).alias("obs_turns"), F.count_if(F.col("metric.kind") == "forward").alias("metric_turns"),
        F.sum(timed).alias("timed_ms"), F.sum(when(timed > 0, F.greatest(F.coalesce("interval_words", F.lit(0)), F.lit(0)))).alias("timed_words"),
        F.sum("page_secs").alias("paged"), F.sum("page_words").alias("paged_words"), F.sum("page_span").alias("covered"),
        last("content_key").alias("content_key"), last("left_share").alias("left_share"), last("time_left").alias("time_left"), last("stated_wpm").alias("stated_wpm"),
        F.collect_list(when(F.col("gained") > 0, span(F.col("last_t"), F.col("t"), F.col("gained")))).alias("counted_spans"), F.collect_list(when(F.col("turned") > 0, span(start_t, F.col("t"), F.col("turned")))).alias("timed_spans"),
        F.collect_list(when(F.col("page_secs") > 0, span(F.col("t"), F.col("page_end"), F.col("page_secs") * 1000))).alias("paged_spans"),
        stretches(F.sort_array(F.collect_list(when(obs & F.col("left_share").isNotNull(), point)))).alias("stretches"),
    )


def _settled(sat: DataFrame, device: str, held: DataFrame | None, counters: DataFrame | None = None) -> DataFrame:
    """Sittings with their counters: what an open, a wake, a midnight or a late statement of the book makes of them.

    A sitting without page turns that is read on after its last counter is owing: the next sitting of the book that states
    one shares the gain that no line stated out over the owing ones, by the seconds they were awake, and the last takes
    the rest. Windows run over sittings of a device and of a book in it.
    """
    by_device = Window.partitionBy(device).orderBy("no")
    w = Window.partitionBy(device, "end_position").orderBy("no")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    ends = F.when((F.col("obs_turns") == 0) | F.col("last_obs").isNull(), F.col("last_seen")).otherwise(F.col("last_obs"))
    sat = sat.withColumns({"end": F.coalesce(ends, F.struct(F.col("began").alias("ts"), _secs(F.col("began")).alias("t"), F.col("began_asleep").alias("asleep"))), "began_t": _secs(F.col("began"))})
    nxt = F.lead(F.struct("how", "began_t", "began", "first_obs", F.col("first_stated.total_ms").alias("total_ms"), F.col("first_stated.words").alias("words"))).over(by_device)
    sat = sat.withColumn("nxt", nxt)
    # midnight: counters by the clock on either side
    over = lambda a, x: share(F.greatest(a, F.lit(0)), x["began_t"] - F.col("last_obs.t"), x["first_obs"]["t"] - F.col("last_obs.t"))
    n = F.col("nxt")
    is_cut = n["how"].isin("midnight", "passed")
    cut_ms = F.when(n["how"] == "midnight", F.col("last_stated.total_ms") + over(n["total_ms"] - F.col("last_stated.total_ms"), n))
    cut_words = F.when(n["how"] == "midnight", F.col("last_stated.words") + over(n["words"] - F.col("last_stated.words"), n))
    cut_timed = F.when(n["how"] == "midnight", over(n["first_obs"]["timed"], n)).otherwise(0)
    sat = sat.withColumns({"cut_ms": cut_ms, "cut_words": cut_words, "cut_timed": F.coalesce(cut_timed, F.lit(0)), "is_cut": F.coalesce(is_cut, F.lit(False))})
    carried = F.lag(F.struct("cut_ms", "cut_words", "cut_timed")).over(by_device)
    sat = sat.withColumn("carried", F.when(F.col("how") == "midnight", carried))
    # the book's latest counter, and the sittings that owe since
    states = F.col("last_stated").isNotNull()
    owing = ~F.coalesce(F.col("nxt.how") == "midnight", F.lit(False)) & (F.col("obs_turns") == 0) & (~states | (F.col("last_seen.t") > F.col("last_stated.t")))
    stated, since = F.last("last_stated", True).over(before), F.last("last_stated", True).over(w)
    sat = sat.withColumn("stated_here", stated)
    if counters is not None:
        kind = sat.schema["last_stated"].dataType.simpleString()
        zero = F.lit(0).cast("long")
        prior = F.struct("total_ms", "words", _secs(F.col("ts")).alias("t"), zero.alias("asleep"), zero.alias("credit_ms"), zero.alias("credit_words")).cast(kind)
        sat = sat.join(counters.select(device, F.col("position").alias("end_position"), prior.alias("prior")), [device, "end_position"], "left")
        stated, since = F.coalesce(stated, "prior"), F.coalesce(since, "prior")
    sat = sat.withColumns({"owing": owing, "stated": stated, "since": since, "group": F.sum(states.cast("long")).over(w)})
    from_t, from_asleep = F.greatest("began_t", "since.t"), F.when(F.coalesce(F.col("since.t") > F.col("began_t"), F.lit(False)), F.col("since.asleep")).otherwise(F.col("began_asleep"))
    awake = F.greatest(F.col("end.t") - from_t - (F.col("end.asleep") - from_asleep), F.lit(0))
    sat = sat.withColumn("weight", F.when(F.col("owing"), awake).otherwise(0))
    groups = Window.partitionBy(device, "end_position", "group")
    sat = sat.withColumns({"owed": F.sum("weight").over(groups), "n_owing": F.count_if(F.col("owing")).over(groups)})
    sat = sat.withColumn("owed_before", F.when(states, F.coalesce(F.last(F.struct("group", "owed"), False).over(before)["owed"], F.lit(0))).otherwise(0))
    # a floor settles at the first counted line
    f, s = F.col("first_stated"), F.col("stated")
    lent_ms, lent_words = F.lit(None).cast("long"), F.lit(None).cast("long")
    if held is not None:
        opened = held.groupBy(device, "end_position", F.col("started_at").alias("began")).agg(F.first("start_counter_ms", True).alias("lent_ms"), F.first("start_words", True).alias("lent_words"))
        sat = sat.join(opened, [device, "end_position", "began"], "left")
        lent_ms, lent_words = F.col("lent_ms"), F.col("lent_words")
    # what these lines state, then what the sitting was held with, then what earlier lines stated
    here, at_wake = F.col("stated_here"), F.col("how").isin("wake", "passed")
    floor_ms = F.when(F.col("how") == "floor", F.col("read_ms")).when(at_wake, F.coalesce(here["total_ms"], lent_ms, s["total_ms"]))
    floor_words = F.when(at_wake, F.when(here.isNotNull(), here["words"]).when(lent_ms.isNotNull(), lent_words).otherwise(s["words"]))
    step = F.when(F.col("how") == "floor", 1000).otherwise(1)
    after = F.greatest(f["t"] - F.col("began_t") - (f["asleep"] - F.col("began_asleep")), F.lit(0))
    owed = F.when(F.col("how") == "floor", 0).otherwise(F.col("owed_before"))
    unseen = f["total_ms"] - f["credit_ms"] - floor_ms
    fits = F.coalesce((unseen >= 0) & (unseen <= (owed + after + SLACK) * 1000), F.lit(False))
    ours = lambda x: F.when(unseen < step, 0).when(owed + after == 0, x).otherwise(intdiv(x * after, F.greatest(owed + after, F.lit(1))))
    unseen_words = f["words"] - f["credit_words"] - floor_words
    beside = (F.col("how") == "open") & (intdiv(s["total_ms"], 1000) == intdiv(F.col("read_ms"), 1000))  # words that stood beside the counter an open restates
    words_fit = fits & F.coalesce(unseen_words >= 0, F.lit(False))
    sat = sat.withColumns({
        "lo0": F.when(F.col("how") == "open", F.col("read_ms")).when(F.col("how") == "midnight", F.col("carried.cut_ms")).when(fits, f["total_ms"] - f["credit_ms"] - ours(unseen)).otherwise(f["total_ms"] - f["credit_ms"]),
        "words0": F.when(F.col("how") == "midnight", F.col("carried.cut_words")).when(words_fit, f["words"] - f["credit_words"] - ours(unseen_words)).when(beside, s["words"]).otherwise(f["words"] - f["credit_words"]),
        "left_ms": F.when(fits & (unseen >= step), unseen - ours(unseen)), "left_words": F.when(words_fit & (unseen >= step), unseen_words - ours(unseen_words)),
    })
    reread = F.col("read_ms") - s["total_ms"]
    reread = F.when((F.col("how") == "open") & reread.between(1000, (F.col("owed_before") + SLACK) * 1000), reread)
    # what a sitting leaves to those that owe before it
    leaves = F.when(states, F.struct("group", F.coalesce("left_ms", reread, F.lit(0)).alias("ms"), "left_words"))
    sat = sat.withColumn("gain", F.first(leaves, True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    of = Window.partitionBy(device, "end_position", "group", "owing").orderBy("no")
    earlier = of.rowsBetween(Window.unboundedPreceding, -1)
    is_last = F.row_number().over(of) == F.col("n_owing")
    part = lambda x: F.when(F.col("owed") > 0, intdiv(x * F.col("weight"), F.greatest("owed", F.lit(1)))).otherwise(0)
    sat = sat.withColumns({"part_ms": part(F.col("gain.ms")), "part_words": part(F.col("gain.left_words")), "is_last": is_last})
    given = {name: F.coalesce(F.sum(name).over(earlier), F.lit(0)) for name in ("part_ms", "part_words")}
    sat = sat.withColumns({"given_ms": given["part_ms"], "given_words": given["part_words"]})
    top = lambda whole, part, given: F.when(F.col("owing"), F.coalesce(F.when(F.col("is_last"), whole - given).otherwise(part), F.lit(0))).otherwise(0)
    sat = sat.withColumns({"top_ms": top(F.col("gain.ms"), F.col("part_ms"), F.col("given_ms")), "top_words": top(F.col("gain.left_words"), F.col("part_words"), F.col("given_words"))})
    topped = F.col("top_ms") > 0
    lo = F.coalesce(F.least("lo0", "lo"), F.when(topped, F.col("since.total_ms") + F.col("given_ms")))
    wlo = F.coalesce(F.least("words0", "words_lo"), F.when(topped & (F.col("top_words") > 0), F.col("since.words") + F.col("given_words")))
    sat = sat.withColumns({"start_counter_ms": lo, "start_words": wlo})
    return sat.withColumns({
        "end_counter_ms": F.greatest("start_counter_ms", "hi", "cut_ms") + F.col("top_ms"), "end_words": F.greatest("start_words", "words_hi", "cut_words") + F.when(topped, F.col("top_words")).otherwise(0),
        "timed_ms": F.col("timed_ms") + F.col("cut_timed") - F.least(F.coalesce("carried.cut_timed", F.lit(0)), F.coalesce("first_obs.timed", F.lit(0))),
    })


def hours_of(spans: Column, seconds: Column, awake: Column | None = None) -> Column:
    """``array<struct<h,s>>`` that adds up to ``seconds``: milliseconds of ``spans`` (a, b, ms) over the clock hours they ran through.

    A span is first shared over the parts of ``awake`` (a and b, in order) inside it, if there are any. Each part is spread
    evenly and its first hour takes what is left over; hours become seconds by the truncated running sum, and the
    busiest takes the rest. What lies past the midnight after a span's start counts at that midnight.
    """
    if awake is not None:
        spans = F.flatten(F.transform(spans, lambda x: F.transform(shared_over(awake, x["a"], x["b"], x["ms"]), lambda p: F.struct((x["a"] - F.pmod(x["a"], F.lit(86_400))).alias("day"), p["a"].alias("a"), p["b"].alias("b"), p["ms"].alias("ms")))))
        clip = lambda at, x: F.least(F.greatest(at - x["day"], F.lit(0)), F.lit(86_400))
        inside = F.flatten(F.transform(spans, lambda x: spread_over(x["ms"], clip(x["a"], x), clip(x["b"], x))))
    else:
        inside = F.flatten(F.transform(spans, lambda x: spread_over(x["ms"], F.pmod(x["a"], F.lit(86_400)), F.pmod(x["a"], F.lit(86_400)) + F.greatest(x["b"] - x["a"], F.lit(0)))))
    total = lambda h: F.aggregate(F.filter(inside, lambda x: x["h"] == h), F.lit(0).cast("long"), lambda a, x: a + x["s"])
    start = F.expr("named_struct('run', 0L, 'given', 0L, 'out', cast(array() as array<struct<h:int,s:bigint>>))")

    def whole(acc: Column, h: Column) -> Column:
        run = acc["run"] + total(h)
        secs = intdiv(run, 1000) - acc["given"]
        return F.struct(run.alias("run"), (acc["given"] + secs).alias("given"), F.when(secs > 0, F.concat(acc["out"], F.array(F.struct(h.alias("h"), secs.alias("s"))))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(23)), start, whole, lambda acc: F.transform(acc["out"], lambda x, i: F.struct(x["h"].alias("h"), (x["s"] + F.when(i == busiest(acc["out"]), seconds - acc["given"]).otherwise(0)).alias("s"))))


def awake_spans(rows: DataFrame, device: str = "device") -> DataFrame:
    """``(device, from_at, to_at)``: when the device was awake and something was read (rows of ``read_rows``).

    A span runs from a wake to the next sleep; before the first sleep there is one if the reading ran on unbroken to it.
    Spans that nothing was read in are dropped, so is an open last one.
    """
    w = Window.partitionBy(device).orderBy("ts", "line")
    mark = F.col("observed") | F.col("metric.kind").isNotNull()
    some = rows.where(mark | F.col("state").isNotNull()).select(device, "ts", "line", "t", mark.alias("mark"), "state")
    was = F.last("state", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    some = some.withColumn("turn", F.col("state").isNotNull() & (was.isNull() | (was != F.col("state"))))
    some = some.withColumn("span", F.sum(F.col("turn").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(device, "span").orderBy("ts", "line")
    far = F.coalesce(F.col("t") - F.lag("t").over(inside) > GAP, F.lit(False))
    spans = some.withColumn("far", far).groupBy(device, "span").agg(F.first(F.when(F.col("turn"), F.col("state")), True).alias("state"), F.min("ts").alias("from_at"), F.max("t").alias("last_t"), F.max("mark").alias("read"), F.max("far").alias("far"))
    order = Window.partitionBy(device).orderBy("span")
    spans = spans.withColumns({"to_at": F.lead("from_at").over(order), "then": F.lead("state").over(order)})
    # ahead of the first change, if that is a sleep
    lead = (F.col("span") == 0) & (F.col("then") == "idle") & ~F.col("far") & (_secs(F.col("to_at")) - F.col("last_t") <= GAP)
    return spans.where(F.col("to_at").isNotNull() & F.col("read") & (lead | (F.col("state") == "active"))).select(device, "from_at", "to_at")


def sittings(lines: DataFrame, device: str = "device", held: DataFrame | None = None, counters: DataFrame | None = None) -> DataFrame:
    """Sittings of each device from its observations (see ``sources.logs``), in order of stamp and line.

    Seconds are the first of four measures that has any: ``counted``, the span of the book's counter with what late
    statements add; ``timed``, the pages that the counter took or that were read at a fair rate; ``paged``, how long
    page metrics stood; ``awake``, how long the device was awake. Sittings without seconds are dropped.

    The work is windows over one shuffle by device and, on the far fewer sittings, by device and book; a device's log
    is sorted with spilling and never held whole. Rows with the same stamp and line count once each; null stamps are
    left out; an empty log gives no sittings. ``held`` are sittings that ``lines`` restate: one that opens at a wake
    lends the book and counter that lines before the wake stated. ``counters`` (device, position, total_ms, words, ts: one row a book)
    are what lines before these stated last; the first of these lines go on from them.
    """
    n = tasks(lines, LINES_A_TASK)
    rows = read_rows(lines, device, held, counters, n)
    sat = _settled(_folded(_pages(numbered(rows, device), device), device), device, held, counters)
    sat = sat.withColumns({"counted": intdiv(F.col("end_counter_ms") - F.col("start_counter_ms"), 1000), "timed": intdiv(F.col("timed_ms"), 1000), "ended_at": F.when(F.col("is_cut"), F.date_add(F.to_date("last_seen.ts"), 1).cast("timestamp_ntz") - F.expr("interval 1 second")).otherwise(F.col("end.ts"))})
    sat = sat.withColumns({"id": F.struct(device, "no"), "end_at": F.col("end.ts"), "awake_seconds": F.greatest(F.col("end.t") - F.col("began_t") - (F.col("end.asleep") - F.col("began_asleep")), F.lit(0))})
    sat = spans_inside(sat.withColumn("until", F.greatest("end_at", "ended_at")), pinned(awake_spans(rows, device)), device, "id", "began", "until", n=n)
    sat = sat.withColumn("overlap", seconds_in(F.col("inside"), F.col("began_t"), F.col("end.t")))
    measure = F.when(F.col("counted") > 0, "counted").when(F.col("timed") > 0, "timed").when(F.col("paged") > 0, "paged").when(F.col("overlap") > 0, "awake")
    sat = sat.withColumn("measure", measure).where("measure is not null")
    seconds = F.when(F.col("measure") == "counted", F.col("counted")).when(F.col("measure") == "timed", F.col("timed")).when(F.col("measure") == "paged", F.col("paged")).otherwise(F.col("overlap"))
    # what stands around the lines: from the start to the first counter, to a midnight, and what came late
    edge = lambda a, b, ms: F.array(F.struct(a.alias("a"), b.alias("b"), F.coalesce(F.greatest(ms, F.lit(0)), F.lit(0)).cast("long").alias("ms")))
    day_end = F.col("last_obs.t") - F.pmod("last_obs.t", F.lit(86_400)) + 86_400
    spans = (
        F.when(F.col("measure") == "counted", F.concat(
            edge(F.col("began_t"), F.col("first_stated.t"), F.col("first_stated.total_ms") - F.col("start_counter_ms")), "counted_spans",
            edge(F.col("last_obs.t"), day_end, F.col("cut_ms") - F.col("last_stated.total_ms")), edge(F.coalesce("last_stated.t", "began_t"), F.col("end.t"), F.col("top_ms")),
        )).when(F.col("measure") == "timed", F.concat("timed_spans", edge(F.col("last_obs.t"), day_end, F.col("cut_timed"))))
        .when(F.col("measure") == "paged", F.col("paged_spans")).otherwise(edge(F.col("began_t"), F.col("end.t"), F.col("overlap") * 1000))
    )
    sat = sat.withColumn("seconds", seconds.cast("long"))
    return sat.select(
        device, F.col("began").alias("started_at"), "ended_at", "end_position", "seconds", F.when(F.col("obs_turns") > 0, F.col("obs_turns")).otherwise(F.col("metric_turns")).alias("page_turns"),
        F.coalesce(F.nullif(F.col("end_words") - F.col("start_words"), F.lit(0)), "paged_words").cast("long").alias("words"), "measure", "content_key", (1 - F.col("left_share")).alias("progress"),
        "start_counter_ms", "end_counter_ms", "start_words", "end_words", "time_left", "stated_wpm", "awake_seconds", F.col("paged").cast("long").alias("paged_seconds"), F.col("paged_words").cast("long").alias("paged_words"),
        F.col("timed").alias("timed_seconds"), F.coalesce("timed_words", F.lit(0)).cast("long").alias("timed_words"), "covered", "stretches",
        hours_of(F.filter(spans, lambda x: x["ms"] > 0), F.col("seconds"), F.col("inside")).alias("hours"),
    )


def resume_at(held: DataFrame, watermark: DataFrame, device: str = "device") -> DataFrame:
    """``(device, cut)``: where the next pass starts to read; null reads everything.

    It is the watermark (``watermark`` has device and watermark), but the start of the newest sitting if that ended
    within a gap of the watermark, or later. A sitting cut at midnight starts where its chain over midnights does. A
    column ``reset_at`` of ``watermark`` is a floor.
    """
    w = Window.partitionBy(device, "end_position").orderBy("started_at")
    before = F.lag("ended_at").over(w)
    goes_on = (F.col("started_at") == _midnight(F.col("started_at"))) & (before == F.col("started_at") - F.expr("interval 1 second"))
    rows = held.withColumn("chain", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("first", F.min("started_at").over(Window.partitionBy(device, "end_position", "chain")))
    last = rows.groupBy(device).agg(F.max(F.struct("started_at", "end_position", "ended_at", "first")).alias("s"))
    out = watermark.join(last, device, "left")
    open_ = F.col("watermark").isNull() | (_secs(F.col("watermark")) - _secs(F.col("s.ended_at")) < GAP)
    cut = F.when(F.col("s").isNull(), F.lit(None)).when(open_, F.col("s.first")).otherwise(F.greatest("watermark", "s.first"))
    return out.select(device, (F.greatest(cut, F.col("reset_at")) if "reset_at" in watermark.columns else cut).alias("cut"))


def absorb(held: DataFrame, lines: DataFrame, cuts: DataFrame, device: str = "device", counters: DataFrame | None = None) -> DataFrame:
    """Incremental batch: sittings before each device's cut stay, later ones come from ``lines`` parsed from the cut on.

    What is parsed again is lent the counters and books at which the ``held`` sittings opened, and goes on from ``counters`` (see
    ``sittings``), those that each device's books stood at by its cut. ``cuts`` has one row a
    device; a null cut replaces all that the device holds, a device without a row keeps it and reads all its lines.
    """
    cuts = cuts.withColumn("cut", F.coalesce("cut", F.lit("0001-01-01").cast("timestamp_ntz")))
    fresh = lines.join(cuts, device, "left").where(F.col("cut").isNull() | (F.col("ts") >= F.col("cut"))).drop("cut")
    both = held.join(cuts, device, "left")
    later = both.where(F.col("started_at") >= F.col("cut")).drop("cut")
    parsed = sittings(fresh, device, later, counters)
    old = both.where(F.col("cut").isNull() | (F.col("started_at") < F.col("cut"))).drop("cut")
    return old.unionByName(parsed, allowMissingColumns=True)


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """The growing folder ``path/<device>/…`` as a stream of marker lines."""
    raw = spark.readStream.option("recursiveFileLookup", "true").text(path)
    rows = raw.select(F.left("value", F.lit(65_536)).alias("line"), F.regexp_extract(F.input_file_name(), r"/([^/]+)/[^/]+$", 1).alias("device"))
    return kept(rows)


#: Devices that a batch names up to which their partitions are listed by name; beyond it all are read and joined.
NAMED_DEVICES = 10_000
_STATE = "position long, total_ms long, words long, ts timestamp_ntz, epoch long, device string, day date"


def run_available(spark: SparkSession, path: str, lines_table: str, out_table: str, checkpoint: str) -> None:
    """Read what is new (``AvailableNow``), add its lines to ``lines_table`` and bring the sittings of the devices it names up to date.

    Three tables lie by device, and a batch reads and writes only those of the devices that it names:

    * ``lines_table``, by device and day too: of it the days from the earliest cut on, a gap before the earliest new line or
      the start of the sitting that this line may belong to;
    * ``<out_table>_state``: the last counter that each day's lines state of a book. What days before the cut state comes from here, so
      counters stated only before the cut count without their lines being read again;
    * ``out_table``: the sittings, a version a batch of its devices (see ``read_sittings``).

    Lines are a set and a batch overwrites its own files, so one that runs again after a failure changes nothing; which version of
    a device counts is written last, in ``<out_table>_versions``, so a reader never sees half of one.
    """

    def batch(rows: DataFrame, epoch: int) -> None:
        session = rows.sparkSession
        stamped = rows.dropDuplicates(["device", "line"]).withColumn("at", logline.stamp(F.col("line"))).where("at is not null")
        stamped.withColumn("day", F.to_date("at")).write.mode("overwrite").partitionBy("device", "day").parquet(f"{lines_table}/batch={epoch}")
        added = session.read.schema("line string, at timestamp_ntz, batch long, device string, day date").parquet(lines_table)
        new = added.where(F.col("batch") == epoch)
        named = new.groupBy("device").agg((F.min("at") - F.make_dt_interval(secs=F.lit(GAP))).cast("timestamp_ntz").alias("watermark"), F.min("day").alias("first_day"))
        named = pinned(named)
        devices = [r[0] for r in named.select("device").limit(NAMED_DEVICES + 1).collect()]
        of = F.col("device").isin(devices) if len(devices) <= NAMED_DEVICES else F.lit(True)
        held = read_sittings(session, out_table, epoch).where(of)
        ours = held.join(named.select("device", "watermark"), "device")
        cuts = pinned(resume_at(ours.where(F.col("started_at") <= F.col("watermark")).drop("watermark"), named.select("device", "watermark")))
        first = cuts.agg(F.count_if(F.col("cut").isNull()), F.min(F.to_date("cut"))).first()
        since = F.lit(True) if first[0] or first[1] is None else F.col("day") >= F.lit(first[1])
        read = added.where(of & since).join(cuts, "device").where(F.col("cut").isNull() | (F.col("day") >= F.to_date("cut")))
        fresh = observations(read.select("device", "line", "cut", "day").distinct())
        stated = without_chapters(fresh)
        kept = _table(session, f"{out_table}_state", _STATE).where(of & (F.col("epoch") < epoch))
        last = kept.withColumn("__l", F.max("epoch").over(Window.partitionBy("device", "day"))).where("epoch = __l").drop("__l")
        known = last.join(cuts, "device").where(F.col("day") < F.to_date("cut")).select("device", "position", "total_ms", "words", "ts")
        earlier = last_statements(stated.where(F.col("ts") < F.col("cut")), "device").select("device", "position", "total_ms", "words", "ts")
        counters = known.unionByName(earlier).groupBy("device", "position").agg(F.max_by(F.struct("total_ms", "words", "ts"), "ts").alias("s")).select("device", "position", "s.*")
        result = absorb(ours.drop("watermark"), fresh.drop("cut", "day"), cuts, counters=pinned(counters))
        by_day = last_statements(stated, "device", "day").withColumn("epoch", F.lit(epoch).cast("long"))
        by_day.write.mode("overwrite").partitionBy("epoch", "device", "day").option("partitionOverwriteMode", "dynamic").parquet(f"{out_table}_state")
        result.write.mode("overwrite").partitionBy("device").parquet(f"{out_table}/version={epoch}")
        named.select("device", F.lit(epoch).cast("long").alias("version")).write.mode("overwrite").parquet(f"{out_table}_versions/epoch={epoch}")

    query = stream_lines(spark, path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``; an empty one if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_sittings(spark: SparkSession, out_table: str, before: int | None = None) -> DataFrame:
    """The sittings of every device as of its last version (before batch ``before``); only those versions' folders are read."""
    versions = _table(spark, f"{out_table}_versions", "device string, version long, epoch long")
    if before is not None:
        versions = versions.where(F.col("epoch") < before)
    last = versions.groupBy("device").agg(F.max("version").alias("version"))
    rows = _table(spark, out_table, f"{SITTING}, version long")
    return rows.join(last, ["device", "version"]).select(rows.drop("version").columns)
