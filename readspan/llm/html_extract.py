"""Main text of web pages: host-wide repeated runs found with suffix arrays, and the marks pages give themselves."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readspan.llm.common import folder

#: Tokens from which a run that repeats on distinct pages of a host is boilerplate.
RUN = 8
_SEP = "\x1f"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(script|style|noscript|template|textarea|select|svg|iframe|object)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*(?:>.*?(?:</\1\s*>|$)|$)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|$)|([^<]+|<)",
    re.S | re.I,
)
_NAMES = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MAIN = frozenset(("article", "main"))
_ASIDE = frozenset("nav header footer aside form button dialog menu head title".split())
#: A class, id or role marks what isn't the article if it is one of these words, or if its first or last part (split at - and _) is.
_MARKS = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies contentinfo footer header menu nav navbar navigation newsletter notice popup promo related "
    "search share sharing sidebar social sponsor sponsored subscribe toolbar widget complementary".split()
)
#: Not so if one of these is a part of it: "has-sidebar" says what stands beside.
_BESIDE = frozenset("has no not non with without".split())
#: These end an open paragraph, whose end tag may be left out.
_BLOCKS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


def blocks(page: str) -> list[tuple[str, int, str]]:
    """A page's blocks in order: (text, state, path). State 1: in the article; 0: in a marked other part; -1: undecided.

    Tags such as ``nav`` always mark their part. A mark by class, id or role holds over an ``article`` or ``main``
    inside it only if the page has another one that stands in no such part. ``path`` names the open elements with
    their classes; equal parts of a site's template have equal paths.
    """
    out: list[tuple[str, int, str]] = []
    stack: list[tuple[str, str, str]] = []  # tag, shown, what it sets: "t" other part by tag, "n" by name, "m" main, "" nothing
    text: list[str] = []
    within = False  # blocks whose main stands in a part marked by name
    alone = False  # blocks whose main stands free

    def close() -> None:
        nonlocal within, alone
        if text:
            said = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if said:
                sets = "".join(s for _, _, s in stack)
                if "t" in sets or "n" in sets[sets.rfind("m") + 1 :]:
                    state = 0
                elif "n" in sets:
                    state, within = 2, True
                else:
                    state = 1 if sets else -1
                    alone = alone or state == 1
                out.append((said, state, "/".join(shown for _, shown, _ in stack)))

    for m in _TOKEN.finditer(page):
        if m[5] is not None:
            text.append(m[5])
            continue
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag in _INLINE:
            if not m[2] and m[4] and _marked(_names(m[4])):
                close()
                stack.append((tag, tag, "n"))
            elif m[2] and stack and stack[-1][0] == tag:
                close()
                stack.pop()
            continue
        close()
        if tag in _VOID:
            continue
        if m[2]:
            if any(t == tag for t, _, _ in stack):
                while stack and stack[-1][0] != tag:
                    stack.pop()
                stack.pop()
            continue
        if tag in _BLOCKS and any(t == "p" for t, _, _ in stack):
            while stack[-1][0] != "p":
                stack.pop()
            stack.pop()
        elif tag in ("li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1][0] == tag:
            stack.pop()
        if (m[4] or "").rstrip().endswith("/"):
            continue
        names = _names(m[4]) if m[4] else ()
        inside = any(s == "m" for _, _, s in stack)
        if tag in _ASIDE and not (tag == "header" and inside):
            sets = "t"
        elif tag in _MAIN:
            sets = "n" if names and names[0] in _MARKS else "m"  # <article class="comment">, but not class="post share"
        else:
            sets = "n" if tag not in ("html", "body") and _marked(names) else ""
        stack.append((tag, ".".join((tag, *names)), sets))
    close()
    if within:
        out = [(said, state if state != 2 else 0 if alone else 1, path) for said, state, path in out]
    return out


def _names(attributes: str) -> tuple[str, ...]:
    """The words of class, id and role, the class's first."""
    found = sorted(_NAMES.findall(attributes), key=lambda x: x[0].lower() != "class")
    return tuple(" ".join(a or b or c for _, a, b, c in found).lower().split())


def _marked(names: tuple[str, ...]) -> bool:
    for name in names:
        parts = [x for x in re.split(r"[_-]+", name) if x]
        if parts and (parts[0] in _MARKS or parts[-1] in _MARKS) and not _BESIDE.intersection(parts):
            return True
    return False


def _tokens(found: list[tuple[str, int, str]]) -> list[tuple[int, str]]:
    """The token stream of what is outside the article: (block, token); a block is its path and then its words."""
    return [(i, t) for i, (text, state, path) in enumerate(found) if state != 1 for t in (path, *text.split())]


def suffix_windows(pages: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All RUN tokens in a row of some token streams, by a suffix array: (stream, place, group); a group has equal tokens.

    The streams are laid end to end and their suffixes sorted as deep as RUN by doubling; suffixes next to each
    other that agree so far are a group. Windows don't cross streams.
    """
    codes: dict[str, int] = {}
    flat = np.array([codes.setdefault(t, len(codes) + 1) for page in pages for t in page], dtype=np.int64)
    sizes = np.array([len(p) for p in pages], dtype=np.int64)
    stream = np.repeat(np.arange(len(pages)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rank, depth = flat, 1
    while depth < RUN:
        step = min(depth, RUN - depth)
        after = np.zeros(len(flat), np.int64)
        if len(flat) > step:
            after[:-step] = np.where(stream[:-step] == stream[step:], rank[step:], 0)
        order = np.lexsort((after, rank))
        new = np.ones(len(flat), np.int64)
        if len(flat):
            new[1:] = (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])
        rank = np.empty(len(flat), np.int64)
        rank[order] = np.cumsum(new)
        depth += step
    whole = place + RUN <= sizes[stream]
    return stream[whole], place[whole], rank[whole]


_PARSED = "uid long, page_id string, url string, host string, texts array<string>, states array<int>, stream array<string>, stream_block array<int>"
_WINDOWS = "host string, run string, lo long, hi long"


def parse_pages(pages: DataFrame, page_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Texts and states of all blocks, and the token stream outside the article, written to the shared folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                found = [blocks(h) for h in part["html"]]
                streams = [_tokens(f) for f in found]
                more = {"texts": [[t for t, _, _ in f] for f in found], "states": [[s for _, s, _ in f] for f in found]}
                more |= {"stream": [[t for _, t in s] for s in streams], "stream_block": [[b for b, _ in s] for s in streams]}
                yield part.drop(columns="html").assign(**more)

    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    picked = pages.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col(page_col).cast("string").alias("page_id"),
        F.col(url_col).alias("url"),
        host.alias("host"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    )
    path = folder(pages.sparkSession, "parsed")
    picked.mapInPandas(run, _PARSED).write.parquet(path)
    return pages.sparkSession.read.parquet(path)


def repeated_runs(parsed: DataFrame) -> DataFrame:
    """``run``: hashes of the token runs that at least two pages of a host have.

    Each task sorts the suffixes of the streams in its batch and hands on one row a host and group, with the
    smallest and largest page that has it; an aggregation over hosts joins the tasks' rows. So a host with very
    many pages is pre-aggregated in every task and is no single task anywhere.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            streams = [list(x) for x in batch["stream"]]
            stream, place, group = suffix_windows(streams)
            if not len(stream):
                continue
            rows = pd.DataFrame({"host": batch["host"].to_numpy()[stream], "page": batch["uid"].to_numpy()[stream], "group": group, "stream": stream, "place": place})
            found = rows.groupby(["host", "group"], sort=False).agg(lo=("page", "min"), hi=("page", "max"), stream=("stream", "first"), place=("place", "first")).reset_index()
            runs = [_SEP.join(streams[s][p : p + RUN]) for s, p in zip(found["stream"], found["place"], strict=True)]
            yield pd.DataFrame({"host": found["host"], "run": runs, "lo": found["lo"], "hi": found["hi"]})

    rows = parsed.select("uid", "host", "stream").mapInPandas(run, _WINDOWS).withColumn("run", F.xxhash64("host", "run"))
    return rows.groupBy("run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("run")


def extract_main_text(pages: DataFrame, page_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text)``, one row a page: its blocks of main text in order, one line each.

    Blocks in ``article`` or ``main`` are main text; blocks in parts that their tag, class, id or role marks as
    navigation, header, footer, advert, notice, form or comments are not, nor are scripts and styles. A block
    that neither says anything about is boilerplate if all its tokens lie in runs of RUN tokens that repeat on
    another page of its host (the longest repeated runs are just the unions of these); else it is kept whole. Character references are decoded, white space in a block
    is one space, inline elements don't end a block. Null or empty html gives an empty text, a page without url
    belongs to the host of no name, unclosed and stray tags are borne. Rows that repeat a page are pages of
    their own.
    """
    parsed = parse_pages(pages, page_col, url_col, html_col)
    undecided = F.exists("states", lambda s: s == -1)
    sure = parsed.where(~undecided)
    main = F.filter("texts", lambda _, i: F.get("states", i) == 1)
    sure = sure.select("page_id", "url", F.array_join(main, "\n").alias("text"))
    open_ = parsed.where(undecided)
    starts = F.sequence(F.lit(0), F.size("stream") - RUN)
    windows = F.when(F.size("stream") >= RUN, F.transform(starts, lambda i: F.struct(i.alias("at"), F.xxhash64("host", F.array_join(F.slice("stream", i + 1, RUN), _SEP)).alias("run"))))
    places = open_.select("uid", F.explode(windows).alias("w")).select("uid", "w.at", F.bitwise_not("w.run").alias("k"))
    hit = places.join(repeated_runs(parsed).select(F.bitwise_not("run").alias("k")), "k").groupBy("uid").agg(F.collect_set("at").alias("at"))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for said, states, owner, at in zip(batch["texts"], batch["states"], batch["stream_block"], batch["at"], strict=True):
                covered = np.zeros(len(owner), bool)
                for i in at if at is not None else ():
                    covered[i : i + RUN] = True
                alive = set(np.asarray(owner)[~covered].tolist())
                texts.append("\n".join(t for i, (t, s) in enumerate(zip(said, states, strict=True)) if s == 1 or s == -1 and i in alive))
            yield batch[["page_id", "url"]].assign(text=texts)

    rest = open_.join(hit, "uid", "left").select("page_id", "url", "texts", "states", "stream_block", "at")
    out = sure.unionByName(rest.mapInPandas(keep, "page_id string, url string, text string"))
    return out.select(F.col("page_id").cast(pages.schema[page_col].dataType).alias("page_id"), "url", "text")
