"""Chat formatting with Spark expressions only: sorted turns, merged roles, one string and its loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, NEXT = "<|im_start|>", "<|im_end|>", "<|im_next|>"
#: What an escape guards inside texts, after the first character: the template's own marks and those of other templates.
_TAIL = r"(/?s>|/?INST\]|/?SYS>|<SYS>>|</SYS>>|\|[A-Za-z0-9_]*\|>)"


def escape(text: Column) -> Column:
    """Put one backslash after the first character of each control string (behind which backslashes may already stand)."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TAIL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """Take one backslash away again; ``unescape(escape(x)) = x`` for every text."""
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAIL, r"$1$2$3")


def _role(role: Column) -> Column:
    """A role stands on one line and holds no mark."""
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def _unrole(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """``(conv_id, formatted, loss_spans)``, one row a conversation.

    Turns are sorted by turn number (ties by role and text, nulls first). Turns of one role in a row become one
    block, their texts parted by a mark, so that reading back gives the turns again. ``loss_spans`` are the
    places (0-based start, length, in code points) of the texts of ``loss_role``. Null role and text count as
    empty, a null conversation id is a conversation. A conversation is one string, so its turns meet in one row.
    """
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    grouped = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    safe = F.transform("turns", lambda t: F.struct(_role(t["role"]).alias("role"), escape(t["text"]).alias("text"), (t["role"] == loss_role).alias("loss")))
    # blocks: adjacent turns of a role in one struct
    empty = F.expr("cast(array() as array<struct<role:string,loss:boolean,texts:array<string>>>)")

    def merged(blocks: Column, t: Column) -> Column:
        last = F.try_element_at(blocks, F.lit(-1))
        block = lambda texts: F.array(F.struct(t["role"].alias("role"), t["loss"].alias("loss"), texts.alias("texts")))
        return F.when(
            last["role"] == t["role"],
            F.concat(F.slice(blocks, F.lit(1), F.size(blocks) - 1), block(F.concat(last["texts"], F.array(t["text"])))),
        ).otherwise(F.concat(blocks, block(F.array(t["text"]))))

    blocks = grouped.select("conv_id", F.aggregate(safe, empty, merged).alias("blocks"))
    # parts: each text with what stands before it, so that its place is a running sum
    parts = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.transform(
                b["texts"],
                lambda x, i: F.struct(
                    F.when(i == 0, F.concat(F.lit(START), b["role"], F.lit("\n"))).otherwise(F.lit(NEXT)).alias("before"),
                    x.alias("text"),
                    F.when(i == F.size(b["texts"]) - 1, F.lit(END + "\n")).otherwise(F.lit("")).alias("after"),
                    b["loss"].alias("loss"),
                ),
            ),
        )
    )
    placed = F.aggregate(
        "parts",
        F.expr("named_struct('at', 0L, 'spans', cast(array() as array<struct<start:bigint,length:bigint>>))"),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["before"]) + F.length(p["text"]) + F.length(p["after"])).alias("at"),
            F.when(
                p["loss"],
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(p["before"])).alias("start"), F.length(p["text"]).cast("long").alias("length")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return blocks.select("conv_id", parts.alias("parts")).select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: F.concat(p["before"], p["text"], p["after"])), "").alias("formatted"),
        placed["spans"].alias("loss_spans"),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """``formatted`` with what its string and spans say: ``turns`` (role, text) and ``loss_text``."""
    blocks = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda b: b != "")
    body = lambda b: F.split(b, r"<\|im_end\|>\n", -1)[0]
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substr(body(b), F.instr(b, "\n") + 1), r"<\|im_next\|>", -1),
                lambda x: F.struct(_unrole(F.substring_index(b, "\n", 1)).alias("role"), unescape(x).alias("text")),
            ),
        )
    )
    loss = F.array_join(
        F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""
    )
    return formatted.select("*", turns.alias("turns"), loss.alias("loss_text"))
