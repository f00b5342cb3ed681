"""Text functions: cleaning, folding, searching, names and codes, all Column expressions."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Full-width forms and their ASCII counterparts.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_ASCII = "".join(map(chr, range(0x21, 0x7F)))
_HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}\x{AC00}-\x{D7AF}"
_CJK = rf"[\x{{3040}}-\x{{30FF}}\x{{FF00}}-\x{{FFEF}}{_HAN}]"
# What follows the comma of a name that is never flipped.
_SUFFIXES = "jr sr ii iii iv v phd md do esq dds jd".split()
#: What stands for null in a field of text.
NONE = "\\N"


@cache
def han_pairs() -> tuple[str, str]:
    """Traditional characters and the simplified one of each, as ICU (which Spark ships) pairs them."""
    change = SparkSession.active()._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified")
    signs = [chr(c) for lo, hi in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00)) for c in range(lo, hi)]
    pairs = [(a, b) for a, b in zip(signs, change.transliterate("\n".join(signs)).split("\n"), strict=True) if a != b and len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalised(text: Column) -> Column:
    """One space between words, none at the ends, lower case."""
    return F.lower(collapsed(text))


def folded(text: Column) -> Column:
    """Normalised, full-width forms as ASCII, traditional characters as simplified: equal names fold alike."""
    return F.translate(normalised(F.translate(text, _WIDE, _ASCII)), *han_pairs())


def holds(text: Column, needle: str) -> Column:
    """Plain or folded substring match in lower case; an empty needle is in every text."""
    low = F.lower(text)
    return low.contains(needle.lower()) | folded(text).contains(folded(F.lit(needle)))


def either_holds(a: Column, b: Column) -> Column:
    """One text contains the other, and neither is empty."""
    return (F.length(a) > 0) & (F.length(b) > 0) & (a.contains(b) | b.contains(a))


def bounded(text: Column, limit: int = 600) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("…"))).otherwise(text)


def escaped(text: Column) -> Column:
    """Backslash, tab and line ends as two characters each."""
    for raw, shown in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return text


def unescaped(text: Column) -> Column:
    """The inverse; an unknown escape stays as written."""
    mark = "\ue000"  # private use: stands for an escaped backslash meanwhile
    text = F.replace(text, F.lit("\\\\"), F.lit(mark))
    for shown, raw in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r")):
        text = F.replace(text, F.lit(shown), F.lit(raw))
    return F.replace(text, F.lit(mark), F.lit("\\"))


def is_cjk(text: Column) -> Column:
    return text.rlike(_CJK)


def is_han_name(text: Column) -> Column:
    """A Han or Hangul sign in it; kana alone don't make one."""
    return text.rlike(f"[{_HAN}]")


def shown_name(name: Column) -> Column:
    """``Surname, Given`` as ``Given Surname`` if there is one comma, no sign of an East Asian script and no suffix behind it."""
    plain = collapsed(name)
    surname, given = F.trim(F.substring_index(plain, ",", 1)), F.trim(F.substring_index(plain, ",", -1))
    suffix = F.lower(F.regexp_replace(given, r"\.+$", "")).isin(*_SUFFIXES)
    flips = (F.size(F.split(plain, ",", -1)) == 2) & ~is_cjk(plain) & (surname != "") & (given != "") & ~suffix
    return F.when(flips, F.concat(given, F.lit(" "), surname)).otherwise(plain)


def split_names(line: Column) -> Column:
    """The names of a stored author line: parted by ``&`` and ``、``, and by commas where every part is a Han or Hangul name."""

    def unpacked(part: Column) -> Column:
        names = F.filter(F.transform(F.split(part, "[,，]"), lambda x: F.trim(x)), lambda x: x != "")
        return F.when(F.forall(names, is_han_name), names).otherwise(F.array(part))

    parts = F.flatten(F.transform(F.split(line, "[&、]"), unpacked))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def authors(line: Column) -> Column:
    """The names of an author line as typed, each the way it is shown."""
    return F.filter(F.transform(split_names(line), shown_name), lambda x: x != "")


def suggested_authors(line: Column) -> Column:
    """The line as its names are shown, if that isn't how it stands; else null."""
    return F.nullif(joined_names(authors(line)), line)


def optional(text: Column) -> Column:
    """A field that can be null."""
    return F.coalesce(escaped(text), F.lit(NONE))


def read_optional(field: Column) -> Column:
    return F.when(field != NONE, unescaped(field))


def flat(text: Column) -> Column:
    """Tabs and line ends as spaces."""
    return F.translate(text, "\t\n\r", "   ")


def tags_of(value: Column) -> Column:
    """``array<struct<type,tag>>`` of lines ``type, tab, tag``; lines without both are left out."""
    pairs = F.transform(F.split(value, "\n"), lambda x: F.struct(F.substring_index(x, "\t", 1).alias("type"), F.when(x.contains("\t"), F.substr(x, F.instr(x, "\t") + 1)).otherwise("").alias("tag")))
    return F.filter(pairs, lambda x: (x["type"] != "") & (x["tag"] != ""))


def tags_value(tags: Column) -> Column:
    return F.array_join(F.transform(tags, lambda x: F.concat(x["type"], F.lit("\t"), x["tag"])), "\n")


def same_tag(a: Column, b: Column) -> Column:
    """Type and tag fold alike."""
    return (folded(a["type"]) == folded(b["type"])) & (folded(a["tag"]) == folded(b["tag"]))


def folded_in_place(text: Column) -> Column:
    """Lower case and simplified, character for character, so that places stay where they are."""
    return F.translate(F.lower(text), *han_pairs())


def runs_in(line: Column, needle: Column) -> Column:
    """``array<struct<from,to>>``: where a needle stands in a line, folded, from 0 and without overlaps; none for an empty needle."""
    body, key = folded_in_place(line), folded_in_place(needle)
    between = F.when(key != "", F.split(body, F.concat(F.lit("\\Q"), key, F.lit("\\E")), -1))
    n = F.length(key)
    found = F.aggregate(
        F.slice(between, F.lit(1), F.size(between) - 1),
        F.expr("named_struct('at', 0, 'runs', cast(array() as array<struct<from:int,to:int>>))"),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x) + n).alias("at"), F.concat(acc["runs"], F.array(F.struct((acc["at"] + F.length(x)).alias("from"), (acc["at"] + F.length(x) + n).alias("to")))).alias("runs")
        ),
    )
    return F.coalesce(found["runs"], F.expr("cast(array() as array<struct<from:int,to:int>>)"))


def fingerprint(rows: list[Column]) -> Column:
    """One number for the inputs of a pass: equal numbers tell that it needn't run again. Order counts, nulls too."""
    return F.xxhash64(*(F.coalesce(c.cast("string"), F.lit(NONE)) for c in rows))


def joined_names(names: Column) -> Column:
    return F.when(F.forall(names, is_cjk) & (F.size(names) > 1), F.array_join(names, "、")).otherwise(F.array_join(names, " & "))


def unpadded(text: Column) -> Column:
    """Without a run of three or more of one leading sign."""
    return F.regexp_replace(text, r"^([^A-Za-z0-9])\1{2,}", "")
