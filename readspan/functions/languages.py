"""Language tags and names: canonical codes, names in several languages, languages that a title suggests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readspan.functions.text import folded

# Three-letter codes and their two-letter forms, regions of each Chinese script, words for "language".
TWO_LETTERS = {
    "eng": "en", "jpn": "ja", "zho": "zh", "chi": "zh", "cmn": "zh", "kor": "ko", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "spa": "es", "ita": "it", "por": "pt", "rus": "ru",
    "nld": "nl", "dut": "nl", "ara": "ar", "heb": "he", "hin": "hi", "tha": "th", "vie": "vi", "ind": "id", "msa": "ms", "may": "ms", "pol": "pl", "swe": "sv", "dan": "da", "nor": "no",
    "fin": "fi", "ell": "el", "gre": "el", "ces": "cs", "cze": "cs", "tur": "tr", "ukr": "uk", "ron": "ro", "rum": "ro", "hun": "hu",
}
SIMPLIFIED_IN, TRADITIONAL_IN = ("cn", "sg", "my"), ("tw", "hk", "mo")
TYPE_WORDS = ("language", "sprache", "语言", "言语")
#: Codes that names are known for, and the languages they are named in.
CODES = (*sorted(set(TWO_LETTERS.values()) - {"zh"}), "zh", "zh-Hans", "zh-Hant")
NAMED_IN = ("en", "de", "zh-Hans", "zh-Hant", "ja")


def canonical(tag: Column) -> Column:
    """A language tag as one code: two letters where there are any, Chinese with its script if tag or region names one."""
    parts = F.transform(F.filter(F.split(F.trim(tag), "[-_]"), lambda x: x != ""), F.lower)
    first = F.try_element_at(parts, F.lit(1))
    known = F.create_map(*(F.lit(x) for pair in TWO_LETTERS.items() for x in pair))
    code = F.when(F.length(first) == 2, first).otherwise(F.coalesce(known[first], first))
    rest = F.slice(parts, 2, 99)
    script = F.try_element_at(F.filter(rest, lambda x: x.isin("hans", "hant")), F.lit(1))
    region = F.try_element_at(F.filter(rest, lambda x: x.isin(*SIMPLIFIED_IN, *TRADITIONAL_IN)), F.lit(1))
    chinese = (
        F.when(script == "hans", "zh-Hans").when(script == "hant", "zh-Hant")
        .when(region.isin(*SIMPLIFIED_IN), "zh-Hans").when(region.isin(*TRADITIONAL_IN), "zh-Hant").otherwise("zh")
    )
    return F.coalesce(F.when(code == "zh", chinese).otherwise(code), F.lit(""))


def is_language_type(words: Column) -> Column:
    """Whether a tag type is the word for language, case and width aside."""
    return folded(words).isin(*TYPE_WORDS)


def language_names(spark: SparkSession) -> DataFrame:
    """``(code, named_in, name)``: every code's name in each of NAMED_IN and, as ``own``, in itself, from the locale data of the JVM.

    A few hundred rows by construction. Chinese names of languages end in one of two signs; both are given.
    """
    locale = spark._jvm.java.util.Locale
    rows = []
    for code in CODES:
        for named_in in (*NAMED_IN, "own"):
            shown = locale.forLanguageTag(code if named_in == "own" else named_in)
            name = locale.forLanguageTag(code).getDisplayName(shown) if "-" in code else locale.forLanguageTag(code).getDisplayLanguage(shown)
            rows.append((code, named_in, name))
            if named_in.startswith("zh") and name[-1:] in "文語语":
                rows += [(code, named_in, name[:-1] + end) for end in "文語语" if end != name[-1]]
    return spark.createDataFrame(rows, "code string, named_in string, name string")


def codes_of(rows: DataFrame, words: str, names: DataFrame) -> DataFrame:
    """``rows`` with ``code``: what ``words`` name, as a tag or by a language's name, case and width aside; null for others.

    ``names`` (code, named_in, name) is a dictionary of some hundred rows, so it is broadcast.
    """
    known = names.select(folded(F.col("name")).alias("__f"), "code").groupBy("__f").agg(F.min("code").alias("__named"))
    listed = [r.code for r in names.select("code").distinct().collect()]
    joined = rows.withColumn("__f", folded(F.col(words))).join(F.broadcast(known), "__f", "left")
    tag = canonical(F.col(words))
    return joined.withColumn("code", F.when(tag.isin(*listed), tag).otherwise(F.col("__named"))).drop("__f", "__named")


def suggested(title: Column, author: Column) -> Column:
    """Japanese if there are kana, Korean if there is Hangul; else none."""
    both = F.concat_ws(" ", title, author)
    return F.when(both.rlike(r"[\x{3040}-\x{30FF}]"), "ja").when(both.rlike(r"[\x{AC00}-\x{D7AF}]"), "ko")
