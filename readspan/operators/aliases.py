"""Names of one value: spellings and codes as nodes of one graph, and the names that a value is known by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readspan.functions.languages import TYPE_WORDS, codes_of, is_language_type
from readspan.functions.text import folded
from readspan.operators.breakdown import alias_classes
from readspan.operators.lineage import pinned

TAG, TYPE = "tag", "type"


def _node(field: Column, type_: Column, name: Column) -> Column:
    """A spelling: names that fold alike in a field and type are one."""
    return F.concat_ws("\u0001", F.lit("name"), field, F.coalesce(type_, F.lit("")), folded(name))


def _code(code: Column) -> Column:
    return F.concat_ws("\u0001", F.lit("code"), code)


def _claims(links: DataFrame) -> DataFrame:
    """``(field, type, name, no, link)``: of each name the latest link that joins it, and its place there.

    The latest row of a field, type and first name counts; one without names joins none. A name that several links hold is
    the later one's.
    """
    w = Window.partitionBy("field", "type", folded(F.col("first"))).orderBy(F.desc("edited"), F.col("names").cast("string"))
    live = links.withColumn("__n", F.row_number().over(w)).where("__n = 1 and names is not null")
    said = live.select("field", F.coalesce("type", F.lit("")).alias("type"), "first", "edited", F.posexplode(F.concat(F.array("first"), "names")).alias("no", "name"))
    own = Window.partitionBy("field", "type", folded(F.col("name"))).orderBy(F.desc("edited"), folded(F.col("first")))
    return said.withColumn("__n", F.row_number().over(own)).where("__n = 1").select("field", "type", "name", "no", F.concat_ws("\u0001", F.lit("link"), "field", "type", folded(F.col("first"))).alias("link"))


def type_classes(links: DataFrame, types: DataFrame) -> DataFrame:
    """``(folded_type, type_class)`` of the tag types in ``types`` (type) and in ``links``: joined by links of types, the five words for language by nature.

    Links can't join a word for language to others.
    """
    claims = _claims(links.where(F.col("field") == TYPE)).where(~is_language_type(F.col("name")))
    joined = claims.select(folded(F.col("name")).alias("a"), F.col("link").alias("b"))
    known = types.select(folded(F.col("type")).alias("a")).unionByName(claims.select(folded(F.col("name")).alias("a"))).distinct()
    spark = types.sparkSession
    words = spark.createDataFrame([(w,) for w in TYPE_WORDS], "w string").select(folded(F.col("w")).alias("a"), F.lit(TYPE_WORDS[0]).alias("b"))
    every = joined.unionByName(known.select("a", F.col("a").alias("b"))).unionByName(words)
    classes = alias_classes(every, "a", "b").where(~F.col("name").startswith("link\u0001"))
    return classes.select(F.col("name").alias("folded_type"), F.col("class").alias("type_class"))


def _typed(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` with ``kind``, the class of a tag's type, else nothing, and ``language``: whether a word for language names the type."""
    tag = F.col("field") == TAG
    out = rows.withColumn("__f", F.when(tag, folded(F.coalesce("type", F.lit(""))))).join(classes, F.col("__f") == F.col("folded_type"), "left")
    kind = F.when(tag, F.coalesce("type_class", "__f")).otherwise("")
    return out.withColumns({"kind": kind, "language": tag & is_language_type(F.coalesce("type", F.lit("")))}).drop("__f", "folded_type", "type_class")


def values(links: DataFrame, held: DataFrame, dictionary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(field, kind, name, class, shown, n_books, linked)`` of every name that is held or linked, and the type classes.

    ``held`` (book, field, type, name), ``links`` as in ``operators.links``, ``dictionary`` (code, named_in, name) of languages. Tags
    whose types are of one class are of one field. Spellings, links and language codes are nodes of one graph: a name is
    joined to the latest link that holds it and, if its type is a word for language, to the code that it names, so that names
    of a language in any tongue are one value, though no link says so; links of languages are left out. A value is shown by
    the name that most books hold, then the first in its link, then by name; ``linked`` tells values that a link joins.
    """
    classes = pinned(type_classes(links, held.where(F.col("field") == TAG).select("type").distinct()))
    typed = pinned(_typed(held, classes))
    claims = _typed(_claims(links.where(F.col("field") != TYPE)), classes).where("not language")
    node = _node(F.col("field"), F.col("kind"), F.col("name"))
    names = typed.groupBy("field", "kind", "language", "name").agg(F.countDistinct("book").alias("n_books"))
    said = claims.select("field", "kind", "language", "name", "no", "link")
    every = names.join(said.select("field", "kind", "name", "no"), ["field", "kind", "name"], "left").unionByName(
        said.join(names, ["field", "kind", "name"], "left_anti").select("field", "kind", "name", "language", F.lit(0).cast("long").alias("n_books"), "no")
    )
    every = pinned(codes_of(every.withColumn("node", folded(node)), "name", dictionary).withColumn("code", F.when(F.col("language"), F.col("code"))))
    edges = (
        every.select(F.col("node").alias("a"), F.col("node").alias("b"))
        .unionByName(said.select(node.alias("a"), F.col("link").alias("b")))
        .unionByName(every.where("code is not null").select(F.col("node").alias("a"), _code(F.col("code")).alias("b")))
    )
    found = alias_classes(edges, "a", "b").withColumnRenamed("name", "node")
    joined = pinned(every.join(found, "node"))
    best = Window.partitionBy("class").orderBy(F.desc("n_books"), F.col("no").asc_nulls_last(), "name")
    several = F.size(F.collect_set(F.when(F.col("no").isNotNull(), F.col("node"))).over(Window.partitionBy("class"))) > 1
    out = joined.withColumns({"shown": F.first("name").over(best), "linked": several})
    return out.select("field", "kind", "language", "code", "node", "name", "class", "shown", "n_books", "linked"), classes


def looked_up(asked: DataFrame, values_: DataFrame, classes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``asked`` (field, type, name) with ``class`` and ``shown`` of the value it names: by its spelling, else by the language it means.

    A name that no value has is a class of its own and shown as it is.
    """
    typed = codes_of(_typed(asked, classes), "name", dictionary)
    typed = typed.withColumn("node", folded(_node(F.col("field"), F.col("kind"), F.col("name"))))
    by_name = values_.groupBy("node").agg(F.min(F.struct("class", "shown")).alias("v"))
    by_code = values_.where("code is not null").groupBy(F.col("kind").alias("__kind"), F.col("code").alias("__code")).agg(F.min(F.struct("class", "shown")).alias("w"))
    out = typed.join(by_name, "node", "left").join(by_code, F.col("language") & (F.col("kind") == F.col("__kind")) & (F.col("code") == F.col("__code")), "left")
    value = F.coalesce("v", "w")
    return out.select(*asked.columns, F.coalesce(value["class"], F.col("node")).alias("class"), F.coalesce(value["shown"], "name").alias("shown"))


def same(pairs: DataFrame, values_: DataFrame, classes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``pairs`` (id, a and b: structs of field, type, name) with ``same``: whether both are names of one value."""
    both = pairs.select("id", F.explode(F.array(F.struct(F.lit("a").alias("s"), "a.*"), F.struct(F.lit("b").alias("s"), "b.*"))).alias("x")).select("id", "x.*")
    found = looked_up(both, values_, classes, dictionary)
    agreed = found.groupBy("id").agg((F.countDistinct("class") == 1).alias("same"))
    return pairs.join(agreed, "id")


def others(asked: DataFrame, values_: DataFrame, classes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``asked`` with ``every`` name of its value and ``also``, those that a book holds but the shown one, most held first; a name without a value has itself alone."""
    order = F.sort_array(F.collect_list(F.struct((-F.col("n_books")).alias("n"), F.col("name").alias("name"), (F.col("n_books") > 0).alias("held"))))
    lists = values_.groupBy("class").agg(order.alias("__l"))
    out = looked_up(asked, values_, classes, dictionary).join(lists, "class", "left")
    every = F.coalesce(F.transform("__l", lambda x: x["name"]), F.array("name"))
    also = F.coalesce(F.transform(F.filter("__l", lambda x: x["held"] & (x["name"] != F.col("shown"))), lambda x: x["name"]), F.array().cast("array<string>"))
    return out.select(*asked.columns, "class", "shown", every.alias("every"), also.alias("also"))
