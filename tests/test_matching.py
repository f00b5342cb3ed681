"""Containment against plain search."""

from readspan.operators import matching


def test_contained_finds_needles_of_any_length(spark):
    needles = ["one", "one two", "a b c d", "one two three four five six", " two", "x\ty z u v w", "", None, "no such"]
    texts = ["one two three four five six", "zone two", "q a b c d\n", "x\ty z u v w", "", None]
    n = spark.createDataFrame(list(enumerate(needles)), "i int, needle string")
    t = spark.createDataFrame(list(enumerate(texts)), "j int, text string")
    got = sorted((r.i, r.j) for r in matching.contained(n, t, "needle", "text").collect())
    assert got == sorted((i, j) for i, a in enumerate(needles) for j, b in enumerate(texts) if a and b and a in b)


def test_words_of_a_text_longer_than_a_slice(spark):
    from readspan.operators import grams

    n = grams.SLICE + 5000
    texts = [(1, " ".join(map(str, range(n)))), (2, "a b c a b c"), (3, "a b"), (4, None)]
    rows = grams.listed_words(spark.createDataFrame(texts, "i int, text string"), ["i"], "text")
    assert {r.i: r["count"] for r in rows.groupBy("i").count().collect()} == {1: n - 2, 2: 3}
    assert rows.distinct().count() == n + 1
