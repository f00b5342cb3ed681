"""Files whose name holds the key of one book."""

from readspan.operators import identify


def test_named_in_by_whole_keys(spark, monkeypatch):
    keys = ["0000012345", "0000012346", "B0ABCDEFGHIJ", "short", "00000123450000012346"]
    names = ["paper_0000012345_x", "paper_0000012345_0000012346", "B0ABCDEFGHIJ", "00000123450000012346", "B0ABCDEFGHI", "0000012345", "a 0000012345 0000012345", ""]
    files = spark.createDataFrame([(n,) for n in names * 2] + [(None,)], "file string")
    books = spark.createDataFrame([(k, None) for k in keys] + [("B0ABCDEFGH", 5)], "cde_key string, extent long")
    held = {n: [k for k in keys if len(k) >= 10 and k in n] for n in names}
    want = sorted((n, k[0]) for n, k in held.items() if len(k) == 1)
    assert sorted(identify.named_in(files, books).collect()) == want
    monkeypatch.setattr(identify, "NAMES_A_TASK", 2)
    for few in (3, 1, 0):  # keys are too many to be sent to all tasks, then most of their beginnings, then all
        monkeypatch.setattr(identify, "FEW_KEYS", few)
        got = identify.named_in(files, books)
        assert sorted(got.collect()) == want and got.rdd.getNumPartitions() == 9
