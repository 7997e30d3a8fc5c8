from topicloom.operators import joins


def test_lookup_of_any_size(spark, monkeypatch):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(["hot"] * 300 + ["a", "b", "b", None, "gone"])], "k string, i int")
    table = spark.createDataFrame([("hot", 300, "x"), ("a", 1, None), ("b", 2, "z")], "k string, n int, v string")
    want = {how: sorted(map(tuple, joins.lookup(rows, table, ["k"], "n", how).select("k", "i", "n", "v").collect()), key=str) for how in ("inner", "left")}
    assert len(want["inner"]) == 303 and len(want["left"]) == 305
    for most_hot in (0, 1, 5):
        monkeypatch.setattr(joins, "BROADCAST_ROWS", 2)
        monkeypatch.setattr(joins, "HOT_ROWS", 100)
        monkeypatch.setattr(joins, "MOST_HOT", most_hot)
        for how, expected in want.items():
            assert sorted(map(tuple, joins.lookup(rows, table, ["k"], "n", how).select("k", "i", "n", "v").collect()), key=str) == expected
    assert joins.lookup(rows.limit(0), table, ["k"], "n").count() == 0 and joins.lookup(rows, table.limit(0), ["k"], "n").count() == 0
