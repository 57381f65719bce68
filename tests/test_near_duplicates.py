"""Near duplicates: one deal of the items, and characters left out as the pattern did."""

from pyspark.sql import functions as F

from screenlake.operators import entities as E


def test_characters_left_out(spark):
    text = "".join(map(chr, range(1, 0x3100))) + "（）！，；：、"
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    bare = F.regexp_replace("t", "[\\s,，。.;；:：\"'“”‘’/\\\\|\\-—_、]", "")
    bare = F.regexp_replace(F.regexp_replace(bare, "（", "("), "）", ")")
    assert all(r.a == r.b for r in df.select(E.comparable(F.col("t")).alias("a"), bare.alias("b")).collect())


def test_items_are_dealt_once(spark):
    rows = [(1, 1, "Hello, big world"), (1, 2, "hellobigworld"), (1, 3, "so Hello big world!"), (1, 4, "Hello-big world"), (1, 5, "short"), (1, 6, "a short one"), (2, 1, "Hello big world"), (1, 7, "abababababab"), (1, 8, "xabababababab")]
    items = spark.createDataFrame(rows, "image_id long, ord long, text string")
    found = E.near_duplicate_text(items)
    assert {(r.image_id, r.ord, r.dup_of) for r in found.collect()} == {(1, 3, 1), (1, 4, 1), (1, 8, 7)}
    # the result is a table: joins and minima were taken where the items lay
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
