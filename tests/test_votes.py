"""Votes, agreements and passes case by case."""

from pyspark.sql import functions as F

from tidemark.operators import votes


def test_flow_comes_first_then_the_stream_then_height(spark):
    rows = [
        (1, 0.6, 0.2, 10.0, 30.0, None), (2, 0.6, 0.55, 10.0, 30.0, 0), (3, 0.6, 0.55, 30.0, 10.0, None), (4, None, 0.5, 10.0, 11.0, None), (5, float("nan"), 0.5, None, 3.0, 1), (6, 0.1, 0.9, 1.0, 9.0, 0),
    ]
    df = spark.createDataFrame(rows, "k int, f0 double, f1 double, h0 double, h1 double, stream int")
    vote = votes.upstream_vote((F.col("f0"), F.col("f1")), (F.col("h0"), F.col("h1")), F.col("stream"), 0.1, 2.0)
    found = {r.k: (r.side, r.decided_by, r.agree) for r in df.select("k", vote.alias("v")).select("k", "v.*").collect()}
    assert found == {1: (0, "flow", False), 2: (0, "crossing", None), 3: (0, "height", None), 4: (None, "unclear", None), 5: (1, "crossing", None), 6: (1, "flow", True)}


def test_totals_are_judged_by_what_a_reader_would_do(spark):
    pairs = [(2.0, 4.9, "agree"), (20.0, 25.0, "agree"), (0.0, 9.0, "agree"), (40.0, 59.0, "agree"), (20.0, 60.0, "differ"), (19.0, 60.0, "far apart"), (60.0, 19.0, "far apart"), (5.0, 30.0, "differ"), (None, 3.0, None)]
    df = spark.createDataFrame(pairs, "a double, b double, word string")
    assert all(r.x == r.word for r in df.select("word", votes.totals_agree(F.col("a"), F.col("b")).alias("x")).collect())


def test_passes_are_united_and_counted(spark):
    rows = [(1, 0), (1, 1), (1, 2), (1, 255), (2, 3), (3, 250), (3, 251), (4, 250), (4, 255), (5, 255)]
    df = spark.createDataFrame(rows, "cell int, code int")
    read = lambda both: {r.cell: (r.extent, r.valid, r.flooded) for r in votes.passes_combined(df, "cell", both=both).collect()}
    assert read(False) == {1: (3, 3, 2), 2: (3, 1, 1), 3: (251, 0, 0), 4: (250, 0, 0), 5: (255, 0, 0)}
    assert read(True)[1] == (3, 3, 0) and read(True)[2] == (3, 1, 1)
