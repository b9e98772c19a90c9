"""The chunked paths give what a plain window over the whole sequence gives."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from drivegrid.lib import ordered as O
from drivegrid.operators import intervals as iv
from drivegrid.operators import polylines as pl
from drivegrid.operators import trajectory as tr


def sequence(spark, n=1000):
    # run 0 holds two thirds of all rows
    df = spark.range(n).select(
        F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 4 + 1).cast("long").alias("run_id"),
        F.col("id").alias("k"), (F.rand(7) * 10).alias("x"), (F.rand(8) * 2).alias("y"), F.rand(9).alias("z"),
    )
    return df.withColumn("stamp_ns", F.col("k") * 1_000_000_000 + 5).withColumn("seq", F.col("k"))


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_range_path_numbers_like_a_window(spark):
    df = sequence(spark)
    small = O.index_rows(df, ["run_id"], ["k"])
    large = O.index_rows(df, ["run_id"], ["k"], small_group=10)
    assert O.bound_of(small, "i") and O.bound_of(large, "i") is None
    assert rows(small, "run_id", "k", "i") == rows(large, "run_id", "k", "i")


def test_neighbours_running_and_reindex_across_chunks(spark):
    small = O.index_rows(sequence(spark), ["run_id"], ["k"])
    free = small.withColumn("i", F.col("i") + 0)  # no bound known: chunked
    assert O.bound_of(free, "i") is None
    near = O.with_neighbours(free, ["run_id"], "i", ["k"], 2, 1, rows=16)
    w = Window.partitionBy("run_id").orderBy("i")
    want = small.withColumns({"k_p1": F.lag("k").over(w), "k_p2": F.lag("k", 2).over(w), "k_n1": F.lead("k").over(w)})
    cols = ("run_id", "i", *[F.coalesce(c, F.lit(-1)) for c in ("k_p1", "k_p2", "k_n1")])
    assert rows(near, *cols) == rows(want, *cols)
    for kind in ("sum", "max", "min", "last"):
        for reverse in (False, True):
            spec = {"o": (kind, F.when(F.col("k") % 5 != 0, F.col("k")))}
            a = O.running(free, ["run_id"], "i", spec, reverse, rows=16)
            b = O.running(small, ["run_id"], "i", spec, reverse)
            key = ("run_id", "i", F.coalesce("o", F.lit(-1)))
            assert rows(a, *key) == rows(b, *key), (kind, reverse)
    gaps = free.filter("k % 3 <> 1")
    again = O.reindex(gaps, ["run_id"], "i", rows=16)
    assert rows(again, "run_id", "k", "i") == rows(O.index_rows(gaps.drop("i"), ["run_id"], ["k"]), "run_id", "k", "i")


def test_stationary_removal_is_independent_of_chunks(spark):
    line = O.index_rows(sequence(spark, 600), ["run_id"], ["k"])
    one = rows(tr.remove_stationary(line, 6.0, 100_000), "run_id", "k", "i")
    many = rows(tr.remove_stationary(line, 6.0, 40), "run_id", "k", "i")
    assert one == many


def test_simplify_levels_equal_single_pass(spark):
    line = O.index_rows(sequence(spark, 120).withColumn("x", F.col("k") * 0.1), ["run_id"], ["k"])
    a = pl.simplify(line, 0.4, ["run_id"])
    b = pl.simplify(line, 0.4, ["run_id"], solo_rows=40)
    assert rows(a, "run_id", "k") == rows(b, "run_id", "k")


def test_merge_spans_over_bucket_borders(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 2.0), (1, 1, 1.5, 9.0), (1, 1, 9.0, 9.5), (1, 1, 20.0, 21.0), (1, 2, 3.0, 3.0)],
                               "run_id long, edge_id long, start_s double, end_s double")
    assert rows(iv.merge_spans(df, size=2.0), "edge_id", "start_s", "end_s") == [(1, 0.0, 9.5), (1, 20.0, 21.0)]


def test_greedy_choice_by_doubling_equals_arrays(spark):
    c = sequence(spark, 800).filter("k % 7 <> 3").select("run_id", F.col("k").alias("i"))
    a = tr.choose_apart(c, 3)
    b = tr.choose_apart(c, 3, solo_rows=5)
    assert rows(a, "run_id", "i") == rows(b, "run_id", "i")
