"""Dates told apart by their shape: same as trying every format, without the time that takes."""

import time

from pyspark.sql import functions as F

from orrery.functions import dates

ODD = [
    "2020/01/02", "2020-01-02", "01/02/2020", "20200102", "02-Jan-2020", "02-feb-2020", "20200102030405", "2020-01-02T03:04:05", "2020-01-02t03:04:05", "2020/01/02 03:04:05", "20200102 03:04", "01/02/2020 03:04:05",
    "2020/01/02 03:04", "2020-01-02T03:04", "2020/01-02", "2020-1-2", "2020-02-30", "2020-01-02 24:00", "2020-01-02 23:60:00", "2020-01-02\n", " 2020-01-02", "2020-01-02 ", "2020-01-02 03:04:05Z", "2020", "T03:04", "20200132", "20201332000000",
    "0000-01-01", "+12020/01/02", "+2020/01/02", "-0001-01-02", "01/02/+12020", "02-Jan--0001", "+120200102", "+120200102030405", "12020-01-02", "٢020-01-02", "", None,
]


def test_same_as_trying_every_format(spark):
    tried = F.coalesce(*[F.try_to_timestamp("t", F.lit(f)) for f in dates.FORMATS + dates.MORE_FORMATS])
    got = spark.createDataFrame([(t,) for t in ODD], "t string").select("t", tried.cast("string").alias("tried"), dates.parse_date(F.col("t")).cast("string").alias("d")).collect()
    assert [(r["t"], r["d"]) for r in got] == [(r["t"], r["tried"]) for r in got] and sum(r["d"] is not None for r in got) >= 18


def test_late_formats_cost_little_more_than_the_one_that_fits(spark):
    f = "yyyy/MM/dd HH:mm:ss"
    t = spark.range(0, 100_000, 1, 1).select(F.date_format(F.timestamp_seconds(F.col("id") * 7919), f).alias("t")).localCheckpoint()

    def took(c):
        out = []
        for _ in range(3):
            began = time.time()
            t.select(c.alias("d")).write.format("noop").mode("overwrite").save()
            out.append(time.time() - began)
        return min(out)

    assert took(dates.parse_date(F.col("t"))) < 0.2 + 3 * took(F.try_to_timestamp("t", F.lit(f)))
