import random

from pyspark.sql import functions as F

from netresil.functions.rounding import round_even


def test_rounds_like_the_digits_of_the_double(spark):
    r = random.Random(2)
    cases = [(2 * r.randrange(1, 50_000) + 1) * 5 / 10 ** r.randrange(1, 6) for _ in range(4000)]
    cases += [r.uniform(-1000, 1000) for _ in range(1000)] + [r.randrange(-9999, 9999) / 2 ** r.randrange(9) for _ in range(1000)]
    cases += [1.015, 1.225, 60.045, 2.675, 0.5, 1.5, 2.5, -0.5, -1.5, 0.0, 1e16, -3e300, 1e-300, 4503599627370497.5]
    df = spark.createDataFrame([(x,) for x in cases], "x double")
    got = df.select("x", *[round_even("x", n).alias(f"r{n}") for n in range(5)]).collect()
    for row in got:
        for n in range(5):
            assert row[f"r{n}"] == round(row.x, n), (row.x, n)


def test_nulls_and_odd_numbers_stay(spark):
    df = spark.sql("select cast(null as double) as a, double('NaN') as b, double('inf') as c, 7 as d")
    row = df.select(*[round_even(F.col(x), 2).alias(x) for x in "abcd"]).first()
    assert row.a is None and row.b != row.b and row.c == float("inf") and row.d == 7.0
