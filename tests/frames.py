"""Small frames with known answers."""

import datetime as dt


def people(spark, gender_gap=False):
    day = lambda n: dt.datetime(2021, 1, n)
    rows = [
        (1, 9.1, "M", day(1), 60000),
        (2, 8.2, "F", day(2), 40000),
        (2, 8.2, "F", day(2), 40000),
        (4, None, "Male", day(4), 30000),
        (5, 6.0, "m", day(5), 22000),
        (6, 7.5, None if gender_gap else "F", day(6), 999999),
    ]
    return spark.createDataFrame(rows, "id bigint, score double, gender string, joined timestamp, salary bigint")


def clean(spark):
    return spark.createDataFrame([(1.0, "x"), (2.0, "y"), (3.0, "z")], "a double, b string")


def big(spark):
    rows = [(None if i == 100 else float(i), float(i % 7), f"c{i % 5}") for i in range(5000)]
    return spark.createDataFrame(rows, "x double, y double, cat string")


def messy(spark):
    rows = [
        (22.0, 1, 100.0, "north"), (None, 2, 250.5, "south"), (35.0, 3, 80.0, "east"), (41.0, 4, 60.0, "north"),
        (29.0, 5, 10.0, "west"), (50.0, 6, 300.0, "south"), (33.0, 7, 20.0, "east"), (27.0, 8, 500.0, "west"),
    ]
    return spark.createDataFrame(rows, "age double, tenure bigint, balance double, region string")


def labelled(spark, sizes):
    rows = [(float(i), float(i * 7 % 11), label) for label, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "f1 double, f2 double, label string")


def skewed(spark, n=3000):
    """A third of the rows under one key, with gaps, ties and a long tail."""
    rows = []
    for i in range(n):
        key = 0 if i % 3 == 0 else i % 97
        value = float((i * 7919) % 1009) ** 1.5
        rows.append((i, key, (i * 31) % n, value, None if (i * 13) % 10 < 6 else value, 33.0 if i % 3 == 0 else value))
    return spark.createDataFrame(rows, "id bigint, key bigint, at bigint, value double, gap double, tied double")
