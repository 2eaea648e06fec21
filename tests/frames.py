"""Small frames with results worked out by hand."""


def district(spark):
    rows = [("C1", "d1", 10.0, 100), ("C1", "d1", 20.0, 100), ("C1", "d2", 50.0, 50), ("C1", "d3", 30.0, 30), ("C2", "d4", 40.0, 80), ("C2", "d5", 10.0, 20)]
    return numbered(spark, rows, "County string, District string, TestScr double, EnrlTot long")


def numbered(spark, rows, schema):
    """A frame in one partition, so that rows come in the order given, with their number as ``i``."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i long, {schema}").coalesce(1)


def values(df, name="x"):
    return [r[name] for r in df.orderBy("i").collect()]
