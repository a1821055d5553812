import random

from pyspark.sql import functions as F

from chainframe.functions import u256 as U


def test_sum_hex_sub_random(spark):
    rnd = random.Random(7)
    vals = [rnd.randrange(0, 2 ** 256) for _ in range(150)] + [2 ** 256 - 1, 0, 1, 10 ** 18, 10 ** 18 - 1, 2 ** 124, 2 ** 124 - 1]
    rows = [(i % 5, str(v), hex(v)) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "g int, v string, h string")
    got = {r.g: int(r.s) for r in U.sum_u256(df, ["g"], {"s": F.col("v")}).collect()}
    exp: dict = {}
    for g, v, _ in rows:
        exp[g] = exp.get(g, 0) + int(v)
    assert got == exp
    for r in df.select("v", U.hex_to_u256("h").alias("d"), U.sub("v", F.lit(str(2 ** 255))).alias("s")).collect():
        assert r.d == r.v
        assert int(r.s) == int(r.v) - 2 ** 255


def test_invalid_hex_is_null(spark):
    r = spark.range(1).select(U.hex_to_u256(F.lit("0xzz")).alias("a"), U.hex_to_u256(F.lit("f" * 65)).alias("b"),
                              U.hex_to_u256(F.lit("0x")).alias("c")).first()
    assert r.a is None and r.b is None and r.c is None


def test_signed_combine(spark):
    r = spark.range(1).select(U.combine([(1, F.lit("5")), (-1, F.lit(str(2 ** 256 - 1))), (1, F.lit(None).cast("string"))]).alias("x")).first()
    assert int(r.x) == 5 - (2 ** 256 - 1)
