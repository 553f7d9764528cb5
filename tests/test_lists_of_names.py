"""Lists of names are read with each step written once."""

from pyspark.sql import functions as F

from tidewatch import plans
from tidewatch.functions import names


def test_each_step_of_a_list_is_computed_once(spark):
    cases = {
        "A(주), a㈜ , B건설부문, b 컨소시엄": (["A(주)", "B건설부문"], 0, False),
        "A / B · A 외 12개사": (["A", "B"], 12, False),
        "A、B 등": (["A", "B"], 0, True),
        " , (주)": ([], 0, False),
        None: (None, 0, False),
    }
    df = spark.createDataFrame([(x,) for x in cases], "raw string").select("raw", names.consortium(F.col("raw")).alias("c"))
    assert {r.raw: (r.c.names, r.c.extra, r.c.more) for r in df.collect()} == cases
    # names nested in each other were computed anew wherever they were named
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 10


def test_parts_are_dealt(spark):
    df = plans.queries()["consortium_members"](spark, "/root/testdata/sf0.001")
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
