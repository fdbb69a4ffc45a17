import pinprice
from pinprice.session import shared_dir


def test_shared_dir_uses_the_configured_checkpoint_dir(spark):
    base = spark.sparkContext.getCheckpointDir()
    a, b = shared_dir(spark, "x", "y"), shared_dir(spark, "x", "y")
    assert a.startswith(base.rstrip("/") + "/x/y/") and a != b
    assert shared_dir(spark, "z", unique=False) == base.rstrip("/") + "/z"


def test_top_level_api_is_importable():
    for name in pinprice.__all__:
        assert callable(getattr(pinprice, name))


def test_read_table_and_typed_match(spark):
    from pinprice import schemas
    from pinprice.sources.tables import match, read_table

    path = shared_dir(spark, "test-read")
    spark.createDataFrame([(500, "ASIA"), (501, "EUROPE")], schemas.PINCODES).write.csv(path)
    df = read_table(spark, path, schemas.PINCODES, fmt="csv", options={"header": "false"})
    assert [r["pincode"] for r in match(df, zone="ASIA").collect()] == [500]
    assert match(df, zone=None).count() == 0 and match(df).count() == 2
