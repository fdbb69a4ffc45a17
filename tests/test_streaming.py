import __spark_entry__ as E
from conftest import SF001, rows


def test_stream_equals_batch(spark):
    s = E.queries()["q24_stream_requests"](spark, SF001)
    b = E.queries()["q22_min_for_requests"](spark, SF001)
    assert s.columns == b.columns
    assert rows(s) == rows(b)
    assert s.count() > 0


def test_stream_merge_equals_one_batch_merge(spark):
    from pinprice.plans.requests import price_requests
    from pinprice.sources.fixtures import fixture_tables
    from pinprice.sources.sinks import merge_values

    t = fixture_tables(spark, SF001)
    streamed = E.queries()["q25_stream_merge_prices"](spark, SF001)
    res = price_requests(t["requests"], t["zoneprices"], t["pincodes"], t["productinfos"])
    upd = res.select("product", "pincode", "price", "quantity", "request_id")
    batch = merge_values(t["product_prices"], upd, order_col="request_id").drop("request_id")
    assert rows(streamed) == rows(batch)
    assert streamed.count() >= t["product_prices"].count()


def test_recompute_job_matches_stream_and_is_idempotent(spark):
    from pinprice.plans.jobs import recompute_prices
    from pinprice.session import shared_dir
    from pinprice.sources.fixtures import fixture_state_table, fixture_tables

    t = fixture_tables(spark, SF001)
    base = shared_dir(spark, "test-recompute")
    args = (t["requests"], t["zoneprices"], t["pincodes"])
    from conftest import uniq

    r1, r2 = uniq("t_recompute_v1"), uniq("t_recompute_v2")
    new, n = recompute_prices(spark, *args, fixture_state_table(spark, SF001), r1,
                              f"{base}/v1", t["productinfos"], buckets=8)
    assert n.first()["n"] > 0
    streamed = E.queries()["q25_stream_merge_prices"](spark, SF001)
    assert rows(new.drop("seq")) == rows(streamed)
    again, n2 = recompute_prices(spark, *args, r1, r2, f"{base}/v2",
                                 t["productinfos"], buckets=8)
    assert n2.first()["n"] == 0
    assert rows(again) == rows(new)


SEQ_DDL = "product BIGINT, pincode INT, price BIGINT, quantity INT, seq STRUCT<run: BIGINT, request_id: BIGINT>"


def test_updates_do_not_depend_on_session_settings(spark):
    from pinprice.session import shared_dir
    from pinprice.streaming.requests import current_prices, read_updates, write_updates

    path = shared_dir(spark, "test-updates")
    own = spark.conf.get("spark.sql.shuffle.partitions")
    state = spark.range(1000).selectExpr("id AS product", "1 AS pincode", "id AS price", "1 AS quantity")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 16)
        new = [(5000 + i, 1, i, 1, (0, i)) for i in range(10)]
        write_updates(spark.createDataFrame(new, SEQ_DDL), path, "a", 0)
        assert current_prices(state, read_updates(spark, path)).count() == 1010
        spark.conf.set("spark.sql.shuffle.partitions", 32)
        every = [(i, 1, 7, 1, (1, i)) for i in range(1000)]
        write_updates(spark.createDataFrame(every, SEQ_DDL), path, "a", 1)
        out = current_prices(state, read_updates(spark, path))
        assert out.count() == 1010 and out.where("price = 7").count() >= 1000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", own)


def test_a_new_checkpoint_hides_nothing_and_a_snapshot_is_an_ordinary_job(spark, mk):
    """Three batches, then another stream's batch 0: all are read, a repeated batch changes nothing, and a snapshot
    holds what was read, before and after applying the same updates again."""
    from conftest import uniq
    from pinprice.session import shared_dir
    from pinprice.sources.sinks import merge_into_table, write_bucketed
    from pinprice.streaming.requests import current_prices, read_updates, write_updates

    base = shared_dir(spark, "test-updates")
    path = f"{base}/updates"
    state = mk([(9, 9, 1, 1)], "product BIGINT, pincode INT, price BIGINT, quantity INT")
    now = lambda s=state: rows(current_prices(s, read_updates(spark, path)).drop("seq"))
    for b in range(3):
        write_updates(spark.createDataFrame([(b, 1, 10 + b, 1, (0, b))], SEQ_DDL), path, "old", b)
    write_updates(spark.createDataFrame([(7, 1, 70, 1, (1, 0)), (0, 1, 99, 1, (1, 1))], SEQ_DDL), path, "new", 0)
    want = [(0, 1, 99, 1), (1, 1, 11, 1), (2, 1, 12, 1), (7, 1, 70, 1), (9, 9, 1, 1)]
    assert now() == want
    write_updates(spark.createDataFrame([(0, 1, 10, 1, (0, 0))], SEQ_DDL), path, "old", 0)
    assert now() == want
    v0, v1, v2 = (uniq("t_snap") for _ in range(3))
    write_bucketed(state, v0, f"{base}/v0", ("product",), 4)
    snap, n = merge_into_table(spark, v0, read_updates(spark, path), v1, f"{base}/v1", order_col="seq", buckets=4)
    assert rows(snap.drop("seq")) == want and n == 4
    again, n = merge_into_table(spark, v1, read_updates(spark, path), v2, f"{base}/v2", order_col="seq", buckets=4)
    assert rows(again) == rows(snap) and n == 0
    # an older run's request never replaces a newer run's value, although its id is greater
    write_updates(spark.createDataFrame([(7, 1, 1, 1, (0, 50)), (8, 1, 80, 1, (0, 51))], SEQ_DDL), path, "new", 1)
    want = sorted([*want, (8, 1, 80, 1)])
    assert now() == want and now(snap) == want


def test_restarted_stream_adds_to_the_updates(spark):
    """The query id names the stream: a second checkpoint over new files continues beside the first."""
    from pinprice.session import shared_dir
    from pinprice.sources.fixtures import fixture_tables
    from pinprice.streaming.requests import current_prices, read_updates, stream_merge_prices

    t = fixture_tables(spark, SF001)
    base = shared_dir(spark, "test-stream")
    half = t["requests"].where("request_id < 500"), t["requests"].where("request_id >= 500")
    for i, part in enumerate(half):
        part.coalesce(1).write.parquet(f"{base}/src{i}")
        stream_merge_prices(spark, f"{base}/src{i}", f"{base}/updates", f"{base}/ckpt{i}", t["zoneprices"], t["pincodes"],
                            t["productinfos"]).awaitTermination()
    got = rows(current_prices(t["product_prices"], read_updates(spark, f"{base}/updates")).drop("seq"))
    assert got == rows(E.queries()["q25_stream_merge_prices"](spark, SF001))
    assert spark.read.parquet(f"{base}/updates").select("stream").distinct().count() == 2
