"""Stand-in tables against their twins."""

import random
from collections import Counter
from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

from tidemark.sources.adapters import SPARK, Views, view_sql, with_views


def test_quotes_are_asked_from_one_scan(spark, tmp_path):
    """The Spark texts of the price views give the twin's rows, also for NULLs and repeated keys, and read the markets once."""
    rng = random.Random(4)
    day = lambda d, s=0: datetime(2024, 1, 1) + timedelta(days=d, seconds=s)
    events = [(i, None if i % 37 == 0 else day(rng.randrange(25), rng.randrange(7200)), i % 20, ["view", "purchase"][i % 2], i * 1.37 % 90,
               None if i % 41 == 0 else f'{{"k": {i % 9}}}') for i in range(400)]
    orders = [(None if i % 67 == 0 else i // 2 if i % 29 == 0 else i, None if i % 31 == 0 else i % 50, "FOP"[i % 3], 1000.0 + i, day(i % 90),
               ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"][i % 4]) for i in range(600)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    v = Views(spark, str(tmp_path))
    for name, cols in (("quoted", "num, market_id, epoch_us(ts) as ts, place, rn"), ("prices", "market_id, epoch_us(ts) as ts, mid_price")):
        want = Counter(con.execute(with_views(f"select {cols} from {name}")).fetchall())
        got = Counter(tuple(r) for r in getattr(v, name).withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp"))).collect())
        assert len(want) > 50 and got == want
    assert view_sql(SPARK)["quoted"].count("from markets") == 1 and view_sql(SPARK)["quoted"].count("from trades") == 1
