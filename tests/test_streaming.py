"""Streams in several micro-batches and over restarts against the batch layers."""


from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.test_series import frame, walk
from tidemark.operators import sessions
from tidemark.plans.config import SessionConfig
from tidemark.streaming.sessions import streaming_sessions

LAYER = ["bar", "session_name", *[f"prev_{s}_{e}" for s in ("asia", "london", "newyork") for e in ("high", "low")], "session_low_swept", "session_high_swept", "session_liquidity_long_valid", "session_liquidity_short_valid", "Session_Liquidity_Valid"]


def test_sweeps_over_micro_batches_and_a_restart(spark, tmp_path):
    rows = walk(150, 4) + walk(150, 9, symbol="Y")
    bars = frame(spark, rows).withColumns({"sd_demand_valid": F.col("bar") % 3 != 0, "sd_supply_valid": F.when(F.col("bar") % 5 != 0, F.col("bar") % 2 == 0)})
    source, out, kept = (str(tmp_path / n) for n in ("in", "out", "kept"))
    want = {(r["symbol"], r["time"]): tuple(r[c] for c in LAYER) for r in sessions.add_sessions(bars, SessionConfig()).collect()}
    last = max(t for _, t in want)
    stored = bars.drop("bar").withColumn("time", F.col("time").cast("timestamp"))
    shuffled = stored.withColumn("hour", F.unix_seconds("time") / 3600).withColumn("part", F.floor((F.col("hour") - F.min("hour").over(Window.partitionBy())) / 31)).persist()

    def run():
        stream = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = streaming_sessions(stream, lateness="2 hours").writeStream.format("parquet").option("path", out).option("checkpointLocation", kept).trigger(availableNow=True).start()
        query.awaitTermination()
        return query.recentProgress

    seen = 0
    for parts in ([0, 1], [2], [3, 4]):
        for k in parts:  # hours of one part come in any order
            shuffled.where(F.col("part") == k).select(stored.columns).orderBy(F.rand(k)).coalesce(1).write.mode("append").parquet(source)
        seen += len([p for p in run() if p.numInputRows])
    assert seen >= 5
    found = spark.read.parquet(out).collect()
    got = {(r["symbol"], r["time"].replace(tzinfo=None)): tuple(r[c] for c in LAYER) for r in found}
    assert len(found) == len(got) and all(want[k] == v for k, v in got.items())
    open_ = {k for k in want if k not in got}
    assert all((last - t).total_seconds() <= 2 * 3600 for _, t in open_) and len(got) >= len(want) - 8
    # a bar that comes after the watermark changes nothing
    stored.where("symbol = 'X'").orderBy("time").limit(3).withColumn("high", F.lit(1e6)).coalesce(1).write.mode("append").parquet(source)
    run()
    assert spark.read.parquet(out).count() == len(found)
