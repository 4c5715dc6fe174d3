import math
import random
from datetime import datetime, timedelta


from sparknorm.operators import graph
from sparknorm.streaming import transitions

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_a_restarted_stream_equals_the_batch(spark, tmp_path):
    rng = random.Random(1)
    start = datetime(2024, 1, 1)
    rows = [(g, start + timedelta(minutes=5 * w), a, b, rng.random()) for w in range(12) for g in ("x", "y", None) for a in range(3) for b in range(a + 1, 3) if rng.random() < 0.8]
    schema = "g string, at timestamp, a int, b int, w double"
    # three files: the second has rows that come late but within the watermark
    cut = lambda low, high: [r for r in rows if low <= (r[1] - start).seconds // 300 < high]
    early, middle, last = cut(0, 5), cut(5, 9), cut(9, 12)
    late = early[-4:]
    end = [("end", start + timedelta(days=1), 0, 1, 1.0)]
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        for k, part in enumerate((early[:-4], [*middle, *late], [*last, ("x", None, 0, 1, 1.0)], end, [("end", start + timedelta(days=2), 0, 1, 1.0), ("x", start, 0, 1, 99.0)])):
            rng.shuffle(part)
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            out = transitions.changes(stream, ["g"], "at", "1 hour")
            q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination(120)
            assert q.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = {(r["g"], r["at"]): r["delta"] for r in spark.read.parquet(str(tmp_path / "out")).where("g is null or g <> 'end'").collect()}
    want = {(r["g"], r["at"]): r["delta"] for r in graph.changes(spark.createDataFrame(rows, schema), ["g"], "at").collect()}
    assert set(got) == set(want) and len(want) > 25
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
