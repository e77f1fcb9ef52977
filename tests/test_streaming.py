import numpy as np

from sweepframe.operators.temporal import vitals_of
from sweepframe.streaming.vitals import trailing_vitals


def test_trailing_vitals(spark, tmp_path):
    signal = np.sin(2 * np.pi * 0.3 * np.arange(120) / 15)
    source = f"{tmp_path}/in"
    rows = [("a", i, float(x)) for i, x in enumerate(signal)] + [("b", 0, 1.0)]
    df = spark.createDataFrame(rows, "capture_id string, frame int, signal double")
    for part in (df.where("frame >= 60 and frame < 100"), df.where("frame < 60"), df.where("frame >= 95")):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        query = trailing_vitals(stream).writeStream.outputMode("update").foreachBatch(lambda d, i: d.write.mode("append").parquet(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {r.capture_id for r in got} == {"a"} and len(got) == 3
    last = max(got, key=lambda r: r.frame)
    assert last.frame == 119 and np.allclose(tuple(last)[2:], vitals_of(signal[-75:], 15.0))
