import pytest
from pyspark.errors import StreamingQueryException

from tessera.streaming import frames

PIXELS = "panel int, frame int, z int, y int, x int, value double"


def stream(spark, tmp_path, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, PIXELS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    return spark.readStream.schema(PIXELS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")


def run(spark, tmp_path, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def plane(z):
    return [(0, z, z, y, x, float(100 * z + 10 * y + x)) for y in range(3) for x in range(4)]


def test_frames_in_order(spark, tmp_path):
    got = run(spark, tmp_path, frames.pushed_frames(stream(spark, tmp_path, [plane(0), plane(1) + plane(2)])), "frames_in_order")
    assert sorted((r.frame, r.n, r.total) for r in got) == [(z, 12, sum(p[5] for p in plane(z))) for z in range(3)]


def test_frames_out_of_order(spark, tmp_path):
    with pytest.raises(StreamingQueryException):
        run(spark, tmp_path, frames.pushed_frames(stream(spark, tmp_path, [plane(0), plane(2)])), "frames_out_of_order")


def test_boxes_of_a_stream(spark, tmp_path):
    boxes = spark.createDataFrame([(1, 0, 1, 3, 0, 2, 0, 2), (2, 0, 0, 1, 2, 3, 1, 3), (3, 0, 0, 1, 0, 1, 2, 9), (4, 1, 0, 1, 0, 1, 0, 1)], "row_id long, panel int, x0 int, x1 int, y0 int, y1 int, z0 int, z1 int")
    got = run(spark, tmp_path, frames.cut_boxes(stream(spark, tmp_path, [plane(z) for z in range(3)]), boxes), "boxes_of_a_stream")
    assert {r.row_id: r.data for r in got} == {1: [1.0, 2.0, 11.0, 12.0, 101.0, 102.0, 111.0, 112.0], 2: [120.0, 220.0]}
