import time

from cuespark.operators.segment import anchored_groups
from cuespark.streaming.segments import stream_groups

KIND = "video_id bigint, seq bigint, path string, timestamp double, signal double"


def test_groups_of_a_stream_match_the_batch(spark, tmp_path):
    """Groups run on over micro-batches; the one that is open at the end isn't given yet."""
    values = [0, 3, 6, 9, 12, 12.5, 4, 30, 31, 30]
    frames = spark.createDataFrame([(v, k, f"{v}-{k}", k / 2, float(x + v)) for v in (1, 2) for k, x in enumerate(values)], KIND)
    for part in range(0, len(values), 4):
        # the last row of the part before comes again, too late
        frames.where(f"seq >= {part - 1} and seq < {part + 4}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = (
        stream_groups(stream, 8.0)
        .writeStream.format("memory")
        .queryName("closed_groups")
        .option("checkpointLocation", f"{tmp_path}/state")
        .start()
    )
    row = lambda r: (r.video_id, r.seq, r.start_time, r.end_time, r.frame, r.n_frames)
    whole = sorted(map(row, anchored_groups(frames, 8.0).collect()))
    assert len(whole) == 6
    last = {v: max(r[1] for r in whole if r[0] == v) for v in (1, 2)}
    closed = [r for r in whole if r[1] < last[r[0]]]
    # batches go on for the timeouts' sake, so the stream is stopped once all rows are there
    until = time.time() + 90
    while query.isActive and time.time() < until and spark.table("closed_groups").count() < len(closed):
        time.sleep(0.5)
    query.stop()
    assert sorted(map(row, spark.table("closed_groups").collect())) == closed
