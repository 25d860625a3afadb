"""The queue as a stream against the loop over all jobs."""

import random

from loomgate.streaming.queue import queue_outcomes, serve


def test_stream_of_jobs(spark, tmp_path):
    """State goes from batch to batch: two servers, three files, an age limit that binds, and a job without a time."""
    rng, jobs = random.Random(6), []
    clock = {"a": 0, "b": 0}
    for i in range(90):
        s = rng.choice("ab")
        clock[s] += rng.randrange(0, 60)
        jobs.append((s, f"j{i:02d}", clock[s], rng.randrange(1, 90)))
    schema = "server string, job_id string, arrival_us bigint, service_us bigint"
    for k in range(3):
        part = jobs[k * 30 : k * 30 + 30] + ([("a", "none", None, 5)] if k == 1 else [])
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    done = queue_outcomes(stream, 100).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    try:
        assert done.awaitTermination(120)
    finally:
        done.stop()
    got = {r["job_id"]: tuple(r)[2:] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {}
    for s in "ab":
        mine = sorted([(j, a, us) for x, j, a, us in jobs if x == s], key=lambda r: (r[1], r[0]))
        want |= {o[0]: o[1:] for o in serve(0, mine, 100)[1]}
    assert got == want and any(o[-1] for o in want.values()) and len(want) == 90
