import random

from pulseframe.operators.intervals import merge_intervals
from pulseframe.streaming import operators as streaming


def drain(spark, stream, mode, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_interval_union_agrees_with_batch(spark, tmp_path):
    rng = random.Random(8)
    rows = [(f"k{rng.randrange(4)}", s := rng.randrange(3000), s + rng.randrange(-2, 60)) for _ in range(300)] + [("k0", None, 5), ("k0", 5, None)]
    df = spark.createDataFrame(rows, "key string, start long, end long")
    for n, part in enumerate(df.randomSplit([1.0, 1.0, 1.0], seed=1)):
        part.coalesce(1).write.parquet(f"file://{tmp_path}/in/p{n}")
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    out = drain(spark, streaming.interval_union(src, "key"), "update", tmp_path, "intervals_out")
    rows = out.collect()
    last = {k: max(r.version for r in rows if r.key == k) for k in {r.key for r in rows}}
    got = sorted((r.key, r.seg_kind, r.start, r.end) for r in rows if r.version == last[r.key])
    assert got == sorted(tuple(r) for r in merge_intervals(df, "key", "start", "end", partitions=3).collect())


def test_refractory(spark, tmp_path):
    df = spark.createDataFrame([("a", 0), ("a", 5), ("a", 11), ("a", 12), ("b", 3), ("a", 21)], "k string, us long")
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    src = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    got = sorted(tuple(r) for r in drain(spark, streaming.refractory(src, "k", 10), "append", tmp_path, "refractory_out").collect())
    assert got == [("a", 0), ("a", 11), ("a", 21), ("b", 3)]
