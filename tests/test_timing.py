import pandas as pd

from pulseframe.plans import timing


def test_transition_pivot_keeps_every_type(spark, tmp_path):
    kinds = ["t1", "t2", "t3", "t4", "t5", "t6", "t7", "t1"]
    rows = [(1, i, pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=i), k, 1.0) for i, k in enumerate(kinds)]
    spark.createDataFrame(pd.DataFrame(rows, columns=["user_id", "event_id", "ts", "event_type", "value"])).write.parquet(f"{tmp_path}/events.parquet")
    p = timing.transition_pivot(spark, str(tmp_path))
    assert p.columns == ["event_type", *("n_" + c for c in "abcdefg")]
    got = {r.event_type: r for r in p.collect()}
    assert got["t5"].n_f == 1 and got["t6"].n_g == 1 and got["t7"].n_a == 1
    assert sum(v for r in got.values() for v in r[1:]) == 7
