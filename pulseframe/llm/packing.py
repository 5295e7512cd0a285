"""Whole texts into containers of a fixed number of tokens, by optimal length buckets.

The global histogram of lengths (bounded by the capacity) is all the driver sees. Dynamic
programming over it chooses the bucket boundaries with the least padding. Token-budget batches are
planned over the buckets' sizes alone: a batch repeats texts of one bucket as often as the budget
allows and is topped up from shorter buckets, since a batch of one long bucket would leave up to half
of its container free. Inside each bucket texts are numbered by a global range sort with partition
offsets, and the number alone decides the container.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rangescan import number_rows
from ..scratch import materialize

CAPACITY = 1024
#: Python's word and blank classes, spelled out for Java: a token is a run of word characters, or of neither word characters nor blanks.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f\x85\xa0  -     　]+"


def regex_tokens(text: Column) -> Column:
    """Tokens of a text: matches of a Unicode ``\\w+|[^\\w\\s]+``; null counts as an empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def plan_buckets(histogram: dict[int, int], capacity: int, max_buckets: int = 160) -> list[int]:
    """Upper bounds of the length buckets with the least padding, by dynamic programming.

    Every text counts as long as its bucket's upper bound; the padding of a bucket (a, b] is the sum
    of b - length over its texts.
    """
    lengths = np.array(sorted(length for length, n in histogram.items() if n and 0 < length <= capacity))
    m = len(lengths)
    if m <= max_buckets:
        return lengths.tolist()
    n = np.array([histogram[x] for x in lengths], float)
    count, total = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(n * lengths)))
    # cost[i, j]: padding if the lengths i..j-1 share a bucket
    j = np.arange(1, m + 1)
    cost = np.full((m + 1, m + 1), np.inf)
    cost[:, 1:] = lengths[j - 1] * (count[j] - count[:, None]) - (total[j] - total[:, None])
    cost[np.arange(m + 1)[:, None] >= np.arange(m + 1)] = np.inf
    best, came = np.full(m + 1, np.inf), []
    best[0] = 0
    for _ in range(max_buckets):
        through = best[:, None] + cost
        came.append(through.argmin(0))
        best = through.min(0)
    bounds, at = [], m
    for back in reversed(came):
        bounds.append(int(lengths[at - 1]))
        at = int(back[at])
    return sorted(bounds)


def plan_batches(sizes: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Token-budget batches over bucket sizes: [(texts of each size in a container, containers)].

    A batch takes as many texts of the longest remaining bucket as the budget allows and is topped up
    from shorter buckets; the same batch repeats until one of its buckets is used up.
    """
    left, plan = dict(sorted(sizes.items(), reverse=True)), []
    while left:
        room, use = capacity, {}
        for size, n in left.items():
            if k := min(room // size, n):
                use[size] = k
                room -= k * size
        times = min(left[s] // k for s, k in use.items())
        plan.append((use, times))
        left = {s: rest for s, n in left.items() if (rest := n - use.get(s, 0) * times)}
    return plan


def pack(lengths: DataFrame, capacity: int = CAPACITY, max_buckets: int = 160) -> DataFrame:
    """Containers for texts of known length.

    ``lengths``: (doc_id bigint, n_tokens bigint), one row per text. Result: (doc_id, n_tokens,
    piece_no, piece_tokens, container_id). A text of at most ``capacity`` tokens lies whole in one
    container (piece_no 0). A longer one is split into full containers and one rest, its pieces
    numbered from 0. Texts without tokens (null and empty ones) need no space and get no container
    (null). No container holds more than ``capacity`` tokens. An empty table gives no rows.
    """
    spark = lengths.sparkSession
    full = F.floor((F.col("n_tokens") - 1) / capacity)
    cut = F.when(F.col("n_tokens") > capacity, F.sequence(F.lit(0).cast("long"), full)).otherwise(F.array(F.lit(0).cast("long")))
    pieces = lengths.select("doc_id", "n_tokens", F.explode(cut).alias("piece_no")).withColumn("piece_tokens", F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece_no") * capacity))
    # at most one row per possible length, whatever the number of texts
    histogram = {r["piece_tokens"]: r["n"] for r in pieces.groupBy("piece_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    bounds = plan_buckets(histogram, capacity, max_buckets)
    bucket = {length: bounds[bisect_left(bounds, length)] for length in histogram if length}
    sizes: dict[int, int] = {}
    for length, size in bucket.items():
        sizes[size] = sizes.get(size, 0) + histogram[length]
    rows, base, used = [], 0, dict.fromkeys(sizes, 0)
    for use, times in plan_batches(sizes, capacity):
        for size, k in use.items():
            rows.append((size, used[size], used[size] + k * times, k, base))
            used[size] += k * times
        base += times
    plan = spark.createDataFrame(rows, "bucket long, r0 long, r1 long, per long, base long")
    index = spark.createDataFrame(sorted(bucket.items()), "piece_tokens long, bucket long")
    # both tables are bounded by the capacity, not by the data
    sized = pieces.join(F.broadcast(index), "piece_tokens", "left").select("doc_id", "n_tokens", "piece_no", "piece_tokens", "bucket")
    ranked = number_rows(sized.filter("bucket is not null"), "bucket", ["doc_id", "piece_no"]).alias("x")
    p = F.broadcast(plan).alias("p")
    placed = ranked.join(p, (F.col("x.bucket") == F.col("p.bucket")) & (F.col("rank") >= F.col("r0")) & (F.col("rank") < F.col("r1")))
    placed = placed.select("doc_id", "n_tokens", "piece_no", "piece_tokens", (F.col("base") + F.floor((F.col("rank") - F.col("r0")) / F.col("per"))).alias("container_id"))
    return placed.unionByName(sized.filter("bucket is null").select("doc_id", "n_tokens", "piece_no", "piece_tokens", F.lit(None).cast("long").alias("container_id")))


def pack_texts(docs: DataFrame, capacity: int = CAPACITY, count=regex_tokens) -> DataFrame:
    """``pack`` for (doc_id, text): repeated doc_ids count once, ``count`` gives the tokens of a text column."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), count(F.col("text")).alias("n_tokens"))
    once = sized.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))
    return pack(materialize(once, "lengths"), capacity)
