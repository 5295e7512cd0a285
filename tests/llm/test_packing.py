import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from pulseframe.llm.packing import pack, pack_texts, plan_batches, plan_buckets, regex_tokens


def test_tokens_are_those_of_python(spark):
    texts = ["", " ", "a b,c!!", "naïve Ångström — 12.5µm", "日本語 テスト。", "x_y  z x…", "½ ² ٣", "a\tb\nc\x1cd", None, "é ok", "👍🏽 fine"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r.n for r in df.orderBy("i").select(regex_tokens(F.col("text")).alias("n")).collect()]
    assert got == [len(re.findall(r"\w+|[^\w\s]+", t or "")) for t in texts]


def test_buckets_are_optimal():
    rng = random.Random(1)
    hist = {n: rng.randrange(1, 9) for n in rng.sample(range(1, 60), 9)}
    lengths = sorted(hist)
    cost = lambda b: sum(hist[n] * (min(x for x in b if x >= n) - n) for n in lengths)
    for k in (1, 2, 4):
        best = min(cost((*c, lengths[-1])) for c in combinations(lengths[:-1], k - 1))
        got = plan_buckets(hist, 60, k)
        assert len(got) <= k and cost(got) == best


def test_batches_use_every_text_within_the_budget():
    rng = random.Random(2)
    sizes = {n: rng.randrange(1, 400) for n in rng.sample(range(1, 1025), 60)}
    plan = plan_batches(sizes, 1024)
    assert all(sum(s * k for s, k in use.items()) <= 1024 for use, _ in plan)
    for s, n in sizes.items():
        assert sum(use.get(s, 0) * times for use, times in plan) == n
    tokens = sum(s * n for s, n in sizes.items())
    least = max(tokens / 1024, sum(n for s, n in sizes.items() if s > 512))
    assert sum(t for _, t in plan) <= 1.1 * least


@pytest.mark.parametrize("buckets", [3, 160])
def test_containers(spark, buckets):
    rng = random.Random(3)
    lengths = [rng.choice((rng.randrange(1, 200), rng.randrange(1, 1025), 100)) for _ in range(600)] + [0, 0, 1024, 1025, 2048, 5000]
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n_tokens long")
    rows = pack(df, 1024, buckets).collect()
    held: dict = {}
    per_doc: dict = {}
    for r in rows:
        per_doc.setdefault(r.doc_id, []).append(r)
        if r.container_id is not None:
            held[r.container_id] = held.get(r.container_id, 0) + r.piece_tokens
    assert max(held.values()) <= 1024
    for i, n in enumerate(lengths):
        pieces = sorted(per_doc[i], key=lambda r: r.piece_no)
        assert sum(p.piece_tokens for p in pieces) == n
        assert len(pieces) == max(1, -(-n // 1024))
        assert all((p.container_id is None) == (n == 0) for p in pieces)


def test_texts(spark):
    df = spark.createDataFrame([(1, "a " * 1500), (2, None), (3, ""), (4, "b"), (4, "b")], "doc_id long, text string").withColumn("rank", F.lit(1))
    rows = pack_texts(df).collect()
    assert sorted((r.doc_id, r.piece_no, r.piece_tokens) for r in rows) == [(1, 0, 1024), (1, 1, 476), (2, 0, 0), (3, 0, 0), (4, 0, 1)]
    assert pack_texts(df.limit(0)).count() == 0
