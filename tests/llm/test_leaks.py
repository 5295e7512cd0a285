import random

import numpy as np
from pyspark.sql import functions as F

from pulseframe.llm import leaks
from pulseframe.llm.leaks import find_leaks, words

WORDS = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "lt", "x", "m")]


def text(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def corpus(seed=1):
    rng = random.Random(seed)
    items = [(i, text(rng, 90)) for i in range(6)]
    docs, want = [], set()

    def put(inside, item=None):
        doc = len(docs)
        docs.append((doc, " ".join(text(rng, 60) + inside + text(rng, 60))))
        if item is not None:
            want.add((item, doc))

    put(items[0][1], 0)
    put(items[1][1][20:46], 1)
    put([w for i, w in enumerate(items[2][1]) if i % 10 != 3], 2)
    put([rng.choice(WORDS) if i % 9 == 4 else w for i, w in enumerate(items[3][1])], 3)
    put(items[4][1][:16] + text(rng, 40) + items[4][1][16:32], 4)
    put(items[5][1][10:24])
    docs.append((len(docs), "**" + ",\n".join(w.upper() for w in items[5][1][5:50]) + "**"))
    want.add((5, len(docs) - 1))
    docs += [(len(docs) + k, " ".join(text(rng, 150))) for k in range(60)]
    return items, docs, want


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(7)).withColumn("kind", F.lit("x"))
    return {(r.item_id, r.doc_id) for r in find_leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect()}


def test_finds_passages_whole_and_in_part(spark, monkeypatch):
    items, docs, want = corpus()
    asked = [(i, " ".join(w)) for i, w in items]
    docs += [docs[0], (900, None), (901, ""), (902, "!!! ..."), (None, docs[0][1])]
    assert run(spark, docs, [*asked, (70, None), (71, ""), (72, "short one")]) == want
    monkeypatch.setattr(leaks, "PORTION", 2)
    monkeypatch.setattr(leaks, "CHUNK", 333)
    monkeypatch.setattr(leaks, "KNOWN", 100)
    assert run(spark, docs, asked) == want


def test_stock_sentences_do_not_count(spark):
    rng = random.Random(2)
    stock = " ".join(text(rng, 30)).capitalize() + "."
    item = stock + " " + " ".join(text(rng, 60)).capitalize() + "."
    docs = [(i, " ".join(text(rng, 80)).capitalize() + ". " + stock) for i in range(12)] + [(50, item)]
    assert run(spark, docs, [(1, item)]) == {(1, 50)}


def test_copies_of_a_text_make_no_stock_sentences(spark):
    rng = random.Random(7)
    sentence = lambda n: " ".join(text(rng, n)).capitalize() + "."
    item = " ".join(sentence(12) for _ in range(4))
    stock = " ".join(sentence(12) for _ in range(3))
    leak = f"{sentence(40)} {item} {sentence(70)}"
    docs = [(i, leak) for i in range(10)] + [(10 + i, f"{leak} {sentence(5)}") for i in range(2)] + [(12, f"{sentence(60)} {item}")]
    docs += [(20 + i, f"{sentence(80)} {stock}") for i in range(12)] + [(50, f"{sentence(80)} {stock}")]
    assert run(spark, docs, [(1, item), (2, stock)]) == {(1, i) for i in range(13)}


def test_very_long_text_and_empty_tables(spark):
    rng = random.Random(3)
    item = text(rng, 60)
    long = text(rng, 120_000) + item + text(rng, 50_000)
    assert run(spark, [(1, " ".join(long))], [(5, " ".join(item))]) == {(5, 1)}
    assert run(spark, [], [(5, " ".join(item))]) == set()
    assert run(spark, [(1, "a b c")], []) == set()


def test_block_lookup_is_complete_within_the_radius():
    rng = np.random.default_rng(4)
    v = leaks._Vocabulary({})
    v.weights.update(dict.fromkeys(WORDS, 3))
    index = leaks._Items([(1, " ".join(text(random.Random(5), 100)))], v)
    base = index.prints[rng.integers(0, len(index.prints), 500)]
    for r in range(leaks.RADIUS + 1):
        flips = np.zeros(500, np.uint64)
        for i in range(500):
            for b in rng.choice(64, r, replace=False):
                flips[i] |= np.uint64(1) << np.uint64(b)
        left, right = index.hits(base ^ flips, leaks.RADIUS)
        got = set(zip(left.tolist(), right.tolist()))
        want = {(i, j) for i in range(500) for j in range(len(index.prints)) if int(np.bitwise_count(base[i] ^ flips[i] ^ index.prints[j])) <= leaks.RADIUS}
        assert got == want


def common_changes(seed, n_docs=40):
    """Items whose leaked copies have a common word changed in every window: no window is a plain copy."""
    rng = random.Random(seed)
    common = [f"c{k}" for k in range(8)]
    rare = lambda k: f"r{seed}x{k}"
    items, docs = [], []
    for i in range(n_docs):
        ws = [rare(1000 * i + k) if k % 3 else common[(k + i) % 8] for k in range(90)]
        items.append((i, " ".join(ws)))
        changed = [rng.choice(common) if k % 9 == 3 else w for k, w in enumerate(ws)]
        changed = [w if k % 9 != 3 or w != ws[k] else common[(k + i + 1) % 8] for k, w in enumerate(changed)]
        docs.append((i, " ".join(text(rng, 30) + changed[21:49] + text(rng, 30))))
    return items, docs


def test_the_radius_finds_passages_with_changed_words(spark):
    items, docs = common_changes(3)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = lambda r: {(x.item_id, x.doc_id) for x in find_leaks(d, i, radius=r).collect()}
    want = {(k, k) for k in range(len(docs))}
    assert len(found(leaks.RADIUS) & want) >= 0.9 * len(want) and found(leaks.RADIUS) <= want
    # no window is a copy; some altered ones still have the same fingerprint
    assert len(found(0) & want) <= 0.75 * len(found(leaks.RADIUS) & want)


def test_candidates_against_brute_force():
    """Windows within the radius propose nearly every pair that the exact comparison accepts."""
    items, docs, want = corpus(7)
    weights = leaks.word_weights([w for _, w in items])
    v = leaks._Vocabulary(weights)
    index = leaks._Items([(i, " ".join(w)) for i, w in items], v)
    proposed = accepted = 0
    for _, t in docs:
        ids = v.number(words(t))
        near = set(index.of[index.hits(v.fingerprints(ids), leaks.RADIUS)[1]].tolist())
        for i in range(len(items)):
            if leaks.leaked_words(leaks.pieces(index.ids[i], ids), set(), index.weights[i]) >= leaks.LEAK:
                accepted += 1
                proposed += i in near
    assert accepted >= len(want) and proposed >= 0.9 * accepted


def test_words_in_weighted_pieces():
    chain = [[(0, 12), (14, 24)]]
    assert leaks.leaked_words(chain, set()) == 24
    heavy = [1] * 12 + [5, 5] + [1] * 10
    assert leaks.leaked_words(chain, set(), heavy) == 0  # the words left out carry a third of the weight
    assert leaks.leaked_words(chain, {12, 13}, heavy) == 22


def test_words():
    assert words("A *bold*  Naïve\n12.5, re-run_x") == ["a", "bold", "naïve", "12", "5", "re", "run", "x"]


def test_forgetting_words_keeps_those_of_the_items():
    v = leaks._Vocabulary({})
    a = v.number(["x", "y", "x"])
    v.keep()
    v.number(["z", "q"])
    before = v.ids.signs[:2].copy()
    v.forget()
    assert v.number(["y", "new", "x"]).tolist() == [a[1], 2, a[0]] and (v.ids.signs[:2] == before).all()


def test_runs_are_maximal():
    rng = np.random.default_rng(6)
    item, doc = rng.integers(0, 50, 60), rng.integers(0, 50, 300)
    doc[100:130] = item[10:40]
    doc[200:206] = item[0:6]
    got = leaks._runs(item, doc)
    want = []
    for a in range(60):
        for b in range(300):
            if item[a] == doc[b] and (a == 0 or b == 0 or item[a - 1] != doc[b - 1]):
                n = 0
                while a + n < 60 and b + n < 300 and item[a + n] == doc[b + n]:
                    n += 1
                if n >= leaks.SHINGLE:
                    want.append((a, b, n))
    assert sorted(got) == sorted(want)
