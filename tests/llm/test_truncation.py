import random

from pyspark.sql import functions as F

from pulseframe.llm import truncation
from pulseframe.llm.truncation import truncated_texts

SUBJECTS = ["the neuron", "a quiet unit", "the second cell", "our reader", "the amplitude", "this recording"]
VERBS = ["changed slowly", "stayed constant", "recovered quickly", "became unstable", "returned later"]
TAILS = ["after the last sweep", "during the night", "before stimulation", "within two minutes", "near the electrode"]


def sentence(rng):
    return f"{rng.choice(SUBJECTS)} {rng.choice(VERBS)} {rng.choice(TAILS)}.".capitalize()


def corpus(seed=1):
    rng = random.Random(seed)
    docs, cut = [], set()

    def add(source, text, is_cut=False):
        docs.append((len(docs), source, text))
        if is_cut:
            cut.add(len(docs) - 1)

    for _ in range(300):
        add(rng.choice(("open", "notes")), " ".join(sentence(rng) for _ in range(rng.randrange(2, 8))))
    for _ in range(20):
        add("notes", sentence(rng) + "\n\nTo do:\n- check ground\n- plot widths")
        add("mail", sentence(rng) + "\n\n[sent from the tablet]")
    while len(cut) < 40:
        t = " ".join(sentence(rng) for _ in range(8))[:150]
        add("limited", t, not t.rstrip().endswith("."))
    for k in range(20):
        t = " ".join(sentence(rng) for _ in range(3))
        c = t[: rng.randrange(30, len(t) - 12)]
        c = c if not c.rstrip().endswith(".") else c + " The neur"
        add("mail", c + ("\n\n[sent from the tablet]" if k % 2 else "…"), True)
    return docs, cut


def test_cut_texts(spark):
    docs, cut = corpus()
    extra = [docs[0], (9000, "open", None), (9001, "open", ""), (9002, None, "  "), (9003, None, "The neuron changed slowly during the night."), (None, "open", "x")]
    df = spark.createDataFrame(docs + extra, "doc_id long, source string, text string").withColumn("kind", F.lit(1)).withColumn("short", F.lit(2))
    rows = {r.doc_id: r for r in truncated_texts(df).collect()}
    assert set(rows) == {d[0] for d in docs} | {9003}
    got = {i for i, r in rows.items() if r.truncated}
    assert len(got & cut) >= 0.95 * len(cut)
    assert len(got - cut) <= 2
    assert any(r.cut_word for r in rows.values()) and any(r.at_limit for r in rows.values())


def test_copies_of_a_cut_text_do_not_vouch_for_it(spark):
    docs, _ = corpus()
    docs = [(i, s, t) for i, s, t in docs]
    whole = "The neuron changed slowly during the night."
    cuts = {0: f"{whole}\nZirconium probes stayed near the", 1: f"{whole} The second cell became unsta\n\n[sent from the tablet]"}
    for k, copies in ((0, 4), (1, 150)):
        docs += [(5_000 + 1_000 * k + i, "open", cuts[k]) for i in range(copies)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    rows = {r.doc_id: r for r in truncated_texts(df).collect()}
    assert all(rows[5_000 + i].truncated for i in range(4))
    assert all(rows[6_000 + i].truncated and rows[6_000 + i].cut_word for i in range(150))


def test_long_text_and_empty_table(spark):
    text = "The neuron changed slowly during the night. " * 20_000
    df = spark.createDataFrame([(1, "a", text), (2, "a", text + "The neur")], "doc_id long, source string, text string")
    assert {r.doc_id: r.truncated for r in truncated_texts(df).collect()} == {1: False, 2: True}
    assert truncated_texts(df.limit(0)).count() == 0


def test_the_trie_decides(spark, monkeypatch):
    """Without a vocabulary only ellipses and length limits are left."""
    docs, cut = corpus()
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    with_trie = {r.doc_id for r in truncated_texts(df).filter("truncated").collect()}
    monkeypatch.setattr(truncation, "KNOWN", 10**9)
    left = truncated_texts(df).filter("truncated").collect()
    assert all(r.dots or r.at_limit for r in left)
    assert len(with_trie & cut) >= len(cut & {r.doc_id for r in left}) + 5


def test_many_and_long_service_lines(spark):
    """Nine recurring lines and one of two hundred characters may follow a cut."""
    docs, _ = corpus()
    service = "\n".join(f"[filed by desk {c}]" for c in "abcdefghi")
    long = "This message was sent by the recording service of the second laboratory and may hold readings that were not reviewed by anyone " + "at all " * 10 + "[end]"
    rng = random.Random(9)
    docs += [(3_000 + k, "desk", sentence(rng) + "\n" + service) for k in range(30)] + [(4_000 + k, "desk", sentence(rng) + "\n" + long) for k in range(30)]
    docs += [(5_000, "desk", "The neuron changed slowly during the ni\n" + service), (5_001, "desk", "The second cell became unsta\n" + long)]
    got = {r.doc_id for r in truncated_texts(spark.createDataFrame(docs, "doc_id long, source string, text string")).filter("truncated and source = 'desk'").collect()}
    assert got == {5_000, 5_001}
