"""Held-out passages that leaked into a corpus.

Word windows of the items and of every text get SimHash fingerprints in which rare words of the items weigh
more than common ones, so a changed common word moves few bits. A window is as long as the smallest piece of a
passage. With the fingerprint cut into one block more than the Hamming radius, two fingerprints within the
radius agree in at least one block, so looking up every block finds all window pairs within the radius.
Every such pair makes its text and item a candidate; the exact weighted similarity of their five-word shingles
decides, in which words of stock sentences (sentences that recur throughout the corpus) weigh nothing.

The items are the stated query set, held in memory in portions of bounded size; texts are only
scanned, never shuffled or compared with each other but for the hashes that tell copies.
"""

from __future__ import annotations

import re
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize

#: Words of a window (the smallest piece of a passage), Hamming radius, and blocks of a 64-bit fingerprint (one more than the radius).
WINDOW, RADIUS, BLOCKS = 12, 3, 4
#: Weights of words run from 1 to this, by the number of items that hold them; WINDOW times it must fit in a signed byte.
LEVELS = 5
#: Running words of an item that count as a leak.
LEAK = 24
#: Words of a shingle, words skipped on either side between shared shingles of a piece, the smallest piece of a passage in two, and the share of a piece's weight that shared shingles must cover.
SHINGLE, SLIP, PIECE, AGREE = 5, 6, 12, 0.8
#: A sentence is stock if it stands in this share of all texts and in this many at least.
STOCK_SHARE, STOCK_TEXTS = 0.004, 5
#: Characters of words on either side that tell surroundings apart: beyond a block of stock sentences, so that copies of a text count once.
AROUND = 300
#: (sentence, surroundings) pairs that a task gathers before it passes them on.
_FLUSH = 100_000
#: Items that are held in memory at once, words that are fingerprinted at once, words remembered by a task.
PORTION, CHUNK, KNOWN = 10_000, 100_000, 400_000

_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words(text: str) -> list[str]:
    """Lower-case words of a text, without punctuation and markup characters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(text.lower())


def word_weights(items: list[list[str]]) -> dict[str, int]:
    """Weight of every word of the items: LEVELS if one item holds it, falling with the logarithm of their number."""
    held: dict[str, int] = {}
    for ws in items:
        for w in set(ws):
            held[w] = held.get(w, 0) + 1
    most = np.log(1 + max(1, len(items)))
    return {w: max(1, round(LEVELS * float(np.log(1 + len(items) / k) / most))) for w, k in held.items()}


class _Numbers(dict):
    """Word to number; a new word gets the next one and its 64 signs times its weight."""

    def __init__(self, weights: dict[str, int], known=()):
        super().__init__(known)
        self.weights = weights
        self.signs = np.empty((1 << 12, 64), np.int8)

    def __missing__(self, word):
        k = self[word] = len(self)
        if k >= len(self.signs):
            self.signs = np.concatenate((self.signs, np.empty_like(self.signs)))
        bits = np.unpackbits(np.frombuffer(xxhash.xxh3_64_digest(word.encode()), np.uint8))
        self.signs[k] = (bits.astype(np.int8) * 2 - 1) * self.weights.get(word, LEVELS)
        return k


class _Vocabulary:
    """Numbers words and keeps their weighted signs."""

    def __init__(self, weights: dict[str, int]):
        self.weights = weights
        self.ids = _Numbers(weights)
        self.known = 0

    def number(self, ws: list[str]) -> np.ndarray:
        return np.fromiter(map(self.ids.__getitem__, ws), np.int64, len(ws))

    def keep(self) -> None:
        """The words so far keep their numbers for good."""
        self.known = len(self.ids)

    def forget(self) -> None:
        """All other words are met anew."""
        signs = self.ids.signs
        self.ids = _Numbers(self.weights, list(self.ids.items())[: self.known])
        self.ids.signs = signs[: max(self.known, 1 << 12)].copy()

    def fingerprints(self, ids: np.ndarray) -> np.ndarray:
        """SimHash of every window of WINDOW words."""
        if len(ids) < WINDOW:
            return np.empty(0, np.uint64)
        # sums over 1, 2, 4, ... words; those that make up WINDOW are put side by side
        part, size, total, done = self.ids.signs[ids], 1, None, 0
        while done < WINDOW:
            if WINDOW & size:
                total = part if total is None else total[: len(part) - done] + part[done : done + len(total)]
                done += size
            if done < WINDOW:
                part = part[:-size] + part[size:]
                size *= 2
        return np.packbits(total[: len(ids) - WINDOW + 1] > 0, axis=1).view(np.uint64).ravel()


def item_words(text: str) -> list[str]:
    """Words of an item, sentence by sentence."""
    return [w for part in _SENTENCE.split(text) for w in words(part)]


class _Items:
    """Index of the items' windows: by every block of their fingerprints."""

    def __init__(self, items: list[tuple[int, str]], vocabulary: _Vocabulary):
        self.item, self.ids, self.weights, self.shingles = [i for i, _ in items], [], [], []
        of, at, prints = [], [], []
        self.sentences: list[tuple[int, int, int, str]] = []
        for k, (_, text) in enumerate(items):
            ws: list[str] = []
            for part in _SENTENCE.split(text):
                if len(own := words(part)) >= 4:
                    self.sentences.append((k, len(ws), len(ws) + len(own), " ".join(own)))
                ws += own
            ids = vocabulary.number(ws)
            self.ids.append(ids)
            self.weights.append([vocabulary.weights[w] for w in ws])
            self.shingles.append(_sorted_shingles(ids))
            f = vocabulary.fingerprints(ids)
            of.append(np.full(len(f), k))
            at.append(np.arange(len(f)))
            prints.append(f)
        self.of, self.at, self.prints = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (of, at, prints))
        self.blocks = []
        for b in range(BLOCKS):
            v = _block(self.prints.astype(np.uint64), b)
            order = np.argsort(v, kind="stable")
            first = np.searchsorted(v[order], np.arange((1 << 16) + 1))
            self.blocks.append((order, first))
        self.automaton = ahocorasick.Automaton()
        for s in {s[3] for s in self.sentences}:
            self.automaton.add_word(f" {s} ", s)
        if self.sentences:
            self.automaton.make_automaton()

    def hits(self, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window of the text, window of an item) within the Hamming radius."""
        got = []
        for b, (order, first) in enumerate(self.blocks):
            v = _block(prints, b)
            lo, k = first[v], first[v + 1] - first[v]
            w = np.flatnonzero(k)
            left = np.repeat(w, k[w])
            if not len(left):
                continue
            right = order[np.repeat(lo[w], k[w]) + np.arange(len(left)) - np.repeat(np.cumsum(k[w]) - k[w], k[w])]
            near = np.bitwise_count(prints[left] ^ self.prints[right]) <= radius
            got.append(left[near] * len(self.prints) + right[near])
        pairs = np.unique(np.concatenate(got)) if got else np.empty(0, np.int64)
        return pairs // max(1, len(self.prints)), pairs % max(1, len(self.prints))


def _block(prints: np.ndarray, b: int) -> np.ndarray:
    return ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)


def _shingles(ids: np.ndarray) -> np.ndarray:
    n = max(0, len(ids) - SHINGLE + 1)
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64) + np.uint64(1)
    return h


def _sorted_shingles(item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mine = _shingles(item)
    order = np.argsort(mine, kind="stable")
    return mine[order], order


def _runs(item: np.ndarray, text: np.ndarray, mine: tuple | None = None, other: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Maximal runs (place in the item, place in the text, words) of shared shingles, in the text's order."""
    mine, order = mine or _sorted_shingles(item)
    other = _shingles(text) if other is None else other
    lo, hi = np.searchsorted(mine, other, "left"), np.searchsorted(mine, other, "right")
    k = hi - lo
    at = np.flatnonzero(k)
    b = np.repeat(at, k[at])
    if not len(b):
        return []
    a = order[np.repeat(lo[at], k[at]) + np.arange(len(b)) - np.repeat(np.cumsum(k[at]) - k[at], k[at])]
    same = (item[a[:, None] + np.arange(SHINGLE)] == text[b[:, None] + np.arange(SHINGLE)]).all(1)
    a, b = a[same], b[same]
    by = np.lexsort((a, b - a))
    a, b = a[by], b[by]
    new = np.concatenate(([True], (b[1:] - a[1:] != b[:-1] - a[:-1]) | (a[1:] != a[:-1] + 1)))
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(a))) + SHINGLE - 1
    return sorted(zip(a[start].tolist(), b[start].tolist(), size.tolist()), key=lambda r: r[1]) if len(a) else []


def pieces(item: np.ndarray, text: np.ndarray, mine: tuple | None = None, other: np.ndarray | None = None) -> list[list[tuple[int, int]]]:
    """Passages of the item in the text: chains of runs with at most SLIP words between them.

    Each piece is its runs as (first, behind last) places in the item, in order.
    """
    found: list[list[tuple[int, int]]] = []
    runs = _runs(item, text, mine, other)
    if sum(n for *_, n in runs) < PIECE:
        return found
    best: list[tuple[int, int | None]] = []
    for j, (a, b, n) in enumerate(runs):
        score, came = n, None
        for i in range(j - 1, -1, -1):
            pa_, pb, pn = runs[i]
            if b - pb > len(item) + SLIP:
                break
            if -2 <= a - (pa_ + pn) <= SLIP and -2 <= b - (pb + pn) <= SLIP and a > pa_ and b > pb and best[i][0] + n > score:
                score, came = best[i][0] + n, i
        best.append((score, came))
    used: set[int] = set()
    for j in sorted(range(len(runs)), key=lambda k: -best[k][0]):
        if j in used or best[j][0] < PIECE:
            continue
        chain, k = [], j
        while k is not None and k not in used:
            chain.append((runs[k][0], runs[k][0] + runs[k][2]))
            used.add(k)
            k = best[k][1]
        found.append(chain[::-1])
    return found


def leaked_words(found: list[list[tuple[int, int]]], stock: set[int], weights: list[int] | None = None) -> int:
    """Running words of the item in the best passage, in one piece or two that follow each other in the item.

    A piece counts if the words that shared shingles cover carry AGREE of its weight; stock words weigh nothing.
    """
    spans = []
    for chain in found:
        hit = {p for a, z in chain for p in range(a, z)}
        lo, hi = chain[0][0], max(z for _, z in chain)
        free = [p for p in range(lo, hi) if p not in stock]
        weight = (lambda ps: sum(weights[p] for p in ps)) if weights else len
        shared = [p for p in free if p in hit]
        if len(shared) >= PIECE and weight(shared) >= AGREE * weight(free):
            spans.append((lo, hi, len(shared), len(free)))
    best = max((n for *_, n in spans), default=0)
    for x in spans:
        for y in spans:
            if x[2] >= PIECE and y[2] >= PIECE and x[0] < y[0] and -2 <= y[0] - x[1] <= SLIP:
                best = max(best, x[3] + y[3])
    return best


def _could_leak(found: list[list[tuple[int, int]]]) -> bool:
    """Whether any choice of stock words leaves a leak: the spans of pieces hold its words."""
    return sum(max(z for _, z in c) - c[0][0] for c in found) >= LEAK


_OUT = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("item_id", pa.int64()), ("n", pa.int64()), ("sentence", pa.string()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("piece", pa.list_(pa.int32()))])


def _scanner(items: list[tuple[int, str]], portion: int, weights: dict[str, int], radius: int):
    def scan(batches):
        vocabulary = _Vocabulary(weights)
        index = _Items(items, vocabulary)
        vocabulary.keep()
        stands: set[tuple[str, int]] = set()

        def drain():
            got = pa.RecordBatch.from_pylist([{"kind": 1, "item_id": portion, "n": n, "sentence": s} for s, n in stands], schema=_OUT)
            stands.clear()
            return got

        for batch in batches:
            rows = []
            held: list[np.ndarray] = []
            ids: list[int] = []
            size = 0

            def flush():
                nonlocal held, ids, size
                rows.extend(_compare(index, vocabulary, held, ids, radius))
                held, ids, size = [], [], 0

            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not text:
                    continue
                ws = words(text)
                if len(ws) < PIECE:
                    continue
                if index.sentences:
                    stands.update(_surroundings(index.automaton, f" {' '.join(ws)} "))
                held.append(vocabulary.number(ws))
                ids.append(doc)
                size += len(ws)
                if size >= CHUNK:
                    flush()
            flush()
            if len(vocabulary.ids) > KNOWN:
                vocabulary.forget()
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_OUT)
            if len(stands) > _FLUSH:
                yield drain()
        if stands:
            yield drain()

    return scan


def _surroundings(automaton, text: str):
    """Each sentence that stands in a text with a hash of the words around its first occurrence."""
    first: dict[str, int] = {}
    for end, s in automaton.iter(text):
        first.setdefault(s, end)
    for s, end in first.items():
        at = end - len(s) - 1
        around = f"{text[max(0, at - AROUND) : at]}\n{text[end + 1 : end + 1 + AROUND]}"
        yield s, xxhash.xxh3_64_intdigest(around.encode()) - (1 << 63)


def _compare(index: _Items, vocabulary: _Vocabulary, held: list[np.ndarray], ids: list[int], radius: int) -> list[dict]:
    if not held:
        return []
    flat = np.concatenate(held)
    start = np.cumsum([0, *map(len, held)])
    of = np.repeat(np.arange(len(held)), np.diff(start))
    lefts, rights = [], []
    for lo in range(0, len(flat), CHUNK):  # a very long text is fingerprinted in portions, too
        part = flat[lo : lo + CHUNK + WINDOW - 1]
        left, right = index.hits(vocabulary.fingerprints(part), radius)
        lefts.append(left + lo)
        rights.append(right)
    left, right = np.concatenate(lefts), np.concatenate(rights)
    inside = (left + WINDOW <= len(flat)) & (of[np.minimum(left + WINDOW - 1, len(flat) - 1)] == of[np.minimum(left, len(flat) - 1)]) if len(left) else np.empty(0, bool)
    left, right = left[inside], right[inside]
    out = []
    if not len(left):
        return out
    pairs = np.unique(of[left] * len(index.item) + index.of[right])
    shingles, of_text = None, -1
    for d, i in zip((pairs // len(index.item)).tolist(), (pairs % len(index.item)).tolist()):
        if d != of_text:
            shingles, of_text = _shingles(held[d]), d
        found = pieces(index.ids[i], held[d], index.shingles[i], shingles)
        if _could_leak(found):
            flat_runs = [(a, z, p) for p, chain in enumerate(found) for a, z in chain]
            out.append({"kind": 0, "doc_id": ids[d], "item_id": index.item[i], "starts": [a for a, _, _ in flat_runs], "ends": [z for _, z, _ in flat_runs], "piece": [p for *_, p in flat_runs]})
    return out


def find_leaks(docs: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Texts that hold passages of held-out items.

    ``docs``: (doc_id bigint, text), ``items``: (item_id bigint, text); other columns are ignored. Result:
    (item_id, doc_id, n_words), one row per pair in which ``n_words`` >= 24 running words of the item stand
    in the text, in one piece or in two that follow each other in the item, where shared five-word shingles cover at
    least 80 % of each piece (so single words may be changed, left out or added). Case, blanks and punctuation don't matter; words of stock
    sentences don't count. Null, empty and short texts or items give no rows; repeated doc_ids give one row;
    texts of any length are scanned whole. An empty table gives no rows. A ``radius`` below RADIUS looks up
    equal blocks all the same and keeps fewer window pairs, to measure what the radius adds.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null and text != ''")
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    # the stated query set, in portions of bounded size against all texts
    asked = [(r["item_id"], r["text"]) for r in asked.orderBy("item_id").toLocalIterator()]
    own_words = {i: item_words(t) for i, t in asked}
    weights = word_weights(list(own_words.values()))
    scans = [texts.mapInArrow(_scanner(asked[k : k + PORTION], k, weights, radius), "kind int, doc_id long, item_id long, n long, sentence string, starts array<int>, ends array<int>, piece array<int>") for k in range(0, len(asked), PORTION)]
    if not scans:
        return spark.createDataFrame([], "item_id long, doc_id long, n_words long")
    whole = scans[0]
    for s in scans[1:]:
        whole = whole.unionByName(s)
    found = materialize(whole, "leaks")
    # copies of a text vouch for their sentences once, and only their hashes are compared
    total = texts.select(F.xxhash64("text").alias("h")).distinct().count()
    often = found.filter("kind = 1").groupBy("sentence", "item_id").agg(F.countDistinct("n").alias("n"))
    least = max(STOCK_TEXTS, STOCK_SHARE * total)
    # bounded by the number of the items' sentences
    stock_sentences = {r["sentence"] for r in often.filter(F.col("n") >= least).select("sentence").collect()}
    stock = {}
    for k in range(0, len(asked), PORTION):
        part = asked[k : k + PORTION]
        for i, a, z, s in _sentences(part):
            if s in stock_sentences:
                stock.setdefault(part[i][0], set()).update(range(a, z))

    item_weights = {i: [weights[w] for w in ws] for i, ws in own_words.items()}

    def decide(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                chains: dict[int, list] = {}
                for a, z, p in zip(r["starts"], r["ends"], r["piece"]):
                    chains.setdefault(p, []).append((a, z))
                n = leaked_words(list(chains.values()), stock.get(r["item_id"], set()), item_weights[r["item_id"]])
                if n >= LEAK:
                    rows.append({"item_id": r["item_id"], "doc_id": r["doc_id"], "n_words": n})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64())]))

    pairs = found.filter("kind = 0").select("item_id", "doc_id", "starts", "ends", "piece")
    return pairs.mapInArrow(decide, "item_id long, doc_id long, n_words long").groupBy("item_id", "doc_id").agg(F.max("n_words").alias("n_words"))


def _sentences(items: list[tuple[int, str]]):
    for k, (_, text) in enumerate(items):
        at = 0
        for part in _SENTENCE.split(text):
            own = words(part)
            if len(own) >= 4:
                yield k, at, at + len(own), " ".join(own)
            at += len(own)
