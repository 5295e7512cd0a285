"""Texts that were cut by a field limit or lost in transfer.

One pass over the corpus counts its words, the ways its lines end and its recurring lines (service lines and
closers that may follow a cut). The vocabulary's trie is a table of prefixes, joined with the final tokens; no
dictionary is held by a task or the driver. The trie decides first: a text proper whose final token is an unknown
proper prefix of known words is cut. Only if the final token is a known word, or no word at all, can the line
be cut between words: it is if it stays open, without an end mark and not the way lines of its kind end. Of a
token the trie does not know, length evidence decides (texts piling up at their source's greatest length, in
characters or bytes), as it does for lines that could be complete. An ellipsis at the end is a cut. Copies of
a text vote once, and what may be a text's own cut is left out of the votes that judge it.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize

#: A line recurs if it stands in this share of the texts and this many at least.
RECURS_SHARE, RECURS = 0.0005, 5
#: Lines at the end that are looked at in the first pass; texts whose lines all recur are looked at whole in a second one.
TAIL_LINES = 6
#: Lines that begin alike may end in a token that ends this share of them, and this many at least.
END_SHARE, ENDS = 0.05, 3
#: Texts in which a word must stand inside to be known; texts at the greatest length, and their share, that make a limit.
KNOWN, AT_LIMIT, LIMIT_SHARE = 2, 5, 0.01

_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"[^\W\d_]+")
_END_MARK = re.compile(r"[.!?:;。！？][\"'”’»)\]*_`]*$|[\"”»)\]]$")
_ELLIPSIS = re.compile(r"(…|\.\.\.)[\"'”’»)\]*_]*$")

_SCHEMA = "kind string, k1 string, k2 string, n double, doc_id long, source string, chars long, bytes long, pos int, mark boolean, dots boolean, word string, single boolean"
_ARROW = pa.schema(
    [("kind", pa.string()), ("k1", pa.string()), ("k2", pa.string()), ("n", pa.float64()), ("doc_id", pa.int64()), ("source", pa.string()), ("chars", pa.int64()), ("bytes", pa.int64()), ("pos", pa.int32()), ("mark", pa.bool_()), ("dots", pa.bool_()), ("word", pa.string()), ("single", pa.bool_())]
)
#: Counts of a task are passed on when so many keys have gathered.
_FLUSH = 200_000


def _counter():
    words: dict[str, float] = {}
    ends: dict[tuple[str, str], float] = {}
    lines: dict[str, float] = {}

    def drain():
        n = len(words) + len(ends) + len(lines)
        cols = {f.name: [None] * n for f in _ARROW}
        cols["kind"] = ["w"] * len(words) + ["e"] * len(ends) + ["l"] * len(lines)
        cols["k1"] = [*words, *(a for a, _ in ends), *lines]
        cols["k2"] = [None] * len(words) + [b for _, b in ends] + [None] * len(lines)
        cols["n"] = [*words.values(), *ends.values(), *lines.values()]
        for d in (words, ends, lines):
            d.clear()
        return pa.RecordBatch.from_pydict(cols, schema=_ARROW)

    def scan(batches):
        for batch in batches:
            got = {f.name: [] for f in _ARROW}

            def add(**row):
                for name, column in got.items():
                    column.append(row.get(name))

            for doc, source, text, vote in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "source", "text", "vote"))):
                text = text.rstrip()
                if not text:
                    continue
                parts = [p for line in text.split("\n") if (p := line.strip())]
                for w in _inner_words(parts):
                    words[w] = words.get(w, 0) + vote
                for line in parts:
                    first, last, key, mark = _shape(line)
                    ends[first, "" if mark else last] = ends.get((first, "" if mark else last), 0) + vote
                    lines[key] = lines.get(key, 0) + vote
                for pos, line in enumerate(reversed(parts[-TAIL_LINES:])):
                    add(n=vote, doc_id=doc, source=source, chars=len(text), bytes=len(text.encode()), pos=pos, **_ending(line))
            yield pa.RecordBatch.from_pydict(got, schema=_ARROW)
            if len(words) + len(ends) + len(lines) > _FLUSH:
                yield drain()
        yield drain()

    return scan


def _ending(line: str) -> dict:
    first, last, key, mark = _shape(line)
    final = re.search(r"([^\W\d_]+)[*_`]*$", line)
    return {"kind": "d", "k1": first, "k2": f"{last}\n{key}", "mark": mark, "dots": bool(_ELLIPSIS.search(line)), "word": final[1].lower() if final else None, "single": first == last and len(line.split()) == 1}


def _earlier(batches):
    """The lines before the last TAIL_LINES of every text."""
    for batch in batches:
        got = {f.name: [] for f in _ARROW}
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            parts = [p for line in text.rstrip().split("\n") if (p := line.strip())]
            for pos, line in enumerate(reversed(parts[:-TAIL_LINES])):
                row = {"doc_id": doc, "pos": pos + TAIL_LINES, **_ending(line)}
                for name, column in got.items():
                    column.append(row.get(name))
        yield pa.RecordBatch.from_pydict(got, schema=_ARROW)


def _inner_words(parts: list[str]) -> set[str]:
    """Words of a text but for those that end it or an open line: a service line may follow the cut."""
    body = [_WORD.findall(line.lower()) for line in parts]
    for k, line in enumerate(parts):
        if k == len(parts) - 1 or not _END_MARK.search(line) or _ELLIPSIS.search(line):
            body[k] = body[k][:-1]
    return {w for line in body for w in line}


def _shape(line: str) -> tuple[str, str, str, bool]:
    """First and last token with digits levelled, a key of the whole levelled line, and whether it has an end mark."""
    level = _DIGITS.sub("#", line)
    tokens = level.split(None, 1)
    key = level if len(level) <= 16 else xxhash.xxh3_64_hexdigest(level)
    return tokens[0], level.rsplit(None, 1)[-1], key, bool(_END_MARK.search(line)) and not _ELLIPSIS.search(line)


def truncated_texts(docs: DataFrame) -> DataFrame:
    """Evidence for every text.

    ``docs``: (doc_id bigint, source string, text). Result: (doc_id, source, truncated, cut_word, open_line,
    dots, at_limit), one row per distinct doc_id with a non-empty text. Null, empty and blank texts give no
    rows; a null source counts as one source. Lines that recur throughout the corpus after a text are not
    text proper. Texts of any length are read whole. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text").filter("doc_id is not null and text is not null and trim(text) != ''")
    # of c copies of a text each has 1/c of a vote
    rows = rows.withColumn("h", F.xxhash64(F.rtrim("text")))
    copies = materialize(rows.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "copies")
    rows = rows.join(copies, "h", "left").select("doc_id", "source", "text", (1 / F.coalesce("c", F.lit(1))).alias("vote"))
    seen = materialize(rows.mapInArrow(_counter(), _SCHEMA), "endings")
    parted = lambda d: d.withColumn("short", F.split("k2", "\n")[1]).withColumn("last", F.split("k2", "\n")[0])
    tails = parted(seen.filter("kind = 'd'").dropDuplicates(["doc_id", "pos"]))
    sizes = tails.filter("pos = 0").select("doc_id", "source", "chars", "bytes")
    total = seen.filter("kind = 'd' and pos = 0").agg(F.round(F.coalesce(F.sum("n"), F.lit(0.0)), 3)).first()[0]
    votes = F.round(F.sum("n"), 3).alias("n")
    recurring = seen.filter("kind = 'l'").groupBy(F.col("k1").alias("short")).agg(votes.alias("times")).filter(F.col("times") >= max(RECURS, RECURS_SHARE * total)).select("short", F.lit(True).alias("recurs"))
    ends = seen.filter("kind = 'e'").groupBy("k1", "k2").agg(votes)
    begun = ends.groupBy("k1").agg(votes.alias("of"))
    # the vote of the line that is judged does not count
    usual = ends.join(begun, "k1").filter(f"k2 != '' and n - 1 >= {ENDS} and n - 1 >= {END_SHARE} * (of - 1)").select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.lit(True).alias("usual"))

    def proper_of(lines):
        """The last line of a text that does not recur; a recurring line is whole, or it may be a cut itself."""
        j = lines.join(recurring, "short", "left").join(usual, (F.col("k1") == F.col("u1")) & (F.col("last") == F.col("u2")), "left")
        # a line of one token is whole only if it recurs: a cut leaves such lines, too, all of them alike
        j = j.withColumn("usual", F.when(F.col("usual") & (~F.col("single") | F.col("recurs").isNotNull()), True))
        j = j.filter("recurs is null or (usual is null and not mark)")
        return j.groupBy("doc_id").agg(F.min_by(F.struct("mark", "dots", "word", "usual"), "pos").alias("x")).select("doc_id", "x.*")

    ends_found = materialize(proper_of(tails), "proper")
    open_ = tails.filter(f"pos = {TAIL_LINES - 1}").select("doc_id").join(ends_found, "doc_id", "left_anti")
    further = rows.join(open_, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_earlier, _SCHEMA).dropDuplicates(["doc_id", "pos"])
    proper = ends_found.unionByName(proper_of(parted(further)))
    # the trie: every prefix of a known word, kept where it is asked for
    known = seen.filter("kind = 'w'").groupBy(F.col("k1").alias("w")).agg(votes).filter(F.col("n") >= KNOWN)
    asked = proper.filter("not mark and word is not null").select("word").distinct()
    trie = known.select("w", F.explode(F.transform(F.sequence(F.lit(1), F.length("w")), lambda k: F.col("w").substr(F.lit(1), k))).alias("word"))
    trie = trie.join(asked, "word", "left_semi").groupBy("word").agg(F.max(F.col("w") == F.col("word")).alias("is_word"))
    limits = []
    for unit in ("chars", "bytes"):
        top = sizes.groupBy(F.coalesce("source", F.lit("")).alias("s")).agg(F.max(unit).alias("top"), F.count(F.lit(1)).alias("texts"))
        at = sizes.select("doc_id", F.coalesce("source", F.lit("")).alias("s"), unit).join(top, "s").filter(F.col(unit) == F.col("top"))
        heap = at.groupBy("s").agg(F.count(F.lit(1)).alias("heap"))
        limits.append(at.join(heap, "s").filter((F.col("heap") >= AT_LIMIT) & (F.col("heap") >= LIMIT_SHARE * F.col("texts"))).select("doc_id"))
    limit = limits[0].unionByName(limits[1]).distinct().withColumn("at_limit", F.lit(True))
    j = proper.join(trie, "word", "left")
    is_word = F.col("is_word")
    state = F.when(F.col("word").isNull(), "none").when(is_word, "word").when(is_word.isNotNull(), "prefix").otherwise("unknown")
    j = j.select("doc_id", "mark", "dots", F.coalesce("usual", F.lit(False)).alias("usual"), state.alias("state"))
    j = sizes.select("doc_id", "source").join(j, "doc_id", "left").join(limit, "doc_id", "left")
    no = F.lit(False)
    at_limit, dots, state = F.coalesce("at_limit", no), F.coalesce("dots", no), F.coalesce("state", F.lit(""))
    open_line = ~F.coalesce("mark", F.lit(True)) & ~dots
    cut_word = open_line & (state == "prefix")
    between = open_line & (at_limit | (state.isin("word", "none") & ~F.coalesce("usual", no)))
    return j.select("doc_id", "source", (dots | cut_word | between).alias("truncated"), cut_word.alias("cut_word"), (between & ~cut_word).alias("open_line"), dots.alias("dots"), at_limit.alias("at_limit"))
