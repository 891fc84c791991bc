"""Removal of passages that repeat an earlier document, by pairwise alignment.

Pairs come from shared rare lines: a line that at most ``RARE`` documents have pairs each of them with the earliest.
Passages whose lines are all common, or that begin and end inside lines, are known by winnowed hashes of ``GRAM``
words, of which every run of ``LEAST_WORDS`` words has one; such a hash pairs its documents with the earliest one, too.
So a line or passage of very many documents makes one pair for each of them, not all pairs.

A pair is aligned by patience diff: lines that are unique on both sides and in order are anchors, grown to blocks of
equal lines; what lies between blocks is aligned in the same way by words, so that blocks grow into neighbouring
lines. Where nothing is unique, first occurrences are paired with first ones, second with second, and so on. What is
deleted from the later document (the one of the greater id) is decided by the alignment alone:

- blocks of ``LEAST_WORDS`` equal words in a row or more, wherever they begin and end;
- whole lines of regions that hold so many words, where a region may have ``GAP`` changed lines in a row in it.

The rest is aligned again while anything is found, so repeated passages and those in another order go, too. Of runs
of the same few words over and over alignment may leave some, and where the earliest document has less of a passage than
others that are earlier, too, the passage's first or last words may stay.

Texts of documents in pairs move once for each pair; the pairs of one earlier document are dealt over all parts.

Defined cases: null texts stay null; words are runs of bytes that aren't blank and count as they are spelled; lines
end at line feeds and are equal if their words are; a line of which all words go takes its line feed along; rows with
one doc_id and one text count as one document and are treated alike, rows with one doc_id are never compared with each
other; a null doc_id is left alone; very long texts are aligned whole; empty tables give no rows. ``deduplicate`` keeps
all columns of its input.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_SPACE, POWERS, Scratch, Text, Words, chunks, mix, shuffle_width, table
from .decontaminate import sendable

LEAST_WORDS, GRAM = 50, 32
#: Documents that may have a line that counts as rare, and changed lines in a row inside a region.
RARE, GAP = 64, 1
#: Pairs of an earlier document for which it is copied once more.
PAIRS_A_COPY = 64
#: Bytes of text that are taken apart at a time.
HELD_BYTES = 1 << 19
#: Bytes of a table that are sent to all executors at most; greater ones are joined by a shuffle.
SENT_BYTES = 32 << 20
KEYED = "doc_id long, version long, key long, line boolean"
_U = np.uint64
_KEEP_CASE = np.arange(256, dtype=np.uint8)


class Lines:
    """The words of some texts and the lines that have any: first words, one after another, and the first line of each
    row; and winnowed hashes of runs of words, of which every run of ``least`` words has one, with their places."""

    def __init__(self, text: Text, least: int = LEAST_WORDS) -> None:
        self.words = Words(text, NOT_SPACE, _KEEP_CASE)
        feeds = np.flatnonzero(text.data == 10)
        starts = np.unique(np.concatenate((self.words.first[:-1], np.searchsorted(self.words.begin, feeds))))
        self.start = starts[starts < len(self.words.begin)]
        self.end = np.append(self.start[1:], len(self.words.begin))[: len(self.start)]
        self.first = np.searchsorted(self.start, self.words.first)
        self.hash = spans(self.words.hash, self.start, self.end) if len(self.start) else np.empty(0, dtype=_U)
        gram = max(1, least * GRAM // LEAST_WORDS)
        begin = np.flatnonzero(np.repeat(self.words.first[1:], self.words.count) - np.arange(len(self.words.begin)) >= gram)
        runs = spans(self.words.hash, begin, begin + gram) if len(begin) else np.empty(0, dtype=_U)
        kept = least_of_runs(runs, self.words.row()[begin], least - gram + 1)
        self.print, self.print_at = runs[kept], begin[kept]
        self.print_first = np.searchsorted(self.print_at, self.words.first)

    def row(self, i: int) -> tuple[np.ndarray, ...]:
        """Word hashes of a row, its lines' first words and their hashes, and hashes of runs and their first words."""
        a, b, c, d = self.words.first[i], self.words.first[i + 1], self.first[i], self.first[i + 1]
        e, f = self.print_first[i], self.print_first[i + 1]
        return self.words.hash[a:b], self.start[c:d] - a, self.hash[c:d], self.print[e:f], self.print_at[e:f] - a


def least_of_runs(value: np.ndarray, row: np.ndarray, run: int) -> np.ndarray:
    """Places of values that are the least of some ``run`` values in a row of one text."""
    if len(value) < run:
        return np.empty(0, dtype=np.int64)
    low = extremes(value, run, np.minimum)
    # A window that spans two texts must not keep a value; 0 is no greater than any.
    low = np.where(row[: len(low)] == row[run - 1 :], low, _U(0))
    padded = np.concatenate((np.zeros(run - 1, dtype=_U), low, np.zeros(run - 1, dtype=_U)))
    return np.flatnonzero(extremes(padded, run, np.maximum) == value)


def extremes(value: np.ndarray, run: int, of) -> np.ndarray:
    """The least or greatest of each ``run`` values in a row, by doubling."""
    out, width = value, 1
    while width < run:
        step = min(width, run - width)
        out = of(out[:-step], out[step:])
        width += step
    return out


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of runs of values that do not depend on where a run stands."""
    up, down = POWERS.to(len(values))
    total = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def once_a_row(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places of the distinct pairs."""
    order = np.lexsort((key, row))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (key[order][1:] != key[order][:-1])
    return order[new]


def key_batches(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Hashes of lines, and of some runs of words, once for each text that has them."""
    for batch in batches:
        for part, text in chunks(batch, size=HELD_BYTES):
            lines = Lines(text, least)
            row = np.concatenate([np.repeat(np.arange(len(text)), np.diff(x)) for x in (lines.first, lines.print_first)])
            key = np.concatenate((mix(lines.hash + _U(1)), mix(lines.print + _U(2))))
            some = once_a_row(row, key)
            yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(row[some])) for k in (0, 2)), pa.array(key[some].view(np.int64)), pa.array(some < len(lines.hash))], ["doc_id", "version", "key", "line"])


def patience(a: list[int], b: list[int], spots: list[int] | None = None) -> list[tuple[int, int]]:
    """Pairs of places of equal elements, ascending on both sides: unique ones are anchors, grown and refined.

    Between anchors where nothing is unique on both sides the n-th occurrences of an element are taken for the same.
    With ``spots``, places of b in ascending order, what lies between blocks is refined only if one lies there, too.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1 or spots is not None and bisect_left(spots, b0) == bisect_left(spots, b1):
            continue
        for keyed in (_unique, _numbered):
            once = keyed(a, a0, a1)
            pairs = sorted((once[x], j) for x, j in keyed(b, b0, b1).items() if x in once)
            if pairs:
                break
        else:
            continue
        anchors = _ascending(pairs)
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        out += anchors
        todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(ends[:-1], ends[1:], strict=True) if p + 1 < r and q + 1 < s]
    return sorted(out)


def _unique(x: list[int], start: int, stop: int) -> dict[int, int]:
    seen: dict[int, int] = {}
    for i in range(start, stop):
        seen[x[i]] = -1 if x[i] in seen else i
    return {k: i for k, i in seen.items() if i >= 0}


def _numbered(x: list[int], start: int, stop: int) -> dict[tuple[int, int], int]:
    """Places by element and number of its occurrence."""
    seen: dict[int, int] = {}
    out: dict[tuple[int, int], int] = {}
    for i in range(start, stop):
        nth = seen.get(x[i], 0)
        out[x[i], nth] = i
        seen[x[i]] = nth + 1
    return out


def _ascending(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence whose second places ascend, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        before.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            at.append(k)
        else:
            tops[pile], at[pile] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def matched(a: np.ndarray, a_line: np.ndarray, b: np.ndarray, b_line: np.ndarray, pairs: list[tuple[int, int]], spots: list[int]) -> np.ndarray:
    """For each word of b the place of its partner in a, or -1: those of paired lines, and between them by words.

    spots: where runs of b begin that a has, too; blocks that are long enough hold one.
    """
    partner = np.full(len(b), -1)
    a_start, b_start = a_line.tolist(), b_line.tolist()
    a_end, b_end = [*a_start[1:], len(a)], [*b_start[1:], len(b)]
    x = y = 0
    for i, j in [*pairs, (-1, -1)]:
        x1, y1 = (a_start[i], b_start[j]) if i >= 0 else (len(a), len(b))
        if x < x1 and y < y1:
            here = [k - y for k in spots[bisect_left(spots, y) : bisect_left(spots, y1)]]
            for p, q in patience(a[x:x1].tolist(), b[y:y1].tolist(), here):
                partner[y + q] = x + p
        if i >= 0:
            partner[y1 : b_end[j]] = np.arange(x1, a_end[i])
            x, y = a_end[i], b_end[j]
    return partner


def regions(pairs: list[tuple[int, int]], size: np.ndarray, least: int) -> list[int]:
    """Lines of b that stand in regions of enough words, with ``GAP`` other lines in a row at most on either side."""
    out, start = [], 0
    for k in range(1, len(pairs) + 1):
        if k < len(pairs) and max(pairs[k][0] - pairs[k - 1][0], pairs[k][1] - pairs[k - 1][1]) <= GAP + 1:
            continue
        lines = [j for _, j in pairs[start:k]]
        if size[lines].sum() >= least:
            out += lines
        start = k
    return out


def repeated_words(earlier: tuple[np.ndarray, ...], later: tuple[np.ndarray, ...], least: int) -> np.ndarray:
    """Which words of the later document lie in aligned blocks or regions. Documents: as in ``Lines.row``.

    Words are aligned only while the documents share a hash of a run that isn't gone: without one there is no block.
    """
    (a, a_line, a_hash, a_print, _), (b, b_line, b_hash, b_print, b_print_at) = earlier, later
    if len(b) >= least and np.array_equal(a, b):
        return np.ones(len(b), dtype=bool)
    gone, size_of = np.zeros(len(b), dtype=bool), np.diff(np.append(b_line, len(b)))
    line_of = np.repeat(np.arange(len(b_line)), size_of)
    shared = b_print_at[np.isin(b_print, a_print)]
    copies = 1
    while True:
        left = np.flatnonzero(~gone)
        if len(left) < least:
            break
        # Lines of which some words are gone aren't lines any more.
        rest = np.bincount(line_of[left], minlength=len(b_line))
        some = np.flatnonzero(rest)
        hashes, size = np.where(rest == size_of, b_hash, _U(0))[some], rest[some]
        start = np.cumsum(size) - size
        runs_left = len(shared) and not gone[shared].all()
        if not runs_left and size[np.isin(hashes, a_hash)].sum() < least:
            break
        pairs = [p for p in patience(np.tile(a_hash, copies).tolist(), hashes.tolist()) if hashes[p[1]]]
        chosen = np.zeros(len(left), dtype=bool)
        for j in regions(pairs, size, least):
            chosen[start[j] : start[j] + size[j]] = True
        if runs_left:
            spots = np.searchsorted(left, shared[~gone[shared]]).tolist()
            partner = matched(np.tile(a, copies), (a_line + len(a) * np.arange(copies)[:, None]).ravel(), b[left], start, pairs, spots)
            opens = np.ones(len(left), dtype=bool)  # whether a word opens a block
            opens[1:] = (partner[1:] != partner[:-1] + 1) | (left[1:] != left[:-1] + 1) | (partner[1:] % max(len(a), 1) == 0)
            block = np.cumsum(opens) - 1
            chosen |= (np.bincount(block) >= least)[block] & (partner >= 0)
        if not chosen.any():
            break
        gone[left[chosen]] = True
        copies = 1 + int((~gone).sum()) // max(len(a), 1)
    return gone


def align_batches(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows (hub, hub_version, salt, role, doc_id, version, text) in order; role 0 is the earlier document."""
    hub, earlier = None, None
    for batch in batches:
        for part, text in chunks(batch, size=HELD_BYTES):
            lines, out = Lines(text, least), []
            for i, (key, version, role, doc_id, own) in enumerate(zip(*(part.column(c).to_pylist() for c in (0, 1, 3, 4, 5)), strict=True)):
                if role == 0:
                    hub, earlier = (key, version), tuple(x.copy() for x in lines.row(i))
                elif (key, version) == hub:
                    gone = np.diff(np.concatenate(([0], repeated_words(earlier, lines.row(i), least).view(np.int8), [0])))
                    out += [(doc_id, own, begin, end) for begin, end in zip(np.flatnonzero(gone == 1).tolist(), np.flatnonzero(gone == -1).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], ["doc_id", "version", "begin", "end"])


def pairs_of(docs: DataFrame, scratch: Scratch, least: int) -> DataFrame:
    """(hub, hub_version, doc_id, version): documents and earlier ones to align them with. docs: doc_id, text, version."""
    keyed = scratch(docs.mapInArrow(lambda batches: key_batches(batches, least), KEYED))
    first = F.min(F.struct("doc_id", "version")).alias("o")
    owners = keyed.groupBy("key").agg(first, F.max("doc_id").alias("last"), F.count("*").alias("n"), F.first("line").alias("line"))
    # The earliest document of a key that another one has, too; common lines make no pairs.
    owners = scratch(owners.where(f"last > o.doc_id AND NOT (line AND n > {RARE})").select("key", F.col("o.doc_id").alias("hub"), F.col("o.version").alias("hub_version")))
    return scratch(keyed.join(owners, "key").where("doc_id > hub").select("hub", "hub_version", "doc_id", "version").distinct())


def repeated_runs(docs: DataFrame, least: int = LEAST_WORDS, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(doc_id, version, runs): for documents that lose words, from which word to which. docs: doc_id, text, version."""
    width, scratch = shuffle_width(docs.sparkSession), Scratch(docs.sparkSession)
    named = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    pairs = pairs_of(named, scratch, least)
    # The pairs of one earlier document are dealt over as many parts as they fill, each with a copy of it.
    sizes = pairs.groupBy("hub", "hub_version").agg(F.floor(F.count("*") / PAIRS_A_COPY).alias("more"))
    many = scratch(sizes.where("more > 0"))
    salts = F.coalesce("more", F.lit(0)) + 1
    dealt = pairs.join(sendable(many, 32, sent_bytes), ["hub", "hub_version"], "left")
    dealt = scratch(dealt.withColumn("salt", F.pmod(F.xxhash64("doc_id", "version"), salts)).drop("more"))
    hubs = dealt.select("hub", "hub_version", "salt").distinct().select("hub", "hub_version", "salt", F.lit(0).alias("role"), F.col("hub").alias("doc_id"), F.col("hub_version").alias("version"))
    wanted = scratch(dealt.select("hub", "hub_version", "salt", F.lit(1).alias("role"), "doc_id", "version").unionByName(hubs))
    # The texts of pairs leave the corpus once.
    some = scratch(wanted.select("doc_id", "version").distinct())
    texts = scratch(named.join(sendable(some, 32, sent_bytes), ["doc_id", "version"], "left_semi").dropDuplicates(["doc_id", "version"]))
    rows = wanted.join(texts, ["doc_id", "version"]).select("hub", "hub_version", "salt", "role", "doc_id", "version", "text")
    order = ["hub", "hub_version", "salt", "role", "doc_id", "version"]
    gone = rows.repartition(width, *order[:3]).sortWithinPartitions(*order).mapInArrow(lambda batches: align_batches(batches, least), "doc_id long, version long, begin long, end long")
    # A document meets few earlier ones for each of its lines; their deletions are united.
    united = scratch(gone.groupBy("doc_id", "version").agg(F.collect_set(F.struct("begin", "end")).alias("runs")))
    scratch.drop(united)
    return united


def without(raw: bytes, begin: np.ndarray, end: np.ndarray, runs: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The text without some runs of words, and their number. Lines that lose all words go with their line feed."""
    gone = np.zeros(len(begin) + 1, dtype=np.int64)
    for a, b in runs:
        gone[a] += 1
        gone[b] -= 1
    gone = (np.cumsum(gone) > 0).astype(np.int8)
    step = np.diff(np.concatenate(([0], gone)))
    out, done = [], 0
    for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
        start, stop = int(begin[a]), int(end[b - 1])
        opens, ends = start, stop
        while opens and raw[opens - 1] != 10 and not NOT_SPACE[raw[opens - 1]]:
            opens -= 1
        while ends < len(raw) and raw[ends] != 10 and not NOT_SPACE[raw[ends]]:
            ends += 1
        at_start, at_end = opens == 0 or raw[opens - 1] == 10, ends == len(raw) or raw[ends] == 10
        if at_start and at_end:
            start, stop = (opens, ends + 1) if ends < len(raw) else (max(opens - 1, 0), ends)
        else:
            start, stop = opens if at_end else start, ends
        out.append(raw[done : max(start, done)])
        done = stop
    out.append(raw[done:])
    return b"".join(out), int(gone.sum())


def drop_batches(batches: Iterator[pa.RecordBatch], text_at: int, runs_at: int) -> Iterator[pa.RecordBatch]:
    """Deletes runs of words: the text column gets what is left, ``runs`` becomes the number of words deleted."""
    for batch in batches:
        runs = batch.column(runs_at).to_pylist()
        some = [i for i, x in enumerate(runs) if x]
        text, n = batch.column(text_at), np.zeros(batch.num_rows, dtype=np.int64)
        if some:
            out = text.to_pylist()
            for i in some:
                raw = out[i].encode()
                words = Words(Text(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)])), NOT_SPACE, _KEEP_CASE, hashed=False)
                left, n[i] = without(raw, words.begin, words.end, [(x["begin"], x["end"]) for x in runs[i]])
                out[i] = left.decode()
            text = pa.array(out, text.type)
        columns = list(batch.columns)
        columns[text_at], columns[runs_at] = text, pa.array(n)
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def deduplicate(docs: DataFrame, least: int = LEAST_WORDS, name: str = "n_deleted", sent_bytes: int = SENT_BYTES) -> DataFrame:
    """The rows of docs (doc_id, text and any others) without repeated passages, and the number of words deleted.

    Tables of more than ``sent_bytes`` aren't sent to all executors.
    """
    own = [f"c{i}" for i in range(len(docs.columns))]
    id_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")
    plain = docs.toDF(*own)
    key = [F.col(own[id_at]).cast("long").alias("doc_id"), F.xxhash64(own[text_at]).alias("version")]
    gone = repeated_runs(plain.select(key[0], F.col(own[text_at]).alias("text"), key[1]), least, sent_bytes)
    # Where the runs are too large to be sent this moves all texts, once.
    size = gone.agg(F.sum(F.size("runs") * 32 + 64)).first()[0] or 0
    joined = plain.select(*own, *key).join(F.broadcast(gone) if size <= sent_bytes else gone.hint("merge"), ["doc_id", "version"], "left").select(*own, "runs")
    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(own, docs.schema.fields, strict=True)) + ", runs long"
    return joined.mapInArrow(lambda batches: drop_batches(batches, text_at, len(own)), schema).toDF(*docs.columns, name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_deleted, text): every document without what repeats earlier ones."""
    return deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_deleted", "text")
