"""Cross-entropy difference of two matched n-gram models.

Target and background share one vocabulary (all words of all documents, or on request the most frequent ones,
the rest of which are one unknown word), one order (bigrams interpolated with unigrams) and one smoothing. Both
are counted over whole corpora: the background over every document, the target over the chosen ones. Counts
are exact, by 64-bit hash of the word or of both words, and nothing that is counted has a fixed size.

The counts of the most frequent words, and of bigrams that are frequent in samples, are sent to the executors.
Of each document, its other bigrams are shuffled with its own counts: by the second word, so that one group
holds all that is to be known of a rare word and its bigrams, or by both words if the second one's count was
sent. So no group is large, and what is sent saves time but changes no count. Groups are dealt to buckets, a
few to each part of the shuffle, of which a task holds one at a time.

Which documents are targets is looked up in the executors while their ids are few enough to send, else joined;
the texts are shuffled in the second case only.

A document's score is the mean over its tokens of target loss less background loss, in nats; lower is nearer
to the target. Its own tokens are taken out of the counts first, so no document is judged by itself. Losses are
added up in units of 2^-28 nats, so that a sum doesn't depend on the order of its parts.

Defined cases: null and empty texts have no tokens and null losses and score; without target documents the
target counts are 0 and its model is uniform; a null doc_id is no target; repeated rows count each; an
empty table gives no rows; other columns are ignored. The first token of a text follows the unknown word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, Scratch, Text, Words, chunks, mix, series, shuffle_width, table

#: Bigrams and words whose counts are sent to the executors at most; the others are shuffled.
SENT_PAIRS, SENT_WORDS = 1 << 18, 1 << 16
#: How often a bigram is in a sample (the first chunk of a batch) if its count may be sent.
IN_SAMPLE = 3
#: Ids of target documents that are sent to the executors (64 MB); more are joined instead.
SENT_IDS = 8 << 20
#: Weight of the unigram distribution in a bigram's, in tokens; added count of each word in a unigram's.
PRIOR, ADDED = 20.0, 0.1
#: Units of a nat in sums of losses.
UNITS = float(1 << 28)
#: The number of the unknown word, in place of a hash.
UNKNOWN = 0
_U = np.uint64
#: Buckets of bigrams in a shuffled part, and how many bigrams are gathered before they are dealt to them.
BUCKETS, GATHERED = 16, 1 << 20
#: Bigrams of a bucket, in columns of packed numbers: steps of the document's row, its number of tokens, flags, own counts
#: of the bigram and of its second word, and that word's place among those sent. ``key`` is the hash of the bigram, or
#: of its second word if that wasn't sent, which has the bigram's in ``pair``. A row of a bucket below 0 is of
#: documents and the sums of their known losses.
PARTS = "bucket int, row0 long, row binary, n_tokens binary, flags binary, own binary, own_word binary, word binary, key binary, pair binary, doc_id array<long>, target_loss array<long>, background_loss array<long>"
GOAL, LAST, OPENS, SENT = 1, 2, 4, 8
SUMS = "row long, doc_id long, n_tokens long, target_loss long, background_loss long"


def word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of word hashes, added up over a batch."""
    for batch in batches:
        found = [Words(text, NOT_SPACE, LOWER).hash for _, text in chunks(batch)]
        word, n = np.unique(np.concatenate(found) if found else np.empty(0, _U), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])


class Tokens:
    """Word hashes of some texts, the word before each and the bigram's hash.

    With a vocabulary all other words are the unknown word, which also stands before the first token of a text.
    """

    def __init__(self, text: Text, vocabulary: np.ndarray | None) -> None:
        words = Words(text, NOT_SPACE, LOWER)
        self.first, self.count, self.word = words.first, words.count, words.hash
        if vocabulary is not None:
            self.word = np.where(places(vocabulary, self.word)[1], self.word, _U(UNKNOWN))
        self.opens = self.first[:-1][self.count > 0]
        self.before = np.empty_like(self.word)
        self.before[1:] = self.word[:-1]
        self.before[self.opens] = UNKNOWN
        self.pair = pair_of(self.before, self.word)


def pair_of(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a bigram."""
    return before ^ ((word << _U(17)) | (word >> _U(47)))


def places(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value stands in an ascending array, and whether it does."""
    at = np.minimum(np.searchsorted(known, wanted), max(len(known) - 1, 0))
    return at, known[at] == wanted if len(known) else np.zeros(len(at), dtype=bool)


def targets_of(part: pa.RecordBatch, ids) -> np.ndarray:
    """Which rows are targets: by the column if the ids weren't sent."""
    if ids is None:
        return part.column(1).to_numpy(zero_copy_only=False)
    column = part.column(0)
    found = places(ids.value, column.fill_null(0).to_numpy())[1]
    return found & column.is_valid().to_numpy(zero_copy_only=False)


def count_batches(batches: Iterator[pa.RecordBatch], sent, ids) -> Iterator[pa.RecordBatch]:
    """Counts of words, for all texts and for target ones, added up over a batch; and the frequent bigrams of a sample."""
    for batch in batches:
        words, goals, often = [], [], None
        for part, text in chunks(batch):
            tokens = Tokens(text, sent and sent.value)
            words.append(tokens.word)
            goals.append(np.repeat(targets_of(part, ids), tokens.count))
            if often is None:
                pair, index, n = np.unique(tokens.pair, return_index=True, return_counts=True)
                some = (n >= IN_SAMPLE) & (tokens.before[index] != UNKNOWN)
                often = tokens.word[index[some]], pair[some], n[some]
        if words:
            word, at, n = np.unique(np.concatenate(words), return_inverse=True, return_counts=True)
            target = np.bincount(at, np.concatenate(goals), len(n)).astype(np.int64)
            columns = [
                pa.array(np.concatenate((word, often[0])).view(np.int64)),
                pa.concat_arrays([pa.nulls(len(word), pa.int64()), pa.array(often[1].view(np.int64))]),
                pa.array(np.concatenate((n, often[2]))),
                pa.array(np.concatenate((target, np.zeros(len(often[2]), dtype=np.int64)))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["word", "pair", "n", "target"])


def pair_batches(batches: Iterator[pa.RecordBatch], sent, ids, wanted) -> Iterator[pa.RecordBatch]:
    """Counts of the wanted bigrams, by place, for all texts and for target ones."""
    total = np.zeros((2, len(wanted.value)), dtype=np.int64)
    for batch in batches:
        for part, text in chunks(batch):
            tokens = Tokens(text, sent and sent.value)
            at, found = places(wanted.value, tokens.pair)
            goal = np.repeat(targets_of(part, ids), tokens.count)
            for k, which in enumerate((found, found & goal)):
                np.add.at(total[k], at[which], 1)
    at = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], ["at", "n", "target"])


class Model:
    """Counts that are sent, by the background (row 0) and the target (row 1): of words and bigrams, ascending by hash, and of all tokens."""

    def __init__(self, word: np.ndarray, word_counts: np.ndarray, pair: np.ndarray, pair_counts: np.ndarray, totals: tuple[int, int], words: int) -> None:
        self.word, self.word_counts, self.pair, self.pair_counts = word, word_counts, pair, pair_counts
        self.totals, self.words = totals, words
        at, found = places(word, np.array([UNKNOWN], dtype=_U))
        self.unknown = word_counts[:, at[0]] if found[0] else np.zeros(2, dtype=np.int64)

    def loss(self, k: int, both: np.ndarray, single: np.ndarray, n_tokens: np.ndarray) -> np.ndarray:
        """What a token loses, in units, but for its context. All are others' counts, and n_tokens the document's that are out."""
        unigram = (single + ADDED) / (np.maximum(self.totals[k] - n_tokens, 0) + ADDED * self.words)
        return np.floor(-np.log(both + PRIOR * unigram) * UNITS + 0.5).astype(np.int64)

    @staticmethod
    def context(count: np.ndarray) -> np.ndarray:
        """What each token after a word of that count loses besides, in units."""
        return np.floor(np.log(count + PRIOR) * UNITS + 0.5).astype(np.int64)


def part_batches(batches: Iterator[pa.RecordBatch], sent, ids, model, buckets: int) -> Iterator[pa.RecordBatch]:
    """``PARTS`` of each text. A bigram of a word that was sent is scored as one of no other text; others may correct it."""
    row0, model = TaskContext.get().partitionId() << 40, model.value
    rows, gathered, held, documents = 0, 0, [], []
    for batch in batches:
        for part, text in chunks(batch):
            tokens, goal = Tokens(text, sent and sent.value), targets_of(part, ids)
            size = len(text)
            owner = np.repeat(np.arange(size), tokens.count)
            mark = series(size, 11)[owner]
            _, at, n = np.unique(tokens.word ^ mark, return_inverse=True, return_counts=True)
            own_word = n[at]
            _, index, at, own = np.unique(tokens.pair ^ mark, return_index=True, return_inverse=True, return_counts=True)
            last = np.zeros(len(own), dtype=np.int64)
            last[at[tokens.first[1:][tokens.count > 0] - 1]] = 1
            word, pair, row, own_word, opens = tokens.word[index], tokens.pair[index], owner[index], own_word[index], tokens.before[index] == UNKNOWN
            own_unknown = np.bincount(owner[tokens.word == UNKNOWN], minlength=size)
            place, near = places(model.word, word)
            pair_place, known = places(model.pair, pair)
            known &= near
            sums = []
            for k, mine in enumerate((np.ones(size, dtype=np.int64), goal.astype(np.int64))):
                out, unknown = mine[row], np.maximum(model.unknown[k] - mine * own_unknown, 0)
                both = np.zeros(len(own), dtype=np.int64)
                both[known] = np.maximum(model.pair_counts[k, pair_place[known]] - out[known] * own[known], 0)
                # The unknown word stands before first tokens, too, where it isn't counted.
                both = np.where(opens, np.minimum(both, unknown[row]), both)[near]
                single = np.maximum(model.word_counts[k, place[near]] - out[near] * own_word[near], 0)
                total = np.where(tokens.count > 0, model.context(unknown), 0)
                loss = own[near] * model.loss(k, both, single, out[near] * tokens.count[row[near]]) + (own - last)[near] * model.context(single)
                np.add.at(total, row[near], loss)
                sums.append(total)
            far = ~near | ~(known | opens)
            row, near = row[far], near[far]
            flags = goal[row] * GOAL + last[far] * LAST + opens[far] * OPENS + near * SENT
            numbers = (rows + row, tokens.count[row], flags, own[far], own_word[far], np.where(near, place[far], 0))
            held.append([*(x.astype(np.int32) for x in numbers), np.where(near, pair[far], word[far]), pair[far]])
            documents.append((part.column(0).cast(pa.int64()), tokens.count, sums[1], sums[0]))
            rows, gathered = rows + size, gathered + len(row)
            if gathered >= GATHERED or rows >= GATHERED:
                yield dealt_out(row0, held, documents, buckets)
                row0, rows, gathered, held, documents = row0 + rows, 0, 0, [], []
    if documents:
        yield dealt_out(row0, held, documents, buckets)


def packed(x: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes as the greatest takes; the first byte tells how many."""
    kind = np.min_scalar_type(int(x.max())) if len(x) else np.dtype(np.uint8)
    return bytes([kind.itemsize]) + x.astype(kind).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"u{raw[0]}", offset=1).astype(np.int64)


def dealt_out(row0: int, held: list, documents: list, buckets: int) -> pa.RecordBatch:
    """``PARTS`` of what was gathered."""
    columns = [np.concatenate(x) for x in zip(*held, strict=True)]
    bucket = (mix(columns[6]) % _U(buckets)).astype(np.int32)
    order = np.argsort((bucket.astype(np.int64) << 32) | columns[0])
    bucket, columns = bucket[order], [x[order] for x in columns]
    begins = np.flatnonzero(np.diff(bucket, prepend=-1))
    out: list[list] = [[] for _ in names_of(PARTS)]
    for begin, end in zip(begins, np.append(begins, len(bucket))[1:], strict=True):
        row, *numbers, key, pair = (x[begin:end] for x in columns)
        far = numbers[1] & SENT == 0
        cells = [int(bucket[begin]), row0, packed(np.diff(row, prepend=0)), *map(packed, numbers), key.tobytes(), pair[far].tobytes(), None, None, None]
        for column, cell in zip(out, cells, strict=True):
            column.append(cell)
    ids, counts, target, general = zip(*documents, strict=True)
    mark = -1 - row0 % (1 << 30)
    cells = [mark, row0, None, packed(np.concatenate(counts)), None, None, None, None, None, None, pa.concat_arrays(ids).to_pylist(), np.concatenate(target).tolist(), np.concatenate(general).tolist()]
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 8, *[pa.list_(pa.int64())] * 3]
    return pa.RecordBatch.from_arrays([pa.array([*column, cell], kind) for column, cell, kind in zip(out, cells, kinds, strict=True)], names_of(PARTS))


def names_of(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def sum_batches(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """Losses of the rows of ``PARTS``, in the order of buckets, added up by document over a bucket."""
    bucket, held = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            part = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
            number = part["bucket"].as_py()
            if number < 0:
                n = unpacked(part["n_tokens"].as_py())
                columns = [pa.array(part["row0"].as_py() + np.arange(len(n))), part["doc_id"].values, pa.array(n), part["target_loss"].values, part["background_loss"].values]
                yield pa.RecordBatch.from_arrays(columns, names_of(SUMS))
                continue
            if held and number != bucket:
                yield sums_of(held, model.value)
                held = []
            bucket = number
            row, *numbers = (unpacked(part[c].as_py()) for c in ("row", "n_tokens", "flags", "own", "own_word", "word"))
            key, far = (np.frombuffer(part[c].as_py(), dtype=_U) for c in ("key", "pair"))
            pair = key.copy()
            pair[numbers[1] & SENT == 0] = far
            held.append((part["row0"].as_py() + np.cumsum(row), *numbers, key, pair))
    if held:
        yield sums_of(held, model.value)


def sums_of(parts: list, model: Model) -> pa.RecordBatch:
    """``SUMS`` of a whole bucket."""
    row, n_tokens, flags, own, own_word, word, key, pair = (np.concatenate(x) for x in zip(*parts, strict=True))
    goal, last, opens, shuffled = flags & GOAL, (flags & LAST) // LAST, flags & OPENS != 0, flags & SENT == 0
    group, run = (np.unique(x, return_inverse=True)[1] for x in (key, pair))
    # A bigram of no other text was scored as such where its second word's counts were at hand.
    use = np.flatnonzero(shuffled | (np.bincount(run)[run] > 1))
    losses = []
    for k, mine in enumerate((np.ones(len(own), dtype=np.int64), goal)):
        others = [np.bincount(x, own * mine).astype(np.int64)[x] for x in (run, group)]
        single = np.where(shuffled, others[1], model.word_counts[k, word] if len(model.word) else 0)
        both = np.where(opens, 0, others[0] - mine * own)[use]
        single, out = np.maximum(single - mine * own_word, 0)[use], (mine * n_tokens)[use]
        more = np.where(shuffled[use], (own - last)[use] * model.context(single), -own[use] * model.loss(k, np.zeros(len(use)), single, out))
        losses.append(own[use] * model.loss(k, both, single, out) + more)
    owner, at = np.unique(row[use], return_inverse=True)
    totals = [np.zeros(len(owner), dtype=np.int64) for _ in losses]
    for total, loss in zip(totals, losses, strict=True):
        np.add.at(total, at, loss)
    absent = pa.nulls(len(owner), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(owner), absent, absent, pa.array(totals[1]), pa.array(totals[0])], names_of(SUMS))


def vocabulary_of(docs: DataFrame, size: int) -> np.ndarray:
    """Hashes of the most frequent words of all documents, ascending. At most ``size`` rows reach the driver."""
    counts = docs.select("text").mapInArrow(word_batches, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "word").limit(size).select("word").toArrow()
    return np.sort(rows.column("word").to_numpy().view(_U))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of the greatest n, ``most`` at most: those above a bound, in steps of a twentieth of its logarithm."""
    step = F.floor(F.log(F.col("n").cast("double")) * 20)
    bound, held = math.inf, 0
    # A row for each step: under 900.
    for x in counts.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).orderBy(F.desc("step")).collect():
        held += x["rows"]
        if held > most:
            break
        bound = x["step"]
    return counts.where(step >= bound) if bound < math.inf else counts.limit(0)


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, size: int | None = None, sent_ids: int = SENT_IDS, sent_pairs: int = SENT_PAIRS, sent_words: int = SENT_WORDS) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of every row of (doc_id, text). targets: doc_id.

    size: of the vocabulary, if it isn't to hold all words.
    """
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    scratch = Scratch(spark)
    chosen = scratch(targets.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct())
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(False).alias("is_target"), "text")
    ids = None
    if chosen.count() <= sent_ids:
        ids = context.broadcast(np.sort(chosen.toArrow().column("doc_id").to_numpy()))
    else:
        slim = slim.drop("is_target").join(chosen.withColumn("hit", F.lit(True)), "doc_id", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("is_target"), "text")
    sent = None if size is None else context.broadcast(vocabulary_of(docs, size))
    sums = [F.sum(c).alias(c) for c in ("n", "target")]
    counts = scratch(slim.mapInArrow(lambda batches: count_batches(batches, sent, ids), "word long, pair long, n long, target long").groupBy("word", "pair").agg(*sums))
    words = counts.where("pair IS NULL").select("word", "n", "target")
    all_n, all_target, known = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0)), F.count_if(F.col("word") != UNKNOWN)).first()
    # With a vocabulary all its words are sent, and all bigrams that begin with the unknown one.
    few = frequent(words.where(F.col("word") != UNKNOWN), sent_words if size is None else known).unionByName(words.where(F.col("word") == UNKNOWN)).toArrow()
    word = few.column("word").to_numpy().view(_U)
    order = np.argsort(word)
    word, word_counts = word[order], np.stack([few.column(c).to_numpy()[order] for c in ("n", "target")])
    often = frequent(counts.where("pair IS NOT NULL"), sent_pairs).select("word", "pair").toArrow()
    pair = often.column("pair").to_numpy().view(_U)[places(word, often.column("word").to_numpy().view(_U))[1]]
    if size is not None:
        pair = np.concatenate((pair, pair_of(np.zeros_like(word), word)))
    wanted = context.broadcast(np.unique(pair))
    pair_counts = np.zeros((2, len(wanted.value)), dtype=np.int64)
    if len(pair):
        exact = slim.mapInArrow(lambda batches: pair_batches(batches, sent, ids, wanted), "at long, n long, target long").groupBy("at").agg(*sums).toArrow()
        pair_counts[:, exact.column("at").to_numpy()] = np.stack([exact.column(c).to_numpy() for c in ("n", "target")])
    scratch.drop(chosen)
    model = context.broadcast(Model(word, word_counts, wanted.value, pair_counts, (all_n, all_target), known + 1))
    width = shuffle_width(spark)
    parts = slim.mapInArrow(lambda batches: part_batches(batches, sent, ids, model, width * BUCKETS), PARTS)
    dealt = parts.repartition(width, "bucket").sortWithinPartitions("bucket")
    added = dealt.mapInArrow(lambda batches: sum_batches(batches, model), SUMS).groupBy("row")
    added = added.agg(*(F.max(c).alias(c) for c in ("doc_id", "n_tokens")), *(F.sum(c).alias(c) for c in ("target_loss", "background_loss")))
    mean = [F.when(F.col("n_tokens") > 0, F.col(c) / UNITS / F.col("n_tokens")).alias(c) for c in ("target_loss", "background_loss")]
    return added.select("doc_id", "n_tokens", *mean).withColumn("score", F.col("target_loss") - F.col("background_loss"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents against those that are labelled as of good quality."""
    return cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))
