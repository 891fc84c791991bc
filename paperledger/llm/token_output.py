"""Token ids as ORC files: integer run-length encoding, row indexes, Bloom filters on document ids.

``write_tokens`` sorts documents by id over range partitions, so the files hold ascending, disjoint id
ranges: stripe statistics and Bloom filters on ``doc_id`` prune a lookup to a few row groups, and every
stripe can be read on its own. Each row carries its offset among the ids of its file part, so absolute
offsets need only one total per part, never a global window.

Defined cases: a null text counts as empty and has the end id only; a null ``doc_id`` sorts first;
rows of one id are written each, ordered by a hash
of their text, in as many files as they fill; texts of any length are encoded whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperledger.session import ship

from .common import chunks, lists, new_path, own, shuffle_width, table

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Distinct words whose ids a Python worker remembers; beyond that it starts afresh.
CACHE_WORDS = 800_000
#: Characters of text that are encoded at a time.
CHUNK_CHARS = 1 << 20
TOKENS = "part int, doc_id long, part_start long, n_tokens long, ids array<int>"


class Encoder:
    """Encodes texts word by word. The normaliser and the splitter of the tokenizer never look across a
    blank or a line feed, so the ids of a text are those of its words in a row; common words are remembered,
    as bytes of 32-bit ids. A word of Latin letters with at most a full stop or a comma behind it goes to the
    tokenizer's model directly, any other word through the whole tokenizer.
    """

    def __init__(self, name: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(name if os.sep in name else public_tokenizers.path(name))
        self.model = self.tokenizer.model
        letters = [chr(c) for c in range(0x80, 0x100) if chr(c).isalpha()]
        self.spelling = str.maketrans({c: self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters})
        self.known: dict[str, bytes] = {}
        self.stop = {mark: self.whole(mark) for mark in ("", ".", ",")}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<i4").tobytes()

    def word(self, word: str) -> bytes:
        mark = word[-1:] if word[-1:] in ".," else ""
        core = word[: len(word) - len(mark)]
        if not core.isalpha() or not core.isascii() and max(core) > "\xff":
            return self.whole(word)
        core = core.lower()
        found = self.model.tokenize(core if core.isascii() else core.translate(self.spelling))
        return array("i", [x.id for x in found]).tobytes() + self.stop[mark]

    def __call__(self, text: str) -> bytes:
        if "<|" in text:  # it may hold special tokens, which are told apart by case
            return self.whole(text)
        try:
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
        words = text.replace("\n", " ").split(" ")
        for new in set(words).difference(self.known):
            self.known[new] = self.word(new)
        out = b"".join(map(self.known.__getitem__, words))
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        return out


#: The encoders of this Python worker, by tokenizer.
_ENCODERS: dict[str, Encoder] = {}


def encode_batches(batches: Iterator[pa.RecordBatch], name: str, end_id: int) -> Iterator[pa.RecordBatch]:
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    encode, part, done = _ENCODERS[name], TaskContext.get().partitionId(), 0
    end = np.array([end_id], dtype="<i4").tobytes()
    for batch in batches:
        for some, text in chunks(batch, size=CHUNK_CHARS):
            ids = [encode(x.as_py() or "") + end for x in some.column(1)]
            first = np.zeros(len(text) + 1, dtype=np.int64)
            np.cumsum([len(x) // 4 for x in ids], out=first[1:])
            flat = np.frombuffer(b"".join(ids), dtype="<i4")
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ids), pa.int32()), some.column(0), pa.array(done + first[:-1]), pa.array(np.diff(first)), lists(flat, first, pa.int32())],
                ["part", "doc_id", "part_start", "n_tokens", "ids"],
            )
            done += int(first[-1])


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes (part, doc_id, part_start, n_tokens, ids) in ascending id order to ORC files in ``path``."""
    ship(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Rows of one id are told apart by a hash of their text, and equal rows by the part that they come from, so that
    # those of an id that very many rows have, or of none, are dealt to several parts.
    salted = slim.select("*", F.xxhash64("text").alias("hash"), F.spark_partition_id().alias("origin"))
    ranged = salted.repartitionByRange(parts or shuffle_width(docs.sparkSession), "doc_id", "hash", "origin").sortWithinPartitions("doc_id", "hash", "origin").drop("hash", "origin")
    (
        ranged.mapInArrow(lambda batches: encode_batches(batches, tokenizer, end_id), TOKENS)
        .write.option("compression", "zstd")
        .option("orc.stripe.size", str(16 << 20))
        .option("orc.row.index.stride", "1000")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The written documents with ``start``, the number of ids of all documents before each."""
    stored = spark.read.schema(TOKENS).orc(path)
    # One row for each file part: there are as many as writing tasks, whatever the number of documents, so
    # they are collected, and broadcast lest the ids be shuffled for the join.
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("total")).orderBy("part").collect()
    starts, at = [], 0
    for row in totals:
        starts.append((row["part"], at))
        at += row["total"]
    before = spark.createDataFrame(starts, "part int, before long")
    return stored.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The ids of some documents; row groups are skipped by statistics and Bloom filters."""
    return spark.read.schema(TOKENS).orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def checksum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        ends, data = ids.offsets.to_numpy(), np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<i4")
        sums = [zlib.crc32(data[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def with_checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): crc32 over the ids as little-endian 32-bit integers."""
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(checksum_batches, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return with_checksums(own(read_tokens(spark, path), path))
