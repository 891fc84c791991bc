"""Near-duplicate documents by b-bit MinHash.

Each document's set of word shingles gets ``BANDS * ROWS`` minima, hashed in groups of ``ROWS`` to band keys
that find candidates. Documents that share a key get a signature of ``PERMS`` minima of which only ``BITS``
low bits are kept, packed in longs; the share of equal low bits, by bit counts and corrected for chance
collisions, screens pairs before their full sets are compared. Beside it stands a bitmap of ``ODD_BITS`` bits, each of
which tells whether an odd number of the set's shingles has that hash: where two bitmaps differ one set has a shingle that
the other lacks, so the number of such bits and the sizes bound what they share. No link is lost by that, and of short texts just
under the threshold, which the signature can't tell from links, hardly a pair is left.

Documents with equal sets form a class (two 64-bit sums over the set and its size) that is never expanded; a hash
of these names it, and ids of documents only name components in the end. Each class is first compared with the
least class of its buckets, one pair a class; after that, in a few rounds, each class outside a bucket's largest
component with the likeliest of some members of it, in one of its buckets. What then still shares a bucket and lies in different
components is compared by signature: inside the join where the bucket has few such pairs, each class outside the
largest component with the bucket. Of fuller buckets only pairs are made that share a shingle among the rarest of
both: a set of n shingles has n - ceil(t n) + 1 of these by an order that all sets share, and two sets of a
similarity of t must meet there, so no link is lost and texts that share no more than a common frame never meet.
Only pairs that pass are made, each once. Buckets that are one component cost nothing.

Full sets are compared in streams: the text of a hub comes first, the others follow, dealt over as many parts
as there are shuffle partitions; neither a group nor its pairs are ever held. Only the texts of candidates
are moved, once out of the corpus and then by pair.

Defined cases: null, empty and blank texts have no shingles and link with nothing; texts of fewer words
than a shingle have the whole sequence as their one shingle; texts of any length count whole; rows of one doc_id
are each judged by their own text, and get the least doc_id that their text is linked with; a null doc_id links
with nothing and gets a null component; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, Words, chunks, lists, mix, series, shuffle_width, table
from .graph import components, joined

SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 32, 5
PERMS, BITS = 2048, 1
#: Bits of the bitmap that bounds what two sets share: at 0.8 it tells sets of up to 1,000 shingles or so from links of 0.85.
ODD_BITS = 1024
#: Standard errors of the estimate that a pair may lie below the threshold and still be compared in full.
SLACK = 4.5
#: Rounds in which each class outside the largest component of a bucket is compared with the likeliest of a
#: few members of that component, and their number in each bucket.
ROUNDS, REPRESENTATIVES = 3, 6
#: Pairs outside the largest component up to which a bucket is compared inside the join: a second of work or so.
FEW_PAIRS = 1 << 24
PER_LONG = 64 // BITS
_U = np.uint64
_FACTORS, _SHIFTS = series(PERMS, 11) | _U(1), series(PERMS, 12)
SIGNED = "doc_id long, version long, n_shingles long, s1 long, s2 long, bands array<long>"
LONGS = PERMS // PER_LONG
#: The packed longs are columns of their own: the join condition over them stays small enough to be compiled.
PACKED, HUB_PACKED = [f"p{i}" for i in range(LONGS)], [f"h{i}" for i in range(LONGS)]
ODD, HUB_ODD = [f"o{i}" for i in range(ODD_BITS // 64)], [f"g{i}" for i in range(ODD_BITS // 64)]
SKETCHED = "node long, text string, size long, " + ", ".join(f"{p} long" for p in PACKED + ODD)


def sets(words: Words, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row, ascending, one row after another, and where each row starts."""
    value, _, first = words.grams(shingle)
    short = np.flatnonzero((words.count > 0) & (words.count < shingle))
    whole = {}
    for n in np.unique(words.count[short]).tolist():
        g, at, _ = words.grams(n)
        here = short[words.count[short] == n]
        whole.update(zip(here.tolist(), g[np.searchsorted(at, words.first[here])], strict=True))
    parts = []
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if a == b:
            parts.append(value[:0] if i not in whole else np.array([whole[i]], dtype=_U))
            continue
        s = np.sort(value[a:b])
        parts.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
    starts = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int64)
    return np.concatenate(parts) if parts else value[:0], starts


def minima(values: np.ndarray, starts: np.ndarray, perms: int) -> np.ndarray:
    """The least value of each row (of at least one shingle) under the first permutations, as (perms, rows) of 32 bits."""
    out = np.empty((perms, len(starts) - 1), dtype=np.uint32)
    for j in range(perms):
        out[j] = np.minimum.reduceat(((values * _FACTORS[j] + _SHIFTS[j]) >> _U(32)).astype(np.uint32), starts[:-1])
    return out


def filled(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows with a shingle, and the starts of their shingles with the end of the last."""
    some = np.flatnonzero(np.diff(starts))
    return some, np.append(starts[some], starts[-1])


def band_keys(low: np.ndarray) -> np.ndarray:
    """(rows, BANDS): a hash of each group of ROWS minima and its number."""
    keys = np.zeros((BANDS, low.shape[1]), dtype=_U)
    for j in range(ROWS):
        keys = mix(keys ^ low[j : BANDS * ROWS : ROWS].astype(_U)) + _U(j + 1)
    return mix(keys + series(BANDS, 13)[:, None]).T


def low_bits(low: np.ndarray) -> np.ndarray:
    """(rows, LONGS): the low bits of the minima, packed."""
    bits = (low & np.uint32((1 << BITS) - 1)).astype(_U).reshape(-1, PER_LONG, low.shape[1])
    return np.bitwise_or.reduce(bits << (np.arange(PER_LONG, dtype=_U) * _U(BITS))[None, :, None], axis=1).T


def odd_bits(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(ODD_BITS / 64, rows): whether an odd number of a row's shingles has a hash, for each hash, packed."""
    out = np.zeros((ODD_BITS // 64, len(starts) - 1), dtype=_U)
    hashed = mix(values ^ series(1, 23)) & _U(ODD_BITS - 1)
    np.bitwise_xor.at(out, ((hashed >> _U(6)).astype(np.int64), np.repeat(np.arange(len(starts) - 1), np.diff(starts))), _U(1) << (hashed & _U(63)))
    return out


def some_rows(table: np.ndarray, some: np.ndarray, n: int) -> pa.ListArray:
    """A list column with the rows of a table where there are any, else empty lists."""
    has = np.zeros(n + 1, dtype=np.int64)
    has[some + 1] = table.shape[1]
    return lists(np.ascontiguousarray(table).view(np.int64).ravel(), np.cumsum(has), pa.int64())


def sign_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, text in chunks(batch):
            values, starts = sets(Words(text), shingle)
            some, begins = filled(values, starts)
            sums = np.zeros((2, len(text)), dtype=_U)
            for k in (0, 1):
                sums[k, some] = np.add.reduceat(mix(values ^ series(1, 21 + k)), begins[:-1]) if len(some) else 0
            keys = band_keys(minima(values, begins, BANDS * ROWS))
            s1, s2 = (pa.array(x.view(np.int64)) for x in sums)
            columns = [part.column(0), part.column(2), pa.array(np.diff(starts), pa.int64()), s1, s2, some_rows(keys, some, len(text))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "version", "n_shingles", "s1", "s2", "bands"])


def sketch_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, text in chunks(batch):
            values, starts = sets(Words(text), shingle)
            some, begins = filled(values, starts)
            packed = np.zeros((LONGS, len(text)), dtype=_U)
            packed[:, some] = low_bits(minima(values, begins, PERMS)).T
            longs = [pa.array(p.view(np.int64)) for p in (*packed, *odd_bits(values, starts))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(starts), pa.int64()), *longs], ["node", "text", "size", *PACKED, *ODD])


def matching() -> F.Column:
    """The number of equal low-bit groups of the two signatures of a row, by bit counts."""
    ones = sum(1 << (BITS * i) for i in range(PER_LONG))
    ones -= (1 << 64) if ones >> 63 else 0
    total = F.lit(PERMS)
    for a, b in zip(PACKED, HUB_PACKED, strict=True):
        x = F.col(a).bitwiseXOR(F.col(b))
        differs = x
        for k in range(1, BITS):
            differs = differs.bitwiseOR(F.shiftrightunsigned(x, k))
        total = total - F.bit_count(differs.bitwiseAND(F.lit(ones)) if BITS > 1 else differs)
    return total


def estimate() -> F.Column:
    """The similarity estimated from low bits, corrected for chance collisions of probability 2**-BITS."""
    chance = 2.0**-BITS
    return (matching() / PERMS - chance) / (1 - chance)


def possible(percent: int) -> F.Column:
    """Whether sets of these sizes whose bitmaps differ so much can be similar enough; true of all that are."""
    differs = sum((F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in zip(ODD, HUB_ODD, strict=True)), F.lit(0))
    both = F.col("size") + F.col("hub_size")
    return (both - differs) * (100 + percent) >= both * 2 * percent


def least_estimate(percent: int) -> float:
    """The estimate that a pair at the threshold undercuts only by ``SLACK`` standard errors."""
    chance, j = 2.0**-BITS, percent / 100
    equal = j + (1 - j) * chance
    return j - SLACK * (equal * (1 - equal) / PERMS) ** 0.5 / (1 - chance)


def compare_batches(batches: Iterator[pa.RecordBatch], shingle: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (hub, salt, role, node, text) in order; the text of role 0 holds for the rows of its hub that follow."""
    hub, own = None, np.empty(0, dtype=_U)
    for batch in batches:
        for part, text in chunks(batch):
            values, starts = sets(Words(text), shingle)
            linked = []
            for i, (key, role, node) in enumerate(zip(*(part.column(c).to_pylist() for c in (0, 2, 3)), strict=True)):
                mine = values[starts[i] : starts[i + 1]]
                if role == 0:
                    hub, own = key, mine
                elif key == hub and len(own) and len(mine):
                    both = int(np.count_nonzero(own[np.minimum(np.searchsorted(own, mine), len(own) - 1)] == mine))
                    if 100 * both >= percent * (len(own) + len(mine) - both):
                        linked.append((key, node))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in linked], pa.int64()), pa.array([x for _, x in linked], pa.int64())], ["u", "v"])


def confirm(pairs: DataFrame, sketched: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (hub, node) whose full sets are similar enough, as (u, v). sketched: node and text."""
    width = shuffle_width(pairs.sparkSession)
    dealt = pairs.select("hub", "node", F.pmod(F.xxhash64("node"), F.lit(width)).alias("salt"))
    hubs = dealt.select("hub", "salt").distinct().select("hub", "salt", F.lit(0).alias("role"), F.col("hub").alias("node"))
    wanted = dealt.select("hub", "salt", F.lit(1).alias("role"), "node").unionByName(hubs)
    rows = wanted.join(sketched.select("node", "text"), "node").select("hub", "salt", "role", "node", "text")
    return rows.repartition(width, "hub", "salt").sortWithinPartitions("hub", "salt", "role", "node").mapInArrow(lambda batches: compare_batches(batches, shingle, percent), "u long, v long")


def shingle_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """Rows (node, label, size, shingle) of the sets of (node, label, text)."""
    for batch in batches:
        for part, text in chunks(batch):
            values, starts = sets(Words(text), shingle)
            size = np.diff(starts)
            row = np.repeat(np.arange(len(size)), size)
            yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(row)) for k in (0, 1)), pa.array(size[row]), pa.array(values.view(np.int64))], ["node", "label", "size", "shingle"])


def rare_pairs(nodes: DataFrame, scratch: Scratch, shingle: int, percent: int) -> DataFrame:
    """(node, hub), node > hub: the pairs of different labels that share a rare shingle. nodes: node, label, text.

    Shingles are ordered by the number of sets that have them. Those of one set only come first and pair nothing, so
    of each set only the others are ordered; no more rows than there are shingles are made before the pairs.
    """
    each = scratch(nodes.select("node", "label", "text").mapInArrow(lambda batches: shingle_batches(batches, shingle), "node long, label long, size long, shingle long"))
    often = scratch(each.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"))
    common = each.join(often, "shingle")
    mine = Window.partitionBy("node")
    # Places from 1 on, behind the shingles of this set alone.
    place = F.row_number().over(mine.orderBy("n", "shingle")) + F.col("size") - F.count("*").over(mine)
    most = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    rare = scratch(common.withColumn("place", place).where(F.col("place") <= most).select("shingle", "node", "label"))
    hubs = rare.select("shingle", F.col("node").alias("hub"), F.col("label").alias("hub_label"))
    return rare.join(hubs, "shingle").where("node > hub AND label <> hub_label").select("node", "hub").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", screen: bool = True, few_pairs: int = FEW_PAIRS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents whose sets have ``100 * shared >= percent * union``
    are linked; a component is named by its least doc_id, which is the one kept.

    screen: whether pairs whose signatures differ too much are left out, which loses a link at the threshold with the
    probability of a normal deviate below ``-SLACK``; without it all candidates are compared in full.
    """
    scratch = Scratch(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("version"))
    signed = scratch(slim.mapInArrow(lambda batches: sign_batches(batches, shingle), SIGNED))
    some = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    first = F.min(F.struct("doc_id", "version")).alias("rep")
    classes = some.groupBy("s1", "s2", "n_shingles").agg(first, F.count("*").alias("copies"))
    classes = scratch(classes.select(F.xxhash64("s1", "s2", "n_shingles").alias("node"), "s1", "s2", "n_shingles", F.col("rep.doc_id").alias("rep"), F.col("rep.version").alias("rep_version"), "copies"))
    named = classes.select("node", F.col("rep").alias("doc_id"), F.col("rep_version").alias("version"))
    nodes = scratch(some.select("doc_id", "version", "bands").join(named, ["doc_id", "version"]).dropDuplicates(["node"]).select("node", "bands"))
    slots = scratch(nodes.select(F.explode("bands").alias("key"), "node"))
    shared = scratch(slots.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least"))
    members = scratch(slots.join(shared, "key"))
    # The texts of candidates leave the corpus once. The join is a merge at every size: ids of candidates have no bound.
    candidates = named.join(members.select("node").distinct(), "node", "left_semi").hint("merge")
    texts = slim.join(candidates, ["doc_id", "version"]).dropDuplicates(["node"]).select("node", "text")
    sketched = scratch(texts.mapInArrow(lambda batches: sketch_batches(batches, shingle), SKETCHED))
    floor = least_estimate(percent)
    mine = sketched.select("node", "size", *PACKED, *ODD)
    hub_packed = [F.col(a).alias(b) for a, b in zip(PACKED + ODD, HUB_PACKED + HUB_ODD, strict=True)]
    theirs = sketched.select(F.col("node").alias("hub"), F.col("size").alias("hub_size"), *hub_packed)
    close = F.least("size", "hub_size") * 100 >= F.greatest("size", "hub_size") * percent
    close = close & (estimate() >= floor) & possible(percent) if screen else close

    def mixed(found: DataFrame) -> DataFrame:
        """Members of buckets that hold several components: their component and the bucket's largest one."""
        marked = scratch(members.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label")))
        by_label = marked.groupBy("key", "label").agg(F.count("*").alias("n"))
        largest = by_label.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.max("n").alias("n_most"), F.sum("n").alias("n"), F.count("*").alias("labels"))
        return scratch(marked.join(scratch(largest.where("labels > 1").select("key", "most", "n", (F.col("n") - F.col("n_most")).alias("n_out"))), "key"))

    firsts = members.groupBy("node").agg(F.min("least").alias("hub")).where("hub < node")
    firsts = scratch(firsts.join(mine, "node").join(theirs, "hub").where(close).select("hub", "node"))
    found = components(scratch(confirm(firsts, sketched, shingle, percent)), scratch)
    left = mixed(found)
    for turn in range(ROUNDS):
        # A few members of each bucket's largest component, and of these the likeliest for each class outside it.
        spread = F.xxhash64("node", F.lit(turn))
        some_of = left.where("label = most").groupBy("key", F.pmod(spread, F.lit(REPRESENTATIVES)).alias("slot")).agg(F.min_by("node", spread).alias("hub"))
        # A class asks in one of its buckets a round, in another one the next time.
        asks = left.where("label <> most").groupBy("node").agg(F.min_by("key", F.xxhash64("key", F.lit(turn))).alias("key"))
        pairs = asks.join(scratch(some_of.select("key", "hub")), "key").select("node", "hub")
        likely = pairs.join(mine, "node").join(theirs, "hub").where(close).groupBy("node").agg(F.max_by("hub", estimate()).alias("hub"))
        more = scratch(confirm(scratch(likely.select("hub", "node")), sketched, shingle, percent))
        if more.isEmpty():
            break
        found = joined(found, more, scratch)
        left = mixed(found)
    # What is still apart is compared inside the join; a pair counts in the first of the buckets that it shares.
    bands = nodes.select("node", "bands")
    fuller = F.col("n_out") * F.col("n") > few_pairs
    with_bands = mine.join(bands, "node")
    outside = scratch(left.where(~fuller & (F.col("label") != F.col("most"))).join(with_bands, "node").select("key", F.col("node").alias("hub"), F.col("label").alias("hub_label"), F.col("size").alias("hub_size"), *hub_packed, F.col("bands").alias("hub_bands")))
    if not outside.isEmpty():
        inside = scratch(left.where(~fuller).select("key", "node", "label", "most").join(with_bands, "node"))
        # Two classes outside the largest component meet twice; the greater one is taken as the member then.
        once = (F.col("label") != F.col("hub_label")) & ((F.col("label") == F.col("most")) | (F.col("node") > F.col("hub")))
        passed = outside.join(inside, "key").where(once & close & (F.array_min(F.array_intersect("bands", "hub_bands")) == F.col("key")))
        more = scratch(confirm(scratch(passed.select("hub", "node")), sketched, shingle, percent))
        if not more.isEmpty():
            found = joined(found, more, scratch)
    # Pairs of fuller buckets, the first bucket of some pairs left out above among them, must share a rare shingle.
    crowd = scratch(left.where(fuller).select("node", "label").distinct())
    if not crowd.isEmpty():
        pairs = rare_pairs(crowd.join(sketched.select("node", "text"), "node"), scratch, shingle, percent)
        more = scratch(confirm(pairs.join(mine, "node").join(theirs, "hub").where(close).select("hub", "node"), sketched, shingle, percent))
        if not more.isEmpty():
            found = joined(found, more, scratch)
    grouped = scratch(classes.join(found, "node", "left"))
    least = scratch(grouped.where("component IS NOT NULL").groupBy("component").agg(F.min("rep").alias("least")))
    verdict = grouped.join(least, "component", "left").where("copies > 1 OR component IS NOT NULL")
    verdict = scratch(verdict.select("s1", "s2", "n_shingles", F.coalesce("least", "rep").alias("component")))
    scratch.drop(signed, verdict)
    out = signed.select("doc_id", "n_shingles", "s1", "s2").join(verdict, ["s1", "s2", "n_shingles"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS w FROM documents),
s AS (
    SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
    SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
    JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
),
r AS (SELECT DISTINCT a AS id, a AS node FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.node = e.a),
c AS (SELECT id, min(node) AS component_id FROM r GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id, coalesce(c.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.id = w.doc_id
"""
