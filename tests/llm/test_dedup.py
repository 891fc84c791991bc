"""Near duplicates, passages, contamination, packing and token files against brute force."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from paperledger.llm import decontaminate, graph, line_dedup, near_dup, packing, quality_rules, registry, token_output
from paperledger.llm.common import Scratch, Words, chunks, table, text_of

SF = "/root/testdata/sf0.001"


def frame(spark, texts, extra=""):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string" + extra)


@given(st.lists(st.text(alphabet="aB é\n\t.9", max_size=12) | st.none(), max_size=8))
@settings(max_examples=150, deadline=None)
def test_words(texts):
    text = text_of(pa.array(texts, pa.string()))
    words = Words(text)
    seen = {}
    import re

    for i, t in enumerate(texts):
        wanted = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower().replace(b"\xc3\x89", b"\xc3\x89"))
        spelled = [words.data[a:b].tobytes() for a, b in zip(words.begin[words.first[i] : words.first[i + 1]], words.end[words.first[i] : words.first[i + 1]], strict=True)]
        assert spelled == wanted
        for w, h in zip(spelled, words.hash[words.first[i] : words.first[i + 1]].tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_chunks_cover_a_batch():
    texts = ["x" * n for n in (0, 5, 900, 1, 0, 2000, 3)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], ["doc_id", "text"]).slice(1)
    rows = [(r, t.row(i).decode()) for part, t in chunks(batch, size=1000) for i, r in enumerate(part.column(0).to_pylist())]
    assert rows == [(i, texts[i] or "") for i in range(1, 8)]


def near_brute(texts, shingle, percent):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + shingle]) for i in range(max(len(w) - shingle + 1, 1))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(sets[i]), find(i)) for i in range(len(texts))]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("shingle, percent, few", [(3, 85, 1 << 24), (5, 80, 1 << 24), (3, 85, 0)])
def test_near_duplicates_are_all_found(spark, shingle, percent, few):
    rng = random.Random(shingle)
    texts = [None, "", "one", "one", "One two", "a b c"]
    for family in range(12):
        base = [f"f{family}w{rng.randrange(400)}" for _ in range(rng.choice((30, 120, 400)))]
        # Chains: each copy is made from the one before, so far ends are not alike.
        for _ in range(14):
            texts.append(" ".join(base))
            base = edited(rng, base, rng.randint(0, max(1, len(base) // 40))).split()
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[i] for i in order]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(frame(spark, texts), shingle, percent, few_pairs=few).collect()}
    assert [got[i] for i in range(len(texts))] == near_brute(texts, shingle, percent)


@pytest.mark.parametrize("seed", range(2))
def test_rows_that_share_an_id(spark, seed):
    """Each row is judged by its own text; ids name components only, in any order of the rows."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, c), (4, c), (1, "other"), (5, None), (6, c + " z")]
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect())
    assert got == sorted([(1, 56, 1, True), (1, 56, 1, True), (2, 57, 1, False), (3, 57, 1, False), (4, 56, 4, True), (4, 56, 4, True), (1, 1, 1, True), (5, 0, 5, True), (6, 57, 4, False)])


def test_texts_of_one_frame_are_not_all_compared(spark):
    """Of 4,000 texts of similarity 0.7 or so to each other, in one bucket, some pairs are near copies."""
    rng = random.Random(3)
    shared = [f"frame{i}" for i in range(165)]
    texts = [" ".join(shared + [f"own{rng.randrange(10**9)}" for _ in range(35)]) for _ in range(3996)]
    texts += [edited(rng, texts[i].split(), 4) for i in range(4)]
    rows = [(i, t, i) for i, t in enumerate(texts)]
    nodes = spark.createDataFrame(rows, "node long, text string, label long").repartition(8)
    pairs = {(r.node, r.hub) for r in near_dup.rare_pairs(nodes, Scratch(spark), 1, 85).collect()}
    assert {(3996 + i, i) for i in range(4)} <= pairs and len(pairs) < 4000


def test_copies_just_under_the_threshold_are_not_all_compared(spark, monkeypatch):
    """200 copies that are linked and 200 of similarity 0.82 to these: signatures can't tell all of their pairs from links."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(152)]
    texts = []
    for n in [2] * 200 + [3] * 200:
        words, places = list(base), []
        while len(places) < n:
            k = rng.randrange(2, 150)
            if all(abs(k - x) > 2 for x in places):
                places.append(k)
                words[k] = f"own{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    confirm, made = near_dup.confirm, []
    monkeypatch.setattr(near_dup, "confirm", lambda pairs, *rest: (made.append(pairs.count()), confirm(pairs, *rest))[1])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(frame(spark, texts), 3, 85).collect()}
    assert [got[i] for i in range(len(texts))] == near_brute(texts, 3, 85)
    assert sum(made) < 10 * len(texts)


@pytest.mark.parametrize("size", [20, 300, 3000])
def test_bitmaps_leave_no_link_out(spark, size):
    rng = random.Random(size)
    base = [f"w{i}" for i in range(size)]
    texts = [" ".join(base), *(edited(rng, base, max(1, round(size * x / 100))) for x in range(1, 11)), "other words", " ".join(base[: size // 2])]
    values, starts = near_dup.sets(Words(text_of(pa.array(texts))), 3)
    odd, sets = near_dup.odd_bits(values, starts).view(np.int64).T, [set(values[a:b].tolist()) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets))]
    rows = [(*odd[i].tolist(), *odd[j].tolist(), len(sets[i]), len(sets[j])) for i, j in pairs]
    names = ", ".join(f"{x} long" for x in [*near_dup.ODD, *near_dup.HUB_ODD, "size", "hub_size"])
    got = [r.p for r in spark.createDataFrame(rows, names).coalesce(1).select(near_dup.possible(85).alias("p")).collect()]
    linked = [100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) for i, j in pairs]
    assert all(p for p, x in zip(got, linked, strict=True) if x) and not all(got)


def test_estimate_is_close_to_the_similarity(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(500)]
    texts = [edited(rng, base, n) for n in (0, 5, 20, 60)]
    values, starts = near_dup.sets(Words(text_of(pa.array(texts))), 3)
    packed = near_dup.low_bits(near_dup.minima(values, starts, near_dup.PERMS)).view(np.int64)
    rows = [(*packed[0].tolist(), *p.tolist()) for p in packed]
    names = ", ".join(f"{x} long" for x in near_dup.PACKED + near_dup.HUB_PACKED)
    got = [r.e for r in spark.createDataFrame(rows, names).select(near_dup.estimate().alias("e")).collect()]
    sets = [set(values[a:b].tolist()) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    for e, s in zip(got, sets, strict=True):
        assert e == pytest.approx(len(s & sets[0]) / len(s | sets[0]), abs=0.08)


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(i, 700 + (i - 699) % 30) for i in range(700, 730)] + [(3, 1), (1, 2)]
    links = [x if rng.random() < 0.5 else x[::-1] for x in links if x[0] != x[1]]
    rng.shuffle(links)
    df = spark.createDataFrame(links, "u long, v long")
    got = dict(graph.components(df, Scratch(spark)).collect())
    assert got == {i: 1 for i in (1, 2, 3)} | {i: 100 for i in range(100, 141)} | {i: 500 for i in range(500, 560)} | {i: 700 for i in range(700, 730)}
    assert graph.components(df.limit(0), Scratch(spark)).count() == 0


def runs_brute(texts, least):
    """For each text, which of its words lie in a run of so many words that runs in an earlier text."""
    seen, out = set(), []
    for t in texts:
        w = (t or "").split()
        gone = [False] * len(w)
        mine = {tuple(w[i : i + least]): None for i in range(len(w) - least + 1)}
        for i in range(len(w) - least + 1):
            if tuple(w[i : i + least]) in seen:
                gone[i : i + least] = [True] * least
        seen |= mine.keys()
        out.append(gone)
    return out


def left_words(text, gone):
    return [w for w, g in zip((text or "").split(), gone, strict=True) if not g]


@pytest.mark.parametrize("seed, sent", [(0, 1 << 20), (1, 0), (2, 1 << 20)])
def test_passages_are_removed_from_later_documents(spark, seed, sent):
    """Passages over lines, inside lines, twice in a text, in another order, among words of its own."""
    rng = random.Random(seed)
    number = iter(range(10**9))
    fresh = lambda n: [f"w{next(number)}" + rng.choice(["", "\n", "\n"]) for _ in range(n)]
    passages = [fresh(rng.randint(24, 60)) for _ in range(8)] + [["the", "of\n"] * 15]
    texts = []
    for _ in range(60):
        own = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, 4)
            own += rng.choice([p, p, p[a:], p[: len(p) - a], p + fresh(2) + p]) if rng.random() < 0.7 else []
            own += fresh(rng.choice((0, 1, 4, 12)))
        texts.append(" ".join(own))
    got = {r.doc_id: r for r in line_dedup.deduplicate(frame(spark, texts), least=20, sent_bytes=sent).collect()}
    brute = runs_brute(texts, 20)
    lines = [{tuple(x.split()) for x in t.split("\n")} for t in texts]
    for i, t in enumerate(texts):
        wanted, found = left_words(t, brute[i]), got[i].text.split()
        assert got[i].n_deleted == len(t.split()) - len(found)
        # No passage is left, but for the one of a few words over and over; where the earliest text has less of a passage
        # than others, some words at its ends may stay.
        assert not any(runs_brute([*texts[:i], " ".join(w for w in found if w not in ("the", "of"))], 20)[i])
        assert len(found) - len(wanted) <= 8 * sum(brute[i]) // 20
        kept = [x for x in t.split("\n") if any(tuple(x.split()) in s for s in lines[:i])]
        assert set(wanted) - set(found) <= {w for x in kept for w in x.split()}


def test_lines_around_a_changed_one_are_removed(spark, monkeypatch):
    """No run of 50 words is shared; the alignment alone tells that the lines belong together."""
    say = lambda tag, n=12: " ".join(f"{tag}{k}" for k in range(n))
    one = [say(f"line{i}x") for i in range(7)]
    two = ["own start", *one[:3], "changed " + say("other"), *one[4:], "own end"]
    far = ["own start", *one[:2], "changed a b", "changed c d", *one[4:6], "own end"]
    moved = [*one[4:], "between", *one[:3]]
    texts = ["\n".join(x) for x in (one, two, far, moved)]
    got = [r.text for r in line_dedup.deduplicate(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got[1] == "own start\nchanged " + say("other") + "\nown end"
    assert got[0] == texts[0] and got[2] == texts[2] and got[3] == texts[3]
    lines = line_dedup.Lines(text_of(pa.array(texts)))
    assert line_dedup.repeated_words(lines.row(0), lines.row(1), 50).sum() == 72
    monkeypatch.setattr(line_dedup, "patience", lambda a, b, spots=None: [])
    assert not line_dedup.repeated_words(lines.row(0), lines.row(1), 50).any()


def test_rare_lines_and_runs_make_pairs(spark):
    """A line of many texts pairs none; a rare one pairs with the earliest text, and so does a run of common lines."""
    common = [" ".join(f"c{i}w{k}" for k in range(20)) for i in range(3)]
    texts = [common[i % 3] + f"\nown{i}" for i in range(3 * line_dedup.RARE + 3)]
    texts += ["\n".join(common), "x\n" + "\n".join(common), "rare line here\n" + common[0], "rare line here", "y\n" + "\n".join(common[:2]) + " z"]
    n = len(texts) - 5
    docs = frame(spark, texts).withColumn("version", F.lit(0).cast("long"))
    got = {(r.hub, r.doc_id) for r in line_dedup.pairs_of(docs.select("doc_id", "text", "version"), Scratch(spark), 50).collect()}
    assert got == {(n, n + 1), (n + 2, n + 3)}


@given(st.lists(st.integers(0, 6), max_size=14), st.lists(st.integers(0, 6), max_size=14))
@settings(max_examples=200, deadline=None)
def test_patience_pairs_equal_lines_in_order(a, b):
    pairs = line_dedup.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs[:-1], pairs[1:], strict=True))
    assert bool(pairs) == bool(set(a) & set(b))
    if a == b:
        assert len(pairs) == len(a)


def test_one_word_over_and_over():
    row = lambda n: tuple(line_dedup.Lines(text_of(pa.array(["x " * n]))).row(0))
    assert line_dedup.repeated_words(row(300), row(20_000), 50).sum() >= 20_000 - 50
    assert not line_dedup.repeated_words(row(40), row(500), 50).any()


@pytest.mark.parametrize(
    "raw, runs, wanted",
    [
        ("a b\nc d\ne", [(2, 4)], "a b\ne"), ("a b\nc d", [(2, 4)], "a b"), ("a b", [(0, 2)], ""), ("a b c\nd", [(1, 2)], "a c\nd"), ("a b c\nd", [(1, 3)], "a\nd"),
        ("  a b\nc", [(0, 1)], "  b\nc"), ("a\n\nb\n\nc", [(1, 2)], "a\n\n\nc"), ("a b c d", [(0, 1), (2, 3)], "b d"), ("a b c", [(0, 2), (1, 3)], ""), ("a\nb c", [(0, 2)], "c"),
    ],
)
def test_what_is_left_of_a_text(raw, runs, wanted):
    from paperledger.llm.common import NOT_SPACE

    words = Words(text_of(pa.array([raw])), NOT_SPACE, hashed=False)
    assert line_dedup.without(raw.encode(), words.begin, words.end, runs)[0].decode() == wanted


def words_of(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def contamination_brute(texts, items, window):
    out = []
    wins = [(i, tuple(w[k : k + window])) for i, t in items for w in [words_of(t)] if w for k in range(max(len(w) - window + 1, 1))]
    for t in texts:
        w, hit, found = words_of(t), set(), set()
        for item, g in wins:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found.add(str(item))
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("sent_bytes", [1 << 20, 0])
def test_every_benchmark_window_is_found(spark, sent_bytes):
    rng = random.Random(9)
    vocabulary = "the of And a Été b c d E1".split()
    say = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "-", "."]) for _ in range(n))
    items = [(i, say(rng.choice((1, 3, 8, 9, 10, 11, 25, 40)))) for i in range(25)] + [(25, ""), (26, None), (3, say(12))]
    texts = [None, ""]
    for _ in range(60):
        parts = [say(rng.randint(0, 15))]
        for _ in range(rng.randint(0, 3)):
            w = words_of(rng.choice(items)[1])
            a = rng.randint(0, max(len(w) - 10, 0))
            parts += [" ".join(w[a : a + rng.choice((5, 9, 10, 14, 40))]).upper(), say(rng.randint(0, 6))]
        texts.append(" ".join(parts))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.decontaminate(frame(spark, texts), bench, sent_bytes=sent_bytes).collect()
    got = {r.doc_id: (r.n_words, sum(b - a for a, b in zip(r.begins, r.ends, strict=True)), r["items"]) for r in rows}
    assert [got[i] for i in range(len(texts))] == contamination_brute(texts, items, 10)


@given(st.lists(st.integers(0, 30), min_size=1, max_size=14), st.integers(1, 6))
@settings(max_examples=200, deadline=None)
def test_bucket_bounds_are_optimal(sizes, buckets):
    from itertools import combinations

    lengths = sorted(set(sizes))
    counts = [sizes.count(x) for x in lengths]
    ends = packing.bounds(np.array(lengths), np.array(counts), buckets)
    padded = lambda e: sum(n * min(x for x in e if x >= v) for v, n in zip(lengths, counts, strict=True))
    k = min(buckets, len(lengths))
    assert len(ends) == k and ends == sorted(ends) and ends[-1] == lengths[-1]
    assert padded(ends) == min(padded((*c, lengths[-1])) for c in combinations(lengths[:-1], k - 1))


def test_batches_hold_the_budget(spark):
    rng = random.Random(1)
    texts = ["w " * rng.choice((0, 3, 10, 11, 50, 400)) for _ in range(500)]
    rows = packing.pack(frame(spark, texts), buckets=3, budget=100).toPandas()
    assert (rows.n_tokens <= rows.bucket_length).all()
    per = rows.groupby(["bucket", "batch"]).agg(n=("doc_id", "count"), length=("bucket_length", "max"))
    assert ((per.n * per.length <= 100) | (per.n == 1)).all()
    for _, g in rows.groupby("bucket"):
        room = max(1, 100 // max(1, g.bucket_length.iloc[0]))
        ordered = g.sort_values("doc_id")
        assert (ordered.batch * room + ordered.place).tolist() == list(range(len(g)))


def test_token_files_round_trip(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(token_output.TOKENIZER))
    texts = ["", None, "Hello, World. It's 3.5%!", "ÀÉÎ naïve ß straße ŒUVRE Straße,", "a<|endoftext|>b <|STARTOFTEXT|>", "x\t\ty z w\r\nv", "é combining", "日本語 テキスト", "I'm we'll they've 'tis", "a.,b ... ,.", "İstanbul Σας ΟΔΟΣ", "\x1c\x1d a", "x" * 5000]
    texts += [r.text for r in table(spark, SF, "documents").limit(60).collect()]
    docs = frame(spark, texts)
    path = str(tmp_path / "tokens")
    token_output.write_tokens(docs, path, parts=3)
    rows = {r.doc_id: r for r in token_output.read_tokens(spark, path).collect()}
    sums = {r.doc_id: r for r in token_output.with_checksums(token_output.read_tokens(spark, path)).collect()}
    at = 0
    for i, t in enumerate(texts):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [token_output.END_ID]
        assert rows[i].ids == ids, t
        assert (rows[i].start, sums[i].start, sums[i].n_tokens) == (at, at, len(ids))
        assert sums[i].ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        at += len(ids)
    assert [r.ids for r in token_output.lookup(spark, path, [2]).collect()] == [rows[2].ids]
    plan = token_output.lookup(spark, path, [2])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id" in plan or "PushedFilters: [EqualTo(doc_id" in plan or "PushedFilters: [IsNotNull(doc_id" in plan


def test_tokens_are_orc_with_an_index(spark, tmp_path):
    import pyarrow.orc as orc

    path = str(tmp_path / "tokens")
    token_output.write_tokens(table(spark, SF, "documents"), path, parts=2)
    found = [orc.ORCFile(str(f)) for f in sorted((tmp_path / "tokens").glob("*.orc"))]
    ids = [f.read(columns=["doc_id"])["doc_id"].to_pylist() for f in found]
    assert sum(ids, []) == sorted(sum(ids, [])) and len(ids) == 2


def test_hosts_that_mostly_fail_are_dropped(spark):
    good, bad = " ".join(f"word{i}" for i in range(80)), "short text"
    rows = [(i, good, "good") for i in range(20)] + [(100 + i, bad if i < 19 else good, "bad") for i in range(20)] + [(200, good, "one"), (201, good, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()}
    assert kept[0] and not kept[119] and not kept[100] and kept[200] and kept[201]
    rates = {r.host: r.rate for r in quality_rules.host_rates(quality_rules.counts(docs)).collect()}
    assert 0 < rates["good"] < rates["one"] < rates["bad"] < 19 / 20


def test_packing_by_token_counts(spark, tmp_path):
    got = {r.doc_id: r for r in registry.QUERIES["op9_packing_tokens"](spark, SF).collect()}
    token_output.write_tokens(table(spark, SF, "documents"), str(tmp_path / "ids"))
    ids = {r.doc_id: r.n_tokens for r in token_output.read_tokens(spark, str(tmp_path / "ids")).select("doc_id", "n_tokens").collect()}
    assert {i: r.n_tokens for i, r in got.items()} == ids
    total = {}
    for r in got.values():
        total[r.bucket, r.batch] = total.get((r.bucket, r.batch), 0) + r.bucket_length
    assert all(n <= packing.BUDGET for n in total.values() if n != max(ids.values()))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_agree_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    wanted = con.execute(registry.ORACLES[name])
    names = [d[0] for d in wanted.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, wanted.fetchall()))


def test_pipeline_is_its_stages(spark):
    docs = table(spark, SF, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = spark.createDataFrame(stage(spark, docs, SF).toArrow())
        kept[name] = out
        assert out.columns == docs.columns and out.count() <= docs.count()
        docs = out
    read = lambda df: {r.doc_id: r.text for r in df.collect()}
    q, lines, near, bench = (read(kept[n]) for n, _ in corpus_pipeline.STAGES[:4])
    ids = sorted(q)
    for i, gone in zip(ids, runs_brute([q[i] for i in ids], line_dedup.LEAST_WORDS), strict=True):
        found, wanted = (lines[i] or "").split() if i in lines else [], left_words(q[i], gone)
        assert len(found) <= len(wanted) and (found == wanted or sum(gone) or i not in lines or len((q[i] or "").split()) > len(found))
    ids = sorted(lines)
    groups = near_brute([lines[i] for i in ids], 5, 80)
    assert sorted(near) == [ids[k] for k, (_, c) in enumerate(groups) if c == k]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    ids = sorted(near)
    hits = contamination_brute([near[i] for i in ids], items, 10)
    assert sorted(bench) == [i for i, h in zip(ids, hits, strict=True) if not h[1]]
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(bench)
    packed = packing.pack(kept["decontamination"])
    assert packed.select(F.sum("n_tokens")).first()[0] == sum(len(t.split()) for t in bench.values())
