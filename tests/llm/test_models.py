"""Trained operators: held-out accuracy, gradients, automata and language models against brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from paperledger.llm import language_id, lm_score, quality_classifier, toxicity
from paperledger.llm.common import table, text_of

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = table(spark, SF, "documents")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_more_languages_than_lanes(spark):
    rows = [(100 * k + i, f"{chr(0x4E00 + 97 * k) * 3} {chr(0x4E10 + 97 * k)} " * 30, f"l{k:03}") for k in range(100) for i in range(8)]
    rows += [(99_000 + i, "zz", "once") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.fit(docs).langs == [f"l{k:03}" for k in range(100)]
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs).collect()}
    assert len(got) == len(rows) and sum(got[d] == lang for d, _, lang in rows) > 0.5 * len(rows)


def numeric(net, key, at, loss):
    step = 1e-3
    old = net.w[key][at]
    out = []
    for d in (step, -step):
        net.w[key][at] = old + d
        out.append(loss())
    net.w[key][at] = old
    return (out[0] - out[1]) / (2 * step)


def test_language_gradients():
    rng = np.random.default_rng(1)
    net = language_id.Network(["a", "b", "c"])
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    data, lang, real = rng.integers(97, 103, (12, 3)).astype(np.uint8), np.array([0, 1, 2]), np.ones((12, 3))

    def loss():
        y = net.run("f", data)[0] @ net.w["of"] + net.run("b", data)[0] @ net.w["ob"] + net.w["bias"]
        y = y - np.log(np.exp(y).sum(axis=2, keepdims=True))
        return -y[:, np.arange(3), lang].mean()

    slopes = net.slopes(data, lang, real)
    for key in net.w:
        at = np.unravel_index(np.abs(slopes[key]).argmax(), slopes[key].shape)
        assert slopes[key][at] == pytest.approx(numeric(net, key, at, loss), rel=0.05, abs=1e-3)


def test_language_windows_cover_texts():
    texts = ["", "abc", "x" * 64, "y" * 65, "é" * 100]
    data, length, row = language_id.windows(text_of(pa.array(texts)))
    for i, t in enumerate(texts):
        joined = b"".join(data[k, : length[k]].tobytes() for k in np.flatnonzero(row == i))
        assert joined == t.encode()


def test_quality_held_out(spark):
    got = quality_classifier.query(spark, SF).join(table(spark, SF, "labels"), "doc_id").where("held_out").toPandas()
    assert got.predicted[got.quality == 1].mean() > 0.95 and got.predicted[got.quality == 0].mean() < 0.3


def test_quality_tables_equal_the_network():
    net = quality_classifier.Network()
    texts = ["", "a", "hello world", "ü" * 500, "abc " * 200]
    text = text_of(pa.array(texts))
    got = quality_classifier.Scorer(net)(text)
    for i, t in enumerate(texts):
        raw = list(t.encode()) or [quality_classifier.PAD]
        full = np.array(raw + [quality_classifier.PAD] * quality_classifier.WIDTH)
        conv = np.array([net.w["embed"][full[k : k + quality_classifier.WIDTH]].ravel() @ net.w["filters"] for k in range(len(raw))])
        logits, sizes = [], []
        for k in range(0, len(raw), quality_classifier.CHUNK):
            logits.append(net.head(conv[k : k + quality_classifier.CHUNK].max(axis=0)[None])[2][0])
            sizes.append(len(conv[k : k + quality_classifier.CHUNK]))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-np.average(logits, weights=sizes))), abs=1e-4)


def test_quality_gradients():
    net = quality_classifier.Network()
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    text, owner, label = text_of(pa.array(["abc def " * 40, "!!! $$$ " * 40, "zz"])), np.array([0, 1, 1]), np.array([1.0, 0.0])

    def loss():
        data, begin, row, length = quality_classifier.padded(text)
        pooled = []
        for b, n in zip(begin, length, strict=True):
            pooled.append(np.max([net.w["embed"][data[b + k : b + k + quality_classifier.WIDTH]].ravel() @ net.w["filters"] for k in range(n)], axis=0))
        logit, doc = net.head(np.array(pooled))[2], owner[row]
        z = np.bincount(doc, length * logit) / np.bincount(doc, length)
        p = 1 / (1 + np.exp(-z))
        return -(label * np.log(p) + (1 - label) * np.log(1 - p)).mean()

    slopes = net.slopes(text, owner, label)
    for key in net.w:
        at = np.unravel_index(np.abs(slopes[key]).argmax(), slopes[key].shape)
        assert slopes[key][at] == pytest.approx(numeric(net, key, at, loss), rel=0.05, abs=1e-3)


def levenshtein(a, b):
    """With swaps of neighbours."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row, old = [i], rows[-1]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[-1] = min(row[-1], rows[-2][j - 2] + 1)
        rows.append(row)
    return rows[-1][-1]


def test_automaton_is_the_edit_distance():
    rng = random.Random(3)
    terms = ["abcab", "abcaba", "bacc", "cab", "cccccc", "abxyz"]
    machine = toxicity.Automaton(terms)
    words = {"".join(rng.choice("abcxq") for _ in range(rng.randint(1, 8))) for _ in range(4000)} | set(terms)
    for t in terms:
        for i in range(len(t) + 1):
            words |= {t[:i] + "b" + t[i:], t[:i] + t[i + 1 :], t[:i] + "q" + t[i + 1 :], t[:i] + t[i + 1 : i + 2] + t[i : i + 1] + t[i + 2 :]}
    words = sorted(w for w in words if w)
    found = toxicity.Spelled([" ".join(words)])
    near = machine.near[machine.run(machine.class_of[found.chars], found.begin, found.end)]
    for w, n in zip(words, near, strict=True):
        best = min((levenshtein(w, t) for t in terms if w == t or len(t) >= toxicity.FUZZY_FROM), default=9)
        assert n == (best + 1 if best <= 1 else 0), w


def scorer_brute(texts, toxic, new):
    """The lexicon by its definition, hits by edit distance, and the score of the same regression."""
    import re

    split = lambda t: set(re.split(r"[\W_]+", t.lower()))
    n1, n0 = sum(toxic), len(toxic) - sum(toxic)
    terms = []
    for term in sorted(set().union(*map(split, texts))):
        a, b = (sum(term in split(t) for t, y in zip(texts, toxic, strict=True) if y == k) for k in (1, 0))
        share = (a + b) / (n1 + n0)
        ratio = 2 * sum(k * math.log(k / (share * n)) for k, n in ((a, n1), (b, n0)) if k)
        if len(term) >= 3 and a >= toxicity.LEAST_DOCS and a / n1 > 19 * b / n0 and ratio >= toxicity.LEAST_RATIO:
            terms.append(term)

    def kinds(t):
        words = re.findall(r"\w+", t.lower())
        exact = [w for w in words if w in terms]
        wrong = [w for w in words if w not in terms and any(len(x) >= toxicity.FUZZY_FROM and levenshtein(w, x) <= 1 for x in terms)]
        near = {x for w in exact + wrong for x in terms if x == w or w in wrong and len(x) >= toxicity.FUZZY_FROM and levenshtein(w, x) <= 1}
        hits = len(exact) + len(wrong)
        return np.log1p([len(exact), len(wrong), 0, 0, max(hits - 1, 0), len(near)])

    weights, bias = toxicity.regression(np.array([kinds(t) for t in texts]), np.array(toxic))
    return terms, [1 / (1 + math.exp(-(kinds(t) @ weights + bias))) for t in new]


def test_toxicity_against_brute_force(spark):
    """Terms of any script and plane, learned and found, with swapped letters, too."""
    rng = random.Random(8)
    bad, good = ["scoundrel", "дурак", "𝓲𝓭𝓲𝓸𝓽𝓼", "twit"], [f"plain{i}" for i in range(60)]
    say = lambda *more: " ".join(rng.sample([*rng.sample(good, 12), *more], 12 + len(more)))
    texts = [say(rng.choice(bad)) if i % 3 == 0 else say() for i in range(150)]
    toxic = [int(i % 3 == 0) for i in range(150)]
    new = [say("scuondrel"), say("дурка"), say("𝓲𝓭𝓲𝓸𝓽𝓼"), say("tiwt"), say()]
    rows = [(i, t) for i, t in enumerate([*texts, *new])]
    chosen = [(i, y) for i, y in enumerate(toxic) if zlib.crc32(str(i).encode()) % toxicity.FOLDS]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, y) for i, y in chosen], "doc_id long, quality int, toxic int")
    terms, wanted = scorer_brute([texts[i] for i, _ in chosen], [y for _, y in chosen], new)
    assert set(bad) <= set(terms)
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, marks).collect()}
    assert [got[150 + i] for i in range(5)] == pytest.approx(wanted, abs=1e-6)
    assert [s >= 0.5 for s in wanted] == [True, True, True, False, False]


def test_quotation_is_told_from_abuse():
    machine = toxicity.Automaton(["scoundrel"])
    x = np.round(np.expm1(toxicity.features(["you scoundrel", 'he "scoundrel" it', "they called him scoundrel", "you scoundrl scoundrel", "none", ""], machine)))
    assert x[:, :5].tolist() == [[1, 0, 0, 0, 0], [0, 0, 1, 0, 0], [0, 0, 1, 0, 0], [1, 1, 0, 0, 1], [0] * 5, [0] * 5]


def test_toxicity_held_out(spark):
    got = toxicity.query(spark, SF).join(table(spark, SF, "labels"), "doc_id").join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    assert got.predicted[got.toxic == 0].mean() < 0.02
    english = got[got.lang == "en"]
    assert english.predicted[(english.toxic == 1) & english.held_out].mean() > 0.9


def test_lm_is_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("the of and a cat dog sat Ran mat zzz".split()) for _ in range(rng.randint(0, 12))) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    targets = spark.createDataFrame([(i,) for i in range(0, 30, 3)], "doc_id long")
    size = 6
    sent, joined = ({r.doc_id: r for r in lm_score.cross_entropy_difference(docs, targets, size, n).collect()} for n in (100, 0))
    words = [t.lower().split() for t in texts]
    counts = Counter(w for t in words for w in t)
    least = sorted(counts.values(), reverse=True)[size - 1]
    kept = {w for w in counts if counts[w] > least}
    ties = [w for w in counts if counts[w] == least]
    from paperledger.llm.common import Words

    hashes = {w: int(Words(text_of(pa.array([w]))).hash.view(np.int64)[0]) for w in ties}
    kept |= set(sorted(ties, key=hashes.get)[: size - len(kept)])
    known = [[w if w in kept else None for w in t] for t in words]

    def loss(i, chosen):
        chosen = [t for k, t in enumerate(known) if k in chosen and k != i]
        single, pairs = Counter(w for t in chosen for w in t), Counter((a, b) for t in chosen for a, b in zip([None, *t], t))
        total, n = sum(single.values()), size + 1
        out = 0
        for a, b in zip([None, *known[i]], known[i]):
            uni = (single[b] + lm_score.ADDED) / (total + lm_score.ADDED * n)
            out -= math.log((min(pairs[a, b], single[a]) + lm_score.PRIOR * uni) / (single[a] + lm_score.PRIOR))
        return out / len(known[i])

    for i in range(30):
        assert sent[i] == joined[i]
        if known[i]:
            t, g = loss(i, set(range(0, 30, 3))), loss(i, set(range(30)))
            assert (sent[i].target_loss, sent[i].background_loss, sent[i].score) == pytest.approx((t, g, t - g))


def test_lm_counts_every_word_and_pair(spark):
    rng = random.Random(8)
    # More distinct words than any fixed table of the first version held, most of them rare.
    texts = [" ".join(rng.choice(["the", "of", f"r{rng.randrange(60_000)}", f"only{i}x{k}"]) for k in range(2_000)) for i in range(60)]
    texts += [texts[3], "", "the"]
    chosen = set(range(0, 60, 4)) | {60}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    targets = spark.createDataFrame([(i,) for i in sorted(chosen)], "doc_id long")
    words = [t.split() for t in texts]
    every = [(Counter(t), Counter(zip([None, *t], t))) for t in words]
    models = []
    for some in (chosen, range(len(texts))):
        models.append((sum((every[i][0] for i in some), Counter()), sum((every[i][1] for i in some), Counter()), some))
    size = len({w for t in words for w in t}) + 1
    assert size > 32_768

    def loss(i, single, pairs, some):
        mine, (own, own_pairs) = int(i in some), every[i]
        total, out = sum(single.values()) - mine * len(words[i]), 0
        for a, b in zip([None, *words[i]], words[i]):
            before = single[a] - mine * own[a]
            uni = (single[b] - mine * own[b] + lm_score.ADDED) / (total + lm_score.ADDED * size)
            out -= math.log((min(pairs[a, b] - mine * own_pairs[a, b], before) + lm_score.PRIOR * uni) / (before + lm_score.PRIOR))
        return out / len(words[i])

    wanted = {i: [loss(i, *m) for m in models] for i in (0, 1, 3, 4, 60, 62)}
    for sent in ({}, {"sent_pairs": 0, "sent_words": 0}, {"sent_pairs": 40, "sent_words": 2}):
        got = {r.doc_id: r for r in lm_score.cross_entropy_difference(docs, targets, **sent).collect()}
        assert len(got) == len(texts) and got[61].score is None
        for i, (t, g) in wanted.items():
            assert (got[i].target_loss, got[i].background_loss, got[i].score) == pytest.approx((t, g, t - g), abs=1e-7)


def test_batches_of_any_size_score_alike():
    net = language_id.Network(["a", "b"])
    texts = ["some words here " * 30, "x", "más texto"]
    whole = language_id.predict(net, text_of(pa.array(texts)))[1]
    assert np.allclose(whole, [language_id.predict(net, text_of(pa.array([t])))[1][0] for t in texts], atol=1e-5)
