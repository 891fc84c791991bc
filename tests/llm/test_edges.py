"""Every operator and every stage on awkward tables: nulls, empty and long texts, repeats, no rows, extra columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paperledger.llm import decontaminate, language_id, line_dedup, lm_score, near_dup, packing, quality_classifier, quality_rules, token_output, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
TEXTS = [None, "", " \n\t ", "a", "One line.\nTwo lines.\n", "x " * 300, LONG, "ünï çödé 😀 " * 20, "a\x00b \x1c c", "word " * 10 + "\n" + "word " * 10]


def awkward(spark):
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id at all", "en", "src0", 12), (50, "no lang and source", None, None, None), (3, "a", "en", "src0", 1), (3, "a", "en", "src0", 1), (4, "other text of a known id", "en", "src1", 9)]
    return spark.createDataFrame(rows, DOCS)


def crowded(docs):
    """With columns that operators use names of."""
    names = ["hash", "key", "label", "score", "node", "hub", "salt", "part", "batch", "bucket", "n_deleted", "kept", "items", "n_words", "gone", "version", "gone_id"]
    return docs.select("*", *(F.lit("x").alias(n) for n in names))


def empty(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def bench(spark, rows=((0, "one two three"), (1, None), (None, "no lang and source"), (2, ""))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def tokens(docs, tmp):
    token_output.write_tokens(docs, tmp)
    return token_output.with_checksums(token_output.read_tokens(docs.sparkSession, tmp))


OPERATORS = {
    "rules": lambda s, d, t: quality_rules.judge(d),
    "language": lambda s, d, t: language_id.identify(d),
    "quality": lambda s, d, t: quality_classifier.scored(d, labels(s)),
    "decontaminate": lambda s, d, t: decontaminate.decontaminate(d, bench(s)),
    "toxicity": lambda s, d, t: toxicity.toxicity(d, labels(s)),
    "lm": lambda s, d, t: lm_score.cross_entropy_difference(d, labels(s)),
    "tokens": lambda s, d, t: tokens(d, t),
    "near": lambda s, d, t: near_dup.near_duplicates(d),
    "packing": lambda s, d, t: packing.pack(d),
    "lines": lambda s, d, t: line_dedup.deduplicate(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(spark, tmp_path, name):
    docs = crowded(awkward(spark))
    got = OPERATORS[name](spark, docs, str(tmp_path / "out"))
    assert sorted(map(str, (r.doc_id for r in got.collect()))) == sorted(map(str, (r.doc_id for r in docs.collect())))


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, tmp_path, name):
    assert OPERATORS[name](spark, crowded(empty(spark)), str(tmp_path / "out")).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stages_keep_the_columns(spark, tmp_path, k):
    stage = corpus_pipeline.STAGES[k][1]
    labels(spark, [(None, None, None), (0, 1, None), (0, 1, None)]).write.parquet(str(tmp_path / "labels.parquet"))
    bench(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (crowded(awkward(spark)), crowded(empty(spark))):
        out = stage(spark, docs, str(tmp_path))
        if k == 4:
            assert out.columns == ["doc_id", "n_tokens", "bucket", "bucket_length", "batch", "place"] and out.count() == docs.count()
            continue
        assert [(f.name, f.dataType) for f in out.schema.fields] == [(f.name, f.dataType) for f in docs.schema.fields]
        assert out.exceptAll(docs).where("doc_id IN (0, 1, 2, 3)").count() == 0


def test_defined_results(spark, tmp_path):
    docs = awkward(spark)
    by = lambda df: {r.doc_id: r for r in df.collect()}
    rules = by(quality_rules.judge(docs))
    assert rules[0].n_words == 0 and rules[0].base_failed and not rules[0].kept
    assert rules[5].n_repeat_words == 300 and rules[5].base_failed
    assert rules[6].n_words == 60_000 and rules[6].n_repeat_words == 0 and not rules[6].base_failed
    assert rules[9].n_dup_lines == 1
    langs = by(language_id.identify(docs))
    assert all(langs[i].lang_pred == "und" and langs[i].score == 0 for i in (0, 1, 2))
    near = by(near_dup.near_duplicates(docs))
    assert near[0].n_shingles == 0 and near[0].kept and near[3].n_shingles == 1
    assert near[None].component_id is None and near[None].kept
    packed = by(packing.pack(docs))
    assert packed[0].n_tokens == 0 and packed[6].n_tokens == 60_000
    lm = by(lm_score.cross_entropy_difference(docs, labels(spark)))
    assert lm[0].score is None and lm[6].n_tokens == 60_000
    lines = by(line_dedup.deduplicate(docs))
    assert lines[0].text is None and lines[6].text == LONG and {r.n_deleted for r in lines.values()} == {0}


def test_nulls_in_labels_and_hosts(spark):
    docs = awkward(spark)
    some = labels(spark, [(None, 1, 1), (4, None, None), (5, 0, 0), (6, 1, 1), (6, 1, 1), (99, 0, 1), (7, 2, 3)])
    assert quality_classifier.scored(docs.select("doc_id", "text"), some).count() == docs.count()
    assert toxicity.toxicity(docs, some).count() == docs.count()
    assert quality_rules.judge(docs.withColumn("source", F.lit(None).cast("string"))).count() == docs.count()
    assert language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()[0][0] == "und"


def test_benchmark_without_rows(spark):
    docs = awkward(spark).select("doc_id", "text")
    found = decontaminate.summary(decontaminate.decontaminate(docs, bench(spark, [])))
    assert found.where("contaminated").count() == 0


def tables_left(spark):
    import os

    from paperledger.tables import checkpoint_root, release

    release(spark)
    root = checkpoint_root(spark).removeprefix("file:")
    return {x for folder in os.listdir(root) if folder.startswith("tables-") for x in os.listdir(f"{root}/{folder}")}


@pytest.mark.parametrize("name", ["op1_quality_rules", "op4_decontaminate", "op6_lm_score", "op7_token_output", "op8_near_dup", "op9_packing", "op10_line_dedup", "pipeline"])
def test_no_table_stays_when_a_result_is_gone(spark, name):
    import __spark_entry__

    before = tables_left(spark)
    got = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    derived = got.where(F.col("doc_id") >= 0)
    del got
    tables_left(spark)
    assert derived.count() > 0  # a frame that was made of the result keeps its tables
    del derived
    assert tables_left(spark) <= before
