"""The pipeline and what it is made of on nulls, repeated rows, clashing columns and nothing at all."""

import pytest

import corpus_pipeline
from wayside.llm import mixing, neardup, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long, ids string"
PROSE = "a quiet river runs past the old mill and on to the sea where boats wait for the tide to turn again at dusk"


def rows():
    long_text = " ".join(f"word{i} thing{i * 7}" for i in range(20000))
    own = [(1, None), (2, ""), (3, " \n"), (4, PROSE), (5, PROSE), (5, PROSE), (6, PROSE.replace("dusk", "dawn")), (7, f'{PROSE} password = "hunter2hunter2" {PROSE[::-1]}'), (8, long_text), (9, f"{long_text} end"), (None, f"{PROSE} with no number at all and some more words")]
    return [(i, t, "en", None if i == 4 else "src", 7, True, 1, "clash") for i, t in own]


def stages(spark, docs):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], "unused"))
    return out[1:]


@pytest.fixture(scope="module")
def after(spark):
    return stages(spark, spark.createDataFrame(rows(), SCHEMA).repartition(3))


def test_columns_stay_until_the_last_stage(after):
    assert all(df.columns == [c.split()[0] for c in SCHEMA.split(", ")] for df in after[:-1])
    assert after[-1].columns == ["doc_id", "lang", "source", "ids", "n_tokens", "decoded_sha256"]


def test_each_stage_on_odd_rows(after):
    ids = [sorted((r.doc_id for r in df.collect()), key=str) for df in after]
    assert ids[0] == sorted([4, 5, 5, 6, 7, 8, 9, None], key=str)  # null and empty texts fail the rules
    assert ids[1] == sorted([4, 7, 8, None], key=str)  # of copies and near copies the least, whatever repeats it
    assert ids[2] == ids[1]
    secret = next(r for r in after[2].collect() if r.doc_id == 7)
    assert "hunter2" not in secret.text and "[assign]" in secret.text and secret.n_chars == len(secret.text)
    assert set(ids[3]) <= set(ids[2]) and all(ids[3].count(i) <= 3 for i in ids[3])
    assert ids[4] == ids[3]


def test_nothing_at_all(spark):
    assert [df.count() for df in stages(spark, spark.createDataFrame([], SCHEMA))] == [0] * 5


def test_clashing_columns_of_single_operators(spark):
    docs = spark.createDataFrame([(*r, "x", "x", "x") for r in rows()], SCHEMA + ", n_words string, component_id string, target string")
    assert quality.keep_documents(docs).columns == docs.columns
    assert mixing.mix_documents(docs).columns == docs.columns
    assert neardup.near_duplicates(docs).columns[:4] == ["doc_id", "n_shingles", "component_id", "kept"]
    assert neardup.drop_near_duplicates(docs).columns == docs.columns
