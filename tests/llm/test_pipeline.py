"""Stages of the pipeline by values, on documents with columns of all names and on odd ones."""

import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from assetloom.llm import langid

SF = "/root/testdata/sf0.001"
CLASHES = ["_id", "_sig", "_first", "_alone", "_p", "sig", "n", "h", "l", "t", "i", "score", "key", "spans", "stays", "component_id"]


def documents(spark, rows):
    df = spark.createDataFrame([(*r, None, "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"more {c}") for c in CLASHES})


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_stage_rejects_other_scripts_and_keeps_the_rest(spark, given):
    strange = [(-1, None), (-2, ""), (-3, "12 34 !?"), (-4, "漢字 汉字 漢字 かな カナ 文字"), (-5, "Сегодня хорошая погода и мы идем гулять в парк"), (-6, "A")]
    docs = given.withColumns({c: F.lit(f"more {c}") for c in CLASHES}).unionByName(documents(spark, strange))
    got = p.language_stage(spark, docs, SF)
    assert got.columns == p.COLUMNS
    ids = {r.doc_id for r in got.collect()}
    assert {i for i in ids if i < 0} == {-6} and {r.doc_id for r in given.collect()} <= ids


def test_language_stage_without_anything_to_learn(spark):
    assert p.language_stage(spark, documents(spark, [(1, "some text"), (2, None)]), SF).count() == 0


def test_limit_lies_below_what_is_learned_from(given):
    model, limit = langid.fit_with_limit(given, F.lit(True))
    near = [r.x for r in given.select(langid.language_nearness(F.col("text"), model).alias("x")).collect()]
    assert min(near) > limit > 0


@pytest.mark.parametrize("strange", ["es", "fr", "de", "en"])
def test_language_stage_rejects_a_language_that_no_score_claims(spark, given, strange):
    docs = given.withColumn("lang", F.when(F.col("lang") != strange, F.col("lang")))
    stay = {r.doc_id for r in p.language_stage(spark, docs, SF).collect()}
    of = {r.doc_id: r.lang for r in given.collect()}
    own, other = [i for i in of if of[i] != strange], [i for i in of if of[i] == strange]
    assert sum(i in stay for i in own) >= 0.98 * len(own) and sum(i in stay for i in other) <= 0.15 * len(other)


def test_nearness_goes_by_the_ridge_scores(given):
    model, limit = langid.fit_with_limit(given, F.lit(True))
    texts = [r.text for r in given.filter("length(text) > 200").limit(20).collect()]
    rows = langid.presence(texts)
    assert (langid.nearness(rows, model) > limit).all()
    # texts that no language claims are below any limit, and without ridge weights nothing is near
    assert (langid.nearness(rows, replace(model, least_claim=math.inf)) == -math.inf).all()
    assert (langid.nearness(rows, replace(model, weights=0 * model.weights, least_claim=-math.inf)) == 0).all()
    # cells drawn by chance: squared distances are as many as languages, on average
    rng = np.random.default_rng(1)
    drawn = np.zeros((2000, langid.CELLS), np.float32)
    for row in drawn:
        row[rng.choice(langid.CELLS, 100, replace=False)] = 0.1
    distance, claim = langid.beyond_chance(drawn, model)
    assert (distance**2).mean() == pytest.approx(len(model.languages), rel=0.1) and distance.max() < limit and abs(claim.mean()) < 2


def test_limits_with_few_to_learn_from(spark):
    for rows in ([("some words of one text", "en")], [("some words of one text", "en"), ("noch ein paar Worte", "de")], [("", "en"), ("", "en")], [("some words of one text", "en"), ("some more words of texts", "en"), ("noch ein paar Worte", "de")]):
        docs = spark.createDataFrame([(i, t, x, "s", 1) for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
        assert p.language_stage(spark, docs, SF).count() == sum(t != "" for t, _ in rows)


def test_near_duplicate_stage_keeps_the_first_of_each_class(spark):
    words = [f"w{i}" for i in range(100)]
    near = [*words[:99], "other"]
    rows = [(5, " ".join(words)), (3, " ".join(near)), (9, " ".join(words)), (7, "all other words here now"), (2, ""), (1, None), (8, "all other words here now"), (8, " ".join(words)), (8, "third text of this id and nothing else"), (None, " ".join(words)), (4, "W0 " + " ".join(words[1:]))]
    got = p.near_duplicate_stage(spark, documents(spark, rows), SF)
    assert got.columns == p.COLUMNS
    assert sorted((str(r.doc_id), (r.text or "")[:9]) for r in got.collect()) == [("1", ""), ("2", ""), ("3", "w0 w1 w2 "), ("7", "all other"), ("8", "third tex"), ("None", "w0 w1 w2 ")]


def test_secret_stage_masks_and_keeps_all(spark):
    rows = [(1, "password = hunter2222 and more"), (2, "clean words"), (3, None), (4, "")]
    got = {r.doc_id: (r.text, r.n_chars) for r in p.secret_stage(spark, documents(spark, rows), SF).collect()}
    assert got == {1: ("[SECRET] and more", 17), 2: ("clean words", 11), 3: (None, None), 4: ("", 0)}


def test_quality_stage_goes_by_the_score(spark, given):
    from assetloom.llm.quality import THRESHOLD, fit_quality, quality_score

    model = fit_quality(given, spark.read.parquet(f"{SF}/labels.parquet"), F.lit(True))
    want = {r.doc_id for r in given.filter(quality_score(F.col("text"), model) >= THRESHOLD).collect()}
    got = {r.doc_id for r in p.quality_stage(spark, given.withColumns({c: F.lit("more") for c in CLASHES}), SF).collect()}
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    good = set(labels[labels.quality == 1].doc_id)
    assert got == want and len(good & got) >= 0.95 * len(good) and 0 < len(got) < given.count()


def test_packing_stage_places_all_tokens(spark):
    got = p.packing_stage(spark, documents(spark, [(1, "a b c"), (2, None), (3, "word " * 9000)]), SF).toPandas()
    assert sorted(got[got.doc_id != 3].length) == [1, 4] and got[got.doc_id == 3].length.sum() == 9001 and got.length.max() == 4096
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert list(own.offset) == [0, *own.length.cumsum()[:-1]] and own.length.sum() <= 4096
