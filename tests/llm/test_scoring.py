"""Classifier and language identification: held-out accuracy, odd texts, plain versions."""

import numpy as np
import pyarrow as pa
import pytest

from liftline.llm import language, quality
from liftline.llm import queries as Q
from liftline.llm import text as T
from liftline.llm.shared import prepare, table

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    prepare(spark)


def test_quality_of_the_held_out_fold(spark):
    rows = Q.op9_quality_classifier(spark, SF_DIR).join(table(spark, SF_DIR, "labels"), "doc_id").collect()
    assert Q.op9_quality_classifier(spark, SF_DIR).count() == 1000
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and np.mean([r.predicted == r.quality for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_scores_do_not_depend_on_held_out_labels(spark):
    docs = table(spark, SF_DIR, "documents")
    labels = Q.quality_labels(spark, SF_DIR)
    want = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    got = {r.doc_id: r.score for r in Q.op9_quality_classifier(spark, SF_DIR).collect()}
    assert want == got


def test_forest_is_its_trees():
    """Array traversal against a walk node by node."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    forest = quality.fit(x, y)
    got = forest.score(x)
    for i in range(0, 400, 13):
        total = forest.base
        for root in forest.roots:
            node = root
            while forest.child[node] != node:
                node = forest.child[node] + (x[i, forest.feature[node]] > forest.cut[node])
            total += forest.value[node]
        assert abs(got[i] - 1 / (1 + np.exp(-total))) < 1e-12
    assert ((got >= 0.5) == y).mean() > 0.95


def test_quality_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (2, "good words here"), (None, "x"), (3, "!" * 5000), (4, "é" * 100)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, stats string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None), (9, 0)], "doc_id long, label int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert [r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()] == [0.5] * len(rows)
    assert quality.quality_scores(docs.limit(0), labels).collect() == []


def test_statistics_against_plain_counts():
    texts = ["One two  two\nTHREE 3!", "", "a a a a b", "x\ty", "é é"]
    piece = next(T.slices(pa.array(texts)))
    got = dict(zip(quality._NAMES, quality.statistics(piece).T, strict=True))
    for i, text in enumerate(texts):
        words = text.split()
        raw = text.encode()
        assert got["words"][i] == pytest.approx(np.log1p(len(words)))
        assert got["upper"][i] == pytest.approx(sum(65 <= b <= 90 for b in raw) / max(len(raw), 1))
        assert got["distinct_words"][i] == pytest.approx(len({w.lower() for w in words}) / max(len(words), 1))
        same = sum(a.lower() == b.lower() for a, b in zip(words, words[1:], strict=False))
        assert got["same_as_last"][i] == pytest.approx(same / max(len(words), 1))


def test_language_of_the_held_out_fold(spark):
    rows = Q.op2_language_id(spark, SF_DIR).join(table(spark, SF_DIR, "documents"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and np.mean([r.lang_pred == r.lang for r in held]) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_ignores_its_other_columns(spark):
    docs = table(spark, SF_DIR, "documents")
    model = language.train(docs.where(~Q.held_out(docs["doc_id"])))
    want = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, model).collect()}
    bare = docs.selectExpr("doc_id", "text", "'zz' as lang", "'other' as source", "1 as score")
    assert {r.doc_id: (r.lang_pred, r.score) for r in language.identify(bare, model).collect()} == want


def test_mixture_of_two_languages(spark):
    docs = table(spark, SF_DIR, "documents")
    model = language.train(docs)
    longest = {r.lang: r.text for r in docs.where("n_chars > 6000").select("lang", "text").collect()}
    text = longest["en"][:4000] + " " + longest["de"][:2000]
    shares, size = language.mixtures(next(T.slices(pa.array([text, longest["fr"]]))), model.likelihood)
    first = dict(zip(model.languages, shares[0], strict=True))
    assert 0.5 < first["en"] < 0.8 and 0.2 < first["de"] < 0.5 and size[0] >= 2
    assert model.languages[int(shares[1].argmax())] == "fr" and np.allclose(shares.sum(axis=1), 1)


def test_many_languages_in_one_text(spark):
    """Fourteen languages of words of their own; one text mixes twelve of them."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7))
    words = {f"l{i:02d}": [word() for _ in range(40)] for i in range(14)}
    speak = lambda lang, n: " ".join(rng.choice(words[lang], n))
    model = language.train(spark.createDataFrame([(speak(x, 400), x) for x in words], "text string, lang string"))
    mixed, pure = " ".join(speak(f"l{i:02d}", 60 + 5 * i) for i in range(12)), speak("l13", 50)
    shares, size = language.mixtures(next(T.slices(pa.array([mixed, pure, "", "l"]))), model.likelihood)
    assert size.tolist()[:3] == [12, 1, 0] and (shares[0][:12] > 0.03).all() and shares[0][12:].sum() == 0
    assert shares[1].argmax() == 13 and np.allclose(shares[[0, 1, 3]].sum(axis=1), 1)
    alone = language.mixtures(next(T.slices(pa.array([mixed]))), model.likelihood)[0]
    assert np.allclose(alone[0], shares[0])


def test_em_against_a_plain_loop():
    rng = np.random.default_rng(5)
    p = rng.random((40, 3)).astype(np.float32)
    n = rng.integers(1, 5, 40).astype(float)
    w, ll = language._fit(p, n, np.zeros(40, int), np.full((1, 3), 1 / 3), 7)
    plain = np.full(3, 1 / 3)
    for _ in range(7):
        joint = p * plain
        plain = (n[:, None] * joint / joint.sum(axis=1, keepdims=True)).sum(axis=0) / n.sum()
    assert np.allclose(w[0], plain) and ll[0] == pytest.approx((n * np.log((p * plain).sum(axis=1))).sum())


def test_language_of_odd_texts(spark):
    train = [("the house and the garden", "en"), ("das haus und der garten", "de"), ("nothing", None), (None, "en")]
    model = language.train(spark.createDataFrame(train, "text string, lang string"))
    assert model.languages == ["de", "en"]
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "“”—…"), (5, "the garden"), (5, "der garten"), (None, "und das"), (6, "日本")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_langs string")
    got = [(r.doc_id, r.lang_pred) for r in language.identify(docs, model).collect()]
    assert sorted(map(str, got[:6])) == sorted(map(str, [(1, "und"), (2, "und"), (3, "und"), (4, "und"), (5, "en"), (5, "de")]))
    assert dict(got)[None] == "de" and dict(got)[6] in ("de", "en")
    none = language.train(spark.createDataFrame([], "text string, lang string"))
    assert {(r.lang_pred, r.score) for r in language.identify(docs, none).collect()} == {("und", 0.0)}
    assert language.identify(docs.limit(0), model).collect() == []
