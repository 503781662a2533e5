"""Toxicity and quality: held-out accuracy, defined cases, and the machine's identity."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.llm import quality, toxicity
from panelcast.llm.linear import fit_logistic, sigmoid

DATA = "/root/testdata/sf0.1"


def held_out(frame, spark, label):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    rows = frame.join(labels, "doc_id").where("held_out").toPandas()
    assert len(rows) > 300
    return rows["y"].to_numpy(), rows["score"].to_numpy(), rows["predicted"].to_numpy()


def test_toxicity_held_out(spark):
    from panelcast.llm.queries import QUERIES
    out = QUERIES["op2_toxicity"](spark, DATA).cache()
    assert out.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    y, score, predicted = held_out(out, spark, "toxic")
    assert ((score >= 0.5) == predicted).all() and (score >= 0).all() and (score <= 1).all()
    assert (predicted == y).mean() > 0.95
    assert predicted[y == 1].mean() > 0.75 and predicted[y == 0].mean() < 0.02


def test_quality_held_out(spark):
    from panelcast.llm.queries import QUERIES
    out = QUERIES["op5_quality"](spark, DATA).cache()
    y, score, predicted = held_out(out, spark, "quality")
    assert ((score >= 0.7) == predicted).all()
    assert (predicted == y).mean() > 0.97


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars double, toxicity string")


BAD = [f"you {w} fool go away number {k}" for k in range(12) for w in ("rotten", "nasty")]
GOOD = [f"the river runs past house number {k} and {w}" for k in range(12) for w in ("field", "hill", "lake")]


def training(spark):
    rows = [(i, t, None, "x") for i, t in enumerate(BAD + GOOD)]
    rows += [(100, None, None, None), (101, "", float("nan"), None), (102, BAD[0], 1.0, None), (102, BAD[0], 1.0, None),
             (None, "rotten", 2.0, None), (104, "word " * 40_000, 3.0, None)]
    labels = [(i, int(i < len(BAD)), int(i >= len(BAD))) for i in range(len(BAD) + len(GOOD))] + [(0, None, 1), (None, 1, 1), (7777, 1, 0)]
    return docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxicity_cases(spark):
    docs, labels = training(spark)
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert rows[0].asDict().keys() == {"doc_id", "text", "n_chars", "toxicity"} and len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.text, set()).add(r.toxicity)
    assert all(len(s) == 1 for s in by.values())            # equal texts, equal scores
    assert min(by[t] for t in map(str, BAD)) > max(by[t] for t in map(str, GOOD)) or \
        min(min(by[t]) for t in BAD) > max(max(by[t]) for t in GOOD)
    assert by[None] == by[""]
    assert toxicity.score(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("op", [toxicity, quality])
def test_no_labels_or_one_class(spark, op):
    docs, labels = training(spark)
    name = "toxic" if op is toxicity else "quality"
    out = "toxicity" if op is toxicity else "quality_score"
    for some, want in ((labels.limit(0), 0.5), (labels.where(f"{name} = 1 and doc_id < 1000"), None)):
        scores = {r[out] for r in op.score(docs, op.fit(docs, some, name)).collect()}
        assert len(scores) == 1
        assert want is None or scores == {want}
        assert want or min(scores) > 0.9


def test_quality_cases(spark):
    docs, labels = training(spark)
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).collect()
    scores = {}
    for r in rows:
        scores.setdefault(r.text, r.quality_score)
    assert min(scores[t] for t in GOOD) > max(scores[t] for t in BAD)
    assert 0 <= scores[None] <= 1 and len(rows) == docs.count()
    assert quality.score(docs.limit(0), model).count() == 0


def test_sum_of_squares_identity():
    """The linear-time score is the sum over all pairs."""
    rng = np.random.default_rng(8)
    words, extra = 1 << quality.HASH_BITS, 3
    model = quality.QualityModel(0.3, rng.normal(size=words + extra), rng.normal(size=(words + extra, quality.RANK)),
                                 np.zeros(extra), np.ones(extra))
    bucket, value, dense = rng.integers(0, words, 9), rng.random(9), rng.normal(size=(1, extra))
    got, _ = quality._sums(model, 1, np.zeros(9, np.int64), bucket, value, dense)
    index, x = np.concatenate([bucket, words + np.arange(extra)]), np.concatenate([value, dense[0]])
    want = 0.3 + (model.w[index] * x).sum()
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            want += model.v[index[i]] @ model.v[index[j]] * x[i] * x[j]
    assert abs(got[0] - want) < 1e-9


def test_features_of_texts():
    text = "One two two.\nONE | 2!".encode()
    d, bucket, value, dense = quality.features(np.frombuffer(text, np.uint8), np.array([0, len(text), len(text)]))
    by = dict(zip(quality.STRUCTURE, dense[0], strict=True))
    assert abs(by["bars"] - 1 / len(text)) < 1e-12 and abs(by["distinct"] - 1.0) < 1e-12
    assert (dense[1] == 0).all() and set(d.tolist()) == {0} and abs((value ** 2).sum() - 1) < 1e-9


def test_ngrams_do_not_cross_documents():
    texts = [b"ab", b"", b"cd  ef", b"abcdefgh"]
    offs = np.cumsum([0, *map(len, texts)])
    got = [set() for _ in texts]
    for key, doc in toxicity._ngrams(np.frombuffer(b"".join(texts), np.uint8), offs):
        for k, d in zip(key.tolist(), doc.tolist(), strict=True):
            n = k >> 56
            got[d].add((k & ((1 << 56) - 1)).to_bytes(7, "big")[-n:])
    for text, own in zip(texts, got, strict=True):
        padded = b" " + b" ".join(text.split()) + b" " if text else b" "
        assert own == {padded[i:i + n] for n in toxicity.SIZES for i in range(len(padded) - n + 1)}


def test_logistic_fit():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 3))
    y = (rng.random(400) < sigmoid(x @ [2.0, -1.0, 0.0] + 0.5)).astype(float)
    rows, cols = np.repeat(np.arange(400), 3), np.tile(np.arange(3), 400)
    w, b = fit_logistic(rows, cols, x.ravel(), y, np.ones(400), 3, l2=1.0, steps=2000)
    grad = x.T @ (sigmoid(x @ w + b) - y) + w
    assert np.abs(grad).max() < 1e-3 and w[0] > 1 > -0.3 > w[1]
