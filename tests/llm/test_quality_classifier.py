import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality_classifier as qc
from tidemark.llm.common import crc_mod


def corpus(n):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randrange(5, 120))]
        kind = i % 4
        if kind == 1:
            words = [w + "***" for w in words]
        elif kind == 2:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), "x", 1.5))
        labels.append((i, int(kind not in (1, 2)), 0))
    return rows, labels


def test_held_out_accuracy_and_edges(spark):
    rows, labels = corpus(400)
    odd = [(1000, None, "x", 0.0), (1001, "", None, 0.0), (None, "a b c", "x", 0.0), (0, rows[0][1], "x", 1.5), (1002, "word " * 50_000, "x", 0.0)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score double")
    marks = spark.createDataFrame(labels + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = qc.classify(docs, marks.filter(crc_mod(F.col("doc_id"), 4) != 2)).toPandas()
    assert len(out) == len(rows) + len(odd) and out.score.between(0, 1).all()
    held = out.merge(docs.filter(crc_mod(F.col("doc_id"), 4) == 2).select("doc_id").toPandas(), on="doc_id")
    truth = {i: q for i, q, _ in labels}
    hits = [(s >= 0.7) == truth[i] for i, s in zip(held.doc_id, held.score) if i in truth]
    assert len(hits) > 50 and np.mean(hits) > 0.97
    assert len(set(out[out.doc_id == 0].score)) == 1


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in qc.classify(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(abs(r.score - 2 / 3) < 1e-9 for r in qc.classify(docs, one).collect())
    assert qc.classify(docs.filter("false"), none).count() == 0


def test_contexts_equal_direct_sums():
    words = qc.WordRows()
    texts = ["a b a c. C!", "x", "a b"]
    places, signs = qc.index_vectors()
    got = np.zeros(qc.ROWS * qc.WIDTH)
    qc._add_contexts(got, [qc.tokens_of(words.of(t)) for t in texts], places, signs)
    want = np.zeros((qc.ROWS, qc.WIDTH))
    for t in texts:
        tokens = qc.tokens_of(words.of(t))
        for i, a in enumerate(tokens):
            for j in range(max(0, i - qc.WINDOW), min(len(tokens), i + qc.WINDOW + 1)):
                if i != j:
                    np.add.at(want[a], places[tokens[j]], signs[tokens[j]])
    assert np.array_equal(got.reshape(want.shape), want)


def test_temperature_lowers_overconfidence():
    rng = np.random.default_rng(0)
    network = qc.Network(1)
    network.w1[0, 0], network.w2[0] = 1.0, 40.0
    x = rng.uniform(-0.1, 0.1, (4000, 1))
    y = (rng.random(4000) < 1 / (1 + np.exp(-10 * x[:, 0]))).astype(float)
    network.calibrate(x, y)
    assert 3 < network.temperature < 5.5


def test_held_out_figures_on_the_real_table(spark):
    """Ranking, accuracy and calibration of held-out labelled documents; labels.quality never reaches a score."""
    import duckdb

    sf = "/root/testdata/sf0.1"
    if not Path(sf).exists():
        pytest.skip("no sample tables")
    got = qc.op6_quality_classifier(spark, sf).toPandas()
    label = duckdb.sql(f"SELECT doc_id, min(quality) AS y FROM '{sf}/labels.parquet' WHERE quality IS NOT NULL GROUP BY doc_id").df()
    rows = got[got.held_out].merge(label, on="doc_id")
    good, bad = rows[rows.y == 1].score.to_numpy(), rows[rows.y == 0].score.to_numpy()
    auc = ((good[:, None] > bad[None]) + 0.5 * (good[:, None] == bad[None])).mean()
    bins = rows.assign(b=(rows.score * 10).astype(int).clip(0, 9)).groupby("b").agg(n=("y", "size"), p=("score", "mean"), y=("y", "mean"))
    ece = (bins.n * (bins.p - bins.y).abs()).sum() / len(rows)
    accuracy = ((rows.score >= 0.7) == (rows.y == 1)).mean()
    print(f"AUC {auc:.4f}, accuracy {accuracy:.4f}, ECE {ece:.4f} on {len(rows)} documents")
    assert auc > 0.97 and accuracy > 0.95 and ece < 0.05
