from __future__ import annotations

import numpy as np

from reviewlytics.llm import toxicity


def sentences():
    """Toxic ones name a group of one kind far more often than clean ones."""
    rng = np.random.default_rng(1)
    plain = "river stone window garden letter music winter bread street friend".split()
    bad = "horrid vermin filthy".split()
    rows = []
    for k in range(600):
        words = rng.choice(plain, 8).tolist()
        toxic = k % 3 == 0
        if toxic:
            words.insert(3, str(rng.choice(bad)))
        if rng.random() < (0.8 if toxic else 0.05):
            words.insert(5, "immigrants")
        rows.append((k, " ".join(words) + ".", int(toxic)))
    return rows


def scores(spark, model, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r["score"] for r in toxicity.score(docs, model).orderBy("doc_id").collect()]


def test_counterfactuals_lower_scores_of_neutral_mentions(spark):
    df = spark.createDataFrame(sentences(), "doc_id bigint, text string, label int")
    neutral, rude = "the immigrants bring bread to the garden.", "filthy vermin in the street."
    with_, without = toxicity.fit(df), toxicity.fit(df, strength=0.0)
    a, b = scores(spark, with_, [neutral, rude]), scores(spark, without, [neutral, rude])
    assert a[0] < b[0] / 2 < 0.5
    assert min(a[1], b[1]) > 0.5
    other = scores(spark, with_, [toxicity.exchange(neutral)])[0]
    assert abs(other - a[0]) < abs(scores(spark, without, [toxicity.exchange(neutral)])[0] - b[0])


def test_exchange():
    assert toxicity.exchange("Old women and MEN.") == "young men and girls."
    assert toxicity.exchange("nothing here") is None


def test_edges(spark):
    df = spark.createDataFrame(sentences(), "doc_id bigint, text string, label int")
    model = toxicity.fit(df)
    rows = [(1, None), (2, ""), (3, "filthy " * 200_000), (3, "filthy"), (None, "filthy vermin")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "5 AS score", "6 AS label")
    got = toxicity.score(docs, model).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["score"])
    assert by[1] == by[2] and by[3][0] == by[3][1] > 0.5
    assert toxicity.score(docs.where("false"), model).count() == 0
    assert toxicity.fit(df.where("false")).bias == 0
    assert toxicity.fit(df.where("label = 1")).bias > 0


def test_held_out_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = toxicity.classify(docs, labels)
    assert out.count() == docs.count()
    known = out.join(labels, "doc_id").where("held_out").toPandas()
    pos, neg = known[known.toxic == 1].score, known[known.toxic == 0].score
    auc = np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos])
    assert auc > 0.85 and ((known.score >= 0.5) == (known.toxic == 1)).mean() > 0.9
