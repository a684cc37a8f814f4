"""The bound on labelled rows must not move the scores' prior."""

import numpy as np

from tarifa.llm import toxicity


def test_bias_keeps_the_prior_where_the_bound_is_reached(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(1200):
        y = int(i % 10 == 0)
        said = [f"w{x}" for x in rng.integers(0, 40, 8)] + (["idiot"] if rng.random() < (0.7 if y else 0.1) else [])
        rows.append((i, " ".join(said).replace("0", "a").replace("1", "b").replace("2", "c").replace("3", "d"), y))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = df.select("doc_id", "text"), df.select("doc_id", "toxic")
    whole = toxicity.fit(docs, labels)
    monkeypatch.setattr(toxicity, "MAX_TRAIN_PER_CLASS", 120)
    bounded = toxicity.fit(docs, labels)
    mean = lambda m: float(np.mean([m.score(t) for _, t, _ in rows]))
    assert abs(mean(whole) - 0.1) < 0.03 and abs(mean(bounded) - mean(whole)) < 0.05
