from __future__ import annotations

import numpy as np

from catalogspark.llm import topk
from tests.llm.test_models import products


class Shaken(topk._Index):
    def bounds(self, q, norm2, rings):
        exact = super().bounds(q, norm2, rings)
        return exact + 0.1 * np.random.default_rng().random(exact.shape) * (exact.max() - exact.min())


def test_annuli_stay_as_they_are(spark, monkeypatch):
    """Every annulus is visited once, though bounds and percentiles come out a
    little different each time they are worked out."""
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=6).round(2).tolist()) for i in range(400)] + [(50 * i, [0.5] * 6) for i in range(9)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    monkeypatch.setattr(topk, "_Index", Shaken)
    monkeypatch.setattr(topk, "FIRST", 20)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    assert sorted(map(tuple, topk.top_products(df).collect()), key=repr) == products(rows, 50, 5, 256)
