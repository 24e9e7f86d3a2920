"""Bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_by_label(labelled: DataFrame, rows: int, key: str = "_id", label: str = "_label") -> tuple[DataFrame, dict[int, float]]:
    """(sample, share of each label among all): at most ``rows`` distinct pairs of key and label
    (0 or 1), half of them of each label, by a hash of the key. A label with few rows keeps them
    all, however many the other one has."""
    marked = labelled.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).distinct()
    sizes = {r[label]: r["n"] for r in marked.groupBy(label).agg(F.count("*").alias("n")).collect()}
    total = max(1, sum(sizes.values()))
    of = [marked.filter(F.col(label) == y).orderBy(F.xxhash64(key), key).limit(max(1, rows // 2)) for y in (0, 1)]
    return of[0].unionByName(of[1]), {y: sizes.get(y, 0) / total for y in (0, 1)}


def label_weights(labels: np.ndarray, share: dict[int, float]) -> np.ndarray:
    """Weight of each sampled row, so that the labels weigh as they do among all rows."""
    counts = np.bincount(labels.astype(int), minlength=2)
    each = np.array([share[y] / max(1, counts[y]) for y in (0, 1)])
    return each[labels.astype(int)] * max(1, len(labels))
