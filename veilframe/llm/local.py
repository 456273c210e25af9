"""Small array helpers that run inside Python workers."""

from __future__ import annotations

import numpy as np


def star_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n items and links a[i]-b[i]: the smallest item that each one reaches."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new
