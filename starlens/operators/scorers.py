"""Scorers for ``score_reviews`` that need no model file. A scorer lives in a
module that Python workers can import by itself."""

from __future__ import annotations

import numpy as np


def length_scorer():
    """A stand-in model: three logits from the number of characters."""
    def score(texts):
        n = np.array([len(t) for t in texts])
        z = np.exp(np.stack([n % 7 / 4, n % 5 / 4, n % 3 / 2], axis=1))
        return z / z.sum(axis=1, keepdims=True)

    return score
