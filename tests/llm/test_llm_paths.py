"""Paths through runs whose best single language is on no best path."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pressroom.llm import language_id


def test_two_halves_are_not_given_to_a_third_language():
    assert language_id.best_path(np.array([[10.0, -11.0, 0.0], [-11.0, 10.0, 0.0]]), 15.0).tolist() == [0, 1]
    rng = np.random.default_rng(3)
    for _ in range(300):
        scores = np.repeat(rng.normal(size=(3, 3)), 2, axis=0) * 10
        value = lambda p: sum(scores[i, x] for i, x in enumerate(p)) - 15 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        assert value(language_id.best_path(scores, 15.0)) == pytest.approx(max(map(value, itertools.product(range(3), repeat=6))))
