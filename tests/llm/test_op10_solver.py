"""Rates of the mixing operator beside a plain solver of the same least squares."""

import numpy as np
import pytest

from cairn.llm import op10_mixing


def plain_rates(n, p, shares, total, ridge, least):
    """Coordinate descent: every document's best rate with all others held, until nothing moves."""
    whole = n.sum()
    share = n / whole
    b = np.linalg.inv((share[:, None] * p).T @ p + ridge * np.eye(p.shape[1]))
    w = np.full(len(n), max(1.0, least))
    r = (share * w) @ p - total * np.array(shares) / whole
    for _ in range(3000):
        most = 0.0
        for i in np.flatnonzero(share):
            bp = b @ p[i]
            slope, bend = bp @ r + ridge * (w[i] - 1), share[i] * (p[i] @ bp) + ridge
            new = max(least, w[i] - slope / bend)
            r += share[i] * (new - w[i]) * p[i]
            most, w[i] = max(most, abs(new - w[i])), new
        if most < 1e-9:
            break
    return w


def objective(w, n, p, shares, ridge):
    share = n / n.sum()
    b = np.linalg.inv((share[:, None] * p).T @ p + ridge * np.eye(p.shape[1]))
    r = (share * w) @ p - np.array(shares)
    return (r @ b @ r + ridge * (share * (w - 1) ** 2).sum()) / 2


@pytest.mark.parametrize("goal,least", [({"en": 0.5, "de": 0.3, "fr": 0.2}, 0.0), ({"en": 0.05, "de": 0.05, "fr": 0.9}, 0.0),
                                        ({"en": 0.2, "de": 0.3, "fr": 0.5}, 0.5)])
def test_rates_equal_the_plain_solver(spark, documents, goal, least):
    parts = {"en": "the cat of the hill, and ", "de": "der Hund und die Maus ", "fr": "le chat que les gens "}
    names = ["en", "de", "fr"]
    rows = [(i, parts[names[i % 3]] * (3 + i % 5) + (parts[names[(i + 1) % 3]] * (i % 4))) for i in range(120)]
    labelled = spark.createDataFrame([(i, names[i % 3]) for i in range(0, 120, 2)], "doc_id long, domain string")
    got = sorted(op10_mixing.mix(documents(rows), labelled, goal, least_rate=least).collect(), key=lambda r: r.doc_id)
    n = np.array([r.n_tokens for r in got], float)
    p = np.array([r.posterior for r in got])
    order = sorted(goal)
    want = plain_rates(n, p, [goal[d] for d in order], n.sum(), 0.01, least)
    rates = np.array([r.rate for r in got])
    shares = [goal[d] for d in order]
    assert rates.min() >= least
    if want.min() > least + 1e-3 or least == 0.0 and want.min() > 0:
        assert np.abs(rates - want).max() < 1e-4
    # where rates lie at their least value the operator's 24 steps end near the optimum, not at it
    assert objective(rates, n, p, shares, 0.01) <= 1.02 * objective(want, n, p, shares, 0.01)
    assert np.abs((n * (rates - want)) @ p / n.sum()).max() < 0.005
