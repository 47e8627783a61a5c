"""The class prior of few rows has no jump."""

import numpy as np

from momentlens.llm import quality_classifier as qc


def test_prior_of_few_rows():
    rng = np.random.default_rng(3)
    good = rng.normal(4, 1, (400, 3))
    mixed = np.concatenate([rng.normal(4, 1, (80, 3)), rng.normal(-4, 1, (320, 3))])
    rng.shuffle(mixed)
    priors = {n: qc.class_prior(good[:n], mixed[:n]) for n in (0, 1, 2, 5, 19, 20, 21, 100, 400)}
    assert priors[0] == priors[1] == 0.5
    # both sides of 20 rows
    assert abs(priors[19] - priors[20]) < 0.1 and abs(priors[20] - priors[21]) < 0.1
    for n, prior in priors.items():  # never farther from one half than the rows at hand allow
        assert abs(prior - 0.5) <= 0.45 * n / (n + qc.PRIOR_ROWS) + 1e-12
    assert abs(priors[400] - 0.2) < 0.08
