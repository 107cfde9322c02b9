"""The field labels documents in which no base pattern matches."""

import numpy as np

from geopressure.llm import personal_data


def test_repeated_number_without_base_span():
    """Weights that take nine to fifteen digits for a phone number where like tokens agree."""
    node = np.zeros((personal_data.N_FEATURES, personal_data.LABELS))
    node[8, 3] = 3.0
    pair = np.zeros((personal_data.LABELS, personal_data.LABELS))
    weights = personal_data.Weights(node, pair, 3.0 * np.eye(personal_data.LABELS))
    text = "call 743-555-3824 today or 743-555-3824 later"
    assert personal_data.base_spans(text) == []
    assert personal_data.spans(text, weights) == [(5, 3, 17, False), (27, 3, 39, False)]
    assert personal_data.mask(text, personal_data.spans(text, weights)) == "call <phone> today or <phone> later"


def test_fitted_field_finds_an_address_outside_the_pattern(spark, sf_dir):
    weights = personal_data.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = "mail bob@localhost now, or bob@localhost"
    assert [s[1:] for s in personal_data.spans(text, weights)] == [(0, 18, False), (0, 40, False)]


def test_marginals_with_a_skip_edge_are_near_enumeration():
    """Three nodes, the first and the last alike: message passing on the loop against all label triples."""
    text = "743-555-3824 then 2.0 and 743-555-3824"
    found = personal_data.nodes(text, [])
    chain, skips = personal_data.edges(found)
    assert (chain, skips) == ([(0, 1), (1, 2)], [(0, 2)])
    rng = np.random.default_rng(7)
    n = personal_data.LABELS
    pair = rng.normal(0, 0.3, (n, n))
    weights = personal_data.Weights(rng.normal(0, 0.3, (personal_data.N_FEATURES, n)), (pair + pair.T) / 2, 0.8 * np.eye(n))
    local = np.array([node.features for node in found], float) @ weights.node
    want = np.zeros((3, n))
    for x in np.ndindex(n, n, n):
        worth = sum(local[i, k] for i, k in enumerate(x))
        worth += weights.chain[x[0], x[1]] + weights.chain[x[1], x[2]] + weights.skip[x[0], x[2]]
        for i, k in enumerate(x):
            want[i, k] += np.exp(worth)
    want /= want.sum(axis=1, keepdims=True)
    got = personal_data.marginals(found, weights)
    assert np.abs(got - want).max() < 0.03
    assert (got.argmax(axis=1) == want.argmax(axis=1)).all()
