from __future__ import annotations

import numpy as np

from shotmetrics.operators import boosting


def _trees(rng, n, depth, n_features, n_bins):
    out = []
    for _ in range(n):
        tree = boosting.Tree(depth)

        def build(node, level, tree=tree):
            if level == depth or rng.random() < 0.2:
                tree.value[node] = rng.normal()
                return
            tree.feature[node], tree.threshold[node] = rng.integers(0, n_features), rng.integers(0, n_bins)
            build(2 * node + 1, level + 1)
            build(2 * node + 2, level + 1)

        build(0, 0)
        out.append(tree)
    return out


def test_scores_equal_the_walk_of_every_row_and_equal_bins_are_walked_once(monkeypatch):
    rng = np.random.default_rng(3)
    trees = _trees(rng, 12, 4, 3, 4)
    values = rng.integers(0, 5, (5000, 3)).astype(float)
    values[::97, 1] = np.nan
    for edges in ([[1.0, 2.0, 3.0, 4.0]] * 3, [list(np.arange(1 << 21) / 1000.0)] * 3):  # the second has too many combinations for a long
        bins = boosting.binned(values, edges)
        margin = np.full(len(values), 0.3)
        for t in trees:
            margin += t.value[t.nodes(bins, 4)]
        walked = []
        plain = boosting.margins
        monkeypatch.setattr(boosting, "margins", lambda b, *rest: walked.append(len(b)) or plain(b, *rest))
        score = boosting.Scorer(edges, trees, 4, 0.3)
        got = np.concatenate([score(values[:2000]), score(values[2000:])])
        monkeypatch.undo()
        assert (got == 1.0 / (1.0 + np.exp(-margin))).all()
        if score.steps is not None:
            first = got
            assert sum(walked) == len(np.unique(bins, axis=0)) < len(values)
    monkeypatch.setattr(boosting, "KEPT_SCORES", 3)
    score = boosting.Scorer([[1.0, 2.0, 3.0, 4.0]] * 3, trees, 4, 0.3)
    again = np.concatenate([score(values[:2000]), score(values[2000:])])
    assert len(score.codes) <= 3 and np.array_equal(again, first)
