"""How much of a ball tree its bounds leave out, on vectors that lie in clusters."""

import numpy as np
import pytest

from freshet.llm.topk import LOW, BallTree


@pytest.mark.parametrize("clusters, rows, share", [(20, 1000, 0.1), (100, 80, 0.5)])
def test_leaves_of_clusters_that_are_asked(clusters, rows, share):
    """Clusters of many leaves are told apart well; leaves that hold parts of two clusters are wide, and left out less."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 2000, (clusters, 32))
    points = np.rint(np.repeat(centres, rows, axis=0) + rng.normal(0, 60, (clusters * rows, 32))).astype(np.int64)
    ids = np.arange(len(points))
    tree = BallTree.build(points, ids)
    asked = np.arange(0, len(points), 100)
    queries = points[asked]

    scores = queries @ points.T
    scores[np.arange(len(asked)), asked] = LOW
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -np.maximum(scores, LOW + 1)), axis=-1)[:, :10]
    best = np.take_along_axis(scores, order, 1)
    got_scores, got_ids = tree.search(queries, asked, np.full(len(asked), LOW), 10)
    assert (got_scores == best).all() and (got_ids == order).all()

    norms = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
    stay = np.mean([tree.bounds(queries.astype(np.float64), norms, leaf) >= best[:, -1] for leaf in np.flatnonzero(tree.child < 0)])
    assert stay < share
