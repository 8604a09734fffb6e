"""Beats wait as spans of time, so that a worker's state does not grow with its beats."""

import numpy as np

from quillstone.streaming import heartbeat


def test_beats_in_any_order_merge_to_spans():
    rng = np.random.default_rng(4)
    beats = np.concatenate([rng.integers(0, 10_000, 5000), rng.integers(20_000, 30_000, 5000), [50_000, 50_100, 50_201]])
    spans = np.empty((0, 2), np.int64)
    for some in np.array_split(rng.permutation(beats), 7):
        spans = heartbeat.merged(np.concatenate([spans, np.column_stack([some, some])]), 100)
    want, times = [], sorted(beats.tolist())
    for t in times:
        if want and t - want[-1][1] <= 100:
            want[-1][1] = t
        else:
            want.append([t, t])
    assert spans.tolist() == want and len(want) == 4
