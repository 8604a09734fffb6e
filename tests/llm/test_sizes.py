"""What a task holds does not grow with the table."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from quillstone.llm import pivot_index, rows, toxicity


class Task:
    """Stands for a DataFrame; keeps the function that each task runs over its batches."""

    def __init__(self, result=None):
        self.result = result

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self.result


def traced(batches):
    """The rows of the largest result batch, and the most memory held meanwhile."""
    tracemalloc.start()
    most = 0
    for batch in batches:
        most = max(most, batch.num_rows)
        del batch
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most, peak


def test_a_task_holds_a_bounded_number_of_term_sums(spark, monkeypatch):
    task = Task(spark.createDataFrame([], "term string, fold long, n_toxic long, n long"))
    toxicity.count_terms(task, "y1")
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    rng = np.random.default_rng(3)
    texts = [" ".join(map("".join, rng.choice(letters, (60, 9)))) for _ in range(3000)]
    batch = pa.record_batch({"text": texts, "fold": [i % 5 for i in range(3000)], "y1": [float(i % 3 == 0) for i in range(3000)]})
    most, peak = traced(task.run(iter([batch])))
    assert most <= 10_000 and peak < 60e6  # all texts have up to 720,000 sums

    monkeypatch.setattr(toxicity, "HELD_TERMS", 500)
    n, bad = Counter(), Counter()
    for out in task.run(iter([batch.slice(0, 400), batch.slice(400, 0)])):
        for r in out.to_pylist():
            n[r["term"], r["fold"]] += r["n"]
            bad[r["term"], r["fold"]] += r["n_toxic"]
    own = [({(t, i % 5) for w in texts[i].split() for t in toxicity.terms_of(w)}, i % 3 == 0) for i in range(400)]
    assert n == Counter(t for terms, _ in own for t in terms)
    assert +bad == Counter(t for terms, toxic in own if toxic for t in terms)


def test_rows_of_a_batch_become_objects_in_slices():
    task, out = Task(), pa.schema([("n", pa.int64())])
    rows.map_rows(task, ["text"], lambda text: [(len(text),)], out)
    batch = pa.record_batch({"text": ["x" * 20_000] * 4000})
    most, peak = traced(task.run(iter([batch])))
    assert most <= 1024 and peak < 20e6  # all texts are 80 MB
    assert sum(sum(b.column(0).to_pylist()) for b in task.run(iter([batch]))) == 80_000_000


def test_nearest_pivots_hold_slices_not_batch_times_pivots():
    rng = np.random.default_rng(1)
    x, pivots = (pivot_index.unit(rng.normal(size=(n, 16)).tolist()) for n in (4000, 8000))
    tracemalloc.start()
    order, best = pivot_index.nearest_pivots(x, pivots)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6  # 4,000 x 8,000 cosines alone are 256 MB
    s = x[:200] @ pivots.T
    assert (order[:200] == np.argsort(-s, axis=1, kind="stable")[:, : pivot_index.NEAREST]).all()
    assert np.allclose(best[:200], s.max(axis=1))


def test_shared_pivots_are_counted_in_slices(monkeypatch):
    rng = np.random.default_rng(2)
    lists = [sorted(rng.choice(60, 8, replace=False).tolist()) for _ in range(40)]
    l, r = np.arange(25), np.arange(25, 40)
    for held in (1, 200, 1 << 21):
        monkeypatch.setattr(pivot_index, "HELD", held)
        for at in (0, 30, 59):
            shared, earlier = pivot_index.shared_pivots(lists, l, r, at)
            assert shared.tolist() == [[len(set(lists[i]) & set(lists[j])) for j in r] for i in l]
            assert earlier.tolist() == [[len({p for p in set(lists[i]) & set(lists[j]) if p < at}) for j in r] for i in l]
