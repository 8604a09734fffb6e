"""Toxicity by a chain of linear classifiers.

Categories are columns of the label table, predicted in a stated order that ends with
toxicity; here ``quality``, which the labels also judge, comes before ``toxic``.  Each
model is a logistic regression over the selected terms and the probabilities of the
categories before it.  In training those probabilities are out-of-fold predictions, so a
model sees its predecessors as unsure as they will be on new texts; in scoring they come
from the models fitted to all training rows.  The fold of a text is a hash of it, so
copies are never on both sides, and each fold's terms are selected without its labels.

Terms are words and word starts of 4 to 6 letters.  Training uses a sample of
labelled documents of expected size ``sample_rows``, chosen by a hash of the identifier on
both sides before the join, so the join moves only the sample.  Terms are counted per
task and fold, summed in one shuffle and ranked; ``n_terms`` of them per fold reach the
driver, and of the sampled documents only their counts of those terms.  Scoring reads
every whole text, batch by batch.

Defined results.  Null text has no words; a text without words is not toxic and has
probability 0 in each category.  A document labelled twice has the greatest of its labels;
null labels are ignored, each category by itself.  Of rows that repeat an identifier one
text is used in training, the least; all are scored.  A null identifier is scored and
never trained on.  A probability equal to the threshold is not toxic; terms of equal rank
go by their letters.  Without both toxic and other labels nothing is rejected.  Texts of
any length are read whole.  An empty table gives an empty result.  Repeated rows get
equal results.  Only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from quillstone.llm.rows import BATCH, as_batch, map_rows, values
from quillstone.sources.workspace import materialise

WORD = re.compile(r"[^\W\d_]+")
STARTS = (4, 5, 6)
#: Label columns in the order of the chain.
CATEGORIES = ("quality", "toxic")
FOLDS = 5
#: Standard deviations by which toxic texts have a selected term more often.
LEAST_SCORE = 2.0
MEMO_WORDS = 100_000

#: Sums of terms that a counting task holds; Spark adds up what it gives out.
HELD_TERMS = 50_000
#: Of these, given out at once.
TERM_ROWS = 10_000

TERM = pa.schema([("term", pa.string()), ("fold", pa.int64()), ("n_toxic", pa.int64()), ("n", pa.int64())])


def terms_of(word: str) -> list[str]:
    return [f"w:{word}", *(f"s:{word[:n]}" for n in STARTS if len(word) >= n)]


@dataclass
class Chain:
    """Weights of the chain; ``weights[k]`` has n_terms + k + 1 entries, the last the intercept."""

    index: dict[str, int]
    weights: list[np.ndarray]
    threshold: float
    categories: tuple[str, ...] = CATEGORIES
    memo: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __getstate__(self):
        return {**self.__dict__, "memo": {}}

    def hits(self, text: str) -> tuple[list[int], int]:
        """The selected terms of each word, one after another, and the number of words."""
        found, memo = [], self.memo
        words = WORD.findall(text.lower())
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for word in words:
            own = memo.get(word)
            if own is None:
                own = memo[word] = tuple(self.index[t] for t in terms_of(word) if t in self.index)
            if own:
                found.extend(own)
        return found, len(words)

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """A row per text, a column per category."""
        out = np.zeros((len(texts), len(self.categories)))
        if not self.weights or not texts:
            return out
        found = [self.hits(t) for t in texts]
        n = max(1, len(self.index))
        row = np.repeat(np.arange(len(texts)), [len(h) for h, _ in found])
        cell, count = np.unique(row * n + np.fromiter((t for h, _ in found for t in h), np.int64, len(row)), return_counts=True)
        size = np.log1p(count)
        for k, w in enumerate(self.weights):
            z = np.bincount(cell // n, weights=size * w[cell % n], minlength=len(texts)) + out[:, :k] @ w[len(self.index) : -1] + w[-1]
            out[:, k] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        out[np.array([words == 0 for _, words in found])] = 0.0
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 150) -> np.ndarray:
    """L2-regularised logistic regression by accelerated gradient steps; intercept last, free."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    bound = np.ones(x.shape[1]) / np.sqrt(x.shape[1])
    for _ in range(20):  # largest curvature by power iteration
        bound = x.T @ (x @ bound)
        size = np.linalg.norm(bound)
        bound /= size
    rate = 1 / (0.25 * size * 1.05 + penalty)
    w = v = np.zeros(x.shape[1])
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        new = v - rate * (x.T @ (p - y) + ridge * v)
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def fit_chain(x: np.ndarray, labels: list[np.ndarray], fold: np.ndarray, selected: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Weights per category over all columns of ``x``, and the last one's out-of-fold probabilities.

    ``labels``: per category 0, 1 or NaN.  ``selected``: columns chosen without fold k for
    each k, and last those chosen on all rows.
    """
    weights, earlier, out = [], np.zeros((len(x), 0)), np.zeros(len(x))
    for y in labels:
        known, out = ~np.isnan(y), np.zeros(len(x))
        for k in range(FOLDS):
            held, own = fold == k, np.hstack([x[:, selected[k]], earlier])
            train = known & ~held
            if held.any() and train.any():
                out[held] = predict(own[held], fit_logistic(own[train], y[train]))
        w, last = np.zeros(x.shape[1] + earlier.shape[1] + 1), selected[-1]
        if known.any():
            short = fit_logistic(np.hstack([x[:, last], earlier])[known], y[known])
            w[last], w[x.shape[1] :] = short[: len(last)], short[len(last) :]
        weights.append(w)
        earlier = np.hstack([earlier, out[:, None]])
    return weights, out


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the fewest errors on out-of-fold probabilities; the middle of its gap."""
    order = np.argsort(p, kind="stable")
    p, y = p[order], y[order]
    # Errors when the first i rows are taken as clean.
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    ends = np.concatenate([[0.0], p, [1.0]])
    usable = ends[1:] > ends[:-1]
    i = int(np.argmin(np.where(usable, errors, len(p) + 1)))
    return float((ends[i] + ends[i + 1]) / 2)


def sampled(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], sample_rows: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, fold and the categories' labels of the sample, a row per document,
    written to the shared folder."""
    marks = labels.filter(F.col(categories[-1]).isNotNull() & F.col(id_col).isNotNull())
    n = marks.agg(F.count_distinct(id_col).alias("n")).first()["n"]
    share = int(min(1.0, sample_rows / max(1, n)) * 1_000_000)

    def chosen(df: DataFrame) -> DataFrame:
        return df.filter(F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(1_000_000)) < share)

    marks = chosen(marks).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(*[F.max(c).cast("double").alias(f"y{i}") for i, c in enumerate(categories)])
    texts = chosen(docs).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(F.coalesce(text_col, F.lit(""))).alias("text"))
    return materialise(texts.join(marks, "doc_id").withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS))), "toxicity-sample")


def count_terms(sample: DataFrame, label: str) -> DataFrame:
    """Texts per term and fold, toxic ones and all; summed within a task before the shuffle.

    A task holds ``HELD_TERMS`` sums and one text's terms at most, however many texts its batch has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, bad = Counter(), Counter()
        for text, fold, toxic in values(batches):
            own = {(t, fold) for w in set(WORD.findall(text.lower())) for t in terms_of(w)}
            n.update(own)
            if toxic:
                bad.update(own)
            if len(n) >= HELD_TERMS:
                yield from summed(n, bad)
                n, bad = Counter(), Counter()
        yield from summed(n, bad)

    def summed(n: Counter, bad: Counter) -> Iterator[pa.RecordBatch]:
        for part in batched(n.items(), TERM_ROWS):
            yield as_batch([(*k, bad[k], c) for k, c in part], TERM)

    return sample.select("text", "fold", label).mapInArrow(run, from_arrow_schema(TERM)).groupBy("term", "fold").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n").alias("n"))


def select_terms(counts: DataFrame, rows: dict[int, int], bad: dict[int, int], n_terms: int) -> list[list[str]]:
    """The ``n_terms`` terms of strongest association with toxicity without fold k, for each k, and on all rows.

    ``rows`` and ``bad``: texts and toxic texts per fold.
    """
    found = []
    for k in [*range(FOLDS), None]:
        n_rows, n_bad = (sum(v for f, v in x.items() if f != k) for x in (rows, bad))
        if not 0 < n_bad < n_rows:
            found.append([])
            continue
        # Signed chi statistic of "text is toxic" and "text has the term"; only terms that toxic
        # texts have more often, so that a text of unknown words is as clean as any.
        share = n_bad / n_rows
        spread = F.sqrt(F.col("n") * share * (1 - share) * (1 - F.col("n") / n_rows) + F.lit(1e-9))
        own = counts if k is None else counts.filter(F.col("fold") != k)
        sums = own.groupBy("term").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n").alias("n")).filter("n >= 4")
        ranked = sums.withColumn("score", (F.col("n_toxic") - F.col("n") * share) / spread)
        found.append([r["term"] for r in ranked.filter(F.col("score") > LEAST_SCORE).orderBy(F.desc("score"), "term").limit(n_terms).collect()])
    return found


def fit(
    docs: DataFrame, labels: DataFrame, sample_rows: int = 10_000, n_terms: int = 400, categories: tuple[str, ...] = CATEGORIES, id_col: str = "doc_id", text_col: str = "text"
) -> Chain:
    """The chain, fitted on the driver to ``sample_rows`` (expected) by at most ``n_terms``
    counts per fold."""
    sample = sampled(docs, labels, categories, sample_rows, id_col, text_col)
    last = f"y{len(categories) - 1}"
    totals = sample.groupBy("fold").agg(F.count("*").alias("n"), F.sum(last).alias("bad")).collect()
    rows, bad = ({r["fold"]: r[x] or 0 for r in totals} for x in ("n", "bad"))
    if not 0 < sum(bad.values()) < sum(rows.values()):
        return Chain({}, [], 1.0, categories)
    terms = select_terms(materialise(count_terms(sample, last), "toxicity-terms"), rows, bad, n_terms)
    index = {t: i for i, t in enumerate(dict.fromkeys(t for own in terms for t in own))}
    counter = Chain(index, [], 1.0, categories)
    schema = pa.schema([("fold", pa.int64()), *((f"y{i}", pa.float64()) for i in range(len(categories))), ("terms", pa.list_(pa.int32()))])

    def row(fold, *values) -> Iterator[tuple]:
        yield fold, *values[:-1], counter.hits(values[-1])[0]

    found = map_rows(sample.sort("doc_id"), ["fold", *schema.names[1:-1], "text"], row, schema).collect()
    x = np.zeros((len(found), len(index)))
    for i, r in enumerate(found):
        np.add.at(x[i], r["terms"], 1.0)
    y = [np.array([np.nan if r[f"y{i}"] is None else r[f"y{i}"] for r in found]) for i in range(len(categories))]
    weights, out = fit_chain(np.log1p(x), y, np.array([r["fold"] for r in found]), [np.array([index[t] for t in own], np.int64) for own in terms])
    return Chain(index, weights, best_threshold(out, y[-1]), categories)


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, p_<category> for each, toxic."""
    schema = pa.schema([("doc_id", pa.int64()), *((f"p_{c}", pa.float64()) for c in chain.categories), ("toxic", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                p = chain.probabilities([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, p.T), pa.array(p[:, -1] > chain.threshold)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, from_arrow_schema(schema))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the toxic ones; all columns stay, and no row is moved."""
    chain = fit(docs, labels, id_col=id_col, text_col=text_col)

    @F.arrow_udf("boolean")
    def toxic(texts: pa.Array) -> pa.Array:
        parts = [chain.probabilities([t or "" for t in texts.slice(at, BATCH).to_pylist()])[:, -1] for at in range(0, len(texts), BATCH)]
        return pa.array(np.concatenate(parts) > chain.threshold if parts else [], pa.bool_())

    return docs.filter(~toxic(F.col(text_col)))
