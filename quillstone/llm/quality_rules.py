"""Quality rules whose cutoffs come from labelled holdouts with exact binomial bounds.

Every rule is a share in hundredths (0 to 100) with a cutoff; a text fails when a share
is above its cutoff.  Per stratum (a language) the labelled texts are dealt into two
folds by a hash of their counts, so that copies of a text fall on one side.

The first fold only orders: it gives a path of joint cutoffs from lenient to strict, at
each step tightening the rule that catches most bad texts for the good ones it costs.
The second fold, the holdout, only tests, along that path: the null hypothesis of a step
is "the rules at this step reject more than ``alpha`` of good texts", its p-value the
exact binomial tail (the Clopper-Pearson bound).  Testing stops at the first step that is
not accepted (fixed-sequence testing, which needs no correction along a path, and as the
path is joint, none over rules); over strata the level ``delta`` is divided by their
number (Bonferroni).  So with probability 1 - ``delta``, in every stratum at once, no
more than ``alpha`` of good texts fail.  Of the accepted steps the most lenient one is
taken that rejects as many bad holdout texts as any of them: a stricter one would risk
good texts for nothing.

A stratum needs log(delta / strata) / log(1 - alpha) good holdout texts before a step can
be accepted, 144 with four strata at the defaults, about 216 good labels.  One with fewer
accepts none, and like one without labels it rejects nothing beyond the base rule.

Defined results.  Null text has no words.  Null language is a stratum of its own, apart
from the empty one.  An empty table gives an empty result; without labels nothing but the
base rule rejects.  A document labelled twice counts once, as good if any label says so.
A share equal to its cutoff passes.  Repeated rows get the same verdict each.  Texts of
any length are read whole.  Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.rows import map_rows
from quillstone.sources.workspace import materialise

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
RULES = ("symbol", "dup_line", "repeat", "upper", "shout")
#: Of so many parts of the labelled texts one orders the cutoffs; the others test them.
FOLDS = 3
#: The step of a path at which a text that no step rejects would be rejected.
NEVER = 1 << 20

MEASURES = pa.schema(
    [("doc_id", pa.int64()), ("stratum", pa.string())]
    + [(x, pa.int64()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shout")]
)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the list."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    # Pairs get dense numbers first, so that a pair and a word fit 63 bits at any length.
    pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
    _, window, count = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    twice = count[window] > 1
    covered = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        covered[shift : shift + len(twice)] |= twice
    return int(covered.sum())


def measure(doc_id, stratum, text) -> Iterator[tuple]:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    yield (
        doc_id,
        stratum,
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        sum(map(str.isupper, text)),
        text.count("!"),
    )


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """One row of counts per document."""
    return map_rows(docs, [id_col, stratum_col, text_col], measure, MEASURES)


def with_shares(counts: DataFrame) -> DataFrame:
    """Adds base_failed and each rule's share in hundredths, 0 to 100."""

    def share(part: str, whole: str):
        return F.least(F.lit(100), F.floor(100 * F.col(part) / F.greatest(F.col(whole), F.lit(1)))).cast("int")

    return counts.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "symbol": share("n_symbols", "word_chars"),
            "dup_line": share("n_dup_lines", "n_lines"),
            "repeat": share("n_repeat_words", "n_words"),
            "upper": share("n_upper", "word_chars"),
            "shout": share("n_shout", "n_words"),
        }
    )


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial: the exact p-value of "the rate is p or more"."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    log_term = np.concatenate([[0.0], np.cumsum(np.log(n - i[:-1]) - np.log(i[1:]))]) + i * math.log(p) + (n - i) * math.log1p(-p)
    top = log_term.max()
    return float(min(1.0, math.exp(top) * np.exp(log_term - top).sum()))


def cutoff_path(good: dict[str, np.ndarray], bad: dict[str, np.ndarray]) -> list[tuple[str, int]]:
    """Joint cutoffs from lenient to strict as successive (rule, new cutoff).

    ``good[rule][v]`` and ``bad[rule][v]`` count texts with share v.  A cutoff lies midway
    between a share that bad texts have and the next lower one that any text has.
    """
    steps: dict[str, list[tuple[float, int, int]]] = {}
    for rule in RULES:
        own, cost = [], 0
        for v in range(100, 0, -1):
            cost += int(good[rule][v])
            if bad[rule][v]:
                below = next((u for u in range(v - 1, -1, -1) if good[rule][u] or bad[rule][u]), 0)
                own.append((cost / int(bad[rule][v]), -int(bad[rule][v]), (below + v) // 2))
                cost = 0
        steps[rule] = own[::-1]
    path = []
    while any(steps.values()):
        rule = min((r for r in RULES if steps[r]), key=lambda r: steps[r][-1][:2])
        path.append((rule, steps[rule].pop()[2]))
    return path


def first_steps(path: list[tuple[str, int]]) -> dict[str, list[int]]:
    """Per rule, for each share, the first step of the path that rejects it."""
    found = {rule: np.full(101, NEVER) for rule in RULES}
    for step, (rule, cutoff) in enumerate(path):
        found[rule][cutoff + 1 :] = np.minimum(found[rule][cutoff + 1 :], step)
    return {rule: x.tolist() for rule, x in found.items()}


def accepted_step(step: np.ndarray, good: np.ndarray, bad: np.ndarray, alpha: float, level: float) -> int:
    """The accepted step that rejects most bad texts, the most lenient of equals; -1 if
    none is accepted or none rejects any.

    ``step``: steps at which texts are rejected, in order, with NEVER for the rest;
    ``good`` and ``bad`` count them.
    """
    n, rejected, caught, most, chosen = int(good.sum()), 0, 0, 0, -1
    for at, g, b in zip(step, good, bad, strict=True):
        rejected, caught = rejected + int(g), caught + int(b)
        if at == NEVER or n == 0 or binomial_tail(rejected, n, alpha) > level:
            break
        if caught > most:
            most, chosen = caught, int(at)
    return chosen


def paths(held: DataFrame) -> DataFrame:
    """Per stratum: its cutoffs' path (rules and cutoffs) and, per rule, the first step
    that rejects each share.

    The ordering fold is counted by (stratum, rule, share) in one shuffle of partial
    counts; each stratum's counts (505 at most) then decide.
    """
    each = held.filter("fold = 0").select("stratum", "quality", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("share")) for r in RULES])).alias("x"))
    counts = each.groupBy("stratum", "x.rule", "x.share").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        good, bad = ({r: np.bincount(rows["share"][rows["rule"] == r], weights=rows[x][rows["rule"] == r], minlength=101) for r in RULES} for x in ("good", "bad"))
        path = cutoff_path(good, bad)
        found = {"stratum": rows["stratum"].iloc[0], "rules": [r for r, _ in path], "cutoffs": [c for _, c in path]}
        return pd.DataFrame([found | {f"at_{r}": x for r, x in first_steps(path).items()}])

    schema = "stratum string, rules array<string>, cutoffs array<int>, " + ", ".join(f"at_{r} array<int>" for r in RULES)
    return counts.groupBy("stratum").applyInPandas(order, schema)


def with_step(rows: DataFrame, path: DataFrame) -> DataFrame:
    """Adds step: the first of the stratum's path that rejects the text."""
    found = rows.join(path.withColumnRenamed("stratum", "of"), F.expr("stratum <=> of"), "left").drop("of")
    return found.withColumn("step", F.least(*[F.coalesce(F.get(f"at_{r}", F.col(r)), F.lit(NEVER)) for r in RULES])).drop(*[f"at_{r}" for r in RULES])


def accepted(held: DataFrame, path: DataFrame, alpha: float, delta: float) -> DataFrame:
    """Per stratum with labels: n_good of the holdout, and the accepted step (-1 for none)."""
    counts = with_step(held.filter("fold > 0"), path).groupBy("stratum", "step").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
    counts = materialise(counts, "quality-holdout")
    level = delta / max(1, counts.select("stratum").distinct().count())

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("step")
        chosen = accepted_step(*(rows[x].to_numpy() for x in ("step", "good", "bad")), alpha, level)
        return pd.DataFrame([{"stratum": rows["stratum"].iloc[0], "n_good": int(rows["good"].sum()), "accepted": chosen}])

    return counts.groupBy("stratum").applyInPandas(decide, "stratum string, n_good long, accepted int")


def judge(docs: DataFrame, labels: DataFrame, alpha: float = 0.03, delta: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """One row per document: counts, shares, the step of its stratum's path that would
    reject it, the accepted step with its cutoffs (cut_*, null for none), base_failed, kept."""
    shares = with_shares(materialise(measures(docs, id_col, text_col, stratum_col), "quality-measures"))
    marked = labels.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality")).filter("quality IN (0, 1)")
    held = shares.filter(~F.col("base_failed")).join(marked, "doc_id").withColumn("fold", F.pmod(F.xxhash64(*MEASURES.names[1:]), F.lit(FOLDS)))
    held = materialise(held.select("stratum", "quality", "fold", *RULES), "quality-labelled")
    path = materialise(paths(held), "quality-paths")
    decided = materialise(accepted(held, path, alpha, delta), "quality-accepted")
    # A row per stratum; whether to broadcast them is left to their size at run time.
    judged = with_step(shares, path).join(decided.withColumnRenamed("stratum", "of"), F.expr("stratum <=> of"), "left").drop("of")
    judged = judged.withColumn("accepted", F.coalesce("accepted", F.lit(-1)))

    def cutoff(rule: str):
        own = F.filter(F.slice(F.arrays_zip("rules", "cutoffs"), 1, F.col("accepted") + 1), lambda s: s["rules"] == rule)
        return F.array_min(F.transform(own, lambda s: s["cutoffs"]))

    judged = judged.withColumns({f"cut_{rule}": cutoff(rule) for rule in RULES})
    return judged.drop("rules", "cutoffs").withColumn("kept", ~F.col("base_failed") & (F.col("step") > F.col("accepted")))
