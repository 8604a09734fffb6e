"""Whether a cited chunk supports a claim, by its text.

A claim is a sentence of an answer.  A chunk supports it where one window, at most twice as long as the claim,
holds terms of at least ``SHARE`` of the claim's weight, all its numbers and negations, and no negation
of its own up to the last of those terms: "sixty days" is no support for "thirty days", nor "may not" for
"may".  Weights are inverse document frequencies over the chunks.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.sources.workspace import materialise

#: A sentence ends at a mark that white space or nothing follows.
SENTENCE = r"[^.!?\n]+(?:[.!?]+[^ \n.!?][^.!?\n]*)*"
TERM = r"[\p{L}\p{N}]+"
#: Words that turn a statement round, in the languages of the texts.
NEGATIONS = ("not", "no", "never", "without", "nicht", "kein", "keine", "ne", "pas", "jamais", "nunca", "sin")
SHARE = 0.8
#: Claims judged together by one chunk, about.
TOGETHER = 4096
DIGIT = re.compile("[0-9]")

SUPPORTED, UNSUPPORTED, INSUFFICIENT = "supported", "unsupported", "INSUFFICIENT_EVIDENCE"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def sentences(text: Column) -> Column:
    """The sentences that have a term."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s: F.trim(s)), lambda s: s.rlike(TERM))


def split_claims(answers: DataFrame) -> DataFrame:
    """One row per sentence of answers (text and any other columns): claim_no, claim for text."""
    return answers.select(*[c for c in answers.columns if c != "text"], F.posexplode(sentences(F.col("text"))).alias("claim_no", "claim"))


def rarity(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """wanted (term and any others) with weight; the chunks' terms are counted before they meet it."""
    n = chunks.count()
    counted = chunks.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    df = F.coalesce("df", F.lit(0))
    return wanted.join(counted, "term", "left").withColumn("weight", F.log(1 + (F.lit(n) - df + 0.5) / (df + 0.5))).drop("df")


def judge_claims(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """id, coverage (6 decimals), verdict of claims (id, claim, chunk) by chunks (chunk, text).

    A claim has a row for each chunk it cites; the best one counts.  Where none of them is there, the
    verdict is INSUFFICIENT_EVIDENCE.  Claims meet the chunk they cite and the weights of their terms in parts of
    about ``TOGETHER`` claims, and a hit never leaves its part.
    """
    # Few chunks are cited by very many claims; they are brought to each part of these.
    hot = claims.groupBy("chunk").agg(F.count("*").alias("n")).filter((F.col("n") > TOGETHER) & F.col("chunk").isNotNull())
    hot = F.broadcast(hot.select("chunk", F.ceil(F.col("n") / TOGETHER).alias("parts")))
    part = F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0).cast("long"))
    own = tokens(F.col("claim"))
    dealt = claims.join(hot, "chunk", "left").select("chunk", part.alias("part"), "id", F.size(own).alias("n"), F.array_distinct(own).alias("terms"))
    wanted = dealt.select("chunk", "part", F.explode("terms").alias("term")).distinct()
    weights = rarity(wanted, chunks).select("chunk", "part", "term", "weight", F.lit(None).cast("string").alias("words"))
    cited = chunks_of(chunks, claims).join(hot, "chunk", "left")
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    words = cited.select("chunk", parts, F.lit(None).cast("string").alias("term"), F.lit(None).cast("double").alias("weight"), F.array_join(F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")), " ").alias("words"))
    asked = dealt.select("chunk", "part", "id", "n", F.array_join("terms", " ").alias("terms"))
    schema = f"id {claims.schema['id'].dataType.simpleString()}, there boolean, covered double, fitting double"
    judged = asked.groupBy("chunk", "part").cogroup(words.union(weights.select(*words.columns)).groupBy("chunk", "part")).applyInArrow(judge_part, schema)
    best = judged.groupBy("id").agg(F.bool_or("there").alias("there"), F.round(F.coalesce(F.max("covered"), F.lit(0.0)), 6).alias("coverage"), F.round(F.max("fitting"), 6).alias("fitting"))
    verdict = F.when(~F.col("there"), INSUFFICIENT).when(F.coalesce(F.col("fitting") >= SHARE, F.lit(False)), SUPPORTED).otherwise(UNSUPPORTED)
    return best.select("id", "coverage", verdict.alias("verdict"))


def chunks_of(chunks: DataFrame, citing: DataFrame) -> DataFrame:
    """The chunks that are cited.  Their keys are written first: Spark knows how few they are and does not shuffle all texts for them."""
    keys = materialise(citing.select(F.col("chunk").alias("cited")).filter("cited IS NOT NULL").distinct(), "cited-chunks")
    return chunks.join(keys, F.col("chunk") == F.col("cited"), "left_semi")


def judge_part(claims: pa.Table, known: pa.Table) -> pa.Table:
    """id, whether the chunk is there, covered share of the best window and of the best that fits, of claims on one chunk.

    ``known`` has the chunk's words and the weights of the claims' terms.
    """
    weight, texts = {}, []
    for term, w, words in zip(*(known.column(c).to_pylist() for c in ("term", "weight", "words")), strict=True):
        if words is None:
            weight[term] = w
        else:
            texts.append(words.split(" "))
    places = []
    for words in texts:
        at = defaultdict(list)
        for i, w in enumerate(words):
            if w in weight or w in NEGATIONS:
                at[w].append(i)
        places.append({w: np.array(p, np.int64) for w, p in at.items()})
    covered, fitting = [], []
    for n, terms in zip(claims.column("n").to_pylist(), claims.column("terms").to_pylist(), strict=True):
        found = [f for at in places if (f := best_window(terms.split(" "), 2 * n, weight, at))] if terms else []
        covered.append(max((f[0] for f in found), default=None))
        fitting.append(max((f[1] for f in found if f[1] is not None), default=None))
    there = pa.array([bool(texts)] * len(claims), pa.bool_())
    return pa.table({"id": claims.column("id"), "there": there, "covered": pa.array(covered, pa.float64()), "fitting": pa.array(fitting, pa.float64())})


def best_window(terms: list[str], width: int, weight: dict[str, float], at: dict[str, np.ndarray]) -> tuple[float, float | None] | None:
    """The greatest covered share of windows that start at a hit, and of those that fit; ``at`` has the places of words."""
    hit = [t for t in terms if t in at]
    if not hit:
        return None
    starts = np.sort(np.concatenate([at[t] for t in hit]))
    sums, musts = np.zeros(len(starts)), np.zeros(len(starts), np.int64)
    for t in hit:
        # Of each window, whether the term's next place is in it.
        next_at = np.append(at[t], np.iinfo(np.int64).max)[np.searchsorted(at[t], starts)]
        inside = next_at < starts + width
        sums += np.where(inside, weight[t], 0.0)
        if is_must(t):
            musts += inside
    share = sums / sum(weight[t] for t in terms)
    fits = musts == sum(map(is_must, terms))
    if fits.any() and not any(t in NEGATIONS for t in terms):
        turns = [at[t] for t in NEGATIONS if t in at]
        if turns:
            turned = np.sort(np.concatenate(turns))
            last = starts[np.searchsorted(starts, starts + width) - 1]
            fits &= np.searchsorted(turned, starts) == np.searchsorted(turned, last)
    return float(share.max()), float(share[fits].max()) if fits.any() else None


def is_must(term: str) -> bool:
    """Numbers and negations have to be there."""
    return term in NEGATIONS or DIGIT.search(term) is not None


def grounded(judged: DataFrame, answer: list[str]) -> DataFrame:
    """Per answer: n_claims, groundedness (share of supported claims), verdict.

    An answer with a claim that nothing supports is not given: INSUFFICIENT_EVIDENCE.
    """
    ok = F.col("verdict") == SUPPORTED
    return judged.groupBy(*answer).agg(
        F.count("*").alias("n_claims"), F.round(F.avg(ok.cast("int")), 6).alias("groundedness"), F.when(F.bool_and(ok), "answered").otherwise(INSUFFICIENT).alias("verdict")
    )
