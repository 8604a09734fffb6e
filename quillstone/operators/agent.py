"""Rounds of answering: route, retrieve, rerank, validate, and again for what stays open.

All questions run together.  The state is a table with a row per question; a round works on the
frontier, the questions that still lack citations, and no other.  A tool declares the permission it
needs; a question whose role lacks it never runs.  The tenant comes from the state, and a
tool gets rows of that tenant only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators import retrieval
from quillstone.operators.tenancy import allowed
from quillstone.sources.workspace import materialise

# Fixed limits of a run.
MAX_RETRIES = 2
MAX_ITERATIONS = 8
#: Candidates that a round looks at, and of how many terms of the question a citation holds.
PAGE = 6
SHARE = 0.8

#: Intents by the first word that tells one; the last stands for all other questions.
INTENTS = (("compare", r"^\s*(compare|contrast)\b"), ("risk", r"\b(risk|liability|penalty)\b"), ("summarize", r"^\s*(summari[sz]e|outline)\b"), ("extract", r"^\s*(extract|list)\b"), ("multi_document", r"\b(all|every|across) (documents|contracts)\b"), ("qa", r""))

#: Retrieves (question, id, score) for questions (id, text, tenant) from chunks (id, tenant, text).
Tool = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Registered:
    """A tool with the permission it needs and the citations that an answer by it needs."""

    permission: str
    citations: int
    run: Tool


def intent_of(question: Column) -> Column:
    found = F.lit(INTENTS[-1][0])
    for name, pattern in reversed(INTENTS[:-1]):
        found = F.when(F.lower(question).rlike(pattern), name).otherwise(found)
    return found


def search(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of the question's tenant by BM25."""
    scored = retrieval.bm25(chunks.select("id", "text"), questions.select("id", "text"))
    return in_tenant(scored, questions, chunks)


def in_tenant(scored: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    own = scored.join(questions.select(F.col("id").alias("query"), F.col("tenant").alias("asker")), "query").join(chunks.select("id", "tenant"), "id")
    return own.filter("asker = tenant").select(F.col("query").alias("question"), "id", "score")


def search_where(condition: Callable[[Column], Column]) -> Tool:
    """``search`` over the chunks whose text meets a condition."""
    return lambda questions, chunks: search(questions, chunks.filter(condition(F.col("text"))))


class ToolRegistry:
    """Tools by intent."""

    def __init__(self, spark, tools: dict[str, Registered]):
        self.spark, self.tools = spark, tools

    def routed(self, questions: DataFrame) -> DataFrame:
        """questions (id, text, tenant, role) with intent, needed (citations) and permitted."""
        rows = [(intent, t.permission, t.citations) for intent, t in self.tools.items()]
        known = self.spark.createDataFrame(rows, "intent string, permission string, needed int")
        rights = allowed(self.spark).withColumn("permitted", F.lit(True))
        return questions.withColumn("intent", intent_of(F.col("text"))).join(F.broadcast(known), "intent").join(F.broadcast(rights), ["role", "permission"], "left").withColumn("permitted", F.coalesce("permitted", F.lit(False)))

    def candidates(self, routed: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
        """question, id, place: the first ``n`` of every permitted question by its intent's tool.

        Intents that share a tool's function are asked together: one search reads the chunks for all of them.
        """
        found, intents = None, {}
        for intent, tool in self.tools.items():
            intents.setdefault(tool.run, []).append(intent)
        for run, own_intents in intents.items():
            own = run(routed.filter(F.col("intent").isin(own_intents) & F.col("permitted")), chunks)
            found = own if found is None else found.unionByName(own)
        ranked = retrieval.top(found.withColumnRenamed("question", "query"), "score", n)
        return ranked.select(F.col("query").alias("question"), "id", F.col("rank").alias("place"))


def answer(questions: DataFrame, chunks: DataFrame, registry: ToolRegistry) -> DataFrame:
    """id, intent, rounds, verdict, citations (in order of id) of questions (id, text, tenant, role).

    A round reads the next ``PAGE`` candidates of each open question; a candidate that holds
    ``SHARE`` of its terms is cited.  A question is answered when its intent's citations are
    there, and given up as INSUFFICIENT_EVIDENCE after ``MAX_RETRIES`` retries.
    """
    routed = materialise(registry.routed(questions), "routed")
    candidates = materialise(registry.candidates(routed, chunks, PAGE * (MAX_RETRIES + 1)), "candidates")
    start = F.when(F.col("permitted"), "open").otherwise("FORBIDDEN")
    state = materialise(routed.select("id", "text", "intent", "needed", F.lit(0).alias("rounds"), start.alias("verdict"), F.array().cast("array<bigint>").alias("citations")), "state")
    for n in range(min(MAX_ITERATIONS, MAX_RETRIES + 1)):
        frontier = state.filter("verdict = 'open'").select("id", "text")
        if frontier.isEmpty():
            break
        page = candidates.filter((F.col("place") > n * PAGE) & (F.col("place") <= (n + 1) * PAGE)).select(F.col("question").alias("query"), "id")
        page = page.join(frontier.select(F.col("id").alias("query")), "query", "left_semi")
        good = retrieval.overlap(frontier, chunks.select("id", "text"), page).filter(F.col("overlap") >= SHARE)
        good = good.groupBy("query").agg(F.collect_set("id").alias("found"))  # PAGE at most
        merged = state.join(good, F.col("id") == F.col("query"), "left")
        cited = F.when(F.col("found").isNull(), F.col("citations")).otherwise(F.array_sort(F.array_union("citations", "found")))
        is_open = F.col("verdict") == "open"
        verdict = F.when(~is_open, F.col("verdict")).when(F.size(cited) >= F.col("needed"), "answered").when(F.lit(n == MAX_RETRIES), "INSUFFICIENT_EVIDENCE").otherwise("open")
        moved = merged.select("id", "text", "intent", "needed", (F.col("rounds") + is_open.cast("int")).alias("rounds"), verdict.alias("verdict"), cited.alias("citations"))
        state = materialise(moved, "state", replaces=state)
    return state.select("id", "intent", F.col("rounds").cast("long").alias("rounds"), "verdict", "citations")
