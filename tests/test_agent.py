"""Rounds of answering on planted questions."""

import pytest

from quillstone.operators import agent


@pytest.fixture(scope="module")
def answers(spark):
    filler = [(i, "t1", f"the contract term {i} is one of many the tenant term of contract") for i in range(100, 130)]
    chunks = [(1, "t1", "rent is due on the first day of each month"), (2, "t1", "notice period is ninety days in writing"), (3, "t2", "secret fee of t2 is nine"), (4, "t1", "Notice period is ninety days in writing again"), *filler]
    questions = [
        (1, "rent is due on the first day", "t1", "VIEWER"),
        (2, "secret fee of t2 is nine", "t1", "VIEWER"),  # another tenant's text
        (3, "compare notice period is ninety days in writing", "t1", "VIEWER"),
        (4, "Summarize rent is due on the first day", "t1", "VIEWER"),  # needs analysis:run
        (5, "summarize rent is due on the first day", "t1", "ANALYST"),
        (6, "what of the contract term 117", "t1", "VIEWER"),  # past the first page of candidates
        (7, "words that nobody wrote", "t1", "ADMIN"),
    ]
    tools = {"qa": agent.Registered("query:run", 1, agent.search), "compare": agent.Registered("query:run", 2, agent.search), "summarize": agent.Registered("analysis:run", 1, agent.search)}
    asked = spark.createDataFrame(questions, "id long, text string, tenant string, role string")
    docs = spark.createDataFrame(chunks, "id long, tenant string, text string")
    return {r["id"]: r for r in agent.answer(asked, docs, agent.ToolRegistry(spark, tools)).collect()}


def test_answers_and_citations(answers):
    assert (answers[1]["verdict"], answers[1]["citations"], answers[1]["rounds"]) == ("answered", [1], 1)
    assert (answers[3]["verdict"], answers[3]["citations"]) == ("answered", [2, 4])
    assert (answers[5]["verdict"], answers[5]["intent"]) == ("answered", "summarize")


def test_other_tenants_and_missing_rights_give_nothing(answers):
    assert (answers[2]["verdict"], answers[2]["citations"]) == ("INSUFFICIENT_EVIDENCE", [])
    assert (answers[4]["verdict"], answers[4]["rounds"]) == ("FORBIDDEN", 0)


def test_retries_are_bounded(answers):
    assert (answers[7]["verdict"], answers[7]["rounds"]) == ("INSUFFICIENT_EVIDENCE", 1 + agent.MAX_RETRIES)
    assert all(r["rounds"] <= min(agent.MAX_ITERATIONS, 1 + agent.MAX_RETRIES) for r in answers.values())


def test_intents(spark):
    texts = ["Compare a and b", "What risk is there", "summarise this", "List dates", "in all contracts, who pays", "who pays", "comparison"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(agent.intent_of(agent.F.col("t")))
    assert [r[0] for r in rows.collect()] == ["compare", "risk", "summarize", "extract", "multi_document", "qa", "qa"]
