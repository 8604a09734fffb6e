"""Intents with the same tool are searched together."""

from quillstone.operators import agent


def test_a_shared_tool_reads_the_chunks_once(spark):
    calls = []

    def tool(questions, chunks):
        calls.append(sorted(r["id"] for r in questions.collect()))
        return agent.search(questions, chunks)

    registry = agent.ToolRegistry(spark, {"qa": agent.Registered("query:run", 1, tool), "compare": agent.Registered("query:run", 2, tool)})
    asked = spark.createDataFrame([(1, "rent", "en", "ADMIN"), (2, "compare rent", "en", "ADMIN")], "id long, text string, tenant string, role string")
    chunks = spark.createDataFrame([(10, "en", "rent is due"), (11, "de", "rent")], "id long, tenant string, text string")
    got = registry.candidates(registry.routed(asked), chunks, 5)
    assert sorted((r["question"], r["id"]) for r in got.collect()) == [(1, 10), (2, 10)] and calls == [[1, 2]]
