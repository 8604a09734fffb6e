"""Repetition is looked for on every host, also where markup alone gives the text."""

from quillstone.llm import html_extract


def test_repeats_are_found_on_a_host_of_articles(spark):
    note = "one two three four five six seven eight nine ten"
    rows = [(i, "http://b.example/", f"<nav>{note}</nav><article>own {i}</article>") for i in range(2)]
    got = html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["text"], r["n_repeated"], r["n_removed"]) for r in got) == [("own 0", 11, None), ("own 1", 11, None)]
