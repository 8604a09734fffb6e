"""Text ingestion: HTML, chunking, layout clean-up, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed rule table: name, severity, pattern (ASCII, the same in Java and RE2).
RULES = (
    ("license_notice", "low", "Licensed under the [A-Z][A-Za-z]+"),
    ("contact_address", "medium", "[A-Za-z0-9._]+@[A-Za-z0-9-]+[.][a-z]+"),
    ("credential", "high", "(password|secret|token|api_key) *[:=] *[^ ]+"),
    ("access_key", "high", "AKIA[A-Z0-9]{16}"),
    ("shouting", "low", "[A-Z]{3,}!!"),
    ("symbol_noise", "low", "[*]{3}|[%]{3}|[#]{3}"),
    ("table_row", "low", "[a-z] [|] [a-z]"),
)
HEADING = "^[0-9]+([.][0-9]+)* +[A-Z]"


def risk_findings(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per (text, matching rule) with the excerpt as evidence.

    Patterns are literals, so each is compiled once; each is matched once, as no rule
    matches an empty string; and no row is copied per rule.
    """
    found = [F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.regexp_extract(text_col, p, 0).alias("evidence")) for name, severity, p in RULES]
    found = F.filter(F.array(*found), lambda x: x["evidence"] != "")
    return texts.select("*", F.explode(found).alias("x")).drop(text_col).select("*", "x.*").drop("x")


def plain_text(html: Column) -> Column:
    """Scripts, styles and comments out, tags to blanks, white space to one blank."""
    bare = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), "[ \t\r\n]+", " "))


def html_tables(html: Column) -> Column:
    """Tables as array<array<array<string>>>: rows of cells."""

    def parts(s: Column, pattern: str) -> Column:
        return F.regexp_extract_all(s, F.lit(pattern), F.lit(1))

    def cells(row: Column) -> Column:
        return F.transform(parts(row, r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), lambda c: plain_text(c))

    rows = F.transform(parts(html, r"(?is)<table[^>]*>(.*?)</table>"), lambda t: parts(t, r"(?is)<tr[^>]*>(.*?)</tr>"))
    return F.transform(rows, lambda t: F.transform(t, cells))


def image_sources(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?is)<img[^>]*?src=["']([^"']*)"""), F.lit(1))


def clause_chunks(texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Lines cut into chunks at numbered headings: id, chunk_no, heading, parent, lines, text.

    ``parent`` is the heading number less its last part, so "8.3" hangs under "8".
    """
    lines = texts.select(F.col(id_col), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    heading = F.when(F.col("line").rlike(HEADING), F.regexp_extract("line", "^([0-9]+(?:[.][0-9]+)*)", 1))
    w = Window.partitionBy(id_col).orderBy("pos")
    marked = lines.withColumn("heading", heading).withColumn("chunk_no", F.count("heading").over(w))
    chunks = marked.groupBy(id_col, "chunk_no").agg(F.max("heading").alias("heading"), F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("x"))
    parent = F.when(F.col("heading").contains("."), F.regexp_replace("heading", "[.][0-9]+$", ""))
    return chunks.select(id_col, "chunk_no", "heading", parent.alias("parent"), "n_lines", F.array_join(F.transform("x", lambda s: s["line"]), "\n").alias("text"))


def with_parent_text(chunks: DataFrame, id_col: str) -> DataFrame:
    """Small-to-big: every chunk with its parent chunk's text, if it has one."""
    up = chunks.filter("heading IS NOT NULL").select(F.col(id_col).alias("of"), F.col("heading").alias("above"), F.col("text").alias("parent_text"))
    return chunks.join(up, (F.col(id_col) == F.col("of")) & (F.col("parent") == F.col("above")), "left").drop("of", "above")


def running_lines(texts: DataFrame, group: str, id_col: str, share: float = 0.5) -> DataFrame:
    """Lines that stand on more than ``share`` of a group's pages: headers and footers."""
    pages = texts.groupBy(group).agg(F.count("*").alias("n_pages"))
    lines = texts.select(group, id_col, F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).filter("line <> ''")
    counted = lines.groupBy(group, "line").agg(F.count("*").alias("n"))
    return counted.join(pages, group).filter(F.col("n") > share * F.col("n_pages"))


def edge_lines(text: Column, edge: int) -> Column:
    """array<struct(place, pattern)> of the first and last ``edge`` lines, digits masked, each once."""
    lines = F.split(text, "\n")

    def masked(line: Column) -> Column:
        return F.regexp_replace(F.trim(line), "[0-9]+", "#")

    top = F.transform(F.slice(lines, 1, edge), lambda s: F.struct(F.lit("top").alias("place"), masked(s).alias("pattern")))
    bottom = F.transform(F.slice(lines, -F.least(F.size(lines), F.lit(edge)), F.lit(edge)), lambda s: F.struct(F.lit("bottom").alias("place"), masked(s).alias("pattern")))
    return F.filter(F.array_distinct(F.concat(top, bottom)), lambda x: x["pattern"] != "")


def without_running_lines(texts: DataFrame, group: str, share: float = 0.5, edge: int = 3) -> DataFrame:
    """texts (the group, text and others) with cleaned and n_dropped: running heads and feet are out.

    A line runs where its pattern stands at the same end of more than ``share`` of the group's pages,
    two at least; "Page 3" and "Page 4" are one pattern.  A page puts 2 * ``edge`` patterns at most into the
    count, added up before the shuffle, and a group has 2 * ``edge`` / ``share`` running ones at most.
    Null groups are one group; a null text stays null.
    """
    pages = texts.groupBy(F.col(group).alias("of")).agg(F.count("*").alias("n_pages"))
    counted = texts.select(F.col(group).alias("of"), F.explode(edge_lines(F.col("text"), edge)).alias("x")).groupBy("of", "x").agg(F.count("*").alias("n"))
    many = counted.withColumnRenamed("of", "g").join(pages, F.expr("g <=> of")).filter((F.col("n") > share * F.col("n_pages")) & (F.col("n") >= 2))
    running = many.groupBy("of").agg(F.collect_list("x").alias("running"))
    marked = texts.join(running, F.col(group).eqNullSafe(F.col("of")), "left").withColumn("running", F.coalesce("running", F.array().cast("array<struct<place:string,pattern:string>>")))
    lines = F.split("text", "\n")
    n = F.size(lines)

    def runs(line: Column, i: Column) -> Column:
        pattern = F.regexp_replace(F.trim(line), "[0-9]+", "#")
        top = (i < edge) & F.exists("running", lambda x: (x["place"] == "top") & (x["pattern"] == pattern))
        return top | ((i >= n - edge) & F.exists("running", lambda x: (x["place"] == "bottom") & (x["pattern"] == pattern)))

    kept = marked.withColumn("kept", F.filter(lines, lambda line, i: ~runs(line, i)))
    return kept.withColumn("cleaned", F.array_join("kept", "\n")).withColumn("n_dropped", (n - F.size("kept")).cast("long")).select(*texts.columns, "cleaned", "n_dropped")


def key_dates(text: Column) -> Column:
    """ISO dates of a text in order."""
    return F.regexp_extract_all(text, F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), F.lit(1))


#: Clause types by a phrase that tells one.
CLAUSE_TYPES = (
    ("license", "(?i)licensed under|licen[cs]e (grant|terms)"),
    ("termination", "(?i)\\bterminat(e|es|ed|ion)\\b"),
    ("payment", "(?i)\\b(fees?|payment|invoice|net [0-9]+)\\b"),
    ("liability", "(?i)\\b(liability|liable|indemnif(y|ies|ication))\\b"),
    ("confidentiality", "(?i)\\bconfidential(ity)?\\b"),
    ("contact", "[A-Za-z0-9._]+@[A-Za-z0-9-]+[.][a-z]+"),
)
AMOUNT = r"(?:USD|EUR|[$]) ?[0-9][0-9,]*(?:[.][0-9]{2})?"
#: The schema that extracted facts are checked against.
FACTS = "dates array<string>, amounts array<string>, clause_types array<string>, summary string"


def contract_facts(text: Column) -> Column:
    """struct of FACTS: ISO dates and amounts in order, clause types in the order above, and as summary
    the first line with a letter, whole."""
    types = F.filter(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in CLAUSE_TYPES]), lambda x: x.isNotNull())
    summary = F.get(F.filter(F.split(text, "\n"), lambda line: line.rlike(r"\p{L}")), 0)
    found = F.struct(key_dates(text).alias("dates"), F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(0)).alias("amounts"), types.alias("clause_types"), F.trim(summary).alias("summary"))
    return F.from_json(F.to_json(found), FACTS)  # what does not fit the schema is null


def parse_route(html: Column) -> Column:
    """The parser a page needs: ocr (hardly any text but images), table, complex (columns, frames) or fast."""
    sparse = (F.length(plain_text(html)) < 20) & html.rlike("(?i)<img[ >]")
    return F.when(sparse, "ocr").when(html.rlike("(?i)<table[ >]"), "table").when(html.rlike("(?i)<(aside|frameset|iframe|math|svg)[ >]|column-count"), "complex").otherwise("fast")


def answer_citations(text: Column) -> Column:
    """Numbers of the [n] marks of an answer."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))
