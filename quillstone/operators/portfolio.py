"""Portfolio indicators over documents, findings and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.labels import is_processing


def tabs_of(status: Column) -> Column:
    """The tabs that show a document of that status: all, and one of processing, ready and failed."""
    own = F.when(status == "COMPLETED", "ready").when(status == "FAILED", "failed").otherwise("processing")
    return F.array(F.lit("all"), own)


def status_counts(docs: DataFrame) -> DataFrame:
    """Overlapping tab counts; a tab without documents counts 0."""
    s = F.col("status")
    return docs.agg(
        F.count("*").alias("n_all"),
        F.count_if(is_processing(s)).alias("n_processing"),
        F.count_if(s == "COMPLETED").alias("n_ready"),
        F.count_if(s == "FAILED").alias("n_failed"),
    )


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count("*").alias("n_all"), *[F.count_if(F.col("severity") == x).alias(f"n_{x}") for x in ("high", "medium", "low")])


def exposure(findings: DataFrame) -> DataFrame:
    """Findings (doc, pos, severity) per document by level, in order of 3 high + medium;
    equal weights keep first-seen order.  Width is the share of the largest total."""
    counted = findings.groupBy("doc").agg(
        *[F.count_if(F.col("severity") == x).alias(x) for x in ("high", "medium", "low")], F.count("*").alias("total"), F.min("pos").alias("first_pos")
    )
    # One row: the largest total.  A window over all documents would be one task's work.
    most = counted.agg(F.greatest(F.max("total"), F.lit(1)).alias("most"))
    sized = counted.join(F.broadcast(most), F.lit(True))
    return sized.select("doc", "high", "medium", "low", "total", (3 * F.col("high") + F.col("medium")).alias("weight"), F.round(100 * F.col("total") / F.col("most"), 6).alias("width"), "first_pos")


def kpi_row(docs: DataFrame, findings: DataFrame, dates: DataFrame) -> DataFrame:
    """One row.  docs: status, pages; findings: severity, state; dates: days_until."""
    s = F.col("status")
    a = docs.agg(F.count_if(s == "COMPLETED").alias("indexed"), F.coalesce(F.sum(F.when(s == "COMPLETED", F.col("pages"))), F.lit(0)).alias("pages"), F.count_if(is_processing(s)).alias("processing"))
    b = findings.agg(F.count_if((F.col("severity") == "high") & (F.col("state") != "accepted")).alias("open_high"), F.count("*").alias("findings"))
    c = dates.agg(F.count_if(F.col("days_until").between(0, 90)).alias("deadlines"))
    return a.join(b, F.lit(True)).join(c, F.lit(True))


def ordered_sections(clauses: DataFrame) -> DataFrame:
    """Clauses (doc, pos, section, clause) grouped by section in first-seen order."""
    grouped = clauses.groupBy("doc", "section").agg(F.min("pos").alias("first_pos"), F.array_sort(F.collect_list(F.struct("pos", "clause"))).alias("clauses"))
    rank = F.row_number().over(Window.partitionBy("doc").orderBy("first_pos"))
    return grouped.select("doc", "section", rank.alias("section_no"), F.transform("clauses", lambda x: x["clause"]).alias("clauses"))
