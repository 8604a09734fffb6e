"""What a service around the tables needs: pages, uploads, guarded answers, evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstone.operators.tenancy import MAX_PAGE, TenantTable

#: Fixed file types: extension and MIME type.
FILE_TYPES = {"pdf": "application/pdf"}
MAX_UPLOAD_MB = 50


def page_envelope(own: TenantTable, item: str, offset: int = 0, limit: int = 50, **equal) -> DataFrame:
    """One row: items (at most 200, in order), total, offset, limit."""
    total = own.rows(**equal).agg(F.count("*").alias("total"))
    items = own.page(offset, limit, **equal).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return items.join(total, F.lit(True)).select("items", "total", F.lit(offset).cast("long").alias("offset"), F.lit(min(limit, MAX_PAGE)).cast("long").alias("limit"))


def upload_reason(filename: Column, mime: Column, magic: Column, size: Column) -> Column:
    """Why a file is refused, null for one that is taken; the first reason counts."""
    extension = F.lower(F.regexp_extract(filename, r"[.]([^.]+)$", 1))
    known = F.create_map(*[F.lit(x) for item in FILE_TYPES.items() for x in item])
    return (
        F.when(~extension.isin(list(FILE_TYPES)), "extension")
        .when(F.try_element_at(known, extension) != mime, "mime")
        .when(size == 0, "empty")
        .when(size > MAX_UPLOAD_MB * 1024 * 1024, "too_big")
        .when(magic != "%PDF", "magic")
    )


def upload_rows(files: DataFrame, tenant_col: str, id_col: str) -> DataFrame:
    """The rows that uploads leave: kind (document, version, job, audit), id, and of a file
    whose content the tenant has already, duplicate_of.

    ``files``: tenant, id, sha256, rejected.  A refused file leaves its audit row only, a
    duplicate a version of the document that has its content.  The first file of a content is found by
    partial aggregation, so a content uploaded without end is no one task's work.
    """
    taken = files.filter("rejected IS NULL")
    first = taken.groupBy(F.col(tenant_col).alias("of"), F.col("sha256").alias("content")).agg(F.min(id_col).alias("first"))
    marked = files.join(first, F.expr(f"{tenant_col} = of AND sha256 = content AND rejected IS NULL"), "left")
    marked = marked.withColumn("duplicate_of", F.when(F.col("first") != F.col(id_col), F.col("first")))
    kinds = F.when(F.col("rejected").isNotNull(), F.array(F.lit("audit"))).when(F.col("duplicate_of").isNotNull(), F.array(*map(F.lit, ("version", "job", "audit"))))
    rows = marked.withColumn("kind", F.explode(kinds.otherwise(F.array(*map(F.lit, ("document", "version", "job", "audit"))))))
    return rows.select(tenant_col, id_col, "kind", "rejected", "duplicate_of")


def over_limits(steps: DataFrame, run: str, cost: str, iterations: int, budget: float, timeout_seconds: int) -> DataFrame:
    """Per agent run the steps and cost so far, and whether they or the time from its first step (ts) are over their limits."""
    used = steps.groupBy(run).agg(F.count("*").alias("n_steps"), F.round(F.sum(cost), 4).alias("cost"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    late = F.col("last") > F.col("first") + F.make_dt_interval(secs=F.lit(timeout_seconds))
    return used.select(run, "n_steps", "cost", (F.col("n_steps") > iterations).alias("over_iterations"), (F.col("cost") > budget).alias("over_budget"), late.alias("over_time"))


def schema_check(json: Column, schema: str) -> Column:
    """ok, missing (a field is absent or of another type) or malformed, for a JSON answer."""
    fields = StructType.fromDDL(schema).names
    read = F.from_json(json, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    whole = F.from_json(json, "map<string,string>")
    absent = [read.getField(f).isNull() for f in fields]
    missing = absent[0]
    for x in absent[1:]:
        missing = missing | x
    return F.when(json.isNull() | whole.isNull(), "malformed").when(missing, "missing").otherwise("ok")


def answer_parts(text: Column) -> Column:
    """struct(citations array<int>, bold array<string>, plain): an answer's [n] marks, its **bold** runs and the rest."""
    marks = F.transform(F.regexp_extract_all(text, F.lit(r"\[([0-9]{1,9})\]"), F.lit(1)), lambda x: x.cast("int"))
    bold = F.regexp_extract_all(text, F.lit(r"[*][*]([^*]+)[*][*]"), F.lit(1))
    plain = F.regexp_replace(F.regexp_replace(text, r"\[[0-9]{1,9}\]", ""), r"[*][*]([^*]+)[*][*]", "$1")
    return F.struct(marks.alias("citations"), bold.alias("bold"), plain.alias("plain"))


def evaluation_runs(per_query: DataFrame, metrics: list[str]) -> DataFrame:
    """Per (config, dataset): n_samples and a map of metric to mean."""
    means = F.map_from_arrays(F.array(*map(F.lit, metrics)), F.array(*[F.round(F.coalesce(F.avg(m), F.lit(0.0)), 4) for m in metrics]))
    return per_query.groupBy("config", "dataset").agg(F.count("*").alias("n_samples"), means.alias("metrics"))


def settings_errors(environment: Column, secret: Column, storage: Column, bucket: Column, origins: Column) -> Column:
    """What keeps settings from a start outside development, comma-joined; empty if nothing does."""
    found = F.array(
        F.when(secret == "change-me", "default_secret"),
        F.when((storage == "s3") & (F.coalesce(bucket, F.lit("")) == ""), "bucket"),
        F.when(F.array_contains(F.split(origins, " *, *"), "*"), "wildcard_origin"),
    )
    return F.when(environment == "development", "").otherwise(F.array_join(found, ","))


def found_or_first(asked: DataFrame, key: str, rows: DataFrame, row_key: str) -> DataFrame:
    """Each asked key with the row of that key, or else the first row of all."""
    first = rows.agg(F.min(row_key).alias("first"))  # one row
    own = rows.select(F.col(row_key).alias("match")).distinct()
    return asked.join(own, F.col(key) == F.col("match"), "left").join(F.broadcast(first), F.lit(True)).withColumn("found", F.coalesce("match", "first")).drop("match", "first")


def half_even(x: Column) -> Column:
    """A double rounded to two places as an exact binary number, ties to even.

    The double is taken apart into integers of 2**-60, so 2.675 (a little less in binary)
    gives 2.67, which decimal rounding of its shortest form does not.
    """
    size = F.abs(x)
    high = F.floor(size * F.lit(2.0**20))
    low = F.floor((size * F.lit(2.0**20) - high) * F.lit(2.0**40))
    unit = F.lit(1 << 60).cast("decimal(20,0)")
    exact = (high.cast("decimal(17,0)") * F.lit(1 << 40).cast("decimal(13,0)") + low.cast("decimal(13,0)")).cast("decimal(34,0)")
    hundred = (exact * F.lit(100).cast("decimal(3,0)")).cast("decimal(37,0)")
    rest = hundred % unit
    whole = ((hundred - rest) / unit).cast("decimal(20,0)")
    twice = rest * 2
    odd = whole % 2 == 1
    up = F.when((twice > unit) | ((twice == unit) & odd), 1).otherwise(0)
    return F.signum(x) * (whole + up).cast("double") / 100.0
