"""Display functions as column expressions, in exact arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_bytes(n: Column) -> Column:
    """"512 B", "3.3 MB": one decimal below 10, none from there; GB is the largest unit.

    Decimals come from integers, so no engine's float formatting matters.
    """
    out = F.concat(n.cast("string"), F.lit(" B"))
    for unit, size, above in (("KB", 1 << 10, 1 << 20), ("MB", 1 << 20, 1 << 30), ("GB", 1 << 30, None)):
        tenths = F.floor((n * 10 + size // 2) / F.lit(size).cast("decimal(20,0)")).cast("bigint")
        whole = F.floor((n + size // 2) / F.lit(size).cast("decimal(20,0)")).cast("bigint")
        decimal = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"))
        text = F.concat(F.when(n < 10 * size, decimal).otherwise(whole.cast("string")), F.lit(f" {unit}"))
        out = F.when((n >= size) & ((n < above) if above else F.lit(True)), text).otherwise(out)
    return out


def format_date(d: Column) -> Column:
    return F.coalesce(F.date_format(d, "d MMM yyyy"), F.lit("—"))


def days_until(d: Column, now: Column) -> Column:
    """Whole days ahead, rounded up; a day that began less than 24 hours ago counts as 0."""
    micros = F.unix_micros(d.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))
    return F.ceil(F.floor(micros / 1000) / 86_400_000).cast("bigint")


def relative_time(at: Column, now: Column) -> Column:
    """struct(value, unit): signed, rounded half up, in the largest unit that fits."""
    s = (F.unix_micros(at.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 1e6

    def part(per: int, unit: str) -> Column:
        return F.struct(F.floor(s / per + 0.5).cast("bigint").alias("value"), F.lit(unit).alias("unit"))

    size = F.abs(s)
    return F.when(size < 60, part(1, "second")).when(size < 3600, part(60, "minute")).when(size < 86400, part(3600, "hour")).otherwise(part(86400, "day"))


def deadline_label(days: Column) -> Column:
    return F.when(days <= 0, "Today").otherwise(F.concat(F.lit("in "), days.cast("string"), F.lit("d")))


def question_problem(q: Column) -> Column:
    """Null where the question is valid."""
    n = F.length(F.trim(q))
    return F.when(n < 3, "too_short").when(n > 2000, "too_long")


def file_problem(name: Column, mime: Column, size: Column, max_mb: int) -> Column:
    """Null where the file is valid; an empty MIME type is accepted."""
    wrong = ~F.lower(name).endswith(".pdf") | ((F.coalesce(mime, F.lit("")) != "") & (mime != "application/pdf"))
    return F.when(wrong, "type").when(size == 0, "empty").when(size > max_mb * 1024 * 1024, "too_big")


def origin_list(text: Column) -> Column:
    """A JSON list, or names parted by commas, trimmed, blanks dropped."""
    plain = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.startswith(F.ltrim(text), F.lit("[")), F.from_json(text, "array<string>")).otherwise(plain)


def request_id(given: Column, generated: Column) -> Column:
    """The given id if it is at most 64 ASCII characters, else the generated one."""
    return F.when((F.length(given) <= 64) & given.rlike(r"^[\x00-\x7F]+$"), given).otherwise(generated)
