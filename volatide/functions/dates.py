"""Date functions: market-local timestamps, dates inside strings, date ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKET_ZONE = "Asia/Ho_Chi_Minh"


def market_timestamp(text: Column, zone: str = MARKET_ZONE) -> Column:
    """Wall clock of the market, without zone: strings with an offset are converted, others are local already."""
    parsed = F.try_to_timestamp(F.nullif(F.trim(text), F.lit("")))
    has_offset = text.rlike(r"[T ]\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})\s*$")
    return F.when(has_offset, F.from_utc_timestamp(parsed, zone)).otherwise(parsed).cast("timestamp_ntz")


def published_text(text: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss where it parses, else the normalised string."""
    from volatide.functions.text import normalize

    parsed = F.try_to_timestamp(F.nullif(F.trim(text), F.lit("")))
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd HH:mm:ss"), normalize(text))


def extract_date(text: Column) -> Column:
    """The first date in a text: yyyy-mm-dd, else dd/mm/yyyy, else dd-mm-yyyy."""
    forms = ((r"(\d{4}-\d{2}-\d{2})", "yyyy-MM-dd"), (r"(\d{1,2}/\d{1,2}/\d{4})", "d/M/yyyy"), (r"(\d{1,2}-\d{1,2}-\d{4})", "d-M-yyyy"))
    found = [F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), F.lit(form))) for pattern, form in forms]
    return F.coalesce(*found)


def split_date_fields(raw: Column) -> tuple[Column, Column]:
    """(date, published_at): the latter only where the string tells a time of day."""
    intraday = raw.rlike("[T:]")
    return F.coalesce(F.substring(raw, 1, 10), F.lit("")), F.when(intraday, raw).otherwise(F.lit(""))


def date_from_unix(seconds: Column) -> Column:
    return F.to_date(F.timestamp_seconds(seconds))


def unix_seconds(day: Column, end_of_day: bool = False, zone: str = "UTC") -> Column:
    """Seconds since 1970 at which a day begins, or its last second, on the clocks of a zone."""
    local = day.cast("timestamp_ntz") + F.expr("interval '86399' second") if end_of_day else day.cast("timestamp_ntz")
    at = F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    return F.unix_date(at.cast("date")).cast("long") * 86400 + F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)


def date_blocks(spans: DataFrame, start: str, end: str, days: int) -> DataFrame:
    """Rows of (block_start, block_end): consecutive blocks of `days` days that cover each span."""
    blocks = spans.withColumn("block_start", F.explode(F.expr(f"sequence({start}, {end}, interval {int(days)} days)")))
    return blocks.withColumn("block_end", F.least(F.date_add("block_start", days - 1), F.col(end)))


def month_ranges(spans: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of (month_start, month_end) clipped to each span."""
    months = spans.withColumn("m", F.explode(F.expr(f"sequence(trunc({start}, 'MM'), {end}, interval 1 month)")))
    return months.select("*", F.greatest("m", F.col(start)).alias("month_start"), F.least(F.last_day("m"), F.col(end)).alias("month_end")).drop("m")


def five_day_blocks(spans: DataFrame, start: str, end: str) -> DataFrame:
    """Blocks of days 1-5, 6-10, ... 26-month end, of every month that a span touches."""
    months = spans.withColumn("m", F.explode(F.expr(f"sequence(trunc({start}, 'MM'), {end}, interval 1 month)")))
    blocks = months.withColumn("d", F.explode(F.array(*[F.lit(d) for d in range(1, 27, 5)])))
    return blocks.select("*", F.expr("date_add(m, d - 1)").alias("block_start"), F.when(F.col("d") == 26, F.last_day("m")).otherwise(F.expr("date_add(m, d + 3)")).alias("block_end")).drop("m", "d")
