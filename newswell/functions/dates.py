"""Date, calendar and score arithmetic as Column expressions. The session time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newswell.functions.text import bind

SEOUL = "Asia/Seoul"

_MONTHS = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_WEEKDAY = r"^(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?\.?,?\s+"
#: Clock, fraction, half of the day, zone name, what parts it from an offset, and the offset; all of it may be missing.
_CLOCK = r"(?:(?:\s*T\s*|\s*,\s*|\s+at\s+|\s+)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?:\s*([ap])\.?m\.?)?(?:\s*((?-i:[A-Z]{3,5}|[Zz])))?(?:(\s*)([+-](?:\d{2}:?\d{2}|\d{1,2})))?)?"
_DAY, _YEAR = r"(\d{1,2})(?:st|nd|rd|th)?", r"(\d{4}|\d{2})"
#: Forms of a date, each with the groups that are its year, month and day; the clock's groups follow.
_FORMS = (
    (r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", (1, 2, 3)),
    (rf"{_DAY}[-\s.,/]*{_MONTHS}\.?[-\s,/]*{_YEAR}", (3, 2, 1)),
    (rf"{_MONTHS}\.?\s*{_DAY},?\s*{_YEAR}", (3, 1, 2)),
    (rf"(\d{{4}})[-\s]+{_MONTHS}[-\s]+(\d{{1,2}})", (1, 2, 3)),
    (r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})", (3, 1, 2)),  # the month first, unless it can't be one
)


def _parts(c: Column) -> Column:
    """Year, month, day, hour, minute, second, fraction, half of the day, zone, gap and offset of a date text as one text, parted by bars; null if it is none."""
    out = F.lit(None).cast("string")
    for form, places in reversed(_FORMS):
        pattern = rf"(?i)^{form}{_CLOCK}$"
        out = F.when(c.rlike(pattern), F.regexp_replace(c, pattern, "|".join(f"${k}" for k in (*places, *range(4, 12))))).otherwise(out)
    return out


def _instant(p: Column, lang: Column) -> Column:
    number = lambda k: F.get(p, F.lit(k)).try_cast("int")
    text = lambda k: F.get(p, F.lit(k))
    year, day, hour = number(0), number(2), F.coalesce(number(3), F.lit(0))
    year = F.when(F.length(text(0)) > 2, year).otherwise(F.when(year < 70, 2000 + year).otherwise(1900 + year))
    named = F.floor((F.position(F.lower(F.substring(text(1), 1, 3)), F.lit("janfebmaraprmayjunjulaugsepoctnovdec")) + 2) / 3).cast("int")
    month = F.coalesce(number(1), named)
    swapped = (month > 12) & (day <= 12)
    half = F.lower(text(7))
    hour = F.when(half == "", hour).when(~hour.between(1, 12), None).otherwise(hour % 12 + F.when(half == "p", 12).otherwise(0))
    seconds = (F.concat(F.coalesce(F.nullif(text(5), F.lit("")), F.lit("0")), F.lit("."), F.rpad(F.substring(text(6), 1, 6), 6, "0"))).try_cast("decimal(8,6)")
    at = F.try_make_timestamp(year, F.when(swapped, day).otherwise(month), F.when(swapped, month).otherwise(day), hour, F.coalesce(number(4), F.lit(0)), seconds, F.lit("UTC"))
    digits = F.regexp_replace(text(10), r"[^0-9]", "")
    minutes = F.when(F.length(digits) > 2, F.substring(digits, 1, 2).cast("int") * 60 + F.substring(digits, 3, 2).cast("int")).otherwise(digits.try_cast("int") * 60)
    # A sign right behind a zone's name is that of the name's zone as seen from the clock: GMT+3 is three hours behind.
    east = F.startswith(text(10), F.lit("+")) != ((text(8) != "") & (text(9) == ""))
    moved = F.timestamp_add("MINUTE", F.when(east, -minutes).otherwise(minutes), at)
    utc = F.upper(text(8)).isin("Z", "UTC", "GMT")
    naive = F.when(lang == "ko", F.to_utc_timestamp(at, SEOUL)).otherwise(at)
    return F.when(utc & ((text(10) == "") | (text(9) != "")), at).when(text(10) != "", F.when(minutes < 1440, moved)).otherwise(naive)


def parse_date(c: Column, lang: Column) -> Column:
    """An instant from the dates that feeds write, null if a text is none.

    Read are ISO dates and compact ones, mail dates, dates with a month's name before or after the day, and numbers with the
    month first (the day, if it can't be a month), each with a clock or without, fractions of any length, halves
    of the day, and offsets. Names of zones other than UTC, GMT and Z say nothing, as they don't tell one zone. Without
    a zone Korean texts are in Seoul time, others in UTC. Years of two digits are those from 1970 to 2069; a date without
    a year or a day is none.
    """
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), r"\s*\([A-Z]{3,5}\)$", ""), f"(?i){_WEEKDAY}", "")
    # The year after the clock, and digits alone, are brought into the common order first.
    c = F.regexp_replace(c, rf"(?i)^{_MONTHS}\s+(\d{{1,2}})\s+(\d{{1,2}}:\d{{2}}(?::\d{{2}})?)(\s+(?-i:[A-Z]{{3,5}}))?\s+(\d{{4}})$", "$1 $2 $5 $3$4")
    c = F.regexp_replace(c, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    c = F.regexp_replace(c, r"^(\d{4})(\d{2})(\d{2})T?(\d{2})(\d{2})(\d{2})?(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$", "$1-$2-$3T$4:$5:$6$7$8")
    c = F.regexp_replace(c, r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}):(?=$|Z|[+-])", "$1")
    return bind(bind(c, _parts), lambda p: bind(F.split(p, r"\|", -1), lambda x: _instant(x, lang)))


def seoul_date(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, SEOUL))


def day_key(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")


def week_key(d: Column) -> Column:
    """ISO week, ``2024-W05``."""
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), d), F.weekofyear(d))


def month_key(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def backfill_offset(date_raw: Column, lang: Column, unknown: Column) -> Column:
    """Korean texts with a known date in UTC get the offset of Seoul in its place: the clock time stays, the instant moves."""
    return F.when((lang == "ko") & ~F.coalesce(unknown, F.lit(False)), F.regexp_replace(date_raw, r"(\+00:00|Z)$", "+09:00")).otherwise(date_raw)


def recency_boost(ts: Column, run_ts: Column) -> Column:
    """10 under a day (and for the future), 5 under three, 2 under seven; 0 without a date."""
    hours = (F.unix_timestamp(run_ts) - F.unix_timestamp(ts)) / 3600
    return F.when(hours < 24, 10).when(hours < 72, 5).when(hours < 168, 2).otherwise(0)


def day_number(ts: Column) -> Column:
    return F.datediff(ts, F.lit("1970-01-01").cast("date"))


def strength(hits: Column) -> Column:
    """1 - 0.78 ** hits to three places, from a table without float drift."""
    table = F.array(*(F.lit(round(1 - 0.78**n, 3)) for n in range(41)))
    return F.element_at(table, F.least(hits, F.lit(40)) + 1)


def depth_bonus(n_chars: Column) -> Column:
    return F.when(n_chars >= 80, F.least(F.lit(6.0), F.log2(n_chars / 40) * 1.2)).otherwise(-3.0)


def clamp_score(c: Column, most: int = 120) -> Column:
    """Rounded half to even, from 0 to ``most``."""
    return F.greatest(F.lit(0), F.least(F.lit(most), F.bround(c, 0).cast("int")))


def register_period_keys(spark: SparkSession, name: str = "period_keys") -> str:
    """Make the SQL table function ``period_keys(at)``: three rows ``period, key``, the day, ISO week and month of a timestamp; none for null.

    It is a query and not Python, so it is planned with the query that uses it: ``SELECT ... FROM t, LATERAL period_keys(t.at)``.
    """
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(at TIMESTAMP) RETURNS TABLE (period STRING, key STRING)
        RETURN SELECT period, key FROM inline(if(at IS NULL, NULL, array(
            struct('daily' AS period, date_format(at, 'yyyy-MM-dd') AS key),
            struct('weekly' AS period, format_string('%d-W%02d', extract(YEAROFWEEK FROM at), weekofyear(at)) AS key),
            struct('monthly' AS period, date_format(at, 'yyyy-MM') AS key))))""")
    return name


def fan_out(df: DataFrame, at: str) -> DataFrame:
    """The rows of ``df`` with ``period, key`` of each period that they fall in."""
    spark = df.sparkSession
    name = register_period_keys(spark)
    return spark.sql(f"SELECT t.*, k.period, k.key FROM {{t}} AS t, LATERAL {name}(CAST(t.`{at}` AS TIMESTAMP)) AS k", t=df)
