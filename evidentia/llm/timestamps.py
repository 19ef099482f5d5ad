"""Mixed time texts to UTC: a token dictionary of all dates, a joined reading, and the time suffix parsed by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import dealt_anew
from ..session import written
from .common import pick

# The layouts of a stamp, as its contract states them.
SPACE = " \t\n\x0b\x0c\r"
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
YEAR, TWO = "20[0-9][0-9]", "[0-9][0-9]"
DATE = f"{YEAR}-{TWO}-{TWO}|{YEAR}{TWO}{TWO}|{TWO}[.]{TWO}[.]{YEAR}|{TWO} [A-Z][a-z][a-z] {YEAR}|{TWO}/{TWO}/{YEAR}"
TIME = rf"[T\x20]({TWO}):({TWO})(?::({TWO}))?(?:\x20?([AP]M))?(?:\x20?(Z|[+-]{TWO}:?{TWO}))?"
STAMP = rf"\A({DATE})(?:{TIME})?\z"

FIRST_DAY, DAYS = "2000-01-01", 36_525  # 2000-01-01 to 2099-12-31
DAY, HOUR, MINUTE, SECOND = 86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000
#: Hours after a wall time at which another offset is looked for: clocks go back by three hours at most, or by a day.
LATER = (3, 26)


def date_tokens(spark: SparkSession) -> DataFrame:
    """(token, dmy, mdy): every valid date of 2000 to 2099 in each layout, as days since 1970.

    Slashed tokens hold both readings, null where the order gives no date; all others hold one, as `dmy` and `mdy` alike.
    The table has 4 x 36,525 and 58,650 rows, whatever the input.
    """
    number = F.datediff(F.lit(FIRST_DAY), F.lit("1970-01-01")) + F.col("id").cast("int")
    date = F.date_from_unix_date(number)
    y, m, d = F.year(date).cast("string"), F.lpad(F.month(date).cast("string"), 2, "0"), F.lpad(F.day(date).cast("string"), 2, "0")
    name = F.element_at(F.array(*[F.lit(x) for x in MONTHS]), F.month(date))
    joined = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    none = F.lit(None).cast("int")
    forms = [
        (joined(y, "-", m, "-", d), number, number), (joined(y, m, d), number, number), (joined(d, ".", m, ".", y), number, number),
        (joined(d, " ", name, " ", y), number, number), (joined(d, "/", m, "/", y), number, none), (joined(m, "/", d, "/", y), none, number),
    ]
    rows = F.explode(F.array(*[F.struct(t.alias("token"), a.alias("dmy"), b.alias("mdy")) for t, a, b in forms]))
    return spark.range(DAYS).select(rows.alias("r")).select("r.*").groupBy("token").agg(F.max("dmy").alias("dmy"), F.max("mdy").alias("mdy"))


def _suffix(groups: list[Column]) -> Column:
    """Microseconds since midnight, null if the time is impossible; no time is midnight."""
    h, m, s, half, _ = groups
    hour = F.when(half == "", F.when(h < 24, h)).when(h.between(1, 12), h % 12 + F.when(half == "PM", 12).otherwise(0))
    valid = (m < 60) & (F.coalesce(s, F.lit(0)) < 60)
    return F.when(h.isNull(), F.lit(0).cast("long")).when(valid, hour * HOUR + m * MINUTE + F.coalesce(s, F.lit(0)) * SECOND)


def _offset(text: Column) -> Column:
    """Microseconds that an offset is ahead of UTC, null if there is none or if it is impossible."""
    digits = F.regexp_replace(text, ":", "")
    # Matched, these are digits; a cast that fails costs far more than one that is not tried.
    number = lambda at: F.when(F.length(text) > 1, F.substring(digits, at, 2).try_cast("long"))
    h, m = number(2), number(4)
    sign = F.when(text.startswith("-"), -1).otherwise(1)
    return F.when(text == "Z", F.lit(0).cast("long")).when((h <= 14) & (m < 60), sign * (h * HOUR + m * MINUTE))


def _shifted(us: Column, zone: Column) -> Column:
    """The wall time, as microseconds, that a clock of `zone` shows at an instant."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone))


def _instant(wall: Column, zone: Column) -> Column:
    """The instant of a wall time; one that is skipped or repeated takes the offset before the change."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), zone))


def _known(zone: Column) -> Column:
    """The zone if the calendar knows it, else null: a name that it does not know would fail the whole job."""
    return F.when(F.try_to_timestamp(F.concat(F.lit("2000-01-01 00:00 "), zone), F.lit("yyyy-MM-dd HH:mm VV")).isNotNull(), zone)


def readings(stamps: DataFrame, id_col: str = "stamp_id", source_col: str = "source", zone_col: str = "zone", raw_col: str = "raw") -> DataFrame:
    """Stamps (stamp_id, source, zone) with what their text says: a zone that the calendar knows, `epoch` microseconds, or the days of both orders with the
    microseconds since midnight and the offset. Bad stamps have none of these."""
    rows = pick(stamps, {id_col: "long", source_col: "string", zone_col: "string", raw_col: "string"})
    rows = rows.toDF("stamp_id", "source", "zone", "raw").withColumn("t", F.btrim("raw", F.lit(SPACE)))
    # One replacement parts a stamp; what it leaves as it is, is none.
    rows = rows.withColumn("parts", F.when(F.col("t").rlike(STAMP), F.split(F.regexp_replace("t", STAMP, "|".join(f"${i}" for i in range(1, 7))), "[|]")))
    digits = F.col("t").rlike(r"\A[0-9]+\z")
    seconds, millis = digits & (F.length("t") == 10), digits & (F.length("t") == 13)
    epoch = F.when(seconds, F.col("t").try_cast("long") * SECOND).when(millis, F.col("t").try_cast("long") * 1000)
    rows = rows.select("stamp_id", "source", "zone", epoch.alias("epoch"), "parts").withColumn("token", F.coalesce(F.get("parts", F.lit(0)), F.lit("")))
    # All else is computed above the join: below it, the planner would repeat the matching for each use of a part.
    joined = rows.join(F.broadcast(date_tokens(stamps.sparkSession)), "token", "left")
    part = lambda i: F.coalesce(F.get("parts", F.lit(i - 1)), F.lit(""))
    number = lambda i: F.when(part(i) != "", part(i).try_cast("long"))
    joined = joined.select(
        "stamp_id", "source", "zone", "epoch", "token", "dmy", "mdy", _suffix([number(2), number(3), number(4), part(5), part(6)]).alias("time"),
        _offset(part(6)).alias("offset"), (part(6) != "").alias("offset_given"),
    )
    needed = F.col("dmy").isNotNull() | F.col("mdy").isNotNull()
    joined = joined.withColumn("zone", F.when(needed & ~F.col("offset_given"), _known(F.col("zone"))))
    placed = F.col("offset").isNotNull() | (~F.col("offset_given") & F.col("zone").isNotNull())
    good = F.col("epoch").isNull() & F.col("time").isNotNull() & placed
    return joined.select(
        "stamp_id", "source", "zone", "epoch", F.when(good, F.col("dmy")).alias("dmy"), F.when(good, F.col("mdy")).alias("mdy"),
        "time", "offset", F.col("token").contains("/").alias("slashed"),
    )


def votes(read: DataFrame) -> DataFrame:
    """(source, day_first, month_first): stamps of each source that are possible in one order only."""
    alone = read.where("slashed AND (dmy IS NULL) <> (mdy IS NULL)")
    return alone.groupBy("source").agg(F.count("dmy").alias("day_first"), F.count("mdy").alias("month_first"))


def normalise(
    stamps: DataFrame, id_col: str = "stamp_id", source_col: str = "source", zone_col: str = "zone", raw_col: str = "raw", majority: float = 1.0,
) -> DataFrame:
    """Every stamp as microseconds of UTC, with the rule that read it: stamp_id, utc_us, rule, ambiguous.

    Texts are read once, into a table of numbers; dates come from the joined dictionary, which is broadcast because its
    size is fixed. Stamps of one order only are counted by source, combined before they are shuffled, and the counts are
    joined to the stamps of two dates alone, so a source with a third of all rows can be split. With more than `majority`
    times the other's votes an order wins; else the month comes first.

    Defined cases: a null text, a text of another form and an impossible date, time or offset are bad: utc_us is null,
    rule is `bad`, and they never vote. A null source is a source of its own. A date without an offset is bad if its zone
    is null or no zone that the calendar knows. Rows that repeat an id are read each by itself; ties of votes are `default`;
    a text of any length is matched as a whole; an empty table gives an empty result; further columns are ignored.
    """
    read = written(readings(stamps, id_col, source_col, zone_col, raw_col), "readings")
    both = F.col("dmy").isNotNull() & F.col("mdy").isNotNull() & (F.col("dmy") != F.col("mdy")) & F.col("slashed")
    counted = written(votes(read), "votes")
    # Null sources need a value of their own to meet in a join whose hot keys can be split.
    key = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    counts = dealt_anew(counted.select(key(F.col("source")).alias("key"), "day_first", "month_first"), "key")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    day, month = zero("day_first") > majority * zero("month_first"), zero("month_first") > majority * zero("day_first")
    chosen = read.where(both).withColumn("key", key(F.col("source"))).join(counts, "key", "left").select(
        "stamp_id", "zone", "epoch", F.when(day, F.col("dmy")).otherwise(F.col("mdy")).alias("days"), "time", "offset",
        F.when(day | month, "votes").otherwise("default").alias("rule"),
    )
    plain = read.where(~both).select(
        "stamp_id", "zone", "epoch", F.coalesce("dmy", "mdy").alias("days"), "time", "offset", F.when(F.col("epoch").isNotNull(), "epoch").otherwise("plain").alias("rule"),
    )
    rows = chosen.unionByName(plain)
    wall = F.col("days") * F.lit(DAY) + F.col("time")
    local = F.col("offset").isNull() & F.col("zone").isNotNull()
    rows = rows.select("stamp_id", "rule", "epoch", (wall - F.col("offset")).alias("shifted"), F.when(local, wall).alias("wall"), F.when(local, F.col("zone")).otherwise("UTC").alias("zone"))
    rows = rows.withColumn("instant", _instant(F.col("wall"), F.col("zone")))
    again = F.lit(False)
    for hours in LATER:
        later = F.col("instant") + F.lit(hours * HOUR)
        other = F.col("wall") - (_shifted(later, F.col("zone")) - later)  # the same wall time by the clock of some hours later
        again = again | ((other != F.col("instant")) & (_shifted(other, F.col("zone")) == F.col("wall")))
    odd = F.coalesce(again | (_shifted(F.col("instant"), F.col("zone")) != F.col("wall")), F.lit(False))
    utc = F.coalesce("epoch", "shifted", "instant")
    return rows.select(
        "stamp_id", utc.alias("utc_us"), F.when(utc.isNull(), "bad").otherwise(F.col("rule")).alias("rule"),
        (utc.isNotNull() & (F.col("rule").isin("votes", "default") | odd)).alias("ambiguous"),
    )
