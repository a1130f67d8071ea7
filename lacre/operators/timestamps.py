"""Mixed timestamp notations and time zones to one unambiguous form.

Every text is parsed by one regular expression in the JVM into calendar and clock parts; what remains open is the
zone offset. Wall-clock times meet a table of zone-offset intervals in local time, exploded to the calendar years they
touch, so the as-of join is an equi-join on (zone, year): two matching intervals mean the time occurs twice, none means
it never occurs, one gives the offset. The table covers all IANA zones and the years of YEARS. Before them every zone
keeps one offset; after them the rules repeat with the calendar, so a later year is looked up as the year of LATER with
the same length that begins on the same day of the week: any year from 1 to 9999 has its offset.

Defined results: null, empty and unparsable texts, impossible dates or times, unknown zones, and wall-clock times without
a zone or site yield no row; repeated records yield one row; texts of any length are matched as a whole (a longer text
around a date is no timestamp); extra columns are ignored.
"""

from __future__ import annotations

from calendar import isleap
from collections.abc import Iterator
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacre.functions.once import step

#: Month names by their first three letters (Portuguese, English, Spanish), accents removed.
MONTHS = {
    "jan": 1, "ene": 1, "fev": 2, "feb": 2, "mar": 3, "abr": 4, "apr": 4, "mai": 5, "may": 5, "jun": 6, "jul": 7,
    "ago": 8, "aug": 8, "set": 9, "sep": 9, "out": 10, "oct": 10, "nov": 11, "dez": 12, "dec": 12, "dic": 12,
}
#: First and last year of the interval table, and the years in it that stand for all later ones: a whole cycle of the
#: calendar (28 years without a skipped leap year), past the last transition that is listed singly.
YEARS, LATER = (1850, 2128), (2101, 2128)
FULL_WIDTH = "".join(chr(0xFF01 + i) for i in range(94))
ASCII = "".join(chr(0x21 + i) for i in range(94))
BLANKS = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
INVISIBLE = "\u00ad\u200b-\u200f\u2060\ufeff"

_CLOCK = r"(\d{1,2})(?::|h)(\d{2})(?:(?::|m(?:in)?)(\d{2})s?)?(?:[.,](\d{1,12}))?(?: ?(am|pm|a\.m\.|p\.m\.)(?![a-z]))?(?:h(?:rs)?|min)?"
_ZONE = (
    r"(?: ?(z|utc|gmt)| ?\(?([+\-−])(\d{2})(?::?(\d{2})|'(\d{2})'?)?\)?)?(?: ?\[?([a-z_]+(?:/[a-z0-9_+\-]+)+)\]?)?(?: ?\(?([a-z]{2,5})\)?)?"
)
PATTERN = (
    r"(?iu)^(?:[a-zà-ú]{3,}(?:-feira)?\.?,? )?(?:"
    r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})"  # 1-3 year first
    r"|(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})"  # 4-6 day or month first
    r"|(\d{1,2})(?:º|°|ª|o|st|nd|rd|th)?[ /.-]+(?:de |of )?([a-zç]{3,})\.?,?[ /.-]+(?:de |del )?(\d{4}|\d{2})"  # 7-9
    r"|([a-zç]{3,})\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})"  # 10-12 month name first
    r"|(?:d:)?(\d{4})(\d{2})(\d{2})(?:t?(\d{2})(\d{2})(\d{2})?(?:[.,](\d{1,12}))?)?"  # 13-19 compact
    r")(?:(?:t|,? | - |, ?| às | as | at | a las )" + _CLOCK + r")?" + _ZONE + r"$"  # 20-24 clock, 25-31 zone
)
GROUPS = 31


def zone_intervals(zone: str, years: tuple[int, int] = YEARS) -> list[tuple[int, int, int, int]]:
    """(utc_from, utc_to, offset, dst) in seconds for one IANA zone; an unknown zone has no intervals.

    Listed transitions are read from the zone's compiled file; where a rule goes on after the last of them, changes are
    looked for every four weeks and their second by bisection (every week without a list).
    """
    import zoneinfo

    try:
        tz = zoneinfo.ZoneInfo(zone)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError, IsADirectoryError):
        return []

    def at(t: int) -> tuple[int, int]:
        local = datetime.fromtimestamp(t, tz)
        return int(local.utcoffset().total_seconds()), int((local.dst() or timedelta()).total_seconds())

    begin = int(datetime(years[0], 1, 1, tzinfo=UTC).timestamp()) - 2 * 86400  # local years begin earlier or later
    end = int(datetime(years[1] + 1, 1, 1, tzinfo=UTC).timestamp()) + 2 * 86400
    listed, ruled = _transitions(zone)
    cuts = [(begin, *at(begin))]
    for t in listed:
        if begin < t < end and (now := at(t)) != cuts[-1][1:]:
            cuts.append((t, *now))
    t = max([begin, *(x for x in listed if x < end)])
    stride = (28 if listed else 7) * 86400  # rules of a year change at most every few months
    while ruled and t < end:
        step = min(t + stride, end)
        now = cuts[-1][1:]
        if at(step) != now:
            low, high = t, step
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if at(middle) == now else (low, middle)
            cuts.append((high, *at(high)))
            t = high
        else:
            t = step
    return [(a[0], b[0], a[1], a[2]) for a, b in zip(cuts, [*cuts[1:], (end, 0, 0)], strict=True)]


def _transitions(zone: str) -> tuple[list[int], bool]:
    """Seconds of a zone's listed transitions (version 2 of the TZif format, RFC 8536), and whether a rule with summer
    time goes on after them. Without a readable file: no list, and a rule, so all years are searched."""
    import struct
    import zoneinfo
    from pathlib import Path

    for folder in zoneinfo.TZPATH:
        try:
            raw = Path(folder, zone).read_bytes()
        except OSError:
            continue
        if raw[:4] != b"TZif" or raw[4:5] < b"2":
            break
        utc, std, leaps, times, types, chars = struct.unpack(">6l", raw[20:44])
        second = 44 + times * 5 + types * 6 + chars + leaps * 8 + std + utc
        utc, std, leaps, times, types, chars = struct.unpack(">6l", raw[second + 20 : second + 44])
        body = second + 44
        footer = raw[body + times * 9 + types * 6 + chars + leaps * 12 + std + utc :]
        return list(struct.unpack(f">{times}q", raw[body : body + 8 * times])), b"," in footer
    return [], True


def offset_intervals(spark: SparkSession) -> DataFrame:
    """One row for each (zone_key, local_year) with the array of offset intervals that touch the year.

    Bounded: the IANA list has some 600 names, YEARS 279 years: under 180,000 small rows, whatever the data. The names
    are dealt over tasks.
    """
    import zoneinfo

    def spans(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = [(z.lower(), a + o, b + o, o, d) for z in batch["zone"] for a, b, o, d in zone_intervals(z)]
            yield pd.DataFrame(rows, columns=["zone_key", "lo", "hi", "off", "dst"])

    year = lambda c: F.year(F.date_from_unix_date(F.floor((F.col(c) if isinstance(c, str) else c) / 86400).cast("int")))
    names = spark.createDataFrame([(z,) for z in sorted(zoneinfo.available_timezones())], "zone string")
    return (
        names.repartition(8, "zone")
        .mapInPandas(spans, "zone_key string, lo long, hi long, off int, dst int")
        .withColumn("local_year", F.explode(F.sequence(F.greatest(year("lo"), F.lit(YEARS[0])), F.least(year(F.col("hi") - 1), F.lit(YEARS[1])))))
        .groupBy("zone_key", "local_year")
        .agg(F.collect_list(F.struct("lo", "hi", "off", "dst")).alias("spans"))
    )


def listed_year(year: Column) -> Column:
    """The year of the interval table that a year is looked up as."""
    stands = {(isleap(y), date(y, 1, 1).weekday()): y for y in range(LATER[0], LATER[1] + 1)}
    like = F.array(*(F.lit(stands[leap, day]) for leap in (False, True) for day in range(7)))
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    place = F.weekday(F.make_date(year, F.lit(1), F.lit(1))) + F.when(leap, 7).otherwise(0)
    return F.when(year < YEARS[0], YEARS[0]).when(year > YEARS[1], F.get(like, place)).otherwise(year)


def _int(c: Column) -> Column:
    return c.try_cast("int")


def parse(df: DataFrame, text: str, ocr: Column, day_first: Column) -> DataFrame:
    """Adds kind ('day', 'utc', 'offset', 'zone', 'abbr' or 'wall'), y, mo, d, local_s, frac_us, off_s, zone_text, abbr.

    ocr: where letters may stand for digits. day_first: order of numeric day and month; null accepts only texts whose
    two readings can't both be dates or are the same.
    """
    t = F.translate(F.col(text), FULL_WIDTH, ASCII)
    t = F.trim(F.regexp_replace(F.regexp_replace(t, f"[{INVISIBLE}]", ""), f"[\\s{BLANKS}]+", " "))
    read = t
    for letters, digit in (("OoQ", "0"), ("lI|i", "1"), ("Ss", "5"), ("B", "8"), ("Zz", "2")):
        read = F.regexp_replace(read, f"(?<=\\d)[{letters}]|(?<![A-Za-zÀ-ú])[{letters}](?=[\\d/.-])", digit)
    t = F.when(ocr, read).otherwise(t)
    t = F.regexp_replace(t, r"(?<=\d) ?([/.]) ?(?=\d)", "$1")
    df = step(df, _t=t)
    digits = F.col("_t").rlike(r"^\d+$")
    n = F.length("_t")
    epoch = digits & n.isin(10, 13, 16)
    parts = F.split(F.regexp_replace("_t", PATTERN, "|".join(f"${i}" for i in range(1, GROUPS + 1))), r"\|", -1)
    df = step(df, _p=F.when(~epoch & F.col("_t").rlike(PATTERN), parts))
    g = lambda i: F.col("_p")[i - 1]
    has = lambda i: g(i) != ""
    name = lambda c: F.substring(F.translate(F.lower(c), "çãáéíóúâêô", "caaeiouaeo"), 1, 3)
    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    a, b = _int(g(4)), _int(g(5))
    first = F.when(day_first.isNotNull(), day_first).when(a == b, F.lit(True)).when((a > 12) & (b <= 12), F.lit(True)).when((b > 12) & (a <= 12), F.lit(False))
    yy = lambda c: F.when(F.length(c) == 2, 2000 + _int(c)).otherwise(_int(c))
    y = F.when(has(1), _int(g(1))).when(has(4), yy(g(6))).when(has(7), yy(g(9))).when(has(10), _int(g(12))).when(has(13), _int(g(13)))
    mo = F.when(has(1), _int(g(2))).when(has(4), F.when(first, b).when(~first, a)).when(has(7), months[name(g(8))]).when(has(10), months[name(g(10))]).when(has(13), _int(g(14)))
    d = F.when(has(1), _int(g(3))).when(has(4), F.when(first, a).when(~first, b)).when(has(7), _int(g(7))).when(has(10), _int(g(11))).when(has(13), _int(g(15)))
    half = F.lower(F.substring(g(24), 1, 1))
    hour = F.when(has(16), _int(g(16))).when(has(24), F.when(_int(g(20)).between(1, 12), _int(g(20)) % 12 + F.when(half == "p", 12).otherwise(0))).otherwise(_int(g(20)))
    minute = F.when(has(16), _int(g(17))).otherwise(_int(g(21)))
    second = F.coalesce(F.when(has(16), F.when(has(18), _int(g(18))).otherwise(0)).otherwise(F.when(has(22), _int(g(22))).otherwise(0)))
    frac = F.when(has(19), g(19)).when(has(23), g(23)).otherwise("")
    timed = has(16) | has(20)
    first_read = step(df, y=y, mo=mo, d=d, _h=hour, _m=minute, _s=second, frac_us=_int(F.rpad(F.substring(frac, 1, 6), 6, "0")))
    df = first_read.withColumns({"_timed": timed, "_once": ~(has(16) & has(20))})
    leap = ((F.col("y") % 4 == 0) & (F.col("y") % 100 != 0)) | (F.col("y") % 400 == 0)
    last = F.when(F.col("mo") == 2, F.when(leap, 29).otherwise(28)).when(F.col("mo").isin(4, 6, 9, 11), 30).otherwise(31)
    date_ok = F.col("_once") & F.col("y").between(1, 9999) & F.col("mo").between(1, 12) & F.col("d").between(1, last)
    time_ok = F.col("_h").between(0, 23) & F.col("_m").between(0, 59) & F.col("_s").between(0, 59)
    zh, zm = _int(g(27)), F.coalesce(_int(F.when(has(28), g(28)).when(has(29), g(29))), F.lit(0))
    offset_ok = (zh <= 15) & (zm <= 59)
    off = F.when(g(26) == "+", 1).otherwise(-1) * (zh * 3600 + zm * 60)
    day = F.unix_date(F.make_date("y", "mo", "d")).cast("long")
    local = day * 86400 + F.col("_h") * 3600 + F.col("_m") * 60 + F.col("_s")
    number = F.col("_t").try_cast("long")
    zoned = has(25) | has(26) | has(30) | has(31)
    kind = (
        F.when(epoch, "utc")
        .when(F.col("_p").isNull() | ~F.coalesce(date_ok, F.lit(False)), F.lit(None))
        .when(~F.col("_timed"), F.when(~zoned, "day"))
        .when(~F.coalesce(time_ok, F.lit(False)), F.lit(None))
        .when(has(25), "utc")
        .when(has(26), F.when(offset_ok, "offset"))
        .when(has(30), "zone")
        .when(has(31), "abbr")
        .otherwise("wall")
    )
    df = step(df, kind=kind)
    ok = F.col("kind").isNotNull()
    dated = ok & ~epoch
    dropped = ("_p", "_t", "_h", "_m", "_s", "_timed", "_once", "frac_us")
    out = step(
        df.withColumnRenamed("frac_us", "_frac"),
        day=F.when(dated & (F.col("kind") == "day"), day),
        local_s=F.when(epoch, F.floor(number / F.when(n == 10, 1).when(n == 13, 1000).otherwise(1000000))).when(dated & (F.col("kind") != "day"), local),
        frac_us=F.when(epoch, F.when(n == 10, 0).when(n == 13, (number % 1000) * 1000).otherwise(number % 1000000)).otherwise(F.col("_frac")).cast("int"),
        off_s=F.when(F.col("kind") == "offset", off).when(F.col("kind") == "utc", 0),
        zone_text=F.when(F.col("kind") == "zone", F.lower(g(30))),
        abbr=F.when(F.col("kind") == "abbr", F.upper(g(31))),
    )
    return out.drop(*dropped[:-1], "_frac")


def canonical_instant(local_s: Column, frac_us: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ss.SSSSSSZ of seconds since 1970 UTC, whatever the session's zone."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    s = F.pmod(local_s, F.lit(86400))
    date = F.date_from_unix_date(F.floor(local_s / 86400).cast("int")).cast("string")
    return F.concat(date, F.lit("T"), two(F.floor(s / 3600)), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60), F.lit("."), F.lpad(frac_us.cast("string"), 6, "0"), F.lit("Z"))


def resolve(records: DataFrame, sites: DataFrame) -> DataFrame:
    """Parsed records (with site_code) -> the same with canon, only where exactly one moment or day is stated."""
    site = sites.select(F.upper(F.trim("site_code")).alias("_site"), F.lower("tz_name").alias("_site_zone"), F.upper("std_abbrev").alias("_std"), F.upper("dst_abbrev").alias("_dst"))
    r = records.where(F.col("kind").isNotNull()).withColumn("_site", F.upper(F.trim("site_code")))
    r = r.join(F.broadcast(site.dropDuplicates(["_site"])), "_site", "left")  # sites: a fixed table of 24 rows
    own = F.when(F.col("abbr") == F.col("_std"), F.lit(False)).when(F.col("abbr") == F.col("_dst"), F.lit(True))
    listed = (
        site.select(F.col("_std").alias("abbr"), F.col("_site_zone").alias("_zone"), F.lit(False).alias("_summer"))
        .unionByName(site.select(F.col("_dst").alias("abbr"), F.col("_site_zone").alias("_zone"), F.lit(True).alias("_summer")))
        .where(F.col("abbr").isNotNull()).distinct()
        .groupBy("abbr").agg(F.count("*").alias("_n"), F.first("_zone").alias("_abbr_zone"), F.first("_summer").alias("_abbr_summer"))
        .where("_n = 1").drop("_n")
    )
    r = r.withColumn("_own", own).join(F.broadcast(listed), "abbr", "left")  # at most two for each site
    stated = F.year(F.date_from_unix_date(F.floor(F.col("local_s") / 86400).cast("int")))
    r = step(
        r,
        _summer=F.coalesce("_own", "_abbr_summer"),
        zone_key=F.when(F.col("kind") == "zone", F.col("zone_text"))
        .when(F.col("kind") == "abbr", F.when(F.col("_own").isNotNull(), F.col("_site_zone")).otherwise(F.col("_abbr_zone")))
        .when(F.col("kind") == "wall", F.col("_site_zone")),
        _year=stated,
        local_year=listed_year(stated),
    )
    began = lambda c: F.unix_date(F.make_date(c, F.lit(1), F.lit(1))).cast("long")
    moved = F.when(F.col("_year") == F.col("local_year"), F.col("local_s")).otherwise(F.col("local_s") + (began("local_year") - began("_year")) * 86400)
    # fixed size: all zones and years, see offset_intervals
    r = step(r, _listed_s=moved).join(F.broadcast(offset_intervals(records.sparkSession)), ["zone_key", "local_year"], "left")
    hits = F.filter("spans", lambda x: (x["lo"] <= F.col("_listed_s")) & (F.col("_listed_s") < x["hi"]))
    standard = F.array_min(F.transform("spans", lambda x: x["off"] - x["dst"]))
    now_standard = F.coalesce(F.get(F.transform(hits, lambda x: x["off"] - x["dst"]), F.lit(0)), standard)
    summer = F.array_max(F.transform(F.filter("spans", lambda x: x["dst"] != 0), lambda x: x["off"]))
    off = (
        F.when(F.col("kind").isin("utc", "offset"), F.col("off_s"))
        .when(F.col("kind") == "abbr", F.when(F.col("_summer"), F.coalesce(summer, standard + 3600)).otherwise(now_standard))
        .when(F.size(hits) == 1, hits[0]["off"])
    )
    r = step(r, _off=off)
    instant = F.when(F.col("_off").isNotNull(), canonical_instant(F.col("local_s") - F.col("_off"), F.col("frac_us")))
    day = F.date_from_unix_date(F.col("day").cast("int")).cast("string")
    return step(r, canon=F.when(F.col("kind") == "day", day).otherwise(instant)).where("canon is not null")


def found(uploads: DataFrame, dates: DataFrame, sites: DataFrame) -> DataFrame:
    """src, rec_id, canon of every record of both tables that states exactly one moment or day."""
    order = sites.select(F.upper(F.trim("site_code")).alias("_code"), "day_first").dropDuplicates(["_code"])
    up = uploads.select(F.lit("uploads").alias("src"), F.col("upload_id").alias("rec_id"), F.col("uploaded_at").alias("raw"), "site_code", F.lit(False).alias("ocr"))
    up = up.withColumn("_code", F.upper(F.trim("site_code"))).join(F.broadcast(order), "_code", "left").drop("_code")
    da = dates.select(
        F.lit("dates").alias("src"), F.col("date_id").alias("rec_id"), F.col("raw_content").alias("raw"), F.lit(None).cast("string").alias("site_code"),
        F.coalesce(F.lower("source") == "ocr", F.lit(False)).alias("ocr"), F.lit(True).alias("day_first"),
    )
    parsed = parse(up.unionByName(da), "raw", F.col("ocr"), F.col("day_first"))
    return resolve(parsed, sites).select("src", "rec_id", "canon").distinct()
