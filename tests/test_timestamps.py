"""Timestamp normalisation against a plain Python reading of the same rules."""

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest

from lacre.operators import timestamps

SITES = [("SP-01", "America/Sao_Paulo", True, "BRT", None), ("NYK-02", "America/New_York", False, "EST", "EDT"), ("SY-07", "Australia/Sydney", True, "AEST", "AEDT"), ("KA-06", "Asia/Kolkata", True, "IST", None)]
UPLOAD, DATE = "upload_id long, doc_id string, site_code string, channel string, uploaded_at string", "date_id long, doc_id string, date_value date, raw_content string, source string, page int, metadata_field string, confidence double"
SITE = "site_code string, tz_name string, day_first boolean, std_abbrev string, dst_abbrev string"


def canon(spark, uploads=(), dates=()):
    up = spark.createDataFrame([(i, "d", s, None, t) for i, (t, s) in enumerate(uploads)], UPLOAD)
    da = spark.createDataFrame([(i, "d", None, t, s, None, None, None) for i, (t, s) in enumerate(dates)], DATE)
    rows = timestamps.found(up, da, spark.createDataFrame(SITES, SITE)).collect()
    return {(r.src, r.rec_id): r.canon for r in rows}


UPLOADS = [
    ("2026-02-20 17:59:33[Europe/Lisbon]", None, "2026-02-20T17:59:33.000000Z"),
    ("2025-07-11T17:24:49.621+01", "SP-01", "2025-07-11T16:24:49.621000Z"),
    ("25 de maio de 2026, 17:39", "SP-01", "2026-05-25T20:39:00.000000Z"),
    ("13 de Março de 2024 às 06h24", "sp-01", "2024-03-13T09:24:00.000000Z"),
    ("20260510T092954Z", None, "2026-05-10T09:29:54.000000Z"),
    ("Mon, 31 Jul 2023 18:29:45 -0700", None, "2023-08-01T01:29:45.000000Z"),
    ("D:20230406172344-03'00'", None, "2023-04-06T20:23:44.000000Z"),
    ("D:20240306100742+05'45", None, "2024-03-06T04:22:42.000000Z"),
    ("2025-12-06 06:59:18 EST", "NYK-02", "2025-12-06T11:59:18.000000Z"),
    ("2025-11-02 01:34:00 EDT", "NYK-02", "2025-11-02T05:34:00.000000Z"),
    ("2025-11-02 01:34", "NYK-02", None),  # twice
    ("2025-03-09 02:07:29", "NYK-02", None),  # never
    ("2025-03-09 03:07:29", "NYK-02", "2025-03-09T07:07:29.000000Z"),
    ("07/01/2023 12:08:09 PM", "NYK-02", "2023-07-01T16:08:09.000000Z"),
    ("07/01/2023 12:08:09", "SP-01", "2023-01-07T15:08:09.000000Z"),
    ("1696612347286", None, "2023-10-06T17:12:27.286000Z"),
    ("1744499698861470", None, "2025-04-12T23:14:58.861470Z"),
    (" 1674049605 ", None, "2023-01-18T13:46:45.000000Z"),
    ("20240103003946", "SP-01", "2024-01-03T03:39:46.000000Z"),
    ("20240103", None, "2024-01-03"),
    ("2025-04-13 01:24:38.907872897", "SP-01", "2025-04-13T04:24:38.907872Z"),
    ("06/10/2024 03h16m25s", "SY-07", "2024-10-05T16:16:25.000000Z"),
    ("2024-05-11 21:34:25 IST", "KA-06", "2024-05-11T16:04:25.000000Z"),
    ("2023-04-26T15:36:05 America/Sao_Paulo", None, "2023-04-26T18:36:05.000000Z"),
    ("2024-03-15T13:29:00", None, None),
    ("2024-07-14T25:61:00Z", "SP-01", None),
    ("2025-02-30 10:15:00", "SP-01", None),
    ("0000-00-00 00:00:00", "SP-01", None),
    ("2025-01-01 10:00:00 Nowhere/City", "SP-01", None),
    ("pendente", "SP-01", None),
    ("", "SP-01", None),
    (None, "SP-01", None),
    ("x" * 100_000, "SP-01", None),
]
DATES = [
    ("14/03/2025", "native_text", "2025-03-14"),
    ("10.02.23", "native_text", "2023-02-10"),
    ("26/9/2O23", "ocr", "2023-09-26"),
    ("14.O1.2023", "ocr", "2023-01-14"),
    ("14.O1.2023", "native_text", None),
    ("10.OUT.2023", "ocr", "2023-10-10"),
    ("14 DE MARÇO DE 2024", "ocr", "2024-03-14"),
    ("1º de abril, 2023", "native_text", "2023-04-01"),
    ("Apr. 30, 2024", "ocr", "2024-04-30"),
    ("January 27, 2026", "ocr", "2026-01-27"),
    (" 20 / 03 / 2023 ", "native_text", "2023-03-20"),
    ("３０/０３/２０２３", "ocr", "2023-03-30"),
    ("D:20250406", "file_system", "2025-04-06"),
    ("D:20240616180241+10'00'", "file_system", "2024-06-16T08:02:41.000000Z"),
    ("26/13/2023", "native_text", None),
    ("D:", "pdf_metadata", None),
    (None, "ocr", None),
]


def test_notations(spark):
    got = canon(spark, [(t, s) for t, s, _ in UPLOADS], [(t, s) for t, s, _ in DATES])
    for i, (text, _, want) in enumerate(UPLOADS):
        assert got.get(("uploads", i)) == want, text and text[:60]
    for i, (text, _, want) in enumerate(DATES):
        assert got.get(("dates", i)) == want, text


def test_wall_clock_against_zoneinfo(spark):
    """Every half hour around the changes of offset: none, one or two instants, as the zone has them."""
    zone = ZoneInfo("America/New_York")
    cases = []
    for begin in (datetime(2024, 3, 10), datetime(2024, 11, 3)):
        for k in range(12):
            t = begin + timedelta(minutes=30 * k)
            instants = set()
            for fold in (0, 1):
                u = t.replace(tzinfo=zone, fold=fold).astimezone(UTC)
                if u.astimezone(zone).replace(tzinfo=None) == t:
                    instants.add(u)
            cases.append((t.isoformat(sep=" "), instants.pop().strftime("%Y-%m-%dT%H:%M:%S.%fZ") if len(instants) == 1 else None))
    got = canon(spark, [(t, "NYK-02") for t, _ in cases])
    assert [got.get(("uploads", i)) for i in range(len(cases))] == [want for _, want in cases]


def test_repeats_empty_and_extra_columns(spark):
    up = spark.createDataFrame([(1, "d", "SP-01", None, "2024-01-01 00:00:00", "z", 1)] * 3, UPLOAD + ", kind string, day int")
    no = spark.createDataFrame([], DATE)
    sites = spark.createDataFrame(SITES, SITE)
    assert [tuple(r) for r in timestamps.found(up, no, sites).collect()] == [("uploads", 1, "2024-01-01T03:00:00.000000Z")]
    assert timestamps.found(spark.createDataFrame([], UPLOAD), no, sites).count() == 0
    assert timestamps.found(up, no, spark.createDataFrame([], SITE)).count() == 0


@pytest.mark.parametrize("zone", ["America/Sao_Paulo", "Europe/Madrid", "Asia/Kathmandu", "Africa/Casablanca"])
def test_zone_intervals_are_gapless(zone):
    spans = timestamps.zone_intervals(zone, (2015, 2030))
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    for begin, end, off, _ in spans:
        for t in (begin, (begin + end) // 2, end - 1):
            assert datetime.fromtimestamp(t, ZoneInfo(zone)).utcoffset().total_seconds() == off


def test_unknown_zone():
    assert timestamps.zone_intervals("Nowhere/City") == []


@pytest.mark.parametrize(
    ("raw", "canon"),
    [
        ("1965-03-01 10:00:00", "1965-03-01T15:00:00.000000Z"),
        ("1965-07-01 10:00:00", "1965-07-01T14:00:00.000000Z"),
        ("1965-03-01 10:00:00 EST", "1965-03-01T15:00:00.000000Z"),
        ("2105-03-01 10:00:00", "2105-03-01T15:00:00.000000Z"),
        ("2105-07-01 10:00:00", "2105-07-01T14:00:00.000000Z"),
        ("2405-07-01 10:00:00", "2405-07-01T14:00:00.000000Z"),
        ("9999-12-31 10:00:00", "9999-12-31T15:00:00.000000Z"),
        ("1790-07-01 12:00:00", "1790-07-01T16:56:02.000000Z"),
        ("2300-07-01 10:00:00 [Europe/London]", "2300-07-01T09:00:00.000000Z"),
        ("2105-03-08 02:30:00", None),
        ("1850-01-01 00:30:00 Asia/Tokyo", "1849-12-31T15:11:01.000000Z"),
        ("2129-01-01 00:30:00 Asia/Tokyo", "2128-12-31T15:30:00.000000Z"),
    ],
)
def test_wall_clocks_of_any_year(spark, raw, canon):
    sites = spark.createDataFrame([("NY1", "America/New_York", False, "EST", "EDT")], "site_code string, tz_name string, day_first boolean, std_abbrev string, dst_abbrev string")
    uploads = spark.createDataFrame([(1, "d", "NY1", "web", raw)], "upload_id long, doc_id string, site_code string, channel string, uploaded_at string")
    dates = spark.createDataFrame([], "date_id long, doc_id string, raw_content string, source string")
    assert [r["canon"] for r in timestamps.found(uploads, dates, sites).collect()] == ([canon] if canon else [])
