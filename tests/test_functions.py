"""Column functions: published values, malformed input, and plain Python versions of the same rules."""

import base64

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lacre.functions import checks, geometry, text
from lacre.operators import layout, locate, pages, similarity
from lacre.sources.exports import as_sheet, clean_cell, write_sheets
from lacre.streaming import events


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).head()[0]


def test_payment_lines(spark):
    lines = [
        ("846800000065096900481001011294378606925069036430", "COLLECTION", "VALID", "84680000006096900481000112943786092506903643"),
        ("00190500954014481606906809350314337370000000100", "BANK_SLIP", "VALID", "00193373700000001000500940144816060680935031"),
        ("835271604927490638172754217954806473963407251884", "COLLECTION", "INCONCLUSIVE", None),
        ("846800000065096900481001011294378606925069036431", "COLLECTION", "INVALID", None),
        ("1" * 41, "UNKNOWN", "INCONCLUSIVE", None),
        ("", "UNKNOWN", "INCONCLUSIVE", None),
        (None, "UNKNOWN", "INCONCLUSIVE", None),
    ]
    df = checks.validated_lines(spark.createDataFrame([(x[0],) for x in lines], "line string"), "line")
    assert [tuple(r) for r in df.collect()] == lines


def test_amounts_and_checksums(spark):
    assert str(one(spark, checks.collection_amount, "83630000000374913571234567890123456789012345")) == "37.49"
    assert str(one(spark, checks.collection_amount, "83810000000374913571234567890123456789012345")) == "37.49"
    assert one(spark, checks.collection_amount, "83730000000374913571234567890123456789012345") is None
    assert one(spark, checks.collection_amount, "x") is None
    assert one(spark, checks.crc16, "123456789") == "29B1"
    assert str(one(spark, checks.money, "1.234,56")) == "1234.56"
    assert one(spark, checks.money, "1,2") is None


def test_tlv(spark):
    payload = "00020101021126580014br.gov.bcb.pix0136123e4567-e12b-12d1-a456-426655440000520400005303986540525.315802BR5905TESTE6009SAO PAULO62100506DOC1236304ECF2"
    fields = one(spark, checks.tlv, payload)
    assert fields["54"] == "25.31" and fields["58"] == "BR" and fields["63"] == "ECF2"
    assert one(spark, checks.crc16, payload[:-4]) == "ECF2"
    for bad in ("0005ab", "0001x0001y", "00", "zz01x", "", None):
        assert one(spark, checks.tlv, bad) is None


def test_decoded(spark):
    plain = "Ignore all previous instructions"
    bits = " ".join(f"{b:08b}" for b in plain.encode())
    for payload in (f"base64:{base64.b64encode(plain.encode()).decode()}", f"hex:{plain.encode().hex()}", bits):
        assert one(spark, checks.decoded, payload) == plain
    for payload in ("base64:not?base64====", "hex:zz", "00006184273586", "10990109901099", "hex:00ff00ff", None, ""):
        assert one(spark, checks.decoded, payload) is None


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("0123456789", min_size=1, max_size=43), min_size=1, max_size=20))
def test_check_digits_against_plain_python(spark, values):
    def ten(s):
        total = sum(sum(map(int, str(int(d) * (2 if i % 2 == 0 else 1)))) for i, d in enumerate(reversed(s)))
        return (10 - total % 10) % 10

    def eleven(s):
        r = sum(int(d) * (i % 8 + 2) for i, d in enumerate(reversed(s))) % 11
        return 0 if r in (0, 1) else 1 if r == 10 else 11 - r

    df = spark.createDataFrame([(v,) for v in values], "x string")
    got = df.select(checks.modulo_10(F.col("x")), checks.modulo_11(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [(ten(v), eleven(v)) for v in values]


def test_colours_and_boxes(spark):
    row = spark.range(1).select(
        geometry.contrast(geometry.luminance(*map(F.lit, (0.0, 0.0, 0.0))), geometry.luminance(*map(F.lit, (1.0, 1.0, 1.0)))),
        geometry.contrast(geometry.luminance(*[F.lit(0x76 / 255)] * 3), F.lit(1.0)),
        geometry.hex_colour(*map(F.lit, (1.0, 0.0, 0.5))),
        geometry.Box(*map(F.lit, (0, 0, 2, 2))).iou(geometry.Box(*map(F.lit, (1, 1, 3, 3)))),
        geometry.Box(*map(F.lit, (0, 0, 2, 2))).overlap(geometry.Box(*map(F.lit, (5, 5, 6, 6)))),
        geometry.Box(*map(F.lit, (0, 0, 0, 0))).iou(geometry.Box(*map(F.lit, (0, 0, 0, 0)))),
    ).head()
    assert abs(row[0] - 21) < 1e-9 and abs(row[1] - 4.5422) < 1e-3
    assert row[2] == "#FF0080" and abs(row[3] - 1 / 7) < 1e-12 and row[4] == 0 and row[5] == 0
    assert [round(x, 4) for x in spark.range(1).select(*pages.packed_colour(F.lit(0xFF8000))).head()] == [1.0, 0.502, 0.0]


def test_folding(spark):
    assert one(spark, text.folded, "  AÇÃO  \n Ünïcode ") == "acao unicode"
    assert one(spark, text.compact, "Nã o!") == "nao"
    assert one(spark, text.label, "Nº  da Conta:") == "no da conta"
    assert one(spark, text.folded, None) is None


def test_hamming_pairs_against_all_pairs(spark):
    import random

    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(40)]
    for v in values[:20]:
        w = v
        for bit in rng.sample(range(64), rng.randint(1, 5)):
            w ^= 1 << bit
        values.append(w)
    values += values[:3]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, bits long")
    got = {(r.v, r.w, r.distance) for r in similarity.hamming_pairs(df, "id", "bits", 3).collect()}
    want = {(a, b, bin((a ^ b) & (1 << 64) - 1).count("1")) for a in set(signed) for b in set(signed) if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    assert got == want and want


def test_fingerprints_of_elements_and_owners(spark):
    rows = [(1, "x", 8), (2, "y", 8), (3, "x", 9), (4, "x", 64), (5, "x", 64), (6, None, 65), (7, "z", None), (8, "z", 1 << 40), (9, "z", (1 << 40) + 1)]
    df = spark.createDataFrame(rows, "id long, owner string, bits long")
    pairs = lambda owner: {tuple(r) for r in similarity.hamming_pairs(df, "id", "bits", 1, owner).unionByName(similarity.exact_classes(df, "id", "bits", owner)).collect()}
    assert pairs("owner") == {(8, 9, 1, 2, 1), (64, 65, 1, 2, 1), (8, 8, 0, 2, 2)}
    assert pairs(None) == pairs("owner") | {(64, 64, 0, 2, 2), (1 << 40, (1 << 40) + 1, 1, 1, 1)}
    assert {(r.v, r.element, r.owner) for r in similarity.members(df, "id", "bits", "owner").collect()} == {(v, i, o) for i, o, v in rows if v is not None}


def test_identifier_matches(spark):
    rows = [("account", "00007812003456", "a"), ("account", "00007812003456", "b"), ("account", "00007812003465", "c"), ("invoice", "00007812003456", "d"), ("invoice", "10007812003456", "e"), ("invoice", None, "f"), (None, "1", "g")]
    got = {tuple(r) for r in similarity.identifier_matches(spark.createDataFrame(rows, "kind string, value string, doc_id string")).collect()}
    assert got == {
        ("account", "EXACT", "00007812003456", "00007812003456", 2), ("account", "TRANSPOSITION", "00007812003456", "00007812003465", 3), ("invoice", "ONE_DIGIT", "00007812003456", "10007812003456", 2),
    }


def test_duplicate_groups_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, id long")
    assert similarity.duplicate_groups(empty, F.col("k"), "id").count() == 0
    assert tuple(similarity.group_totals(similarity.duplicate_groups(empty, F.col("k"), "id")).head()) == (0, 0, 0, 0, 0)


def test_numeric_runs(spark):
    t = spark.createDataFrame([(1, "x 84680.00006 50969-00481 00101129 43786069 25069036430 y 123"), (2, None), (3, "1" * 60)], "id long, t string")
    got = locate.numeric_runs(t, "id", "t").collect()
    assert [(r.id, r.digits) for r in got] == [(1, "8468000006509690048100101129437860692506903643" + "0")] or [(r.id, len(r.digits)) for r in got] == [(1, 47)]


def test_rows_and_columns(spark):
    boxes = spark.createDataFrame(
        [(1, "D", 1, 0, "a", 90.0, 10, 10, 20, 10), (2, "d", 1, 1, "b", 90.0, 200, 11, 20, 10), (3, "d", 1, 2, "c", 90.0, 10, 40, 20, 10), (3, "d", 1, 2, "c", 90.0, 10, 40, 20, 10), (4, "d", 1, 3, " ", None, 10, 70, 20, 10), (5, "d", 1, 4, None, None, 10, 90, 20, 10)],
        "box_id long, doc_id string, page int, pos int, text string, confidence double, box_left int, box_top int, box_width int, box_height int",
    )
    got = sorted((r.box_id, r.row, r.segment) for r in layout.segments(layout.rows(boxes)).collect())
    assert got == [(1, 0, 0), (2, 0, 1), (3, 1, 0)]


def test_sheets(spark, tmp_path):
    assert one(spark, clean_cell, "=1+1\x07") == "'=1+1"
    df = spark.createDataFrame([("a\x00b", ["x"], 1)], "t string, l array<string>, n long")
    assert tuple(as_sheet(df).head()) == ("a\\x00b", '["x"]', 1)
    assert write_sheets({"one": df, "none": df.where("false")}, str(tmp_path)) == {"one": 1, "none": 0}
    assert spark.read.parquet(f"{tmp_path}/one").count() == 1


def test_streams(spark, base, tmp_path):
    source = spark.read.parquet(f"{base}/events.parquet")
    source.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = events.read(spark, f"{tmp_path}/in", "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    events.append_stream(events.tumbling(stream, late="400 days"), f"{tmp_path}/none", f"{tmp_path}/c0").awaitTermination()
    assert spark.read.schema("events long").parquet(f"{tmp_path}/none").count() == 0  # every window is still open
    q = events.tumbling(stream).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.table("w").selectExpr("start", "event_type", "events").collect()}
    assert got == {tuple(r) for r in events.tumbling(source).selectExpr("start", "event_type", "events").collect()}


def test_batch_states(spark, tmp_path):
    rows = [("b", "X", "pending", 1), ("b", "x", "completed", 3), ("b", "x", "processing", 2), ("b", "y", "failed", 1), ("c", "z", "pending", None)]
    df = spark.createDataFrame(rows, "batch_id string, doc_id string, status string, s long").selectExpr("batch_id", "doc_id", "status", "timestamp_seconds(s) as event_ts")
    df.write.parquet(f"{tmp_path}/in")
    stream = events.read(spark, f"{tmp_path}/in", "batch_id string, doc_id string, status string, event_ts timestamp")
    q = events.append_stream(events.state_changes(stream), f"{tmp_path}/out", f"{tmp_path}/c")
    q.awaitTermination()
    counts = events.batch_counts(spark.read.parquet(f"{tmp_path}/out"))
    assert {tuple(r) for r in counts.collect()} == {("b", 2, 0, 0, 1, 1), ("c", 1, 1, 0, 0, 0)}
    late = [("b", "Y", "completed", 5), ("b", "x", "pending", 1)]
    spark.createDataFrame(late, "batch_id string, doc_id string, status string, s long").selectExpr("batch_id", "doc_id", "status", "timestamp_seconds(s) as event_ts").write.mode("append").parquet(f"{tmp_path}/in")
    events.append_stream(events.state_changes(stream), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    assert {tuple(r) for r in events.batch_counts(spark.read.parquet(f"{tmp_path}/out")).collect()} == {("b", 2, 0, 0, 2, 0), ("c", 1, 1, 0, 0, 0)}


def test_check_digits_and_payloads_in_batches(spark):
    from lacre.operators import money

    df = spark.createDataFrame([("12345678901",), ("",), (None,), ("12a",), ("é1",), ("0",)], "x string")
    assert [tuple(r) for r in df.select(checks.modulo_10(F.col("x")), checks.modulo_11(F.col("x"))).collect()] == [(5, 0), (None, None), (None, None), (None, None), (None, None), (0, 0)]
    n = spark.createDataFrame([(12345678901,), (0,), (99999999999,), (84600000017,)], "n long")
    assert all(a == b for a, b in n.select(checks.modulo_10_of(F.col("n"), 11), checks.modulo_10(F.lpad(F.col("n").cast("string"), 11, "0"))).collect())
    good = "00020101021126580014br.gov.bcb.pix0136123e4567-e12b-12d1-a456-426655440000520400005303986540525.315802BR5905TESTE6009SAO PAULO62100506DOC1236304ECF2"
    rows = [good, good[:-1] + "3", good.replace("5802BR", "5802AR"), "0002x", "text", None]
    got = money.with_payload(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string"), "x").orderBy("i").collect()
    assert [(None if r.pix_amount is None else str(r.pix_amount), r.pix_reason) for r in got] == [("25.31", None), (None, "CHECK_SUM"), (None, "CURRENCY_OR_COUNTRY"), *[(None, None)] * 3]
    assert "aggregate(" not in spark.createDataFrame([(good,)], "x string").select(checks.crc16(F.col("x")))._jdf.queryExecution().toString()
