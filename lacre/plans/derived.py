"""Inputs that no table holds (decoded codes, hashes of images), derived from the tables by one formula each, with the
same formula in SQL. The engines that make them (decoders, pixel hashes) are outside this library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacre.sources.tables import table


def _hex_bits(test) -> Column:  # noqa: ANN001
    """64 tests of a vector's elements as 16 hexadecimal digits, the first element in the lowest bit."""
    bit = F.transform(F.slice("embedding", 1, 64), lambda x, i: F.when(test(x, i), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.lower(F.lpad(F.hex(F.aggregate(bit, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))), 16, "0"))


def fingerprints(spark: SparkSession, base: str) -> DataFrame:
    """Hashes of a vector's signs, of its elements above 0.05 and under -0.05; every vector has a near copy in another
    document (some of its last hexadecimal digit changed), and every fifth document a second analysis that doesn't count."""
    v = table(spark, base, "embeddings").select(
        "vec_id", _hex_bits(lambda x, i: x > 0).alias("p"), _hex_bits(lambda x, i: x > F.lit(0.05).cast("float")).alias("a"), _hex_bits(lambda x, i: x < F.lit(-0.05).cast("float")).alias("d")
    )
    k = F.col("vec_id")
    last = lambda c, n: F.concat(F.substring(c, 1, 15), F.lower(F.hex(F.conv(F.substring(c, 16, 1), 16, 10).cast("long").bitwiseXOR(n))))
    own = v.select(
        F.concat(F.lit("d"), (k % 40).cast("string")).alias("doc_id"), F.lit(0).alias("analysis_pos"), k.alias("seq"), F.upper("p").alias("perceptual_hash"), F.concat(F.lit(" "), "a").alias("average_hash"),
        F.when(k % 7 != 0, F.col("d")).alias("difference_hash"), F.md5((k % 60).cast("string")).alias("image_hash"), F.lit(640).alias("width"), F.lit(480).alias("height"),
        F.when(k % 4 == 0, "Águas SA").when(k % 4 == 1, " Telefonia").otherwise("").alias("company_name"),
    )
    copy = v.select(
        F.concat(F.lit("d"), ((k * 7 + 3) % 40).cast("string")).alias("doc_id"), F.when(k % 5 == 0, 1).otherwise(0).alias("analysis_pos"), (k + 1_000_000).alias("seq"), last("p", k % 5).alias("perceptual_hash"), last("a", k % 3).alias("average_hash"),
        F.col("d").alias("difference_hash"), F.when(k % 6 == 0, F.md5((k % 60).cast("string"))).alias("image_hash"), F.lit(640).alias("width"), (F.lit(480) + k % 2).cast("int").alias("height"),
        F.when(k % 8 == 0, "águas sa").when(k % 8 == 4, "Energia").otherwise("Telefonia ").alias("company_name"),
    )
    return own.unionByName(copy)


_BITS = "printf('%016x', list_sum(list_transform(embedding, lambda x, i: case when {test} then (1::hugeint << (i - 1)) else 0::hugeint end))::ubigint)"
_LAST = "substr({c}, 1, 15) || printf('%x', xor(('0x' || substr({c}, 16, 1))::bigint, {n}))"
FINGERPRINTS = (
    f"with v as (select vec_id k, {_BITS.format(test='x > 0')} p, {_BITS.format(test='x > 0.05::float')} a, {_BITS.format(test='x < (-0.05)::float')} d from embeddings), "
    "raw as (select 'd' || (k % 40) doc_id, 0 analysis_pos, k seq, p, a, case when k % 7 <> 0 then d end d, md5((k % 60)::varchar) image_hash, 640 width, 480 height, case k % 4 when 0 then 'Águas SA' when 1 then ' Telefonia' else '' end company_name from v union all "
    f"select 'd' || ((k * 7 + 3) % 40), case when k % 5 = 0 then 1 else 0 end, k + 1000000, {_LAST.format(c='p', n='k % 5')}, {_LAST.format(c='a', n='k % 3')}, d, case when k % 6 = 0 then md5((k % 60)::varchar) end, 640, (480 + k % 2)::int, "
    "case k % 8 when 0 then 'águas sa' when 4 then 'Energia' else 'Telefonia ' end from v), "
    "o as (select * from raw join (select doc_id, min(analysis_pos) analysis_pos from raw group by 1) using (doc_id, analysis_pos)) "
)


def barcodes(spark: SparkSession, base: str) -> DataFrame:
    """Codes of orders: document of the customer's nation and segment, four formats, some without a place."""
    k = F.col("o_orderkey")
    form = F.when(k % 4 == 0, "ITF").when(k % 4 == 1, "QR_CODE").when(k % 4 == 2, "qr").otherwise("Code 39")
    content = F.when(k % 4 == 0, F.concat(F.lit("8"), F.lpad((k % 900).cast("string"), 43, "0"))).when(k % 19 == 0, " ").otherwise(F.concat(F.lit("V"), (k % 500).cast("string")))
    at = lambda n, most: F.when(k % 17 != 0, ((k * n) % most).cast("double"))
    return table(spark, base, "orders").select(
        F.concat(F.lit("c"), (F.col("o_custkey") % 200).cast("string")).alias("doc_id"), k.alias("barcode_index"), (k % 3 + 1).cast("int").alias("page"), form.alias("format"), content.alias("content"),
        F.when(k % 5 != 0, F.md5((k % 300).cast("string"))).alias("image_hash"), at(37, 500).alias("x"), at(53, 700).alias("y"), at(0, 1).alias("_0"), F.when(k % 23 == 0, "enhanced").otherwise("baseline").alias("pass"),
    ).withColumns({"w": F.when(F.col("_0").isNotNull(), 120.0), "h": F.when(F.col("_0").isNotNull(), 40.0)}).drop("_0")


BARCODES = (
    "bc as (select 'c' || (o_custkey % 200) doc_id, o_orderkey k, o_orderkey barcode_index, (o_orderkey % 3 + 1)::int page, case o_orderkey % 4 when 0 then 'ITF' when 1 then 'QR_CODE' when 2 then 'qr' else 'Code 39' end format, "
    "case when o_orderkey % 4 = 0 then '8' || lpad((o_orderkey % 900)::varchar, 43, '0') when o_orderkey % 19 = 0 then ' ' else 'V' || (o_orderkey % 500) end as content, case when o_orderkey % 5 <> 0 then md5((o_orderkey % 300)::varchar) end image_hash, "
    "case when o_orderkey % 17 <> 0 then ((o_orderkey * 37) % 500)::double end x, case when o_orderkey % 17 <> 0 then ((o_orderkey * 53) % 700)::double end y, case when o_orderkey % 17 <> 0 then 120.0::double end w, "
    "case when o_orderkey % 17 <> 0 then 40.0::double end h, case when o_orderkey % 23 = 0 then 'enhanced' else 'baseline' end pass from orders) "
)


def backgrounds(spans: DataFrame) -> DataFrame:
    """Backgrounds of spans: white, dark for every seventh, unknown for every tenth."""
    k = F.col("span_id")
    dark = F.pow((F.lit(0.2) + 0.055) / 1.055, F.lit(2.4))
    return spans.select("span_id", F.when(k % 10 != 9, F.when(k % 7 == 0, dark).otherwise(1.0)).alias("background"), (0.55 + (k % 9) / 20).alias("dominance")).distinct()
