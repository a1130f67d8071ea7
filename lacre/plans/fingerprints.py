"""Queries of image, logo and matrix-code fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacre.operators import images
from lacre.plans.derived import BARCODES, FINGERPRINTS, barcodes, fingerprints
from lacre.plans.register import query


def _occurrences(spark: SparkSession, base: str) -> DataFrame:
    return images.occurrences(fingerprints(spark, base))


_O = FINGERPRINTS + ", n as (select doc_id, seq, lower(trim(p)) p, lower(trim(a)) a, lower(trim(d)) d, image_hash, width, height, company_name from o) "
_NAMED = {"image": "", "logo": ", company_name"}


def _classes(kind: str) -> str:
    extra = _NAMED[kind]
    return _O + (
        f", c as (select p, a, d, image_hash, width, height{extra}, min(seq) cls, count(*) members, count(distinct doc_id) documents, min(doc_id) lo, max(doc_id) hi from n group by p, a, d, image_hash, width, height{extra}), "
        "x as (select *, ('0x' || p)::ubigint pb, ('0x' || a)::ubigint ab, ('0x' || d)::ubigint db from c), "
        "r as (select i.cls first_class, j.cls second_class, coalesce(i.image_hash = j.image_hash, false) as exact, bit_count(xor(i.pb, j.pb))::bigint p_distance, bit_count(xor(i.ab, j.ab))::bigint a_distance, "
        "bit_count(xor(i.db, j.db))::bigint d_distance, (i.width = j.width and i.height = j.height) same_dimensions, abs(i.height - j.height)::bigint as height_delta"
        + (", lower(trim(i.company_name)) ni, lower(trim(j.company_name)) nj" if extra else "")
        + " from x i join x j on i.cls < j.cls or (i.cls = j.cls and i.documents > 1) where (i.cls = j.cls or i.lo <> j.hi or j.lo <> i.hi) and (bit_count(xor(i.pb, j.pb)) <= 3 or i.image_hash = j.image_hash)), "
        "m as (select *, case when exact then 'EXACT' when 1 - p_distance / 64.0 >= 0.98 then 'STRONG' when 1 - p_distance / 64.0 >= 0.95 then 'MODERATE' end as match from r) "
    )


def _code(prefix: str) -> str:
    return f"case match when 'EXACT' then '{prefix}_EXACT_MATCH' when 'STRONG' then '{prefix}_STRONG_VISUAL_MATCH' else '{prefix}_VISUAL_MATCH' end"


_SEVERITY = "case when match = 'EXACT' then 'INFO' when match = 'STRONG' and same_dimensions then 'MEDIUM' else 'LOW' end"
_CONFIDENCE = "round(case when match = 'EXACT' then 1.0 else 1 - p_distance / 64.0 end, 6)::double as confidence"


@query(_classes("image") + "select first_class, second_class, exact, p_distance, a_distance, d_distance, same_dimensions, height_delta from m")
def image_comparisons(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of image classes in different documents, compared by all hashes and sizes."""
    r = images.related(images.classes(_occurrences(spark, base)), images.max_distance(64, 0.95))
    return r.select(F.col("cls_x").alias("first_class"), F.col("cls_y").alias("second_class"), "exact", "p_distance", "a_distance", "d_distance", "same_dimensions", F.col("height_delta").cast("long").alias("height_delta"))


@query(_classes("image") + f"select first_class, second_class, match as classification, {_code('IMAGE')} as code, {_SEVERITY} as severity, {_CONFIDENCE} from m where match is not null")
def image_findings(spark: SparkSession, base: str) -> DataFrame:
    f = images.image_findings(images.related(images.classes(_occurrences(spark, base))))
    return f.select(F.col("cls_x").alias("first_class"), F.col("cls_y").alias("second_class"), F.col("match").alias("classification"), "code", "severity", F.round("confidence", 6).alias("confidence"))


@query(_O + "select c.cls, n.seq, n.doc_id from n join (select p, a, d, image_hash, width, height, min(seq) cls from n group by all) c on n.p = c.p and n.a = c.a and n.d is not distinct from c.d and n.image_hash is not distinct from c.image_hash and n.width = c.width and n.height = c.height")
def image_members(spark: SparkSession, base: str) -> DataFrame:
    """The occurrences that each class of image_findings stands for."""
    return images.members(_occurrences(spark, base))


@query(
    _classes("logo")
    + ", k as (select *, case when ni <> '' and nj <> '' then ni = nj end as same_company_name from m where match is not null) select first_class, second_class, same_company_name, "
    + f"case when same_company_name = false then 'LOGO_COMPANY_NAME_MISMATCH' else {_code('LOGO')} end as code, case when same_company_name = false then case when match in ('EXACT', 'STRONG') then 'HIGH' else 'MEDIUM' end else {_SEVERITY} end as severity, {_CONFIDENCE} from k"
)
def logo_findings(spark: SparkSession, base: str) -> DataFrame:
    f = images.logo_findings(images.related(images.classes(_occurrences(spark, base), "company_name")))
    return f.select(F.col("cls_x").alias("first_class"), F.col("cls_y").alias("second_class"), "same_company_name", "code", "severity", F.round("confidence", 6).alias("confidence"))


@query(
    _classes("image") + ", s as (select count(*) n from n), q as (select sum(c) rows, sum(c * c) squares from (select doc_id, count(*) c from n group by 1)), f as (select count(*) k from m where match is not null) "
    "select ((rows * rows - squares) / 2)::bigint as potential_pairs, k as class_pairs, round(1 - k / ((rows * rows - squares) / 2), 6)::double as reduction_ratio from q, f"
)
def candidate_reduction(spark: SparkSession, base: str) -> DataFrame:
    """How many comparisons the candidate search leaves of all pairs of different documents; 0 where there is no pair."""
    o = _occurrences(spark, base)
    n = o.groupBy("doc_id").agg(F.count("*").alias("c")).agg(F.sum("c").alias("rows"), F.sum(F.col("c") * F.col("c")).alias("squares"))
    k = images.image_findings(images.related(images.classes(o))).agg(F.count("*").alias("class_pairs"))
    p = ((F.col("rows") * F.col("rows") - F.col("squares")) / 2).cast("long")
    j = n.crossJoin(F.broadcast(k)).select(p.alias("potential_pairs"), "class_pairs")  # one row each
    return j.withColumn("reduction_ratio", F.when(F.col("potential_pairs") > 0, F.round(1 - F.col("class_pairs") / F.col("potential_pairs"), 6)).otherwise(0.0))


_HASHES = _O + "select seq, unnest(['sha256', 'phash', 'ahash', 'dhash']) as hash_type, unnest([image_hash, p, a, d]) as value from n"


@query(f"select * from ({_HASHES}) where value is not null")
def image_hashes(spark: SparkSession, base: str) -> DataFrame:
    """The hashes of all images as rows."""
    return images.unpivoted(_occurrences(spark, base), "seq").select("seq", "hash_type", "value")


@query(_O + "select seq, doc_id, (seq % 3)::bigint as page, width, height, image_hash, p as perceptual_hash, a as average_hash, d as difference_hash from n")
def image_fingerprints(spark: SparkSession, base: str) -> DataFrame:
    """Fingerprints assembled from hashes in rows and the images' sizes."""
    o = _occurrences(spark, base).withColumn("page", F.col("seq") % 3)
    return images.assembled(images.unpivoted(o, "seq"), o, "seq")


_QR = "qr as (select doc_id, barcode_index, page, content as value, lower(trim(image_hash)) image_hash, x, y, w, h, 1.0::double as confidence from bc where replace(replace(lower(trim(format)), '-', ''), '_', '') in ('qr', 'qrcode') and x is not null) "


@query("with " + BARCODES + ", " + _QR + "select * from qr")
def code_fingerprints(spark: SparkSession, base: str) -> DataFrame:
    return images.code_fingerprints(barcodes(spark, base))


@query(
    "with " + BARCODES + ", " + _QR + ", f as (select distinct doc_id, lower(trim(value)) as value, nullif(image_hash, '') image_hash from qr where trim(value) <> '') "
    "select 'QRCODE_EXACT_MATCH' as code, 'INFO' as severity, 'EXACT' as classification, value, image_hash, count(distinct doc_id) as documents, 1::bigint as linked from f where image_hash is not null group by value, image_hash having count(distinct doc_id) > 1 union all "
    "select 'QRCODE_REGENERATED', 'LOW', 'STRONG', value, null, count(distinct doc_id), count(distinct coalesce(image_hash, '')) from f group by value having count(distinct doc_id) > 1 and count(distinct coalesce(image_hash, '')) > 1 union all "
    "select 'QRCODE_VALUE_MISMATCH', 'HIGH', 'MODERATE', null, image_hash, count(distinct doc_id), count(distinct value) from f where image_hash is not null group by image_hash having count(distinct doc_id) > 1 and count(distinct value) > 1"
)
def code_findings(spark: SparkSession, base: str) -> DataFrame:
    return images.code_findings(images.code_fingerprints(barcodes(spark, base)))


@query(
    _O.replace("with v as", "with " + BARCODES + ", " + _QR + ", v as", 1)
    + ", i as (select doc_id, string_agg(distinct image_hash, ',' order by image_hash) as images from n where image_hash is not null group by 1), c as (select doc_id, string_agg(distinct value, ',' order by value) as codes from qr group by 1) "
    "select doc_id, md5(doc_id) as sha256, coalesce(images, '') as images, coalesce(codes, '') as codes from (select distinct doc_id from n union select distinct doc_id from qr) left join i using (doc_id) left join c using (doc_id)"
)
def document_fingerprints(spark: SparkSession, base: str) -> DataFrame:
    """One row for each document with its digest, image hashes and code values."""
    o, c = _occurrences(spark, base), images.code_fingerprints(barcodes(spark, base))
    d = o.select("doc_id").union(c.select("doc_id")).distinct().withColumn("sha256", F.md5("doc_id"))
    f = images.document_fingerprints(d, o, c)
    return f.select("doc_id", "sha256", F.array_join("images", ",").alias("images"), F.array_join("codes", ",").alias("codes"))
