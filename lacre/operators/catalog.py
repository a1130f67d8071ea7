"""Long-form catalogue of document elements: deterministic ids, lineage, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacre.operators.batches import first_analyses

#: Fixed value: the namespace of element ids.
NAMESPACE = "8b0bd7dd81184e8da51f3a49da0c9377"


def element_id(document: Column, key: Column) -> Column:
    """Version 5 UUID of "document:key" (lower case), from SHA-1, in the JVM."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), F.encode(F.concat(F.lower(document), F.lit(":"), F.lower(F.trim(key))), "utf-8")))
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.substr(variant, nibble, F.lit(1)), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def elements(analyses: DataFrame, spans: DataFrame, boxes: DataFrame) -> DataFrame:
    """element_id, doc_id, element_type, subtype, value, parent_id, layer, page of documents, digests, texts and boxes."""
    text = F.coalesce(F.when(F.trim("native_text") != "", F.col("native_text")), F.col("ocr_text"))
    a = first_analyses(analyses.where("doc_id is not null")).select(F.lower("doc_id").alias("doc_id"), F.regexp_extract(F.lower("sha256"), "([0-9a-f]{64})", 1).alias("sha"), text.alias("t"))
    root = element_id(F.col("doc_id"), F.lit("document"))

    def row(kind: str, subtype: str | None, value: Column, key: Column, parent: Column | None, layer: str, page: Column | None = None) -> list[Column]:
        return [
            element_id(F.col("doc_id"), key).alias("element_id"), F.col("doc_id"), F.lit(kind).alias("element_type"), F.lit(subtype).cast("string").alias("subtype"), value.cast("string").alias("value"),
            (parent if parent is not None else F.lit(None)).cast("string").alias("parent_id"), F.lit(layer).alias("layer"), (page if page is not None else F.lit(None)).cast("int").alias("page"),
        ]

    s = spans.distinct().withColumn("doc_id", F.lower("doc_id"))
    b = boxes.distinct().withColumn("doc_id", F.lower("doc_id"))
    return (
        a.select(*row("document", None, F.col("doc_id"), F.lit("document"), None, "source"))
        .unionByName(a.where("sha != ''").select(*row("hash", "sha256", F.col("sha"), F.lit("sha256"), root, "source")))
        .unionByName(a.where("t is not null").select(*row("text", "content", F.md5("t"), F.lit("text"), root, "extracted")))
        .unionByName(s.select(*row("text", "span", F.col("text"), F.concat(F.lit("span:"), F.col("span_id")), root, "extracted", F.col("page"))))
        .unionByName(b.where("text is not null").select(*row("text", "box", F.col("text"), F.concat(F.lit("box:"), F.col("box_id")), root, "extracted", F.col("page"))))
    )


def _element(kind: str, subtype: Column, value: Column, key: Column, parent: Column | None, layer: str, page: Column) -> list[Column]:
    own = F.lit(None).cast("string")
    return [
        element_id(F.col("doc_id"), key).alias("element_id"), F.col("doc_id"), F.lit(kind).alias("element_type"), subtype.alias("subtype"), value.cast("string").alias("value"),
        (element_id(F.col("doc_id"), parent) if parent is not None else own).alias("parent_id"), F.lit(layer).alias("layer"), page.cast("int").alias("page"),
    ]


def image_elements(images: DataFrame) -> DataFrame:
    """images(doc_id, index, page, image_hash, perceptual_hash, average_hash, difference_hash) -> an element for each image
    and a child for each of its hashes; missing ones are left out."""
    kinds = {"sha256": "image_hash", "phash": "perceptual_hash", "ahash": "average_hash", "dhash": "difference_hash"}
    image = F.concat(F.lit("image:"), F.col("index"))
    own = images.select(*_element("image", F.lit(None).cast("string"), F.col("index"), image, F.lit("document"), "extracted", F.col("page")))
    pairs = F.array(*(F.struct(F.lit(k).alias("hash_type"), F.col(c).alias("value")) for k, c in kinds.items()))
    h = images.select("doc_id", "index", "page", F.inline(pairs)).where("trim(value) != ''")
    return own.unionByName(h.select(*_element("hash", F.col("hash_type"), F.col("value"), F.concat(image, F.lit(":hash:"), "hash_type"), image, "derived", F.col("page"))))


def code_elements(barcodes: DataFrame) -> DataFrame:
    """An element for each bar code, and for matrix codes another one as its child."""
    form = F.regexp_replace(F.lower(F.trim("format")), "[-_ ]", "")
    b = barcodes.where("trim(content) != ''")
    key = F.concat(F.lit("barcode:"), F.col("barcode_index"))
    own = b.select(*_element("barcode", form, F.trim("content"), key, F.lit("document"), "extracted", F.col("page")))
    qr = b.where(form.isin("qr", "qrcode")).select(*_element("qrcode", F.lit("payload"), F.trim("content"), F.concat(F.lit("qrcode:"), F.col("barcode_index")), key, "decoded", F.col("page")))
    return own.unionByName(qr)


def line_elements(lines: DataFrame) -> DataFrame:
    """lines(doc_id, line_index, page, raw, digits, status) -> raw line, its digits as a child, their validation as its."""
    key = lambda part: F.concat(F.lit("numeric_line:"), F.col("line_index"), F.lit(f":{part}"))
    chain = (("raw", "raw", F.lit("document"), "extracted"), ("normalized", "digits", key("raw"), "derived"), ("validation", "status", key("normalized"), "validated"))
    parts = [lines.where(F.col(c).isNotNull()).select(*_element("numeric_line", F.lit(part), F.col(c), key(part), parent, layer, F.col("page"))) for part, c, parent, layer in chain]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def totals(catalog: DataFrame) -> DataFrame:
    """Elements by type, subtype and layer, with sub-totals and the grand total (grouping sets)."""
    return catalog.groupingSets([["element_type"], ["element_type", "subtype"], ["layer"], []], "element_type", "subtype", "layer").agg(F.count("*").alias("elements"), F.count_distinct("doc_id").alias("documents"), F.grouping_id().alias("level"))


def orphans(catalog: DataFrame) -> DataFrame:
    """Elements whose parent isn't in the catalogue of the same document."""
    parents = catalog.select(F.col("element_id").alias("parent_id"), "doc_id")
    return catalog.where("parent_id is not null").join(parents, ["parent_id", "doc_id"], "left_anti").select("element_id", "doc_id", "parent_id")


def lookup(catalog: DataFrame, probes: DataFrame) -> DataFrame:
    """Elements whose value equals a probe after trimming and folding of case: an index look-up as a semi-join."""
    key = lambda c: F.lower(F.trim(c))
    return catalog.withColumn("_k", key("value")).join(probes.select(key("value").alias("_k")).distinct(), "_k", "left_semi").drop("_k")
