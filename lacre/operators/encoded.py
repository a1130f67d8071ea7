"""Encoded texts and graphics made of font characters: decoding, groups of spans, and codes that they belong to.

Decoding is tried for whole texts only, twice at most, in Arrow batches: 8-bit groups of zeros and ones, hexadecimal digits
(marked, or with a letter), base64 (marked, padded, or with + or /). What comes out counts if it is a text: valid UTF-8 of 4 to
4,096 bytes, 95 % printable, three letters, three different ones.

Defined results: null and blank texts are passed over; texts above 8,192 characters are reported as oversize and not decoded;
repeated rows count once; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacre.functions.geometry import Box
from lacre.operators.barcodes import code_format

#: Bounds of decoding.
RAW_CHARACTERS, DECODED_BYTES, DEPTH, VARIANTS, LEAST_BITS, PREVIEW = 8192, 4096, 2, 6, 32, 120
QR_FONT = r"(?i)(?:^|[^a-z])qr(?:code)?(?:[^a-z]|$)|qrcode"
#: Distance over which spans of one font are one graphic, and how many groups back are looked at.
REACH, BACK = 16.0, 100
VARIANT = "array<struct<chain:string,text:string,sha256:string,bytes:int>>"


def bits_of(text: str) -> str | None:
    """The bits of a text of zeros, ones and white space, if they are enough."""
    bits = "".join(text.split())
    return bits if len(bits) >= LEAST_BITS and not bits.strip("01") else None


def readable(data: bytes) -> str | None:
    import unicodedata

    if not 4 <= len(data) <= DECODED_BYTES:
        return None
    try:
        text = data.decode("utf-8")
    except UnicodeError:
        return None
    letters = [c.casefold() for c in text if unicodedata.category(c)[0] == "L"]
    shown = sum(c.isprintable() or c in "\n\r\t" for c in text)
    return text if len(text) >= 4 and text.strip() and shown >= 0.95 * len(text) and len(letters) >= 3 and len(set(letters)) >= 3 else None


def candidates(text: str) -> Iterator[tuple[str, bytes]]:
    """Byte strings that a text may stand for, with the notation's name."""
    import base64
    import binascii

    bits = bits_of(text)
    if bits and len(bits) % 8 == 0 and len(bits) <= 8 * DECODED_BYTES:
        yield "binary_8bit", int(bits, 2).to_bytes(len(bits) // 8, "big")
    text = text.strip()
    low = text.lower()
    body = text[4:].strip() if low.startswith("hex:") else text
    clean = re.sub(r"[\s:]", "", body)
    if (low.startswith("hex:") or re.search("[a-fA-F]", clean)) and 8 <= len(clean) <= 2 * DECODED_BYTES and len(clean) % 2 == 0 and re.fullmatch(r"(?:[0-9a-fA-F]{2}[\s:]*)+", body):
        yield "hex", bytes.fromhex(clean)
    body = text[7:].strip() if low.startswith("base64:") else text
    if (low.startswith("base64:") or body.endswith("=") or "+" in body or "/" in body) and 12 <= len(body) <= 2 * DECODED_BYTES and len(body) % 4 == 0 and re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", body):
        try:
            yield "base64", base64.b64decode(body, validate=True)
        except (ValueError, binascii.Error):
            return


def variants(text: str) -> list[tuple[str, str, str, int]]:
    """(chain, text, digest of the bytes, their number) of what a text decodes to, level by level, each text once."""
    import hashlib

    out: list[tuple[str, str, str, int]] = []
    seen = {text.strip()}
    level = [(text.strip(), "")]
    for _ in range(DEPTH):
        following = []
        for value, chain in level:
            for name, data in candidates(value):
                made = readable(data)
                if made is None or made in seen or len(out) >= VARIANTS:
                    continue
                seen.add(made)
                steps = f"{chain}>{name}" if chain else name
                out.append((steps, made, hashlib.sha256(data).hexdigest(), len(data)))
                following.append((made, steps))
        level = following
    return out


def decoded_column(texts: DataFrame, text: str) -> DataFrame:
    """Adds decoded: the variants of each text; oversize texts have none."""
    kept = list(texts.columns)
    schema = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in kept) + f", decoded {VARIANT}"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        item = pa.struct([("chain", pa.string()), ("text", pa.string()), ("sha256", pa.string()), ("bytes", pa.int32())])
        for batch in batches:
            rows = [[dict(zip(("chain", "text", "sha256", "bytes"), v, strict=True)) for v in variants(t)] if t and len(t) <= RAW_CHARACTERS else [] for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(rows, pa.list_(item))], [*kept, "decoded"])

    return texts.mapInArrow(run, schema)


def is_qr_font(c: Column) -> Column:
    return F.coalesce(c.rlike(QR_FONT), F.lit(False))


def is_bits(c: Column) -> Column:
    return c.rlike(r"^[01\s]+$") & (F.length(F.regexp_replace(c, r"\s", "")) >= LEAST_BITS)


def inspected(observations: DataFrame, key: str, text: str, font: str) -> DataFrame:
    """(key, code, sha256, length, preview, font_hint, decoded) of texts that are oversize, decode to a text, stand in a font
    of matrix codes, or are bits that decode to nothing."""
    o = observations.where(F.trim(text) != "").select(key, F.col(text).alias("_t"), is_qr_font(F.col(font)).alias("font_hint"))
    o = decoded_column(o, "_t")
    code = F.when(F.length("_t") > RAW_CHARACTERS, "ENCODED_CONTENT_OVERSIZE").when(F.size("decoded") > 0, "ENCODED_TEXT_DECODED").when(F.col("font_hint"), "QR_FONT_CANDIDATE").when(is_bits(F.col("_t")), "ENCODED_BINARY_UNRESOLVED")
    o = o.withColumn("code", code).where("code is not null")
    return o.select(key, "code", F.sha2("_t", 256).alias("sha256"), F.length("_t").alias("length"), F.substring("_t", 1, PREVIEW).alias("preview"), "font_hint", "decoded")


def code_texts(barcodes: DataFrame) -> DataFrame:
    """(doc_id, barcode_index, page, chain, text, sha256, status): what matrix codes hold and what that decodes to, as texts for
    detectors; never anything to be acted on. Oversize contents have no text."""
    b = barcodes.distinct().where(code_format(F.col("format")).isin("qr", "qrcode") & (F.trim("content") != "")).select("doc_id", "barcode_index", "page", "content")
    d = decoded_column(b, "content")
    big = F.length("content") > RAW_CHARACTERS
    own = F.struct(F.lit("").alias("chain"), F.when(~big, F.col("content")).alias("text"), F.sha2("content", 256).alias("sha256"))
    more = F.transform("decoded", lambda v: F.struct(v["chain"].alias("chain"), v["text"].alias("text"), v["sha256"].alias("sha256")))
    return d.select("doc_id", "barcode_index", "page", F.inline(F.concat(F.array(own), more)), F.when(big, "SKIPPED_OVERSIZE").otherwise("REQUIRES_SEMANTIC_ANALYSIS").alias("status"))


def span_groups(spans: DataFrame) -> DataFrame:
    """Spans of a matrix font, or of bits, with the graphic they belong to: adds group (from 0 on a page and font).

    In order of top and left, a span joins the latest of the last 100 groups whose box, grown so far, lies within 16 points;
    pages and fonts are read once each, sorted inside their partition.
    """
    s = spans.where((F.trim("text") != "") & (is_qr_font(F.col("font_name")) | is_bits(F.col("text"))) & (F.col("box_left") < F.col("box_right")) & (F.col("box_top") < F.col("box_bottom")))
    s = s.select("doc_id", "page", F.coalesce("font_name", F.lit("")).alias("font_name"), "span_id", "box_left", "box_top", "box_right", "box_bottom")
    kind = s.schema["span_id"].dataType.simpleString()

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at: tuple = ()
        groups: list[list[float]] = []
        for batch in batches:
            out = []
            for *key, a, b, c, d in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "page", "font_name", "box_left", "box_top", "box_right", "box_bottom")), strict=True):
                if tuple(key) != at:
                    at, groups = tuple(key), []
                k = next((i for i in range(len(groups) - 1, max(-1, len(groups) - 1 - BACK), -1) if groups[i][0] <= c + REACH and a <= groups[i][2] + REACH and groups[i][1] <= d + REACH and b <= groups[i][3] + REACH), -1)
                if k < 0:
                    groups.append([a, b, c, d])
                    k = len(groups) - 1
                else:
                    g = groups[k]
                    groups[k] = [min(g[0], a), min(g[1], b), max(g[2], c), max(g[3], d)]
                out.append(k)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc_id", "page", "font_name", "span_id")), pa.array(out, pa.int64())], ["doc_id", "page", "font_name", "span_id", "group"])

    ordered = s.repartition("doc_id", "page", "font_name").sortWithinPartitions("doc_id", "page", "font_name", "box_top", "box_left", "span_id")
    return ordered.mapInArrow(read, f"doc_id string, page int, font_name string, span_id {kind}, group long")


def group_boxes(grouped: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, page, font_name, group, spans, box edges)."""
    j = grouped.join(spans.select("span_id", "box_left", "box_top", "box_right", "box_bottom"), "span_id")
    return j.groupBy("doc_id", "page", "font_name", "group").agg(F.count("*").alias("spans"), F.min("box_left").alias("box_left"), F.min("box_top").alias("box_top"), F.max("box_right").alias("box_right"), F.max("box_bottom").alias("box_bottom"))


def linked_codes(groups: DataFrame, barcodes: DataFrame, overlap: float = 0.65) -> DataFrame:
    """groups with the matrix codes of their page that they share 0.65 of the smaller area with: adds barcode_index, content."""
    b = barcodes.distinct().where(F.regexp_replace(F.lower("format"), " ", "").contains("qr") & F.col("x").isNotNull()).select("doc_id", "page", "barcode_index", "content", "x", "y", "w", "h")
    share = Box.of().overlap(Box.sized(*(F.col(c) for c in "xywh")))
    return groups.join(b, ["doc_id", "page"]).where(share >= overlap).drop("x", "y", "w", "h")


def graphic_spans(spans: DataFrame, linked: DataFrame) -> DataFrame:
    """Spans that draw a linked code: bits, of the group's font and page, with their centre inside the group's box."""
    g = linked.select("doc_id", "page", "font_name", *(F.col(f"box_{e}").alias(f"g_{e}") for e in ("left", "top", "right", "bottom"))).distinct()
    s = spans.where(is_bits(F.col("text"))).withColumn("font_name", F.coalesce("font_name", F.lit("")))
    x, y = Box.of().centre
    inside = x.between(F.col("g_left"), F.col("g_right")) & y.between(F.col("g_top"), F.col("g_bottom"))
    return s.join(g, ["doc_id", "page", "font_name"]).where(inside).select("span_id").distinct()


def without_graphics(findings: DataFrame, graphics: DataFrame) -> DataFrame:
    """Findings of spans (span_id) less those of spans that draw a code."""
    return findings.join(graphics, "span_id", "left_anti")
