"""Labelled identifiers of documents: reading them from boxes, spans and texts, choosing observations, comparing documents.

Only values beside or under a label count; a label without a value infers nothing. Pages are read by visual rows (rows.grouped
"anchor"), rows by segments. Documents are compared by the kinds for which they state exactly one value.

Defined results: missing confidences make a quality of 0; null texts hold nothing; repeated rows count once; a reading that
other boxes contradict takes no part in comparisons; empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacre.functions.once import step
from lacre.operators import rows

_W = r"(?<![\p{L}\p{N}_])"
_VALUE = r"\s*[:#\-.]?\s*(\d[\d.\-/ ]{4,29}\d)(?!\d)"
#: Labels with their value, by kind.
PATTERNS = {
    "account": r"(?:n[º°o.]?\s*(?:da\s+)?conta|n[uú]mero\s+da\s+conta|conta\s*(?:n[º°o.]?|n[uú]mero)?)",
    "customer": r"(?:c[oó]d(?:igo)?\.?\s*(?:do\s+)?cliente|cliente\s*(?:n[º°o.]?|c[oó]digo)?)",
    "invoice": r"(?:n[º°o.]?\s*(?:da\s+)?fatura|n[uú]mero\s+da\s+fatura|fatura\s*(?:n[º°o.]?|n[uú]mero)?)",
    "automatic_debit": r"(?:(?:c[oó]d(?:igo)?\.?\s*(?:de\s+)?)?d[eé]bito\s+autom[aá]tico)",
}
HOLDER = r"(?:titular|nome\s+do\s+cliente|nome\s+do\s+titular|cliente|nome\s+do\s+assinante)"
HOLDER_VALUE = r"\s*[:\-]\s*([A-ZÀ-Ü][A-Za-zÀ-ÿ' -]{5,75})"
HOLDER_END = r"\s{2,}|\s+(?:CONTA|CLIENTE|FATURA|D[EÉ]BITO)\s*[:#]"
#: Labels alone, over a value.
HEADERS = {
    "account": r"(?:n[º°o.]?\s*(?:da\s+)?conta|n[uú]mero\s+da\s+conta|conta)",
    "customer": r"(?:c[oó]d(?:igo)?\.?\s*(?:do\s+)?cliente|cliente)",
    "invoice": r"(?:n[º°o.]?\s*(?:da\s+)?fatura|n[uú]mero\s+da\s+fatura|fatura)",
    "automatic_debit": r"(?:(?:c[oó]d(?:igo)?\.?\s*(?:de\s+)?)?d[eé]bito\s+autom[aá]tico)",
    "holder": r"(?:titular|nome\s+do\s+titular|nome\s+do\s+assinante)",
}
COLUMN_GAP, BELOW, MARGIN = 140, 54, 18
_DIGITS_CELL, _NAME_CELL = r"^[0-9][0-9.\-/ ]{4,34}[0-9]$", r"^[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ' -]{5,75}$"


def scanned(df: DataFrame, text: str) -> DataFrame:
    """Rows with kind and value for each labelled identifier in their text: 6 to 24 digits, or a holder's name of two words."""
    found = []
    for kind, label in PATTERNS.items():
        raws = F.regexp_extract_all(F.col(text), F.lit(f"(?iu){_W}{label}{_VALUE}"), F.lit(1))
        found.append(F.transform(raws, lambda r: F.regexp_replace(r, "[^0-9]", "")))
    kinds = list(PATTERNS)
    lists = [F.transform(v, _tag(k)) for k, v in zip(kinds, found, strict=True)]
    names = F.regexp_extract_all(F.col(text), F.lit(f"(?iu){_W}{HOLDER}{HOLDER_VALUE}"), F.lit(1))
    upper = F.transform(names, lambda r: F.upper(F.trim(F.regexp_replace(F.regexp_replace(r, r"^[ .\-/]+|[ .\-/]+$", ""), r"\s+", " "))))
    upper = F.filter(upper, lambda v: F.size(F.split(v, " ")) >= 2)
    holders = F.transform(upper, lambda v: F.struct(F.lit("holder").alias("kind"), F.trim(F.get(F.split(v, HOLDER_END, 2), F.lit(0))).alias("value")))
    out = df.where(F.col(text).isNotNull()).select("*", F.inline(F.concat(*lists, holders)))
    return out.where((F.col("kind") == "holder") | F.length("value").between(6, 24))


def _tag(kind: str):  # noqa: ANN202
    return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))


def _region(edges: str = "box_") -> list[Column]:
    left, top, width, height = (F.col(f"{edges}{n}") for n in ("left", "top", "width", "height"))
    return [F.min(left).alias("left"), F.min(top).alias("top"), F.max(left + width).alias("right"), F.max(top + height).alias("bottom")]


def from_segments(placed: DataFrame) -> DataFrame:
    """placed: boxes with row and segment -> (doc_id, page, kind, value, confidence, region): labels with their value in one
    segment; the confidence is the least of its boxes that have one."""
    item = F.struct("box_left", "box_id", F.coalesce("text", F.lit("")).alias("text"))
    g = placed.groupBy("doc_id", "page", "row", "segment").agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["text"]), " ").alias("t"), F.min("confidence").alias("confidence"), *_region())
    return scanned(g, "t").select("doc_id", "page", "kind", "value", "confidence", "left", "top", "right", "bottom", F.lit(False).alias("has_region"))


def stacked(placed: DataFrame) -> DataFrame:
    """Labels with the value in the cell below: (doc_id, page, kind, value, confidence, region of the cell).

    Labels are found in a row's text and have the bounds of their words; cells are runs of words of a row (a number of 6 to
    24 digits is a cell by itself, others join over blanks of up to 35). A label and a cell below it by at most 54, sharing a
    fifth of the narrower width and 5 at least, score by distance of centres plus twice the gap; they belong together if each
    is the other's best by 18 or more.
    """
    row = ["doc_id", "page", "row"]
    w = Window.partitionBy(*row).orderBy("box_left", "box_id")
    b = placed.withColumn("text", F.coalesce("text", F.lit("")))
    token = F.regexp_replace("text", r"^[ .\-/]+|[ .\-/]+$", "")
    n_digits = F.length(F.regexp_replace(token, "[^0-9]", ""))
    full = token.rlike(_DIGITS_CELL) & n_digits.between(6, 24)
    b = b.withColumns({"_full": full, "_off": F.coalesce(F.sum(F.length("text") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    gap = F.col("box_left") - F.lag(F.col("box_left") + F.col("box_width")).over(w)
    new = F.when(F.col("_full") | F.coalesce(F.lag("_full").over(w), F.lit(False)) | (gap > 35), 1).otherwise(0)
    b = b.withColumn("_new", new).withColumn("cell", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.struct("box_left", "box_id", "text")
    line = F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["text"]), " ")
    least = [F.min("confidence").alias("c"), F.max(F.col("confidence").isNull()).alias("_none")]
    cells = b.groupBy(*row, "cell").agg(line.alias("t"), *least, *_region())
    raw = F.regexp_replace(F.trim("t"), r"^[ .\-/]+|[ .\-/]+$", "")
    d = F.regexp_replace(raw, "[^0-9]", "")
    numeric = raw.rlike(_DIGITS_CELL) & F.length(d).between(6, 24)
    name = raw.rlike(_NAME_CELL) & (F.size(F.split(raw, r"\s+")) >= 2)
    cells = cells.select(*row, "cell", "c", "_none", "left", "top", "right", "bottom", F.when(numeric, d).alias("number"), F.when(name, F.upper(F.regexp_replace(raw, r"\s+", " "))).alias("name")).where("number is not null or name is not null")
    texts = b.groupBy(*row).agg(line.alias("t"))
    size = lambda arr, i: F.aggregate(F.slice(arr, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x))
    found = []
    for kind, label in HEADERS.items():
        p = rf"(?iu){_W}{label}(?![\p{{L}}\p{{N}}_])"
        t = step(texts.where(F.col("t").rlike(p)), _p=F.split("t", p, -1), _f=F.regexp_extract_all("t", F.lit(p), F.lit(0)))
        spots = F.transform(F.sequence(F.lit(1), F.size("_f")), lambda i: F.struct((size("_p", i) + size("_f", i - 1)).alias("a"), (size("_p", i) + size("_f", i)).alias("z")))
        found.append(t.select(*row, F.lit(kind).alias("kind"), F.inline(spots)))
    labels = reduce(lambda x, y: x.unionByName(y), found).join(b, row).where((F.col("_off") < F.col("z")) & (F.col("_off") + F.length("text") > F.col("a")))
    labels = labels.groupBy(*row, "kind", "a").agg(*least, *_region())
    l = labels.select("doc_id", "page", F.col("row").alias("lr"), "kind", "a", F.col("c").alias("lc"), F.col("_none").alias("ln"), *(F.col(e).alias(f"l_{e}") for e in ("left", "top", "right", "bottom")))
    fits = F.when(F.col("kind") == "holder", F.col("name").isNotNull()).otherwise(F.col("number").isNotNull())
    drop = F.col("top") - F.col("l_bottom")
    shared = F.least("l_right", "right") - F.greatest("l_left", "left")
    close = drop.between(0, BELOW) & (shared >= F.greatest(F.lit(5.0), F.least(F.col("l_right") - F.col("l_left"), F.col("right") - F.col("left")) * 0.2))
    o = l.join(cells, ["doc_id", "page"]).where((F.col("row") > F.col("lr")) & fits & close)
    o = o.withColumn("score", F.abs((F.col("l_left") + F.col("l_right")) / 2 - (F.col("left") + F.col("right")) / 2) + 2 * drop)
    by_label = Window.partitionBy("doc_id", "page", "lr", "kind", "a").orderBy("score", "row", "cell")
    by_cell = Window.partitionBy("doc_id", "page", "row", "cell").orderBy("score", "lr", "kind", "a")
    o = o.withColumns({"_i": F.row_number().over(by_label), "_j": F.row_number().over(by_cell), "_si": F.lead("score").over(by_label), "_sj": F.lead("score").over(by_cell)})
    clear = lambda s: F.coalesce(F.col(s) - F.col("score") >= MARGIN, F.lit(True))
    best = o.where((F.col("_i") == 1) & (F.col("_j") == 1) & clear("_si") & clear("_sj"))
    value = F.when(F.col("kind") == "holder", F.col("name")).otherwise(F.col("number"))
    return best.select("doc_id", "page", "kind", value.alias("value"), F.when(~F.col("ln") & ~F.col("_none"), F.least("lc", "c")).alias("confidence"), "left", "top", "right", "bottom", F.lit(True).alias("has_region"))


def from_boxes(boxes: DataFrame, source: str = "OCR_BOX") -> DataFrame:
    """Both arms over boxes: beside a label, and below it."""
    placed = rows.segmented(boxes, rows.grouped(boxes, "anchor"), COLUMN_GAP)
    return from_segments(placed).unionByName(stacked(placed)).withColumn("source", F.lit(source))


def from_spans(spans: DataFrame) -> DataFrame:
    """The same over native spans, read at twice their scale; places are given back in points, without a confidence."""
    b = spans.select(
        F.col("span_id").alias("box_id"), "doc_id", "page", "text", F.lit(100.0).alias("confidence"), (F.col("box_left") * 2).alias("box_left"), (F.col("box_top") * 2).alias("box_top"), ((F.col("box_right") - F.col("box_left")) * 2).alias("box_width"),
        ((F.col("box_bottom") - F.col("box_top")) * 2).alias("box_height"),
    )
    n = from_boxes(b, "NATIVE_SPAN")
    return n.withColumns({e: F.col(e) / 2 for e in ("left", "top", "right", "bottom")}).withColumn("confidence", F.lit(None).cast("double"))


def from_texts(texts: DataFrame, source: str) -> DataFrame:
    """texts(doc_id, text): line by line, without page and place."""
    t = texts.where("text is not null").select("doc_id", F.explode(F.split("text", r"\r\n|\r|\n")).alias("t"))
    none = [F.lit(None).cast("double").alias(c) for c in ("confidence", "left", "top", "right", "bottom")]
    return scanned(t, "t").select("doc_id", F.lit(None).cast("int").alias("page"), "kind", "value", *none, F.lit(False).alias("has_region"), F.lit(source).alias("source"))


def quality(source: str = "source", confidence: str = "confidence") -> Column:
    s = F.col(source)
    return F.when(s == "NATIVE_SPAN", 100.0).when(s == "NATIVE_AGGREGATED", 65.0).when(s.isin("OCR_BOX", "OCR_REGION"), F.coalesce(F.col(confidence), F.lit(0.0))).otherwise(0.0)


def deduplicated(observations: DataFrame) -> DataFrame:
    """One observation for each document, kind, value and page: the best quality, then one with a region, then the first by
    place. What has no page is dropped where the same value was seen on one."""
    o = observations.withColumn("quality", quality())
    seen = o.where("page is not null").select("doc_id", "kind", "value").distinct().withColumn("_seen", F.lit(True))
    o = o.join(seen, ["doc_id", "kind", "value"], "left").where("page is not null or _seen is null").drop("_seen")
    w = Window.partitionBy("doc_id", "kind", "value", "page").orderBy(F.col("quality").desc(), F.col("has_region").desc(), "source", F.col("top").asc_nulls_first(), F.col("left").asc_nulls_first(), F.col("right").asc_nulls_first(), F.col("bottom").asc_nulls_first())
    return o.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def region_conflicts(observations: DataFrame, boxes: DataFrame) -> DataFrame:
    """(doc_id, page, kind, value, other): boxes of 6 to 24 digits without letters that cover half of a value's region (or of
    themselves) and read otherwise."""
    d = F.regexp_replace("text", "[^0-9]", "")
    b = boxes.select(F.lower("doc_id").alias("doc_id"), "page", d.alias("other"), "text", "box_left", "box_top", "box_width", "box_height").where(F.length("other").between(6, 24) & ~F.col("text").rlike("[A-Za-z]"))
    o = observations.where("has_region").select("doc_id", "page", "kind", "value", "left", "top", "right", "bottom")
    j = o.join(b, ["doc_id", "page"]).where("other != value")
    across = F.least(F.col("box_left") + F.col("box_width"), F.col("right")) - F.greatest("box_left", "left")
    down = F.least(F.col("box_top") + F.col("box_height"), F.col("bottom")) - F.greatest("box_top", "top")
    area = F.least(F.col("box_width") * F.col("box_height"), (F.col("right") - F.col("left")) * (F.col("bottom") - F.col("top")))
    share = F.greatest(across, F.lit(0)) * F.greatest(down, F.lit(0)) / area
    return j.where((area > 0) & (share >= 0.5)).select("doc_id", "page", "kind", "value", "other").distinct()


def participants(observations: DataFrame) -> DataFrame:
    """(kind, value, doc_id, quality, holder): the documents that take part, by the one value they state for a kind; holder
    where they name exactly one."""
    o = observations.withColumn("quality", quality())
    n = F.count_distinct("value")
    holders = o.where("kind = 'holder'").groupBy("doc_id").agg(n.alias("n"), F.min("value").alias("holder")).where("n = 1").drop("n")
    one = o.where("kind != 'holder'").groupBy("doc_id", "kind").agg(n.alias("n"), F.min("value").alias("value"), F.max("quality").alias("quality")).where("n = 1").drop("n")
    return one.join(holders, "doc_id", "left").select("kind", "value", "doc_id", "quality", "holder")


def compared(part: DataFrame) -> DataFrame:
    """(kind, relation, value, other_value, documents, holders): equal values of two documents or more (EXACT); values that
    differ in one digit, where a masked form has exactly two (ONE_DIGIT); and with two neighbours swapped (TRANSPOSITION).
    The last two need a quality of 80 for all documents. A document states one value, so the two sides share none."""
    g = part.groupBy("kind", "value").agg(F.count("*").alias("documents"), F.min("quality").alias("quality"), F.count_distinct("holder").alias("holders"))
    exact = g.where("documents > 1").select("kind", F.lit("EXACT").alias("relation"), "value", F.lit(None).cast("string").alias("other_value"), "documents", "holders")
    v = g.where(F.col("value").rlike("^[0-9]{6,24}$"))
    place = F.sequence(F.lit(1), F.length("value"))
    cut = lambda i: F.concat(F.substr("value", F.lit(1), i - 1), F.lit("*"), F.substr(F.col("value"), i + 1))
    m = v.select("kind", "value", "documents", "quality", F.explode(F.transform(place, cut)).alias("mask")).groupBy("kind", "mask")
    m = m.agg(F.count("*").alias("n"), F.min("value").alias("value"), F.max("value").alias("other_value"), F.sum("documents").alias("documents"), F.min("quality").alias("quality")).where("n = 2").where("quality >= 80")
    one = m.select("kind", F.lit("ONE_DIGIT").alias("relation"), "value", "other_value", "documents").distinct()
    at = F.filter(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substr("value", i, F.lit(1)) != F.substr("value", i + 1, F.lit(1)))
    swap = F.transform(at, lambda i: F.concat(F.substr("value", F.lit(1), i - 1), F.substr("value", i + 1, F.lit(1)), F.substr("value", i, F.lit(1)), F.substr(F.col("value"), i + 2)))
    s = v.select("kind", "value", "documents", "quality", F.explode(F.array_distinct(swap)).alias("other_value")).where("value < other_value")
    s = s.join(v.select("kind", F.col("value").alias("other_value"), F.col("documents").alias("_d"), F.col("quality").alias("_q")), ["kind", "other_value"]).where("quality >= 80 and _q >= 80")
    two = s.select("kind", F.lit("TRANSPOSITION").alias("relation"), "value", "other_value", (F.col("documents") + F.col("_d")).alias("documents"))
    return exact.unionByName(one.unionByName(two).withColumn("holders", F.lit(None).cast("long")))


def proposed_regions(placed: DataFrame, observations: DataFrame, most: int = 4) -> DataFrame:
    """(doc_id, page, number, missing, left, top, right, bottom): rows of headings of two kinds or more (holders apart) of which
    some have no observation on the page: where to read again. The first four of a document, as a re-reading costs an engine
    run each; overlapping rows are one region each here, in order of page and top."""
    row = ["doc_id", "page", "row"]
    item = F.struct("box_left", "box_id", F.coalesce("text", F.lit("")).alias("text"))
    t = placed.groupBy(*row).agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["text"]), " ").alias("t"), F.median("box_height").alias("h"), *_region())
    kinds = F.array(*(F.when(F.col("t").rlike(rf"(?iu){_W}{p}(?![\p{{L}}\p{{N}}_])"), k) for k, p in HEADERS.items() if k != "holder"))
    t = t.withColumn("kinds", F.filter(kinds, lambda x: x.isNotNull())).where(F.size("kinds") >= 2)
    known = observations.where("page is not null").groupBy("doc_id", "page").agg(F.collect_set("kind").alias("known"))  # five kinds at most
    j = t.join(known, ["doc_id", "page"], "left").withColumn("missing", F.array_except("kinds", F.coalesce("known", F.array().cast("array<string>"))))
    j = j.where((F.size("missing") > 0) & (F.col("h") > 0))
    j = j.withColumn("number", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "top", "row")).cast("long")).where(F.col("number") <= most)
    h = F.col("h")
    return j.select("doc_id", "page", "number", F.array_join(F.array_sort("missing"), ",").alias("missing"), F.greatest(F.lit(0.0), F.col("left") - 2 * h).alias("left"), F.greatest(F.lit(0.0), F.col("top") - h).alias("top"), (F.col("right") + 2 * h).alias("right"), (F.col("bottom") + 3 * h).alias("bottom"))
