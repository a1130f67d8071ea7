"""Queries of the adapters from raw reader output to canonical rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacre.functions.geometry import Box, hex_colour
from lacre.operators import adapters, batches
from lacre.plans.derived import BARCODES, barcodes
from lacre.plans.oracles import FIRST
from lacre.plans.register import query
from lacre.sources.exports import visible_cell
from lacre.sources.tables import table

_S = "with s as (select distinct * replace (lower(doc_id) as doc_id) from spans) "
_B = "with b as (select distinct * replace (lower(doc_id) as doc_id) from boxes) "


def _spans(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "spans").distinct().withColumn("doc_id", F.lower("doc_id"))


def _boxes(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "boxes").distinct().withColumn("doc_id", F.lower("doc_id"))


def _raw(spark: SparkSession, base: str) -> DataFrame:
    """Spans as a reader gives them: flags, a packed colour, a box as a list."""
    two = lambda c, s: F.call_function("shiftleft", F.round(F.col(c) * 255).cast("int"), F.lit(s))
    return _spans(spark, base).select(
        "span_id", "doc_id", "page", "pos", "text", F.when(F.col("span_id") % 11 != 0, F.col("font_name")).alias("font"), F.when(F.col("span_id") % 13 == 0, 0.0).otherwise(F.col("font_size")).alias("size"),
        (F.col("bold").cast("int") * 16 + F.col("italic").cast("int") * 2 + (F.col("span_id") % 2).cast("int") * 8).alias("flags"), two("red", 16).bitwiseOR(two("green", 8)).bitwiseOR(two("blue", 0)).alias("color"),
        F.array("box_left", "box_top", "box_right", "box_bottom").alias("bbox"),
    )


@query(
    _S + "select span_id, page, case when span_id % 11 <> 0 and trim(font_name) <> '' then trim(font_name) else 'Unknown' end as font_name, case when span_id % 13 = 0 or font_size <= 0 then 1.0 else font_size end::double as font_size, bold, italic, span_id % 2 = 1 as mono, "
    "round(round(red * 255) / 255, 6)::double as red, round(round(green * 255) / 255, 6)::double as green, round(round(blue * 255) / 255, 6)::double as blue, box_left, box_bottom from s where text <> ''"
)
def native_spans(spark: SparkSession, base: str) -> DataFrame:
    s = adapters.native_spans(_raw(spark, base))
    return s.select("span_id", "page", "font_name", "font_size", "bold", "italic", "mono", *(F.round(c, 6).alias(c) for c in ("red", "green", "blue")), "box_left", "box_bottom")


def _nested(spark: SparkSession, base: str) -> DataFrame:
    """Pages of spans as blocks of lines of spans; every third block is a picture."""
    r = _raw(spark, base).withColumns({"block": F.floor(F.col("pos") / 6), "line": F.floor(F.col("pos") % 6 / 2)})
    item = F.struct("pos", "span_id", "text", "font", "size", "flags", "color", "bbox")
    l = r.groupBy("doc_id", "page", "block", "line").agg(F.sort_array(F.collect_list(item)).alias("spans"))
    b = l.groupBy("doc_id", "page", "block").agg(F.sort_array(F.collect_list(F.struct("line", "spans"))).alias("lines"))
    one = F.struct("block", F.when(F.col("block") % 3 == 2, 1).otherwise(0).alias("type"), "lines")
    return b.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(one)).alias("blocks"))


@query(
    _S + ", k as (select *, pos // 6 b, (pos % 6) // 2 l from s) select span_id, doc_id, page, (dense_rank() over (partition by doc_id, page order by b) - 1)::int as block, (dense_rank() over (partition by doc_id, page, b order by l) - 1)::int as line, "
    "(row_number() over (partition by doc_id, page, b, l order by pos, span_id) - 1)::int as place from k qualify b % 3 <> 2"
)
def flattened_spans(spark: SparkSession, base: str) -> DataFrame:
    return adapters.flattened(_nested(spark, base)).select("span_id", "doc_id", "page", "block", "line", "place")


@query(
    _S + ", n as (select doc_id, max(page) pages from s group by 1), p as (select doc_id, unnest(range(1, pages + 1))::int page from n), c as (select doc_id, page, count(*) n from s where text <> '' group by 1, 2) "
    "select doc_id, page, coalesce(n, 0) as spans from p left join c using (doc_id, page)"
)
def document_pages(spark: SparkSession, base: str) -> DataFrame:
    """Every page of every document with its number of spans."""
    s = _spans(spark, base)
    return adapters.all_pages(s.groupBy("doc_id").agg(F.max("page").alias("pages")), s.where("text != ''"))


@query(
    _B + ", n as (select doc_id, max(page) pages from b group by 1), p as (select doc_id, unnest(range(1, pages + 1))::int page from n), c as (select doc_id, page, count(*) n, min(confidence) c from b where trim(text) <> '' group by 1, 2) "
    "select doc_id, page, (590 + page % 3)::int as width, n as spans, c as confidence from p left join c using (doc_id, page)"
)
def ocr_pages(spark: SparkSession, base: str) -> DataFrame:
    """Sizes of pages with the OCR spans on them and their least confidence."""
    b = _boxes(spark, base)
    p = b.groupBy("doc_id").agg(F.max("page").alias("pages")).select("doc_id", F.explode(F.sequence(F.lit(1), F.col("pages"))).alias("page"))
    sizes = p.select("doc_id", "page", (590 + F.col("page") % 3).cast("int").alias("width"), F.lit(842).alias("height"))
    return adapters.sized_pages(sizes, b.where("trim(text) != ''")).select("doc_id", "page", "width", "spans", "confidence")


@query(_B + "select box_id, coalesce(try_cast(case when box_id % 13 = 0 then 'n/a' when box_id % 17 = 0 then ' 41.5 ' else confidence::varchar end as double), -1) as confidence from b")
def parsed_confidences(spark: SparkSession, base: str) -> DataFrame:
    told = F.when(F.col("box_id") % 13 == 0, "n/a").when(F.col("box_id") % 17 == 0, " 41.5 ").otherwise(F.col("confidence").cast("string"))
    return _boxes(spark, base).select("box_id", adapters.parsed_confidence(told).alias("confidence"))


@query(_B + "select box_id, box_left::int as box_left, box_top::int as box_top, box_width::int as box_width, box_height::int as box_height from b where trim(text) <> '' and confidence >= 0")
def word_boxes(spark: SparkSession, base: str) -> DataFrame:
    return adapters.word_boxes(_boxes(spark, base)).select("box_id", "box_left", "box_top", "box_width", "box_height")


@query(
    _B + ", k as (select doc_id, page, pos // 40 as block, pos // 10 as para, pos // 5 as line, string_agg(text, ' ' order by pos, box_id) as text from b where trim(text) <> '' group by all) "
    "select doc_id, page, row_number() over (partition by doc_id, page order by block, para, line) as number, text from k"
)
def word_lines(spark: SparkSession, base: str) -> DataFrame:
    part = lambda n: F.floor(F.col("pos") / n)
    w = _boxes(spark, base).select("doc_id", "page", part(40).alias("block"), part(10).alias("paragraph"), part(5).alias("line"), F.struct("pos", "box_id").alias("word"), "text")
    return adapters.word_lines(w)


_SEEN = (
    "with " + BARCODES + ", ob as (select doc_id, page, k * 10 as seq, format, content, x, y, w, h, pass from bc union all select doc_id, page, k * 10 + 1, format, content || ' ', x + 10, y, w, h, 'enhanced' from bc where k % 3 = 0 union all "
    "select doc_id, page, k * 10 + 2, format, content, x + 300, y, w, h, 'rotated' from bc where k % 6 = 0), "
    "r as (select doc_id, page, format, trim(content) as content, seq, x, y, w, h, pass, row_number() over (partition by doc_id, page, format, trim(content) order by seq) rn from ob where trim(content) <> '') "
)


def _observed(spark: SparkSession, base: str) -> DataFrame:
    """Every code once, every third again by another pass, every sixth a second time elsewhere on the page."""
    b = barcodes(spark, base).withColumn("seq", F.col("barcode_index") * 10)
    again = b.where("barcode_index % 3 = 0").withColumns({"seq": F.col("seq") + 1, "content": F.concat("content", F.lit(" ")), "x": F.col("x") + 10, "pass": F.lit("enhanced")})
    other = b.where("barcode_index % 6 = 0").withColumns({"seq": F.col("seq") + 2, "x": F.col("x") + 300, "pass": F.lit("rotated")})
    return b.unionByName(again).unionByName(other)


_OVERLAP = "(greatest(least(k.x + k.w, n.x + n.w) - greatest(k.x, n.x), 0) * greatest(least(k.y + k.h, n.y + n.h) - greatest(k.y, n.y), 0)) / least(k.w * k.h, n.w * n.h)"


@query(
    "with recursive "
    + _SEEN.removeprefix("with ")
    + ", f as (select doc_id, page, format, content, rn, [struct_pack(seq := seq, x := x, y := y, w := w, h := h)] as kept, seq as owner, pass from r where rn = 1 union all "
    "select doc_id, page, format, content, n.rn, case when own is null then list_append(kept, struct_pack(seq := n.seq, x := n.x, y := n.y, w := n.w, h := n.h)) else kept end, coalesce(own, n.seq), n.pass from (select f.doc_id, f.page, f.format, f.content, f.kept, n, "
    f"list_filter(f.kept, lambda k: (k.x is null and n.x is null) or (k.x is not null and n.x is not null and {_OVERLAP} >= 0.45))[1].seq as own from f join r n on n.doc_id = f.doc_id and n.page = f.page and n.format = f.format and n.content = f.content and n.rn = f.rn + 1)) "
    "select doc_id, page, format, content, owner as seq, count(*) as n, bool_or(pass = 'baseline') as baseline, row_number() over (partition by doc_id order by page, owner) as barcode_index from f group by doc_id, page, format, content, owner"
)
def physical_codes(spark: SparkSession, base: str) -> DataFrame:
    """Observations of codes merged to physical codes, numbered in each document."""
    c = adapters.numbered_codes(adapters.merged_observations(_observed(spark, base)))
    return c.select("doc_id", "page", "format", "content", "seq", "n", "baseline", "barcode_index")


@query(
    "with " + BARCODES + "select case when f like '%itf%' and regexp_full_match(content, '[0-9]{44}') then 'ITF_44' when f like '%itf%' then 'ITF_OTHER_' || length(content) when f like '%qr%' then 'QR' else 'DECODED' end as condition, "
    "count(*) as codes, sum((f like '%itf%' and length(trim(content)) < 44)::int)::bigint as short from (select *, regexp_replace(lower(format), '[^a-z0-9]', '', 'g') f from (select doc_id, format, case when k % 8 = 0 then substr(content, 1, (k % 44)::int) else content end as content from bc)) group by 1"
)
def reading_conditions(spark: SparkSession, base: str) -> DataFrame:
    """What readings tell by format and length; every eighth code is cut short."""
    k = F.col("barcode_index")
    b = barcodes(spark, base).withColumn("content", F.when(k % 8 == 0, F.expr("substring(content, 1, cast(barcode_index % 44 as int))")).otherwise(F.col("content")))
    short = adapters.is_short_itf(F.col("format"), F.col("content")).cast("int")
    return b.groupBy(adapters.reading_condition(F.col("format"), F.col("content")).alias("condition")).agg(F.count("*").alias("codes"), F.sum(short).alias("short"))


_HEX = "'#' || printf('%02X', round(red * 255)::int) || printf('%02X', round(green * 255)::int) || printf('%02X', round(blue * 255)::int)"


@query(_S + f"select span_id, {_HEX} || case when a < 1 then printf('%02X', round(a * 255)::int) else '' end as hex, round(round(red * 255) / 255, 6)::double as red, round(case when a < 1 then round(a * 255) / 255 else 1 end, 6)::double as alpha from (select *, case when span_id % 9 = 0 then 0.5 else alpha end a from s)")
def colour_notation(spark: SparkSession, base: str) -> DataFrame:
    """Colours as hexadecimal texts, read back to channels; every ninth span is half transparent."""
    a = F.when(F.col("span_id") % 9 == 0, 0.5).otherwise(F.col("alpha"))
    s = _spans(spark, base).select("span_id", hex_colour(F.col("red"), F.col("green"), F.col("blue"), a).alias("hex"))
    c = s.withColumn("c", adapters.parsed_colour(F.col("hex")))
    return c.select("span_id", "hex", F.round("c.red", 6).alias("red"), F.round("c.alpha", 6).alias("alpha"))


_PAIR = _S + ", p as (select *, lag(span_id) over w as other, lag(box_left) over w l, lag(box_top) over w t, lag(box_right) over w r, lag(box_bottom) over w b from s window w as (partition by doc_id, page order by pos, span_id)), "


@query(
    _PAIR + "q as (select *, box_left < r and l < box_right and box_top < b and t < box_bottom as meets, greatest(least(box_right, r) - greatest(box_left, l), 0) * greatest(least(box_bottom, b) - greatest(box_top, t), 0) as common, "
    "(box_right - box_left) * (box_bottom - box_top) a1, (r - l) * (b - t) a2 from p where other is not null) select span_id, other, meets, box_left <= r and l <= box_right and box_top <= b and t <= box_bottom as touches, box_left <= l and box_top <= t and box_right >= r and box_bottom >= b as holds, "
    "box_left < l and box_top < t and box_right > r and box_bottom > b as holds_strictly, round(case when meets then common end, 4) as common, round(case when a1 + a2 - common > 0 then common / (a1 + a2 - common) else 0 end, 6)::double as iou, round((box_left + box_right) / 2, 4) as centre, "
    "round(box_left + 10, 4) as moved, greatest(0, l - box_right, box_left - r) <= 100 and greatest(0, t - box_bottom, box_top - b) <= 75 as near from q"
)
def span_geometry(spark: SparkSession, base: str) -> DataFrame:
    """Each span's box against that of the span before it on the page."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "page").orderBy("pos", "span_id")
    edges = {f"_{e}": F.lag(f"box_{e}").over(w) for e in ("left", "top", "right", "bottom")}
    s = _spans(spark, base).withColumns({**edges, "other": F.lag("span_id").over(w)}).where("other is not null")
    a, b = Box.of(), Box(*(F.col(f"_{e}") for e in ("left", "top", "right", "bottom")))
    return s.select(
        "span_id", "other", a.intersects(b).alias("meets"), a.intersects(b, edges=True).alias("touches"), a.contains(b).alias("holds"), a.contains(b, edges=False).alias("holds_strictly"), F.round(a.intersection(b), 4).alias("common"),
        F.round(a.iou(b), 6).alias("iou"), F.round(a.centre[0], 4).alias("centre"), F.round(a.moved(10, 0).left, 4).alias("moved"), a.near(b).alias("near"),
    )


@query(
    _S + ", p as (select doc_id, page, (500 + page % 3 * 40)::double as width, (700 + page % 2 * 50)::double as height from s group by 1, 2), a as (select *, width * height area from p) "
    "select doc_id, count(*) as pages, sum(area) as area, round(avg(area), 4) as mean_area, arg_max(page, struct_pack(a := area, p := -page)) as largest, arg_min(page, struct_pack(a := area, p := page)) as smallest from a group by 1"
)
def page_extremes(spark: SparkSession, base: str) -> DataFrame:
    p = _spans(spark, base).select("doc_id", "page").distinct()
    p = p.select("doc_id", "page", (500 + F.col("page") % 3 * 40).cast("double").alias("width"), (700 + F.col("page") % 2 * 50).cast("double").alias("height"))
    return adapters.extreme_pages(p).withColumn("mean_area", F.round("mean_area", 4))




@query(_S + "select span_id, length(text)::bigint as characters, case when trim(text) = '' then 0 else length(string_split(trim(regexp_replace(text, '[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')), ' ')) end::bigint as words from s where text is not null")
def span_words(spark: SparkSession, base: str) -> DataFrame:
    """Characters and words of spans; compatibility forms of blanks separate words like others."""
    t = F.trim(F.regexp_replace(adapters.composed(F.col("text")), r"\s+", " "))
    return _spans(spark, base).where("text is not null").select("span_id", F.length("text").cast("long").alias("characters"), F.when(t == "", 0).otherwise(F.size(F.split(t, " "))).cast("long").alias("words"))


@query(
    "with l as (select distinct evidence_id, case evidence_id % 3 when 0 then 'numeric_line' when 1 then 'prompt' else 'concealment' end kind, case when evidence_id % 3 = 0 then confidence * 130 else confidence * 1.2 end c from evidences), "
    "r as (select evidence_id, kind, case when kind = 'numeric_line' then case when c between 0 and 100 then c / 100 end else least(greatest(c, 0.0), 1.0) end as ratio from l) "
    "select evidence_id, kind, round(ratio, 6) as ratio, case when ratio >= 0.9 then 'high' when ratio >= 0.7 then 'medium' when ratio is not null then 'low' else 'unknown' end as band from r"
)
def rescaled_confidences(spark: SparkSession, base: str) -> DataFrame:
    k = F.col("evidence_id") % 3
    e = table(spark, base, "evidences").select("evidence_id", "confidence").distinct()
    e = e.select("evidence_id", F.when(k == 0, "numeric_line").when(k == 1, "prompt").otherwise("concealment").alias("kind"), F.when(k == 0, F.col("confidence") * 130).otherwise(F.col("confidence") * 1.2).alias("c"))
    r = e.withColumn("ratio", adapters.rescaled(F.col("kind"), F.col("c")))
    return r.select("evidence_id", "kind", F.round("ratio", 6).alias("ratio"), adapters.band(F.col("ratio")).alias("band"))


@query("with " + FIRST + "select accepted, count(*) as uploads from (select lower(case when pos % 7 = 0 then filename || '.exe' else filename end) like '%.pdf' as accepted from f) group by 1")
def accepted_uploads(spark: SparkSession, base: str) -> DataFrame:
    """Uploads by whether they are taken; every seventh name gets another ending."""
    a = batches.first_analyses(table(spark, base, "analyses"))
    name = F.when(F.col("pos") % 7 == 0, F.concat("filename", F.lit(".exe"))).otherwise(F.col("filename"))
    return adapters.accepted(a.select(name.alias("filename"))).groupBy("accepted").agg(F.count("*").alias("uploads"))


@query(_B + "select box_id, case when box_id % 5 = 0 then 'a\\x07' || text else text end as cell from b where text is not null")
def visible_cells(spark: SparkSession, base: str) -> DataFrame:
    """Cells of reports with control characters made visible; every fifth box gets one."""
    t = F.when(F.col("box_id") % 5 == 0, F.concat(F.lit("a\x07"), "text")).otherwise(F.col("text"))
    return _boxes(spark, base).where("text is not null").select("box_id", visible_cell(t).alias("cell"))


@query()
def file_hashes(spark: SparkSession, base: str) -> DataFrame:
    """Digests of the files in the tables' folder; no SQL, as views have no files."""
    return adapters.file_hashes(spark, base).select(F.element_at(F.split("path", "/"), -1).alias("name"), "size_bytes", "sha256")
