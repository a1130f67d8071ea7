"""The core's registered queries: each takes (spark, folder of tables) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacre.functions import checks
from lacre.functions.text import folded
from lacre.operators import barcodes, batches, catalog, detectors, evidence, layout, locate, observations, pages, similarity, temporal, timestamps
from lacre.plans.derived import backgrounds
from lacre.sources.exports import audited, clean_cell
from lacre.sources.tables import table
from lacre.streaming import events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return timestamps.found(*(table(spark, base, t) for t in ("uploads", "dates", "sites")))


# Duplicates and similarity


def _digests(spark: SparkSession, base: str) -> DataFrame:
    a = table(spark, base, "analyses").withColumn("doc", F.lower("doc_id"))
    k = F.regexp_extract(F.lower("sha256"), "([0-9a-f]{64})", 1)
    return similarity.duplicate_groups(a, F.when(k != "", k), "pos", "doc")


@query
def exact_duplicate_groups(spark: SparkSession, base: str) -> DataFrame:
    return _digests(spark, base)


@query
def exact_duplicate_totals(spark: SparkSession, base: str) -> DataFrame:
    return similarity.group_totals(_digests(spark, base))


@query
def text_duplicate_groups(spark: SparkSession, base: str) -> DataFrame:
    d = table(spark, base, "documents").where("trim(text) != ''")
    return similarity.duplicate_groups(d, F.sha2("text", 256), "doc_id")


@query
def pair_space_reduction(spark: SparkSession, base: str) -> DataFrame:
    b = table(spark, base, "boxes").distinct().withColumn("doc_id", F.lower("doc_id"))
    return similarity.pair_space(b, "doc_id")


def _fingerprints(spark: SparkSession, base: str) -> DataFrame:
    """Sign bits of the vectors and, as near copies, the same with vec_id % 5 low bits flipped."""
    v = table(spark, base, "embeddings").select("vec_id", similarity.sign_bits(F.col("embedding")).alias("bits"))
    flipped = F.col("bits").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("vec_id") % 5).cast("int")) - 1)
    return v.unionByName(v.select((F.col("vec_id") + 1_000_000).alias("vec_id"), flipped.alias("bits")))


@query
def fingerprint_pairs(spark: SparkSession, base: str) -> DataFrame:
    p = similarity.hamming_pairs(_fingerprints(spark, base), "vec_id", "bits", 3)
    v, w = (F.lpad(F.hex(c), 16, "0") for c in ("v", "w"))
    kind = similarity.similarity_class(F.col("distance"), 64, F.lit(False))
    return p.select(F.least(v, w).alias("a"), F.greatest(v, w).alias("b"), F.col("distance").cast("long").alias("distance"), kind.alias("class"))


@query
def fingerprint_relations(spark: SparkSession, base: str) -> DataFrame:
    """fingerprint_pairs with the values that several vectors share as EXACT, and how many vectors each value stands for."""
    f = _fingerprints(spark, base)
    p = similarity.hamming_pairs(f, "vec_id", "bits", 3).unionByName(similarity.exact_classes(f, "vec_id", "bits"))
    v, w = (F.lpad(F.hex(c), 16, "0") for c in ("v", "w"))
    kind = similarity.similarity_class(F.col("distance"), 64, F.col("distance") == 0)
    n_a, n_b = F.when(v <= w, F.col("n_v")).otherwise(F.col("n_w")), F.when(v <= w, F.col("n_w")).otherwise(F.col("n_v"))
    return p.select(F.least(v, w).alias("a"), F.greatest(v, w).alias("b"), F.col("distance").cast("long").alias("distance"), kind.alias("class"), n_a.alias("members_a"), n_b.alias("members_b"))


@query
def fingerprint_members(spark: SparkSession, base: str) -> DataFrame:
    """The vectors that each value of fingerprint_pairs and fingerprint_relations stands for."""
    m = similarity.members(_fingerprints(spark, base), "vec_id", "bits")
    return m.select(F.lpad(F.hex("v"), 16, "0").alias("representative"), F.col("element").alias("vec_id"))


LABELS = {"nº conta": "account", "nº da fatura": "invoice", "agência/código": "customer", "carteira": "portfolio"}


@query
def identifier_matches(spark: SparkSession, base: str) -> DataFrame:
    b = table(spark, base, "boxes").distinct()
    name = F.lower(F.regexp_extract("text", r"^\s*([^:]+):\s*\d{4,}\s*$", 1))
    kinds = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    obs = b.select(kinds[name].alias("kind"), F.regexp_extract("text", r":\s*(\d{4,})\s*$", 1).alias("value"), F.lower("doc_id").alias("doc_id"))
    return similarity.identifier_matches(obs.where("kind is not null"))


# Payment lines and amounts


def _lines(spark: SparkSession, base: str) -> DataFrame:
    """Lines printed in boxes, and 48-digit lines of orders whose last check digit is wrong for every seventh key."""
    b = table(spark, base, "boxes").distinct().where("lower(text) like 'linha digit%'").select(F.concat(F.lit("box:"), "box_id").alias("line_id"), checks.digits(F.col("text")).alias("line"))
    o = table(spark, base, "orders").select("o_orderkey")
    return b.unionByName(o.select(F.concat(F.lit("order:"), "o_orderkey").alias("line_id"), order_line(F.col("o_orderkey")).alias("line")))


def order_line(key: Column) -> Column:
    """The line of an order."""
    k = F.lpad(key.cast("string"), 10, "0")
    n = k.cast("long")
    check = lambda x: checks.modulo_10_of(x, 11)
    head = F.substring(k, 3, 8)
    wrong = (check(n) + F.when(key % 7 == 0, 1).otherwise(0)) % 10
    return F.concat(F.lit("846"), head, check(F.lit(84_600_000_000) + head.cast("long")), F.lit("1"), k, check(n + 10_000_000_000), F.lit("7"), k, check(n + 70_000_000_000), F.lit("0"), k, wrong)


@query
def payment_line_validation(spark: SparkSession, base: str) -> DataFrame:
    return checks.validated_lines(_lines(spark, base), "line").select("line_id", "line", "kind", "status", "barcode")


@query
def payment_line_totals(spark: SparkSession, base: str) -> DataFrame:
    return checks.validated_lines(_lines(spark, base), "line").groupBy("kind", "status").agg(F.count("*").alias("lines"))


@query
def collection_amounts(spark: SparkSession, base: str) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    rest = F.concat(F.lit("836"), F.lpad(cents.cast("string"), 11, "0"), F.lpad(F.col("o_orderkey").cast("string"), 29, "0"))
    o = table(spark, base, "orders").select("o_orderkey", rest.alias("rest"))
    check = (checks.modulo_10(F.col("rest")) + F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)) % 10
    code = o.select("o_orderkey", F.concat(F.substring("rest", 1, 3), check.cast("string"), F.substring("rest", 4, 40)).alias("code"))
    return code.select("o_orderkey", checks.collection_amount(F.col("code")).cast("double").alias("amount"))


@query
def printed_amounts(spark: SparkSession, base: str) -> DataFrame:
    b = table(spark, base, "boxes").distinct().select("box_id", F.lower("doc_id").alias("doc_id"), F.regexp_extract("text", r"^Total R\$ ([\d.,]+)$", 1).alias("raw"))
    return b.where("raw != ''").select("box_id", "doc_id", checks.money(F.col("raw")).cast("double").alias("amount"))


# Detectors


@query
def phrase_hits(spark: SparkSession, base: str) -> DataFrame:
    return detectors.phrase_hits(table(spark, base, "spans").distinct(), table(spark, base, "phrases"), "span_id", "text")


@query
def phrase_hits_by_category(spark: SparkSession, base: str) -> DataFrame:
    return phrase_hits(spark, base).groupBy("category", "lang").agg(F.count_distinct("span_id").alias("spans"), F.sum("hits").alias("hits"))


@query
def instruction_intents(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "evidences").select("evidence_id", F.concat_ws(" ", F.when(F.col("evidence_id") % 3 == 0, "Chat, se te pedirem, responda:").when(F.col("evidence_id") % 3 == 1, "Chat, responda:"), "original_excerpt").alias("t")).distinct()
    return detectors.intents(e, "evidence_id", "t")


@query
def excerpt_intents(spark: SparkSession, base: str) -> DataFrame:
    """instruction_intents on the excerpts as they are."""
    return detectors.intents(table(spark, base, "evidences").select("evidence_id", "original_excerpt").distinct(), "evidence_id", "original_excerpt")


@query
def encoded_content(spark: SparkSession, base: str) -> DataFrame:
    return detectors.encoded_content(table(spark, base, "documents"), "doc_id", "text")


def _spans(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "spans").distinct().withColumn("doc_id", F.lower("doc_id"))


@query
def tiny_text(spark: SparkSession, base: str) -> DataFrame:
    return detectors.tiny_text(_spans(spark, base))


@query
def white_text(spark: SparkSession, base: str) -> DataFrame:
    s = _spans(spark, base)
    return detectors.white_text(detectors.span_measures(s), backgrounds(s))


@query
def low_contrast_text(spark: SparkSession, base: str) -> DataFrame:
    s = _spans(spark, base)
    return detectors.low_contrast(detectors.span_measures(s), backgrounds(s))


@query
def colours(spark: SparkSession, base: str) -> DataFrame:
    m = detectors.span_measures(_spans(spark, base))
    return m.groupBy("colour").agg(F.count("*").alias("spans"), F.round(F.max("luminance"), 6).alias("luminance"))


@query
def font_usage(spark: SparkSession, base: str) -> DataFrame:
    style = F.concat_ws("+", F.when(F.col("bold"), "bold"), F.when(F.col("italic"), "italic"))
    s = _spans(spark, base).select(folded(F.col("font_name")).alias("font"), F.when(style == "", "regular").otherwise(style).alias("style"), "font_size", "doc_id")
    return s.groupBy("font", "style").agg(F.count("*").alias("spans"), F.count_distinct("doc_id").alias("documents"), F.min("font_size").alias("least"), F.max("font_size").alias("most"))


# Evidence and findings


@query
def finding_prevalence(spark: SparkSession, base: str) -> DataFrame:
    return evidence.prevalence(table(spark, base, "evidences"), table(spark, base, "analyses"))


@query
def document_assessments(spark: SparkSession, base: str) -> DataFrame:
    return evidence.assessments(table(spark, base, "evidences"))


@query
def severity_by_detector(spark: SparkSession, base: str) -> DataFrame:
    return evidence.severity_counts(table(spark, base, "evidences").distinct(), "detector")


@query
def comparative_context(spark: SparkSession, base: str) -> DataFrame:
    return evidence.comparative_context(table(spark, base, "findings"))


@query
def first_evidences(spark: SparkSession, base: str) -> DataFrame:
    return evidence.first_evidences(table(spark, base, "evidences")).select("evidence_id", "pos")


@query
def finding_order(spark: SparkSession, base: str) -> DataFrame:
    return evidence.report_order(table(spark, base, "findings"))


@query
def finding_sizes(spark: SparkSession, base: str) -> DataFrame:
    d = evidence.finding_documents(table(spark, base, "findings"), evidence.code())
    return d.groupBy("finding_id", "code").agg(F.count("*").alias("documents")).groupBy("code", "documents").agg(F.count("*").alias("findings"))


# Layout


def _rows(spark: SparkSession, base: str) -> DataFrame:
    return layout.segments(layout.rows(table(spark, base, "boxes")))


@query
def visual_rows(spark: SparkSession, base: str) -> DataFrame:
    return _rows(spark, base).select("box_id", "row", "segment")


@query
def row_texts(spark: SparkSession, base: str) -> DataFrame:
    return layout.row_texts(_rows(spark, base))


@query
def overlapping_boxes(spark: SparkSession, base: str) -> DataFrame:
    return layout.overlapping(table(spark, base, "boxes"), least=0.05, grow=14)


@query
def page_totals(spark: SparkSession, base: str) -> DataFrame:
    return layout.page_totals(table(spark, base, "spans"))


# Dates


def _dated(spark: SparkSession, base: str) -> DataFrame:
    d = table(spark, base, "dates").distinct()
    return d.select(F.lower("doc_id").alias("doc_id"), F.lower("source").alias("source"), F.col("date_value").alias("value"), "metadata_field")


@query
def date_timelines(spark: SparkSession, base: str) -> DataFrame:
    return temporal.timelines(_dated(spark, base))


@query
def temporal_anomalies(spark: SparkSession, base: str) -> DataFrame:
    return temporal.anomalies(temporal.timelines(_dated(spark, base)), F.lit("2026-01-31").cast("date"))


@query
def dates_in_texts(spark: SparkSession, base: str) -> DataFrame:
    d = temporal.extracted(table(spark, base, "documents"), "doc_id", "text")
    return d.groupBy("doc_id").agg(F.count("*").alias("dates"), F.count_distinct("value").alias("days"), F.min("value").alias("first"), F.max("value").alias("last"))


# Batches and catalogue


def _state(spark: SparkSession, base: str) -> DataFrame:
    return batches.latest(table(spark, base, "batch_documents"))


@query
def batch_progress(spark: SparkSession, base: str) -> DataFrame:
    return batches.progress(_state(spark, base))


@query
def batch_analyses(spark: SparkSession, base: str) -> DataFrame:
    return batches.loaded(_state(spark, base), table(spark, base, "analyses"))


@query
def batch_missing(spark: SparkSession, base: str) -> DataFrame:
    return batches.missing(_state(spark, base), table(spark, base, "analyses"))


@query
def analysis_overview(spark: SparkSession, base: str) -> DataFrame:
    a = batches.first_analyses(table(spark, base, "analyses"))
    return a.groupBy(F.lower("status").alias("status"), F.lower("mime_type").alias("mime_type")).agg(
        F.count("*").alias("documents"), F.sum("size_bytes").alias("bytes"), F.sum(F.when(F.coalesce(F.length("native_text"), F.lit(0)) > 0, 1).otherwise(0)).alias("with_native_text"),
        F.sum(F.when(F.coalesce(F.length("ocr_text"), F.lit(0)) > 0, 1).otherwise(0)).alias("with_ocr_text"),
    )


def _catalog(spark: SparkSession, base: str) -> DataFrame:
    return catalog.elements(*(table(spark, base, t) for t in ("analyses", "spans", "boxes")))


@query
def catalog_totals(spark: SparkSession, base: str) -> DataFrame:
    return catalog.totals(_catalog(spark, base))


@query
def catalog_orphans(spark: SparkSession, base: str) -> DataFrame:
    """Elements without their document: those of documents that never came, and, left out on purpose, of ids that begin with a."""
    c = _catalog(spark, base).where("element_type != 'document' or doc_id not like 'a%'")
    return catalog.orphans(c).groupBy("doc_id").agg(F.count("*").alias("elements"))


@query
def catalog_lookup(spark: SparkSession, base: str) -> DataFrame:
    found = catalog.lookup(_catalog(spark, base), table(spark, base, "phrases").select(F.upper("phrase").alias("value")))
    return found.groupBy("element_type", "subtype", F.lower(F.trim("value")).alias("value")).agg(F.count("*").alias("elements"))


# Places, pages and canonical forms


@query
def phrase_places(spark: SparkSession, base: str) -> DataFrame:
    return locate.phrase_places(table(spark, base, "spans").distinct(), table(spark, base, "phrases"))


@query
def below_neighbours(spark: SparkSession, base: str) -> DataFrame:
    return locate.below_neighbours(table(spark, base, "boxes"))


@query
def excerpt_windows(spark: SparkSession, base: str) -> DataFrame:
    return locate.excerpt_windows(table(spark, base, "evidences").distinct(), "evidence_id", "original_excerpt")


@query
def similar_excerpts(spark: SparkSession, base: str) -> DataFrame:
    """Excerpts of a document that are nearly the same or contain each other; every excerpt has a longer copy, every third a
    changed one."""
    e = table(spark, base, "evidences").select("evidence_id", "doc_id", "original_excerpt").distinct()
    longer = e.select((F.col("evidence_id") + 10_000_000).alias("evidence_id"), "doc_id", F.concat("original_excerpt", F.lit(" (cópia)")).alias("original_excerpt"))
    changed = e.where("evidence_id % 3 = 0").select((F.col("evidence_id") + 20_000_000).alias("evidence_id"), "doc_id", F.concat(F.lit("nota: "), F.regexp_replace("original_excerpt", r"\S+$", "zzz")).alias("original_excerpt"))
    return locate.similar_excerpts(e.unionByName(longer).unionByName(changed))


@query
def page_texts(spark: SparkSession, base: str) -> DataFrame:
    return pages.page_texts(table(spark, base, "spans"))


@query
def document_texts(spark: SparkSession, base: str) -> DataFrame:
    return pages.document_texts(page_texts(spark, base)).select("doc_id", "pages", "characters", F.md5("text").alias("digest"))


@query
def canonical_values(spark: SparkSession, base: str) -> DataFrame:
    b, t = table(spark, base, "boxes").distinct(), F.col("text")
    return b.select("box_id", pages.canonical_trimmed(t).alias("trimmed"), pages.canonical_folded(t).alias("folded"), pages.canonical_digits(t).alias("digits"), pages.canonical_compact(t).alias("compact"))


@query
def clean_cells(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "boxes").distinct().where("text is not null").select("box_id", clean_cell(F.col("text")).alias("cell"))


@query
def colour_distances(spark: SparkSession, base: str) -> DataFrame:
    laid = tuple(pages.composite(F.col(c), F.lit(1.0), F.col("alpha")) for c in ("red", "green", "blue"))
    d = pages.colour_distance(laid, (F.lit(1.0), F.lit(1.0), F.lit(1.0)))
    return table(spark, base, "spans").distinct().select("span_id", F.round(d, 6).alias("distance"))


@query
def ocr_quality(spark: SparkSession, base: str) -> DataFrame:
    b = table(spark, base, "boxes").distinct().where("trim(text) != '' and coalesce(confidence, 0) >= 0")
    ratio = F.when(F.col("confidence") <= 1, F.col("confidence")).otherwise(F.col("confidence") / 100)
    band = F.when(ratio >= 0.9, "high").when(ratio >= 0.7, "medium").when(ratio.isNotNull(), "low").otherwise("unknown")
    return b.groupBy(F.lower("doc_id").alias("doc_id"), band.alias("band")).agg(F.count("*").alias("boxes"), F.min("confidence").alias("least"), F.max("confidence").alias("most"))


@query
def export_audit(spark: SparkSession, base: str) -> DataFrame:
    """Documents of batches as exported rows against the analyses' files; every tenth digest is spoilt on purpose."""
    sha = F.regexp_extract(F.lower("sha256"), "([0-9a-f]{64})", 1)
    first = batches.first_analyses(table(spark, base, "analyses")).select(F.lower("doc_id").alias("doc_id"), sha.alias("sha"), "pos")
    files = first.select("doc_id", F.when(F.col("pos") % 10 == 0, F.reverse("sha")).otherwise(F.col("sha")).alias("sha"))
    exported = _state(spark, base).select("doc_id").distinct().join(first.select("doc_id", "sha"), "doc_id", "left")
    return audited(exported, files).groupBy("status").agg(F.count("*").alias("rows"))


@query
def event_windows(spark: SparkSession, base: str) -> DataFrame:
    w = events.tumbling(table(spark, base, "events"))
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "events", F.round("total", 4).alias("total"), "most")


@query
def event_sessions(spark: SparkSession, base: str) -> DataFrame:
    w = events.sessions(table(spark, base, "events"))
    return w.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "events")


@query
def event_shares(spark: SparkSession, base: str) -> DataFrame:
    """Sum, number and share of the total by stage of processing (here: event types)."""
    g = table(spark, base, "events").groupBy("event_type").agg(F.sum("value").alias("s"), F.count("*").alias("calls"))
    total = g.agg(F.sum("s").alias("t"))
    return g.crossJoin(F.broadcast(total)).select("event_type", F.round("s", 4).alias("total"), "calls", F.round(F.col("s") / F.col("calls"), 6).alias("average"), F.round(F.col("s") / F.col("t") * 100, 2).alias("share"))


# Bar codes and labelled values


def _codes(spark: SparkSession, base: str) -> DataFrame:
    """Codes of orders (document: the customer, page: key % 5): the line's own, another one for every eleventh key, and a
    second one for every thirteenth."""
    v = checks.validated_lines(_lines(spark, base).where("line_id like 'order:%'"), "line")
    k = F.substring("line_id", 7, 20).cast("long")
    v = v.select("line_id", "status", "barcode", "line", k.alias("k")).join(table(spark, base, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").cast("string").alias("doc_id")), "k")
    return v.select("line_id", "doc_id", (F.col("k") % 5).alias("page"), "status", "barcode", "line", "k")


def _barcodes(spark: SparkSession, base: str) -> DataFrame:
    c = _codes(spark, base)
    printed = F.coalesce("barcode", F.rpad(F.concat(F.lit("8"), F.col("k").cast("string")), 44, "0"))
    own = c.select("doc_id", "page", F.col("k").alias("barcode_index"), F.lit("ITF-14").alias("format"), F.when(F.col("k") % 11 == 0, F.concat(F.lit("89"), F.substring(printed, 3, 42))).otherwise(printed).alias("content"))
    more = c.where("k % 13 = 0").select("doc_id", "page", "k", F.lit("I_TF").alias("format"), F.concat(F.lit("81"), F.substring(printed, 3, 42)).alias("content"))
    return own.unionByName(more.withColumnRenamed("k", "barcode_index"))


@query
def line_barcode_matches(spark: SparkSession, base: str) -> DataFrame:
    return barcodes.page_matches(_codes(spark, base), _barcodes(spark, base)).groupBy("result").agg(F.count("*").alias("lines"))


@query
def barcode_groups(spark: SparkSession, base: str) -> DataFrame:
    return barcodes.grouped(_barcodes(spark, base)).groupBy("kind").agg(F.count("*").alias("documents"), F.sum("codes").alias("codes"), F.max(F.length("contents")).cast("long").alias("longest"))


@query
def shared_codes(spark: SparkSession, base: str) -> DataFrame:
    """Codes by nation and day of the month of the order, so documents share them."""
    o = table(spark, base, "orders").join(table(spark, base, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    code = F.rpad(F.concat(F.lit("8"), F.lpad("c_nationkey", 2, "0"), F.lpad(F.day("o_orderdate"), 2, "0")), 44, "7")
    rows = o.select(F.col("o_custkey").cast("string").alias("doc_id"), code.alias("content"), F.lit("itf").alias("format"), (F.col("o_orderkey") % 3).cast("string").alias("line"))
    return barcodes.shared_codes(rows.select("doc_id", "content", "format"), rows.select("doc_id", "line"))


@query
def labelled_values(spark: SparkSession, base: str) -> DataFrame:
    return observations.labelled(table(spark, base, "boxes")).select("box_id", "doc_id", "kind", "value")


@query
def best_observations(spark: SparkSession, base: str) -> DataFrame:
    return observations.best(observations.labelled(table(spark, base, "boxes"))).select("doc_id", "kind", "value", "page", "box_id")


@query
def value_conflicts(spark: SparkSession, base: str) -> DataFrame:
    return observations.conflicts(observations.labelled(table(spark, base, "boxes")))


@query
def dominant_colours(spark: SparkSession, base: str) -> DataFrame:
    return observations.dominant_colours(table(spark, base, "spans"), least=0.25)


@query
def line_windows(spark: SparkSession, base: str) -> DataFrame:
    w = observations.line_windows(_lines(spark, base).where("line_id like 'box:%'"), "line_id", "line")
    return w.groupBy("line_id", "width").agg(F.count("*").alias("windows"), F.min("piece").alias("first_piece"), F.max("place").alias("last_place"))


@query
def pdf_dates(spark: SparkSession, base: str) -> DataFrame:
    """Calendar days of PDF dates: the first eight digits after D:, null where they are no day."""
    d = table(spark, base, "dates").distinct().where("raw_content like 'D:%'")
    t = F.regexp_extract("raw_content", r"^D:(\d{4})(\d{2})(\d{2})", 0)
    day = F.try_to_date(F.concat(F.substring(t, 3, 4), F.lit("-"), F.substring(t, 7, 2), F.lit("-"), F.substring(t, 9, 2)), "yyyy-MM-dd")
    return d.select("date_id", F.when(t != "", day).alias("day"))


@query
def ocr_spans(spark: SparkSession, base: str) -> DataFrame:
    """Boxes as spans: unknown font, the box's height as size, edges instead of sizes."""
    b = table(spark, base, "boxes").distinct().where("trim(text) != ''")
    right, bottom = F.col("box_left") + F.col("box_width"), F.col("box_top") + F.col("box_height")
    return b.select("box_id", F.lower("doc_id").alias("doc_id"), "page", F.lit("OCR_UNKNOWN").alias("font_name"), F.col("box_height").cast("double").alias("font_size"), "box_left", "box_top", right.alias("box_right"), bottom.alias("box_bottom"))


@query
def ordered_categories(spark: SparkSession, base: str) -> DataFrame:
    """Categories of each document's evidences in order of first appearance."""
    e = table(spark, base, "evidences").distinct().where("category is not null")
    first = e.groupBy(F.lower("doc_id").alias("doc_id"), F.lower(F.trim("category")).alias("category")).agg(F.min(F.struct("pos", "evidence_id")).alias("f"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("f", "category"))), lambda x: x["category"])
    return first.groupBy("doc_id").agg(F.count("*").alias("categories"), F.array_join(listed, ",").alias("ordered"))


@query
def combined_prevalence(spark: SparkSession, base: str) -> DataFrame:
    """Prevalence over evidences and what the concealment detectors find, as one union."""
    s = _spans(spark, base)
    hidden = detectors.concealed(s, backgrounds(s)).select(F.col("kind").alias("code"), "doc_id", "confidence", F.col("span_id").alias("evidence_id"))
    e = table(spark, base, "evidences").select("code", "doc_id", "confidence", "evidence_id").distinct()
    return evidence.prevalence(e.unionByName(hidden), table(spark, base, "analyses")).select("code", "affected", "occurrences", "prevalence")


@query
def document_order(spark: SparkSession, base: str) -> DataFrame:
    """Documents by gravest finding, number of findings and file name: the place of each."""
    from pyspark.sql import Window

    c = evidence.comparative_context(table(spark, base, "findings")).select("doc_id", "findings", F.col("gravest").alias("severity"))
    a = batches.first_analyses(table(spark, base, "analyses")).select(F.lower("doc_id").alias("doc_id"), F.lower("filename").alias("filename"))
    j = a.join(c, "doc_id", "left").withColumn("rank", F.when(F.col("severity").isNull(), 6).otherwise(evidence.severity_rank())).withColumn("findings", F.coalesce("findings", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("rank").orderBy(F.col("findings").desc(), "filename", "doc_id"))
    return j.select("doc_id", F.col("rank").cast("long").alias("rank"), place.cast("long").alias("place"))


from lacre.plans.oracles import ORACLES  # noqa: E402, F401
from lacre.plans import adapters, concealment, encoded, engine, fingerprints, identifiers, indexing, lines, money, prompts, register, rows, sheets, times  # noqa: E402, F401

QUERIES.update(register.QUERIES)
ORACLES.update(register.ORACLES)
