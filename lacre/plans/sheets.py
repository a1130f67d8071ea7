"""Queries of the report's sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacre.functions import checks
from lacre.operators import barcodes as codes
from lacre.operators import batches, detectors, evidence, images, observations
from lacre.plans import concealment, oracles
from lacre.plans.derived import BARCODES, FINGERPRINTS, backgrounds, barcodes, fingerprints
from lacre.plans.oracles import CLAMP, FIRST, NAMED, NAMES, RANK, STATE
from lacre.plans.register import query
from lacre.sources import sheets
from lacre.sources.tables import table


def _state(spark: SparkSession, base: str) -> DataFrame:
    return batches.latest(table(spark, base, "batch_documents"))


_NAMED = NAMED.removeprefix("with ")
_TIMES = "tm as (select batch_id, min(event_ts) started, max(event_ts) finished from (select * from b qualify row_number() over (partition by batch_id, doc_id order by coalesce(event_ts, timestamptz '1970-01-01 00:00:00+00') desc, status desc, coalesce(analysis_id, '') desc) = 1) group by 1)"
SUMMARY = (
    STATE + ", g as (select batch_id, count(*) total, " + ", ".join(f"sum((status = '{s}')::int)::bigint {s}" for s in ("pending", "processing", "completed", "failed")) + f" from s group by 1), {_TIMES}, {_NAMED}, "
    "k as (select batch_id, count(distinct code) finding_types from s join n using (doc_id) group by 1) select batch_id, total, pending, processing, completed, failed, round((completed + failed) / total * 100, 2) as progress, "
    "case when pending + processing > 0 then 'processing' when failed = total then 'failed' when failed = 0 then 'completed' else 'completed_with_errors' end as status, strftime(started at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as started, "
    "strftime(finished at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as finished, coalesce(finding_types, 0) as finding_types, coalesce(finding_types, 0) > 0 as has_findings from g join tm using (batch_id) left join k using (batch_id)"
)


@query(SUMMARY)
def sheet_summary(spark: SparkSession, base: str) -> DataFrame:
    s = sheets.summary(_state(spark, base), table(spark, base, "findings"))
    return s.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("started", "finished")})


@query(
    STATE + f", {_NAMED}, c as (select doc_id, count(*) k, {NAMES}[min({RANK}) + 1] sev from n group by 1), " + BARCODES + ", m as (select doc_id, count(*) q from bc where trim(content) <> '' group by 1), e as (select distinct batch_id, lower(doc_id) doc_id, status, analysis_id from s) "
    "select batch_id, s.doc_id, status, analysis_id, coalesce(k, 0) as comparative_findings, sev as comparative_severity, coalesce(q, 0) as barcodes from s left join c using (doc_id) left join m using (doc_id)"
)
def sheet_documents(spark: SparkSession, base: str) -> DataFrame:
    return sheets.documents(_state(spark, base), table(spark, base, "findings"), barcodes(spark, base)).drop("error_message")


@query(
    STATE + f", e as (select distinct * from evidences where trim(code) <> ''), p as (select upper(trim(code)) code, lower(doc_id) doc_id, count(*) n, max({CLAMP}) c from e group by 1, 2), t as (select batch_id, count(distinct doc_id) total from s group by 1), "
    "g as (select batch_id, code, count(*) affected, sum(n)::bigint occurrences, max(c) c from (select distinct batch_id, doc_id from s) join p using (doc_id) group by 1, 2) "
    "select batch_id, code, array_to_string(list_transform(string_split(lower(regexp_replace(code, '_+', ' ', 'g')), ' '), lambda x: upper(x[1]) || x[2:]), ' ') as title, affected, total as total_documents, occurrences, round(affected / total * 100, 2) as prevalence, c as highest_confidence from g join t using (batch_id)"
)
def sheet_findings(spark: SparkSession, base: str) -> DataFrame:
    return sheets.findings_by_type(_state(spark, base), table(spark, base, "evidences"))


@query("select distinct upper(trim(code)) as code, lower(doc_id) as doc_id from evidences where trim(code) <> ''")
def sheet_affected(spark: SparkSession, base: str) -> DataFrame:
    return sheets.affected_documents(table(spark, base, "evidences"))


_EVIDENCE = (
    oracles.LABELLED + ", e as (select distinct * from evidences), " + BARCODES + f"select lower(doc_id) as doc_id, upper(trim(code)) as code, lower(severity) as severity, page, round({CLAMP}, 4) as confidence, evidence_id::varchar as reference from e union all "
    "select doc_id, 'BARCODE_READ_OBSERVED', 'info', page, 1.0, barcode_index::varchar from bc where trim(content) <> '' union all select doc_id, 'DOCUMENT_IDENTIFIER_OBSERVED', 'info', page, round(confidence / 100, 4), kind || ':' || value from v"
)


@query(_EVIDENCE)
def sheet_evidences(spark: SparkSession, base: str) -> DataFrame:
    return sheets.evidence_rows(table(spark, base, "evidences"), barcodes(spark, base), observations.labelled(table(spark, base, "boxes")))


_FINANCIAL = oracles.LINES + (
    ", o2 as (select 'order:' || o_orderkey as line_id, 'c' || o_custkey as doc_id, o_orderkey k from orders), v as (select line_id, doc_id, line, status, case when status = 'VALID' then code end as barcode, k from verdict join o2 using (line_id)), "
    "am as (select o_orderkey, '836' || lpad(round(o_totalprice * 100)::bigint::varchar, 11, '0') || lpad(o_orderkey::varchar, 29, '0') r from orders) "
    "select 'validation' as record_type, doc_id, line_id as reference, status, line as content from v union all select 'comparison', doc_id, line_id, case when status <> 'VALID' then 'INCONCLUSIVE' when k % 11 = 0 then 'MISMATCH' else 'MATCH' end, barcode from v union all "
    "select 'value', 'c' || o_custkey, 'ITF', 'OBSERVED', printf('%.2f', substr(r, 4, 11)::bigint / 100) from am join orders using (o_orderkey)"
)


def _lines(spark: SparkSession, base: str) -> DataFrame:
    from lacre.plans.queries import _lines as every

    o = table(spark, base, "orders").select(F.concat(F.lit("order:"), "o_orderkey").alias("line_id"), F.concat(F.lit("c"), "o_custkey").alias("doc_id"), F.col("o_orderkey").alias("k"))
    return checks.validated_lines(every(spark, base).join(o, "line_id"), "line")


@query(_FINANCIAL)
def sheet_financial(spark: SparkSession, base: str) -> DataFrame:
    """Lines of orders, each on a page of its own with its code (another one for every eleventh), and the orders' amounts."""
    v = _lines(spark, base)
    printed = v.where("status = 'VALID'").select("doc_id", F.col("k").alias("page"), F.lit("ITF").alias("format"), F.when(F.col("k") % 11 == 0, F.concat(F.lit("89"), F.substring("barcode", 3, 42))).otherwise(F.col("barcode")).alias("content"))
    m = codes.page_matches(v.withColumn("page", F.col("k")), printed).join(v.select("line_id", "doc_id", "barcode"), "line_id")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    values = table(spark, base, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("doc_id"), F.lit("ITF").alias("source"), (cents.cast("decimal(18,2)") / 100).cast("decimal(18,2)").alias("amount"))
    return sheets.financial_rows(v, m, values)


_ASSESSED = oracles.ORACLES["document_assessments"]


@query(
    f"with a as ({_ASSESSED}), e as (select distinct * replace (lower(doc_id) as doc_id) from evidences) select doc_id, evidence_id, row_number() over (partition by doc_id order by pos, evidence_id) as evidence_index, upper(trim(code)) as code, lower(trim(category)) as category, e.lang, page, "
    f"round({CLAMP} * coalesce(weight, 0.5), 4) as weighted_score, score, level from e join a using (doc_id)"
)
def sheet_prompts(spark: SparkSession, base: str) -> DataFrame:
    return sheets.prompt_rows(table(spark, base, "evidences"))


def _concealed(spark: SparkSession, base: str) -> DataFrame:
    s = concealment.spans_of(spark, base)
    return detectors.concealed(s, backgrounds(s))


@query(
    concealment.HIDDEN + "select kind, span_id, doc_id, page, row_number() over (partition by doc_id order by rank, page, span_id) as finding_index, row_number() over (partition by doc_id, rank = 2 order by rank, page, span_id) as shown_index from hid"
)
def sheet_concealment(spark: SparkSession, base: str) -> DataFrame:
    """Concealed text with both numberings: running over all kinds, and beginning anew with tiny text."""
    c = _concealed(spark, base)
    shown = sheets.concealment_rows(c, running=False).select("rank", "span_id", F.col("finding_index").alias("shown_index"))
    return sheets.concealment_rows(c).join(shown, ["rank", "span_id"]).select("kind", "span_id", "doc_id", "page", "finding_index", "shown_index")


_PLACES = (
    concealment.HIDDEN + ", l as (select distinct * replace (lower(doc_id) as doc_id) from boxes where lower(text) like 'linha digit%'), e as (select distinct * replace (lower(doc_id) as doc_id) from evidences) "
    "select doc_id, 'numeric_line' as location_type, box_id::varchar as reference, page, round(case when confidence between 0 and 100 then confidence / 100 end, 4) as confidence, page is not null as located from l union all "
    "select doc_id, 'prompt', evidence_id::varchar, page, round(least(greatest(confidence, 0.0), 1.0), 4), page is not null from e union all select doc_id, 'concealment', kind || ':' || span_id, page, 1.0, true from hid"
)


@query(_PLACES)
def sheet_locations(spark: SparkSession, base: str) -> DataFrame:
    b = table(spark, base, "boxes").distinct().where("lower(text) like 'linha digit%'").select(F.lower("doc_id").alias("doc_id"), F.col("box_id").alias("reference"), "page", "confidence")
    e = table(spark, base, "evidences").distinct().select(F.lower("doc_id").alias("doc_id"), F.col("evidence_id").alias("reference"), "page", "confidence")
    c = _concealed(spark, base).select("doc_id", F.concat_ws(":", "kind", "span_id").alias("reference"), "page", F.lit(1.0).alias("confidence"))
    return sheets.location_rows(b, e, c)


@query(
    "with " + FIRST + ", s as (select lower(doc_id) doc_id, count(*) n from (select distinct * from spans) group by 1), b as (select lower(doc_id) doc_id, count(*) n from (select distinct * from boxes) group by 1), e as (select lower(doc_id) doc_id, count(*) n from (select distinct * from evidences) group by 1) "
    "select lower(f.doc_id) as doc_id, lower(filename) as filename, size_bytes, coalesce(trim(native_text), '') <> '' as has_native_text, coalesce(length(native_text), 0)::bigint as native_characters, coalesce(length(ocr_text), 0)::bigint as ocr_characters, "
    "coalesce(s.n, 0) as spans, coalesce(b.n, 0) as boxes, coalesce(e.n, 0) as evidences from f left join s on s.doc_id = lower(f.doc_id) left join b on b.doc_id = lower(f.doc_id) left join e on e.doc_id = lower(f.doc_id)"
)
def sheet_technical(spark: SparkSession, base: str) -> DataFrame:
    rows = {t: table(spark, base, t).distinct().select(F.lower("doc_id").alias("doc_id")) for t in ("spans", "boxes", "evidences")}
    return sheets.technical_rows(table(spark, base, "analyses"), rows)


@query(
    FINGERPRINTS + "select doc_id, seq, lower(trim(image_hash)) as image_hash, lower(trim(p)) as perceptual_hash, width, height, row_number() over (partition by doc_id order by seq) as fingerprint_index, count(*) over (partition by doc_id) as images from o"
)
def sheet_images(spark: SparkSession, base: str) -> DataFrame:
    return sheets.image_rows(images.occurrences(fingerprints(spark, base))).select("doc_id", "seq", "image_hash", "perceptual_hash", "width", "height", "fingerprint_index", "images")


_MATCHES = oracles.ORACLES["identifier_matches"]


@query(
    f"with im as ({_MATCHES}), {_NAMED}, d as (select finding_id, code, lower(trim(severity)) severity, count(*) documents from n group by 1, 2, 3 having count(*) > 1) select code, finding_id::varchar as reference, severity, documents from d union all "
    "select 'DOCUMENT_IDENTIFIER_' || relation, kind || ':' || value_a || ':' || value_b, 'info', documents from im"
)
def sheet_comparisons(spark: SparkSession, base: str) -> DataFrame:
    from lacre.plans.queries import identifier_matches

    return sheets.comparison_rows(table(spark, base, "findings"), identifier_matches(spark, base))


_BOOK = {"summary": SUMMARY, "evidences": _EVIDENCE, "financial": _FINANCIAL, "locations": _PLACES}


@query(" union all ".join(f"select '{k}' as sheet, count(*) as rows from ({v})" for k, v in _BOOK.items()))
def workbook_rows(spark: SparkSession, base: str) -> DataFrame:
    """Row counts of a workbook's sheets."""
    made = {"summary": sheet_summary, "evidences": sheet_evidences, "financial": sheet_financial, "locations": sheet_locations}
    return sheets.row_counts({k: f(spark, base) for k, f in made.items()})


@query(
    f"with {_NAMED}, k as (select code, {RANK} r from n) select code, " + ", ".join(f"sum((r = {i})::int)::bigint as {s}" for i, s in enumerate(("critical", "high", "medium", "low", "info")))
    + f", {NAMES}[min(r) + 1] as gravest, sum((r < 5)::int)::bigint as total, sum((r < 5)::int)::bigint || ' evidences, gravest ' || {NAMES}[min(r) + 1] as message from k group by 1"
)
def comparison_view(spark: SparkSession, base: str) -> DataFrame:
    """Related documents of findings by severity, for each code."""
    return sheets.severity_view(evidence.finding_documents(table(spark, base, "findings"), evidence.code()), "code")


@query(
    f"with e as (select distinct * replace (lower(doc_id) as doc_id) from evidences), k as (select doc_id, {RANK} r from e) select doc_id, " + ", ".join(f"sum((r = {i})::int)::bigint as {s}" for i, s in enumerate(("critical", "high", "medium", "low", "info")))
    + f", {NAMES}[min(r) + 1] as gravest, sum((r < 5)::int)::bigint as total, sum((r < 5)::int)::bigint || ' evidences, gravest ' || {NAMES}[min(r) + 1] as message from k group by 1"
)
def evidence_report_view(spark: SparkSession, base: str) -> DataFrame:
    """Evidences of each document by severity, with a message."""
    return sheets.severity_view(table(spark, base, "evidences").distinct().withColumn("doc_id", F.lower("doc_id")), "doc_id")


@query(
    oracles.LINES + ", o2 as (select 'order:' || o_orderkey as line_id, 'c' || o_custkey as doc_id, o_orderkey k from orders) select doc_id, count(*) as lines, sum((status = 'VALID')::int)::bigint as valid, sum((status = 'INVALID')::int)::bigint as invalid, "
    "sum((status = 'VALID' and k % 11 <> 0)::int)::bigint as matches, sum((status = 'VALID' and k % 11 = 0)::int)::bigint as mismatches, sum((status <> 'VALID')::int)::bigint as inconclusive from verdict join o2 using (line_id) group by 1"
)
def analysis_view(spark: SparkSession, base: str) -> DataFrame:
    """What one analysis shows of its payment lines: how many are valid, match their code, or are inconclusive."""
    f = sheet_financial(spark, base)
    n = lambda kind, *s: F.sum(((F.col("record_type") == kind) & F.col("status").isin(*s)).cast("long"))
    g = f.where("record_type != 'value'").groupBy("doc_id").agg(
        F.sum((F.col("record_type") == "validation").cast("long")).alias("lines"), n("validation", "VALID").alias("valid"), n("validation", "INVALID").alias("invalid"), n("comparison", "MATCH").alias("matches"),
        n("comparison", "MISMATCH").alias("mismatches"), n("comparison", "INCONCLUSIVE").alias("inconclusive"),
    )
    return g


