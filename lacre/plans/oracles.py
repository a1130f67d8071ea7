"""The same results in SQL over the same tables, for the queries that SQL can express."""

from __future__ import annotations

from lacre.functions.text import SPACES, forms
from lacre.operators.detectors import INSTRUCTIONS, SIGNALS
from lacre.operators.observations import KINDS, MEMBERS, PLAIN

UUID = (
    "case when regexp_full_match(regexp_replace(regexp_replace(lower(trim(x)), '^urn:uuid:', ''), '[{}\\s-]', '', 'g'), '[0-9a-f]{32}') then "
    "regexp_replace(regexp_replace(regexp_replace(lower(trim(x)), '^urn:uuid:', ''), '[{}\\s-]', '', 'g'), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') end"
)
RANK = "case lower(trim(severity)) when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 when 'info' then 4 else 5 end"
NAMES = "['critical', 'high', 'medium', 'low', 'info', 'unknown']"
CLAMP = "least(greatest(coalesce(confidence, 0.0), 0.0), 1.0)"


def unaccented(c: str) -> str:
    source, target, several = forms()
    pairs = ", ".join(f"'{k}': '{v}'" for k, v in several.items())
    spelt = f"array_to_string(list_transform(string_split({c}, ''), lambda x: coalesce((map {{{pairs}}})[x], x)), '')"
    target = target.replace("'", "''")
    return f"translate(case when regexp_matches({c}, '[{''.join(several)}]') then {spelt} else {c} end, '{source}', '{target}')"


def folded(c: str) -> str:
    return f"trim(regexp_replace(lower({unaccented(c)}), '{SPACES}', ' ', 'g'))"


def mod10(c: str, n: int) -> str:
    terms = " + ".join(
        f"(case when {w}*substr({c}, {n - i}, 1)::int > 9 then {w}*substr({c}, {n - i}, 1)::int - 9 else {w}*substr({c}, {n - i}, 1)::int end)" for i in range(n) for w in (2 if i % 2 == 0 else 1,)
    )
    return f"((10 - ({terms}) % 10) % 10)"


def mod11(c: str, n: int) -> str:
    rest = "((" + " + ".join(f"substr({c}, {n - i}, 1)::int * {i % 8 + 2}" for i in range(n)) + ") % 11)"
    return f"(case when {rest} in (0, 1) then 0 when {rest} = 10 then 1 else 11 - {rest} end)"


GROUPS = """with a as (select {key} as key, {doc} as doc from {rows}), p as (select key, doc, count(*) n from a where key is not null and key <> '' group by 1, 2)
select key, sum(n)::bigint as elements, count(*) as documents, (sum(n) * (sum(n) - 1) / 2)::bigint as relations, (sum(n) * (sum(n) - 1) / 2 - sum(n * (n - 1) / 2))::bigint as cross_relations
from p group by 1 having sum(n) >= 2"""
DIGESTS = GROUPS.format(key="regexp_extract(lower(sha256), '([0-9a-f]{64})', 1)", doc="lower(doc_id)", rows="analyses")

LINES = (
    "with boxed as (select distinct * from boxes where lower(text) like 'linha digit%'), o as (select o_orderkey, lpad(o_orderkey::varchar, 10, '0') k from orders), "
    "parts as (select o_orderkey, '846' || substr(k, 3, 8) a, '1' || k b, '7' || k c, '0' || k d from o), "
    "lines as (select 'box:' || box_id as line_id, regexp_replace(text, '[^0-9]', '', 'g') as line from boxed union all "
    f"select 'order:' || o_orderkey, a || {mod10('a', 11)} || b || {mod10('b', 11)} || c || {mod10('c', 11)} || d || (({mod10('d', 11)} + case when o_orderkey % 7 = 0 then 1 else 0 end) % 10) from parts), "
    "checked as (select *, case when length(line) = 47 then 'BANK_SLIP' when length(line) = 48 and line like '8%' then 'COLLECTION' else 'UNKNOWN' end as kind from lines), "
    "f as (select *, "
    + ", ".join(f"substr(line, {a + 1}, {n}) s{i}, substr(line, {a + n + 1}, 1)::int t{i}" for i, (a, n) in enumerate(((0, 9), (10, 10), (21, 10))))
    + " from checked where kind = 'BANK_SLIP'), g as (select *, "
    + ", ".join(f"substr(line, {12 * i + 1}, 11) s{i}, substr(line, {12 * i + 12}, 1)::int t{i}" for i in range(4))
    + " from checked where kind = 'COLLECTION'), verdict as (select line_id, line, kind, case when "
    + " and ".join(f"{mod10(f's{i}', n)} = t{i}" for i, n in enumerate((9, 10, 10)))
    + " then 'VALID' else 'INVALID' end as status, substr(line, 1, 4) || substr(line, 33, 15) || substr(line, 5, 5) || substr(line, 11, 10) || substr(line, 22, 10) as code from f union all "
    "select line_id, line, kind, case when substr(line, 3, 1) in ('6', '7') then case when "
    + " and ".join(f"{mod10(f's{i}', 11)} = t{i}" for i in range(4))
    + " then 'VALID' else 'INVALID' end when substr(line, 3, 1) in ('8', '9') then case when "
    + " and ".join(f"{mod11(f's{i}', 11)} = t{i}" for i in range(4))
    + " then 'VALID' else 'INVALID' end else 'INCONCLUSIVE' end, s0 || s1 || s2 || s3 from g union all select line_id, line, kind, 'INCONCLUSIVE', null from checked where kind = 'UNKNOWN') "
)

SPAN = "(select distinct * replace (lower(doc_id) as doc_id) from spans)"
LINEAR = "(case when {c} <= 0.04045 then {c} / 12.92 else pow(({c} + 0.055) / 1.055, 2.4) end)"
LUM = "0.2126 * " + LINEAR.format(c="red") + " + 0.7152 * " + LINEAR.format(c="green") + " + 0.0722 * " + LINEAR.format(c="blue")
MEASURED = (
    f"with s as (select *, {LUM} as luminance, '#' || " + " || ".join(f"lpad(upper(to_hex(round({c} * 255)::int)), 2, '0')" for c in ("red", "green", "blue")) + f" as colour from {SPAN}), "
    "page as (select doc_id, page, median(font_size) page_size from s where trim(text) <> '' and font_size > 0 group by 1, 2), m as (select s.*, page_size, case when span_id % 10 <> 9 then case when span_id % 7 = 0 then pow((0.2::double + 0.055) / 1.055, 2.4) else 1.0::double end end as bl, 0.55::double + (span_id % 9) / 20 as dom from s left join page using (doc_id, page)) "
)
RATIO = "((greatest(luminance, bl) + 0.05) / (least(luminance, bl) + 0.05))"

WORD = "'[\\p{L}\\p{N}_]'"
#: Places are tried one after the other, with a word-edge test where the phrase's own edge is a letter or digit.
HITS = (
    f"with t as (select distinct span_id, {folded('text')} t from spans where text is not null), p as (select phrase_id, category, lang, {folded('phrase')} p from phrases), "
    "c as (select * from t, p where p <> '' and contains(t, p)), "
    "places as (select *, list_filter(range(1, length(t) - length(p) + 2), lambda i: substr(t, i, length(p)) = p "
    f"and (not regexp_matches(substr(p, 1, 1), '[\\p{{L}}\\p{{N}}]') or i = 1 or not regexp_matches(substr(t, i - 1, 1), {WORD})) "
    f"and (not regexp_matches(substr(p, length(p), 1), '[\\p{{L}}\\p{{N}}]') or i + length(p) > length(t) or not regexp_matches(substr(t, i + length(p), 1), {WORD}))) as spots from c), "
    "hits as (select span_id, phrase_id, category, lang, p, spots, length(spots)::bigint as hits from places where length(spots) > 0) "
)


def _group(signals: tuple[str, ...]) -> str:
    tests = [f"contains(f, '{s}')" for s in signals] + [f"contains(c, '{s.replace(' ', '')}')" for s in signals if len(s.replace(" ", "")) >= 4]
    return "(" + " or ".join(tests) + ")"


INTENTS = (
    f"with t as (select distinct evidence_id, concat_ws(' ', case evidence_id % 3 when 0 then 'Chat, se te pedirem, responda:' when 1 then 'Chat, responda:' end, original_excerpt) t from evidences), n as (select evidence_id, {folded('t')} f, regexp_replace(lower({unaccented('t')}), '[^a-z0-9]', '', 'g') c from t), "
    "g as (select evidence_id, " + ", ".join(f"{_group(s)} as {k}" for k, s in SIGNALS.items()) + " from n), "
    "k as (select *, " + " + ".join(f"{k}::int" for k in SIGNALS) + " as n from g) "
    "select evidence_id, n::bigint as groups, round(least((case when n >= 5 then 0.98 when n >= 4 then 0.92 when n >= 3 then 0.82 else 0.72 end)::double + (case when bias_control then 0.02 else 0.0 end)::double, 1.0), 4) as confidence "
    "from k where ai_targeting and response_command and n >= 3"
)

PLACED = (
    "with b as (select distinct * replace (lower(doc_id) as doc_id) from boxes where trim(text) <> ''), "
    "g as (select *, case when box_top - lag(box_top) over w > 0.5 * box_height then 1 else 0 end nw from b window w as (partition by doc_id, page order by box_top, box_left, box_id)), "
    "r as (select * exclude (nw), sum(nw) over (partition by doc_id, page order by box_top, box_left, box_id rows unbounded preceding)::bigint as row from g), "
    "h as (select *, case when box_left - lag(box_left + box_width) over (partition by doc_id, page, row order by box_left, box_id) > 140 then 1 else 0 end nw from r), "
    "cut as (select * exclude (nw), sum(nw) over (partition by doc_id, page, row order by box_left, box_id rows unbounded preceding)::bigint as segment from h) "
)
DATED = "with d as (select distinct * from dates), t as (select lower(doc_id) doc_id, lower(source) source, date_value v, metadata_field f from d where date_value is not null), "
LINES_OF_TIME = (
    DATED + "tl as (select doc_id, count(*) as dates, count(distinct v) as days, min(v) as first, max(v) as last, min(v) filter (source in ('native_text', 'ocr')) as first_content, "
    "max(v) filter (source in ('native_text', 'ocr')) as last_content, min(v) filter (f = 'creationDate') as created, min(v) filter (f = 'modDate') as modified, "
    "(select max(abs(date_diff('day', m.v, k.v))) from t m join t k on m.doc_id = k.doc_id where m.doc_id = t.doc_id and m.source = 'pdf_metadata' and k.source in ('native_text', 'ocr'))::bigint as divergence from t group by 1) "
)
STATE = (
    "with b as (select distinct * replace (lower(doc_id) as doc_id, lower(status) as status) from batch_documents), s as (select batch_id, doc_id, status, analysis_id from b "
    "qualify row_number() over (partition by batch_id, doc_id order by coalesce(event_ts, timestamptz '1970-01-01 00:00:00+00') desc, status desc, coalesce(analysis_id, '') desc) = 1) "
)
FIRST = "f as (select a.* from analyses a join (select lower(doc_id) k, min(pos) pos from analyses group by 1) using (pos)) "
NAMED = f"with u as (select distinct on (finding_id) * from findings), n as (select finding_id, upper(trim(code)) code, severity, unnest(list_distinct(list_filter(list_transform(doc_ids, lambda x: {UUID}), lambda x: x is not null))) doc_id from u) "
CATALOG = (
    "with a as (select lower(doc_id) doc_id, regexp_extract(lower(sha256), '([0-9a-f]{64})', 1) sha, coalesce(case when trim(native_text) <> '' then native_text end, ocr_text) t from analyses where doc_id is not null qualify row_number() over (partition by lower(doc_id) order by pos) = 1), "
    "s as (select distinct * replace (lower(doc_id) as doc_id) from spans), b as (select distinct * replace (lower(doc_id) as doc_id) from boxes), "
    "c as (select doc_id, 'document' element_type, null::varchar subtype, doc_id as value, 'source' as layer from a union all select doc_id, 'hash', 'sha256', sha, 'source' from a where sha <> '' union all "
    "select doc_id, 'text', 'content', md5(t), 'extracted' from a where t is not null union all select doc_id, 'text', 'span', text, 'extracted' from s union all select doc_id, 'text', 'box', text, 'extracted' from b where text is not null) "
)
OBSERVED = (
    "with b as (select distinct * from boxes), o as (select case lower(regexp_extract(text, '^\\s*([^:]+):\\s*\\d{4,}\\s*$', 1)) when 'nº conta' then 'account' when 'nº da fatura' then 'invoice' when 'agência/código' then 'customer' "
    "when 'carteira' then 'portfolio' end kind, regexp_extract(text, ':\\s*(\\d{4,})\\s*$', 1) as value, lower(doc_id) doc_id from b), "
    "v as (select kind, value, count(distinct doc_id) docs from o where kind is not null group by 1, 2), "
    "m as (select kind, value, docs, unnest(list_transform(range(1, length(value) + 1), lambda i: substr(value, 1, i - 1) || '*' || substr(value, i + 1))) mask from v), "
    "w as (select kind, value, docs, unnest(list_distinct(list_transform(range(1, length(value)), lambda i: substr(value, 1, i - 1) || substr(value, i + 1, 1) || substr(value, i, 1) || substr(value, i + 2)))) other from v) "
)

LABELLED = (
    f"with b as (select distinct * from boxes where text like '%:%'), l as (select *, trim(translate(lower(regexp_extract(text, '^\\s*([^:]{{3,40}}):', 1)), '{MEMBERS}', '{PLAIN}')) n, trim(regexp_extract(text, '^[^:]+:\\s*(.+?)\\s*$', 1)) r from b), k as (select *, case "
    + " ".join(f"when regexp_full_match(n, '{p}') then '{k}'" for k, p in KINDS)
    + " end kind, regexp_replace(r, '[.\\-/ ]', '', 'g') d from l), v as (select box_id, lower(doc_id) doc_id, page, coalesce(confidence, 0.0) confidence, kind, case when kind = 'holder' then case when regexp_full_match(r, '[^0-9]+ [^0-9]+') then upper(r) end "
    "when regexp_full_match(d, '[0-9]{4,24}') then d end as value from k where kind is not null and value is not null) "
)

MEMBERS = """with s as (select vec_id, list_sum(list_transform(embedding, lambda x, i: case when x > 0 then (1::hugeint << (i - 1)) else 0::hugeint end))::ubigint bits from embeddings),
e as (select vec_id, bits from s union all select vec_id + 1000000, xor(bits, ((1::ubigint << (vec_id % 5)) - 1)::ubigint) from s)"""

ORACLES: dict[str, str] = {
    "exact_duplicate_groups": DIGESTS,
    "exact_duplicate_totals": f"with g as ({DIGESTS}) select count(*) as groups, coalesce(sum(elements), 0)::bigint as elements, coalesce(sum(relations), 0)::bigint as relations, coalesce(sum((documents > 1)::int), 0)::bigint as cross_groups, coalesce(sum(cross_relations), 0)::bigint as cross_relations from g",
    "text_duplicate_groups": GROUPS.format(key="sha256(text)", doc="doc_id", rows="documents where trim(text) <> ''"),
    "pair_space_reduction": "with b as (select distinct * from boxes), n as (select lower(doc_id) d, count(*) n from b group by 1) select count(*) as owners, sum(n)::bigint as rows, ((sum(n) * sum(n) - sum(n * n)) / 2)::bigint as potential_pairs from n",
    "fingerprint_pairs": """with s as (select vec_id, list_sum(list_transform(embedding, lambda x, i: case when x > 0 then (1::hugeint << (i - 1)) else 0::hugeint end))::ubigint bits from embeddings),
v as (select distinct bits from (select bits from s union all select xor(bits, ((1::ubigint << (vec_id % 5)) - 1)::ubigint) from s))
select lpad(upper(to_hex(l.bits)), 16, '0') as a, lpad(upper(to_hex(r.bits)), 16, '0') as b, bit_count(xor(l.bits, r.bits))::bigint as distance,
case when 1 - bit_count(xor(l.bits, r.bits)) / 64 >= 0.98 then 'STRONG' when 1 - bit_count(xor(l.bits, r.bits)) / 64 >= 0.95 then 'MODERATE' else 'NONE' end as class
from v l, v r where l.bits < r.bits and bit_count(xor(l.bits, r.bits)) <= 3""",
    "fingerprint_relations": MEMBERS + """, v as (select bits, count(distinct vec_id) n from e group by 1)
select lpad(upper(to_hex(l.bits)), 16, '0') as a, lpad(upper(to_hex(r.bits)), 16, '0') as b, bit_count(xor(l.bits, r.bits))::bigint as distance,
case when l.bits = r.bits then 'EXACT' when 1 - bit_count(xor(l.bits, r.bits)) / 64 >= 0.98 then 'STRONG' when 1 - bit_count(xor(l.bits, r.bits)) / 64 >= 0.95 then 'MODERATE' else 'NONE' end as class,
l.n::bigint as members_a, r.n::bigint as members_b
from v l, v r where l.bits < r.bits and bit_count(xor(l.bits, r.bits)) <= 3 or l.bits = r.bits and l.n >= 2""",
    "fingerprint_members": MEMBERS + " select distinct lpad(upper(to_hex(bits)), 16, '0') as representative, vec_id from e",
    "identifier_matches": OBSERVED + "select kind, 'EXACT' as relation, value as value_a, value as value_b, docs::bigint as documents from v where docs >= 2 union all "
    "select kind, 'ONE_DIGIT', min(value), max(value), sum(docs)::bigint from m group by kind, mask having count(*) = 2 union all "
    "select w.kind, 'TRANSPOSITION', w.value, v.value, (w.docs + v.docs)::bigint from w join v on v.kind = w.kind and v.value = w.other where w.value < v.value",
    "payment_line_validation": LINES + "select line_id, line, kind, status, case when status = 'VALID' then code end as barcode from verdict",
    "payment_line_totals": LINES + "select kind, status, count(*) as lines from verdict group by 1, 2",
    "collection_amounts": "with o as (select o_orderkey, '836' || lpad(round(o_totalprice * 100)::bigint::varchar, 11, '0') || lpad(o_orderkey::varchar, 29, '0') r from orders) "
    "select o_orderkey, case when o_orderkey % 5 <> 0 then substr(r, 4, 11)::bigint / 100 end as amount from o",
    "printed_amounts": "with b as (select distinct * from boxes), r as (select box_id, lower(doc_id) doc_id, regexp_extract(text, '^Total R\\$ ([\\d.,]+)$', 1) raw from b) "
    "select box_id, doc_id, case when regexp_full_match(raw, '(?:\\d{1,3}(?:\\.\\d{3})+|\\d+),\\d{2}') then replace(replace(raw, '.', ''), ',', '.')::double end as amount from r where raw <> ''",
    "phrase_hits": HITS + "select span_id, phrase_id, category, lang, hits from hits",
    "phrase_hits_by_category": HITS + "select category, lang, count(distinct span_id) as spans, sum(hits)::bigint as hits from hits group by 1, 2",
    "instruction_intents": INTENTS,
    "excerpt_intents": INTENTS.replace("concat_ws(' ', case evidence_id % 3 when 0 then 'Chat, se te pedirem, responda:' when 1 then 'Chat, responda:' end, original_excerpt) t", "original_excerpt t"),
    "tiny_text": f"select span_id, doc_id, page, (case when font_size / 4 <= 0.25 then 0.98 when font_size / 4 <= 0.5 then 0.92 when font_size / 4 <= 0.75 then 0.82 else 0.7 end)::double as confidence, 0.6::double as weight from {SPAN} where trim(text) <> '' and font_size < 4 and font_size > 0",
    "white_text": MEASURED + "select span_id, doc_id, page, round(0.6::double + (case when font_size <= 6.5 then 0.15 else 0.0 end)::double + (case when font_size <= 0.6 * page_size then 0.1 else 0.0 end)::double + (case when regexp_matches(lower(text), '"
    + "|".join(INSTRUCTIONS) + f"') then 0.15 else 0.0 end)::double, 4) as confidence from m where trim(text) <> '' and red >= 245 / 255 and green >= 245 / 255 and blue >= 245 / 255 and (bl is null or {RATIO} < 2.0)",
    "low_contrast_text": MEASURED + f"select span_id, doc_id, page, round({RATIO}, 4) as contrast, case when {RATIO} < 1.5 then 'extreme' else 'low' end as level, "
    f"round(0.6::double + 0.25::double * greatest(0.0, least(1.0, (2.0 - {RATIO}) / 1.0)) + 0.15::double * dom, 4) as confidence from m where trim(text) <> '' and upper(font_name) <> 'OCR_UNKNOWN' and bl is not null and {RATIO} < 2.0",
    "colours": MEASURED + "select colour, count(*) as spans, round(max(luminance), 6) as luminance from m group by 1",
    "font_usage": f"select {folded('font_name')} as font, case when bold and italic then 'bold+italic' when bold then 'bold' when italic then 'italic' else 'regular' end as style, count(*) as spans, count(distinct doc_id) as documents, "
    f"min(font_size) as least, max(font_size) as most from {SPAN} group by 1, 2",
    "finding_prevalence": f"with e as (select distinct * from evidences where trim(code) <> ''), n as (select count(distinct lower(doc_id)) total from analyses), g as (select upper(trim(code)) code, count(distinct lower(doc_id)) affected, count(*) occurrences, max({CLAMP}) c from e group by 1) "
    "select code, array_to_string(list_transform(string_split(lower(regexp_replace(code, '_+', ' ', 'g')), ' '), lambda x: upper(x[1]) || x[2:]), ' ') as title, affected, total as total_documents, occurrences, round(affected / total * 100, 2) as prevalence, c as highest_confidence from g, n",
    "document_assessments": f"with e as (select distinct * from evidences), w as (select lower(doc_id) doc_id, {CLAMP} c, coalesce(weight, 0.5) w, lower(trim(category)) category, lang, detector from e), "
    "g as (select doc_id, max(c * w) t, count(distinct category) categories, count(*) evidences, count(distinct detector) detectors, count(distinct lang) languages, count(distinct case when category in ('instruction_override', 'system_prompt_extraction', 'tool_manipulation') then category end) strong from w group by 1), "
    "s as (select *, round(least(t + least(0.05::double * greatest(categories - 1, 0), 0.15::double) + least(0.03::double * greatest(evidences - 1, 0), 0.12::double) + least(0.08::double * strong, 0.16::double), 1.0), 4) score from g) "
    "select doc_id, score, categories, evidences, detectors, languages, case when score <= 0 then 'NONE' when score < 0.3 then 'LOW' when score < 0.55 then 'MEDIUM' when score < 0.8 then 'HIGH' else 'CRITICAL' end as level from s",
    "severity_by_detector": f"with e as (select distinct * from evidences) select detector, " + ", ".join(f"sum(({RANK} = {i})::int)::bigint as {s}" for i, s in enumerate(("critical", "high", "medium", "low", "info"))) + f", {NAMES}[min({RANK}) + 1] as gravest from e group by 1",
    "comparative_context": NAMED + f"select doc_id, count(*) as findings, count(distinct code) as codes, {NAMES}[min({RANK}) + 1] as gravest from n group by 1",
    "first_evidences": "with e as (select distinct * from evidences) select evidence_id, pos from e qualify row_number() over (partition by lower(doc_id), upper(trim(code)), lower(lang), lower(category), page, lower(trim(normalized_excerpt)), source order by pos, evidence_id) = 1",
    "finding_order": f"with u as (select distinct on (finding_id) * from findings), r as (select finding_id, upper(trim(code)) code, severity, round({CLAMP}, 4) confidence from u) select finding_id, code, severity, confidence, row_number() over (partition by code order by {RANK}, confidence desc, finding_id) as place from r",
    "finding_sizes": NAMED + ", k as (select finding_id, code, count(*) documents from n group by 1, 2) select code, documents, count(*) as findings from k group by 1, 2",
    "visual_rows": PLACED + "select box_id, row, segment from cut",
    "row_texts": PLACED + "select doc_id, page, row, segment, string_agg(text, ' ' order by box_left, box_id) as text, count(*) as words, round(avg(confidence), 4) as confidence from cut group by 1, 2, 3, 4",
    "overlapping_boxes": "with b as (select distinct * replace (lower(doc_id) as doc_id, box_left - 14 as box_left, box_top - 14 as box_top, box_width + 28 as box_width, box_height + 28 as box_height) from boxes where box_width > 0 and box_height > 0), j as (select l.doc_id, l.page, l.box_id a, r.box_id b, "
    "greatest(least(l.box_left + l.box_width, r.box_left + r.box_width) - greatest(l.box_left, r.box_left), 0) * greatest(least(l.box_top + l.box_height, r.box_top + r.box_height) - greatest(l.box_top, r.box_top), 0) / least(l.box_width * l.box_height, r.box_width * r.box_height) o "
    "from b l join b r on l.doc_id = r.doc_id and l.page = r.page and l.box_id < r.box_id) select doc_id, page, a, b, round(o, 4) as overlap from j where o >= 0.05",
    "page_totals": "with s as (select distinct * replace (lower(doc_id) as doc_id) from spans where trim(text) <> '') select doc_id, page, count(*) as spans, sum(length(text))::bigint as characters, "
    "sum(length(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')))::bigint as words, min(box_left) as left, min(box_top) as top, max(box_right) as right, max(box_bottom) as bottom, median(case when font_size > 0 then font_size end) as median_size from s group by 1, 2",
    "date_timelines": LINES_OF_TIME + "select * from tl",
    "temporal_anomalies": LINES_OF_TIME + "select doc_id, 'METADATA_ORDER' as code, 'HIGH' as severity, date_diff('day', modified, created)::bigint as days from tl where modified < created union all "
    "select doc_id, 'FUTURE_DATE', 'MEDIUM', date_diff('day', date '2026-01-31', last) from tl where last > date '2026-01-31' union all "
    "select doc_id, 'WIDE_RANGE', 'LOW', date_diff('day', first, last) from tl where date_diff('day', first, last) > 3650 union all "
    "select doc_id, 'METADATA_DIVERGENCE', 'MEDIUM', divergence from tl where divergence > 3650",
    "dates_in_texts": "with r as (select doc_id, unnest(regexp_extract_all(text, '\\b(\\d{2}[/.-]\\d{2}[/.-]\\d{4})\\b', 1)) raw from documents), v as (select doc_id, raw, try_cast(substr(raw, 7, 4) || '-' || substr(raw, 4, 2) || '-' || substr(raw, 1, 2) as date) v from r where substr(raw, 3, 1) = substr(raw, 6, 1)) "
    "select doc_id, count(*) as dates, count(distinct v) as days, min(v) as first, max(v) as last from v where v is not null group by 1",
    "batch_progress": STATE + ", g as (select batch_id, count(*) total, " + ", ".join(f"sum((status = '{s}')::int)::bigint {s}" for s in ("pending", "processing", "completed", "failed")) + " from s group by 1) "
    "select batch_id, total, pending, processing, completed, failed, round((completed + failed) / total * 100, 2) as progress, case when pending + processing > 0 then 'processing' when failed = total then 'failed' when failed = 0 then 'completed' else 'completed_with_errors' end as status from g",
    "batch_analyses": STATE + ", " + FIRST + "select batch_id, s.doc_id, s.status, lower(f.status) as analysis_status, size_bytes, lower(mime_type) as mime_type from s join f on lower(f.doc_id) = s.doc_id",
    "batch_missing": STATE + "select batch_id, doc_id, status from s where doc_id not in (select lower(doc_id) from analyses)",
    "analysis_overview": "with " + FIRST + "select lower(status) as status, lower(mime_type) as mime_type, count(*) as documents, sum(size_bytes)::bigint as bytes, sum((coalesce(length(native_text), 0) > 0)::int)::bigint as with_native_text, "
    "sum((coalesce(length(ocr_text), 0) > 0)::int)::bigint as with_ocr_text from f group by 1, 2",
    "catalog_totals": CATALOG + "select element_type, subtype, layer, count(*) as elements, count(distinct doc_id) as documents, grouping(element_type, subtype, layer)::bigint as level from c group by grouping sets ((element_type), (element_type, subtype), (layer), ())",
    "catalog_orphans": CATALOG + "select doc_id, count(*) as elements from c where element_type <> 'document' and (doc_id not in (select doc_id from a) or doc_id like 'a%') group by 1",
    "catalog_lookup": CATALOG + "select element_type, subtype, lower(trim(value)) as value, count(*) as elements from c where lower(trim(value)) in (select lower(trim(upper(phrase))) from phrases) group by 1, 2, 3",
    "phrase_places": HITS + ", s as (select distinct span_id, lower(doc_id) doc_id, page, pos from spans), j as (select * from hits join s using (span_id)) select doc_id, phrase_id, page, pos, span_id, (count(*) over (partition by doc_id, phrase_id))::bigint as spans from j "
    "qualify row_number() over (partition by doc_id, phrase_id order by page, pos, span_id) = 1",
    "below_neighbours": "with b as (select distinct lower(doc_id) doc_id, page, box_id, box_left l, box_top t, box_width w, box_height h from boxes where trim(text) <> ''), p as (select u.doc_id, u.page, u.box_id upper, d.box_id lower, round(d.t - (u.t + u.h) + abs(u.l - d.l) / 10, 4) score from b u join b d "
    "on u.doc_id = d.doc_id and u.page = d.page and u.box_id <> d.box_id and d.t - (u.t + u.h) between 0 and 54 and least(u.l + u.w, d.l + d.w) - greatest(u.l, d.l) >= greatest(5.0, 0.2 * least(u.w, d.w))), "
    "r as (select *, row_number() over (partition by doc_id, page, upper order by score, lower) a, row_number() over (partition by doc_id, page, lower order by score, upper) z from p) select doc_id, page, upper, lower, score from r where a = 1 and z = 1",
    "excerpt_windows": f"with e as (select distinct evidence_id, string_split({folded('original_excerpt')}, ' ') w from evidences where trim(original_excerpt) <> ''), k as (select evidence_id, w, unnest(case when length(w) >= 5 then list_filter([24, 16, 12, 8, 5], lambda s: s <= length(w)) else [length(w)] end) n from e) "
    "select evidence_id, n::bigint as words, array_to_string(w[1:n], ' ') as excerpt from k",
    "similar_excerpts": "with x as (select distinct evidence_id, lower(doc_id) doc_id, original_excerpt o from evidences where trim(original_excerpt) <> ''), y as (select * from x union all select evidence_id + 10000000, doc_id, o || ' (cópia)' from x union all "
    f"select evidence_id + 20000000, doc_id, 'nota: ' || regexp_replace(o, '\\S+$', 'zzz') from x where evidence_id % 3 = 0), e as (select doc_id, {folded('o')} t, evidence_id from y), r as (select doc_id, t, min(evidence_id) id from e group by 1, 2), "
    "k as (select doc_id, id, t, list_distinct(list_filter(regexp_split_to_array(t, '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 3)) ts from r) select l.doc_id, l.id as a, r.id as b, length(list_intersect(l.ts, r.ts))::bigint as shared, "
    "round(length(list_intersect(l.ts, r.ts)) / (length(l.ts) + length(r.ts) - length(list_intersect(l.ts, r.ts))), 4) as similarity from k l join k r on l.doc_id = r.doc_id and l.id < r.id "
    "where length(list_intersect(l.ts, r.ts)) > 0 and (length(list_intersect(l.ts, r.ts)) / (length(l.ts) + length(r.ts) - length(list_intersect(l.ts, r.ts))) >= 0.7 or contains(l.t, r.t) or contains(r.t, l.t))",
    "page_texts": "with s as (select distinct * from spans where trim(text) <> '') select lower(doc_id) as doc_id, page, string_agg(text, chr(10) order by pos, span_id) as text from s group by 1, 2",
    "document_texts": "with s as (select distinct * from spans where trim(text) <> ''), p as (select lower(doc_id) doc_id, page, string_agg(text, chr(10) order by pos, span_id) t from s group by 1, 2), "
    "d as (select doc_id, count(*) pages, string_agg('--- Página ' || page || ' ---' || chr(10) || t, chr(10) || chr(10) order by page) t from p group by 1) select doc_id, pages, length(t)::bigint as characters, md5(t) as digest from d",
    "canonical_values": "with b as (select distinct * from boxes) select box_id, nullif(trim(text), '') as trimmed, lower(replace(nullif(trim(text), ''), 'ß', 'ss')) as folded, nullif(regexp_replace(text, '[^\\p{Nd}]', '', 'g'), '') as digits, nullif(lower(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')), '') as compact from b",
    "clean_cells": "with b as (select distinct * from boxes where text is not null), c as (select box_id, regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') t from b) select box_id, case when regexp_matches(t, '^\\s*[=+\\-@]') then chr(39) || t else t end as cell from c",
    "colour_distances": "with s as (select distinct * from spans), l as (select span_id, red * alpha + (1 - alpha) r, green * alpha + (1 - alpha) g, blue * alpha + (1 - alpha) b from s) select span_id, round(sqrt(((r - 1) * (r - 1) + (g - 1) * (g - 1) + (b - 1) * (b - 1)) / 3), 6) as distance from l",
    "ocr_quality": "with b as (select distinct * from boxes where trim(text) <> '' and coalesce(confidence, 0) >= 0), r as (select lower(doc_id) doc_id, confidence, case when confidence <= 1 then confidence else confidence / 100 end c from b) "
    "select doc_id, case when c >= 0.9 then 'high' when c >= 0.7 then 'medium' when c is not null then 'low' else 'unknown' end as band, count(*) as boxes, min(confidence) as least, max(confidence) as most from r group by 1, 2",
    "export_audit": "with " + FIRST.rstrip() + ", g as (select lower(doc_id) doc_id, regexp_extract(lower(sha256), '([0-9a-f]{64})', 1) sha, pos from f), x as (select distinct lower(doc_id) doc_id from batch_documents) "
    "select case when g.doc_id is null then 'MISSING_PDF' when coalesce(g.sha, '') = '' then 'INSPECTION_FAILED' when g.sha = (case when pos % 10 = 0 then reverse(g.sha) else g.sha end) then 'INSPECTED_HASH_VERIFIED' else 'HASH_MISMATCH' end as status, count(*) as rows from x left join g using (doc_id) group by 1",
    "event_windows": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as events, round(sum(value), 4) as total, max(value) as most from events group by 1, 2",
    "event_sessions": "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end n from events), s as (select *, sum(n) over (partition by user_id order by ts range unbounded preceding) k from g) "
    "select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as start, count(*) as events from s group by user_id, k",
    "event_shares": "with g as (select event_type, sum(value) s, count(*) calls from events group by 1), t as (select sum(s) t from g) select event_type, round(s, 4) as total, calls, round(s / calls, 6) as average, round(s / t * 100, 2) as share from g, t",
    "line_barcode_matches": LINES + ", ob as (select line_id, status, case when status = 'VALID' then code end as barcode, substr(line_id, 7)::bigint k from verdict where line_id like 'order:%'), c as (select ob.*, o_custkey::varchar doc_id, k % 5 as page from ob join orders on o_orderkey = k), "
    "p as (select *, coalesce(barcode, rpad('8' || k, 44, '0')) printed from c), b as (select doc_id, page, case when k % 11 = 0 then '89' || substr(printed, 3, 42) else printed end content from p union all select doc_id, page, '81' || substr(printed, 3, 42) from p where k % 13 = 0), "
    "gg as (select doc_id, page, min(content) lo, max(content) hi from b group by 1, 2), r as (select case when status <> 'VALID' or lo is null or lo <> hi then 'INCONCLUSIVE' when barcode = lo then 'MATCH' else 'MISMATCH' end as result from p left join gg using (doc_id, page)) select result, count(*) as lines from r group by 1",
    "barcode_groups": LINES + ", ob as (select substr(line_id, 7)::bigint k from verdict where line_id like 'order:%'), c as (select k, o_custkey doc_id from ob join orders on o_orderkey = k union all select k, o_custkey from ob join orders on o_orderkey = k where k % 13 = 0), "
    "gg as (select doc_id, case when k is null then 'itf' else 'itf' end as kind, count(*) n from c group by 1, 2) select kind, count(*) as documents, sum(n)::bigint as codes, max(n * 45 - 1)::bigint as longest from gg group by 1",
    "shared_codes": "with r as (select o_custkey d, rpad('8' || lpad(c_nationkey::varchar, 2, '0') || lpad(day(o_orderdate)::varchar, 2, '0'), 44, '7') content, (o_orderkey % 3)::varchar line from orders join customer on c_custkey = o_custkey), s as (select d, string_agg(distinct line, '|' order by line) g from r group by 1), "
    "c as (select distinct content, d from r) select content, count(*) as documents, count(g) as with_lines, count(distinct g) as signatures, count(g) >= 2 and count(distinct g) >= 2 as divergent from c join s using (d) group by 1 having count(*) >= 2",
    "labelled_values": LABELLED + "select box_id, doc_id, kind, value from v",
    "best_observations": LABELLED + "select doc_id, kind, value, page, box_id from v qualify row_number() over (partition by doc_id, kind, value, page order by confidence desc, box_id) = 1",
    "value_conflicts": LABELLED + "select doc_id, kind, count(distinct value) as distinct_values, min(value) as first_value, max(value) as last_value from v group by 1, 2 having count(distinct value) > 1",
    "dominant_colours": "with s as (select distinct * from spans), b as (select lower(doc_id) doc_id, page, ((least(floor(red * 16), 15) * 16 + least(floor(green * 16), 15)) * 16 + least(floor(blue * 16), 15))::bigint bucket from s), n as (select doc_id, page, bucket, count(*) n from b group by 1, 2, 3), "
    "r as (select *, sum(n) over (partition by doc_id, page) t from n qualify row_number() over (partition by doc_id, page order by n desc, bucket) = 1) select doc_id, page, bucket, round(n / t, 4) as share from r where n / t >= 0.25",
    "line_windows": "with b as (select distinct * from boxes where lower(text) like 'linha digit%'), l as (select 'box:' || box_id as line_id, regexp_replace(text, '[^0-9]', '', 'g') as line from b), w as (select line_id, 1 place, length(line) width, line piece from l union select line_id, i, 48, substr(line, i, 48) from l, range(1, 60) t(i) "
    "where length(line) > 48 and i <= length(line) - 47 and substr(line, i, 1) = '8' union select line_id, i, 47, substr(line, i, 47) from l, range(1, 60) t(i) where length(line) > 47 and i <= length(line) - 46) select line_id, width::bigint as width, count(*) as windows, min(piece) as first_piece, max(place)::bigint as last_place from w group by 1, 2",
    "pdf_dates": "with d as (select distinct * from dates where raw_content like 'D:%') select date_id, case when regexp_matches(raw_content, '^D:\\d{8}') then try_cast(substr(raw_content, 3, 4) || '-' || substr(raw_content, 7, 2) || '-' || substr(raw_content, 9, 2) as date) end as day from d",
    "ocr_spans": "select distinct box_id, lower(doc_id) as doc_id, page, 'OCR_UNKNOWN' as font_name, box_height::double as font_size, box_left, box_top, box_left + box_width as box_right, box_top + box_height as box_bottom from boxes where trim(text) <> ''",
    "ordered_categories": "with e as (select distinct lower(doc_id) doc_id, lower(trim(category)) category, pos, evidence_id from evidences where category is not null), f as (select doc_id, category, pos, evidence_id from e qualify row_number() over (partition by doc_id, category order by pos, evidence_id) = 1) "
    "select doc_id, count(*) as categories, string_agg(category, ',' order by pos, evidence_id) as ordered from f group by 1",
    "combined_prevalence": MEASURED + f", e as (select upper(trim(code)) code, lower(doc_id) doc_id from (select distinct code, doc_id, confidence, evidence_id from evidences) where trim(code) <> '' union all select 'TINY_TEXT', doc_id from s where trim(text) <> '' and font_size < 4 and font_size > 0 union all "
    f"select 'WHITE_TEXT', doc_id from m where trim(text) <> '' and red >= 245 / 255 and green >= 245 / 255 and blue >= 245 / 255 and (bl is null or {RATIO} < 2.0) union all select 'LOW_CONTRAST_TEXT', doc_id from m where trim(text) <> '' and upper(font_name) <> 'OCR_UNKNOWN' and bl is not null and {RATIO} < 2.0), n as (select count(distinct lower(doc_id)) total from analyses) "
    "select code, count(distinct doc_id) as affected, count(*) as occurrences, round(count(distinct doc_id) / any_value(total) * 100, 2) as prevalence from e, n group by 1",
    "document_order": NAMED + f", c as (select doc_id, count(*) k, min({RANK}) r from n group by 1), " + FIRST + "select lower(f.doc_id) as doc_id, coalesce(r, 6)::bigint as rank, row_number() over (partition by coalesce(r, 6) order by coalesce(k, 0) desc, lower(filename), lower(f.doc_id)) as place from f left join c on c.doc_id = lower(f.doc_id)",
}
