"""Queries of listed phrases, signals of intent and their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacre.functions.text import SPACES, folded
from lacre.operators import batches, detectors, evidence, pages
from lacre.operators.detectors import CATEGORY_CONFIDENCE, CATEGORY_WEIGHT, SIGNALS
from lacre.plans import oracles
from lacre.plans.register import query
from lacre.sources.tables import table

#: Places in the original text: every character's folded length, summed up.
PLACES = (
    oracles.HITS + ", r as (select distinct span_id, text from spans), o as (select span_id, phrase_id, category, lang, unnest(spots) - 1 as a, length(p) as n from hits), "
    "ch as (select span_id, i, substr(text, i, 1) c from (select span_id, text, unnest(range(1, length(text) + 1)) i from r where span_id in (select span_id from hits))), "
    f"f as (select span_id, i, case when regexp_full_match(c, '{SPACES}') then ' ' else lower({oracles.unaccented('c')}) end f from ch), "
    "k as (select span_id, i, case when f = ' ' and lag(f) over (partition by span_id order by i) = ' ' then 0 else length(f) end n from f where f <> '' union all select span_id, i, 0 from f where f = ''), "
    "e as (select span_id, i, sum(n) over (partition by span_id order by i) e from k), "
    "w as (select o.span_id, phrase_id, category, lang, a, count(*) filter (e <= a) as s, count(*) filter (e < a + n) + 1 as z from o join e using (span_id) group by all), "
    "x as (select w.span_id, phrase_id, category, lang, s, least(z, length(text)) z, text from w join r using (span_id)) "
)
EXCERPT = f"trim(regexp_replace(substr(text, (greatest(s - 80, 0) + 1)::int, (z + 80 - greatest(s - 80, 0))::int), '{SPACES}', ' ', 'g'))"


def _spans(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "spans").select("span_id", "text").distinct()


@query(PLACES + f"select span_id, phrase_id, s::int as start_index, z::int as end_index, {EXCERPT} as excerpt from x")
def phrase_offsets(spark: SparkSession, base: str) -> DataFrame:
    """Where phrases stand in the original texts of spans, with the text around them."""
    s = _spans(spark, base)
    m = detectors.phrase_matches(s, table(spark, base, "phrases"), "span_id", "text").join(s, "span_id").drop("t")
    o = detectors.original_places(m, "span_id", "text").select("span_id", "phrase_id", "start_index", "end_index").join(s, "span_id")
    return o.select("span_id", "phrase_id", "start_index", "end_index", detectors.excerpt(F.col("text"), F.col("start_index"), F.col("end_index")).alias("excerpt"))


def _case(values: dict[str, float], default: float) -> str:
    return "(case category " + " ".join(f"when '{k}' then {v}" for k, v in values.items()) + f" else {default} end)::double"


@query(
    PLACES + f", u as (select span_id, lower(lang) lang, lower(category) category, s, z, text, min(phrase_id) phrase_id from x group by all), v as (select *, {_case(CATEGORY_CONFIDENCE, 0.6)} as confidence, "
    f"{_case(CATEGORY_WEIGHT, 0.5)} as weight from u) select span_id, phrase_id, lang, category, s::int as start_index, z::int as end_index, substr(text, s::int + 1, (z - s)::int) as matched, {EXCERPT} as excerpt, "
    "'PROMPT_INJECTION_' || upper(replace(category, ' ', '_')) as code, confidence, weight, row_number() over (partition by span_id order by s, weight desc, phrase_id, lang, category) as number from v"
)
def phrase_evidence(spark: SparkSession, base: str) -> DataFrame:
    """The phrase detector's evidence rows for spans."""
    return detectors.phrase_evidence(_spans(spark, base), table(spark, base, "phrases"), "span_id", "text")


TOLD = detectors.languages()
_SIGNALS = (
    f"with t as (select distinct evidence_id, original_excerpt t from evidences where original_excerpt is not null), n as (select evidence_id, {oracles.folded('t')} f, regexp_replace(lower({oracles.unaccented('t')}), '[^a-z0-9]', '', 'g') c from t), "
    + "g as (select evidence_id, "
    + ", ".join(
        "list_filter([" + ", ".join(f"case when contains(f, '{x}')" + (f" or contains(c, '{x.replace(' ', '')}')" if len(x.replace(" ", "")) >= 4 else "") + f" then '{x}' end" for x in xs) + f"], lambda x: x is not null) as {k}"
        for k, xs in SIGNALS.items()
    )
    + " from n), l as (select *, "
    + " || ".join(SIGNALS)
    + " as every from g), u as (select *, list_filter(every, lambda x, i: list_position(every, x) = i) as kept from l), v as (select *, "
    + ", ".join(f"length(list_filter(kept, lambda x: x in ({', '.join(repr(x) for x, v in TOLD.items() if v == lang)}))) as {name}" for lang, name in (("pt-BR", "pt"), ("en", "en")))
    + " from u) "
)


@query(_SIGNALS + "select evidence_id, case when pt > en then 'pt-BR' when en > pt then 'en' end as lang, " + ", ".join(f"length({g})::bigint as n_{g}" for g in SIGNALS) + ", array_to_string(kept, '|') as signals from v")
def intent_signals(spark: SparkSession, base: str) -> DataFrame:
    """Signals of intent in excerpts, by group, and the language that most of them tell."""
    return detectors.signals_found(table(spark, base, "evidences").select("evidence_id", "original_excerpt").distinct(), "evidence_id", "original_excerpt")


@query(
    f"with t as (select doc_id, trim(regexp_replace(text, '{SPACES}', ' ', 'g')) t from documents where text is not null) "
    "select doc_id, case when length(t) <= 500 then t else rtrim(substr(t, 1, 500)) || '...' end as excerpt from t"
)
def intent_excerpts(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").where("text is not null").select("doc_id", detectors.intent_excerpt(F.col("text")).alias("excerpt"))


# All texts of a document through the phrase detector


def _texts(spark: SparkSession, base: str) -> DataFrame:
    """(k, doc_id, source, page, text): native and OCR texts, and pages put together from spans."""
    a = batches.first_analyses(table(spark, base, "analyses")).select(F.lower("doc_id").alias("doc_id"), "native_text", "ocr_text")
    one = lambda c, s: a.where(F.trim(c) != "").select("doc_id", F.lit(s).alias("source"), F.lit(None).cast("int").alias("page"), F.col(c).alias("text"))
    p = pages.page_texts(table(spark, base, "spans")).select("doc_id", F.lit("normalized_document").alias("source"), "page", "text")
    t = one("native_text", "native_text").unionByName(one("ocr_text", "ocr")).unionByName(p)
    return t.select(F.concat_ws(":", "doc_id", "source", "page").alias("k"), "doc_id", "source", "page", "text")


_TEXTS = (
    "with " + oracles.FIRST + ", sp as (select distinct * from spans), pg as (select lower(doc_id) doc_id, page, string_agg(text, chr(10) order by pos, span_id) t from sp where trim(text) <> '' group by 1, 2), "
    "tx as (select lower(doc_id) || ':native_text' k, lower(doc_id) doc_id, 'native_text' source, null::int page, native_text t from f where trim(native_text) <> '' union all "
    "select lower(doc_id) || ':ocr', lower(doc_id), 'ocr', null, ocr_text from f where trim(ocr_text) <> '' union all select doc_id || ':normalized_document:' || page, doc_id, 'normalized_document', page, t from pg), "
    f"fo as (select k, doc_id, source, page, {oracles.folded('t')} t from tx), p as (select phrase_id, category, lang, {oracles.folded('phrase')} p from phrases), c as (select * from fo, p where p <> '' and contains(t, p)), "
    "spots as (select k, doc_id, source, page, phrase_id, lower(category) category, lower(lang) lang, unnest(list_filter(range(1, length(t) - length(p) + 2), lambda i: substr(t, i, length(p)) = p "
    f"and (not regexp_matches(substr(p, 1, 1), '[\\p{{L}}\\p{{N}}]') or i = 1 or not regexp_matches(substr(t, i - 1, 1), {oracles.WORD})) "
    f"and (not regexp_matches(substr(p, length(p), 1), '[\\p{{L}}\\p{{N}}]') or i + length(p) > length(t) or not regexp_matches(substr(t, i + length(p), 1), {oracles.WORD})))) as i from c), "
    f"ev as (select doc_id, source, page, category, lang, min(phrase_id) phrase_id, {_case(CATEGORY_CONFIDENCE, 0.6)} as confidence, {_case(CATEGORY_WEIGHT, 0.5)} as weight from (select distinct k, doc_id, source, page, category, lang, i, phrase_id from spots) group by all), "
)


def _document_evidence(spark: SparkSession, base: str) -> DataFrame:
    """One row for each document, source, page, language and category: the union of all texts' evidence, repeats dropped."""
    t = _texts(spark, base)
    m = detectors.phrase_matches(t, table(spark, base, "phrases"), "k", "text").join(t.drop("text"), "k")
    g = m.groupBy("doc_id", "source", "page", F.lower("lang").alias("lang"), F.lower("category").alias("category")).agg(F.min("phrase_id").alias("phrase_id"))
    return g.withColumns({"confidence": detectors._by_category(CATEGORY_CONFIDENCE, 0.6), "weight": detectors._by_category(CATEGORY_WEIGHT, 0.5)})


@query(_TEXTS + "z as (select 1) select doc_id, source, page, category, lang, phrase_id, confidence, weight from ev")
def prompt_evidence(spark: SparkSession, base: str) -> DataFrame:
    return _document_evidence(spark, base)


@query(
    _TEXTS + "d as (select doc_id, count(*) n, max(confidence) c from ev group by 1) select 'PROMPT_INJECTION' as code, count(*) as affected, sum(n)::bigint as occurrences, "
    "round(100.0 * count(*) / (select count(distinct lower(doc_id)) from analyses), 2)::double as prevalence, max(c) as highest_confidence from d"
)
def prompt_prevalence(spark: SparkSession, base: str) -> DataFrame:
    """How many documents the phrase detector hits in any of their texts."""
    e = _document_evidence(spark, base).select("doc_id", "confidence", F.lit("PROMPT_INJECTION").alias("code"), F.monotonically_increasing_id().alias("evidence_id"))
    return evidence.prevalence(e, table(spark, base, "analyses")).select("code", "affected", "occurrences", "prevalence", "highest_confidence")


# The catalogue of phrases as documents of JSON


def _catalogues(spark: SparkSession, base: str) -> DataFrame:
    """(language, json): one document for each language, with a version and its phrases by category."""
    p = table(spark, base, "phrases").groupBy("lang", "category").agg(F.sort_array(F.collect_list(F.struct("phrase_id", "phrase"))).alias("phrases"))
    body = F.struct(F.lit(1).alias("schema_version"), F.col("lang").alias("language"), F.col("categories"))
    c = p.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("category", "phrases"))).alias("categories"))
    return c.select("lang", F.to_json(body).alias("json"))


@query(
    f"with p as (select lang, category, phrase_id, phrase, {oracles.folded('phrase')} f from phrases) select lower(lang) as lang, lower(category) as category, min(phrase_id) as phrase_id, lower(arg_min(phrase, phrase_id)) as phrase "
    "from p group by lower(lang), lower(category), lower(phrase)"
)
def rule_catalogue(spark: SparkSession, base: str) -> DataFrame:
    """Catalogue documents taken apart: categories exploded to phrases, the first of equal ones kept; other versions are an
    error."""
    kind = "schema_version int, language string, categories map<string, array<struct<phrase_id: long, phrase: string>>>"
    d = _catalogues(spark, base).select(F.from_json("json", kind).alias("d"))
    d = d.where(F.when(F.col("d.schema_version") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("unknown version of a catalogue")).cast("boolean")))
    e = d.select("d.language", F.explode("d.categories").alias("category", "phrases")).select("language", "category", F.inline("phrases"))
    g = e.groupBy(F.lower("language").alias("lang"), F.lower("category").alias("category"), F.lower("phrase").alias("phrase")).agg(F.min("phrase_id").alias("phrase_id"))
    return g.select("lang", "category", "phrase_id", "phrase")


@query("select lower(lang) as lang, lower(category) as category, count(*) as phrases, min(length(phrase))::bigint as shortest, max(length(phrase))::bigint as longest from phrases where lower(lang) = 'pt-br' group by 1, 2")
def catalogue_lookup(spark: SparkSession, base: str) -> DataFrame:
    """Phrases of one language, in any letter case, by category."""
    p = rule_catalogue(spark, base).where(F.col("lang") == F.lower(F.lit("PT-BR")))
    n = F.length("phrase")
    return p.groupBy("lang", "category").agg(F.count("*").alias("phrases"), F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"))


@query(f"select span_id, {oracles.folded('text')} as folded, {oracles.folded('font_name')} as font from (select distinct span_id, text, font_name from spans) where text is not null")
def folded_texts(spark: SparkSession, base: str) -> DataFrame:
    s = table(spark, base, "spans").select("span_id", "text", "font_name").distinct().where("text is not null")
    return s.select("span_id", folded(F.col("text")).alias("folded"), folded(F.col("font_name")).alias("font"))
