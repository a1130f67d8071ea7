"""Detectors over texts and spans: listed phrases, instruction intent, encoded content, concealed text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacre.functions.checks import decoded
from lacre.functions.geometry import contrast, hex_colour, luminance
from lacre.functions.once import step
from lacre.functions.text import SPACES, code_of, compact, folded

#: Signals of the five intent groups, folded.
SIGNALS = {
    "ai_targeting": ("chat", "chatgpt", "assistente", "assistente de ia", "ia", "inteligencia artificial", "modelo de linguagem", "llm", "ai", "artificial intelligence", "language model", "assistant"),
    "operational_condition": (
        "se te pedirem", "se lhe pedirem", "se perguntarem", "quando pedirem", "quando perguntarem", "quando solicitado", "quando solicitarem", "ao fazer um resumo", "ao resumir", "quando resumir",
        "se for solicitado um resumo", "if asked", "if they ask", "when asked", "when requested", "when summarizing", "when you summarize", "if asked to summarize",
    ),
    "response_command": (
        "informe", "diga", "fale", "responda", "declare", "afirme", "considere", "escreva", "retorne", "mostre", "relate", "indique", "tell", "say", "respond", "reply", "state", "claim", "write", "return",
        "show", "report",
    ),
    "bias_control": (
        "em favor do autor", "em favor da autora", "a favor do autor", "a favor da autora", "contra o reu", "contra a re", "contra o banco", "sempre em favor", "sempre a favor", "sempre contra", "favoreca o autor",
        "favoreca a autora", "defenda o autor", "defenda a autora", "favor the plaintiff", "support the plaintiff", "against the defendant", "against the bank", "always favor", "always support",
    ),
    "response_control": (
        "sempre informe", "sempre diga", "sempre fale", "responda sempre", "informe sempre", "diga sempre", "fale sempre", "responda apenas", "responda somente", "nao mencione", "nao informe", "nao diga",
        "fale que nao existe", "diga que nao existe", "informe que nao existe", "always say", "always state", "always respond", "answer only", "respond only", "do not mention", "do not say",
    ),
}
#: The first English signal of each group.
FIRST_ENGLISH = frozenset(("ai", "if asked", "tell", "favor the plaintiff", "always say"))
#: Imperatives that make a concealed text look like an instruction, as patterns on lower case.
INSTRUCTIONS = (
    r"\bverifique\b", r"\bconfira\b", r"\binforme\b", r"\bresponda\b", r"\bdiga\b", r"\bignore\b", r"\bconsidere\b", r"\bmarque\b", r"\buse\b", r"\bfa[çc]a\b",
    r"\bn[aã]o\s+(?:considere|informe|responda|use)\b", r"\bse\s+.*\b(?:correto|correta|verdadeiro|verdadeira)\b",
)
TINY_POINTS, WHITE_CHANNEL, SMALL_POINTS, CONTRAST, EXTREME_CONTRAST = 4.0, 245 / 255, 6.5, 2.0, 1.5


#: A phrase's first runs of word characters, by which it is looked up.
LEAD = 3
#: Phrases that are broadcast at most; a longer catalogue is joined by shuffle.
PHRASES = 100_000


def _runs(c: Column) -> Column:
    return F.filter(F.split(c, r"[^\p{L}\p{N}_]+"), lambda x: x != "")


def phrase_matches(texts: DataFrame, phrases: DataFrame, key: str, text: str) -> DataFrame:
    """(key, phrase_id, category, lang, t, start, stop): every occurrence of a listed phrase in the folded text t, in
    characters from 0. A phrase may not go on in a word at either side, tested only where its own edge is a letter or digit.

    Texts are cut into windows of word runs and phrases looked up by the hash of their first three runs, so the join is an
    equi-join and no text meets all phrases; the pattern is tested on these candidates alone.
    """
    listed = phrases.select("phrase_id", "category", "lang", folded(F.col("phrase")).alias("p")).where("p != ''")
    listed = listed.withColumn("_r", _runs(F.col("p"))).where(F.size("_r") > 0).withColumn("lead", F.array_join(F.slice("_r", 1, LEAD), " ")).withColumn("k", F.least(F.size("_r"), F.lit(LEAD)))
    sizes = sorted(r[0] for r in listed.select("k").distinct().collect())  # three values at most
    t = step(texts.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_text")), t=folded(F.col("_text")))
    t = step(t.select(key, "t"), w=_runs(F.col("t")))

    def windows_of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), " "))

    windows = [windows_of(n) for n in sizes]
    leads = t.select(key, "t", F.explode(F.array_distinct(F.concat(*windows) if windows else F.array())).alias("lead"))
    fixed = listed.drop("_r", "k")
    hit = leads.join(F.broadcast(fixed) if phrases.count() <= PHRASES else fixed, "lead")
    edge = lambda c, look: F.when(c.rlike(r"[\p{L}\p{N}]"), look).otherwise("")
    pattern = F.concat(edge(F.substring("p", 1, 1), r"(?<![\p{L}\p{N}_])"), F.lit("\\Q"), F.col("p"), F.lit("\\E"), edge(F.substring("p", -1, 1), r"(?![\p{L}\p{N}_])"))
    hit = step(hit.withColumn("_x", pattern), _parts=F.split("t", F.col("_x"), -1))
    lengths = lambda i: F.aggregate(F.slice("_parts", F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x))
    starts = F.transform(F.sequence(F.lit(1), F.size("_parts") - 1), lambda i: lengths(i) + (i - 1) * F.length("p"))
    found = hit.where(F.size("_parts") > 1).select(key, "phrase_id", "category", "lang", "t", F.length("p").alias("_n"), F.explode(starts).alias("start"))
    return found.select(key, "phrase_id", "category", "lang", "t", "start", (F.col("start") + F.col("_n")).alias("stop"))


def phrase_hits(texts: DataFrame, phrases: DataFrame, key: str, text: str) -> DataFrame:
    """(key, phrase_id, category, lang, hits): how often each phrase stands in a text; see phrase_matches()."""
    return phrase_matches(texts, phrases, key, text).groupBy(key, "phrase_id", "category", "lang").agg(F.count("*").alias("hits"))


#: Confidence and weight of a phrase's category; other categories have 0.6 and 0.5.
CATEGORY_CONFIDENCE = {"instruction_override": 0.95, "ai_targeting": 0.75, "role_manipulation": 0.85, "system_prompt_extraction": 0.98, "response_control": 0.70, "tool_manipulation": 0.90, "prompt_structure": 0.65}
CATEGORY_WEIGHT = {"instruction_override": 0.95, "ai_targeting": 0.60, "role_manipulation": 0.80, "system_prompt_extraction": 1.00, "response_control": 0.55, "tool_manipulation": 0.85, "prompt_structure": 0.50}


def _by_category(values: dict[str, float], default: float) -> Column:
    table = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.lower(F.trim("category"))), F.lit(default))


def original_places(matches: DataFrame, key: str, text: str) -> DataFrame:
    """Matches (with the original text) and where they stand in it: adds start_index, end_index, matched.

    Characters that fold to nothing have no place of their own, white space after white space neither. The folded text has
    no leading white space but the walk counts it, so in a text that begins with some, all places lie one character early.
    Only texts with a match are walked, in Arrow batches.
    """
    kept = [c for c in matches.columns if c != text]
    schema = ", ".join(f"{c} {matches.schema[c].dataType.simpleString()}" for c in kept) + ", start_index int, end_index int, matched string"

    def walk(batches: Iterator) -> Iterator:
        import unicodedata
        from bisect import bisect_left, bisect_right

        import pyarrow as pa

        def ends(t: str) -> list[int]:
            out, n, blank = [], 0, False
            for c in t:
                f = " " if c.isspace() else "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).casefold()
                n += 0 if f == " " and blank else len(f)
                blank = f == " " or blank and not f
                out.append(n)
            return out

        for batch in batches:
            known: dict = {}
            rows = []
            for t, a, b in zip(*(batch.column(c).to_pylist() for c in (text, "start", "stop")), strict=True):
                e = known.get(t)
                if e is None:
                    e = known[t] = ends(t)
                at = bisect_right(e, a)
                to = bisect_left(e, b) + 1
                rows.append((at, min(to, len(t)), t[at:to]))
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *cols], [*kept, "start_index", "end_index", "matched"])

    return matches.select(*kept, text).mapInArrow(walk, schema)


def excerpt(text: Column, at: Column, to: Column, context: int = 80) -> Column:
    """The text around a place, white space collapsed."""
    begin = F.greatest(at - context, F.lit(0))
    return F.trim(F.regexp_replace(F.substr(text, begin + 1, to + context - begin), SPACES, " "))


def phrase_evidence(texts: DataFrame, phrases: DataFrame, key: str, text: str) -> DataFrame:
    """Evidence rows of the phrase detector: one for each language, category and place (the lowest phrase_id of equal
    ones), with code, confidence, weight, place in the original text and excerpt; number counts a text's rows by place,
    heavier ones first."""
    texts = texts.select(key, F.col(text).alias("_original"))
    text = "_original"
    m = original_places(phrase_matches(texts, phrases, key, text).drop("t").join(texts, key), key, text)
    kept = m.groupBy(key, F.lower("lang").alias("lang"), F.lower("category").alias("category"), "start_index", "end_index").agg(F.min_by(F.struct("phrase_id", "matched"), "phrase_id").alias("m"))
    e = kept.join(texts, key).select(
        key, "m.phrase_id", "lang", "category", "start_index", "end_index", "m.matched", excerpt(F.col(text), F.col("start_index"), F.col("end_index")).alias("excerpt"), code_of(F.col("category"), "PROMPT_INJECTION_").alias("code"),
        _by_category(CATEGORY_CONFIDENCE, 0.6).alias("confidence"), _by_category(CATEGORY_WEIGHT, 0.5).alias("weight"),
    )
    order = Window.partitionBy(key).orderBy("start_index", F.col("weight").desc(), "phrase_id", "lang", "category")
    return e.withColumn("number", F.row_number().over(order).cast("long"))


#: Signals that tell no language although they are listed.
NO_LANGUAGE = frozenset(("chat", "chatgpt", "ia", "llm", "ai", "assistant"))


def languages() -> dict[str, str]:
    """The language of each signal that tells one: the lists hold Portuguese signals first, then English ones."""
    out = {}
    for signals in SIGNALS.values():
        at = next(i for i, x in enumerate(signals) if x in FIRST_ENGLISH)
        out.update({x: "en" if i >= at else "pt-BR" for i, x in enumerate(signals) if x not in NO_LANGUAGE})
    return out


def signals_found(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, lang, n_<group>, signals): matched signals of each group, in order, and the language most of them tell (null
    on a tie). Short signals also match inside words; those of four letters and more also match the text's letters alone."""
    t = step(texts.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_text")), f=folded(F.col("_text")), c=compact(F.col("_text")))

    def hit(signal: str) -> Column:
        tight = signal.replace(" ", "")
        return F.col("f").contains(signal) | F.col("c").contains(tight) if len(tight) >= 4 else F.col("f").contains(signal)

    told = languages()
    groups = {g: F.filter(F.array(*(F.when(hit(x), x) for x in signals)), lambda x: x.isNotNull()) for g, signals in SIGNALS.items()}
    df = step(t.select(key, "f", "c"), **groups)
    every = F.array_distinct(F.concat(*(F.col(g) for g in SIGNALS)))
    of = lambda lang: F.size(F.array_intersect(every, F.array(*(F.lit(x) for x, v in told.items() if v == lang))))
    df = step(df, every=every, pt=of("pt-BR"), en=of("en"))
    lang = F.when(F.col("pt") > F.col("en"), "pt-BR").when(F.col("en") > F.col("pt"), "en")
    return df.select(key, lang.alias("lang"), *(F.size(g).cast("long").alias(f"n_{g}") for g in SIGNALS), F.array_join("every", "|").alias("signals"))


def intent_excerpt(text: Column, most: int = 500) -> Column:
    """White space collapsed; longer texts cut, with three dots."""
    t = F.trim(F.regexp_replace(text, SPACES, " "))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most)), F.lit("...")))


def intent_groups(f: Column, c: Column) -> dict[str, Column]:
    """For each group whether one of its signals stands in the folded text f, or its letters in the compacted one c."""

    def has(signal: str) -> Column:
        tight = signal.replace(" ", "")
        return f.contains(signal) | c.contains(tight) if len(tight) >= 4 else f.contains(signal)

    return {g: reduce(or_, (has(s) for s in signals)) for g, signals in SIGNALS.items()}


def intents(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, groups, confidence): one row where an addressed system is told what to answer."""
    t = step(texts.where(F.col(text).isNotNull()).select(key, text), f=folded(F.col(text)), c=compact(F.col(text)))
    df = step(t.select(key, "f", "c"), **intent_groups(F.col("f"), F.col("c")))
    n = reduce(lambda a, b: a + b, (F.col(g).cast("int") for g in SIGNALS))
    base = F.when(n >= 5, 0.98).when(n >= 4, 0.92).when(n >= 3, 0.82).otherwise(0.72)
    confidence = F.least(base + F.when(F.col("bias_control"), 0.02).otherwise(0.0), F.lit(1.0))
    return df.where(F.col("ai_targeting") & F.col("response_command") & (n >= 3)).select(key, n.cast("long").alias("groups"), F.round(confidence, 4).alias("confidence"))


def encoded_content(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, encoding, payload, plain): whole lines that hold base64:, hex: or groups of bits and decode to a text."""
    lines = texts.where(F.col(text).isNotNull()).select(key, F.explode(F.split(F.col(text), r"\r?\n")).alias("payload"))
    lines = lines.withColumn("payload", F.trim("payload")).where(F.col("payload").rlike(r"^(?:base64:|hex:|[01][01\s,]{31,}$)"))
    kind = F.when(F.col("payload").startswith("base64:"), "base64").when(F.col("payload").startswith("hex:"), "hex").otherwise("binary")
    return step(lines.select(key, kind.alias("encoding"), "payload"), plain=decoded(F.col("payload"))).where("plain is not null")


def span_measures(spans: DataFrame) -> DataFrame:
    """Spans with luminance, hex colour, area and the exact median size of their page's non-blank spans."""
    lum = luminance(F.col("red"), F.col("green"), F.col("blue"))
    page = spans.where("trim(text) != '' and font_size > 0").groupBy("doc_id", "page").agg(F.median("font_size").alias("page_size"))
    return spans.withColumns({"luminance": lum, "colour": hex_colour(F.col("red"), F.col("green"), F.col("blue"))}).join(page, ["doc_id", "page"], "left")


def tiny_text(spans: DataFrame) -> DataFrame:
    """Visible spans under four points; the confidence grows as the size falls."""
    share = F.col("font_size") / TINY_POINTS
    confidence = F.when(share <= 0.25, 0.98).when(share <= 0.5, 0.92).when(share <= 0.75, 0.82).otherwise(0.7)
    return spans.where((F.trim("text") != "") & (F.col("font_size") < TINY_POINTS) & (F.col("font_size") > 0)).select("span_id", "doc_id", "page", confidence.alias("confidence"), F.lit(0.6).alias("weight"))


def white_text(measured: DataFrame, backgrounds: DataFrame) -> DataFrame:
    """Near-white spans; those whose known background sets them off are dropped, those without a known one stay.

    backgrounds(span_id, background, dominance): the luminance behind a span and the share of samples that have it, null
    where no colour prevails; an input, as the sampling of pixels is outside this library.
    """
    near = reduce(lambda a, b: a & b, (F.col(c) >= WHITE_CHANNEL for c in ("red", "green", "blue")))
    told = F.lower("text").rlike("(?U)" + "|".join(INSTRUCTIONS))
    confidence = 0.6 + F.when(F.col("font_size") <= SMALL_POINTS, 0.15).otherwise(0.0) + F.when(F.col("font_size") <= 0.6 * F.col("page_size"), 0.1).otherwise(0.0) + F.when(told, 0.15).otherwise(0.0)
    found = measured.where((F.trim("text") != "") & near).join(backgrounds.select("span_id", "background"), "span_id", "left")
    hidden = F.col("background").isNull() | (contrast(F.col("luminance"), F.col("background")) < CONTRAST)
    return found.where(hidden).select("span_id", "doc_id", "page", F.round(confidence, 4).alias("confidence"))


def low_contrast(measured: DataFrame, backgrounds: DataFrame) -> DataFrame:
    """Spans whose contrast with their background is under 2.0 (extreme: under 1.5); spans of OCR, whose colour isn't known,
    and spans without a known background are passed over."""
    ratio = contrast(F.col("luminance"), F.col("background"))
    confidence = 0.6 + 0.25 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (CONTRAST - ratio) / (CONTRAST - 1))) + 0.15 * F.col("dominance")
    level = F.when(ratio < EXTREME_CONTRAST, "extreme").otherwise("low")
    seen = measured.where((F.trim("text") != "") & (F.upper("font_name") != "OCR_UNKNOWN")).join(backgrounds.where("background is not null"), "span_id")
    return seen.where(ratio < CONTRAST).select("span_id", "doc_id", "page", F.round(ratio, 4).alias("contrast"), level.alias("level"), F.round(confidence, 4).alias("confidence"))


def concealed(spans: DataFrame, backgrounds: DataFrame) -> DataFrame:
    """(kind, rank, span_id, doc_id, page, confidence): near-white, low-contrast and tiny text as one union."""
    m = span_measures(spans)
    rows = (("WHITE_TEXT", white_text(m, backgrounds)), ("LOW_CONTRAST_TEXT", low_contrast(m, backgrounds)), ("TINY_TEXT", tiny_text(spans)))
    parts = [df.select(F.lit(kind).alias("kind"), F.lit(i).alias("rank"), "span_id", "doc_id", "page", "confidence") for i, (kind, df) in enumerate(rows)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def source_spans(findings: DataFrame, spans: DataFrame) -> DataFrame:
    """findings(finding_id, doc_id, page, text, box edges) with the first span (by pos, then id) of the same page, text and
    box, null where there is none."""
    key = ["doc_id", "page", "text", "box_left", "box_top", "box_right", "box_bottom"]
    first = spans.groupBy(*key).agg(F.min_by("span_id", F.struct("pos", "span_id")).alias("span_id"))
    return findings.join(first, key, "left").select("finding_id", "span_id")
