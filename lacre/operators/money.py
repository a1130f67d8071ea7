"""Payment values from codes, payloads and printed totals, and whether those of a page agree.

An agreement on a page proves no connection: results are CONSISTENT, REVIEW_REQUIRED or INCONCLUSIVE, never a verdict.

Defined results: a code or payload without a value that its own check covers has none, with the reason; amounts without a
page never meet others; several codes of a kind on a page are ambiguous; repeated rows count once; null texts hold nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacre.functions.checks import collection_amount, modulo_10, modulo_11, money, payload_parts
from lacre.functions.once import step
from lacre.operators.barcodes import code_format

#: Labels of a total to be paid, before an amount in 1.234,56 notation.
LABEL = r"(?:valor\s+a\s+pagar|total\s+a\s+pagar|total\s+devido|total\s+da\s+fatura|valor\s+total\s+a\s+pagar)"
AMOUNT = r"(?:\d{1,3}(?:\.\d{3})+|\d+),\d{2}"
_WORD = r"[\p{L}\p{N}_]"
LABELLED = rf"(?i)(?<!{_WORD}){LABEL}\s*[:\-–—|>]*\s*(?:R\$\s*)?({AMOUNT})(?!\d)"
NEAR_LABEL = rf"(?i)(?<!{_WORD}){LABEL}(?!{_WORD})[\s:;|=>\-–—]{{0,24}}(?:R\$\s*)?({AMOUNT})(?!\d)"
ONLY_LABEL = rf"(?i)(?<!{_WORD}){LABEL}(?!{_WORD})"
ONLY_MONEY = rf"(?i)^\s*(?:R\$\s*)?({AMOUNT})\s*$"
PRICE = rf"(?<!\d){AMOUNT}(?!\d)"
LEAST_CONFIDENCE = 70.0


def with_payload(df: DataFrame, payload: str) -> DataFrame:
    """Adds pix_amount and pix_reason of an instant-payment payload: format 01, the scheme's name in a merchant field (26 to
    51), currency 986, country BR, a right check sum in the last field, an amount in field 54. Texts of another kind have
    neither. Each part is computed once; only texts that begin like a payload are taken apart."""
    c = F.col(payload)
    df = step(df, _p=payload_parts(F.when(c.startswith("0002"), c)))
    df = step(df, _ours=F.coalesce("_p.ours", F.lit(False)), _country=F.col("_p.place"), _stated=F.col("_p.stated"), _sum=F.col("_p.sum"))
    n = F.length(c)
    reason = (
        F.when(F.col("_country") != "986BR", "CURRENCY_OR_COUNTRY").when(F.col("_sum").isNull(), "NO_CHECK_SUM").when(F.upper(F.substr(c, n - 3, F.lit(4))) != F.col("_sum"), "CHECK_SUM")
        .when(F.col("_stated") == "", "NO_AMOUNT").when(~F.col("_stated").rlike(r"^[0-9]{1,10}(?:\.[0-9]{1,2})?$"), "AMOUNT")
    )
    df = step(df, pix_reason=F.when(F.col("_ours"), reason))
    return df.withColumn("pix_amount", F.when(F.col("_ours") & F.col("pix_reason").isNull(), F.col("_stated").try_cast("decimal(18,2)"))).drop("_p", "_ours", "_country", "_stated", "_sum")


def collection_reason(c: Column) -> Column:
    """Why a collection code has no value; null for values and for texts that are no collection code."""
    ours = c.rlike("^8[12345679][0-9]{42}$")
    mark = F.substring(c, 3, 1)
    rest = F.concat(F.substring(c, 1, 3), F.substring(c, 5, 40))
    expected = F.when(mark.isin("6", "7"), modulo_10(rest)).otherwise(modulo_11(rest))
    return F.when(ours, F.when(~mark.isin("6", "7", "8", "9"), "REFERENCE").when(F.substring(c, 4, 1).try_cast("int") != expected, "CHECK_DIGIT").when(mark.isin("7", "9"), "NO_MONEY"))


def code_values(barcodes: DataFrame) -> DataFrame:
    """(doc_id, page, barcode_index, source, amount, reason, content): ITF and PIX values of codes, or why there is none."""
    form = code_format(F.col("format"))
    b = barcodes.distinct().withColumn("content", F.trim("content"))
    b = step(b, source=F.when(form.isin("itf", "interleaved2of5", "i2of5"), "ITF").when(form.isin("qr", "qrcode"), "PIX")).where("source is not null")
    b = with_payload(b, "content")
    plain = F.col("content").rlike("^[0-9]{44}$")
    b = step(b, _itf=F.when((F.col("source") == "ITF") & plain, collection_amount(F.col("content"))), _why=F.when((F.col("source") == "ITF") & plain, collection_reason(F.col("content"))))
    own = lambda one, other: F.when(F.col("source") == "ITF", F.col(one)).otherwise(F.col(other))
    v = step(b, amount=own("_itf", "pix_amount").cast("decimal(18,2)"), reason=own("_why", "pix_reason"))
    return v.where("amount is not null or reason is not null").select("doc_id", "page", "barcode_index", "source", "amount", "reason", "content")


def text_totals(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, amount): totals after a label in running text, in order."""
    t = texts.where(F.col(text).isNotNull()).select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(LABELLED), F.lit(1))).alias("place", "raw"))
    return t.select(key, F.col("place").cast("long").alias("place"), money(F.col("raw")).alias("amount"))


def located_totals(placed: DataFrame) -> DataFrame:
    """placed(doc_id, page, box_id, text, confidence, box edges, row, segment: see rows.segmented) -> (doc_id, page, amount,
    confidence, how, box_id): totals where they were seen.

    LINE: a segment with one price that follows a label. PAIR: a label whose only plausible amount stands right of it on
    its row or just below. A segment with several prices is ambiguous and passed over. Labels and amounts meet on their page
    only, in a range join of few rows.
    """
    seg = ["doc_id", "page", "row", "segment"]
    w = Window.partitionBy(*seg).orderBy("box_left", "box_id")
    b = placed.where("trim(text) != '' and box_width > 0 and box_height > 0").withColumn("text", F.trim("text"))
    b = b.withColumn("_off", F.coalesce(F.sum(F.length("text") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    item = F.struct("_off", "box_id", "text")
    g = b.groupBy(*seg).agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["text"]), " ").alias("t"), F.min("confidence").alias("c"), F.sum(F.col("confidence").isNull().cast("int")).alias("_none"), F.min("box_id").alias("box_id"))
    g = step(g, _prices=F.regexp_count("t", F.lit(PRICE)), _hits=F.regexp_extract_all("t", F.lit(NEAR_LABEL), F.lit(1)))
    g = g.where("_prices <= 1")
    line = g.where(F.size("_hits") == 1).select("doc_id", "page", money(F.col("_hits")[0]).alias("amount"), F.when(F.col("_none") == 0, F.col("c")).alias("confidence"), F.lit("LINE").alias("how"), "box_id")
    rest = step(g.where(F.size("_hits") != 1).select(*seg, "t"), _parts=F.split("t", ONLY_LABEL, -1), _found=F.regexp_extract_all("t", F.lit(ONLY_LABEL), F.lit(0)))
    size = lambda arr, i: F.aggregate(F.slice(arr, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x))
    spots = F.transform(F.sequence(F.lit(1), F.size("_found")), lambda i: F.struct((size("_parts", i) + size("_found", i - 1)).alias("a"), (size("_parts", i) + size("_found", i)).alias("z"), i.alias("i")))
    labels = rest.where(F.size("_found") > 0).select(*seg, F.inline(spots))
    lb = labels.join(b, seg).where((F.col("_off") < F.col("z")) & (F.col("_off") + F.length("text") > F.col("a")))
    edge = [F.min("box_left").alias("lx"), F.min("box_top").alias("ly"), F.max(F.col("box_left") + F.col("box_width")).alias("lr"), F.max(F.col("box_top") + F.col("box_height")).alias("lb"), F.min("confidence").alias("lc"), F.sum(F.col("confidence").isNull().cast("int")).alias("ln")]
    lb = lb.groupBy(*seg, "i").agg(*edge)
    cash = b.join(rest.select(*seg), seg, "left_semi").where(F.col("text").rlike(ONLY_MONEY))
    cash = cash.select("doc_id", "page", "box_id", F.regexp_extract("text", ONLY_MONEY, 1).alias("raw"), F.col("box_left").alias("cx"), F.col("box_top").alias("cy"), (F.col("box_left") + F.col("box_width")).alias("cr"), (F.col("box_top") + F.col("box_height")).alias("cb"), "confidence")
    mid = F.abs((F.col("ly") + F.col("lb")) / 2 - (F.col("cy") + F.col("cb")) / 2)
    low = lambda a, b: F.least(F.col(a), F.col(b))
    beside = (mid <= F.greatest(F.lit(9.0), F.least(F.col("lb") - F.col("ly"), F.col("cb") - F.col("cy")) * 0.9)) & (F.col("cx") >= F.col("lr")) & (F.col("cx") - F.col("lr") <= 260)
    shared = low("lr", "cr") - F.greatest("lx", "cx")
    drop = F.col("cy") - F.col("lb")
    below = (drop >= 0) & (drop <= F.greatest(F.lit(36.0), 2.5 * (F.col("lb") - F.col("ly")))) & (shared >= F.greatest(F.lit(5.0), F.least(F.col("lr") - F.col("lx"), F.col("cr") - F.col("cx")) * 0.2))
    met = lb.join(cash, ["doc_id", "page"]).where(beside | below)
    one = met.groupBy(*seg, "i").agg(F.count("*").alias("_n"), F.first("raw").alias("raw"), F.min("box_id").alias("box_id"), F.min(F.least("lc", "confidence")).alias("c"), F.max(F.col("ln") + F.col("confidence").isNull().cast("int")).alias("_none")).where("_n = 1")
    pair = one.select("doc_id", "page", money(F.col("raw")).alias("amount"), F.when(F.col("_none") == 0, F.col("c")).alias("confidence"), F.lit("PAIR").alias("how"), "box_id")
    return line.unionByName(pair).where("amount is not null")


def page_comparisons(values: DataFrame) -> DataFrame:
    """values(doc_id, page, source, amount, content, confidence) -> (doc_id, page, sources, amounts, relation): pages where two
    sources or more (printed totals with a confidence of 70 at least) state one amount each; ITF and PIX with one content."""
    v = values.where("page is not null and amount is not null").where((F.col("source") != "PRINTED") | (F.col("confidence") >= LEAST_CONFIDENCE))
    s = v.groupBy("doc_id", "page", "source").agg(F.count_distinct("content").alias("contents"), F.min("amount").alias("lo"), F.max("amount").alias("hi"))
    bad = ((F.col("source") != "PRINTED") & (F.col("contents") > 1)) | (F.col("lo") != F.col("hi"))
    g = s.groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.max(bad).alias("_bad"), F.array_join(F.sort_array(F.collect_list("source")), ",").alias("sources"), F.min("lo").alias("least"), F.max("hi").alias("most")).where("n > 1 and not _bad")
    return g.select("doc_id", "page", "sources", "least", "most", F.when(F.col("least") == F.col("most"), "EQUAL_VALUES").otherwise("DIFFERENT_VALUES").alias("relation"))


def page_evidence(values: DataFrame) -> DataFrame:
    """(doc_id, page, evidence): pages with both ITF and PIX: AMBIGUOUS with several contents of a kind, else CONSISTENT or
    REVIEWED (different amounts)."""
    v = values.where("page is not null and amount is not null and source in ('ITF', 'PIX')")
    s = v.groupBy("doc_id", "page", "source").agg(F.count_distinct("content").alias("contents"), F.min("amount").alias("amount"))
    g = s.groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.max("contents").alias("contents"), F.min("amount").alias("lo"), F.max("amount").alias("hi")).where("n = 2")
    return g.select("doc_id", "page", F.when(F.col("contents") > 1, "AMBIGUOUS").when(F.col("lo") == F.col("hi"), "CONSISTENT").otherwise("REVIEWED").alias("evidence"))


def reconciled(values: DataFrame) -> DataFrame:
    """(doc_id, status, values, comparisons, different): a document's result. REVIEW_REQUIRED where a page's ITF and PIX
    differ, or all three sources are on a page and differ; then INCONCLUSIVE where a page is ambiguous, CONSISTENT where one
    agrees, INCONCLUSIVE otherwise."""
    n = values.where("amount is not null").groupBy("doc_id").agg(F.count("*").alias("values"))
    has = lambda c: F.coalesce(F.max(c), F.lit(False))
    e = page_evidence(values).groupBy("doc_id").agg(has(F.col("evidence") == "REVIEWED").alias("reviewed"), has(F.col("evidence") == "AMBIGUOUS").alias("ambiguous"), has(F.col("evidence") == "CONSISTENT").alias("consistent"))
    apart = F.col("relation") == "DIFFERENT_VALUES"
    c = page_comparisons(values).groupBy("doc_id").agg(F.count("*").alias("comparisons"), F.sum(apart.cast("long")).alias("different"), has(apart & (F.col("sources") == "ITF,PIX,PRINTED")).alias("three"))
    j = n.join(e, "doc_id", "left").join(c, "doc_id", "left")
    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    status = F.when(yes("three") | yes("reviewed"), "REVIEW_REQUIRED").when(yes("ambiguous"), "INCONCLUSIVE").when(yes("consistent"), "CONSISTENT").otherwise("INCONCLUSIVE")
    return j.select("doc_id", status.alias("status"), "values", F.coalesce("comparisons", F.lit(0)).alias("comparisons"), F.coalesce("different", F.lit(0)).alias("different"))
