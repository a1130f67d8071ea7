"""Queries of the catalogue's elements, indexes and inserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacre.functions import checks
from lacre.operators import catalog, images, indexes
from lacre.plans import oracles
from lacre.plans.derived import BARCODES, FINGERPRINTS, barcodes, fingerprints
from lacre.plans.register import query

#: A version 5 UUID from its definition (RFC 4122): SHA-1 of the namespace's bytes and the name.
_SHA = f"sha1(unhex('{catalog.NAMESPACE}') || encode(doc_id || ':' || k))"
_ID = "concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], printf('%x', (('0x' || h[17:17])::int & 3) | 8) || h[18:20], h[21:32])"


def _with_id(rows: str) -> str:
    return f"select {_ID} as element_id, doc_id, element_type, subtype, value, layer, page from (select *, {_SHA} as h from ({rows}))"


_IMAGES = FINGERPRINTS + ", im as (select doc_id, seq as i, (seq % 3)::int as page, image_hash, lower(trim(p)) p, lower(trim(a)) a, lower(trim(d)) d from o) "
_IMAGE_ROWS = (
    "select doc_id, 'image:' || i as k, 'image' as element_type, null::varchar as subtype, i::varchar as value, 'extracted' as layer, page from im union all "
    "select doc_id, 'image:' || i || ':hash:' || t, 'hash', t, v, 'derived', page from (select doc_id, i, page, unnest(['sha256', 'phash', 'ahash', 'dhash']) t, unnest([image_hash, p, a, d]) v from im) where v is not null"
)


def _images(spark: SparkSession, base: str) -> DataFrame:
    o = images.occurrences(fingerprints(spark, base)).withColumn("index", F.col("seq")).withColumn("page", (F.col("seq") % 3).cast("int"))
    return catalog.image_elements(o)


@query(_IMAGES + _with_id(_IMAGE_ROWS))
def image_elements(spark: SparkSession, base: str) -> DataFrame:
    return _images(spark, base).drop("parent_id")


_CODE_ROWS = (
    "select doc_id, 'barcode:' || barcode_index as k, 'barcode' as element_type, replace(replace(lower(trim(format)), '_', ''), ' ', '') as subtype, trim(content) as value, 'extracted' as layer, page from bc where trim(content) <> '' union all "
    "select doc_id, 'qrcode:' || barcode_index, 'qrcode', 'payload', trim(content), 'decoded', page from bc where trim(content) <> '' and replace(lower(trim(format)), '_', '') in ('qr', 'qrcode')"
)


def _codes(spark: SparkSession, base: str) -> DataFrame:
    return catalog.code_elements(barcodes(spark, base))


@query("with " + BARCODES + _with_id(_CODE_ROWS))
def code_elements(spark: SparkSession, base: str) -> DataFrame:
    return _codes(spark, base).drop("parent_id")


_LINES = oracles.LINES + ", ln as (select 'c' || o_custkey doc_id, o_orderkey line_index, (o_orderkey % 3 + 1)::int page, line, status from verdict join (select *, 'order:' || o_orderkey line_id from orders) using (line_id)) "
_LINE_ROWS = (
    "select doc_id, 'numeric_line:' || line_index || ':raw' as k, 'numeric_line' as element_type, 'raw' as subtype, substr(line, 1, 12) || ' ' || substr(line, 13) as value, 'extracted' as layer, page from ln union all "
    "select doc_id, 'numeric_line:' || line_index || ':normalized', 'numeric_line', 'normalized', line, 'derived', page from ln union all select doc_id, 'numeric_line:' || line_index || ':validation', 'numeric_line', 'validation', status, 'validated', page from ln"
)


def _lines(spark: SparkSession, base: str) -> DataFrame:
    from lacre.plans.sheets import _lines as validated

    v = validated(spark, base)
    raw = F.concat(F.substring("line", 1, 12), F.lit(" "), F.substring("line", 13, 60))
    return catalog.line_elements(v.select("doc_id", F.col("k").alias("line_index"), (F.col("k") % 3 + 1).cast("int").alias("page"), raw.alias("raw"), checks.digits(raw).alias("digits"), "status"))


@query(_LINES + _with_id(_LINE_ROWS))
def line_elements(spark: SparkSession, base: str) -> DataFrame:
    return _lines(spark, base).drop("parent_id")


# Indexes over all of them


def _elements(spark: SparkSession, base: str) -> DataFrame:
    return _images(spark, base).unionByName(_codes(spark, base)).unionByName(_lines(spark, base))


_ALL = (
    f"with i_el as ({_IMAGES}{_IMAGE_ROWS}), c_el as (with {BARCODES}{_CODE_ROWS}), l_el as ({_LINES}{_LINE_ROWS}), el as (select * from i_el union all select * from c_el union all select * from l_el), "
    "en as (select doc_id || ':' || k as e, doc_id, 'sha256' as ix, lower(trim(value)) as key from el where element_type = 'hash' and subtype = 'sha256' union all select doc_id || ':' || k, doc_id, 'barcode', lower(regexp_replace(value, '[^\\p{L}\\p{N}]', '', 'g')) from el where element_type = 'barcode' union all "
    "select doc_id || ':' || k, doc_id, 'numeric_line', value from el where element_type = 'numeric_line' and subtype = 'normalized' union all select doc_id || ':' || k, doc_id, 'image', lower(trim(value)) from el where element_type = 'hash' and subtype in ('phash', 'ahash', 'dhash')), "
    "pd as (select ix, key, doc_id, count(*) n from en group by 1, 2, 3), gr as (select ix, key, sum(n)::bigint elements, count(*) documents, (sum(n) * (sum(n) - 1) / 2)::bigint relations, (sum(n) * (sum(n) - 1) / 2 - sum(n * (n - 1) / 2))::bigint cross_relations from pd group by 1, 2 having count(*) > 1) "
)


@query(_ALL + "select ix as index, count(*) as elements, count(distinct doc_id) as documents, count(distinct key) as keys from en group by 1")
def index_statistics(spark: SparkSession, base: str) -> DataFrame:
    """What each index holds after routing all elements."""
    return indexes.standard().statistics(_elements(spark, base))


@query(_ALL + "select n as memberships, count(*) as elements from (select e, count(*) n from en group by 1) group by 1")
def index_memberships(spark: SparkSession, base: str) -> DataFrame:
    """In how many indexes elements are."""
    e = indexes.standard().entries(_elements(spark, base))
    return e.groupBy("element_id").agg(F.count("*").alias("memberships")).groupBy("memberships").agg(F.count("*").alias("elements"))


@query(_ALL + "select ix as index, key, elements, documents, relations, cross_relations from gr where ix in ('barcode', 'sha256')")
def exact_candidates(spark: SparkSession, base: str) -> DataFrame:
    """Groups of two indexes asked for by name, one of them twice and in another letter case."""
    return indexes.candidate_groups(indexes.standard().entries(_elements(spark, base), ["barcode", "SHA256", "Barcode"]))


@query(
    _ALL + "select count(*) as groups, count(distinct ix) as sources, sum(relations)::bigint as relations, (select count(distinct e) from en join gr using (ix, key)) as elements, (select count(distinct en.doc_id) from en join gr using (ix, key)) as documents from gr"
)
def candidate_totals(spark: SparkSession, base: str) -> DataFrame:
    e = indexes.standard().entries(_elements(spark, base))
    return indexes.candidate_totals(indexes.candidate_groups(e), e)


@query(
    "with " + BARCODES + f", el as ({_CODE_ROWS}), st as (select * from el where length(k) % 2 = 0) select (select count(*) from st) as stored, (select count(*) from el) as offered, (select count(*) from el where length(k) % 2 = 1) as added, "
    "(select count(*) from st where value like 'V1%') as conflicts"
)
def catalogue_inserts(spark: SparkSession, base: str) -> DataFrame:
    """A batch of all codes' elements into a catalogue that holds some of them: what is new; and the conflicts of the same
    batch with some values changed."""
    new = _codes(spark, base)
    keyed = barcodes(spark, base).where("trim(content) != ''")
    form = F.regexp_replace(F.lower(F.trim("format")), "[-_ ]", "")
    even = lambda p: F.length(F.concat(F.lit(p), F.col("barcode_index"))) % 2 == 0
    ids = keyed.where(even("barcode:")).select(catalog.element_id(F.col("doc_id"), F.concat(F.lit("barcode:"), "barcode_index")).alias("element_id"))
    ids = ids.unionByName(keyed.where(even("qrcode:") & form.isin("qr", "qrcode")).select(catalog.element_id(F.col("doc_id"), F.concat(F.lit("qrcode:"), "barcode_index")).alias("element_id")))
    stored = new.join(ids, "element_id", "left_semi")
    changed = new.withColumn("value", F.when(F.col("value").startswith("V1"), F.concat("value", F.lit("?"))).otherwise(F.col("value")))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    parts = (one(stored, "stored"), one(new, "offered"), one(indexes.added(stored, new), "added"), one(indexes.conflicts(stored, changed), "conflicts"))
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


@query(
    "with o as (select o_orderkey k, 'c' || o_custkey doc_id, '8' || lpad((o_custkey % 40)::varchar, 43, '0') content, 'L' || (o_orderkey % 3) line, case when o_orderkey % 5 = 0 then 'concatenated_fields' end kind from orders), l as (select doc_id, line, min(k) at_k from o where kind is null group by 1, 2), "
    "s as (select doc_id, list(line order by at_k, line) ls from l group by 1), c as (select content, doc_id, ls, array_to_string(ls, '|') sg from (select distinct content, doc_id from o) left join s using (doc_id)), "
    "g as (select content, count(*) documents, count(sg) with_lines, count(distinct sg) signatures from c group by 1 having count(*) > 1 and count(distinct sg) > 1), "
    "v as (select content, doc_id, unnest(range(1, length(ls) + 1)) i, unnest(ls) line from c where ls is not null), f as (select content, line, min(struct_pack(d := doc_id, i := i)) f from v group by 1, 2) "
    "select content, documents, with_lines, signatures, string_agg(line, '|' order by f.f) as values from g join f using (content) group by all"
)
def divergent_codes(spark: SparkSession, base: str) -> DataFrame:
    """Codes that customers of one remainder share, whose lines differ or stand in another order."""
    from lacre.sources.tables import table

    k = F.col("o_orderkey")
    o = table(spark, base, "orders").select(
        k.alias("line_index"), F.concat(F.lit("c"), "o_custkey").alias("doc_id"), F.concat(F.lit("8"), F.lpad((F.col("o_custkey") % 40).cast("string"), 43, "0")).alias("content"), F.concat(F.lit("L"), (k % 3).cast("string")).alias("line"),
        F.when(k % 5 == 0, "concatenated_fields").alias("kind"),
    )
    return indexes.signature_candidates(o, o)
