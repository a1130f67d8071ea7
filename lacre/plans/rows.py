"""Queries of visual rows by each rule, and the same rules as recursive SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lacre.operators import rows
from lacre.plans.register import query
from lacre.sources.tables import table


def recursive(rule: str, boxes: str = "select distinct lower(doc_id) doc_id, page, box_id, box_left, box_top, box_width, box_height from boxes", name: str = "rw") -> str:
    """CTEs (after "with recursive") that end with name(doc_id, page, box_id, line)."""
    y = "box_top + box_height / 2.0" if rule == "centre" else "box_top::double"
    n = f"{name}_n as (select doc_id, page, box_id, {y} as y, box_height::double as h, row_number() over (partition by doc_id, page order by {y}, box_left, box_id) as i from ({boxes})), "
    if rule in ("mean", "first"):
        mean = f"list_transform(range(1, length(s) + 1), lambda k: {'s[k] / c[k]' if rule == 'mean' else 'f[k]'})"
        join = f"coalesce(list_position(list_transform({mean}, lambda m: abs(n.y - m) <= 20), true), 0)"
        put = lambda a, new, old: f"case when k = 0 then list_append({a}, {new}) else list_transform({a}, lambda v, q: case when q = k then {old} else v end) end"
        return n + (
            f"{name}_r as (select doc_id, page, box_id, i, [y] as s, [1.0::double] as c, [y] as f, 1::bigint as line from {name}_n where i = 1 union all select doc_id, page, box_id, i, {put('s', 'y', 'v + y')}, {put('c', '1.0::double', 'v + 1')}, case when k = 0 then list_append(f, y) else f end, "
            f"case when k = 0 then length(s) + 1 else k end from (select n.doc_id, n.page, n.box_id, n.i, n.y, s, c, f, {join} as k from {name}_r r join {name}_n n on n.doc_id = r.doc_id and n.page = r.page and n.i = r.i + 1)), "
            f"{name} as (select doc_id, page, box_id, line - 1 as line from {name}_r) "
        )
    near = {"anchor": "least(10.0, greatest(4.0, coalesce(nullif(n.h, 0), 14.0) * 0.4))", "half": "least(n.h, ah) * 0.5", "centre": "greatest(6.0, least(12.0, least(n.h, ah) * 0.7))"}[rule]
    return n + (
        f"{name}_r as (select doc_id, page, box_id, i, y as ay, h as ah, 0::bigint as line from {name}_n where i = 1 union all select n.doc_id, n.page, n.box_id, n.i, case when abs(n.y - ay) <= {near} then ay else n.y end, case when abs(n.y - ay) <= {near} then ah else n.h end, "
        f"case when abs(n.y - ay) <= {near} then line else line + 1 end from {name}_r r join {name}_n n on n.doc_id = r.doc_id and n.page = r.page and n.i = r.i + 1), {name} as (select doc_id, page, box_id, line from {name}_r) "
    )


def _sql(rule: str) -> str:
    return "with recursive " + recursive(rule) + "select doc_id, page, box_id, line as row from rw"


@query(_sql("mean"))
def rows_by_mean(spark: SparkSession, base: str) -> DataFrame:
    return rows.grouped(table(spark, base, "boxes"), "mean")


@query(_sql("first"))
def rows_by_first(spark: SparkSession, base: str) -> DataFrame:
    return rows.grouped(table(spark, base, "boxes"), "first")


@query(_sql("anchor"))
def rows_by_anchor(spark: SparkSession, base: str) -> DataFrame:
    return rows.grouped(table(spark, base, "boxes"), "anchor")


@query(_sql("half"))
def rows_by_half(spark: SparkSession, base: str) -> DataFrame:
    return rows.grouped(table(spark, base, "boxes"), "half")


@query(
    "with recursive " + recursive("centre") + ", b as (select distinct * replace (lower(doc_id) as doc_id) from boxes), j as (select b.*, line from b join rw using (doc_id, page, box_id)), "
    "g as (select *, case when box_left - lag(box_left + box_width) over w > 100 then 1 else 0 end nw from j window w as (partition by doc_id, page, line order by box_left, box_id)) "
    "select box_id, line as row, (sum(nw) over (partition by doc_id, page, line order by box_left, box_id rows unbounded preceding))::bigint as segment from g"
)
def money_segments(spark: SparkSession, base: str) -> DataFrame:
    """Rows by centres, cut where the blank is wider than 100."""
    b = table(spark, base, "boxes").distinct()
    return rows.segmented(b, rows.grouped(b, "centre"), 100).select("box_id", "row", "segment")
