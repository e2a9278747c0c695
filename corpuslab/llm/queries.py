"""The queries of the operators for training data, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NARRATIVE = "Consumer complaint narrative"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslab.llm.encoding import repair_encoding

    return repair_encoding(_read(spark, sf_dir, "combined_complaints"), "row_id", NARRATIVE, "Submitted via")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_restored(spark, sf_dir).select("row_id")


def p2_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct narrative with its number of copies."""
    from corpuslab.llm.copies import collapse_copies

    return collapse_copies(_read(spark, sf_dir, "combined_complaints"), "row_id", NARRATIVE).filter("row_id = first_row_id").select("row_id", "copies")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslab.llm.copies import collapse_copies

    found = collapse_copies(_read(spark, sf_dir, "combined_complaints"), "row_id", NARRATIVE)
    return found.filter("row_id <> first_row_id").select("first_row_id", "row_id")


def _config(spark: SparkSession, sf_dir: str):
    return _read(spark, sf_dir, "data_config").filter("is_current").select("split.*").first()


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslab.llm.splits import assign_components, tie_components

    c = _config(spark, sf_dir)
    records = _read(spark, sf_dir, "combined_complaints").select("Complaint ID", c.stratify_on)
    ties = tie_components(records, "Complaint ID", _read(spark, sf_dir, "complaint_entities"), c.group_by.split(","), c.unbound_keys)
    return assign_components(records, "Complaint ID", c.stratify_on, ties, c.train_val_test, c.seed)


def p3_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each complaint with its component and split."""
    return _assigned(spark, sf_dir).select(F.col("id").alias("complaint_id"), F.col("component").alias("first_complaint_id"), "label", "split")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_split(spark, sf_dir).filter("complaint_id <> first_complaint_id").select("first_complaint_id", "complaint_id")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each split and the share of each product in it, beside what is wanted and what the hashed start gave."""
    from corpuslab.llm.splits import split_report

    return split_report(_assigned(spark, sf_dir), _config(spark, sf_dir).train_val_test)


def p3_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each component of several complaints how many it has, and over how many splits they are: one, if it is whole."""
    c = _assigned(spark, sf_dir).groupBy(F.col("component").alias("first_complaint_id")).agg(F.count(F.lit(1)).alias("complaints"), F.count_distinct("split").alias("splits"))
    return c.filter("complaints > 1")


def _sampled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from corpuslab.llm.sampling import sample_to_targets

    return sample_to_targets(_read(spark, sf_dir, "combined_complaints"), "Complaint ID", "Product", _read(spark, sf_dir, "sample_targets"))


def p4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(spark, sf_dir)[0].select("plan_id", F.col("id").alias("complaint_id"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(spark, sf_dir)[1]


def p4_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each plan the rows in its sample, those wanted, and by how many records its categories are off together."""
    sample, report = _sampled(spark, sf_dir)
    drawn = sample.groupBy("plan_id").agg(F.count_distinct("id").alias("drawn"))
    per = report.withColumn("p", F.trim(F.regexp_replace(F.lower("product"), r"[\s\p{Z}]+", " "))).groupBy("plan_id", "p").agg(F.max("sample_size").alias("s"), F.max("wanted").alias("w"), F.max("drawn").alias("d"))
    plan = per.groupBy("plan_id").agg(F.max("s").alias("sample_size"), F.sum(F.abs(F.col("w") - F.col("d"))).alias("off"))
    return plan.join(drawn, "plan_id", "left").select("plan_id", "sample_size", F.coalesce("drawn", F.lit(0)).alias("drawn"), "off")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_report(spark, sf_dir).filter("short").select("plan_id", "product")


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of a group of near-duplicates with the group's smallest row."""
    from corpuslab.llm.neardup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "combined_complaints"), "row_id", NARRATIVE, k=3, threshold=0.6)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_groups(spark, sf_dir).filter("row_id <> first_row_id").select("first_row_id", "row_id")


def p6_ids(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    from corpuslab.llm.tokens import DEFAULT_PATH, encode_corpus

    return encode_corpus(_read(spark, sf_dir, "documents"), "doc_id", "text", tokenizer or DEFAULT_PATH)


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslab.llm.leakage import find_leaks

    return find_leaks(_read(spark, sf_dir, "documents"), "doc_id", "text", _read(spark, sf_dir, "benchmark"), "item_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).filter("kind = 'verbatim'").select("doc_id", "item_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslab.llm.spans import shared_spans

    return shared_spans(_read(spark, sf_dir, "documents"), "doc_id", "text")


def p8_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document stands elsewhere."""
    from corpuslab.llm.spans import shared_share

    return shared_share(_read(spark, sf_dir, "documents"), "doc_id", "text", p8_found(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


_CATEGORY = r"""trim(regexp_replace(lower({}), '[\s\p{{Z}}]+', ' ', 'g'))"""
_TRIM = r"""lower(regexp_replace(regexp_replace({}, '^[\s\p{{Z}}]+', ''), '[\s\p{{Z}}]+$', ''))"""
_LEAF = r"""regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', '', 'g')"""
_WORDS = r"""regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"""
#: Rows of ``reach`` (a, b) are every node and what it reaches along ``sym``.
_REACH = "reach(a, b) as (select a, a from sym union select reach.a, sym.b from reach join sym on reach.b = sym.a), root as (select a, min(b) as lo from reach group by 1)"

SQL: dict[str, str] = {
    "p2_found": rf"""
with recursive c as (select row_id, "{NARRATIVE}" as t from combined_complaints where "{NARRATIVE}" is not null),
parts as (select row_id, list_filter(regexp_split_to_array(t, '[\n\r;|]+'), lambda p: not regexp_matches(p, '^[\s\p{{Z}}]*$')) as ps from c),
forms as (select row_id, list_sort(list_filter(list_transform(ps, lambda p: {_LEAF.format("p")}), lambda p: p <> '')) as k from parts where len(ps) > 1 and len(list_filter(ps, lambda p: not regexp_matches(p, '^[^:]*[\p{{L}}\p{{N}}][^:]*:'))) = 0),
keys as (select row_id, md5({_LEAF.format("t")}) as k from c union all select row_id, 'form' || md5(array_to_string(k, chr(10))) from forms),
heads as (select k, min(row_id) as h from keys group by 1 having count(*) > 1),
sym as (select row_id as a, h as b from keys join heads using (k) union select h, row_id from keys join heads using (k)), {_REACH}
select lo as first_row_id, a as row_id from root where lo <> a""",
    "p3_found": f"""
with recursive cfg as (select split.group_by as kinds, split.unbound_keys as skip from data_config where is_current),
e as (select distinct "Complaint ID" as id, {_TRIM.format("entity_kind")} as kind, {_TRIM.format("entity_key")} as key from complaint_entities),
f as (select e.* from e, cfg where list_contains(list_transform(string_split(kinds, ','), lambda q: lower(trim(q))), kind) and key is not null and key <> '' and not list_contains(list_transform(coalesce(skip, []), lambda q: lower(trim(q))), key) and id in (select "Complaint ID" from combined_complaints)),
heads as (select kind, key, min(id) as h from f group by all having count(*) > 1),
sym as (select id as a, h as b from f join heads using (kind, key) union select h, id from f join heads using (kind, key)), {_REACH}
select lo as first_complaint_id, a as complaint_id from root where lo <> a""",
    "p3_audit": f"""
with recursive cfg as (select split.group_by as kinds, split.unbound_keys as skip from data_config where is_current),
e as (select distinct "Complaint ID" as id, {_TRIM.format("entity_kind")} as kind, {_TRIM.format("entity_key")} as key from complaint_entities),
f as (select e.* from e, cfg where list_contains(list_transform(string_split(kinds, ','), lambda q: lower(trim(q))), kind) and key is not null and key <> '' and not list_contains(list_transform(coalesce(skip, []), lambda q: lower(trim(q))), key) and id in (select "Complaint ID" from combined_complaints)),
heads as (select kind, key, min(id) as h from f group by all having count(*) > 1),
sym as (select id as a, h as b from f join heads using (kind, key) union select h, id from f join heads using (kind, key)), {_REACH}
select lo as first_complaint_id, count(*) as complaints, 1::bigint as splits from root group by 1""",
    "p4_found": f"""
with c as (select distinct "Complaint ID" as id, {_CATEGORY.format('"Product"')} as product from combined_complaints where "Complaint ID" is not null),
per as (select product, count(*) as n from c group by 1),
all_n as (select count(distinct "Complaint ID") as n from combined_complaints),
t as (select plan_id, product, greatest(min_rows, (all_n.n * sample_bp // 10000) * target_bp // 10000) as wanted from sample_targets, all_n)
select t.plan_id, t.product from t left join per on per.product = {_CATEGORY.format("t.product")} where coalesce(per.n, 0) < t.wanted""",
    # the least deviation there can be where a complaint has one product: what is missing, what doesn't fit, and what has to be filled up
    "p4_audit": f"""
with c as (select distinct "Complaint ID" as id, {_CATEGORY.format('"Product"')} as product from combined_complaints where "Complaint ID" is not null),
per as (select product, count(*) as n from c group by 1),
all_n as (select count(distinct "Complaint ID") as n from combined_complaints),
t as (select plan_id, {_CATEGORY.format("product")} as p, max(all_n.n * sample_bp // 10000) over (partition by plan_id) as s, min_rows, target_bp from sample_targets, all_n),
g as (select plan_id, p, max(s) as s, max(greatest(min_rows, s * target_bp // 10000)) as w from t group by 1, 2),
k as (select plan_id, max(s) as s, sum(w) as w, sum(least(w, coalesce(n, 0))) as fit, sum(coalesce(n, 0)) as named from g left join per on per.product = g.p group by 1)
select plan_id, s as sample_size, least(s, n) as drawn, (w - fit + greatest(0, fit - s) + greatest(0, s - fit - (n - named)))::bigint as off from k, all_n""",
    "p5_found": f"""
with recursive c as (select row_id, "{NARRATIVE}" as t, {_WORDS.format(f'"{NARRATIVE}"')} as ws from combined_complaints where "{NARRATIVE}" is not null),
s as (select distinct row_id, hash(ws[i], ws[i + 1], ws[i + 2]) as g from (select row_id, ws, unnest(range(1, len(ws) - 1)) as i from c)),
n as (select row_id, count(*) as n from s group by 1),
common as (select x.row_id as a, y.row_id as b, count(*) as k from s x join s y on x.g = y.g and x.row_id < y.row_id group by all),
near as (select a, b from common join n na on na.row_id = a join n nb on nb.row_id = b where k >= 0.6 * (na.n + nb.n - k) - 1e-9),
heads as (select t, min(row_id) as h from c group by 1 having count(*) > 1),
links as (select a, b from near union select h, row_id from c join heads using (t)),
sym as (select a, b from links union select b, a from links), {_REACH}
select lo as first_row_id, a as row_id from root where lo <> a""",
    "p7_found": f"""
with d as (select doc_id, {_WORDS.format("text")} as ws from documents where text is not null), i as (select item_id, {_WORDS.format("text")} as ws from benchmark where text is not null),
dw as (select doc_id, ws[p : p + 12] as w from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as p from d)),
iw as (select item_id, ws[p : p + 12] as w from (select item_id, ws, unnest(range(1, len(ws) - 11)) as p from i))
select distinct doc_id, item_id from dw join iw using (w)""",
    "p8_found": """
with w as (select doc_id, p, substr(text, p, 240) as s from (select doc_id, text, unnest(range(1, length(text) - 238)) as p from documents where length(text) >= 240)),
many as (select s from w group by 1 having min(doc_id) <> max(doc_id)),
hit as (select doc_id, p from w semi join many using (s)),
runs as (select *, sum(case when p <= before + 240 then 0 else 1 end) over (partition by doc_id order by p) as run from (select *, lag(p) over (partition by doc_id order by p) as before from hit))
select doc_id, min(p) as span_start, max(p) + 240 - min(p) as span_len from runs group by doc_id, run""",
}

_P2, _P5, _P8 = (SQL[k].rpartition("\nselect")[0] for k in ("p2_found", "p5_found", "p8_found"))
SQL |= {
    "p2_collapsed": _P2 + """, k as (select lo, count(*) as n from root group by 1)
select c.row_id, coalesce(k.n, 1) as copies from c left join root on root.a = c.row_id left join k on k.lo = c.row_id where root.a is null or root.lo = c.row_id""",
    "p5_groups": _P5 + "\nselect a as row_id, lo as first_row_id from root",
    "p8_share": _P8 + """, spans as (select doc_id, max(p) + 240 - min(p) as n from runs group by doc_id, run), d as (select doc_id, max(length(text)) as chars from documents where text is not null group by 1)
select d.doc_id, chars, coalesce(k, 0)::bigint as shared_chars, coalesce(k, 0) / nullif(chars, 0) as share from d left join (select doc_id, sum(n) as k from spans group by 1) using (doc_id)""",
}
