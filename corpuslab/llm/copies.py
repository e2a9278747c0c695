"""Copies hidden by formatting: the same letters and digits under other white space, case, punctuation or field order.

Records are hashed bottom-up like a Merkle tree. A leaf is normalised to its letters and digits in lower case. A
narrative is an ordered node, whose digest is that of its normalised text. An intake form, which consists only of
``Label: value`` fields parted by line breaks, semicolons or bars, is an unordered node besides: the digests of its
fields are sorted before they are hashed. Rows group by root digest, and within a group every row's full
structure is compared with that of the group's first row.

Defined cases: a null narrative is no copy of anything and gives no row. Empty narratives, and those without any
letter or digit, are copies of one another. Rows repeated with id and text are one record. Where two forms are copies by order and others by fields, the relation
carries over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.components import connected_components
from corpuslab.operators.joins import salted
from corpuslab.session import Stage

OTHER = r"[^\p{L}\p{N}]+"
PARTS = r"[\n\r\x0B\f\x{85}\x{2028}\x{2029};|]+"


def leaf(text: Column) -> Column:
    """Letters and digits in lower case."""
    return F.regexp_replace(F.lower(text), OTHER, "")


def is_form(text: Column) -> Column:
    """Whether the text consists of two or more fields (a single field has no order)."""
    parts = F.filter(F.split(text, PARTS), lambda p: ~p.rlike(r"\A[\s\p{Z}]*\z"))
    labelled = F.forall(parts, lambda p: p.rlike(r"\A[^:]*[\p{L}\p{N}][^:]*:"))
    return F.coalesce(text.rlike(r"[\n\r\x0B\f\x{85}\x{2028}\x{2029};|]") & text.contains(":") & (F.size(parts) > 1) & labelled, F.lit(False))


def field_node(text: Column) -> Column:
    """The sorted, normalised fields of a form."""
    return F.array_sort(F.filter(F.transform(F.split(text, PARTS), leaf), lambda p: p != ""))


def collapse_copies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(row_id, first_row_id, copies, by_fields)`` for every row with a narrative: the smallest row of its copies, how
    many rows they are, and whether the row is a form.

    Only ids and 128-bit digests are shuffled for the grouping. Digests are grouped with map-side combine, so
    a narrative copied into a third of all rows moves as one row per task. Full structures move only for rows
    that share a digest."""
    spark = docs.sparkSession
    stage = Stage(spark, "copies")
    base = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("t"))
    node = base.select(
        "row_id",
        F.unhex(F.md5(leaf(F.col("t")).cast("binary"))).alias("k1"),
        F.when(is_form(F.col("t")), F.unhex(F.md5(F.concat_ws("\n", F.transform(field_node(F.col("t")), lambda x: F.md5(x.cast("binary")))).cast("binary")))).alias("k2"),
    )
    keys = stage.put(node.distinct(), "digests")
    # root of each ordered digest: the form digest where there is one, so that both kinds of key meet
    forms = keys.filter("k2 is not null").select("k1", "k2").distinct()
    root = forms.groupBy("k1").agg(F.min("k2").alias("root"), F.count(F.lit(1)).alias("n"))
    edges = forms.join(root.filter("n > 1"), "k1").filter("k2 <> root").select(F.hex("k2").alias("src"), F.hex("root").alias("dst"))
    if edges.isEmpty():
        named = root.select("k1", "root")
    else:
        comp = connected_components(edges).select(F.unhex("node").alias("root"), F.unhex("component").alias("c"))
        named = root.join(comp, "root", "left").select("k1", F.coalesce("c", "root").alias("root"))
    k1s = keys.groupBy("k1").agg(F.min("row_id").alias("lo"), F.count(F.lit(1)).alias("n"))
    k1s = k1s.join(named, "k1", "left").withColumn("root", F.coalesce("root", F.concat(F.lit(b"="), F.col("k1"))))
    groups = k1s.groupBy("root").agg(F.min("lo").alias("first_row_id"), F.sum("n").alias("copies"))
    k1s = stage.put(k1s.join(groups, "root").select("k1", "lo", "n", "first_row_id", "copies"), "groups")
    many = k1s.filter("copies > 1")
    members = keys.join(many, "k1").select("row_id", "k1", "k2", "lo", "n", "first_row_id", "copies")
    sure = _confirm(base, stage.put(members, "members"), stage)
    single = keys.join(many.select("k1"), "k1", "left_anti").select(
        "row_id", F.col("row_id").alias("first_row_id"), F.lit(1).cast("long").alias("copies"), F.col("k2").isNotNull().alias("by_fields")
    )
    return sure.unionByName(single)


def _confirm(base: DataFrame, members: DataFrame, stage: Stage) -> DataFrame:
    """Compare the full structure of each row with that of the first row of its ordered digest, and of that row's
    fields with those of the first row of the form digest. A row that only shares a digest stays alone."""
    full = base.join(members, "row_id").select("*", leaf(F.col("t")).alias("flat"), F.when(F.col("k2").isNotNull(), field_node(F.col("t"))).alias("tree")).drop("t")
    full = stage.put(full, "structures")
    # an id that stands in several rows meets each of its texts; only the one of this digest counts. Read back first,
    # or the comparison would become a join key and every text of the table would be normalised again
    full = full.filter(F.unhex(F.md5(F.col("flat").cast("binary"))) == F.col("k1")).dropDuplicates(["row_id", "k1", "k2"])
    n = full.count()
    heads = full.filter("row_id = lo").select("k1", F.col("flat").alias("head_flat"), "n")
    # heads carry texts of any length, so hot ones go to parts instead of to all tasks
    same = salted(full, heads.drop("n"), ["k1"], heads.select("k1", "n"), "n", n, F.col("row_id")).withColumn("ok1", F.col("flat") == F.col("head_flat"))
    trees = full.filter("k2 is not null").groupBy("k2").agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("n2"))
    trees = trees.join(full.select("row_id", F.col("tree").alias("head_tree")), "row_id").select("k2", "head_tree", "n2")
    ordered = same.filter("k2 is null").withColumn("ok", F.col("ok1"))
    forms = salted(same.filter("k2 is not null"), trees.drop("n2"), ["k2"], trees.select("k2", "n2"), "n2", n, F.col("row_id")).withColumn("ok", F.col("ok1") & (F.col("tree") == F.col("head_tree")))
    both = ordered.select("row_id", "k2", "first_row_id", "copies", "ok").unionByName(forms.select("row_id", "k2", "first_row_id", "copies", "ok"))
    return both.select(
        "row_id",
        F.when(F.col("ok"), F.col("first_row_id")).otherwise(F.col("row_id")).alias("first_row_id"),
        F.when(F.col("ok"), F.col("copies")).otherwise(F.lit(1).cast("long")).alias("copies"),
        F.col("k2").isNotNull().alias("by_fields"),
    )
