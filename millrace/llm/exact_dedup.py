"""Exact deduplication: group by a 128-bit content hash, compare bytes inside the groups.

The grouping key is (hash, text), so Spark's aggregate compares the bytes of texts whose hashes are
equal, and copies collapse before the shuffle. Only a hash that turns out to stand for several texts
takes the longer way, a join on the text itself.

Defined results: a null text counts as empty. Repeated rows of one id are copies of each other and one
of them stays. A null id is less wanted than any other; if all ids of a group are null, one of those
rows stays and keep_id is null. An empty table gives an empty result. Extra columns pass through
deduplicate() unread and are ignored by duplicate_groups().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import durable, require, text_or_empty


def content_hash_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _same(text: Column) -> Column:
    return text


def duplicate_groups(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] = _same,
    content_hash: Callable[[Column], Column] = content_hash_128,
) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256."""
    require(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), normalise(text_or_empty(text_col)).alias("body")).withColumn("h", content_hash(F.col("body")))
    chosen = F.max("id") if keep == "largest" else F.min("id")
    by_text = rows.groupBy("h", "body").agg(chosen.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = durable(by_text.select("h", "keep_id", "group_size", F.sha2("body", 256).alias("text_sha256")), "exact-groups")
    collided = groups.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("h")

    def placed(members: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
        # Repeated rows collapse here and unfold after the join, numbered, so that one of them stays.
        counted = members.groupBy("id", *on).agg(F.count(F.lit(1)).alias("times"))
        return (
            counted.join(known, on)
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
            .select("id", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")
        )

    if collided.isEmpty():
        out = placed(rows, groups, ["h"])
    else:
        apart = rows.join(collided, "h", "left_semi")
        again = apart.groupBy("h", "body").agg(chosen.alias("keep_id"), F.count(F.lit(1)).alias("group_size")).withColumn("text_sha256", F.sha2("body", 256))
        out = placed(rows.join(collided, "h", "left_anti"), groups, ["h"]).unionByName(placed(apart, again, ["h", "body"]))
    return out.withColumnRenamed("id", id_col)


def deduplicate(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    content_hash: Callable[[Column], Column] = content_hash_128,
) -> DataFrame:
    """The rows of docs that stay, with all their columns: one shuffle, copies collapse before it."""
    require(docs, id_col, text_col)
    others = [c for c in docs.columns if c != text_col]
    body = text_or_empty(text_col)
    row = F.struct(*[F.col(f"`{c}`") for c in others], F.col(text_col).isNull().alias("__was_null"))
    if keep == "largest":
        winner = F.max_by(row, F.struct(F.col(id_col).isNotNull(), F.col(id_col)))
    else:
        winner = F.min_by(row, F.struct(F.col(id_col).isNull(), F.col(id_col)))
    won = docs.groupBy(content_hash(body).alias("__h"), body.alias("__body")).agg(winner.alias("__row"))
    text = F.when(~F.col("__row.__was_null"), F.col("__body")).alias(text_col)
    return won.select(*[text if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
