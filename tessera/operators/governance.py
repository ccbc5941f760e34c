"""Who may see what, and in which order: access groups, block states, page dispositions, layers, metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import schema as S


def allowed(acl, groups: list[str] | None):
    """No list: public; a list and no groups: denied; else any group in common."""
    acl = F.col(acl) if isinstance(acl, str) else acl
    if not groups:
        return acl.isNull() | (F.size(acl) == 0)
    return acl.isNull() | (F.size(acl) == 0) | F.arrays_overlap(acl, F.array(*map(F.lit, groups)))


def inherited_acl(documents: DataFrame) -> DataFrame:
    """path, acl: a derived page (with a `source`) has the list of the document it was made from."""
    src = documents.select(F.col("path").alias("origin"), F.col("acl").alias("origin_acl"))
    rows = documents.withColumn("origin", F.regexp_replace("source", "^raw/", ""))
    return rows.join(src, "origin", "left").select("path", F.when(F.col("source").isNotNull(), F.col("origin_acl")).otherwise(F.col("acl")).alias("acl"))


def acl_filter(rows: DataFrame, acls: DataFrame, groups: list[str] | None) -> DataFrame:
    return rows.join(acls.select(F.col("path").alias("doc_path"), "acl"), "doc_path", "left").filter(allowed("acl", groups)).drop("acl")


def state_filter(rows: DataFrame, states: DataFrame, include: tuple[str, ...] = ()) -> DataFrame:
    """Rows of hidden states go unless they are asked for; rows without a state are active."""
    hidden = [s for s in S.HIDDEN_STATES if s not in include]
    out = rows.join(states.select("id", F.col("state").alias("st_")), "id", "left").withColumn("state", F.coalesce("st_", F.lit("active"))).drop("st_")
    return out.filter(~F.col("state").isin(hidden)) if hidden else out


def disposition_bands(rows: DataFrame, pages: DataFrame, include: tuple[str, ...] = ()) -> DataFrame:
    """Rows of retracted pages go, or to the very end where their own state is asked for; stale pages sink, else the
    order stays.  Adds band; `rank` is renewed."""
    out = rows.join(pages.select("doc_path", F.col("state").alias("ps_"), "stale"), "doc_path", "left")
    band = F.when(F.col("ps_") == "retracted", 2).when(F.coalesce("stale", F.lit(False)), 1).otherwise(0)
    out = out.withColumn("band", band).drop("ps_", "stale")
    keep = F.col("band") < 2
    if include and "state" in rows.columns:
        keep = keep | F.col("state").isin(*include)
    return reranked(out.filter(keep), "band")


def reranked(rows: DataFrame, *first) -> DataFrame:
    """Ranks renewed by `first`, then the old rank; rows are a bounded result list."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*first, "rank", "id")) - 1)


def filter_chain(rows: DataFrame, acls: DataFrame, states: DataFrame, pages: DataFrame, groups=None, include: tuple[str, ...] = ()) -> DataFrame:
    """Access, then state, then disposition: what every read path applies."""
    return disposition_bands(state_filter(acl_filter(rows, acls, groups), states, include), pages, include)


def metadata_filter(rows: DataFrame, documents: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """All fields must match, each by any allowed value; a missing field doesn't; `fm` maps keys to lists."""
    key = F.regexp_replace(F.col("doc_path"), "^sources/", "")
    test = reduce(lambda a, b: a & b, [F.coalesce(F.arrays_overlap(F.col("fm")[k], F.array(*map(F.lit, v))), F.lit(False)) for k, v in wanted.items()], F.lit(True))
    return rows.withColumn("k_", key).join(documents.select(F.col("path").alias("k_"), "fm"), "k_").filter(test).drop("k_", "fm")


def layer_filter(rows: DataFrame, layer: str | None) -> DataFrame:
    return rows if layer is None else rows.filter(F.col("layer") == "raw" if layer == "raw" else F.col("layer") != "raw")
