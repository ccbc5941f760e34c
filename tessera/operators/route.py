"""The whole route of a search: channels fused, governed, filtered, cut to the window, source rows first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import governance, retrieval
from tessera.session import stored


def route(lists: dict[str, DataFrame], weights: dict[str, float], blocks: DataFrame, acls: DataFrame, states: DataFrame, pages: DataFrame, documents: DataFrame, top: int, groups: list[str] | None = None, include_states: tuple[str, ...] = (), filters: dict[str, list[str]] | None = None, layer: str | None = None) -> DataFrame:
    """rank, id, doc_path, breadcrumb, raw, layer, state, score, scores (a number per channel), matched_by.

    `lists` are ranked lists (id, rank) by channel, each bounded by its channel's limit, so what is ranked here is bounded
    too.  Access, state and disposition come before metadata and the window; the layer is chosen inside the window."""
    fused = retrieval.attributed(retrieval.rrf([(df, weights[n]) for n, df in lists.items()]), lists)
    fused = fused.withColumn("scores", F.struct(*(F.col(f"s_{n}").alias(n) for n in lists))).drop(*(f"s_{n}" for n in lists))
    rows = retrieval.ranked(blocks.select("id", "doc_path", "breadcrumb", "raw", "layer").join(F.broadcast(fused), "id"))
    rows = governance.filter_chain(rows, acls, states, pages, groups, include_states)
    if filters:
        rows = governance.metadata_filter(rows, documents, filters)
    window = stored(governance.reranked(rows), "window").filter(F.col("rank") < top)
    out = governance.reranked(governance.layer_filter(retrieval.source_first(window), layer))
    return out.select("rank", "id", "doc_path", "breadcrumb", "raw", "layer", "state", "score", "scores", "matched_by")


def visible_paths(documents: DataFrame, acls: DataFrame, groups: list[str] | None) -> DataFrame:
    """path of every document that the groups may see."""
    return documents.select("path").join(acls.select("path", "acl"), "path", "left").filter(governance.allowed("acl", groups)).select("path").distinct()
