"""The link graph: structural edges, link resolution, confidence, personalised PageRank."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.functions import text as X
from tessera.operators.containment import contained, plain
from tessera.session import discard, stored


def structural_edges(blocks: DataFrame, key: str, kind: str) -> DataFrame:
    """src, dst, kind, weight between all blocks that share `key`; rows of the derived layer weigh nothing."""
    a = blocks.select(key, F.col("id").alias("src"), F.col("layer").alias("l"))
    b = blocks.select(key, F.col("id").alias("dst"))
    weight = F.when(F.col("l") == "raw", S.EDGE_WEIGHTS[kind]).otherwise(0.0)
    return a.join(b, key).filter("src <> dst").select("src", "dst", F.lit(kind).alias("kind"), weight.alias("weight"))


def resolve_links(blocks: DataFrame, documents: DataFrame, sections: DataFrame, contains: bool = False) -> DataFrame:
    """src, dst, kind, weight of the links in block texts: the first of document path, path with .md, document title and
    section title that exists; a link to a document or section fans out to its blocks; unresolved links keep their target.

    With `contains`, a link that names no document goes to every section whose id contains its target (A-Z in either case),
    which is more than the sections of that title.  Every step is a join by equality (of n-grams for the last one), so
    the work grows with links and not with pairs."""
    links = blocks.select(F.col("id").alias("src"), F.explode(F.array_distinct(X.wikilinks("raw"))).alias("target")).filter("target <> ''")
    keys = documents.select(F.lit(1).alias("p"), F.col("path").alias("target"), F.col("path").alias("doc_path"), F.lit(None).cast("string").alias("section_id"))
    keys = keys.unionByName(documents.filter(F.col("path").endswith(".md")).select(F.lit(2).alias("p"), F.regexp_replace("path", r"\.md$", "").alias("target"), F.col("path").alias("doc_path"), F.lit(None).cast("string").alias("section_id")))
    keys = keys.unionByName(documents.select(F.lit(3).alias("p"), F.col("title").alias("target"), F.col("path").alias("doc_path"), F.lit(None).cast("string").alias("section_id")))
    if contains:
        left = links.select("target").distinct().join(keys.select("target").distinct(), "target", "left_anti")
        ids = sections.select("id", "doc_path", plain("id").alias("text")).distinct()
        found = contained(left.select(plain("target").alias("needle")), ids)
        named = left.withColumn("needle", plain("target")).join(found, "needle").join(ids.select("id", "doc_path"), "id")
        keys = keys.unionByName(named.select(F.lit(4).alias("p"), "target", "doc_path", F.col("id").alias("section_id")))
    else:
        keys = keys.unionByName(sections.select(F.lit(4).alias("p"), F.col("title").alias("target"), "doc_path", F.col("id").alias("section_id")))
    met = links.join(keys, "target", "left")
    best = met.groupBy("src", "target").agg(F.min("p").alias("best"))
    first = met.join(best, ["src", "target"]).filter(F.col("p").eqNullSafe(F.col("best")))
    by_doc = first.filter("p < 4").select("src", "doc_path").join(blocks.select("doc_path", F.col("id").alias("dst")), "doc_path").select("src", "dst")
    by_section = first.filter("p = 4").select("src", "section_id").join(blocks.select("section_id", F.col("id").alias("dst")), "section_id").select("src", "dst")
    found = by_doc.unionByName(by_section).filter("src <> dst").distinct().select("src", "dst", F.lit("wikilink").alias("kind"), F.lit(1.0).alias("weight"))
    lost = first.filter("p is null").select("src", F.col("target").alias("dst")).distinct().select("src", "dst", F.lit("wikilink-unresolved").alias("kind"), F.lit(0.0).alias("weight"))
    return found.unionByName(lost)


def weighted_edges(links: DataFrame, blocks: DataFrame, confidence: DataFrame) -> DataFrame:
    """src, dst, w: the weight times the confidence of the source: high for source rows and unknown ones, else what the
    document's page says (doc_path, confidence), draft by default."""
    src = links.join(blocks.select(F.col("id").alias("src"), "doc_path", "layer"), "src", "left").join(confidence, "doc_path", "left")
    level = F.when(F.coalesce("layer", F.lit("raw")) == "raw", "high").otherwise(F.coalesce("confidence", F.lit("draft")))
    return src.select("src", "dst", (F.col("weight") * X.edge_multiplier(level)).alias("w"))


def weighted_members(members: DataFrame, blocks: DataFrame, confidence: DataFrame) -> DataFrame:
    """`cliques` with the confidence of the member's document in its weight, as `weighted_edges` has it."""
    w = weighted_edges(members.select(F.col("id").alias("src"), F.col("group").alias("dst"), F.col("w").alias("weight")), blocks, confidence)
    return w.select(F.col("dst").alias("group"), F.col("src").alias("id"), "w")


def pagerank_kernel(edges: pd.DataFrame, seeds: list, rounds: int = S.ROUNDS, tolerance: float | None = S.TOLERANCE, members: pd.DataFrame | None = None) -> pd.DataFrame:
    """Personalised PageRank over one small frontier.  Weight that leaves the node set is lost, as out-weights count it.

    `members` (src, group, w, others) are cliques: a group's flow is summed once and each member receives it without its
    own part."""
    import numpy as np

    if members is None:
        members = pd.DataFrame({"src": [], "group": [], "w": [], "others": []})
    nodes = sorted({*seeds, *edges.src, *edges.loc[edges.inside, "dst"], *members.src})
    at = {n: i for i, n in enumerate(nodes)}
    n = len(nodes)
    p = np.zeros(n)
    p[[at[s] for s in seeds]] = 1 / len(seeds)
    out = np.bincount(edges.src.map(at), weights=edges.w, minlength=n) if len(edges) else np.zeros(n)
    own = edges[edges.inside & (edges.w > 0)]
    s, d, w = own.src.map(at).to_numpy(dtype=int), own.dst.map(at).to_numpy(dtype=int), own.w.to_numpy(dtype=float)
    m, mw = members.src.map(at).to_numpy(dtype=int), members.w.to_numpy(dtype=float)
    g = pd.factorize(members.group)[0]
    if len(m):
        out = out + np.bincount(m, weights=mw * members.others.to_numpy(dtype=float), minlength=n)
    pr = np.full(n, 1 / n)
    for _ in range(rounds):
        flow = np.bincount(d, weights=pr[s] * w / out[s], minlength=n).astype(float)
        if len(m):
            give = np.where(mw > 0, pr[m] * mw / np.where(out[m] > 0, out[m], 1), 0)
            flow += np.bincount(m, weights=np.bincount(g, weights=give)[g] - give, minlength=n)
        new = (1 - S.DAMPING) * p + S.DAMPING * flow + S.DAMPING * pr[out <= 0].sum() * p
        moved, pr = np.abs(new - pr).sum(), new
        if tolerance is not None and moved < tolerance:
            break
    return pd.DataFrame({"id": nodes, "pr": pr})


def frontier(edges: DataFrame, seeds: DataFrame, hops: int = S.HOPS, cap: int = S.FRONTIER, members: DataFrame | None = None) -> DataFrame:
    """query, id: the seeds and what they reach in so many hops; a query whose set is over the cap goes no further.

    A clique is entered once by a query, whoever of its members is in the set."""
    nodes = seeds.select("query", "id").distinct()
    for _ in range(hops):
        small = nodes.groupBy("query").count().filter(F.col("count") <= cap).select("query")
        now = nodes.join(small, "query")
        step = now.join(edges.select(F.col("src").alias("id"), "dst"), "id").select("query", F.col("dst").alias("id"))
        if members is not None:
            groups = now.join(members.select("id", "group"), "id").select("query", "group").distinct()
            step = step.unionByName(groups.join(members.select("group", "id"), "group").select("query", "id"))
        nodes = nodes.unionByName(step).distinct()
    return nodes


def personalized_pagerank(edges: DataFrame, seeds: DataFrame, rounds: int = S.ROUNDS, tolerance: float | None = S.TOLERANCE, members: DataFrame | None = None) -> DataFrame:
    """query, id, pr for seeds (query, id): joins find each query's frontier, a task per query iterates over it.

    `members` (group, id, w) are cliques whose pairs are never formed.  A frontier is bounded by the hops and the cap (and
    the sizes of the groups it enters); for rank over a whole graph use `pagerank_by_joins`."""
    nodes = frontier(edges, seeds, members=members)
    own = nodes.select("query", F.col("id").alias("src")).join(edges, "src")
    inside = nodes.select("query", F.col("id").alias("dst"), F.lit(True).alias("inside"))
    q = seeds.schema["query"].dataType.simpleString()
    i = seeds.schema["id"].dataType.simpleString()
    none = {"group": F.lit(None).cast("string"), "others": F.lit(None).cast("bigint")}
    own = own.join(inside, ["query", "dst"], "left").select("query", "src", "dst", "w", F.coalesce("inside", F.lit(False)).alias("inside"), *(c.alias(k) for k, c in none.items()))
    blank = [F.lit(None).cast(i).alias("dst"), F.lit(None).cast("double").alias("w"), F.lit(None).cast("boolean").alias("inside")]
    rows = own.unionByName(seeds.select("query", F.col("id").alias("src"), *blank, *(c.alias(k) for k, c in none.items())))
    if members is not None:
        sizes = members.groupBy("group").agg((F.count("*") - 1).alias("others")).filter("others > 0")
        held = nodes.select("query", F.col("id").alias("src")).join(members.select(F.col("id").alias("src"), "group", "w"), "src").join(sizes, "group")
        rows = rows.unionByName(held.select("query", "src", blank[0], "w", blank[2], "group", "others"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        in_group = pdf.group.notna()
        is_seed = pdf.inside.isna() & ~in_group
        out = pagerank_kernel(pdf[~is_seed & ~in_group].astype({"inside": bool}), sorted(set(pdf[is_seed].src)), rounds, tolerance, pdf[in_group])
        return out.assign(query=pdf["query"].iloc[0])[["query", "id", "pr"]]

    return rows.groupBy("query").applyInPandas(run, f"query {q}, id {i}, pr double")


def cliques(blocks: DataFrame, **keys: str) -> DataFrame:
    """group, id, w: memberships that stand for the edges between all blocks of a group, one row a block instead of one a
    pair.  `keys` maps a kind of `structural_edges` (same_doc, same_section) to its column; blocks without it are in no group
    of that kind.  Rows of the derived layer weigh nothing."""
    rows = None
    for kind, key in keys.items():
        base = S.EDGE_WEIGHTS[kind.replace("_", "-")]
        part = blocks.filter(F.col(key).isNotNull()).select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("group"), "id", F.when(F.col("layer") == "raw", F.lit(base)).otherwise(0.0).alias("w"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def clique_edges(members: DataFrame) -> DataFrame:
    """src, dst, w: the pairs that memberships stand for, for small graphs and tests; grows with the square of a group."""
    a = members.select("group", F.col("id").alias("src"), "w")
    return a.join(members.select("group", F.col("id").alias("dst")), "group").filter("src <> dst").select("src", "dst", "w")


def pagerank_by_joins(edges: DataFrame, seeds: DataFrame, rounds: int, every: int = 1, members: DataFrame | None = None) -> DataFrame:
    """id, pr by one join and one aggregate a round, for graphs that no task holds; its state (a row a node) is
    stored every round, as a round reads it four times, and what it replaces is deleted.

    `members` (group, id, w) are cliques: a member of weight w has an edge of that weight to every other member.  No pair
    is formed: a group's flow is the sum of what its members give to each edge, and a member receives that sum without its
    own part.  Work grows with the memberships, whatever the size of a group."""
    named = [edges.select(F.col("src").alias("id")), edges.select(F.col("dst").alias("id")), seeds.select("id")] + ([members.select("id")] if members is not None else [])
    nodes = reduce(DataFrame.unionByName, named).distinct()
    n = nodes.count()
    k = seeds.select("id").distinct().count()
    pers = nodes.join(seeds.select("id", F.lit(1.0 / max(1, k)).alias("p")).distinct(), "id", "left").select("id", F.coalesce("p", F.lit(0.0)).alias("p"))
    weights = edges.select(F.col("src").alias("id"), "w")
    if members is not None:
        sizes = members.groupBy("group").agg((F.count("*") - 1).alias("others")).filter("others > 0")
        members = members.join(sizes, "group").select("group", "id", "w", "others")
        weights = weights.unionByName(members.select("id", (F.col("w") * F.col("others")).alias("w")))
    out = stored(weights.groupBy(F.col("id").alias("src")).agg(F.sum("w").alias("out")))
    share = edges.join(out, "src").filter("w > 0").select("src", "dst", (F.col("w") / F.col("out")).alias("f"))
    if members is not None:
        members = stored(members.join(out.withColumnRenamed("src", "id"), "id", "left").select("group", "id", F.when(F.col("w") > 0, F.col("w") / F.col("out")).otherwise(0.0).alias("f")))
    pr = pers.select("id", "p", F.lit(1.0 / max(1, n)).alias("pr"))
    pr_at = None
    for r in range(rounds):
        came = share.join(pr.select(F.col("id").alias("src"), "pr"), "src").select(F.col("dst").alias("id"), (F.col("pr") * F.col("f")).alias("flow"))
        if members is not None:
            given = members.join(pr.select("id", "pr"), "id").select("group", "id", (F.col("pr") * F.col("f")).alias("give"))
            whole = given.groupBy("group").agg(F.sum("give").alias("all_"))
            came = came.unionByName(given.join(whole, "group").select("id", (F.col("all_") - F.col("give")).alias("flow")))
        flow = came.groupBy("id").agg(F.sum("flow").alias("flow"))
        dangling = pr.join(out.filter("out > 0").select(F.col("src").alias("id")), "id", "left_anti").agg(F.coalesce(F.sum("pr"), F.lit(0.0)).alias("lost"))
        pr = pr.join(flow, "id", "left").crossJoin(F.broadcast(dangling)).select("id", "p", ((1 - S.DAMPING) * F.col("p") + S.DAMPING * F.coalesce("flow", F.lit(0.0)) + S.DAMPING * F.col("lost") * F.col("p")).alias("pr"))
        if r % every == every - 1 and r + 1 < rounds:
            old, pr = pr_at, stored(pr, "rank")
            pr_at = pr.stored_at
            if old:
                discard(pr.sparkSession, old)
    return pr.select("id", "pr")
