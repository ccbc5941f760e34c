"""One object for a knowledge base: its tables, and what can be asked of them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.functions import text as X
from tessera.operators import answer, compile, governance, graph, ingest, lexical, lifecycle, quality, retrieval, route
from tessera.session import shared_folder, stored
from tessera.sources import tables
from tessera.sources.registry import Registry, stamp_of


@dataclass(frozen=True)
class KnowledgeBase:
    """documents (path, title, fm, layer), sections, blocks, links; states (id, state), pages (doc_path, state, stale)
    and vectors (id, vector) may be empty.  `members` are the same-document and same-section edges as cliques."""

    spark: SparkSession
    documents: DataFrame
    sections: DataFrame
    blocks: DataFrame
    links: DataFrame
    states: DataFrame
    pages: DataFrame
    vectors: DataFrame
    index: lexical.Index | None = None
    members: DataFrame | None = None
    registry: Registry | None = None

    @classmethod
    def from_documents(cls, spark: SparkSession, docs: DataFrame, vectors: DataFrame | None = None) -> KnowledgeBase:
        """From (path, text, layer, title, fm) rows: parses them, resolves links, takes declared states."""
        sections, blocks = map(stored, ingest.parse(docs.select("path", "text", "layer")))
        named = stored(docs.select("path", "title", "fm", "layer"))
        links = stored(graph.resolve_links(blocks, named, sections, contains=True).distinct())
        members = stored(graph.cliques(blocks, same_section="section_id", same_doc="doc_path"))
        declared = named.select(F.col("path").alias("doc_path"), F.get(F.col("fm")["state"], F.lit(0)).alias("state")).filter(F.col("state").isin(*S.STATES))
        states = blocks.select("id", "doc_path").join(declared, "doc_path").select("id", "state")
        pages = named.limit(0).select(F.col("path").alias("doc_path"), F.lit("active").alias("state"), F.lit(False).alias("stale"))
        none = blocks.limit(0).select("id", F.expr("cast(array() as array<double>)").alias("vector"))
        return cls(spark, named, sections, blocks, links, states, pages, vectors if vectors is not None else none, members=members)

    @classmethod
    def from_folders(cls, spark: SparkSession, raw: str, wiki: str | None = None) -> KnowledgeBase:
        docs = tables.documents(spark, raw)
        if wiki:
            docs = docs.unionByName(tables.documents(spark, wiki, "wiki"))
        return cls.from_documents(spark, docs)

    # ---- search

    def indexed(self, path: str | None = None) -> KnowledgeBase:
        """The base with a stored full-text index of its blocks, which its searches then read instead of the texts."""
        return replace(self, index=lexical.Index.build(self.blocks, path or f"{shared_folder(self.spark)}/index-{uuid.uuid4().hex}"))

    @property
    def acls(self) -> DataFrame:
        return governance.inherited_acl(self.documents.select("path", F.col("fm")["acl"].alias("acl"), F.get(F.col("fm")["source"], F.lit(0)).alias("source")))

    def registered(self, root: str | None = None) -> KnowledgeBase:
        """The base with a registry for what is derived from it: a graph is then stored once for each state of the corpus
        and used again while the stamp of blocks, links and documents is the same."""
        return replace(self, registry=Registry(self.spark, root or f"{shared_folder(self.spark)}/registry-{uuid.uuid4().hex}"))

    def stamp(self) -> str:
        """The stamp of everything that the graph's shape and weights follow from."""
        documents = self.documents.select("path", "layer", F.to_json("fm").alias("fm"))
        return stamp_of(blocks=(self.blocks, ("id", "doc_path", "section_id", "layer", "raw", "hash")), links=(self.links, ("src", "dst", "kind", "weight")), documents=(documents, ("path", "layer", "fm")))

    def _confidence(self) -> DataFrame:
        return self.documents.select(F.col("path").alias("doc_path"), F.get(F.col("fm")["confidence"], F.lit(0)).alias("confidence"))

    def visible(self, groups: list[str] | None = None) -> DataFrame:
        """path of the documents that the groups may see; derived pages as their sources."""
        return route.visible_paths(self.documents, self.acls, groups)

    def edges(self) -> DataFrame:
        return graph.weighted_edges(self.links, self.blocks, self._confidence())

    def graph(self) -> tuple[DataFrame, DataFrame | None]:
        """Weighted links and weighted cliques; from the registry where there is one."""
        parts = {"edges": self.edges, "members": lambda: graph.weighted_members(self.members, self.blocks, self._confidence())}
        if self.members is None:
            del parts["members"]
        if self.registry is None:
            made = {k: f() for k, f in parts.items()}
        else:
            stamp = self.stamp()
            made = {k: self.registry.derived(k, stamp, f)[0] for k, f in parts.items()}
        return made["edges"], made.get("members")

    def channel(self, name: str, query: str, limit: int, vector: list[float] | None = None) -> DataFrame:
        """id, rank of one channel: lexical, graph (lexical re-scored by rank), tree, full, vector."""
        if name == "tree":
            return retrieval.tree_search(self.sections, self.blocks, query)
        if name == "full":
            return retrieval.ranked(retrieval.full_corpus(self.blocks).withColumn("score", F.lit(0)).orderBy("doc_path", "ordinal").limit(limit * 20)).select("id", "rank")
        if name == "vector":
            q = self.spark.createDataFrame([(vector or [],)], "vector array<double>")
            return retrieval.knn(self.vectors.join(self.blocks.select("id"), "id", "left_semi"), q, limit).select("id", "rank")
        found = stored(self.index.search(query, 3 * limit) if self.index else lexical.bm25(self.blocks, query, 3 * limit))
        if name == "lexical":
            return found.select("id", "rank")
        seeds = found.filter(F.col("rank") < S.SEEDS).select(F.lit(0).alias("query"), "id")
        edges, members = self.graph()
        return retrieval.hybrid(found, graph.personalized_pagerank(edges, seeds, members=members).select("id", "pr"), 3 * limit).select("id", "rank")

    def search(self, query: str, top: int = 8, groups: list[str] | None = None, channel: str | None = None, layer: str | None = None, include_states: tuple[str, ...] = (), filters: dict[str, list[str]] | None = None, vector: list[float] | None = None, weights: dict[str, float] | None = None) -> DataFrame:
        """rank, id, doc_path, breadcrumb, raw, layer, state, score, scores, matched_by: fused channels, then access, state and
        disposition, metadata filters, the window, source rows first, the layer."""
        names = [channel] if channel else ["graph", "tree"] + (["vector"] if vector else [])
        weights = {"graph": S.CHANNEL_WEIGHTS["lexical"], "lexical": S.CHANNEL_WEIGHTS["lexical"], "full": 1.0} | S.CHANNEL_WEIGHTS | (weights or {})
        lists = {n: stored(self.channel(n, query, top, vector)) for n in names}
        return route.route(lists, weights, self.blocks, self.acls, self.states, self.pages, self.documents, top, groups, include_states, filters, layer)

    def ask(self, question: str, top: int = 8, groups: list[str] | None = None, generate: Callable[[str, str], str] | None = None) -> DataFrame:
        """answer, n_evidence, verdict, cited, total, violations.  Without evidence a wider window of the corpus is tried.
        `generate` (question, context) may write the answer from the assembled context; it is checked like any other."""
        rows = self.search(question, top, groups)
        wide = governance.filter_chain(retrieval.ranked(self.blocks.join(self.channel("full", question, top), "id").withColumn("score", -F.col("rank")).drop("rank")), self.acls, self.states, self.pages, groups)
        more = answer.escalate(wide, question).filter(F.col("rank") < 5 * top)
        kept = ["rank", "id", "doc_path", "breadcrumb", "raw"]
        rows = stored(rows.select(kept))
        has = rows.agg(F.count("*").alias("n_"))
        rows = rows.unionByName(more.select(kept).crossJoin(F.broadcast(has)).filter("n_ = 0").drop("n_"))
        verdict = answer.grade_terms(rows, question)
        if generate is None:
            said = answer.extractive_answer(rows, self.pages.filter("stale").select("doc_path"))
        else:
            context = "\n\n".join(r.piece for r in answer.assemble(rows).orderBy("rank").collect())  # bounded by the budget
            said = rows.agg(F.count("*").alias("n_evidence")).select(F.lit(generate(question, context)).alias("answer"), "n_evidence")
        return answer.check_contracts(said.crossJoin(F.broadcast(verdict)))

    # ---- maintenance

    def retracted(self, ids: list[str]) -> KnowledgeBase:
        """The base with blocks retracted and the derived pages that cite them stale."""
        gone = self.blocks.filter(F.col("id").isin(ids)).select("id")
        states = self.states.join(gone, "id", "left_anti").unionByName(gone.select("id", F.lit("retracted").alias("state")))
        cited = self.blocks.filter("layer <> 'raw'").select(F.col("doc_path").alias("page"), F.col("raw").alias("text"))
        stale = lifecycle.retract(gone, cited).select(F.col("page").alias("doc_path"))
        pages = self.pages.join(stale, "doc_path", "left_anti").unionByName(self.pages.join(stale, "doc_path", "full").filter("stale or stale is null").select("doc_path", F.coalesce("state", F.lit("active")).alias("state"), F.lit(True).alias("stale")).join(stale, "doc_path", "left_semi"))
        return replace(self, states=states, pages=pages)

    def changes(self, before: KnowledgeBase) -> DataFrame:
        return lifecycle.diff_docs(lifecycle.fingerprints(before.blocks), lifecycle.fingerprints(self.blocks))

    def entities(self) -> DataFrame:
        return compile.entities(compile.mentions(self.blocks.filter("layer = 'raw'")))

    def derived_pages(self) -> DataFrame:
        """path, content of source and entity pages, made from the raw layer only."""
        raw = self.blocks.filter("layer = 'raw'")
        return compile.source_pages(raw).select("path", "content").unionByName(compile.entity_pages(compile.mentions(raw)))

    def lint(self, today) -> DataFrame:
        """kind, subject of all findings."""
        fm = lambda k: F.get(F.col("fm")[k], F.lit(0))
        docs = self.documents.select("path", fm("ttl").alias("ttl"), fm("valid_from").alias("valid_from"))
        by = self.blocks.select("id", "doc_path")
        noted = self.blocks.filter(F.col("breadcrumb").rlike("(^| > )Conflicts$") & (F.col("layer") != "raw")).select(F.col("doc_path").alias("page"), F.concat(F.lit("## Conflicts\n"), "raw").alias("text"))
        pages = self.links.filter("kind = 'wikilink'").join(by.select(F.col("id").alias("src"), F.col("doc_path").alias("src_page")), "src").join(by.select(F.col("id").alias("dst"), F.col("doc_path").alias("dst_page")), "dst")
        return quality.findings(
            broken_link=self.links.filter("kind = 'wikilink-unresolved'").select("dst"),
            unsourced=quality.unsourced(self.blocks),
            expired=quality.expired(docs, today),
            stale=self.pages.filter("stale").select("doc_path"),
            conflict=quality.open_conflicts(noted).select("page"),
            orphan=quality.orphans(self.documents.filter("layer <> 'raw'").select(F.col("path").alias("page")), pages),
        )

    def claim(self, claim: str, ids: list[str]) -> DataFrame:
        """id, verdict of a claim against blocks by their numerals."""
        return self.blocks.filter(F.col("id").isin(ids)).select("id", X.judge(F.lit(claim), "raw").alias("verdict"))
