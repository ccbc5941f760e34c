"""Queries: governance, graph, answers, lifecycle, derived pages, quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.functions import text as X
from tessera.operators import answer, chains, compile, governance, graph, lifecycle, quality, retrieval
from tessera.plans.base import BLOCKS, ORACLES, TURNS, blocks, bm25_sql, hash_sql, query, read, text_index, turns
from tessera.plans.search import KNN, SECTIONS, _sections, knn_topk
from tessera.session import stored

ASK = "heat that edthe onthe the"
HITS = f"WITH {BLOCKS}, {bm25_sql(ASK, 200, ('or',))}, ev AS (SELECT h.rank, h.id, b.doc_id, b.doc_path, b.breadcrumb, b.raw, b.layer FROM hits h JOIN blocks b USING (id))"
TABLES = """acls AS (SELECT doc_id, source || '/' || doc_id AS path, CASE WHEN source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5') THEN [lang] END AS acl FROM documents),
states AS (SELECT b.id, CASE WHEN l.toxic = 1 THEN 'retracted' WHEN l.quality = 0 THEN 'superseded' ELSE 'active' END AS state FROM blocks b JOIN labels l USING (doc_id)),
pages_ AS (SELECT source || '/' || doc_id AS doc_path, CASE WHEN doc_id % 11 = 0 THEN 'retracted' ELSE 'active' END AS state, doc_id % 7 = 0 AS stale FROM documents)"""


def _evidence(spark, sf, limit=200):
    b = blocks(spark, sf)
    hits = text_index(spark, sf).search(ASK, limit, ("or",)).select("id", "rank")
    return b, b.join(F.broadcast(hits), "id")


def _path():
    return F.concat_ws("/", "source", F.col("doc_id").cast("string"))


def _acls(spark, sf):
    return read(spark, sf, "documents").select(_path().alias("path"), F.when(F.col("source").isin(*(f"src{i}" for i in range(6))), F.array("lang")).alias("acl"))


def _states(spark, sf, b):
    lab = read(spark, sf, "labels")
    state = F.when(F.col("toxic") == 1, "retracted").when(F.col("quality") == 0, "superseded").otherwise("active")
    return b.select("id", "doc_id").join(lab, "doc_id").select("id", state.alias("state"))


def _pages(spark, sf):
    return read(spark, sf, "documents").select(_path().alias("doc_path"), F.when(F.col("doc_id") % 11 == 0, "retracted").otherwise("active").alias("state"), (F.col("doc_id") % 7 == 0).alias("stale"))


@query(f"{HITS}, {TABLES} SELECT rank, id FROM ev LEFT JOIN acls ON doc_path = path WHERE acl IS NULL OR list_has_any(acl, ['de', 'fr'])")
def acl_filter(spark, sf):
    return governance.acl_filter(_evidence(spark, sf)[1], _acls(spark, sf), ["de", "fr"]).select("rank", "id")


@query(f"{HITS}, {TABLES} SELECT rank, id FROM ev LEFT JOIN acls ON doc_path = path WHERE acl IS NULL")
def acl_anonymous(spark, sf):
    return governance.acl_filter(_evidence(spark, sf)[1], _acls(spark, sf), None).select("rank", "id")


@query("""WITH d AS (SELECT source || '/' || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN [lang] END AS acl, NULL AS src FROM documents
UNION ALL SELECT 'sources/' || source || '/' || doc_id, NULL, 'raw/' || source || '/' || doc_id FROM documents)
SELECT d.path, coalesce(array_to_string(CASE WHEN d.src IS NULL THEN d.acl ELSE o.acl END, ','), '') AS acl FROM d LEFT JOIN d o ON o.path = regexp_replace(d.src, '^raw/', '')""")
def acl_inherit(spark, sf):
    d = read(spark, sf, "documents")
    own = d.select(_path().alias("path"), F.when(F.col("doc_id") % 3 == 0, F.array("lang")).alias("acl"), F.lit(None).cast("string").alias("source"))
    derived = d.select(F.concat(F.lit("sources/"), _path()).alias("path"), F.lit(None).cast("array<string>").alias("acl"), F.concat(F.lit("raw/"), _path()).alias("source"))
    return governance.inherited_acl(own.unionByName(derived)).select("path", F.coalesce(F.array_join("acl", ","), F.lit("")).alias("acl"))


@query(f"{HITS}, {TABLES} SELECT e.rank, e.id, coalesce(s.state, 'active') AS state FROM ev e LEFT JOIN states s USING (id) WHERE coalesce(s.state, 'active') NOT IN ('superseded', 'retracted')")
def state_filter(spark, sf):
    b, ev = _evidence(spark, sf)
    return governance.state_filter(ev, _states(spark, sf, b)).select("rank", "id", "state")


@query(f"{HITS}, {TABLES} SELECT e.rank, e.id, coalesce(s.state, 'active') AS state FROM ev e LEFT JOIN states s USING (id) WHERE coalesce(s.state, 'active') <> 'retracted'")
def state_include_history(spark, sf):
    b, ev = _evidence(spark, sf)
    return governance.state_filter(ev, _states(spark, sf, b), ("superseded",)).select("rank", "id", "state")


@query(f"{HITS}, {TABLES}, x AS (SELECT e.id, e.rank AS r0, CASE WHEN p.state = 'retracted' THEN 2 WHEN p.stale THEN 1 ELSE 0 END AS band FROM ev e LEFT JOIN pages_ p USING (doc_path)) SELECT id, band::BIGINT AS band, row_number() OVER (ORDER BY band, r0, id) - 1 AS rank FROM x WHERE band < 2")
def disposition_bands(spark, sf):
    return governance.disposition_bands(_evidence(spark, sf)[1], _pages(spark, sf)).select("id", "band", "rank")


@query(f"{HITS} SELECT rank, id FROM ev WHERE layer = 'raw'")
def layer_filter(spark, sf):
    return governance.layer_filter(_evidence(spark, sf)[1], "raw").select("rank", "id")


@query(f"{HITS} SELECT e.rank, e.id FROM ev e JOIN documents d USING (doc_id) WHERE d.lang IN ('en', 'de') AND d.source IN ('src1', 'src2', 'src3', 'src7')")
def metadata_filter(spark, sf):
    d = read(spark, sf, "documents").select(_path().alias("path"), F.create_map(F.lit("lang"), F.array("lang"), F.lit("source"), F.array("source")).alias("fm"))
    return governance.metadata_filter(_evidence(spark, sf)[1], d, {"lang": ["en", "de"], "source": ["src1", "src2", "src3", "src7"]}).select("rank", "id")


CHAIN = f"""{HITS}, {TABLES}, c1 AS (SELECT e.* FROM ev e LEFT JOIN acls ON doc_path = path WHERE acl IS NULL OR list_has_any(acl, ['en'])),
c2 AS (SELECT c1.*, coalesce(s.state, 'active') AS state FROM c1 LEFT JOIN states s USING (id) WHERE coalesce(s.state, 'active') NOT IN ('superseded', 'retracted')),
c3 AS (SELECT c2.id, c2.doc_path, c2.breadcrumb, c2.raw, c2.state, c2.rank AS r0, CASE WHEN p.state = 'retracted' THEN 2 WHEN p.stale THEN 1 ELSE 0 END AS band FROM c2 LEFT JOIN pages_ p USING (doc_path)),
chain AS (SELECT id, doc_path, breadcrumb, raw, state, band::BIGINT AS band, row_number() OVER (ORDER BY band, r0, id) - 1 AS rank FROM c3 WHERE band < 2)"""


def _chain(spark, sf):
    b, ev = _evidence(spark, sf)
    return governance.filter_chain(ev, _acls(spark, sf), _states(spark, sf, b), _pages(spark, sf), ["en"])


@query(f"{CHAIN} SELECT id, state, band, rank FROM chain")
def filter_chain(spark, sf):
    return _chain(spark, sf).select("id", "state", "band", "rank")


@query("""SELECT doc_id, CASE WHEN toxic = 1 THEN 'hard_filter' WHEN quality = 0 THEN 'filtered_unless_explicit_history' WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'refuse_or_recompile' WHEN doc_id % 3 = 0 THEN 'downrank_and_async_recompile' ELSE 'use' END AS disposition FROM labels""")
def disposition_rule(spark, sf):
    state = F.when(F.col("toxic") == 1, "retracted").when(F.col("quality") == 0, "superseded").otherwise("active")
    return read(spark, sf, "labels").select("doc_id", X.disposition(state, F.col("doc_id") % 3 == 0, F.col("doc_id") % 2 == 0).alias("disposition"))


# ---- graph


@query(f"WITH {TURNS} SELECT a.id AS src, b.id AS dst, CASE WHEN a.layer = 'raw' THEN 0.2 ELSE 0.0 END::DOUBLE AS weight FROM turns a JOIN turns b USING (doc_path) WHERE a.id <> b.id")
def edges_same_doc(spark, sf):
    return graph.structural_edges(turns(spark, sf), "doc_path", "same-doc").select("src", "dst", "weight")


@query(f"WITH {TURNS} SELECT a.id AS src, b.id AS dst, CASE WHEN a.layer = 'raw' THEN 0.5 ELSE 0.0 END::DOUBLE AS weight FROM turns a JOIN turns b USING (section_id) WHERE a.id <> b.id")
def edges_same_section(spark, sf):
    return graph.structural_edges(turns(spark, sf), "section_id", "same-section").select("src", "dst", "weight")


# links are derived: a document links to the next one by path, to a title, to a section and to nothing
LINKED = """d AS (SELECT doc_id, 'p/' || doc_id || '.md' AS path, 'title ' || doc_id AS title, 'sec ' || doc_id AS section FROM documents),
lb AS (SELECT path || '#' || section || '/0' AS id, path AS doc_path, path || '#' || section AS section_id, 'raw' AS layer, doc_id,
  'see ' || CASE doc_id % 5 WHEN 0 THEN '[[p/' || (doc_id + 1) || '.md]]' WHEN 1 THEN '[[p/' || (doc_id + 1) || ']]' WHEN 2 THEN '[[title ' || (doc_id + 1) || '|x]]' WHEN 3 THEN '[[sec ' || (doc_id + 1) || ']]' ELSE '[[none ' || doc_id || '#y]]' END AS raw FROM d)"""


def _linked(spark, sf):
    i = F.col("doc_id").cast("string")
    nxt = (F.col("doc_id") + 1).cast("string")
    link = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("[[p/"), nxt, F.lit(".md]]"))).when(F.col("doc_id") % 5 == 1, F.concat(F.lit("[[p/"), nxt, F.lit("]]"))).when(F.col("doc_id") % 5 == 2, F.concat(F.lit("[[title "), nxt, F.lit("|x]]"))).when(F.col("doc_id") % 5 == 3, F.concat(F.lit("[[sec "), nxt, F.lit("]]"))).otherwise(F.concat(F.lit("[[none "), i, F.lit("#y]]")))
    d = read(spark, sf, "documents").select("doc_id", F.concat(F.lit("p/"), i, F.lit(".md")).alias("path"), F.concat(F.lit("title "), i).alias("title"), F.concat(F.lit("sec "), i).alias("section"), F.concat(F.lit("see "), link).alias("raw"))
    sid = F.concat("path", F.lit("#"), "section")
    b = d.select(F.concat(sid, F.lit("/0")).alias("id"), F.col("path").alias("doc_path"), sid.alias("section_id"), F.lit("raw").alias("layer"), "doc_id", "raw")
    sections = d.select(sid.alias("id"), F.col("path").alias("doc_path"), F.col("section").alias("title"))
    return b, d.select("path", "title"), sections


@query(f"""WITH {LINKED}, l AS (SELECT id AS src, doc_id, trim(regexp_extract(raw, '\\[\\[([^\\]|#]+)', 1)) AS t FROM lb),
r AS (SELECT src, coalesce(a.id, b.id, c.id, e.id) AS dst, t FROM l LEFT JOIN lb a ON a.doc_path = t LEFT JOIN lb b ON b.doc_path = t || '.md' LEFT JOIN lb c ON 'title ' || c.doc_id = t LEFT JOIN lb e ON 'sec ' || e.doc_id = t)
SELECT src, coalesce(dst, t) AS dst, CASE WHEN dst IS NULL THEN 'wikilink-unresolved' ELSE 'wikilink' END AS kind, CASE WHEN dst IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS weight FROM r""")
def wikilink_resolve(spark, sf):
    return graph.resolve_links(*_linked(spark, sf))


@query(f"""WITH {TURNS}, e AS (SELECT id AS src, lead(id) OVER (PARTITION BY doc_path ORDER BY ordinal) AS dst, doc_path, layer FROM turns)
SELECT src, dst, CASE WHEN layer = 'raw' THEN 1.0 WHEN substr(doc_path, 6)::BIGINT % 8 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS w FROM e WHERE dst IS NOT NULL""")
def edge_confidence(spark, sf):
    t = turns(spark, sf)
    e = t.select(F.col("id").alias("src"), F.lead("id").over(Window.partitionBy("doc_path").orderBy("ordinal")).alias("dst")).filter("dst is not null").withColumn("weight", F.lit(1.0))
    conf = t.select("doc_path").distinct().filter(F.substring("doc_path", 6, 20).cast("bigint") % 8 == 0).withColumn("confidence", F.lit("medium"))
    return graph.weighted_edges(e, t, conf)


PAGE_EDGES = """l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages),
e0 AS (SELECT page_id AS src, lead(page_id) OVER (PARTITION BY target ORDER BY page_id) AS dst FROM l),
edges AS (SELECT src, dst, count(*)::DOUBLE AS w FROM e0 WHERE dst IS NOT NULL GROUP BY src, dst)"""


def _page_edges(spark, sf):
    """Pages that share a link target, each with the next: extracted links, chains over ranges of (target, page), so a
    target that all pages link to is spread over tasks like any other."""
    rows = read(spark, sf, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).alias("target"))
    step = chains.successors(rows, "target", "page_id").withColumnRenamed("next", "dst").filter("dst is not null")
    return step.groupBy(F.col("page_id").alias("src"), "dst").agg(F.count("*").cast("double").alias("w"))


@query(f"WITH {PAGE_EDGES} SELECT src, dst, w FROM edges")
def page_links(spark, sf):
    return _page_edges(spark, sf)


@query(f"""WITH RECURSIVE {PAGE_EDGES}, seeds AS (SELECT page_id AS query, page_id AS id FROM pages WHERE page_id % 20 = 0),
n1 AS (SELECT * FROM seeds UNION SELECT s.query, e.dst FROM seeds s JOIN edges e ON e.src = s.id),
nodes AS (SELECT * FROM n1 UNION SELECT s.query, e.dst FROM n1 s JOIN edges e ON e.src = s.id),
o AS (SELECT src, sum(w) AS out FROM edges GROUP BY src),
trans AS (
  SELECT n.query, n.id AS src, e.dst, e.w / o.out AS f FROM nodes n JOIN edges e ON e.src = n.id JOIN o ON o.src = n.id JOIN nodes m ON m.query = n.query AND m.id = e.dst
  UNION ALL SELECT n.query, n.id, s.id, 1.0 FROM nodes n JOIN seeds s USING (query) LEFT JOIN o ON o.src = n.id WHERE o.out IS NULL
  UNION ALL SELECT query, id, id, 0.0 FROM nodes),
pr AS (SELECT 0 AS r, query, id, 1.0::DOUBLE / count(*) OVER (PARTITION BY query) AS pr FROM nodes
  UNION ALL SELECT pr.r + 1, t.query, t.dst, 0.15 * (CASE WHEN t.query = t.dst THEN 1 ELSE 0 END) + 0.85 * sum(pr.pr * t.f) FROM pr JOIN trans t ON t.query = pr.query AND t.src = pr.id WHERE pr.r < 20 GROUP BY pr.r, t.query, t.dst)
SELECT query, id, round(pr, 6) AS pr FROM pr WHERE r = 20""")
def ppr_20(spark, sf):
    seeds = read(spark, sf, "pages").filter("page_id % 20 = 0").select(F.col("page_id").alias("query"), F.col("page_id").alias("id"))
    return graph.personalized_pagerank(_page_edges(spark, sf), seeds, 20, None).select("query", "id", F.round("pr", 6).alias("pr"))


@query(f"""WITH RECURSIVE {BLOCKS}, {bm25_sql(ASK, 60, ('or',), name='lex')}, pairs AS (SELECT a.id AS src, b.id AS dst FROM blocks a JOIN blocks b ON a.doc_path = b.doc_path AND b.ordinal = a.ordinal + 1),
inl AS (SELECT src, dst FROM pairs),
nodes AS (SELECT id FROM lex WHERE rank < 50 UNION SELECT dst FROM pairs JOIN lex ON src = id WHERE rank < 50 UNION SELECT q.dst FROM pairs p JOIN lex ON p.src = id JOIN pairs q ON q.src = p.dst WHERE rank < 50),
p AS (SELECT n.id, CASE WHEN l.id IS NOT NULL AND l.rank < 50 THEN 1.0 / (SELECT least(50, count(*)) FROM lex) ELSE 0 END::DOUBLE AS p, EXISTS (SELECT 1 FROM pairs WHERE src = n.id) AS busy FROM nodes n LEFT JOIN lex l USING (id)),
trans AS (SELECT src, dst, 1.0::DOUBLE AS f FROM pairs JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst
  UNION ALL SELECT a.id, b.id, b.p FROM p a, p b WHERE NOT a.busy AND b.p > 0 UNION ALL SELECT id, id, 0 FROM p),
pr AS (SELECT 0 AS r, id, 1.0::DOUBLE / (SELECT count(*) FROM p) AS pr FROM p
  UNION ALL SELECT pr.r + 1, t.dst, 0.15 * any_value(p.p) + 0.85 * sum(pr.pr * t.f) FROM pr JOIN trans t ON t.src = pr.id JOIN p ON p.id = t.dst WHERE pr.r < 20 GROUP BY pr.r, t.dst),
base AS (SELECT id, round(1.0::DOUBLE / (61 + rank), 9) AS s FROM lex)
SELECT id, round(s + 1.2 * coalesce(pr, 0), 6) AS score FROM base LEFT JOIN (SELECT id, pr FROM pr WHERE r = 20) USING (id)""")
def hybrid_ppr(spark, sf):
    """Lexical hits re-scored by the rank of a reading-order graph around the first fifty."""
    b = blocks(spark, sf)
    lex = stored(text_index(spark, sf).search(ASK, 60, ("or",)))
    nxt = b.select("doc_path", (F.col("ordinal") - 1).alias("ordinal"), F.col("id").alias("dst"))
    edges = b.select("doc_path", "ordinal", F.col("id").alias("src")).join(nxt, ["doc_path", "ordinal"]).select("src", "dst", F.lit(1.0).alias("w"))
    seeds = lex.filter(F.col("rank") < S.SEEDS).select(F.lit(0).alias("query"), "id")
    pr = graph.personalized_pagerank(edges, seeds, 20, None).select("id", "pr")
    return retrieval.hybrid(lex, pr, 60).select("id", "score")


# ---- answers


@query(f"{CHAIN} SELECT CASE WHEN count(*) = 0 THEN 'evidence_absent' WHEN regexp_matches(substr(lower(string_agg(raw, chr(10) ORDER BY rank)), 1, 2000), 'heat|that|edthe|onthe|the') THEN 'enough' ELSE 'missing' END AS verdict FROM chain")
def grade_terms(spark, sf):
    return answer.grade_terms(_chain(spark, sf), ASK)


@query(f"{CHAIN} SELECT CASE WHEN count(*) = 0 THEN 'evidence_absent' WHEN bool_or(contains(lower(raw), 'zzqq')) OR bool_or(contains(lower(raw), 'qqzz')) THEN 'enough' ELSE 'missing' END AS verdict FROM chain")
def grade_chars(spark, sf):
    return answer.grade_chars(_chain(spark, sf), "zzqq qqzz")


@query(f"""{CHAIN}, p AS (SELECT rank, '[' || id || '] ' || breadcrumb || chr(10) || raw AS piece FROM chain), r AS (SELECT *, sum(length(piece)) OVER (ORDER BY rank) AS e FROM p), o AS (SELECT *, 6000 - (e - length(piece)) AS l, sum((e > 6000)::INT) OVER (ORDER BY rank) AS over_ FROM r)
SELECT rank, CASE WHEN over_ = 0 THEN piece ELSE substr(piece, 1, l::BIGINT) END AS piece FROM o WHERE over_ = 0 OR (over_ = 1 AND l > 120)""")
def assemble_budget(spark, sf):
    return answer.assemble(_chain(spark, sf))


@query(f"{CHAIN} SELECT coalesce(string_agg(substr(replace(raw, chr(10), ' '), 1, 180) || ' [[' || id || ']]' || CASE WHEN band = 1 THEN ' (stale)' ELSE '' END, chr(10) ORDER BY rank), '{S.REFUSAL}') AS answer, count(*) AS n_evidence FROM chain WHERE rank < 3")
def extractive_answer(spark, sf):
    stale = _pages(spark, sf).filter("stale").select("doc_path")
    return answer.extractive_answer(_chain(spark, sf), stale)


ANSWERS = "a AS (SELECT conv_id || '/' || turn AS id, replace(coalesce(text, ''), '.', '!') || CASE WHEN turn % 3 = 0 THEN ' x (d#' || turn || ')' ELSE '' END AS answer, (turn % 2)::BIGINT AS n_evidence FROM conversations), s AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(answer, '([。！？；!?;])\\s*', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS s FROM a), c AS (SELECT id, answer, n_evidence, len(s) AS total, len(list_filter(s, lambda x: regexp_matches(x, '\\[\\[[^\\]]+\\]\\]|[(（][^()（）]*#[^()（）]*[)）]'))) AS cited FROM s)"


def _answers(spark, sf):
    c = read(spark, sf, "conversations")
    text = F.concat(F.replace(F.coalesce("text", F.lit("")), F.lit("."), F.lit("!")), F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" x (d#"), F.col("turn").cast("string"), F.lit(")"))).otherwise(F.lit("")))
    return c.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), text.alias("answer"), (F.col("turn") % 2).alias("n_evidence"))


@query(f"WITH {ANSWERS} SELECT id, cited, total FROM c")
def citation_coverage(spark, sf):
    return answer.citation_coverage(_answers(spark, sf)).select("id", "cited", "total")


@query(f"WITH {ANSWERS} SELECT id, concat_ws('; ', CASE WHEN cited < total THEN 'citation ' || cited || '/' || total || ' sentences cited' END, CASE WHEN n_evidence = 0 AND NOT contains(answer, '{S.REFUSAL}') THEN 'refusal' END) AS violations FROM c")
def contract_check(spark, sf):
    return answer.check_contracts(_answers(spark, sf)).select("id", F.array_join("violations", "; ").alias("violations"))


@query(f"{CHAIN} SELECT rank, id FROM chain WHERE contains(lower(raw), 'edthe') OR contains(lower(raw), 'onthe')")
def escalation(spark, sf):
    return answer.escalate(_chain(spark, sf), "edthe onthe").select("rank", "id")


# ---- lifecycle


FPS = f"{BLOCKS}, before_ AS (SELECT doc_path AS doc, sha256(string_agg({hash_sql('raw')}, '|' ORDER BY ordinal)) AS fp FROM blocks WHERE doc_id % 13 <> 1 GROUP BY 1), after_ AS (SELECT doc_path AS doc, sha256(string_agg({hash_sql('''(CASE WHEN doc_id % 6 = 0 THEN raw || 'x' ELSE raw END)''')}, '|' ORDER BY ordinal)) AS fp FROM blocks WHERE doc_id % 17 <> 2 GROUP BY 1), diff AS (SELECT coalesce(b.doc, a.doc) AS doc, CASE WHEN b.doc IS NULL THEN 'added' WHEN a.doc IS NULL THEN 'deleted' WHEN a.fp <> b.fp THEN 'changed' END AS change FROM before_ b FULL JOIN after_ a ON a.doc = b.doc)"


def _diff(spark, sf):
    b = blocks(spark, sf)
    new = b.filter("doc_id % 17 <> 2").withColumn("raw", F.when(F.col("doc_id") % 6 == 0, F.concat("raw", F.lit("x"))).otherwise(F.col("raw")))
    return lifecycle.diff_docs(lifecycle.fingerprints(b.filter("doc_id % 13 <> 1")), lifecycle.fingerprints(new))


@query(f"WITH {FPS} SELECT doc, change FROM diff WHERE change IS NOT NULL")
def changed_docs(spark, sf):
    return _diff(spark, sf)


@query(f"WITH {FPS} SELECT count(*) AS kept FROM blocks WHERE doc_path NOT IN (SELECT doc FROM diff WHERE change = 'deleted')")
def deleted_docs(spark, sf):
    return lifecycle.purge(blocks(spark, sf), _diff(spark, sf).filter("change = 'deleted'")).agg(F.count("*").alias("kept"))


@query(f"WITH {FPS}, ps AS (SELECT 'synthesis/' || (doc_id % 50) AS page, source || '/' || doc_id AS doc FROM documents) SELECT DISTINCT page FROM ps JOIN diff USING (doc) WHERE change IN ('changed', 'deleted')")
def stale_synthesis(spark, sf):
    ps = read(spark, sf, "documents").select(F.concat(F.lit("synthesis/"), (F.col("doc_id") % 50).cast("string")).alias("page"), _path().alias("doc"))
    return lifecycle.stale_pages(_diff(spark, sf), ps)


CITING = f"{BLOCKS}, citing AS (SELECT 'page/' || (doc_id % 97) AS page, 'as [[' || id || ']] says' AS text, id, doc_id FROM blocks)"


@query(f"WITH {CITING} SELECT DISTINCT page, true AS stale FROM citing JOIN labels USING (doc_id) WHERE toxic = 1")
def retract_cascade(spark, sf):
    b = blocks(spark, sf)
    pages = b.select(F.concat(F.lit("page/"), (F.col("doc_id") % 97).cast("string")).alias("page"), F.concat(F.lit("as [["), "id", F.lit("]] says")).alias("text"))
    gone = b.join(read(spark, sf, "labels").filter("toxic = 1").select("doc_id"), "doc_id").select("id")
    return lifecycle.retract(gone, pages)


@query(f"WITH {BLOCKS} SELECT id, 'retracted' AS state FROM blocks WHERE doc_id % 10 = 3 AND ordinal % 2 = 0")
def ledger_replay(spark, sf):
    b = blocks(spark, sf).withColumn("hash", X.content_hash("raw"))
    ledger = b.filter("doc_id % 10 = 3").select("id", F.when(F.col("ordinal") % 2 == 0, F.col("hash")).otherwise(F.lit("0")).alias("content_hash"), F.lit("retracted").alias("state"))
    return lifecycle.replay_ledger(ledger, b)


@query("""WITH v AS (SELECT vec_id AS id, label FROM embeddings) SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NULL THEN 'drop' ELSE 'encode' END AS action
FROM (SELECT id, label FROM v WHERE id % 9 <> 0) n FULL JOIN (SELECT id, CASE WHEN id % 4 = 0 THEN -1 ELSE label END AS label FROM v WHERE id % 5 <> 0) o ON n.id = o.id WHERE n.id IS NULL OR o.id IS NULL OR n.label <> o.label""")
def vector_delta(spark, sf):
    v = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("hash"))
    old = v.filter("id % 5 <> 0").withColumn("hash", F.when(F.col("id") % 4 == 0, F.lit(-1)).otherwise(F.col("hash")))
    return lifecycle.vector_delta(v.filter("id % 9 <> 0"), old)


@query("SELECT count(embedding) AS encoded, count(*) FILTER (embedding IS NULL) AS pending, max(len(embedding)) AS dims FROM embeddings")
def vector_status(spark, sf):
    return read(spark, sf, "embeddings").agg(F.count("embedding").alias("encoded"), F.count_if(F.col("embedding").isNull()).alias("pending"), F.max(F.size("embedding")).alias("dims"))


# ---- derived pages and quality

EDGE, TAIL = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
# SQL's expressions don't look ahead: every separator is written twice, so neighbours don't share one
NAMES = rf"""{BLOCKS}, up AS (SELECT id, doc_path, ordinal, regexp_replace(CASE WHEN ordinal % 4 = 0 THEN upper(translate(raw, '{X.FOLD_FROM}ß', '{X.FOLD_TO}s')) ELSE raw END, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g') AS raw FROM blocks),
m AS (SELECT id, doc_path, ordinal, replace(unnest(list_concat(regexp_extract_all(raw, '{EDGE}([A-Z]{{2,}}){TAIL}', 1), regexp_extract_all(raw, '{EDGE}([A-Z][a-z]+(?:  [A-Z][a-z]+)+){TAIL}', 1))), '  ', ' ') AS name FROM up),
mm AS (SELECT *, lower(regexp_replace(name, '[^\p{{L}}\p{{N}}]', '-', 'g')) AS entity_id FROM m)"""


def _mentions(spark, sf):
    up = F.when(F.col("ordinal") % 4 == 0, F.upper(F.translate("raw", X.FOLD_FROM + "ß", X.FOLD_TO + "s"))).otherwise(F.col("raw"))
    return compile.mentions(blocks(spark, sf).withColumn("raw", up), (compile.CAPITALS, compile.RUNS))


@query(f"WITH {NAMES} SELECT entity_id, count(*) AS n_facts, count(DISTINCT doc_path) AS n_docs FROM mm GROUP BY entity_id")
def entity_extract(spark, sf):
    return _mentions(spark, sf).groupBy("entity_id").agg(F.count("*").alias("n_facts"), F.countDistinct("doc_path").alias("n_docs"))


@query(f"WITH {NAMES}, f AS (SELECT entity_id, arg_min(name, (doc_path, ordinal, name)) AS name, count(*) AS n_facts, count(DISTINCT name) - 1 AS n_aliases FROM mm GROUP BY entity_id) SELECT * FROM f")
def entity_merge(spark, sf):
    return compile.entities(_mentions(spark, sf)).select("entity_id", "name", "n_facts", F.size("aliases").alias("n_aliases"))


@query(rf"""WITH {SECTIONS}, have AS (SELECT DISTINCT unnest(regexp_extract_all(lower(raw), '[\p{{L}}\p{{N}}]{{3,}}')) AS term FROM blocks),
c AS (SELECT DISTINCT id AS concept, unnest(regexp_extract_all(lower(summary), '[\p{{L}}\p{{N}}]{{3,}}')) AS term FROM sections)
SELECT concept, count(*) AS hits FROM c JOIN have USING (term) GROUP BY concept ORDER BY hits DESC, concept LIMIT 10""")
def affected_concepts(spark, sf):
    b = blocks(spark, sf)
    return compile.affected_concepts(b, _sections(b).select(F.col("id").alias("concept"), "summary"))


@query(f"WITH {BLOCKS} SELECT 'sources/' || doc_path || '.md' AS path, count(*) AS n_blocks FROM blocks GROUP BY doc_path")
def source_pages(spark, sf):
    return compile.source_pages(blocks(spark, sf)).select("path", "n_blocks")


@query(rf"""WITH {BLOCKS}, s AS (SELECT doc_path, ordinal, id, unnest(list_filter(list_transform(string_split(regexp_replace(raw, '([。！？；!?;.])\s*', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:2]) AS s, generate_subscripts(list_filter(list_transform(string_split(regexp_replace(raw, '([。！？；!?;.])\s*', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:2], 1) AS p FROM blocks),
d AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_path, substr(s, 1, 40) ORDER BY ordinal, id, p) = 1)
SELECT doc_path, position, bullet FROM (SELECT doc_path, row_number() OVER (PARTITION BY doc_path ORDER BY ordinal, id, p) AS position, s AS bullet FROM d) WHERE position <= 12""")
def brief(spark, sf):
    return compile.brief(blocks(spark, sf))


@query(f"""WITH {BLOCKS}, s AS (SELECT breadcrumb AS parent, substr(arg_min(raw, ordinal), 1, 40) AS title, doc_id AS ordinal FROM blocks GROUP BY breadcrumb, doc_id),
c AS (SELECT parent, ordinal, trim(regexp_replace(title, '[\\[\\](){{}}]', ' ', 'g')) AS t FROM s),
g AS (SELECT parent, min(ordinal) AS seen, array_to_string(list(t ORDER BY ordinal, t)[1:6], ' | ') AS titles FROM c GROUP BY parent ORDER BY seen, parent LIMIT 12)
SELECT parent, titles, row_number() OVER (ORDER BY seen, parent) AS position FROM g""")
def mindmap(spark, sf):
    s = blocks(spark, sf).groupBy(F.col("breadcrumb").alias("parent_id"), F.col("doc_id").alias("ordinal")).agg(F.substring(F.min_by("raw", "ordinal"), 1, 40).alias("title"))
    return compile.mindmap(s).select("parent", F.array_join("titles", " | ").alias("titles"), "position")


@query(f"WITH {BLOCKS}, rec AS (SELECT 'brief/' || (doc_id % 40) AS page, CASE WHEN doc_id % 37 = 5 THEN id || 'gone' ELSE id END AS id FROM blocks) SELECT page, count(*) AS wanted, count(b.id) AS found, count(*) = count(b.id) AS ok FROM rec LEFT JOIN blocks b ON b.id = rec.id GROUP BY page")
def stale_reconcile(spark, sf):
    b = blocks(spark, sf)
    rec = b.select(F.concat(F.lit("brief/"), (F.col("doc_id") % 40).cast("string")).alias("page"), F.when(F.col("doc_id") % 37 == 5, F.concat("id", F.lit("gone"))).otherwise(F.col("id")).alias("id"))
    return compile.rebuildable(rec, b)


@query(f"""WITH {LINKED}, l AS (SELECT id AS src, trim(regexp_extract(raw, '\\[\\[([^\\]|#]+)', 1)) AS target FROM lb),
alive AS (SELECT path AS key FROM d UNION SELECT replace(path, '.md', '') FROM d UNION SELECT title FROM d UNION SELECT section FROM d) SELECT src, target FROM l WHERE target NOT IN (SELECT key FROM alive)""")
def lint_broken_links(spark, sf):
    b, docs, sections = _linked(spark, sf)
    links = b.select(F.col("id").alias("src"), F.explode(X.wikilinks("raw")).alias("target"))
    keys = docs.select(F.explode(F.array("path", F.regexp_replace("path", r"\.md$", ""), "title")).alias("key")).unionByName(sections.select(F.col("title").alias("key")))
    return quality.broken_links(links, keys)


@query(f"WITH {BLOCKS}, x AS (SELECT id, layer, CASE WHEN ordinal % 3 = 0 THEN '- ' || raw WHEN ordinal % 3 = 1 THEN '- ' || raw || ' [[a#b]]' ELSE raw END AS line FROM blocks) SELECT id, line FROM x WHERE layer <> 'raw' AND regexp_matches(trim(line), '^[-*] ') AND NOT regexp_matches(line, '\\[\\[[^\\]]+\\]\\]|[(（][^()（）]*#[^()（）]*[)）]')")
def lint_unsourced(spark, sf):
    line = F.when(F.col("ordinal") % 3 == 0, F.concat(F.lit("- "), "raw")).when(F.col("ordinal") % 3 == 1, F.concat(F.lit("- "), "raw", F.lit(" [[a#b]]"))).otherwise(F.col("raw"))
    return quality.unsourced(blocks(spark, sf).withColumn("raw", line))


@query("SELECT source || '/' || doc_id AS path FROM documents WHERE date_diff('day', DATE '2024-01-01' + (doc_id % 400)::INT, DATE '2025-01-01') > 90 + doc_id % 30")
def lint_expired_ttl(spark, sf):
    d = read(spark, sf, "documents").select(_path().alias("path"), F.concat((90 + F.col("doc_id") % 30).cast("string"), F.lit("d")).alias("ttl"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 400).cast("int")), "yyyy-MM-dd").alias("valid_from"))
    return quality.expired(d, F.lit("2025-01-01").cast("date"))


@query("SELECT source || '/' || doc_id AS doc_path FROM documents WHERE doc_id % 7 = 0")
def lint_stale_pages(spark, sf):
    return _pages(spark, sf).filter("stale").select("doc_path")


@query(f"WITH {BLOCKS} SELECT doc_path AS page, '- ⚠ ' || raw AS line FROM blocks")
def lint_conflicts(spark, sf):
    rows = blocks(spark, sf).select(F.col("doc_path").alias("page"), F.concat(F.lit("# t\n- ⚠ before\n## Conflicts\n- ⚠ "), "raw", F.lit("\n- fine")).alias("text"))
    return quality.open_conflicts(rows)


@query(f"WITH {PAGE_EDGES} SELECT page_id AS page FROM pages WHERE page_id NOT IN (SELECT src FROM edges WHERE w >= 4) AND page_id NOT IN (SELECT dst FROM edges WHERE w >= 4)")
def lint_orphans(spark, sf):
    e = _page_edges(spark, sf).filter("w >= 4").select(F.col("src").alias("src_page"), F.col("dst").alias("dst_page"))
    return quality.orphans(read(spark, sf, "pages").select(F.col("page_id").alias("page")), e)


@query("""SELECT conv_id, turn, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 'unknown' WHEN list_has_any(a, b) THEN 'entailed' ELSE 'contradicted' END AS verdict FROM (
SELECT conv_id, turn, regexp_extract_all(coalesce(text, '') || CASE WHEN turn % 2 = 0 THEN ' ' || conv_id ELSE '' END, '[0-9]+(?:\\.[0-9]+)?') AS a, regexp_extract_all('see ' || (conv_id + turn % 3), '[0-9]+(?:\\.[0-9]+)?') AS b FROM conversations)""")
def judge_numbers(spark, sf):
    c = read(spark, sf, "conversations")
    claim = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" "), F.col("conv_id").cast("string"))).otherwise(F.lit("")))
    return c.select("conv_id", "turn", X.judge(claim, F.concat(F.lit("see "), (F.col("conv_id") + F.col("turn") % 3).cast("string"))).alias("verdict"))


@query("""SELECT doc_id, CASE WHEN NOT (doc_id % 2 = 0) THEN c WHEN c = 'draft' THEN 'medium' WHEN c = 'medium' THEN 'high' ELSE c END AS confidence, CASE c WHEN 'medium' THEN 0.5 WHEN 'high' THEN 1.0 ELSE 0.0 END::DOUBLE AS weight FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'medium' ELSE 'high' END AS c FROM documents)""")
def promote_ladder(spark, sf):
    c = F.when(F.col("doc_id") % 3 == 0, "draft").when(F.col("doc_id") % 3 == 1, "medium").otherwise("high")
    return read(spark, sf, "documents").select("doc_id", c.alias("c")).select("doc_id", X.next_rung("c", F.col("doc_id") % 2 == 0).alias("confidence"), X.edge_multiplier("c").alias("weight"))


@query("""SELECT count(*) AS total, round(avg((expected IS NOT NULL AND found)::INT::DOUBLE), 6) AS recall_at_k, round(avg(CASE WHEN expected IS NULL THEN refused::INT::DOUBLE END), 6) AS refusal_acc, round(avg(CASE WHEN total_sentences > 0 THEN cited::DOUBLE / total_sentences END), 6) AS citation_cov FROM (
SELECT CASE WHEN doc_id % 4 <> 0 THEN doc_id END AS expected, quality = 1 AS found, toxic = 0 AS refused, doc_id % 3 AS cited, doc_id % 4 AS total_sentences FROM labels)""")
def eval_metrics(spark, sf):
    c = read(spark, sf, "labels").select(F.when(F.col("doc_id") % 4 != 0, F.col("doc_id")).alias("expected"), (F.col("quality") == 1).alias("found"), (F.col("toxic") == 0).alias("refused"), (F.col("doc_id") % 3).alias("cited"), (F.col("doc_id") % 4).alias("total_sentences"))
    return quality.eval_metrics(c)


@query(f"""WITH {KNN}, ends AS (SELECT label, min(vec_id) AS lo, max(vec_id) AS hi FROM embeddings GROUP BY label), asked AS (SELECT vec_id AS qid, lo, hi FROM embeddings JOIN ends USING (label) WHERE vec_id % 20 = 0),
gold AS (SELECT qid, lo AS id FROM asked UNION SELECT qid, hi FROM asked UNION SELECT qid, -1 - qid FROM asked),
cov AS (SELECT * FROM gold WHERE id >= 0), h AS (SELECT c.qid, min(k.rank) AS best FROM cov c LEFT JOIN knn k ON k.query = c.qid AND k.id = c.id GROUP BY c.qid)
SELECT k, round(avg((coalesce(best, 1073741824) < k)::INT::DOUBLE), 6) AS hit, (SELECT round((SELECT count(*) FROM cov)::DOUBLE / count(*), 6) FROM gold) AS coverage FROM h, (SELECT unnest([1, 5, 40])::BIGINT AS k) GROUP BY k""")
def hit_at_k(spark, sf):
    """Every vector whose id is divisible by 20 asks for the first and the last vector of its label, and for one that is nowhere."""
    e = read(spark, sf, "embeddings")
    ends = e.groupBy("label").agg(F.min("vec_id").alias("lo"), F.max("vec_id").alias("hi"))
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "label").join(ends, "label")
    gold = asked.select("qid", F.explode(F.array("lo", "hi", -1 - F.col("qid"))).alias("id")).distinct()
    res = knn_topk(spark, sf).select(F.col("query").alias("qid"), "id", "rank")
    return quality.hit_at_k(res, gold, e.select(F.col("vec_id").alias("id")), (1, 5, 40))


LINT = {"broken": ("lint_broken_links", "src"), "unsourced": ("lint_unsourced", "id"), "expired": ("lint_expired_ttl", "path"), "stale": ("lint_stale_pages", "doc_path"), "conflict": ("lint_conflicts", "page"), "orphan": ("lint_orphans", "page")}
FINDINGS = " UNION ALL ".join(f"SELECT '{kind}' AS kind, {c}::VARCHAR AS subject FROM ({ORACLES[name]})" for kind, (name, c) in LINT.items())


def _findings(spark, sf):
    checks = {"broken": lint_broken_links, "unsourced": lint_unsourced, "expired": lint_expired_ttl, "stale": lint_stale_pages, "conflict": lint_conflicts, "orphan": lint_orphans}
    return quality.findings(**{kind: checks[kind](spark, sf).select(c) for kind, (_, c) in LINT.items()})


@query(FINDINGS)
def lint_all(spark, sf):
    return _findings(spark, sf)


@query(f"SELECT kind, count(*) AS n, count(DISTINCT subject) AS n_subjects FROM ({FINDINGS}) GROUP BY kind")
def lint_totals(spark, sf):
    return quality.totals(_findings(spark, sf))


@query(f"WITH {BLOCKS} SELECT doc_path, count(*) AS n_blocks, min(ordinal) AS first, max(ordinal) AS last FROM blocks GROUP BY doc_path")
def incremental_ingest(spark, sf):
    """Blocks taken in by a stream over the document files, counted."""
    import uuid

    from tessera.session import shared_folder
    from tessera.streaming.incremental import ingest

    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    docs = read(spark, sf, "documents")
    ingest(spark, f"{sf}/documents.parque[t]", docs.schema, f"{root}/blocks", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/blocks").groupBy("doc_path").agg(F.count("*").alias("n_blocks"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))


@query(f"WITH {TURNS} SELECT layer, count(*) AS n, count(DISTINCT doc_path) AS docs, sum(length(raw))::BIGINT AS chars FROM turns GROUP BY layer")
def layer_totals(spark, sf):
    return turns(spark, sf).groupBy("layer").agg(F.count("*").alias("n"), F.countDistinct("doc_path").alias("docs"), F.sum(F.length("raw")).alias("chars"))


@query(f"WITH {TURNS} SELECT count(*) AS n FROM turns")
def stamp_rows(spark, sf):
    return lifecycle.corpus_stamp(turns(spark, sf), "id", "raw").select("n")


@query(f"""WITH {NAMES}, f AS (SELECT entity_id, id, row_number() OVER (PARTITION BY entity_id ORDER BY doc_path, ordinal, id) AS rn FROM mm),
n AS (SELECT entity_id, arg_min(name, (doc_path, ordinal, name)) AS name FROM mm GROUP BY entity_id)
SELECT 'entities/' || entity_id || '.md' AS path, any_value(name) AS title, string_agg(id, ' ' ORDER BY rn) AS cited FROM f JOIN n USING (entity_id) WHERE rn <= 8 GROUP BY entity_id""")
def entity_pages(spark, sf):
    pages = compile.entity_pages(_mentions(spark, sf))
    cited = F.array_join(F.regexp_extract_all("content", F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1)), " ")
    return pages.select("path", F.regexp_extract("content", r"(?m)^# (.*)$", 1).alias("title"), cited.alias("cited"))


@query("""SELECT 'entities/' || doc_id || '.md' AS path, CASE doc_id % 3 WHEN 0 THEN 'high' ELSE 'draft' END AS confidence, CASE WHEN doc_id % 2 = 0 AND doc_id % 5 <> 0 THEN '- ⚠ ' || source ELSE '- none' END AS conflicts FROM documents""")
def page_carry_forward(spark, sf):
    d = read(spark, sf, "documents")
    path = F.concat(F.lit("entities/"), F.col("doc_id").cast("string"), F.lit(".md"))
    page = lambda level, notes: F.concat(F.lit("---\nconfidence: "), level, F.lit("\n---\n# t\n\n## Conflicts\n"), notes, F.lit("\n"))
    fresh = d.select(path.alias("path"), page(F.lit("draft"), F.lit("- none")).alias("content"))
    notes = F.when((F.col("doc_id") % 2 == 0) & (F.col("doc_id") % 5 != 0), F.concat(F.lit("- ⚠ "), "source")).otherwise(F.lit("- none"))
    old = d.select(path.alias("path"), page(F.when(F.col("doc_id") % 3 == 0, "high").otherwise("draft"), notes).alias("content"))
    out = compile.carry_forward(fresh, old)
    return out.select("path", compile.confidence_of(F.col("content")).alias("confidence"), F.trim(F.regexp_replace(compile.conflicts_of(F.col("content")), "\n", "")).alias("conflicts"))


@query("SELECT 'sources/' || source || '/' || doc_id || '.md' AS path FROM documents WHERE doc_id % 6 = 1")
def retire_pages(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", _path().alias("path"))
    pages = d.select(F.concat(F.lit("sources/"), "path", F.lit(".md")).alias("path"))
    return compile.retire_pages(pages, d.filter("doc_id % 6 <> 1"))


@query(f"""WITH {SECTIONS}, t AS (SELECT doc_path, ordinal, substr(raw, 1, 30) AS title, id FROM blocks), r AS (SELECT *, row_number() OVER (PARTITION BY doc_path ORDER BY ordinal, id) AS rn FROM t WHERE NOT regexp_matches(title, '^(__|p\\.)') AND trim(title) <> '')
SELECT doc_path, string_agg('What about ' || title || '?', ' | ' ORDER BY rn) AS questions FROM r WHERE rn <= 5 GROUP BY doc_path""")
def source_questions(spark, sf):
    s = blocks(spark, sf).select("doc_path", "ordinal", "id", F.substring("raw", 1, 30).alias("title"))
    return compile.source_questions(s).select("doc_path", F.array_join("questions", " | ").alias("questions"))


@query(f"""WITH {TURNS}, e AS (SELECT doc_path AS qid, ordinal - 1 AS rank, id, raw FROM turns WHERE ordinal > 0), q AS (SELECT doc_path AS qid, substr(raw, 1, 60) AS question FROM turns WHERE ordinal = 0)
SELECT qid, '## ' || any_value(question) || chr(10) || substr(arg_min(raw, rank), 1, 180) || chr(10) || string_agg('[[' || id || ']]', ' ' ORDER BY rank) AS entry FROM q JOIN e USING (qid) WHERE rank < 3 GROUP BY qid""")
def faq(spark, sf):
    t = turns(spark, sf)
    q = t.filter("ordinal = 0").select(F.col("doc_path").alias("qid"), F.substring("raw", 1, 60).alias("question"))
    e = t.filter("ordinal > 0").select(F.col("doc_path").alias("qid"), (F.col("ordinal") - 1).alias("rank"), "id", "raw")
    return compile.faq(q, e)


@query("""WITH e AS (SELECT lang AS topic, source AS entity_id, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, entity_id) AS rn FROM e),
d AS (SELECT lang AS topic, source || '/' || doc_id AS doc FROM documents), s AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY doc) AS rn FROM d)
SELECT topic, '# ' || topic || chr(10) || (SELECT string_agg('- [[entities/' || entity_id || ']]', chr(10) ORDER BY rn) FROM r WHERE r.topic = x.topic AND rn <= 10) || chr(10) || 'sources: ' || (SELECT string_agg(doc, ', ' ORDER BY doc) FROM s WHERE s.topic = x.topic AND rn <= 3) AS content FROM (SELECT DISTINCT lang AS topic FROM documents WHERE lang IS NOT NULL) x""")
def synthesis_pages(spark, sf):
    d = read(spark, sf, "documents").filter("lang is not null")
    return compile.synthesis_pages(d.select(F.col("lang").alias("topic"), F.col("source").alias("entity_id"), F.lit(1).alias("n_facts"), _path().alias("doc_path")))
