"""Queries: stamps and derived tables, ingest that replaces, index segments, many searches at once, cliques."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import graph, ledger, lexical, lifecycle, quality, rebuild, retrieval, route
from tessera.plans.base import BLOCKS, TURNS, blocks, bm25_sql, hash_sql, mirror_sql, query, read, text_index, tokens_sql, turns
from tessera.plans.knowledge import TABLES as ROUTE_TABLES
from tessera.plans.knowledge import _acls, _pages, _path, _states
from tessera.plans.search import TREE, TREE_QUERY, _sections
from tessera.session import discard, shared_folder, stored
from tessera.sources.registry import Registry, stamp_of
from tessera.streaming import replacing


@contextmanager
def scratch(spark, label: str):
    """A folder for a query's own stored state, deleted when its result has been stored elsewhere."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        discard(spark, path)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# ---- stamps and what is derived under them

STAMPED = ("id", "doc_path", "layer", "raw")
STAMP = "sha256(count(*) || ':' || coalesce(sum(('0x' || substr(m, 1, 15))::BIGINT), 0) || ':' || coalesce(sum(('0x' || substr(m, 18, 15))::BIGINT), 0))"


@query(f"""WITH {TURNS}, r AS (SELECT md5({" || ".join(f"coalesce(length({c}) || ':' || {c}, '-')" for c in STAMPED)}) AS m FROM turns)
SELECT count(*) AS n, {STAMP} AS stamp FROM r""")
def corpus_stamp(spark, sf):
    """The stamp itself, of every turn."""
    return lifecycle.corpus_stamp(turns(spark, sf), *STAMPED)


def _reading_order(t: DataFrame) -> DataFrame:
    """The weighted graph of a corpus of turns: each block linked to the next of its document."""
    nxt = t.select("doc_path", (F.col("ordinal") - 1).alias("ordinal"), F.col("id").alias("dst"))
    links = t.select("doc_path", "ordinal", F.col("id").alias("src")).join(nxt, ["doc_path", "ordinal"]).select("src", "dst", F.lit(1.0).alias("weight"))
    conf = t.select("doc_path").distinct().filter(F.substring("doc_path", 6, 20).cast("bigint") % 8 == 0).withColumn("confidence", F.lit("medium"))
    return graph.weighted_edges(links, t, conf)


def _order_sql(name: str) -> str:
    return f"SELECT a.doc_path, a.id AS src, b.id AS dst, CASE WHEN a.layer = 'raw' THEN 1.0 WHEN substr(a.doc_path, 6)::BIGINT % 8 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS w FROM {name} a JOIN {name} b ON a.doc_path = b.doc_path AND b.ordinal = a.ordinal + 1"


@query(f"""WITH {TURNS}, pick AS (SELECT 'conv/' || min(conv_id) AS d FROM conversations),
later AS (SELECT id, doc_path, section_id, breadcrumb, raw, ordinal, CASE WHEN doc_path = d THEN 'raw' ELSE layer END AS layer FROM turns, pick WHERE doc_path <> d OR ordinal <> 1),
g1 AS ({_order_sql("turns")}), g2 AS ({_order_sql("later")}),
steps AS (SELECT 1 AS step, true AS built, 1 AS version, * FROM g1 UNION ALL SELECT 2, false, 1, * FROM g1 UNION ALL SELECT 3, true, 2, * FROM g2 UNION ALL SELECT 4, false, 1, * FROM g1)
SELECT step::BIGINT AS step, built, version::BIGINT AS version, doc_path, count(*) AS n_edges, sum(w) AS weight FROM steps GROUP BY ALL""")
def graph_by_stamp(spark, sf):
    """The stored graph of all conversations: built, asked for again, asked for after one document has changed, and read
    once more by a reader that had pinned the first version."""
    now = turns(spark, sf)
    doc = f"conv/{read(spark, sf, 'conversations').agg(F.min('conv_id')).first()[0]}"
    later = now.filter((F.col("doc_path") != doc) | (F.col("ordinal") != 1)).withColumn("layer", F.when(F.col("doc_path") == doc, "raw").otherwise(F.col("layer")))
    with scratch(spark, "graphs") as root:
        registry, out, pinned = Registry(spark, root), [], None
        for step, corpus in ((1, now), (2, now), (3, later), (4, None)):
            if corpus is None:
                edges, built, version = pinned.table("graph"), False, pinned.version
            else:
                edges, built = registry.derived("graph", stamp_of(blocks=(corpus, STAMPED)), lambda c=corpus: _reading_order(c))
                version = registry.snapshot().version
                pinned = pinned or registry.snapshot()
            out.append(edges.groupBy(F.regexp_extract("src", "^(.*)/", 1).alias("doc_path")).agg(F.count("*").alias("n_edges"), F.sum("w").alias("weight")).select(F.lit(step).alias("step"), F.lit(built).alias("built"), F.lit(version).alias("version"), "doc_path", "n_edges", "weight"))
        return stored(_union(out))


# ---- ingest that replaces

ADDED_LINE = "an added line"


def _feeds(spark, sf) -> list[DataFrame]:
    """Three batches of changes of all documents: most documents; changed, deleted and late ones; new, restored and repeated ones."""
    d = read(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    i = F.col("doc_id")
    more = F.concat(F.coalesce("text", F.lit("")), F.lit("\n" + ADDED_LINE))
    change = lambda rows, seq, text=F.col("text"), gone=False: rows.select("doc_id", text.alias("text"), "lang", "source", F.lit(seq).cast("bigint").alias("seq"), F.lit(gone).alias("deleted"))
    grown = change(d.filter(i % 6 == 0), 2, more)
    late = change(d.filter(i % 9 == 1), 0, F.lit("late"))
    return [change(d.filter(i % 4 != 3), 1), _union([grown, change(d.filter(i % 10 == 5), 2, F.lit(None).cast("string"), True), late]), _union([change(d.filter((i % 4 == 3) | (i % 30 == 15)), 3), grown])]


def _ingested(spark, sf, root: str):
    """The registry after three runs of the stream, and each run's version."""
    made = []
    for k, feed in enumerate(_feeds(spark, sf)):
        feed.write.parquet(f"{root}/feed/{k}")
        replacing.follow(spark, f"{root}/feed/*", f"{root}/base", f"{root}/state", files_per_batch=1_000_000, after=made.append).awaitTermination()
    return Registry(spark, f"{root}/base"), made


FINAL = f"""final AS (SELECT doc_id, source, CASE WHEN doc_id % 4 = 3 OR doc_id % 30 = 15 THEN coalesce(text, '') WHEN doc_id % 6 = 0 THEN coalesce(text, '') || chr(10) || '{ADDED_LINE}' WHEN doc_id % 10 = 5 THEN NULL ELSE coalesce(text, '') END AS text FROM documents),
lines_ AS (SELECT doc_id, source || '/' || doc_id AS doc_path, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS arr FROM final WHERE text IS NOT NULL),
state_ AS (SELECT doc_id, doc_path, unnest(arr) AS raw, generate_subscripts(arr, 1) - 1 AS ordinal FROM lines_)"""


@query(f"WITH {FINAL} SELECT doc_path, count(*) AS n_blocks, sha256(string_agg({hash_sql('raw')}, '|' ORDER BY ordinal)) AS fp FROM state_ GROUP BY doc_path")
def replacing_ingest(spark, sf):
    """Blocks after three batches of changes, by document: the same as of a rebuild from what the documents are at last."""
    with scratch(spark, "replacing") as root:
        registry, _ = _ingested(spark, sf, root)
        b = registry.snapshot().table("blocks")
        counts = b.groupBy("doc_path").agg(F.count("*").alias("n_blocks"))
        return stored(counts.join(lifecycle.fingerprints(b).withColumnRenamed("doc", "doc_path"), "doc_path"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')) = 0 THEN 0 ELSE 1 END AS has, source || '/' || doc_id AS doc_path FROM documents),
c AS (SELECT 0 AS batch, doc_id, has, doc_path, 'added' AS change FROM d WHERE doc_id % 4 <> 3
UNION ALL SELECT 1, doc_id, 1, doc_path, CASE WHEN doc_id % 4 = 3 THEN 'added' ELSE 'changed' END FROM d WHERE doc_id % 6 = 0
UNION ALL SELECT 1, doc_id, has, doc_path, 'deleted' FROM d WHERE doc_id % 10 = 5 AND doc_id % 4 <> 3
UNION ALL SELECT 1, doc_id, 1, doc_path, 'added' FROM d WHERE doc_id % 9 = 1 AND doc_id % 4 = 3 AND doc_id % 6 <> 0 AND doc_id % 10 <> 5
UNION ALL SELECT 2, doc_id, 1, doc_path, CASE WHEN doc_id % 9 = 1 AND doc_id % 4 = 3 AND doc_id % 10 <> 5 THEN 'changed' ELSE 'added' END FROM d WHERE doc_id % 4 = 3 OR doc_id % 30 = 15)
SELECT batch::BIGINT AS batch, doc_id, change FROM c""")
def replacing_changes(spark, sf):
    """What each batch of the three did to which document; late, repeated and unchanged ones are not there."""
    with scratch(spark, "replacing") as root:
        _, made = _ingested(spark, sf, root)
        return stored(_union([s.table("changes").select(F.lit(k).alias("batch"), "doc_id", "change") for k, s in enumerate(made)]))


# ---- index segments

GROWN = "heatly thorea"
SEGMENTED = f"""{BLOCKS}, now_ AS (SELECT id, breadcrumb, CASE WHEN doc_id % 6 = 0 THEN raw || ' {GROWN}' ELSE raw END AS raw FROM blocks WHERE doc_id % 10 <> 5)"""
ASKED = ("heatly thorea tionnt", "qqqzzz heatly", "the heat")


@query(f"WITH {SEGMENTED}, " + ", ".join(bm25_sql(q, 50, name=f"h{k}", source="now_") for k, q in enumerate(ASKED)) + "\n" + "\nUNION ALL ".join(f"SELECT '{state}' AS state, {k}::BIGINT AS asked, id, score, rung, rank FROM h{k}" for state in ("segments", "merged") for k in range(len(ASKED))))
def index_segments(spark, sf):
    """Three searches of an index of two segments and of their merger, after a third of the documents were added, changed
    or deleted: the hits are those of a rebuilt index."""
    b = blocks(spark, sf)
    before = b.filter("doc_id % 4 <> 3")
    grown = b.withColumn("raw", F.when(F.col("doc_id") % 6 == 0, F.concat("raw", F.lit(f" {GROWN}"))).otherwise(F.col("raw"))).filter("doc_id % 10 <> 5")
    touched = (F.col("doc_id") % 6 == 0) | (F.col("doc_id") % 10 == 5)
    with scratch(spark, "segments") as root:
        index = lexical.Index.build(before, root).updated(grown.filter(touched | (F.col("doc_id") % 4 == 3)), before.filter(touched))
        out = []
        for state, one in (("segments", index), ("merged", index.merge())):
            out += [one.search(q, 50).select(F.lit(state).alias("state"), F.lit(k).alias("asked"), "id", "score", "rung", "rank") for k, q in enumerate(ASKED)]
        return stored(_union(out))


# ---- many searches at once

BATCH = rf"""{BLOCKS}, asked AS (SELECT doc_id AS qid, CASE WHEN doc_id % 40 = 20 THEN 'zqx' || doc_id || ' qzx' ELSE substr(coalesce(text, ''), 1, 40) END AS text FROM documents WHERE doc_id % 20 = 0),
qw AS (SELECT qid, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+') AS words FROM asked),
qt AS (SELECT qid, unnest(regexp_extract_all({{fold}}, '[\p{{L}}\p{{N}}]+')) AS term, generate_subscripts(regexp_extract_all({{fold}}, '[\p{{L}}\p{{N}}]+'), 1) AS p FROM asked),
tok AS (SELECT id, list_concat({tokens_sql('id')}, {tokens_sql(mirror_sql('breadcrumb'))}, {tokens_sql(mirror_sql('raw'))}) AS ts FROM blocks),
tot AS (SELECT count(*) AS n_, avg(len(ts)) AS avg_ FROM tok),
tf AS (SELECT id, len(ts) AS dl, term, count(*) AS tf FROM (SELECT id, ts, unnest(ts) AS term FROM tok) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
m AS (SELECT qid, p, id, dl, tf, count(*) OVER (PARTITION BY qid, p) AS df FROM qt JOIN tf USING (term)),
sc AS (SELECT qid, id, count(*) AS held, round(sum((CASE WHEN ln((n_ - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_ - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_))), 6) AS score FROM m, tot GROUP BY qid, id),
st AS (SELECT qid, len(words) AS n, CASE WHEN max(held) = len(words) THEN 1 ELSE 2 END AS rung, words FROM sc JOIN qw USING (qid) GROUP BY qid, words),
top_ AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rn FROM sc JOIN st USING (qid) WHERE rung = 2 OR held = n),
kept AS (SELECT qid, t.id, score, rung, b.doc_id FROM top_ t JOIN blocks b USING (id) WHERE rn <= 10 AND (rung = 1 OR n < 2 OR len(list_filter(words, lambda w: contains(b.raw, w))) >= 2)),
batch AS (SELECT qid, id, doc_id, score, rung::BIGINT AS rung, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank FROM kept)"""
BATCH = BATCH.replace("{fold}", f"translate(lower(text), '{X.FOLD_FROM}', '{X.FOLD_TO}')")


def _asked(spark, sf) -> DataFrame:
    """A question for every document whose id is divisible by 20: its own first characters, or words that are nowhere."""
    d = read(spark, sf, "documents").filter("doc_id % 20 = 0")
    nowhere = F.concat(F.lit("zqx"), F.col("doc_id").cast("string"), F.lit(" qzx"))
    return d.select(F.col("doc_id").alias("qid"), F.when(F.col("doc_id") % 40 == 20, nowhere).otherwise(F.substring(F.coalesce("text", F.lit("")), 1, 40)).alias("text"))


def _searched(spark, sf) -> tuple[DataFrame, DataFrame]:
    asked = stored(_asked(spark, sf))
    with scratch(spark, "batch") as root:
        return asked, stored(lexical.Index.build(blocks(spark, sf), root).batch(asked, 10))


@query(f"WITH {BATCH} SELECT qid, id, score, rung, rank FROM batch")
def bm25_batch(spark, sf):
    """All questions of `_asked` at once over a stored index."""
    return _searched(spark, sf)[1]


@query(f"""WITH {BATCH}, r AS (SELECT qid, count(*) AS n, bool_or(rank < 5 AND doc_id = qid) AS found FROM batch GROUP BY qid),
c AS (SELECT a.qid, CASE WHEN a.qid % 40 <> 20 THEN a.qid END AS expected, coalesce(found, false) AS found, n IS NULL AS refused, least(3, coalesce(n, 0)) AS total_sentences, least(3, coalesce(n, 0)) AS cited FROM asked a LEFT JOIN r USING (qid))
SELECT count(*) AS total, round(avg((expected IS NOT NULL AND found)::INT::DOUBLE), 6) AS recall_at_k, round(avg(CASE WHEN expected IS NULL THEN refused::INT::DOUBLE END), 6) AS refusal_acc, round(avg(CASE WHEN total_sentences > 0 THEN cited::DOUBLE / total_sentences END), 6) AS citation_cov FROM c""")
def eval_batch(spark, sf):
    """Seed evaluation end to end: every question is searched for; a question of a document's own words is met when the
    document is among the first five hits, one of words that are nowhere when nothing is found."""
    asked, hits = _searched(spark, sf)
    own = F.regexp_extract("id", r"^[^/]*/(-?[0-9]+)#", 1).cast("bigint")
    by = hits.groupBy("qid").agg(F.count("*").alias("n"), F.bool_or((F.col("rank") < 5) & (own == F.col("qid"))).alias("found"))
    shown = F.least(F.lit(3), F.coalesce("n", F.lit(0)))
    cases = asked.join(by, "qid", "left").select(F.when(F.col("qid") % 40 != 20, F.col("qid")).alias("expected"), F.coalesce("found", F.lit(False)).alias("found"), F.col("n").isNull().alias("refused"), shown.alias("cited"), shown.alias("total_sentences"))
    return quality.eval_metrics(cases)


# ---- cliques

PAIRS = f"""{TURNS}, links_ AS ({_order_sql("turns")}),
edges AS (SELECT src, dst, w FROM links_
  UNION ALL SELECT a.id, b.id, CASE WHEN a.layer = 'raw' THEN 0.2 ELSE 0.0 END FROM turns a JOIN turns b USING (doc_path) WHERE a.id <> b.id
  UNION ALL SELECT a.id, b.id, CASE WHEN a.layer = 'raw' THEN 0.5 ELSE 0.0 END FROM turns a JOIN turns b USING (section_id) WHERE a.id <> b.id),
o AS (SELECT src, sum(w) AS out FROM edges GROUP BY src)"""


@query(f"""WITH RECURSIVE {PAIRS}, seeds AS (SELECT id AS query, id FROM turns WHERE substr(doc_path, 6)::BIGINT % 20 = 0),
n1 AS (SELECT * FROM seeds UNION SELECT s.query, e.dst FROM seeds s JOIN edges e ON e.src = s.id),
nodes AS (SELECT * FROM n1 UNION SELECT s.query, e.dst FROM n1 s JOIN edges e ON e.src = s.id),
trans AS (SELECT query, src, dst, sum(f) AS f FROM (
  SELECT n.query, n.id AS src, e.dst, e.w / o.out AS f FROM nodes n JOIN edges e ON e.src = n.id JOIN o ON o.src = n.id JOIN nodes m ON m.query = n.query AND m.id = e.dst WHERE o.out > 0
  UNION ALL SELECT n.query, n.id, n.query, 1.0 FROM nodes n LEFT JOIN o ON o.src = n.id WHERE coalesce(o.out, 0) = 0
  UNION ALL SELECT query, id, id, 0.0 FROM nodes) GROUP BY ALL),
pr AS (SELECT 0 AS r, query, id, 1.0::DOUBLE / count(*) OVER (PARTITION BY query) AS pr FROM nodes
  UNION ALL SELECT pr.r + 1, t.query, t.dst, 0.15 * (CASE WHEN t.query = t.dst THEN 1 ELSE 0 END) + 0.85 * sum(pr.pr * t.f) FROM pr JOIN trans t ON t.query = pr.query AND t.src = pr.id WHERE pr.r < 20 GROUP BY pr.r, t.query, t.dst)
SELECT query, id, round(pr, 6) AS pr FROM pr WHERE r = 20""")
def ppr_cliques(spark, sf):
    """Rank around every turn of the conversations with an id divisible by 20, over links and the same-document and
    same-section edges, of which no pair is formed."""
    t = turns(spark, sf)
    seeds = t.filter(F.substring("doc_path", 6, 20).cast("bigint") % 20 == 0).select(F.col("id").alias("query"), "id")
    members = graph.cliques(t, same_doc="doc_path", same_section="section_id")
    return graph.personalized_pagerank(_reading_order(t), seeds, 20, None, members).select("query", "id", F.round("pr", 6).alias("pr"))


@query(f"""WITH RECURSIVE {PAIRS}, p AS (SELECT id, CASE WHEN ordinal = 0 THEN 1.0::DOUBLE / (SELECT count(*) FROM turns WHERE ordinal = 0) ELSE 0 END AS p FROM turns),
pr AS (SELECT 0 AS r, id, p, 1.0::DOUBLE / (SELECT count(*) FROM p) AS pr FROM p
  UNION ALL (WITH flow AS (SELECT e.dst AS id, sum(pr.pr * e.w / o.out) AS f FROM pr JOIN edges e ON e.src = pr.id JOIN o ON o.src = pr.id WHERE o.out > 0 GROUP BY e.dst),
    lost AS (SELECT coalesce(sum(pr.pr), 0) AS l FROM pr LEFT JOIN o ON o.src = pr.id WHERE coalesce(o.out, 0) = 0)
    SELECT pr.r + 1, pr.id, pr.p, 0.15 * pr.p + 0.85 * coalesce(flow.f, 0) + 0.85 * l * pr.p FROM pr LEFT JOIN flow USING (id), lost WHERE pr.r < 6))
SELECT id, round(pr, 9) AS pr FROM pr WHERE r = 6""")
def rank_cliques(spark, sf):
    """Rank over the whole graph of turns from all first turns, by joins, with cliques as memberships."""
    t = turns(spark, sf)
    members = graph.cliques(t, same_doc="doc_path", same_section="section_id")
    return graph.pagerank_by_joins(_reading_order(t), t.filter("ordinal = 0").select("id"), 6, members=members).select("id", F.round("pr", 9).alias("pr"))


# ---- verdicts


@query(f"""WITH {BLOCKS}, judged AS (SELECT id, b.doc_id, ordinal, raw, CASE WHEN toxic = 1 THEN 'retracted' WHEN ordinal % 2 = 0 THEN 'disputed' ELSE 'superseded' END AS state, CASE WHEN toxic <> 1 AND ordinal % 2 = 0 THEN 'again' ELSE 'label' END AS reason FROM blocks b JOIN labels l USING (doc_id) WHERE toxic = 1 OR quality = 0),
alive AS (SELECT * FROM judged WHERE doc_id % 6 <> 0),
p AS (SELECT 'page/' || (doc_id % 97) AS page, id, state, reason FROM alive)
SELECT 'block' AS kind, id AS subject, state || ' ' || reason AS detail, 1::BIGINT AS n FROM alive
UNION ALL SELECT 'page', page, arg_min('cited ' || state || ' ' || id || ': ' || reason, id), count(*) FROM p GROUP BY page""")
def retract_and_replay(spark, sf):
    """Verdicts recorded twice, a sixth of the documents rewritten, then all replayed: what applies, and which pages are
    stale."""
    b = blocks(spark, sf).withColumn("hash", X.content_hash("raw"))
    lab = read(spark, sf, "labels").filter("toxic = 1 or quality = 0")
    asked = b.join(lab, "doc_id")
    first = asked.select("id", F.when(F.col("toxic") == 1, "retracted").otherwise("superseded").alias("state"), F.lit("label").alias("reason"), F.lit("2024-01-01").alias("updated"))
    second = asked.filter("toxic <> 1 and ordinal % 2 = 0").select("id", F.lit("disputed").alias("state"), F.lit("again").alias("reason"), F.lit("2024-02-01").alias("updated"))
    later = b.withColumn("hash", F.when(F.col("doc_id") % 6 == 0, F.concat("hash", F.lit("x"))).otherwise(F.col("hash")))
    pages = b.select(F.concat(F.lit("page/"), (F.col("doc_id") % 97).cast("string")).alias("page"), F.concat(F.lit("as [["), "id", F.lit("]] says")).alias("text"))
    with scratch(spark, "ledger") as root:
        registry = Registry(spark, root)
        ledger.decide(registry, first, b)
        states, stale = ledger.replay(ledger.decide(registry, second, b), later, pages)
        one = states.select(F.lit("block").alias("kind"), F.col("id").alias("subject"), F.concat_ws(" ", "state", "reason").alias("detail"), F.lit(1).cast("bigint").alias("n"))
        return stored(one.unionByName(stale.select(F.lit("page").alias("kind"), F.col("page").alias("subject"), F.col("reason").alias("detail"), "n")))


# ---- stale pages made anew

SPLIT = r"list_filter(list_transform(string_split(regexp_replace(raw, '([。！？；!?;.])\s*', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:2]"
OLD_PAGE = """'---\ntype: ' || kind || '\ngenerated: ' || CASE WHEN doc_id % 11 = 2 THEN 'false' ELSE 'true' END || '\ncreated: 2024-01-01\nsources: [raw/' || ids[1] || CASE WHEN doc_id % 13 = 4 THEN 'gone' ELSE '' END || ']\nstale: true\nconfidence: ' || CASE WHEN doc_id % 4 = 0 THEN 'high' ELSE 'draft' END || '\n---\n# T ' || doc_id || '\n\n## Facts\n' || coalesce('- old [[raw/' || ids[2] || ']]', '- none') || '\n\n## Evidence (1)\n' || coalesce('- `' || ids[3] || '` — x', '') || '\n\n## Entities\n- [[entities/' || lang || ']]\n\n## Conflicts\n- none\n'"""


@query(f"""WITH {BLOCKS}, own AS (SELECT doc_id, any_value(lang) AS lang, CASE WHEN doc_id % 2 = 0 THEN 'synthesis' ELSE 'brief' END AS kind, list(id ORDER BY ordinal)[1:3] AS ids FROM blocks WHERE ordinal < 3 AND lang IS NOT NULL GROUP BY doc_id),
old AS (SELECT *, 'synthesis/' || doc_id || '.md' AS path, doc_id % 3 = 0 AS stale, {OLD_PAGE} AS content FROM own),
redo AS (SELECT * FROM old WHERE stale AND doc_id % 11 <> 2 AND doc_id % 13 <> 4),
used AS (SELECT r.doc_id, b.id, b.raw, b.breadcrumb, b.ordinal FROM redo r JOIN blocks b USING (doc_id) WHERE b.ordinal < CASE WHEN kind = 'brief' THEN 3 ELSE 2 END),
sent AS (SELECT doc_id, id, ordinal, unnest({SPLIT}) AS s, generate_subscripts({SPLIT}, 1) AS k FROM used),
point AS (SELECT * FROM sent QUALIFY row_number() OVER (PARTITION BY doc_id, substr(s, 1, 40) ORDER BY ordinal, k) = 1),
points AS (SELECT doc_id, string_agg('- ' || s || ' [[raw/' || id || ']]', chr(10) ORDER BY ordinal, k) AS t FROM point GROUP BY doc_id),
parts AS (SELECT doc_id, count(*) AS n, string_agg('raw/' || id, ', ' ORDER BY ordinal) AS src, string_agg('- `' || id || '` — ' || breadcrumb, chr(10) ORDER BY ordinal) AS ev, string_agg('- ' || raw || ' [[raw/' || id || ']]', chr(10) ORDER BY ordinal) AS facts FROM used GROUP BY doc_id),
fresh AS (SELECT path, '---\ntype: ' || kind || '\ngenerated: true\ncreated: 2024-01-01\nsources: [' || src || ']\nlast_compiled: now\nstale: false\nconfidence: ' || CASE WHEN kind = 'synthesis' AND r.doc_id % 4 = 0 THEN 'high' ELSE 'draft' END || '\n---\n# T ' || r.doc_id || CASE WHEN kind = 'brief' THEN '\n\n## Points\n' || coalesce(t, '- none') || '\n\n## Evidence (' || n || ')\n' || ev || '\n' ELSE '\n\n## Facts\n' || facts || '\n\n## Entities\n- [[entities/' || lang || ']]\n\n## Conflicts\n- none\n' END AS new FROM redo r JOIN parts USING (doc_id) LEFT JOIN points USING (doc_id))
SELECT path, coalesce(new, content) AS content, stale AND new IS NULL AS stale, 'active' AS state, new IS NOT NULL AS rebuilt FROM old LEFT JOIN fresh USING (path)""")
def stale_rebuild(spark, sf):
    """A page of every document from its first blocks: a third is stale, of which those are made anew that are generated
    and whose recorded blocks are all there; the contents are compared."""
    b = blocks(spark, sf)
    i = F.col("doc_id")
    ids = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "id"))), lambda x: x["id"]), 1, 3)
    own = b.filter("ordinal < 3 and lang is not null").groupBy("doc_id").agg(F.first("lang").alias("lang"), ids.alias("ids")).withColumn("kind", F.when(i % 2 == 0, "synthesis").otherwise("brief"))
    at = lambda k: F.get("ids", F.lit(k))
    text = F.concat(F.lit("---\ntype: "), "kind", F.lit("\ngenerated: "), F.when(i % 11 == 2, "false").otherwise("true"), F.lit("\ncreated: 2024-01-01\nsources: [raw/"), at(0), F.when(i % 13 == 4, "gone").otherwise(""), F.lit("]\nstale: true\nconfidence: "), F.when(i % 4 == 0, "high").otherwise("draft"), F.lit("\n---\n# T "), i.cast("string"), F.lit("\n\n## Facts\n"), F.coalesce(F.concat(F.lit("- old [[raw/"), at(1), F.lit("]]")), F.lit("- none")), F.lit("\n\n## Evidence (1)\n"), F.coalesce(F.concat(F.lit("- `"), at(2), F.lit("` — x")), F.lit("")), F.lit("\n\n## Entities\n- [[entities/"), "lang", F.lit("]]\n\n## Conflicts\n- none\n"))
    pages = own.select(F.concat(F.lit("synthesis/"), i.cast("string"), F.lit(".md")).alias("path"), text.alias("content"), (i % 3 == 0).alias("stale"), F.lit("active").alias("state"))
    return rebuild.rebuild_stale(stored(pages), b, "now")


# ---- the whole route

ROUTE_GROUPS, ROUTE_LANGS = ("de", "fr", "en"), ("en", "de", "fr")
ROUTED = f"""{TREE}, {bm25_sql(TREE_QUERY, 200, ('and', 'or'), name='lex')}, {ROUTE_TABLES},
vecs AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL), q0 AS (SELECT e AS q FROM vecs ORDER BY vec_id LIMIT 1),
near AS (SELECT b.id, round(list_sum(list_transform(list_zip(e, q), lambda p: p[1] * p[2])), 6) AS cosine FROM vecs JOIN blocks b ON b.doc_id = vec_id AND b.ordinal = 0, q0),
vec AS (SELECT id, row_number() OVER (ORDER BY cosine DESC, id) - 1 AS rank FROM near QUALIFY rank < 60),
u AS (SELECT id, 0.8::DOUBLE / (61 + rank) AS s FROM tree UNION ALL SELECT id, 1.0::DOUBLE / (61 + rank) FROM lex UNION ALL SELECT id, 1.0::DOUBLE / (61 + rank) FROM vec),
fused AS (SELECT id, round(sum(s), 9) AS score FROM u GROUP BY id),
att AS (SELECT f.id, f.score, round(coalesce(1.0::DOUBLE / (61 + l.rank), 0), 6) AS s_lexical, round(coalesce(1.0::DOUBLE / (61 + t.rank), 0), 6) AS s_tree, round(coalesce(1.0::DOUBLE / (61 + v.rank), 0), 6) AS s_vector,
  concat_ws(',', CASE WHEN l.id IS NOT NULL THEN 'lexical' END, CASE WHEN t.id IS NOT NULL THEN 'tree' END, CASE WHEN v.id IS NOT NULL THEN 'vector' END) AS matched_by FROM fused f LEFT JOIN lex l USING (id) LEFT JOIN tree t USING (id) LEFT JOIN vec v USING (id)),
r AS (SELECT a.*, b.doc_id, b.doc_path, b.breadcrumb, b.raw, b.layer, b.lang, row_number() OVER (ORDER BY a.score DESC, a.id) AS r0 FROM att a JOIN blocks b USING (id)),
f1 AS (SELECT r.* FROM r LEFT JOIN acls ON doc_path = path WHERE acl IS NULL OR list_has_any(acl, ['de', 'fr', 'en'])),
f2 AS (SELECT f1.*, coalesce(s.state, 'active') AS state FROM f1 LEFT JOIN states s USING (id) WHERE coalesce(s.state, 'active') <> 'retracted'),
f3 AS (SELECT f2.*, CASE WHEN p.state = 'retracted' THEN 2 WHEN p.stale THEN 1 ELSE 0 END AS band FROM f2 LEFT JOIN pages_ p USING (doc_path)),
f4 AS (SELECT *, row_number() OVER (ORDER BY band, r0, id) AS r1 FROM f3 WHERE (band < 2 OR state = 'superseded') AND lang IN ('en', 'de', 'fr')),
f5 AS (SELECT *, row_number() OVER (ORDER BY r1) AS r2 FROM f4 QUALIFY r2 <= 40)"""


@query(f"WITH {ROUTED} SELECT row_number() OVER (ORDER BY layer <> 'raw', r2) - 1 AS rank, id, doc_path, breadcrumb, raw, layer, state, score, s_lexical, s_tree, s_vector, matched_by FROM f5")
def search_full(spark, sf):
    """Lexical, tree and vector channels fused, then access, state with history, disposition, metadata, window, layers."""
    b = blocks(spark, sf)
    lex = stored(text_index(spark, sf).search(TREE_QUERY, 200, ("and", "or")).select("id", "rank"))
    tree = stored(retrieval.tree_search(_sections(b), b, TREE_QUERY))
    e = read(spark, sf, "embeddings").filter("embedding is not null")
    own = e.join(b.filter("ordinal = 0").select("id", F.col("doc_id").alias("vec_id")), "vec_id").select("id", F.col("embedding").alias("vector"))
    vec = stored(retrieval.knn(own, e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("vector")), 60).select("id", "rank"))
    documents = read(spark, sf, "documents").select(_path().alias("path"), F.create_map(F.lit("lang"), F.array("lang")).alias("fm"))
    out = route.route({"lexical": lex, "tree": tree, "vector": vec}, {"lexical": 1.0, "tree": 0.8, "vector": 1.0}, b, _acls(spark, sf), _states(spark, sf, b), _pages(spark, sf), documents, 40, list(ROUTE_GROUPS), ("superseded",), {"lang": list(ROUTE_LANGS)})
    return out.select("rank", "id", "doc_path", "breadcrumb", "raw", "layer", "state", "score", *(F.col(f"scores.{n}").alias(f"s_{n}") for n in ("lexical", "tree", "vector")), F.array_join("matched_by", ",").alias("matched_by"))


@query(f"WITH {ROUTE_TABLES.split(chr(10))[0].rstrip(',')} SELECT path FROM acls WHERE acl IS NULL OR list_has_any(acl, ['de', 'fr', 'en'])")
def visible_paths(spark, sf):
    """Every document that three groups may see."""
    acls = _acls(spark, sf)
    return route.visible_paths(acls.select("path"), acls, list(ROUTE_GROUPS))
