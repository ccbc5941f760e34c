"""Queries: blocks, text functions, full-text search, vectors, fusion."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import lexical, lifecycle, retrieval
from tessera.plans.base import BLOCKS, TURNS, blocks, bm25_sql, hash_sql, query, read, text_index, tokens_sql, mirror_sql, turns
from tessera.session import shared_folder, stored

WIDE = "heatly thorea tionnt ofthe eneaor"
NARROW = "the heat"
MIXED = "the qqqzzz that"


@query(f"WITH {BLOCKS}, {bm25_sql(WIDE, 50, ('or',))} SELECT h.rank, h.id, h.score, b.doc_path, b.raw FROM hits h JOIN blocks b USING (id)")
def bm25_or_topk(spark, sf):
    """From the stored index alone: the postings of the terms, then the texts of the hits; an id begins with its document."""
    hits = text_index(spark, sf).hits(WIDE, 50, ("or",))
    return hits.select("rank", "id", "score", F.regexp_extract("id", r"^(.*/-?[0-9]+)#", 1).alias("doc_path"), "raw")


@query(f"WITH {BLOCKS}, {bm25_sql(NARROW, 50, ('and',))} SELECT id, score, rank FROM hits")
def bm25_and(spark, sf):
    return lexical.bm25(blocks(spark, sf), NARROW, 50, ("and",)).select("id", "score", "rank")


@query(f"WITH {BLOCKS}, {bm25_sql(MIXED, 50)} SELECT id, score, rung, rank FROM hits")
def bm25_ladder(spark, sf):
    return text_index(spark, sf).search(MIXED, 50)


@query(f"WITH {BLOCKS}, {bm25_sql('The That heat', 200, ('or',))} SELECT id, score, rank FROM hits")
def bm25_minmatch(spark, sf):
    return text_index(spark, sf).search("The That heat", 200, ("or",)).select("id", "score", "rank")


HAN = ("eat", "中文本")


@query(f"WITH {BLOCKS}, han AS (SELECT * REPLACE (translate(raw, '{HAN[0]}', '{HAN[1]}') AS raw) FROM blocks), {bm25_sql('中文本 文中', 50, ('and', 'or', 'terms'), 'han')} SELECT id, score, rung, rank FROM hits")
def bm25_phrase(spark, sf):
    return lexical.bm25(blocks(spark, sf).withColumn("raw", F.translate("raw", *HAN)), "中文本 文中", 50)


@query(f"WITH {BLOCKS}, t AS (SELECT id, unnest(list_concat({tokens_sql('id')}, {tokens_sql(mirror_sql('breadcrumb'))}, {tokens_sql(mirror_sql('raw'))})) AS term FROM blocks), p AS (SELECT term, id, count(*) AS tf FROM t GROUP BY ALL) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY term")
def term_df_stats(spark, sf):
    return lexical.postings(blocks(spark, sf)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"""WITH {BLOCKS}, f AS (SELECT id, unnest([0, 1, 2])::BIGINT AS field, unnest([{tokens_sql('id')}, {tokens_sql(mirror_sql('breadcrumb'))}, {tokens_sql(mirror_sql('raw'))}]) AS tokens FROM blocks),
t AS (SELECT id, field, unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS pos FROM f)
SELECT term, field, count(DISTINCT id) AS n_blocks, count(*) AS n_places, sum(pos)::BIGINT AS sum_places FROM t GROUP BY term, field""")
def posting_places(spark, sf):
    return lexical.places(blocks(spark, sf))


def _by_index(spark, b, q, limit, rungs):
    """The hits of one search of a stored index, which is built for it and deleted after."""
    index = lexical.Index.build(b, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    try:
        return stored(index.search(q, limit, rungs))
    finally:
        index.drop()


@query(f"WITH {BLOCKS}, {bm25_sql(MIXED, 50)} SELECT id, score, rung, rank FROM hits")
def index_search(spark, sf):
    return _by_index(spark, blocks(spark, sf), MIXED, 50, ("and", "or", "terms"))


@query(f"WITH {BLOCKS}, han AS (SELECT * REPLACE (translate(raw, '{HAN[0]}', '{HAN[1]}') AS raw) FROM blocks), {bm25_sql('中文本 文中', 50, ('and', 'or', 'terms'), 'han')} SELECT id, score, rung, rank FROM hits")
def index_search_phrase(spark, sf):
    return _by_index(spark, blocks(spark, sf).withColumn("raw", F.translate("raw", *HAN)), "中文本 文中", 50, ("and", "or", "terms"))


@query(f"WITH {BLOCKS} SELECT coalesce(sum(length(raw)), 0)::BIGINT AS chars FROM blocks")
def corpus_size(spark, sf):
    return retrieval.corpus_size(blocks(spark, sf))


@query(f"WITH {TURNS} SELECT id, doc_path, ordinal FROM turns WHERE (SELECT sum(length(raw)) FROM turns) <= 1000000000000")
def full_corpus(spark, sf):
    return retrieval.full_corpus(turns(spark, sf), 10**12)


@query(f"WITH {TURNS} SELECT id, doc_path, ordinal FROM turns WHERE (SELECT sum(length(raw)) FROM turns) <= 1")
def full_corpus_refused(spark, sf):
    return retrieval.full_corpus(turns(spark, sf), 1)


@query(f"WITH {BLOCKS} SELECT id, doc_path, section_id, breadcrumb, raw, ordinal, layer FROM blocks")
def block_split(spark, sf):
    return blocks(spark, sf).select("id", "doc_path", "section_id", "breadcrumb", "raw", "ordinal", "layer")


@query(rf"""WITH {BLOCKS}, x AS (SELECT id, CASE doc_id % 3 WHEN 0 THEN '- ' || raw WHEN 1 THEN '1. ' || raw || chr(10) || '* b' ELSE raw END AS t FROM blocks)
SELECT id, CASE WHEN contains(t, '|') THEN 'table' WHEN len(list_filter(string_split(t, chr(10)), lambda s: NOT (regexp_matches(s, '^[-*+] ') OR (regexp_matches(s, '^[0-9]') AND contains(s, '. '))))) = 0 THEN 'list' ELSE 'paragraph' END AS type FROM x""")
def block_types(spark, sf):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("- "), "raw")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("1. "), "raw", F.lit("\n* b"))).otherwise(F.col("raw"))
    return blocks(spark, sf).select("id", X.block_type(t).alias("type"))


@query(f"WITH {BLOCKS} SELECT id, {hash_sql('breadcrumb || chr(10) || raw')} AS hash FROM blocks")
def content_hash(spark, sf):
    return blocks(spark, sf).select("id", X.content_hash(F.concat("breadcrumb", F.lit("\n"), "raw")).alias("hash"))


@query(f"WITH {BLOCKS}, t AS (SELECT id, {tokens_sql('raw')} AS t FROM blocks) SELECT id, len(t) AS n_terms, coalesce(t[1], '') AS first_term FROM t")
def query_terms(spark, sf):
    return blocks(spark, sf).select("id", X.tokens("raw").alias("t")).select("id", F.size("t").alias("n_terms"), F.coalesce(F.get("t", F.lit(0)), F.lit("")).alias("first_term"))


@query(rf"""WITH {BLOCKS}, s AS (SELECT id, list_filter(list_transform(string_split(regexp_replace(replace(raw, '.', '!'), '([。！？；!?;])\s*', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS s FROM blocks)
SELECT id, len(s) AS n_sentences, coalesce(s[1], '') AS first_sentence FROM s""")
def sentence_split(spark, sf):
    return blocks(spark, sf).select("id", X.sentences(F.replace("raw", F.lit("."), F.lit("!"))).alias("s")).select("id", F.size("s").alias("n_sentences"), F.coalesce(F.get("s", F.lit(0)), F.lit("")).alias("first_sentence"))


@query(rf"""WITH {BLOCKS}, s AS (SELECT id, lower(regexp_replace(regexp_replace(raw, '[^\p{{L}}\p{{N}}]', '-', 'g'), '^-+|-+$', '', 'g')) AS s FROM blocks)
SELECT id, CASE WHEN s = '' THEN 'entity' ELSE s END AS slug FROM s""")
def slugify(spark, sf):
    return blocks(spark, sf).select("id", X.slug("raw").alias("slug"))


@query(f"WITH {BLOCKS} SELECT doc_path AS doc, sha256(string_agg({hash_sql('raw')}, '|' ORDER BY ordinal)) AS fp FROM blocks GROUP BY doc_path")
def doc_fingerprint(spark, sf):
    return lifecycle.fingerprints(blocks(spark, sf))


KNN = """v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q AS (SELECT id AS query, e AS q FROM v WHERE id % 20 = 0),
near AS (SELECT query, id, round(list_sum(list_transform(list_zip(e, q), lambda p: p[1] * p[2])), 6) AS cosine FROM v, q),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) - 1 AS rank FROM near) WHERE rank < 40)"""


@query(f"WITH {KNN} SELECT * FROM knn")
def knn_topk(spark, sf):
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieval.knn_many(e, e.filter("id % 20 = 0"), 40)


LISTS = f"WITH {BLOCKS}, {bm25_sql(WIDE, 60, ('or',), name='a')}, {bm25_sql(NARROW, 60, ('or',), name='b')}"


def _lists(spark, sf):
    index = text_index(spark, sf)
    return index.search(WIDE, 60, ("or",)), index.search(NARROW, 60, ("or",))


@query(f"{LISTS}, u AS (SELECT id, 1.0::DOUBLE / (60 + rank + 1) AS s FROM a UNION ALL SELECT id, 1.0::DOUBLE / (60 + rank + 1) FROM b) SELECT id, round(sum(s), 9) AS score FROM u GROUP BY id")
def rrf_two_lists(spark, sf):
    a, b = _lists(spark, sf)
    return retrieval.rrf([(a, 1.0), (b, 1.0)])


@query(f"{LISTS}, u AS (SELECT id, 0.8::DOUBLE / (60 + rank + 1) AS s FROM a UNION ALL SELECT id, 1.0::DOUBLE / (60 + rank + 1) FROM b) SELECT id, round(sum(s), 9) AS score FROM u GROUP BY id")
def rrf_weighted(spark, sf):
    a, b = _lists(spark, sf)
    return retrieval.rrf([(a, 0.8), (b, 1.0)])


TREE_QUERY = "the that heat onthe"
SECTIONS = f"""{BLOCKS}, sections AS (SELECT section_id AS id, any_value(breadcrumb) AS title, substr(arg_min(raw, ordinal), 1, 160) AS summary FROM blocks GROUP BY section_id)"""
TREE = rf"""{SECTIONS}, scored AS (SELECT id, round(len(list_intersect(list_distinct(regexp_split_to_array(lower(title || ' ' || summary), '{X.SPACE}')), ['heat', 'onthe', 'that', 'the'])) / 4.0::DOUBLE, 6) AS score FROM sections),
best AS (SELECT id AS section_id, row_number() OVER (ORDER BY score DESC, id) AS sr FROM (SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, id LIMIT 3)),
tree AS (SELECT b.id, row_number() OVER (ORDER BY sr, ordinal, b.id) - 1 AS rank FROM blocks b JOIN best USING (section_id))"""


def _sections(b):
    return b.groupBy(F.col("section_id").alias("id")).agg(F.first("breadcrumb").alias("title"), F.substring(F.min_by("raw", "ordinal"), 1, 160).alias("summary"))


@query(f"WITH {SECTIONS} SELECT id, title, summary FROM sections")
def section_summaries(spark, sf):
    return _sections(blocks(spark, sf))


@query(f"WITH {TREE} SELECT id, rank FROM tree")
def tree_search(spark, sf):
    b = blocks(spark, sf)
    return retrieval.tree_search(_sections(b), b, TREE_QUERY)


FUSED = f"WITH {TREE}, {bm25_sql(TREE_QUERY, 60, ('and', 'or'), name='lex')}, u AS (SELECT id, 0.8::DOUBLE / (61 + rank) AS s FROM tree UNION ALL SELECT id, 1.0::DOUBLE / (61 + rank) FROM lex), fused AS (SELECT id, round(sum(s), 9) AS score FROM u GROUP BY id)"
ATTRIBUTED = f"""{FUSED}, att AS (SELECT f.id, f.score, round(coalesce(1.0::DOUBLE / (61 + l.rank), 0), 6) AS s_lexical, round(coalesce(1.0::DOUBLE / (61 + t.rank), 0), 6) AS s_tree,
  CASE WHEN l.id IS NOT NULL AND t.id IS NOT NULL THEN 'lexical,tree' WHEN l.id IS NOT NULL THEN 'lexical' ELSE 'tree' END AS matched_by
  FROM fused f LEFT JOIN lex l USING (id) LEFT JOIN tree t USING (id))"""


def _attributed(spark, sf):
    b = blocks(spark, sf)
    tree = retrieval.tree_search(_sections(b), b, TREE_QUERY)
    lex = stored(text_index(spark, sf).search(TREE_QUERY, 60, ("and", "or")))
    fused = retrieval.rrf([(tree, 0.8), (lex, 1.0)])
    return b, retrieval.attributed(fused, {"lexical": lex, "tree": tree}).withColumn("matched_by", F.array_join("matched_by", ","))


@query(f"{ATTRIBUTED} SELECT id, score, s_lexical, s_tree, matched_by FROM att")
def channel_attribution(spark, sf):
    return _attributed(spark, sf)[1].select("id", "score", "s_lexical", "s_tree", "matched_by")


@query(f"""{ATTRIBUTED}, win AS (SELECT * FROM att ORDER BY score DESC, id LIMIT 30), r AS (SELECT w.*, b.doc_path, b.breadcrumb, b.raw, b.layer, row_number() OVER (ORDER BY score DESC, w.id) - 1 AS r0 FROM win w JOIN blocks b USING (id))
SELECT id, doc_path, breadcrumb, raw, layer, score, s_lexical, s_tree, matched_by, row_number() OVER (ORDER BY layer <> 'raw', r0) - 1 AS rank FROM r""")
def retrieve_all(spark, sf):
    b, att = _attributed(spark, sf)
    win = retrieval.ranked(att.orderBy(F.desc("score"), "id").limit(30))
    rows = b.select("id", "doc_path", "breadcrumb", "raw", "layer").join(F.broadcast(win), "id")
    return retrieval.source_first(rows).select("id", "doc_path", "breadcrumb", "raw", "layer", "score", "s_lexical", "s_tree", "matched_by", "rank")
