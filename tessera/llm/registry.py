"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm._shared import table

VOCABULARY = "word_bpe_49k.json"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_packing(spark, sf_dir):
    """All documents packed into sequences of 2048 tokens along a Hilbert curve."""
    from tessera.llm.packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_line_dedup(spark, sf_dir):
    """Lines found in at least 10 documents removed everywhere."""
    from tessera.llm.lines import apply_bitmaps, keep_bitmaps

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = apply_bitmaps(docs, keep_bitmaps(docs, min_docs=10, min_key=1))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
frequent AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f USING (k) GROUP BY doc_id
"""


def op8_tiff(spark, sf_dir):
    """Every text stored as a TIFF, read back page by page and hashed."""
    from tessera.llm.tiff import payload_digests, text_to_tiff, tiff_pages

    return payload_digests(tiff_pages(text_to_tiff(table(spark, sf_dir, "documents"))))


def op9_bpe(spark, sf_dir):
    """Every text encoded and decoded with the word-level vocabulary."""
    from tessera.llm.bpe import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"), vocabulary())


QUERIES = {f.__name__: f for f in (op1_packing, op2_line_dedup, op8_tiff, op9_bpe)}
ORACLES = {"op2_line_dedup": OP2_SQL}


def op6_toxicity(spark, sf_dir):
    """Toxicity of every document from its significant toxic passages."""
    from tessera.llm import toxicity
    from tessera.llm._shared import id_remainder

    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.withColumn("held_out", id_remainder("doc_id", 5) == 0).select("doc_id", "held_out", "score", "predicted", "passage_start", "passage_end", "passages")


def op10_language(spark, sf_dir):
    """Language of every document by a bidirectional recurrent network over bytes."""
    from tessera.llm import langid
    from tessera.llm._shared import id_remainder

    docs = table(spark, sf_dir, "documents")
    return langid.label_documents(docs, langid.fit(docs)).withColumn("held_out", id_remainder("doc_id", 4) == 2).select("doc_id", "held_out", "lang_pred", "score")


QUERIES |= {f.__name__: f for f in (op6_toxicity, op10_language)}


def op7_html(spark, sf_dir):
    """The main text of every page, by its host's wrapper."""
    from tessera.llm import html

    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.wrappers(pages))


QUERIES |= {f.__name__: f for f in (op7_html,)}


def op5_jaccard(spark, sf_dir):
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    from tessera.llm.jaccard import similar_documents

    return similar_documents(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


QUERIES |= {f.__name__: f for f in (op5_jaccard,)}


def op3_vectors(spark, sf_dir):
    """Links and components of vectors with a cosine of 0.9 or more."""
    from tessera.llm.vectors import similar_vectors

    return similar_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


QUERIES |= {f.__name__: f for f in (op3_vectors,)}


def op4_hpylm(spark, sf_dir):
    """Every document scored by the hierarchical Pitman-Yor model."""
    from tessera.llm.hpylm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


QUERIES |= {f.__name__: f for f in (op4_hpylm,)}


def op12_whitening(spark, sf_dir):
    """Every usable vector on the first four whitened components of the distinct ones."""
    from tessera.llm import whitening

    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit_whitening(vectors)).withColumn("deviation", F.col("deviation").cast("bigint"))


QUERIES |= {f.__name__: f for f in (op12_whitening,)}

#: Host, path and verdict of the rules that the query applies (fixed by its contract).
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op13_urls(spark, sf_dir):
    """Every page's URL judged by the longest rule that fits its host and path."""
    from tessera.llm.urls import judge

    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


OP13_SQL = rf"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
rules(h, p, v) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
pairs AS (SELECT DISTINCT host, path FROM parts),
best AS (
  SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM pairs JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (host, path)
"""

QUERIES |= {f.__name__: f for f in (op13_urls,)}
ORACLES |= {"op13_urls": OP13_SQL}


def op11_trie(spark, sf_dir):
    """The prefix trie of all conversations, rebuilt so that families share their first turns."""
    from tessera.llm.trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


# The checksum bit by bit: SQL has none of its own.  A node's key is the digest of its turns' digests.
CRC32_SQL = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"
OP11_SQL = f"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, count(*) AS n, {CRC32_SQL} % 6 AS h FROM turns GROUP BY c),
convs AS (SELECT own.c, own.h, own.c - own.c % 100 AS family, least(own.h, coalesce(f.n, 0)) AS taken FROM own LEFT JOIN own f ON f.c = own.c - own.c % 100),
rebuilt AS (
  SELECT c, taken + pos - h AS d, role, text FROM turns JOIN convs USING (c) WHERE pos > h
  UNION ALL SELECT convs.c, pos, role, text FROM turns t JOIN convs ON t.c = family WHERE pos <= taken),
walks AS (SELECT c, d, length(text) AS size, md5(string_agg(md5(role) || md5(text), '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)) AS node FROM rebuilt
  UNION ALL SELECT c, 0, 0, '' FROM convs),
steps AS (SELECT *, lag(node) OVER (PARTITION BY c ORDER BY d) AS parent, lead(node) OVER (PARTITION BY c ORDER BY d) IS NULL AS last FROM walks),
nodes AS (SELECT d, node, any_value(parent) AS parent, min(c) AS c, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
  sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends_sha256 FROM steps GROUP BY d, node),
kids AS (SELECT d - 1 AS d, parent AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (d, node)),
sums AS (SELECT w.d, w.node, sum(f.saved)::BIGINT AS saved, count(*) FILTER (f.n_children = 0) AS leaves FROM full_ f JOIN walks w ON w.c = f.c AND w.d <= f.d GROUP BY w.d, w.node)
SELECT f.c AS conv_id, f.d AS depth, p.c AS parent_conv_id, f.n_convs, f.n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, f.ends_sha256
FROM full_ f JOIN sums s USING (d, node) LEFT JOIN nodes p ON p.d = f.d - 1 AND p.node = f.parent
"""

QUERIES |= {f.__name__: f for f in (op11_trie,)}
ORACLES |= {"op11_trie": OP11_SQL}
