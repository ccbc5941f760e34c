"""From ranked evidence to a checked answer."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.functions import text as X


def grade_terms(rows: DataFrame, query: str) -> DataFrame:
    """verdict: evidence_absent without rows, enough where a term lies in the first characters of the evidence, else missing."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "raw"))), lambda x: F.lower(x["raw"])), "\n")
    one = rows.agg(F.count("*").alias("n"), F.substring(joined, 1, S.GRADE_CHARS).alias("t"))
    hit = F.lit(False)
    for t in X.query_terms(query):
        hit = hit | X.term_present("t", t.lower())
    return one.select(F.when(F.col("n") == 0, "evidence_absent").when(hit, "enough").otherwise("missing").alias("verdict"))


def grade_chars(rows: DataFrame, query: str) -> DataFrame:
    """The same by single characters: Han characters one by one, other terms whole."""
    hits = sum((F.max(F.lower("raw").contains(t.lower()).cast("int")) for t in dict.fromkeys(X.single_terms(query))), F.lit(0))
    return rows.agg(F.count("*").alias("n"), hits.alias("h")).select(F.when(F.col("n") == 0, "evidence_absent").when(F.coalesce("h", F.lit(0)) > 0, "enough").otherwise("missing").alias("verdict"))


def piece():
    return F.concat(F.lit("["), "id", F.lit("] "), "breadcrumb", F.lit("\n"), "raw")


def assemble(rows: DataFrame, budget: int = S.CONTEXT_CHARS, least: int = 120) -> DataFrame:
    """rank, piece: whole pieces while the budget holds; the first that doesn't fit is cut where over `least` remain."""
    w = Window.orderBy("rank")
    run = rows.withColumn("piece", piece()).withColumn("end", F.sum(F.length("piece")).over(w))
    run = run.withColumn("left", F.lit(budget) - (F.col("end") - F.length("piece"))).withColumn("over", F.sum((F.col("end") > budget).cast("int")).over(w))
    keep = (F.col("over") == 0) | ((F.col("over") == 1) & (F.col("left") > least))
    return run.filter(keep).select("rank", F.when(F.col("over") == 0, F.col("piece")).otherwise(F.expr("substring(piece, 1, int(left))")).alias("piece"))


def escalate(rows: DataFrame, query: str) -> DataFrame:
    """Of a wider window, the rows that hold a term of the query: a run of two Han characters or more, or a run of ASCII
    letters and digits.  Scripts that touch are terms of their own."""
    hit = F.lit(False)
    for t in re.findall(r"[\u4e00-\u9fff]{2,}|[0-9A-Za-z]+", query):
        hit = hit | F.lower("raw").contains(t.lower())
    return rows.filter(hit)


def extractive_answer(rows: DataFrame, stale: DataFrame | None = None, top: int = 3, chars: int = 180) -> DataFrame:
    """answer: the first rows' snippets with their citations, stale ones marked; a refusal without rows."""
    few = rows.filter(F.col("rank") < top)
    if stale is not None:
        few = few.join(stale.select("doc_path", F.lit(True).alias("stale_")), "doc_path", "left")
    else:
        few = few.withColumn("stale_", F.lit(False))
    s = F.concat(F.substring(F.regexp_replace("raw", "\n", " "), 1, chars), F.lit(" [["), "id", F.lit("]]"), F.when(F.coalesce("stale_", F.lit(False)), F.lit(" (stale)")).otherwise(F.lit("")))
    got = few.withColumn("s_", s).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("s_").alias("s")))), lambda x: x["s"]), "\n").alias("answer"), F.count("*").alias("n"))
    return got.select(F.when(F.col("n") == 0, F.lit(S.REFUSAL)).otherwise(F.col("answer")).alias("answer"), F.col("n").alias("n_evidence"))


def citation_coverage(answers: DataFrame, text: str = "answer") -> DataFrame:
    """The rows with `cited` and `total` sentences."""
    s = X.sentences(text)
    return answers.withColumn("total", F.size(s)).withColumn("cited", F.size(F.filter(s, X.has_citation)))


def check_contracts(answers: DataFrame) -> DataFrame:
    """The rows with `violations`: a sentence without a citation; no evidence and no refusal."""
    c = citation_coverage(answers)
    cite = F.when(F.col("cited") < F.col("total"), F.concat(F.lit("citation "), "cited", F.lit("/"), "total", F.lit(" sentences cited")))
    refuse = F.when((F.col("n_evidence") == 0) & ~X.is_refusal("answer"), F.lit("refusal"))
    return c.withColumn("violations", F.filter(F.array(cite, refuse), lambda x: x.isNotNull()))
