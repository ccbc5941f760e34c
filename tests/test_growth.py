"""What grows with pairs where it need not, and the odd rows of the same queries."""

from pyspark.sql import functions as F

from tessera.operators import compile, containment, lexical


def test_numbers_in_ids_lead_to_few_candidates(spark):
    """Three digits of a number stand in many others: looked up by them, a needle met hundreds of ids."""
    n = 20_000
    texts = spark.range(n).select("id", F.concat(F.lit("p/"), "id", F.lit(".md#sec "), "id").alias("text"))
    needles = spark.range(0, n, 4).select(F.concat(F.lit("ec "), F.col("id").cast("string")).alias("needle")).unionByName(spark.range(n).select(F.concat(F.lit("none "), F.col("id").cast("string")).alias("needle")))
    want = sum(1 for i in range(n) for k in range(1, len(str(i)) + 1) if int(str(i)[:k]) % 4 == 0 and (k == 1 or str(i)[0] != "0"))
    assert containment.contained(needles, texts).count() == want
    assert containment.candidates(needles, texts).count() < 2 * want


def test_concepts_without_a_name_count_too(spark):
    blocks = spark.createDataFrame([("Heat flows heat",), ("ab",), (None,)], "raw string")
    concepts = spark.createDataFrame([("c1", "Reheating; flows-on"), ("c1", "the heat"), (None, "heatflows"), ("c2", "he at")], "concept string, summary string")
    assert [tuple(r) for r in compile.near_concepts(blocks, concepts).collect()] == [("c1", 2), (None, 2)]


def test_places_of_ids_that_stand_twice(spark):
    b = spark.createDataFrame([("a", "x", "red fish red"), ("a", "x", "red"), ("b", "y", "red"), (None, "x", "fish")], "id string, breadcrumb string, raw string")
    got = {(r.term, r.field): (r.n_blocks, r.n_places, r.sum_places) for r in lexical.places(b).collect()}
    assert got[("red", 2)] == (2, 8, 0 + 2 + 3 + 5 + 0 + 1 + 0 + 1) and got[("fish", 2)] == (1, 4, 1 + 4 + 0 + 1)
    assert got[("x", 1)] == (1, 6, 3) and got[("a", 0)] == (1, 2, 0)
