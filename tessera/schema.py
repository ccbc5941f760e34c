"""Fixed values of the data model: enumerations, weights and limits."""

from __future__ import annotations

from pyspark.sql import types as T

# States, confidence ladder, edge kinds with base weights, channel weights, limits.
HIDDEN_STATES = ("superseded", "retracted")
STATES = ("active", "superseded", "disputed", "retracted", "draft")
CONFIDENCE = {"draft": 0.0, "medium": 0.5, "high": 1.0}
EDGE_WEIGHTS = {"wikilink": 1.0, "wikilink-unresolved": 0.0, "same-section": 0.5, "same-doc": 0.2}
RRF_K = 60
GRAPH_GAIN = 0.12 * 10
CHANNEL_WEIGHTS = {"vector": 1.0, "lexical": 1.0, "tree": 0.8}
DAMPING, ROUNDS, TOLERANCE, HOPS, FRONTIER, SEEDS = 0.85, 20, 1e-6, 2, 500, 50
FULL_CORPUS_CHARS, CONTEXT_CHARS, GRADE_CHARS = 200_000, 6_000, 2_000
BM25_K1, BM25_B, IDF_FLOOR = 1.2, 0.75, 1e-6
REFUSAL = "资料中未涉及"

DOCUMENT = T.StructType([T.StructField("path", T.StringType()), T.StructField("text", T.StringType()), T.StructField("layer", T.StringType())])
EVIDENCE_COLUMNS = ["rank", "id", "doc_path", "breadcrumb", "raw"]
