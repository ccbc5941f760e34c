"""Training-data operators: packing, deduplication, scoring, extraction, media and tokenisation.

Nothing outside this subpackage imports it.  ``tessera.llm.registry`` lists its queries."""
