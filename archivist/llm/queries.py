"""The registered queries of this subpackage and their SQL."""

from archivist.llm import fingerprints, hard_negatives, mixing, ngram_join, packing, passage_dedup, pseudo_likelihood, records, spelling, token_counts, toxicity, url_filter, vector_dedup

MODULES = [records, pseudo_likelihood, packing, fingerprints, mixing, vector_dedup, toxicity, passage_dedup, token_counts, ngram_join, url_filter, spelling, hard_negatives]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: q for m in MODULES for k, q in m.SQL.items()}
