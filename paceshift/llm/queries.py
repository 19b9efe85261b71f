"""The corpus queries, each over the whole of its tables, and the SQL that checks those SQL can express."""

from __future__ import annotations

from paceshift.llm import (
    collocations,
    exact_index,
    lattice_hash,
    lm_scoring,
    mixing,
    order_minhash,
    packing,
    periodic_runs,
    quality,
    secret_scan,
    simhash,
    suffix_dedup,
    url_rules,
)

QUERIES = {
    "op1_lm_scoring": lm_scoring.query,
    "op2_url_filter": url_rules.query,
    "op3_suffix_dedup": suffix_dedup.query,
    "op4_near_duplicates": order_minhash.query,
    "op5_secret_scan": secret_scan.query,
    "op6_simhash": simhash.query,
    "op7_mix_sources": mixing.query,
    "op8_quality": quality.query,
    "op9_packing": packing.query,
    "op10_near_vectors": lattice_hash.query,
    "op11_exact_index": exact_index.query,
    "op12_collocations": collocations.query,
    "op13_periodic_runs": periodic_runs.query,
}
ORACLES = {"op2_url_filter": url_rules.ORACLE, "op7_mix_sources": mixing.ORACLE, "op11_exact_index": exact_index.ORACLE, "op12_collocations": collocations.ORACLE}
