"""The operators' queries and their SQL, by name."""

from __future__ import annotations

from functools import wraps

from siftwell.llm import bpe, exact, fingerprints, jaccard_join, lines, packing, pii, quality, secrets, toxicity
from siftwell.session import ship


def _shipped(query):
    @wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _shipped(query) for name, query in _queries().items()}


def _queries() -> dict:
    return {
        "op1_bpe_transducer": bpe.op1,
        "op2_weighted_fingerprints": fingerprints.op2,
        "op3_jaccard_join": jaccard_join.op3,
        "op4_quality_network": quality.op4,
        "op5_line_chunks": lines.op5,
        "op6_personal_data": pii.op6,
        "op7_exact_dedup": exact.op7,
        "op8_secret_ledger": secrets.op8,
        "op9_best_fit_packing": packing.op9,
        "op10_toxicity_subwords": toxicity.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_line_chunks": lines.OP5_SQL, "op7_exact_dedup": exact.OP7_SQL}
