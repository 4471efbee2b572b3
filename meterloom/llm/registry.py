"""The queries of this subpackage by name, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from . import bpe_sql, cotrain, digest, exponion, merkle, ppm, range_ans, secret_ledger, sharding, simhash_vp, style_tree, superkmer, tiling


def queries() -> dict:
    return {
        "op1_string_tiling": tiling.query,
        "op2_secret_ledger": secret_ledger.query,
        "op3_bpe_sql": bpe_sql.query,
        "op4_simhash_vp": simhash_vp.query,
        "op5_ppm": ppm.query,
        "op6_cotraining": cotrain.query,
        "op7_range_ans_files": range_ans.query,
        "op8_sharding": sharding.query,
        "op9_style_tree": style_tree.query,
        "op10_canonical_digest": digest.query,
        "op11_super_kmers": superkmer.query,
        "op12_fractal_merkle": merkle.query,
        "op13_exponion_codes": exponion.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_secret_ledger": secret_ledger.oracle_sql(), "op11_super_kmers": superkmer.oracle_sql(),
        "op12_fractal_merkle": merkle.oracle_sql(), "op13_exponion_codes": exponion.oracle_sql(),
    }
