"""The numbered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_tree, dual_tree, exact_dedup, hash_tree, license_scan, nn_descent, pack, partenum, pfair_mix, piece_bpe, quality_fm, turn_repair, url_reputation


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": license_scan.op1_license_scan,
        "op2_nn_descent": nn_descent.op2_nn_descent,
        "op3_quality_fm": quality_fm.op3_quality_fm,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_url_reputation": url_reputation.op5_url_reputation,
        "op6_chat_trees": chat_tree.op6_chat_trees,
        "op7_pfair_mix": pfair_mix.op7_pfair_mix,
        "op8_pack_ids": pack.op8_pack_ids,
        "op9_partenum_join": partenum.op9_partenum_join,
        "op10_piece_bpe": piece_bpe.op10_piece_bpe,
        "op11_turn_repair": turn_repair.op11_turn_repair,
        "op12_dual_tree": dual_tree.op12_dual_tree,
        "op13_hash_tree": hash_tree.op13_hash_tree,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": exact_dedup.ORACLE, "op5_url_reputation": url_reputation.ORACLE, "op6_chat_trees": chat_tree.ORACLE, "op11_turn_repair": turn_repair.ORACLE, "op12_dual_tree": dual_tree.ORACLE, "op13_hash_tree": hash_tree.ORACLE}
