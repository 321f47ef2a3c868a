"""Queries of this subpackage, and SQL for those that SQL can express."""

from . import brown_lm, chat_events, chunk_bpe, cotraining, divergence_audit, exact_dedup, fill_in_middle, license_scan, packing, partenum, quality_rules, repeated_windows, secret_ledger

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_packing": packing.query,
    "op3_chat_events": chat_events.query,
    "op4_brown_lm": brown_lm.query,
    "op5_secret_ledger": secret_ledger.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_cotraining": cotraining.query,
    "op8_repeated_windows": repeated_windows.query,
    "op9_chunk_bpe": chunk_bpe.query,
    "op10_partenum": partenum.query,
    "op11_license_scan": license_scan.query,
    "op12_fill_in_middle": fill_in_middle.query,
    "op13_divergence_audit": divergence_audit.query,
}
SQL = {"op6_exact_dedup": exact_dedup.SQL, "op12_fill_in_middle": fill_in_middle.SQL, "op13_divergence_audit": divergence_audit.SQL}
