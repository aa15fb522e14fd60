"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from . import bpe, content_sort, hilbert, language_id, license_scan, pii, prob_minhash, quality_rules, secret_scan, vector_packing

QUERIES = {
    "op1_vector_packing": vector_packing.query,
    "op2_pii_surrogates": pii.query,
    "op3_content_sort": content_sort.query,
    "op4_hilbert_neighbours": hilbert.query,
    "op5_license_scan": license_scan.query,
    "op6_secret_scan": secret_scan.query,
    "op7_language_id": language_id.query,
    "op8_prob_minhash": prob_minhash.query,
    "op9_prefix_bpe": bpe.query,
    "op10_quality_rules": quality_rules.query,
    "packing_of_conversations": vector_packing.query_conversations,
}
ORACLE_SQL = {"op3_content_sort": content_sort.ORACLE}
