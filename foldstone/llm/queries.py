"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from . import (
    ann_tree, cover_codes, langid, mixing, mtree, piece_fst, positional_index, prefix_trie, secret_scan, simhash, toxicity, warc, wrappers,
)

QUERIES = {
    "op1_ann": ann_tree.op1_ann,
    "op2_main_text": wrappers.op2_main_text,
    "op3_langid": langid.op3_langid,
    "op4_secrets": secret_scan.op4_secrets,
    "op5_mix": mixing.op5_mix,
    "op6_simhash": simhash.op6_simhash,
    "op7_revisits": warc.op7_revisits,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_pieces": piece_fst.op9_pieces,
    "op10_topk": mtree.op10_topk,
    "op11_codes": cover_codes.op11_codes,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_decontaminate": positional_index.op13_decontaminate,
}
ORACLES = {
    "op4_secrets": secret_scan.oracle(),
    "op7_revisits": warc.ORACLE,
    "op10_topk": mtree.ORACLE,
    "op11_codes": cover_codes.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
    "op13_decontaminate": positional_index.ORACLE,
}
