"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, chat, decontaminate, infill, langid, licenses, linededup, mixing, neardup, periodic, suffixdedup, topk, warc

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_line_dedup": linededup.op2_line_dedup,
    "op3_chat_format": chat.op3_chat_format,
    "op4_near_duplicates": neardup.op4_near_duplicates,
    "op5_language_id": langid.op5_language_id,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_warc": warc.op8_warc,
    "op9_top_k": topk.op9_top_k,
    "op10_suffix_dedup": suffixdedup.op10_suffix_dedup,
    "op11_infill": infill.op11_infill,
    "op12_byte_bpe": bpe.op12_byte_bpe,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}
SQL = {
    "op1_license_scan": licenses.OP1_SQL,
    "op2_line_dedup": linededup.OP2_SQL,
    "op3_chat_format": chat.OP3_SQL,
    "op4_near_duplicates": neardup.OP4_SQL,
    "op6_decontaminate": decontaminate.OP6_SQL,
    "op7_mix_sources": mixing.OP7_SQL,
    "op8_warc": warc.OP8_SQL,
    "op9_top_k": topk.OP9_SQL,
    "op10_suffix_dedup": suffixdedup.OP10_SQL,
    "op11_infill": infill.OP11_SQL,
    "op13_periodic_runs": periodic.OP13_SQL,
}
