"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from wardcraft.llm import audit, decontaminate, e8, exact, langid, licences, nbest, quality, repair, secrets, simhash, token_files, warc

QUERIES = {
    "op1_tokens": token_files.op1_tokens,
    "op2_warc": warc.op2_warc,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_quality": quality.op4_quality,
    "op5_secrets": secrets.op5_secrets,
    "op6_licences": licences.op6_licences,
    "op7_simhash": simhash.op7_simhash,
    "op8_exact": exact.op8_exact,
    "op9_sentencepiece": nbest.op9_sentencepiece,
    "op10_langid": langid.op10_langid,
    "op11_lattice": e8.op11_lattice,
    "op12_repair": repair.op12_repair,
    "op13_audit": audit.op13_audit,
}
ORACLE_SQL = {"op2_warc": warc.OP2_SQL, "op8_exact": exact.OP8_SQL, "op13_audit": audit.OP13_SQL}
