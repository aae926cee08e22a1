"""The queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from . import collisions, collocations, ctw, decontaminate, langid, licenses, linededup, merkle, mixing, secrets, simhash, topk, warc

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_linededup": linededup.op2_linededup,
    "op3_langid": langid.op3_langid,
    "op4_licenses": licenses.op4_licenses,
    "op5_secrets": secrets.op5_secrets,
    "op6_ctw": ctw.op6_ctw,
    "op7_warc": warc.op7_warc,
    "op8_simhash": simhash.op8_simhash,
    "op9_topk": topk.op9_topk,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_collisions": collisions.op11_collisions,
    "op12_merkle": merkle.op12_merkle,
    "op13_collocations": collocations.op13_collocations,
}
ORACLE_SQL = {
    "op1_mixing": mixing.SQL,
    "op2_linededup": linededup.SQL,
    "op7_warc": warc.SQL,
    "op9_topk": topk.SQL,
    "op10_decontaminate": decontaminate.SQL,
    "op11_collisions": collisions.SQL,
    "op12_merkle": merkle.SQL,
    "op13_collocations": collocations.SQL,
}
