"""Registered queries of the corpus operators and their SQL: name -> callable(spark, sf_dir), name -> DuckDB SQL."""

from __future__ import annotations

from tabflow.llm import (crosspoly, filteraudit, hilbertpq, jaccard, langid, linededup, mixing, packing, quality, substrings,
                         syncmers, tokenfile, warc)

QUERIES = {
    "op1_tokenfile": tokenfile.op1_tokenfile,
    "op2_warc": warc.op2_warc,
    "op3_mixing": mixing.op3_mixing,
    "op4_linededup": linededup.op4_linededup,
    "op5_quality": quality.op5_quality,
    "op6_syncmers": syncmers.op6_syncmers,
    "op7_langid": langid.op7_langid,
    "op8_crosspoly": crosspoly.op8_crosspoly,
    "op9_packing": packing.op9_packing,
    "op10_jaccard": jaccard.op10_jaccard,
    "op11_filteraudit": filteraudit.op11_filteraudit,
    "op12_substrings": substrings.op12_substrings,
    "op13_hilbertpq": hilbertpq.op13_hilbertpq,
}
ORACLE = {
    "op2_warc": warc.OP2_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op4_linededup": linededup.OP4_SQL,
    "op8_crosspoly": crosspoly.OP8_SQL,
    "op10_jaccard": jaccard.OP10_SQL,
    "op11_filteraudit": filteraudit.OP11_SQL,
    "op12_substrings": substrings.OP12_SQL,
    "op13_hilbertpq": hilbertpq.OP13_SQL,
}
