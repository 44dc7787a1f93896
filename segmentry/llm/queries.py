"""Queries of the training-data operators and their SQL, as the entry module registers them."""

from __future__ import annotations

from .audit import SQL as AUDIT_SQL
from .audit import op12_audit
from .decontaminate import op8_decontamination
from .fingerprints import op13_fingerprints
from .licences import op1_licences
from .mixing import op10_mixing
from .pii import op2_pii
from .quality import op3_quality
from .repeats import op7_repeats
from .search import SQL as SEARCH_SQL
from .search import op11_search
from .simhash import op4_simhash
from .tokens import op9_tokens
from .vectors import SQL as VECTORS_SQL
from .vectors import op6_embeddings
from .warc import SQL as WARC_SQL
from .warc import op5_warc

QUERIES = {
    "op1_licences": op1_licences,
    "op2_pii": op2_pii,
    "op3_quality": op3_quality,
    "op4_simhash": op4_simhash,
    "op5_warc": op5_warc,
    "op6_embeddings": op6_embeddings,
    "op7_repeats": op7_repeats,
    "op8_decontamination": op8_decontamination,
    "op9_tokens": op9_tokens,
    "op10_mixing": op10_mixing,
    "op11_search": op11_search,
    "op12_audit": op12_audit,
    "op13_fingerprints": op13_fingerprints,
}

ORACLE_SQL: dict[str, str] = {
    "op5_warc": WARC_SQL,
    "op6_embeddings": VECTORS_SQL,
    "op11_search": SEARCH_SQL,
    "op12_audit": AUDIT_SQL,
}
