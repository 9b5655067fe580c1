"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .fingerprints import op1_fingerprints
from . import audit, licenses, resampling
from .audit import op13_filter_audit
from .bpe import op11_byte_bpe
from .licenses import op4_licenses
from .media import op9_media
from .mixing import op10_mixing
from .pieces import op7_pieces
from .pii import op3_pii
from .resampling import op12_resampling
from .sharding import op8_sharding
from .simhash import op6_simhash
from .toxicity import op2_toxicity
from .urls import op5_urls

QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_toxicity": op2_toxicity,
    "op3_pii": op3_pii,
    "op4_licenses": op4_licenses,
    "op5_urls": op5_urls,
    "op6_simhash": op6_simhash,
    "op7_pieces": op7_pieces,
    "op8_sharding": op8_sharding,
    "op9_media": op9_media,
    "op10_mixing": op10_mixing,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_resampling": op12_resampling,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {"op4_licenses": licenses.ORACLE_SQL, "op12_resampling": resampling.ORACLE_SQL, "op13_filter_audit": audit.ORACLE_SQL}
