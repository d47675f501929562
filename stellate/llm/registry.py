"""The queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from . import ann, bpe, license_scan, order_minhash, packing, quality, secret_scan, sharding, simhash, suffix_dedup

_MODULES = (license_scan, suffix_dedup, simhash, ann, packing, secret_scan, bpe, order_minhash, quality, sharding)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in getattr(m, "ORACLE", {}).items()}
