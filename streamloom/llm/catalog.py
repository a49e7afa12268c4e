"""All queries of this subpackage and their SQL."""

from . import decontaminate, language_id, lm_score, media, near_dedup, packing, pii, quality, substring_dedup, warc

_ALL = (pii, media, packing, language_id, decontaminate, warc, quality, substring_dedup, near_dedup, lm_score)
QUERIES = {k: f for m in _ALL for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _ALL for k, s in m.ORACLES.items()}
