"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import license_scan
from .hard_negatives import op11_hard_negatives
from .license_scan import op3_license_scan
from .near_duplicates import op9_near_duplicates
from .packing import op4_packing
from .periodic_runs import op12_periodic_runs
from .quality_rules import op5_quality_rules
from .sharding import op13_sharding
from .source_mix import op7_source_mix
from .substring_dedup import op1_substring_dedup
from .token_counts import op2_token_counts
from .toxicity import op6_toxicity
from .vector_search import op8_vector_search
from .warc import op10_warc

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_license_scan": op3_license_scan,
    "op4_packing": op4_packing,
    "op5_quality_rules": op5_quality_rules,
    "op6_toxicity": op6_toxicity,
    "op7_source_mix": op7_source_mix,
    "op8_vector_search": op8_vector_search,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_warc": op10_warc,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_sharding": op13_sharding,
}

#: Of records with equal payloads of 1000 bytes or more, the one with the largest id is the response.
_WARC_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to FROM t"""

ORACLE_SQL: dict[str, str] = {
    "op10_warc": _WARC_SQL,
    "op3_license_scan": license_scan.oracle_sql(),
}
