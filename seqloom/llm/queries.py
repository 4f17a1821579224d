"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .ann import op2_nearest_neighbours
from .bpe import op1_byte_bpe
from .chat import OP3_SQL, op3_chat_format
from .mixing import op10_mix_sources
from .quality import QUALITY_BASE_SQL, op5_quality_rules, quality_base
from .secretscan import SECRETS_BASE_SQL, op6_secret_scan, secrets_base
from .simhash import op7_simhash_near_dedup
from .toxicity import op8_toxicity
from .urlfilter import OP9_SQL, op9_url_filter
from .warc import OP4_SQL, op4_warc

QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_chat_format": op3_chat_format,
    "op4_warc": op4_warc,
    "op5_quality_rules": op5_quality_rules,
    "op6_secret_scan": op6_secret_scan,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_url_filter": op9_url_filter,
    "op10_mix_sources": op10_mix_sources,
    "quality_base": quality_base,
    "secrets_base": secrets_base,
}

#: The others are models, digests SQL lacks, or approximate; tests hold them against brute force.
ORACLE_SQL = {
    "op3_chat_format": OP3_SQL,
    "op4_warc": OP4_SQL,
    "op9_url_filter": OP9_SQL,
    "quality_base": QUALITY_BASE_SQL,
    "secrets_base": SECRETS_BASE_SQL,
}
