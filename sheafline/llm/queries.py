"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe_tree import op7_bpe_round_trip
from .language_tree import op4_language_tree
from .parsed_repeats import op6_parsed_repeats
from .qgram_leaks import op9_benchmark_leaks
from .ring_shards import op2_ring_shards
from .scaled_sketch import op10_document_sketches
from .simhash_gray import op8_simhash_groups
from .token_counts import op5_token_counts
from .toxicity import op1_toxicity
from .warc import ORACLE_SQL as WARC_SQL
from .warc import op3_warc_salvage

QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_ring_shards, op3_warc_salvage, op4_language_tree, op5_token_counts, op6_parsed_repeats,
        op7_bpe_round_trip, op8_simhash_groups, op9_benchmark_leaks, op10_document_sketches
    )
}
ORACLE_SQL = {"op3_warc_salvage": WARC_SQL}
