"""Queries of the dealt operators over the driver's tables, and the SQL beside them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bitslices, blocks, bpe, columns, decontam, flatgraph, langid, linespread, mixing, oddsketch, prefixtrie, toxicity, warc
from tidemark.llm.common import read
from tidemark.llm.sql import SQL

__all__ = ["QUERIES", "SQL"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_crf": lambda s, d: langid.label_documents(read(s, d, "documents")),
    "op2_line_spread": lambda s, d: linespread.drop_boilerplate(read(s, d, "documents").select("doc_id", "source", "text")),
    "op3_toxicity_gru": lambda s, d: toxicity.score_documents(read(s, d, "documents"), read(s, d, "labels")),
    "op4_water_filling": lambda s, d: mixing.mix(read(s, d, "documents")),
    "op5_warc_transactions": lambda s, d: warc.archived_pages(read(s, d, "pages")),
    "op6_suffix_columns": lambda s, d: columns.remove_repeats(read(s, d, "documents")),
    "op7_odd_sketch": lambda s, d: oddsketch.near_duplicates(read(s, d, "documents")),
    "op8_block_anchors": lambda s, d: blocks.remove_repeats(read(s, d, "documents")),
    "op9_bm25_leaks": lambda s, d: decontam.leaks(read(s, d, "documents"), read(s, d, "benchmark")),
    "op10_flat_graph": lambda s, d: flatgraph.near_vectors(read(s, d, "embeddings")),
    "op11_tree_contraction": lambda s, d: prefixtrie.shared_heads(read(s, d, "conversations")),
    "op12_bit_slices": lambda s, d: bitslices.search(read(s, d, "documents"), read(s, d, "benchmark")),
    "op13_prefix_tokens": lambda s, d: bpe.digests(read(s, d, "documents"), public_tokenizers.path("word_bpe_49k.json")),
}
