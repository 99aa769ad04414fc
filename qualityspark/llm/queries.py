"""Registry of the training-data queries."""

from __future__ import annotations

import corpus_pipeline
from qualityspark.llm import (decontaminate, fingerprints, hard_negatives, jaccard_join, language_id, packing, page_text,  # noqa: F401
                              prefix_trie, pseudo_likelihood, secret_scan, topk_search, toxicity, url_filter)
from qualityspark.llm.common import ORACLE, REGISTRY


def queries():
    return REGISTRY | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    more = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return ORACLE | more
