"""The registered queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from firmlake.llm.bpe import op9_bpe_chunks
from firmlake.llm.centroids import OP12_SQL, op12_centroid_clustering
from firmlake.llm.embed_dedup import op6_embedding_near_dedup
from firmlake.llm.langid import op5_language_id
from firmlake.llm.licenses import op1_license_scan
from firmlake.llm.line_dedup import op8_line_dedup
from firmlake.llm.middle import OP11_SQL, op11_fill_in_middle
from firmlake.llm.mixing import op13_source_mixing
from firmlake.llm.ngram_join import op7_ngram_jaccard_join
from firmlake.llm.packing import op10_best_fit_packing
from firmlake.llm.quality import op4_quality
from firmlake.llm.spotsigs import op2_spot_signatures
from firmlake.llm.toxicity import op3_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_spot_signatures": op2_spot_signatures,
        "op3_toxicity": op3_toxicity,
        "op4_quality": op4_quality,
        "op5_language_id": op5_language_id,
        "op6_embedding_near_dedup": op6_embedding_near_dedup,
        "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
        "op8_line_dedup": op8_line_dedup,
        "op9_bpe_chunks": op9_bpe_chunks,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_centroid_clustering": op12_centroid_clustering,
        "op13_source_mixing": op13_source_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_fill_in_middle": OP11_SQL, "op12_centroid_clustering": OP12_SQL}
