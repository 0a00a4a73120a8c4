"""Registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .attention_lm import op7_attention_lm
from .decontam import op1_decontamination
from .impact_index import OP13_SQL, op13_top_products
from .language import op8_language
from .near_join import OP4_SQL, op4_near_join
from .neighbours import op9_neighbours
from .orc_ids import op10_orc_ids
from .packing import op6_packing
from .secrets import op3_secret_scan
from .site_tree import op5_site_text
from .token_counts import op2_token_counts
from .turn_trie import OP12_SQL, op12_turn_trie
from .whitening import op11_whitening


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_token_counts, op3_secret_scan, op4_near_join, op5_site_text, op6_packing, op7_attention_lm,
    op8_language, op9_neighbours, op10_orc_ids, op11_whitening, op12_turn_trie, op13_top_products, pipeline)}
ORACLES: dict[str, str] = {"op4_near_join": OP4_SQL, "op12_turn_trie": OP12_SQL, "op13_top_products": OP13_SQL}
