"""The registered queries of this subpackage and the DuckDB form of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pricepanel.llm.decontamination import op6_benchmark_decontamination
from pricepanel.llm.embedding_links import OP11_SQL, op11_embedding_links
from pricepanel.llm.fill_in_middle import OP13_SQL, op13_fill_in_middle
from pricepanel.llm.jaccard_join import op8_ngram_jaccard_join
from pricepanel.llm.packing import op4_best_fit_packing
from pricepanel.llm.periodic_runs import op12_periodic_runs
from pricepanel.llm.personal_data import op9_personal_data
from pricepanel.llm.preferences import OP3_SQL, op3_preference_formatting
from pricepanel.llm.quality_ranking import op10_quality_ranking
from pricepanel.llm.quality_rules import op2_quality_rules
from pricepanel.llm.secrets import op1_secret_scan
from pricepanel.llm.token_counts import op7_token_counts
from pricepanel.llm.token_files import op5_token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_quality_rules, op3_preference_formatting, op4_best_fit_packing, op5_token_files,
        op6_benchmark_decontamination, op7_token_counts, op8_ngram_jaccard_join, op9_personal_data, op10_quality_ranking,
        op11_embedding_links, op12_periodic_runs, op13_fill_in_middle,
    )
}
ORACLES: dict[str, str] = {"op3_preference_formatting": OP3_SQL, "op11_embedding_links": OP11_SQL, "op13_fill_in_middle": OP13_SQL}
