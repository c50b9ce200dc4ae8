"""The queries of this subpackage: names, callables and SQL."""

from __future__ import annotations

from arborlane.llm import bpe, exact_dedup, language_model, mixing, ngram_join, private_data, quality_classifier, quality_rules, substring_dedup, url_filters
from arborlane.llm.common import table


def _on(name, f):
    return lambda spark, sf_dir: f(table(spark, sf_dir, name))


QUERIES = {
    "op1_mixing": _on("documents", mixing.query),
    "op2_ngram_join": _on("documents", ngram_join.query),
    "op3_url_filters": _on("pages", url_filters.query),
    "op4_language_model": _on("documents", language_model.query),
    "op5_bpe": _on("documents", bpe.query),
    "op6_private_data": _on("documents", private_data.query),
    "op7_quality_classifier": lambda spark, sf_dir: quality_classifier.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op8_quality_rules": _on("documents", quality_rules.query),
    "op9_exact_dedup": _on("documents", exact_dedup.query),
    "op10_substring_dedup": _on("documents", substring_dedup.query),
}

ORACLES = {
    "op3_url_filters": url_filters.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
}
