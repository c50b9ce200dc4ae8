"""The registered queries of the engine and their SQL."""

from __future__ import annotations

import importlib

from arborlane.plans import registry

GROUPS = ("graph_queries", "report_queries", "change_queries", "content_queries", "schedule_queries", "text_queries", "stream_queries", "format_queries", "rule_queries")

for _group in GROUPS:
    importlib.import_module(f"arborlane.plans.{_group}")


def flagship(spark, sf_dir):
    return registry.QUERIES["graph_rdeps_kinds"](spark, sf_dir)


def queries():
    return dict(registry.QUERIES)


def oracles():
    return dict(registry.ORACLES)
