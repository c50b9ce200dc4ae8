"""The pipeline: stages keep their contract, and the whole equals its stages in turn."""

import importlib.util
from pathlib import Path
from types import SimpleNamespace

import pytest

from arborlane.llm import common

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def pipeline():
    spec = importlib.util.spec_from_file_location("corpus_pipeline", ROOT / "corpus_pipeline.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_stages(spark, sf_dir, pipeline, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, n = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if i < len(pipeline.STAGES) - 1:
            assert out.columns == names, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        n.append(docs.count())
    assert n[0] > n[1] > n[2] >= n[3] > 0 and n[4] == n[5]
    whole = pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, docs.collect()))


def test_stages_begin_rested(spark, pipeline, monkeypatch):
    """Executors give their heaps back before each stage, and the collection runs in Spark."""
    calls = []
    monkeypatch.setattr(pipeline, "shrink_heaps", lambda s: calls.append("shrink"))
    assert pipeline.rested(lambda s, docs, at: calls.append("stage") or docs)(spark, 7, "") == 7
    assert calls == ["shrink", "stage"]
    assert all(stage.__qualname__.startswith("rested") for _, stage in pipeline.STAGES)
    assert common.shrink_heaps(spark) == 0  # local mode
    memory = SimpleNamespace(getExecutorMemoryStatus=lambda: SimpleNamespace(size=lambda: 3))
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: memory)), range=spark.range)
    assert common.shrink_heaps(cluster) == 2
