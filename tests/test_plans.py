"""What the plans of the queries must and must not hold."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
# Fits run many jobs before they return a plan over a few rows.
FITS = {"fit_topics", "subtopics", "assign_new_documents", "experiment", "auto_kmeans_text",
        "recompute", "spectral_clustering", "auto_gaussian_mixture", "soft_topics", "fit_soft_topics"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - FITS))
def test_no_product_of_rows(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize(
    "name", ["collapse_lines", "term_counts", "hashing_vectors", "hash_embedding", "tokens", "strip_text"]
)
def test_work_inside_the_row(spark, name):
    """No shuffle but the one that spreads a single small file over the cores."""
    text = plan(entry.queries()[name](spark, FOLDER))
    assert set(re.findall(r"Exchange (\w+)", text)) <= {"RoundRobinPartitioning"}


def test_scans_read_needed_columns(spark):
    text = plan(entry.queries()["event_runs"](spark, FOLDER))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert schemas and all("props" not in s and "value" not in s for s in schemas)


def test_filters_reach_the_scan(spark):
    text = plan(entry.queries()["last_message"](spark, FOLDER))
    assert "EqualTo(role,assistant)" in text


def test_lineage_is_never_cut_on_one_machine():
    root = Path(entry.__file__).parent
    for path in [*root.glob("topicloom/**/*.py"), root / "bench.py", root / "__spark_entry__.py"]:
        text = path.read_text()
        assert "localCheckpoint" not in text and "crossJoin" not in text
