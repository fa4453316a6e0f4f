"""Documents of recognition results: written small, read back whole."""

from pathlib import Path

import pytest

from passbook.catalog import token_queries
from passbook.catalog.registry import Tables
from passbook.sources import ocr_json

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def tables(spark):
    return Tables(spark, FOLDER)


def plain_size(spark, path):
    return sum(len(r.value.encode()) + 1 for r in spark.read.text(str(path)).collect())


def test_results_are_compressed(spark, tables):
    path = Path(token_queries._results_path(tables))
    written = sum(p.stat().st_size for p in path.glob("part-*"))
    assert written * 5 < plain_size(spark, path)
    assert ocr_json.read_ocr(spark, str(path), one_per_file=False).selectExpr("sum(size(items))").first()[0] == tables.tokens.count()


def test_responses_are_compressed(spark, tables):
    files = token_queries._responses(tables).inputFiles()
    assert files and all(f.endswith(".gz") for f in files)
