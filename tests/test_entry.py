import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from tests.check_catalog import connect, difference

SMALL = "/root/testdata/sf0.001"


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


# A cross-section; ``python tests/check_catalog.py`` compares all of them.
@pytest.mark.parametrize("name", ["preprocess_partitioned", "sgns_pairs", "nearest_neighbors", "align"])
def test_query_matches_its_sql(spark, name):
    found = difference(spark, connect(SMALL), SMALL, name)
    assert found is None or found.startswith("(types")


def test_flagship(spark):
    assert entry.entry(spark).columns == ["target", "rank", "word", "score"]


@pytest.mark.parametrize("pipeline", [False, True])
def test_the_rest_works_without_the_training_data_subpackage(tmp_path, pipeline):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(os.path.join(root, "lexloom"), tmp_path / "lexloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", "bench.py", *(["corpus_pipeline.py"] if pipeline else [])]:
        if os.path.exists(os.path.join(root, name)):
            shutil.copy(os.path.join(root, name), tmp_path / name)
    say = "import __spark_entry__ as e, bench; print(*sorted(e.queries())); assert set(e.oracle_sql()) == set(e.queries())"
    done = subprocess.run([sys.executable, "-c", say], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    found = done.stdout.split()
    assert len(found) >= 80 and not [n for n in found if n.startswith("op") or n == "pipeline"]
