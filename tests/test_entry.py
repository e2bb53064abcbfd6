import os

import pytest

import __spark_entry__


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the test data isn't here")
def test_entry_runs(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["object_id", "generation", "epoch", "physical_ms", "recent_events"] and df.count() >= 0


def test_the_text_operators_are_not_needed(tmp_path):
    """A copy without them still imports and has the other queries."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    shutil.copytree(f"{root}/quarrylight", tmp_path / "quarrylight", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; names = e.queries(); assert 'exact_latest' in names and not any(n.startswith('op') for n in names) and 'pipeline' not in names"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, timeout=60).returncode == 0
