from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "flagship" in e.queries()


def test_works_without_the_language_model_subpackage():
    code = "import sys; sys.modules['sluice.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not [n for n in e.queries() if n.startswith('op')]"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0


def test_entry_runs(spark):  # noqa: ANN001
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
