import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__


def test_entry_has_rows_and_a_stable_schema(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.schema == __spark_entry__.entry(spark).schema


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("path", ["", str(Path(__file__).resolve().parents[1])])
@pytest.mark.parametrize("gone", [["sqlcurio/llm", "corpus_pipeline.py"], ["sqlcurio/llm"], ["corpus_pipeline.py"]])
def test_entry_without_the_optional_parts(tmp_path, gone, path):
    root = Path(__file__).resolve().parents[1]
    for part in ("sqlcurio", "corpus_pipeline.py", "__spark_entry__.py"):
        if part not in gone and (root / part).exists():
            copy = shutil.copytree if (root / part).is_dir() else shutil.copy
            copy(root / part, tmp_path / part)
    if "sqlcurio/llm" in gone:
        shutil.rmtree(tmp_path / "sqlcurio" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = set(e.queries()); assert set(e.oracle_sql()) <= q and 'strat_report' in q; print('pipeline' in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": path}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and done.stdout.split()[-1] == "False", done.stderr
