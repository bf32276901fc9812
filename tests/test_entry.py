"""The entry module must work where the training-data folders, or the pipeline too, have been deleted."""

import os
import shutil
import subprocess
import sys

import pytest

from strandgraph.plans import registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline", [True, False])
@pytest.mark.parametrize("folder_stays", [True, False])
def test_entry_without_the_training_data_part(tmp_path, pipeline, folder_stays):
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline and os.path.exists(f"{ROOT}/corpus_pipeline.py") else [])):
        shutil.copy(f"{ROOT}/{name}", tmp_path)
    shutil.copytree(f"{ROOT}/strandgraph", tmp_path / "strandgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    if folder_stays:
        (tmp_path / "strandgraph" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == [str(len(registry.queries())), str(len(registry.oracle_sql()))], done.stderr
