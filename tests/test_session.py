"""Stage tables without a shared folder, and the driver contract without the optional parts."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
STAGED = """
from lokora.session import local_session, stage_root, stage_table
spark = local_session("2")
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert stage_table(spark.range(9), "t").count() == 9 and stage_root(spark) == stage_root(spark)
"""
WITHOUT = """
import __spark_entry__ as driver
from lokora import catalog
assert set(driver.queries()) == set(catalog.QUERIES) and set(driver.oracle_sql()) == set(catalog.SQL)
"""


def run(code: str, folder: Path, conf: Path) -> None:
    env = os.environ | {"SPARK_CONF_DIR": str(conf), "PYTHONPATH": str(folder)}
    done = subprocess.run([sys.executable, "-c", code], env=env, cwd=folder, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_stage_without_checkpoint_dir(tmp_path):
    run(STAGED, ROOT, tmp_path)


@pytest.mark.parametrize("left", [False, True])
def test_driver_without_optional_parts(tmp_path, left):
    """``corpus_pipeline.py`` may be there or not: it goes with the subpackage."""
    skip = shutil.ignore_patterns("llm", "__pycache__", *(() if left else ("corpus_pipeline.py",)))
    shutil.copytree(ROOT / "lokora", tmp_path / "lokora", ignore=skip)
    for name in ("__spark_entry__.py", "corpus_pipeline.py")[: 2 if left else 1]:
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    run(WITHOUT, tmp_path, tmp_path)
