"""The driver's contract."""

import importlib.util
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e


def test_every_oracle_has_a_query_and_the_flagship_runs(spark):
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.oracle_sql()) >= 40
    got = e.entry(spark)
    assert got.columns == ["qid", "vid", "dist", "rk"] and not got.isEmpty()


def test_optional_parts_are_registered_where_they_exist():
    names, root = e.queries(), Path(e.__file__).parent
    present = importlib.util.find_spec("halyard.llm") is not None
    assert present == any(n.startswith("op1_") for n in names)
    assert (present and (root / "corpus_pipeline.py").exists()) == ("pipeline" in names)


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    root = Path(e.__file__).parent
    shutil.copytree(root / "halyard", tmp_path / "halyard", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); e.oracle_sql(); assert 'knn_cosine' in n and 'pipeline' not in n and not any(x.startswith('op') for x in n)"
    for left in ((), ("corpus_pipeline.py",)):
        for name in left:
            if not (root / name).exists():
                return
            shutil.copy(root / name, tmp_path)
        subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
