"""The entry module, with the corpus operators and without them."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder):
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*sorted(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return set(subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, check=True).stdout.split())


@pytest.mark.parametrize("gone", [["llm"], ["llm", "corpus_pipeline.py"]])
def test_without_the_corpus_operators(tmp_path, gone):
    shutil.copytree(ROOT, f"{tmp_path}/repo", ignore=shutil.ignore_patterns(*gone, "__pycache__", ".git"))
    left = names(f"{tmp_path}/repo")
    assert {"kv_resolve", "map_get", "stream_upsert"} <= left and not any(n.startswith("op") or n == "pipeline" for n in left)


def test_nothing_else_imports_them():
    for at, _, files in os.walk(f"{ROOT}/siltbed"):
        for name in files:
            if name.endswith(".py") and not at.endswith("llm"):
                assert "siltbed.llm" not in open(f"{at}/{name}").read()


def test_entry(spark):
    sys.path.insert(0, ROOT)
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["k", "v", "seq"] and df.count() > 0
