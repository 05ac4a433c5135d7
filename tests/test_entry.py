import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_training_operators(tmp_path):
    for name in ("__spark_entry__.py", "quillon"):
        source = os.path.join(ROOT, name)
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(source) else shutil.copy(source, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_nothing_imports_the_training_operators():
    for folder, _, names in os.walk(os.path.join(ROOT, "quillon")):
        if os.path.basename(folder) not in ("llm", "__pycache__"):
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as f:
                        assert "quillon.llm" not in f.read()
