import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q), 'pipeline' in q)"


def run(folder):
    return subprocess.run([sys.executable, "-B", "-c", SAY], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True)


def test_guard(tmp_path):
    """Without the optional parts the other queries stay; a broken import inside them is an error."""
    for name in ("__spark_entry__.py", "archivist"):
        src = os.path.join(REPO, name)
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(src) else shutil.copy(src, tmp_path)
    bare = run(tmp_path)
    assert bare.returncode == 0 and bare.stdout.split()[1:] == ["False", "False"] and int(bare.stdout.split()[0]) > 50, bare.stderr
    (tmp_path / "archivist/llm").mkdir()
    (tmp_path / "archivist/llm/__init__.py").write_text("")
    (tmp_path / "archivist/llm/queries.py").write_text("from archivist.llm.common import tablex\n")
    for common in (None, "", "import no_such_module\n"):  # a missing submodule, a missing name, a missing library
        if common is not None:
            (tmp_path / "archivist/llm/common.py").write_text(common)
        broken = run(tmp_path)
        assert broken.returncode and "Error" in broken.stderr
    (tmp_path / "archivist/llm/queries.py").write_text("QUERIES, SQL = {'op0_x': None}, {}\n")
    (tmp_path / "corpus_pipeline.py").write_text("import archivist.llm.gone\n")
    assert run(tmp_path).returncode
