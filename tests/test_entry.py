"""The library without its subpackage of corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
PROBE = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q)); assert len(q) > 50; assert not [k for k in (*q, *s) if k.startswith('op') or k == 'pipeline']"


def _copy(to: Path, *without: str) -> Path:
    shutil.copytree(ROOT, to, ignore=lambda folder, names: [n for n in names if n in (".git", "__pycache__", ".pytest_cache") or str(Path(folder, n).relative_to(ROOT)) in without])
    return to


def _runs(folder: Path, code: str) -> None:
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True, timeout=120, check=False)
    assert done.returncode == 0, done.stderr


def test_queries_without_both_folders(tmp_path):
    _runs(_copy(tmp_path / "copy", "panelfactor/llm", "tests/llm", "corpus_pipeline.py"), PROBE)


def test_queries_without_the_subpackage_only(tmp_path):
    _runs(_copy(tmp_path / "copy", "panelfactor/llm", "tests/llm"), PROBE)


def test_queries_without_an_empty_folder(tmp_path):
    """A folder left behind without modules counts as absent."""
    folder = _copy(tmp_path / "copy", "panelfactor/llm", "tests/llm")
    (folder / "panelfactor/llm/__pycache__").mkdir(parents=True)
    _runs(folder, PROBE)


def test_the_rest_does_not_import_the_subpackage():
    for path in (ROOT / "panelfactor").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "panelfactor.llm" not in path.read_text(), path
