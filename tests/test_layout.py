"""The operators for training data stand apart: nothing else imports them, and the entry module does without them."""

import pathlib
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent
APART = ("postwatch/llm/", "tests/llm/", "corpus_pipeline.py")


def test_nothing_else_imports_them():
    for path in ROOT.rglob("*.py"):
        name = path.relative_to(ROOT).as_posix()
        if not name.startswith((*APART, ".")) and name not in ("__spark_entry__.py", "tests/test_layout.py"):
            assert "postwatch.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), name


def test_entry_without_them(tmp_path):
    for name in ("__spark_entry__.py", "checks", "postwatch"):
        source = ROOT / name
        for path in [source] if source.is_file() else source.rglob("*.py"):
            rest = path.relative_to(ROOT)
            if not rest.as_posix().startswith(APART):
                (tmp_path / rest).parent.mkdir(parents=True, exist_ok=True)
                (tmp_path / rest).write_text(path.read_text())
    code = "import __spark_entry__ as e; names = e.queries(); assert len(names) > 50 and set(e.oracle_sql()) == set(names); print('fine')"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "fine", done.stderr[-800:]
