"""The library without its optional subpackage."""

import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code: str) -> subprocess.CompletedProcess:
    return subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=ROOT, capture_output=True, text=True, timeout=120)


BLOCKED = """
    import sys
    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name.startswith({names!r}):
                raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
    sys.meta_path.insert(0, Gone())
"""


def test_entry_without_the_subpackage():
    for names in (("lexmill.llm", "corpus_pipeline"), ("corpus_pipeline",)):
        out = run(BLOCKED.format(names=names) + """
    import __spark_entry__ as e
    assert "nb_predict" in e.queries() and "pipeline" not in e.queries()
    assert set(e.oracle_sql()) <= set(e.queries())
    assert not any(q.startswith("op") for q in e.queries())
    """)
        assert out.returncode == 0, out.stderr


def test_nothing_else_imports_the_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "lexmill")):
        if os.path.basename(folder) != "llm":
            for name in files:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as f:
                        assert "lexmill.llm" not in f.read(), name
