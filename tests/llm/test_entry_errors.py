"""Errors inside the subpackage are not taken for its absence."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

CODE = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "tokenizers":
            raise ModuleNotFoundError("No module named 'tokenizers'", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__
"""


def test_a_missing_library_is_not_passed_over():
    out = subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode != 0 and "tokenizers" in out.stderr


def test_all_queries_are_registered():
    code = "import __spark_entry__ as e; print(*e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    names = out.stdout.split()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names}
