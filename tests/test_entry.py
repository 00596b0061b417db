import subprocess
import sys
from pathlib import Path

REPO = str(Path(__file__).resolve().parents[1])
BLOCKED = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == {module!r} or name == {module!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as entry
names = entry.queries()
assert "scan_all_detectors" in names and not any(n.startswith("op") and n[2].isdigit() for n in names), names
assert "pipeline" not in names and set(entry.oracle_sql()) <= set(names)
"""


def test_core_queries_load_without_modules_of_the_corpus_part():
    for module in ("xxhash", "regex", "public_tokenizers", "veilscan.llm", "corpus_pipeline"):
        done = subprocess.run([sys.executable, "-c", BLOCKED.format(module=module)], cwd=REPO, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
