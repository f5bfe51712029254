import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent
CODE = """
import sys
class Blocked:
    def find_spec(self, name, path=None, target=None):
        if any(name == b or name.startswith(b + ".") for b in {blocked!r}):
            raise ImportError(name)
sys.meta_path.insert(0, Blocked())
import __spark_entry__ as e
names = set(e.queries())
assert set(e.oracle_sql()) <= names
print(len(names), "p1_found" in names, any(n.startswith(("p2", "p4", "p6", "p7", "p8", "p9")) for n in names))
"""


def loaded(*blocked):
    out = subprocess.run([sys.executable, "-c", CODE.format(blocked=blocked)], cwd=ROOT, capture_output=True, text=True, check=True)
    n, general, optional = out.stdout.split()
    return int(n), general == "True", optional == "True"


def test_queries_load_without_optional_libraries():
    n, general, _ = loaded("none")
    fewer, still, optional = loaded("lociforge.llm")
    assert general and still and not optional and 97 <= fewer <= n
    assert loaded("tiktoken")[0] >= fewer and loaded("regex")[0] >= fewer
