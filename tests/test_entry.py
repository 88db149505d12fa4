"""The driver contract stands without the optional parts."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
for name in {missing!r}:
    sys.modules[name] = None  # an import of it raises ImportError
import __spark_entry__ as entry
from trialweave.plans.queries import ORACLES, QUERIES
print(entry.queries().keys() >= QUERIES.keys(), entry.oracle_sql().keys() >= ORACLES.keys(), [q for q in entry.queries() if q.startswith("op") or q == "pipeline"])
"""


@pytest.mark.parametrize("missing", [["trialweave.llm"], ["xxhash"], ["trialweave.llm", "corpus_pipeline"]])
def test_queries_stand_without_the_optional_parts(missing):
    script = SCRIPT.format(root=ROOT, missing=missing)
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=120, check=True)
    assert done.stdout.strip() == "True True []"
