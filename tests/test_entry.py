"""The entry points load without what only the training-data queries need."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest


@pytest.mark.parametrize("blocked", ["xxhash", "corpus_pipeline", "lodestar.llm"])
def test_the_rest_loads_alone(blocked):
    code = f"import sys; sys.modules[{blocked!r}] = None; import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') and n[2].isdigit() for n in e.queries()) and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=Path(__file__).parents[1], check=True, timeout=120)
