"""The entry points, with and without the folders that may be left out."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def names(folder):
    out = subprocess.run(
        [sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, check=True, timeout=120
    )
    queries, oracles = out.stdout.strip().splitlines()[-2:]
    return set(queries.split()), set(oracles.split())


def copy(folder, *left_out):
    def ignore(where, found):
        return [n for n in found if n in (".git", "__pycache__") or os.path.join(where, n) in left_out]

    shutil.copytree(ROOT, folder, ignore=ignore)
    return folder


def test_reports_stay_without_the_optional_folder(tmp_path):
    left_out = [os.path.join(ROOT, n) for n in ("fleetwarden/llm", "tests/llm")]
    with_pipeline = names(copy(tmp_path / "a", *left_out))
    without = names(copy(tmp_path / "b", *left_out, os.path.join(ROOT, "corpus_pipeline.py")))
    assert with_pipeline == without
    queries, oracles = without
    assert oracles <= queries and len(oracles) > 90
    assert "machine_status" in oracles and not any(n.startswith("op") for n in queries if n[2:3].isdigit())
    everything, _ = names(ROOT)
    assert queries <= everything
