"""The entry module with and without what the corpus operators need."""

import subprocess
import sys

import pytest

from .conftest import ROOT

ASK = "import sys; sys.path.insert(0, {root!r}); {absent}import __spark_entry__ as e; print(len(e.queries()), sum(q.startswith('op') and q[2].isdigit() or q == 'pipeline' for q in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"


@pytest.mark.parametrize("module", ["zstandard", "regex", "reelframe.llm", "corpus_pipeline"])
def test_queries_without_a_module(module):
    """The other queries are there; the corpus queries and their SQL are left out."""
    ask = ASK.format(root=ROOT, absent=f"sys.modules[{module!r}] = None; ")
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", ask], capture_output=True, text=True, check=True, timeout=120).stdout.split()
    assert int(out[0]) > 100 and out[1:] == ["0", "True"]


def test_a_mistaken_import_is_an_error():
    """A module that nobody knows isn't taken for an absent library."""
    ask = ASK.format(root=ROOT, absent="sys.modules['reelframe.llm.bpe'] = None; ")
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", ask], capture_output=True, text=True, timeout=120)
    assert out.returncode and "reelframe.llm.bpe" in out.stderr
