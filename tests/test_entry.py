"""The driver's contract holds whatever libraries are missing."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

from quern.plans import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names_without(*modules: str) -> set[str]:
    hide = "".join(f"sys.modules[{m!r}] = None\n" for m in modules)
    code = f"import sys\n{hide}import __spark_entry__ as e\nprint(*e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    return set(done.stdout.split())


@pytest.mark.parametrize("modules", [("tiktoken",), ("tokenizers", "xxhash"), ("quern.llm",), ("corpus_pipeline",)])
def test_analytic_queries_stay(modules):
    assert names_without(*modules) == set(QUERIES)


def test_all_queries_have_a_name():
    assert set(QUERIES) <= names_without()
