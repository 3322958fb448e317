"""The driver contract, with and without the text operators."""

from __future__ import annotations

import subprocess
import sys

import __spark_entry__ as entry
from loomline.plans import QUERIES


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "variant_id" in df.columns


def test_registers():
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_text_operators():
    code = "import sys; sys.modules['loomline.llm'] = None; import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.QUERIES), len(e.oracle_sql()) == len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=entry.__file__.rsplit("/", 1)[0], capture_output=True, text=True, check=True, timeout=120)
    assert out.stdout.split() == ["True", "True"]


def test_one_query_for_each_text_operator():
    numbers = [n.split("_")[0] for n in entry.LLM_QUERIES if n.startswith("op")]
    assert sorted(numbers) == sorted(set(numbers))
