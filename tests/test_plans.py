"""Plans of queries over the project's tables: what is shuffled and what is read."""

import io
import os
import re
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as e

D = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.exists(D), reason="no tables here")


def formatted(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def exchanged(plan):
    """The columns that go into each exchange of a plan."""
    return [m.group(1) for m in re.finditer(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", plan)]


@pytest.mark.parametrize("name", ["commit_labels", "label_distributions", "code_resurrection_exact", "script_tokens", "python_tokens"])
def test_no_diff_is_shuffled(spark, name):
    plan = formatted(e.queries()[name](spark, D))
    assert exchanged(plan) and not [c for c in exchanged(plan) if "raw_diff" in c or "code#" in c]


@pytest.mark.parametrize("name", ["contribution_share", "language_distribution", "sample_stratified", "kept_changes"])
def test_wide_columns_are_not_read(spark, name):
    assert "raw_diff" not in formatted(e.queries()[name](spark, D))
