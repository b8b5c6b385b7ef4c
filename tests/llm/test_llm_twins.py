"""Queries of this package against their SQL twins."""

import pytest

from comparing import compare, connect
from newsloom.llm.queries import QUERIES
from newsloom.llm.sql import SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), connect(sf_dir), SQL[name]) is None


def test_all_are_registered():
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14))
