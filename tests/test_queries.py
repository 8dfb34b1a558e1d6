"""Every registered query against its SQL on the small tables."""

import os

import compare
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
FOLDER = "/root/testdata/sf0.01"
# These fix the thresholds at which the search ends on FOLDER.
FULL = {"acs_sample", "acs_picks"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def databases():
    return {folder: compare.connect(folder) for folder in (SMALL, FOLDER)}


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, databases, name):
    folder = FOLDER if name in FULL else SMALL
    frame = entry.queries()[name](spark, folder)
    assert compare.differences(frame, databases[folder], entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_rows_only(spark, name):
    assert entry.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert 0 < entry.entry(spark).count() <= 50
