"""CSV seeds with records that are no rows: counted and returned, good rows unchanged."""

from __future__ import annotations

import os
import tempfile

import pytest

from marketspark.sources import read_broken, read_raw, read_rejected

HEADER = "campaign_id,channel,objective,start_date,end_date,target_segment,expected_uplift\n"
GOOD = ['1,email,reach,2021-01-01,2021-02-01,all,0.1', '2,"a ""quoted"" one, with comma",reach,2021-01-01,2021-02-01,all,0.2',
        '3,"two\nlines",sales,2021-01-01,2021-02-01,new,0.3', '4,,,,,,', '5,social,sales,2021-01-01,2021-02-01,"x\r\ny",0.5']
FEW, MANY, TEXT = "6,email,reach", "7,email,reach,2021-01-01,2021-02-01,all,0.1,extra,fields", "just a line"
OPEN = '8,"never closed,reach,2021-01-01,2021-02-01,all,0.1'


def seeds(*files):
    root = tempfile.mkdtemp(prefix="marketspark-broken-")
    os.makedirs(os.path.join(root, "campaigns.csv"))
    for i, records in enumerate(files):
        with open(os.path.join(root, "campaigns.csv", f"part-{i}.csv"), "w", newline="") as f:
            f.write(HEADER + "\n".join(records) + "\n")
    return root


def loaded(spark, root):
    return sorted(tuple(r) for r in read_raw(spark, root, tables=("campaigns",))["campaigns"].collect())


def broken(spark, root):
    found = read_broken(spark, root, tables=("campaigns",)).collect()
    assert all(r.table_name == "campaigns" and "/campaigns.csv/part-" in r.file for r in found)
    return sorted(r.record.strip() for r in found)


def test_quoted_line_breaks_belong_to_their_value(spark):
    rows = loaded(spark, seeds(GOOD))
    assert [r[0] for r in rows] == [1, 2, 3, 4, 5]
    assert rows[1][1] == 'a "quoted" one, with comma' and rows[2][1] == "two\nlines" and rows[4][5].split() == ["x", "y"]
    assert broken(spark, seeds(GOOD)) == []


@pytest.mark.parametrize("bad", [[FEW], [MANY], [TEXT], [FEW, MANY, TEXT]])
def test_wrong_field_counts_are_returned(spark, bad):
    root = seeds([GOOD[0], *bad, *GOOD[1:]])
    assert loaded(spark, root) == loaded(spark, seeds(GOOD))
    assert broken(spark, root) == sorted(bad)


def test_an_open_quote_takes_no_row_with_it(spark):
    plain = [GOOD[0], GOOD[3], "9,push,reach,2021-03-01,2021-04-01,all,0.9"]
    root = seeds([plain[0], OPEN, *plain[1:]], [GOOD[2], FEW])
    assert loaded(spark, root) == loaded(spark, seeds([*plain, GOOD[2]]))
    assert broken(spark, root) == sorted([OPEN, FEW])


def test_counts_are_of_good_rows_only(spark):
    root = seeds([GOOD[0], "10,email,reach,soon,2021-02-01,all,much", FEW])
    lost = {r.column_name: r.rejected for r in read_rejected(spark, root, tables=("campaigns",)).collect()}
    assert {k for k, v in lost.items() if v} == {"start_date", "expected_uplift"}
    assert read_raw(spark, root, tables=("campaigns",))["campaigns"].count() == 2


def test_an_empty_seed(spark):
    root = seeds([])
    assert loaded(spark, root) == [] and broken(spark, root) == []
