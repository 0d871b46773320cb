"""Routing of damaged CSV lines: sides, faults and line numbers against a plain reading of the files."""

import pytest

from quarry.sources.routed import route_csv

SCHEMA = "id long, `row` string, `first.x` double, day date"
A = 'id,row,first.x,day\n1,a,2.5,2020-01-02\n\n2,b\nx,c,1,2020-01-02\n3,"d, e",,\n4,f,1,2020-01-02,2\n5,g,abc,2020-01-02\n   \n6,h,1,2020-13-02\n'
B = 'id,row,first.x,day\n7,i,NaN,\n,,,\n"8,j,1,\n\n9,k,1e3,2021-01-01'


def write(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def test_sides_faults_and_lines(spark, tmp_path):
    found = route_csv(spark, write(tmp_path, a=A, b=B, empty="", head="id,row,first.x,day\n"), SCHEMA)
    assert found.good.columns == ["id", "row", "first.x", "day"]
    good = sorted((r[0], r[1], r[2], str(r[3])) for r in found.good.where("id IS NOT NULL").collect())
    assert good == [(1, "a", 2.5, "2020-01-02"), (3, "d, e", None, "None"), (7, "i", None, "None"), (9, "k", 1000.0, "2021-01-01")]
    assert found.good.count() == 5  # and the line of empty cells
    bad = sorted((r.file.rsplit("/", 1)[1], r.line, r.raw, r.column) for r in found.bad.collect())
    assert bad == [("a.csv", 4, "2,b", None), ("a.csv", 5, "x,c,1,2020-01-02", "id"), ("a.csv", 7, "4,f,1,2020-01-02,2", None),
                   ("a.csv", 8, "5,g,abc,2020-01-02", "first.x"), ("a.csv", 10, "6,h,1,2020-13-02", "day"), ("b.csv", 4, '"8,j,1,', None)]


def test_without_header_and_with_separator(spark, tmp_path):
    found = route_csv(spark, write(tmp_path, a="1;a\nb;2\n3;c\n"), "n int, s string", header=False, sep=";")
    assert sorted(map(tuple, found.good.collect())) == [(1, "a"), (3, "c")]
    assert [tuple(r)[1:] for r in found.bad.collect()] == [(2, "b;2", "n")]


def test_no_lines(spark, tmp_path):
    found = route_csv(spark, write(tmp_path, a=""), "n int, s string")
    assert found.good.count() == 0 and found.bad.count() == 0 and found.good.columns == ["n", "s"]


@pytest.mark.parametrize("split", [100, 1000, 1 << 20])
def test_line_numbers_over_splits(spark, tmp_path, split):
    """Files cut into many splits, read again with other splits than they were written with."""
    texts = {f"f{k}": "n,s\n" + "".join(f"{'x' * (i % 7 == k)}{i},{'long text ' * (i % 5 * k)}\n" for i in range(400)) for k in range(4)}
    path = write(tmp_path, **texts)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        found = route_csv(spark, path, "n int, s string")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = sorted((r.file.rsplit("/", 1)[1][:-4], r.line, r.raw) for r in found.bad.collect())
    want = sorted((k, i + 1, line) for k, t in texts.items() for i, line in enumerate(t.split("\n")) if line.startswith("x"))
    assert got == want and len(got) > 200
    assert found.good.count() == 1600 - len(want)
