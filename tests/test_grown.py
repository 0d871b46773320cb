"""Profiles from stored part states equal those of the whole table, without reading old rows again."""

import math
import random

import pytest

from quarry.operators import grown as G
from quarry.operators import profile as P
from quarry.operators import values as V
from quarry.plans.profilestate import merged_columns, merged_quantiles
from quarry.plans.quantiles import column_quantiles

SCHEMA = "`a.b` double, v long, key string, c int, f float"


def rows_of(n, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        x = r.choice([None, float("nan"), -0.0, 0.0, r.gauss(0, 1e3), r.gauss(1e6, 1), 7.25])
        out.append((x, r.choice([None, 2**53, 2**53 + 1, r.randrange(-50, 50)]), r.choice([None, "", "x", "y", "z" * 3]), r.randrange(9), r.choice([0.1, 2.5, None])))
    return out


def close(got, want):
    assert got.columns == want.columns
    a, b = ({r["col_name"]: r for r in df.collect()} for df in (got, want))
    assert set(a) == set(b)
    for name in a:
        for c, x, y in zip(got.columns, a[name], b[name]):
            same = math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-5) if isinstance(x, float) and isinstance(y, float) else x == y
            assert same, (name, c, x, y)


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    """Three parts, one of them empty, read from files that are gone afterwards; and the whole table."""
    folder = tmp_path_factory.mktemp("grown")
    path, parts = str(folder / "state"), {"old": rows_of(900, 1), "none": [], "new": rows_of(300, 2)}
    for name, rows in parts.items():
        source = folder / name
        spark.createDataFrame(rows, SCHEMA).write.parquet(str(source))
        G.add_part(spark.read.parquet(str(source)), path, name)
        for f in source.iterdir():
            f.unlink()
    from quarry.functions.columns import nan_to_null

    return path, nan_to_null(spark.createDataFrame([r for rows in parts.values() for r in rows], SCHEMA)).cache()


def test_numeric_profile(spark, grown):
    path, whole = grown
    close(G.grown_numeric_profile(spark, path), P.numeric_profile(whole))


def test_column_profile(spark, grown):
    path, whole = grown
    close(G.grown_column_profile(spark, path), P.column_profile(whole))


def test_histogram_and_top_values(spark, grown):
    path, whole = grown
    for got, want in ((G.grown_histogram(spark, path, bins=7), V.histogram(whole, bins=7)), (G.grown_top_values(spark, path, 3), V.top_values(whole, 3)),
                      (G.grown_top_values(spark, path, 4, ["v", "c", "f", "a.b"]), V.top_values(whole, 4, ["v", "c", "f", "a.b"]))):
        assert got.columns == want.columns and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_quantiles_of_many_rounds(spark, grown):
    path, whole = grown
    probs = [0, 0.1, 1 / 3, 0.5, 0.999, 1]
    assert merged_quantiles(spark, path, probs, limit=3) == column_quantiles(whole, ["a.b", "v", "c", "f"], probs)


def test_parts_are_added_once_and_must_agree(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spark.createDataFrame([(1.0, "a"), (2.0, None)], "x double, t string")
    with pytest.raises(ValueError, match="no finished part"):
        G.grown_numeric_profile(spark, path)
    G.add_part(df, path, "01")
    G.add_part(df, path, "1")  # another name
    for bad in ("01", "", "a/b", "a=b"):
        with pytest.raises(ValueError):
            G.add_part(df, path, bad)
    with pytest.raises(ValueError, match="other columns"):
        G.add_part(df.select("t", "x"), path, "2")
    assert merged_columns(spark, path).where("col_name = 'x'").first()["n"] == 4
    G.add_part(df.limit(1), path, "01", replace=True)
    r = {r["col_name"]: r for r in merged_columns(spark, path).collect()}
    assert (r["x"]["rows"], r["t"]["missing"]) == (3, 1)


def test_an_unfinished_part_is_not_read(spark, tmp_path):
    import shutil

    path = str(tmp_path / "s")
    df = spark.createDataFrame([(1.0,), (5.0,)], "x double")
    G.add_part(df, path, "a")
    shutil.copytree(f"{path}/values/part=a", f"{path}/values/part=b")  # its driver was lost before the rest
    shutil.copytree(f"{path}/intervals/part=a", f"{path}/intervals/part=b")
    assert merged_quantiles(spark, path, [1.0]) == {"x": [5.0]}
    assert G.grown_numeric_profile(spark, path).first()["count"] == 2
    G.add_part(df, path, "b")
    assert G.grown_numeric_profile(spark, path).first()["count"] == 4


def test_columns_without_values(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spark.createDataFrame([(None, None), (None, 3)], "x double, y int")
    G.add_part(df, path, "a")
    close(G.grown_numeric_profile(spark, path), P.numeric_profile(df))
    assert sorted(G.grown_histogram(spark, path, bins=2).collect()) == sorted(V.histogram(df, bins=2).collect())
    G.add_part(df.select("y").where("y < 0"), str(tmp_path / "e"), "a")
    assert G.grown_numeric_profile(spark, str(tmp_path / "e")).first()["count"] == 0
