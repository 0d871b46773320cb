import datetime

import numpy as np
from pyspark.sql import functions as F

from quarry.plans import ordered as O
from quarry.queries.tables import table

from .conftest import SF


def _sorted(pdf, key="o_orderkey"):
    return pdf.sort_values(key).reset_index(drop=True)


def test_bucketed_fill_equals_single_window(spark):
    og = table(spark, SF, "orders_gappy")
    pdf = _sorted(og.toPandas())
    for rpb in (10**9, 700):  # one bucket / ~22 buckets
        f = _sorted(O.forward_fill(og, ["price_n", "priority_n"], ["o_orderkey"], rows_per_bucket=rpb).toPandas())
        assert f["price_n"].equals(pdf["price_n"].ffill())
        b = _sorted(O.backward_fill(og, ["price_n"], ["o_orderkey"], rows_per_bucket=rpb).toPandas())
        assert b["price_n"].equals(pdf["price_n"].bfill())
        g = _sorted(O.forward_fill(og, ["price_n"], ["o_orderkey"], ["o_custkey"], rows_per_bucket=rpb).toPandas())
        exp = pdf.groupby("o_custkey")["price_n"].ffill()
        assert np.allclose(g["price_n"].fillna(-1), exp.fillna(-1))


def test_global_row_number_is_a_permutation(spark):
    og = table(spark, SF, "orders")
    rn = O.global_row_number(og, ["o_orderdate", "o_orderkey"], rows_per_bucket=1000).toPandas()
    srt = og.toPandas().sort_values(["o_orderdate", "o_orderkey"]).reset_index(drop=True)
    rn = rn.sort_values("row_number").reset_index(drop=True)
    assert list(rn["row_number"]) == list(range(1, len(srt) + 1))
    assert (rn["o_orderkey"].values == srt["o_orderkey"].values).all()


def test_bucketed_plan_has_no_single_partition_exchange(spark):
    og = table(spark, SF, "orders_gappy")
    out = O.forward_fill(og, ["price_n"], ["o_orderkey"], rows_per_bucket=1000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # the data rows are windowed per bucket; only the per-bucket summary (<= B rows) meets in one task,
    # and the boundaries in the scalar subquery of the binary search
    assert "hashpartitioning(_bk" in plan
    main, depth = [], None
    for line in plan.splitlines():
        at = len(line) - len(line.lstrip(" :+-*("))
        if depth is not None and at > depth:
            continue
        depth = at if "Subquery" in line else None
        main += [] if "Subquery" in line else [line]
    assert sum("SinglePartition" in x for x in main) <= 1


def test_page(spark):
    df = table(spark, SF, "orders").select("o_orderkey")
    p = O.page(df, 2, 7, ["o_orderkey"]).orderBy("row_number").toPandas()
    keys = sorted(df.toPandas().o_orderkey)[7:14]
    assert list(p.o_orderkey) == keys and p.total_pages.iloc[0] == -(-len(df.toPandas()) // 7)


def test_many_buckets_and_unpartitioned_bfill(spark):
    og = table(spark, SF, "orders_gappy")
    pdf = _sorted(og.toPandas())
    b = _sorted(O.backward_fill(og, ["price_n"], ["o_orderkey"], rows_per_bucket=10).toPandas())  # about 1500 buckets
    assert b["price_n"].equals(pdf["price_n"].bfill())
    assert O.with_buckets(og, ["o_orderkey"], rows_per_bucket=10)[1] > 1024


def test_first_rows_are_exact_with_ties_and_nulls(spark):
    from pyspark.sql import functions as F

    from quarry.operators.mlprep import eval_regression, split_time

    df = spark.createDataFrame([(i, None if i % 5 == 0 else i // 40) for i in range(500)], "id long, t int")
    for rpb in (10**6, 50):
        for ratio in (0.1, 0.2, 0.55):
            out = split_time(df, "t", ratio, rows_per_bucket=rpb).toPandas()
            assert (out.split == "train").sum() == int(500 * (1 - ratio)) and len(out) == 500 and out.id.is_unique
            assert out[out.split == "train"].t.max() <= out[(out.split == "val")].t.fillna(10**6).min()
        dated = split_time(df, "t", 0.2, ["id"], rows_per_bucket=rpb).where("split = 'train'")
        assert dated.where("t IS NULL").count() == 0
    pairs = spark.createDataFrame([(1.0, 2.0), (2.0, None), (None, 1.0)], "y double, p double")
    assert eval_regression(pairs, "y", "p").first()["rmse"] == 1.0
    plan = split_time(df, "t", 0.2, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # the payload does not move


def test_page_moves_only_its_rows(spark):
    df = table(spark, SF, "orders").select("o_orderkey", "o_orderdate")
    for rpb in (10**6, 1000):
        p = O.page(df, 40, 13, ["o_orderdate", "o_orderkey"], rows_per_bucket=rpb).orderBy("row_number").toPandas()
        want = df.toPandas().sort_values(["o_orderdate", "o_orderkey"]).o_orderkey[39 * 13:40 * 13]
        assert list(p.o_orderkey) == list(want) and list(p.row_number) == list(range(39 * 13 + 1, 40 * 13 + 1))
    assert O.page(df, 10**6, 10, ["o_orderkey"]).count() == 0


def test_directory_of_many_levels(spark, monkeypatch):
    """Nodes stay small, every cut is in one of them, and the buckets are ranges of the order."""
    from pyspark.sql import functions as F

    df = spark.range(3000).select(((F.col("id") * 7919) % 3000).alias("c0"), (F.col("id") % 3).alias("c1"))
    for fan, want in ((256, 3000), (4, 700), (256, 256), (256, 257)):
        monkeypatch.setattr(O, "FAN", fan)
        monkeypatch.setattr(O, "_BITS", fan.bit_length() - 1)
        nodes = O._directory(df, ["c0"], 3000, want, 3)
        assert nodes.agg(F.max(F.size("cuts")), F.sum(F.size("cuts"))).first()[:] == (min(fan, want) - 1, want - 1)
        d, nb = O.with_buckets(df, ["c0"], rows_per_bucket=3000 / want)
        assert nb == want
        got = sorted(d.collect())
        assert [r["_bk"] for r in got] == sorted(r["_bk"] for r in got) and len({r["_bk"] for r in got}) > want * 0.6
        rn = O.global_row_number(df, ["c0"], rows_per_bucket=3000 / want).collect()
        assert all(r.row_number == r.c0 + 1 for r in rn)


def test_names_of_helpers_are_free(spark):
    """Columns with every helper name pass through ordered steps, splits and encoders unchanged."""
    from quarry.operators import charts, encode, mlprep, values
    from quarry.operators.distribution import quantile_transform

    names = ["id", "_bk", "_h", "_first", "first", "digest", "undated", "_undated", "_value", "_code", "_local", "_off", "_c", "_b0", "_l0", "_cuts",
             "value", "code", "k0", "c0", "c3", "at0", "share0", "_qt_in0", "v", "min", "bin", "y", "count", "q1", "_number", "split", "tie", "pos", "g0"]
    rows = [(i, *[(i * (k + 3)) % 11 if (i + k) % 5 else None for k in range(len(names) - 1)]) for i in range(60)]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` long" for n in names))
    whole = sorted(map(tuple, rows))

    def same(out, *changed):
        keep = [n for n in names if n not in changed]
        assert [n for n in out.columns if n not in changed][: len(keep)] == keep
        idx = [names.index(n) for n in keep]
        assert sorted(tuple(r) for r in out.select(*keep).collect()) == sorted(tuple(r[i] for i in idx) for r in whole)

    for rpb in (10**6, 7):
        same(mlprep.split_random(df, "id", rows_per_bucket=rpb), "split")
        same(mlprep.split_time(df, "_first", tiebreak=["id"], rows_per_bucket=rpb), "split")
        same(O.forward_fill(df, ["_bk"], ["id"], rows_per_bucket=rpb), "_bk")
        same(O.backward_fill(df, ["_cuts"], ["id"], ["_value"], rows_per_bucket=rpb), "_cuts")
        same(O.page(df, 1, 60, ["id"], rows_per_bucket=rpb))
    same(encode.label_encoder(df, ["_value"]), "_value")
    same(encode.label_encoder(df, ["c0", "value"], max_bytes=0), "c0", "value")
    same(encode.ordinal_encoder(df, ["code"], order=["3"]), "code")
    same(mlprep.encode_target(df, df, "value", "code")[0], "code")
    same(quantile_transform(df, ["_qt_in0", "share0"], "uniform"), "_qt_in0", "share0")
    hot = encode.onehot_encoder(spark.createDataFrame([("b_c", "c", 1), ("x", "y", 2)], "a string, a_b string, a_x long"), ["a", "a_b"], drop_first=False)
    assert len(set(hot.columns)) == len(hot.columns) == 5
    for group in ("v", "min", "q1", "g0"):
        box = charts.chart_box(df, "id", group)
        assert len(set(box.columns)) == len(box.columns) and box.count() == len({r[names.index(group)] for r in rows})
    hist = charts.chart_histogram(df, "id", "bin", bins=3)
    assert hist.columns[1] == "_bin" and hist.count() == 3 * len({r[names.index("bin")] for r in rows})
    bar = charts.chart_bar(df, "y", "id")
    assert bar.columns == ["_y", "y"] and sum(r.y for r in bar.collect()) == sum(range(60))
    assert charts.chart_pie(df, "value").columns == ["_value", "value"]
    assert values.histogram(df, ["v"], bins=2).count() == 2


def test_the_search_for_buckets_runs_once_a_row(spark):
    """Keys at ranks: rows are read for the sample and for the search, not again for each count."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(x):
        read.add(1)
        return x

    df = spark.range(0, 4000, 1, 4).select(seen.asNondeterministic()("id").alias("k"))
    assert O.keys_at(df, ["k"], [10, 3900], 4000, rows_per_bucket=100) == [((9,), 9, 1), ((3899,), 3899, 1)]
    assert read.value <= 12000  # the sample is sorted, which reads twice


def test_names_that_clash_fills_and_encodes_once(spark, tmp_path):
    """What the ordered fill and the dictionaries shuffle is written, so the split and its readers don't do it again."""
    from quarry.queries.scale_q import names_that_clash

    rows = [(i, i % 7, datetime.datetime(2020, 1, 1), float(i), "5-LOW" if i % 2 else "1-URGENT") for i in range(1, 2001)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp, o_totalprice double, o_orderpriority string").write.parquet(
        str(tmp_path / "orders.parquet"))
    out = names_that_clash(spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    got = {r.digest: r for r in out.collect()}
    assert len(got) == 2000 and sum(r.split == "val" for r in got.values()) == 400
    assert all(got[i].first == (i if i % 7 else (i - 1 or None)) and got[i]._bk == got[i].code == i % 7 for i in got)
