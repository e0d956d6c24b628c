"""Co-moments, tails, silhouettes, keyed stores, dependencies, time limits and fitted selection."""

import io
import math
import os
import random
import threading
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from tabulon.functions.tails import chi_square_tail, log_gamma
from tabulon.operators import comoments as C
from tabulon.operators import metrics as X
from tabulon.operators import models as M
from tabulon.operators import profile as P
from tabulon.operators import reports, sessions as S, sketches
from tabulon.operators.dependencies import closure, run_order
from tabulon.operators.features import rank_features
from tabulon.operators.selection import FeatureSelector, FeatureSelectorModel
from tabulon.operators.side_by_side import side_by_side
from tabulon.plans.catalog import QUERIES
from tabulon.plans.queries_tables import turn_slots, typed_workbook
from tabulon.plans.run import Options, run
from tabulon.sources import store, workbooks
from tabulon.streaming.slots import folded_sessions, start_fold


@pytest.fixture(scope="module")
def wide():
    rng = np.random.default_rng(0)
    x = rng.normal(1e6, 1, (300, 200))
    x[:, 7] += 3 * x[:, 8]
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 3], x[:, 5] = 7.1, np.nan
    return x


def test_correlations_of_two_hundred_columns_in_one_scan(spark, wide):
    df = spark.createDataFrame(wide.tolist(), ", ".join(f"c{i:03} double" for i in range(200))).repartition(5)
    got = {(r["a"], r["b"]): r["r"] for r in P.correlations(df).collect()}
    want = pd.DataFrame(wide).corr().to_numpy()
    assert len(got) == 200 * 199 // 2
    for (a, b), r in got.items():
        w = want[int(a[1:]), int(b[1:])]
        assert (r is None) == bool(np.isnan(w)) and (r is None or abs(r - w) < 1e-8)


def test_the_plan_reads_the_table_once(spark, load):
    lineitem = load("lineitem")
    few, many = ["l_quantity", "l_tax", "l_discount"], [f"c{i}" for i in range(20)]
    for df, columns in ((lineitem, few), (lineitem.select(*[(F.col("l_tax") * i + F.col("l_quantity")).alias(c) for i, c in enumerate(many)]), many)):
        plan = P.correlations(df, columns)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1


def test_few_and_many_columns_give_the_same(spark, wide):
    df = spark.createDataFrame(wide[:, 2:8].tolist(), ", ".join(f"c{i} double" for i in range(6)))
    few = {(r["a"], r["b"]): r["r"] for r in P.correlations(df).collect()}
    many = {(r["a"], r["b"]): r["r"] for r in C.correlation_pairs(C.comoments(df), df.columns).collect()}
    assert few.keys() == many.keys()
    assert all((few[k] is None) == (many[k] is None) and (few[k] is None or abs(few[k] - many[k]) < 1e-9) for k in few)


def test_states_of_parts_merge_to_the_state_of_all(wide):
    a, b = slice(0, 64), slice(64, 128)
    whole = C.tile_state(wide, a, b)
    parts = None
    for rows in np.array_split(wide, 17):
        parts = C.merged(parts, C.tile_state(rows, a, b))
    assert np.allclose(whole, C.merged(C.tile_state(wide[:0], a, b), parts), rtol=1e-9, atol=1e-6)


def test_spreads_of_each_column(spark):
    df = spark.createDataFrame([(1.0, None, 5), (3.0, None, 5), (float("nan"), None, 5)], "a double, b double, c int")
    got = {r["column"]: tuple(r)[1:] for r in C.spreads(C.comoments(df), df.columns).collect()}
    assert got == {"a": (2, 2.0, 2.0), "b": (0, None, None), "c": (3, 5.0, 0.0)}


def test_rank_correlation_with_a_value_on_half_of_the_rows(spark):
    rng = random.Random(1)
    rows = [(float(rng.choice([0, 0, 0, 1, 2])), float(rng.randrange(1000)), rng.choice([None, 1.0, 2.5])) for _ in range(600)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    got = {(r["a"], r["b"]): r["r"] for r in P.wide_correlations(df, ["x", "y", "z"]).collect()}
    want = pd.DataFrame(rows, columns=["x", "y", "z"]).dropna().corr("pearson") * 0 + pd.DataFrame(rows, columns=["x", "y", "z"]).dropna().rank().corr()
    assert all(abs(got[a, b] - want.loc[a, b]) < 1e-9 for a, b in got) and len(got) == 3
    assert P.wide_correlations(df.where("x > 5"), ["x", "y"]).where("r IS NOT NULL").count() == 0


def test_tail_probabilities(spark):
    rows = [(k, x) for k in (1, 2, 4, 10, 400) for x in (0.0, 0.1, 1.0, 3.84, 0.9 * k, float(k), 1.1 * k + 2, k + 6 * math.sqrt(2 * k))]
    df = spark.createDataFrame(rows, "k int, x double").select("k", "x", chi_square_tail(F.col("x"), F.col("k")).alias("p"), log_gamma(F.col("k") / 2).alias("g"))
    for k, x, p, g in df.collect():
        terms = [math.exp(j * math.log(max(x, 1e-300) / 2) - x / 2 - math.lgamma(j + 1)) if x else float(j == 0) for j in range(k // 2)]
        want = math.erfc(math.sqrt(x / 2)) if k == 1 else math.fsum(terms)
        assert abs(p - want) < 1e-9 and abs(g - math.lgamma(k / 2)) < 1e-9 * max(1, abs(g))
    known = spark.range(1).select(chi_square_tail(F.lit(11.0705), F.lit(5)).alias("a"), chi_square_tail(F.lit(51.0), F.lit(51)).alias("b")).first()
    assert abs(known["a"] - 0.05) < 1e-6 and 0.47 < known["b"] < 0.49


def test_one_level_cannot_be_tested(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "y")], "a string, b string")
    row = P.chi_square_test(df, "a", "b").first()
    assert (row["n"], row["degrees"], row["p_value"]) == (2, 0, None)


def test_silhouette_matches_all_pairs(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(1e5, 1, (60, 3))
    labels = rng.integers(0, 3, 60)
    labels[0] = 9
    x[labels == 1] += 4
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    want = {}
    for i, c in enumerate(labels):
        if (labels == c).sum() == 1:
            want.setdefault(c, []).append(0.0)
            continue
        a = d[i, labels == c].sum() / ((labels == c).sum() - 1)
        b = min(d[i, labels == o].mean() for o in set(labels) - {c})
        want.setdefault(c, []).append((b - a) / max(a, b))
    df = spark.createDataFrame([(int(c), v.tolist()) for c, v in zip(labels, x)] + [(None, [1.0, 2.0, 3.0])], "prediction int, features array<double>")
    got = {r["cluster"]: r["silhouette"] for r in X.silhouette(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[c] - np.mean(v)) < 1e-6 for c, v in want.items())
    assert [r["silhouette"] for r in X.silhouette(df.where("prediction = 1")).collect()] == [0.0]


def files_of(path):
    found = {}
    for folder, _, names in os.walk(path):
        for n in names:
            if n.endswith(".parquet"):
                found[os.path.join(folder, n)] = os.stat(os.path.join(folder, n)).st_mtime_ns
    return found


def test_a_store_rewrites_only_touched_buckets_and_can_be_replayed(spark, tmp_path):
    path, merge = str(tmp_path / "store"), store.latest_rows(["k"], ["t"])
    rows = spark.range(200).select(F.col("id").alias("k"), F.lit(1).alias("t"), F.lit("old").alias("v"))
    assert store.read_store(spark, path, rows.schema).count() == 0
    assert store.update_store(rows, path, ["k"], merge, 0, buckets=16) == 16
    before = files_of(path)
    late = spark.createDataFrame([(7, 2, "new"), (7, 0, "stale"), (None, 1, "nobody")], "k long, t int, v string")
    touched = store.update_store(late, path, ["k"], merge, 1, buckets=16)
    after = files_of(path)
    assert touched <= 2 and len(before.keys() - after.keys()) <= 2
    assert all(after[f] == before[f] for f in before.keys() & after.keys())
    got = sorted(map(tuple, store.read_store(spark, path).collect()), key=str)
    assert len(got) == 201 and (7, 2, "new") in got and (None, 1, "nobody") in got
    store.update_store(late, path, ["k"], merge, 1, buckets=16)
    assert sorted(map(tuple, store.read_store(spark, path).collect()), key=str) == got
    store.update_store(late.where("v = 'stale'"), path, ["k"], merge, 2, buckets=16)
    assert sorted(map(tuple, store.read_store(spark, path).collect()), key=str) == got


def test_an_update_that_ended_half_way_is_completed(spark, tmp_path):
    path, merge = str(tmp_path / "store"), store.latest_rows(["k"], ["t"])
    rows = spark.range(50).select(F.col("id").alias("k"), F.lit(1).alias("t"))
    store.update_store(rows, path, ["k"], merge, "a", buckets=4)
    newer = rows.withColumn("t", F.lit(2))
    store.update_store(newer, path, ["k"], merge, "b", buckets=4)
    for f in files_of(path):  # as if the run had ended between taking away the old rows and moving in the new
        os.rename(f, f + ".gone")
    store.update_store(newer, path, ["k"], merge, "b", buckets=4)
    assert store.read_store(spark, path).where("t = 2").count() == 50


def test_stream_state_is_bounded_and_nothing_is_lost(spark, load, tmp_path):
    turns = turn_slots(load("conversations"))
    source, out, state = (str(tmp_path / n) for n in ("turns", "out", "state"))
    sizes = []
    parts = [turns.where("session_id % 4 <> 3 AND turn % 2 = 0"), turns.where("session_id % 4 = 3"), turns.where("session_id % 4 <> 3 AND turn % 2 = 1")]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
        query = start_fold(spark.readStream.schema(turns.schema).parquet(source), out, state, idle=1.0)
        query.awaitTermination()
        sizes.append((part.select("session_id").distinct().count(), query.lastProgress["stateOperators"][0]["numRowsTotal"]))
        time.sleep(1.5)
    assert sizes[0][1] >= sizes[0][0] > 0
    # The sessions of the first batch have left when the second is done, and so on.
    assert sizes[1][1] < sizes[0][1] and sizes[1][1] <= sizes[1][0] * (sizes[0][1] / sizes[0][0]) + 1
    got, want = folded_sessions(spark, out), S.fold_slots(turns)
    assert got.count() == want.count() == got.select("session_id").distinct().count()
    assert got.select(*want.columns).exceptAll(want).count() == 0


def brute_order(requests, edges):
    needs = {}
    for s, r in edges:
        needs.setdefault(s, set())
        if r is not None:
            needs.setdefault(r, set())
            needs[s].add(r)
    reach = {}
    for s in needs:
        seen, todo = set(), list(needs[s])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += needs[x]
        reach[s] = seen
    knots = {s for s in needs if s in reach[s]}
    out = []
    for session in {s for s, _ in requests}:
        mine = {x for s, x in requests if s == session and x is not None}
        run_ = set()
        for x in mine:
            if x not in needs:
                out.append((session, x, None, "unknown stage"))
            elif reach[x] & knots:
                out.append((session, x, None, f"requires itself: {min(reach[x] & knots)}"))
            else:
                run_ |= {x} | reach[x]
        out += [(session, x, i, None) for i, x in enumerate(sorted(run_, key=lambda x: (len(reach[x]), x)), 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [0, 1])
def test_run_order_of_any_prerequisites(spark, seed):
    rng = random.Random(seed)
    names = [f"s{i:02}" for i in range(30)]
    edges = [(names[i], names[j]) for i in range(30) for j in range(i) if rng.random() < 0.08]
    edges += [("s20", "s25"), ("s25", "s20"), ("s29", "s29"), ("s00", None), ("s03", None), (None, "s01"), *edges[:3]]
    requests = [(k, rng.choice([*names, "other", None])) for k in range(40) for _ in range(rng.randrange(4))]
    got = run_order(spark.createDataFrame(requests, "session_id long, stage string"), spark.createDataFrame(edges, "stage string, requires string"))
    want = brute_order(requests, [e for e in edges if e[0] is not None] + [("s01", None)])
    assert sorted(map(tuple, got.collect()), key=str) == want
    for s, before in closure(spark.createDataFrame(edges, "stage string, requires string")).collect():
        at = {(r["session_id"], r["stage"]): r["position"] for r in got.collect() if r["position"]}
        assert all(p > at[k, before] for (k, x), p in at.items() if x == s)


def test_run_order_of_empty_tables(spark):
    none = spark.createDataFrame([], "stage string, requires string")
    asked = spark.createDataFrame([(1, "a")], "session_id long, stage string")
    assert [tuple(r) for r in run_order(asked, none).collect()] == [(1, "a", None, "unknown stage")]
    assert run_order(asked.where("session_id > 1"), none).count() == 0


def test_tasks_run_side_by_side_and_end_at_their_limit(spark):
    def wait(seconds):
        time.sleep(seconds)
        return seconds

    def job():
        return spark.range(10).count()

    def endless():
        spark.range(4).mapInPandas(lambda batches: (time.sleep(600) or b for b in batches), "id long").count()

    start = time.monotonic()
    tasks = {"slow": lambda: wait(60), "a": lambda: wait(1), "b": lambda: wait(1), "job": job, "bad": lambda: 1 // 0, "endless": endless}
    got = side_by_side(spark, tasks, 4, parallel=3)
    assert time.monotonic() - start < 30 and list(got) == list(tasks)
    assert got["a"] == got["b"] == 1 and got["job"] == 10 and isinstance(got["bad"], ZeroDivisionError)
    assert str(got["slow"]) == str(got["endless"]) == "time limit of 4 s"
    assert spark.range(5).count() == 5


def test_selection_learns_from_training_rows_only(spark, tmp_path):
    rows = spark.range(400).select(
        "id", (F.col("id") % 17).cast("double").alias("a"), (F.col("id") * 3 % 101).alias("b"),
        F.when(F.col("id") < 300, 1.0).otherwise(F.col("id")).alias("late"), F.when(F.col("id") >= 300, 2).alias("gap"),
    ).withColumn("twin", 5 - 2 * F.col("a"))
    train, columns = rows.where("id < 300"), ["a", "b", "late", "gap", "twin"]
    model = FeatureSelector(inputCols=columns).fit(train)
    assert model.kept == ["a", "b"]
    assert {r["column"]: r["reason"] for r in model.report(spark).collect()} == {
        "a": None, "b": None, "late": "constant", "gap": "missing", "twin": "duplicate of a"
    }
    other = FeatureSelector(inputCols=columns).fit(rows)
    assert "late" in other.kept
    PipelineModel([model]).write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert again.transform(rows).columns == ["id", "a", "b"] and isinstance(again.stages[0], FeatureSelectorModel)
    assert FeatureSelector(inputCols=[]).fit(rows).transform(rows).columns == rows.columns
    assert FeatureSelector(inputCols=columns).fit(rows.where("id < 0")).kept == []


class Hanging(LogisticRegression):
    def _fit(self, dataset):
        time.sleep(600)


def test_a_run_takes_candidates_grids_and_steps_of_the_caller(spark, tmp_path):
    rows = spark.range(600).select(
        (F.col("id") * 7 % 23).cast("double").alias("x"), (F.col("id") * 5 % 19).cast("double").alias("y"), F.rand(1).alias("z"),
    ).withColumn("goal", F.when(F.col("x") > F.col("y"), "up").otherwise("down")).withColumn("copy", 3 * F.col("x"))
    rows.coalesce(2).write.parquet(str(tmp_path / "rows.parquet"))
    own = LogisticRegression(maxIter=3)
    options = Options(
        candidates={"hanging": Hanging(), "own": own},
        grids={"own": ParamGridBuilder().addGrid(own.regParam, [0.0, 0.5]).build()},
        steps=[SQLTransformer(statement="SELECT *, x - y AS gap FROM __THIS__")],
        time_limit=25.0,
    )
    info = {"data_path": "rows.parquet", "task_type": "classification", "target_column": "goal", "agents_to_call": ["ModelTrainingAgent"]}
    results = run(spark, info, str(tmp_path / "out"), str(tmp_path), partitions=2, options=options)
    assert results.ok
    board = {r["model"]: r for r in results.leaderboard.collect()}
    assert board["hanging"]["reason"] == "time limit of 25 s" and board["own"]["value"] > 0.9
    report = results.status["FeatureEngineeringAgent"].first()
    assert "x" in report["dropped_features"] and "gap" in report["selected_features"] and "copy" in report["selected_features"]
    scored = M.score(M.load_pipeline(str(tmp_path / "out" / "transformers")).transform(rows), results.model_path)
    assert scored.count() == 600 and "prediction" in scored.columns


def test_a_large_workbook_is_parsed_by_many_tasks(spark, monkeypatch):
    rng = random.Random(4)
    frame = pd.DataFrame({
        "n": range(30_000), "t": [rng.choice(["a", "b & <c>", "</row>", "é\n", " x "]) for _ in range(30_000)],
        "d": [pd.Timestamp(2020, 1, 1) + pd.Timedelta(hours=i) for i in range(30_000)], "b": [i % 3 == 0 for i in range(30_000)],
    })
    content = typed_workbook(frame)
    parts = list(workbooks.sheet_parts(content, 200_000))
    assert len(parts) > 5 and [p[4] for p in parts] == [True] + [False] * (len(parts) - 1)
    books = spark.createDataFrame([("one.xlsx", content)], "path string, content binary")
    got = workbooks.parse_workbooks(books)
    assert [f.simpleString() for f in got.schema] == ["n:bigint", "t:string", "d:timestamp_ntz", "b:boolean"]
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    rows = [(r.n, r.t, r.d.to_pydatetime(), r.b) for r in frame.itertuples(index=False)]
    want = spark.createDataFrame(rows, "n long, t string, d timestamp_ntz, b boolean")
    assert got.exceptAll(want).count() == 0 and got.count() == 30_000


def test_sheets_that_cannot_be_cut_are_read_whole():
    rows = "".join(f"<x:row><x:c><x:v>{i}</x:v></x:c></x:row>" for i in range(500))
    plain = f'<?xml version="1.0"?><x:worksheet xmlns:x="{workbooks.MAIN[1:-1]}"><x:cols/><x:sheetData>{rows}</x:sheetData><x:z/></x:worksheet>'
    blocks = list(workbooks._row_blocks(io.BytesIO(plain.encode()), 1000))
    assert len(blocks) > 10
    assert [r[0][1] for b in blocks for r in workbooks._rows(b, "{}", "[[], false]")] == [str(i) for i in range(500)]
    odd = plain.replace("<x:v>499</x:v>", "<x:v><![CDATA[</x:row>]]></x:v>").replace("<x:cols/>", "")
    blocks = list(workbooks._row_blocks(io.BytesIO(odd.encode()), 30_000))
    assert sum(1 for b in blocks for _ in workbooks._rows(b, "{}", "[[], false]")) == 500
    wide = plain.encode("utf-16")
    assert list(workbooks._row_blocks(io.BytesIO(wide), 1000)) == [wide]
    empty = plain.replace(f"<x:sheetData>{rows}</x:sheetData>", "<x:sheetData/>").encode()
    assert [r for b in workbooks._row_blocks(io.BytesIO(empty), 100) for r in workbooks._rows(b, "{}", "[[], false]")] == []


def test_listing_is_tested_in_place_or_reduced_by_depth(spark, monkeypatch):
    files = spark.createDataFrame([(p,) for p in ("/a/b/c.txt", "/a//x/./y", "/q/r/s/t/u", "/a/b/d.txt", "/")], "path string")
    claimed = spark.createDataFrame([(p,) for p in ("/a/b", "/a/b/c.txt", "/a/c", "/a/x/y", "/q/r/s/t", "/q/r/s/t/u/v")], "path string")
    want = ["/a/b", "/a/b/c.txt", "/a/x/y", "/q/r/s/t"]
    assert sorted(r[0] for r in reports.listed(claimed, files).collect()) == want
    monkeypatch.setattr(reports, "fits_broadcast", lambda *_: False)
    assert sorted(r[0] for r in reports.listed(claimed, files).collect()) == want
    assert reports.listed(claimed.where("path = ''"), files).count() == 0


def test_states_of_parts_with_gaps_and_empty_parts(spark, tmp_path):
    path = str(tmp_path / "states")
    rows = spark.range(3000).select(
        (F.col("id") * 1.0).alias("x"), F.when(F.col("id") >= 2000, F.col("id")).alias("late"), F.lit(None).cast("double").alias("none"),
        F.when(F.col("id") % 2 == 0, float("nan")).otherwise(1e9 + F.col("id")).alias("far"),
    )
    for part, when in (("a", "x < 1000"), ("b", "x >= 1000 AND x < 2000"), ("c", "x >= 2000"), ("empty", "x < 0"), ("b", "x >= 1000 AND x < 2000")):
        sketches.write_part(rows.where(when), path, part)
    got = {r["column"]: r for r in sketches.stored_profile(spark, path).collect()}
    assert {c: (r["rows"], r["missing"]) for c, r in got.items()} == {"x": (3000, 0), "late": (3000, 2000), "none": (3000, 3000), "far": (3000, 1500)}
    assert (got["x"]["min"], got["x"]["max"], got["x"]["mean"]) == (0.0, 2999.0, 1499.5)
    assert abs(got["far"]["std"] - np.std(np.arange(1, 3000, 2), ddof=1)) < 1e-3 and abs(got["x"]["std"] - np.std(np.arange(3000), ddof=1)) < 1e-9
    assert got["none"]["q50"] is None and got["none"]["mean"] is None and got["none"]["distinct_count"] == 0
    assert all(abs(got["x"][f"q{q}"] - 30 * q) < 3000 * 0.015 for q in (25, 50, 75)) and abs(got["x"]["distinct_count"] - 3000) < 150
    states = sketches.merge_states(sketches.column_states(rows.where("x < 1500")).unionByName(sketches.column_states(rows.where("x >= 1500"))))
    ranks = {r["column"]: r["rank"] for r in sketches.rank_of(states, F.lit(1500.0)).collect()}
    assert abs(ranks["x"] - 0.5) < 0.015 and ranks["none"] is None


def test_features_with_one_value_are_ranked_last(spark):
    rows = spark.range(50).select(F.lit(3.0).alias("same"), (F.col("id") * 2.0).alias("good"), (F.col("id") % 7).alias("other"), F.col("id").cast("double").alias("y"))
    ranked = [(r["column"], r["score"]) for r in rank_features(rows, "y", 3).orderBy("rank").collect()]
    assert ranked[0] == ("good", pytest.approx(1.0)) and ranked[-1] == ("same", None)


def test_a_stream_reads_a_table_of_many_files_and_an_empty_one(spark, sf, tmp_path):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    turns.repartition(3).write.parquet(str(tmp_path / "many/conversations.parquet"))
    turns.limit(0).write.parquet(str(tmp_path / "none/conversations.parquet"))
    # A neighbour whose name is alike is another table.
    turns.withColumn("conv_id", -F.col("conv_id") - 1).write.parquet(str(tmp_path / "many/conversations.parquet2"))
    got = QUERIES["slot_fold_stream"](spark, str(tmp_path / "many"))
    assert sorted(got.collect(), key=str) == sorted(QUERIES["slot_fold"](spark, sf).select(*got.columns).collect(), key=str)
    empty = QUERIES["slot_fold_stream"](spark, str(tmp_path / "none"))
    assert empty.count() == 0 and empty.dtypes == got.dtypes


def test_candidates_read_partitions_of_bounded_size(spark):
    """The given number of partitions is the least; more rows make more of them, not larger ones."""
    seen = []

    class Counts:
        def fit(self, train):
            seen.append(train.rdd.getNumPartitions())
            raise ValueError("counted")

    rows = spark.range(800_000).selectExpr("id", "id % 7 AS x", "double(id) AS label")
    ready = VectorAssembler(inputCols=["id", "x"], outputCol="features").transform(rows)
    results = M.train_all(ready, ready.limit(10), {"counts": Counts()}, "regression", partitions=1)[1]
    assert results.first()["reason"] == "counted" and seen == [math.ceil(800_000 * 6 / M.PART_VALUES)] and seen[0] > 1
    M.train_all(ready.limit(10), ready.limit(10), {"counts": Counts()}, "regression", partitions=2)
    assert seen[1:] == [2]


def test_large_pieces_are_dealt_out_and_small_ones_stay(spark, tmp_path, monkeypatch):
    """What a candidate's task reads is bounded where no number of partitions is given, and in a whole run."""
    seen = []

    class Counts:
        def fit(self, train):
            seen.append(train.rdd.getNumPartitions())
            raise ValueError("counted")

    rows = spark.range(0, 60_000, 1, 3).selectExpr("id % 1009 AS x", "id * 7 % 1013 / 3 AS y", "double(id % 977) AS label")
    ready = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(rows)
    monkeypatch.setattr(M, "PART_VALUES", 150_000)
    for df in (ready, ready.coalesce(1), ready.where("x < 0")):
        M.train_all(df, ready.limit(10), {"counts": Counts()}, "regression")
    assert seen[:2] == [3, math.ceil(60_000 * 6 / 150_000)] and len(seen) == 3

    rows.coalesce(1).write.parquet(str(tmp_path / "rows.parquet"))
    info = {"data_path": "rows.parquet", "task_type": "regression", "target_column": "label", "agents_to_call": ["ModelTrainingAgent"]}
    monkeypatch.setattr(M, "regression_models", lambda: {"counts": Counts()})
    for partitions in (1, None):
        run(spark, info, str(tmp_path / f"out-{partitions}"), str(tmp_path), partitions=partitions)
    assert len(seen) == 5 and min(seen[3:]) >= 60_000 * 0.7 * 5 // 150_000 + 1 > 1


def test_workers_hold_few_workbooks_at_a_time(spark):
    psutil, peak, done = pytest.importorskip("psutil"), [0], threading.Event()

    def make(batches):
        rng = random.Random(3)
        for batch in batches:
            for i in batch["id"].tolist():
                frame = pd.DataFrame({"n": range(10), "t": [rng.randbytes(100_000).hex() for _ in range(10)]})
                yield pd.DataFrame({"path": [f"book-{i}"], "content": [typed_workbook(frame)]})

    def watch():
        while not done.wait(0.05):
            for p in psutil.Process().children(recursive=True):
                try:
                    if "java" not in p.name():
                        peak[0] = max(peak[0], p.memory_info().rss / 1e6)
                except psutil.Error:
                    pass

    books = spark.range(0, 200, 1, 1).mapInPandas(make, "path string, content binary")
    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        got = workbooks.parse_workbooks(books).agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.min(F.length("t")).alias("t")).first()
    finally:
        done.set()
        watcher.join()
    assert tuple(got) == (2000, 200 * 45, 200_000)
    assert peak[0] < 300, f"{peak[0]:.0f} MB in one worker"
