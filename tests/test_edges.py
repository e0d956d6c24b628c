"""Small tables with the awkward cases: empty, null, NaN, one class, unseen, malformed."""

import io
import json
import os
import zipfile
from datetime import datetime

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from tabulon.functions import text as T
from tabulon.functions.bounded import render
from tabulon.functions.columns import literal_rows
from tabulon.operators import features as E
from tabulon.operators import models as M
from tabulon.operators import profile as P
from tabulon.operators import reports as D
from tabulon.operators import sessions as S
from tabulon.operators import transforms as R
from tabulon.operators.baselines import group_baseline
from tabulon.plans.queries_tables import turn_slots, workbook
from tabulon.plans.run import run
from tabulon.sources import readers, sinks
from tabulon.streaming.slots import folded_sessions, start_fold

SCHEMA = "id long, x double, c string, when timestamp, list array<int>, none string, flag boolean"


@pytest.fixture(scope="module")
def odd(spark):
    nan = float("nan")
    return spark.createDataFrame(
        [
            (1, 1.0, "a", None, [1], None, True), (2, nan, "b", None, None, None, False),
            (3, None, "a", None, [2, 3], None, True), (4, 4.0, None, None, [], None, None),
        ],
        SCHEMA,
    )


def by_column(df):
    return {r["column"]: r for r in df.collect()}


def test_missing_counts_nan_and_leaves_complex_alone(odd):
    got = {c: r["missing"] for c, r in by_column(P.missing(odd)).items()}
    assert got == {"id": 0, "x": 2, "c": 1, "when": 4, "list": 1, "none": 4, "flag": 1}


def test_kinds(odd):
    got = {c: r["kind"] for c, r in by_column(P.column_kinds(odd)).items()}
    assert got == {
        "id": "id", "x": "numeric", "c": "categorical", "when": "constant", "list": "complex",
        "none": "constant", "flag": "boolean",
    }


def test_profile_of_odd_and_of_empty_table(odd):
    full = by_column(P.profile(odd))
    assert full["x"]["mean"] == 2.5 and full["x"]["q50"] == 2.5 and full["c"]["mode"] == "a"
    empty = P.profile(odd.where("false"))
    assert empty.count() == 7
    assert P.profile_status(odd.where("false"), empty).first()["pipeline_status"] == "failed"


def test_profile_without_numbers_or_strings(spark):
    assert P.profile(spark.createDataFrame([([1],)], "a array<int>")).first()["kind"] == "complex"
    assert P.profile(spark.createDataFrame([("q",)], "a string")).first()["mode"] == "q"


def test_mode_of_long_texts(spark):
    long, other = "w" * 5000, "v" * 4999
    df = spark.createDataFrame([(long, "x"), (other, "x"), (long, "y"), (None, "y")], "t string, s string")
    got = by_column(P.categorical_summary(df))
    assert (got["t"]["mode"], got["t"]["mode_count"], got["t"]["distinct_count"]) == (long, 2, 2)
    assert (got["s"]["mode"], got["s"]["mode_count"]) == ("x", 2)


def test_histogram_of_constant(spark):
    got = P.histogram(spark.createDataFrame([(2.0,)] * 3, "x double"), "x", 4).collect()
    assert [(r["bin"], r["count"]) for r in got] == [(0, 3)]


def test_wide_table_is_split_into_passes(spark):
    df = spark.range(50).select(*[(F.col("id") * i).alias(f"c{i}") for i in range(70)])
    got = by_column(P.numeric_summary(df, exact=False))
    assert len(got) == 70 and got["c69"]["max"] == 69 * 49


def test_transform_edges(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "c string, x double")
    new = spark.createDataFrame([("a", 1.0), ("z", float("nan")), (None, None)], "c string, x double")
    assert [r["c_index"] for r in E.index_encode(train, new, "c").collect()].count(2) == 2
    assert {r["c_freq"] for r in E.frequency_encode(train, new, "c").where("c is null or c = 'z'").collect()} == {0.0}
    assert {r["c_target"] for r in E.target_encode(train, new, "c", "x").where("c is null or c = 'z'").collect()} == {3.0}
    hot = E.one_hot(train, new, "c").where("c = 'z' or c is null")
    assert all(r["c_a"] == r["c_b"] == 0 for r in hot.collect())
    filled = E.impute(train, new, "x", "median").collect()
    assert [r["x"] for r in filled] == [1.0, 3.0, 3.0] and [r["x_missing"] for r in filled] == [0, 1, 1]
    flat = spark.createDataFrame([(2.0,)] * 3, "x double")
    assert [r["x_z"] for r in E.standardize(flat, flat, ["x"]).collect()] == [0.0] * 3
    with pytest.raises(ValueError):
        E.one_hot(spark.range(50), spark.range(50), "id")


def test_group_baseline_of_unseen_group(spark):
    train = spark.createDataFrame([("a", "u"), ("a", "v"), ("b", "v")], "g string, y string")
    new = spark.createDataFrame([("a",), ("zz",), (None,)], "g string")
    got = [(r["g"], r["prediction"]) for r in group_baseline(train, new, "g", "y", "classification").collect()]
    assert sorted(got, key=str) == sorted([("a", "u"), ("zz", "v"), (None, "v")], key=str)


def test_fit_uses_train_rows_only(spark, tmp_path):
    plan = literal_rows(spark, [("x", 1, "impute_median"), ("x", 2, "clip"), ("x", 4, "standardize")], "column string, ordinal int, step string")
    train = spark.range(1, 101).select(F.col("id").cast("double").alias("x"))
    model = R.fit_transforms(train, plan, str(tmp_path / "t"))
    stats = model.transform(train).agg(F.avg("x"), F.stddev_samp("x")).first()
    assert stats[0] == pytest.approx(0, abs=1e-9) and stats[1] == pytest.approx(1)
    other = spark.createDataFrame([(1e9,), (None,), (50.5,)], "x double")
    got = [r["x"] for r in model.transform(other).collect()]
    assert got[1] == pytest.approx(0) and got[2] == pytest.approx(0) and got[0] == pytest.approx((149.25 + 0.75 - 50.5 + 0.0) / 29.011, abs=0.1)


def test_saved_pipeline_transforms_the_same(spark, load, tmp_path):
    part = load("part")
    model = R.fit_transforms(part, R.recommend(P.profile(part), "p_type"), str(tmp_path / "t"))
    M.save_pipeline(model, str(tmp_path / "m"))
    before, after = model.transform(part), M.score(part, str(tmp_path / "m"))
    assert before.columns == after.columns
    assert before.exceptAll(after).count() == 0 == after.exceptAll(before).count()


def test_recommended_plan_covers_every_step(spark, tmp_path):
    df = spark.range(400).select(
        F.col("id").alias("key"), F.lit(1).alias("same"),
        F.when(F.col("id") % 9 > 0, (F.col("id") % 97).cast("double")).alias("n"),
        F.when(F.col("id") % 50 == 0, 1e6).otherwise(F.col("id") % 31).cast("double").alias("far"),
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("it's \\"), (F.col("id") % 3).cast("string"))).alias("few"),
        F.concat(F.lit("v"), (F.col("id") % 60).cast("string")).alias("many"),
        F.timestamp_seconds(F.col("id") * 86400).alias("day"), (F.col("id") % 2 == 0).alias("flag"),
        F.repeat(F.concat(F.col("id").cast("string"), F.lit(" word ")), 10).alias("doc"),
        F.array("id").alias("list"), (F.col("id") % 2).alias("y"),
    ).withColumn("doc", F.when(F.col("key") > 1, F.col("doc")).otherwise(F.lit("word " * 20)))
    plan = R.recommend(P.profile(df), "y")
    steps = {(r["column"], r["step"]) for r in plan.collect()}
    assert {
        ("key", "drop"), ("same", "drop"), ("list", "drop"), ("n", "impute_median"), ("n", "standardize"), ("far", "clip"),
        ("few", "impute_mode"), ("few", "one_hot"), ("many", "frequency_encode"), ("day", "date_parts"), ("flag", "to_number"),
        ("doc", "text_size"),
    } <= steps
    assert not any(c == "y" for c, _ in steps)
    out = R.fit_transforms(df, plan, str(tmp_path / "t")).transform(df)
    assert {"few_it's \\0", "many_freq", "day_weekday", "doc_tokens", "flag", "n", "far", "y"} <= set(out.columns)
    assert out.where("n is null or many_freq is null").count() == 0
    assert out.agg(F.sum("`few_it's \\0`")).first()[0] > 130


def test_no_trainable_model_fails_the_stage(spark):
    bad = spark.createDataFrame([(1.0,)], "label double")
    _, rows = M.train_all(bad, bad, {"logistic_regression": LogisticRegression()}, "classification")
    report = M.training_report(rows).first()
    assert report["pipeline_status"] == "failed" and report["failed"] == 1
    assert not M.compare(rows, "classification").first()["is_best"]


def test_candidates_are_gated(spark):
    assert "gradient_boosted_trees" not in M.classification_models(3, True)
    assert "naive_bayes" not in M.classification_models(2, False)
    with pytest.raises(ValueError):
        M.candidates("reinforcement learning", None)


def test_run_reports_failures(spark, sf, tmp_path):
    out = str(tmp_path / "run")
    missing = run(spark, {"data_path": "nothing.parquet", "agents_to_call": ["ModelTrainingAgent"]}, out, base=sf)
    assert not missing.ok and list(missing.status) == ["EDAAgent"]
    saved = spark.read.json(out + "/reports/EDAAgent").first()
    assert saved["pipeline_status"] == "failed" and saved["pipeline_status_reason"]
    no_target = run(spark, {"data_path": "part.parquet", "target_column": "zzz", "agents_to_call": ["EDAAgent"]}, out, base=sf)
    assert no_target.status["EDAAgent"].first()["pipeline_status_reason"] == "target column not found"
    assert not run(spark, {"data_path": "part.parquet", "agents_to_call": ["Nope"]}, out, base=sf).ok


def test_run_end_to_end_on_csv(spark, load, tmp_path):
    load("orders").coalesce(1).write.option("header", True).csv(str(tmp_path / "orders.csv"))
    info = {"data_path": "orders.csv", "data_type": "csv", "task_type": "regression", "target_column": "o_totalprice", "agents_to_call": ["ModelTrainingAgent"]}
    results = run(spark, info, str(tmp_path / "out"), base=str(tmp_path))
    assert results.ok and results.stages == ["EDAAgent", "FeatureEngineeringAgent", "ModelTrainingAgent"]
    assert results.leaderboard.where("is_best").count() == 1
    assert sorted(os.listdir(tmp_path / "out" / "processed"))[-3:] == ["split=test", "split=train", "split=validation"]
    raw = readers.load_dataset(spark, info, str(tmp_path))
    scored = M.score(M.score(raw, str(tmp_path / "out" / "transformers")), results.model_path)
    assert scored.where("prediction is not null").count() == raw.count()
    unlabelled = M.score(raw.drop("o_totalprice"), str(tmp_path / "out" / "transformers"))
    assert "o_totalprice" not in unlabelled.columns and unlabelled.count() == raw.count()


def test_readers(spark, tmp_path):
    import pandas as pd

    (tmp_path / "books").mkdir()
    (tmp_path / "books" / "a.xlsx").write_bytes(workbook(pd.DataFrame({"ICD_CODE": ["A1", "A1", "B & <2>"], "n": [1, 2, 3]})))
    (tmp_path / "books" / "b.xlsx").write_bytes(workbook(pd.DataFrame({"n": [9], "ICD_CODE": ["B & <2>"]})))
    got = readers.read_table(spark, str(tmp_path / "books"), "excel", "ICD_CODE string, n long")
    assert sorted(tuple(r) for r in got.collect()) == [("A1", 1), ("A1", 2), ("B & <2>", 3), ("B & <2>", 9)]
    assert readers.read_table(spark, str(tmp_path / "books"), "excel").columns == ["ICD_CODE", "n"]
    assert {r["length"] for r in readers.read_table(spark, str(tmp_path / "books"), "images").collect()} == {
        os.path.getsize(tmp_path / "books" / f) for f in ("a.xlsx", "b.xlsx")
    }
    (tmp_path / "bad.csv").write_text("a,b\n1,x\nq,y\n")
    bad = readers.read_table(spark, str(tmp_path / "bad.csv"), "csv", "a int, b string, _corrupt_record string").cache()
    assert bad.where("_corrupt_record is not null").count() == 1
    (tmp_path / "docs").mkdir()
    for name, content in (("1", '{"session_id": 1}'), ("2", "{broken"), ("3", ""), ("4", " \n")):
        (tmp_path / "docs" / f"info_{name}.json").write_text(content)
    docs = readers.read_documents(spark, str(tmp_path / "docs"), "session_id long").collect()
    assert [r["is_valid"] for r in docs].count(True) == 1 and len(docs) >= 3
    assert readers.read_table(spark, str(tmp_path / "docs" / "info_1.json"), "text").count() == 1
    for info in ({}, {"data_path": ""}, {"data_path": "x.unknown"}):
        with pytest.raises(ValueError):
            readers.load_dataset(spark, info)


def sheet_bytes(rows, styles=""):
    """A workbook from rows of cell elements."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="x" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/a.xml"/></Relationships>')
        if styles:
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}">{styles}</styleSheet>')
        body = "".join(f"<row>{''.join(r)}</row>" for r in rows)
        z.writestr("xl/worksheets/a.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def test_workbooks_with_different_blank_and_repeated_headers_and_dates(spark, tmp_path):
    text = lambda at, v: f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
    number = lambda at, v, s=0: f'<c r="{at}" s="{s}"><v>{v}</v></c>'
    styles = '<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/></cellXfs>'
    first = [
        [text("A1", "a"), text("B1", "day"), text("D1", "a")],
        [number("A2", 1), number("B2", 44197, 1), number("C2", 0.5), text("D2", "x")],
        [number("A3", 2), number("B3", 44197.25, 2), '<c r="C3" t="e"><v>#N/A</v></c>', text("D3", "y")],
    ]
    second = [[text("A1", "c"), text("B1", "a")], [f'<c r="A2" t="b"><v>1</v></c>', number("B2", 3)]]
    (tmp_path / "1.xlsx").write_bytes(sheet_bytes(first, styles))
    (tmp_path / "2.xlsx").write_bytes(sheet_bytes(second))
    got = readers.read_table(spark, str(tmp_path), "excel")
    assert [f.simpleString() for f in got.schema] == [
        "a:bigint", "day:timestamp_ntz", "column_2:double", "a_2:string", "c:boolean"
    ]
    assert sorted(map(tuple, got.collect())) == [
        (1, datetime(2021, 1, 1), 0.5, "x", None), (2, datetime(2021, 1, 1, 6), None, "y", None), (3, None, None, None, True)
    ]


def test_workbook_with_shared_strings(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="x" sheetId="1" r:id="r7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r7" Target="/xl/worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>code</t></si><si><r><t>A</t></r><r><t>1</t></r></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>2.0</v></c></row><row><c r="C3"><v>5</v></c></row></sheetData></worksheet>')
    got = readers.read_table(spark, str(tmp_path), "excel", "code string, n int").collect()
    assert [tuple(r) for r in got] == [("A1", 2), (None, 5)]


def test_report_sink_always_writes(spark, odd, tmp_path):
    row = spark.createDataFrame([("EDAAgent", None, float("nan"))], "stage string, reason string, score double")
    sinks.write_report(row.withColumn("at", F.current_timestamp()), str(tmp_path / "r"))
    (line,) = [r["value"] for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert json.loads(line)["stage"] == "EDAAgent" and "reason" in json.loads(line)


def texts(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["o"] for r in df.select("i", expr(F.col("t")).alias("o")).orderBy("i").collect()]


def test_error_signature(spark):
    cases = ["", "  \n\t\n", "one", "a\n\n b \r\n\n", "x\ry", "E: 1\n   "]
    assert texts(spark, cases, T.error_signature) == ["", "", "one", " b", "y", "E: 1"]


def test_fences(spark):
    cases = ["```python\n x = 1\n```", "```python\nopen", "no", "a ```python\n1\n``` b ```python 2```", "```python\n```"]
    assert texts(spark, cases, T.python_blocks) == [["x = 1"], [], [], ["1", "2"], [""]]
    assert texts(spark, cases[:2], T.first_block) == ["x = 1", None]
    assert texts(spark, ['```json\n{"a": 1}\n```', '{"a": 1}\n'], T.strip_json_fence) == ['{"a": 1}'] * 2


def test_slots(spark):
    cases = [
        "type of data is csv, target column is Quality and task type is classification",
        "data/iris.csv, data is of type csv, classification and target column is variety, full pipeline",
        "- data_path: data/b.csv\n- data_type: csv\n- task_type: classification\n- target_column: Quality\n- task_intent: full_pipeline",
        "hello",
    ]
    names = list(T.extract_slots(F.col("t")))
    got = texts(spark, cases, lambda t: F.struct(*[c.alias(n) for n, c in T.extract_slots(t).items()]))
    assert [[r[n] for n in names] for r in got] == [
        [None, "csv", "classification", "Quality", None],
        ["data/iris.csv", "csv", "classification", "variety", "full_pipeline"],
        ["data/b.csv", "csv", "classification", "Quality", "full_pipeline"],
        [None] * 5,
    ]


def test_stage_requests(spark):
    df = spark.createDataFrame([(["EdaAgent", "EDAAgent", "x"],), ([],), (None,), (["ModelTrainingAgent"],)], "a array<string>")
    got = [tuple(r) for r in df.select(S.run_list(F.col("a")), T.merge_stages(F.col("a")), S.unknown_stages(F.col("a"))).collect()]
    assert got[0] == (["EDAAgent"], ["EDAAgent", "x"], ["x"])
    assert got[1][0] == [] and got[1][1] == [] and got[2][1] == [] and len(got[3][0]) == 3


def test_plans(spark):
    df = spark.createDataFrame([("[]",), ("[1,2]",), ('{"a":1}',), ("nope",), ('["a","b"]',), ('["a",1]',), ("",)], "plan string")
    got = [(r["tasks"], r["reason"]) for r in D.validate_plans(df).collect()]
    assert got == [
        (None, "empty list"), (None, "not a list of strings"), (None, "not a list"), (None, "not valid JSON"),
        (["a", "b"], None), (None, "not a list of strings"), (None, "not valid JSON"),
    ]


def test_claims_at_any_depth(spark):
    deep = '"/out/1/deep"'
    for _ in range(12):
        deep = '{"k": [' + deep + "]}"
    report = f'{{"/out/1/key": {deep}, "esc": "\\/out\\/1\\/q\\"x\\"", "back": "C:\\\\\\\\", "up": "/out/1/../2/z", "self": "/out/1/", "n": "/out/1/a//b/./c"}}'
    json.loads(report)
    df = spark.createDataFrame([(7, "/out/1", report), (8, "/out/1", "{bad"), (9, "/out/1", '"/out/1/s"')], "run_id long, output_dir string, report string")
    got = {tuple(r) for r in D.artifact_claims(df).collect()}
    assert got == {(7, "/out/1/deep"), (7, '/out/1/q"x"'), (7, "/out/1/a/b/c"), (9, "/out/1/s")}


def test_one_hot_path_claimed_by_many(spark):
    claims = spark.range(500).select(F.col("id").alias("run_id"), F.when(F.col("id") % 3 == 0, "/o/hot").otherwise(F.concat(F.lit("/o/"), F.col("id"))).alias("path"))
    files = spark.range(250).select(F.concat(F.lit("/o/"), F.col("id")).alias("path"))
    gone = D.missing_artifacts(claims, files)
    assert gone.where("path = '/o/hot'").count() == 167
    assert gone.where("path <> '/o/hot'").count() == len([i for i in range(250, 500) if i % 3])


def test_bounded_render(spark):
    df = spark.createDataFrame(
        [([str(i) for i in range(20)], {f"k{i}": i for i in range(20)}, "x" * 400, 'q"\n', None, float("nan"))],
        "a array<string>, m map<string,int>, s string, q string, z string, f double",
    ).select(F.struct("*").alias("r"))
    out = render(df, "r").first()
    doc = json.loads(out["rendered"])
    assert doc["a"][-1] == "... 5 more items omitted" and len(doc["a"]) == 16
    assert doc["m"]["__omitted__"] == "5 more keys omitted" and len(doc["m"]) == 16
    assert doc["s"] == "x" * 300 + "... [truncated, 400 chars total]"
    assert doc["q"] == 'q"\n' and doc["z"] is None and not out["is_truncated"]
    cut = render(df, "r", total=50).first()
    assert cut["is_truncated"] and cut["rendered"].startswith(out["rendered"][:50] + "\n... [truncated, ")


def test_stream_fold_over_several_batches(spark, load, tmp_path):
    turns = turn_slots(load("conversations"))
    source, out, state = (str(tmp_path / n) for n in ("turns", "out", "state"))
    for part in (turns.where("turn % 2 = 1"), turns.where("turn % 2 = 0")):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(turns.schema).parquet(source)
        start_fold(stream, out, state).awaitTermination()
    got, want = folded_sessions(spark, out), S.fold_slots(turns)
    assert got.count() == want.count() > 0
    assert got.select(*want.columns).exceptAll(want).count() == 0


def test_upsert_keeps_latest(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, t int, v string")
    new = spark.createDataFrame([(1, 2, "c"), (2, 4, "d"), (3, 1, "e")], "k int, t int, v string")
    assert {tuple(r) for r in sinks.upsert(old, new, ["k"], ["t"]).collect()} == {(1, 2, "c"), (2, 5, "b"), (3, 1, "e")}


def messy(spark, label):
    """Rows with missing dates, an empty column and the given label."""
    return spark.range(400).select(
        F.expr("timestampadd(DAY, CAST(id AS INT), TIMESTAMP_NTZ'2020-01-01')").alias("day"),
        (F.col("id") % 17).cast("double").alias("x"), F.lit(None).cast("double").alias("void"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 3 == 0).alias("flag"), label.alias("y"),
    ).withColumn("day", F.when(F.dayofyear("day") % 7 > 0, F.col("day")))


@pytest.mark.parametrize("labels", [(-1, 1), (5, 7), (0, 1_000_000)])
def test_runs_with_missing_dates_and_any_labels(spark, tmp_path, labels):
    low, high = labels
    messy(spark, F.when(F.col("id") % 17 > 8, high).otherwise(low)).write.parquet(str(tmp_path / "d.parquet"))
    info = {
        "data_path": "d.parquet", "task_type": "classification", "target_column": "y", "agents_to_call": ["ModelTrainingAgent"]
    }
    results = run(spark, info, str(tmp_path / "out"), str(tmp_path), partitions=2)
    assert results.ok
    report = results.status["ModelTrainingAgent"].first()
    assert report["failed"] == 0 and report["best_model"] in {r["model"] for r in results.leaderboard.collect()}
    assert 0 <= report["metrics"]["accuracy"] <= 1 and 0 <= report["test_metrics"]["accuracy"] <= 1
    assert "constant" in {r["model"] for r in results.leaderboard.collect()}
    assert "day_missing" in report["selected_features"] and report["dataset_path"].endswith("/processed")


def test_unique_integers_are_a_regression_target(spark, tmp_path):
    messy(spark, (F.col("id") * 3).cast("int")).write.parquet(str(tmp_path / "d.parquet"))
    info = {"data_path": "d.parquet", "target_column": "y", "agents_to_call": ["ModelTrainingAgent"]}
    results = run(spark, info, str(tmp_path / "out"), str(tmp_path), partitions=2)
    assert results.ok and {r["task"] for r in results.leaderboard.collect()} == {"regression"}


def test_stale_one_hot_plan_becomes_frequencies(spark, tmp_path):
    df = spark.range(300).select((F.col("id") % 30).cast("string").alias("c"))
    plan = literal_rows(spark, [("c", 3, "one_hot", "few categories")], "column string, ordinal int, step string, reason string")
    out = R.fit_transforms(df, plan, str(tmp_path / "t")).transform(df)
    assert out.columns == ["c_freq"] and out.where("abs(c_freq - 0.0333333333) > 1e-6").isEmpty()


def test_mode_ties_go_to_the_smallest_text_long_or_short(spark):
    long = "b" * 100
    ties = spark.createDataFrame([("a",), ("a",), (long,), (long,), ("A" * 90,)], "t string")
    assert P.categorical_summary(ties).first()["mode"] == "a"
    assert P.categorical_summary(ties.where("t <> 'a'")).first()["mode"] == long
    single = spark.createDataFrame([("c",), (long,), ("A" * 90,)], "t string")
    assert P.categorical_summary(single).first()["mode"] == "A" * 90


def test_folders_exist_and_all_gaps_are_named(spark):
    report = json.dumps({"pipeline_status": "success", "dataset": "/o/1/processed", "m": ["/o/1/y", "/o/1/x/"]})
    expected = literal_rows(spark, [(1, "/o/1")], "run_id int, output_dir string")
    reports = literal_rows(spark, [(1, report)], "run_id int, report string")
    files = literal_rows(spark, [("/o/1/processed/part-0.parquet",)], "path string")
    row = D.validate_reports(expected, reports, files).first()
    assert (row["outcome"], row["reason"]) == ("missing_artifact", "/o/1/x, /o/1/y")


def test_slot_values_keep_blanks_and_dashes(spark):
    message = "data_path: data/my file.csv; target_column: fixed acidity, task_type: regression\ntask_intent: eda"
    got = spark.range(1).select(*[c.alias(n) for n, c in T.extract_slots(F.lit(message)).items()]).first().asDict()
    assert got == {
        "data_path": "data/my file.csv", "data_type": None, "task_type": "regression", "target_column": "fixed acidity", "task_intent": "eda"
    }
    quoted = T.extract_slots(F.lit('target column is "total price" and so on'))["target_column"]
    assert spark.range(1).select(quoted).first()[0] == "total price"


def test_no_document_file_means_no_documents(spark, tmp_path):
    assert readers.read_documents(spark, str(tmp_path / "none.json"), "a long").collect() == []


def test_no_slice_of_a_quantile_holds_many_values(spark, monkeypatch):
    """5 M rows with heavy ties: what is ranked is cut into slices of bounded size."""
    from tabulon.operators import ordering, quantiles

    seen = []
    whole = ordering.range_slices
    monkeypatch.setattr(
        ordering, "range_slices", lambda *a, **k: (seen.append(cut := whole(*a, **k)), cut)[1]
    )
    df = spark.range(5_000_000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.hash("id").cast("double")).alias("x"))
    got = {r["prob"]: r["value"] for r in quantiles.quantile_table(df, ["x"], [0.1, 0.5, 0.9]).collect()}
    exact = df.select(F.percentile("x", [0.1, 0.5, 0.9])).first()[0]
    assert [got[p] for p in (0.1, 0.5, 0.9)] == pytest.approx(exact)
    assert max(r["count"] for r in seen[0].groupBy(ordering.SLICE).count().collect()) < 5000


def test_steps_are_written_below_one_folder_and_dropped_together(spark, tmp_path, monkeypatch):
    from tabulon import session

    monkeypatch.setattr(session, "scratch_root", lambda spark: str(tmp_path))
    session.materialize(spark.range(3), "step")
    assert os.listdir(tmp_path / "tabulon") == [spark.sparkContext.applicationId]
    session.drop_scratch(spark)
    assert os.listdir(tmp_path / "tabulon") == []


def test_mixtures_may_take_twenty_iterations(spark):
    fits = {n: e.getMaxIter() for n, e in M.clustering_models().items() if n.startswith("gaussian_mixture")}
    assert len(fits) == 3 and set(fits.values()) == {20}
