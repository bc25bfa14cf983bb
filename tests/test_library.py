"""Value semantics, readers, sinks, fills and plans on small hand-made tables."""

from __future__ import annotations

import bz2
import datetime
import gzip
import json
import lzma
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import values
from quarry.functions.values import ORDER
from quarry.operators import auto, categories, cleaning, dates, entities, missing, profile, rows, selection
from quarry.plans import registry
from quarry.sources import readers, sinks


def table(spark, data, schema):
    return spark.createDataFrame(data, schema)


def column(df, name, by="id"):
    return [r[name] for r in df.orderBy(by).collect()]


def test_missing_tokens_and_numbers(spark):
    raw = ["", " na ", "N/A", "null", "None", "NaN", "-", "?", "007", "1,000", "1_000", "1d", "inf", "\t4.5 ", "-3e2", None]
    df = table(spark, list(enumerate(raw)), "id int, c string")
    out = df.select("id", values.missing(df, "c").alias("m"), values.number(df, "c").alias("x"))
    assert column(out, "m") == [True] * 8 + [False] * 7 + [True]
    assert column(out, "x") == [None] * 8 + [7.0, 1000.0, None, None, None, 4.5, -300.0, None]


def test_quantiles_by_shrinking_brackets(spark, monkeypatch):
    rng = random.Random(5)
    tied = [float(rng.choice([1, 2, 2, 2, 3, 3000])) if i % 3 else rng.random() for i in range(3000)]
    wide = [None if i % 50 == 0 else rng.gauss(0, 10 ** rng.randint(0, 9)) for i in range(3000)]
    df = table(spark, [(i, a, b, None, 7.0) for i, (a, b) in enumerate(zip(tied, wide))], "id int, a double, b double, c double, d double").repartition(4)
    at = [0.0, 0.01, 0.25, 0.5, 0.77, 0.999, 1.0]
    for few in (values.FEW, 40):
        monkeypatch.setattr(values, "FEW", few)
        got = values.quantiles(df, {c: F.col(c) for c in "abcd"}, at)
        assert got["c"] is None and got["d"] == [7.0] * len(at)
        for name, data in (("a", tied), ("b", [x for x in wide if x is not None])):
            assert got[name] == pytest.approx(np.quantile(data, at).tolist(), rel=1e-12, abs=1e-12)


def test_places_and_numbers_are_dense_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(values, "RANGE", 20)
    rng = random.Random(6)
    rows = [(f"level {i} {rng.random()}", rng.choice([1, 1, 1, 1, 5, 9])) for i in range(400)]
    out = values.places(table(spark, rows, "level string, n long").repartition(3))
    want = {level: i for i, (level, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert {r["level"]: r["place"] for r in out.collect()} == want
    ranks = values.average_ranks(table(spark, [(float(n),) for _, n in rows] + [(float(i % 90),) for i in range(300)], "v double"))
    everything = sorted([float(n) for _, n in rows] + [float(i % 90) for i in range(300)])
    for r in ranks.collect():
        at = [i for i, v in enumerate(everything) if v == r["value"]]
        assert r["rank"] == sum(at) / len(at) and r["n"] == len(everything)
    numbered, n = values.numbered(table(spark, [(rng.getrandbits(40),) for _ in range(100)], "h long"), "h", "at", 7)
    assert n == 100 and sorted(r["at"] for r in numbered.collect()) == list(range(100))


def test_model_scores(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        a, b, c = rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((i, a, b, c, a + 0.5 * b, int(a + 0.3 * rng.gauss(0, 1) > 0)))
    df = table(spark, rows, "id int, a double, b double, c double, y double, z int")
    by = lambda target, method, **o: {r["column"]: r["score"] for r in selection.rank_features(df, target, ["a", "b", "c"], method, **o).collect()}
    kept = by("y", "rfe", keep=2)
    assert kept["a"] == 1.0 and kept["b"] == pytest.approx(0.75, abs=0.01) and kept["c"] == 0.0
    assert by("z", "rfe")["a"] == 1.0
    x, y = np.array([r[1] for r in rows]), np.array([r[4] for r in rows])
    r2 = np.corrcoef(x, y)[0, 1] ** 2
    assert by("y", "f_test")["a"] == pytest.approx(r2 / (1 - r2) * 298)
    out = {r["column"]: r for r in selection.rank_features(df, "z", ["a", "b", "c"], "permutation", repeats=2, trees=10, max_depth=5).collect()}
    assert out["a"]["score"] > 0.2 > abs(out["c"]["score"]) and out["a"]["std"] >= 0


def test_moments(spark):
    raw = ["2024-03-04", "2024-03-04T05:06:07Z", "2024-03-04 05:06:07+02:00", "2024/03/04", "03/04/2024", "13/04/2024", "04/13/2024", "4.3.2024", "20240304", "Mar 4 2024", "4 Mar 2024", "1709510400", "1709510400000", "2024", "nonsense"]
    df = table(spark, list(enumerate(raw)), "id int, c string")
    day = datetime.datetime(2024, 3, 4)
    got = column(df.select("id", values.moment(df, "c").alias("t")), "t")
    assert got[:3] == [day, datetime.datetime(2024, 3, 4, 5, 6, 7), datetime.datetime(2024, 3, 4, 3, 6, 7)]
    assert got[3:7] == [day, datetime.datetime(2024, 4, 3), datetime.datetime(2024, 4, 13), datetime.datetime(2024, 4, 13)]
    assert got[7:] == [day, day, day, day, day, day, None, None]


def test_group_keys_do_not_depend_on_type(spark):
    df = table(spark, [(1, "1", 1.0, None), (2, " 2 ", 2.5, "x")], "a long, b string, c double, d string")
    got = [tuple(r) for r in df.select(*(values.key(df, c).alias(c) for c in "abcd")).collect()]
    assert got == [("1", "1", "1.0", ""), ("2", "2", "2.5", "x")]


CSV = "a,b,a\n1,x,2.5\n\n2, y ,n/a\n3,\"q,\"\"r\",4\n"


@pytest.mark.parametrize("packed", ["", ".gz", ".bz2", ".xz"])
def test_delimited(spark, tmp_path, packed):
    path = tmp_path / f"t.csv{packed}"
    opener = {"": open, ".gz": gzip.open, ".bz2": bz2.open, ".xz": lzma.open}[packed]
    with opener(path, "wb") as f:
        f.write(CSV.encode())
    frame = readers.read_dataset(spark, str(path))
    assert (frame.format, frame.columns, frame.truncated) == ("delimited", ["a", "b", "a_2"], False)
    assert frame.dtypes() == {"a": "int", "b": "str", "a_2": "float"}
    assert [tuple(r.values()) for r in frame.head()] == [(1, "x", 2.5), (2, "y", None), (3, 'q,"r', 4.0)]
    if not packed:
        short = readers.read_delimited(spark, str(path), limit=2, columns="a")
        assert short.truncated and short.columns == ["a"] and len(short.head()) == 2


def test_codes_with_leading_zeros_stay_text(spark, tmp_path):
    path = tmp_path / "codes.csv"
    path.write_text("zip,flat,x,y,z\n01234,007,0.5,1e3,.\n10115,12,-.25,+7.,.5\n,?,0,2,1\n")
    df = readers.read_delimited(spark, str(path)).df.drop(ORDER)
    assert {f.name: f.dataType.simpleString() for f in df.schema} == {"zip": "string", "flat": "string", "x": "double", "y": "double", "z": "string"}
    assert [tuple(r) for r in df.collect()] == [("01234", "007", 0.5, 1000.0, "."), ("10115", "12", -0.25, 7.0, ".5"), (None, None, 0.0, 2.0, "1")]


def test_shapes_of_letters_without_case(spark):
    df = table(spark, [(0, "日本-1"), (1, "Ärger 22"), (2, "שלום-A²"), (3, "ǅx\u00a0y")], "id int, t string")
    assert column(df.select("id", auto.shape_of(F.col("t")).alias("s")), "s") == ["日本-9", "Aa 9", "שלום-A9", "ǅa a"]


def test_sniffed_delimiter_and_no_header(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text("1;a\n2;b\n")
    frame = readers.read_dataset(spark, str(path), has_header=False)
    assert [tuple(r.values()) for r in frame.head()] == [(1, "a"), (2, "b")] and frame.columns == ["column_1", "column_2"]


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2, "y": "b"}]')
    (tmp_path / "b.json").write_text('{"meta": 1, "rows": [{"x": 1}, {"x": 2}]}')
    (tmp_path / "c.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    (tmp_path / "d.jsonl").write_text('{"x": 1}\n{bad\n')
    assert [r["x"] for r in readers.read_dataset(spark, str(tmp_path / "a.json")).head()] == [1, 2]
    assert [r["x"] for r in readers.read_dataset(spark, str(tmp_path / "b.json")).head()] == [1, 2]
    assert [r["x"] for r in readers.read_json(spark, str(tmp_path / "b.json"), record_path="rows").head()] == [1, 2]
    assert [r["x"] for r in readers.read_dataset(spark, str(tmp_path / "c.jsonl")).head()] == [1, 2]
    assert [r["x"] for r in readers.read_jsonl(spark, str(tmp_path / "d.jsonl"), skip_invalid=True).head()] == [1]
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "d.jsonl")).head()


def test_excel(spark, tmp_path):
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    path = tmp_path / "t.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {m} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>name</t></si><si><t>n</t></si><si><t>ann</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {m}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row/><row><c r="A3" t="s"><v>2</v></c><c r="B3"><v>2.5</v></c></row><row><c r="B4"><v>3</v></c></row></sheetData></worksheet>')
    frame = readers.read_dataset(spark, str(path))
    assert frame.format == "excel" and [tuple(r.values()) for r in frame.head()] == [("ann", 2.5), (None, 3.0)]
    with pytest.raises(ValueError):
        readers.read_excel(spark, str(path), sheet="Two")


def test_detection_by_content(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "p"))
    part = next((tmp_path / "p").glob("*.parquet"))
    (tmp_path / "plain").write_bytes(part.read_bytes())
    (tmp_path / "lines").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "doc").write_text('[{"a": 1}]')
    (tmp_path / "text").write_text("a,b\n1,2\n")
    assert [readers.detect_format(spark, str(tmp_path / n)) for n in ("plain", "lines", "doc", "text")] == ["parquet", "jsonl", "json", "delimited"]


def test_tables_and_names(spark):
    spark.range(5).createOrReplaceTempView("five")
    assert readers.read_table(spark, "five", limit=2).truncated
    with pytest.raises(ValueError):
        readers.read_table(spark, "five; drop")
    assert readers.unique_names(["a", "", "a", "a_2"]) == ["a", "column_2", "a_3", "a_2"]
    assert readers.connector_options(connection={"engine": "postgresql", "database": "d", "user": "u"})["url"] == "jdbc:postgresql://localhost:5432/d"


def test_inline_data(spark):
    for data in ("a,b\n1,2\n3,4\n", '[{"a": 1, "b": 2}, {"a": 3, "b": 4}]', {"a": [1, 3], "b": [2, 4]}, {"rows": [{"a": 1, "b": 2}, {"a": 3, "b": 4}]}):
        got = readers.load_rows(spark, data).orderBy("a").collect()
        assert [(int(r["a"]), int(r["b"])) for r in got] == [(1, 2), (3, 4)]


def test_sinks(spark, tmp_path):
    df = table(spark, [(1, datetime.datetime(2024, 1, 2), 1.23456789, None, [1, 2])], "id int, t timestamp_ntz, x double, s string, l array<int>")
    path = sinks.write_csv(df, str(tmp_path / "o"), single=True)
    assert spark.read.text(path).collect()[1][0] == '1,2024-01-02T00:00:00,1.23456789,,"[1,2]"'
    sinks.write_data(df, str(tmp_path / "o.json"))
    row = json.loads(spark.read.text(str(tmp_path / "o.json")).collect()[0][0])
    assert row["x"] == 1.234568 and row["t"] == "2024-01-02T00:00:00"
    assert sinks.default_output_path("/a/b.csv", "x") == "/a/b__x.csv" and sinks.json_safe({"b": b"\x01", "d": [datetime.date(2024, 1, 1)]}) == {"b": "01", "d": ["2024-01-01"]}


def test_rolling_ties_and_exact_edges(spark):
    day = datetime.datetime(2024, 1, 1)
    data = [(1, 0, day, 1.0), (1, 1, day, 2.0), (1, 2, day + datetime.timedelta(days=7), 4.0), (1, 3, None, 8.0), (1, 4, day + datetime.timedelta(days=3), None)]
    df = table(spark, data, f"u int, id int, t timestamp_ntz, x double").withColumn(ORDER, F.col("id"))
    out = entities.rolling_windows(df, ["u"], ["t"], ["x"], (7,))[0]
    assert column(out, "events_last_7d") == [1, 2, 2, None, 3]
    assert column(out, "x_sum_last_7d") == [1.0, 3.0, 4.0, None, 3.0]
    assert column(out, "x_mean_last_7d") == [1.0, 1.5, 4.0, None, 1.5]
    lagged = entities.lags(df, ["u"], ["t"], ["x"])[0]
    assert column(lagged, "x_lag_1") == [None, 1.0, None, 4.0, 2.0]
    assert column(entities.cumulative(df, ["u"], ["t"], ["x"])[0], "x_cumsum") == [1.0, 3.0, 7.0, 15.0, 3.0]


def test_fills(spark):
    df = table(spark, [(1, 0, 1.0, "a"), (1, 1, None, None), (1, 2, 3.0, "missing"), (2, 3, None, "a"), (2, 4, 9.0, "a")], "u int, id int, x double, s string")
    fill = lambda out, c="x": column(out[0], c)
    assert fill(missing.impute_statistic(df, ["x"])) == [1.0, 3.0, 3.0, 3.0, 9.0]
    assert fill(missing.impute_group(df, ["x"], ["u"])) == [1.0, 2.0, 3.0, 9.0, 9.0]
    assert fill(missing.impute_forward(df, ["x"], ["u"], order=["id"])) == [1.0, 1.0, 3.0, None, 9.0]
    assert fill(missing.impute_forward(df, ["x"], ["u"], direction="both", order=["id"])) == [1.0, 1.0, 3.0, 9.0, 9.0]
    assert fill(missing.impute_category(df, ["s"]), "s") == ["a", "missing_value", "missing", "a", "a"]
    flags = missing.impute_statistic(df, ["x"])[0]
    assert column(flags, "x_is_missing") == [0, 1, 0, 1, 0]
    values_ = missing.learn_fill_values(df, ["x", "s"], order=["id"])
    assert values_ == {"x": 3.0, "s": "a"} and fill(missing.impute_plan(df, values_)) == [1.0, 3.0, 3.0, 3.0, 9.0]
    drawn = fill(missing.impute_random_sample(df, ["x"], 3, order=["id"]))
    assert set(drawn) <= {1.0, 3.0, 9.0} and drawn == fill(missing.impute_random_sample(df, ["x"], 3, order=["id"]))


def test_kinds_come_from_the_whole_table(spark):
    df = spark.range(900).select(F.col("id").alias(ORDER), F.when(F.col("id") >= 500, F.col("id").cast("double")).alias("late"))
    assert auto.column_kinds(df) == {"late": "numeric"} and auto.column_kinds(df, sample=400) == {"late": "empty"}
    holed = df.withColumn("late", F.when(F.col(ORDER) != 700, F.col("late")))
    assert missing.impute_interpolate(holed, order=[ORDER])[0].where(f"{ORDER} = 700").head()["late"] == 700.0


def test_random_fills_draw_from_all_present_values(spark):
    n = 10_000
    df = spark.range(2 * n).select(F.col("id"), F.when(F.col("id") < n, F.col("id").cast("double")).alias("x"))
    drawn = [r["x"] for r in missing.impute_random_sample(df, ["x"], 3, order=["id"])[0].where(f"id >= {n}").collect()]
    assert len(drawn) == n and set(drawn) <= set(map(float, range(n)))
    assert 6100 < len(set(drawn)) < 6550  # 1 - 1/e of the values, as draws with replacement give
    assert max(map(drawn.count, set(drawn[:2000]))) < 12
    few = spark.range(4020).select(F.col("id"), F.when(F.col("id") < 20, F.col("id").cast("double")).alias("x"))
    drawn = [r["x"] for r in missing.impute_random_sample(few, ["x"], 3, order=["id"])[0].where("id >= 20").collect()]
    assert all(140 < drawn.count(float(v)) < 260 for v in range(20))
    plain = spark.range(3000).select(F.when(F.col("id") < 900, "a").when(F.col("id") < 1000, "b").alias("s"))  # rows without an order
    out = missing.impute_random_sample(plain, ["s"], 3)[0].where("s_is_missing = 1").groupBy("s").count().collect()
    assert 120 < {r["s"]: r["count"] for r in out}["b"] < 280


def test_model_fills_follow_a_line(spark):
    data = [(i, float(i), None if i % 7 == 3 else 2.0 * i + 1) for i in range(60)]
    df = table(spark, data, "id int, x double, y double")
    want = [2.0 * i + 1 for i in range(60)]
    # the last row has no value: its fill stays in the observed range; the ridge pulls a little
    assert column(missing.impute_regression(df, ["y"], ["x"])[0], "y") == pytest.approx(want[:-1] + [117.0], abs=1e-2)
    assert column(missing.impute_knn(df, ["y"], ["x"], neighbours=2, order=["id"])[0], "y")[:-1] == pytest.approx(want[:-1], abs=0.5)


def test_cleaning(spark):
    df = table(spark, [(1, " a ", 1), (2, "n/a", 1), (3, "a", 1), (4, "b", 1)], "id int, `My Text` string, `9x` int")
    df, log = registry.prepare(df, ["normalize_columns", "strip_whitespace", "drop_constant_columns", {"step": "fill_missing", "strategy": "mode", "columns": ["my_text"]}])
    assert df.columns == ["id", "my_text"] and column(df, "my_text") == ["a", "a", "a", "b"] and [x["step"] for x in log][0] == "normalize_columns"
    with pytest.raises(ValueError):
        registry.prepare(df, ["no such step"])
    twice = table(spark, [(1, "k", 1), (2, "k", 2), (3, None, 3), (4, None, 4)], f"id int, k string, {ORDER} int")
    assert column(cleaning.drop_duplicates(twice, ["k"])[0], "id") == [1, 3]
    last = cleaning.drop_duplicates(twice, ["k"], "last")[0]
    assert [(r["id"], r[ORDER]) for r in last.orderBy("id").collect()] == [(2, 1), (4, 3)]


def test_kinds_roles_and_recipe(spark):
    data = [(i, "yes" if i % 2 else "no", "c", f"2024-01-{i % 28 + 1:02d}", "x" * 30 + str(i), float(i % 5)) for i in range(60)]
    df = table(spark, data, "user_id int, flag string, same string, day string, note string, amount double")
    assert profile.column_kinds(df) == {"user_id": "numeric", "flag": "boolean", "same": "constant", "day": "date", "note": "text", "amount": "numeric"}
    assert auto.column_kinds(df)["note"] == "categorical"
    roles = profile.column_roles(df)
    assert roles["ids"] == ["user_id"] and roles["dates"] == ["day"] and roles["constant"] == ["same"]
    steps = registry.recipe(df)
    assert "drop_constant_columns" in [s["step"] for s in steps["cleaning"]] and "date_parts" in [s["step"] for s in steps["features"]]
    assert registry.infer_columns(df)["date_columns"] == ["day"]


def test_selection(spark):
    data = [(i, i % 2, float(i % 2) + 0.001 * (i % 3), float(i * 7919 % 101), "k") for i in range(200)]
    df = table(spark, data, "row int, y int, near double, noise double, same string")
    assert selection.resolve_task(df, "y") == "binary" and selection.resolve_method("auto", "binary") == "mutual_information"
    with pytest.raises(ValueError):
        selection.resolve_method("auc", "regression")
    with pytest.raises(ValueError):
        selection.resolve_task(df, "same")
    out = {r["column"]: r for r in selection.select_features(df, "y").collect()}
    assert out["same"]["stage"] == "screening" and out["row"]["reason"] == "id_like" and out["near"]["stage"] == "leakage" and out["noise"]["selected"]
    assert selection.f_p_value(4.0, 2, 30) == pytest.approx(0.02882, abs=1e-4)


def test_steps_are_reported_not_raised(spark):
    df = table(spark, [(1, 2.0), (2, 3.0)], "id int, x double")
    out, report = registry.run_steps(df, "scaling, nothing_like_it, binning", {"aggregation_columns": ["x"]}, {"binning": {"strategy": "odd", "bins": 2}})
    assert [r["status"] for r in report] == ["done", "unknown", "failed"] and "x_zscore" in out.columns
    assert registry.catalogue("features", "scaling")[0]["arguments"]["method"] == "zscore" and len(registry.FEATURE_STEPS) >= 49
    assert registry.data_reader(spark, "/no/such/file.csv")["status"] == "error"


def test_facades_and_recorder(spark, tmp_path):
    data = "user_id,day,amount,kind\n" + "".join(f"{i % 3},2024-01-{i + 1:02d},{i}.5,{'ab'[i % 2]}\n" for i in range(12))
    path = tmp_path / "t.csv"
    path.write_text(data)
    recorder = registry.Recorder()
    read = recorder.record(registry.data_reader, "read", spark=spark, data_source=str(path))
    assert read["status"] == "ok" and read["rows"] == 12
    made = recorder.record(registry.feature_prep, "features", spark=spark, data=str(path), output_path=str(tmp_path / "out"))
    assert made["status"] == "ok" and all(r["status"] == "done" for r in made["report"])
    assert recorder.covers("features") and "feature_prep(spark, data=" in recorder.render_script()
    for level in ("row", "entity", "numeric", "all"):
        assert registry.feature_generation(spark, str(path), level)["status"] == "ok"
    assert registry.analyzer(spark, str(path), ["describe", "grain"])["status"] == "ok"
    assert registry.missing_report(spark, str(path))["status"] == "ok" and registry.impute(spark, str(path))["status"] == "ok"


def test_empty_and_tiny_tables(spark):
    df = table(spark, [], "id int, x double, s string, t timestamp_ntz")
    assert rows.scaling(df, ["x"])[1] == [] and rows.binning(df, ["x"])[1] == [] and dates.recency(df, ["t"])[1] == []
    assert categories.frequency_encoding(df, ["s"])[0].count() == 0 and entities.group_aggregates(df, ["id"], ["x"])[0].count() == 0
    assert profile.describe(df).count() == 4 and profile.histogram(df, "x").count() == 0 and missing.missing_counts(df).count() == 0
    assert auto.auto_numeric_shape(df, ["x"])[0].count() == 0


def test_stream_and_table_give_the_same_totals(spark, tmp_path):
    from quarry.streaming.entities import windowed_totals

    data = [(i % 2, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=5 * i), float(i)) for i in range(20)]
    df = table(spark, data, "u int, t timestamp, x double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = windowed_totals(stream, ["u"], "t", ["x"], "1 day", "1 day")
    q = out.writeStream.outputMode("complete").format("memory").queryName("totals").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    batch = windowed_totals(df, ["u"], "t", ["x"], "1 day", "1 day")
    key = lambda r: (r["window_start"], r["u"], r["events"], r["x_sum"])
    assert sorted(map(key, spark.table("totals").collect())) == sorted(map(key, batch.collect()))


def test_exact_sums_and_rfm_scores_do_not_depend_on_row_order(spark):
    parts = [1e16, 1.0, -1e16, 0.1, 0.2, 0.3, -7.25]
    rng = random.Random(4)
    data = [(u, datetime.datetime(2024, 1, 1 + u), x) for u in range(9) for x in (parts if u == 0 else rng.sample(parts, len(parts)))]
    data += [(9, datetime.datetime(2024, 2, 1), 5e-324), (9, datetime.datetime(2024, 2, 1), 1e308), (9, datetime.datetime(2024, 2, 1), -1e308)]
    df = table(spark, data, "u long, t timestamp_ntz, x double").coalesce(1)
    scores = {r["u"]: r for r in entities.rfm(df, ["u"], ["t"], ["x"])[0].collect()}
    assert len({scores[str(u)]["monetary_sum"] for u in range(9)}) == 1 and scores["0"]["monetary_sum"] == math.fsum(parts)
    assert {scores[str(u)]["m_score"] for u in range(9)} == {3} and scores["9"]["m_score"] == 5
    assert scores["9"]["monetary_sum"] == 5e-324
    odd = table(spark, [(1, None), (2, math.inf), (2, 1.0), (3, 0.0)], "u long, x double")
    got = {r["u"]: r["s"] for r in odd.groupBy("u").agg(values.exact_sum(odd, F.col("x")).alias("s")).collect()}
    assert got == {1: None, 2: math.inf, 3: 0.0}
