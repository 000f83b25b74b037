import sqlite3

import pytest
from threadloom import schema
from threadloom.config import Config, resolve_path
from threadloom.sources import files, sqlite


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'multi\nline, "quoted"', ["a"]), (2, "é", [])], "id int, tweet string, l array<string>")
    path = files.save(df, f"{tmp_path}/x", "csv")
    back = files.read_csv(spark, path).orderBy("id").collect()
    assert [(r["id"], r["tweet"], r["l"]) for r in back] == [(1, 'multi\nline, "quoted"', '["a"]'), (2, "é", "[]")]
    assert files.first_existing(spark, [f"{tmp_path}/no", path], "step") == path
    with pytest.raises(FileNotFoundError, match="step"):
        files.first_existing(spark, [f"{tmp_path}/no"], "step")


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "a.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE post (id INTEGER, tweet TEXT, score REAL)")
        db.executemany("INSERT INTO post VALUES (?, ?, ?)", [(1, "a", 0.5), (2, None, None)])
    tables = sqlite.read_all(spark, path, folder=str(tmp_path))
    assert [tuple(r) for r in tables["post"].orderBy("id").collect()] == [(1, "a", 0.5), (2, None, None)]
    with pytest.raises(ValueError):
        schema.require_tables(tables)


def test_nan(spark):
    df = schema.nan_to_null(spark.createDataFrame([(float("nan"), "x"), (1.0, None)], "a double, b string"))
    assert [r["a"] for r in df.collect()] == [None, 1.0]


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("conversation:\n  slope_threshold: 0.1\nown: 3\n")
    c = Config(tmp_path / "c.yaml")
    assert c["conversation"]["slope_threshold"] == 0.1 and c["conversation"]["volatility_threshold"] == 0.25 and c.get("own") == 3 and c.get("none", 1) == 1
    with pytest.raises(FileNotFoundError):
        Config(tmp_path / "no.yaml")
    for bad in ("", "- a\n- b\n", "a: [1\n"):
        (tmp_path / "bad.yaml").write_text(bad)
        with pytest.raises(ValueError):
            Config(tmp_path / "bad.yaml")
    assert resolve_path("a/b", "/r").as_posix() == "/r/a/b" and resolve_path("/a", "/r").as_posix() == "/a"
