"""Logs of growing width: what one program writes, another one reads."""

from datetime import datetime

from pyspark.sql import functions as F

from tessera.functions.text import is_json
from tessera.sources import files as S

COLUMNS = [("at", "timestamp"), ("project", "string"), ("outcome", "string"), ("ms", "long"), ("n", "int")]


def test_round_trip_of_every_width(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [(at, "p\tq", "done", 5, 7), (at, "p", "done", None, None), (at, "p", "done", None, 7), (at, None, "x\ny", 1, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "at timestamp, project string, outcome string, ms long, n int")
    assert sorted(r.value for r in S.log_lines(df, [n for n, _ in COLUMNS]).collect())[0] == ""
    S.append_log(df, f"{tmp_path}/log", [n for n, _ in COLUMNS])
    got = S.stats_log(spark, f"{tmp_path}/log", COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([
        (at, "p q", "done", 5, 7, 5, None), (at, "p", "done", None, None, 3, None), (at, "p", "done", None, 7, 5, None), (None, None, None, None, None, 4, "bad project"),
    ], key=str)


def test_faults(spark):
    lines = spark.createDataFrame([(x,) for x in ("", None, "  ", "a", "2024-01-01\tp", "never\tp\tdone", "2024-01-01\tp\tdone\r", "2024-01-01\tp\tdone\tx\t9999999999999\tmore", "2024-01-01\tp\t")], "value string")
    got = S.parsed_log(lines, COLUMNS, 3).collect()
    assert sorted((r.width, r.fault or "", r.outcome or "", r.ms, r.n) for r in got) == [
        (1, "too few fields", "", None, None), (2, "too few fields", "", None, None), (3, "", "done", None, None), (3, "bad at", "", None, None), (3, "bad outcome", "", None, None), (6, "", "done", None, None),
    ]
    assert S.parsed_log(lines.limit(0), COLUMNS, 3).count() == 0


def test_line_faults(spark):
    lines = [None, " ", "{", "5", "[1]", '{"kind":"x","data":{"id":1}}', '{"kind":"edge","data":{}}', '{"a":1}', '{"id":1}', '{"kind":"entry","data":{"id":2}}']
    got = {r.fault: r.n for r in S.line_faults(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got == {"empty": 2, "no JSON": 1, "no object": 2, "unknown kind": 1, "no id": 2}


def test_one_value_and_nothing_behind_it(spark):
    sound = ["1", " -2.5e3 ", '"a]}"', "null", "[1, 2]", '{"a": [1], "b": {}}', "\t[]\n"]
    broken = ["4397110767823743 +1 (654) 555-4136 a text", "1 2", "1, 2", "{} x", '{"a": 1} {"b": 2}', "1], [2", '1}, {"a": 1', '1, "b": 2', "[1] ]", "", " ", "[1,]", "nul", None]
    got = [r.j for r in spark.createDataFrame([(i, x) for i, x in enumerate(sound + broken)], "i int, value string").select("i", is_json(F.col("value")).alias("j")).orderBy("i").collect()]
    assert [bool(x) for x in got] == [True] * len(sound) + [False] * len(broken) and None not in got
    lines = spark.createDataFrame([("4397110767823743 +1 (654) a text",), ("12",), ('{"id": 1} rest',)], "value string")
    assert {(r.fault, r.n) for r in S.line_faults(lines).collect()} == {("no JSON", 2), ("no object", 1)}
    assert S.bad_lines(lines).count() == 2
