"""Insights of tool payloads on small cases, and the saving rule against a plain loop."""

import json
import random
from datetime import datetime, timedelta

from tessera.operators import payloads as P


def told(spark, *payloads):
    rows = [(i, p if p is None or isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "id int, payload string")
    return sorted(P.insights(df).collect(), key=lambda r: (r.id, r.rule)), {r.id: r.fault for r in P.rejected(df).collect()}


def edit(path, old, new, **more):
    return {"tool_name": "Edit", "tool_input": {"file_path": path, "old_string": old, "new_string": new}, **more}


def bash(command, code, **out):
    return {"tool_name": "Bash", "tool_input": {"command": command}, "tool_response": {"exitCode": code, **out}}


def test_edits(spark):
    got, bad = told(
        spark, edit("config/database.toml", "a", "b", session_id="s"), edit("src/a.rs", "x", 'y = std::env::var("PORT")\nz'), edit("src/main.rs", "// a", "// b"),
        edit("Cargo.lock.toml", "a", "b"), edit("a.js", "process.env.A", "process.env.B"), edit("a.py", "x", "os.environ.get(k)"), edit("a.toml", "", "b"), edit("vite.config.ts", "a", "process.env.KEY"),
    )
    assert [(r.id, r.rule, r.title, r.topic_key) for r in got] == [
        (0, "config change", "Config change: database", "config:database"), (1, "env var", "New env var: PORT in a", "env:PORT"), (5, "env var", "New env var: unknown in a", "env:unknown"),
        (7, "config change", "Config change: vite.config", "config:vite.config"), (7, "env var", "New env var: KEY in vite.config", "env:KEY"),
    ]
    assert got[0].session == "s" and got[0].tags == ["auto-extract", "config", "config/database.toml"] and '```\ny = std::env::var("PORT")\n```' in got[1].content and not bad


def test_writes_and_commands(spark):
    write = lambda p: {"tool_name": "Write", "tool_input": {"file_path": p}}
    got, _ = told(
        spark, write("Dockerfile"), write("x/.github/workflows/ci.yml"), write("db/migrations/1.sql"), write("a/b.yaml"), write("src/a.ts"), write("yarn.lock"),
        bash("cargo test", 1, stderr="test a::b ... FAILED\ntest c ... ok"), bash("npx tsc", 2, stdout="e" * 600), bash("eslint .", 1, stdout="x"), bash("make all", 0), bash("ls", 1), bash("", 1), bash("pytest", "1"), bash("pytest", 1, stderr=5, stdout="FAILED t.py::x\n"),
    )
    assert [(r.id, r.type, r.confidence) for r in got] == [
        (0, "architecture", 0.90), (1, "architecture", 0.85), (2, "architecture", 0.80), (3, "decision", 0.70), (6, "bug", 0.75), (7, "auto-change", 0.70), (8, "tech-debt", 0.70), (13, "bug", 0.75),
    ]
    assert got[4].title == "Test failure: a::b" and got[-1].title == "Test failure: t.py::x" and "e" * 500 + "...\n" in got[5].content


def test_rejected_and_silent(spark):
    got, bad = told(spark, None, "", "{", "[1]", '"x"', {"tool_name": 5}, {}, {"tool_name": "Edit", "session_id": 5}, {"tool_name": "Edit", "session_id": None}, {"tool_name": "mcp__store__save"}, {"tool_name": "Read"}, {"tool_name": "Edit", "tool_input": "x"})
    assert not got and bad == {**dict.fromkeys(range(5), "no object"), 5: "no tool name", 6: "no tool name", 7: "session is no text"}


def test_saving_rule(spark):
    draw, start, rows = random.Random(2), datetime(2024, 1, 1), []
    for i in range(600):
        p = edit(f"c{draw.randrange(60)}.toml", "a", draw.choice(["b", f"process.env.V{draw.randrange(90)}"]), session_id=f"s{draw.choice([0, 0, 0, 1, 2])}")
        rows.append((i, start + timedelta(seconds=draw.randrange(6000)), json.dumps(p)))
    df = spark.createDataFrame(rows, "id int, ts timestamp, payload string").repartition(4)
    found = P.insights(df)
    for most in (20, 5):
        got = sorted((r.id, r.rule) for r in P.saved_insights(found, "ts", "id", most).collect())
        want, state = [], {}
        by_payload = {}
        for r in found.collect():
            by_payload.setdefault((r.session, r.ts, r.id), []).append(r)
        for (s, t, i), mine in sorted(by_payload.items()):
            last, used, seen = state.get(s, (None, 0, frozenset()))
            if used >= most or last is not None and (t - last).total_seconds() < 30:
                continue
            kept = [r for r in sorted(mine, key=lambda r: (r.rule != "env var", r.rule)) if r.topic_key not in seen][: most - used]
            if kept:
                state[s] = (t, used + len(kept), seen | {r.topic_key for r in kept})
                want += [(i, r.rule) for r in kept]
        assert got == sorted(want)
    assert P.saved_insights(P.insights(df.limit(0)), "ts", "id").count() == 0
