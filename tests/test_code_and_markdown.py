"""Markdown, plans, answers and source files on small cases."""

from datetime import datetime

from pyspark.sql import functions as F

from tessera.functions import markdown as M
from tessera.operators import answers, code


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


DOC = "# Guide #\n\n> quoted\nReads **rows** and [writes](http://x) them.\nMore `text`.\n\n```sh\n# not a heading\n- not a bullet\n```\n## Rules\n- must stay small\n* decided to use files\n+ reads tables\n- \n"


def test_markdown(spark):
    assert [(h.level, h.text) for h in one(spark, DOC, M.headings)] == [(1, "Guide"), (2, "Rules")]
    assert one(spark, DOC, lambda t: M.purpose(t, F.lit("a/b.md"))) == "Reads rows and writes them. More text."
    assert one(spark, "# Only\n", lambda t: M.purpose(t, F.lit("a/b.md"))) == "Only"
    assert one(spark, None, lambda t: M.purpose(t, F.lit("docs/my-file_name.md"))) == "my file name"
    assert [(b.kind, b.text) for b in one(spark, DOC, M.bullets)] == [("decision", "decided to use files"), ("rule", "must stay small"), ("responsibility", "reads tables")]
    assert one(spark, "```\n# open\n- x", M.headings) == [] and one(spark, None, M.bullets) == []


def test_learnings(spark):
    text = "intro\n## Key Learnings\nlead\n- **first**\n  goes on\n\n2) second " + "x" * 120 + "\n* third\n### Next\n- not this"
    got = one(spark, text, M.learnings)
    assert [g.content for g in got] == ["**first**\ngoes on", "second " + "x" * 120, "third"]
    assert got[0].title == "first" and len(got[1].title) == 98 and got[1].title.endswith("…") and len(got[2].key) == 16
    assert one(spark, "#### Key learnings\n- x", M.learnings) == [] and not one(spark, None, M.learnings)


def test_plan(spark):
    got = one(spark, "# Big plan\nwhy\n\n## Phase 2 — storage\nbody\n### Phase 9\n## Notes\nprose\n", M.plan)
    assert (got.title, got.overview) == ("Big plan", "why")
    assert [(s.heading, s.phase, s.body) for s in got.sections] == [("Phase 2 — storage", 2, "body\n### Phase 9"), ("Notes", None, "prose")]
    assert one(spark, "", M.plan).sections == []


def test_split_section(spark):
    text = "\n\n".join(("para %d " % i) + "w" * (7 * i % 60) for i in range(40)) + "\n" + "z" * 300
    parts = one(spark, text, lambda t: M.split_section(t, 120))
    assert all(len(p) <= 120 for p in parts) and all(p.endswith(M.CONTINUED) for p in parts[:-1])
    assert "".join(p.removesuffix(M.CONTINUED) for p in parts).replace("\n", "") == text.replace("\n", "")
    assert one(spark, "short", lambda t: M.split_section(t, 120)) == ["short"]
    keyed = spark.range(1).select(M.part_key(M.section_key(F.lit("p"), F.lit(3), F.lit("The Body")), F.lit(2), F.lit(3)), M.with_tag(F.array(F.lit("status:draft"), F.lit("phase:2")), "status:", F.lit("done"))).first()
    assert keyed[0].startswith("plan:p:03-the-body") and keyed[1] == ["phase:2", "status:done"]


def test_entry_points_and_patterns(spark):
    files = spark.createDataFrame(
        [("web/pages/index.tsx", "x"), ("manage.py", None), ("src/main.rs", "use axum::Router;"), ("b/main.rs", "fn main"), ("srv/app.js", "const a = Express()"), ("util.py", "")],
        "path string, content string",
    )
    got = {r.path: (r.framework, r.confidence) for r in code.ranked_entry_points(code.entry_points(files)).collect()}
    assert got == {"web/pages/index.tsx": ("nextjs", 0.95), "manage.py": ("django", 0.95), "src/main.rs": ("axum", 0.93), "b/main.rs": ("rust-binary", 0.7), "srv/app.js": ("express", 0.9)}
    pages = spark.createDataFrame([("a/cache.ts", None), ("b.ts", "Redis client"), ("c/auth.ts", ""), ("d/jwt.ts", "")], "path string, purpose string")
    assert [tuple(r) for r in code.cross_file_patterns(pages).collect()] == [("cache-layer", 2, 1.0)]


def test_imports(spark):
    files = spark.createDataFrame(
        [
            ("src/main.ts", "import {a} from './a'\nimport './lib'\nconst x = require('../b.js')\nimport React from 'react'"),
            ("src/a.ts", ""), ("src/lib/index.ts", ""), ("b.ts", None),
            ("pkg/one.py", "from . import two\nfrom .two import x\nimport os, pkg.sub as s\n"), ("pkg/two.py", ""), ("pkg/__init__.py", ""), ("pkg/sub/__init__.py", ""),
            ("src/net/mod.rs", "use crate::store::Row;\nuse super::util;\nuse std::fs;"), ("src/store.rs", ""), ("src/util.rs", ""),
            ("m.go", 'import (\n "fmt"\n x "a/b"\n)\nimport "os"'),
        ],
        "path string, content string",
    )
    found = code.imports(files)
    named = {}
    for r in found.collect():
        named.setdefault(r.path, set()).add(r.source)
    assert named["src/main.ts"] == {"./a", "./lib", "../b.js", "react"} and named["m.go"] == {"fmt", "a/b", "os"}
    assert named["pkg/one.py"] == {".", ".two", "os", "pkg.sub"} and named["src/net/mod.rs"] == {"crate::store::Row", "super::util", "std::fs"}
    assert {(r.path, r.source, r.target) for r in code.resolved_imports(found, files).collect()} == {
        ("src/main.ts", "./a", "src/a.ts"), ("src/main.ts", "./lib", "src/lib/index.ts"), ("src/main.ts", "../b.js", "b.ts"),
        ("pkg/one.py", ".", "pkg/__init__.py"), ("pkg/one.py", ".two", "pkg/two.py"), ("pkg/one.py", "pkg.sub", "pkg/sub/__init__.py"),
        ("src/net/mod.rs", "crate::store::Row", "src/store.rs"), ("src/net/mod.rs", "super::util", "src/util.rs"),
    }


def test_ddl(spark):
    sql = "-- create table no (x)\nCREATE TABLE IF NOT EXISTS Users (id int, t int REFERENCES teams(id));\nalter table users add x int;\ncreate unique index ix on users (id);"
    files = spark.createDataFrame([("m/0012_users.sql", sql), ("e.sql", None)], "path string, content string")
    assert {(r.kind, r.name, r.other) for r in code.ddl_landmarks(files).collect()} == {("table", "users", None), ("alter", "users", None), ("index", "ix", "users"), ("reference", "teams", "id")}
    assert [r[0] for r in files.select(code.migration_number(F.col("path"))).collect()] == [12, None]


def test_answers(spark):
    when = datetime(2024, 2, 3)
    questions = spark.createDataFrame([(1, "why?", "decision"), (2, "what broke", "bug-history"), (3, "nothing", "general"), (4, "shape", "architecture")], "question_id long, question string, kind string")
    ranked = spark.createDataFrame([(1, 0, 7, "T", "decision", "C", when), (2, 1, 8, "U", "note", "D", when), (2, 0, 9, "V", "note", "E" * 400, when), (4, 0, 5, "A", "architecture", "whole", when)], "question_id long, rank int, id long, title string, type string, content string, created_at timestamp")
    got = {r.question_id: r for r in answers.answers(questions, ranked).collect()}
    assert got[1].answer == "## Relevant Decisions\n\n### T\nC\n" and [(c.id, c.relevance) for c in got[2].citations] == [(9, 1.0), (8, 0.95)]
    assert got[2].answer == "## Bug History\n\n- **V** (2024-02-03): " + "E" * 300 + "...\n- **U** (2024-02-03): D"
    assert (got[3].answer, got[3].has_answer) == ("", False) and got[4].answer == "## shape\n\nwhole\n"
