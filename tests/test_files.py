"""Heuristics, inventories and DDL on small cases; inventories against a walk of every folder."""

import random

import pytest

from tessera.operators import heuristics as H
from tessera.operators import inventory as V


def one(spark, content, path="src/a.ts"):
    return H.heuristics(spark.createDataFrame([(path, content, 1)], "path string, content string, literals_ int")).first()


def test_every_pattern_and_note(spark):
    text = "getInstance(); new Factory; @Inject; x.on(1); a.pipe(b); Strategy implements; app.use(req); @guard; repository jwt sign password argon xss cors allow authguard helmet throttle"
    got = one(spark, text, "src/Model.ts")
    assert got.patterns == [n for n, _ in H.PATTERNS] and got.security == [n for n, _ in H.SECURITY]
    assert one(spark, text).patterns == [n for n, _ in H.PATTERNS][:-1]
    for empty in (None, "", "\n", "nothing here"):
        r = one(spark, empty)
        assert (r.patterns, r.security, r.rules, r.gotchas, r.responsibilities, r.trait_impls, r.purpose) == ([], [], [], [], [], [], "a")
    assert H.heuristics(spark.createDataFrame([], "path string, content string")).count() == 0


def test_literals_overlap(spark):
    df = spark.createDataFrame([("@injectable request",), ("x" * 500_000 + "REQUEST",)], "content string")
    got = [{H.LITERALS[k] for k in r.literals} for r in H.literals_in(df).collect()]
    assert got == [{"@inject", "@injectable", "req", "request"}, {"req", "request"}]


def test_lines(spark):
    text = "#!/bin/sh\r\n\r\n/// Reads whole tables\r\nexport async default class HTTPServerPool {\r\nfn new()\n  pub fn read_all_rows()\ndef _x\ndef get_page(a)\n// x must be; always\nconst MAX_N_ = 1\n// Fixme now @ts-ignore\nimpl<T> Store<T> for a::Disk<T> {\n"
    got = one(spark, text)
    assert got.purpose == "Reads whole tables"
    assert got.responsibilities == ["httpserver pool", "read all rows", "get page"]
    assert got.rules == ["Line 9: x must be; always", "MAX_N_ — constant"]
    assert got.gotchas == ["Line 11: Fixme now @ts-ignore", "Line 11: TS suppression"] and got.trait_impls == ["Store for a::Disk"]
    many = one(spark, "a // hack x\nb // hack @ts-ignore eslint-disable\n" * 9)
    assert len(many.gotchas) == 12 and many.gotchas[-1] == "Line 6: ESLint disabled"
    assert one(spark, "/* @description  Does it \n*/").purpose == "Does it" and one(spark, "x\n// a longer comment").purpose == "a"


def walk(paths, rules):
    """What a walk from the top lists: a folder that is ignored is not entered."""
    out = set()
    for p in paths:
        parts, kept = p.split("/"), True
        for k in range(1, len(parts) + 1):
            name, node, verdict = parts[k - 1], "/".join(parts[:k]), None
            for j in range(k):
                folder = "/".join(parts[:j])
                for pattern, keep in rules.get(folder, []):
                    here = node[len(folder) + 1 :] if folder else node
                    if name.endswith(pattern[1:]) if pattern.startswith("*") else here == pattern if "/" in pattern else name == pattern:
                        verdict = keep
            kept &= verdict is not False
        if kept:
            out.add(p)
    return out


def test_inventory_against_a_walk(spark):
    draw, names = random.Random(6), ["a", "b", "c.log", "d.md", "keep.log"]
    paths = sorted({"/".join(draw.choice(names) for _ in range(draw.randint(1, 5))) for _ in range(300)})
    folders = sorted({"/".join(p.split("/")[:k]) for p in paths for k in range(len(p.split("/")))})
    files, rules = [], {}
    for folder in draw.sample(folders, 25) + [""]:
        for name in V.IGNORE_FILES:
            lines = [draw.choice(["*.log", "!keep.log", "a", "!a/b", "a/b", "# no", "", " d.md ", "/b/", "!", "*"]) for _ in range(draw.randint(0, 3))]
            files.append((f"{folder}/{name}".lstrip("/"), "\r\n".join(lines)))
            for line in (x.strip() for x in lines):
                pattern = line.lstrip("!").strip("/")
                if pattern and not line.startswith("#"):
                    rules.setdefault(folder, []).append((pattern, line.startswith("!")))
    files += [("x/.gitignore", None), ("README.md", "*.md")]
    df = spark.createDataFrame([(p, 10, i) for i, p in enumerate(paths)] + [(None, 1, 0), (paths[0], 10, 99)], "path string, size long, folder int").repartition(3)
    found = V.ignore_rules(spark.createDataFrame(files, "path string, content string"))
    got = [r.path for r in V.listed(df, found).collect()]
    want = walk(paths, rules)
    assert set(got) == want and len(got) == len(want) + (paths[0] in want)
    assert V.listed(df.limit(0), found).count() == 0 and V.listed(df, found.limit(0)).count() == len(paths) + 1


@pytest.mark.parametrize("path,kept", [("a/node_modules/x.js", 0), ("a.min.js", 0), (".env", 0), (".env.example", 1), ("a/.git/x", 0), ("a.png", 0), ("a.PNG", 1), ("Cargo.lock", 0), ("big", 0), ("src/a.rs", 1), ("noext", 1)])
def test_default_rules(spark, path, kept):
    df = spark.createDataFrame([(path, 1 << 21 if path == "big" else 1 << 20)], "path string, size long")
    assert V.listed(df).count() == kept


def test_ddl(spark):
    from tessera.operators import ddl as D

    text = """-- CREATE TABLE no (a INT);
create table "Own"."Items" ( id  BIGINT, kind TEXT DEFAULT 'a, (b' /* x, y */, price DECIMAL(10, 2) CHECK (price > (1 + 2)),
  "note" TEXT DEFAULT 'it''s, so', lone, FOREIGN KEY (a, b) REFERENCES other (x, y), CONSTRAINT c FOREIGN KEY (z) REFERENCES q, PRIMARY KEY (id), UNIQUE(a), check (1) );
ALTER TABLE Items ADD COLUMN extra int not null; alter table x DROP COLUMN y; ALTER TABLE x ADD CONSTRAINT f FOREIGN KEY (k) REFERENCES l(m); ALTER TABLE x RENAME TO z;
CREATE UNIQUE INDEX IF NOT EXISTS "ix" ON Items (a, b); create index j on k ( lower(a) );"""
    rows = spark.createDataFrame([("a/007_add-items.sql", text, 1), ("b.sql", None, 2), ("c.sql", "", 3), ("d.sql", "select 1; ALTER TABLE broken", 4)], "path string, content string, kind_ int")
    got = [tuple(r)[3:] for r in D.declarations(rows).orderBy("path", "nth").collect()]
    assert got == [
        ("table", 'Items', None, None, "Own", None, None),
        ("column", '"Own"."Items"', "id", "BIGINT", "", None, None), ("column", '"Own"."Items"', "kind", "TEXT", "DEFAULT 'a, (b'", None, None),
        ("column", '"Own"."Items"', "price", "DECIMAL(10,", "2) CHECK (price > (1 + 2))", None, None), ("column", '"Own"."Items"', "note", "TEXT", "DEFAULT 'it''s, so'", None, None),
        ("foreign_key", '"Own"."Items"', "a, b", None, None, "other", "x, y"), ("foreign_key", '"Own"."Items"', "z", None, None, "q", ""),
        ("add_column", "Items", "EXTRA", "INT", "NOT NULL", None, None), ("drop_column", "x", "Y", None, None, None, None), ("add_foreign_key", "x", "k", None, None, "l", "m"), ("alter", "x", None, None, "RENAME TO z", None, None),
        ("unique_index", "Items", "ix", None, "a, b", None, None), ("index", "k", "j", None, "lower(a", None, None),
    ]
    named = {r.path: tuple(r.m) for r in rows.select("path", D.migration(rows.path).alias("m")).collect()}
    assert named == {"a/007_add-items.sql": ("007", "add-items"), "b.sql": (None, "b"), "c.sql": (None, "c"), "d.sql": (None, "d")}
    assert D.declarations(rows.limit(0)).count() == 0
