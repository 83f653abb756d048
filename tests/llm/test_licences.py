"""The licence scan against a search of every place for every template."""

import math
import random
import re

import pytest

from tessera.llm.licences import BASE, scan, template, templates

RARE, SHARE = 6, 0.8


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(rows, known):
    texts = [words(t) for _, t in rows]
    df = {w: sum(w in t for t in map(set, texts)) for k in known for w in k.words}
    weight = {w: math.log((len(rows) + 1) / (c + 1)) + 1e-9 for w, c in df.items()}
    out = []
    for (i, _), w in zip(rows, texts, strict=True):
        found = []
        for t in known:
            mine = sorted(range(len(t.words)), key=lambda p, t=t: (df[t.words[p]], t.words[p], p))[:RARE]
            for s in range(len(w)):
                at = lambda p, s=s: w[s + p] if s + p < len(w) else None
                if all(w[s + a : s + b] == list(t.words[a:b]) for a, b in t.keys):
                    share = sum(weight[t.words[p]] for p in mine if at(p) == t.words[p]) / sum(weight[t.words[p]] for p in mine)
                    if share >= SHARE - 1e-12:
                        found.append((t, s, share))
        base = [x for x in found if x[0].base]
        starts = [s for _, s, _ in base]
        out.append((i, len(w), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x[0].label for x in base})), ",".join(sorted({x[0].label for x in found})), round(max((x[2] for x in found), default=0), 9)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    some = "mit license apache general public LICENSE the MIT-License é1 gnu lesser General affero".split()
    made = [(i, "".join(draw.choice(some) + draw.choice(" .\n-/") for _ in range(draw.randint(0, 40)))) for i in range(300)]
    for i, t in enumerate(templates()):
        own = list(t.words)
        made.append((400 + i, "Some text. " + " ".join(own).title() + "; more text"))
        own[draw.randrange(len(own))] = "other"
        made.append((500 + i, " ".join(own)))
    return made + [(600, None), (601, ""), (601, ""), (None, "MIT License"), (602, "license " * 20_000), (603, "mit\x00license ÀMIT license KK")]


def test_equals_a_search_of_every_place(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, words string, found int").repartition(5)
    got = scan(df, rare=RARE, least_share=SHARE)
    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels")
    assert sorted(((*(r[c] for c in columns), round(r.score, 9)) for r in got.collect()), key=str) == plain(rows, templates())
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in got.collect())
    assert scan(df.limit(0)).count() == 0


def test_work_stays_in_the_jvm_and_texts_are_not_shuffled(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plan = scan(df)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_templates():
    t = template("x", "one [two three] four [five]")
    assert t.words == ("one", "two", "three", "four", "five") and t.keys == ((1, 3), (4, 5))
    assert {" ".join(t.words): t.label for t in templates() if t.base} == BASE
