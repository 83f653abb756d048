"""Decisions fall on rows: repeated ids with other texts, repeated rows, null ids."""

import io
from contextlib import redirect_stdout

import corpus_pipeline
import pytest

from tessera.llm.exact_dedup import drop_exact_copies, exact_dedup
from tessera.llm.jaccard_dedup import drop_similar
from tessera.llm.language_id import with_known_language
from tessera.llm.simhash_dedup import drop_near_copies, simhash_components
from tessera.llm.storage import materialize

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "one two three four five six seven eight nine ten eleven twelve"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS).repartition(3)


def held(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


@pytest.mark.parametrize("drop", [drop_near_copies, drop_similar, drop_exact_copies])
def test_a_repeated_id_does_not_take_other_texts_along(spark, drop):
    other = "wholly different words stand here in the second text of that very id"
    rows = [(1, LONG), (2, LONG), (2, other), (3, "  "), (3, None), (None, LONG), (None, other + " and more of it at the end x y z q"), (1, LONG), (1, LONG)]
    got = held(drop(frame(spark, rows)))
    assert (1, LONG) in got and (2, other) in got and (2, LONG) not in got and ((None, LONG) in got) == (drop is not drop_exact_copies)
    assert got.count((1, LONG)) == 1 and any(i is None for i, _ in got) and sum(i == 3 for i, _ in got) in (1, 2)
    assert held(drop(frame(spark, rows).limit(0))) == []


def test_simhash_groups_by_own_text(spark):
    rows = [(2, LONG), (2, "quite another text of several words that shares nothing at all"), (5, LONG + " "), (None, LONG)]
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash_components(frame(spark, rows)).collect())
    assert [x[2] for x in got] == [2, 2, 2, None] and len({x[1] for x in got}) == 2


def test_language_is_told_row_by_row(spark):
    draw = __import__("random").Random(3)
    rows = [(i, " ".join("".join(draw.choice("abcdeé" if i % 2 else "mnopqß") for _ in range(5)) for _ in range(30)), "ab" if i % 2 else "mn") for i in range(300)]
    odd = [(7, "12345", None), (7, rows[7][1], None), (7, rows[7][1], None), (None, rows[8][1], "mn"), (301, None, "ab"), (302, "", "ab")]
    df = spark.createDataFrame([(i, t, l, "s", 1) for i, t, l in rows + odd], COLUMNS).repartition(4)
    got = held(with_known_language(df))
    assert got == sorted(((i, t) for i, t, _ in rows + odd if any(c.isalpha() for c in t or "")), key=str)
    assert {t for _, t in held(with_known_language(df, wanted=("ab",)))} <= {t for i, t, _ in rows + odd if t and set(t) & set("abcdeé")}
    assert with_known_language(df, least_lead=0.999999).count() == 0
    assert with_known_language(df.limit(0)).count() == 0


def test_exact_merge_sorts_in_every_round(spark):
    df = frame(spark, [(i, f"t{i % 7}") for i in range(50)])
    out = io.StringIO()
    with redirect_stdout(out):
        exact_dedup(df, runs=8).explain()
    plan = out.getvalue()
    merges = [x for x in plan.splitlines() if "row_number() windowspecdefinition(run" in x and "keep_id" in x]
    assert len(merges) >= 3 and "Python" not in plan and "Arrow" not in plan
    for runs in (1, 2, 16):
        assert sorted(tuple(r)[:4] for r in exact_dedup(df, runs=runs).collect()) == sorted((i, i % 7, 8 if i % 7 == 0 else 7, i < 7) for i in range(50))
    with pytest.raises(ValueError):
        exact_dedup(df, runs=3)


def test_pipeline_of_empty_and_repeated_rows(spark):
    letters = [(i, LONG.replace("one", "w" * (i + 1)) + f" x{i} y{i} z{i} v{i} u{i}") for i in range(6)]
    docs = frame(spark, [*letters, letters[0], (0, "9 9 9"), (9, None)])
    for frames, least in ((docs, 1), (docs.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES:
            frames = materialize(stage(spark, frames, ""))
        assert frames.count() >= least
