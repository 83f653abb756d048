"""Markdown as columns: headings, purpose, bullets, learnings and plan sections, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapsed, shortened, slug

# fixed values: headers of a block of learnings in order of precedence, and words that tell bullets apart
LEARNING_HEADERS = ("## key learnings", "### key learnings", "## learnings", "### learnings", "## takeaways", "### takeaways")
DECISIONS = r"^(decided|chose) | we chose | chose to |rationale:|decision:"
RULES = r"must |never |always |required|do not |don't "
BULLET = r"[ \t]*(?:[-*+] |[0-9]+[.)] )"
CONTINUED = "\n\n… [continues in the next part]"


def without_fences(text: Column) -> Column:
    """The text without fenced code; an open fence runs to the end."""
    return F.regexp_replace(text, r"(?ms)^[ \t]*```.*?(?:^[ \t]*```[^\n]*$|\z)", "")


def plain_inline(line: Column) -> Column:
    """Links as their text; emphasis and code marks dropped."""
    return F.regexp_replace(F.regexp_replace(line, r"\[([^\]]*)\](?:\([^)]*\))?", "$1"), r"[*_`]+", "")


def _lines(text: Column) -> Column:
    return F.transform(F.split(without_fences(F.coalesce(text, F.lit(""))), "\r?\n"), lambda s: F.ltrim(s))


def headings(text: Column) -> Column:
    """Array of (level, text) of the headings outside fenced code."""
    marked = F.filter(_lines(text), lambda s: s.rlike(r"^#{1,6} +[^ #]"))
    return F.transform(
        marked,
        lambda s: F.struct(
            F.length(F.regexp_extract(s, "^(#+)", 1)).alias("level"),
            F.trim(F.regexp_replace(F.regexp_replace(s, "^#+", ""), "#+[ \t]*$", "")).alias("text"),
        ),
    )


def purpose(text: Column, path: Column) -> Column:
    """The first paragraph of prose, else the first top heading, else the file's name in words."""
    prose = F.array_join(F.filter(_lines(text), lambda s: ~s.rlike(r"^(#|>|<!--|\[!\[)")), "\n")
    first = F.regexp_extract(prose, r"(?s)^\s*(.*?)[ \t]*(?:\n[ \t]*\n|\z)", 1)
    tops = F.filter(headings(text), lambda h: h["level"] == 1)
    name = F.regexp_replace(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.mdx?$", ""), "[-_]", " ")
    found = shortened(plain_inline(F.trim(F.regexp_replace(first, "\n+", " "))), 280)
    return F.coalesce(F.when(found != "", found), F.get(tops, 0)["text"], name)


def bullets(text: Column) -> Column:
    """Array of (kind, text): decisions, rules, and at most 20 responsibilities."""
    items = F.transform(F.filter(_lines(text), lambda s: s.rlike(r"^[-*+] +\S")), lambda s: plain_inline(F.trim(F.substring(s, 3, 1 << 30))))
    low = F.lower
    kinds = F.transform(
        items,
        lambda s: F.struct(F.when(low(s).rlike(DECISIONS), "decision").when(low(s).rlike(RULES), "rule").otherwise("responsibility").alias("kind"), s.alias("text")),
    )
    of = lambda k: F.filter(kinds, lambda x: x["kind"] == k)
    return F.concat(of("decision"), of("rule"), F.slice(of("responsibility"), 1, 20))


def learnings(text: Column) -> Column:
    """Array of (title, content, key) of the items in the first block of learnings.

    An item is a bullet or a number with the lines that follow it; null or no block gives no items.
    """
    blocks = [F.regexp_extract(text, rf"(?is)(?:^|\n){h}[^\n]*\n(.*?)(?=\n#{{1,3}} |\z)", 1) for h in LEARNING_HEADERS]
    block = F.coalesce(*(F.when(b != "", b) for b in blocks), F.lit(""))
    items = F.filter(F.split(block, rf"(?m)^(?={BULLET})"), lambda s: s.rlike(f"^{BULLET}"))
    clean = F.transform(
        items,
        lambda s: F.array_join(F.filter(F.transform(F.split(F.regexp_replace(s, f"^{BULLET}", ""), "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n"),
    )
    first = lambda s: F.regexp_replace(F.substring_index(s, "\n", 1), "^[*_`]+|[*_`]+$", "")
    return F.transform(
        F.filter(clean, lambda s: s != ""),
        lambda s: F.struct(
            F.when(F.length(first(s)) > 100, F.concat(F.substring(first(s), 1, 97), F.lit("…"))).otherwise(first(s)).alias("title"),
            s.alias("content"), F.substring(F.sha2(collapsed(s), 256), 1, 16).alias("key"),
        ),
    )


def plan(text: Column) -> Column:
    """(title, overview, sections): a section for each ``##``, with the number of the phase its heading names."""
    pieces = F.split(F.coalesce(text, F.lit("")), r"(?m)^(?=## )")
    head = F.get(pieces, 0)
    head = F.when(head.startswith("## "), "").otherwise(head)
    title = F.nullif(F.trim(F.regexp_extract(head, r"(?m)^# (.*)$", 1)), F.lit(""))
    sections = F.transform(
        F.filter(pieces, lambda p: p.startswith("## ")),
        lambda p: F.struct(
            F.trim(F.regexp_extract(p, r"^## ([^\n]*)", 1)).alias("heading"),
            F.regexp_extract(p, r"(?i)^## (?:(?!phase)[^\n])*phase[ \t]*([0-9]+)", 1).try_cast("int").alias("phase"),
            F.regexp_replace(F.regexp_replace(p, r"^## [^\n]*\n?", ""), r"^\s+|\s+\z", "").alias("body"),
        ),
    )
    overview = F.regexp_replace(F.regexp_replace(head, r"(?m)^# .*\n?", ""), r"^\s+|\s+\z", "")
    return F.struct(title.alias("title"), overview.alias("overview"), sections.alias("sections"))


def split_section(body: Column, limit: int) -> Column:
    """Parts of at most ``limit`` characters, cut at the last paragraph, else line, else anywhere.

    A cut before a quarter of the room is not taken; all parts but the last say that they go on.
    """
    room = max(limit - len(CONTINUED) - 1, 1)
    least = room // 4 + 1
    part = (
        rf"(?s)\G(?:.{{1,{limit}}}\z|(?:.{{{least},{max(room - 2, least)}}}(?=\n\n)|(?!.{{0,{max(room - 2, 0)}}}\n\n).{{{least},{max(room - 1, least)}}}(?=\n)|.{{1,{room}}})\n*)"
    )
    pieces = F.filter(F.regexp_extract_all(body, F.lit(part), F.lit(0)), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")) != "")
    marked = F.transform(pieces, lambda p, i: F.when(i + 1 < F.size(pieces), F.concat(F.regexp_replace(p, r"\s+\z", ""), F.lit(CONTINUED))).otherwise(p))
    return F.when(F.length(body) <= limit, F.array(body)).otherwise(marked)


def section_key(plan_slug: Column, index: Column, heading: Column) -> Column:
    return F.concat(F.lit("plan:"), plan_slug, F.lit(":"), F.lpad(index.cast("string"), 2, "0"), F.lit("-"), slug(heading))


def part_key(key: Column, part: Column, parts: Column) -> Column:
    return F.when(parts <= 1, key).otherwise(F.concat(key, F.lit("--p"), F.lpad(part.cast("string"), 2, "0")))


def with_tag(tags: Column, prefix: str, value: Column) -> Column:
    """``tags`` with one tag of the prefix, its value replaced."""
    return F.array_append(F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: ~t.startswith(prefix)), F.concat(F.lit(prefix), value))
