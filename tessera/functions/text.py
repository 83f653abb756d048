"""Text expressions over columns, all inside the JVM's generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that carry no signal in a search
STOPWORDS = (
    "a", "about", "after", "all", "also", "am", "an", "and", "any", "are", "as", "at", "back", "be", "because",
    "been", "before", "being", "but", "by", "can", "could", "did", "do", "does", "doing", "done", "for", "from",
    "had", "has", "have", "having", "he", "her", "here", "him", "his", "how", "i", "if", "in", "into", "is", "it",
    "its", "just", "let", "like", "may", "me", "might", "much", "must", "my", "need", "no", "not", "now", "of", "off",
    "on", "once", "one", "only", "or", "our", "out", "over", "please", "put", "said", "same", "see", "shall", "she",
    "should", "so", "some", "still", "such", "sure", "tell", "than", "that", "the", "their", "them", "then", "there",
    "these", "they", "thing", "things", "this", "those", "through", "to", "too", "under", "up", "us", "very", "want",
    "was", "way", "we", "were", "what", "when", "where", "which", "while", "who", "whom", "why", "will", "with",
    "would", "yes", "you", "your",
)
MAX_TERMS = 12


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing behind it; false for null.

    Spark's parser stops after the first value. So the text is read as the only item of an array and as the value of a key: what
    closes the one bracket early does not fit into the other.
    """
    items = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).cast("array<variant>")
    return (F.coalesce(F.size(items), F.lit(-1)) == 1) & F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit("}"))).isNotNull()


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def content_hash(title: Column, content: Column) -> Column:
    """SHA-256 of normalised title, line feed, normalised content."""
    return F.sha2(F.concat(collapsed(title), F.lit("\n"), collapsed(content)), 256)


def shortened(text: Column, n: int) -> Column:
    """The first ``n`` characters, with an ellipsis only where something was cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def bounded(text: Column, n: int) -> Column:
    """At most ``n`` characters; a cut text ends with a marker that fits the bound and counts what is beyond it."""
    marker = F.concat(F.lit("\n\n… [truncated "), (F.length(text) - n).cast("string"), F.lit(" chars]"))
    return F.when(F.length(text) > n, F.concat(text.substr(F.lit(1), F.greatest(F.lit(n) - F.length(marker), F.lit(0))), marker)).otherwise(text)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def name_tokens(name: Column) -> Column:
    """Words of a camel- or snake-case name, then the whole name in lower case, joined by spaces."""
    humps = F.regexp_replace(F.regexp_replace(name, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2"), r"([^\p{Lu}\s_:.\-])(\p{Lu})", "$1 $2")
    words = F.filter(F.split(F.lower(humps), r"[\s_:.\-]+"), lambda w: F.length(w) > 1)
    return F.array_join(F.when(F.array_contains(words, F.lower(name)), words).otherwise(F.array_append(words, F.lower(name))), " ")


def slug(title: Column, n: int = 64) -> Column:
    """Lower-case letters and digits with single dashes, ``n`` characters at most, never empty."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", "-"), "^-", "")
    out = F.regexp_replace(F.substring(dashed, 1, n), "-$", "")
    return F.when(out == "", "untitled").otherwise(out)


def without_private(text: Column) -> Column:
    """``<private>`` blocks replaced; an open one runs to the end, the first close ends it."""
    return F.regexp_replace(text, r"(?is)<private>.*?(</private>|\z)", "[redacted]")


def without_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{Cntrl}", " ")


def confidence_of(preset: Column) -> Column:
    """A named level or a number, clamped to [0, 1]; anything else is 0.9."""
    name = F.lower(F.trim(preset))
    known = F.when(name == "verified", 1.0).when(name == "observed", 0.9).when(name == "inferred", 0.7).when(name == "speculative", 0.4)
    number = name.try_cast("double")
    return F.coalesce(known, F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))), F.lit(0.9))


def tag_value(tags: Column, prefix: str) -> Column:
    """What follows ``prefix`` in the first tag that starts with it."""
    return F.get(F.transform(F.filter(tags, lambda t: t.startswith(prefix)), lambda t: F.substring(t, len(prefix) + 1, 1 << 20)), 0)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def search_terms(question: Column) -> Column:
    """At most twelve distinct terms: quoted phrases of more than one word, then words of two characters or more without stop words.

    Words of a quoted phrase are no terms of their own.
    """
    loose = F.regexp_replace(question, r'"[^"]*[^"\p{L}\p{N}_]+[^"]*"', " ")
    keep = F.filter(F.array_distinct(words_of(loose)), lambda w: (F.length(w) >= 2) & ~w.isin(*STOPWORDS))
    return F.slice(F.array_distinct(F.concat(search_phrases(question), keep)), 1, MAX_TERMS)


def search_phrases(question: Column) -> Column:
    """Quoted parts of more than one word, cleaned of marks."""
    quoted = F.regexp_extract_all(F.lower(F.coalesce(question, F.lit(""))), F.lit('"([^"]*)"'), 1)
    clean = F.transform(quoted, lambda p: F.trim(F.regexp_replace(p, r"[^\p{L}\p{N}_]+", " ")))
    return F.filter(clean, lambda p: p.contains(" "))


def identifiers(prompt: Column, most: int = 4) -> Column:
    """The first words of five characters or more in snake case or mixed case; all capitals are no name."""
    words = F.regexp_extract_all(F.coalesce(prompt, F.lit("")), F.lit("([A-Za-z0-9_]+)"), 1)
    mixed = lambda w: w.rlike("[A-Za-z]") & (w.contains("_") | (w.rlike("[a-z]") & w.rlike("^.+[A-Z]")))
    return F.slice(F.filter(words, lambda w: (F.length(w) >= 5) & mixed(w)), 1, most)


def hint_token(pattern: Column) -> Column:
    """The longest run of letters, digits and underscores, the first of equals; null if shorter than four or without letter."""
    runs = F.regexp_extract_all(F.coalesce(pattern, F.lit("")), F.lit("([A-Za-z0-9_]+)"), 1)
    longest = F.aggregate(runs, F.lit(""), lambda best, r: F.when(F.length(r) > F.length(best), r).otherwise(best))
    return F.when((F.length(longest) >= 4) & longest.rlike("[A-Za-z]"), longest)


def freshness(base_head: Column, base_dirty: Column, head: Column, dirty: Column) -> Column:
    """fresh, stale or unknown from what was recorded at index time and what is there now."""
    unknown = base_head.isNull() | (base_head == "no-git") | (F.coalesce(base_dirty, F.lit("")) == "") | head.isNull() | dirty.isNull()
    return F.when(unknown, "unknown").when((base_head != head) | (base_dirty != dirty), "stale").otherwise("fresh")


def marker_of(line: Column) -> Column:
    """The debt marker that a comment line starts with, or null; for whole files see ``debt_of``."""
    return F.nullif(F.regexp_extract(F.upper(line), r"^\s*(?://+|#+|--|\*|/\*)\s*(TODO|FIXME|HACK|XXX|OPTIMIZE|BUG|NOTE)", 1), F.lit(""))


# fixed values: prompts that say nothing, and marks of prompts that machines wrote
ACKNOWLEDGEMENTS = ("ok", "yes", "no", "y", "n", "sure", "thanks", "ty", "thx", "done", "go", "continue", "proceed", "please", "dale", "sí")
MACHINE_MARKS = (
    "<system-reminder>", "<task-notification>", "<task_notification>", "<command-name>", "<command-message>", "<local-command-stdout>",
    "<ide_selection>", "the user selected the following lines", "the user opened the file", "[pasted text #",
)
ORDERS = ("you are ", "you write ", "you must ", "you will ", "your task is", "your job is", "act as ")


def is_trivial(prompt: Column) -> Column:
    p = F.lower(F.trim(prompt))
    return F.coalesce((p == "") | p.startswith("/") | p.isin(*ACKNOWLEDGEMENTS), F.lit(True))


def is_machine_made(prompt: Column) -> Column:
    """Editor dumps, bulk log pastes (over 30 lines, over 80 % log-like) and agents' own templates."""
    low = F.lower(prompt)
    any_of = lambda col, parts: F.array_max(F.array(*(col.contains(p) for p in parts)))
    lines = F.split(prompt, "\n")
    log_like = F.filter(
        F.transform(lines, lambda t: F.ltrim(t)),
        lambda t: (F.length(t) >= 10)
        & (t.rlike(r"^(at |\[|.?(ERROR|WARN|INFO|DEBUG|TRACE))") | (F.length(F.regexp_replace(F.substring(t, 1, 10), "[^0-9]", "")) >= 6)),
    )
    logs = (F.size(lines) > 30) & (F.size(log_like) * 100 > F.size(lines) * 80)
    block = F.exists(lines, lambda x: F.trim(x).rlike(r"^<[A-Za-z].*>$")) | any_of(prompt, ('":', ": {", ":{"))
    return F.coalesce(any_of(low, MACHINE_MARKS) | logs | (any_of(F.substring(low, 1, 80), ORDERS) & block), F.lit(False))


def debt_of(source: Column, path: Column) -> Column:
    """Array of (line from 1, marker, text) of the debt markers in a file's comments.

    A comment is a line that starts as one, or what follows ``//`` or ``#`` outside quotes; in markdown only
    ``<!-- -->`` counts.
    """
    lines = F.split(F.coalesce(source, F.lit("")), "\r?\n")
    # quoted parts are blanked at equal length before a trailing comment is looked for
    bare = lambda s: F.regexp_replace(s, r"""("(?:[^"\\\\]|\\\\.)*"|'(?:[^'\\\\]|\\\\.)*')""", "")
    code = lambda s: F.when(s.rlike(r"^\s*(//|#|--|\*|/\*)"), F.regexp_replace(s, r"^\s*(//+|#+|--|\*|/\*)", "")).otherwise(F.regexp_extract(bare(s), r"(?://|#)(.*)$", 1))
    prose = lambda s: F.regexp_extract(s, r"<!--(.*?)-->", 1)
    markdown = F.lower(path).rlike(r"\.mdx?$")
    said = F.when(markdown, F.transform(lines, prose)).otherwise(F.transform(lines, code))
    mark = r"(?i)^\s*(TODO|FIXME|HACK|XXX|OPTIMIZE|BUG|NOTE)\b[:\s(-]*(.*)$"
    found = F.transform(
        said, lambda s, i: F.struct((i + 1).alias("line"), F.upper(F.regexp_extract(s, mark, 1)).alias("marker"), F.trim(F.regexp_extract(s, mark, 2)).alias("text"))
    )
    return F.filter(found, lambda x: x["marker"] != "")
