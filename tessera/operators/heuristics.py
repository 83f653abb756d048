"""What a source file's text suggests: purpose, responsibilities, design patterns, rules, gotchas, security, trait implementations.

All literals of all patterns are found in one pass over a text by one automaton (Aho-Corasick, in Arrow batches); a pattern is
then a condition on the few literals found. Rules on lines work within the row. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: design patterns and security notes; one literal of each group must stand in the text in lower case
PATTERNS = (
    ("Singleton", (("getinstance(", "private static instance"),)),
    ("Factory", (("factory", "create"), ("new ",))),
    ("Dependency Injection", (("@injectable", "@inject"),)),
    ("Observer/Event Emitter", (("subscribe", "eventemitter", ".on("),)),
    ("Pipeline/Transform", ((".pipe(", ".transform("),)),
    ("Strategy", (("strategy",), ("implements",))),
    ("Middleware", ((".use(", "middleware"), ("req", "request"))),
    ("Guard", (("canactivate", "@guard"),)),
    ("Repository", (("repository", ".find", ".save("),)),
)
#: fixed values: the last pattern also asks for one of these in the path
MODEL_PATHS = ("entity", "model", "schema")
SECURITY = (
    ("JWT/token handling detected", (("jwt", "bearer", "token"), ("verify", "validate", "sign"))),
    ("Sensitive data (password/credentials/secrets)", (("password", "credential", "secret"),)),
    ("Password hashing detected", (("bcrypt", "argon", "scrypt"), ("password",))),
    ("Input sanitization detected", (("sanitize", "escape", "xss"),)),
    ("CORS configuration detected", (("cors",), ("allow", "enable"))),
    ("Auth guard usage detected", (("@useguards", "canactivate", "authguard"),)),
    ("Security headers configuration", (("helmet", "content-security"),)),
    ("Rate limiting detected", (("rate-limit", "ratelimit", "throttle"),)),
)
# fixed values: names that say nothing, words of rules, prefixes of constants, marks of gotchas, and how many of each are listed
BOILERPLATE = ("constructor", "new", "toString", "toJSON", "clone", "default", "from", "into")
RULE_WORDS = ("rule", "policy", "requirement", " must ", " always ", " never ", "enforce", "constraint")
DECLARATIONS = ("const ", "let ", "val ", "static ", "public static final ", "pub const ")
LIMITS = ("MAX_", "MIN_", "DEFAULT_", "LIMIT_", "THRESHOLD_")
GOTCHAS = ("// workaround", "// hack", "// fixme", "// warning", "// caution")
MOST_RESPONSIBILITIES, MOST_RULES, MOST_GOTCHAS = 15, 20, 10
TRAIT_IMPL = r"(?m)^\s*impl(?:\s*<[^>]*>)?\s+([A-Za-z_][\w:]*)(?:\s*<[^>]*>)?\s+for\s+([A-Za-z_][\w:]*)"

LITERALS = tuple(sorted({x for _, groups in PATTERNS + SECURITY for g in groups for x in g}))
_IDENT = r"[\p{L}\p{N}_]+"


def _finder(literals: tuple[str, ...], n_kept: int):
    """Batches whose last column is the text in lower case -> the other columns and the literals found, by their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for k, x in enumerate(literals):
            machine.add_word(x, k)
        machine.make_automaton()
        for batch in batches:
            found = [sorted({k for _, k in machine.iter(t.as_py())}) if t.is_valid else [] for t in batch.column(n_kept)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], pa.array(found, pa.list_(pa.int32()))], names=[*batch.schema.names[:n_kept], "literals"])

    return run


def literals_in(files: DataFrame, content_col: str = "content", literals: tuple[str, ...] = LITERALS) -> DataFrame:
    """``files`` with ``literals``: the numbers of all literals that stand anywhere in the content, whatever its case."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields), "literals array<int>"])
    return files.select("*", F.lower(content_col).alias("__low")).mapInArrow(_finder(literals, len(files.columns)), schema)


def _meets(groups, literals: tuple[str, ...] = LITERALS) -> Column:
    out = F.lit(True)
    for g in groups:
        out = out & F.arrays_overlap("literals", F.array(*(F.lit(literals.index(x)) for x in g)))
    return out


def _named(table) -> Column:
    low = F.lower("path")
    at_model = F.lit(False)
    for p in MODEL_PATHS:
        at_model = at_model | low.contains(p)
    return F.array_compact(F.array(*(F.when(_meets(g) & (at_model if name == "Repository" else F.lit(True)), F.lit(name)) for name, g in table)))


def spoken(name: Column) -> Column:
    """A name as words in lower case: at underlines and where a small letter meets a capital."""
    return F.lower(F.replace(F.regexp_replace(name, r"(\p{Ll})(\p{Lu})", "$1 $2"), F.lit("_"), F.lit(" ")))


def _lines(content: Column) -> Column:
    whole = F.regexp_replace(F.coalesce(content, F.lit("")), r"\r?\n\z", "")
    return F.split(whole, r"\r?\n", -1)


def responsibilities(content: Column) -> Column:
    """What the first functions, classes and constants of a file do, by their names."""
    exported = rf"^\s*export (?:async )*(?:default )*(?:function |class |const )({_IDENT})"
    defined = rf"^\s*(?:pub fn |fn )({_IDENT})"
    python = rf"^\s*def ((?!_){_IDENT})"
    name = lambda s: F.coalesce(*(F.nullif(F.regexp_extract(s, p, 1), F.lit("")) for p in (exported, defined, python)))
    names = F.filter(F.transform(_lines(content), name), lambda n: n.isNotNull() & ~n.isin(*BOILERPLATE))
    return F.transform(F.slice(names, 1, MOST_RESPONSIBILITIES), spoken)


def _until(items: Column, most: int) -> Column:
    """Notes up to and with the line that brings their number to ``most``."""
    last = F.coalesce(F.get(items, F.lit(most - 1))["line"], F.lit((1 << 31) - 1))
    return F.transform(F.filter(items, lambda x: x.line <= last), lambda x: x.note)


def _by_line(content: Column, notes) -> Column:
    """(line, note) of every note of every line, in order."""
    of_line = lambda s, i: F.transform(F.array_compact(notes(s, i + 1)), lambda n: F.struct((i + 1).alias("line"), n.alias("note")))
    return F.flatten(F.transform(_lines(content), of_line))


def business_rules(content: Column) -> Column:
    """Comments that speak of rules, and constants that set limits, with their lines."""
    limit = rf"^\s*(?:{'|'.join(DECLARATIONS)})((?:{'|'.join(LIMITS)})[A-Z_]*)"

    def notes(s: Column, line: Column) -> Column:
        cleaned = F.regexp_replace(s, r"^[/*#\s]+|\s+$", "")
        comment = s.rlike(r"^\s*(//|#|/\*|\*)") & F.lower(s).rlike("|".join(RULE_WORDS)) & (F.octet_length(cleaned) > 5)
        return F.array(F.when(comment, F.concat(F.lit("Line "), line.cast("string"), F.lit(": "), cleaned)), F.when(s.rlike(limit), F.concat(F.regexp_extract(s, limit, 1), F.lit(" — constant"))))

    return _until(_by_line(content, notes), MOST_RULES)


def gotchas(content: Column) -> Column:
    """Comments that warn, and suppressed checks, with their lines."""

    def notes(s: Column, line: Column) -> Column:
        low, at = F.lower(s), F.concat(F.lit("Line "), line.cast("string"), F.lit(": "))
        cleaned = F.regexp_replace(s, r"^\s*/*\s*|\s+$", "")
        return F.array(
            F.when(low.rlike("|".join(GOTCHAS)), F.concat(at, cleaned)), F.when(low.rlike("@ts-ignore|@ts-expect-error"), F.concat(at, F.lit("TS suppression"))),
            F.when(low.contains("eslint-disable"), F.concat(at, F.lit("ESLint disabled"))),
        )

    return _until(_by_line(content, notes), MOST_GOTCHAS)


def trait_impls(content: Column) -> Column:
    """``Trait for Type`` of each implementation block, without type parameters."""
    pick = lambda k: F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(TRAIT_IMPL), F.lit(k))
    return F.zip_with(pick(1), pick(2), lambda a, b: F.concat(a, F.lit(" for "), b))


def purpose(content: Column, path: Column) -> Column:
    """A description tag in the first 500 characters, else the first line comment of more than ten bytes, else the file's name.

    The comment must be the first line that is not empty and no interpreter line, among the first ten.
    """
    text = F.coalesce(content, F.lit(""))
    told = F.trim(F.regexp_extract(F.substring(text, 1, 500), r"@description([^\r\n]*)", 1))
    first = F.get(F.filter(F.transform(F.slice(_lines(text), 1, 10), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: (s != "") & ~s.startswith("#!")), F.lit(0))
    comment = F.when(first.startswith("//"), F.regexp_replace(first, r"^/+\s*", ""))
    name = F.element_at(F.split(path, "/"), -1)
    return F.coalesce(F.nullif(told, F.lit("")), F.when(F.octet_length(comment) > 10, comment), F.when(name.rlike(r"^.+\."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name))


def heuristics(files: DataFrame) -> DataFrame:
    """``files(path, content, ...)`` -> all columns but content, and (purpose, responsibilities, patterns, rules, gotchas, security, trait_impls).

    Null content counts as empty; files of one path each give a row; an empty table gives none.
    """
    content, path = F.col("content"), F.col("path")
    kept = [c for c in files.columns if c != "content"]
    return literals_in(files).select(
        *kept, purpose(content, path).alias("purpose"), responsibilities(content).alias("responsibilities"), _named(PATTERNS).alias("patterns"),
        business_rules(content).alias("rules"), gotchas(content).alias("gotchas"), _named(SECURITY).alias("security"), trait_impls(content).alias("trait_impls"),
    )
