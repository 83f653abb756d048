"""Source files as tables: entry points, imports and what they resolve to, patterns across files, DDL landmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: (file names, path, any of these in the head, framework, confidence)
ENTRY_POINTS = (
    (r"^(_app|index)\.[tj]sx?$", r"(^|/)pages/", (), "nextjs", 0.95),
    (r"^(layout|page)\.[tj]sx?$", r"(^|/)app/", (), "nextjs", 0.90),
    (r"^(manage|wsgi|asgi)\.py$", "", (), "django", 0.95),
    (r"^main\.[tj]s$", "", ("nestfactory", "@nestjs/core"), "nestjs", 0.95),
    (r"^(server|app)\.[tj]s$", "", ("express()", "require('express')", 'from "express"'), "express", 0.90),
    (r"^app\.py$", "", ("flask(__name__)", "from flask import"), "flask", 0.90),
    (r"^main\.rs$", "", ("axum::router", "axum::serve", "axum::routing"), "axum", 0.93),
    (r"^main\.rs$", "", ("actix_web::httpserver", "actix_web::web"), "actix", 0.93),
    (r"^main\.go$", "", ("gin.default()", "gin.new("), "gin", 0.93),
    (r"^main\.go$", "", ("echo.new(",), "echo", 0.93),
)
FALLBACKS = (
    (r"^main\.rs$", "rust-binary", 0.70), (r"^lib\.rs$", "rust-library", 0.70),
    (r"^((main|app|server|cli|index)\.ts|main\.py|main\.go)$", "script", 0.55),
)
# fixed values: (pattern, words in a path or purpose, files for full confidence)
SIGNALS = (
    ("authentication-flow", ("guard", "strategy", "jwt", "passport", "session", "auth", "bearer", "token"), 4),
    ("data-access-pattern", ("repository", "typeorm", "prisma", "sequelize", "entity", "model", ".schema."), 4),
    ("error-handling", ("exception", ".filter.", "error-handler", "error.handler", "error-middleware"), 3),
    ("dependency-injection", ("module", "provider", "injectable", "inject", "container", "di."), 3),
    ("middleware-chain", ("middleware", "interceptor", "pipe.", ".use("), 3),
    ("validation-layer", ("validator", "schema", "zod", "joi", "yup", "dto"), 3),
    ("factory-pattern", ("factory", ".create", "newinstance"), 3),
    ("logger-surface", ("logger", "logging", "pino", "winston", "bunyan", "tracing"), 2),
    ("cache-layer", ("cache", "redis", "memcached", "lru"), 2),
    ("queue-worker", ("queue", "worker", "job", "bullmq", "sqs", "kafka"), 2),
    ("event-bus", ("eventbus", "event-bus", "emitter", "pubsub", "pub-sub"), 2),
    ("config-surface", ("config", ".env", "settings"), 3),
)
LEAST_SURE = 0.6


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def entry_points(files: DataFrame) -> DataFrame:
    """``files(path, content)`` -> (path, framework, confidence); a name alone counts only where no framework is found."""
    low = F.lower(F.replace(F.col("path"), F.lit("\\"), F.lit("/")))
    name, head = F.element_at(F.split(low, "/"), -1), F.lower(F.substring(F.coalesce("content", F.lit("")), 1, 8192))
    found = lambda kind, sure: F.struct(F.lit(kind).alias("framework"), F.lit(sure).alias("confidence"))
    hits = [
        F.when(name.rlike(n) & (low.rlike(p) if p else F.lit(True)) & (_any(head, words) if words else F.lit(True)), found(kind, sure))
        for n, p, words, kind, sure in ENTRY_POINTS
    ]
    by_name = F.coalesce(*(F.when(name.rlike(n), found(kind, sure)) for n, kind, sure in FALLBACKS))
    sure = F.array_compact(F.array(*hits))
    every = F.when(F.size(sure) > 0, sure).otherwise(F.array_compact(F.array(by_name)))
    return files.select("path", F.explode(every).alias("hit")).select("path", "hit.*")


def ranked_entry_points(found: DataFrame) -> DataFrame:
    """The surest framework of each path; of equals the first by name."""
    return found.groupBy("path").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "framework")).alias("x")).select("path", "x.framework", (-F.col("x.c")).alias("confidence"))


def cross_file_patterns(files: DataFrame) -> DataFrame:
    """``files(path, purpose)`` -> (pattern, files, confidence) of patterns that two files or more show."""
    path, said = F.lower("path"), F.lower(F.coalesce("purpose", F.lit("")))
    hits = [F.when(_any(path, words) | _any(said, words), F.struct(F.lit(name).alias("pattern"), F.lit(full).alias("full"))) for name, words, full in SIGNALS]
    shown = files.select("path", F.explode(F.array_compact(F.array(*hits))).alias("hit")).select("path", "hit.*").distinct()
    counts = shown.groupBy("pattern", "full").agg(F.count("*").alias("files"))
    rated = counts.select("pattern", "files", F.least(F.col("files") / F.col("full"), F.lit(1.0)).alias("confidence"))
    return rated.where((F.col("files") >= 2) & (F.col("confidence") >= LEAST_SURE))


def joined_path(base: Column, more: Column) -> Column:
    """``more`` below the folder ``base``, with ``.`` and ``..`` folded away."""
    steps = F.filter(F.split(F.concat_ws("/", base, more), "/"), lambda s: ~s.isin("", "."))
    empty = F.array().cast("array<string>")
    folded = F.aggregate(steps, empty, lambda at, s: F.when(s == "..", F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.array_append(at, s)))
    return F.array_join(folded, "/")


def imports(files: DataFrame) -> DataFrame:
    """``files(path, content)`` -> (path, lang, source) once for each module that a file names.

    Scripts' ``from``/``import``/``require``, Python's ``from``/``import``, Rust's ``use`` and Go's import paths.
    """
    ext = F.regexp_extract(F.lower("path"), r"\.([a-z]+)$", 1)
    lang = F.when(ext.isin("ts", "tsx", "js", "jsx", "mjs"), "script").when(ext == "py", "python").when(ext == "rs", "rust").when(ext == "go", "go")
    pick = lambda pattern: F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(pattern), F.lit(1))
    python = F.concat(
        pick(r"(?m)^[ \t]*from[ \t]+([.\w]+)[ \t]+import\b"),
        F.flatten(F.transform(pick(r"(?m)^[ \t]*import[ \t]+([.\w, \t]+?)[ \t]*(?:#.*)?$"), lambda x: F.transform(F.split(x, r"\s*,\s*"), lambda y: F.regexp_replace(F.trim(y), r"\s+as\s+\w+$", "")))),
    )
    named = (
        F.when(lang == "script", pick(r"""(?:\bfrom|\bimport|\brequire\(|\bimport\()\s*['"]([^'"\n]+)['"]"""))
        .when(lang == "python", python)
        .when(lang == "rust", pick(r"(?m)^[ \t]*(?:pub(?:\([a-z]+\))?[ \t]+)?use[ \t]+([A-Za-z_][\w:]*?)(?:::)?(?:[{*;]| as )"))
        .when(lang == "go", F.flatten(F.transform(pick(r"""(?ms)^import[ \t]+(\((?:[^)]*)\)|(?:\w+[ \t]+)?"[^"\n]+")"""), lambda s: F.regexp_extract_all(s, F.lit('"([^"\n]+)"'), F.lit(1)))))
    )
    return files.select("path", lang.alias("lang"), F.explode(F.array_distinct(named)).alias("source")).where("source <> ''")


def resolved_imports(found: DataFrame, paths: DataFrame) -> DataFrame:
    """Imports to files that exist: (path, source, target); the first candidate that ``paths(path)`` lists.

    Candidates are spelled out and joined, so the check for existence is one equi-join. Packages from
    outside and Go paths stay unresolved and give no row.
    """
    folder, s = F.regexp_replace("path", r"/?[^/]+$", ""), F.col("source")
    at = joined_path(folder, s)
    bare = F.regexp_replace(at, r"\.[mc]?jsx?$", "")
    script = F.array(at, *(F.concat(bare, F.lit(x)) for x in (".ts", ".tsx", ".js", ".jsx", ".mjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")))
    dots = F.length(F.regexp_extract(s, r"^(\.*)", 1))
    module = F.replace(F.regexp_replace(s, r"^\.+", ""), F.lit("."), F.lit("/"))
    up = joined_path(folder, F.repeat(F.lit("../"), dots - 1))
    bases = F.when(dots > 0, F.array(up)).otherwise(F.array(F.lit(""), folder))
    python = F.flatten(F.transform(bases, lambda b: F.transform(
        F.array(F.lit(".py"), F.lit("/__init__.py")), lambda x: F.concat(joined_path(b, module), x))))
    python = F.transform(python, lambda p: F.regexp_replace(p, "^/", ""))
    steps = F.split(F.regexp_replace(s, r"^(crate|self|super)(::)?", ""), "::")
    root = F.when(s.startswith("crate"), F.regexp_extract("path", r"^((?:.*/)?src)/", 1)).when(s.startswith("super"), F.when(F.col("path").rlike(r"(^|/)mod\.rs$"), joined_path(folder, F.lit(".."))).otherwise(folder)).otherwise(folder)
    whole = lambda n: F.array_join(F.slice(steps, 1, F.greatest(F.size(steps) - n, F.lit(0))), "/")
    rust = F.flatten(F.array(*(F.array(*(F.concat(joined_path(root, whole(n)), F.lit(x)) for x in (".rs", "/mod.rs"))) for n in (0, 1))))
    candidates = (
        F.when((F.col("lang") == "script") & s.startswith("."), script)
        .when(F.col("lang") == "python", python)
        .when((F.col("lang") == "rust") & s.rlike(r"^(crate|self|super)(::|$)"), rust)
    )
    tried = found.select("path", "source", F.posexplode(candidates).alias("nth", "target"))
    real = tried.join(paths.select(F.col("path").alias("target")).distinct(), "target", "left_semi")
    return real.groupBy("path", "source").agg(F.min_by("target", "nth").alias("target"))


def ddl_landmarks(files: DataFrame) -> DataFrame:
    """``files(path, content)`` -> (path, kind, name, other) of tables, columns' references, alterations and indexes."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce("content", F.lit("")), r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " ")
    word = r"[`\"\[]?([\w.]+)[`\"\]]?"
    of_type = lambda kind, pattern, second: F.transform(
        F.regexp_extract_all("bare", F.lit(pattern), F.lit(0)),
        lambda s: F.struct(F.lit(kind).alias("kind"), F.lower(F.regexp_extract(s, pattern, 1)).alias("name"), F.lower(F.regexp_extract(s, pattern, 2) if second else F.lit(None).cast("string")).alias("other")),
    )
    every = F.concat(
        of_type("table", rf"(?i)create\s+(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?{word}", False),
        of_type("alter", rf"(?i)alter\s+table\s+(?:if\s+exists\s+)?(?:only\s+)?{word}", False),
        of_type("index", rf"(?i)create\s+(?:unique\s+)?index\s+(?:concurrently\s+)?(?:if\s+not\s+exists\s+)?{word}\s+on\s+{word}", True),
        of_type("reference", rf"(?i)references\s+{word}\s*(?:\(\s*{word})?", True),
    )
    return files.select("path", bare.alias("bare")).select("path", F.explode(F.array_distinct(every)).alias("x")).select("path", "x.*")


def migration_number(path: Column) -> Column:
    """The number a migration's file name starts with, or null."""
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^[vV]?([0-9]+)", 1).try_cast("long")
