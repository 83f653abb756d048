"""What tool payloads say: semi-structured JSON routed by tool, one row for each rule that fires, and rejected rows apart.

A payload is an object with ``tool_name``, ``tool_input``, ``tool_response`` and ``session_id``. It is parsed once into a
variant; fields of another type than asked for count as absent. Everything but the sequential saving rule is one projection.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import shortened

LEAST_CONFIDENCE = 0.70
MOST_SAVED, LEAST_SECONDS = 20, 30

# fixed values: tools by route, and what marks a configuration file, a read of the environment and a kind of command
EDITS, WRITES, SHELLS = ("Edit", "MultiEdit"), ("Write", "Create"), ("Bash",)
CONFIG_NAMES = (".env.example", "tsconfig.json", "tailwind.config.js", "vite.config.ts", "next.config.js", "next.config.mjs")
CONFIG_ENDINGS = (".toml", ".yaml", ".yml")
ENVIRONMENT = ("env::var", "process.env", "os.environ", "os.getenv")
VARIABLE_AFTER = ('env::var("', "env::var('", "process.env.", 'process.env["', 'os.environ["', 'os.getenv("')
TEST_COMMANDS = ("cargo test", "npm test", "npx jest", "npx vitest", "pytest", "go test", "mix test")
BUILD_COMMANDS = ("cargo build", "cargo check", "npm run build", "npx tsc", "go build", "make ")
LINT_COMMANDS = ("clippy", "eslint", "ruff", "pylint", "golangci-lint", "rustfmt")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the text holds one of the words, by one pass."""
    return text.rlike("|".join(re.escape(w) for w in words))


def _of_type(v: Column, path: str, kind: str, cast: str) -> Column:
    held = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(held) == kind, F.try_variant_get(v, path, cast))


def _text(v: Column, path: str) -> Column:
    return F.coalesce(_of_type(v, path, "STRING", "string"), F.lit(""))


def parsed(rows: DataFrame, payload_col: str = "payload") -> DataFrame:
    """``rows`` with ``tool``, ``session``, ``body`` (variant) and ``fault``: null, or why the payload is rejected.

    A payload is rejected if it is null or no JSON object, if its tool name is no string, or its session is neither string nor null.
    """
    body = F.try_parse_json(F.col(payload_col))
    kind = lambda path: F.schema_of_variant(F.try_variant_get("body", path, "variant"))
    session = kind("$.session_id")
    fault = (
        F.when(F.col("body").isNull() | ~F.schema_of_variant("body").startswith("OBJECT"), "no object")
        .when(F.coalesce(kind("$.tool_name"), F.lit("")) != "STRING", "no tool name")
        .when(session.isNotNull() & ~session.isin("STRING", "VOID"), "session is no text")
    )
    held = rows.withColumn("body", body).withColumn("fault", fault)
    return held.withColumn("tool", F.when(F.col("fault").isNull(), _of_type(F.col("body"), "$.tool_name", "STRING", "string"))).withColumn(
        "session", F.when(F.col("fault").isNull(), _of_type(F.col("body"), "$.session_id", "STRING", "string"))
    )


def is_config_file(path: Column) -> Column:
    """Whether a path in lower case names a configuration file; lock files are none."""
    name = F.element_at(F.split(path, "/"), -1)
    plain = "|".join(re.escape(n) for n in CONFIG_NAMES)
    ends = "|".join(re.escape(e) for e in CONFIG_ENDINGS)
    return ~name.contains("lock") & name.rlike(rf"({ends})$|\.config\.|^({plain})$")


def variable_read(code: Column) -> Column:
    """The name after the first way of reading the environment, in the order of the list, that has a name; null if none."""
    named = (F.regexp_extract(code, f"{re.escape(p)}([\\p{{L}}\\p{{N}}_]*)", 1) for p in VARIABLE_AFTER)
    return F.coalesce(*(F.when(n != "", n) for n in named))


def failing_test(output: Column) -> Column:
    """The last line of the output that names a failed test, without its marks; null if none does."""
    told = lambda s: (
        F.when(s.endswith("FAILED") & s.startswith("test "), F.regexp_replace(F.regexp_replace(s, "^(test )+", ""), "( \\.\\.\\. FAILED)+$", ""))
        .when(s.startswith("FAIL "), F.regexp_replace(s, "^(FAIL )+", ""))
        .when(s.startswith("FAILED "), F.regexp_replace(s, "^(FAILED )+", ""))
    )
    named = F.array_compact(F.transform(F.split(output, "\r?\n"), lambda s: told(F.regexp_replace(s, r"^\s+|\s+$", ""))))
    return F.try_element_at(named, F.lit(-1))


def insights(rows: DataFrame, payload_col: str = "payload", own_prefix: str = "mcp__store__", least: float = LEAST_CONFIDENCE) -> DataFrame:
    """``rows`` without the payload, and (rule, title, content, type, tags, topic_key, confidence): a row for each rule that fires.

    Calls of the store's own tools (``own_prefix``) and other tools say nothing; rejected payloads give no rows here. Fields are read once,
    rules that fire are listed by name and exploded, and only then are the texts of a rule made.
    """
    body, kept = F.col("body"), [c for c in rows.columns if c != payload_col]
    taken = parsed(rows, payload_col).where(F.col("fault").isNull() & F.col("tool").isin(*EDITS, *WRITES, *SHELLS) & ~F.col("tool").startswith(own_prefix))
    exit_code = _of_type(body, "$.tool_response.exitCode", "BIGINT", "bigint")
    fields = taken.select(
        *kept, "session", "tool", _text(body, "$.tool_input.file_path").alias("path"), _text(body, "$.tool_input.old_string").alias("old"), _text(body, "$.tool_input.new_string").alias("new"),
        _text(body, "$.tool_input.command").alias("command"), F.coalesce(exit_code != 0, F.lit(False)).alias("failed"),
        F.coalesce(F.nullif(_text(body, "$.tool_response.stderr"), F.lit("")), _text(body, "$.tool_response.stdout")).alias("output"),
    )
    path, old, new, command, output, tool = (F.col(c) for c in ("path", "old", "new", "command", "output", "tool"))
    low, low_command = F.lower(path), F.lower(command)
    name = F.element_at(F.split(low, "/"), -1)
    edit = tool.isin(*EDITS) & (path != "") & (old != "") & (new != "")
    # fixed values: what the path of a new file says, first match wins
    written = F.when(tool.isin(*WRITES) & (path != ""), (
        F.when(name.startswith("dockerfile") | (name == "containerfile"), "Dockerfile created")
        .when(low.contains(".github/workflows/") | name.isin(".gitlab-ci.yml", ".gitlab-ci.yaml"), "CI configuration created")
        .when((low.contains("migration") | low.contains("migrate")) & low.rlike(r"\.(sql|rs|py)$"), "Database migration created")
        .when(is_config_file(low), "new config")
    ))
    ran = F.when(tool.isin(*SHELLS) & F.col("failed") & (command != ""), (
        F.when(_any(low_command, TEST_COMMANDS), "test failure").when(_any(low_command, BUILD_COMMANDS), "build error").when(_any(low_command, LINT_COMMANDS), "lint")
    ))
    fired = F.array_compact(F.array(
        F.when(edit & is_config_file(low), "config change"), F.when(edit & ~_any(old, ENVIRONMENT) & _any(new, ENVIRONMENT), "env var"), written, ran,
    ))
    rule, file = F.col("rule"), F.element_at(F.split(path, "/"), -1)
    of = lambda r, c: F.when(rule == r, c)
    hints = fields.withColumn("rule", F.explode(fired)).withColumns({
        "stem": F.when(file.rlike(r"^.+\."), F.regexp_replace(file, r"\.[^.]*$", "")).otherwise(file), "file": file,
        "named": of("env var", F.coalesce(variable_read(new), F.lit("unknown"))).otherwise(of("test failure", F.coalesce(failing_test(output), F.lit("unknown")))),
        "hash": F.substring(F.md5(F.encode(output, "utf-8")), 1, 6),
    })
    stem, named, digest = F.col("stem"), F.col("named"), F.col("hash")
    lit, quoted = F.lit, lambda c, n: F.concat(F.lit("```\n"), shortened(c, n), F.lit("\n```"))
    usage = F.coalesce(F.trim(F.get(F.filter(F.split(new, "\r?\n"), lambda s: s.contains(named)), F.lit(0))), F.lit(""))
    new_file = rule.endswith(" created")
    # fixed values: texts, kinds, tags, topics and confidence of each rule
    title = (
        of("config change", F.concat(lit("Config change: "), stem)).when(rule == "env var", F.concat(lit("New env var: "), named, lit(" in "), stem))
        .when(new_file, F.concat(rule, lit(": "), path)).when(rule == "new config", F.concat(lit("New config: "), F.col("file")))
        .when(rule == "test failure", F.concat(lit("Test failure: "), shortened(named, 60)))
        .when(rule == "build error", F.concat(lit("Build error: "), shortened(command, 60))).otherwise(F.concat(lit("Lint violations: "), shortened(command, 60)))
    )
    content = (
        of("config change", F.concat(lit("Configuration updated in `"), path, lit("`.\n\n**Changed:**\n"), quoted(old, 200), lit("\n→\n"), quoted(new, 200)))
        .when(rule == "env var", F.concat(lit("Environment variable `"), named, lit("` is read in `"), path, lit("`.\n\n"), quoted(usage, 200)))
        .when(new_file, F.concat(rule, lit(" at `"), path, lit("`."))).when(rule == "new config", F.concat(lit("Configuration file created at `"), path, lit("`.")))
        .when(rule == "test failure", F.concat(lit("Test command failed: `"), shortened(command, 100), lit("`\n\n**Failing test:** "), named, lit("\n\n**Output (truncated):**\n"), quoted(output, 500)))
        .when(rule == "build error", F.concat(lit("Build failed: `"), shortened(command, 100), lit("`\n\n**Error (truncated):**\n"), quoted(output, 500)))
        .otherwise(F.concat(lit("Linter found issues: `"), shortened(command, 100), lit("`\n\n**Output (truncated):**\n"), quoted(output, 500)))
    )
    kind = F.when(new_file, "architecture").when(rule == "test failure", "bug").when(rule == "build error", "auto-change").when(rule == "lint", "tech-debt").otherwise("decision")
    tag = F.when(new_file, "architecture").when(rule.isin("config change", "new config"), "config").when(rule == "env var", "env-var").when(rule == "test failure", "test-failure").when(rule == "build error", "build-error").otherwise("lint")
    tags = F.array_compact(F.array(lit("auto-extract"), tag, F.when(~tool.isin(*SHELLS), path)))
    topic = (
        of("config change", F.concat(lit("config:"), stem)).when(rule == "env var", F.concat(lit("env:"), named)).when(new_file | (rule == "new config"), F.concat(lit("newfile:"), path))
        .when(rule == "test failure", F.concat(lit("testfail:"), digest)).when(rule == "build error", F.concat(lit("builderr:"), digest)).otherwise(F.concat(lit("lint:"), digest))
    )
    sure = F.when(rule.startswith("Dockerfile"), 0.90).when(rule.startswith("CI "), 0.85).when(rule.startswith("Database"), 0.80).when(rule == "test failure", 0.75).otherwise(0.70)
    told = hints.select(
        *kept, "session", F.when(new_file, "new file").otherwise(rule).alias("rule"), title.alias("title"), content.alias("content"), kind.alias("type"),
        tags.alias("tags"), topic.alias("topic_key"), sure.alias("confidence"),
    )
    return told.where(F.col("confidence") >= least)


def rejected(rows: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Payloads that can't be read, with the reason."""
    return parsed(rows, payload_col).where("fault is not null").select(*rows.columns, "fault")


def _saved(n_columns: int, most: int, gap: float):
    """Sorted batches whose last columns are (session, time, payload, topic) -> the rows that are saved; carries one session's state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, payload, last, used, seen, open_, fresh = object(), None, None, 0, set(), False, set()
        for batch in batches:
            keep = []
            for s, t, p, topic in zip(*(batch.column(n_columns + k).to_pylist() for k in range(4)), strict=True):
                if s != session:
                    session, payload, last, used, seen, fresh = s, None, None, 0, set(), set()
                if p != payload:
                    seen |= fresh
                    payload, open_, fresh = p, used < most and (last is None or t - last >= gap), set()
                ok = open_ and used < most and topic not in seen
                if ok:
                    last, used = t, used + 1
                    fresh.add(topic)
                keep.append(ok)
            yield pa.RecordBatch.from_arrays(batch.columns[:n_columns], names=batch.schema.names[:n_columns]).filter(pa.array(keep, pa.bool_()))

    return run


def saved_insights(found: DataFrame, time_col: str, id_col: str, most: int = MOST_SAVED, least_seconds: float = LEAST_SECONDS) -> DataFrame:
    """Insights that a session saves: ``most`` at all, each topic once, a payload ``least_seconds`` after the last saving one.

    Each decision depends on the one before, so a session's rows pass in time order through one task, which holds ``most`` topics and nothing else of it.
    """
    order = [F.coalesce("session", F.lit("")).alias("__s"), F.unix_micros(F.col(time_col).cast("timestamp")).alias("__t"), F.col(id_col).alias("__p"), F.col("topic_key").alias("__k")]
    dealt = found.select("*", *order).repartition("__s").sortWithinPartitions("__s", "__t", "__p", F.desc("rule"), "__k")
    return dealt.mapInArrow(_saved(len(found.columns), most, least_seconds * 1e6), found.schema)
