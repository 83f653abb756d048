"""Which files an inventory lists: ignore files scoped to their folders, default rules, hidden names, binary kinds and sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: names and endings that are never listed, hidden names that are, kinds of binary files, and the largest file
IGNORED_NAMES = (
    "node_modules", ".git", "dist", "build", "target", ".next", ".nuxt", ".turbo", "__pycache__", ".venv", "venv", ".env", ".DS_Store", "coverage", ".cache", "tmp", ".tmp",
    "package-lock.json", "pnpm-lock.yaml", "bun.lock", "yarn.lock", "Cargo.lock",
)
IGNORED_ENDINGS = (".min.js", ".min.css", ".map", ".lock")
SHOWN = (".env.example", ".scoutignore")
BINARY = (
    "png", "jpg", "jpeg", "gif", "ico", "svg", "webp", "bmp", "tiff", "mp3", "mp4", "wav", "avi", "mov", "mkv", "zip", "tar", "gz", "bz2", "xz", "7z", "rar", "pdf", "doc", "docx",
    "xls", "xlsx", "ppt", "pptx", "exe", "dll", "so", "dylib", "o", "a", "wasm", "node", "woff", "woff2", "ttf", "eot", "otf",
)
MOST_BYTES = 1_048_576
#: ignore files in the order in which their rules apply
IGNORE_FILES = (".scoutignore", ".gitignore")


def _folder(parts: Column, depth: Column) -> Column:
    return F.array_join(F.slice(parts, F.lit(1), depth), "/")


def ignore_rules(files: DataFrame, names: tuple[str, ...] = IGNORE_FILES) -> DataFrame:
    """``files(path, content)`` -> (folder, rules): the rules of each folder's ignore files in order, ``array<struct<pattern, keep>>``.

    Empty lines and notes (``#``) are skipped, ``!`` takes a rule back, slashes at the ends of a pattern are dropped. A folder's rules are as
    many as its ignore files hold.
    """
    parts = F.split("path", "/")
    rank = F.array_position(F.array(*(F.lit(n) for n in names)), F.element_at(parts, -1))
    lines = F.filter(F.transform(F.split(F.coalesce("content", F.lit("")), r"\r?\n"), lambda s: F.trim(s)), lambda s: (s != "") & ~s.startswith("#"))
    rule = F.transform(lines, lambda s: F.struct(F.regexp_replace(s, r"^!?/*|/+$", "").alias("pattern"), s.startswith("!").alias("keep")))
    found = files.select(_folder(parts, F.size(parts) - 1).alias("folder"), rank.alias("rank"), F.filter(rule, lambda r: r.pattern != "").alias("rule")).where("rank > 0")
    listed = found.groupBy("folder").agg(F.array_sort(F.collect_list(F.struct("rank", "rule"))).alias("x"))
    return listed.select("folder", F.flatten("x.rule").alias("rules"))


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ``path`` of what the rules ignore: a path goes with any folder above it.

    A rule holds for names in its folder and below: equal to the pattern, ending as it does after ``*``, or at that very place if it has slashes. Of the rules of
    one folder the last that matches decides, of several folders the deepest. What is above a path is decided once for all paths below it.
    """
    parts = F.split("path", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: _folder(parts, k))
    below = paths.select("path").distinct().select("path", F.explode(steps).alias("node"))
    nodes = below.select("node").distinct()
    own = F.split("node", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(own) - 1), lambda k: F.struct(k.alias("depth"), _folder(own, k).alias("folder")))
    asked = nodes.select("node", F.element_at(own, -1).alias("name"), F.explode(above).alias("x")).select("node", "name", "x.*")
    place = F.when(F.col("folder") == "", F.col("node")).otherwise(F.expr("substring(node, length(folder) + 2)"))
    name = F.col("name")
    meets = lambda r: F.when(r.pattern.startswith("*"), name.endswith(F.substring(r.pattern, 2, 1 << 20))).when(r.pattern.contains("/"), place == r.pattern).otherwise(name == r.pattern)
    judged = asked.join(rules, "folder").select("node", "depth", F.try_element_at(F.filter("rules", meets), F.lit(-1)).alias("rule")).where("rule is not null")
    gone = judged.groupBy("node").agg(F.max_by("rule.keep", "depth").alias("keep")).where("not keep")
    return below.join(gone.select("node"), "node", "left_semi").select("path").distinct()


def listed(files: DataFrame, rules: DataFrame | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Rows of ``files(path, size, ...)`` that an inventory lists, with ``ext``; paths are relative, folders parted by ``/``.

    Files without a path go. The default rules can't be taken back.
    """
    parts = F.split("path", "/")
    ext = F.regexp_extract(F.element_at(parts, -1), r"[^.]\.([^.]*)$", 1)
    plain = F.forall(parts, lambda p: ~p.isin(*IGNORED_NAMES) & ~p.rlike("(" + "|".join(x.replace(".", r"\.") for x in IGNORED_ENDINGS) + ")$") & (~p.startswith(".") | p.isin(*SHOWN)))
    kept = files.where(F.col("path").isNotNull() & (F.col("size") <= most_bytes) & plain).withColumn("ext", ext).where(~F.col("ext").isin(*BINARY))
    return kept if rules is None else kept.join(ignored(kept, rules), "path", "left_anti")
