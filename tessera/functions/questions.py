"""Classifying questions and grading their answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import STOPWORDS

# fixed values: the kinds in the order in which they are tried, their confidence, and the parts of
# which one must occur (a tuple asks for all of its parts)
KINDS = (
    ("architecture", 0.90, ("architecture", "structure", "organized")),
    ("entry-points", 0.92, ("entry point", "main entry", "starts from")),
    ("differentiation", 0.88, ("different from", ("what makes", "different"))),
    ("bug-history", 0.80, ("bug", ("issue", "fix"), ("problem", "fix"))),
    ("decision", 0.85, ("why did", "decision", "chose", "rationale")),
    ("auth", 0.88, ("auth", "login", "jwt", ("session", "token"))),
    ("flow", 0.82, ("how does", "how do", "flow", "process")),
    ("pattern", 0.80, ("pattern", "convention", "approach")),
    ("tech-debt", 0.85, ("tech debt", "todo", "technical debt", "refactor")),
    ("dependency", 0.78, ("depend", "package", "library", "framework")),
    ("data", 0.80, ("database", "schema", "table", "model")),
    ("module", 0.75, ("module", "component", "service")),
    ("file", 0.72, ("file", ".ts", ".rs", ".py", ".go")),
    ("implementation", 0.70, ("implement", "how is", "where is")),
    ("onboarding", 0.85, ("onboard", "new developer", "getting started", "overview")),
    ("status", 0.75, ("status", "progress", "recent")),
    ("rule", 0.78, ("rule", "policy", "constraint")),
)


def _any(q: Column, parts: tuple[str | tuple[str, ...], ...]) -> Column:
    both = [reduce(Column.__and__, (q.contains(x) for x in ((part,) if isinstance(part, str) else part))) for part in parts]
    return reduce(Column.__or__, both)


def classify(question: Column) -> Column:
    """struct(kind, confidence): the first kind that fits, else general at one half."""
    q = F.lower(F.coalesce(question, F.lit("")))
    kind, sure = F, F
    for name, c, parts in KINDS:
        hit = _any(q, parts)
        kind, sure = kind.when(hit, name), sure.when(hit, c)
    return F.struct(kind.otherwise("general").alias("kind"), sure.otherwise(0.5).alias("confidence"))


def subject_of(question: Column) -> Column:
    """What follows the first of a few prepositions, up to a mark; null if empty or of 100 bytes or more."""
    found = [
        F.trim(F.regexp_extract(F.lower(question), rf"(?s)^.*?{p} ([^?.,\n]*)", 1)) for p in ("about", "regarding", "for the", "of the", "in the")
    ]
    return F.coalesce(*(F.when((x != "") & (F.octet_length(x) < 100), x) for x in found))


def answer_confidence(n_primary: Column, overlap: Column, alignment: Column, recency: Column, answer_bytes: Column) -> Column:
    """Between 0.40 (nothing found) and 0.97."""
    raw = (
        0.30 * (1 - F.exp(-n_primary / 3.0)) + 0.30 * overlap + 0.20 * alignment + 0.15 * recency
        + 0.05 * F.when(answer_bytes < 20, 0.6).otherwise(1.0)
    )
    return F.when(n_primary == 0, 0.40).otherwise(F.least(F.lit(0.97), F.greatest(F.lit(0.40), 0.40 + raw * 0.57)))


def grade(answered: Column, confidence: Column, cited: Column, expected: Column, hits: Column, keywords: Column, answer_bytes: Column) -> Column:
    """Points of 100: answered, confidence, citations, keywords, length; capped where keywords are missing."""
    cite = F.when(expected > 0, F.least(cited / expected, F.lit(1.0))).otherwise(1.0)
    rate = hits / keywords
    points = (
        F.when(answered, 30).otherwise(0) + F.floor(confidence * 25 + 0.5) + F.floor(cite * 25 + 0.5) + F.floor(rate * 10 + 0.5)
        + F.when(answer_bytes >= 100, 10).when(answer_bytes >= 20, 5).otherwise(0)
    )
    capped = F.when(hits == 0, F.least(points, F.lit(54))).when(rate < 0.5, F.least(points, F.lit(69))).otherwise(points)
    return F.least(F.lit(100), F.greatest(F.lit(0), capped)).cast("int")


def letter(score: Column) -> Column:
    return F.when(score >= 85, "A").when(score >= 70, "B").when(score >= 55, "C").when(score >= 40, "D").otherwise("F")


def question_terms(question: Column) -> Column:
    """Words of a question longer than two bytes without stop words, marks at their ends removed."""
    bare = F.transform(F.split(F.lower(F.coalesce(question, F.lit(""))), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.filter(bare, lambda w: (F.octet_length(w) > 2) & ~w.isin(*STOPWORDS))
