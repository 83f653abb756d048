"""What the types of a program say about its calls: closures of type relations, declared field types, methods of traits.

Calls are resolved by what they ask for, (file, callee) or (container, field, callee), each once; a name that many types share never multiplies its calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import written

#: fixed values: confidence of a resolution by its tier
FIELD_TYPE, TRAIT_METHOD, SUFFIX = 0.85, 0.70, 0.55


def closure(links: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """``links(source, target)`` -> every (source, target) that one or more steps join; cycles end by themselves.

    Semi-naive: a round extends only the pairs that the last one added and takes off what is known. Each round's pairs are written, so
    plans stay small and no round runs twice. It stops when a round adds nothing, or after ``most_rounds``.
    """
    steps = written(links.select("source", "target").where("source is not null and target is not null").distinct())
    known, front, rounds = steps, steps, 0
    hop = steps.select(F.col("source").alias("target"), F.col("target").alias("further"))
    while most_rounds is None or rounds < most_rounds:
        found = front.join(hop, "target").select("source", F.col("further").alias("target")).distinct()
        front = written(found.join(known, ["source", "target"], "left_anti"))
        if front.isEmpty():
            break
        known, rounds = known.union(front), rounds + 1
    return known


def field_types(fields: DataFrame, containers: DataFrame) -> DataFrame:
    """``fields(container, name, signature)``, ``containers(name)`` -> (container, field, type) where the declaration names one known type.

    The type is what follows the first colon; its words are matched with the containers, wrappers and all. A field declared twice in its container, or
    one whose declaration names no or several known types, gives no row.
    """
    declared = fields.groupBy("container", F.col("name").alias("field")).agg(F.count("*").alias("n"), F.min("signature").alias("signature")).where("n = 1")
    after = F.when(F.col("signature").contains(":"), F.regexp_replace("signature", r"(?s)^[^:]*:", ""))
    words = declared.select("container", "field", F.explode(F.array_distinct(F.split(after, r"[^\p{L}\p{N}_]+"))).alias("type"))
    named = words.join(containers.select(F.col("name").alias("type")).distinct(), "type", "left_semi")
    return named.groupBy("container", "field").agg(F.min("type").alias("type"), F.max("type").alias("most")).where("type = most").drop("most")


def _members(symbols: DataFrame) -> DataFrame:
    return symbols.where("container is not null").select(F.col("id").alias("target"), F.col("name").alias("callee"), F.col("container").alias("owner"))


def field_calls(calls: DataFrame, fields: DataFrame, symbols: DataFrame, containers: DataFrame) -> DataFrame:
    """``calls(call_id, container, qualifier, callee)`` on a field of the enclosing type -> (call_id, target, resolution, confidence).

    The qualifier is ``self.field`` or ``this.field``, one level deep; the field's declared type must have one member of the callee's name.
    """
    field = F.regexp_extract("qualifier", r"^(?:self|this)\.([^.]+)$", 1)
    asked = calls.select("call_id", "container", field.alias("field"), "callee").where("field <> ''")
    members = _members(symbols).groupBy("owner", "callee").agg(F.min("target").alias("target"), F.max("target").alias("most")).where("target = most")
    typed = field_types(fields, containers)
    once = asked.select("container", "field", "callee").distinct().join(typed, ["container", "field"]).withColumnRenamed("type", "owner").join(members, ["owner", "callee"])
    found = asked.join(once.select("container", "field", "callee", "target"), ["container", "field", "callee"])
    return found.select("call_id", "target", F.lit("field_type").alias("resolution"), F.lit(FIELD_TYPE).alias("confidence"))


def trait_calls(calls: DataFrame, symbols: DataFrame, visible: DataFrame, traits: DataFrame, implements: DataFrame, common: tuple[str, ...] = ()) -> DataFrame:
    """``calls(call_id, file_path, callee)`` on a receiver of unknown type -> (call_id, target, resolution, confidence).

    Candidates are members of the callee's name in types that the file can name (``visible(file_path, owner)``). One alone is meant
    (``suffix``). Of several, one that a trait declares is meant if the types of all others implement it (``implements(source, target)``, a closure if
    indirect ones count): they are that method (``trait_method``). ``common`` names are never guessed.
    """
    asked = calls.where(~F.col("callee").isin(*common)) if common else calls
    pairs = asked.select("file_path", "callee").distinct()
    candidates = visible.select("file_path", "owner").distinct().join(_members(symbols), "owner").join(pairs, ["file_path", "callee"], "left_semi")
    marked = candidates.join(traits.select(F.col("name").alias("owner"), F.lit(True).alias("declares")).distinct(), "owner", "left")
    keys = ["file_path", "callee"]
    counted = marked.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count("declares").alias("declared"), F.min("target").alias("single"),
        F.min(F.when(F.col("declares"), F.col("target"))).alias("method"), F.min(F.when(F.col("declares"), F.col("owner"))).alias("trait"),
    )
    open_ = counted.where("n > 1 and declared = 1")
    others = marked.join(open_.select(*keys, "trait"), keys).where("owner <> trait")
    strangers = others.join(implements.select(F.col("source").alias("owner"), F.col("target").alias("trait")), ["owner", "trait"], "left_anti").select(*keys).distinct()
    collapsed = open_.join(strangers, keys, "left_anti").select(*keys, F.col("method").alias("target"), F.lit("trait_method").alias("resolution"), F.lit(TRAIT_METHOD).alias("confidence"))
    alone = counted.where("n = 1").select(*keys, F.col("single").alias("target"), F.lit("suffix").alias("resolution"), F.lit(SUFFIX).alias("confidence"))
    return asked.select("call_id", *keys).join(alone.union(collapsed), keys).select("call_id", "target", "resolution", "confidence")
