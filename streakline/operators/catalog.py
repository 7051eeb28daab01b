"""Pack catalog versions: content digest, import decision, manifest counts (UP-13, AG-30, AG-31).

The digest of a pack version is the SHA-256 of its canonical JSON: keys in
alphabetical order, no blanks, no nulls. The document is nested (pack, quests,
tasks, validators and hints), and a level stands in its parent as the digest of
its children, so a catalog of any size is hashed by grouped aggregations and is
never gathered into one document. A list's digest is taken over its children's
hashes with the number of times each occurs, sorted; children carry their place
in the list among their fields. Hashes meet in buckets by their first digits
first, so no group holds all children of a large parent, and equal rows count
as often as they occur.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_DIGITS = 3


def canonical_json(*names: str) -> Column:
    """The named columns as one JSON object with sorted keys; null fields are left out."""
    return F.to_json(F.struct(*[F.col(n) for n in sorted(names)]))


def list_digest(children: DataFrame, keys: list[str], json: str, name: str) -> DataFrame:
    """(keys, <name>, n_<name>): digest and number of each parent's children, in any row order."""
    one = children.select(*keys, F.sha2(F.col(json), 256).alias("_h")).groupBy(*keys, "_h").agg(
        F.count(F.lit(1)).alias("_n"))

    def joined(*parts) -> Column:
        return F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", *parts))), ",")

    some = one.groupBy(*keys, F.substring("_h", 1, BUCKET_DIGITS).alias("_b")).agg(
        F.sha2(joined("_h", F.col("_n").cast("string")), 256).alias("_d"), F.sum("_n").alias("_n"))
    return some.groupBy(*keys).agg(F.sha2(joined("_b", "_d"), 256).alias(name), F.sum("_n").alias(f"n_{name}"))


def _fields(df: DataFrame, *without: str) -> list[str]:
    return [c for c in df.columns if c not in without]


def version_digest(quests: DataFrame, tasks: DataFrame, validators: DataFrame, hints: DataFrame) -> DataFrame:
    """(pack_version_id, content_hash, quests, tasks, validators, hints).

    ``quests`` and ``tasks`` carry pack_version_id; validators and hints belong
    to a task. Every other column is content.
    """
    v = list_digest(validators.withColumn("_j", canonical_json(*_fields(validators, "task_id"))), ["task_id"], "_j",
                    "validators")
    h = list_digest(hints.withColumn("_j", canonical_json(*_fields(hints, "task_id"))), ["task_id"], "_j", "hints")
    t = tasks.join(v, "task_id", "left").join(h, "task_id", "left")
    own = _fields(tasks, "pack_version_id", "quest_id")
    t = t.withColumn("_j", canonical_json(*own, "validators", "hints"))
    sums = t.groupBy("pack_version_id").agg(F.coalesce(F.sum("n_validators"), F.lit(0)).alias("validators"),
                                            F.coalesce(F.sum("n_hints"), F.lit(0)).alias("hints"))
    of_quest = list_digest(t, ["pack_version_id", "quest_id"], "_j", "tasks")
    q = quests.join(of_quest, ["pack_version_id", "quest_id"], "left")
    q = q.withColumn("_j", canonical_json(*_fields(quests, "pack_version_id"), "tasks"))
    pack = list_digest(q, ["pack_version_id"], "_j", "quests")
    n_tasks = q.groupBy("pack_version_id").agg(F.coalesce(F.sum("n_tasks"), F.lit(0)).alias("tasks"))
    j = reduce(lambda a, b: a.join(b, "pack_version_id", "left"), [n_tasks, sums], pack)
    return j.select("pack_version_id", F.sha2(canonical_json("quests"), 256).alias("content_hash"),
                    F.col("n_quests").alias("quests"),
                    *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ["tasks", "validators", "hints"]])


def import_decision(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """UP-13: what becomes of each incoming (pack_id, version, content_hash).

    duplicate: the pack has this version with this content, nothing is written;
    conflict: it has the version with other content (versions never change);
    new_version: the pack is known, the version is not; new_pack: otherwise.
    """
    packs = existing.select("pack_id").distinct().withColumn("_known", F.lit(True))
    versions = existing.select("pack_id", "version", F.col("content_hash").alias("_old"))
    j = incoming.distinct().join(packs, "pack_id", "left").join(versions, ["pack_id", "version"], "left")
    status = (F.when(F.col("_old") == F.col("content_hash"), F.lit("duplicate"))
              .when(F.col("_old").isNotNull(), F.lit("conflict"))
              .when(F.col("_known"), F.lit("new_version")).otherwise(F.lit("new_pack")))
    return j.select("pack_id", "version", "content_hash", status.alias("status"))


def apply_import(existing: DataFrame, decisions: DataFrame) -> DataFrame:
    """Stored versions after an import: those that are new are added."""
    new = decisions.filter(F.col("status").isin("new_version", "new_pack")).select("pack_id", "version", "content_hash")
    return existing.select("pack_id", "version", "content_hash").unionByName(new)
