"""Registered queries of pack versions: digests and import decisions, with DuckDB oracles.

In the stand-in every region is a pack whose tasks are the region's suppliers.
Four packs are stored as version 1.0; all five come in again: unchanged, changed
under the same version, unchanged and changed under a new version, and unknown.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..sources import standin_sql as Q
from ..sources import standins as S
from ..sources.tables import Tables
from .registry import register

# pack (region): version that comes in, points added to each task; the last pack is not stored yet
INCOMING = {0: ("1.0", 0), 1: ("1.0", 1), 2: ("1.1", 0), 3: ("1.1", 1), 4: ("1.0", 0)}
UNKNOWN = 4


def _digest_sql(name: str, child: str, keys: str, json: str, out: str) -> list[str]:
    b = C.BUCKET_DIGITS
    return [f"{name}_h AS (SELECT {keys}, sha256({json}) AS h, count(*) AS n FROM {child} GROUP BY ALL)",
            f"""{name}_b AS (SELECT {keys}, left(h, {b}) AS b, sum(n) AS n,
         sha256(string_agg(h || ':' || n, ',' ORDER BY h || ':' || n)) AS d FROM {name}_h GROUP BY ALL)""",
            f"""{name} AS (SELECT {keys}, sha256(string_agg(b || ':' || d, ',' ORDER BY b || ':' || d)) AS {out},
         sum(n) AS n_{out} FROM {name}_b GROUP BY ALL)"""]


def _str(field: str, col: str) -> str:
    return f"""'"{field}":"' || {col} || '"'"""


def _version_sql(prefix: str, added: str, packs: str) -> list[str]:
    """CTEs that end in ``<prefix>versions`` (pack_version_id, content_hash, quests, tasks, validators, hints)."""
    task_json = (f"""'{{' || coalesce('"hints":"' || h.hints || '",', '') || '"points":' || (t.points + {added}) || ',"task_id":' """
                 f"""|| t.task_id || ',' || {_str('task_slug', 't.task_slug')} || ',"task_sort":' || t.task_sort """
                 f"""|| coalesce(',"validators":"' || v.validators || '"', '') || '}}'""")
    quest_json = (f"""'{{"has_unlock_rule":' || CASE WHEN q.has_unlock_rule THEN 'true' ELSE 'false' END || ',"quest_id":' """
                  f"""|| q.quest_id || ',' || {_str('quest_slug', 'q.quest_slug')} || coalesce(',"tasks":"' || o.tasks || '"', '') """
                  f"""|| coalesce(',"unlock_quest_slug":"' || q.unlock_quest_slug || '"', '') || '}}'""")
    return [
        f"""{prefix}t AS (SELECT t.quest_id AS pack_version_id, t.quest_id, {task_json} AS j, v.n_validators, h.n_hints
  FROM tasks t LEFT JOIN vd v USING (task_id) LEFT JOIN hd h USING (task_id) WHERE t.quest_id IN ({packs}))""",
        *_digest_sql(f"{prefix}o", f"{prefix}t", "pack_version_id, quest_id", "j", "tasks"),
        f"""{prefix}q AS (SELECT q.quest_id AS pack_version_id, {quest_json} AS j, o.n_tasks
  FROM catalog_quests q LEFT JOIN {prefix}o o ON o.quest_id = q.quest_id WHERE q.quest_id IN ({packs}))""",
        *_digest_sql(f"{prefix}p", f"{prefix}q", "pack_version_id", "j", "quests"),
        f"""{prefix}versions AS (SELECT p.pack_version_id, sha256('{{"quests":"' || p.quests || '"}}') AS content_hash,
         CAST(p.n_quests AS BIGINT) AS quests,
         CAST((SELECT coalesce(sum(n_tasks), 0) FROM {prefix}q x WHERE x.pack_version_id = p.pack_version_id) AS BIGINT) AS tasks,
         CAST((SELECT coalesce(sum(n_validators), 0) FROM {prefix}t x WHERE x.pack_version_id = p.pack_version_id) AS BIGINT)
           AS validators,
         CAST((SELECT coalesce(sum(n_hints), 0) FROM {prefix}t x WHERE x.pack_version_id = p.pack_version_id) AS BIGINT) AS hints
  FROM {prefix}p p)"""]


_VALIDATOR = (f"""'{{' || {_str('mode', 'mode')} || ',' || {_str('operator', 'operator')} || ',' || """
              f"""{_str('statement', 'statement')} || ',' || {_str('type', 'type')} || ',"validator_id":' || validator_id || '}}'""")
_HINT = """'{"hint_id":' || hint_id || ',"penalty_points":' || penalty_points || '}'"""
_ADDED = "CASE t.quest_id " + " ".join(f"WHEN {p} THEN {a}" for p, (_, a) in INCOMING.items()) + " END"
_ALL = ", ".join(map(str, INCOMING))
_STORED = ", ".join(str(p) for p in INCOMING if p != UNKNOWN)
_BASE = [Q.TASKS, Q.CATALOG_QUESTS, Q.CATALOG_VALIDATORS, Q.CATALOG_HINTS,
         *_digest_sql("vd", "catalog_validators", "task_id", _VALIDATOR, "validators"),
         *_digest_sql("hd", "catalog_hints", "task_id", _HINT, "hints")]


def _digests(t: Tables, packs: list[int], added=None):
    """Digests of the packs of some regions, with ``added`` points on each task of a pack."""
    tasks = S.tasks(t).filter(F.col("quest_id").isin(*packs)).select(
        F.col("quest_id").alias("pack_version_id"), "quest_id", "task_id", "task_slug", "task_sort",
        (F.col("points") + (added if added is not None else F.lit(0))).alias("points"))
    quests = S.catalog_quests(t).filter(F.col("quest_id").isin(*packs)).withColumn("pack_version_id", F.col("quest_id"))
    return C.version_digest(quests, tasks, S.catalog_validators(t), S.catalog_hints(t))


@register("pack_version_digest", "WITH " + ",\n".join([*_BASE, *_version_sql("s_", "0", _ALL)])
          + "\nSELECT * FROM s_versions")
def q_pack_digest(spark, sf_dir):
    """UP-13 / AG-30 / AG-31: content digest and counts of each pack version."""
    return _digests(Tables(spark, sf_dir), list(INCOMING))


_VERSION = "CASE pack_version_id " + " ".join(f"WHEN {p} THEN '{v}'" for p, (v, _) in INCOMING.items()) + " END"


@register("pack_import_decisions", "WITH " + ",\n".join(
    [*_BASE, *_version_sql("s_", "0", _STORED), *_version_sql("i_", _ADDED, _ALL),
     f"inc AS (SELECT CAST(pack_version_id AS VARCHAR) AS pack_id, {_VERSION} AS version, content_hash FROM i_versions)",
     "old AS (SELECT CAST(pack_version_id AS VARCHAR) AS pack_id, '1.0' AS version, content_hash FROM s_versions)"]) + """
SELECT i.*, CASE WHEN o.content_hash = i.content_hash THEN 'duplicate' WHEN o.content_hash IS NOT NULL THEN 'conflict'
                 WHEN EXISTS (SELECT 1 FROM old p WHERE p.pack_id = i.pack_id) THEN 'new_version' ELSE 'new_pack' END AS status
FROM inc i LEFT JOIN old o ON o.pack_id = i.pack_id AND o.version = i.version""")
def q_pack_import(spark, sf_dir):
    """UP-13: every pack comes in again; same, changed, new and unknown versions."""
    t = Tables(spark, sf_dir)

    def by_pack(values: dict):
        return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("quest_id"))

    def named(df, version):
        return df.select(F.col("pack_version_id").cast("string").alias("pack_id"), version.alias("version"), "content_hash")

    stored = named(_digests(t, [p for p in INCOMING if p != UNKNOWN]), F.lit("1.0"))
    coming = _digests(t, list(INCOMING), by_pack({p: a for p, (_, a) in INCOMING.items()}))
    versions = F.element_at(F.create_map(*[F.lit(x) for p, (v, _) in INCOMING.items() for x in (p, v)]),
                            F.col("pack_version_id"))
    return C.import_decision(named(coming, versions), stored)
