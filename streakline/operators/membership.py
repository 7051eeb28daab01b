"""Team memberships: bulk import of participants with one team an event (UP-10, JO-16) and look-ups (TK-6).

An import row names a participant by user id or e-mail and may name a team. Teams
and participants are inserted if absent (the first row of a participant
describes it); a participant whose rows name a team leaves every other team of
the event (a keyed delete through a semi-join with the event's teams) and joins
the one of its last row. Teams of other events are left alone. All tables change
together (:func:`run_import`), so a partial import never shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..versions import VersionedTables
from .keys import first_per_key, insert_absent

IMPORT_COLUMNS = ["user_id", "email", "display_name", "team_name"]
COUNTS = ["rows", "participants_created", "teams_created", "assignments", "removed"]


class ImportRefused(ValueError):
    """No row of the import names anybody."""


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def usable_rows(rows: DataFrame) -> DataFrame:
    """(event_id, line, user_id, email, display_name, team_name) of the rows that name somebody, trimmed."""
    user, email = _text(rows, "user_id"), _text(rows, "email")
    uid = F.trim(F.when(user != "", user).otherwise(email))
    mail = F.trim(F.when(email != "", email).otherwise(uid))
    shown = F.trim(_text(rows, "display_name"))
    r = rows.select("event_id", "line", uid.alias("user_id"), mail.alias("email"),
                    F.when(shown != "", shown).otherwise(F.split(uid, "@")[0]).alias("display_name"),
                    F.trim(_text(rows, "team_name")).alias("team_name"))
    return r.filter((F.col("user_id") != "") & F.col("event_id").isNotNull())


def _new_id(prefix: str, *parts: Column) -> Column:
    key = F.to_json(F.array(*[p.cast("string") for p in parts]))
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(key, 256), 1, 16))


def import_participants(rows: DataFrame, teams: DataFrame, participants: DataFrame, members: DataFrame,
                        joined_at: Column) -> dict[str, DataFrame]:
    """Tables after an import: ``teams``, ``participants``, ``members`` and ``counts`` (per event).

    ``teams``: team_id, event_id, name, display_name; ``participants``:
    participant_id, event_id, user_id, display_name, email; ``members``:
    team_id, participant_id, joined_at. A membership that the import confirms
    keeps its ``joined_at``. ``removed`` counts memberships that went.
    """
    r = usable_rows(rows)
    named = r.filter(F.col("team_name") != "")

    new_teams = insert_absent(teams, named.select("event_id", F.col("team_name").alias("name")).distinct(),
                              ["event_id", "name"]).select(
        _new_id("team", F.col("event_id"), F.col("name")).alias("team_id"), "event_id", "name",
        F.col("name").alias("display_name"))
    teams_after = teams.select("team_id", "event_id", "name", "display_name").unionByName(new_teams)

    first = first_per_key(r.select("event_id", "user_id", "line", "display_name", "email"), ["event_id", "user_id"],
                          ["line"])
    new_people = insert_absent(participants, first, ["event_id", "user_id"]).select(
        _new_id("part", F.col("event_id"), F.col("user_id")).alias("participant_id"), "event_id", "user_id",
        "display_name", "email")
    people_after = participants.select("participant_id", "event_id", "user_id", "display_name", "email") \
        .unionByName(new_people)

    # of each participant the team of the last row; settled: no row names another one
    target = named.groupBy("event_id", "user_id").agg(
        F.max_by("team_name", F.struct("line", "team_name")).alias("name"),
        (F.min("team_name") == F.max("team_name")).alias("settled"))
    target = (target.join(teams_after.select("event_id", "name", "team_id"), ["event_id", "name"])
              .join(people_after.select("event_id", "user_id", "participant_id"), ["event_id", "user_id"])
              .select("event_id", "participant_id", F.col("team_id").alias("to_team"), "settled"))
    held = members.join(teams_after.select("team_id", "event_id"), "team_id", "left").join(
        target, ["event_id", "participant_id"], "left")
    stays = F.col("to_team").isNull() | ((F.col("team_id") == F.col("to_team")) & F.col("settled"))
    kept = held.filter(stays).select("team_id", "participant_id", "joined_at")
    joined = insert_absent(kept, target.select(F.col("to_team").alias("team_id"), "participant_id"),
                           ["team_id", "participant_id"]).select("team_id", "participant_id",
                                                                 joined_at.alias("joined_at"))

    def per_event(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("event_id").agg(F.count(F.lit(1)).alias(name))

    gone = held.filter(F.col("to_team").isNotNull() & (F.col("team_id") != F.col("to_team")))
    counts = r.groupBy("event_id").agg(F.count(F.lit(1)).alias("rows"),
                                       F.count_if(F.col("team_name") != "").alias("assignments"))
    for df, name in ((new_people, "participants_created"), (new_teams, "teams_created"), (gone, "removed")):
        counts = counts.join(per_event(df, name), "event_id", "left")
    counts = counts.select("event_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS])
    return {"teams": teams_after, "participants": people_after, "members": kept.unionByName(joined), "counts": counts}


def run_import(store: VersionedTables, rows: DataFrame, joined_at: Column) -> DataFrame:
    """Import ``rows`` into the current version of ``store`` as one change; returns the counts per event."""
    if usable_rows(rows).isEmpty():
        raise ImportRefused("no usable participant rows: each needs a user id or an e-mail")
    tables = [store.read(t) for t in ("teams", "participants", "members")]
    return store.read("counts", store.commit(import_participants(rows, *tables, joined_at)))


def set_team(members: DataFrame, teams: DataFrame, moves: DataFrame, joined_at: Column) -> DataFrame:
    """Memberships after ``moves`` (event_id, participant_id, team_id): one team an event for each moved participant."""
    m = moves.join(teams.select("event_id", "team_id"), ["event_id", "team_id"], "left_semi")
    of_event = members.join(teams.select("team_id", "event_id"), "team_id")
    leaves = of_event.join(m.select("event_id", "participant_id", F.col("team_id").alias("to_team")),
                           ["event_id", "participant_id"]).filter(F.col("team_id") != F.col("to_team"))
    kept = members.join(leaves.select("team_id", "participant_id"), ["team_id", "participant_id"], "left_anti")
    return kept.unionByName(insert_absent(kept, m.select("team_id", "participant_id").distinct(),
                                          ["team_id", "participant_id"]).withColumn("joined_at", joined_at))


def user_team(members: DataFrame, teams: DataFrame, participants: DataFrame) -> DataFrame:
    """TK-6 / JO-11: of each (event, user) the team of the earliest membership (team id breaks ties)."""
    j = members.join(participants.select("participant_id", "event_id", "user_id"), "participant_id").join(
        teams.select("team_id", F.col("display_name").alias("team_name")), "team_id")
    return first_per_key(j.select("event_id", "user_id", "joined_at", "team_id", "team_name"),
                         ["event_id", "user_id"], ["joined_at", "team_id"])
