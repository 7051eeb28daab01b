"""The post-event report of every event at once: sections, JSON lines, Markdown lines (SK-3, SK-5).

A report is rows, not one document: an event may have any number of
participants, hints or tasks, so an item is a row ``(event_id, section, place,
key, ...)`` and (section, place, key) is where it stands. Files are written
in that order by range, so that a large event is spread over tasks too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import event as E
from . import extras as XT

# Fixed values of the report: section names and their fields in order, headings, rules in order.
FIELDS = {
    "summary": "title string, status string, participants long, teams long, quests long, tasks long, attempts long, "
               "attempts_by_status string",
    "leaderboard": "rank int, team_id int, team_name string, total_points long, last_scored_at string",
    "teams": "team_id int, team_name string, members long",
    "completion_matrix": "team_id int, team_name string, completed_count long, total_tasks long, completion_pct double",
    "roster": "user_id string, display_name string, role string, team_id int, team_name string, tasks_passed long, "
              "attempts_total long",
    "task_catalog": "task_id long, task_title string, quest_title string, points int",
    "validation_failures": "task_id long, task_title string, status string, attempts long",
    "hint_usage": "team_id int, team_name string, task_title string, hint_id string, penalty int, at_time string",
    "blockers": "task_id long, task_title string, quest_title string, solved_teams long, total_teams long, "
                "failed_attempts long",
    "champions": "rank int, team_id int, team_name string, total_points long",
    "fastest_team": "team_id int, team_name string, first_solves long",
    "recommended_follow_ups": "rule string, line string",
}
RULE_ORDER = ["worst_blocker", "hints", "weak_team", "champions", "no_blockers"]
TOP_BLOCKERS = 10
UNRANKED = 1 << 31
WORST_FIRST = 1 << 40   # solved teams count in steps of this, failed attempts downwards within one
LAST = (1 << 62)        # place of the blank line after a section
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _placed(df: DataFrame, section: str, at: Column, key: Column) -> DataFrame:
    fields = [f.split()[0] for f in FIELDS[section].split(", ")]
    kinds = [f.split()[1] for f in FIELDS[section].split(", ")]
    return df.select("event_id", at.cast("long").alias("place"), key.cast("string").alias("key"),
                     *[F.col(f).cast(k).alias(f) for f, k in zip(fields, kinds, strict=True)])


def sections(g) -> dict[str, DataFrame]:
    """Every section of the report: (event_id, place, key, its fields)."""
    none, zero = F.lit(""), F.lit(0)
    board = g.leaderboard.withColumnRenamed("display_name", "team_name")
    names = E.team_names(g.teams)
    blocks = g.blockers()
    hints = E.hint_usage(g.ledger, g.teams, g.tasks).withColumn(
        "team_name", F.coalesce("team_name", F.col("team_id").cast("string"))).withColumn(
        "at_time", F.date_format("created_at", ISO))
    catalog = g.competitions.select("event_id", "pack_version_id").join(g.tasks, "pack_version_id").join(
        g.quests.select("quest_id", "quest_title"), "quest_id", "left")
    rule = F.array_position(F.array(*[F.lit(r) for r in RULE_ORDER]), F.col("rule"))
    return {
        "summary": _placed(g.summary(), "summary", zero, none),
        "leaderboard": _placed(board.withColumn("last_scored_at", F.date_format("last_scored_at", ISO)), "leaderboard",
                               F.coalesce(F.col("rank").cast("long"), F.lit(UNRANKED)), F.col("team_id")),
        "teams": _placed(XT.team_members(g).withColumnRenamed("display_name", "team_name"), "teams", F.col("team_id"), none),
        "completion_matrix": _placed(g.completion_matrix(), "completion_matrix", F.col("team_id"), none),
        "roster": _placed(g.roster(), "roster", F.col("participant_id"), none),
        "task_catalog": _placed(catalog, "task_catalog", F.col("task_id"), none),
        "validation_failures": _placed(g.failures, "validation_failures", F.col("task_id"), F.col("status")),
        "hint_usage": _placed(hints, "hint_usage", F.unix_micros(F.col("created_at").cast("timestamp")),
                              F.concat_ws(":", "hint_id", F.col("team_id").cast("string"))),
        "blockers": _placed(blocks, "blockers", F.col("solved_teams") * WORST_FIRST - F.col("failed_attempts"),
                            F.col("task_id")),
        "champions": _placed(E.champions(board, 3), "champions", F.col("position"), none),
        "fastest_team": _placed(E.fastest_team(g.first_solves()).join(names, ["event_id", "team_id"], "left"),
                                "fastest_team", zero, none),
        "recommended_follow_ups": _placed(XT.follow_ups(g), "recommended_follow_ups", rule, F.col("line")),
    }


# ----------------------------- JSON -----------------------------------------
def json_lines(parts: dict[str, DataFrame]) -> DataFrame:
    """SK-3: (event_id, section, place, key, doc), ``doc`` one item as a JSON object with all its fields."""
    return reduce(DataFrame.unionByName, [
        df.select("event_id", F.lit(name).alias("section"), "place", "key",
                  F.to_json(F.struct(*df.columns[3:]), {"ignoreNullFields": "false"}).alias("doc"))
        for name, df in parts.items()])


def parse_object(text, schema: str) -> Column:
    """JSON text as a struct; NULL where it is null, broken or not an object."""
    text = F.col(text) if isinstance(text, str) else text
    got = F.from_json(text, f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    fields = [f.split()[0] for f in schema.split(", ")]
    return F.when(F.ltrim(text).startswith("{") & got["_broken"].isNull(), F.struct(*[got[f].alias(f) for f in fields]))


def read_section(lines: DataFrame, section: str) -> DataFrame:
    """The items of one section, back from their JSON; broken ones are left out."""
    doc = parse_object("doc", FIELDS[section])
    return lines.where(F.col("section") == section).select("event_id", "place", "key", doc.alias("d")).where(
        "d is not null").select("event_id", "place", "key", "d.*")


def write_json(parts: dict[str, DataFrame], path: str) -> None:
    """One folder per event, JSON lines in report order."""
    _in_order(json_lines(parts)).select("event_id", F.to_json(F.struct("section", "place", "key", "doc")).alias("value")).write.mode(
        "overwrite").partitionBy("event_id").text(path)


# ----------------------------- Markdown --------------------------------------
def _head(events: DataFrame, section: int, *lines: Column) -> DataFrame:
    """Heading lines before the items (places below zero) and a blank line after them."""
    rows = [F.struct(F.lit(i - len(lines)).cast("long").alias("place"), x.alias("line")) for i, x in enumerate(lines)]
    rows.append(F.struct(F.lit(LAST).alias("place"), F.lit("").alias("line")))
    return events.select("event_id", F.lit(section).alias("section"), F.explode(F.array(*rows)).alias("r")).select(
        "event_id", "section", "r.place", F.lit("").alias("key"), "r.line")


def _row(*cells) -> Column:
    texts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("—")) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *texts), F.lit(" |"))


def _body(df: DataFrame, section: int, line: Column) -> DataFrame:
    return df.select("event_id", F.lit(section).alias("section"), "place", "key", line.alias("line"))


def markdown_lines(parts: dict[str, DataFrame]) -> DataFrame:
    """SK-5: all sections as lines (event_id, section, place, key, line); sections without items have no heading."""
    s, lit, blank = parts["summary"], F.lit, F.lit("")
    text = lambda c: F.col(c).cast("string")
    top = _head(s, 0, F.concat(lit("# Event report — "), F.col("title")), blank,
                F.concat(lit("- **Status:** "), F.col("status")),
                F.concat(lit("- **Teams:** "), text("teams"), lit("  •  **Participants:** "), text("participants")),
                F.concat(lit("- **Quests:** "), text("quests"), lit("  •  **Tasks:** "), text("tasks")),
                F.concat(lit("- **Attempts:** "), text("attempts"), lit(" ("), F.col("attempts_by_status"), lit(")")))
    any_of = {n: parts[n].select("event_id").distinct() for n in ("champions", "blockers")}
    hints = parts["hint_usage"].groupBy("event_id").agg(F.count(lit(1)).alias("n"), F.sum("penalty").alias("p"))
    people = parts["roster"].groupBy("event_id").agg(F.count(lit(1)).alias("n"))
    # TOP_BLOCKERS a event: a top-k report
    worst = E.worst_blockers(parts["blockers"], TOP_BLOCKERS)
    fast = parts["fastest_team"].join(any_of["champions"], "event_id", "left_semi").withColumn("place", lit(LAST - 1))
    return reduce(DataFrame.unionByName, [
        top,
        _head(s, 1, lit("## Leaderboard"), blank, lit("| Rank | Team | Points |"), lit("|---:|---|---:|")),
        _body(parts["leaderboard"], 1, _row("rank", "team_name", "total_points")),
        _head(any_of["champions"], 2, lit("## Champions / high performers"), blank),
        _body(parts["champions"], 2, F.concat(lit("- **#"), F.coalesce(text("rank"), lit("—")), lit(" "), F.col("team_name"),
                                              lit("** — "), text("total_points"), lit(" pts"))),
        _body(fast, 2, F.concat(lit("- **Fastest team:** "), F.col("team_name"), lit(" ("), text("first_solves"),
                                lit(" first solves)"))),
        _head(s, 3, lit("## Quest completion"), blank, lit("| Team | Completed | % |"), lit("|---|---:|---:|")),
        _body(parts["completion_matrix"], 3, _row("team_name", F.concat_ws("/", text("completed_count"), text("total_tasks")),
                                                  F.concat(text("completion_pct"), lit("%")))),
        _head(any_of["blockers"], 4, lit("## Blockers (hardest tasks)"), blank,
              lit("| Task | Quest | Solved | Failed attempts |"), lit("|---|---|---:|---:|")),
        _body(worst, 4, _row("task_title", "quest_title", F.concat_ws("/", text("solved_teams"), text("total_teams")),
                             "failed_attempts")),
        _head(hints, 5, F.concat(lit("## Hint usage ("), text("n"), lit(" reveals, "), text("p"), lit(" pts)")), blank,
              lit("| Team | Task | Penalty |"), lit("|---|---|---:|")),
        _body(parts["hint_usage"], 5, _row("team_name", "task_title", "penalty")),
        _head(people, 6, F.concat(lit("## Participant roster ("), text("n"), lit(")")), blank,
              lit("| Participant | Role | Team | Tasks passed | Attempts |"), lit("|---|---|---|---:|---:|")),
        _body(parts["roster"], 6, _row("display_name", "role", "team_name", "tasks_passed", "attempts_total")),
        _head(s, 7, lit("## Recommended follow-ups"), blank),
        _body(parts["recommended_follow_ups"], 7, F.concat(lit("- "), F.col("line"))),
    ])


def _in_order(lines: DataFrame) -> DataFrame:
    order = ["event_id", "section", "place", "key"]
    return lines.repartitionByRange(*order).sortWithinPartitions(*order)


def write_markdown(lines: DataFrame, path: str) -> None:
    """One folder per event; its files, read by name, are the report's lines in order."""
    _in_order(lines).select("event_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("event_id").text(path)
