"""Control events: text commands become the current levels and mutes of subscribers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import duration_hours, shift_hours
from tidemark.rules import LEVEL_BAND, MUTE_CAP_HOURS

# The grammar of commands.
_PRICE = r"(-?[\d,]+(?:\.\d+)?)"
_BARE_PRICE = r"([\d,]+(?:\.\d+)?)"


def first_number(argument: Column, pattern: str = _PRICE) -> Column:
    """First number of an argument, blanks and group commas dropped."""
    digits = F.regexp_extract(F.replace(argument, F.lit(" "), F.lit("")), pattern, 1)
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("double")


def level_direction(argument: Column) -> Column:
    text = F.lower(argument)
    return (
        F.when(text.rlike("above|over"), F.lit("above"))
        .when(text.rlike("below|under"), F.lit("below"))
        .otherwise(F.lit("either"))
    )


def level_note(argument: Column) -> Column:
    """What is left of an argument without numbers and direction words."""
    bare = F.regexp_replace(argument, r"[\d,.]+", "")
    words = F.regexp_replace(bare, r"(?i)\b(above|over|below|under)\b", "")
    return F.regexp_replace(words, r"^[\s\-—:]+|[\s\-—:]+$", "")


def parse(events: DataFrame, known: DataFrame) -> DataFrame:
    """Commands of known subscribers with their parsed arguments."""
    verb = F.regexp_extract("text", r"^/(\w+)", 1)
    argument = F.regexp_extract("text", r"^/\w+\s*(.*)$", 1)
    mine = events.join(known.select("subscriber").distinct(), "subscriber", "left_semi")
    # Each argument is read once: generated columns are not worked out again by the
    # filters further on.
    split = mine.select(
        "subscriber", "seq", "ts", F.inline(F.array(F.struct(verb.alias("verb"), argument.alias("argument"))))
    )
    on = lambda *verbs: F.col("verb").isin(*verbs)
    read = F.struct(
        # A dash before the number of an `unset` is no sign.
        F.when(on("set"), first_number(F.col("argument")))
        .when(on("unset"), first_number(F.col("argument"), _BARE_PRICE))
        .alias("number"),
        F.when(on("set"), level_direction(F.col("argument"))).alias("direction"),
        F.when(on("set"), level_note(F.col("argument"))).alias("note"),
        F.when(on("mute"), duration_hours(F.col("argument"))).alias("asked"),
    )
    return split.select("subscriber", "seq", "ts", "verb", F.inline(F.array(read))).select(
        "subscriber",
        "seq",
        "ts",
        "verb",
        F.when(F.col("number").between(*map(F.lit, LEVEL_BAND)), F.col("number")).alias("value"),
        "direction",
        "note",
        F.when(F.col("asked") > 0, F.least("asked", F.lit(MUTE_CAP_HOURS))).alias("hours"),
    )


def current_levels(commands: DataFrame) -> DataFrame:
    """Levels that stand: the first `set` of a value after its last `unset`."""
    named = commands.filter(F.col("verb").isin("set", "unset") & F.col("value").isNotNull())
    dropped = (
        named.filter("verb = 'unset'")
        .groupBy("subscriber", "value")
        .agg(F.max(F.struct("ts", "seq")).alias("_gone"))
    )
    sets = named.filter("verb = 'set'").join(dropped, ["subscriber", "value"], "left")
    live = sets.filter(F.col("_gone").isNull() | (F.struct("ts", "seq") > F.col("_gone")))
    first = F.min_by(F.struct("direction", "note", F.col("ts").alias("added")), F.struct("ts", "seq"))
    return live.groupBy("subscriber", "value").agg(first.alias("l")).select("subscriber", "value", "l.*")


def current_mutes(commands: DataFrame) -> DataFrame:
    """Latest readable mute or unmute per subscriber; unmuted ones have no row."""
    said = commands.filter("verb = 'unmute' OR (verb = 'mute' AND hours IS NOT NULL)")
    latest = said.groupBy("subscriber").agg(
        F.max_by(F.struct("verb", "ts", "hours"), F.struct("ts", "seq")).alias("m")
    )
    return latest.filter("m.verb = 'mute'").select(
        "subscriber",
        F.col("m.ts").alias("from_ts"),
        shift_hours(F.col("m.ts"), F.col("m.hours")).alias("until_ts"),
    )
