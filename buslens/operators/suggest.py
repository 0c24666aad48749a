"""Proposing signals for the stick, actuator and delay analyses by their labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Fixed word lists.
STICK = ["joy", "joystick"]
STICK_X = ["pos_x", "joystick_x", "_x", ".x", " axisx"]
STICK_Y = ["pos_y", "joystick_y", "_y", ".y", " axisy"]
STICK_YAW = ["yaw", "twist", "rz", "rot"]
ACTUATOR = ["act", "actuator", "actual", "realpos", "feedback", "position"]
SIDES = {"left": ["left", "links"], "right": ["right", "rechts"], "front": ["front", "voor"]}
POSITION_WORDS = ["actualpos", "realpos", "position", "feedback", "actuator", "act"]
ACTUATOR_NOISE = ["force", "current", "temperature", "voltage", "status", "state", "error", "heartbeat", "text", "char"]
COMMAND = ["realpos", "cmd", "command", "target", "setpoint", "request", "desired"]
COMMAND_FIRST, COMMAND_SECOND = ["realpos"], ["cmd", "command", "target", "setpoint"]
RESPONSE = ["actualpos", "actual", "feedback", "measured", "position", "encoder", "state"]
RESPONSE_FIRST = ["actualpos", "actual", "feedback"]
DELAY_NOISE = ["force", "current", "temperature", "status", "error", "heartbeat"]
# Removed one after the other, so the order counts.
STRIPPED = [".x", ".y", ".z", "_x", "_y", "_z", "axisx", "axisy", "axisz", "cmd", "command", "target", "setpoint", "request",
            "desired", "realpos", "actual", "actualpos", "feedback", "measured", "position", "encoder", "joy", "joystick", "actuator"]


def has(label: Column, words: list[str]) -> Column:
    low = F.lower(label)
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def actuator_score(label: Column, side: list[str]) -> Column:
    """6 for the side, 5 for a position word, -8 for a word of another quantity."""
    return (F.when(has(label, side), 6).otherwise(0) + F.when(has(label, POSITION_WORDS), 5).otherwise(0)
            - F.when(has(label, ACTUATOR_NOISE), 8).otherwise(0))


def bare_name(label: Column) -> Column:
    return F.trim(reduce(lambda text, word: F.replace(text, F.lit(word), F.lit("")), STRIPPED, F.lower(label)))


def _flag(test: Column) -> Column:
    return F.when(test, 1).otherwise(0)


def suggest_signals(labels: DataFrame, label: str = "label") -> DataFrame:
    """role, label for jx, jy, yaw, left, right, front, command and response.

    labels: one row per signal. Each role takes its best-scoring label; the stick
    and actuator roles fall back to the next label in order if nothing fits.
    """
    c = F.col("label")
    rows = labels.select(F.col(label).alias("label")).distinct()
    stick = has(c, STICK)
    score = {
        "jx": F.when(has(c, STICK_X), _flag(stick) + 1),
        "jy": F.when(has(c, STICK_Y), _flag(stick) + 1),
        "yaw": F.when(has(c, STICK_YAW), _flag(stick) + 1),
    }
    for role, side in SIDES.items():
        points = actuator_score(c, side)
        # A positive score wins outright; then actuator labels of the side, then any label of the side.
        score[role] = (F.when(points > 0, points + 10).when(has(c, ACTUATOR) & has(c, side), 2).when(has(c, side), 1))
    # The best row per role is an aggregate over the label table; rank 0 is the best, ties go by label.
    picks = [F.min(F.when(s.isNotNull(), F.struct((-s).alias("s"), c.alias("label"))))["label"].alias(r) for r, s in score.items()]
    one = rows.agg(*picks)
    # Fallbacks need only the first three labels.
    heads = rows.orderBy("label").limit(3).agg(F.sort_array(F.collect_list("label")).alias("all3"))
    acts = rows.where(has(c, ACTUATOR)).orderBy("label").limit(3).agg(F.sort_array(F.collect_list("label")).alias("act3"))
    pair = suggest_delay(rows)
    joined = one.withColumn("k", F.lit(1))
    for part in (heads, acts, pair):
        joined = joined.join(part.withColumn("k", F.lit(1)), "k")
    a, t = F.col("all3"), F.col("act3")
    jx = F.coalesce("jx", F.get(a, F.lit(0)))
    jy = F.coalesce("jy", F.get(a, F.lit(1)), F.get(a, F.lit(0)))
    left = F.coalesce("left", F.get(t, F.lit(0)), F.get(a, F.lit(0)))
    right = F.coalesce(F.col("right"), F.get(t, F.lit(1)), left)
    roles = {"jx": jx, "jy": jy, "yaw": F.coalesce(F.col("yaw"), F.get(a, F.lit(2)), jy), "left": left, "right": right,
             "front": F.coalesce(F.col("front"), F.get(t, F.lit(2)), right),
             "command": F.coalesce("command", F.get(a, F.lit(0))),
             "response": F.coalesce("response", F.get(a, F.lit(1)), F.get(a, F.lit(0)))}
    table = F.array(*[F.struct(F.lit(r).alias("role"), x.alias("label")) for r, x in roles.items()])
    return joined.select(F.explode(table).alias("p")).select("p.role", "p.label")


def suggest_delay(rows: DataFrame) -> DataFrame:
    """One row: the best command with a response of the same bare name, else the best of each."""
    c = F.col("label")
    quiet = ~has(c, DELAY_NOISE)
    commands = rows.where(has(c, COMMAND) & quiet).select(
        c.alias("command"), F.struct(-_flag(has(c, COMMAND_FIRST)), -_flag(has(c, COMMAND_SECOND)), c).alias("c_rank"), bare_name(c).alias("bare"))
    responses = rows.where(has(c, RESPONSE) & quiet).select(
        c.alias("response"), F.struct(-_flag(has(c, RESPONSE_FIRST)), c).alias("r_rank"), bare_name(c).alias("bare"))
    # One response per bare name is enough: its best.
    best_response = responses.groupBy("bare").agg(F.min_by("response", "r_rank").alias("response"))
    matched = commands.join(best_response, "bare").agg(F.min_by(F.struct("command", "response"), "c_rank").alias("m"))
    alone = commands.agg(F.min_by("command", "c_rank").alias("c0")).withColumn("j", F.lit(1))
    other = responses.agg(F.min("response").alias("r0")).withColumn("j", F.lit(1))
    out = matched.withColumn("j", F.lit(1)).join(alone, "j").join(other, "j")
    return out.select(F.coalesce("m.command", "c0").alias("command"), F.coalesce("m.response", "r0").alias("response"))
