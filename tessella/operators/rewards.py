"""Dense rewards of step logs, as windows over an episode's steps."""

from __future__ import annotations

import math

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from .metrics import so_far
from .scans import Fold, State


def progress(distance: Column, w: WindowSpec, digits: int | None = None) -> Column:
    """By how much a distance fell since the step before, 0 at the first."""
    gain = F.coalesce(F.lag(distance).over(w) - distance, F.lit(0.0))
    return gain if digits is None else F.round(gain, digits)


def navigation(distance: Column, w: WindowSpec, scale: float, angle: Column | None = None, angle_scale: float = 1.0, turn_within: float = 0.0) -> Column:
    """Progress towards a goal; within `turn_within` of it, that of the angle since the last step so near as well."""
    out = scale * progress(distance, w)
    if angle is None:
        return out
    close = distance < turn_within
    last = F.last(F.when(close, angle), ignorenulls=True).over(w.rowsBetween(-(1 << 31), -1))
    return out + F.when(close, angle_scale * F.coalesce(last - angle, F.lit(0.0))).otherwise(0.0)


def reach(distance: Column, w: WindowSpec, scale: float = 1.0, diff: bool = True) -> Column:
    """Progress towards a resting place (not scaled), or minus the scaled distance."""
    return progress(distance, w) if diff else -scale * distance


def picking(to_object: Column, to_rest: Column, held: Column, target: Column, w: WindowSpec, pick: float, wrong: float, drop: float, scale: float) -> Column:
    """Reward of picking an object up: `held` is the object in the gripper or null, `target` that which is wanted.

    The distance that counts is that to the object, once something is held that to the resting place.  It counts as progress in
    thousandths, none at the step at which the target is gripped and at the step after a wrong grip or a drop."""
    has = held.isNotNull()
    had = F.coalesce(F.lag(has).over(w), F.lit(False))
    gripped = has & ~had
    right, bad, dropped = gripped & (held == target), gripped & (held != target), ~has & had
    distance = F.when(has, to_rest).otherwise(to_object)
    # a flag of the step before, from lags alone: windows can't be nested
    before = F.coalesce(F.lag(has, 2).over(w), F.lit(False))
    bad_before = had & ~before & (F.lag(held).over(w) != F.lag(target).over(w))
    dropped_before = ~had & before
    stale = right | F.coalesce(bad_before, F.lit(False)) | dropped_before
    past = F.when(had, F.lag(to_rest).over(w)).otherwise(F.lag(to_object).over(w))
    moved = F.when(stale, 0.0).otherwise(F.round(F.coalesce(past - distance, F.lit(0.0)), 3))
    return F.when(bad, -wrong).otherwise(F.when(right, pick).otherwise(0.0) + scale * moved - F.when(dropped, drop).otherwise(0.0))


def placing(to_goal: Column, to_rest: Column, has: Column, at_goal: Column, w: WindowSpec, place: float, drop: float, scale: float, least: float = 0.0) -> Column:
    """Reward of putting an object down: once for the first step without it, at the goal or not, and progress in thousandths.

    The distance that counts is the object's to its goal, from when it lies there that of the gripper to its resting place; below
    `least` the former doesn't count."""
    away = ~at_goal | has
    distance = F.when(away, to_goal).otherwise(to_rest)
    first = ~has & (F.sum((~has).cast("int")).over(so_far(w)) == 1)
    right = first & at_goal
    away_before = ~F.lag(at_goal).over(w) | F.lag(has).over(w)
    past = F.when(away_before, F.lag(to_goal).over(w)).otherwise(F.lag(to_rest).over(w))
    moved = F.when(right, 0.0).otherwise(F.round(F.coalesce(past - distance, F.lit(0.0)), 3))
    counts = distance >= F.when(away, least).otherwise(0.0)
    return F.when(right, place).when(first, -drop).otherwise(0.0) + F.when(counts, scale * moved).otherwise(0.0)


def articulated(goal: float, state: float, grasp: float, wrong: float, there: float, rest: float, marker: float) -> Fold:
    """Reward of moving a joint to `goal`, over the steps of an episode; values (joint, holds, right, to_marker, to_rest, arrived).

    `state` for each unit that the joint comes nearer while it hasn't arrived; once, at the first grip of something, `grasp` if it is the right
    handle and minus `wrong` if not; `there` at the first step at which it has arrived, and `rest` for each unit that the gripper then
    comes nearer to its resting place; else, with nothing held, `marker` for each unit nearer to the handle.  What is held at the first step
    counts as gripped before."""

    def step(kept: State, row: tuple) -> tuple[State, tuple]:
        joint, holds, right, to_marker, to_rest, arrived = row
        was, gripped, from_marker, from_rest, done = (joint, holds, to_marker, to_rest, 0.0) if math.isnan(kept[0]) else kept
        reward = 0.0 if arrived else state * (abs(was - goal) - abs(joint - goal))
        if holds and not gripped:
            reward += grasp if right else -wrong
        if arrived:
            reward += (0.0 if done else there) + rest * (from_rest - to_rest)
        elif not holds:
            reward += marker * (from_marker - to_marker)
        return (joint, max(gripped, holds), to_marker, to_rest, max(done, arrived)), (reward,)

    return Fold((math.nan, 0.0, 0.0, 0.0, 0.0), step, "reward double")


def moving(targets: int, distance: float, pick: float, place: float, near: float) -> Fold:
    """Reward of bringing objects to their goals one after the other; values (held: the number of the object in the gripper or -1, then the
    distance of each object to its goal, then that of the gripper to each object).

    The object of the stage counts alone: `distance` for each unit that it comes nearer to its goal while held, else that the gripper comes nearer to
    it; `pick` once for each object; `place` when it lies within `near` of its goal, which begins the next stage, after the last the first again."""

    def step(kept: State, row: tuple) -> tuple[State, tuple]:
        held, to_goal, to_object = row[0], row[1 : 1 + targets], row[1 + targets :]
        fresh, now = math.isnan(kept[1]), int(kept[0])
        from_goal, from_object = (to_goal[now], to_object[now]) if fresh else kept[1:3]
        holding, given = held == now, int(kept[4])
        reward = distance * (from_goal - to_goal[now] if holding else from_object - to_object[now])
        if holding and not kept[3] and not given >> now & 1:
            reward, given = reward + pick, given | 1 << now
        if to_goal[now] < near and not holding:
            reward, now = reward + place, (now + 1) % targets
        return (float(now), to_goal[now], to_object[now], float(holding), float(given)), (reward,)

    return Fold((0.0, math.nan, 0.0, 0.0, 0.0), step, "reward double")
