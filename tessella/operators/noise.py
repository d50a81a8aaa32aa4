"""Noise of sensors and of motions, by registered name; every number is drawn by counter, so reruns agree."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import normal, poisson, truncated, uniform
from .registry import Registry

models = Registry()

# Mean and variance of what is added to the way ahead, the way aside and the turn (radians), when moving and when turning.
MOTION = {
    ("LoCoBot", "ILQR"): {"linear": ((0.014, 0.006), (0.009, 0.005), (0.008, 0.004)), "rotational": ((0.003, 0.002), (0.003, 0.003), (0.023, 0.012))},
    ("LoCoBot", "Proportional"): {"linear": ((0.017, 0.007), (0.042, 0.023), (0.031, 0.026)), "rotational": ((0.001, 0.001), (0.005, 0.004), (0.043, 0.017))},
    ("LoCoBot", "Movebase"): {"linear": ((0.074, 0.019), (0.036, 0.033), (0.189, 0.038)), "rotational": ((0.002, 0.0), (0.003, 0.002), (0.219, 0.019))},
    ("LoCoBot-Lite", "ILQR"): {"linear": ((0.142, 0.008), (0.023, 0.008), (0.031, 0.028)), "rotational": ((0.002, 0.001), (0.002, 0.002), (0.122, 0.03))},
    ("LoCoBot-Lite", "Proportional"): {"linear": ((0.135, 0.007), (0.043, 0.009), (0.049, 0.009)), "rotational": ((0.002, 0.002), (0.002, 0.001), (0.054, 0.061))},
    ("LoCoBot-Lite", "Movebase"): {"linear": ((0.192, 0.055), (0.117, 0.144), (0.128, 0.143)), "rotational": ((0.002, 0.001), (0.001, 0.001), (0.173, 0.025))},
}
#: Deviates are never farther from the mean than so many deviations, and a motion always keeps a part of its amount.
WIDEST, LEAST_PART = 3.0, 0.95


def _byte(share: Column) -> Column:
    """0 to 255 from a share of full brightness, rounded down."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * 255).cast("int")


@models.register("noise")
def gaussian(image: Column, key: Column, shape: tuple[int, ...], seed: str = "gaussian", intensity: float = 0.2, mean: float = 0.0, sigma: float = 1.0) -> Column:
    """Adds to each pixel's share of 255 a normal deviate times the intensity."""
    return F.transform(image, lambda v, i: _byte(v / F.lit(255.0) + (normal(seed, key, i) * sigma + mean) * intensity))


@models.register("noise")
def speckle(image: Column, key: Column, shape: tuple[int, ...], seed: str = "speckle", intensity: float = 0.2, mean: float = 0.0, sigma: float = 1.0) -> Column:
    """Adds to each pixel a deviate in proportion to it; the sum is taken as a share of full brightness, so what is above 1 is full."""
    return F.transform(image, lambda v, i: _byte(v + v * (normal(seed, key, i) * sigma + mean) * intensity))


@models.register("noise", "poisson")
def shot(image: Column, key: Column, shape: tuple[int, ...], seed: str = "poisson") -> Column:
    """Counts of as many levels as the image has values, up to the next power of two."""
    levels = F.pow(F.lit(2.0), F.ceil(F.log2(F.size(F.array_distinct(image)).cast("double"))))
    own = F.transform(F.array(levels), lambda n: F.transform(image, lambda v, i: _byte(poisson(v / F.lit(255.0) * n, uniform(seed, key, i)) / n)))
    return F.get(own, F.lit(0))


@models.register("noise")
def salt_and_pepper(image: Column, key: Column, shape: tuple[int, ...], seed: str = "salt", amount: float = 0.05, salt: float = 0.5) -> Column:
    """Draws places, one number an axis short of its last index, and sets salt to 1 and then pepper to 0."""
    size = math.prod(shape)

    def places(kind: str, share: float) -> Column:
        at = lambda j: sum((F.floor(uniform(seed, kind, key, j, d) * (n - 1)).cast("int") * math.prod(shape[d + 1 :]) for d, n in enumerate(shape)), F.lit(0))
        n = math.ceil(amount * size * share)
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at) if n else F.array().cast("array<int>")

    both = F.struct(places("salt", salt).alias("s"), places("pepper", 1 - salt).alias("p"))
    own = F.transform(F.array(both), lambda b: F.transform(image, lambda v, i: F.when(F.array_contains(b["p"], i), 0).when(F.array_contains(b["s"], i), 1).otherwise(v.cast("int"))))
    return F.get(own, F.lit(0))


@models.register("noise", "none")
def still(image: Column, key: Column, shape: tuple[int, ...], seed: str = "") -> Column:
    return image


def noisy(df: DataFrame, model: str, image: str, key: str, shape: tuple[int, ...], out: str, **config: object) -> DataFrame:
    """Adds `out`: the image (an array of bytes in the order of `shape`) under a registered model.  A null image stays null."""
    f = models.get("noise", model)
    return df.withColumn(out, F.when(F.col(image).isNotNull(), f(F.col(image), F.col(key), shape, **config)))


def moved(df: DataFrame, key: str, move: str, amount: str, robot: str = "LoCoBot", controller: str = "ILQR", multiplier: float = 1.0, seed: str = "motion") -> DataFrame:
    """Adds ahead, aside, turn (radians): what a robot does that is told to `move` ('forward', 'backward': amount; 'left', 'right': degrees).

    Deviates lie within WIDEST deviations; that along the motion never takes away more than LEAST_PART of its amount, and goes
    the motion's way.  Other moves give null."""
    if (robot, controller) not in MOTION:
        raise KeyError(f"no robot {robot} with a controller {controller}")
    model = MOTION[robot, controller]
    sign = F.when(F.col(move).isin("backward", "right"), -1.0).otherwise(1.0)
    linear, turning = F.col(move).isin("forward", "backward"), F.col(move).isin("left", "right")
    size = F.col(amount).cast("double")

    def deviate(kind: str, part: int, floor: Column | None) -> Column:
        mean, variance = model[kind][part]
        if not variance:
            return F.lit(mean * multiplier)
        deviation = math.sqrt(variance)
        low = F.greatest(F.lit(-WIDEST), (-LEAST_PART * F.abs(floor) - mean) / deviation) if floor is not None else F.lit(-WIDEST)
        return truncated(F.lit(mean), F.lit(deviation), low, F.lit(WIDEST), seed, kind, part, F.col(key)) * multiplier

    forward = F.when(linear, sign * (F.abs(size) + deviate("linear", 0, size))).when(turning, deviate("rotational", 0, None))
    aside = F.when(linear, sign * deviate("linear", 1, None)).when(turning, deviate("rotational", 1, None))
    radians = F.radians(size)
    turn = F.when(linear, deviate("linear", 2, None)).when(turning, sign * (F.abs(radians) + deviate("rotational", 2, radians)))
    return df.withColumns({"ahead": forward, "aside": aside, "turn": turn})
