"""Column names, pitch and player settings."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import types as T

BALL = "ball"
FOOTBALL = "football"
FRAME = ["game_id", "period_id", "frame_id"]
OBJECT = ["game_id", "id", "period_id"]

#: Fixed names: the columns of a row of tracking data.
TRACKING = T.StructType(
    [T.StructField("game_id", T.StringType()), T.StructField("period_id", T.IntegerType()), T.StructField("frame_id", T.LongType()), T.StructField("t_ms", T.LongType()), T.StructField("ball_state", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in ("id", "team_id", "position_name")]
    + [T.StructField(c, T.DoubleType()) for c in ("x", "y", "z", "vx", "vy", "vz", "v", "ax", "ay", "az", "a")]
    + [T.StructField("ball_owning_team_id", T.StringType()), T.StructField("is_ball_carrier", T.BooleanType())]
)


@dataclass(frozen=True)
class Settings:
    """A metric soccer pitch with its origin at the centre, and the limits of motion. The defaults are fixed values."""

    length: float = 105.0
    width: float = 68.0
    max_player_speed: float = 12.0
    max_ball_speed: float = 28.0
    max_player_acceleration: float = 6.0
    max_ball_acceleration: float = 13.5
    ball_carrier_threshold: float = 25.0
    home_team_id: str = "home"
    ball_id: str = BALL
    orientation: str = "ball_owning"
    defending_team_node_value: float = 0.1
    non_potential_receiver_node_value: float = 0.1

    def __post_init__(self):
        if not isinstance(self.ball_carrier_threshold, float):
            raise TypeError("ball_carrier_threshold must be a float")
        if self.orientation not in ("ball_owning", "home_away", "static_home_away"):
            raise ValueError(f"orientation {self.orientation!r} is not set or not known")

    @property
    def x_max(self) -> float:
        return self.length / 2

    @property
    def y_max(self) -> float:
        return self.width / 2

    @property
    def diagonal(self) -> float:
        return math.hypot(self.length, self.width)


@dataclass(frozen=True)
class FootballSettings(Settings):
    """An American football field in yards. The defaults are fixed values."""

    length: float = 120.0
    width: float = 53.3
    ball_id: str = FOOTBALL
    min_height: float = 150.0
    max_height: float = 225.0
    min_weight: float = 60.0
    max_weight: float = 200.0
    attacking_non_qb_node_value: float = 0.1

    @property
    def end_zone(self) -> float:
        return self.x_max - 10
