"""Column expressions for field geometry. All stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from routeforge.constants import FIELD_LENGTH, FIELD_WIDTH


def flip_when(condition: Column, value: Column, extent: float) -> Column:
    """Mirror a coordinate on an axis of the given extent where the condition holds."""
    return F.when(condition, F.lit(extent) - value).otherwise(value)


def negate_when(condition: Column, value: Column) -> Column:
    return F.when(condition, -value).otherwise(value)


def half_turn(angle: Column) -> Column:
    return F.pmod(angle - F.lit(180.0), F.lit(360.0))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    return F.sqrt(dx * dx + dy * dy)


def compass_angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees clockwise from the +y axis, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(x2 - x1, y2 - y1)) + F.lit(360.0), F.lit(360.0))


def sideline_distance(y: Column) -> Column:
    """Yards to the nearer sideline, taken from |y|.

    At exactly the far sideline the formula gives the field width, not zero; that is
    part of the feature's definition.
    """
    half = F.lit(FIELD_WIDTH / 2)
    size = F.abs(y)
    return F.abs(half * F.floor(size / half) - F.pmod(size, half))


def hold_on_field(value: Column, extent: float) -> Column:
    """Past the far edge: just inside it. Below zero: zero. The edge itself stays."""
    return (
        F.when(value > extent, F.lit(extent - 0.01)).when(value < 0, F.lit(0.0)).otherwise(value)
    )


def from_line(x: Column, yard_line: Column) -> Column:
    return F.abs(x - yard_line)


def zone_edges(start: Column, low: Column, high: Column, extent: float) -> tuple[Column, Column]:
    """Absolute edges of a zone; one that starts off the field is centred on the boundary."""
    half = (high - low) / 2
    near = start + low
    lower = F.when(near > extent, F.lit(extent) - half).when(near < 0, -half).otherwise(near)
    upper = (
        F.when(near > extent, F.lit(extent) + half).when(near < 0, half).otherwise(start + high)
    )
    return lower, upper


def first_down_line(yard_line: Column, to_go: Column, direction: Column) -> Column:
    return (
        F.when(direction == "right", yard_line + to_go)
        .when(direction == "left", yard_line - to_go)
        .otherwise(F.raise_error(F.lit("playDirection must be left or right")).cast("int"))
    )


def mid_route_point(
    x1: Column, y1: Column, x2: Column, y2: Column, kind: Column
) -> tuple[Column, Column]:
    """Bend of a designed route between its start and its zone centre.

    The fallback of the 45 degree kind scales the sign of the sideways move by the
    first candidate x, as the contract of the designed routes has it.
    """
    side = F.signum(y1 - y2)
    gap = F.abs(y1 - y2)
    forward = x1 <= x2
    bend = F.when(forward, x2 - gap).otherwise(x2 + gap)
    overshoots = F.when(forward, bend < x1).otherwise(bend > x1)
    fallback_y = F.when(forward, y2 - bend * side).otherwise(y2 + bend * side)
    bad = F.raise_error(F.lit("route type must be straight, 45angle or 90angle")).cast("double")
    xi = (
        F.when(kind == "straight", (x1 + x2) / 2)
        .when(kind == "90angle", x2)
        .when(kind == "45angle", F.when(overshoots, x2).otherwise(bend))
        .otherwise(bad)
    )
    yi = (
        F.when(kind == "straight", (y1 + y2) / 2)
        .when(kind == "90angle", y1)
        .when(kind == "45angle", F.when(overshoots, fallback_y).otherwise(y1))
        .otherwise(bad)
    )
    return xi, yi


def mirrored_x(x: Column, direction: Column) -> Column:
    return flip_when(direction == "left", x, FIELD_LENGTH)


def mirrored_y(y: Column, direction: Column) -> Column:
    return flip_when(direction == "left", y, FIELD_WIDTH)
