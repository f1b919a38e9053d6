"""Scalar geometry on columns: boxes, court zones, projection, angles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtflow import config as C
from courtflow.functions.sequences import spread_join

CALIBRATION = ("fps", "width", "height", "image_to_court", "court_to_image", "rmse_m")


@dataclass(frozen=True)
class Camera:
    """Frame rate, size and matrices of each row's own match, as ``calibrated`` joins them.

    Takes the place of ``config.Video``, of corners and of a matrix where matches differ.
    ``top_fps`` is the highest rate among them: how far a window can reach.
    """

    top_fps: float

    @property
    def fps(self) -> Column:
        return F.col("fps")

    @property
    def width(self) -> Column:
        return F.col("width")

    @property
    def height(self) -> Column:
        return F.col("height")

    @property
    def diagonal(self) -> Column:
        return hypot(self.width, self.height)

    @property
    def homography(self) -> list[Column]:
        return coefficients("image_to_court")

    @property
    def inverse(self) -> list[Column]:
        return coefficients("court_to_image")

    @property
    def corners(self) -> list[tuple[Column, Column]]:
        """The court's corners in the image."""
        at = [F.get(F.col("court_corners"), F.lit(i)) for i in range(8)]
        return list(zip(at[::2], at[1::2], strict=True))

    def frames(self, seconds: float, least: int = 1) -> Column:
        return F.greatest(F.lit(least), F.bround(F.lit(seconds) * self.fps).cast("bigint"))

    def reach(self, seconds: float, least: int = 1) -> int:
        return C.frames_for(seconds, self.top_fps, least)


def coefficients(matrix: str) -> list[Column]:
    """The nine entries of an array column; null where it is missing or shorter."""
    return [F.get(F.col(matrix), F.lit(i)) for i in range(9)]


def camera_of(calibrations: DataFrame) -> Camera:
    """Camera for rows joined with ``calibrations``; one number comes to the driver."""
    top = calibrations.agg(F.max("fps")).first()[0]
    return Camera(float(top) if top is not None else C.Video().fps)


def calibrated(rows: DataFrame, calibrations: DataFrame, how: str = "left") -> DataFrame:
    """Rows with the calibration of their match (one row each); null columns where it has none.

    The corners of the court are projected once per match.  A match that holds most
    rows is spread over several tasks.
    """
    w, l = C.COURT_WIDTH_M, C.COURT_LENGTH_M  # noqa: E741
    corners = [v for x, y in ((0.0, 0.0), (w, 0.0), (w, l), (0.0, l)) for v in project(F.lit(x), F.lit(y), coefficients("court_to_image"))]
    cameras = calibrations.select("match_id", *CALIBRATION, F.array(*corners).alias("court_corners"))
    return spread_join(rows, cameras, ["match_id"], how=how)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def both(a: Column, b: Column) -> Column:
    return a.isNotNull() & b.isNotNull()


def hypot(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def distance(ax, ay, bx, by) -> Column:
    return hypot(col(ax) - col(bx), col(ay) - col(by))


def box_center(l, t, r, b) -> tuple[Column, Column]:
    return (col(l) + col(r)) / 2, (col(t) + col(b)) / 2


def ground_point(l, r, b) -> tuple[Column, Column]:
    return (col(l) + col(r)) / 2, col(b)


def box_iou(a: tuple, b: tuple) -> Column:
    """Intersection over union of two ``(left, top, right, bottom)`` boxes."""
    al, at, ar, ab = map(col, a)
    bl, bt, br, bb = map(col, b)
    w = F.greatest(F.lit(0.0), F.least(ar, br) - F.greatest(al, bl))
    h = F.greatest(F.lit(0.0), F.least(ab, bb) - F.greatest(at, bt))
    overlap = w * h
    union = (ar - al) * (ab - at) + (br - bl) * (bb - bt) - overlap
    return F.when(union > 0, overlap / union).otherwise(F.lit(0.0))


def box_distance(x, y, l, t, r, b) -> Column:
    dx = F.greatest(col(l) - col(x), F.lit(0.0), col(x) - col(r))
    dy = F.greatest(col(t) - col(y), F.lit(0.0), col(y) - col(b))
    return hypot(dx, dy)


def inside_box(x, y, l, t, r, b) -> Column:
    return col(x).between(col(l), col(r)) & col(y).between(col(t), col(b))


def project(x, y, h: list) -> tuple[Column, Column]:
    """Apply a 3x3 homography given row by row; null where it has no finite image."""
    h = [col(v) if isinstance(v, (str, Column)) else F.lit(float(v)) for v in h]
    x, y = col(x), col(y)
    d = h[6] * x + h[7] * y + h[8]
    ok = F.abs(d) >= 1e-12
    px = F.when(ok, (h[0] * x + h[1] * y + h[2]) / d)
    py = F.when(ok, (h[3] * x + h[4] * y + h[5]) / d)
    bad = F.isnan(px) | F.isnan(py) | (F.abs(px) == float("inf")) | (F.abs(py) == float("inf"))
    return F.when(~bad, px), F.when(~bad, py)


def in_convex(x, y, corners: list[tuple]) -> Column:
    """Point in a convex quadrilateral, its edge included."""
    x, y = col(x), col(y)
    signs = []
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
        ax, ay, bx, by = (F.lit(float(v)) if isinstance(v, (int, float)) else col(v) for v in (ax, ay, bx, by))
        signs.append((bx - ax) * (y - ay) - (by - ay) * (x - ax))
    up = down = F.lit(True)
    for s in signs:
        up, down = up & (s >= 0), down & (s <= 0)
    return up | down


def in_court(x, y) -> Column:
    return col(x).between(0, C.COURT_WIDTH_M) & col(y).between(0, C.COURT_LENGTH_M)


def zone(y, depth: float = C.NVZ_DEPTH_M) -> Column:
    """Kitchen (its lines included), transition zone or backcourt."""
    y = col(y)
    near, far = C.NEAR_KITCHEN_Y_M, C.FAR_KITCHEN_Y_M
    return (
        F.when(y.between(near, far), "kitchen")
        .when(y.between(near - depth, near) | y.between(far, far + depth), "transitionZone")
        .when(y.isNotNull(), "backcourt")
    )


def kitchen_setback(y) -> Column:
    """Distance behind the own half's kitchen line, 0 inside it."""
    y = col(y)
    return F.when(y <= C.NET_Y_M, F.greatest(F.lit(0.0), C.NEAR_KITCHEN_Y_M - y)).otherwise(
        F.greatest(F.lit(0.0), y - C.FAR_KITCHEN_Y_M)
    )


def side_setback(y, side) -> Column:
    y, side = col(y), col(side)
    return F.when(side == "near_side", F.greatest(F.lit(0.0), C.NEAR_KITCHEN_Y_M - y)).when(
        side == "far_side", F.greatest(F.lit(0.0), y - C.FAR_KITCHEN_Y_M)
    )


def lands_in_opponent_kitchen(y, side) -> Column:
    y, side = col(y), col(side)
    return F.when(
        y.isNotNull(),
        F.when(side == "near_side", y.between(C.NET_Y_M, C.FAR_KITCHEN_Y_M)).when(
            side == "far_side", y.between(C.NEAR_KITCHEN_Y_M, C.NET_Y_M)
        ),
    )


def angle_degrees(ax, ay, bx, by) -> Column:
    """Angle between two velocities; 0 if one of them is about zero."""
    ax, ay, bx, by = map(col, (ax, ay, bx, by))
    na, nb = hypot(ax, ay), hypot(bx, by)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / (na * nb)))
    return F.when((na <= 1e-12) | (nb <= 1e-12), 0.0).otherwise(F.degrees(F.acos(cosine)))


def cap1(c: Column) -> Column:
    return F.least(F.lit(1.0), c)


def ratio(a: Column, b: Column) -> Column:
    """Quotient that is null where nothing was counted."""
    return F.when(b != 0, a / b)


def ratio0(a: Column, b: Column) -> Column:
    """Quotient that is 0 where nothing was counted (event evaluation)."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))
