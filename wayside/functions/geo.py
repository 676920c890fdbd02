"""Geodesy and the ground-plane camera as column expressions.

Two Earth models live side by side: great-circle distances use a sphere of 6 371 000 m, local
offsets 111 320 m for each degree. They differ by about 0.1 % and are not unified.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS_M = 6_371_000.0
M_PER_DEG_LAT = 111_320.0
BOX_SCALE = 1000.0
MERCATOR_LIMIT = 85.05112878


def m_per_deg_lon(lat: Column) -> Column:
    return M_PER_DEG_LAT * F.cos(F.radians(lat))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    # rounding can bring h to just over 1, where nanvl steps in; least() would turn null into 1
    return 2 * EARTH_RADIUS_M * F.nanvl(F.asin(F.sqrt(h)), F.lit(1.5707963267948966))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial compass bearing in [0, 360)."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(dl) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def offset_lat(lat: Column, north_m: Column) -> Column:
    return lat + north_m / M_PER_DEG_LAT


def offset_lon(lat: Column, lon: Column, east_m: Column) -> Column:
    return lon + east_m / m_per_deg_lon(lat)


def local_east(lon: Column, lat0: Column, lon0: Column) -> Column:
    return (lon - lon0) * m_per_deg_lon(lat0)


def local_north(lat: Column, lat0: Column) -> Column:
    return (lat - lat0) * M_PER_DEG_LAT


def scene_xz(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    """Scene coordinates of a viewer: x to the east, z to the south."""
    return F.struct(local_east(lon, lat0, lon0).alias("x"), (-local_north(lat, lat0)).alias("z"))


def focal_px(height: Column, vfov_deg: Column) -> Column:
    return height / 2.0 / F.tan(F.radians(vfov_deg) / 2.0)


def horizon_row(height: Column, pitch_offset_frac: Column) -> Column:
    return height / 2.0 + pitch_offset_frac * height


def ground_range(u: Column, v: Column, width: Column, height: Column, cam: dict[str, Column]) -> Column:
    """struct(forward, lateral) of an image point on flat ground.

    Null at or above the horizon and beyond the camera's range. ``cam`` has height_m, vfov_deg,
    pitch_offset_frac and max_range_m.
    """
    f = focal_px(height, cam["vfov_deg"])
    dy = v - horizon_row(height, cam["pitch_offset_frac"])
    forward = F.try_divide(cam["height_m"], F.tan(F.atan2(dy, f)))
    seen = (dy > 1e-6) & (forward > 0) & (forward <= cam["max_range_m"])
    return F.when(seen, F.struct(forward.alias("forward"), ((u - width / 2.0) * forward / f).alias("lateral")))


def row_for_range(range_m: Column, height: Column, cam: dict[str, Column]) -> Column:
    """Pixel row at which ground ``range_m`` ahead appears; null unless the range is positive."""
    row = horizon_row(height, cam["pitch_offset_frac"]) + focal_px(height, cam["vfov_deg"]) * F.try_divide(cam["height_m"], range_m)
    return F.when(range_m > 0, row)


def ground_lat(forward: Column, lateral: Column, lat: Column, heading_deg: Column) -> Column:
    psi = F.radians(heading_deg)
    return offset_lat(lat, -lateral * F.sin(psi) + forward * F.cos(psi))


def ground_lon(forward: Column, lateral: Column, lat: Column, lon: Column, heading_deg: Column) -> Column:
    psi = F.radians(heading_deg)
    return offset_lon(lat, lon, lateral * F.cos(psi) + forward * F.sin(psi))


def anchor_u(box: Column, width: Column) -> Column:
    return (box["x1"] + box["x2"]) / 2.0 / BOX_SCALE * width


def anchor_v(box: Column, height: Column, geometry: Column) -> Column:
    """A point stands on its box's lower edge; areas and segments are taken at the centre."""
    return F.when(geometry == "point", box["y2"]).otherwise((box["y1"] + box["y2"]) / 2.0) / BOX_SCALE * height


def bearing_to_box(box: Column, width: Column, height: Column, vfov_deg: Column, heading_deg: Column) -> Column:
    off = F.degrees(F.atan2(anchor_u(box, width) - width / 2.0, focal_px(height, vfov_deg)))
    return F.pmod(heading_deg + off + 360.0, F.lit(360.0))


def ray_forward_m(lat: Column, lon: Column, bearing: Column, to_lat: Column, to_lon: Column) -> Column:
    """Distance along a ray to the point nearest a target; negative behind its start."""
    psi = F.radians(bearing)
    return local_east(to_lon, lat, lon) * F.sin(psi) + local_north(to_lat, lat) * F.cos(psi)


def angle_between(a: Column, b: Column) -> Column:
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def tile_x(lon: Column, zoom: Column) -> Column:
    return (lon + 180.0) / 360.0 * F.pow(F.lit(2.0), zoom)


def tile_y(lat: Column, zoom: Column) -> Column:
    held = F.radians(F.greatest(F.lit(-MERCATOR_LIMIT), F.least(F.lit(MERCATOR_LIMIT), lat)))
    return (1.0 - F.asinh(F.tan(held)) / F.pi()) / 2.0 * F.pow(F.lit(2.0), zoom)


def tile_lon(x: Column, zoom: Column) -> Column:
    return x / F.pow(F.lit(2.0), zoom) * 360.0 - 180.0


def tile_lat(y: Column, zoom: Column) -> Column:
    return F.degrees(F.atan(F.sinh(F.pi() * (1.0 - 2.0 * y / F.pow(F.lit(2.0), zoom)))))
