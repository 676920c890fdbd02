"""Parsing and writing of the texts that surveys come in and go out as."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(text: Column) -> Column:
    """Seconds from ``M:SS``, ``H:MM:SS`` or seconds; null if blank or unreadable."""
    parts = F.split(F.trim(text), ":")
    at = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    return (
        F.when(F.size(parts) == 1, at(0)).when(F.size(parts) == 2, at(0) * 60 + at(1))
        .when(F.size(parts) == 3, at(0) * 3600 + at(1) * 60 + at(2))
    )


def parse_number(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def parse_severity(text: Column) -> Column:
    """A whole number 1 to 5, halves to the even one; else null."""
    v = F.bround(parse_number(text), 0)
    return F.when(v.between(1, 5), v.cast("int"))


def parse_confidence(text: Column) -> Column:
    v = parse_number(text)
    return F.when(v.between(0, 1), v)


def time_text(seconds: Column) -> Column:
    """``M:SS.mmm``; seconds may print as 60.000, which parses back to the same time."""
    minutes = F.floor(seconds / 60)
    return F.concat(minutes.cast("string"), F.lit(":"), F.lpad(F.format_string("%.3f", seconds - minutes * 60), 6, "0"))


def slug(name: Column) -> Column:
    return F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit("_"))


def title(key: Column) -> Column:
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def drive_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/d/([a-zA-Z0-9_-]+)", 1), F.lit(""))


def map_color(color: Column, alpha: str = "ff") -> Column:
    """``#rrggbb`` or ``#rgb`` as alpha, blue, green, red; anything else is amber."""
    h = F.lower(F.regexp_replace(F.coalesce(color, F.lit("")), "^#", ""))
    six = F.when(F.length(h) == 3, F.regexp_replace(h, "(.)(.)(.)", "$1$1$2$2$3$3")).otherwise(h)
    part = lambda i: F.substring(six, i, 2)
    return F.when(six.rlike("^[0-9a-f]{6}$"), F.concat(F.lit(alpha), part(5), part(3), part(1))).otherwise(F.lit(f"{alpha}0b9ef5"))


def color_fractions(color: Column) -> Column:
    """``#rrggbb`` as struct(r, g, b) of fractions; null for anything else, three digits too."""
    h = F.lower(F.regexp_replace(F.coalesce(color, F.lit("")), "^#+", ""))
    part = lambda i: (F.conv(F.substring(h, i, 2), 16, 10).cast("int") / 255.0)
    return F.when(h.rlike("^[0-9a-f]{6}$"), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def cdata(text: Column) -> Column:
    return F.replace(text, F.lit("]]>"), F.lit("]]]]><![CDATA[>"))


def stamp_to_seconds(text: Column) -> Column:
    return F.regexp_replace(text, r"\.\d+", "")


def fixed(value: Column, places: int = 8) -> Column:
    """``value`` with ``places`` (at most 8) decimals, rounded by the double's exact value, as C's printf and SQL do.

    Java rounds the shortest decimal text of a double instead, which differs wherever that text ends in a 5 after the last place.
    The fraction is taken as 52 bits, and multiplied in two halves that fit a long each.
    """
    size, ten = F.abs(value), 10**places
    whole = F.floor(size)
    part = (size - whole) * float(2**52)
    bits = part.cast("long")
    low = bits.bitwiseAND(F.lit(2**26 - 1)) * ten + 2**51
    sum_ = F.shiftright(bits, 26) * ten + F.shiftright(low, 26)
    n = F.shiftright(sum_, 26)
    even = (bits.cast("double") == part) & (low.bitwiseAND(F.lit(2**26 - 1)) == 0) & (sum_.bitwiseAND(F.lit(2**26 - 1)) == 0) & (n % 2 == 1)
    n = n - F.when(even, 1).otherwise(0)
    digits = F.concat(F.when(value < 0, "-").otherwise(""), (whole + F.floor(n / ten)).cast("string"), F.lit("."), F.lpad((n % ten).cast("string"), places, "0"))
    return F.when(size < 1e9, digits).otherwise(F.format_string(f"%.{places}f", value))


def coordinates(lon: Column, lat: Column) -> Column:
    return F.concat(fixed(lon), F.lit(","), fixed(lat), F.lit(",0"))


def building_height(height: Column, levels: Column) -> Column:
    """Metres from a height text, else storeys of 3.2 m, at least 2; 8 where neither is known."""
    metres = F.trim(F.replace(F.lower(height), F.lit("m"), F.lit(""))).try_cast("double")
    storeys = F.trim(F.get(F.split(levels, ";"), F.lit(0))).try_cast("double") * 3.2
    known = F.coalesce(metres, storeys)
    return F.when(known.isNull(), 8.0).otherwise(F.greatest(F.lit(2.0), known))


def accuracy_label(method: Column, residual_m: Column) -> Column:
    return (
        F.when((method == "triangulated") & residual_m.isNotNull(), F.format_string("triangulated, +/-%.1f m", residual_m))
        .when(method == "camera", "camera position").otherwise("ground plane, +/-2-4 m")
    )


def provenance(backend: Column, verifier: Column) -> Column:
    synthetic = F.when(backend == "mock", F.lit("synthetic data"))
    return F.concat_ws("; ", F.concat(F.lit("detected by "), backend), F.concat(F.lit("verified by "), verifier), synthetic)
