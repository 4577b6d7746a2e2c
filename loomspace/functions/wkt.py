"""Well-known text of points and axis-parallel rectangles as columns.

All parsing is done by built-in expressions, so it stays inside the JVM. A text is readable when it is a POINT or a
POLYGON of one ring with at least four coordinates, in any case and spacing, with an optional SRID prefix and an optional
third coordinate, whose two decisive corners are finite and inside the world. Everything else gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
PAIR = rf"{NUMBER}\s+{NUMBER}"
REST = rf"(?:\s+{NUMBER}){{0,2}}"
PREFIX = r"(?i)^\s*(?:SRID\s*=\s*\d+\s*;\s*)?"
POINT = rf"{PREFIX}POINT\s*(?:ZM|Z|M)?\s*\(\s*({PAIR}){REST}\s*\)\s*$"
RING = (
    rf"{PREFIX}POLYGON\s*(?:ZM|Z|M)?\s*\(\s*\(\s*({PAIR}){REST}\s*,\s*{PAIR}{REST}\s*,\s*({PAIR}){REST}"
    rf"(?:\s*,\s*{PAIR}{REST})+\s*\)\s*\)\s*$"
)
WORLD = (-180.0, -90.0, 180.0, 90.0)


def _inside(x: Column, y: Column, world: tuple[float, float, float, float]) -> Column:
    return x.between(world[0], world[2]) & y.between(world[1], world[3])


def _coordinate(pair: Column, at: int) -> Column:
    # `+ 0` turns a negative zero into zero, so that both are one location
    return F.substring_index(pair, " ", at).try_cast("float") + F.lit(0).cast("float")


def _flat(text: Column) -> Column:
    return F.translate(text, "\t\r\n\f\u000b", "     ")


def _corners(text: Column) -> Column:
    """The deciding corners as an array of texts ``x y``: one of a point, two of a rectangle, none if unreadable.

    Each text is matched by one regular expression, once for a point and twice for a rectangle.
    """
    pair = F.array(F.regexp_extract(text, POINT, 1))
    ring = F.array(F.regexp_extract(text, RING, 1), F.regexp_extract(text, RING, 2))
    return F.when(F.lower(text).contains("polygon"), ring).otherwise(pair)


def _geometry(text: Column, points_only: bool, ordered: bool, world: tuple[float, float, float, float] | None) -> Column:
    """Array of at most one ``struct<x1,y1,x2,y2,is_point>``."""
    texts = F.array(F.regexp_extract(text, POINT, 1)) if points_only else _corners(text)
    # transform binds its argument to a variable, so the regular expression runs once however often the result is used
    pairs = F.transform(texts, lambda t: F.struct(_coordinate(_flat(t), 1).alias("x"), _coordinate(_flat(t), -1).alias("y")))

    def build(p: Column) -> Column:
        a, b = F.get(p, F.lit(0)), F.get(p, F.size(p) - 1)
        x1, y1, x2, y2 = a["x"], a["y"], b["x"], b["y"]
        if ordered:
            x1, y1, x2, y2 = F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2)
        return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), (F.size(p) == 1).alias("is_point"))

    known = lambda g: g["x1"].isNotNull() & g["y1"].isNotNull() & g["x2"].isNotNull() & g["y2"].isNotNull()
    fits = (lambda g: _inside(g["x1"], g["y1"], world) & _inside(g["x2"], g["y2"], world)) if world else known
    return F.filter(F.transform(F.array(pairs), build), fits)


def with_geometry(df: DataFrame, text: str, world: tuple[float, float, float, float] = WORLD, points_only: bool = False) -> DataFrame:
    """The rows with a readable geometry in column ``text`` and a new column ``geometry``.

    ``geometry`` is ``struct<x1,y1,x2,y2:float,is_point:boolean>``; a rectangle's ring coordinates 0 and 2 come out as
    lower-left and upper-right. NULL, empty and unreadable texts drop the row. An existing column ``geometry`` is replaced.
    Each step ends in a generator, which keeps later filters from repeating the parse and lets code generation do the rest.
    """
    kept = [F.col(c) for c in df.columns if c not in ("geometry", "__p")]
    point, t = F.regexp_extract(text, POINT, 1), F.col(text)
    found = point if points_only else F.when(F.lower(t).contains("polygon"), F.concat_ws(" ", F.regexp_extract(t, RING, 1), F.regexp_extract(t, RING, 2))).otherwise(point)
    parts = df.select(*kept, F.explode(F.array(F.split(found, "[ \\t\\r\\n\\f\\x0B]+"))).alias("__p"))
    n, zero = F.size("__p"), F.lit(0).cast("float")
    number = lambda i: F.when(n >= 2, F.get("__p", i).try_cast("float") + zero)
    a, b, c, d = number(F.lit(0)), number(F.lit(1)), number(n - 2), number(n - 1)
    made = F.struct(F.least(a, c).alias("x1"), F.least(b, d).alias("y1"), F.greatest(a, c).alias("x2"), F.greatest(b, d).alias("y2"), (n == 2).alias("is_point"))
    out = parts.select(*kept, F.explode(F.array(made)).alias("geometry"))
    return out.filter(_inside(F.col("geometry.x1"), F.col("geometry.y1"), world) & _inside(F.col("geometry.x2"), F.col("geometry.y2"), world))


def wkt_point(text: Column, world: tuple[float, float, float, float] = WORLD) -> Column:
    """``struct<x1,y1,x2,y2:float,is_point:boolean>`` of a readable point (both corners equal), else NULL."""
    return F.get(_geometry(text, True, True, world), F.lit(0))


def wkt_box(text: Column, world: tuple[float, float, float, float] = WORLD) -> Column:
    """The same of a readable point or rectangle, else NULL."""
    return F.get(_geometry(text, False, True, world), F.lit(0))


def wkt_ring_corners(text: Column) -> Column:
    """Ring coordinates 0 and 2 as they stand, without putting the corners in order and without a world."""
    return F.get(_geometry(text, False, False, None), F.lit(0))


def format_point(x: Column, y: Column) -> Column:
    """``POINT(x y)``."""
    return F.concat(F.lit("POINT("), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(")"))


def placed(x: Column, y: Column, world: tuple[float, float, float, float] = WORLD) -> Column:
    """Both coordinates present, finite and inside the world."""
    # NaN sorts above every number in Spark, so BETWEEN leaves it out; NULL gives NULL, which a filter drops
    return _inside(x, y, world)
