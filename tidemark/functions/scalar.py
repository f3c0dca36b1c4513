"""Small domain functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def signal_level(value, low: float, high: float) -> Column:
    """none, low, medium or high by two thresholds."""
    return F.when(value.isNull(), "none").when(value >= high, "high").when(value >= low, "medium").otherwise("low")


def strength(stream, fields: dict[str, Column]) -> Column:
    """The field that measures the strength of an event of each stream; null for other streams."""
    return reduce(lambda c, kv: c.when(stream == kv[0], kv[1].cast("double")), fields.items(), F.when(F.lit(False), F.lit(None).cast("double")))


def bracket_height(value, most: float = 3.0) -> Column:
    """Strength as a height between 0.35 and 1."""
    return F.greatest(F.lit(0.35), F.least(F.lit(1.0), F.coalesce(F.abs(value) / most, F.lit(0.35))))


def peak_time(peak, start, end) -> Column:
    return F.coalesce(peak, (start + end) / 2)


def db_to_gain(db) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def eye_direction(look: dict[str, Column]) -> tuple[Column, Column]:
    """Horizontal and vertical deflection from the eight look measures
    (in, out, up, down of the left and the right eye)."""
    x = ((look["out_left"] - look["in_left"]) + (look["in_right"] - look["out_right"])) / 2
    y = ((look["up_left"] - look["down_left"]) + (look["up_right"] - look["down_right"])) / 2
    return x, y


def euler(m: list[list[Column]]) -> tuple[Column, Column, Column]:
    """Yaw, pitch and roll in degrees of a rotation matrix."""
    flat = F.sqrt(m[0][0] * m[0][0] + m[1][0] * m[1][0])
    return F.degrees(F.atan2(-m[2][0], flat)), F.degrees(F.atan2(m[2][1], m[2][2])), F.degrees(F.atan2(m[1][0], m[0][0]))


def gaze(yaw, pitch, yaw0=0.0, pitch0=0.0, side=18.0, vertical=14.0, frontal=6.0) -> Column:
    """Class of a pose relative to the neutral one: left, right, up, down, camera or front."""
    dy, dp = yaw - yaw0, pitch - pitch0
    return F.when(yaw.isNull() | pitch.isNull(), F.lit("")).when(dy <= -side, "left").when(dy >= side, "right").when(dp >= vertical, "up").when(dp <= -vertical, "down").when((F.abs(dy) <= frontal) & (F.abs(dp) <= frontal), "camera").otherwise("front")


def in_zone(yaw, pitch, zone: tuple[float, float, float, float]) -> Column:
    return yaw.between(zone[0], zone[1]) & pitch.between(zone[2], zone[3])


def camera_zone(yaw, pitch, eye_x, eye_y, zone, eye_gain: float = 20.0) -> Column:
    """The zone test on the pose corrected by the eyes, where they are measured."""
    return in_zone(yaw + F.coalesce(eye_x, F.lit(0.0)) * eye_gain, pitch + F.coalesce(eye_y, F.lit(0.0)) * eye_gain, zone)


def rect_pixels(x, y, w, h, width, height) -> Column:
    """Normalised rectangle in pixels."""
    return F.struct(F.round(x * width).cast("int").alias("x"), F.round(y * height).cast("int").alias("y"), F.round(w * width).cast("int").alias("w"), F.round(h * height).cast("int").alias("h"))


def cut_state(enabled, accepted) -> Column:
    return F.when(~enabled, "disabled").when(accepted, "accepted").otherwise("proposed")


def cut_lane(lane, origin) -> Column:
    return F.coalesce(F.nullif(lane, F.lit("")), F.when(origin == "ai", "ai").otherwise("main"))


def source_layer(layer_id) -> Column:
    """Stored layer of a presented lane."""
    return F.split(layer_id, "#")[0]


def state_for(action) -> Column:
    return F.when(action == "accept", "accepted").when(action == "reject", "rejected").when(action == "reset", "proposed")


def online_cost(seconds, per_minute, speed) -> Column:
    """Cost and time of work that is billed by the minute begun."""
    return F.struct((F.ceil(seconds / 60) * per_minute).alias("cost"), (seconds / speed).alias("wait"))


def retry_after(header, now) -> Column:
    """Seconds of a Retry-After header, a number or an HTTP date; never negative."""
    day = F.regexp_extract(header, r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1)
    at = F.try_to_timestamp(F.nullif(day, F.lit("")), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.greatest(F.lit(0.0), F.coalesce(header.try_cast("double"), (F.unix_timestamp(at) - F.unix_timestamp(now)).cast("double")))


def canonical_json(*columns) -> Column:
    """Compact JSON with the given columns in name order; nulls are written."""
    ordered = sorted(columns)
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def digest(*columns) -> Column:
    """SHA-256 of the canonical JSON; pass only the fields that make up the identity."""
    return F.sha2(canonical_json(*columns), 256)


def same_identity(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)])


#: Names of credentials, and endings of such names.
SECRET_NAMES, SECRET_ENDINGS = ("token", "secret", "password", "passwd", "credentials", "authorization"), ("_key", "_token", "_secret", "_password", "apikey")


def is_secret(name: str) -> bool:
    """Does a name stand for a credential? ``api_key`` and ``Password`` do, ``monkey`` doesn't."""
    plain = name.lower()
    return plain in SECRET_NAMES or plain.endswith(SECRET_ENDINGS)


def without_secrets(schema: T.StructType) -> list[Column]:
    """The columns of a table, without fields that name a credential, at every level of structs, arrays and the values of maps."""

    def clean(x: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            kept = [clean(x.getField(f.name), f.dataType).alias(f.name) for f in kind.fields if not is_secret(f.name)]
            return F.when(x.isNotNull(), F.struct(*kept)) if kept else F.lit(None).cast("string")
        if isinstance(kind, T.ArrayType) and holds(kind):
            return F.transform(x, lambda y: clean(y, kind.elementType))
        if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
            plain = F.map_filter(x, lambda k, _: ~(F.lower(k).isin(*SECRET_NAMES) | F.lower(k).rlike(f"({'|'.join(SECRET_ENDINGS)})$")))
            return F.transform_values(plain, lambda _, v: clean(v, kind.valueType)) if holds(kind.valueType) else plain
        return x

    def holds(kind: T.DataType) -> bool:
        return isinstance(kind, (T.StructType, T.MapType)) or isinstance(kind, T.ArrayType) and holds(kind.elementType)

    return [clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in schema.fields if not is_secret(f.name)]
