"""Column-expression helpers.

Every row-level rule of the incident application is a Catalyst expression
here (no Python UDF), so it stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ripple import constants as K


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def null_token(x, tokens=K.NULL_TOKENS) -> Column:
    """Sentinel text (``NULL``, ``nan``) -> SQL NULL."""
    x = c(x)
    return F.when(x.isin(*tokens), F.lit(None).cast("string")).otherwise(x)


def parse_flag(x) -> Column:
    """Text flag -> boolean; anything but TRUE (incl. null) is False."""
    return F.coalesce(F.upper(F.trim(c(x))) == F.lit("TRUE"), F.lit(False))


def norm_vehicle(x) -> Column:
    """lower/trim; nan, '' and '0' (and null) become ``unknown``."""
    v = F.lower(F.trim(c(x)))
    return F.when(v.isNull() | v.isin(*K.VEHICLE_UNKNOWN_TOKENS), F.lit("unknown")).otherwise(v)


def norm_cause(x, default=K.DEFAULT_CAUSE) -> Column:
    """lower/trim; a missing cause becomes ``others``."""
    return F.lower(F.trim(F.coalesce(c(x), F.lit(default))))


def group_cause(x) -> Column:
    """Civic causes collapse into ``civic_event``."""
    x = c(x)
    return F.when(x.isin(*K.CIVIC_CAUSES), F.lit(K.CIVIC_GROUP)).otherwise(x)


def is_named_corridor(x="corridor") -> Column:
    """Named corridor predicate (C11), null-safe."""
    x = c(x)
    return F.coalesce(x.isNotNull() & ~x.isin(*K.NOT_NAMED_CORRIDORS), F.lit(False))


def is_peak(hour, peaks=K.PEAK_HOURS) -> Column:
    """1 when the hour falls in a peak range, null hour -> 0."""
    h = c(hour)
    cond = F.lit(False)
    for lo, hi in peaks:
        cond = cond | h.between(lo, hi)
    return F.coalesce(cond, F.lit(False)).cast("int")


def is_weekend(dow) -> Column:
    return F.coalesce(c(dow).isin(5, 6), F.lit(False)).cast("int")


def is_heavy(veh) -> Column:
    return F.coalesce(c(veh).isin(*K.HEAVY_TYPES), F.lit(False)).cast("int")


def vehicle_category(veh) -> Column:
    v = c(veh)
    expr = None
    for name, members in K.VEHICLE_CATEGORIES:
        expr = (F.when(v.isin(*members), F.lit(name)) if expr is None
                else expr.when(v.isin(*members), F.lit(name)))
    return expr.otherwise(F.lit("unknown"))


def severity(priority, closure) -> Column:
    """high = High and closure; medium = either; low = neither."""
    high = F.coalesce(c(priority) == F.lit("High"), F.lit(False))
    clo = F.coalesce(c(closure), F.lit(False))
    return (F.when(high & clo, F.lit("high"))
            .when(high | clo, F.lit("medium"))
            .otherwise(F.lit("low")))


def epoch_micros(name: str) -> Column:
    """Microseconds since the epoch of a wall-clock (TIMESTAMP_NTZ) column.

    Built from the date and clock fields, so it does not depend on the
    session time zone or its daylight-saving rules.
    """
    t = F.col(name)
    days = F.unix_date(F.to_date(t)).cast("long")
    clock = (F.hour(t) * 3600 + F.minute(t) * 60).cast("long") * 1_000_000
    secs = (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")      # seconds with fraction
    return days * 86_400_000_000 + clock + secs


def to_local(ts, tz=K.LOCAL_TZ) -> Column:
    """UTC wall clock -> local wall clock (C3), both TIMESTAMP_NTZ."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), c(ts).cast("timestamp_ntz"))


def minutes_between(start, end) -> Column:
    """Fractional minutes end - start."""
    return F.expr(f"timestampdiff(MICROSECOND, {start}, {end})") / F.lit(60_000_000.0)


def band(risk, cuts=K.CONFIDENCE_BANDS, default="LOW") -> Column:
    """Confidence band (D1) / tier (D11) from ordered cut-offs."""
    r = c(risk)
    expr = None
    for cut, name in cuts:
        expr = F.when(r >= cut, F.lit(name)) if expr is None else expr.when(r >= cut, F.lit(name))
    return expr.otherwise(F.lit(default))


def corridor_code(corridor) -> Column:
    """First letters of words that start with a letter, 3 chars, padded X."""
    words = F.split(F.trim(c(corridor)), r"\s+")
    initials = F.transform(
        F.filter(words, lambda w: F.substring(w, 1, 1).rlike("^[A-Za-z]$")),
        lambda w: F.substring(w, 1, 1))
    code = F.upper(F.substring(F.array_join(initials, ""), 1, 3))
    return F.rpad(code, 3, "X")


def relative_duration(minutes) -> Column:
    """``~N min`` below an hour, else ``~Xh Ym`` / ``~Xh``."""
    m = c(minutes).cast("bigint")
    h = F.floor(m / 60).cast("bigint")
    r = (m % 60).cast("bigint")
    return (F.when(m < 60, F.concat(F.lit("~"), m.cast("string"), F.lit(" min")))
            .when(r > 0, F.concat(F.lit("~"), h.cast("string"), F.lit("h "), r.cast("string"), F.lit("m")))
            .otherwise(F.concat(F.lit("~"), h.cast("string"), F.lit("h"))))


def deploy_message(police, breakdown, barricades, corridor) -> Column:
    """List only non-zero resources; a monitor text when all are zero."""
    p, b, r = c(police), c(breakdown), c(barricades)
    parts = F.filter(F.array(
        F.when(p > 0, F.concat(p.cast("string"), F.lit(" traffic police"))),
        F.when(b > 0, F.concat(b.cast("string"), F.lit(" breakdown units"))),
        F.when(r > 0, F.concat(r.cast("string"), F.lit(" barricades")))),
        lambda x: x.isNotNull())
    return (F.when(F.size(parts) == 0,
                   F.concat(F.lit("Monitor "), c(corridor), F.lit(" - no immediate deployment required")))
            .otherwise(F.concat(F.lit("Deploy "), F.array_join(parts, ", "), F.lit(" -> "), c(corridor),
                                F.lit(", ETA: subject to fleet positioning"))))


def map_lookup(key, mapping: dict, default) -> Column:
    """Constant dictionary lookup with a default (a literal map, no join)."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(m, c(key)), F.lit(default))
