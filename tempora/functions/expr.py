"""Column expressions: Column -> Column, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DAY, DEFAULT, LOW_SUPPORT, LOW_TYPE, UNKNOWN, Config


def clean(x: Column) -> Column:
    """Spaces trimmed, white space collapsed, upper case; empty becomes null. A leading TAB survives as a space."""
    t = F.trim(x)
    odd = t.contains("  ")
    for space in "\t\n\x0b\f\r":
        odd = odd | t.contains(space)
    # most texts have single spaces only: a regular expression for each would take most of the time
    return F.nullif(F.upper(F.when(odd, F.regexp_replace(t, r"\s+", " ")).otherwise(t)), F.lit(""))


def normalise_id(x: Column) -> Column:
    """A caller's id: all outer white space goes."""
    return F.upper(F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"\s+", " "))


def identifier(pairing: Column, host: Column, journey_id: Column) -> Column:
    return F.coalesce(clean(pairing), clean(host), F.concat(F.lit("JOURNEY#"), journey_id.cast("string")))


def host_serial(model: Column, pairing: Column, seq: Column) -> Column:
    return clean(F.concat(clean(model), F.lit("-"), clean(pairing), F.lit("-"), clean(seq)))


def serial_part(x: Column, n: int) -> Column:
    return clean(F.split_part(clean(x), F.lit("-"), F.lit(n)))


def fuzzy_key(x: Column, cfg: Config = DEFAULT) -> Column:
    words = F.filter(F.split(F.regexp_replace(F.upper(x), r"[^\p{L}\p{N}]", " "), " +"), lambda w: w != "")
    expand = lambda w: F.coalesce(*[F.when(w == a, F.lit(b)) for a, b in cfg.abbreviations], w)
    return F.array_join(F.transform(words, expand), " ")


def similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(F.bround(1 - F.levenshtein(a, b) / longest, 4))


def micros(ts: Column) -> Column:
    """Microseconds since 1970; the session's zone is UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def days(a: Column, b: Column) -> Column:
    """Days from a to b, both in microseconds."""
    return (b - a) / F.lit(float(DAY))


def log1p0(x: Column) -> Column:
    return F.log1p(F.greatest(F.coalesce(x.cast("double"), F.lit(0.0)), F.lit(0.0)))


def age_band(d: Column, cfg: Config = DEFAULT) -> Column:
    out = None
    for limit, label in cfg.age_bands:
        out = F.when(d < limit, label) if out is None else out.when(d < limit, label)
    return out.otherwise(cfg.last_band)


def positive(x: Column) -> Column:
    return F.coalesce(x, F.lit(0)) > 0


def month_of(us: Column) -> Column:
    return F.month(F.timestamp_micros(us))


def collapse(value: Column, support: Column, least: int = DEFAULT.model_support, low: str = LOW_SUPPORT) -> Column:
    return F.when(value.isNull(), UNKNOWN).when(F.coalesce(support, F.lit(0)) < least, low).otherwise(value)


def known_or_low(value: Column, known: Column) -> Column:
    """A null is low support too, not unknown."""
    return F.when(F.coalesce(known, F.lit(False)), value).otherwise(LOW_TYPE)


def coarse(d: Column) -> Column:
    """Daily up to 120, in steps of 60 beyond, half to even."""
    return F.when(d <= 120, d).otherwise(120 + 60 * F.bround((d - 120) / 60))


def definite(duration: Column, event: Column, h: Column) -> Column:
    """Alive at h if followed so far (also at equality), failed if the event came first, else unknown."""
    return F.when(duration >= h, 0).when(event & (duration <= h), 1)


def band(p: Column, cfg: Config = DEFAULT) -> Column:
    return F.when(p >= cfg.high, "HIGH").when(p >= cfg.medium, "MEDIUM").otherwise("LOW")


def is_recon(wo_type: Column, order_type: Column, status: Column, activity: Column, done_by: Column, remark: Column) -> Column:
    no = F.lit(False)
    return (
        F.coalesce(wo_type == "RECON", no)
        | F.coalesce(order_type == "RECON", no)
        | F.coalesce((status == "DISMANTLED") & (activity == "RECON"), no)
        | F.coalesce((status == "INSTALLED") & (F.coalesce(done_by, F.lit("")).contains("RECON") | remark.contains("RECON")), no)
    )


def public_place(name: Column) -> Column:
    n = F.upper(F.trim(name))
    return n.startswith("STASIUN ") | n.endswith("(KA BANDARA)")


def in_box(lat: Column, lon: Column) -> Column:
    return lat.between(-6.60, -5.80) & lon.between(106.23, 107.20)


def search_name(name: Column) -> Column:
    """Name to look up: the airport-line tag goes, stations get their prefix once."""
    bare = F.trim(F.regexp_replace(F.trim(name), r"\(KA BANDARA\)", ""))
    return F.when(F.upper(bare).startswith("STASIUN "), F.concat(F.lit("Stasiun "), F.trim(F.substring(bare, 9, 1000)))).otherwise(F.concat(F.lit("Stasiun "), bare))
