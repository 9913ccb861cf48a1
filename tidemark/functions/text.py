"""Column functions for names, phones, paths, coordinates, units and seasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_name(name: Column) -> Column:
    """Lower case, administrative words dropped, one space between words."""
    words = F.regexp_replace(F.lower(name), r"\b(?:ban|tambon|amphoe|changwat|district|province|mueang)\b", " ")
    return F.trim(F.regexp_replace(words, r"[^\p{L}\p{N}]+", " "))


def normal_path(path: Column) -> Column:
    """A route without locale and with ids replaced."""
    bare = F.regexp_replace(F.regexp_replace(path, r"[?#].*$", ""), r"^/(?:th|en|ms)(?=/|$)", "")
    ids = F.regexp_replace(bare, r"/(?:[0-9]+|[0-9a-fA-F-]{32,36})(?=/|$)", "/:id")
    return F.when(ids == "", "/").otherwise(ids)


def normal_phone(phone: Column, country: str = "66") -> Column:
    """+country and digits; NULL for what has too few or too many."""
    digits = F.regexp_replace(phone, r"[^0-9+]", "")
    full = F.when(digits.startswith("+"), digits).when(digits.startswith("0"), F.concat(F.lit(f"+{country}"), F.substring(digits, 2, 20))).otherwise(F.concat(F.lit("+"), digits))
    return F.when(F.length(full).between(10, 16), full)


def masked_phone(phone: Column) -> Column:
    return F.concat(F.repeat(F.lit("*"), F.greatest(F.length(phone) - 4, F.lit(0)).cast("int")), F.right(phone, F.lit(4)))


def decimal_degrees(text: Column) -> Column:
    """Degrees, minutes and seconds with a side letter, or plain degrees."""
    part = lambda i: F.expr("double(null)") if i is None else F.regexp_extract(text, r"^\s*(\d+)\D+(\d+)\D+([\d.]+)\D*([NSEW])", i)
    whole = part(1).try_cast("double") + part(2).try_cast("double") / 60 + part(3).try_cast("double") / 3600
    return F.coalesce(F.when(part(4).isin("S", "W"), -whole).otherwise(whole), text.try_cast("double"))


def mcm_per_hour_to_cms(value: Column) -> Column:
    return value * 1_000_000 / 3600


def fill(template: Column, values: dict[str, Column]) -> Column:
    """{name} places of a template replaced by texts."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value.cast("string"))
    return template


def agent(ua: Column) -> dict[str, Column]:
    """device, os and browser of a user agent."""
    has = lambda *words: ua.rlike("|".join(words))
    device = F.when(has("iPad", "Tablet"), "tablet").when(has("Mobi", "iPhone", "Android"), "phone").when(has("Windows", "Macintosh", "X11"), "computer").otherwise("other")
    system = F.when(has("iPhone", "iPad"), "ios").when(has("Android"), "android").when(has("Windows"), "windows").when(has("Mac OS X"), "macos").otherwise("other")
    browser = F.when(has("Edg/"), "edge").when(has("Firefox/"), "firefox").when(has("Chrome/"), "chrome").when(has("Safari/"), "safari").otherwise("other")
    return {"device": device, "os": system, "browser": browser}


def hit_score(name: Column, asked: Column) -> Column:
    """100 for the same name, 90 where it begins with more than half of it, 70 where it begins so, 50 where it contains it, else NULL."""
    more = 2 * F.length(asked) > F.length(name)
    return F.when(name == asked, 100).when(F.startswith(name, asked), F.when(more, 90).otherwise(70)).when(F.contains(name, asked), 50)


def range_text(low: Column, high: Column) -> Column:
    """Hours from low to high, widened outward: whole hours up to twelve, half days beyond."""
    hours = F.concat(F.floor(low).cast("string"), F.lit("-"), F.ceil(high).cast("string"), F.lit(" h"))
    days = F.format_string("%.1f-%.1f d", (F.floor(low / 12) / 2).cast("double"), (F.ceil(high / 12) / 2).cast("double"))
    return F.when(high <= 12, hours).otherwise(days)


def url_coordinates(url: Column) -> tuple[Column, Column]:
    """(lat, lon) of a map link: behind an at sign, or in q, query, ll or center."""
    pattern = r"(?:@|[?&](?:q|query|ll|center)=)(-?[0-9]{1,2}(?:\.[0-9]+)?)(?:,|%2C)\s*(-?[0-9]{1,3}(?:\.[0-9]+)?)"
    lat, lon = (F.regexp_extract(url, pattern, i).try_cast("double") for i in (1, 2))
    fits = (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
    return F.when(fits, lat), F.when(fits, lon)


#: The digits of plus codes, in order.
PLUS_DIGITS = "23456789CFGHJMPQRVWX"


def plus_code_centre(code: Column) -> tuple[Column, Column]:
    """(lat, lon) of the middle of the cell of a whole plus code with ten digits; NULL for others."""
    clean = F.regexp_replace(F.upper(F.trim(code)), r"\+", "")
    valid = F.upper(F.trim(code)).rlike(rf"^[{PLUS_DIGITS}]{{8}}\+[{PLUS_DIGITS}]{{2}}$")
    digit = lambda i: F.instr(F.lit(PLUS_DIGITS), F.substring(clean, i, 1)) - 1
    steps = (20.0, 1.0, 0.05, 0.0025, 0.000125)
    lat = sum((digit(2 * i + 1) * step for i, step in enumerate(steps)), F.lit(-90.0)) + steps[-1] / 2
    lon = sum((digit(2 * i + 2) * step for i, step in enumerate(steps)), F.lit(-180.0)) + steps[-1] / 2
    return F.when(valid, lat), F.when(valid, lon)
