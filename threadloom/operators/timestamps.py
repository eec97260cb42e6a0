"""One UTC instant from timestamps of many notations (problem 6).

A value is reduced to its shape: each letter ``a``, each digit ``9``, all else as it is. Equal shapes have
their fields at equal places, so a shape is matched against the notations once, and all its values are then
cut and converted as NumPy arrays. Local times go through transition tables of the zone database; every
worker checks that its version (:func:`zone_table_version`) is the driver's.
"""

import hashlib
import re
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.sources.tables import small, spread

# Month names and their abbreviations in the languages of the lists, lower case, without dots.
MONTHS = {
    w: n
    for n, words in enumerate(
        (
            "january jan janvier janv januar jän jänner enero ene",
            "february feb février févr fevrier fevr februar febrero",
            "march mar mars märz mär mrz maerz marzo",
            "april apr avril avr abril abr",
            "may mai mayo",
            "june jun juin juni junio",
            "july jul juillet juil juli julio",
            "august aug août aout agosto ago",
            "september sep sept septembre septiembre",
            "october oct octobre oktober okt octubre",
            "november nov novembre noviembre",
            "december dec décembre déc decembre dezember dez diciembre dic",
        ),
        1,
    )
    for w in words.split()
}
# Names of UTC itself.
UTC_NAMES = {"Z", "UT", "UTC", "GMT", "UCT", "ZULU"}
# Zone abbreviations and their offsets in minutes, where the mailbox's own zone doesn't have them.
ABBREVIATIONS = {
    "WET": 0, "WEST": 60, "BST": 60, "IST": 330, "CET": 60, "MEZ": 60, "CEST": 120, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480, "JST": 540,
}

_SPACE = r"[ \t]+"
_TIME = r"(?P<H>99?)[:.h](?P<M>99)(?:[:.](?P<S>99)(?:[.,](?P<f>9+))?)?"
_AMPM = rf"(?:(?:{_SPACE})?(?P<ap>aa(?![a.])|a\.a\.))"
_ZONE = rf"(?:(?:{_SPACE})?(?:(?P<off>[+-]9{{4}}|[+-]99?:99|[+-]99)|(?P<abbr>a+)|\[?(?P<name>a[a_+-]*(?:/[a9_+-]+)+|(?<=\[)a+)\]?))?(?:{_SPACE}\([^)]*\))?"
_WD = rf"(?:a+\.?,?{_SPACE})?"
#: Notations as patterns on shapes; the first that fits decides. The order of day and month in ``x/x`` is the mailbox's.
LAYOUTS = [
    (k, re.compile(p + "$"))
    for k, p in (
        ("epoch", r"(?P<e>9{9,10})(?:[.,]9+)?"),
        ("epoch_ms", r"(?P<e>9{12,13})"),
        ("epoch_us", r"(?P<e>9{15,16})"),
        ("epoch_ns", r"(?P<e>9{18,19})"),
        ("compact", r"(?P<y>9999)(?P<m>99)(?P<d>99)(?P<t>a)(?P<H>99)(?P<M>99)(?P<S>99)?(?:[.,]9+)?" + _ZONE),
        ("iso", rf"(?P<y>9999)[-/.](?P<m>99?)[-/.](?P<d>99?)(?:(?P<t>a)|{_SPACE}){_TIME}{_ZONE}"),
        ("stamped", r"(?P<y>9999)-(?P<mon>a+)-(?P<d>99?)-a+-(?P<H>99)-(?P<M>99)-(?P<S>99)(?:-(?:(?P<abbr>a+)|(?P<off>[+-]9{4})))?"),
        ("mail", rf"{_WD}(?P<d>99?)\.?(?:{_SPACE}|-)(?P<mon>[aéûä]+)\.?(?:{_SPACE}|-)(?P<y>9999|99),?(?:{_SPACE}a)?{_SPACE}{_TIME}{_AMPM}?{_ZONE}"),
        ("mail", rf"{_WD}(?P<d>99?)\.?(?:{_SPACE}|-)(?P<mon>[aéûä]+)\.?(?:{_SPACE}|-)(?P<y>9999|99),?(?:{_SPACE}a)?{_SPACE}(?P<H>99?)a(?P<M>99)"),
        ("ctime", rf"(?:a+\.?,?{_SPACE})(?P<mon>a+)\.?{_SPACE}(?P<d>99?){_SPACE}{_TIME}(?:{_SPACE}(?:(?P<abbr>a+)|(?P<off>[+-]9{{4}})))?{_SPACE}(?P<y>9999)"),
        ("us", rf"{_WD}(?P<mon>a+)\.?{_SPACE}(?P<d>99?),{_SPACE}(?P<y>9999),?(?:{_SPACE}a+)?{_SPACE}{_TIME}{_AMPM}?{_ZONE}"),
        ("slashes", rf"(?P<p>99?)/(?P<q>99?)/(?P<y>9999|99),?{_SPACE}{_TIME}{_AMPM}?{_ZONE}"),
        ("dots", rf"(?P<d>99?)\.(?P<m>99?)\.(?P<y>9999|99),?{_SPACE}{_TIME}{_ZONE}"),
        ("dots", rf"(?P<d>99?)-(?P<m>99?)-(?P<y>9999),?{_SPACE}{_TIME}{_ZONE}"),
    )
]
_DIGITS = {ord(c): "9" for c in "0123456789"}
_STRIP = " \t\r\n\f\v   ﻿"


class _Shapes(dict):
    """Translation of one character; letters of any script count as letters."""

    def __missing__(self, k: int):
        self[k] = v = "a" if chr(k).isalpha() else chr(k)
        return v


_SHAPE = _Shapes(_DIGITS)


#: Zones with many kinds of rules, by whose tables a zone database is told from another.
_PROBES = ["Europe/Paris", "Europe/Istanbul", "America/New_York", "America/Mexico_City", "Asia/Tehran", "Africa/Cairo"]


@cache
def zone_table_version() -> str:
    """Version of the zone database whose transitions are used: its name, if it has one, and a fingerprint of its tables."""
    try:
        import tzdata

        name = tzdata.IANA_VERSION
    except (ImportError, AttributeError):
        name = "system"
    h = hashlib.sha256()
    for z in _PROBES:
        h.update(z.encode())
        for x in (transitions(z) or ())[:2]:
            h.update(np.asarray(x, "int64").tobytes())
    return f"{name}-{h.hexdigest()[:12]}"


def same_tables(version: str) -> None:
    """Raises an error where the zone tables aren't those of ``version``: a cluster must not convert by two of them."""
    if (own := zone_table_version()) != version:
        raise RuntimeError(f"zone tables {own} here, {version} on the driver")


@lru_cache(4096)
def layout(shape: str):
    """Kind and field places of a shape, or None; each distinct shape is matched once a worker."""
    for kind, pattern in LAYOUTS:
        if m := pattern.match(shape):
            return kind, {k: m.span(k) for k in m.groupdict() if m.group(k) is not None}
    return None


@lru_cache(1024)
def transitions(name: str):
    """(local seconds from which each offset holds, offsets, {abbreviation: offset}) of a zone, or None if unknown.

    Offset i holds for local times below border i; a time that occurs twice or never is below the border, so it gets
    the offset before the change: the first occurrence, and for a skipped time the offset before.
    """
    from datetime import datetime, timedelta, timezone
    from zoneinfo import ZoneInfo

    try:
        z = ZoneInfo(name)
    except Exception:  # noqa: BLE001  an unknown or malformed name
        return None
    zero = datetime(1970, 1, 1, tzinfo=timezone.utc)
    at = lambda s: (zero + timedelta(seconds=s)).astimezone(z)
    off = lambda s: int(at(s).utcoffset().total_seconds())
    step, s, end = 14 * 86400, -2208988800, 4102444800
    borders, offsets, abbrs = [], [off(s)], {}
    while s < end:
        if (a := off(s)) != off(s + step):
            lo, hi = s, s + step
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if off(mid) == a else (lo, mid)
            b = off(hi)
            borders.append(hi + max(a, b))
            offsets.append(b)
        if s > 0 and (n := at(s).tzname()).isalpha():
            abbrs[n.upper()] = off(s)
        s += step
    return np.array(borders, "int64"), np.array(offsets, "int64"), abbrs


def _days(y, m, d):
    """Days since 1970-01-01 of civil dates, and whether they exist."""
    ok = (m >= 1) & (m <= 12) & (d >= 1) & (y >= 1)
    length = np.array([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.where(ok, m, 1) - 1]
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    ok &= d <= length + ((m == 2) & leap)
    months = np.where(ok, (y - 1970) * 12 + m - 1, 0)
    return months.astype("datetime64[M]").astype("datetime64[D]").astype("int64") + d - 1, ok


@lru_cache(4096)
def _abbreviation(abbr: str, zone: str):
    """Offset in seconds of a zone abbreviation as meant in the mailbox's country, or None."""
    if abbr in UTC_NAMES:
        return 0
    own = (transitions(zone) or (None, None, {}))[2]
    if abbr in own:
        return own[abbr]
    if "A" + abbr in own:  # EST and EDT as Australians write them
        return own["A" + abbr]
    return ABBREVIATIONS[abbr] * 60 if abbr in ABBREVIATIONS else None


def parse(values: pd.Series, zones: pd.Series, orders: pd.Series) -> pd.Series:
    """Whole UTC seconds of each value, or null; zones and orders are those of the rows' mailboxes."""
    out = np.zeros(len(values), "int64")
    found = np.zeros(len(values), bool)
    text = [v.strip(_STRIP) if isinstance(v, str) else "" for v in values]
    zones, orders = zones.fillna("UTC").to_numpy(object), orders.fillna("dmy").to_numpy(object)
    shapes, kinds = pd.factorize(np.array([t.translate(_SHAPE) for t in text], dtype=object))
    place = np.argsort(shapes, kind="stable")
    bounds = np.searchsorted(shapes[place], np.arange(len(kinds) + 1))
    for k, shape in enumerate(kinds):
        if fit := layout(shape):
            at = place[bounds[k] : bounds[k + 1]]
            chars = np.array([text[i] for i in at], dtype=f"U{len(shape)}").view("U1").reshape(len(at), len(shape))
            for part, spans in _halves(fit[1], chars):
                out[at[part]], found[at[part]] = _convert(fit[0], spans, chars[part], zones[at[part]], orders[at[part]])
    return pd.Series(out).astype("Int64").where(found)


def _halves(spans: dict, chars: np.ndarray):
    """Rows and their fields; two letters after the time are half of the day in some values and a zone in others."""
    if "ap" not in spans or spans["ap"][1] - spans["ap"][0] != 2:
        return [(slice(None), spans)]
    a = spans["ap"][0]
    half = np.isin(chars[:, a], list("aApP")) & np.isin(chars[:, a + 1], list("mM"))
    zoned = {k: v for k, v in spans.items() if k not in ("ap", "abbr", "off", "name")} | {"abbr": spans["ap"]}
    return [(p, s) for p, s in ((half, spans), (~half, zoned)) if p.any()]


def _convert(kind: str, spans: dict, chars: np.ndarray, zones: np.ndarray, orders: np.ndarray):
    """Seconds and validity of the values of one shape."""
    n = len(chars)
    codes = chars.view("uint32").reshape(chars.shape).astype("int64")

    def number(k: str, default: int = 0):
        if k not in spans:
            return np.full(n, default, "int64")
        a, b = spans[k]
        v = np.zeros(n, "int64")
        for i in range(a, b):
            v = v * 10 + codes[:, i] - 48
        return v

    def words(k: str):
        a, b = spans[k]
        return np.ascontiguousarray(chars[:, a:b]).view(f"U{b - a}").ravel()

    if kind.startswith("epoch"):
        return number("e") // {"epoch": 1, "epoch_ms": 1000, "epoch_us": 10**6, "epoch_ns": 10**9}[kind], np.ones(n, bool)
    ok = np.ones(n, bool)
    if "t" in spans:
        ok &= np.char.upper(words("t")) == "T"
    y, m, d = number("y"), number("m"), number("d")
    if "y" in spans and spans["y"][1] - spans["y"][0] == 2:
        y += 2000
    if "mon" in spans:
        names, back = np.unique(words("mon"), return_inverse=True)
        m = np.array([MONTHS.get(str(w).lower().strip("."), 0) for w in names], "int64")[back]
    if "p" in spans:
        p, q, mdy = number("p"), number("q"), orders == "mdy"
        m, d = np.where(mdy, p, q), np.where(mdy, q, p)
    hour, minute, second = number("H"), number("M"), number("S")
    if "ap" in spans:
        ap = np.char.lower(words("ap"))
        am, pm = (ap == "am") | (ap == "a.m."), (ap == "pm") | (ap == "p.m.")
        ok &= (am | pm) & (hour >= 1) & (hour <= 12)
        hour = hour % 12 + 12 * pm
    days, real = _days(y, m, d)
    ok &= real & (hour <= 23) & (minute <= 59) & (second <= 59)
    local = days * 86400 + hour * 3600 + minute * 60 + second
    shift = np.zeros(n, "int64")
    if "off" in spans:
        a, b = spans["off"]
        sign = np.where(chars[:, a] == "-", -1, 1)
        fig = [codes[:, i] - 48 for i in range(a + 1, b) if chars[0, i] != ":"]
        hh = fig[0] * 10 + fig[1] if len(fig) != 3 else fig[0]
        mm = (fig[-2] * 10 + fig[-1]) if len(fig) > 2 else 0
        ok &= (hh <= 23) & (mm <= 59)
        return local - sign * (hh * 3600 + mm * 60), ok
    named = words("name") if "name" in spans else words("abbr") if "abbr" in spans else None
    if named is not None and "abbr" in spans:
        pairs, back = np.unique(np.char.add(np.char.add(np.char.upper(named), " "), zones.astype(str)), return_inverse=True)
        found = [_abbreviation(*str(p).split(" ", 1)) for p in pairs]
        ok &= np.array([f is not None for f in found], bool)[back]
        return local - np.array([f or 0 for f in found], "int64")[back], ok
    if named is not None:
        zones = named.astype(object)
    for z in set(zones):
        at = zones == z
        if t := transitions(str(z)):
            shift[at] = t[1][np.searchsorted(t[0], local[at], side="right")]
        else:
            ok &= ~at
    return local - shift, ok


def epoch_seconds(value: Column, zone: Column, order: Column) -> Column:
    """BIGINT UTC seconds of a timestamp string, null if it denotes none; Arrow batches, one parser a shape.

    Every worker checks that its zone tables are the driver's.
    """
    version = zone_table_version()

    def run(values: pd.Series, zones: pd.Series, orders: pd.Series) -> pd.Series:
        same_tables(version)
        return parse(values, zones, orders)

    return F.pandas_udf(run, T.LongType())(value, zone, order)


def sending_times(messages: DataFrame, mailboxes: DataFrame) -> DataFrame:
    """``seq``, ``epoch_s`` of every message whose ``msg_date`` denotes a possible date and time.

    Null, empty and unreadable dates give no row. A mailbox that is missing from ``mailboxes`` counts as UTC and
    day before month. The 23 mailboxes are broadcast only after their number has been checked.
    """
    box = small(mailboxes.select(F.col("mailbox").alias("_box"), F.col("tz_name").alias("_tz"), F.col("date_order").alias("_order")).dropDuplicates(["_box"]))
    rows = spread(messages.where(F.col("msg_date").isNotNull()).select("seq", "msg_date", "mailbox"))
    rows = rows.join(box, rows["mailbox"] == box["_box"], "left")
    return rows.select("seq", epoch_seconds(F.col("msg_date"), F.col("_tz"), F.col("_order")).alias("epoch_s")).where(F.col("epoch_s").isNotNull())
