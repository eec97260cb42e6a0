"""Text that was decoded with the wrong charset: found, and restored where it can be (problem 2).

Lines that agree once their non-ASCII characters are taken out are near-twins. Each is aligned with the most frequent
line of its group, segment by segment. A pair of charsets that turns every segment of one into that of the other is a
vote for that transformation and says which side is garbled. Where no known pair does, the segments are aligned
character by character and vote for single mappings, so that a charset nobody listed is learned as a table. What has
votes enough is then inverted on all lines. What an inversion yields counts if it is more usual in its surroundings than
what stands there, by counts of characters and their neighbours over the whole corpus. Characters that only twins can
give back (those lost as U+FFFD) come from the twin.
"""

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.sources.scratch import discard, save
from threadloom.sources.tables import spread

# Charsets that text may have been written in or read in.
CHARSETS = ["utf-8", "cp1252", "latin-1", "cp1251", "cp850", "cp437", "mac_roman", "koi8_r", "iso8859_2", "iso8859_5"]
#: Least letters a line must have left for its twins to be looked for, and least votes of a transformation, in lines and as a share of all votes.
SKELETON, VOTES, VOTE_SHARE = 8, 3, 1e-4
#: Least different characters that a learned table must restore, longest run of characters that stands for one of them,
#: least share of its votes that a mapping must have among those of the same run, and how much rarer than the original a single character must be.
TABLE, RUN, SURE, RARER = 4, 4, 0.8, 0.5
#: Least occurrences of a character that a restored text may hold, in lines and as a share of all characters outside ASCII.
MET, MET_SHARE = 3, 1e-7
#: Least letters of a line whose lost characters a twin may give back; the twin must yield the very line.
LOST_SKELETON = 4
#: Buckets of the table of neighbourhoods.
BUCKETS = 1 << 18

_NON = re.compile(r"[^\x00-\x7f]+")
_PREFIX, _END = re.compile(r"(?:[ \t>|:]|[A-Z]{1,3}>)*"), " \t\n\x0b\f\r"
_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_FRAME = " \t\r\n\"'()[]{},;:.!?/<>-=*|«»„“”‹›"


@lru_cache(64)
def _table(charset: str) -> dict:
    """Character -> byte of a single-byte charset; bytes without a character stand for the control with their number."""
    out = {}
    for b in range(128, 256):
        try:
            out.setdefault(bytes([b]).decode(charset), b)
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    return out


def _bytes(text: str, charset: str) -> bytes | None:
    """What ``text`` was read from in ``charset``, or None if it can't have been."""
    table = _table(charset)
    try:
        return bytes(ord(c) if ord(c) < 128 else table[c] for c in text)
    except KeyError:
        return None


def _read(data: bytes, charset: str) -> str | None:
    if charset == "utf-8":
        return data.decode("utf-8", "replace")
    back = {b: c for c, b in _table(charset).items()}
    return "".join(chr(b) if b < 128 else back.get(b, chr(b)) for b in data)


@lru_cache(300_000)
def garble(text: str, written: str, read: str) -> str | None:
    """``text`` written in one charset and read in another; ``utf-8+`` as the first does so twice."""
    if written == "utf-8+":
        once = garble(text, "utf-8", read)
        return garble(once, "utf-8", read) if once is not None else None
    data = text.encode("utf-8") if written == "utf-8" else _bytes(text, written)
    return None if data is None else _read(data, read)


TRANSFORMATIONS = [(w, r) for w in ["utf-8", "utf-8+", *CHARSETS[1:]] for r in CHARSETS if r != w.rstrip("+") and not (w[-1] == "+" and r == "utf-8") and {w, r} != {"cp1252", "latin-1"}]


def align(a: str, b: str) -> list[tuple[str, str, str, str]]:
    """(written, read, garbled, clean) of each aligned segment of two near-twins, or nothing if no transformation fits."""
    x, y = _NON.findall(a), _NON.findall(b)
    if x == y or len(x) != len(y) or _NON.split(a) != _NON.split(b):
        return []
    odd = [(s, t) for s, t in zip(x, y) if s != t]
    for bad, good in ((0, 1), (1, 0)):
        pairs = [(p[bad], p[good]) for p in odd]
        for w, r in TRANSFORMATIONS:
            if all(garble(g, w, r) == s for s, g in pairs):
                return [(w, r, s, g) for s, g in pairs]
    return []


def char_pairs(bad: str, clean: str) -> list[tuple[str, str]]:
    """What each character of the clean twin's segments stands as, where the runs can be divided evenly; else nothing."""
    x, y = _NON.findall(bad), _NON.findall(clean)
    if x == y or len(x) != len(y) or _NON.split(bad) != _NON.split(clean):
        return []
    out = set()
    for s, t in zip(x, y):
        if s != t:
            k, rest = divmod(len(s), len(t))
            if rest or not 1 <= k <= RUN or "�" in s + t:
                return []
            out |= {(s[i * k : i * k + k], c) for i, c in enumerate(t) if s[i * k : i * k + k] != c}
    return sorted(out)


def tables(votes: dict, together: list[tuple[str, str]], often, least: float = VOTES) -> dict[str, str]:
    """The mappings that make up tables of garbled runs: ``votes`` of (run, character), ``often``: how often a character occurs.

    Mappings belong together if their runs stand ``together`` in a line. A table must restore ``TABLE`` characters from
    as many runs; so variants in spelling, of which there are few, make none. A single character must moreover be rarer
    than what it stands for.
    """
    total: Counter = Counter()
    for (bad, _), n in votes.items():
        total[bad] += n
    sure = {bad: good for (bad, good), n in votes.items() if n >= least and n >= SURE * total[bad] and (len(bad) > 1 or often(bad) < RARER * often(good))}
    group = {bad: bad for bad in sure}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for x, y in together:
        if x in group and y in group:
            group[top(x)] = top(y)
    parts: dict = {}
    for bad, good in sure.items():
        parts.setdefault(top(bad), {})[bad] = good
    return {b: g for part in parts.values() if len(set(part.values())) >= TABLE for b, g in part.items()}


def _stripped(line: str):
    return F.regexp_replace(line, r"^(?:[ \t>|:]|[A-Z]{1,3}>)+|\s+$", "")


def lines(messages: DataFrame) -> DataFrame:
    """``line``, ``n``: the distinct lines with non-ASCII characters of texts and subjects, without quotation prefixes.

    Counted before they are shuffled, so a line that a third of all messages hold costs one row a task.
    """
    both = messages.select(F.explode(F.array("text", "subject")).alias("t")).where(F.col("t").rlike(r"[^\x00-\x7F]"))
    rows = both.select(F.explode(F.split("t", "\n")).alias("line")).where(F.col("line").rlike(r"[^\x00-\x7F]"))
    rows = rows.select(_stripped("line").alias("line"))
    return rows.groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def learn(counted: DataFrame, table: np.ndarray, votes: int = VOTES) -> tuple[list[tuple[str, str]], dict[str, str]]:
    """The transformations that near-twins show, most votes first, and the mappings of charsets that aren't listed.

    ``counted`` as :func:`lines` gives it, ``table`` as :func:`surroundings` does. Each line is paired with one
    representative of its group only. Two readings that undo each other fit the same pairs; the one with more votes
    stays. A transformation or mapping must have ``VOTE_SHARE`` of all votes, which bounds what is collected.
    """
    rows = counted.withColumn("bone", F.regexp_replace("line", r"[^\x00-\x7F]+", ""))
    rows = rows.where(F.regexp_count("bone", F.lit("[A-Za-z]")) >= SKELETON).withColumn("key", F.xxhash64("bone")).drop("bone")
    first = rows.groupBy("key").agg(F.max_by("line", F.struct("n", -F.length("line"), "line")).alias("twin"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    pairs = rows.join(first, "key").where("line <> twin").select("line", "twin")

    def run(batches):
        by: Counter = Counter()
        for df in batches:
            for a, b in zip(df["line"], df["twin"]):
                found = {("charsets", *x[:2]) for x in align(a, b)}
                if not found and (single := char_pairs(a, b)):
                    found = {("map", *x) for x in single} | {("with", single[0][0], x[0]) for x in single[1:]}
                for t in found:
                    by[t] += 1
        yield pd.DataFrame([(*k, n) for k, n in by.items()], columns=["kind", "w", "r", "n"])

    rows = save(pairs.mapInPandas(run, "kind STRING, w STRING, r STRING, n BIGINT").groupBy("kind", "w", "r").agg(F.sum("n").alias("n")), "votes")
    total = rows.agg(F.sum("n").alias("n")).collect()[0].n or 0
    least = max(votes, VOTE_SHARE * total)
    kept = rows.where(F.col("n") >= least).collect()
    discard(counted.sparkSession, rows)
    around = Surroundings(table)
    often = lambda c: table[around.alone(c)]
    return ranked({(x.w, x.r): x.n for x in kept if x.kind == "charsets"}, least), tables({(x.w, x.r): x.n for x in kept if x.kind == "map"}, [(x.w, x.r) for x in kept if x.kind == "with"], often, least)


def ranked(count: dict, votes: float = VOTES) -> list[tuple[str, str]]:
    """Transformations with enough votes, without those outvoted by their inverse."""
    kept = [t for t, n in count.items() if n >= votes and ("utf-8" in t or (n, t) > (count.get(t[::-1], 0), t[::-1]))]
    return sorted(kept, key=lambda t: (-count[t], t))


def _near(c: str) -> str:
    return c.lower() if c.isascii() and c.isalpha() else "0" if c.isdigit() else " " if c.isspace() or c in ">|:" else c if c in "'’-" else "." if c.isascii() else "é" if c.isalpha() else "."


def _bucket(a: str, c: str, b: str) -> int:
    h = (ord(a) * 1_000_003 + ord(c)) * 1_000_003 + ord(b)
    h ^= h >> 17
    return (h * 0x9E3779B97F4A7C15 >> 20) % BUCKETS


class Surroundings:
    """Counts of non-ASCII characters, alone and between their neighbours."""

    def __init__(self, table: np.ndarray | None = None):
        self.table, self.at = np.zeros(BUCKETS) if table is None else table, {}

    def place(self, a: str, c: str, b: str) -> int:
        k = (_near(a), c, _near(b))
        if (i := self.at.get(k)) is None:
            if len(self.at) > 500_000:
                self.at.clear()
            i = self.at[k] = _bucket(*k)
        return i

    def alone(self, c: str) -> int:
        k = (c,)
        if (i := self.at.get(k)) is None:
            i = self.at[k] = _bucket("\0", c, "\0")
        return i

    def add(self, text: str, n: int = 1) -> None:
        t = " " + text + " "
        for m in _NON.finditer(t):
            for i in range(*m.span()):
                self.table[self.place(t[i - 1], t[i], t[i + 1])] += n
                self.table[self.alone(t[i])] += n

    def usual(self, t: str, i: int) -> float:
        """Log of how often the character of ``t`` at ``i`` has its neighbours, less a trifle where only it alone is known."""
        n = self.table[self.place(t[i - 1], t[i], t[i + 1])]
        return float(np.log(n + 0.3 * min(1.0, self.table[self.alone(t[i])] / 1e3) + 0.01))


def surroundings(counted: DataFrame) -> np.ndarray:
    """The table over all lines, as :func:`lines` counts them; each task sends one vector of fixed size at most."""

    def run(batches):
        s = Surroundings()
        for df in batches:
            for t, n in zip(df["line"], df["n"]):
                s.add(t, n)
        at = np.flatnonzero(s.table)
        yield pd.DataFrame({"b": at.astype("int32"), "n": s.table[at]})

    total = counted.mapInPandas(run, "b INT, n DOUBLE").groupBy("b").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS)
    out[total["b"]] = total["n"]
    return out


class Repair:
    """Finds and restores garbled lines by learned transformations and tables."""

    def __init__(self, learned: list[tuple[str, str]], table: np.ndarray, mapped: dict[str, str] | None = None):
        self.around, self.mapped = Surroundings(table), mapped or {}
        self.run = re.compile("|".join(map(re.escape, sorted(self.mapped, key=lambda x: (-len(x), x)))) or r"(?!)")
        self.met = max(MET, MET_SHARE * float(table.sum()) / 2)
        reads = [r for w, r in learned if w.startswith("utf-8") and r != "utf-8"]
        self.multi = list(dict.fromkeys(["cp1252" if r == "latin-1" else r for r in reads]))
        self.single = [(w, r) for w, r in learned if not w.startswith("utf-8") and r != "utf-8"]
        self.lost = any(r == "utf-8" for _, r in learned)
        # first characters of the sequences that each charset makes of UTF-8
        self.lead = {r: re.compile("[" + "".join(re.escape(c) for c, b in _table(r).items() if 0xC2 <= b <= 0xF4) + "][^\x00-\x7f]") for r in self.multi}
        self.any_lead = re.compile("|".join(p.pattern for p in self.lead.values()) or r"(?!)")
        # of a single-byte reading only characters whose originals the corpus knows; a garbled line has one whose original is the more frequent
        self.turn, self.hot, self.known = {}, {}, {}
        often = lambda c: table[self.around.alone(c)]
        for w, r in self.single:
            turn = {c: _back(b, w) for c, b in _table(r).items()}
            turn = {c: g for c, g in turn.items() if g != "�" and often(g) >= max(self.met, 0.05 * often(c))}
            if hot := [c for c, g in turn.items() if often(g) > often(c)]:
                self.turn[w, r] = turn
                self.hot[w, r] = re.compile("[" + "".join(map(re.escape, hot)) + "]")
        self.any_hot = re.compile("|".join(p.pattern for p in self.hot.values()) or r"(?!)")

    def _invert(self, line: str, read: str, any_: bool = False) -> tuple[str, list[tuple[int, str]]]:
        """The line with all UTF-8 sequences read in ``read`` put right, and what came out where: characters that the corpus knows, or ``any_``."""
        out, got, last = [], [], 0
        table = _table(read)
        if read == "cp1252":
            table = _table("latin-1") | table
        for m in _NON.finditer(line):
            run = m[0]
            data = bytearray(table.get(c, 0x20) if ord(c) != 0xFFFD else 0x20 for c in run)
            at = 0
            out.append(line[last : m.start()])
            for s in _UTF8.finditer(bytes(data)):
                c = s[0].decode("utf-8", "ignore")
                out.append(run[at : s.start()])
                if c and (any_ or self.around.table[self.around.alone(c)] >= self.met):
                    got.append((sum(map(len, out)), c))
                    out.append(c)
                else:
                    out.append(run[s.start() : s.end()])
                at = s.end()
            out.append(run[at:])
            last = m.end()
        out.append(line[last:])
        return "".join(out), got

    def line(self, line: str) -> tuple[str, str | None]:
        """The restored line, and how it was garbled, or None if it wasn't."""
        if (out := self.known.get(line)) is None:
            if len(self.known) > 200_000:
                self.known.clear()
            out = self.known[line] = self._line(line)
        return out

    def _line(self, line: str) -> tuple[str, str | None]:
        lost = "�" in line and self.lost
        best = None
        if self.any_lead.search(line):
            for r in self.multi:
                if self.lead[r].search(line):
                    fixed, got = self._invert(line, r)
                    if got and (best is None or len(got) > len(best[1])):
                        best = (fixed, got, r)
        if lost and (best is None or not _shown(line, best[0], best[1])) and _lost(line, best is not None):
            return (best[0] if best else line), "utf-8"
        if best:
            fixed, got, r = best
            if _shown(line, fixed, got):
                return line, None
            again, more = self._invert(fixed, r) if self.lead[r].search(fixed) else (fixed, [])
            # garbled twice: what stands between the two readings needn't be known
            if self.lead[r].search(between := self._invert(line, r, True)[0]):
                whole, got = self._invert(between, r)
                if got and not self.lead[r].search(whole):
                    again, more = whole, got
            return (again if more else fixed), r
        if self.mapped and self.run.search(line) and (by_table := self._by_table(line)):
            return by_table, "table"
        if not self.any_hot.search(line):
            return line, None
        t = " " + line + " "
        spots = [i for i, c in enumerate(t) if ord(c) > 127]
        worst = None
        for k, table in self.turn.items():
            if self.hot[k].search(line) and all(t[i] in table for i in spots):
                u = "".join(table.get(c, c) if ord(c) > 127 else c for c in t)
                gain = sum(self.around.usual(u, i) - self.around.usual(t, i) for i in spots)
                met = any(self.around.table[self.around.place(u[i - 1], u[i], u[i + 1])] > 0 for i in spots)
                if met and gain > 2.0 + 0.3 * len(spots) and (worst is None or gain > worst[0]):
                    worst = (gain, u[1:-1], "/".join(k))
        return (worst[1], worst[2]) if worst else (line, None)


    def _by_table(self, line: str) -> str | None:
        """The line with all runs of learned tables replaced, if that is more usual and no example."""
        t = " " + line + " "
        out, got, last = [], [], 0
        for m in self.run.finditer(t):
            out.append(t[last : m.start()])
            got.append((sum(map(len, out)), self.mapped[m[0]], m.start(), m.end()))
            out.append(self.mapped[m[0]])
            last = m.end()
        u = "".join([*out, t[last:]])
        if _shown(line, u[1:-1], [(i - 1, c) for i, c, *_ in got]):
            return None
        gain = sum(self.around.usual(u, i) - min(self.around.usual(t, k) for k in range(a, b)) for i, _, a, b in got)
        return u[1:-1] if gain > 2.0 * min(1.0, len(got)) + 0.3 * len(got) else None


def _back(b: int, written: str) -> str:
    for c, x in _table(written).items():
        if x == b:
            return c
    return "�"


def _alone(line: str, a: int, b: int) -> bool:
    return (a == 0 or line[a - 1] in _FRAME) and (b >= len(line) or line[b] in _FRAME)


def _lost(line: str, other: bool) -> bool:
    """Whether U+FFFD stands for lost characters and isn't, beside another sequence, just spoken of."""
    spots = [m.span() for m in re.finditer("�+", line)]
    return not other or any(not _alone(line, *s) for s in spots) or len(spots) > 1


def _shown(line: str, fixed: str, got: list[tuple[int, str]]) -> bool:
    """Whether the sequences are examples in a line that is otherwise right.

    They are if one or two stand alone and the line also has the right character, or a lost one, standing alone, or if
    a single quotation mark stands between words.
    """
    if len(got) > 2 or any(not _alone(fixed, i, i + 1) for i, _ in got):
        return False
    at, chars = {i for i, _ in got}, [c for _, c in got]
    if len(set(chars)) < len(chars):
        return False
    others = {c for i, c in enumerate(fixed) if i not in at and ord(c) > 127 and _alone(fixed, i, i + 1)}
    if others & {*chars, "�"}:
        return True
    i, c = got[0]
    return len(got) == 1 and c in "“”„’‘" and fixed[i - 1 : i] == " " and fixed[i + 1 : i + 2] == " "


def lost_form(lost: str, clean: str) -> bool:
    """Whether ``clean``, its segments written in one charset and read as UTF-8, gives ``lost``; equal segments may stand."""
    x, y = _NON.findall(lost), _NON.findall(clean)
    if len(x) != len(y) or _NON.split(lost) != _NON.split(clean):
        return False
    odd = [(s, t) for s, t in zip(x, y) if s != t]
    return bool(odd) and any(all(garble(t, w, "utf-8") == s for s, t in odd) for w in CHARSETS[1:])


def agreed(lost: str, twins: list[str]) -> str:
    """``lost`` with the segments on which all twins agree."""
    found = [_NON.findall(t) for t in twins]
    new = iter([s[0] if len(set(s)) == 1 else x for x, *s in zip(_NON.findall(lost), *found)])
    return _NON.sub(lambda _: next(new), lost)


def recovered(counted: DataFrame, learned: list[tuple[str, str]], table: np.ndarray, mapped: dict[str, str]) -> DataFrame:
    """``line``, ``fixed`` of the lines with U+FFFD that have clean twins, by shuffled joins on the skeleton."""
    bone = F.regexp_replace("line", r"[^\x00-\x7F]+", "\x01")
    rows = counted.where("line is not null").withColumn("bone", bone).where(F.regexp_count("bone", F.lit("[A-Za-z]")) >= LOST_SKELETON).withColumn("key", F.xxhash64("bone"))
    is_lost = F.contains(F.col("line"), F.lit("�"))
    pairs = rows.where(is_lost).select("key", "line").join(rows.where(~is_lost).select("key", F.col("line").alias("twin")), "key").select("line", "twin")
    sent = counted.sparkSession.sparkContext.broadcast((learned, table, mapped))

    def run(batches):
        repair = Repair(*sent.value)
        for df in batches:
            kept = [lost_form(a, b) and repair.line(b)[1] is None for a, b in zip(df["line"], df["twin"])]
            yield df[kept]

    fixed = F.pandas_udf(lambda a, b: pd.Series([agreed(x, list(y)) for x, y in zip(a, b)], dtype="object"), "string")
    out = pairs.mapInPandas(run, "line STRING, twin STRING").groupBy("line").agg(F.collect_set("twin").alias("twins"))
    return out.select("line", fixed("line", "twins").alias("fixed")).where("fixed <> line")


def _core(line: str) -> tuple[str, str, str]:
    """Quotation prefix, line as :func:`lines` counts it, and blanks after it."""
    start = _PREFIX.match(line).end()
    core = line[start:].rstrip(_END)
    return line[:start], core, line[start + len(core) :]


def examine(messages: DataFrame, twins: bool = True) -> DataFrame:
    """``seq``, ``field_name``, ``restored`` of every text and subject that was decoded wrongly, all or in part.

    ``restored`` is the field with all that can be put right put right; what is lost comes from the clean ``twins`` of its
    line, and stays U+FFFD where there are none or they disagree. Null and empty fields are none, copies are given as often
    as they stand, foreign scripts and sequences shown as examples are none.
    """
    spark = messages.sparkSession
    counted = save(lines(messages), "lines")
    table = surroundings(counted)
    learned, mapped = learn(counted, table)
    known = save(recovered(counted, learned, table, mapped), "twins") if twins else None
    discard(spark, counted)
    sent = spark.sparkContext.broadcast((learned, table, mapped))

    def run(batches):
        repair = Repair(*sent.value)
        for df in batches:
            rows = []
            for seq, name, text, pairs in zip(df["seq"], df["field_name"], df["t"], df["twins"] if twins else [None] * len(df)):
                out, found = [], False
                clean = dict(x.split("\n") for x in pairs) if pairs is not None else {}
                for line in text.split("\n"):
                    if not line.isascii():
                        was = line
                        line, how = repair.line(line)
                        found |= how is not None
                        if how is not None and clean:
                            before, core, after = _core(was)
                            if core in clean:
                                line = repair.line(before + clean[core] + after)[0]
                    out.append(line)
                if found:
                    rows.append((seq, name, "\n".join(out)))
            yield pd.DataFrame(rows, columns=["seq", "field_name", "restored"])

    fields = messages.select("seq", F.explode(F.map_from_arrays(F.array(F.lit("text"), F.lit("subject")), F.array("text", "subject"))).alias("field_name", "t")).where(F.col("t").rlike(r"[^\x00-\x7F]"))
    schema = "seq BIGINT, field_name STRING, restored STRING"
    if not twins:
        return spread(fields).mapInPandas(run, schema)
    # only fields with lost characters meet the twins' table, which grows with the corpus
    is_lost = F.contains(F.col("t"), F.lit("�"))
    lost = fields.where(is_lost)
    each = lost.select("seq", "field_name", F.explode(F.split("t", "\n")).alias("line")).where(F.contains(F.col("line"), F.lit("�"))).withColumn("line", _stripped("line")).distinct()
    pairs = each.join(known, "line").groupBy("seq", "field_name").agg(F.collect_list(F.concat_ws("\n", "line", "fixed")).alias("twins"))
    lost = lost.join(pairs, ["seq", "field_name"], "left")
    return spread(fields.where(~is_lost).withColumn("twins", F.lit(None).cast("array<string>"))).mapInPandas(run, schema).unionByName(lost.mapInPandas(run, schema))
