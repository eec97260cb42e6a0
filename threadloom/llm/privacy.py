"""Personal information in mail texts: found, and replaced by typed placeholders or surrogates (problem 4).

E-mail addresses (also disguised), telephone numbers, national person numbers, streets with house numbers and names
are found by their written forms. What is a given name and how family names end is learned from the senders' names of
all messages. A replacement depends on a key and on the item alone, so it is the same wherever the item recurs. A
placeholder has a type and a keyed code of 96 bits (:func:`clashes` shows items that share one). A surrogate has the
type, format, case, script and gender of what it replaces. Names are replaced part by part, given name by given name of
the same gender and family name by family name, so that a person stays the same in every order and case; initials follow
the given names. Surrogates of distinct items are distinct by bijections or, for names and streets, by a check over all.
"""

import hashlib
import hmac
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.sources.scratch import discard, save
from threadloom.sources.tables import spread

#: Least families a given name must stand with, and least families an ending (or given names a short family name) must have.
GIVEN, ENDING = 2, 2
#: Least share of all pairs of given and family name that an entry of the learned lists must have, so each has 50 000 at most.
SHARE = 1 / 50_000
#: Given names up to which one pattern holds them all; beyond, patterns hold those that stand nearby.
PATTERN = 400
#: Bytes of an item's code.
CODE = 12

X = "\u0080-￿"  # accented letters, and whatever stands for them in wrongly decoded text
_SEP = r"(?: |\r?\n(?:[>|:»] ?)*)"
_EMAIL = re.compile(
    r"(?<![\w.+@-])(?:(?P<a>[A-Za-z0-9][\w.+-]*)@(?P<b>(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"
    r"|[A-Za-z0-9][\w.+-]* ?(?:\((?:at|AT|arobase|arroba|a)\)|\[(?:at|AT|arobase|arroba)\]|\{at\}| AT | at (?=\S+ dot )) ?[A-Za-z0-9-]+(?:(?:\.| ?(?:\((?:dot|DOT|punkt|punto|point)\)|\[(?:dot|DOT|punkt|punto|point)\]|\{dot\}) ?| DOT | dot )[A-Za-z0-9-]+)*(?:\.| ?(?:\((?:dot|DOT|punkt|punto|point)\)|\[(?:dot|DOT|punkt|punto|point)\]|\{dot\}) ?| DOT | dot )[A-Za-z]{2,})(?![\w@-])",
    re.ASCII,
)
#: Hosts and forms of message identifiers, which are not addresses.
_MESSAGE_ID = re.compile(r"(?:^|\.)(?:mta|mx\d*|desk-\d+)(?:\.|$)|^[^@]*\d{4,}\.[0-9a-z]{3,}@", re.I)
_DIGITS = re.compile(r"(?<![\w.,/:#$-])[+(]?\d[\d ().\-/]{6,}\d(?:[ -]?[A-Z]\b)?(?!\w)", re.ASCII)
_NINO = re.compile(r"(?<!\w)[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D](?!\w)", re.ASCII)
_ID = re.compile(
    r"\d{3}([- ])\d{2}\1\d{4}|[12]([ .]?)\d\d\2\d\d\2\d\d\2\d{3}\2\d{3}(?:\2\d\d)?|[1-9]\d \d{3} \d{3} \d{3}|[1-9]\d{10}|\d{8}[ -]?[A-Z]|\d\d\.\d{3}\.\d{3}[ -]?[A-Z]"
)
_NIE = re.compile(r"(?<!\w)[XYZ]-?\d{7}-?[A-Z](?!\w)", re.ASCII)
_PHONE = re.compile(
    r"(?:(?:\+33|0033) ?\(?0?\)? ?|0)[1-9](?:[ .-]?\d\d){4}|(?:(?:\+44|0044) ?\(?0?\)? ?\(?7\d{3}\)?|\(?07\d{3}\)?)[ -]?\d{3}[ -]?\d{3}"
    r"|(?:(?:\+1|1)[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[.-]\d{4}|\+1 \d{3} \d{3} \d{4}|(?:(?:\+34|0034) ?)?[6-9]\d{2}(?:([ .-]?)\d{3}\1\d{3}|([ .-])\d\d\2\d\d\2\d\d)"
    r"|(?:(?:\+49|0049) ?\(?0?\)?\d{2,4}|\(0\d{2,4}\)|0\d{2,4})[ /-]?\d{4,6}[ -]?\d{2,4}|\+\d{1,3}(?:[ .-]?\(?\d{2,5}\)?){2,5}"
)
# Kinds of streets.
_EN = "Street|Road|Lane|Drive|Close|Court|Avenue|Rd|St|Ave|Ln|Dr|Square|Way|Terrace|Place|Hill|Crescent|Boulevard|Blvd|Row|Gardens"
_FR = f"rue|avenue|av\\.|boulevard|bd|impasse|place|chemin|quai|all[{X}]{{1,6}}e|allee|route|cours|square|passage|ruelle"
_DE = f"stra(?:[{X}]{{1,6}}|ss)e|str\\.|stra(?:[{X}]{{1,6}}|ss)e|platz|weg|allee|gasse|ring|damm|ufer|steig|markt"
_ES = "C/|Calle|Avenida|Avda\\.?|Av\\.|Plaza|Pza\\.?|Paseo|P[ºo]|Camino|Ronda|Traves[^ \\d]{1,6}a|Carrera"
_STREET = re.compile(
    rf"(?<![\w./:#-])\d{{1,4}}(?: ?(?:bis|ter|[a-dA-D]))?,?{_SEP}(?:(?:[A-Z][a-z{X}'’-]+{_SEP}){{1,3}}(?:{_EN})\b\.?|(?:{_FR}){_SEP}(?:(?:de{_SEP}la|de{_SEP}l['’]|des|du|de|d['’]|l['’]){_SEP}?)?[A-Z{X}][\w{X}'’-]*(?:[ -][A-Z][\w{X}'’-]*)*)"
    rf"|(?<![\w{X}])[A-Z{X}][a-z{X}-]*(?:{_DE}){_SEP}\d{{1,4}}(?: ?[a-d]\b)?"
    rf"|(?<![\w{X}])(?:{_ES}){_SEP}?(?:(?:de{_SEP}las?|de{_SEP}los|del|de){_SEP})?[A-Z{X}][\w{X}'’-]*(?:{_SEP}[A-Z{X}][\w{X}'’-]*)*,?{_SEP}(?:n[º°.] ?|núm\. )?\d{{1,4}}(?: ?[a-d]\b)?"
)
_PARTICLE = "de la |de los |de |del |du |von der |von |van der |van |di "


def item(written: str) -> str:
    """Lower-cased, without all but a-z and 0-9."""
    return re.sub("[^a-z0-9]", "", written.lower())


_WORD = re.compile(r"[^\W\d_]{5,}")
_SHORT = re.compile(r"[a-z]+")
_INITIAL = re.compile(r"(?<![A-Za-z])[A-Z]\.")


def loose_key(w: str) -> str:
    """A word by which it is looked up: a letter outside ASCII may have become several characters."""
    return _NOT_ASCII.sub("*", w.lower())


_NOT_ASCII = re.compile(rf"[{X}]+")
_ANY_WORD = re.compile(rf"[A-Za-z{X}]+")


def _loose(w: str) -> str:
    return _NOT_ASCII.sub(lambda _: rf"[{X}]{{1,8}}", re.sub(r"(?<=\w) (?=\w)", "_", w)).replace("_", _SEP)


@lru_cache(4_000)
def _name_patterns(given: tuple, tails: tuple, short: tuple):
    """Patterns of a full name and of a given name alone."""
    forms = sorted({_loose(g) for g in given}, key=len, reverse=True)
    second = rf"(?:[- ](?:Marie|Maria|Mar[{X}]{{1,8}}a|Jean|Paul))?"
    first = rf"(?i:(?:{'|'.join(forms) or '(?!)'}){second})"
    ends = "|".join(sorted(map(re.escape, tails), key=len, reverse=True)) or "(?!)"
    part = "|".join(p.strip().replace(" ", _SEP) + _SEP for p in _PARTICLE.split("|"))
    whole = "|".join(sorted({_loose(f) for f in short}, key=len, reverse=True)) or "(?!)"
    family = rf"(?i:(?:{part})?(?:[A-Z{X}]+(?:{ends})|(?:{whole})(?![A-Za-z{X}]))(?:-[A-Z{X}]{{4,}})?)"
    full = rf"(?<![\w@.])(?:{first}{_SEP}{family}|{family},?{_SEP}{first}|[A-Z{X}]\.(?:-?[A-Z]\.)?{_SEP}?{family})(?![\w@]|[.-]\w)"
    return re.compile(full), re.compile(rf"{first}$")


class Names:
    """Finds personal names by learned given names and endings of family names; ``^kim`` among the endings is a whole short name."""

    def __init__(self, given_names, endings):
        self.endings = frozenset(e.lower() for e in endings if e[:1] != "^")
        self.short = frozenset(e[1:].lower() for e in endings if e[:1] == "^")
        self.given = tuple(given_names)
        self.keys: dict = {}
        for g in self.given:
            self.keys.setdefault(loose_key(g.split()[0]), []).append(g)
        self.full = self.given_line = None
        if self.given:
            self.full, self.given_line = _name_patterns(self.given if len(self.given) <= PATTERN else (), tuple(sorted(self.endings)), tuple(sorted(self.short)))
        self.first = frozenset(w for g in self.given for w in g.lower().split() if w.isascii())

    def is_given(self, line: str) -> bool:
        """Whether a line is a given name alone."""
        if len(self.given) <= PATTERN:
            return self.given_line is not None and self.given_line.match(line) is not None
        m = _ANY_WORD.match(line)
        near = tuple(self.keys.get(loose_key(m[0]), ())) if m else ()
        return bool(near) and _name_patterns(near, (), ())[1].match(line) is not None

    def _pattern(self, near: str, word: str):
        if len(self.given) <= PATTERN:
            return self.full
        given = {g for w in _ANY_WORD.findall(near) for g in self.keys.get(loose_key(w), ())}
        tail = word[-4:].lower()
        return _name_patterns(tuple(sorted(given)), (tail,) if tail in self.endings else (), (word.lower(),) if word.lower() in self.short else ())[0]

    def find(self, text: str):
        """(start, end) of every name; looked for around words that are a short family name or have the ending of one."""
        if self.full is None:
            return
        at, endings, short = 0, self.endings, self.short
        for m in (_ANY_WORD if short else _WORD).finditer(text):
            if (m[0][-4:].lower() in endings and len(m[0]) > 4 or short and m[0].lower() in short) and m.start() >= at:
                lo, hi = max(at, m.start() - 40), min(len(text), m.end() + 40)
                near = text[lo:hi]
                if near.isascii() and self.first.isdisjoint(_SHORT.findall(near.lower())) and not _INITIAL.search(near):
                    continue
                for n in self._pattern(near, m[0]).finditer(text, lo, hi):
                    if n.start() < m.end() and n.end() > m.start():
                        yield n.span()
                        at = n.end()
                        break


def _numbers(text: str):
    for m in _DIGITS.finditer(text):
        s = m[0]
        bare = s.rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ").rstrip(" -")
        if hit := _ID.fullmatch(s) or (_ID.fullmatch(bare) if bare != s else None):
            yield "id_number", m.start(), m.start() + len(hit[0])
        elif _PHONE.fullmatch(bare):
            yield "phone", m.start(), m.start() + len(bare)
        else:
            for part in re.finditer(r"\S.*?(?=  |$)", bare):
                if (hit := _PHONE.match(part[0])) and hit.end() >= len(part[0]):
                    yield "phone", m.start() + part.start(), m.start() + part.end()


def entities(text: str, names: Names) -> list[tuple[int, int, str]]:
    """Start, end and kind of every item of a text, in order, none within another."""
    found = []
    if "@" in text or " AT " in text or "at)" in text or "at]" in text or " at " in text or "arrob" in text or "arobase" in text:
        for m in _EMAIL.finditer(text):
            if m["a"] is None or not (_MESSAGE_ID.search(m["b"]) or _MESSAGE_ID.search(m[0])):
                found.append((*m.span(), "email"))
    found += [(a, b, k) for k, a, b in _numbers(text)]
    found += [(*m.span(), "id_number") for p in (_NINO, _NIE) for m in p.finditer(text)]
    found += [(*m.span(), "street") for m in _STREET.finditer(text)]
    found += [(*s, "name") for s in names.find(text)]
    found.sort(key=lambda x: (x[0], -x[1]))
    out = []
    for x in found:
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def learn_names(messages: DataFrame, given: int = GIVEN, ending: int = ENDING, share: float = SHARE) -> tuple[list[str], list[str]]:
    """Given names, and the last four letters of family names (shorter ones whole, with ``^``), from all senders' names.

    Senders are counted before they are shuffled. An entry must have the ``share`` of all pairs of given and family name,
    which bounds the lists whatever the number of senders; on fewer than 100 000 pairs that asks for nothing.
    """
    n = F.regexp_replace(F.trim(F.regexp_replace("from_name", '["“”]', "")), r"\s+", " ")
    n = F.regexp_replace(n, r"^([^,]+), (.+)$", "$2 $1")
    shape = r"^(\p{Lu}[\p{Ll}'’]+(?:[- ](?:Mar[^\s]{1,3}))?) (?:de la |de los |de |del |du |von der |von |van der |van |di )?((?:\p{Lu}[\p{L}'’]+)(?:-\p{Lu}[\p{L}'’]+)*)$"
    people = messages.where("from_name is not null").select("from_name").distinct().select(n.alias("n"))
    people = people.select(F.regexp_extract("n", shape, 1).alias("g"), F.lower(F.regexp_extract("n", shape, 2)).alias("f")).where("g <> ''")
    people = people.withColumn("g", F.regexp_replace("g", r"[- ]Mar[^\s]{1,3}$", ""))
    people = people.distinct()
    both = people.select(F.explode(F.array(F.struct(F.lit("g").alias("k"), F.col("g").alias("x"), F.col("f").alias("y")), F.struct(F.when(F.length("f") < 5, "f").otherwise("e").alias("k"), F.when(F.length("f") < 5, F.col("f")).otherwise(F.expr("right(f, 4)")).alias("x"), F.when(F.length("f") < 5, F.col("g")).otherwise(F.col("f")).alias("y")))).alias("s")).select("s.*")
    counted = both.groupBy("k", "x").agg(F.count(F.lit(1)).alias("pairs"), F.approx_count_distinct("y").alias("m"))
    counted = save(counted, "names")
    least = share * (counted.where("k = 'g'").agg(F.sum("pairs").alias("n")).collect()[0].n or 0)
    rows = counted.where((F.col("m") >= F.when(F.col("k") == "g", given).otherwise(ending)) & (F.col("pairs") >= least)).orderBy(F.desc("m"), "x").collect()
    discard(messages.sparkSession, counted)
    return [r.x for r in rows if r.k == "g"], [r.x if r.k == "e" else "^" + r.x for r in rows if r.k != "g"]


@lru_cache(2)
def _names(given: tuple, endings: tuple) -> Names:
    return Names(given, endings)


def find(messages: DataFrame, lists: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """``seq``, ``kind``, ``item``: the distinct items of every text; null and empty texts have none."""
    given, endings = lists or learn_names(messages)

    def run(batches):
        names = _names(tuple(given), tuple(endings))
        for df in batches:
            rows = set()
            for seq, text in zip(df["seq"], df["text"]):
                rows.update((seq, k, i) for a, b, k in entities(text, names) if (i := item(text[a:b])))
            yield pd.DataFrame(sorted(rows), columns=["seq", "kind", "item"])

    return spread(messages.where("text is not null").select("seq", "text")).mapInPandas(run, "seq BIGINT, kind STRING, item STRING")


def code(kind: str, what: str, key: str, size: int = CODE) -> str:
    """The item's keyed code."""
    return hmac.new(key.encode(), f"{kind}:{what}".encode(), hashlib.sha256).hexdigest()[: 2 * size]


#: Syllables of three letters, so that a word of them can be taken apart in one way only.
SYLLABLES = [a + b + c for a in "bcdfghjklmnprstvwxyz" for b in "aeiou" for c in "bdfgklmnrs"]
# Given names of women that don't end in a, and of men that do.
FEMALE = "Aurélie Hélène Noémie Solène Sylvie Camille Margaux Zoé Alice Irene Megan Judith Anke Birgit Heike Silke Ulrike Käthe Renate Inés Pilar Rocío Amparo Agnes Carmen Charlotte Chloé Claire Elisabeth Emily Ingrid Isabel Jane Joanne Karen Margaret Marion Ruth Sarah Susan".split()
MALE = "Luca Andrea Nikita Sascha Mika Ilya Elia Joshua Ezra Noa Misha Kolja Attila Costa Nicola".split()
_FEMALE, _MALE = frozenset(map(loose_key, FEMALE)), frozenset(map(loose_key, MALE))
_PARTICLES = frozenset("de la los las del du von der van di d l".split())


@lru_cache(1 << 17)
def permuted(kind: str, text: str, key: str) -> str:
    """``text`` of a-z and 0-9 as another of the same shape: a keyed bijection (Feistel steps, repeated until in range), so different texts stay different."""
    shape = re.sub("[a-z]", "a", re.sub("[0-9]", "0", text))
    value, size = 0, 1
    for c in text:
        base = 10 if c.isdigit() else 26
        value, size = value * base + (int(c) if c.isdigit() else ord(c) - 97), size * base
    half = (size.bit_length() + 1) // 2
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for i in range(8):
            mixed = hashlib.shake_256(f"{len(key)}:{key}:{kind}:{shape}:{i}:{right}".encode()).digest(half // 8 + 1)
            left, right = right, left ^ int.from_bytes(mixed) & mask
        value = left << half | right
        if value < size:
            break
    out = []
    for c in reversed(shape):
        value, d = divmod(value, 10 if c == "0" else 26)
        out.append(str(d) if c == "0" else chr(97 + d))
    return "".join(reversed(out))


def drawn(kind: str, what: str, key: str, again: int = 0, space: int | None = None) -> int:
    """The number of the made-up word that stands for a part of a name or a street; ``again`` gives another."""
    number = int.from_bytes(hmac.new(key.encode(), f"w{again}:{kind}:{what}".encode(), hashlib.sha256).digest())
    return number % (space or len(SYLLABLES) ** (3 if kind == "given" else 4))


@lru_cache(64)
def _letters(block: int) -> str:
    """The small or only letters of a block of 256 characters; those of Han all."""
    if 0x4E <= block <= 0x9F:
        return "".join(map(chr, range(0x4E00, 0x9FA0)))
    return "".join(chr(c) for c in range(block << 8, (block << 8) + 256) if unicodedata.category(chr(c)) in ("Ll", "Lo"))


def made_word(number: int, like: str, syllables: int = 4) -> str:
    """The word of a number in the script of ``like``, another for each number."""
    c = next((c for c in like if c.isalpha()), "a")
    if ord(c) < 0x250:
        return "".join(SYLLABLES[number // len(SYLLABLES) ** i % len(SYLLABLES)] for i in range(syllables))
    letters = _letters(ord(c) >> 8)
    out = []
    while number or len(out) < 2:
        number, d = divmod(number, len(letters))
        out.append(letters[d])
    return "".join(out)


def is_female(given: str) -> bool:
    k = loose_key(given)
    return k in _FEMALE or k[-1:] in "aаα" and k not in _MALE


def name_parts(written: str, names: Names) -> list[tuple[int, int, str]]:
    """Start, end and role (``given``, ``family``, ``initial``) of the parts of a name; particles have none."""
    words = [m.span() for m in re.finditer(r"[^\W\d_]+", written)]
    comma = written.find(",")
    given = lambda a, b: loose_key(written[a:b]) in names.keys
    core = [(a, b) for a, b in words if b - a > 1 and written[a:b].lower() not in _PARTICLES]
    # where the given names stand: after a comma, last after a family name, else first
    last = len(core) > 1 and not given(*core[0]) and given(*core[-1])
    out = []
    for i, (a, b) in enumerate(words):
        if written[a:b].lower() in _PARTICLES and len(words) > 1 and written[b : b + 1] != ".":
            continue
        if b - a == 1 and written[b : b + 1] == ".":
            role = "initial"
        elif 0 <= comma:
            role = "given" if a > comma else "family"
        elif len(core) == 1:
            role = "given" if given(a, b) and not any(r == "initial" for *_, r in out) else "family"
        elif last:
            role = "given" if (a, b) == core[-1] else "family"
        else:
            second = written[a:b].lower() in ("marie", "maria", "jean", "paul") or loose_key(written[a:b]) == "mar*a"
            role = "given" if (a, b) == core[0] and not any(r == "initial" for *_, r in out) or second and (a, b) in core[1:2] and len(core) > 2 else "family"
        out.append((a, b, role))
    return out


def _cased(word: str, like: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word if like.islower() else word[:1].upper() + word[1:]


def surrogate_name(written: str, names: Names, key: str, again: dict) -> str:
    """Each part replaced where it stands, so that order, signs and case stay."""
    out, at = [], 0
    for a, b, role in name_parts(written, names):
        w = written[a:b]
        first = _initial(w[:1], key)
        if role == "initial":
            new = first
        elif role == "family":
            what = _told(w)
            new = _cased(made_word(drawn(role, what, key, again.get((role, what), 0)), w), w)
        else:
            what = _told(w)
            rest = made_word(drawn(role, what, key, again.get((role, what), 0)), w, 3)
            new = _cased(first.lower() + "e" + rest + ("a" if is_female(w) else "o") if ord(w[0]) < 0x250 else rest, w)
        out += [written[at:a], new]
        at = b
    return "".join([*out, written[at:]])


def _initial(letter: str, key: str) -> str:
    """The capital that stands for a given name's first letter, one for each."""
    plain = unicodedata.normalize("NFD", letter)
    if not (plain[:1].isascii() and plain[:1].isalpha()):
        return letter.upper()
    return unicodedata.normalize("NFC", permuted("initial", plain[0].lower(), key).upper() + plain[1:])


_AT = re.compile(r"@|\s?[(\[{]\s?(?:at|AT|arobase|arroba|a)\s?[)\]}]\s?|\s(?:AT|at)\s")
_DOT = re.compile(r"\.|\s?[(\[{]\s?(?:dot|DOT|punkt|punto|point)\s?[)\]}]\s?|\s(?:DOT|dot)\s")


def _moved(text: str, kind: str, key: str, at) -> str:
    """Letters and digits permuted as one, other characters of the same kind drawn, signs kept."""
    new = iter(permuted(kind, item(text), key))
    put = lambda c: (next(new).upper() if c.isupper() else next(new)) if c.isascii() and c.isalnum() else str(next(at) % 10) if c.isdigit() else chr(97 + next(at) % 26) if c.isalpha() else c
    return "".join(map(put, text))


@lru_cache(1 << 17)
def surrogate(kind: str, written: str, what: str, key: str, again: int = 0) -> str:
    """A replacement of a phone, id, address or street of the same type and format; which one depends on the key and the item alone.

    Different items get different ones: digits and letters of phones, ids, local parts and the labels of hosts are
    permuted (top-level domains stay), streets get a word of their own, as :func:`redraws` makes sure with ``again``.
    """
    at = iter(hmac.new(key.encode(), f"s:{kind}:{what}".encode(), hashlib.sha512).digest() * (1 + len(written) // 32))
    if kind == "email":
        if not (m := _AT.search(written)):
            return _moved(written, kind, key, at)
        host, out, last = written[m.end() :], [_moved(written[: m.start()], kind, key, at), m[0]], 0
        for d in _DOT.finditer(host):
            out += [_moved(host[last : d.start()], "label", key, at), d[0]]
            last = d.end()
        return "".join([*out, host[last:]])
    if kind == "id_number":
        return _moved(written, kind, key, at)
    if kind == "phone":
        # the first four digits and all letters stay
        digits = re.sub("[^0-9]", "", written)
        new = iter(digits[:4] + permuted(f"{kind}:{digits[:4]}", digits[4:], key))
        return "".join(next(new) if c in "0123456789" else str(next(at) % 10) if c.isdigit() else c for c in written)
    own = made_word(drawn(kind, what, key, again), written).title()
    kept = rf"(?:{_EN}|{_FR}|{_ES}|de|la|las|los|del|des|du|bis|ter)\b\.?|C/"
    # the first word is the street's own, more are only for the form
    words = iter([own])
    made = lambda m: m[0] if re.fullmatch(kept, m[0]) else next(words, (SYLLABLES[next(at)] + SYLLABLES[next(at)]).title()) + (re.search(rf"(?:{_DE})$", m[0]) or [""])[0]
    if any(not re.fullmatch(kept, w) for w in re.findall(r"[^\W\d]+", written)):
        return re.sub(r"\d+|[^\W\d]+", lambda m: str(1 + next(at) % 199) if m[0].isdigit() else made(m), written)
    return re.sub(r"[0-9]+", lambda m: permuted(kind, m[0], key), written)


def redraws(items: DataFrame, key: str, space: int | None = None) -> dict[tuple[str, str], int]:
    """How often names and streets of ``kind``, ``item`` have to be drawn anew until no two share a word.

    Of n items about n² / 2 ``space`` have to (10^12 words, 10^9 of given names): 50 of ten million, so what the driver
    holds stays small.
    """
    again: dict[tuple[str, str], int] = {}
    while True:
        word = F.pandas_udf(lambda k, i, again=dict(again): pd.Series([drawn(a, b, key, again.get((a, b), 0), space) for a, b in zip(k, i)]), "bigint")
        shared = items.withColumn("word", word("kind", "item")).groupBy("kind", "word").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("item")).alias("i")).where("n > 1")
        shared = shared.select("kind", F.explode(F.slice("i", 2, 1 << 30)).alias("item")).collect()
        if not shared:
            return again
        for r in shared:
            again[r.kind, r.item] = again.get((r.kind, r.item), 0) + 1


def clashes(items: DataFrame, key: str, size: int = CODE) -> DataFrame:
    """``kind``, ``code``, ``items`` (how many) of codes that several items of a kind share; none is expected.

    Of n items n² / 2^97 pairs would: less than one in a million of 10^11 items.
    """
    own = F.pandas_udf(lambda k, i: pd.Series([code(a, b, key, size) for a, b in zip(k, i)], dtype="object"), "string")
    return items.select("kind", "item").distinct().withColumn("code", own("kind", "item")).groupBy("kind", "code").agg(F.count(F.lit(1)).alias("items")).where("items > 1")


def replace(messages: DataFrame, key: str, style: str = "placeholder") -> DataFrame:
    """``seq``, ``from_name``, ``from_email``, ``text`` with each item replaced; all else stays as it is.

    ``key``: a secret, without which nobody can tell which replacement an item has. ``style``: ``placeholder`` writes
    ``[EMAIL_<code>]`` and the like, ``surrogate`` a made-up item of the same type. Items that differ only in case, blanks
    and signs get the same replacement. Null fields stay null.
    """
    if not key:
        raise ValueError("replacements need a secret key")
    lists = learn_names(messages)
    if style == "surrogate":
        return _made_up(messages, key, lists)
    given, endings = lists

    def run(batches):
        names = _names(tuple(given), tuple(endings))
        one = lru_cache(1 << 17)(lambda written, kind: f"[{kind.upper()}_{code(kind, _told(written), key)}]")
        short = lru_cache(1 << 17)(lambda x, only: _put(x, _spans(x, names, only), one))  # names and addresses recur

        for df in batches:
            yield pd.DataFrame({"seq": df["seq"], "from_name": [short(x, "name") for x in df["from_name"]], "from_email": [short(x, "email") for x in df["from_email"]], "text": [_put(x, _spans(x, names, None), one) for x in df["text"]]})

    return spread(messages.select("seq", *FIELDS)).mapInPandas(run, "seq BIGINT, from_name STRING, from_email STRING, text STRING")


#: The fields that are replaced, and what a field without any item is as a whole.
FIELDS = {"from_name": "name", "from_email": "email", "text": None}


def _spans(text, names: Names, only: str | None) -> list[tuple[int, int, str]]:
    if not isinstance(text, str) or not text.strip():
        return []
    return entities(text, names) or ([(0, len(text), only)] if only else [])


def _put(text, spans, one):
    if not spans:
        return text
    out, last = [], 0
    for a, b, kind in spans:
        out += [text[last:a], one(text[a:b], kind)]
        last = b
    return "".join([*out, text[last:]])


def _told(written: str) -> str:
    """The item; one without a letter from a to z is told apart by what is written."""
    return item(written) or " ".join(written.lower().split())


def _made_up(messages: DataFrame, key: str, lists: tuple[list[str], list[str]]) -> DataFrame:
    """Texts are searched once; where the items stand is saved beside them, so that the words of all are checked before any is written."""
    given, endings = lists

    def mark(batches):
        names = _names(tuple(given), tuple(endings))
        short = lru_cache(1 << 17)(lambda x, only: _spans(x, names, only))  # names and addresses recur

        @lru_cache(1 << 17)
        def parts(kind, written):
            if kind == "name":
                return [f"{r}:{_told(written[a:b])}" for a, b, r in name_parts(written, names) if r != "initial"]
            return [f"street:{_told(written)}"] if kind == "street" else []

        for df in batches:
            out, items = {"seq": df["seq"]}, [set() for _ in range(len(df))]
            for c, only in FIELDS.items():
                out[c], at = df[c], []
                for x, mine in zip(df[c], items):
                    found = short(x, only) if only else _spans(x, names, only)
                    mine.update(y for a, b, k in found for y in parts(k, x[a:b]))
                    at.append(" ".join(f"{a},{b},{k}" for a, b, k in found))
                out["at_" + c] = at
            yield pd.DataFrame(out | {"items": [sorted(x) for x in items]})

    schema = "seq BIGINT, " + ", ".join(f"{c} STRING, at_{c} STRING" for c in FIELDS) + ", items ARRAY<STRING>"
    marked = save(spread(messages.select("seq", *FIELDS)).mapInPandas(mark, schema), "marked")
    items = save(marked.select(F.explode("items").alias("x")).distinct().selectExpr("substring_index(x, ':', 1) AS kind", "substring(x, instr(x, ':') + 1) AS item"), "items")
    again = redraws(items, key)
    discard(messages.sparkSession, items)

    def run(batches):
        names = _names(tuple(given), tuple(endings))

        @lru_cache(1 << 17)
        def one(written, kind):
            if kind == "name":
                return surrogate_name(written, names, key, again)
            what = _told(written)
            return surrogate(kind, written, what, key, again.get((kind, what), 0))

        for df in batches:
            out = {"seq": df["seq"]}
            for c in FIELDS:
                out[c] = [_put(x, [(int(a), int(b), k) for a, b, k in (y.split(",") for y in at.split())], one) for x, at in zip(df[c], df["at_" + c])]
            yield pd.DataFrame(out)

    return marked.drop("items").mapInPandas(run, "seq BIGINT, from_name STRING, from_email STRING, text STRING")
