"""Only the lines that an e-mail's sender newly wrote (problem 7).

Each message meets two dictionaries: the text of the message it answers, with what that quotes of earlier ancestors, and
its sender's closings (lines that stand below signatures in several of the sender's messages, learned from all
messages). Paragraphs are compressed with them. One that shrinks abnormally is suspected; its lines are then compared
exactly, blanks, quotation marks and wrongly decoded characters aside, and only lines that overlap are taken out.
Notices that no dictionary of the sender holds are compressed with the closings of the whole archive that share words
with them. What no dictionary can say (an ancestor that isn't there, a sender's first message) is read from its form:
quotation marks, the lines that introduce quotations, signature marks, names and legal words. All else is kept.
:meth:`Reducer.decide` tells for every line which of these decided.
"""

import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.ids import clean_id
from threadloom.llm.privacy import Names, _names, learn_names
from threadloom.sources.scratch import save
from threadloom.sources.tables import spread

#: Share of its size that a paragraph must lose to a dictionary to be suspected.
GAIN = 0.35
#: Share of its own size below which a compressed paragraph is abnormal in any case.
SMALL = 0.3
#: Bytes of a dictionary that one compression sees, how many of them the next piece repeats, and most bytes of text it compresses.
PIECE, REPEAT, PART = 28_000, 8_000, 4_000
#: Messages below whose signatures a closing of the archive must stand, and its least share there of all it occurs.
CLOSING, TAIL = 8, 0.75
#: Least share that a closing must have of all lines below signatures, which bounds the archive's closings, and of the
#: sender's, which bounds a sender's; messages of one sender in which it must stand. Rarer closings of the archive are the senders'.
COMMON, OWN, TWICE = 1 / 50_000, 1 / 500, 2
#: Words of a shingle by which the archive's closings are looked up, and share of a paragraph's words that they must cover.
SHINGLE, COVERED = 4, 0.6
#: Pieces into which the rows of one sender are dealt for the join with the sender's closings.
SALT = 16

X = "\u0080-￿"
_MARK = re.compile(r"[ \t]?(?:>|\||:|»|├╗|┬╗|╗|Â»|В»|¬ª|ª|�|[A-Z]{2,3}>)[ \t]?")
_INTRO_END = re.compile(rf"(?:\bwrote|\bsaid|\bschrieb|\ba [^\s:]{{0,9}}crit|\bescribi[^\s:]{{0,9}}|\bdisait)\s?:\s*$|^Quoting .*:\s*$|^(?:Am|On|Le|El) .*\d.*\b(?:schrieb|wrote|escribi)\b.*:\s*$")
_INTRO_START = re.compile(r"^(?:On|Am|Le|El) .*\d{1,4}.*$|^\* \S.*$|^Quoting .*$")
_INTRO_WORDS = {"On ", "Am ", "Le ", "El ", "Quo", "* "} | {f"* {chr(c)}" for c in range(65, 91)}
_HEADER_MARK = re.compile(r"^-{3,}\s?\S.*\S\s?-{3,}\s*$|^_{25,40}\s*$")
_HEADER = re.compile(rf"^(?:From|Von|De|Desde)\s?: ")
_FIELD = re.compile(rf"^(?:From|Von|De|Sent|Gesendet|Envoy[{X}]{{1,8}}|Enviado|To|An|[{X}]{{1,8}}|A|Para|Subject|Betreff|Objet|Asunto|Date|Datum|Fecha|Cc)\s?: ")
_SIGN = re.compile(r"^(?:--|---|\*{3,8}|_{8,24}|={3,8}|~{3,8})\s*$")
_FOOTER = re.compile(r"^_{41,}\s*$")
_DEVICE = re.compile(rf"^(?:Sent (?:from|with|via) |Get \w+ for |Envoy[{X}]{{1,8}} (?:de|depuis|avec) |Von mein\w* .*gesendet|Gesendet (?:mit|von) |Enviado (?:desde|con) )")
_INITIALS = re.compile(rf"^(?:[A-Z{X}]\.){{1,3}}$|^[A-Z{X}]{{1,3}}$|^[A-Z{X}]{{1,3}}\.$")
_OWN_MARKED = re.compile(r"^>From |^>>> (?:import|from|print|\w+\.\w+|\w+ ?=|\w+\()|^\| ?[^|>]+\|.*\|\s*$|^\+-[-+]*\+\s*$")
_PATH = re.compile(r"^> ?[/~]\S*\s*$")
# Closing phrases, which are new text, and words of legal notices.
_BYE = re.compile(
    rf"^(?:cheers|best|regards|kind regards|best regards|many thanks|thanks|thanks in advance|thank you(?: for your help)?|yours|cordialement|amicalement|merci(?: d'avance| pour votre aide)?|bonne journ[{X}]{{1,8}}e|[{X}]{{1,8}} bient[{X}]{{1,8}}t"
    rf"|gracias(?: de antemano)?|muchas gracias|un saludo|saludos(?: cordiales)?|hasta pronto|viele gr[{X}]{{1,9}}(?:ss)?e|sch[{X}]{{1,8}}ne gr[{X}]{{1,16}}e|mit freundlichen gr[{X}]{{1,16}}en|danke(?: sch[{X}]{{1,8}}n| im voraus)?|beste gr[{X}]{{1,16}}e)\s?[,.!]?\s*$",
    re.I,
)
_LEGAL = re.compile(
    r"confiden|vertraulich|privileged|rechtlich gesch|informations prot|AVISO LEGAL|^NOTICE:|^HINWEIS:|^AVIS ?:|no liability|haften nicht|responsables de|intended only|destinat|bestimmt\b|before printing|avant d['’]imprimer|Ausdruck n|antes de imprimir|decline toute|free of errors|bind the company|is forbidden|est interdite|nicht gestattet|sin autoriz",
    re.M,
)
def _may_be_legal(t: str) -> bool:
    """Whether a text has a part of some word of ``_LEGAL``: this is much faster than the pattern, which most texts don't match."""
    return (
        "onfiden" in t or "ertraulich" in t or "rivileged" in t or "echtlich" in t or "tions prot" in t or "AVIS" in t or "NOTICE" in t or "HINWEIS" in t or "liability" in t
        or "haften" in t or "responsables" in t or "intended" in t or "destinat" in t or "bestimmt" in t or "printing" in t or "imprim" in t or "Ausdruck" in t or "decline" in t
        or "of errors" in t or "bind the" in t or "forbidden" in t or "interdite" in t or "gestattet" in t or "autoriz" in t
    )


_FOREIGN = re.compile(rf"[{X}]+")


def bone(s: str) -> str:
    """What is compared: no blanks, no characters that decoding may have changed."""
    s = "".join(s.split())
    return s if s.isascii() else _FOREIGN.sub("", s)


#: Whether any line may begin with a quotation mark, and how the last line of an introduction may end.
_SOME_MARK, _INTRO_LAST = re.compile(r"^(?:[ \t]?[^\w\s]|[ \t]?[^\x00-\x7f]|[ \t]?[A-Z]{2,3}>)", re.M), frozenset(": \t\x0b\x0c")
_SOME_HEADER = re.compile(r"^(?:-{3}|_{25}|From|Von|De)", re.M)
_ODD_BLANK = re.compile("[\x0b\x0c\x1c-\x1f]")


def bones(text: str) -> list[str]:
    """:func:`bone` of each line of a text."""
    t = text.replace(" ", "").replace("\t", "").replace("\r", "")
    if not t.isascii():
        t = _FOREIGN.sub("", t)
    if _ODD_BLANK.search(t):
        t = _ODD_BLANK.sub("", t)
    return t.split("\n")


def mark_of(line: str):
    """The match of a quotation mark at the start of a line that isn't blank."""
    c = line[0]
    return _MARK.match(line) if not c.islower() and (not c.isascii() or not c.isalnum() or ">" in line[1:4]) else None


def unmarked(line: str) -> tuple[int, str]:
    """Depth and rest of a line with quotation marks."""
    n = 0
    while m := _MARK.match(line):
        n, line = n + 1, line[m.end() :]
    return n, line


class Dictionary:
    """A text that paragraphs are compressed with: its lines and their whole without marks and blanks, and its bytes in pieces."""

    def __init__(self, text: str, masked: bool = False):
        self.text, self.hit = text, 0
        all_ = bones(figures(text) if masked else text)
        if not masked and _SOME_MARK.search(text):
            all_ = [bone(unmarked(x)[1]) if x and mark_of(x) else b for x, b in zip(text.split("\n"), all_)]
        self.whole, self.lines = "".join(all_), frozenset(all_) - {""}
        self._pieces: list[bytes] | None = None

    @property
    def pieces(self) -> list[bytes]:
        if self._pieces is None:
            raw = self.text.encode(errors="replace")
            self._pieces = [raw[i : i + PIECE] for i in range(0, max(len(raw) - REPEAT, 1), PIECE - REPEAT)]
        return self._pieces

    def abnormal(self, paragraph: str) -> bool:
        """Whether the paragraph shrinks abnormally: to less than ``SMALL`` of its size, which no short text does by itself, or by ``GAIN``."""
        raw = paragraph.encode(errors="replace")
        if len(raw) <= PART and len(self.pieces) == 1 and (best := _packed(raw, self.pieces[0])) > SMALL * len(raw):
            return 1 - best / _packed(raw) >= GAIN
        return len(raw) <= PART and len(self.pieces) == 1 or self.gain(paragraph) >= GAIN

    def gain(self, paragraph: str) -> float:
        """Share of its compressed size that the paragraph loses to this dictionary, whatever the size of either.

        Long paragraphs are compressed part by part, each with the piece of the dictionary that serves it best; the one
        that served the part before is tried first and is enough if the gain is abnormal.
        """
        raw = paragraph.encode(errors="replace")
        plain = rest = 0
        for i in range(0, len(raw), PART):
            part = raw[i : i + PART]
            alone = _packed(part)
            best, n = alone, len(self.pieces)
            for k in range(n):
                size = _packed(part, self.pieces[(self.hit + k) % n])
                if size < best:
                    best = size
                    if 1 - size / alone >= 2 * GAIN:
                        self.hit = (self.hit + k) % n
                        break
            plain, rest = plain + alone, rest + best
        return 1 - rest / plain if plain else 0.0


def _packed(raw: bytes, dictionary: bytes = b"") -> int:
    # a small window suffices, and is sooner made, where all fits in it
    bits, memory = (-13, 5) if len(raw) + len(dictionary) < 7_900 else (-15, 8)
    z = zlib.compressobj(3, zlib.DEFLATED, bits, memory, zlib.Z_DEFAULT_STRATEGY, *([dictionary] if dictionary else []))
    return len(z.compress(raw)) + len(z.flush())


@lru_cache(8192)
def _dictionary(text: str, masked: bool = False) -> Dictionary:
    return Dictionary(text, masked)


class Closings:
    """The closings of the whole archive, looked up by shingles of words."""

    def __init__(self, lines):
        self.lines, self.known, self.index = list(lines), frozenset(figures(bone(x)) for x in lines), {}
        for i, x in enumerate(self.lines):
            for w in self.shingles(x.split()):
                self.index.setdefault(w, []).append(i)
        # a text that holds a shingle holds its longest word
        self.heads = frozenset(max(w, key=len) for w in self.index)

    @staticmethod
    def shingles(words: list[str]) -> list[tuple]:
        return list(zip(*(words[i:] for i in range(SHINGLE))))

    def taken(self, text: str) -> bool:
        """Whether a paragraph is made of closings: shingles name the closings, the gain with these must be abnormal, and they must cover it."""
        words = text.split()
        if len(words) < 2 * SHINGLE or self.heads.isdisjoint(words):
            return False
        # what covers so much holds runs that some of every third shingle lies in
        if not any(tuple(words[i : i + SHINGLE]) in self.index for i in range(0, len(words), 3)):
            return False
        found = [self.index.get(w) for w in self.shingles(words)]
        if sum(x is not None for x in found) < COVERED / 2 * len(words):
            return False
        near = dict.fromkeys(i for x in found if x for i in x)
        if Dictionary("\n".join(self.lines[i] for i in near)).gain(text) < GAIN:
            return False
        covered = set()
        for i, x in enumerate(found):
            if x:
                covered.update(range(i, i + SHINGLE))
        return len(covered) >= COVERED * len(words)


#: What settled a line: it is blank, new, overlaps with an ancestor or a closing after an abnormal gain, or by its form.
BLANK, NEW, ANCESTOR, OWN_CLOSING, FORM = "blank", "new", "ancestor", "closing", "form"


class Reducer:
    """Tells new lines from others; ``forms=False`` leaves all to the dictionaries."""

    def __init__(self, names: Names, closings, forms: bool = True):
        self.names, self.closings, self.forms = names, Closings(closings), forms
        self.seen: dict = {}

    def _is_name(self, line: str) -> bool:
        if (out := self.seen.get(line)) is None:
            if len(self.seen) > 100_000:
                self.seen.clear()
            out = self.seen[line] = self._name(line.strip())
        return out

    def _name(self, s: str) -> bool:
        if s.startswith("--"):
            s = s[2:].strip()
        if not s or len(s) > 90 or s[-1] in ",:?!" or s.count(" ") > 6:
            return False
        if _INITIALS.match(s) or self.names.is_given(s):
            return True
        s = re.sub(r"\s*[<(]\S+@\S+[>)]$", "", s)
        return any(b - a >= len(s) for a, b in self.names.find(s))

    def _closing(self, part: list[str], keys) -> str | None:
        """Whether the lines of a paragraph are known closings, by the archive's closings or by legal words and exact sentences; ``keys``: what is compared of each."""
        text = " ".join([x.strip() for x in part])
        known = self.closings.known
        taken = self.closings.taken(text)
        legal = len(_LEGAL.findall(text)) if not taken and self.forms and _may_be_legal(text) else 0
        device = not taken and self.forms and part[0][0] in "SGEV" and all(_DEVICE.match(x) for x in part)
        if not (taken or legal or device or self.forms and not known.isdisjoint(keys)) or any(_BYE.match(x.strip()) for x in part):
            return None
        if taken or legal > 1 or device:
            return OWN_CLOSING if taken else FORM
        sentences = [b for x in re.split(r"(?<=[.!?:]) ", text) if (b := figures(bone(x)))]
        size = sum(map(len, sentences))
        return FORM if size > 0 and sum(len(b) for b in sentences if b in known) >= 0.6 * size else None

    def lines(self, text: str, ancestor: str | None = None, own: str | None = None) -> list[int]:
        """Numbers, from 1, of the non-blank lines that are new; ``ancestor``: the answered text, ``own``: the sender's closings."""
        return [i for i, how in enumerate(self.decide(text, ancestor, own), 1) if how == NEW]

    def decide(self, text: str, ancestor: str | None = None, own: str | None = None) -> list[str]:
        """What settled each line."""
        rows = text.split("\n")
        if "\r" in text:
            rows = [x.rstrip("\r") for x in rows]
        n = len(rows)
        old: list = [None] * n
        blank = [not x or x.isspace() for x in rows]
        marks: list = [None] * n
        if _SOME_MARK.search(text):
            marks = [None if blank[i] or not (m := mark_of(x)) else m[0].strip() for i, x in enumerate(rows)]
        source = _dictionary(ancestor) if ancestor else None
        bare = bones(text)
        same = self._overlaps(rows, blank, marks, source, bare) if source else old
        if source:
            for i in range(n):
                if same[i] and marks[i] is not None:
                    old[i] = ANCESTOR
        if self.forms:
            self._quotations(text, rows, blank, marks, old, same, source, ancestor)
        if source:
            self._copies(blank, marks, old, same, bare)
        # what is compared of the lines that are left
        keys = [None if blank[i] or old[i] else figures(b) for i, b in enumerate(bare)]
        if own:
            self._own(rows, blank, old, _dictionary(own, True), keys)
        self._signatures(rows, blank, old, keys)
        return [BLANK if blank[i] else old[i] or NEW for i in range(n)]

    @staticmethod
    def _overlaps(rows, blank, marks, source, bare) -> list:
        """Which lines stand in the ancestor: those of paragraphs with abnormal gain that overlap exactly."""
        n, out = len(rows), [None] * len(rows)
        a = 0
        while a < n:
            if blank[a]:
                a += 1
                continue
            b = a + 1
            while b < n and not blank[b] and marks[b] == marks[a]:
                b += 1
            hits, plain = [], []
            for i in range(a, b):
                if marks[i] is None:
                    x, short = rows[i], 8
                elif _OWN_MARKED.match(rows[i]) or _PATH.match(rows[i]):
                    # what looks like a quotation but may be the sender's own must be a line of the ancestor
                    x, short = rows[i][1:].lstrip(), 1 << 30
                else:
                    x, short = unmarked(rows[i])[1], 3 if marks[i][:1] == ">" else 8
                plain.append(x)
                k = bare[i] if marks[i] is None else bone(x)
                if k and (k in source.lines and (marks[i] is None or marks[i][:1] == ">" or len(k) > 8) or len(k) > short and k in source.whole):
                    hits.append(i)
            if hits and source.abnormal("\n".join(plain)):
                for i in hits:
                    out[i] = ANCESTOR
            a = b
        return out

    def _quotations(self, text, rows, blank, marks, old, same, source, ancestor) -> None:
        """Quotations by their form: introductions, marks, headers, and copies below introductions."""
        n = len(rows)
        whole, known = (source.whole, source.lines) if source else ("", frozenset())

        def take(a, b):
            for j in range(a, b):
                old[j] = old[j] or same[j] or FORM

        intros = {i: k for i, x in enumerate(rows) if (x[-1:] in _INTRO_LAST or x[:3] in _INTRO_WORDS) and not blank[i] and (k := self._intro(rows, i, marks))}
        for i, k in intros.items():
            take(i, i + k)
        if any(marks):
            self._marked(rows, marks, old, blank, intros, whole, known)
        # a message copied below its header stands to the end
        for i in range(n if _SOME_HEADER.search(text) else 0):
            if (not old[i] or same[i]) and not blank[i] and (rows[i][0] in "-_FVD"):
                nxt = next((k for k in range(i + 1, n) if not blank[k]), None)
                if (_HEADER_MARK.match(rows[i]) and nxt is not None and _HEADER.match(rows[nxt])) or (_HEADER.match(rows[i]) and nxt is not None and _FIELD.match(rows[nxt])):
                    take(i, n)
                    break
        # a copy without marks below its introduction, which may begin with the ancestor's own quotations:
        # to the last line that overlaps with the ancestor, without it to the end
        first = next((x for x in (ancestor or "").split("\n") if x.strip()), "") if intros else ""
        for i, size in intros.items():
            k = i + size
            while k < n and blank[k]:
                k += 1
            if k < n and (not old[k] and not (marks[k] and not _OWN_MARKED.match(rows[k])) or k in intros and not marks[i] or known and len(first) > 3 and bone(rows[k]) == bone(first) and unmarked(rows[k])[0] == unmarked(first)[0]):
                last = n - 1
                if known and (equal := [j for j in range(k, n) if not blank[j] and self._in(rows[j], whole)]) and equal[0] == k:
                    last = equal[-1]
                    tail = [j for j in range(last + 1, n) if not blank[j]]
                    if len(tail) <= 1 and not any(self._is_name(rows[j]) or _SIGN.match(rows[j]) for j in tail):
                        last = n - 1
                take(i, last + 1)

    @staticmethod
    def _marked(rows, marks, old, blank, intros, whole, known) -> None:
        """Lines with quotation marks: ``>`` always, others after an introduction, by overlap, or in numbers."""
        n = len(rows)
        own = [bool(m) and bool(_OWN_MARKED.match(x)) for m, x in zip(marks, rows)]
        trusted = {m for m in marks if m and m[0] == ">"}
        for i, size in intros.items():
            k = i + size
            while k < n and blank[k]:
                k += 1
            if k < n and marks[k]:
                trusted.add(marks[k])
        for mark in {m for m, o, w in zip(marks, old, own) if m and not o and not w} - trusted:
            rest = [b for i in range(n) if marks[i] == mark and not own[i] and (b := bone(unmarked(rows[i])[1]))]
            if any(b in known or len(b) > 8 and b in whole for b in rest) or (mark != ":" and len(rest) > 1):
                trusted.add(mark)
        for i in range(n):
            if marks[i] in trusted and not old[i]:
                if own[i] and bone(rows[i][1:].lstrip()) not in known:
                    continue
                if _PATH.match(rows[i]) and bone(rows[i][1:]) not in known and (known or not intros):
                    continue
                old[i] = FORM

    def _in(self, line: str, whole: str) -> bool:
        b = bone(unmarked(line)[1])
        return len(b) > 3 and b in whole

    @staticmethod
    def _intro(rows: list[str], i: int, marks: list) -> int:
        """How many lines from ``i`` introduce a quotation."""
        x = rows[i]
        if marks[i] and not x.startswith("* "):
            return 0
        if x.rstrip().endswith(":") and _INTRO_END.search(x):
            return 1
        if x[:3] in _INTRO_WORDS and i + 1 < len(rows) and not marks[i + 1] and rows[i + 1].rstrip().endswith(":") and _INTRO_START.match(x) and _INTRO_END.search(rows[i + 1]) and not _INTRO_START.match(rows[i + 1]):
            return 2
        return 0

    @staticmethod
    def _copies(blank, marks, old, same, bare) -> None:
        """Runs copied from the ancestor without any mark: two lines of some length or more, one after another but for blanks."""
        run: list[int] = []
        for i in range(len(blank) + 1):
            if i < len(blank) and (blank[i] and run or same[i] and marks[i] is None):
                if not blank[i]:
                    run.append(i)
                continue
            if sum(len(bare[j]) > 20 for j in run) > 1:
                for j in run:
                    old[j] = old[j] or ANCESTOR
            run = []

    @staticmethod
    def _own(rows, blank, old, own: Dictionary, keys) -> None:
        """The sender's closings: the last lines that aren't quoted, as far as they stand in the dictionary and shrink abnormally."""
        i, block = len(rows) - 1, []
        while i >= 0 and (blank[i] or old[i] or keys[i] in own.lines and not _BYE.match(rows[i].strip())):
            if not blank[i] and not old[i]:
                block.append(i)
            i -= 1
        if block and own.abnormal("\n".join(rows[i] for i in reversed(block))):
            for i in block:
                old[i] = OWN_CLOSING

    def _signatures(self, rows, blank, old, keys) -> None:
        n = len(rows)
        i = 0
        while i < n:
            if old[i] or blank[i]:
                i += 1
                continue
            x = rows[i]
            end, how = i, FORM
            while end < n and not blank[end] and not old[end]:
                end += 1
            if not self.forms:
                if not ((i == 0 or blank[i - 1] or old[i - 1]) and (how := self._closing(rows[i:end], keys[i:end]))):
                    i += 1
                    continue
                stop = end
            elif x[0] == "_" and _FOOTER.match(x):
                stop = end
            elif x[0] in "-*_=~" and _SIGN.match(x):
                k = i + 1
                while k < n and blank[k] and not old[k]:
                    k += 1
                stop = end if end > i + 1 or k >= n or old[k] else (i + 1)
            elif self._is_name(x) and (i > 0 or end < n or x.strip().startswith("--")):
                stop = end
                for k in range(i + 1, end):
                    if _SIGN.match(rows[k]) or _FOOTER.match(rows[k]):
                        break
            elif (i == 0 or blank[i - 1] or old[i - 1]) and (taken := self._closing(rows[i:end], keys[i:end])):
                stop, how = end, taken
            elif _DEVICE.match(x) or keys[i] in self.closings.known and not _BYE.match(x.strip()) and any(old[k] or _BYE.match(rows[k].strip()) for k in range(max(0, i - 3), i)):
                stop = i + 1
            else:
                i += 1
                continue
            for k in range(i, stop):
                old[k] = how
            i = max(stop, i + 1)


_FIGURE = re.compile(r"\d")


def figures(b: str) -> str:
    return _FIGURE.sub("9", b)


def _below(text: str) -> tuple[list[str], list[str]]:
    """The sender's own lines above and below the last signature mark, closing phrase or initials; copies below headers are no own lines."""
    rows = [x.rstrip("\r") for x in text.split("\n")]
    marks = [bool(x) and mark_of(x) is not None for x in rows]
    own = []
    for i, x in enumerate(rows):
        if marks[i] or not x or x.isspace():
            continue
        intro = x.rstrip().endswith(":") and _INTRO_END.search(x)
        if x[0] in "-_FVD" and (_HEADER_MARK.match(x) or _HEADER.match(x)) or intro and not any(marks[i + 1 : i + 4]):
            break
        if not intro and not (x[:3] in _INTRO_WORDS and i + 1 < len(rows) and rows[i + 1].rstrip().endswith(":") and _INTRO_START.match(x) and _INTRO_END.search(rows[i + 1])):
            own.append(x.strip())
    for i in range(len(own) - 1, -1, -1):
        if _SIGN.match(own[i]) or _BYE.match(own[i]) or _INITIALS.match(own[i]):
            return own[: i + 1], own[i + 1 :]
    return own, []


def learn_closings(messages: DataFrame) -> tuple[list[str], DataFrame]:
    """The archive's closings, and ``sender``, ``own``: those of each sender; from the unquoted lines of all messages.

    Lines are counted in each task before they are shuffled, as hashes and, where they stand below a signature, with the
    line. A closing stands there in ``TAIL`` of its occurrences; figures count as equal. The archive's have ``COMMON`` of
    all lines there, so there are 50 000 at most; a sender's stand in ``TWICE`` messages and have ``OWN`` of the
    sender's, so there are 500 at most.
    """

    def run(batches):
        by: Counter = Counter()
        line: dict = {}
        for batch in batches:
            for who, text in zip(batch.column("sender").to_pylist(), batch.column("text").to_pylist()):
                above, below = _below(text)
                for x in set(bones(figures("\n".join(above)))):
                    by[None, xxhash.xxh64_intdigest(x)] += 1
                for k, x in dict(zip(bones(figures("\n".join(below))), below)).items():
                    if k and not _BYE.match(x):
                        h = xxhash.xxh64_intdigest(k)
                        by[who or "", h] += 1
                        line[h] = x
            if len(by) > 300_000:
                yield table(by, line)
                by.clear()
                line.clear()
        yield table(by, line)

    def table(by, line):
        who, hashes = [w for w, _ in by], [h for _, h in by]
        return pa.RecordBatch.from_arrays([pa.array(who, pa.string()), pa.array(np.array(hashes, "uint64").view("int64")), pa.array([None if w is None else line[h] for w, h in by], pa.string()), pa.array(list(by.values()), pa.int64())], ["sender", "h", "line", "n"])

    texts = messages.where("text is not null").select(F.lower("from_email").alias("sender"), "text")
    rows = save(spread(texts).mapInArrow(run, "sender STRING, h BIGINT, line STRING, n BIGINT"), "closings")
    below = F.when(F.col("sender").isNotNull(), F.col("n")).otherwise(0)
    total = rows.groupBy("h").agg(F.sum("n").alias("n"), F.sum(below).alias("b"), F.max("line").alias("line")).where((F.col("b") > 0) & (F.col("b") >= TAIL * F.col("n")))
    size = rows.where("sender is not null").agg(F.sum("n").alias("n")).collect()[0].n or 0
    common = total.where(F.col("b") >= max(CLOSING, COMMON * size)).select("line").collect()
    of = rows.where("sender <> ''").groupBy("sender", "h").agg(F.sum("n").alias("n"), F.max("line").alias("line"))
    most = of.groupBy("sender").agg(F.sum("n").alias("all"))
    of = of.where(F.col("n") >= TWICE).join(most, "sender").where(F.col("n") >= OWN * F.col("all")).join(total.select("h"), "h", "left_semi")
    return sorted(r.line for r in common), of.groupBy("sender").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("own"))


@lru_cache(2)
def _reducer(given: tuple, endings: tuple, closings: tuple) -> Reducer:
    return Reducer(_names(given, endings), closings)


def with_dictionaries(messages: DataFrame, closings: DataFrame) -> DataFrame:
    """``seq``, ``text``, ``before``, ``own``: each message with the text of the kept row its ``in_reply_to`` names, and its sender's closings, or null.

    A sender's rows are dealt into ``SALT`` pieces, each with a copy of the (short) closings. Texts of ancestors are
    moved once: the aggregate that picks the kept row of an identifier leaves them where the replies are joined, and
    adaptive execution splits an ancestor that very many messages answer. Rows without a link aren't part of that join.
    """
    ref = F.when(F.col("in_reply_to") != "", clean_id(F.col("in_reply_to")))
    rows = messages.where("text is not null").select("seq", "text", ref.alias("ref"), F.lower("from_email").alias("sender"), F.pmod("seq", F.lit(SALT)).alias("salt"))
    dealt = closings.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<bigint>")))
    rows = rows.join(dealt, ["sender", "salt"], "left").select("seq", "text", "ref", "own")
    ident = clean_id(F.col("message_id"))
    texts = messages.where(ident.isNotNull()).groupBy(ident.alias("id")).agg(F.min_by("text", "seq").alias("before")).where("before is not null")
    replies = rows.where("ref is not null")
    alone = rows.where("ref is null").select("seq", "text", F.lit(None).cast("string").alias("before"), "own")
    return replies.join(texts, replies["ref"] == texts["id"], "left").select("seq", "text", "before", "own").unionByName(alone)


def settled_lines(messages: DataFrame, only: str | None = None, fields: tuple = ("seq", "line_no", "line", "how")) -> DataFrame:
    """``seq``, ``line_no``, ``line``, ``how`` of every non-blank line, lines counted from 1 between line feeds.

    ``how`` is ``new``, or what settled that it isn't: ``ancestor`` and ``closing`` by compression and exact overlap, ``form``.
    ``only`` leaves the lines of one kind, ``fields`` those columns. Null, empty and blank texts have no line; repeated rows are given as often as they stand.
    """
    given, endings = map(tuple, learn_names(messages))
    common, closings = learn_closings(messages)
    common = tuple(common)

    columns = {"seq": pa.int64(), "line_no": pa.int32(), "line": pa.string(), "how": pa.string()}
    columns = {k: columns[k] for k in fields}

    def run(batches):
        r = _reducer(given, endings, common)
        for batch in batches:
            rows: dict = {k: [] for k in columns}
            for seq, text, before, own in zip(*(batch.column(c).to_pylist() for c in ("seq", "text", "before", "own"))):
                how = r.decide(text, before, own)
                at = [i for i, h in enumerate(how) if (h == only if only else h != BLANK)]
                rows["seq"] += [seq] * len(at)
                rows["line_no"] += [i + 1 for i in at]
                if "line" in rows:
                    lines = text.split("\n")
                    rows["line"] += [lines[i] for i in at]
                if "how" in rows:
                    rows["how"] += [how[i] for i in at]
            yield pa.RecordBatch.from_arrays([pa.array(v, columns[k]) for k, v in rows.items()], list(columns))

    types = {"seq": "BIGINT", "line_no": "INT"}
    return with_dictionaries(messages, closings).mapInArrow(run, ", ".join(f"{k} {types.get(k, 'STRING')}" for k in columns))


def new_lines(messages: DataFrame, fields: tuple = ("seq", "line_no", "line")) -> DataFrame:
    """``seq``, ``line_no``, ``line``: the lines newly written by the sender, of :func:`settled_lines`."""
    return settled_lines(messages, NEW, fields)
