"""Alignment of a message with the reply that quotes it, and the tags that follow from it.

Word alignment is a dynamic programme, so it runs as an Arrow-backed function; reply lines, sentence ends and tags are
arrays of the same couple and are settled beside it, which spares a shuffle of tokens. Of a couple with more than ``KEPT``
cells only some rows of the table are kept, and those between are computed again on the way back, so the alignment is the
same whatever the size, memory grows with the length times its square root, and no text is cut.
"""

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Penalties of the word alignment (assumed, since the library the original calls isn't there): substitution, insertion, deletion.
PENALTIES = (100, 75, 75)
#: Share of a reply line's tokens that must be aligned, and most positions of a cut continuation line.
ALIGNED, CONTINUATION = 0.5, 10
#: Cells of a table that is kept whole.
KEPT = 4_000_000

_TOKEN = re.compile(r"\w+|\n|[^\w\s]")


def tokens(text: str) -> list[str]:
    """STR10: words, signs and line feeds."""
    return _TOKEN.findall(text)


def _rows(row: np.ndarray, x: np.ndarray, y: np.ndarray, penalties) -> np.ndarray:
    """The rows of the cost table after ``row``, one for each of the tokens ``x``, with ``row`` before them."""
    sub, ins, dele = penalties
    cost = np.empty((len(x) + 1, len(row)), "int64")
    cost[0] = row
    steps = np.arange(len(row), dtype="int64") * ins
    for i, t in enumerate(x, 1):
        best = cost[i - 1] + dele
        best[1:] = np.minimum(best[1:], cost[i - 1, :-1] + np.where(y == t, 0, sub))
        # insertions run along the row: a running minimum of the cost less the steps taken
        cost[i] = np.minimum.accumulate(best - steps) + steps
    return cost


def align(source: list[str], reply: list[str], penalties=PENALTIES) -> list[tuple[int | None, int | None]]:
    """ALN3, ALN4: the best word alignment ignoring case; gaps are None, the tokens keep their case because only indices are given.

    Ties prefer a match, then leaving out a source token.
    """
    sub, ins, dele = penalties
    number: dict[str, int] = {}
    x, y = (np.array([number.setdefault(t.lower(), len(number)) for t in w], dtype="int64") for w in (source, reply))
    n, m = len(x), len(y)
    size = n or 1
    if (n + 1) * (m + 1) > KEPT:
        size = max(math.isqrt(n), 1)
    marks = [np.arange(m + 1, dtype="int64") * ins]
    for i in range(0, n - size, size):
        marks.append(_rows(marks[-1], x[i : i + size], y, penalties)[-1].copy())
    out, i, j = [], n, m
    for k in range(len(marks) - 1, -1, -1):
        low = k * size
        cost = _rows(marks[k], x[low : low + size], y, penalties)
        while i > low or (j and k == 0):
            r = i - low
            if i and j and cost[r, j] == cost[r - 1, j - 1] + (0 if x[i - 1] == y[j - 1] else sub):
                i, j = i - 1, j - 1
                out.append((i, j))
            elif i and cost[r, j] == cost[r - 1, j] + dele:
                i -= 1
                out.append((i, None))
            else:
                j -= 1
                out.append((None, j))
    return out[::-1]


def reply_positions(pairs, reply: list[str]) -> set[int]:
    """ALN5: positions of the alignment that belong to reply lines.

    A line is flagged by a ``>`` at its start; it counts if at least half of its positions are aligned. An unflagged line of few positions
    counts if the line before was flagged and broken off by ``=``. A last line without line feed doesn't count.
    """
    out: set[int] = set()
    line, flagged, before = [], False, False
    for at, (s, r) in enumerate(pairs):
        line.append(at)
        token = reply[r] if r is not None else None
        if token == ">" and (r == 0 or reply[r - 1] == "\n"):
            flagged = True
        elif token == "\n":
            hits = sum(pairs[i][0] is not None and pairs[i][1] is not None for i in line)
            cut = before and line[0] >= 2 and (q := pairs[line[0] - 2][1]) is not None and reply[q].startswith("=")
            if (flagged and hits / len(line) >= ALIGNED) or (not flagged and cut and len(line) < CONTINUATION):
                out.update(line)
            before, flagged, line = flagged, False, []
    return out


def sentence_ends(pairs, source: list[str], reply: list[str], inside: set[int]) -> list[int]:
    """ALN6: ends of sentences as positions: line feeds outside reply lines, marks in them, moved to a line feed that follows."""
    n, ends = len(pairs), set()
    word = lambda k: reply[pairs[k][1]] if pairs[k][1] is not None else source[pairs[k][0]]
    for k in range(n):
        t = word(k)
        if k in inside:
            if t in (".", "?", "!", ";", ":"):
                ends.add(k + 1 if k + 1 < n and word(k + 1) == "\n" else k)
            elif t == "\n":
                ends.add(k)
        elif t == "\n":
            ends.add(k)
    if n and word(n - 1) != "\n":
        ends.add(n)
    return sorted(ends)


def aligned_lines(source_text: str, reply_text: str) -> list[tuple[str, str | None, str]]:
    """ALN2-8: source sentence, reply sentence or None, and BIEO tag."""
    source, reply = tokens(re.sub("\n\n+", "\n", source_text or "")), tokens(re.sub("\n\n+", "\n", reply_text or ""))
    pairs = align(source, reply)
    inside = reply_positions(pairs, reply)
    out, start = [], 0
    for end in sentence_ends(pairs, source, reply, inside):
        part = pairs[start : end + 1]
        s = " ".join(" ".join(source[a] for a, _ in part if a is not None).split())
        r = " ".join(" ".join(reply[b] for _, b in part if b is not None).split()) if end in inside else None
        out.append((s, r))
        start = end + 1
    on = [r is not None for _, r in out]
    tag = lambda i: "O" if not on[i] else {(False, False): "BE", (False, True): "B", (True, False): "E", (True, True): "I"}[i > 0 and on[i - 1], i + 1 < len(on) and on[i + 1]]
    return [(s, r, tag(i)) for i, (s, r) in enumerate(out)]


def couple_lines(couples: DataFrame) -> DataFrame:
    """``source_seq``, ``pos``, ``source_line``, ``reply_line``, ``tag`` of couples ``source_seq source_text reply_text``; null texts count as empty."""

    def run(batches):
        for df in batches:
            rows = [(k, i, s, r, t) for k, a, b in zip(df["source_seq"], df["source_text"], df["reply_text"]) for i, (s, r, t) in enumerate(aligned_lines(a, b))]
            yield pd.DataFrame(rows, columns=["source_seq", "pos", "source_line", "reply_line", "tag"])

    spark = couples.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # few rows, much work: not to be coalesced by size
    return couples.select("source_seq", "source_text", "reply_text").repartition(parts).mapInPandas(run, "source_seq BIGINT, pos INT, source_line STRING, reply_line STRING, tag STRING")


def couple_documents(couples: DataFrame) -> DataFrame:
    """ALN9, SRC17: one text of source and reply, and the spans of both; the reply's starts with the line feed."""
    return couples.select(
        "source_seq",
        F.concat("source_text", F.lit("\n"), "reply_text").alias("document"),
        F.length("source_text").alias("source_end"),
        (F.length("source_text") + 1 + F.length("reply_text")).alias("document_end"),
    )
