"""Token ids of the whole corpus by a public byte-level BPE tokenizer (problem 8).

Each partition runs recursive DuckDB queries over the words it hasn't met: rows of (word, position, token) join the
table of merges, the pair of smallest rank of each word is contracted, leftmost occurrences first, until no pair of any
word can merge, and an ordered aggregation turns the rows into lists. A pair's later ranks can't undercut the rank that
made its token, so all occurrences of a word's best pair that don't overlap are contracted at once; a long run of one
character then takes as many rounds as it has kinds of merges and not one a byte.

A recursive query runs a fixed number of rounds and hands the words that aren't finished to the next one, so that what it
holds is bounded. A long word (base64, a script without blanks) is first cut where no token holds the two bytes beside the
cut, since no merge can cross it. What is still long is contracted in overlapping blocks, which makes its time
proportional to its length. Blocks are joined at a token that both hold at the same place: then each two neighbouring
tokens of the whole are neighbours in the ids of some block, and a list of tokens is the one that merging gives if each two
neighbours are what merging gives for the two. Where no token is shared, the two blocks are contracted as one.
"""

import importlib.util
import itertools
import json
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.sources.tables import spread

#: Folder of the public tokenizers.
TOKENIZERS = "/opt/tokenizers"
#: Most distinct words whose ids a worker keeps, most bytes of words in one recursive query, and its rounds.
CACHE_WORDS, QUERY_BYTES, ROUNDS = 400_000, 500_000, 16
#: Bytes from which a word is contracted in blocks, bytes of a block, and how many of them the next one repeats.
LONG, BLOCK, OVERLAP = 400, 192, 64

_CONTRACT = """
WITH RECURSIVE step(round, word, pos, tok) AS (
    SELECT 0, word, pos, tok FROM start
    UNION ALL
    SELECT round + 1, word, row_number() OVER (PARTITION BY word ORDER BY pos), new
    FROM (
        SELECT round, word, pos, took, coalesce(merged, tok) AS new, lag(took, 1, false) OVER (PARTITION BY word ORDER BY pos) AS gone
        FROM (
            SELECT *, best AND row_number() OVER (PARTITION BY word, best, pos - nth ORDER BY pos) % 2 = 1 AS took,
                   CASE WHEN best AND row_number() OVER (PARTITION BY word, best, pos - nth ORDER BY pos) % 2 = 1 THEN id END AS merged
            FROM (
                SELECT *, row_number() OVER (PARTITION BY word, best ORDER BY pos) AS nth
                FROM (
                    SELECT *, coalesce(rank = min(rank) OVER (PARTITION BY word), false) AS best, min(rank) OVER (PARTITION BY word) AS least
                    FROM (SELECT round, word, pos, tok, lead(tok) OVER (PARTITION BY word ORDER BY pos) AS nxt FROM step) AS pairs
                    LEFT JOIN merges ON merges.l = pairs.tok AND merges.r = pairs.nxt
                )
                WHERE least IS NOT NULL AND round < {rounds}
            )
        )
    )
    WHERE NOT gone
)
SELECT word, last < {rounds} AS done, list(tok ORDER BY pos) AS ids
FROM (SELECT *, max(round) OVER (PARTITION BY word) AS last FROM step)
WHERE round = last GROUP BY word, last
"""


@lru_cache(4)
def _pattern(folder: str):
    """The published pattern that splits a text into words."""
    import regex

    spec = importlib.util.spec_from_file_location("_public_tokenizers", Path(folder) / "__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return regex.compile(module.PATTERN)


@lru_cache(4)
def _merges(folder: str, name: str):
    """DuckDB connection with the table ``merges(l, r, rank, id)``, the ids of the 256 bytes, the length of each token,
    and which two bytes stand side by side within a token.
    """
    import duckdb

    model = json.loads((Path(folder) / f"{name}.json").read_text(encoding="utf-8"))["model"]
    vocab = model["vocab"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    table = pd.DataFrame({"l": [vocab[a] for a, _ in pairs], "r": [vocab[b] for _, b in pairs], "rank": range(len(pairs)), "id": [vocab[a + b] for a, b in pairs]}, dtype="int32")
    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
    con.register("table_", table)
    con.execute("CREATE TABLE merges AS SELECT * FROM table_")
    con.unregister("table_")
    # The vocabulary writes printable Latin-1 characters as themselves and the other bytes as the characters from 256 on.
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
    size = np.ones(max(vocab.values()) + 1, "int64")
    size[list(vocab.values())] = [len(w) for w in vocab]
    byte = {c: b for b, c in letter.items()}
    inside = np.zeros((256, 256), bool)
    for w in vocab:
        for x, y in itertools.pairwise(w):
            if x in byte and y in byte:
                inside[byte[x], byte[y]] = True
    return con, np.array([vocab[letter[b]] for b in range(256)], "int32"), size.tolist(), inside


class Encoder:
    """Ids of texts; keeps those of the words it has met, up to ``CACHE_WORDS``."""

    def __init__(self, folder: str = TOKENIZERS, name: str = "byte_bpe_50k"):
        self.con, self.bytes, self.size, self.inside = _merges(folder, name)
        self.split, self.known = _pattern(folder).findall, {}

    def _contract(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word, by recursive queries over words of ``QUERY_BYTES`` together."""
        out: list = [None] * len(words)
        part, size = [], 0
        for i, w in enumerate(words):
            part.append((i, self.bytes[np.frombuffer(w, "uint8")]))
            size += len(w)
            if size > QUERY_BYTES or i + 1 == len(words):
                while part:
                    part = self._rounds(part, out)
                size = 0
        return out

    def _rounds(self, part: list, out: list) -> list:
        """``ROUNDS`` rounds of merges; finished words go to ``out``, the others are given back."""
        size = np.array([len(t) for _, t in part])
        first = np.cumsum(size) - size
        word = np.repeat(np.arange(len(part), dtype="int32"), size)
        start = pd.DataFrame({"word": word, "pos": (np.arange(size.sum()) - np.repeat(first, size) + 1).astype("int64"), "tok": np.concatenate([t for _, t in part])})
        self.con.register("start", start)
        left = []
        for w, done, ids in self.con.execute(_CONTRACT.format(rounds=ROUNDS)).fetchall():
            if done:
                out[part[w][0]] = ids
            else:
                left.append((part[w][0], np.array(ids, "int32")))
        self.con.unregister("start")
        return left

    def _long(self, word: bytes) -> list[int]:
        """The ids of a long word, cut where no merge can cross."""
        data = np.frombuffer(word, "uint8")
        cuts = [0, *(np.flatnonzero(~self.inside[data[:-1], data[1:]]) + 1).tolist(), len(word)]
        pieces = [word[a:b] for a, b in itertools.pairwise(cuts)]
        short = list({p for p in pieces if len(p) <= LONG})
        ids = dict(zip(short, self._contract(short)))
        return list(itertools.chain.from_iterable(ids[p] if p in ids else self._blocks(p) for p in pieces))

    def _blocks(self, word: bytes) -> list[int]:
        """The ids of a long word, block by block."""
        spans = [(a, min(a + BLOCK + OVERLAP, len(word))) for a in range(0, max(len(word) - OVERLAP, 1), BLOCK)]
        kinds = dict.fromkeys(word[a:b] for a, b in spans)
        ids = dict(zip(kinds, self._contract(list(kinds))))
        blocks = [(a, b, ids[word[a:b]]) for a, b in spans]
        while len(blocks) > 1:
            whole, again = [blocks[0]], []
            for b in blocks[1:]:
                if (joined := self._join(whole[-1], b)) is None:
                    again.append(len(whole) - 1)
                    whole.append(b)
                else:
                    whole[-1] = joined
            if len(whole) == 1:
                return whole[0][2]
            # each block without a shared token is contracted with the one after it, from a span of its own
            merged, i = [], 0
            while i < len(whole):
                if i in again:
                    merged.append((whole[i][0], whole[i + 1][1], None))
                    i += 2
                else:
                    merged.append(whole[i])
                    i += 1
            new = iter(self._contract([word[a:b] for a, b, t in merged if t is None]))
            blocks = [(a, b, next(new) if t is None else t) for a, b, t in merged]
        return blocks[0][2]

    def _join(self, a: tuple, b: tuple) -> tuple | None:
        """Two overlapping blocks (start, end, ids) as one, if a token stands at the same place in both."""
        ends, at = {}, a[1]
        for i in range(len(a[2]) - 1, -1, -1):
            ends[at] = i
            at -= self.size[a[2][i]]
            if at < b[0]:
                break
        at = b[0]
        for k, t in enumerate(b[2]):
            at += self.size[t]
            if at > a[1]:
                return None
            if (i := ends.get(at)) is not None and a[2][i] == t and (at < a[1] or b[1] == a[1]):
                return a[0], b[1], a[2][: i + 1] + b[2][k + 1 :]
        return None

    def encode(self, texts) -> list[list[int]]:
        """A list of ids for each text; null and empty texts give an empty list."""
        split = [self.split(t) if isinstance(t, str) else [] for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known, long = self.known, {}
        new = []
        for w in dict.fromkeys(itertools.chain.from_iterable(split)):
            if w not in known:
                if len(w) * 4 > LONG and len(raw := w.encode()) > LONG:
                    long[w] = self._long(raw)
                else:
                    new.append(w)
        known.update(zip(new, self._contract([w.encode() for w in new])))
        if long:
            return [list(itertools.chain.from_iterable(long[w] if w in long else known[w] for w in ws)) for ws in split]
        return [list(itertools.chain.from_iterable(known[w] for w in ws)) for ws in split]


@lru_cache(2)
def encoder(folder: str, name: str) -> Encoder:
    """The worker's encoder."""
    return Encoder(folder, name)


def token_ids(documents: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """``doc_id``, ``ids`` of every document; whole texts, no special tokens.

    Null and empty texts give an empty list, blanks are encoded as they are; repeated rows come out as often as they
    stand. No shuffle: every partition encodes its own rows.
    """

    def run(batches):
        e = encoder(folder, name)
        for df in batches:
            yield pd.DataFrame({"doc_id": df["doc_id"], "ids": e.encode(df["text"])})

    return spread(documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))).mapInPandas(run, "doc_id BIGINT, ids ARRAY<INT>")
