"""Containers of fixed capacity filled with whole texts (problem 9).

Bounded-space online packing: every partition keeps a fixed number of open windows for each capacity, puts an item into
the window it fits best, and when none fits emits the fullest and opens a new one. The windows that are still open at
the end of a partition are merged in groups of partitions, largest first, each into the window it fits best. So no
task ever holds more than its open windows, and the room left in each container is that of a best fit.
"""

from bisect import bisect_left, insort
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.tokens import TOKENIZERS
from threadloom.sources.scratch import save
from threadloom.sources.tables import spread

#: Open windows a partition and capacity keeps, and partitions whose last windows are merged together.
WINDOWS, GROUP = 64, 64
#: Kinds of containers that are packed in one pass over the documents.
KINDS = 200

ROWS = "container_kind STRING, container STRING, doc_id BIGINT, part INT, start INT, n_tokens INT"


@lru_cache(2)
def _tokenizer(folder: str, name: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(Path(folder) / f"{name}.json"))
    t.encode_special_tokens = True
    return t


def token_counts(documents: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """``doc_id``, ``n_tokens`` of every document; null and empty texts have none."""

    def run(batches):
        t = _tokenizer(folder, name)
        for df in batches:
            n = [len(e.ids) for e in t.encode_batch_fast(df["text"].fillna("").tolist(), add_special_tokens=False)]
            yield pd.DataFrame({"doc_id": df["doc_id"], "n_tokens": pd.Series(n, dtype="int32")})

    return spread(documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))).mapInPandas(run, "doc_id BIGINT, n_tokens INT")


class Open:
    """The open windows of one capacity, sorted by the room left."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.room, self.born, self.load = capacity, most, [], 0, {}

    def put(self, size: int, item) -> list:
        """Places an item; gives back the windows that had to be emitted."""
        out, at = [], bisect_left(self.room, (size,))
        if at < len(self.room):
            room, number = self.room.pop(at)
        else:
            if len(self.room) >= self.most:
                out.append(self.load.pop(self.room.pop(0)[1]))
            room, number, self.born = self.capacity, self.born, self.born + 1
            self.load[number] = []
        self.load[number].append(item)
        insort(self.room, (room - size, number))
        return out

    def rest(self) -> list:
        return [(self.capacity - room, self.load[number]) for room, number in self.room]


def pack(documents: DataFrame, containers: DataFrame, windows: int = WINDOWS, group: int = GROUP, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """One row per piece of a document and container kind: its container, its first token and its number of tokens.

    A document of more tokens than the capacity is cut into pieces of the capacity and a rest, which is packed like an
    item; any other has one piece. Documents without tokens (null or empty texts) take no room and stand in the window
    with the least room left. Kinds that are null and capacities that are null or below 1 have no containers; repeated rows are packed as often as they stand.
    """
    sized = token_counts(documents, folder, name).withColumn("p", F.spark_partition_id())
    every = containers.select("container_kind", "capacity_tokens").where("capacity_tokens >= 1").distinct()
    # each kind packs all documents for itself: so many of them at a time, however many there are
    if every.limit(KINDS + 1).count() > KINDS:
        sized = save(sized, "sized")
    out, seen = None, None
    while True:
        part = every.orderBy("container_kind", "capacity_tokens") if seen is None else every.where((F.col("container_kind") > seen[0]) | (F.col("container_kind") == seen[0]) & (F.col("capacity_tokens") > seen[1])).orderBy("container_kind", "capacity_tokens")
        kinds = [(r[0], r[1]) for r in part.where("container_kind IS NOT NULL").limit(KINDS).collect()]
        if out is not None and not kinds:
            return out
        packed = _pack(sized, kinds, windows, group)
        out = packed if out is None else out.unionByName(packed)
        if len(kinds) < KINDS:
            return out
        seen = kinds[-1]


def _pack(sized: DataFrame, kinds: list[tuple[str, int]], windows: int, group: int) -> DataFrame:
    """:func:`pack` of sized documents into some kinds of containers."""

    def first(batches):
        p, open_, n = 0, {k: Open(c, windows) for k, c in kinds}, dict.fromkeys(kinds, 0)
        for df in batches:
            rows = []
            for doc, size, p in zip(df["doc_id"].astype(object).where(df["doc_id"].notna(), None), df["n_tokens"], df["p"]):
                for kind in kinds:
                    k, c = kind
                    whole, rest = divmod(size, c) if size > c else (0, size)
                    emitted = [[(doc, i, i * c, c)] for i in range(whole)]
                    if rest or not whole:
                        emitted += open_[k].put(rest, (doc, whole, whole * c, rest))
                    for load in emitted:
                        rows += [(k, f"{p}-{n[kind]}", *x, 0, 0) for x in load]
                        n[kind] += 1
            yield pd.DataFrame(rows, columns=columns)
        rows = []
        for kind in kinds:
            for used, load in open_[kind[0]].rest():
                rows += [(kind[0], f"{p}-{n[kind]}", *x, 1, used) for x in load]
                n[kind] += 1
        yield pd.DataFrame(rows, columns=columns)

    columns = ["container_kind", "container", "doc_id", "part", "start", "n_tokens", "open", "used"]
    placed = save(sized.mapInPandas(first, ROWS + ", open INT, used INT"), "packed")
    rest = placed.where("open = 1").select("container_kind", "container", "used", F.floor(F.split_part("container", F.lit("-"), F.lit(1)).cast("int") / group).alias("g")).distinct()
    capacity = dict(kinds)

    def merge(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["used", "container"], ascending=[False, True])
        box, names, out = Open(capacity[df["container_kind"].iloc[0]], 1 << 30), {}, []
        for used, c in zip(df["used"], df["container"]):
            box.put(int(used), c)
        for _, load in box.rest():
            names |= dict.fromkeys(load, "m" + load[0])
        out = df[["container_kind", "container"]].assign(merged=df["container"].map(names))
        return out

    moved = rest.groupBy("container_kind", "g").applyInPandas(merge, "container_kind STRING, container STRING, merged STRING")
    done = placed.where("open = 0").select("container_kind", "container", "doc_id", "part", "start", "n_tokens")
    late = placed.where("open = 1").join(moved, ["container_kind", "container"]).select("container_kind", F.col("merged").alias("container"), "doc_id", "part", "start", "n_tokens")
    return done.unionByName(late)


def fill(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """``container_kind``, ``containers``, ``tokens``, ``fill`` (share of the room that is used)."""
    used = packed.groupBy("container_kind", "container").agg(F.sum("n_tokens").alias("n")).groupBy("container_kind").agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("tokens"))
    cap = containers.select("container_kind", "capacity_tokens").distinct()
    return used.join(cap, "container_kind").select("container_kind", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))
