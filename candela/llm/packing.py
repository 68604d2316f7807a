"""Packing (7): best-fit decreasing over whole documents' token ids.

Documents longer than a window are cut into full windows first; what is left of each has 1 .. WINDOW tokens.
Best-fit decreasing needs only how many pieces there are of each length, so the exact global packing is planned
on a histogram of at most WINDOW rows, whatever the data's size: a segment tree over remaining capacities finds
the tightest open windows, and all pieces of a length that go to windows alike are placed in one step. The plan
says which ranks of which length go to which sequences; ranks are made by Spark, in groups of about GROUP_ROWS pieces of a length that a hash of
their place in the stored table makes, so equal rows are spread like others.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import id_text, ids_of, n_blocks, stored, text_or_empty

WINDOW = 1024
END_ID = 0
GROUP_ROWS = 4000  # pieces for each salt of a length
SALTS_TOGETHER = 4096  # whose sizes are added up in one group


class CapacityTree:
    """Segment tree over capacities 0 .. size: which of them have an open window."""

    def __init__(self, size: int):
        self.leaves = 1 << (size + 1).bit_length()
        self.any = [False] * (2 * self.leaves)

    def set(self, capacity: int, there: bool) -> None:
        i = capacity + self.leaves
        self.any[i] = there
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity >= least that has one."""
        i = least + self.leaves
        if self.any[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing of counts[length] pieces: rows of (length, first rank, end rank, first sequence,
    pieces in each sequence, offset of the first piece). Sequences are numbered gaplessly from 0."""
    tree, open_at, out, sequences = CapacityTree(window), [deque() for _ in range(window + 1)], [], 0

    def put(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            open_at[capacity].append((first, n))
            tree.set(capacity, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:  # new windows
                capacity, first, n = window, sequences, -(-left // (window // length))
                sequences += n
            else:
                first, n = open_at[capacity].popleft()
                if not open_at[capacity]:
                    tree.set(capacity, False)
            each = capacity // length
            full = min(n, left // each)
            if full:
                out.append((length, rank, rank + full * each, first, each, window - capacity))
                put(capacity - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < n:  # fewer pieces than one more window would take
                out.append((length, rank, rank + left, first + full, left, window - capacity))
                put(capacity - left * length, first + full, 1)
                full, left = full + 1, 0
            put(capacity, first + full, n - full)
    return out


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: every document's ids and the end id, cut at full windows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = bpe.load(path)
        for f in frames:
            rows = []
            for doc, ids in zip(f["doc_id"], encoder.encode(list(f["t"])), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                rows += [(doc, s, min(window, len(ids) - s), bpe.crc32_ids(ids[s : s + window]), len(ids)) for s in range(0, len(ids), window)]
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield out.assign(doc_id=ids_of(out["doc_id"]))

    return docs.select(id_text("doc_id"), text_or_empty().alias("t")).mapInPandas(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def place(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to a stored table with columns length (1 .. window) and deal, a number of its own for each row."""
    spark = cut.sparkSession
    counts = {int(r[0]): int(r[1]) for r in cut.groupBy("length").count().collect()}  # at most `window` rows
    planned = plan(counts, window)
    steps = spark.createDataFrame(planned, "length long, r0 long, r1 long, first_sequence long, each long, first_offset long")
    salts = F.array(*[F.lit(n_blocks(counts.get(k, 0), GROUP_ROWS)) for k in range(window + 1)])
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("deal"), F.get(salts, F.col("length").cast("int"))))
    sizes = salted.groupBy("length", "salt").count().withColumn("high", F.floor(F.col("salt") / SALTS_TOGETHER))
    lower = Window.partitionBy("length", "high").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    upper = Window.partitionBy("length").orderBy("high").rowsBetween(Window.unboundedPreceding, -1)
    sums = sizes.groupBy("length", "high").agg(F.sum("count").alias("sum")).select("length", "high", F.coalesce(F.sum("sum").over(upper), F.lit(0)).alias("below"))
    base = sizes.withColumn("base", F.coalesce(F.sum("count").over(lower), F.lit(0))).join(sums, ["length", "high"]).select("length", "salt", (F.col("base") + F.col("below")).alias("base"))
    ranked = (
        salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("deal")) - 1)
        .join(base, ["length", "salt"])
        .withColumn("rank", F.col("rank") + F.col("base"))
    )
    # The plan's size depends on the window, not on the data.
    return (
        ranked.join(F.broadcast(steps.withColumnRenamed("length", "l")), (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("r0")) & (F.col("rank") < F.col("r1")))
        .withColumn("sequence_id", F.col("first_sequence") + F.floor((F.col("rank") - F.col("r0")) / F.col("each")))
        .withColumn("offset", F.col("first_offset") + F.pmod(F.col("rank") - F.col("r0"), F.col("each")) * F.col("length"))
        .drop("l", "r0", "r1", "each", "first_sequence", "first_offset", "rank", "base", "salt")
    )


def pack(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one piece of one token, the end id. Rows with the same doc_id are packed each by
    itself; equal rows take places in any order, as do pieces of one length. A text of any length is encoded whole and cut into full
    windows. Extra columns of docs are ignored, whatever their names; an empty table gives no rows.
    """
    cut = stored(pieces(docs, path, window).withColumn("deal", F.monotonically_increasing_id()), "packing-pieces")
    return place(cut, window).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
