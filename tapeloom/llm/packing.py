"""Sequence packing: non-negative least squares over shallow length combinations."""

from __future__ import annotations

import itertools
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import slices, table
from tapeloom.llm.tokens import encoder
from tapeloom.storage import cut, numbered

WINDOW = 2048
#: A document's tail is cut to a multiple of this and a rest below it.
GRAIN = 32
#: Lengths in one combination at most.
DEPTH = 3
END_ID = 1

#: ``marks``: of a piece that may be cut again, the CRCs of its first 1, 2, ... grains, as unsigned 32-bit integers.
PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, marks binary"


def tokenized_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, grain: int = GRAIN) -> DataFrame:
    """Cut every document's ids into full windows, a multiple of ``grain`` and a rest."""
    import zlib

    import numpy as np

    def scan(batches):
        import pyarrow as pa

        encode, closing = encoder(tokenizer), np.array([END_ID], "<u4").tobytes()
        for b in slices(batches):
            rows = []
            texts = [t or "" for t in b.column(1).to_pylist()]
            for doc, ids in zip(b.column(0).to_pylist(), encode(texts), strict=True):
                ids = ids.tobytes() + closing
                n = len(ids) // 4
                full = n - n % window
                cuts = [*range(0, full, window), full, n - n % grain, n]
                for start, end in itertools.pairwise(cuts):
                    if end > start:
                        crc, marks = 0, []
                        step = grain if full <= start and end < n + (n % grain == 0) else end - start
                        for at in range(start, end, step):
                            crc = zlib.crc32(ids[4 * at : 4 * (at + step)], crc)
                            marks.append(crc)
                        rows.append((doc, start, end - start, crc, n, np.array(marks, "<u4").tobytes() if len(marks) > 1 else None))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, PIECES)


def combinations(window: int, grain: int, depth: int) -> list[tuple[int, ...]]:
    """All ways to fill the window with 2 to ``depth`` multiples of ``grain``, longest first."""
    units = window // grain

    def parts(total, most, left):
        if total == 0:
            yield ()
        elif left:
            for x in range(min(total, most), 0, -1):
                if x * left < total:
                    break
                for rest in parts(total - x, x, left - 1):
                    yield (x, *rest)

    return [tuple(x * grain for x in p) for p in parts(units, units - 1, depth)]


def nnls(columns, target, rounds: int = 3000):
    """Minimise |A x - target| over x >= 0 by accelerated projected gradients."""
    import numpy as np

    n = len(target)
    a = np.zeros((n, len(columns)))
    for j, c in enumerate(columns):
        np.add.at(a[:, j], list(c), 1.0)
    gram, b = a.T @ a, a.T @ target
    step = 1.0 / np.linalg.norm(gram, 2)
    x = y = np.zeros(len(columns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * (gram @ y - b))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def layout(histogram: dict[int, int], window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH) -> list[tuple]:
    """Slots (length, lo, hi, start, part, first, per, sequence, offset).

    Of the pieces of ``length`` ranked lo..hi-1, the ``part`` ids from
    ``start`` on lie in sequence ``sequence + k // per`` at ``offset + k % per
    * part``, where k is ``first`` plus the rank less lo. First come the
    least-squares counts of the exact fillings, rounded down; what is left is
    packed greedily, longest first, each filling repeated as often as the
    counts allow. Room that no piece fits takes the head of a longer one, cut
    at a grain; its tail is packed later. The histogram has at most ``window``
    lengths, so this is small whatever the corpus.
    """
    # by length: runs [original length, lo, hi, start] of pieces not placed yet
    runs = {n: deque([[n, 0, c, 0]]) for n, c in histogram.items() if c}
    left = {n: c for n, c in histogram.items() if c}
    slots, sequence = [], 0

    def take(n: int, count: int):
        """Remove ``count`` pieces of length n, as runs."""
        left[n] -= count
        while count:
            origin, lo, hi, start = run = runs[n][0]
            m = min(count, hi - lo)
            yield origin, lo, lo + m, start
            run[1] += m
            count -= m
            if run[1] == hi:
                runs[n].popleft()

    def place(filling: dict[int, int], times: int, cut: tuple[int, int] | None = None) -> None:
        nonlocal sequence
        offset = 0
        for n, per in filling.items():
            first = 0
            for origin, lo, hi, start in take(n, per * times):
                slots.append((origin, lo, hi, start, n, first, per, sequence, offset))
                first += hi - lo
            offset += n * per
        if cut:
            n, head = cut
            first = 0
            for origin, lo, hi, start in list(take(n, times)):
                slots.append((origin, lo, hi, start, head, first, 1, sequence, offset))
                first += hi - lo
                runs.setdefault(n - head, deque()).append([origin, lo, hi, start + head])
                left[n - head] = left.get(n - head, 0) + hi - lo
        sequence += times

    if left.get(window):
        place({window: 1}, left[window])
    sizes = [n for n in range(grain, window, grain) if left.get(n)]
    index = {n: i for i, n in enumerate(sizes)}
    fits = [c for c in combinations(window, grain, depth) if all(n in index for n in c)]
    if fits:
        import numpy as np

        counts = nnls([[index[n] for n in c] for c in fits], np.array([left[n] for n in sizes], float))
        for j in np.argsort(-counts, kind="stable"):
            filling: dict[int, int] = {}
            for n in fits[j]:
                filling[n] = filling.get(n, 0) + 1
            times = min(int(counts[j]), *(left[n] // per for n, per in filling.items()))
            if times > 0:
                place(filling, times)
    while any(left.values()):
        room, filling = window, {}
        lengths = sorted((n for n, c in left.items() if c), reverse=True)
        for n in lengths:
            if fit := min(left[n], room // n):
                filling[n] = fit
                room -= fit * n
        head = room - room % grain
        cut = next(((n, head) for n in lengths if head and n > head and n % grain == 0 and left[n] > filling.get(n, 0)), None)
        needs = filling | ({cut[0]: filling.get(cut[0], 0) + 1} if cut else {})
        place(filling, min(left[n] // need for n, need in needs.items()), cut)
    return slots


def _part_crc(grain: int):
    """CRC of the ids from start on, for ``part`` ids, out of the CRCs of a piece's beginnings."""
    import zlib

    import numpy as np

    zeros = bytes(4 * WINDOW)

    @F.pandas_udf("long")
    def crc(marks: pd.Series, start: pd.Series, part: pd.Series) -> pd.Series:
        def one(m, s, n):
            m = np.frombuffer(m, "<u4")
            before = int(m[s // grain - 1]) if s else 0
            # crc(A + B) = crc(A moved on by the length of B) ^ crc(B)
            moved = zlib.crc32(zeros[: 4 * n], before) ^ zlib.crc32(zeros[: 4 * n], 0)
            return int(m[(s + n) // grain - 1]) ^ moved

        return pd.Series([one(*x) for x in zip(marks, start, part, strict=True)], dtype="int64")

    return crc


def packed(pieces: DataFrame, window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH) -> DataFrame:
    """Add sequence_id and offset to ``pieces``; each piece's place follows from its length and rank.

    Pieces are ranked within their length by a distributed sort that also
    spreads one very common length; only the counts by length (at most
    ``window``) reach the driver.
    """
    spark = pieces.sparkSession
    spread = F.xxhash64("doc_id", "start", "ids_crc32")
    ranked = numbered(pieces.withColumn("_h", spread), ["length", "_h", "doc_id", "start"], "_row").drop("_h")
    counts = {r[0]: r[1] for r in ranked.groupBy("length").count().collect()}
    below, total = {}, 0
    for n in sorted(counts):
        below[n], total = total, total + counts[n]
    slots = [(n, below[n] + lo, below[n] + hi, *rest) for n, lo, hi, *rest in layout(counts, window, grain, depth)]
    # a few thousand rows at most, as many as there are fillings and lengths
    columns = "_n int, _lo long, _hi long, _start int, _part int, _first long, _per long, _seq long, _off long"
    where = spark.createDataFrame(slots or [(0,) * 9], columns)
    inside = (F.col("length") == F.col("_n")) & (F.col("_row") >= F.col("_lo")) & (F.col("_row") < F.col("_hi"))
    placed = ranked.join(F.broadcast(where), inside)
    whole = F.col("_part") == F.col("length")
    parts = placed.where(~whole).withColumn("ids_crc32", _part_crc(grain)("marks", "_start", "_part"))
    k = F.col("_first") + F.col("_row") - F.col("_lo")
    return (
        placed.where(whole)
        .unionByName(parts)
        .select(
            "doc_id",
            (F.col("start") + F.col("_start")).alias("start"),
            F.col("_part").cast("long").alias("length"),
            "ids_crc32",
            "doc_tokens",
            (F.col("_seq") + F.floor(k / F.col("_per"))).cast("long").alias("sequence_id"),
            (F.col("_off") + k % F.col("_per") * F.col("_part")).cast("long").alias("offset"),
        )
    )


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, grain: int = GRAIN) -> DataFrame:
    """Pack whole documents; one row per piece.

    A null or empty text is one end id. Rows that repeat a doc_id are separate
    documents. An empty table gives no rows. The sequences of the greedy step
    may be short; all others are full.
    """
    return packed(cut(tokenized_pieces(docs, tokenizer, window, grain)), window, grain)


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())
