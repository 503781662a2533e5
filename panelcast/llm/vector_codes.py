"""Vector code compression: product codes found by equal-average search.

Vectors of integers floor(scale * x) are cut into ``PARTS`` equal consecutive parts; each part position has a codebook
of at most 256 entries. The codebooks start as the parts of the vectors of the smallest ids; each round assigns every part of
every vector to the nearest entry (squared distance, ties to the lower index) and replaces each used entry by its parts'
componentwise floor of the mean. All arithmetic is on integers, so the result doesn't depend on how Spark deals the rows.

The search for the nearest entry keeps a codebook's entries sorted by the sum of their components. By Cauchy-Schwarz the
squared gap of two sums is at most the dimension times the squared distance. So from a part's own sum the entries are
taken outwards, a few at a time on either side, and a side ends once its next gap squared over the dimension strictly exceeds
the best distance so far; what is farther out can't even tie. Rows are taken in blocks of similar sums, so that a
step is one matrix product for the rows whose side is still open.

Each round is one map pass with partial sums per entry (a fixed size: parts x 256 x width) and one aggregate; the codebooks
are the only thing that reaches the driver or is broadcast.

Vectors that are null or hold null or non-finite components are dropped; shorter ones (and widths that aren't a multiple
of ``PARTS``) count as if zeros followed; rows of one id are each coded, those without an id are coded but start no entry;
ties among starting rows of one id go by the vector; fewer vectors than entries give fewer entries; an empty table gives no
rows. Components beyond 53 bits are computed in Python integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm.common import saved
from panelcast.llm.vectors import finite, matrix

PARTS = 4
ENTRIES = 256
ROUNDS = 4
_BLOCK = 512   # rows of similar sums searched together
_STEP = 16     # entries taken at once on a side
LABEL_ROWS = 1_000_000
SALTS = 32


class Codebook:
    """One part position's entries, sorted by their sums."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        sums = entries.sum(1)
        self.order = np.argsort(sums, kind="stable")
        self.sums = sums[self.order]
        self.most = int(np.abs(entries).max(initial=0))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and its squared distance, for every row."""
        k, dim = self.entries.shape
        index, best = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        reach = 2 * max(self.most, int(np.abs(x).max(initial=0))) + 1
        # distance * k + index orders by distance, then index; exact in doubles below 2**53
        exact = dim * reach * reach * k < 2 ** 53
        kind = np.float64 if exact else object
        entries, sums = self.entries[self.order].astype(kind), self.sums.astype(kind)
        norms = (entries * entries).sum(1)
        own = x.astype(kind)
        total = own.sum(1)
        order = np.argsort(total, kind="stable")
        for at in range(0, len(x), _BLOCK):
            rows = order[at:at + _BLOCK]
            block, s = own[rows], total[rows]
            norm = (block * block).sum(1)
            key = np.full(len(rows), np.inf) if exact else np.full(len(rows), dim * reach * reach * k, object)

            def take(some: np.ndarray, lo: int, hi: int) -> None:
                part = block[some]
                d = norm[some, None] - 2 * (part @ entries[lo:hi].T) + norms[None, lo:hi]
                found = (d * k + self.order[lo:hi].astype(kind)).min(1)
                key[some] = np.minimum(key[some], found)

            low = max(0, int(np.searchsorted(self.sums, int(s[0]))) - _STEP // 2)
            high = min(k, int(np.searchsorted(self.sums, int(s[-1]))) + _STEP // 2)
            low, high = min(low, k - 1), max(high, min(low, k - 1) + 1)
            every = np.arange(len(rows))
            take(every, low, high)
            left, right = every, every
            while len(left) or len(right):
                left = left[self._open(s[left], key[left], sums[low - 1], dim, k)] if low else left[:0]
                if len(left):
                    take(left, max(0, low - _STEP), low)
                    low = max(0, low - _STEP)
                right = right[self._open(s[right], key[right], sums[high], dim, k)] if high < k else right[:0]
                if len(right):
                    take(right, high, min(k, high + _STEP))
                    high = min(k, high + _STEP)
            index[rows] = (key % k).astype(np.int64)
            best[rows] = (key // k).astype(np.int64)
        return index, best

    @staticmethod
    def _open(s: np.ndarray, key: np.ndarray, edge: float | int, dim: int, k: int) -> np.ndarray:
        """Whether a side may still hold an entry as near as the best: its gap squared over the dimension doesn't
        strictly exceed the best distance."""
        return ((s - edge) * (s - edge) <= key // k * dim).astype(bool)


def parts_of(column: pa.Array, width: int) -> list[np.ndarray]:
    x = matrix(column, PARTS * width, np.int64)
    return [x[:, p * width:(p + 1) * width] for p in range(PARTS)]


def integers(vectors: DataFrame, vec_col: str, scale: int, columns: list[str]) -> DataFrame:
    floors = F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale))
    return vectors.where(finite(vec_col)).select(*columns, floors.alias("__v"))


def start(base: DataFrame, id_col: str, width: int, entries: int) -> list[np.ndarray]:
    """The parts of the rows of the smallest ids (at most ``entries`` rows)."""
    first = base.where(F.col(id_col).isNotNull()).orderBy(id_col, "__v").limit(entries).select("__v").toArrow()
    return parts_of(first.column("__v"), width)


def improve(base: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """One round: every part to its nearest entry, every used entry to the floor of its parts' mean."""
    held = base.sparkSession.sparkContext.broadcast([Codebook(b) for b in books])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # column 0 counts, the others sum
        sums = [np.zeros((len(b), width + 1), np.int64) for b in books]
        for batch in batches:
            for p, x in enumerate(parts_of(batch.column("__v"), width)):
                own, _ = held.value[p].nearest(x)
                sums[p][:, 0] += np.bincount(own, minlength=len(sums[p]))
                order = np.argsort(own, kind="stable")
                cut = np.flatnonzero(np.diff(own[order], prepend=-1))
                sums[p][own[order][cut], 1:] += np.add.reduceat(x[order], cut, axis=0)
        shape = (PARTS, len(books[0]), width + 1)
        used = np.broadcast_to(np.stack(sums)[:, :, :1] > 0, shape).reshape(-1)
        where = [w.reshape(-1)[used].astype(np.int32) for w in np.indices(shape)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, where), pa.array(np.stack(sums).reshape(-1)[used])], ["p", "e", "i", "s"])

    rows = (base.select("__v").mapInArrow(partial, "p int, e int, i int, s long").groupBy("p", "e", "i")
            .agg(F.sum("s").alias("s")).toArrow())
    total = np.zeros((PARTS, len(books[0]), width + 1), np.int64)
    p, e, i, s = (rows.column(c).to_numpy() for c in ("p", "e", "i", "s"))
    total[p, e, i] = s
    held.destroy()
    count = total[:, :, :1]
    return list(np.where(count > 0, total[:, :, 1:] // np.maximum(count, 1), np.stack(books)))


def fit(base: DataFrame, id_col: str, width: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks of an ``integers`` frame (read in every round: write it first where it is costly)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    books = start(base, id_col, width, entries)
    if not len(books[0]):   # no row with an id
        return [np.zeros((1, width), np.int64)] * PARTS
    for _ in range(rounds):
        books = improve(base, books, width)
    return books


def encode(base: DataFrame, books: list[np.ndarray], width: int, columns: list[str]) -> DataFrame:
    """``columns`` with code (two hex digits a part) and error (squared distances, summed)."""
    held = base.sparkSession.sparkContext.broadcast([Codebook(b) for b in books])
    shape = T.StructType([*(base.schema[c] for c in columns), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, error = np.zeros((len(batch), PARTS), np.uint8), np.zeros(len(batch), np.int64)
            for p, x in enumerate(parts_of(batch.column("__v"), width)):
                own, d = held.value[p].nearest(x)
                codes[:, p] = own
                error += d
            text = codes.tobytes().hex()
            code = pa.array([text[k:k + 2 * PARTS] for k in range(0, len(text), 2 * PARTS)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), code, pa.array(error)], shape.names)

    return base.select(*columns, "__v").mapInArrow(rows, shape)


def decode(codes: DataFrame, books: list[np.ndarray], code_col: str = "code", out_col: str = "decoded") -> DataFrame:
    """The vectors of integers that codes stand for."""
    flat = [F.array(*[F.array(*[F.lit(int(x)) for x in entry]) for entry in b]) for b in books]
    part = lambda p: F.conv(F.substring(code_col, 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn(out_col, F.concat(*[F.element_at(flat[p], part(p) + 1) for p in range(PARTS)]))


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry, position, in decimal with commas."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.reshape(-1)).encode()).hexdigest()


def with_group_sum(rows: DataFrame, group_col: str, value_col: str, out_col: str) -> DataFrame:
    """``rows`` with the sum of a column over equal groups, nulls together. Sums are combined before the shuffle and
    joined back: broadcast up to ``LABEL_ROWS`` groups, beyond that under ``SALTS`` salts, so that a group with a
    third of the rows is spread."""
    sums = rows.groupBy(group_col).agg(F.sum(value_col).alias(out_col)).select(F.col(group_col).alias("__group"), out_col)
    sums = saved(sums, "group_sums")
    if sums.count() <= LABEL_ROWS:
        return rows.join(F.broadcast(sums), F.col(group_col).eqNullSafe(F.col("__group"))).drop("__group")
    salted = sums.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = rows.withColumn("__own", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return out.join(salted, F.col(group_col).eqNullSafe(F.col("__group")) & (F.col("__own") == F.col("__salt"))).drop("__group", "__salt", "__own")


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
             scale: int = 1024, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every row that takes part."""
    base = saved(integers(vectors, vec_col, scale, [id_col, label_col]), "integers")
    width = -(-(base.agg(F.max(F.size("__v"))).first()[0] or 1) // PARTS)
    books = fit(base, id_col, width, entries, rounds)
    coded = saved(encode(base, books, width, [id_col, label_col]), "codes")
    return (with_group_sum(coded, label_col, "error", "label_error").drop(label_col)
            .withColumn("codebooks_sha256", F.lit(digest(books))))
