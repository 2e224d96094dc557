"""Product codes of vectors by Lloyd's iteration with the bounds of Elkan.

A vector of whole numbers is cut into equal parts; each part position has a codebook. A round assigns each part to the nearest
entry and moves each entry to the mean of its parts. Between rounds a row keeps, for each part, an upper bound of the distance to its
own entry and a lower bound of that to each entry; both are shifted by how far entries have moved. An entry whose lower bound is above the upper
bound, or that is more than twice the upper bound away from the own entry, is farther for certain and is passed over. All others are
compared by squared distances in whole numbers, so ties are exact. Bounds are whole UNITths, lower ones rounded down and upper ones up, in 16 bits;
a bound that is too large for that is cut (lower) or unknown (upper), which prunes less and errs never.

The rows with their codes and bounds are written to the shared folder after each round, so a lost executor costs no round; they take 2 bytes for each part and entry. Sums of
parts are added up in each task, then by Spark; only codebooks, which are as small as their shape, come to the driver.

Defined results: vectors that are null or hold null or non-finite components take no part; shorter vectors are padded with zeros to the longest, and
that to a multiple of ``parts``; codebooks start at the smallest ids, null after all, ties by vector, and have as many entries as there are rows if
those are fewer; repeated rows are rows of their own; components that leave the range of 64 bits count as its end, and so do errors;
a null label is a label; an empty table gives an empty result; other columns may have any names and don't come back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored, stored_texts
from .vector_search import MOST, usable, whole

#: Bounds are counted in this part of a step of the components; the largest bound, and what stands for an unknown upper one.
UNIT, CAP, UNKNOWN = 16, 2**16 - 2, 2**16 - 1
#: Labels, of some 20 bytes, whose sums are broadcast; more are joined by shuffle.
FEW = 100_000


def lower_bound(squared):
    """Of the square root, in UNITths."""
    return np.minimum(np.floor(UNIT * np.sqrt(squared.astype(float)) * (1 - 1e-9)), CAP).astype(np.int32)


def upper_bound(squared):
    x = np.ceil(UNIT * np.sqrt(squared.astype(float)) * (1 + 1e-9))
    return np.where(x <= CAP, x, UNKNOWN).astype(np.int32)


def squares(x, entries):
    """Squared distances (row, entry) of whole numbers."""
    return ((x[:, None, :] - entries[None, :, :]) ** 2).sum(2)


@dataclass
class Assignment:
    """Of the rows of a batch to one part's entries. exact: squared distance to the own entry, where it had to be found (else -1)."""

    code: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    checked: int


def assign(x, entries) -> Assignment:
    """Without bounds: every distance."""
    d = squares(x, entries)
    code = d.argmin(1)
    return Assignment(code, upper_bound(d[np.arange(len(x)), code]), lower_bound(d), d.size)


def reassign(x, entries, before: Assignment, moved) -> Assignment:
    """With the bounds of the assignment before; entries have moved by at most ``moved`` (UNITths, UNKNOWN: any distance) since."""
    code, n = before.code.copy(), len(x)
    lower = np.where(moved >= UNKNOWN, 0, np.maximum(before.lower.astype(np.int32) - moved, 0))
    upper = before.upper.astype(np.int32) + moved[code]
    upper[(before.upper >= UNKNOWN) | (moved[code] >= UNKNOWN) | (upper > CAP)] = UNKNOWN
    apart = lower_bound(squares(entries, entries))

    def open_entries(rows):
        """Entries other than the own that may be as near."""
        u = upper[rows, None]
        may = ((lower[rows] <= u) & (apart[code[rows]] <= 2 * u)) | (u == UNKNOWN)
        may[np.arange(len(rows)), code[rows]] = False
        return may

    rows = np.arange(n)
    rows = rows[open_entries(rows).any(1)]
    own = ((x[rows] - entries[code[rows]]) ** 2).sum(1)
    upper[rows], lower[rows, code[rows]] = upper_bound(own), lower_bound(own)
    may = open_entries(rows)
    r, c = np.nonzero(may)
    d = ((x[rows[r]] - entries[c]) ** 2).sum(1)
    lower[rows[r], c] = lower_bound(d)
    far = np.full((len(rows), len(entries)), np.iinfo(np.int64).max if x.dtype != object else 1 << 200, x.dtype)
    far[r, c] = d
    far[np.arange(len(rows)), code[rows]] = own
    best = far.argmin(1)  # the lowest index of those that tie
    code[rows] = best
    upper[rows] = upper_bound(far[np.arange(len(rows)), best])
    return Assignment(code, upper, lower, len(own) + len(d))


@dataclass(frozen=True)
class Codebooks:
    """entries: (part, entry, component) of whole numbers. moved: (part, entry) since the codebooks before."""

    entries: np.ndarray
    moved: np.ndarray

    @property
    def shape(self):
        return self.entries.shape

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.entries.ravel()).encode()).hexdigest()

    def after(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> Codebooks:
        """With each entry that has parts at the mean of them, rounded down. sums: (part, entry) to count and sums."""
        new = self.entries.copy()
        for (p, e), (n, s) in sums.items():
            new[p, e] = [x // n for x in s]
        return Codebooks(new, np.stack([upper_bound(((a - b) ** 2).sum(1)) for a, b in zip(new, self.entries)]))


def _matrix(batch: pa.RecordBatch, books: Codebooks):
    """(row, part, component) of the batch's vectors."""
    parts, _, width = books.shape
    v = batch.column("v")
    flat = v.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(v), parts, width).astype(books.entries.dtype)


def _packed(batch: pa.RecordBatch, name: str, kind, *shape):
    """Numbers of fixed shape in a binary column."""
    joined = b"".join(batch.column(name).to_pylist())
    return np.frombuffer(joined, kind).reshape(len(batch), *shape)


def _bytes(numbers, kind) -> pa.Array:
    return pa.array([x.tobytes() for x in np.ascontiguousarray(numbers.astype(kind))], pa.binary())


STATE = "codes binary, upper binary, lower binary"


def _assigned(batch: pa.RecordBatch, books: Codebooks, last: bool):
    """(codes, per part: Assignment) of a batch, from its bounds if it has any."""
    parts, entries, _ = books.shape
    x = _matrix(batch, books)
    if "codes" not in batch.schema.names:
        return x, [assign(x[:, p], books.entries[p]) for p in range(parts)]
    codes, upper = _packed(batch, "codes", "<u1", parts), _packed(batch, "upper", "<u2", parts)
    lower = _packed(batch, "lower", "<u2", parts, entries)
    return x, [reassign(x[:, p], books.entries[p], Assignment(codes[:, p].astype(np.int64), upper[:, p], lower[:, p], 0), books.moved[p]) for p in range(parts)]


def with_state(rows: DataFrame, books: Codebooks) -> DataFrame:
    """Rows (id, label, v, ...) with their codes and bounds, packed."""

    def run(batches):
        for batch in batches:
            if len(batch):
                _, found = _assigned(batch, books, False)
                state = [np.stack([getattr(a, n) for a in found], 1) for n in ("code", "upper", "lower")]
                columns = [_bytes(s, kind) for s, kind in zip(state, ("<u1", "<u2", "<u2"))]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("id", "label", "v")), *columns], ["id", "label", "v", "codes", "upper", "lower"])

    own = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in ("id", "label", "v"))
    return rows.mapInArrow(run, f"{own}, {STATE}")


def sums(rows: DataFrame, books: Codebooks) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) to the count and the sums of its parts: as many numbers as the codebooks have, whatever the rows."""
    parts, entries, width = books.shape

    def run(batches):
        count = np.zeros((parts, entries), np.int64)
        total = np.zeros((parts, entries, width), object)
        for batch in batches:
            x, codes = _matrix(batch, books), _packed(batch, "codes", "<u1", parts)
            for p in range(parts):
                code = codes[:, p].astype(np.int64)
                count[p] += np.bincount(code, minlength=entries)
                order = np.argsort(code, kind="stable")
                at = np.flatnonzero(np.diff(code[order], prepend=-1))
                if len(at):
                    total[p, code[order][at]] += np.add.reduceat(x[order, p].astype(books.entries.dtype), at, 0).astype(object)
        p, e = np.nonzero(count)
        kind = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e], pa.int64()), pa.array([[str(x) for x in s] for s in total[p, e]], kind)], ["part", "entry", "n", "s"])

    some = rows.select("v", "codes").mapInArrow(run, "part int, entry int, n long, s array<string>")
    each = [F.sum(F.col("s")[k].cast("decimal(38,0)")).cast("string").alias(f"s{k}") for k in range(width)]
    return {(r["part"], r["entry"]): (r["n"], [int(r[f"s{k}"]) for k in range(width)]) for r in some.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect()}


def coded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, code, error, checked): the last assignment. checked: distances that had to be computed for it."""
    parts = books.shape[0]

    def run(batches):
        for batch in batches:
            if len(batch):
                x, found = _assigned(batch, books, True)
                codes = np.stack([a.code for a in found], 1)
                error = sum(((x[:, p] - books.entries[p][codes[:, p]]) ** 2).sum(1).astype(object) for p in range(parts))
                text = codes.astype("u1").tobytes().hex()
                columns = [pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string()), pa.array([min(int(e), MOST) for e in error], pa.int64())]
                columns.append(pa.array([sum(a.checked for a in found) // len(batch)] * len(batch), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), *columns], ["id", "label", "code", "error", "checked"])

    own = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in ("id", "label"))
    return rows.mapInArrow(run, f"{own}, code string, error long, checked long")


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0, store: Callable = stored, store_state: Callable = stored_texts) -> tuple[DataFrame, Codebooks | None]:
    """(key, label, code, error, label_error, checked) of each usable vector and the final codebooks (None without vectors).

    code: the parts' entries, two hex digits each, so ``entries`` is at most 256. label_error: error summed over equal labels."""
    rows = vectors.where(usable(F.col(vector))).select(F.col(key).alias("id"), F.col(label).alias("label"), whole(F.col(vector), scale).alias("v"))
    n, longest, least, most = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    if not n:
        return rows.select(F.col("id").alias(key), F.col("label").alias(label), F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error", "checked")]), None
    width = max(1, -(-longest // parts))
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width * parts) - F.size("v"))))
    wide = width * (max(abs(least or 0), abs(most or 0)) * 2 + 2) ** 2 >= 2**62
    first = np.array([r["v"] for r in rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()], object if wide else np.int64)
    start = first.reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    books = Codebooks(start, np.zeros(start.shape[:2], np.int32))
    for _ in range(rounds):
        rows = store_state(with_state(rows, books), "codes")
        books = books.after(sums(rows, books))
    found = store(coded(rows, books), "coded")
    total = found.groupBy(F.col("label").alias("__label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"))
    total = store(total.select("__label", F.least("sum", F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error")), "label_errors")
    total = F.broadcast(total) if total.count() <= FEW else total
    both = found.join(total, F.col("label").eqNullSafe(F.col("__label")))
    return both.select(F.col("id").alias(key), F.col("label").alias(label), "code", "error", "label_error", "checked"), books
