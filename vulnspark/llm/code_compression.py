"""Vectors as short codes: product quantisation by Lloyd's algorithm over active entries.

Every vector is cut into parts; each part position has a codebook. A round assigns each
part to the nearest entry and then moves the entries. A part whose entry stayed where it
was keeps its exact distance and is compared with the moved entries only; a part whose entry
moved is compared with all. All arithmetic is on integers, so ties are ties.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnspark.llm.common import bound_batches, col, discard, slices, stored


@dataclass(frozen=True)
class Settings:
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096


@dataclass(frozen=True)
class Codes:
    """``vectors``: the kept columns, ``code`` (one byte per part) and ``error``; ``codebooks``: (parts, entries, width)."""

    vectors: DataFrame
    codebooks: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all integers of all entries, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def whole(values: np.ndarray, scale: int, dims: int) -> np.ndarray:
    """floor(scale * value), held within bounds that keep a squared distance over all dimensions within 63 bits."""
    most = 1 << ((62 - int(dims - 1).bit_length()) // 2 - 1)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values.astype(np.float64) * scale), -most, most).astype(np.int64)


def _scan(x: np.ndarray, entries: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of the entries ``which`` (ascending) for every row: index and squared distance."""
    gap = x[:, None, :] - entries[which][None, :, :]
    far = np.einsum("nkd,nkd->nk", gap, gap)
    least = far.argmin(1)
    return which[least], far[np.arange(len(x)), least]


def assign(
    x: np.ndarray, codebooks: np.ndarray, moved: np.ndarray, code: np.ndarray | None, far: np.ndarray | None
) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entries (n, parts) and distances of rows (n, parts, width), from those of the round before.

    ``moved`` (parts, entries) tells which entries are not where they were. An entry that stayed
    was, among those that stayed, the nearest before and is still; only the moved ones
    can take its place, by a smaller distance or an equal one and a lower index.
    """
    n, parts = x.shape[:2]
    new_code, new_far = np.empty((n, parts), np.int64), np.empty((n, parts), np.int64)
    everything = np.arange(codebooks.shape[1])
    for p in range(parts):
        active = np.flatnonzero(moved[p])
        again = np.ones(n, bool) if code is None else moved[p][code[:, p]]
        rows = np.flatnonzero(again)
        if len(rows):
            new_code[rows, p], new_far[rows, p] = _scan(x[rows, p], codebooks[p], everything)
        rows = np.flatnonzero(~again)
        if len(rows):
            had, was = code[rows, p], far[rows, p]
            if len(active):
                best, least = _scan(x[rows, p], codebooks[p], active)
                better = (least < was) | ((least == was) & (best < had))
                had, was = np.where(better, best, had), np.where(better, least, was)
            new_code[rows, p], new_far[rows, p] = had, was
    return new_code, new_far


def _fixed(column: pa.Array, kind, width: int) -> np.ndarray:
    """Binary values of one length as the rows of a matrix."""
    rows = len(column)
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if rows else 0
    size = rows * width * np.dtype(kind).itemsize
    return np.frombuffer(column.buffers()[2], np.uint8)[start : start + size].view(kind).reshape(rows, width)


def _binary(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    ends = pa.py_buffer((np.arange(rows + 1) * (width * matrix.itemsize)).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), rows, [None, ends, pa.py_buffer(np.ascontiguousarray(matrix).tobytes())])


def _step(state: DataFrame, kept: Sequence[str], codebooks: np.ndarray, moved: np.ndarray, first: bool) -> DataFrame:
    """The state after one assignment: the kept columns, the integers, the code and the distances."""
    parts, _, width = codebooks.shape
    schema = T.StructType([
        *(state.schema[k] for k in kept), T.StructField("v", T.BinaryType()),
        T.StructField("code", T.BinaryType()), T.StructField("far", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                v = part.column("v")
                x = _fixed(v, np.int32, parts * width).astype(np.int64).reshape(-1, parts, width)
                code = far = None
                if not first:
                    code = _fixed(part.column("code"), np.uint8, parts).astype(np.int64)
                    far = _fixed(part.column("far"), np.int64, parts)
                code, far = assign(x, codebooks, moved, code, far)
                columns = [*(part.column(k) for k in kept), v, _binary(code.astype(np.uint8)), _binary(far)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return state.mapInArrow(run, schema)


def _sums(state: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sums (parts, entries, width) and counts (parts, entries) of the parts at each entry.

    Every task adds up its own rows; the driver gets one row per number of the codebooks.
    """
    parts, entries, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = _fixed(batch.column("v"), np.int32, parts * width).astype(np.int64).reshape(-1, parts, width)
            code = _fixed(batch.column("code"), np.uint8, parts)
            for p in range(parts):
                count[p] += np.bincount(code[:, p], minlength=entries)
                for e in np.unique(code[:, p]):
                    total[p, e] += x[code[:, p] == e, p].sum(0)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))],
            ["part", "entry", "n", "sums"],
        )

    found = state.select("v", "code").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    rows = found.groupBy("part", "entry").agg(F.sum("n"), F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(width)))).collect()
    total, count = np.zeros(shape, np.int64), np.zeros((parts, entries), np.int64)
    for p, e, n, sums in rows:
        count[p, e], total[p, e] = n, sums
    return total, count


def compress(
    vectors: DataFrame, keep: Sequence[str], vec_id: str = "vec_id", vector: str = "embedding", settings: Settings = Settings()
) -> Codes | None:
    """Learn codebooks from all vectors and code every one of them; None without a usable vector.

    Left out are rows whose vector is null, empty, holds null or a component that is not finite, or
    has a length that the parts do not divide or other than that of the first one. Each codebook
    begins with the parts of the first vectors by id (null last, equal ids by their
    components), fewer entries if there are fewer vectors. Repeated rows count as often as they
    are there. Components beyond +-2^27 or so (at 64 dimensions) after scaling count as that bound.
    A kept column named ``code`` or ``error`` is replaced. Rounds end early once no entry moves:
    nothing would change any more.
    """
    parts, scale = settings.parts, settings.scale
    kept = [c for c in keep if c.lower() not in ("code", "error")]
    names = [f"k{i}" for i in range(len(kept))]
    x = col(vector).cast("array<double>")
    usable = F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & (F.size(x) > 0) & (F.size(x) % parts == 0)
    rows = vectors.filter(usable).select(*(col(c).alias(n) for c, n in zip(kept, names)), col(vec_id).alias("id"), x.alias("x"))
    begin = rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(1).collect()
    if not begin:
        return None
    dims = len(begin[0]["x"])
    rows = rows.filter(F.size("x") == dims)
    begin = rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(settings.entries).collect()
    codebooks = whole(np.array([r["x"] for r in begin]), scale, dims).reshape(len(begin), parts, -1).transpose(1, 0, 2).copy()

    bound_batches(vectors.sparkSession)
    raw = T.StructType([*(rows.schema[n] for n in names), T.StructField("v", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
            packed = _binary(whole(values, scale, dims).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), packed], raw.names)

    moved = np.ones(codebooks.shape[:2], bool)
    state = stored(_step(rows.drop("id").mapInArrow(pack, raw), names, codebooks, moved, True), "assigned")
    for _ in range(settings.rounds):
        total, count = _sums(state, codebooks.shape)
        used = count > 0
        new = codebooks.copy()
        new[used] = np.floor_divide(total[used], count[used][:, None])
        moved = (new != codebooks).any(2)
        codebooks = new
        if not moved.any():
            break
        before, state = state, stored(_step(state, names, codebooks, moved, False), "assigned")
        discard(before)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            error = _fixed(batch.column("far"), np.int64, parts).sum(1)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), batch.column("code"), pa.array(error)], out.names)

    out = T.StructType([*(rows.schema[n] for n in names), T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    done = state.mapInArrow(finish, out)
    return Codes(done.select(*(F.col(n).alias(c) for c, n in zip(kept, names)), "code", "error"), codebooks)
