"""Exact top-k inner products by a three-phase uniform threshold over parts of the dimensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vulnspark.llm.common import stored

# A cell multiplies a pack of queries with a pack of candidates.
PACK_ROWS = 8192
QUERY_ROWS = 1024

ENTRY = "q bigint, c bigint, id bigint, list int, s bigint"
NAMED = "qp int, cp int, named binary"


def _pack_of(row: str, packs: int) -> Column:
    return F.pmod(F.xxhash64(row), F.lit(packs)).cast("int")


def _apart(side: DataFrame) -> DataFrame:
    """Never broadcast, however small the files look: a pack is copied for every pack of the other side, and the
    planner sizes the files before the copies are made, which would all gather on the driver."""
    return side.hint("merge")


def _packs(vectors: DataFrame, packs: int, width: int, lists: int) -> DataFrame:
    """(pack, list, data, sums): vectors cut by dimension; data holds counts, ids, rows and components."""
    cut = [width * i // lists for i in range(lists + 1)]

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        m = np.zeros((t.num_rows, width), np.int64)
        for r, v in enumerate(t.column("v").to_pylist()):
            m[r, : len(v)] = v
        ids, rows = t.column("id").to_numpy(), t.column("row").to_numpy()
        data, sums = [], []
        for a, b in zip(cut, cut[1:]):
            part = m[:, a:b]
            small = np.abs(part).max(initial=0) < 1 << 15
            head = np.concatenate(([len(ids), b - a, int(small)], ids, rows)).astype("<i8").tobytes()
            data.append(head + part.astype("<i2" if small else "<i8").tobytes())
            sums.append(part.sum(axis=0, dtype=np.float64).tolist())
        return pa.table(
            {
                "pack": pa.array([key[0].as_py()] * lists, pa.int32()), "list": pa.array(range(lists), pa.int32()),
                "data": pa.array(data, pa.binary()), "sums": pa.array(sums, pa.list_(pa.float64())),
            }
        )

    keyed = vectors.withColumn("pack", _pack_of("row", packs))
    return keyed.groupBy("pack").applyInArrow(pack, "pack int, list int, data binary, sums array<double>")


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, d, small = np.frombuffer(data, "<i8", 3).tolist()
    ids, rows = np.frombuffer(data, "<i8", 2 * n, 24).reshape(2, n)
    return ids, rows, np.frombuffer(data, "<i2" if small else "<i8", n * d, 24 + 16 * n).reshape(n, d).astype(np.int64)


def _factors(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As floating point where every sum of products is exact there, else as integers."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    kind = np.float32 if top < 2.0**24 else np.float64 if top < 2.0**53 else np.int64
    return q.astype(kind), c.T.astype(kind)


def _entries(q, c, ids, number: int, s) -> pa.RecordBatch:
    columns = [q, c, ids, np.full(len(q), number, np.int32), s.astype(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["q", "c", "id", "list", "s"])


def _named(cell: dict, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """The pairs that a list names in a cell, by their places in the two packs."""
    data = np.stack([i, j], axis=1).astype("<i4").tobytes()
    return pa.RecordBatch.from_arrays(
        [pa.array([cell["qp"]], pa.int32()), pa.array([cell["cp"]], pa.int32()), pa.array([data], pa.binary())],
        names=["qp", "cp", "named"],
    )


def _places(rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    order = np.argsort(rows)
    return order[np.searchsorted(rows[order], wanted)]


def _by_row(rows: np.ndarray, cuts: list[dict], name: str) -> np.ndarray:
    """A value per query of the pack; queries without candidates have none and get the largest."""
    out = np.full(len(rows), np.inf) if name == "above" else np.full(len(rows), np.iinfo(np.int64).max)
    out[_places(rows, np.array([x["q"] for x in cuts], np.int64))] = [x[name] for x in cuts]
    return out


def _cells(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def top_k(
    vectors: DataFrame, queries: Column, k: int, id_col: str = "id", vector_col: str = "v", lists: int = 2
) -> DataFrame:
    """The ``k`` best candidates of every query by integer inner product: query_id, rank, id, score.

    ``vectors`` has a long id and an array of longs; ``queries`` is a condition on the
    column ``id``. Each vector is cut by dimension into ``lists`` lists, which stand
    for the nodes that hold partial scores.

    1. Every list gives its ``k`` best partial scores per query. The whole scores of
       these candidates are resolved; the k-th best of them is a cutoff that the
       answer reaches for sure.
    2. What the cutoff is above the mean score is shared evenly by the lists. Each
       list sends every entry that reaches its own mean plus that share. What no list
       sends lies below the cutoff.
    3. The partial scores that are missing of what was sent are resolved, and the
       ``k`` best whole scores remain.

    Ties go to the smaller id, then the row. Each row but the query's own is a
    candidate, rows that repeat an id too. Rows with a null id or vector, or null
    components, take no part; shorter vectors count as padded with zeros; fewer than
    ``k`` candidates are all returned; an empty table gives an empty result.
    """
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<bigint>").alias("v"))
    clean = clean.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    rows = stored(clean.withColumn("row", F.monotonically_increasing_id()), "search_rows")
    asked = rows.filter(queries)
    count, n_queries, width = rows.agg(
        F.count("*"), F.count(F.when(queries, 1)), F.coalesce(F.max(F.size("v")), F.lit(0))
    ).first()
    lists = max(1, min(lists, width))
    n_c, n_q = max(1, -(-count // PACK_ROWS)), max(1, -(-n_queries // QUERY_ROWS))
    c_packs = stored(_packs(rows, n_c, width, lists), "candidate_packs")
    q_packs = stored(_packs(asked, n_q, width, lists), "query_packs")
    q_side = q_packs.select(F.col("pack").alias("qp"), "list", F.col("data").alias("q_data"))
    c_side = c_packs.select(F.col("pack").alias("cp"), "list", F.col("data").alias("c_data"))

    def every(packs: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(packs - 1)))

    # Every query pack meets every candidate pack, list by list.
    def cells(q_side: DataFrame) -> DataFrame:
        return q_side.withColumn("cp", every(n_c)).join(_apart(c_side.withColumn("qp", every(n_q))), ["qp", "cp", "list"])

    def best_of_list(batches):
        for cell in _cells(batches):
            (_, q_row, q), (ids, c_row, c) = _unpack(cell["q_data"]), _unpack(cell["c_data"])
            left, right = _factors(q, c)
            m = min(k + 1, len(c_row))  # the query's own row may be among them
            for a in range(0, len(q_row), 128):
                s = left[a : a + 128] @ right
                best = np.argpartition(-s, m - 1, axis=1)[:, :m]
                who, j = np.repeat(q_row[a : a + 128], m), best.ravel()
                other = who != c_row[j]
                s = np.take_along_axis(s, best, axis=1).ravel()[other]
                yield _entries(who[other], c_row[j[other]], ids[j[other]], cell["list"], s)

    def named(cell, pairs_of: str) -> np.ndarray:
        return np.concatenate([np.frombuffer(x["named"], "<i4").reshape(-1, 2) for x in cell[pairs_of]]).astype(np.int64)

    def best_of(ids, c_row, kept):
        i, j, s = (np.concatenate(x) for x in zip(*kept))
        order = np.lexsort((c_row[j], ids[j], -s, i))
        i, j, s = i[order], j[order], s[order]
        first = np.searchsorted(i, i)
        few = np.arange(len(i)) - first < k
        return i[few], j[few], s[few]

    def resolve(batches, exact: bool):
        """Whole scores of all pairs that some list named, list by list; with ``exact`` only those that reach the
        cutoff, and of a query no more than its ``k`` best in the cell: of any number of equal vectors no more can count."""
        for cell in _cells(batches):
            q_parts = [_unpack(x["data"]) for x in sorted(cell["q_lists"], key=lambda x: x["list"])]
            c_parts = [_unpack(x["data"]) for x in sorted(cell["c_lists"], key=lambda x: x["list"])]
            (_, q_row, _), (ids, c_row, _) = q_parts[0], c_parts[0]
            code = np.unique(named(cell, "named_by") @ np.array([len(c_row), 1]))
            floor = _by_row(q_row, cell["cuts"], "cutoff") if exact else None
            kept = []
            for part in np.array_split(code, len(code) // 65_536 + 1):
                i, j = part // max(1, len(c_row)), part % max(1, len(c_row))
                s = sum((q[i] * c[j]).sum(axis=1) for (_, _, q), (_, _, c) in zip(q_parts, c_parts))
                if not exact:
                    yield _entries(q_row[i], c_row[j], ids[j], 0, s)
                    continue
                ok = s >= floor[i]
                kept.append((i[ok], j[ok], s[ok]))
                if len(kept) > 64:
                    kept = [best_of(ids, c_row, kept)]
            if exact:
                i, j, s = best_of(ids, c_row, kept)
                yield _entries(q_row[i], c_row[j], ids[j], 0, s)

    def with_packs(found: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
        """A row per pair of packs: what all lists named there, the vectors, and the cutoffs of the queries."""
        by_cell = found.groupBy("qp", "cp").agg(F.collect_list(F.struct("named")).alias("named_by"))
        whole = F.collect_list(F.struct("list", "data"))
        q_all = q_packs.groupBy(F.col("pack").alias("qp")).agg(whole.alias("q_lists"))
        q_all = q_all if cuts is None else q_all.join(_apart(cuts), "qp")
        c_all = c_packs.groupBy(F.col("pack").alias("cp")).agg(whole.alias("c_lists"))
        return by_cell.join(_apart(q_all), "qp").join(_apart(c_all), "cp")

    # 1. Local lists: the places in the packs of each list's best.
    in_list = W.partitionBy("q", "list").orderBy(F.desc("s"), "id", "c")
    first = (
        cells(q_side).mapInArrow(best_of_list, ENTRY).withColumn("n", F.row_number().over(in_list))
        .filter(F.col("n") <= k).select("q", "c").distinct()
        .groupBy(_pack_of("q", n_q).alias("qp"), _pack_of("c", n_c).alias("cp"))
        .agg(F.collect_list(F.struct("q", "c")).alias("pairs"))
    )

    def place(batches):
        for cell in _cells(batches):
            _, q_row, _ = _unpack(cell["q_data"])
            _, c_row, _ = _unpack(cell["c_data"])
            pairs = np.array([(x["q"], x["c"]) for x in cell["pairs"]], np.int64)
            yield _named(cell, _places(q_row, pairs[:, 0]), _places(c_row, pairs[:, 1]))

    placed = first.join(_apart(q_side.filter("list = 0").drop("list")), "qp").join(_apart(c_side.filter("list = 0").drop("list")), "cp")
    placed = placed.mapInArrow(place, NAMED)
    by_score = W.partitionBy("q").orderBy(F.desc("s"), "id", "c")
    known = with_packs(placed).mapInArrow(lambda b: resolve(b, False), ENTRY)
    cutoff = (
        known.withColumn("n", F.row_number().over(by_score)).filter(F.col("n") <= k)
        .groupBy("q").agg(F.min("s").alias("cutoff"), F.count("*").alias("n"))
    )
    mean = np.zeros(width)
    sums = c_packs.select("list", F.posexplode("sums")).groupBy("list", "pos").agg(F.sum("col").alias("x"))
    for r in sums.collect():  # one number per dimension
        mean[width * r["list"] // lists + r["pos"]] = r["x"] / max(1, count)
    whole_mean = F.aggregate(
        F.zip_with("v", F.lit(mean.tolist()).cast("array<double>"), lambda x, m: F.coalesce(x * m, F.lit(0.0))),
        F.lit(0.0), lambda a, x: a + x,
    )
    means = asked.select(F.col("row").alias("q"), whole_mean.alias("mean"))
    # A little below the exact value, for rounding; a query with fewer than k candidates has no cutoff.
    slack = 0.5 + 1e-9 * (F.abs("cutoff") + F.abs("mean"))
    above = F.when(F.col("n") == k, F.col("cutoff") - F.col("mean") - slack).otherwise(float("-inf"))
    least = F.when(F.col("n") == k, F.col("cutoff")).otherwise(F.lit(-(1 << 63)))
    cuts = (
        cutoff.join(_apart(means), "q").select("q", above.alias("above"), least.alias("cutoff"))
        .groupBy(_pack_of("q", n_q).alias("qp")).agg(F.collect_list(F.struct("q", "above", "cutoff")).alias("cuts"))
    )
    cuts = stored(cuts, "cutoffs")

    # 2. Each list sends what reaches its share of the cutoff.
    def reaching(batches):
        for cell in _cells(batches):
            (_, q_row, q), (ids, c_row, c) = _unpack(cell["q_data"]), _unpack(cell["c_data"])
            first_dim = width * cell["list"] // lists
            floor = q @ mean[first_dim : first_dim + q.shape[1]] + _by_row(q_row, cell["cuts"], "above") / lists
            left, right = _factors(q, c)
            found = []
            for a in range(0, len(q_row), 128):
                i, j = np.nonzero(left[a : a + 128] @ right >= floor[a : a + 128, None])
                other = q_row[a + i] != c_row[j]
                found.append((a + i[other], j[other]))
            yield _named(cell, *(np.concatenate(x) for x in zip(*found)))

    sent = cells(q_side.join(_apart(cuts), "qp")).mapInArrow(reaching, NAMED)
    # 3. What was sent is resolved.
    final = with_packs(sent, cuts).mapInArrow(lambda b: resolve(b, True), ENTRY)
    ranked = final.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    return ranked.join(_apart(asked.select(F.col("row").alias("q"), F.col("id").alias("query_id"))), "q").select(
        "query_id", "rank", "id", F.col("s").alias("score")
    )
