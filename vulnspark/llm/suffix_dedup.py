"""Remove repeated byte strings with an enhanced suffix array over sampled suffixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnspark.llm.common import (
    as_bytes, bound_batches, byte_sums, col, discard, map_rows, mixed, partitions, slices, stored, stretch_hash,
)

GRAM = 64
GROUP_LIMIT = 60_000
SAMPLE_BYTES = 1 << 20  # hashing takes a hundred times as much for a moment
BITS_EACH = 16
MOST_BITS = 1 << 28

MARKS = "n_bytes bigint, n_removed bigint, spans array<struct<start:int,end:int>>, kept binary"


# -- which suffixes ---------------------------------------------------------------


def anchors(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, width: int, gram: int):
    """Sampled suffixes: in every ``width`` bytes of a text, the gram with the least hash, the first of equals.

    Equal strings of that width pick the same place in them, so of two equal strings
    both are found through their samples. Returns owner, place in the text, key (hash
    of the gram) and context (hash of all bytes that a string through it can reach).
    """
    span = width - gram + 1
    n = len(data) - gram + 1
    none = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)] * 2
    long_enough = ends - begins >= width
    if n < span or not long_enough.any():
        return none
    sums = byte_sums(data)
    place = np.arange(n)
    hashes = stretch_hash(sums, place, place + gram)
    # Below the hash stands the place in a block of ``span`` grams: a window meets two blocks at most,
    # and of equal hashes the first block's counts, so the first of equals wins wherever the text is cut.
    bits = np.uint64(max(1, (span - 1).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    padded = np.full(-(-n // span) * span, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = (hashes & ~low) | (place % span).astype(np.uint64)
    blocks = padded.reshape(-1, span)
    up_to = np.minimum.accumulate(blocks, axis=1).ravel()
    from_on = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - span + 1)
    here, next_ = from_on[: len(starts)], up_to[span - 1 : span - 1 + len(starts)]
    first = here >> bits <= next_ >> bits
    at = np.where(first, starts, starts + span - 1) // span * span + (np.where(first, here, next_) & low).astype(np.int64)
    # Windows that cross from one text to the next do not count.
    owner = np.searchsorted(ends, starts, "right")
    inside = starts + width <= ends[np.minimum(owner, len(ends) - 1)]
    at = at[inside]
    at = at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at
    owner = np.searchsorted(ends, at, "right")
    lo = np.maximum(begins[owner], at - (width - gram))
    hi = np.minimum(ends[owner], at + width)
    context = mixed(stretch_hash(sums, lo, hi) + (at - lo).astype(np.uint64))
    return owner, at - begins[owner], hashes[at], context


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    return np.frombuffer(b"".join(texts), np.uint8), begins, ends


def _sampled(rows: DataFrame, width: int, gram: int) -> DataFrame:
    bound_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, SAMPLE_BYTES):
                owner, at, key, context = anchors(*_joined(as_bytes(part.column("text"))), width, gram)
                ids = [part.column(c).to_numpy()[owner] for c in ("d", "t")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (*ids, key.view(np.int64), context.view(np.int64), at.astype(np.int32))],
                    names=["d", "t", "key", "context", "at"],
                )

    return rows.select("d", "t", "text").mapInArrow(run, "d bigint, t bigint, key bigint, context bigint, at int")


# -- the suffix array of a group --------------------------------------------------


def _common(a: list[bytes]) -> np.ndarray:
    """Length of the common prefix of each string with the one before it; 0 for the first."""
    out = np.zeros(len(a), np.int64)
    for i in range(1, len(a)):
        x, y = a[i - 1], a[i]
        n = min(len(x), len(y))
        if x[:n] == y[:n]:
            out[i] = n
        else:
            p, q = np.frombuffer(x, np.uint8, n), np.frombuffer(y, np.uint8, n)
            out[i] = int((p != q).argmax())
    return out


def repeats(lefts: list[bytes], rights: list[bytes], width: int) -> list[list[tuple[int, int]]]:
    """Ranges [x, y] for each suffix: the string of ``width`` bytes that begins that far before it occurs elsewhere.

    ``lefts`` are the bytes before each suffix, backwards. The suffixes are sorted, and a
    scan with a stack yields the tree of intervals with a common prefix. In an
    interval of common length l, strings begin at least ``width - l`` before the suffix;
    its members, sorted by what precedes them, show how far each agrees to the left
    with another. Where they differ at once the repeat ends (it is maximal to the
    left); every member gets its range, not only neighbours in the array.
    """
    m = len(rights)
    out: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    order = sorted(range(m), key=rights.__getitem__)
    common = _common([rights[i] for i in order])
    by_left = sorted(range(m), key=lefts.__getitem__)
    left_common = _common([lefts[i] for i in by_left])
    rank = np.empty(m, np.int64)
    rank[by_left] = np.arange(m)
    most_left = int(left_common.max(initial=0))
    order = np.array(order)

    def interval(length: int, a: int, b: int) -> None:
        if length + most_left < width:
            return
        ranks = np.sort(rank[order[a:b]])
        agree = np.minimum.reduceat(left_common[: ranks[-1] + 1], ranks[:-1] + 1) if len(ranks) > 1 else []
        best = np.zeros(len(ranks), np.int64)
        best[1:] = agree
        best[:-1] = np.maximum(best[:-1], agree)
        first = width - length
        for r, y in zip(ranks[best >= first].tolist(), best[best >= first].tolist()):
            out[by_left[r]].append((first, y))

    stack: list[tuple[int, int]] = []  # (common length, first place)
    for i in range(1, m + 1):
        now = min(int(common[i]), width) if i < m else 0
        begin = i - 1
        while stack and stack[-1][0] > now:
            length, begin = stack.pop()
            interval(length, begin, i)
        if now and (not stack or stack[-1][0] < now):
            stack.append((now, begin))
    return out


def _resolve(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The groups of one partition, which come one after the other: no more than one is held."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    now, members = None, {}
    keys, contexts, spans = [], [], []

    def settle() -> None:
        if len(members) > 1:
            found = repeats([x for x, _ in members.values()], [x for _, x in members.values()], width)
            for context, ranges in zip(members, found):
                if ranges:
                    keys.append(now)
                    contexts.append(context)
                    spans.append([{"start": -y, "end": width - x} for x, y in ranges])

    def made() -> pa.RecordBatch:
        columns = [pa.array(keys, pa.int64()), pa.array(contexts, pa.int64()), pa.array(spans, kind)]
        keys.clear(), contexts.clear(), spans.clear()
        return pa.RecordBatch.from_arrays(columns, names=["key", "context", "spans"])

    for b in batches:
        for key, context, left, right in zip(*(b.column(c).to_pylist() for c in ("key", "context", "left", "right"))):
            if key != now:
                settle()
                now, members = key, {}
            members[context] = (left, right)
        yield made()
    settle()
    yield made()


# -- the operator -----------------------------------------------------------------


def _joined_to(rows: DataFrame, found: DataFrame, name: str, others: bool) -> DataFrame:
    """``rows`` with the column ``name`` of the stored table ``found``, one row for each (d, t); with all ``others``, where it is null.

    Only texts whose hash has its bit among those of ``found`` are shuffled. The bits are
    broadcast, ``BITS_EACH`` for a row of ``found`` and 32 MB at most, beyond which more texts are shuffled in vain.
    """
    size = min(MOST_BITS, max(1 << 15, 1 << (BITS_EACH * found.count()).bit_length()))
    place = F.pmod(F.xxhash64("d", "t"), F.lit(size)) + 1
    bits = (
        found.select(F.bitmap_bucket_number(place).alias("block"), F.bitmap_bit_position(place).alias("bit")).repartition("block")
        .groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    likely = F.coalesce(F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1, F.lit(False))
    tested = (
        rows.withColumn("block", F.bitmap_bucket_number(place)).join(F.broadcast(bits), "block", "left")
        .withColumn("likely", likely).drop("block", "bits")
    )
    near = tested.filter("likely").drop("likely").join(found.select("d", "t", name), ["d", "t"], "left" if others else "inner")
    if not others:
        return near
    far = tested.filter("NOT likely").withColumn(name, F.lit(None).cast(found.schema[name].dataType))
    return near.unionByName(far.drop("likely"))


def _cut_out(texts: pa.Array, marks: pa.Array) -> list:
    sizes, removed, spans, kept = [], [], [], []
    for text, found in zip(as_bytes(texts), marks.to_pylist()):
        merged: list[list[int]] = []
        for a, b in sorted((max(0, s["start"]), min(len(text), s["end"])) for s in found or ()):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        cuts = [0, *(x for s in merged for x in s), len(text)]
        sizes.append(len(text))
        removed.append(sum(b - a for a, b in merged))
        spans.append([{"start": a, "end": b} for a, b in merged])
        kept.append(b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2])))
    return [sizes, removed, spans, kept]


def remove_repeats(
    docs: DataFrame, keep: list[str], width: int = 400, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM,
    sift: bool = False,
) -> DataFrame:
    """Per document the ``keep`` columns and ``n_bytes, n_removed, spans, kept``.

    Every byte goes that a string of ``width`` bytes covers which also starts anywhere
    else, in the same document or another; strings never cross documents and are
    judged on the input. ``kept`` are the other bytes.

    1. Each text is sampled so that equal strings are sampled at the same place; a
       sample stands for the suffix from there and the bytes before it.
    2. Samples with equal surroundings are counted: of two or more, all strings
       through them repeat. This settles exact copies, however many they are.
    3. Of samples with one gram but different surroundings, one each is brought together
       in a suffix array whose interval tree gives the repeats. A gram with more than
       ``GROUP_LIMIT`` different surroundings is not gathered: its strings are
       compared by their hashes in a count of their own.

    With ``sift`` only texts that may have a partner are shuffled, which are scanned once more for that.

    A null text counts as empty; shorter texts stay whole; equal rows are occurrences of
    each other; null ids are a value like any other; an empty table gives an empty result.
    """
    reach = width - gram
    columns = list(dict.fromkeys(keep))
    rows = docs.select(
        *(col(c).alias(f"c{i}") for i, c in enumerate(columns)),
        F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"),
        F.xxhash64(col(id_col)).alias("d"), F.xxhash64(col(text_col)).alias("t"),
    )
    samples = stored(_sampled(rows, width, gram), "suffix_samples")
    alike = samples.groupBy("key", "context").agg(F.count("*").alias("n"), F.min(F.struct("d", "t", "at")).alias("one"))
    alike = stored(alike, "suffix_contexts")
    keys = alike.groupBy("key").agg(F.sum("n").alias("all"), F.count("*").alias("m")).filter(F.col("m") > 1)
    whole = alike.filter("n > 1").select(
        "key", "context", F.array(F.struct(F.lit(-reach).alias("start"), F.lit(width).alias("end"))).alias("spans")
    )
    undecided = alike.join(keys, "key").select("key", "context", "m", "one.*")
    wanted = undecided.groupBy("d", "t").agg(F.collect_set(F.struct("key", "context", "at", "m")).alias("wanted"))
    if sift:
        wanted = stored(wanted, "suffix_wanted")
    asked = _joined_to(rows, wanted, "wanted", others=False) if sift else rows.join(wanted, ["d", "t"])

    def surroundings(texts: pa.Array, wanted: pa.Array) -> list:
        out = []
        for text, asked in zip(as_bytes(texts), wanted.to_pylist()):
            out.append(
                [
                    {
                        "key": w["key"], "context": w["context"], "hot": w["m"] > GROUP_LIMIT,
                        "left": text[max(0, w["at"] - reach) : w["at"]][::-1], "right": text[w["at"] : w["at"] + width],
                    }
                    for w in asked
                ]
            )
        return [out]

    contexts = (
        map_rows(
            asked, ["text", "wanted"], [],
            "found array<struct<key:bigint,context:bigint,hot:boolean,left:binary,right:binary>>", surroundings,
        )
        .select(F.explode("found").alias("f")).select("f.*")
    )
    hot = not keys.filter(F.col("m") > GROUP_LIMIT).isEmpty()
    if hot:
        contexts = stored(contexts, "suffix_surroundings")
    resolved = (
        contexts.filter("NOT hot").drop("hot").repartition(partitions(docs.sparkSession), "key").sortWithinPartitions("key")
        .mapInArrow(lambda b: _resolve(b, width), "key bigint, context bigint, spans array<struct<start:int,end:int>>")
    )
    marks = whole.unionByName(resolved)
    if hot:
        marks = marks.unionByName(_by_hash(contexts.filter("hot"), width))
    # Each table goes once what reads it is written.
    marks = stored(marks, "suffix_marks")
    discard(alike, wanted, contexts)
    at = F.transform(
        "spans", lambda s: F.struct((s["start"] + F.col("at")).alias("start"), (s["end"] + F.col("at")).alias("end"))
    )
    by_text = samples.join(marks, ["key", "context"]).select("d", "t", F.explode(at).alias("s")).groupBy("d", "t").agg(
        F.collect_set("s").alias("marks")
    )
    by_text = stored(by_text, "suffix_spans")
    discard(samples, marks)
    marked = _joined_to(rows, by_text, "marks", others=True) if sift else rows.join(by_text, ["d", "t"], "left")
    out = map_rows(
        marked, ["text", "marks"], [f"c{i}" for i in range(len(columns))], MARKS, _cut_out
    )
    new = ["n_bytes", "n_removed", "spans", "kept"]
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns) if c.lower() not in new), *new)


def _by_hash(contexts: DataFrame, width: int) -> DataFrame:
    """The same for grams with very many surroundings: every string through them, counted by its hash."""

    def strings(lefts: pa.Array, rights: pa.Array) -> list:
        out = []
        for left, right in zip(lefts.to_pylist(), rights.to_pylist()):
            data = np.frombuffer(left[::-1] + right, np.uint8)
            x = np.arange(len(left) + 1)
            x = x[width - x <= len(right)]
            start = len(left) - x
            h = stretch_hash(byte_sums(data), start, start + width).view(np.int64)
            out.append([{"x": a, "h": b} for a, b in zip(x.tolist(), h.tolist())])
        return [out]

    each = map_rows(contexts, ["left", "right"], ["key", "context"], "strings array<struct<x:int,h:bigint>>", strings)
    each = each.select("key", "context", F.explode("strings").alias("s")).select("key", "context", "s.*")
    twice = each.groupBy("key", "x", "h").count().filter("count > 1").drop("count")
    return each.join(twice, ["key", "x", "h"]).select(
        "key", "context",
        F.array(F.struct((-F.col("x")).cast("int").alias("start"), (F.lit(width) - F.col("x")).cast("int").alias("end"))).alias("spans"),
    )
