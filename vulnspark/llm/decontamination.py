"""Find passages of a benchmark in documents by the n-grams they share, and cut them out."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnspark.llm.common import Shipped, _ODD, as_bytes, map_rows, powers, stored

# Every byte that is neither a digit, a letter of ASCII nor part of another character separates words.
_SEPARATE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)

FIELDS = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:int,end:int>>, clean_text string"


def words(text: bytes) -> list[bytes]:
    return text.translate(_SEPARATE).split()


def benchmark_windows(benchmark: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct (window, item): n consecutive words; an item of fewer words, but one at least, is one window."""

    def cut(texts: pa.Array) -> list:
        out = []
        for text in as_bytes(texts):
            w = words(text)
            grams = {b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else ()
            out.append([g.decode() for g in grams])
        return [out]

    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return (
        map_rows(items, ["text"], ["item"], "grams array<string>", cut)
        .select("item", F.explode("grams").alias("gram"))
        .groupBy("gram").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )


@dataclass
class GramSet:
    """Windows by length: sorted hashes, the words of each window, and its items."""

    vocabulary: dict[bytes, int]
    by_length: dict[int, tuple[np.ndarray, np.ndarray, list[list[str]]]]

    @staticmethod
    def build(rows) -> GramSet:
        vocabulary: dict[bytes, int] = {}
        grams: dict[int, list] = {}
        for gram, items in rows:
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in gram.encode().split(b" ")]
            grams.setdefault(len(ids), []).append((ids, list(items)))
        by_length = {}
        for length, found in grams.items():
            ids = np.array([g for g, _ in found], np.int64)
            hashes = _window_hashes(ids)
            order = np.argsort(hashes, kind="stable")
            by_length[length] = (hashes[order], ids[order], [found[i][1] for i in order])
        return GramSet(vocabulary, by_length)

    def hits(self, ids: np.ndarray) -> list[tuple[int, int, list[str]]]:
        """(first word, length, items) of every window that occurs in the word ids."""
        out = []
        unknown = np.concatenate(([0], np.cumsum(ids < 0)))
        for length, (hashes, grams, items) in self.by_length.items():
            if len(ids) < length:
                continue
            at = np.flatnonzero(unknown[length:] == unknown[:-length])
            windows = np.lib.stride_tricks.sliding_window_view(ids, length)
            for part in np.array_split(at, len(at) // 200_000 + 1):
                h = _window_hashes(windows[part])
                k = np.searchsorted(hashes, h)
                while True:  # equal hashes stand side by side: try each
                    ok = k < len(hashes)
                    ok[ok] = hashes[k[ok]] == h[ok]
                    part, h, k = part[ok], h[ok], k[ok]
                    if not len(part):
                        break
                    same = (windows[part] == grams[k]).all(axis=1)
                    out += [(p, length, items[j]) for p, j in zip(part[same].tolist(), k[same].tolist())]
                    k = k + 1
        return out


def _window_hashes(ids: np.ndarray) -> np.ndarray:
    p = powers(ids.shape[1], _ODD)
    h = np.zeros(len(ids), np.uint64)
    for j in range(ids.shape[1]):
        h += (ids[:, j].astype(np.uint64) + np.uint64(1)) * p[j]
    return h


def _byte_spans(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as byte ranges of the text."""
    flat = np.frombuffer(text.translate(_SEPARATE), np.uint8) != 0x20
    edge = np.diff(np.concatenate(([False], flat, [False])).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    run = np.diff(np.concatenate(([False], hit, [False])).view(np.int8))
    first, last = np.flatnonzero(run == 1), np.flatnonzero(run == -1) - 1
    return list(zip(starts[first].tolist(), ends[last].tolist()))


def _scan(grams, texts: pa.Array) -> list:
    grams = grams.value
    find = grams.vocabulary.get
    raw = as_bytes(texts)
    ids, counts = [], []
    for text in raw:
        found = [find(w, -1) for w in words(text)]
        counts.append(len(found))
        ids += found
        ids.append(-1)  # no window crosses documents
    flat = np.array(ids, np.int64)
    begin = np.concatenate(([0], np.cumsum(np.array(counts, np.int64) + 1)))
    n_hit, items, spans = [0] * len(raw), [[] for _ in raw], [[] for _ in raw]
    clean = texts.to_pylist()
    by_doc: dict[int, list] = {}
    for first, length, of in grams.hits(flat):
        by_doc.setdefault(int(np.searchsorted(begin, first, "right")) - 1, []).append((first, length, of))
    for d, hits in by_doc.items():
        step = np.zeros(counts[d] + 1, np.int64)
        for first, length, _ in hits:
            step[first - begin[d]] += 1
            step[first - begin[d] + length] -= 1
        hit = np.cumsum(step[:-1]) > 0
        n_hit[d] = int(hit.sum())
        items[d] = sorted({i for _, _, of in hits for i in of})
        spans[d] = _byte_spans(raw[d], hit)
        cuts = [0, *(x for s in spans[d] for x in s), len(raw[d])]
        clean[d] = b"".join(raw[d][a:b] for a, b in zip(cuts[::2], cuts[1::2])).decode()
    return [counts, n_hit, items, [[{"start": a, "end": b} for a, b in s] for s in spans], clean]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    n: int = 10,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    broadcast_windows: int = 500_000,
) -> DataFrame:
    """Per document the ``keep`` columns and ``n_words, n_hit, items, spans, clean_text``.

    The benchmark's windows of ``n`` words go to every task as a hash set. If there are
    more than ``broadcast_windows`` of them, they are dealt by hash into blocks of that
    size and each block takes a pass over the documents, whose hits add up; no more
    than one block is ever held at once.

    ``items`` are the ids, as sorted strings, of the items with a window in the
    document; ``spans`` the byte ranges of the runs of hit words, and ``clean_text``
    the text without them. A null text has no words, no hits and stays null. An item
    without an id marks words but is not listed; repeated item rows count once. With
    an empty benchmark nothing is hit. Repeated documents are judged one by one.
    """
    spark = docs.sparkSession
    windows = stored(benchmark_windows(benchmark, n, item_id, item_text), "benchmark_windows")
    blocks = -(-windows.count() // broadcast_windows)
    if blocks <= 1:
        held = Shipped(spark, GramSet.build(windows.collect()))
        return map_rows(docs, [text_col], keep, FIELDS, lambda texts: _scan(held, texts))
    return _in_blocks(docs, windows, keep, text_col, blocks)


def _in_blocks(docs: DataFrame, windows: DataFrame, keep: list[str], text_col: str, blocks: int) -> DataFrame:
    """One pass per block of windows; the spans and items found so far travel with each row."""
    spark = docs.sparkSession
    out = None
    for b in range(blocks):
        part = windows.filter(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == b)
        held = Shipped(spark, GramSet.build(part.collect()))
        if out is None:
            columns = list(dict.fromkeys([*keep, text_col]))
            source = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)))
            text = f"c{columns.index(text_col)}"
            kept = list(source.columns)
            out = map_rows(source, [text], kept, FIELDS, lambda texts, h=held: _scan(h, texts))
        else:
            out = map_rows(
                out, [text, "items", "spans"], kept, FIELDS,
                lambda texts, items, spans, h=held: _joined(h, texts, items, spans),
            )
        out = stored(out, "decontaminated")
        held.unpersist()
    names = [f.split()[0] for f in ("n_words", "n_hit", "items", "spans", "clean_text")]
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep) if c.lower() not in names), *names)


def _joined(held, texts: pa.Array, items: pa.Array, spans: pa.Array) -> list:
    """A pass whose hits join those of earlier passes."""
    counts, _, new_items, new_spans, _ = _scan(held, texts)
    clean, n_hit = texts.to_pylist(), []
    for d, (text, was_items, was) in enumerate(zip(as_bytes(texts), items.to_pylist(), spans.to_pylist())):
        new_items[d] = sorted({*new_items[d], *was_items})
        merged: list[list[int]] = []
        flat = np.frombuffer(text.translate(_SEPARATE), np.uint8) != 0x20
        covered = np.zeros(len(flat) + 1, np.int64)
        for s in [*new_spans[d], *was]:
            covered[s["start"]] += 1
            covered[s["end"]] -= 1
        starts = np.flatnonzero(np.diff(np.concatenate(([False], flat)).view(np.int8)) == 1)
        hit = np.cumsum(covered[:-1])[starts] > 0 if len(starts) else np.zeros(0, bool)
        n_hit.append(int(hit.sum()))
        merged = _byte_spans(text, hit) if len(starts) else []
        new_spans[d] = [{"start": a, "end": b} for a, b in merged]
        if merged:
            cuts = [0, *(x for s in merged for x in s), len(text)]
            clean[d] = b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2])).decode()
    return [counts, n_hit, new_items, new_spans, clean]
