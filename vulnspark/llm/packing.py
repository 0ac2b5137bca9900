"""Pack tokenised documents into sequences by vector best-fit."""

from __future__ import annotations

import os
import sys
import zlib
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vulnspark.llm.common import as_bytes, col, map_rows, stored

PIECES = "pieces array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint,ids:binary>>"
CACHE_WORDS, KEPT_WORDS = 700_000, 250_000
# The splitting pattern of the tokenizer file: a fixed value.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Words with other signs than these, or with the beginning of a special token, are encoded whole. Letters
# of these blocks have one lower case, and none is a combining mark.
ODD = r"[^ ]*(?:[^ \x21-\x7E\u00A1-\u00AC\u00AE-\u012F\u0132-\u017F]|<\|)[^ ]*"
# Bytes of texts that are cut byte by byte: ASCII but for controls and the apostrophe, which begins parts of its
# own, and the letters from U+00C0 to U+017F but for the signs and letters in RARE.
KINDS = np.zeros(256, np.uint8)  # 0: white space
KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = 1
KINDS[0x30:0x3A] = 2
KINDS[[c for c in range(0x21, 0x7F) if not KINDS[c]]] = 3
EASY = bytes([9, 10, 11, 12, 13, 32, *(c for c in range(256) if KINDS[c] and c != 0x27)])
RARE = (b"<|", b"\xc3\x97", b"\xc3\xb7", b"\xc4\xb0", b"\xc4\xb1")
# Stands between words; no token has this id.
GAP = b"\xff\xff\xff\xff"
SALTS = 64


# -- tokens -----------------------------------------------------------------------


@dataclass
class Words:
    """Token ids of words, as bytes, kept over the batches of a worker.

    The tokenizer never joins what ASCII white space separates, so a text's ids are
    those of its words in turn; each word is looked up once. Nor does it
    join the parts of a word (letters, a digit, other signs), so words of common
    scripts are put together from their parts; all others, and those that may hold one of
    the tokenizer's special tokens, are encoded whole. New words are cut all at once, as one text.
    Texts of easy bytes only, most of them, are cut into parts at once and need no words.
    """

    path: str
    ids: dict[bytes, bytes] = field(default_factory=dict)
    parts: dict[str, bytes] = field(default_factory=dict)
    runs: dict[bytes, bytes] = field(default_factory=dict)
    tools: tuple = ()

    def of(self, texts: list[bytes]) -> list[bytes]:
        if not self.tools:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
            import regex
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(self.path)
            closes = np.zeros(tokenizer.get_vocab_size(), bool)
            closes[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
            self.tools = tokenizer, regex.compile(PARTS + "| "), regex.compile(ODD), closes
        for known in (self.ids, self.parts, self.runs):
            if len(known) > CACHE_WORDS:  # frequent words came first
                first = list(islice(known.items(), KEPT_WORDS))
                known.clear()
                known.update(first)
        easy = [not t.translate(None, EASY) and not any(r in t for r in RARE) for t in texts]
        cut = iter(self._of_easy([t for t, e in zip(texts, easy) if e]))
        words = iter(self._of_words([t for t, e in zip(texts, easy) if not e]))
        return [next(cut if e else words) for e in easy]

    def _of_easy(self, texts: list[bytes]) -> list[bytes]:
        """Parts are runs of letters or of other signs, and single digits: cut where the kind of byte changes."""
        if not texts:
            return []
        data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
        kinds = KINDS[data]
        begins = kinds != 0
        inside = begins[1:] & begins[:-1]
        begins[1:] &= ~inside | (kinds[1:] != kinds[:-1]) | (kinds[1:] == 2)
        gap = begins.copy()
        gap[1:] &= inside
        gap[0] = False
        spread = np.full(len(data) + int(gap.sum()), 32, np.uint8)
        spread[np.arange(len(data)) + np.cumsum(gap)] = data
        found = spread.tobytes().split()
        new = list(set(found).difference(self.runs))
        self.runs.update(zip(new, self._encode([r.decode() for r in new])))
        before = np.concatenate(([0], np.cumsum(begins)))
        ends = before[np.cumsum([len(t) + 1 for t in texts])].tolist()
        get = self.runs.__getitem__
        return [b"".join(map(get, found[a:b])) for a, b in zip([0, *ends], ends)]

    def _of_words(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        new = list(set().union(*split).difference(self.ids))
        for a in range(0, len(new), 100_000):
            self._learn(new[a : a + 100_000])
        get = self.ids.__getitem__
        return [b"".join(map(get, ws)) for ws in split]

    def _learn(self, words: list[bytes]) -> None:
        tokenizer, parts, odd, _ = self.tools
        text = b" ".join(words).decode()
        whole = list(set(odd.findall(text)))
        for a in range(0, len(whole), 20_000):
            some = whole[a : a + 20_000]
            found = tokenizer.encode_batch_fast(some, add_special_tokens=False)
            self.ids.update((w.encode(), np.array(e.ids, "<u4").tobytes()) for w, e in zip(some, found))
        if whole:
            words = [w for w in words if w not in self.ids]
            text = b" ".join(words).decode()
        cut = parts.findall(text.lower())
        new = list(set(cut).difference(self.parts, " "))
        self.parts.update(zip(new, self._encode(new)))
        self.parts[" "] = GAP
        flat = b"".join(map(self.parts.__getitem__, cut))
        ends = np.flatnonzero(np.frombuffer(flat, "<u4") == np.uint32(0xFFFFFFFF)) * 4
        begins, ends = [0, *(ends + 4).tolist()], [*ends.tolist(), len(flat)]
        if words:
            self.ids.update(zip(words, [flat[a:b] for a, b in zip(begins, ends)], strict=True))

    def _encode(self, parts: list[str]) -> list[bytes]:
        """The ids of each part. One text of many takes a fraction of the time of as many texts; a part's last token says so."""
        tokenizer, _, _, closes = self.tools
        out = []
        for a in range(0, len(parts), 2000):
            some = parts[a : a + 2000]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(closes[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                flat, ends = ids.tobytes(), (4 * ends).tolist()
                out += [flat[x:y] for x, y in zip([0, *ends], ends)]
            else:
                out += [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        return out


def _kept_words(path: str) -> Words:
    """One per Python worker: later tasks of the worker find the words of earlier ones."""
    return vars(sys).setdefault("_token_words", {}).setdefault(path, Words(path))


def _cut(path: str, end: bytes, most: int, with_ids: bool, texts: pa.Array) -> list:
    out = []
    for ids in _kept_words(path).of(as_bytes(texts)):
        ids += end
        n = len(ids) // 4
        out.append(
            [
                {
                    "piece": p, "start": a, "length": min(most, n - a),
                    "ids_crc32": zlib.crc32(ids[4 * a : 4 * (a + most)]),
                    "ids": ids[4 * a : 4 * (a + most)] if with_ids else None,
                }
                for p, a in enumerate(range(0, n, most))
            ]
        )
    return [out]


def token_pieces(
    docs: DataFrame, keep: list[str], tokenizer: str, text_col: str = "text", end_id: int = 1, most: int = 4096, ids: bool = False
) -> DataFrame:
    """One row per piece of a document: the ``keep`` columns, piece, start, length, ids_crc32 and, if asked for, ids.

    A document's ids end with ``end_id``; only one of more than ``most`` ids is cut. Special
    tokens in a text are tokens. ``tokenizer`` is the path of a tokenizers file, which must
    split at white space.

    A null or empty text is a document of its end alone; repeated rows are packed each; an
    empty table gives no piece. Kept columns named ``pieces``, ``piece``, ``start``, ``length``,
    ``ids_crc32`` or ``ids`` give way to the new ones.
    """
    end = np.array([end_id], "<u4").tobytes()
    cut = map_rows(docs, [text_col], keep, PIECES, lambda texts: _cut(tokenizer, end, most, ids, texts))
    new = ("pieces", "piece", "start", "length", "ids_crc32", "ids")
    kept = [c for c in keep if c.lower() not in new]
    # inline() names the new columns itself, so no kept column can clash with a helper.
    flat = cut.select(*(col(c) for c in kept), F.inline("pieces"))
    return flat if ids else flat.drop("ids")


# -- best fit ---------------------------------------------------------------------


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds: tokens, documents, and attention cost (the sum of squared lengths)."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.05, 0.2)
    rule: str = "norm"  # or "dot"


def best_fit(histogram: list[tuple[int, int]], capacity: Capacity) -> list[tuple[int, int, int, int, int, int]]:
    """Plan for pieces of these lengths: (length, lo, hi, per_bin, first_bin, offset).

    The pieces of a length are numbered; those from ``lo`` to ``hi`` go to bins from
    ``first_bin`` on, ``per_bin`` to each, the first at ``offset``. Lengths are placed
    from the longest down. A run of bins with equal contents is one entry: of all
    entries with room in tokens, documents and attention cost, the one is taken whose
    remainder has the least weighted norm (or, by the other rule, whose remainder has
    the greatest weighted dot product with the piece), and its bins are filled in
    turn, as best-fit would one by one. The work depends on the number of different
    lengths, at most the capacity, not on the number of pieces: some 10,000 entries for
    4096 lengths, be there 10^5 pieces or 10^8.
    """
    full = np.array([capacity.tokens, capacity.documents, capacity.attention], np.float64)
    weights = np.array(capacity.weights)
    free = np.zeros((1024, 3), np.int64)  # of each open entry
    first, bins = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
    n, next_bin, plan = 0, 0, []

    def add(room, at, count):
        nonlocal free, first, bins, n
        if n == len(first):
            free, first, bins = np.vstack([free, free * 0]), np.append(first, first * 0), np.append(bins, bins * 0)
        free[n], first[n], bins[n] = room, at, count
        n += 1

    for length, pieces in sorted(histogram, reverse=True):
        need, done = np.array([length, 1, length * length], np.int64), 0
        while done < pieces:
            fits = np.flatnonzero((free[:n] >= need).all(axis=1))
            if len(fits):
                room = free[fits]
                if capacity.rule == "norm":
                    e = fits[np.argmin((weights * ((room - need) / full) ** 2).sum(axis=1))]
                else:
                    e = fits[np.argmax((weights * (room / full) * (need / full)).sum(axis=1))]
                room, at, count = free[e].copy(), int(first[e]), int(bins[e])
                n -= 1
                free[e], first[e], bins[e] = free[n], first[n], bins[n]
            else:
                room = full.astype(np.int64)
                per = int((room // need).min())
                at, count = next_bin, -(-(pieces - done) // per)
                next_bin += count
            per = int((room // need).min())
            left = pieces - done
            whole, rest = min(count, left // per), 0
            if whole < count and whole * per < left:
                rest = left - whole * per
            offset = capacity.tokens - int(room[0])
            plan.append((length, done, done + whole * per + rest, per, at, offset))
            done += whole * per + rest
            if whole and (room - per * need)[:2].min() > 0:
                add(room - per * need, at, whole)
            if rest and (room - rest * need)[:2].min() > 0:
                add(room - rest * need, at + whole, 1)
            used = whole + (rest > 0)
            if used < count:
                add(room, at + used, count - used)
    return plan


def pack(pieces: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity.tokens``.

    Only the number of pieces of each length goes to the driver; the plan that comes
    back has some entries per length; both are bounded by the capacity. Pieces are numbered within their length and a
    salt, so that a length which a third of all pieces have is spread over tasks. The
    salt is stored with the pieces, because they are read more than once.
    """
    spark = pieces.sparkSession
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    whole = F.struct(*(col(c) for c in pieces.columns))
    salted = stored(pieces.select(whole.alias("row"), col("length").alias("length"), salt.alias("salt")), "pieces")
    counts = salted.groupBy("length", "salt").count()
    in_length = W.partitionBy("length").orderBy("salt")
    counts = stored(counts.withColumn("before", F.sum("count").over(in_length) - F.col("count")), "length_counts")
    histogram = [tuple(r) for r in counts.groupBy("length").agg(F.sum("count")).collect()]
    if any(length > capacity.tokens or length * length > capacity.attention for length, _ in histogram):
        raise ValueError("a piece is larger than a sequence")
    plan = best_fit(histogram, capacity)
    planned = spark.createDataFrame(
        plan, "length bigint, lo bigint, hi bigint, per_bin bigint, first_bin bigint, begin bigint"
    )
    rank = F.row_number().over(W.partitionBy("length", "salt").orderBy("row")) - 1
    numbered = (
        salted.withColumn("r", rank)
        .join(F.broadcast(counts.select("length", "salt", "before")), ["length", "salt"])
        .withColumn("r", F.col("r") + F.col("before"))
    )
    at = F.col("r") - F.col("lo")
    placed = numbered.join(F.broadcast(planned), "length").filter("r >= lo AND r < hi")
    return placed.select(
        *(F.col("row").getField(c).alias(c) for c in pieces.columns if c.lower() not in ("sequence_id", "offset")),
        (F.col("first_bin") + F.floor(at / F.col("per_bin"))).alias("sequence_id"),
        (F.col("begin") + at % F.col("per_bin") * F.col("length")).alias("offset"),
    )
