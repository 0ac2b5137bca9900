"""Score texts by a hierarchical Pitman-Yor language model of word pairs.

Every context has a restaurant over single words. Pairs of two frequent tokens (dishes)
are seated in a small table; there all other words are one dish and one context. Every
other pair that training holds is seated below it, in a restaurant of its context whose
base is the small table's probability: a frequent context's over the words that are no
dishes, any other context's over all words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnspark.llm.common import Shipped, as_bytes, bound_batches, col, mixed, partitions, slices, stored, word_bounds, word_hashes
from vulnspark.session import brief_shuffles

END = np.uint64(1)  # stands for the end of a text; a word's hash is this number by a chance of 2^-64
BEGIN = np.uint64(2)  # stands before a text's first token
BINS = 8

# Pairs are dealt to blocks by context, some BLOCK tokens to a block and not less than LEAST; a context of more
# than SPLIT tokens is dealt by context and word.
BLOCK = 1 << 21
LEAST = 1 << 17
SPLIT = 1 << 20
CHUNK = 1 << 18  # pairs to a row of a block's table


@dataclass(frozen=True)
class Settings:
    """Pairs of the ``dishes`` most frequent tokens are few enough to be held by every task; pairs with
    any other word are seated below them, block by block. Counts of up to ``held`` frequent words go
    to every task; those of all others are joined."""

    dishes: int = 1000
    held: int = 200_000
    burn_in: int = 3
    samples: int = 4
    moves: int = 8
    strength: float = 1.0
    seed: int = 11


# -- counting ---------------------------------------------------------------------


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, each text followed by its end, and the number of tokens of each text."""
    data = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
    starts, ends = word_bounds(data)
    words = word_hashes(data, starts, ends)
    edges = np.cumsum([0] + [len(t) + 1 for t in texts])
    n = np.diff(np.searchsorted(starts, edges))
    out = np.full(len(words) + len(texts), END, np.uint64)
    word = np.ones(len(out), bool)
    word[np.cumsum(n + 1) - 1] = False
    out[word] = words
    return out, n + 1


def _counted(rows: DataFrame, fields: str, keys_of) -> DataFrame:
    """Sums of what ``keys_of(hashes, sizes)`` finds in each slice of texts."""

    bound_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keys, counts = np.unique(keys_of(*_tokens(as_bytes(part.column(0)))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["k", "n"])

    return rows.select("text").mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n"))


class Index:
    """Places of numbers in a sorted array of distinct hashes: a number's leading bits say where to begin."""

    def __init__(self, keys: np.ndarray):
        bits = min(24, len(keys).bit_length() + 1)
        self.keys, self.shift = keys, np.uint64(64 - bits)
        before = np.cumsum(np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits))
        self.start = np.minimum(np.concatenate(([0], before[:-1])), max(0, len(keys) - 1)).astype(np.int32)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, found)"""
        if not len(self.keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = self.start[wanted >> self.shift].astype(np.int64)
        there = self.keys[at]
        found = there == wanted
        left = np.flatnonzero((there < wanted) & (at < len(self.keys) - 1))
        while len(left):
            at[left] += 1
            there = self.keys[at[left]]
            found[left] = there == wanted[left]
            left = left[(there < wanted[left]) & (at[left] < len(self.keys) - 1)]
        return at, found


@dataclass
class Lexicon:
    """The frequent words by hash, with their counts, and which of them are dishes."""

    hashes: np.ndarray
    counts: np.ndarray
    dish: np.ndarray  # the rare dish for all but the most frequent
    dishes: int

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, found)"""
        index = vars(self).get("index")
        if index is None:
            index = self.index = Index(self.hashes)
        return index.find(hashes)

    def pairs(self, hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Context and dish of every token as one number; a text begins in a context of its own."""
        return self.dish_pairs(self.codes(hashes), sizes)

    def dish_pairs(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        dish = self.dish_of(codes)
        context = np.empty(len(dish), np.int64)
        context[1:] = dish[:-1]
        context[np.cumsum(sizes) - sizes] = self.dishes + 1
        return context * (self.dishes + 1) + dish

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """Place in the lexicon from 1; 0 for words that are not held."""
        at, known = self.find(hashes)
        return np.where(known, at + 1, 0)

    def dish_of(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate(([self.dishes], self.dish)).astype(np.int64)[codes]

    def parts(self, context: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Among how many blocks a context's pairs are dealt."""
        parts = (np.concatenate(([0], self.counts)) // SPLIT + 1).astype(np.uint64)
        texts = parts[self.codes(np.array([END]))[0]]
        return np.where(context == BEGIN, texts, parts[codes])

    def pack(self, hashes: np.ndarray, codes: np.ndarray) -> tuple[bytes, bytes]:
        """Three bytes a word, and eight more for each that is not held."""
        return codes.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes(), hashes[codes == 0].tobytes()

    def unpack(self, packed: list[bytes], rest: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and codes."""
        three = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, 3)
        four = np.zeros((len(three), 4), np.uint8)
        four[:, :3] = three
        codes = four.view("<u4").ravel().astype(np.int64)
        out = np.concatenate((np.zeros(1, np.uint64), self.hashes))[codes]
        out[codes == 0] = np.frombuffer(b"".join(rest), np.uint64)
        return out, codes


@dataclass
class Pairs:
    """Contexts and words, with their places in the lexicon."""

    context: np.ndarray
    context_code: np.ndarray
    word: np.ndarray
    code: np.ndarray

    def __getitem__(self, at) -> Pairs:
        return Pairs(self.context[at], self.context_code[at], self.word[at], self.code[at])

    def keys(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed(mixed(self.context) * np.uint64(3) + self.word)

    def blocks(self, lexicon: Lexicon, blocks: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            part = mixed(self.word) % lexicon.parts(self.context, self.context_code)
            return mixed(mixed(self.context) + part) % np.uint64(blocks)

    def pack(self, lexicon: Lexicon) -> tuple[bytes, bytes, bytes, bytes]:
        return *lexicon.pack(self.context, self.context_code), *lexicon.pack(self.word, self.code)


def _below(lexicon: Lexicon, hashes: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, Pairs]:
    """Places of the tokens whose pair is not one of two dishes, and these pairs."""
    first = np.cumsum(sizes) - sizes
    rare = lexicon.dish_of(codes) == lexicon.dishes
    context, before, after_rare = np.empty_like(hashes), np.empty_like(codes), np.empty_like(rare)
    context[1:], before[1:], after_rare[1:] = hashes[:-1], codes[:-1], rare[:-1]
    context[first], before[first], after_rare[first] = BEGIN, 0, False
    at = np.flatnonzero(rare | after_rare)
    return at, Pairs(context, before, hashes, codes)[at]


def _order(block: np.ndarray, pairs: Pairs) -> np.ndarray:
    """By block, and so that like pairs mostly lie together."""
    with np.errstate(over="ignore"):
        return np.argsort((block << np.uint64(40)) | (mixed(pairs.context) >> np.uint64(40) << np.uint64(16)) | (mixed(pairs.word) >> np.uint64(48)))


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal values begin and end."""
    if not len(values):
        return []
    cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return list(zip(cuts, cuts[1:]))


# -- seating ----------------------------------------------------------------------


def _pick(rng: np.random.Generator, weights: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """One place out of each run of weights, in proportion to them."""
    out = first.copy()
    choice = np.flatnonzero(count > 1)
    first, count = first[choice], count[choice]
    total = np.zeros(len(weights) + 1)
    np.cumsum(weights, out=total[1:])
    low, high = total[first], total[first + count]
    at = np.searchsorted(total, low + rng.random(len(first)) * (high - low), "right") - 1
    out[choice] = np.clip(at, first, first + count - 1)
    return out


class Seating:
    """Tables of dishes in restaurants: for each (restaurant, dish) the sizes of its tables.

    ``alone`` is a restaurant's number of further dishes with one customer, who keeps the
    only table. ``parts`` says into how many equal parts a restaurant was dealt by dish;
    its open tables are then reckoned from those of the part at hand.
    """

    def __init__(
        self, restaurant: np.ndarray, dish: np.ndarray, customers: np.ndarray, sizes: list | None = None,
        alone: np.ndarray | None = None, parts: np.ndarray | float = 1.0,
    ):
        self.restaurant, self.dish, self.customers = restaurant, dish, customers
        self.alone = np.zeros(int(restaurant.max()) + 1 if len(restaurant) else 0) if alone is None else alone
        self.parts = parts
        self.count = np.array([len(s) for s in sizes], np.int64) if sizes else np.ones(len(dish), np.int64)
        self.sizes = np.concatenate([np.asarray(s, np.int64) for s in sizes]) if sizes else customers.astype(np.int64)

    def tables(self) -> np.ndarray:
        return np.add.reduceat((self.sizes > 0).astype(np.int64), np.cumsum(self.count) - self.count) if len(self.count) else self.count

    def open(self, tables: np.ndarray) -> np.ndarray:
        """Tables in use in each restaurant."""
        return (np.bincount(self.restaurant, tables, len(self.alone)) + self.alone) * self.parts

    def begin(self, rng, parent: np.ndarray, discount: float, strength: float) -> None:
        """Seat everybody in turn; the customer who next opens a table is drawn at once.

        Between two new tables the chance of none is about (i / j) ** a, with a the
        weight of a new table.
        """
        kinds = self.open(np.ones(len(self.dish)))[self.restaurant]
        weight = (strength + discount * kinds) * parent[self.dish]
        tables, at = np.ones(len(self.dish), np.int64), np.ones(len(self.dish))
        active = np.flatnonzero(self.customers > 1)
        while len(active):
            base = np.maximum(at[active] - discount * tables[active], 1e-9)
            with np.errstate(over="ignore"):  # beyond all customers
                nxt = discount * tables[active] + base * rng.random(len(active)) ** (-1.0 / np.maximum(weight[active], 1e-12))
            nxt = np.maximum(np.ceil(nxt), at[active] + 1)
            ok = nxt <= self.customers[active]
            active = active[ok]
            at[active] = nxt[ok]
            tables[active] += 1
        shares = rng.standard_exponential(int(tables.sum()))
        first = np.cumsum(tables) - tables
        spread = shares / np.repeat(np.add.reduceat(shares, first), tables) if len(first) else shares
        sizes = 1 + np.floor(spread * np.repeat(self.customers - tables, tables)).astype(np.int64)
        if len(first):
            sizes[first] += self.customers - np.add.reduceat(sizes, first)
        self.sizes, self.count = sizes, tables

    def gibbs(self, rng, parent: np.ndarray, discount: float, strength: float, moves: int) -> None:
        """One customer of every dish at a time gets up and sits down again.

        The chance of a table is its size less the discount, that of a new one the
        restaurant's weight for new tables times the parent's probability of the dish.
        """
        several = np.flatnonzero(self.customers > 1)
        every = slice(None) if len(several) == len(self.customers) else several
        restaurant, base, customers = self.restaurant[every], parent[self.dish[every]], self.customers[every]
        tables = self.tables()
        first = np.cumsum(self.count) - self.count
        for _ in range(moves if len(several) else 0):
            at, count = first[every], self.count[every]
            left = _pick(rng, self.sizes, at, count)
            self.sizes[left] -= 1
            emptied = self.sizes[left] == 0
            tables[every] -= emptied
            new = (strength + discount * self.open(tables)[restaurant]) * base
            old = customers - 1 - discount * tables[every]
            opens = rng.random(len(several)) * (new + old) < new
            joins = ~opens
            joined = _pick(rng, np.maximum(self.sizes - discount, 0), at[joins], count[joins])
            self.sizes[joined] += 1
            self.sizes[left[opens & emptied]] = 1
            fresh = opens & ~emptied
            if fresh.any():
                self.sizes = np.insert(self.sizes, at[fresh] + count[fresh], 1)
                self.count[several[fresh]] += 1
                first = np.cumsum(self.count) - self.count
            tables[every] += opens
        full = self.sizes > 0
        if len(self.count):
            self.count = self.tables()
        self.sizes = self.sizes[full]

    def follow(self, rng, customers: np.ndarray, parent: np.ndarray, discount: float, strength: float) -> None:
        """Bring the restaurant to new numbers of customers: as many leave or come, one of a dish at a time; all others keep their seats."""
        while (self.customers != customers).any():
            less, more = np.flatnonzero(self.customers > customers), np.flatnonzero(self.customers < customers)
            first = np.cumsum(self.count) - self.count
            if len(less):
                self.sizes[_pick(rng, self.sizes, first[less], self.count[less])] -= 1
                self.customers[less] -= 1
            if len(more):
                tables = self.tables()
                open_ = self.open(tables)[self.restaurant[more]]
                new = (strength + discount * open_) * parent[self.dish[more]]
                old = self.customers[more] - discount * tables[more]
                opens = rng.random(len(more)) * (new + old) < new
                joined = _pick(rng, np.maximum(self.sizes - discount, 0) * (self.sizes > 0), first[more], self.count[more])
                self.sizes[joined[~opens]] += 1
                self.sizes = np.insert(self.sizes, (first + self.count)[more[opens]], 1)
                self.count[more[opens]] += 1
                self.customers[more] += 1
        full = self.sizes > 0
        self.count = self.tables()
        self.sizes = self.sizes[full]

    def rows(self) -> list[list[int]]:
        return [s.tolist() for s in np.split(self.sizes, np.cumsum(self.count)[:-1])] if len(self.count) else []


def _sweep(pairs: DataFrame, parent: np.ndarray, discount: float, s: Settings, dishes: int, round_: int) -> DataFrame:
    """All context restaurants once, a partition of them at a time; ``tables`` holds the sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        held = pa.Table.from_batches(held).sort_by("k")
        if not held.num_rows:
            return
        code, n = held.column("k").to_numpy(), held.column("n").to_numpy()
        restaurant, dish = code // (dishes + 1), code % (dishes + 1)
        _, restaurant = np.unique(restaurant, return_inverse=True)
        rng = np.random.default_rng([s.seed, round_, int(code[0])])
        if round_:
            seats = Seating(restaurant, dish, n, held.column("tables").to_pylist())
        else:
            seats = Seating(restaurant, dish, n)
            seats.begin(rng, parent, discount, s.strength)
        seats.gibbs(rng, parent, discount, s.strength, s.moves)
        yield pa.RecordBatch.from_arrays(
            [pa.array(code), pa.array(n), pa.array(seats.rows(), pa.list_(pa.int64()))], names=["k", "n", "tables"]
        )

    by_context = pairs.repartition(F.floor(F.col("k") / (dishes + 1)))
    return stored(by_context.mapInArrow(run, "k bigint, n bigint, tables array<bigint>"), "seating")


@dataclass
class Model:
    """Averages over the samples, and the counts that the rare words need."""

    lexicon: Lexicon
    tokens: int
    types: int
    pairs: np.ndarray  # seen (context, dish), sorted
    extra: np.ndarray  # mean of (customers - discount * tables) / (strength + customers of the context)
    back: np.ndarray  # by sample and context: weight of the parent
    parent: np.ndarray  # by sample and dish
    rare_tokens: int
    rare_types: int
    rare_discount: float
    strength: float
    blocks: int = 1
    # Contexts dealt among several blocks: hashes, customers, discounted tables.
    hot: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    seats: DataFrame | None = None  # the restaurants of single words, by block

    def pair_scores(self, codes: np.ndarray) -> np.ndarray:
        width = self.lexicon.dishes + 1
        context, dish = codes // width, codes % width
        p = np.zeros(len(codes))
        for back, parent in zip(self.back, self.parent):
            p += back[context] * parent[dish]
        p /= len(self.back)
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
            p += np.where(self.pairs[at] == codes, self.extra[at], 0.0)
        return np.log10(p)

    def rare(self, count):
        """Probability of a rare word with this count in training, given that it is rare; works on columns too."""
        base = (self.strength + self.rare_discount * self.rare_types) / (self.rare_types + 1)
        return base / (self.strength + self.rare_tokens), 1.0 / (self.strength + self.rare_tokens)

    def bases(self, pairs: Pairs) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What the restaurants of single words rest on: (probability that the context's is asked at all,
        base but for the share of a rare word, that share, whether the word is held).

        The share of a word that is not held is that of the mean count of such words.
        """
        lex = self.lexicon
        width = lex.dishes + 1
        code = pairs.code
        dish = lex.dish_of(code)
        before = np.where(pairs.context == BEGIN, width, lex.dish_of(pairs.context_code))
        own = before != lex.dishes  # over the rare words only
        heads = 10 ** self.pair_scores(np.arange(width + 1) * width + lex.dishes)
        under_rare = 10 ** self.pair_scores(lex.dishes * width + np.arange(width))
        rare_held = lex.dish == lex.dishes
        left = self.rare_types - int(rare_held.sum())
        mean = (self.rare_tokens - lex.counts[rare_held].sum()) / left if left > 0 else 1.0
        new, each = self.rare(0)
        count = np.concatenate(([mean], lex.counts))[code]
        share = np.where(dish == lex.dishes, new + each * np.maximum(count - self.rare_discount, 0.0), 1.0)
        return np.where(own, heads[before], 1.0), np.where(own, 1.0, under_rare[dish]), share, code > 0


# -- restaurants of single words ----------------------------------------------------

SEATS = "b int, c binary, cr binary, cn binary, w binary, wr binary, v binary"


def _column(part: pa.RecordBatch, name: str) -> list[bytes]:
    return part.column(part.schema.get_field_index(name)).to_pylist()


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """All rows of a block at a time, out of rows sorted by block."""
    block, held = None, []
    for batch in batches:
        numbers = batch.column(0).to_numpy()
        for a, b in _runs(numbers):
            if numbers[a] != block and held:
                yield block, held
                held = []
            block = int(numbers[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield block, held


def _counted_below(texts: DataFrame, held: Shipped, blocks: int) -> DataFrame:
    """The pairs that are not of two dishes, counted in each slice of texts, a row per slice and block."""

    bound_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = held.value.lexicon
        for batch in batches:
            for part in slices(batch):
                hashes, sizes = _tokens(as_bytes(part.column(0)))
                _, pairs = _below(lexicon, hashes, sizes, lexicon.codes(hashes))
                block = pairs.blocks(lexicon, blocks)
                order = _order(block, pairs)
                block, pairs = block[order], pairs[order]
                new = np.ones(len(block), bool)
                new[1:] = (pairs.context[1:] != pairs.context[:-1]) | (pairs.word[1:] != pairs.word[:-1])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(block))).astype("<u4")
                block, pairs = block[first], pairs[first]
                rows = [(int(block[a]), *pairs[a:b].pack(lexicon), n[a:b].tobytes()) for a, b in _runs(block)]
                if rows:
                    types = [pa.int32()] + [pa.binary()] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=["b", "c", "cr", "w", "wr", "v"])

    return texts.select("text").mapInArrow(run, "b int, c binary, cr binary, w binary, wr binary, v binary")


def _seat(model: Model, s: Settings, block: int, rows: list[pa.RecordBatch]) -> Iterator[tuple]:
    """Seat a block's pairs: rows of contexts (hash, pairs, customers, discounted tables) with their pairs'
    words and customers less the discount for every table, both a mean over the samples."""
    lexicon = model.lexicon

    def column(name: str) -> list[bytes]:
        return [v for part in rows for v in _column(part, name)]

    found = Pairs(*lexicon.unpack(column("c"), column("cr")), *lexicon.unpack(column("w"), column("wr")))
    n = np.frombuffer(b"".join(column("v")), "<u4").astype(np.int64)
    keys = found.keys()
    order = np.argsort(keys)
    first = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0))
    found, n = found[order[first]], np.add.reduceat(n[order], first)
    order = np.argsort(found.context, kind="stable")
    found, n = found[order], n[order]
    start = np.flatnonzero(np.append(True, np.diff(found.context) != 0))
    contexts, pairs = found.context[start], np.diff(np.append(start, len(n)))
    restaurant = np.repeat(np.arange(len(start)), pairs)
    n1, n2 = int((n == 1).sum()), int((n == 2).sum())
    discount = min(0.95, max(0.05, n1 / max(1, n1 + 2 * n2)))
    several = n > 1
    _, base, share, _ = model.bases(found[several])
    parts = lexicon.parts(contexts, found.context_code[start]).astype(np.float64)
    seats = Seating(
        restaurant[several], np.arange(int(several.sum())), n[several],
        alone=np.bincount(restaurant[~several], minlength=len(contexts)), parts=parts,
    )
    rng = np.random.default_rng([s.seed, block])
    seats.begin(rng, base * share, discount, s.strength)
    tables = np.zeros(int(several.sum()))
    for round_ in range(s.burn_in + s.samples):
        seats.gibbs(rng, base * share, discount, s.strength, s.moves)
        if round_ >= s.burn_in:
            tables += seats.tables() / s.samples
    t = np.ones(len(n))
    t[several] = tables
    rest = (n - discount * t).astype("<f4")
    customers, held = np.add.reduceat(n, start).astype("<f8"), np.add.reduceat(discount * t, start).astype("<f8")
    hot = [{"c": x, "n": y, "t": z} for x, y, z in zip(
        contexts[parts > 1].view(np.int64).tolist(), customers[parts > 1].tolist(), held[parts > 1].tolist()
    )]
    for a, b in _runs(start // CHUNK):
        i, j = int(start[a]), int(start[b - 1] + pairs[b - 1])
        yield (
            block, contexts[a:b].tobytes(), pairs[a:b].astype("<u4").tobytes(), customers[a:b].tobytes() + held[a:b].tobytes(),
            *lexicon.pack(found.word[i:j], found.code[i:j]), rest[i:j].tobytes(), hot if a == 0 else [],
        )


def _seated(texts: DataFrame, model: Model, s: Settings) -> Model:
    """The model with its restaurants of single words, each block in a task's turn."""
    held = Shipped(texts.sparkSession, model)
    fields = SEATS + ", hot array<struct<c:bigint,n:double,t:double>>"
    schema = T.StructType.fromDDL(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for block, rows in _by_block(batches):
            for row in _seat(held.value, s, block, rows):
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow)], schema=arrow)

    counted = _counted_below(texts, held, model.blocks)
    seats = stored(counted.repartition("b").sortWithinPartitions("b").mapInArrow(run, schema), "single_words")
    # No more than one context in SPLIT tokens.
    hot = seats.select(F.explode("hot").alias("h")).groupBy("h.c").agg(F.sum("h.n").alias("n"), F.sum("h.t").alias("t")).toArrow()
    hashes = hot.column("c").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return replace(
        model, seats=seats.drop("hot"),
        hot=(hashes[order], hot.column("n").to_numpy()[order], hot.column("t").to_numpy()[order]),
    )


def fit(training: DataFrame, text_col: str = "text", s: Settings = Settings()) -> tuple[Model, DataFrame]:
    """Seat the training tokens; returns the model and the table (k, n) of all words' counts."""
    if s.held >= 1 << 24:
        raise ValueError("a held word's place has three bytes")
    with brief_shuffles(training.sparkSession):
        return _fit(training, text_col, s)


def _fit(training: DataFrame, text_col: str, s: Settings) -> tuple[Model, DataFrame]:
    texts = training.select(F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    words = stored(_counted(texts, "k bigint, n bigint", lambda h, n: h), "word_counts")
    tokens, types, once, twice = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count(F.when(F.col("n") == 1, 1)), F.count(F.when(F.col("n") == 2, 1))
    ).first()
    # From which count on the words are few enough to hold; a few hundred bins of counts.
    bin_of = F.floor(F.log2("n") * BINS)
    least, room = None, s.held
    for b, n in sorted(((r[0], r[1]) for r in words.groupBy(bin_of).count().collect()), reverse=True):
        room -= n
        if room < 0:
            break
        least = b
    frequent = words.filter(bin_of >= least).toArrow() if least is not None else None
    hashes = frequent.column("k").to_numpy().view(np.uint64) if frequent else np.zeros(0, np.uint64)
    counts = frequent.column("n").to_numpy() if frequent else np.zeros(0, np.int64)
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    top = np.lexsort((hashes, -counts))[: s.dishes]
    dishes = len(top)
    dish = np.full(len(hashes), dishes)
    dish[top] = np.arange(dishes)
    lexicon = Lexicon(hashes, counts, dish, dishes)
    held = Shipped(training.sparkSession, lexicon)
    # At most (dishes + 2) * (dishes + 1) rows from here on, whatever the corpus.
    pairs = stored(_counted(texts, "k bigint, n bigint", lambda h, n: held.value.pairs(h, n)), "pairs")
    n1, n2 = pairs.agg(F.count(F.when(F.col("n") == 1, 1)), F.count(F.when(F.col("n") == 2, 1))).first()
    discount = min(0.95, max(0.05, n1 / max(1, n1 + 2 * n2)))
    seen = pairs.toArrow().sort_by("k")
    codes, n = seen.column("k").to_numpy(), seen.column("n").to_numpy()
    context = codes // (dishes + 1)
    in_context = np.bincount(context, n, dishes + 2)
    rng = np.random.default_rng(s.seed)
    share = np.bincount(codes % (dishes + 1), n, dishes + 1) + 1.0
    parent, seating, extra, backs, parents = share / share.sum(), pairs, np.zeros(len(codes)), [], []
    top_level: Seating | None = None
    for round_ in range(s.burn_in + s.samples):
        seating = _sweep(seating, parent, discount, s, dishes, round_)
        found = seating.select("k", F.size("tables").alias("t")).toArrow().sort_by("k")
        t = found.column("t").to_numpy().astype(np.float64)
        # A context's tables are the customers of the restaurant that all contexts share.
        shared = np.bincount(codes % (dishes + 1), t, dishes + 1).astype(np.int64)
        served = np.flatnonzero(shared)
        even = np.full(dishes + 1, 1.0 / (dishes + 1))
        if top_level is None:
            top_level = Seating(np.zeros(len(served), np.int64), served, shared[served].copy())
            top_level.begin(rng, even, discount, s.strength)
        else:
            # Every pair keeps a table at least, so the dishes served stay the same; those seated stay seated.
            top_level.follow(rng, shared[served], even, discount, s.strength)
        top_level.gibbs(rng, even, discount, s.strength, s.moves)
        above = np.zeros(dishes + 1)
        above[served] = top_level.tables()
        parent = (shared - discount * above + (s.strength + discount * above.sum()) * even) / (s.strength + shared.sum())
        if round_ >= s.burn_in:
            open_ = np.bincount(context, t, dishes + 2)
            backs.append((s.strength + discount * open_) / (s.strength + in_context))
            parents.append(parent)
            extra += (n - discount * t) / (s.strength + in_context[context]) / s.samples
    rare_discount = min(0.95, max(0.05, once / max(1, once + 2 * twice)))
    model = Model(
        lexicon, tokens, types, codes, extra, np.array(backs), np.array(parents),
        int(tokens - counts[top].sum()), types - dishes, rare_discount, s.strength,
        max(tokens // BLOCK, min(partitions(training.sparkSession), tokens // LEAST)) + 1,
    )
    return _seated(texts, model, s), words


# -- scores -----------------------------------------------------------------------

TABLE, PAIRS, ROW, SUM, RARE = range(5)  # what a row is


def _first_scores(m: Model, hashes: np.ndarray, sizes: np.ndarray, codes: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Per text the tokens, the held ones, their base score, and the score of the pairs of two dishes."""
    known = codes > 0
    first = np.cumsum(sizes) - sizes
    base = np.concatenate(([0.0], np.log10((m.lexicon.counts + 1) / (m.tokens + m.types + 1))))[codes]
    dishes = np.ones(len(hashes), bool)
    dishes[at] = False
    score = np.zeros(len(hashes))
    score[dishes] = m.pair_scores(m.lexicon.dish_pairs(codes, sizes)[dishes])
    return [sizes, np.add.reduceat(known.astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(score, first)]


def _dealt(m: Model, rows: np.ndarray, sizes: np.ndarray, at: np.ndarray, pairs: Pairs) -> list[tuple]:
    """The other pairs by block: (block, smallest row, contexts, words, rows counted from the smallest)."""
    block = pairs.blocks(m.lexicon, m.blocks)
    order = _order(block, pairs)
    block, pairs = block[order], pairs[order]
    least = int(rows.min())
    after = (rows - least)[np.repeat(np.arange(len(sizes)), sizes)[at]][order]
    after = after.astype("<u2" if int((rows - least).max()) < 1 << 16 else "<u8")
    return [(int(block[a]), least, *pairs[a:b].pack(m.lexicon), after[a:b].tobytes()) for a, b in _runs(block)]


class _Tables:
    """The restaurants of one block."""

    def __init__(self, m: Model):
        self.m, self.pieces, self.ready = m, [], False

    def add(self, part: pa.RecordBatch) -> None:
        for c, k, n, w, wr, v in zip(*(_column(part, x) for x in ("c", "cr", "cn", "w", "wr", "v"))):
            contexts, numbers = np.frombuffer(c, np.uint64), np.frombuffer(n, "<f8").reshape(2, -1)
            of = np.repeat(contexts, np.frombuffer(k, "<u4"))
            pairs = Pairs(of, of, *self.m.lexicon.unpack([w], [wr]))
            self.pieces.append((contexts, numbers[0], numbers[1], pairs.keys(), np.frombuffer(v, "<f4")))

    def finish(self) -> None:
        empty = (np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), np.zeros(0, np.uint64), np.zeros(0, "<f4"))
        contexts, customers, held, keys, rest = (np.concatenate(x) for x in zip(*(self.pieces or [empty])))
        self.pieces, self.ready = [], True
        order = np.argsort(contexts)
        self.contexts, self.customers, self.held = Index(contexts[order]), customers[order], held[order]
        order = np.argsort(keys)
        self.keys, self.rest = Index(keys[order]), rest[order]

    def score(self, part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """(row, score) summed over held words; (row, word, what its pair has, what it has of its base) of the others."""
        m, unpack = self.m, self.m.lexicon.unpack
        if not self.ready:
            self.finish()
        pairs = Pairs(*unpack(_column(part, "c"), _column(part, "cr")), *unpack(_column(part, "w"), _column(part, "wr")))
        c, w = pairs.context, pairs.word
        rows = []
        for least, after, words in zip(part.column(part.schema.get_field_index("row")).to_pylist(), _column(part, "v"), _column(part, "w")):
            rows.append(np.frombuffer(after, "<u2" if len(after) * 3 == len(words) * 2 else "<u8").astype(np.int64) + least)
        row = np.concatenate(rows)
        customers, held = np.zeros(len(c)), np.zeros(len(c))
        for known, n, t in ((self.contexts, self.customers, self.held), (Index(m.hot[0]), *m.hot[1:])):
            at, found = known.find(c)
            customers[found], held[found] = n[at[found]], t[at[found]]
        extra = np.zeros(len(c))
        at, found = self.keys.find(pairs.keys())
        extra[found] = self.rest[at[found]] / (m.strength + customers[found])
        head, base, share, is_held = m.bases(pairs)
        base = base * (m.strength + held) / (m.strength + customers)
        of, inverse = np.unique(row[is_held], return_inverse=True)
        sums = np.bincount(inverse, np.log10(head * (extra + base * share))[is_held], len(of))
        other = ~is_held
        return of, sums, row[other], w[other], (head * extra)[other], (head * base)[other]


def score(docs: DataFrame, model: Model, words: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Per document the ``keep`` columns and ``n_tokens, n_known, base_score, score``.

    ``score`` is the log10 probability of the text: of each token after the one before,
    averaged over the samples. All words that training has not seen are one class.
    ``base_score`` is the same under counts plus one.

    A null text is empty and has its end as only token. Without any training text all
    words are unknown. Equal rows are each scored; an empty table gives an empty result.
    """
    with brief_shuffles(docs.sparkSession):
        return _score(docs, model, words, keep, text_col)


def _score(docs: DataFrame, model: Model, words: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    spark = docs.sparkSession
    held = Shipped(spark, replace(model, seats=None))
    columns = list(dict.fromkeys(keep))
    kept = [f"c{i}" for i in range(len(columns))]
    rows = docs.select(*(col(c).alias(k) for c, k in zip(columns, kept)), col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).select("text", "row", *kept)
    of_row = "n_tokens bigint, n_known bigint, base_score double, score double"
    callers = [T.StructField(k, rows.schema[k].dataType) for k in kept]
    dealt = T.StructType([*T.StructType.fromDDL(f"{SEATS}, kind int, row bigint, {of_row}").fields, *callers])
    out = T.StructType([*T.StructType.fromDDL(f"kind int, row bigint, {of_row}, k bigint, e double, f double").fields, *callers])
    bound_batches(spark)

    def filled(schema: pa.Schema, rows: int, values: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.nulls(rows, f.type) if (v := values.get(f.name)) is None else v.cast(f.type) if isinstance(v, pa.Array) else pa.array(v, f.type) for f in schema],
            schema=schema,
        )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(dealt)
        m: Model = held.value
        for batch in batches:
            for part in slices(batch):
                hashes, sizes = _tokens(as_bytes(part.column(0)))
                row = part.column(1).to_numpy()
                codes = m.lexicon.codes(hashes)
                at, pairs = _below(m.lexicon, hashes, sizes, codes)
                n_tokens, n_known, base, scores = _first_scores(m, hashes, sizes, codes, at)
                values = {"b": (row % m.blocks).astype(np.int32), "kind": np.full(len(row), ROW, np.int32), "row": row}
                values |= {"n_tokens": n_tokens, "n_known": n_known, "base_score": base, "score": scores}
                yield filled(schema, len(row), values | dict(zip(kept, part.columns[2:])))
                found = _dealt(m, row, sizes, at, pairs)
                if found:
                    values = dict(zip(["b", "row", "c", "cr", "w", "wr", "v"], zip(*found)))
                    yield filled(schema, len(found), values | {"kind": np.full(len(found), PAIRS, np.int32)})

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        block, tables = None, None
        for batch in batches:
            kind = batch.column(batch.schema.get_field_index("kind")).to_numpy()
            numbers = batch.column(0).to_numpy()
            for a, b in _runs(numbers.astype(np.int64) * 3 + kind):
                part = batch.slice(a, b - a)
                if numbers[a] != block:
                    block, tables = numbers[a], _Tables(held.value)
                if kind[a] == TABLE:
                    tables.add(part)
                elif kind[a] == ROW:
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(b - a, f.type) if f.name in ("k", "e", "f") else part.column(part.schema.get_field_index(f.name)) for f in schema],
                        schema=schema,
                    )
                else:
                    of, sums, row, word, e, f = tables.score(part)
                    yield filled(schema, len(of), {"kind": np.full(len(of), SUM, np.int32), "row": of, "score": sums})
                    rare = {"kind": np.full(len(row), RARE, np.int32), "row": row, "k": word.view(np.int64), "e": e, "f": f}
                    yield filled(schema, len(row), rare)

    seats = model.seats.withColumn("kind", F.lit(TABLE))
    both = rows.mapInArrow(deal, dealt).unionByName(seats, allowMissingColumns=True)
    part = stored(both.repartition("b").sortWithinPartitions("b", "kind").mapInArrow(judge, out), "scores")
    new, each = model.rare(0)
    count = F.coalesce(F.col("count"), F.lit(0))
    share = F.lit(new) + F.when(count > 0, F.lit(each) * (count - model.rare_discount)).otherwise(0.0)
    rare = (
        part.filter(F.col("kind") == RARE).join(words.select("k", F.col("n").alias("count")), "k", "left")
        .select(
            "row", F.when(count > 0, 1).otherwise(0).alias("known"),
            F.log10((count + 1) / (model.tokens + model.types + 1)).alias("base"), F.log10(F.col("e") + F.col("f") * share).alias("more"),
        )
    )
    sums = part.filter(F.col("kind") == SUM).select("row", F.lit(0).alias("known"), F.lit(0.0).alias("base"), F.col("score").alias("more"))
    rest = rare.unionByName(sums).groupBy("row").agg(F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("more").alias("more"))
    zero = F.lit(0)
    new_names = ["n_tokens", "n_known", "base_score", "score"]
    return part.filter(F.col("kind") == ROW).join(rest, "row", "left").select(
        *(F.col(k).alias(c) for c, k in zip(columns, kept) if c.lower() not in new_names),
        "n_tokens", (F.col("n_known") + F.coalesce("known", zero)).alias("n_known"),
        (F.col("base_score") + F.coalesce("base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("more", zero)).alias("score"),
    )


def perplexity(scored: DataFrame, condition: Column | None = None) -> DataFrame:
    """One row: perplexity of the model and of the base over the texts that meet the condition."""
    rows = scored if condition is None else scored.filter(condition)
    return rows.agg(
        *(F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens")).alias(n) for c, n in (("score", "perplexity"), ("base_score", "base_perplexity")))
    )
