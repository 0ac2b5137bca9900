"""The ring walked key by key."""

import struct
import zlib
from collections import Counter, defaultdict, deque

import pytest
import xxhash
from pyspark.sql import functions as F

from vulnspark.llm.sharding import ring_shards


def place(*parts):
    """Spark's xxhash64 over texts, 64-bit and 32-bit numbers, without its last bit."""
    h = 42
    for p in parts:
        data = p.encode() if isinstance(p, str) else struct.pack("<q", p)
        h = xxhash.xxh64_intdigest(data, seed=h)
    return h >> 1


def walk(keys, shards, replicas):
    """Shard of every key, by an actual walk: a key goes on clockwise until a shard has room."""
    nodes = sorted((place("node", i % shards, i // shards), i % shards) for i in range(shards * replicas))
    total = len(keys)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    arcs = defaultdict(list)
    for key in keys:
        at = place("key", *key)
        arc = next((a for a, (hi, _) in enumerate(nodes) if at <= hi), 0)
        arcs[arc].append((nodes[arc][0] < at, at, key))
    out = {}
    # Keys of a shard's own arcs come first, in ring order.
    over = defaultdict(list)
    for arc, (_, shard) in enumerate(nodes):
        for wrapped, at, key in sorted(arcs[arc], key=lambda x: x[1:]):
            if room[shard]:
                room[shard] -= 1
                out[key] = shard
            else:
                over[arc].append(key)
    waiting = deque()
    for lap in range(2):
        for arc, (_, shard) in enumerate(nodes):
            if lap == 0:
                waiting.extend(over[arc])
            while waiting and room[shard]:
                room[shard] -= 1
                out[waiting.popleft()] = shard
    assert not waiting
    return out


@pytest.mark.parametrize("rows, shards, replicas", [(900, 7, 8), (50, 12, 4), (400, 3, 1)])
def test_against_a_walk(spark, rows, shards, replicas):
    made = [(i % max(1, rows // 2), "text" * (i % 5)) for i in range(rows)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    seen, keys = Counter(), []
    for i, text in made:
        row = (i, len(text) + 16, zlib.crc32(text.encode()))
        seen[row] += 1
        keys.append((*row, seen[row]))
    wanted = walk(keys, shards, replicas)
    expected = sorted((k[0], k[1], k[2], s) for k, s in wanted.items())
    found = ring_shards(docs, shards, replicas=replicas).select("doc_id", "size", F.col("text_crc32").cast("long"), "shard")
    assert sorted(tuple(r) for r in found.collect()) == expected
