"""Texts of several slices: nothing is cut off and places beyond the first slice are right."""

import random
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from vulnspark.llm.common import SLICE_BYTES
from vulnspark.llm.decontamination import decontaminate
from vulnspark.llm.packing import token_pieces
from vulnspark.llm.queries import tokenizer_path
from vulnspark.llm.simhash import fingerprints
from vulnspark.llm.substring_dedup import remove_repeated_words
from vulnspark.llm.suffix_dedup import remove_repeats
from vulnspark.llm.toxicity import Settings, score, train

END = "one quite unusual closing passage of exactly ten words here"


@pytest.fixture(scope="module")
def text():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(30_000)]
    long = " ".join(rng.choice(words) for _ in range(850_000)) + " " + END
    assert len(long) > 2 * SLICE_BYTES
    return long


@pytest.fixture(scope="module")
def docs(spark, text, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long") / "docs")
    spark.createDataFrame([(1, text), (2, "x " + text), (3, "short")], "doc_id long, text string").write.parquet(path)
    return spark.read.parquet(path)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_tokens(docs, text):
    ids = np.array(Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids + [1], "<u4")
    rows = sorted((r["start"], r["length"], r["ids_crc32"]) for r in token_pieces(docs, ["doc_id"], tokenizer_path()).filter("doc_id = 1").collect())
    assert rows == [(a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for a in range(0, len(ids), 4096)]


def test_fingerprint(docs, text):
    words = text.split()
    counts = np.zeros(64, np.int64)
    for i in range(len(words) - 2):
        h = xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), seed=42)
        counts += np.unpackbits(np.array([h], ">u8").view(np.uint8))
    wanted = int("".join("1" if 2 * c > len(words) - 2 else "0" for c in counts), 2)
    assert by_id(fingerprints(docs, ["doc_id"], "text", 3))[1]["fp"] % (1 << 64) == wanted


def test_benchmark_at_the_end(spark, docs, text):
    bench = spark.createDataFrame([(7, END)], "item_id long, text string")
    row = by_id(decontaminate(docs, bench, ["doc_id"]))[1]
    assert row["n_words"] == 850_010 and row["n_hit"] == 10 and row["items"] == ["7"]
    assert [(s["start"], s["end"]) for s in row["spans"]] == [(len(text) - len(END), len(text))]


def test_copies(docs, text):
    rows = by_id(remove_repeats(docs, ["doc_id"]))
    assert rows[1]["n_removed"] == len(text) and bytes(rows[2]["kept"]) == b"x " and rows[3]["n_removed"] == 0
    words = by_id(remove_repeated_words(docs, ["doc_id"]))
    assert words[1]["n_removed"] == 0 and words[2]["n_removed"] == 850_010 and words[2]["n_words"] == 850_011


def test_score(docs, text):
    model = train([b"bad words", b"good words"] * 20, [1, 0] * 20, Settings(epochs=1, steps=20))
    rows = by_id(score(docs, model, ["doc_id"]))
    assert rows[1]["score"] == pytest.approx(float(model.scores([text.encode()], {})[0]))
