"""One named query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnspark.llm.code_compression import compress
from vulnspark.llm.common import stored
from vulnspark.llm.decontamination import decontaminate
from vulnspark.llm.exact_search import top_k
from vulnspark.llm.packing import pack, token_pieces
from vulnspark.llm import pitman_yor
from vulnspark.llm.mixing import mix
from vulnspark.llm.prefix_trie import borrow_turns, numbered_turns, trie
from vulnspark.llm.registry import query, table
from vulnspark.llm.running import attach
from vulnspark.llm.sharding import ring_shards
from vulnspark.llm.simhash import near_duplicates
from vulnspark.llm.substring_dedup import remove_repeated_words
from vulnspark.llm.suffix_dedup import remove_repeats
from vulnspark.llm.toxicity import Model, fit, score
from vulnspark.llm.url_filter import judge_urls


@query("op7_ring_sharding")
def ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 shards of as many rows each, one more or less."""
    placed = ring_shards(table(spark, sf_dir, "documents"), 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


_SQL_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION_SQL = f"""
WITH items AS (SELECT item_id, {_SQL_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
grams AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
),
docs AS (SELECT doc_id, coalesce({_SQL_WORDS.format("text")}, []) AS w FROM documents),
windows AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM docs CROSS JOIN (SELECT DISTINCT n FROM grams) WHERE len(w) >= n)
),
found AS (SELECT windows.*, item_id FROM windows JOIN grams USING (n, gram)),
hit AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id
),
which AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN which USING (doc_id)
"""


@query("op4_decontamination", DECONTAMINATION_SQL)
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-word windows of every benchmark item, in every document."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op5_simhash")
def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, fingerprints linked at two bits or fewer."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


EXACT_SEARCH_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query("op6_exact_search", EXACT_SEARCH_SQL)
def exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for every vector whose id is divisible by 20."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.floor(v * 64).cast("long"))
    vectors = table(spark, sf_dir, "embeddings").filter(finite).select(F.col("vec_id").alias("id"), whole.alias("v"))
    return top_k(vectors, F.col("id") % 20 == 0, 20).withColumnRenamed("id", "vec_id")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def packed(docs: DataFrame) -> DataFrame:
    """Documents, cut only beyond 4096 tokens, in sequences of 4096."""
    return pack(token_pieces(docs, ["doc_id"], tokenizer_path())).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op3_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def id_remainder(n: int):
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % n


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> Model:
    """Learned from rows outside the held-out fifth only."""
    labels = table(spark, sf_dir, "labels").filter(id_remainder(5) != 0)
    return fit(docs, labels, "doc_id", "text", "toxic")


@query("op10_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, toxicity_model(spark, sf_dir, docs), ["doc_id"]).select(
        "doc_id", F.coalesce(id_remainder(5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@query("op2_url_templates")
def url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query("op9_suffix_array_dedup")
def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


SUBSTRING_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS path
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs WHERE len(w) >= 13)
),
later AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY path) AS m FROM windows) WHERE doc_id > m),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM later),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs) ANTI JOIN gone USING (doc_id, i)
  GROUP BY doc_id
),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op8_substring_dedup", SUBSTRING_SQL)
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_words(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op1_pitman_yor")
def pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_remainder(7) == 2, F.lit(False))
    model, words = pitman_yor.fit(docs.filter(~held_out))
    scored = pitman_yor.score(docs, model, words, ["doc_id"])
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score",
    )


_SQL_CRC32 = """list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ord(c))),
         lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)), lambda s, i: xor(s >> 1, 3988292384 * (s & 1))))"""

PREFIX_TRIE_SQL = rf"""
WITH own AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
heads AS (SELECT *, xor({_SQL_CRC32}, 4294967295) % 4 AS h FROM own),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns
  FROM heads c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20
),
member AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM rebuilt),
prefixes AS (SELECT conv_id, depth, turns[1:depth] AS p, depth = len(turns) AS ends FROM member),
nodes AS (
  SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS listed
  FROM prefixes GROUP BY p, depth
),
family AS (
  SELECT x.*, parent.conv_id AS parent_conv_id, coalesce(n, 0) AS n_children,
         CASE WHEN x.depth = 0 THEN 0 ELSE (x.n_convs - 1) * len(regexp_extract_all(x.p[-1].t, '[^ 	-]+')) END AS saved
  FROM nodes x LEFT JOIN nodes parent ON parent.depth = x.depth - 1 AND parent.p = x.p[1:x.depth - 1]
  LEFT JOIN (SELECT p[1:depth - 1] AS q, depth - 1 AS d, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL) k ON k.d = x.depth AND k.q = x.p
),
above AS (SELECT p[1:d] AS q, d, n_children = 0 AS leaf, saved FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM family)),
trees AS (SELECT q, d, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY q, d)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, CAST(n_children AS BIGINT) AS n_children,
       n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(listed) AS ends_sha256
FROM family JOIN trees ON d = depth AND q = p
"""


@query("op11_prefix_trie", PREFIX_TRIE_SQL)
def prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of rebuilt conversations: up to three turns come from the conversation whose id ends the last twenty."""
    turns = numbered_turns(table(spark, sf_dir, "conversations"))
    head = F.crc32(F.encode(F.col("conv").cast("string"), "UTF-8")) % 4
    rows, conversations = borrow_turns(turns, F.col("conv") - F.col("conv") % 20, head, most=3)
    return trie(rows, conversations).drop("ends")


@query("op12_source_mixing")
def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources weigh 1, 2, 3 in turn; no word is taken more than three times."""
    mixed = mix(table(spark, sf_dir, "documents"), ["doc_id"])
    return mixed.taken().select("doc_id", "size", "source_size", "target", "taken")


def _code_compression_sql() -> str:
    """Lloyd's rounds one after the other, every part compared with every entry."""
    steps = ["""
WITH vectors AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v,
         row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
cut AS (
  SELECT row, p, v[p * w + 1:(p + 1) * w] AS x
  FROM (SELECT row, v, len(v) // 8 AS w, unnest(range(0, 8)) AS p FROM vectors)
),
books0 AS MATERIALIZED (SELECT p, row - 1 AS e, x AS c FROM cut WHERE row <= 16)"""]
    nearest = """
near{0} AS MATERIALIZED (
  SELECT row, p, x, min({{'d': d, 'e': e}}) AS best
  FROM (SELECT row, cut.p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
        FROM cut JOIN books{0} ON cut.p = books{0}.p)
  GROUP BY row, p, x
)"""
    update = """
books{1} AS MATERIALIZED (
  SELECT p, e, coalesce(n.c, b.c) AS c FROM books{0} b LEFT JOIN (
    SELECT p, e, list(m ORDER BY k) AS c FROM (
      SELECT p, best.e AS e, k, CAST(floor(CAST(sum(x[k]) AS DOUBLE) / count(*)) AS BIGINT) AS m
      FROM (SELECT p, best, x, unnest(range(1, len(x) + 1)) AS k FROM near{0}) GROUP BY p, best.e, k
    ) GROUP BY p, e
  ) n USING (p, e)
)"""
    for i in range(6):
        steps += [nearest.format(i), update.format(i, i + 1)]
    steps += [nearest.format(6), """
codes AS (
  SELECT row, string_agg(lower(lpad(to_hex(best.e), 2, '0')), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM near6 GROUP BY row
),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM books6)"""]
    return ",".join(steps) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM vectors JOIN codes USING (row) CROSS JOIN digest"""


@query("op13_code_compression", _code_compression_sql())
def code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight parts, 16 entries, six rounds; errors also summed by label."""
    found = compress(table(spark, sf_dir, "embeddings"), ["vec_id", "label"])
    if found is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    none = F.col("label").isNull()
    keyed = found.vectors.withColumns({"none": none, "key": F.when(none, 0).otherwise(F.col("label"))})
    rows = stored(keyed.drop("label"), "codes")
    sums = rows.groupBy("none", "key").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows"))
    return attach(rows, sums, ["none", "key"], "rows", rows.count()).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256")
    )
