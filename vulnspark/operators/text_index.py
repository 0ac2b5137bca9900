"""A stored search index of segments: exact top-k that skips blocks, and searches fitted on a selection.

Documents are added as segments, which read the texts once and keep their counted terms.
``commit`` makes a generation of all segments, from the counts alone:

    terms    (term, df, idf)
    docs     (number, batch, doc, norm, facets): numbered batch by batch, from the shortest vector to the longest
    forward  (number, term, tf), a document's terms together
    blocks   (term, cell, most, postings): of 128 neighbouring documents the place, tf and norm, and the greatest tf / norm
    bits     (facet, value, chunk, bits): which documents have a value, one bit each

A weight at unit length is tf / norm times the idf of its term; these repeat, and take a fraction of a weight's room.
Neighbours in number have weights of like size, so the greatest weights of the blocks tell
cells of documents that cannot reach the best ones from those that can. Files of terms and blocks
are sorted by term, and a search reads the row groups of its terms in each.

Segments keep their counted terms by batch (see ``search``). Of these a commit shuffles the different terms of the batches,
and the pairs in as many rounds as keep a round's share small beside the tables.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vulnspark.operators.search import (
    WHOLE, WRITTEN, Corpus, batch_of, by_batch, default_stop_words, each_term, perhaps_in, query_terms, term_set,
)
from vulnspark.session import brief_shuffles, settings

CELL_BITS = 7
CHUNK_BITS = 15  # a bitmap of Spark's bitmap functions

# A round of a commit fills 16 partitions at least; there are 8 rounds at most.
ROUND_PARTITIONS, ROUNDS = 16, 8

# Rows that are dealt by batch are joined by (batch, document) where they are; lists are gathered from sorted rows,
# as the hash aggregate of objects would spill them twice.
IN_PLACE = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.execution.useObjectHashAggregateExec": "false"}


def _cell(number: Column | str) -> Column:
    return F.shiftright(number, CELL_BITS)


def _chunk(number: Column | str) -> Column:
    return F.shiftright(number, CHUNK_BITS)


def _bit(number: str) -> Column:
    return F.col(number).bitwiseAND(F.lit((1 << CHUNK_BITS) - 1))


def _marked(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """The rows whose ``number`` has its bit set. The bits are broadcast, one for each document of the index."""
    at = _bit("number").cast("int")
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("getbit", byte.cast("long"), at.bitwiseAND(F.lit(7))) == 1
    return rows.withColumn("chunk", _chunk("number")).join(F.broadcast(bits), "chunk").where(is_set).drop("chunk", "bits")


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@dataclass(frozen=True)
class _Counted(Corpus):
    """Documents that are there as counted terms, ``n_docs`` in number."""

    n_docs: int = 0

    def idf(self, df: Column) -> Column:
        return F.log((1 + F.lit(self.n_docs)) / (1 + df)) + 1


def _corpus(counts: DataFrame, n_docs: int, stop_words: Sequence[str]) -> _Counted:
    return _Counted(counts, "doc", F.lit(""), stop_words, n_docs)


def _frequencies(corpus: _Counted, counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", corpus.idf(F.col("df")))


@dataclass(frozen=True)
class SegmentedIndex:
    """An index below ``path``, a folder that all executors share. ``facets`` are columns to select documents by.

    A document's id must be unique over all segments. ``commit`` before the first search and
    after segments have been added; searches go on over the last generation until then.
    """

    spark: SparkSession
    path: str
    facets: Sequence[str] = ()
    stop_words: Sequence[str] | None = None

    def __post_init__(self) -> None:
        if self.stop_words is None:
            object.__setattr__(self, "stop_words", default_stop_words())

    # -- writing ------------------------------------------------------------------

    def add(self, docs: DataFrame, doc_id: str, text: Column) -> None:
        """Add documents as a segment; their texts are read once, here."""
        name = uuid.uuid4().hex
        corpus = Corpus(docs, doc_id, text, list(self.stop_words))
        of_term = Window.partitionBy("batch", "term").orderBy("doc")
        n = F.when(F.row_number().over(of_term) == 1, F.count("*").over(of_term.rowsBetween(*WHOLE)))
        with brief_shuffles(self.spark):
            # ``n`` stands with one row of a batch's term: in how many documents of the batch it is.
            corpus.batch_counts().withColumn("n", n).write.options(**WRITTEN).parquet(f"{self.path}/segments/counts/{name}")
        listed = docs.select(F.col(doc_id).alias("doc"), *self.facets)
        listed.withColumn("batch", batch_of(self.spark, "doc")).write.options(**WRITTEN).parquet(f"{self.path}/segments/docs/{name}")

    def commit(self) -> SegmentedIndex:
        """Make a generation of all segments; no text is read."""
        with brief_shuffles(self.spark), settings(self.spark, IN_PLACE):
            self._commit()
        return self

    def _commit(self) -> None:
        counts = self.spark.read.parquet(f"{self.path}/segments/counts/*")
        listed = self.spark.read.parquet(f"{self.path}/segments/docs/*")
        corpus = _corpus(counts, listed.count(), self.stop_words)
        new = f"{self.path}/generations/{self._generations():08d}"
        pairs = counts.select("batch", "doc", "term", "tf")

        def write(rows: DataFrame, name: str) -> DataFrame:
            rows.write.mode("append").options(**WRITTEN).parquet(f"{new}/{name}")
            return self.spark.read.parquet(f"{new}/{name}")

        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rounds = max(1, min(ROUNDS, partitions // ROUND_PARTITIONS))
        # Ranges of batches, so that a round skips the files of the others.
        batches = sorted(r["batch"] for r in listed.select("batch").distinct().collect())
        cuts = [len(batches) * i // rounds for i in range(rounds + 1)]
        shares = [F.col("batch").between(batches[a], batches[b - 1]) for a, b in zip(cuts, cuts[1:]) if b > a] or [F.lit(False)]

        dictionary = write(corpus.totals(counts.where("n IS NOT NULL").select("batch", "term", "n")), "dictionary")
        write(each_term(dictionary).sortWithinPartitions("term"), "terms")
        weight = F.col("tf") * F.col("idf")
        for share in shares:
            weighted = corpus.with_idf(by_batch(pairs.where(share)), dictionary.where(share))
            norms = write(weighted.groupBy("batch", "doc").agg(F.sqrt(F.sum(weight * weight)).alias("norm")), "norms")
        _remove(self.spark, f"{new}/dictionary")

        # Batches follow each other from cell to cell; there are no more of them than a batch numbers has.
        cells = listed.groupBy("batch").agg(F.ceil(F.count("*") / (1 << CELL_BITS)).alias("cells"))
        before = F.coalesce(F.sum("cells").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = cells.select("batch", F.call_function("shiftleft", before.cast("long"), F.lit(CELL_BITS)).alias("start"))
        place = F.row_number().over(Window.partitionBy("batch").orderBy("norm", "doc")) - 1
        placed = listed.join(norms.drop("batch"), "doc", "left").withColumn("place", place).join(starts, "batch")
        docs = write(placed.select((F.col("start") + F.col("place")).alias("number"), "batch", "doc", "norm", *self.facets), "docs")
        _remove(self.spark, f"{new}/norms")

        weighed = docs.where("doc IS NOT NULL AND norm IS NOT NULL").select("batch", "doc", "number", "norm")
        at = F.col("number").bitwiseAND(F.lit((1 << CELL_BITS) - 1)).cast("short").alias("at")
        postings = F.collect_list(F.struct(at, "tf", "norm")).alias("postings")
        for share in shares:
            numbered = by_batch(pairs.where(share)).join(by_batch(weighed.where(share)).hint("shuffle_hash"), ["batch", "doc"])
            write(numbered.select("number", "term", "tf").sortWithinPartitions("number", "term"), "forward")
            most = F.max(F.col("tf") / F.col("norm")).alias("most")
            blocks = numbered.groupBy("batch", "term", _cell("number").alias("cell")).agg(most, postings)
            # The order in which they were gathered.
            write(blocks.sortWithinPartitions("batch", "term", "cell").drop("batch"), "blocks")
        if self.facets:
            kept = [F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in self.facets]
            each = docs.select("number", F.explode(F.array(*kept)).alias("f")).select("number", "f.*")
            write(each.groupBy("facet", "value", _chunk("number").alias("chunk")).agg(F.bitmap_construct_agg(_bit("number")).alias("bits")), "bits")
        write(self.spark.createDataFrame([(corpus.n_docs,)], "n_docs long"), "size")

    def _generations(self) -> int:
        """How many generations are whole: the size is written last."""
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/generations/*/size/_SUCCESS")
        found = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(where)
        return len(found) if found else 0

    def table(self, name: str) -> DataFrame:
        """A table of the last generation."""
        return self.spark.read.parquet(f"{self.path}/generations/{self._generations() - 1:08d}/{name}")

    # -- searching ----------------------------------------------------------------

    def _query(self, query: str) -> dict[str, float]:
        """The query's known terms, no more than were typed in, and their weights at unit length times the terms' idf."""
        asked = {r["term"]: r["query_tf"] for r in query_terms(self.spark, query, self.stop_words).collect()}
        known = self.table("terms").where(F.col("term").isin(list(asked))).select("term", "idf").collect()
        idf = {r["term"]: r["idf"] for r in known}
        weights = {t: asked[t] * w for t, w in idf.items()}
        length = math.sqrt(sum(w * w for w in weights.values())) or 1.0
        return {t: w / length * idf[t] for t, w in weights.items()}

    def _bounds(self, weights: Mapping[str, float]) -> DataFrame:
        """(cell, bound, blocks): no document of a cell can have more. Only the heads of the blocks are read."""
        heads = self.table("blocks").where(F.col("term").isin(list(weights))).select("term", "cell", "most")
        share = F.col("most") * self._weight(weights)
        return heads.groupBy("cell").agg(F.sum(share).alias("bound"), F.count("*").alias("blocks"))

    @staticmethod
    def _weight(weights: Mapping[str, float]) -> Column:
        out = F.lit(0.0)
        for term, weight in weights.items():
            out = F.when(F.col("term") == term, F.lit(weight)).otherwise(out)
        return out

    def _scores(self, weights: Mapping[str, float], cells: DataFrame) -> DataFrame:
        """(number, relevance) of the documents of some cells."""
        blocks = self.table("blocks").where(F.col("term").isin(list(weights))).drop("most").join(cells, "cell", "left_semi")
        each = blocks.select("cell", self._weight(weights).alias("q"), F.explode("postings").alias("p"))
        number = F.call_function("shiftleft", F.col("cell"), F.lit(CELL_BITS)) + F.col("p.at")
        return each.groupBy(number.alias("number")).agg(F.sum(F.col("p.tf") / F.col("p.norm") * F.col("q")).alias("relevance"))

    def _threshold(self, weights: Mapping[str, float], bounds: DataFrame, top_k: int) -> float:
        """What the best ``top_k`` reach at least, from the cells of the greatest bounds."""
        some = 8 + -(-2 * top_k >> CELL_BITS)
        first = bounds.orderBy(F.desc("bound"), "cell").limit(some).select("cell")
        best = self._scores(weights, first).orderBy(F.desc("relevance")).limit(top_k)
        n, least = best.agg(F.count("*"), F.min("relevance")).first()
        # Sums of a bound and of scores may differ in their last digits.
        return least * (1 - 1e-9) if n == top_k else 0.0

    def search(self, query: str, top_k: int | None = 25) -> DataFrame:
        """(doc, relevance), best first: all matches, or the best ``top_k``, exactly.

        A few cells of the greatest bounds are scored; the least of their best is a
        threshold, and cells whose bound lies below it are not read.
        """
        weights = self._query(query)
        bounds = self._bounds(weights)
        least = self._threshold(weights, bounds, top_k) if top_k else 0.0
        scored = self._scores(weights, bounds.where(F.col("bound") >= least).select("cell")).where(F.col("relevance") >= least)
        found = scored.join(self.table("docs").select("number", "doc"), "number").select("doc", "relevance")
        found = found.where("relevance > 0").orderBy(F.desc("relevance"), "doc")
        return found.limit(top_k) if top_k else found

    def skipped(self, query: str, top_k: int = 25) -> DataFrame:
        """One row: the blocks that a search has to choose from, and those it does not read."""
        weights = self._query(query)
        bounds = self._bounds(weights)
        least = self._threshold(weights, bounds, top_k)
        left_out = F.sum(F.when(F.col("bound") < least, F.col("blocks")).otherwise(0))
        return bounds.agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks"), F.coalesce(left_out, F.lit(0)).alias("skipped"))

    # -- searching a selection ----------------------------------------------------

    def select(self, any_of: Mapping[str, Sequence[str]] = {}, at_least: Mapping[str, float] = {}) -> DataFrame:
        """(chunk, bits) of the documents that have one of the values of every facet named.

        ``at_least``: numbers from a least one on, where a missing one counts as 0. A facet
        with an empty list, like one that is not named, keeps every document.
        """
        wanted = {f: F.col("value").isin(list(v)) for f, v in any_of.items() if v}
        for facet, least in at_least.items():
            wanted[facet] = F.coalesce(F.expr("try_cast(value AS double)"), F.lit(0.0)) >= F.lit(float(least))
        bits = self.table("bits")
        if not wanted:
            return bits.where(F.col("facet") == self.facets[0]).groupBy("chunk").agg(F.bitmap_or_agg("bits").alias("bits"))
        hit = F.lit(False)
        for facet, condition in wanted.items():
            hit = hit | ((F.col("facet") == facet) & condition)
        each = bits.where(hit).groupBy("chunk", "facet").agg(F.bitmap_or_agg("bits").alias("bits"))
        whole = each.groupBy("chunk").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n"))
        return whole.where(F.col("n") == len(wanted)).select("chunk", "bits")

    def search_selection(self, query: str, selection: DataFrame, top_k: int | None = 25) -> DataFrame:
        """(doc, relevance) of the selected documents, fitted on them alone, as if the index held no others.

        Document counts and lengths are those of the selection, from the counted terms and the bits;
        no text is read.
        """
        counts = _marked(self.table("forward"), selection)
        n_docs = selection.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0))).first()[0]
        asked = query_terms(self.spark, query, self.stop_words)
        typed = [r["term"] for r in asked.select("term").collect()]
        hit = _marked(self.table("forward").where(F.col("term").isin(typed)), selection)
        matching = hit.groupBy(_chunk("number").alias("chunk")).agg(F.bitmap_construct_agg(_bit("number")).alias("bits"))
        weighed = _marked(self.table("forward"), matching).withColumnRenamed("number", "doc")
        corpus = _corpus(counts, n_docs, self.stop_words)
        # Terms that no weight depends on are not counted.
        frequencies = _frequencies(corpus, perhaps_in(counts, term_set(weighed)))
        weight, query_weight = F.col("weight"), F.col("query_tf") * F.col("idf")
        known = frequencies.join(F.broadcast(asked), "term")
        length = known.agg(F.sqrt(F.sum(query_weight * query_weight)).alias("query_length"))
        scored = corpus.weighted(frequencies, weighed, asked).groupBy("doc").agg(
            F.sqrt(F.sum(weight * weight)).alias("norm"), F.sum(weight * query_weight).alias("product")
        )
        relevance = (F.col("product") / (F.col("norm") * F.col("query_length"))).alias("relevance")
        found = scored.where("product > 0").join(F.broadcast(length)).select(F.col("doc").alias("number"), relevance)
        found = found.join(self.table("docs").select("number", "doc"), "number").select("doc", "relevance").orderBy(F.desc("relevance"), "doc")
        return found.limit(top_k) if top_k else found
