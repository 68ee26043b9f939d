"""Full-text search: records, postings of their words, and the entities named in them.

Words are runs of letters and digits, lower-cased. A posting has a score: the count of the
word, TF-IDF (``tf * log2(N / df)``) or BM25. Postings are a table sorted by word, so a
word or prefix is a pushed-down range of it. An index that is built is runs of a million
words, each sorted where its records are read: nothing is shuffled, and counts of one word
in one record that are in two runs are added when the word is looked up."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.terms import E, to_term
from ..plans.parser import SparqlError
from ..shared import fresh_path, materialize
from .frames import Frame, frame

RUN = 1_000_000  # words that a task counts and sorts at a time
WORD = r"[^\p{L}\p{N}]+"


def tokens(text):
    return F.filter(F.split(F.lower(text), WORD), lambda w: w != "")


def _sorted_codes(a: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct values in order, and for each value its place among them."""
    coded = a.dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()]


def _runs(size: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        words, w = _sorted_codes(pa.concat_arrays([b.column("word") for b in held]))
        recs, r = _sorted_codes(pa.concat_arrays([b.column("rec") for b in held]))
        pairs, n = np.unique(w * len(recs) + r, return_counts=True)
        return pa.record_batch([words.take(pa.array(pairs // len(recs))), recs.take(pa.array(pairs % len(recs))), pa.array(n.astype(float))], names=["word", "rec", "score"])

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in parts:
            held, rows = [*held, b], rows + b.num_rows
            if rows >= size:
                yield made(held)
                held, rows = [], 0
        if rows:
            yield made(held)

    return run


def counted(docs: DataFrame, size: int = RUN) -> DataFrame:
    """word, rec, score of runs of ``size`` words; a run is sorted by word and record."""
    words = docs.select("rec", F.explode(tokens(F.col("text"))).alias("word"))
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("rec", docs.schema["rec"].dataType), T.StructField("score", T.DoubleType())])
    return words.mapInArrow(_runs(size), schema)


@dataclass
class TextIndex:
    postings: DataFrame  # word, rec, score (the count of the word, or what a words file says)
    entities: DataFrame  # rec, entity (IRI), score
    record_kind: str = "int"
    scoring: str = "count"
    records: float = 1.0
    sizes: DataFrame | None = None  # rec, dl: words of a record, for BM25
    mean: float = 1.0
    b: float = 0.75
    k: float = 1.75

    docs: DataFrame | None = None  # rec, text: what records are, where it is known
    runs: bool = False  # whether the counts of a word in a record may be in several rows

    @classmethod
    def from_literals(cls, source, graphs: list[str] | None = None, scoring: str = "count") -> TextIndex:
        """The literals of a graph as text: each distinct one is a record (its own text), and
        the subjects that have it are its entities."""
        df, cols = source.any_predicate(graphs, None)
        o = to_term(cols["o"])
        rows = df.select(to_term(cols["s"]).getField("s").alias("entity"), o.alias("o")).where("o.k = 4 and o.s is not null").select(F.col("o.s").alias("rec"), "entity")
        texts = rows.select("rec", F.col("rec").alias("text")).distinct()
        return cls.build(texts, rows.where("entity is not null").distinct(), scoring, record_kind="str")

    @classmethod
    def build(cls, docs: DataFrame, entities: DataFrame | None = None, scoring: str = "tfidf", b: float = 0.75, k: float = 1.75, record_kind: str = "int") -> TextIndex:
        """``docs``: rec (bigint), text. ``entities``: rec, entity. Counts are stored; TF-IDF
        and BM25 are computed from the postings that a query reads."""
        if scoring not in ("count", "tfidf", "bm25"):
            raise SparqlError("scoring is count, tfidf or bm25")
        if isinstance(docs.schema["rec"].dataType, (T.LongType, T.IntegerType)):
            tf = materialize(counted(docs), "postings")
            made = cls(tf, cls._entities(docs.sparkSession, entities), record_kind, runs=True)
        else:
            words = docs.select("rec", F.explode(tokens(F.col("text"))).alias("word"))
            # Written once: the sample for sorting, and the sizes, read it again.
            tf = materialize(words.groupBy("word", "rec").agg(F.count(F.lit(1)).cast("double").alias("score")), "tf")
            made = cls._held(docs.sparkSession, tf, entities, record_kind)
        made.scoring, made.b, made.k = scoring, b, k
        if scoring != "count":
            made.records = float(max(docs.select("rec").distinct().count(), 1))
        if scoring == "bm25":
            made.sizes = materialize(tf.groupBy("rec").agg(F.sum("score").alias("dl")), "sizes")
            made.mean = made.sizes.agg(F.coalesce(F.avg("dl"), F.lit(1.0)).alias("m")).first()["m"]
        return made

    @classmethod
    def from_words(cls, spark: SparkSession, path: str, record_kind: str = "int", docs: str | None = None) -> TextIndex:
        """A words file: word, whether it is an entity, record, score, separated by tabs. A file
        of ``docs`` has the number and the text of each record."""
        rows = spark.read.csv(path, sep="\t", quote="", schema="word string, ent int, rec bigint, score double")
        words = rows.where("ent = 0").select(F.lower("word").alias("word"), "rec", "score")
        ent = rows.where("ent = 1").select("rec", F.regexp_replace("word", "^<|>$", "").alias("entity"), "score")
        made = cls._held(spark, words, ent, record_kind)
        if docs is not None:
            made.docs = spark.read.csv(docs, sep="\t", quote="", schema="rec bigint, text string")
        return made

    def save(self, path: str) -> None:
        """Writes the index as tables that ``load`` reads; nothing is computed anew then."""
        spark = self.postings.sparkSession
        self._whole(self.postings).repartitionByRange("word", "rec").sortWithinPartitions("word", "rec").write.parquet(f"{path}/postings")
        self.entities.write.parquet(f"{path}/entities")
        for name, df in (("sizes", self.sizes), ("docs", self.docs)):
            if df is not None:
                df.write.parquet(f"{path}/{name}")
        about = [(self.record_kind, self.scoring, self.records, self.mean, self.b, self.k, self.sizes is not None, self.docs is not None)]
        spark.createDataFrame(about, "record_kind string, scoring string, records double, mean double, b double, k double, sizes boolean, docs boolean").coalesce(1).write.parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str, scoring: str | None = None) -> TextIndex:
        """A saved index; ``scoring`` may be another one than it was built for, if it holds what
        that needs (an index built for BM25 serves all)."""
        about = spark.read.parquet(f"{path}/about").first()
        made = cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/entities"), about["record_kind"], about["scoring"], about["records"], None, about["mean"], about["b"], about["k"])
        made.sizes = spark.read.parquet(f"{path}/sizes") if about["sizes"] else None
        made.docs = spark.read.parquet(f"{path}/docs") if about["docs"] else None
        return made if scoring is None else made.scored_by(scoring)

    def scored_by(self, scoring: str) -> TextIndex:
        if scoring not in ("count", "tfidf", "bm25"):
            raise SparqlError("scoring is count, tfidf or bm25")
        if scoring == "bm25" and self.sizes is None:
            raise SparqlError("the index was not built for bm25")
        return replace(self, scoring=scoring)

    @classmethod
    def _held(cls, spark, postings, entities, record_kind) -> TextIndex:
        path = fresh_path(spark, "postings")
        postings.repartitionByRange("word", "rec").sortWithinPartitions("word", "rec").write.parquet(path)
        return cls(spark.read.schema(postings.schema).parquet(path), cls._entities(spark, entities), record_kind)

    @staticmethod
    def _entities(spark: SparkSession, entities: DataFrame | None) -> DataFrame:
        if entities is None:
            return spark.createDataFrame([], "rec bigint, entity string, score double")
        return entities if "score" in entities.columns else entities.withColumn("score", F.lit(1.0))

    def _whole(self, rows: DataFrame) -> DataFrame:
        """Postings with one row for a word of a record."""
        return rows.groupBy("word", "rec").agg(F.sum("score").alias("score")) if self.runs else rows

    def _scored(self, rows: DataFrame) -> DataFrame:
        """Postings of some words, with their final scores."""
        if self.scoring == "count":
            return rows
        rows = rows.join(rows.groupBy("word").agg(F.count(F.lit(1)).alias("df")), "word")
        tf, idf = F.col("score"), F.log2(F.lit(self.records) / F.col("df"))
        if self.scoring == "tfidf":
            return rows.select("word", "rec", (tf * idf).alias("score"))
        rows = rows.join(self.sizes, "rec")
        return rows.select("word", "rec", (tf * (self.k + 1) / (self.k * (1 - self.b + self.b * F.col("dl") / self.mean) + tf) * idf).alias("score"))

    def word(self, text_var: str, word: str, score: str | None, matched: str | None = None) -> Frame:
        w = word.lower()
        cols = {text_var: E(F.col("rec"), self.record_kind, False)}
        if w.endswith("*"):
            df = self._whole(self.postings.where(F.col("word").startswith(w[:-1])))
            if matched:
                cols[matched] = E(F.col("word"), "str", False)
        else:
            df = self._whole(self.postings.where(F.col("word") == w))
        if score:
            df = self._scored(df)
            cols[score] = E(F.col("score"), "dbl", False)
        return frame(df, cols)

    def entity(self, text_var: str, entity, score: str | None) -> Frame:
        """``entity``: the name of a variable, or an IRI as ('iri', value)."""
        df, cols = self.entities, {text_var: E(F.col("rec"), self.record_kind, False)}
        if isinstance(entity, tuple):
            df = df.where(F.col("entity") == entity[1])
        else:
            cols[entity] = E(F.col("entity"), "iri", False)
        if score:
            cols[score] = E(F.col("score"), "dbl", False)
        return frame(df, cols)


def escaped(s: str) -> str:
    return "".join(c if c.isalnum() else f"_{ord(c)}_" for c in s)
