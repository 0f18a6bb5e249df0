"""The search index: four plain tables over a collection of records."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import terms
from plumbline.operators.ordinals import ordinals
from plumbline.session import materialize

#: Between the values of a multi-valued attribute; more than the greatest distance that counts.
VALUE_GAP = 8
LAST_POSITION = 0xFFFF
#: Positions of different attributes are kept this far apart when they stand in one array.
ATTRIBUTE_SPAN = 1 << 20

# The rating buckets, best first.
RATING_BUCKETS = ("9+", "8–9", "7–8", "6–7", "<6")


def decade(year: Column) -> Column:
    """``1994`` is of the ``1990s``."""
    return F.concat((F.floor(year / 10) * 10).cast("int").cast("string"), F.lit("s"))


def rating_bucket(rating: Column) -> Column:
    """NaN falls into the lowest bucket, null has none."""
    at_least = lambda x: ~F.isnan(rating) & (rating >= x)
    chain = F.when(at_least(9), RATING_BUCKETS[0])
    for low, name in zip((8, 7, 6), RATING_BUCKETS[1:4], strict=True):
        chain = chain.when(at_least(low), name)
    return F.when(rating.isNotNull(), chain.otherwise(RATING_BUCKETS[4]))


def _default_facets() -> dict[str, Column]:
    return {"genre": F.col("genres"), "decade": F.array(decade(F.col("year"))), "rating": F.array(rating_bucket(F.col("rating")))}


@dataclass(frozen=True)
class IndexConfig:
    """What of a table is searched: attributes in the order of their weight, facets as array expressions."""

    key: str = "id"
    ordinal: str = "doc_ord"
    attributes: tuple[str, ...] = ("title", "genres", "description")
    facets: Callable[[], dict[str, Column]] = field(default=_default_facets)
    popularity: str = "popularity"


@dataclass
class Index:
    """``docs(doc_ord, id, popularity, facets map, pop_rank)``, ``terms(term, df, n_chars)``,
    ``postings(term, doc_ord, attr, positions)``, ``records`` as given."""

    config: IndexConfig
    docs: DataFrame
    terms: DataFrame
    postings: DataFrame
    records: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.docs.sparkSession

    @cached_property
    def size(self) -> int:
        """The number of documents."""
        return self.docs.count()

    @cached_property
    def vocabulary(self) -> int:
        """The number of terms."""
        return self.terms.count()

    def facet_values(self) -> DataFrame:
        """``(doc_ord, facet, value)``, each value once per document."""
        return self.docs.select("doc_ord", F.explode("facets").alias("facet", "values")).select("doc_ord", "facet", F.explode("values").alias("value"))

    def write(self, path: str) -> None:
        """Keep the tables; postings are sorted by term over files, so that a term's files are few."""
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.records.write.mode("overwrite").parquet(f"{path}/records")
        self.postings.repartitionByRange("term", "doc_ord").sortWithinPartitions("term", "doc_ord").write.mode("overwrite").parquet(f"{path}/postings")


def read_index(spark: SparkSession, path: str, config: IndexConfig | None = None) -> Index:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return Index(config or IndexConfig(), read("docs"), read("terms"), read("postings"), read("records"))


_POSTINGS = pa.schema([
    ("term", pa.string()), ("doc_ord", pa.int64()), ("attr", pa.int32()), ("positions", pa.list_(pa.int32())), ("first", pa.bool_()),
])


def positions_of(values: list[str | None]) -> dict[str, list[int]]:
    """Term -> positions in a multi-valued attribute; null values are skipped."""
    out: dict[str, list[int]] = {}
    base = 0
    for value in values:
        if value is None:
            continue
        found = terms(value)
        for at, term in enumerate(found):
            out.setdefault(term, []).append(min(base + at, LAST_POSITION))
        base += len(found) + VALUE_GAP
    return out


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_ord, array<string> per attribute) to postings; a document is one row, so no shuffle is needed."""
    for batch in batches:
        columns: tuple[list, list, list, list, list] = ([], [], [], [], [])
        cells = [c.to_pylist() for c in batch.columns[1:]]
        for row, doc in enumerate(batch.column(0).to_pylist()):
            seen: set[str] = set()
            for attr, values in enumerate(cells):
                for term, places in positions_of(values[row] or []).items():
                    for column, value in zip(columns, (term, doc, attr, places, term not in seen), strict=True):
                        column.append(value)
                    seen.add(term)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _POSTINGS.types, strict=True)], schema=_POSTINGS)


def attribute_cells(records: DataFrame, config: IndexConfig) -> list[Column]:
    """Each attribute as an array of texts."""
    kinds = dict(records.dtypes)
    values = [F.col(c) if kinds[c].startswith("array") else F.array(c) for c in config.attributes]
    return [v.cast("array<string>").alias(f"a{i}") for i, v in enumerate(values)]


def whole_records(records: DataFrame, config: IndexConfig) -> DataFrame:
    """``records`` in at least as many tasks as there are cores: a few would leave cores idle, and all that follows multiplies their rows."""
    workers = records.sparkSession.sparkContext.defaultParallelism
    return records.repartition(workers, config.ordinal) if records.rdd.getNumPartitions() < workers else records


def invert(records: DataFrame, config: IndexConfig) -> DataFrame:
    """``(term, doc_ord, attr, positions, first)``; ``first`` marks one row per term and document."""
    cells = attribute_cells(records, config)
    return records.select(F.col(config.ordinal).cast("bigint").alias("doc_ord"), *cells).mapInArrow(
        _invert, "term string, doc_ord bigint, attr int, positions array<int>, first boolean"
    )


def term_table(postings: DataFrame) -> DataFrame:
    """``(term, df, n_chars)``."""
    counts = postings.groupBy("term").agg(F.sum(F.col("first").cast("bigint")).alias("df"))
    return counts.select("term", "df", F.length("term").alias("n_chars"))


def facet_map(facets: dict[str, Column]) -> Column:
    """Facet name -> distinct non-null values."""
    entries = []
    for name, values in facets.items():
        kept = F.array_distinct(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.isNotNull()))
        entries += [F.lit(name), kept]
    return F.create_map(*entries)


def build_index(records: DataFrame, config: IndexConfig | None = None) -> Index:
    """Index ``records``, whose ordinals must be unique.

    Null attributes have no terms, null facets no values; a null popularity
    ranks after all others.  An empty table gives an empty index.
    """
    config = config or IndexConfig()
    records = whole_records(records, config)
    docs = records.select(
        F.col(config.ordinal).cast("bigint").alias("doc_ord"), F.col(config.key).alias("id"),
        F.col(config.popularity).cast("bigint").alias("popularity"), facet_map(config.facets()).alias("facets"),
    )
    docs = materialize(ordinals(docs, [F.desc_nulls_last("popularity"), F.asc("doc_ord")], "pop_rank"), "docs")
    inverted = materialize(invert(records, config), "postings")
    terms_ = materialize(term_table(inverted), "terms")
    return Index(config, docs, terms_, inverted.drop("first"), records)


def trie_nodes(terms_: DataFrame) -> Column | DataFrame:
    """One row, ``trie_nodes``: the nodes of a radix trie of the terms, root included.

    A node is a term or a prefix after which terms go on in two ways.
    """
    prefixes = terms_.select("term", F.explode(F.sequence(F.lit(1), F.length("term"))).alias("n"))
    prefixes = prefixes.select(F.substring("term", F.lit(1), F.col("n")).alias("prefix"), F.substring("term", F.col("n") + 1, F.lit(1)).alias("then"))
    nodes = prefixes.groupBy("prefix").agg(F.min("then").alias("a"), F.max("then").alias("b"))
    return nodes.filter("a <> b or a = ''").agg((F.count("*") + 1).alias("trie_nodes"))


def index_stats(index: Index) -> DataFrame:
    """One row: records, terms, postings, positions, trie_nodes, approx_bytes (of packed arrays, for comparison)."""
    counted = index.postings.agg(F.count("*").alias("postings"), F.coalesce(F.sum(F.size("positions")), F.lit(0)).alias("positions"))
    named = index.terms.agg(F.count("*").alias("terms"))
    held = index.docs.agg(F.count("*").alias("records"))
    values = index.facet_values().select("facet", "value").distinct().agg(F.count("*").alias("facet_values"))
    one = counted
    for more in (named, held, values, trie_nodes(index.terms)):
        one = one.join(F.broadcast(more))  # each has one row
    size = 8 * F.col("postings") + 4 * F.col("terms") + 2 * F.col("positions") + 4 * F.col("terms")
    size = size + 4 * F.ceil(F.col("records") / 32) * F.col("facet_values") + 4 * F.col("records")
    return one.select("records", "terms", "postings", "positions", "trie_nodes", size.cast("bigint").alias("approx_bytes"))
