"""The catalogue's tables, and how the star-schema test tables are presented as such."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.expressions import DIMENSIONS, READER_SHELVES, average_of_halves


def kept(cat: Catalogue, df: DataFrame) -> DataFrame:
    if not getattr(cat, "keep", False):
        return df
    cat.__dict__.setdefault("persisted", []).append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return df


def once(cat: Catalogue, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What build gives, kept by a catalogue that keeps tables."""
    if not getattr(cat, "keep", False):
        return build()
    if name not in cat.__dict__:
        cat.__dict__[name] = kept(cat, build())
    return cat.__dict__[name]


def is_rated() -> Column:
    """Whether the user of a shelf has rated its book."""
    u, b = F.col("user_id"), F.col("book_id")
    return F.col("status").isin("read", "reading") & ((u + b) % 2 == 0) & (b % 9 != 0)


def overall_rating() -> Column:
    """The rating of a shelf that is_rated."""
    u, b = F.col("user_id"), F.col("book_id")
    base = F.lit(0.5) + F.lit(4.5) * ((b * 37) % 100) / F.lit(99.0)
    halves = F.round((base + ((u * 7 + b * 3) % 5 - 2) * F.lit(0.5)) * 2)
    return F.least(F.greatest(halves / 2, F.lit(0.5)), F.lit(5.0))


@dataclass(frozen=True)
class Catalogue:
    """Tables by their reader; each is read when it is first asked for. With keep, tables that take a join or a
    grouping to present stay in executors' memory or on their disks; what a lost executor held is derived again."""

    spark: SparkSession
    sf_dir: str
    keep: bool = False

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def purchases(self) -> DataFrame:
        """What each customer bought of each part: the latest line as a shelf's status and mark, and sums of all lines."""
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_quantity")
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
        last = F.max(F.struct("o_orderdate", "l_orderkey", "l_linenumber", "o_orderstatus", "l_returnflag", "l_quantity"))
        flag = lambda x: F.count_if(F.col("l_returnflag") == x)
        # Few lines are of one user and book: dealt before they are summed they are smaller than the sums of each task.
        dealt = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).repartition("o_custkey", "l_partkey")
        bought = dealt.groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("book_id")).agg(
            last.alias("last"), flag("R").alias("r"), flag("N").alias("n"), flag("A").alias("a"), F.count("*").alias("c"), F.min("o_orderdate").alias("created_at")
        )
        status = F.when(F.col("last.o_orderstatus") == "F", "read").when(F.col("last.o_orderstatus") == "O", "reading").when(F.col("last.l_returnflag") == "R", "abandoned").otherwise("want_to_read")
        return kept(self, bought.select("user_id", "book_id", status.alias("status"), (F.col("last.l_quantity") >= 46).alias("is_favorite"), F.col("last.o_orderdate").alias("updated_at"), "r", "n", "a", "c", "created_at"))

    @cached_property
    def bookshelves(self) -> DataFrame:
        """The latest purchase of each customer and part is that user's shelf of the book."""
        return self.purchases.select("user_id", "book_id", "status", "is_favorite", "updated_at")

    @cached_property
    def book_sums(self) -> DataFrame:
        """(book_id, ...): sums of each book's purchases, ratings and shelves, from one pass over its purchases."""
        rated = is_rated()
        n = lambda s: F.count_if(F.col("status") == s).alias(s)
        total = [F.sum(x).alias(x) for x in ("r", "n", "a", "c")]
        ratings = [F.count_if(rated).alias("rating_count"), F.sum(F.when(rated, overall_rating() * 2)).cast("long").alias("halves")]
        return kept(self, self.purchases.groupBy("book_id").agg(*total, F.min("created_at").alias("created_at"), *ratings, *map(n, READER_SHELVES)))

    @cached_property
    def ratings(self) -> DataFrame:
        u, b = F.col("user_id"), F.col("book_id")
        dims = []
        for i, name in enumerate(DIMENSIONS):
            value = F.least(F.greatest(F.col("overall_rating") + ((u + b + i) % 3 - 1) * F.lit(0.5), F.lit(0.5)), F.lit(5.0))
            dims.append((F.when(b % 4 != 0, value) if name == "humor" else value).alias(name))
        return self.bookshelves.where(is_rated()).withColumn("overall_rating", overall_rating()).select("user_id", "book_id", "overall_rating", *dims, F.col("updated_at").alias("created_at"))

    @cached_property
    def view_counts(self) -> DataFrame:
        """Views of each entity id that the event stream names."""
        views = self.table("events").where("event_type = 'view'")
        return kept(self, views.groupBy(F.get_json_object("props", "$.k").cast("long").alias("entity_id")).agg(F.count("*").alias("view_count")))

    @cached_property
    def books(self) -> DataFrame:
        p = F.col("p_partkey")
        factor, known = F.lit(1) + p % 40, p % 18 != 0
        some = lambda x: F.coalesce(F.col(x), F.lit(0)) * factor
        return kept(
            self,
            self.table("part")
            .join(self.book_sums.drop(*READER_SHELVES).withColumnRenamed("book_id", "p_partkey"), "p_partkey", "left")
            .join(self.view_counts.withColumnRenamed("entity_id", "p_partkey"), "p_partkey", "left")
            .select(
                p.alias("book_id"),
                F.col("p_name").alias("title"),
                F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), p).alias("slug"),
                F.when(p % 7 == 0, "de").otherwise("en").alias("language"),
                F.when(p % 10 != 0, F.concat(F.lit("cover/"), p)).alias("primary_cover_url"),
                F.when(p % 11 != 0, F.col("p_size") * 20).cast("int").alias("number_of_pages"),
                (F.lit(1900) + p % 125).cast("int").alias("original_publication_year"),
                F.when(p % 3 == 0, F.col("p_brand")).alias("series_id"),
                F.when((p % 3 == 0) & (p % 13 != 0), F.col("p_size")).cast("double").alias("series_position"),
                F.when(p % 5 != 0, F.concat(F.lit("isbn"), p)).alias("isbn"),
                F.when(p % 4 != 0, F.col("p_brand")).alias("publisher"),
                F.when(p % 6 != 0, F.concat(F.lit("About "), F.col("p_name"))).alias("description"),
                "created_at",
                F.coalesce("rating_count", F.lit(0)).alias("rating_count"),
                average_of_halves(F.col("halves"), F.col("rating_count")).alias("avg_rating"),
                F.when(known, some("c")).otherwise(0).alias("ol_rating_count"),
                F.when(known, F.round(F.lit(0.5) + F.lit(4.5) * ((p * 37) % 100) / F.lit(99.0), 2)).alias("ol_avg_rating"),
                some("n").alias("ol_want_to_read_count"),
                some("a").alias("ol_currently_reading_count"),
                some("r").alias("ol_already_read_count"),
                F.coalesce("view_count", F.lit(0)).alias("view_count"),
            ),
        )

    @cached_property
    def authors(self) -> DataFrame:
        views = self.view_counts.withColumnRenamed("entity_id", "author_id")
        s = F.col("s_suppkey")
        named = self.table("supplier").select(s.alias("author_id"), F.col("s_name").alias("name"), F.concat(F.lit("author-"), s).alias("slug"), F.when(s % 4 != 0, F.concat(F.lit("photo/"), s)).alias("photo_url"))
        return named.join(views, "author_id", "left").withColumn("view_count", F.coalesce("view_count", F.lit(0)))

    @cached_property
    def book_authors(self) -> DataFrame:
        return self.table("lineitem").where("l_linenumber = 1 and l_quantity >= 46").select(F.col("l_partkey").alias("book_id"), F.col("l_suppkey").alias("author_id")).distinct().transform(lambda df: kept(self, df))

    @cached_property
    def book_genres(self) -> DataFrame:
        words = F.split("p_name", " ")
        names = F.array(words[0], words[1], F.col("p_type"), F.concat(F.lit("size"), F.floor(F.col("p_size") / 10).cast("string")))
        slugs = F.array_distinct(F.transform(names, lambda n: F.lower(F.replace(n, F.lit(" "), F.lit("-")))))
        return self.table("part").select(F.col("p_partkey").alias("book_id"), F.explode(slugs).alias("genre_id"))

    @cached_property
    def genres(self) -> DataFrame:
        """A genre's id is its slug."""
        return self.book_genres.select("genre_id").distinct().select("genre_id", F.col("genre_id").alias("slug"), F.initcap(F.replace("genre_id", F.lit("-"), F.lit(" "))).alias("name"))

    @cached_property
    def users(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("reader"), F.col("c_custkey")).alias("username"))

    @cached_property
    def comments(self) -> DataFrame:
        said = self.table("conversations").where("role = 'user'")
        n = self.table("part").agg(F.coalesce(F.max("p_partkey"), F.lit(1))).first()[0]
        books = (F.col("conv_id").cast("long") * 8 + F.col("turn")) % n + 1
        return said.select(
            (F.col("conv_id").cast("long") * 100 + F.col("turn")).alias("comment_id"),
            F.col("conv_id").cast("long").alias("user_id"),
            books.alias("book_id"),
            F.col("text").alias("body"),
            (F.col("turn") % 3 == 0).alias("is_spoiler"),
            F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id").cast("long") * 3600 + F.col("turn")).alias("created_at"),
        )

    @cached_property
    def app_readers(self) -> DataFrame:
        """Users with the book on a shelf other than the abandoned ones."""
        return kept(self, self.bookshelves.where(F.col("status").isin(*READER_SHELVES)).groupBy("book_id").agg(F.count("*").alias("app_readers")))

    @cached_property
    def author_names(self) -> DataFrame:
        """Sorted names and slugs of each book's authors."""
        linked = self.book_authors.join(self.authors.select("author_id", "name", "slug"), "author_id")
        text = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
        return kept(self, linked.groupBy("book_id").agg(text("name").alias("author_names"), text("slug").alias("author_slugs")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of the warehouse where it is unset."""
    return (spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints").rstrip("/")


def _files(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of the files that tables of a folder consist of."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for table in files.listStatus(path):
        parts = files.listStatus(table.getPath()) if table.isDirectory() and table.getPath().getName().endswith(".parquet") else [table]
        out += [(p.getPath().toString(), p.getLen(), p.getModificationTime()) for p in parts]
    return tuple(sorted(out))


_OPEN: dict[tuple[str, str], tuple[tuple, Catalogue]] = {}


def catalogue(spark: SparkSession, sf_dir: str) -> Catalogue:
    """The application's catalogue of a folder: queries share the tables that it keeps, as long as the folder's files are
    the same. When one has changed, what was kept is released and derived anew."""
    key, files = (spark.sparkContext.applicationId, sf_dir), _files(spark, sf_dir)
    if key in _OPEN and _OPEN[key][0] != files:
        release(spark, sf_dir)
    if key not in _OPEN:
        _OPEN[key] = files, Catalogue(spark, sf_dir, keep=True)
    return _OPEN[key][1]


def release(spark: SparkSession, sf_dir: str) -> None:
    """Gives back the memory and disk that the catalogue of a folder keeps."""
    _, cat = _OPEN.pop((spark.sparkContext.applicationId, sf_dir), (None, None))
    for df in getattr(cat, "persisted", ()):
        df.unpersist()
