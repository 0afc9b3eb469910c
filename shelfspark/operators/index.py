"""A stored search index: postings by term, a dictionary that meets misspelt words, changes as signed rows.

Four tables in buckets (see sources.versions), of which one manifest names the versions that belong together:

* postings, by term: (term, field, doc, tf, length, sign). A change of a document adds what it has now with sign 1 and
  what it had with sign -1; sums of signs tell what holds. compact() replaces the rows of a bucket by their sums.
* typos, by key: (key, term). A term's keys are all strings that are left of it without up to two of its letters. Terms
  two edits apart have such a string in common, so a query word meets a few rows of the dictionary, and edits are counted
  for these alone. Of terms beyond LONG letters, which have very many such strings, the keys are their three thirds with
  length and place: two edits leave one third as it is, moved by two places at most.
* lengths, by field: (field, documents, words), additive.
* contents, by document: its postings, for the change that takes them back.

A field is named kind/language/column, with ~ behind it where terms are English stems.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.stem import stem as stem_of
from shelfspark.operators import search
from shelfspark.operators.common import broadcast_if_small, cut
from shelfspark.sources.versions import BUCKETS, BucketedTable, Files

#: Letters of a term whose keys are what is left of it without two of them.
LONG = 32
#: Terms that a task stems, and terms of which it makes keys (some 50 of each term of ten letters).
STEMMED_IN_TASK, KEYED_IN_TASK = 20_000, 20_000
POSTING = "term string, field string, doc string, tf long, length long"


def _without_one(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))


def _thirds(length: int) -> list[tuple[int, int]]:
    """(from, letters) of the three thirds of a term."""
    at = [length * k // 3 for k in range(4)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def term_keys(term: Column) -> Column:
    """The dictionary's keys of a term."""
    once = _without_one(term)
    near = F.when(F.length(term) < 2, F.array(term)).when(F.length(term) < 4, F.concat(F.array(term), once))
    near = near.otherwise(F.concat(F.array(term), once, F.flatten(F.transform(once, _without_one))))
    cuts = [F.floor(F.length(term) * k / 3).cast("int") for k in range(4)]
    thirds = [F.concat_ws(":", F.length(term), F.lit(k), F.substring(term, cuts[k] + 1, cuts[k + 1] - cuts[k])) for k in range(3)]
    return F.array_distinct(F.when(F.length(term) <= LONG, near).otherwise(F.array(*thirds)))


def asked_keys(word: str, edits: int) -> set[str]:
    """Keys that every term within the edits of a query word has one of."""
    found, last = {word}, {word}
    if len(word) <= LONG + edits:
        for _ in range(edits):
            last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
            found |= last
    for length in range(max(LONG + 1, len(word) - edits), len(word) + edits + 1):
        for k, (at, n) in enumerate(_thirds(length)):
            found |= {f"{length}:{k}:{word[max(0, at + by) : max(0, at + by) + n]}" for by in range(-edits, edits + 1)}
    return found


def plain_postings(texts: DataFrame) -> DataFrame:
    """Postings of texts (field, doc, text), one row for each field and document; documents without words have none. Each
    row's words are counted by themselves, so a task holds those of a text and not all that it reads."""
    counts = F.udf(lambda found: list(Counter(found).items()), "array<struct<term:string,tf:bigint>>", useArrow=True)
    words = texts.select("field", "doc", search.terms(F.col("text")).alias("terms")).where(F.size("terms") > 0)
    each = words.select("field", "doc", F.size("terms").cast("long").alias("length"), F.explode(counts("terms")).alias("p"))
    return each.select("p.term", "field", "doc", "length", "p.tf")


def in_tasks(terms: DataFrame, each: int) -> DataFrame:
    """Distinct terms (term), written out and dealt to tasks of about `each`. Their bytes, by which adaptive execution
    would put them together, say little of the work on them."""
    terms = cut(terms)
    return terms.repartition(max(1, -(-terms.count() // each)), "term")


def stems(postings: DataFrame) -> DataFrame:
    """(term, stem) of the words that may have another stem than themselves; each is stemmed once."""
    words = postings.where(F.col("term").rlike("^[a-z]{3,}$")).select("term").distinct()
    return in_tasks(words, STEMMED_IN_TASK).withColumn("stem", F.udf(stem_of, "string", useArrow=True)("term"))


def stemmed_postings(postings: DataFrame) -> DataFrame:
    """The same by English stems."""
    joined = postings.join(broadcast_if_small(stems(postings)), "term", "left")
    stem = F.coalesce("stem", "term").alias("term")
    return joined.groupBy(stem, F.concat("field", F.lit("~")).alias("field"), "doc", "length").agg(F.sum("tf").alias("tf"))


def dictionary_rows(terms: DataFrame) -> DataFrame:
    """(key, term) of distinct terms (term)."""
    return in_tasks(terms, KEYED_IN_TASK).select(F.explode(term_keys(F.col("term"))).alias("key"), "term")


def analysed(texts: DataFrame) -> DataFrame:
    """Postings of texts (field, doc, text, stem: whether terms are stored by their stems, too)."""
    plain = cut(plain_postings(texts))
    stemmed_fields = texts.where("stem").select("field").distinct()
    stemmed = stemmed_postings(plain.join(F.broadcast(stemmed_fields), "field", "left_semi"))  # as many rows as fields
    names = ["term", "field", "doc", "tf", "length"]
    return plain.select(*names).unionByName(stemmed.select(*names))


class SearchIndex:
    """The index at root. Changes come in numbered batches by one writer; a batch that comes again changes nothing, and
    one that was broken off is taken up where it was. Readers see a batch whole or not at all. Without `fuzzy` there is no
    dictionary, and words are found as they are."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, fuzzy: bool = True):
        self.spark, self.root, self.fuzzy = spark, root.rstrip("/"), fuzzy
        table = lambda name, keys, kind: BucketedTable(spark, f"{self.root}/{name}", keys, buckets, kind)
        self.postings = table("postings", ["term"], f"{POSTING}, sign int")
        self.typos = table("typos", ["key"], "key string, term string")
        self.lengths = table("lengths", ["field"], "field string, documents long, words long")
        self.contents = table("contents", ["doc"], POSTING)
        self.tables = {"postings": self.postings, "typos": self.typos, "lengths": self.lengths, "contents": self.contents}
        self.files = Files(spark, self.root)

    def manifest(self) -> dict:
        """{at, batch, tables: {name: version}} of the last batch that is whole; `at` counts manifests."""
        names = [n for n in self.files.names() if n.startswith("index-")]
        return json.loads(self.files.text(names[-1])) if names else {"at": 0, "batch": -1, "tables": {}}

    def _commit(self, batch: int) -> None:
        number = self.manifest()["at"] + 1
        self.files.put(f"index-{number:09}.json", json.dumps({"at": number, "batch": batch, "tables": {n: t.manifest()["version"] for n, t in self.tables.items()}}))

    def _read(self, name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        version = self.manifest()["tables"].get(name)
        rows = self.tables[name].read(buckets, version) if version else None
        return self.spark.createDataFrame([], self.tables[name].kind) if rows is None else rows

    def apply(self, texts: DataFrame, changed: DataFrame, batch: int) -> bool:
        """Documents (doc) in `changed` now have the texts (field, doc, text, stem), or are gone if they have none. False
        if the batch was there before."""
        if batch <= self.manifest()["batch"]:
            return False
        changed = cut(changed.select(F.col("doc").cast("string").alias("doc")).distinct())
        names = ["term", "field", "doc", "tf", "length"]
        new = cut(analysed(texts.withColumn("doc", F.col("doc").cast("string")).join(changed, "doc", "left_semi")).select(*names))
        last = self.manifest()["tables"].get("contents")
        touched = self.contents.touched(changed) if last else None
        before = self.contents.read(touched, last) if last else None
        signed = new.withColumn("sign", F.lit(1))
        if before is not None:  # else each row of new is there once
            signed = signed.unionByName(before.join(changed, "doc", "left_semi").select(*names, F.lit(-1).alias("sign")))
            signed = cut(signed.groupBy(*names).agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0"))
        once = {"writer": "index", "batch": batch}
        self.postings.write(signed, append=True, **once)
        if self.fuzzy:
            terms = signed.where("sign > 0").select("term").distinct()
            self.typos.write(dictionary_rows(terms), append=True, **once)
        of_docs = signed.select("field", "doc", "length", "sign").distinct().groupBy("field").agg(F.sum("sign").alias("documents"), F.sum(F.col("sign") * F.col("length")).alias("words"))
        self.lengths.write(of_docs, append=True, **once)
        self.contents.write(new if before is None else before.join(changed, "doc", "left_anti").select(*names).unionByName(new), touched, **once)
        self._commit(batch)
        return True

    def compact(self, buckets: list[int] | None = None) -> None:
        """Replaces the postings and keys of some buckets (all, if none are named) by what holds of them."""
        every = list(range(self.postings.buckets)) if buckets is None else buckets
        self.postings.write(self.held(every).withColumn("sign", F.lit(1)), every)
        if self.fuzzy:
            self.typos.write(self._read("typos", every).distinct(), every)
        self._commit(self.manifest()["batch"])

    def held(self, buckets: Iterable[int] | None = None, fields: Iterable[str] | None = None, words: DataFrame | None = None) -> DataFrame:
        """The postings that hold, of some buckets, fields and words (term)."""
        rows = self._read("postings", buckets)
        if fields is not None:
            rows = rows.where(F.col("field").isin(*fields))
        if words is not None:
            rows = rows.join(words, "term", "left_semi")
        return rows.groupBy("term", "field", "doc", "tf", "length").agg(F.sum("sign").alias("sign")).where("sign > 0").drop("sign")

    def dictionary(self) -> DataFrame:
        """(key, term) of all terms."""
        return self._read("typos").distinct()

    def near(self, asked: Iterable[str], fuzzy: bool = True) -> DataFrame:
        """(asked, term) of the dictionary's terms within the edits of each query word."""
        if not (fuzzy and self.fuzzy):
            return self.spark.createDataFrame([(w, w) for w in asked], "asked string, term string")
        edits = {w: search.fuzzy_edits(w) for w in asked}
        keys = {w: sorted(asked_keys(w, n)) for w, n in edits.items()}
        wanted = self.spark.createDataFrame([(k, w, edits[w]) for w, ks in keys.items() for k in ks], "key string, asked string, edits int")
        met = self._read("typos", {self.typos.bucket_of(k) for ks in keys.values() for k in ks}).join(F.broadcast(wanted), "key")  # a few hundred rows a word
        apart = F.levenshtein("term", "asked")
        return met.where(apart <= F.col("edits")).select("asked", "term").distinct()

    def best_field(self, fields: dict[str, float], query: str, fuzzy: bool = True) -> DataFrame:
        """(doc, score) of documents by the best of their fields, as search.best_field has it. Read are the buckets of the
        dictionary that have a key of the query, and the buckets of postings that have a term near it."""
        words = search.query_terms(query)
        plain = {f: w for f, w in fields.items() if not f.endswith("~")}
        stems = {f: w for f, w in fields.items() if f.endswith("~")}
        parts = []
        for some, asked in ((plain, sorted(set(words))), (stems, sorted({stem_of(w) for w in words}))):
            if some and asked:
                near = broadcast_if_small(self.near(asked, fuzzy))
                buckets = [r[0] for r in near.select(self.postings.bucket(F.col("term"))).distinct().collect()]  # as many as buckets at most
                parts.append(self.held(buckets, some, near.select("term").distinct()).join(near, "term"))
        if not parts:
            return self.spark.createDataFrame([], "doc string, score double")
        weights = F.create_map(*[F.lit(x) for f, w in fields.items() for x in (f, float(w))])
        matched = reduce(DataFrame.unionByName, parts).withColumn("weight", weights[F.col("field")])
        lengths = self._read("lengths", {self.lengths.bucket_of(f) for f in fields}).where(F.col("field").isin(*fields)).groupBy("field")
        statistics = lengths.agg(F.sum("documents").cast("double").alias("n"), (F.sum("words") / F.sum("documents")).alias("average"))
        return search.scored(matched, statistics)
