"""Collocations: phrases of words that stand together far more often than chance has them.

Texts are dealt with in shards of some million words, each within one task. A shard is an array of word numbers with 0
between pieces of text; its suffixes are ranked by prefix doubling as far as the longest phrase reaches, and each interval
of suffixes with `n` common words (of the LCP array) is one phrase of `n` words and its count there. Counts of all shards
are merged by language and phrase.

A phrase of `least` occurrences is made of words, pairs and triples that have as many. So before phrases are written out
and counted, three passes find frequent words, pairs of these, and triples of these, by sums of counts by a hash; what is
frequent is told to the next pass by a bit map of bounded size. Hashes that meet, in the sums or in the map, let a phrase
through that the last pass counts and finds too rare: they change the work, never a result.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut

LEAST, LONGEST, LIMIT = 100, 5, 2000
#: Words of a shard; a shard ends with a piece.
SHARD = 1 << 20
#: Bits of the map of frequent phrases: 64 for each of them, 2^27 (16 MB) at most.
BITS_EACH, MOST_BITS = 64, 27
#: Words of the phrases that are counted by hash first.
HASHED = 3
#: Hashes that a task holds before it passes their counts on.
HELD = 1 << 22
UNKNOWN = "und"
#: Lower case; what ends a piece becomes a byte that UTF-8 doesn't have.
END = b"\xff"
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + END * 10)
#: Bytes of a text that are cut into words together; a longer text is dealt with in parts that end with a piece.
PART = 1 << 22
COUNTS = "lang string, phrase binary, f long"
COUNTS_ARROW = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("f", pa.int64())])
MIX, STIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Shard:
    """Word numbers (from 1, one for each language and word; 0 behind each piece) of some texts."""

    def __init__(self) -> None:
        self.ids, self.words = array("i"), defaultdict(int)
        self._next = count(1).__next__
        self._numbers: dict[str, defaultdict[bytes, int]] = {}

    def add(self, lang: str, words: list[bytes]) -> None:
        """Words of some pieces, END between pieces."""
        if lang not in self._numbers:
            self._numbers[lang] = defaultdict(self._next, {END: 0})
        self.ids.extend(map(self._numbers[lang].__getitem__, words))
        self.ids.append(0)
        self.words[lang] += len(words) - words.count(END)

    def hashed(self) -> np.ndarray:
        """By word number, a hash of language and word."""
        out = np.zeros(1 + sum(len(n) - 1 for n in self._numbers.values()), np.uint64)
        for name, numbers in self._numbers.items():
            seed = xxhash.xxh64_intdigest(name)
            at = np.fromiter(numbers.values(), np.int64, len(numbers))
            out[at] = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in numbers), np.uint64, len(numbers))
        return out

    def names(self) -> tuple[np.ndarray, pa.Array]:
        """By word number, the language's place in `self.words`, and the word."""
        n = 1 + sum(len(n) - 1 for n in self._numbers.values())
        lang, word = np.zeros(n, np.int64), [b""] * n
        for place, name in enumerate(self.words):
            for w, k in self._numbers[name].items():
                word[k], lang[k] = w, place
        return lang, pa.array(word, pa.binary())


def shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Shard]:
    """Of (lang, text in UTF-8 or null)."""
    shard = Shard()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data, at = (text.as_py() or b"").translate(TABLE), 0
            while at < len(data):
                stop = data.find(END, at + PART)
                stop = len(data) if stop < 0 else stop
                if words := data[at:stop].replace(END, b" \xff ").split():
                    shard.add(lang, words)
                at = stop + 1
                if len(shard.ids) >= size:
                    yield shard
                    shard = Shard()
    if shard.ids:
        yield shard


def phrase_keys(hashed: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the phrases of n words at some places, from the hashes of all words."""
    key = hashed[places]
    for k in range(1, n):
        key = key * MIX + hashed[places + k]
        key = (key ^ key >> np.uint64(32)) * STIR
    return key


def frequent(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which keys the map lets through."""
    at = keys >> np.uint64(65 - (len(bits) * 8).bit_length())
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def chains(ids: np.ndarray, joined: np.ndarray, least: int) -> np.ndarray:
    """The words in chains of `least` words or more, a 0 behind each chain. joined: of each place, whether the next one
    goes on with it."""
    starts = np.flatnonzero(np.append(True, ~joined[:-1]))
    length = np.diff(np.append(starts, len(ids)))
    keep = length >= least
    starts, length = starts[keep], length[keep]
    out = np.zeros(int((length + 1).sum()), ids.dtype)
    to = np.cumsum(length + 1) - length - 1
    within = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(to, length) + within] = ids[np.repeat(starts, length) + within]
    return out


def intervals(ids: np.ndarray, least: int, longest: int, reach: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, a place of each phrase of n words, its count), n from least to longest. ids ends with 0, as all pieces do.
    reach: words of the longest phrase that may begin at a place."""
    if not len(ids):
        return
    padded = np.append(ids, np.zeros(longest, ids.dtype)).astype(np.int64)
    size, rank, k = len(ids), ids.astype(np.int64), 1
    while k < longest:  # rank orders suffixes by k words
        behind = np.zeros(size, np.int64)
        behind[: max(0, size - k)] = rank[k:]
        rank = rank * (int(rank.max()) + 1) + behind
        k *= 2
        if k < longest:
            rank = np.unique(rank, return_inverse=True)[1]
    order = np.argsort(rank)
    order = order[padded[order] > 0]
    inside, common = np.ones(len(order), bool), np.ones(max(0, len(order) - 1), bool)
    for n in range(1, longest + 1):
        word = padded[order + n - 1]
        inside &= word > 0
        if reach is not None:
            inside &= reach[order] >= n
        common &= word[1:] == word[:-1]  # the LCP is n or more
        if n >= least:
            begins = np.flatnonzero(np.append(True, ~common)[: len(order)])
            times = np.diff(np.append(begins, len(order)))
            whole = inside[begins]
            yield n, order[begins[whole]], times[whole]


def live(shard: Shard, hashed: np.ndarray, maps: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers, reach): chains of `least` words or more, of words and pairs that the maps let through, and how far
    phrases of frequent triples go on from each place. maps: of words, pairs, triples, as many as there are."""
    ids = np.frombuffer(shard.ids, np.int32)
    if maps:
        ids = np.where(frequent(hashed, maps[0])[ids], ids, 0)
    joined = np.append((ids[:-1] > 0) & (ids[1:] > 0), False)
    if len(maps) > 1:
        at = np.flatnonzero(joined)
        joined[at] = frequent(phrase_keys(hashed[ids], at, 2), maps[1])
    ids = chains(ids, joined, least)
    ends = np.flatnonzero(ids == 0)
    reach = np.repeat(ends, np.diff(np.append(-1, ends))) - np.arange(len(ids))
    if len(maps) > 2:
        at = np.flatnonzero(reach >= 3)
        rare = at[~frequent(phrase_keys(hashed[ids], at, 3), maps[2])]
        stop = np.append(rare, len(ids))[np.searchsorted(rare, np.arange(len(ids)))]  # where the next rare triple begins
        reach = np.minimum(reach, stop + 2 - np.arange(len(ids)))
    return ids, reach


def passed_on(keys: np.ndarray, times: np.ndarray, bits: int) -> pa.RecordBatch:
    """Counts of hashes (in order), a row for each part: the parts are by the first bits, of the rest 32 bits are kept."""
    part = (keys >> np.uint64(64 - bits)).astype(np.int64)
    low = (keys >> np.uint64(32 - bits)).astype(np.uint32)
    at = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else np.zeros(1, np.int64)
    spans = list(zip(at[:-1].tolist(), at[1:].tolist()))
    times = times.astype(np.uint32)
    columns = [pa.array(part[at[:-1]]), *(pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (low, times))]
    return pa.RecordBatch.from_arrays(columns, names=["part", "low", "times"])


def merged(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, np.concatenate(times), len(found)).astype(np.int64)


def part_bits(texts: DataFrame) -> int:
    """Bits of a part's number: some four parts or more for each task, so that a part's counts stay as many at any size."""
    return max(6, (4 * texts.rdd.getNumPartitions()).bit_length())


def frequent_keys(texts: DataFrame, n: int, least: int, maps: list, shard_words: int) -> DataFrame:
    """(key) of the hashes, 32 bits and those of their part, whose phrases of n words have `least` occurrences together."""
    bits = part_bits(texts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times, held = [], [], 0
        for shard in shards(batches, shard_words):
            hashed = shard.hashed()
            ids, reach = live(shard, hashed, [m.value for m in maps], n)
            for _, places, counts in intervals(ids, n, n, reach):
                keys.append(phrase_keys(hashed[ids], places, n))
                times.append(counts)
                held += len(counts)
            if held > HELD:
                keys, times = map(lambda x: [x], merged(keys, times))
                held = len(keys[0])
                if 2 * held > HELD:
                    yield passed_on(keys[0], times[0], bits)
                    keys, times, held = [], [], 0
        if held:
            yield passed_on(*merged(keys, times), bits)

    def sums(table: pa.Table) -> pa.Table:
        part = np.uint64(table["part"][0].as_py())
        low, times = (np.frombuffer(b"".join(table[c].to_pylist()), np.uint32) for c in ("low", "times"))
        found, total = merged([low], [times])
        often = found[total >= least].astype(np.uint64)
        return pa.table({"key": ((part << np.uint64(64 - bits)) | often << np.uint64(32 - bits)).view(np.int64)})

    return texts.mapInArrow(count, "part long, low binary, times binary").groupBy("part").applyInArrow(sums, "key long")


def bit_map(keys: DataFrame, most_bits: int = MOST_BITS):
    """A broadcast map of keys. What comes to the driver are words of 64 bits of the map, 2^(most_bits - 6) rows at most."""
    keys = cut(keys)
    spark, size = keys.sparkSession, min(most_bits, max(10, (keys.count() * BITS_EACH).bit_length()))
    words = keys.select(F.shiftrightunsigned("key", 64 - size).alias("at")).groupBy(F.shiftrightunsigned("at", 6).alias("place")).agg(F.expr("bit_or(shiftleft(1L, CAST(at & 63 AS INT)))").alias("bits"))
    found = words.toArrow()
    packed = np.zeros((1 << size) // 64, np.int64)
    packed[found["place"].to_numpy()] = found["bits"].to_numpy()
    return spark.sparkContext.broadcast(packed.view(np.uint8))


def grouped(tables: list[pa.Table]) -> pa.Table:
    """Counts (lang, phrase, f) added up."""
    return pa.concat_tables(tables).group_by(["lang", "phrase"]).aggregate([("f", "sum")]).rename_columns(["lang", "phrase", "f"])


def in_parts(table: pa.Table, bits: int) -> pa.RecordBatch:
    """(part, counts): the rows of each part, by a hash of the phrase, as one Arrow stream."""
    hashed = np.fromiter((xxhash.xxh32_intdigest(p or b"") for p in table["phrase"].to_pylist()), np.int64, len(table))
    part = hashed >> (32 - bits)
    order = np.argsort(part, kind="stable")
    table, part = table.take(pa.array(order)), part[order]
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    blobs = []
    for a, b in zip(starts.tolist(), np.append(starts[1:], len(part)).tolist()):
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema) as stream:
            stream.write_table(table.slice(a, b - a))
        blobs.append(out.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(part[starts]), pa.array(blobs, pa.binary())], names=["part", "counts"])


def written_out(texts: DataFrame, least: int, longest: int, maps: list, shard_words: int) -> DataFrame:
    """(lang, phrase, f) of the phrases that have `least` occurrences and more; phrase null: all words of lang. Maps of
    what is frequent decide what is counted at all."""
    bits = part_bits(texts)
    names = ["lang", "phrase", "f"]

    def tables(shard: Shard) -> Iterator[pa.Table]:
        (lang, word), hashed, at = shard.names(), shard.hashed(), [m.value for m in maps]
        langs = pa.array(list(shard.words), pa.string())
        yield pa.table([langs, pa.nulls(len(langs), pa.binary()), pa.array(shard.words.values(), pa.int64())], names)
        times = np.bincount(np.frombuffer(shard.ids, np.int32), minlength=len(hashed))
        times[0] = 0
        some = np.flatnonzero((times > 0) & frequent(hashed, at[0]))
        yield pa.table([langs.take(pa.array(lang[some])), word.take(pa.array(some)), pa.array(times[some], pa.int64())], names)
        if longest > 1:
            ids, reach = live(shard, hashed, at, 2)
            for n, places, times in intervals(ids, 2, longest, reach):
                phrase = pc.binary_join_element_wise(*[word.take(pa.array(ids[places + d])) for d in range(n)], b" ")
                yield pa.table([langs.take(pa.array(lang[ids[places]])), phrase, pa.array(times, pa.int64())], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for shard in shards(batches, shard_words):
            held += tables(shard)
            if sum(map(len, held)) > HELD // 4:
                held = [grouped(held)]
                if len(held[0]) > HELD // 8:
                    yield in_parts(held.pop(), bits)
        if held:
            yield in_parts(grouped(held), bits)

    def sums(table: pa.Table) -> pa.Table:
        found = grouped([pa.ipc.open_stream(blob.as_buffer()).read_all() for blob in table["counts"]])
        return found.filter(pc.or_(pc.is_null(found["phrase"]), pc.greater_equal(found["f"], least))).cast(COUNTS_ARROW)

    return texts.mapInArrow(count, "part long, counts binary").groupBy("part").applyInArrow(sums, COUNTS)


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shard_words: int = SHARD, most_bits: int = MOST_BITS) -> DataFrame:
    """(lang, phrase, f) of all phrases up to `longest` words with `least` occurrences; phrase null: all words of lang."""
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("binary").alias("text"))
    maps: list = []
    for n in range(1, min(HASHED, longest) + 1):
        maps.append(bit_map(frequent_keys(texts, n, least, maps, shard_words), most_bits))
    return cut(written_out(texts, least, longest, maps, shard_words).withColumn("phrase", F.col("phrase").cast("string")))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, contained_percent: int = 100, shard_words: int = SHARD, most_bits: int = MOST_BITS) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all phrases of 2 to `longest` words with a >= `least` occurrences, but for
    those within a longer one that has at least contained_percent of their occurrences. l, r: occurrences of the parts of
    the cut of lowest score floor(1000 * a * n / (l * r)), the first of equals. Counts below 10^16 are exact.

    Letters A-Z count as a-z. A null text is empty, a null lang is `und`; a document without words adds nothing, repeated
    rows count each, ids and other columns are not looked at, an empty table gives an empty one. A phrase doesn't cross
    the end of a piece or of a document. Texts are read whole; a very long one is dealt with in several shards."""
    all_counts = phrase_counts(docs, least, longest, shard_words, most_bits)
    freq, totals = all_counts.where("phrase IS NOT NULL"), all_counts.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
    words = F.split("phrase", " ")
    longer = freq.select("lang", "phrase", F.col("f").alias("a"), words.alias("w")).where(F.size("w") > 1)
    part = lambda at, n: F.concat_ws(" ", F.slice("w", at, n))
    cuts = longer.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("w")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(freq.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    cuts = cuts.join(broadcast_if_small(totals), "lang")
    whole = lambda c: f"CAST({c} AS DECIMAL(16, 0))"
    cuts = cuts.withColumn("score", F.expr(f"(1000BD * {whole('a')} * {whole('n')}) div ({whole('l')} * {whole('r')})"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b"))
    spans = [F.struct(part(F.lit(at), F.lit(n)).alias("phrase"), F.lit(at + n - 1).alias("end"), F.lit(n).alias("size")) for n in range(2, longest) for at in range(1, longest - n + 2)]
    if spans:
        fits = F.filter(F.array(*spans), lambda s: (s["end"] <= F.size("w")) & (s["size"] < F.size("w")))
        inner = longer.where(F.size("w") > 2).select("lang", "a", F.explode(fits).alias("s")).groupBy("lang", F.col("s.phrase").alias("phrase")).agg(F.max("a").alias("within"))
        best = best.join(inner, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("within") < contained_percent * F.col("b.a"), F.lit(True)))
    return best.select("lang", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")


def best_of_each(phrases: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The first `limit` phrases of each language by score, then a (both descending), then phrase, with their rank. First
    those of 64 parts of a language, so that no task gets all phrases of one."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = phrases.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= limit)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= limit)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
