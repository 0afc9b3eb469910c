"""Toxicity classifier with a counterfactual regulariser.

A logistic model over the words that a text holds, and the beginnings of these words, told apart by how many different
words have them. In each labelled text that names a
group of people, the name is swapped for that of another group; the model is charged for the square of the change of its
score, so that a name by itself carries little weight and neutral mentions aren't taken for abuse.

Features are counted by class over the training rows as a Spark job; those whose frequencies differ between the classes
beyond chance are kept. Each enters with its log-odds ratio as its scale, and weights are found by accelerated proximal
gradient with an L1 penalty: few features keep a weight, and long texts don't gather noise.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, labelled_sample
from .quality import remainder

#: Bits of the hash of a word or beginning; two more tell its levels apart.
BITS = 28
#: Labelled rows that the model is fitted on, about: those whose hash is in the share that gives as many.
FIT_ROWS = 20_000
#: Chi-square value of a difference that isn't taken for chance; a parameter of train() and score_documents().
LEAST_CHI2 = 6.6
#: Lengths of the beginnings of words, and numbers of words with one that are told apart.
STEMS, LEVELS = (3, 4, 5, 6, 7, 8), (1, 2, 3, 4)
#: Names of groups that are swapped for one another, in kinds; a name is only swapped within its kind. English, German,
#: French and Spanish.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "deaf", "blind", "elderly"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("frau", "mann"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("muslimisch", "christlich", "jüdisch", "buddhistisch"),
    ("einwanderer", "flüchtlinge", "ausländer", "migranten"),
    ("schwule", "lesben", "heteros"),
    ("behinderte", "gehörlose", "blinde"),
    ("femmes", "hommes", "filles", "garçons"),
    ("femme", "homme", "fille", "garçon"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("musulman", "chrétien", "juif", "bouddhiste"),
    ("immigrés", "réfugiés", "étrangers"),
    ("handicapés", "sourds", "aveugles"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("mujer", "hombre", "chica", "chico"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("inmigrantes", "refugiados", "extranjeros"),
    ("discapacitados", "sordos", "ciegos"),
)
#: Bytes of a word: ASCII letters and whatever isn't ASCII.
WORD = re.compile(rb"[a-z\x80-\xff]+")


def place(key: bytes) -> int:
    """Of a word (=word) or a beginning of words (<beginning): the feature of its first level, the next ones follow."""
    return (xxhash.xxh32_intdigest(key, 7) & ((1 << BITS) - 1)) << 2


def words_of(data: bytes) -> set[bytes]:
    return set(WORD.findall(data.lower()))


def places_of(word: bytes) -> list[int]:
    letters = word.decode("utf-8", "ignore")
    return [place(b"=" + word), *(place(b"<" + letters[:n].encode()) for n in STEMS if len(letters) > n)]


def features(words: set[bytes]) -> set[int]:
    """Each word, and each beginning of words as often as different words have it, up to the last of LEVELS."""
    met = Counter(p for w in words for p in places_of(w))
    return {p + level - 1 for p, n in met.items() for level in LEVELS if n >= level}


def swaps(words: set[bytes], kinds: tuple = IDENTITY_TERMS) -> dict[bytes, bytes]:
    """The next name of its kind that the text doesn't hold, for each name of a group in it."""
    out = {}
    for kind in kinds:
        names = [n.encode() for n in kind]
        for i, name in enumerate(names):
            if name in words:
                others = [o for o in names[i + 1 :] + names[:i] if o not in words]
                if others:
                    out[name] = others[0]
    return out


def both_versions(data: bytes, kinds: tuple) -> tuple[set[int], set[int] | None]:
    """Features of a text, and of its version with groups swapped, if it names any."""
    words = words_of(data)
    change = swaps(words, kinds)
    return features(words), features({change.get(w, w) for w in words}) if change else None


def count_batches(kinds: tuple):
    """(toxic, body) to (feature, clean, toxic, named): how many texts of each class have it, and how many swaps touch it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter, Counter] = (Counter(), Counter(), Counter())

        def flush() -> pa.RecordBatch:
            keys = sorted(set().union(*counts))
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)], names=["feature", "clean", "toxic", "named"])
            for c in counts:
                c.clear()
            return out

        for batch in batches:
            for toxic, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                own, other = both_versions(body.as_py() or b"", kinds)
                counts[1 if toxic else 0].update(own)
                if other is not None:
                    counts[2].update(own ^ other)
            if sum(map(len, counts)) > 500_000:
                yield flush()
        yield flush()

    return run


def kept_batches(kinds: tuple, kept: dict[int, int]):
    """(toxic, body) to (toxic, own, swapped): places of the kept features of a text and of its swap, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [both_versions(t.as_py() or b"", kinds) for t in batch.column(1)]
            places = lambda fs: None if fs is None else sorted(kept[f] for f in fs if f in kept)
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([places(a) for a, _ in pairs], kind), pa.array([places(b) for _, b in pairs], kind)], names=["toxic", "own", "swapped"])

    return run


@dataclass(frozen=True)
class Model:
    weights: dict[int, float]
    bias: float

    @cached_property
    def levels(self) -> dict[int, list[tuple[int, int]]]:
        """(level, feature) of each place whose features have weights."""
        out: dict[int, list[tuple[int, int]]] = {}
        for f in self.weights:
            out.setdefault(f & ~3, []).append(((f & 3) + 1, f))
        return out

    def score(self, data: bytes, seen: dict[bytes, tuple[int, ...]]) -> float:
        """seen: places of words met before, as far as these have weights; so most are looked up and not hashed."""
        levels, met = self.levels, []
        for word in words_of(data):
            if (found := seen.get(word)) is None:
                if len(seen) > 500_000:
                    seen.clear()
                found = seen[word] = tuple(p for p in places_of(word) if p in levels)
            if found:
                met += found
        hits = [f for p, n in Counter(met).items() for level, f in levels[p] if n >= level]
        total = self.bias + sum(map(self.weights.__getitem__, sorted(hits)))
        return float(1 / (1 + np.exp(-np.clip(total, -50, 50))))


class Bags:
    """Sparse rows of ones."""

    def __init__(self, rows: list[list[int]], width: int):
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.columns = np.concatenate([np.asarray(r, np.int64) for r in rows]) if rows else np.empty(0, np.int64)
        self.row = np.repeat(np.arange(len(rows)), self.lengths)
        self.n, self.width = len(rows), width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.columns], minlength=self.n)

    def transposed_dot(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, weights=r[self.row], minlength=self.width)


def fit(own: list[list[int]], swapped: list[list[int] | None], toxic: np.ndarray, width: int, l1: float = 2e-4, fairness: float = 5.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights of `width` features, and the bias: logistic loss + l1 * |w / scale| + fairness * mean((w.x - w.x')^2)
    over texts x that name a group and their swaps x'. A feature's scale is its log-odds ratio."""
    x, y, n = Bags(own, width), toxic.astype(float), max(1, len(own))
    pairs = [(a, b) for a, b in zip(own, swapped) if b is not None]
    a, b, charge = Bags([p for p, _ in pairs], width), Bags([q for _, q in pairs], width), 2 * fairness / max(1, len(pairs))
    n1 = y.sum()
    odds = lambda hits, total: np.log((hits + 0.5) / (total + 1))
    scale = odds(x.transposed_dot(y), n1) - odds(x.transposed_dot(1 - y), n - n1)
    mean = x.transposed_dot(np.ones(x.n)) / n

    def forward(u: np.ndarray) -> np.ndarray:
        return x.dot(scale * u) - (mean * scale) @ u  # centred columns

    def backward(r: np.ndarray) -> np.ndarray:
        return scale * (x.transposed_dot(r) - mean * r.sum())

    def charged(u: np.ndarray) -> np.ndarray:
        change = a.dot(scale * u) - b.dot(scale * u)
        return charge * scale * (a.transposed_dot(change) - b.transposed_dot(change))

    top, v = 1.0, np.ones(width) / max(1, width) ** 0.5
    for _ in range(20):  # power iteration bounds the curvature
        u = backward(forward(v)) * 0.25 / n + charged(v)
        top = np.linalg.norm(u) or 1.0
        v = u / top
    step, rate = 0.9 / top, 4.0
    w, z, t = np.zeros(width), np.zeros(width), 1.0
    bias = zb = float(np.log((n1 + 0.5) / (n - n1 + 0.5)))
    for _ in range(steps):
        f = forward(z) + zb
        r = (1 / (1 + np.exp(-np.clip(f, -50, 50))) - y) / n
        new = z - step * (backward(r) + charged(z))
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_bias = zb - rate * r.sum()
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, zb, t = new + (t - 1) / t2 * (new - w), new_bias + (t - 1) / t2 * (new_bias - bias), t2
        w, bias = new, new_bias
    weights = scale * w
    return weights, float(bias - mean @ weights)


def chosen_features(bodies: DataFrame, kinds: tuple, least_chi2: float = LEAST_CHI2) -> list[int]:
    """Features of rows (toxic, body) whose frequencies differ between the classes, and those that swaps touch: all of
    them, however rare. They come from the bounded sample of rows that the model is fitted on, which bounds their number."""
    counts = bodies.mapInArrow(count_batches(kinds), "feature long, clean long, toxic long, named long").groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"), F.sum("named").alias("named"))
    classes = bodies.agg(F.count_if(F.col("toxic") == 0).alias("n0"), F.count_if(F.col("toxic") == 1).alias("n1")).first()
    n0, n1 = float(classes["n0"]), float(classes["n1"])
    if not n0 or not n1:
        return []
    c, t = F.col("c").cast("double"), F.col("t").cast("double")
    chi2 = F.try_divide((t * (n0 - c) - c * (n1 - t)) ** 2 * (n0 + n1), n0 * n1 * (c + t) * (n0 + n1 - c - t))
    scored = counts.withColumn("chi2", F.coalesce(chi2, F.lit(0.0))).where((F.col("chi2") >= least_chi2) | (F.col("named") > 0))
    return sorted(r["feature"] for r in scored.select("feature").collect())


def train(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS, kinds: tuple = IDENTITY_TERMS, least_chi2: float = LEAST_CHI2, **how) -> Model | None:
    """Fits on docs (doc_id, text) and labels (doc_id, toxic), both of the training part alone. None without labels of
    both kinds."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if not (total := known.count()):
        return None
    rows = labelled_sample(docs, known, limit / total)
    bodies = cut(rows.select((F.col("toxic") > 0).cast("int").alias("toxic"), F.col("text").cast("binary").alias("body")))  # `limit` texts, about
    chosen = chosen_features(bodies, kinds, least_chi2)
    if not chosen:
        return None
    found = bodies.mapInArrow(kept_batches(kinds, {f: i for i, f in enumerate(chosen)}), "toxic int, own array<int>, swapped array<int>").toArrow()
    toxic = found.column("toxic").to_numpy()
    weights, bias = fit(found.column("own").to_pylist(), found.column("swapped").to_pylist(), toxic, len(chosen), **how)
    return Model({f: float(w) for f, w in zip(chosen, weights) if w}, bias)


def score_documents(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, limit: int = FIT_ROWS, kinds: tuple = IDENTITY_TERMS, **how) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text, ...).

    Labels are learnt from rows whose remainder isn't `held` alone. Null texts are scored as empty ones, long texts whole; without labels
    of both kinds all scores are 0; repeated rows are scored alike; null ids belong to remainder 0; an empty table gives
    no rows; other columns are not looked at.
    """
    own = lambda df: df.where(remainder(F.col("doc_id"), modulus) != held)
    model = train(own(docs), own(labels), limit, kinds, **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[int, ...]] = {}
        for batch in batches:
            scores = [model.score(t.as_py() or b"", seen) if model else 0.0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", F.col("text").cast("binary").alias("body")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id"), modulus) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
