"""Language identification by hierarchical discrimination (operator 3).

The first step tells the language family, one linear support vector machine against the rest for
each; inside the family, one-versus-one machines vote between the languages, and a tie goes to the
larger sum of margins. Features are the shares of hashed runs of one to three bytes of the
lower-cased whole text.

Defined results: a null, empty or blank text is `und` with margin 0; a text of any length is read
whole; every row is judged by itself, repeated or not; a tie of votes and margins goes to the language
first in the alphabet; a null doc_id stays null; ids are whole numbers; an id that several rows have is
fitted on once; a family or table with one language needs no machine; without labelled rows every
text is `und`; other columns are left alone; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import common, learn

#: Families of closely related languages; a language that is in none is a family by itself.
FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic"}
#: Labelled documents of each language that the machines are fitted on, at most.
MAX_TRAIN = 500
BUCKETS = 4096
UNKNOWN = "und"


def grams(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Feature numbers of the runs of one, two and three bytes that begin at each byte, their texts' offsets, and which count."""
    data, off = common.utf8(pc.utf8_lower(common.as_array(column)))
    white = (data == 10) | (data == 13) | (data == 9)
    x = np.where(white, 32, data).astype(np.uint32)
    if not len(x):
        return [x.astype(np.int64)] * 3, off, np.zeros(0, bool)
    b, c = np.full_like(x, 32), np.full_like(x, 32)
    b[:-1], c[:-2] = x[1:], x[2:]
    ends = off[1:][np.diff(off) > 0]
    b[ends - 1] = 32  # a text ends in white space
    c[ends - 1] = 32
    two = ends - 2
    c[two[two >= 0]] = 32
    mix = lambda v, salt: ((v * np.uint32(2654435761) + np.uint32(salt)) >> np.uint32(32 - 12)).astype(np.int64)
    return [mix(x, 1), mix(x << np.uint32(8) | b, 77), mix(x << np.uint32(16) | b << np.uint32(8) | c, 12345)], off, x != 32


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    languages: dict[str, list[str]] = field(default_factory=dict)
    #: One column of feature weights and one intercept for each machine.
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    pairs: list[tuple[str, str]] = field(default_factory=list)

    def margins(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A row of all machines' outputs for each text, and which texts have anything but white space."""
        parts, off, counted = grams(column)
        n, m = len(off) - 1, len(self.bias)
        out = np.zeros((n, m))
        some = np.flatnonzero(np.diff(off))
        if len(some):
            for j in range(m):
                w = self.weights[:, j]
                out[some, j] = np.add.reduceat(w[parts[0]] + w[parts[1]] + w[parts[2]], off[some], dtype=np.float64)
            out /= np.maximum(3 * np.diff(off), 1)[:, None]
        full = np.zeros(n, bool)
        full[some] = np.add.reduceat(counted, off[some], dtype=np.int64) > 0 if len(some) else False
        return out + self.bias, full

    def predict(self, column: pa.Array) -> tuple[list[str], list[str], np.ndarray]:
        """Family, language and the margin of the last decision taken, for each text."""
        z, full = self.margins(column)
        n, k = len(z), len(self.families)
        family, language, margin = np.full(n, UNKNOWN, object), np.full(n, UNKNOWN, object), np.zeros(n)
        if not k or not n:
            return list(family), list(language), margin
        if k > 1:
            best = z[:, :k].argmax(axis=1)
            margin = z[np.arange(n), best]
        else:
            best = np.zeros(n, np.int64)
        for f, name in enumerate(self.families):
            rows = np.flatnonzero((best == f) & full)
            inside = self.languages[name]
            family[rows] = name
            language[rows] = inside[0]
            if len(inside) > 1 and len(rows):
                votes = np.zeros((len(rows), len(inside)))
                total = np.zeros_like(votes)
                for p, (a, b) in enumerate(self.pairs):
                    if a in inside and b in inside:
                        v = z[rows, (k if k > 1 else 0) + p]
                        i, j = inside.index(a), inside.index(b)
                        votes[:, i] += v > 0
                        votes[:, j] += v <= 0
                        total[:, i] += v
                        total[:, j] -= v
                pick = (votes + total / (1 + np.abs(total).max() * 4)).argmax(axis=1)
                language[rows] = np.array(inside, object)[pick]
                margin[rows] = total[np.arange(len(rows)), pick]
        margin[~full] = 0
        return list(family), list(language), margin


def features(column: pa.Array) -> np.ndarray:
    out = []
    for lo, hi in common.blocks(column):
        parts, off, _ = grams(column.slice(lo, hi - lo))
        doc = np.repeat(np.arange(hi - lo), np.diff(off))
        x = sum(np.bincount(doc * BUCKETS + p, minlength=(hi - lo) * BUCKETS) for p in parts).reshape(hi - lo, BUCKETS)
        out.append((x / np.maximum(3 * np.diff(off), 1)[:, None]).astype(np.float32))
    return np.concatenate([np.zeros((0, BUCKETS), np.float32), *out])


def fit(texts: pa.Array, langs: list[str], families: dict[str, str] = FAMILIES) -> Model:
    x, lang = features(texts), np.array(langs, object)
    model = Model()
    for one in sorted(set(langs)):
        model.languages.setdefault(families.get(one, one), []).append(one)
    model.families = sorted(model.languages)
    family = np.array([families.get(g, g) for g in langs], object)
    # rare features carry as much as frequent ones once each is divided by its usual size
    scale = 1 / np.sqrt((x**2).mean(axis=0) + 1e-10) if len(x) else np.ones(BUCKETS)
    scale = np.minimum(scale, 3e3).astype(np.float32)
    weights, bias = [], []

    def machine(rows: np.ndarray, positive: np.ndarray) -> None:
        w, b = learn.linear_svm(x[rows] * scale / 30, np.where(positive, 1.0, -1.0), lam=1e-3)
        weights.append((w * scale / 30).astype(np.float32))
        bias.append(b)

    if len(model.families) > 1:
        for f in model.families:
            machine(np.ones(len(x), bool), family == f)
    for f in model.families:
        for a, b in combinations(model.languages[f], 2):
            rows = (lang == a) | (lang == b)
            machine(rows, lang[rows] == a)
            model.pairs.append((a, b))
    if weights:
        model.weights, model.bias = np.stack(weights, axis=1), np.array(bias)
    return model


def _least(most: int):
    """Of each language, the `most` ids of least hash that a task meets."""

    def over(batches):
        best: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = batch.column(1).dictionary_encode()
            ids, code = batch.column(0).to_numpy(), lang.indices.to_numpy()
            for k, name in enumerate(lang.dictionary.to_pylist()):
                own = np.unique(np.concatenate([best.get(name, ids[:0]), ids[code == k]]))
                h = common.mix(own.view(np.uint64))
                best[name] = own[np.lexsort((own, h))[:most]]
        for name, own in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([name] * len(own), pa.string()), pa.array(common.mix(own.view(np.uint64)).view(np.int64))], names=["id", "lang", "h"])

    return over


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MAX_TRAIN) -> Model:
    """Fitted on at most `most` documents of each language of the language column, of different ids."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.where("id is not null and lang is not null and text <> ''")
    each = rows.select("id", "lang").mapInArrow(_least(most), "id long, lang string, h long").distinct()
    # h holds an unsigned hash: its sign bit flipped, it sorts as one
    order = Window.partitionBy("lang").orderBy(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), "id")
    some = each.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).select("id", "lang")
    table = rows.join(F.broadcast(some), ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text")).toArrow()  # `most` ids a language
    table = table.sort_by([("id", "ascending"), ("lang", "ascending")])
    return fit(common.as_array(table.column("text")), table.column("lang").to_pylist())


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, family, language and margin of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights a machine

    def fn(batch):
        for lo, hi in common.blocks(batch.column(1)):
            family, language, margin = shared.value.predict(common.as_array(batch.column(1)).slice(lo, hi - lo))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(family, pa.string()), pa.array(language, pa.string()), pa.array(margin)], names=["doc_id", "family", "language", "margin"])

    return common.only(docs, id_col, text_col).mapInArrow(common.flat_map(fn), "doc_id long, family string, language string, margin double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document of the whole table."""
    docs = common.load(spark, sf_dir, "documents")
    return identify(docs, train(docs))
