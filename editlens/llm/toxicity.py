"""Toxicity by a learned, weighted lexicon matched with Aho-Corasick.

Texts are folded first: compatibility forms, lower case, look-alike letters of other scripts, and digits or
signs that stand for letters inside a word. The folded words, joined by single spaces, run through one
automaton whose patterns are whole words (space at both ends) and word beginnings (space in front). A word
counts with the largest weight of its patterns, unless an exception phrase starts at the same word. The sum of
weights, normalised by the text's length, becomes a score from 0 to 1 by a logistic curve.

Lexicon and curve are learned from labelled rows: log-odds of document frequencies, of two patterns that say the same
only the longer. At most ``SAMPLE`` labelled documents (those of the smallest id hash) are used: that is the
one bound here; every text is scored whole.

Defined cases: null and empty texts have no words and get the curve's value at 0; without labels, or with
labels of one kind only, the lexicon is empty and all scores are alike: 40/41 if all labels are toxic, else (nearly) 0;
rows that repeat an id are scored one by one and learned from once, by the smallest of their texts; null ids are never learned from; extra
columns pass through, result names are replaced; an empty table gives no rows. The lexicon holds the ``PATTERNS`` strongest patterns
and as many harmless words, which bounds the automaton that goes with every task.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

RESULTS = ("held_out", "score", "predicted")
#: Labelled documents that the lexicon is learned from, and patterns that it holds, at most.
SAMPLE, PATTERNS = 20_000, 500
MIN_DOCS, MIN_LOG_ODDS, SHORTEST, LONGEST = 4, 2.5, 3, 10

#: Letters of other scripts by their Latin look-alikes.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ո": "n",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "l", "ѵ": "v",
}
#: Digits and signs that stand for letters inside a word.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: Harmless phrases that begin with a word of abuse.
EXCEPTIONS = ["trash can", "trash bin", "trash bag", "idiot proof", "clown fish", "clown car", "pathetic fallacy"]

_FOLD, _SUB = str.maketrans(HOMOGLYPHS), str.maketrans(SUBSTITUTES)
_TOKENS = regex.compile(r"[\p{L}\p{M}\p{N}@$!]+").findall
_INVISIBLE = regex.compile(r"[­​-‏⁠﻿]+")


def fold(text: str | None) -> list[str]:
    """Folded words of a text."""
    if not text:
        return []
    text = unicodedata.normalize("NFKC", text).lower()
    if not text.isascii():
        text = _INVISIBLE.sub("", text).translate(_FOLD)
    out = []
    for t in _TOKENS(text):
        if not t.isalpha():
            t = t.strip("@$!")
            if not t or t.isdigit():
                continue
            t = t.translate(_SUB)
        out.append(t)
    return out


def grams(word: str) -> list[str]:
    """Beginnings of a word, and the word itself with a space behind."""
    return [word[:k] for k in range(SHORTEST, min(len(word), LONGEST) + 1)] + [word + " "]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)     # pattern without its space in front
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (-20.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick
        a = ahocorasick.Automaton()
        for p, w in self.weights.items():
            a.add_word(" " + p, (len(p), w))
        for p in self.exceptions:                               # an exception says so by its weight
            a.add_word(f" {p} ", (len(p) + 1, -1.0))
        if len(a):
            a.make_automaton()
        return a

    def sums(self, texts: list[str | None], a) -> tuple[np.ndarray, np.ndarray]:
        """(sum of weights, words) of each text."""
        s, n = np.zeros(len(texts)), np.zeros(len(texts))
        for i, t in enumerate(texts):
            ws = fold(t)
            n[i] = len(ws)
            if not ws or not len(a):
                continue
            at: dict[int, float] = {}
            for end, (k, w) in a.iter(f" {' '.join(ws)} "):
                start, old = end - k, at.get(end - k, 0.0)
                at[start] = -1.0 if w < 0 or old < 0 else max(old, w)
            s[i] = sum(w for w in at.values() if w > 0)
        return s, n

    def scores(self, s: np.ndarray, n: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(s, n) @ np.array(self.curve), -40, 40)))


def features(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Constant, weight for each hundred words, weight."""
    return np.stack([np.ones(len(s)), np.log1p(100 * s / (n + 20)), np.log1p(s)], axis=1)


def fit_curve(s: np.ndarray, n: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    x, w = features(s, n), np.zeros(3)
    keep = ridge * np.diag([0.0, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
          sample: int = SAMPLE) -> Model:
    seen = (labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~is_held_out(F.col(doc_id)))
            .groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
            .orderBy(F.xxhash64("id"), "id").limit(sample))
    # the labelled side is bounded by ``sample``
    train = written(docs.join(F.broadcast(seen), F.col(doc_id) == F.col("id"))
                    .groupBy("id", "y").agg(F.min(F.col(text)).alias("text")), "toxic-train")
    n = {r.y: r["count"] for r in train.groupBy("y").count().collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        return Model(curve=(math.log(40) if bad else -40.0, 0.0, 0.0))

    def count(batches):
        for pdf in batches:
            t, c = Counter(), Counter()
            for y, x in zip(pdf["y"], pdf["text"]):
                (t if y else c).update({g for w in set(fold(x)) for g in grams(w)})
            keys = list(t.keys() | c.keys())
            if not keys:
                continue
            yield pd.DataFrame({"g": np.array(keys, dtype=object), "t": [t[k] for k in keys], "c": [c[k] for k in keys]})
    counts = (train.mapInPandas(count, "g string, t long, c long").groupBy("g").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
              .withColumn("w", F.log((F.col("t") + 0.5) / (bad + 1)) - F.log((F.col("c") + 0.5) / (good + 1))))
    counts = written(counts.where((F.col("t") >= MIN_DOCS) | (F.col("c") >= MIN_DOCS)), "toxic-grams")
    top = (counts.where((F.col("t") >= MIN_DOCS) & (F.col("w") >= MIN_LOG_ODDS))
           .orderBy(F.desc("w"), F.desc("t"), F.desc(F.length("g")), "g").limit(8 * PATTERNS).collect())
    found = {r.g: (r.t, r.w) for r in top}
    # a beginning goes if one longer pattern has nearly all of its documents
    most: dict[str, int] = {}
    for g, (t, _) in found.items():
        for k in range(SHORTEST, len(g)):
            most[g[:k]] = max(most.get(g[:k], 0), t)
    weights = {g: w for g, (t, w) in found.items() if most.get(g, 0) < 0.8 * t}
    weights = dict(list(weights.items())[:PATTERNS])
    begins = [g for g in weights if not g.endswith(" ")]
    harmless = []
    if begins:                                  # whole words under a beginning that clean texts use more
        harmless = [r.g.strip() for r in counts.where(F.col("g").endswith(" ") & (F.col("w") < 0) & (F.col("c") >= MIN_DOCS)
                                                      & F.col("g").rlike("^(" + "|".join(map(regex.escape, begins)) + ")"))
                    .orderBy("w", "g").limit(PATTERNS).collect()]
    model = Model(weights, EXCEPTIONS + harmless)

    def sums(batches):
        a = model.automaton()
        for pdf in batches:
            s, k = model.sums(pdf["text"].tolist(), a)
            yield pd.DataFrame({"s": s, "n": k, "y": pdf["y"]})
    rows = train.mapInPandas(sums, "s double, n double, y int").toPandas()      # ``sample`` rows at most
    model.curve = fit_curve(rows["s"].to_numpy(), rows["n"].to_numpy(), rows["y"].to_numpy(dtype=float))
    return model


def score(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """All columns of ``df`` but the text, plus ``RESULTS``."""
    cols = [c for c in df.columns if c != text and c not in RESULTS]
    schema = T.StructType([df.schema[c] for c in cols] + [T.StructField("score", T.DoubleType())])

    def run(batches):
        a = model.automaton()
        for b in batches:
            out = model.scores(*model.sums(b.column(text).to_pylist(), a))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in cols] + [pa.array(out)], names=[*cols, "score"])
    scored = df.select(*cols, text).mapInArrow(run, schema)
    return scored.select(*cols, is_held_out(F.col(doc_id)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
