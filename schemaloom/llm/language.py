"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A
word's probability in a language is the sum over all ways to cut it into pieces
of the product of their probabilities (a forward pass over byte positions); a
text's is the product over its words. The posterior over languages, from equal
priors, gives the prediction.

Piece probabilities are learned by expectation maximisation (forward-backward on
word counts per language). The counts come from a bounded sample of labelled
texts; the sweeps run as Spark jobs over the counts.

Words are maximal runs of letters, lower-cased, behind a space; runs over
``CHUNK`` bytes are cut. Defined cases: null text, empty text and text without
letters are ``und`` with score 0; with no labelled text at all everything is
``und``; equal texts get equal results; ties go to the first label in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from schemaloom.llm.arrow import add_columns, as_text
from schemaloom.llm.bpe import load_tokens
from schemaloom.session import materialize

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
UNKNOWN = "und"
CHUNK = 24
LONGEST_PIECE = 12
#: Expected number of labelled texts per language that piece probabilities are fitted on.
SAMPLE_TEXTS = 3_000
#: Most labels a model is fitted for; the model's size is this times the vocabulary.
MOST_LABELS = 400
SWEEPS = 4
SMOOTHING = 0.02
REMEMBERED = 400_000
ROWS_AT_ONCE = 1_000
LETTERS = re.compile(r"[^\W\d_]+")
_B = np.uint64(1099511628211)


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def chunks_of(word: str) -> list[bytes]:
    raw = b" " + word.encode()
    return [raw[i:i + CHUNK] for i in range(0, len(raw), CHUNK)]


class Lattice:
    """All pieces of the vocabulary that occur in a batch of byte strings."""

    def __init__(self, path: str) -> None:
        tokens = load_tokens(path)
        self.size = len(tokens)
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        for n in range(1, LONGEST_PIECE + 1):
            ids = [i for i, t in enumerate(tokens) if len(t) == n]
            keys = np.zeros(len(ids), np.uint64)
            raw = np.frombuffer(b"".join(tokens[i] for i in ids), np.uint8).reshape(len(ids), n)
            for k in range(n):
                keys = keys * _B + raw[:, k].astype(np.uint64) + np.uint64(1)
            order = np.argsort(keys)
            self.tables.append((keys[order], np.asarray(ids, np.int64)[order]))

    def edges(self, strings: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        """Per piece length, the id that starts at each position (``size`` where there is none), and the lengths."""
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        width = int(lengths.max())
        raw = np.zeros((len(strings), width), np.uint8)
        raw[np.arange(width) < lengths[:, None]] = np.frombuffer(b"".join(strings), np.uint8)
        out, keys = [], np.zeros(raw.shape, np.uint64)
        for n in range(1, min(LONGEST_PIECE, width) + 1):
            keys = keys[:, :width - n + 1] * _B + raw[:, n - 1:].astype(np.uint64) + np.uint64(1)
            known, ids = self.tables[n - 1]
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            hit = (known[at] == keys) & (np.arange(n, n + keys.shape[1]) <= lengths[:, None])
            out.append(np.where(hit, ids[at], self.size))
        return out, lengths


def forward(edges: list[np.ndarray], lengths: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """Probability of every prefix: strings x positions x languages. The last row of ``probs`` is zero."""
    width = edges[0].shape[1]
    total = np.zeros((len(lengths), width + 1, probs.shape[1]))
    total[:, 0] = 1
    for at in range(width):
        for n in range(1, min(len(edges), width - at) + 1):
            total[:, at + n] += total[:, at] * probs[edges[n - 1][:, at]]
    return total


def backward(edges: list[np.ndarray], lengths: np.ndarray, probs: np.ndarray) -> np.ndarray:
    width = edges[0].shape[1]
    total = np.zeros((len(lengths), width + 1, probs.shape[1]))
    total[np.arange(len(lengths)), lengths] = 1
    for at in range(width - 1, -1, -1):
        for n in range(1, min(len(edges), width - at) + 1):
            total[:, at] += total[:, at + n] * probs[edges[n - 1][:, at]]
    return total


def log_probabilities(lattice: Lattice, words: list[str], probs: np.ndarray, batch: int = 4096) -> np.ndarray:
    """Log probability of each word in each language."""
    out = np.zeros((len(words), probs.shape[1]))
    parts = sorted(((c, i) for i, w in enumerate(words) for c in chunks_of(w)), key=lambda x: len(x[0]))
    for k in range(0, len(parts), batch):
        strings, owners = zip(*parts[k:k + batch])
        edges, lengths = lattice.edges(list(strings))
        ends = forward(edges, lengths, probs)[np.arange(len(lengths)), lengths]
        np.add.at(out, np.asarray(owners), np.log(ends))
    return out


@dataclass
class Model:
    labels: list[str]
    #: Pieces x languages with a zero row at the end.
    probs: np.ndarray
    path: str


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", path: str = VOCABULARY,
        sample_texts: int = SAMPLE_TEXTS, sweeps: int = SWEEPS) -> Model:
    """Piece probabilities per label from rows with a label and a text.

    About ``sample_texts`` texts of each label are taken by a hash of the text; all of
    them where there are fewer. The fitted table has vocabulary x labels entries.
    """
    spark = labelled.sparkSession
    rows = as_text(labelled.select(F.col(label).cast("string").alias("label"), F.col(text).alias("text")), "text")
    rows = rows.where("label is not null and text is not null")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(MOST_LABELS).collect()}
    labels, lattice = sorted(counts), Lattice(path)
    if not labels:
        return Model([], np.zeros((lattice.size + 1, 0)), path)
    share = F.create_map(*[F.lit(x) for k in labels for x in (k, min(1.0, sample_texts / counts[k]))])
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(F.col("label").isin(labels) & (draw < F.try_element_at(share, F.col("label"))))

    def count(frames):
        for frame in frames:
            seen: dict[tuple[str, str], int] = {}
            for lab, t in zip(frame["label"], frame["text"]):
                for w in words_of(t):
                    seen[lab, w] = seen.get((lab, w), 0) + 1
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["label", "word", "n"])

    words = sample.mapInPandas(count, "label string, word string, n long").groupBy("word", "label").agg(F.sum("n").alias("n"))
    words = materialize(words.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("n"))
                        .select("word", F.array(*[F.coalesce(F.try_element_at("n", F.lit(k)), F.lit(0)) for k in labels]).alias("n")), "language-words")
    probs = np.zeros((lattice.size + 1, len(labels)))
    probs[:-1] = 1 / lattice.size
    for _ in range(sweeps):
        held = spark.sparkContext.broadcast(probs)

        def expected(frames, held=held, size=lattice.size, path=path):
            lattice, p = Lattice(path), held.value
            total = np.zeros(p.shape)
            for frame in frames:
                weights = np.stack(frame["n"].to_list()).astype(float) if len(frame) else np.zeros((0, p.shape[1]))
                parts = sorted(((c, i) for i, w in enumerate(frame["word"]) for c in chunks_of(w)), key=lambda x: len(x[0]))
                for k in range(0, len(parts), 4096):
                    strings, owners = zip(*parts[k:k + 4096])
                    edges, lengths = lattice.edges(list(strings))
                    a, b = forward(edges, lengths, p), backward(edges, lengths, p)
                    w = weights[list(owners)] / np.maximum(b[:, 0], 1e-300)
                    for n, e in enumerate(edges, 1):
                        at = np.nonzero(e < size)
                        use = a[:, :e.shape[1]][at] * p[e[at]] * b[:, n:n + e.shape[1]][at] * w[at[0]]
                        for j in range(p.shape[1]):
                            total[:, j] += np.bincount(e[at], weights=use[:, j], minlength=size + 1)
            piece, lab = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "label": lab, "n": total[piece, lab]})

        sums = words.mapInPandas(expected, "piece long, label long, n double").groupBy("piece", "label").agg(F.sum("n").alias("n")).toPandas()
        held.unpersist()
        counts_now = np.zeros((lattice.size, len(labels)))
        counts_now[sums["piece"], sums["label"]] = sums["n"]
        counts_now += SMOOTHING
        probs = np.vstack([counts_now / counts_now.sum(axis=0), np.zeros((1, len(labels)))])
    return Model(labels, probs, path)


class Scorer:
    """Texts to log probabilities with a bounded memory of words; one per task."""

    def __init__(self, model: Model) -> None:
        self.model, self.lattice = model, Lattice(model.path)
        self.row: dict[str, int] = {}
        self.values = np.zeros((0, len(model.labels)))

    def posteriors(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Posterior over the labels; None where there is nothing to judge."""
        split = [words_of(t) if t else [] for t in texts]
        new = list(dict.fromkeys(w for words in split for w in words if w not in self.row))
        if len(self.row) + len(new) > REMEMBERED:
            self.row, self.values = {}, self.values[:0]
            new = list(dict.fromkeys(w for words in split for w in words))
        if new and self.model.labels:
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new))))
            self.values = np.concatenate([self.values, log_probabilities(self.lattice, new, self.model.probs)])
        out = []
        for words in split:
            if not words or not self.model.labels:
                out.append(None)
                continue
            total = self.values[[self.row[w] for w in words]].sum(axis=0)
            total = np.exp(total - total.max())
            out.append(total / total.sum())
        return out


def predict(df: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Append the most probable label and its posterior."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(held.value)

        def work(texts):
            found = scorer.posteriors(texts)
            return [
                [UNKNOWN if p is None else scorer.model.labels[int(p.argmax())] for p in found],
                [0.0 if p is None else float(p.max()) for p in found],
            ]

        return work

    return add_columns(df, text, [(lang, StringType()), (score, DoubleType())], make)


def prediction(spark: SparkSession, model: Model, text: Column) -> Column:
    """Struct of the most probable label and its posterior, for use in a filter: only texts go to Python, and no text comes back."""
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(held.value)
        for batch in batches:
            found = [p for at in range(0, len(batch), ROWS_AT_ONCE) for p in scorer.posteriors(batch.iloc[at:at + ROWS_AT_ONCE].to_list())]
            yield pd.DataFrame({
                "lang": [UNKNOWN if p is None else scorer.model.labels[int(p.argmax())] for p in found],
                "score": [0.0 if p is None else float(p.max()) for p in found],
            })

    return F.pandas_udf(run, "lang string, score double")(text.cast("string"))
