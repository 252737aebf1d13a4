"""Toxic spans by a linear-chain conditional random field, documents scored by its marginals.

Only documents are labelled, so tokens are labelled first: a token of a toxic
document counts as toxic if one of its features is found far more often in
toxic than in clean documents. The field is trained on these tokens; its
forward-backward marginals give the offending offsets, and their sum and
maximum the score of a document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fingerprints import sketch
from .shared import SLICE_BYTES, SLICE_ROWS, hold, importable, map_slices

WORD = re.compile(r"[^\W_]+")
SENTENCE_END = re.compile(r"[.!?\n]")
#: A chain is a sentence, or as many words of a longer one.
CHAIN_WORDS = 64
#: Words whose evidence a worker keeps, and the length up to which it does.
MEMORY, KEPT_LENGTH = 200_000, 100
#: Labelled documents that the model is fitted on, at most, of either label.
TOXIC_SAMPLE, CLEAN_SAMPLE = 1_200, 3_000
#: A feature is weighed if its rate in toxic documents is e ** LEANING times that
#: in clean ones and chance makes no such feature, but with odds of e ** -SURE; from
#: e ** STRONG times on it labels a token.
LEANING, STRONG, SURE = 1.5, 3.0, 3.0
TRAINING_STEPS, LEARNING_RATE, PENALTY = 80, 0.3, 0.02
THRESHOLD = 0.7


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def features(word: str) -> list[str]:
    """The word in lower case, its first four to six letters and its last four."""
    word = word.lower()
    found = [word]
    found += [f"{word[:n]}*" for n in (4, 5, 6) if len(word) > n]
    if len(word) > 4:
        found.append(f"*{word[-4:]}")
    return found


@dataclass
class Field:
    """Weights of toxic features, bias, transitions [from, to] and start; score weights."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    scoring: np.ndarray = field(default_factory=lambda: np.array([-20.0, 0.0, 0.0]))

    def emission(self, word: str) -> float | None:
        """Evidence for a toxic token; None without a weighed feature."""
        known = [self.weights[name] for name in features(word) if name in self.weights]
        return self.bias + sum(known) if known else None


def forward_backward(
    emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of tag 1 [chain, token] and of tag pairs, summed, [2, 2].

    `emissions` holds the log potential of tag 1 against tag 0, padded; the
    recursions are scaled per step.
    """
    chains, width = emissions.shape
    potentials = np.ones((chains, width, 2))
    potentials[:, :, 1] = np.exp(np.clip(emissions, -30, 30))
    moves = np.exp(transitions)
    forward = np.empty((chains, width, 2))
    forward[:, 0] = np.exp(start) * potentials[:, 0]
    forward[:, 0] /= forward[:, 0].sum(1, keepdims=True)
    for t in range(1, width):
        now = (forward[:, t - 1] @ moves) * potentials[:, t]
        forward[:, t] = now / now.sum(1, keepdims=True)
    backward = np.ones((chains, width, 2))
    pairs = np.zeros((2, 2))
    for t in range(width - 2, -1, -1):
        inside = (t + 1 < lengths)[:, None]
        ahead = potentials[:, t + 1] * backward[:, t + 1]
        now = ahead @ moves.T
        backward[:, t] = np.where(inside, now / now.sum(1, keepdims=True), 1.0)
        joint = forward[:, t, :, None] * moves * ahead[:, None, :]
        joint /= joint.sum((1, 2), keepdims=True)
        pairs += (joint * inside[:, :, None]).sum(0)
    both = forward * backward
    return both[:, :, 1] / both.sum(2), pairs


def chains_of(text: str, emission) -> list[tuple[list[tuple[int, int]], list[float | None]]]:
    """Chains that hold a weighed token, as word spans and emissions."""
    found, spans, values, after = [], [], [], 0

    def close() -> None:
        if any(value is not None for value in values):
            found.append((list(spans), list(values)))
        spans.clear()
        values.clear()

    for match in WORD.finditer(text):
        if spans and (len(spans) == CHAIN_WORDS or SENTENCE_END.search(text, after, match.start())):
            close()
        after = match.end()
        spans.append(match.span())
        values.append(emission(match[0]))
    close()
    return found


def padded(rows: list[list[float]], fill: float) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(row) for row in rows])
    out = np.full((len(rows), lengths.max()), fill)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out, lengths


def _evidence(probabilities: list[float]) -> tuple[float, float, float]:
    return 1.0, float(np.log1p(sum(probabilities))), max(probabilities, default=0.0)


def _scored(model: Field, texts: list[str], known: dict) -> list[tuple[list, list[float]]]:
    """Per text the spans of its weighed chains' tokens and their marginals."""

    def emission(word: str) -> float | None:
        if word in known:
            return known[word]
        value = model.emission(word)
        if len(word) <= KEPT_LENGTH:
            if len(known) >= MEMORY:
                known.clear()
            known[word] = value
        return value

    owners, spans, rows = [], [], []
    for at, text in enumerate(texts):
        if any(emission(word) is not None for word in set(WORD.findall(text))):
            for own, values in chains_of(text, emission):
                owners.append(at)
                spans.append(own)
                rows.append([model.bias if value is None else value for value in values])
    found = [([], []) for _ in texts]
    if rows:
        marginals, _ = forward_backward(*padded(rows, 0.0), model.transitions, model.start)
        for at, own, row in zip(owners, spans, marginals):
            found[at][0].extend(own)
            found[at][1].extend(row[: len(own)].tolist())
    return found


def _train_field(model: Field, names: list[str], chains: list, labels: list) -> None:
    """Gradient ascent on the penalised likelihood of the token labels."""
    number = {name: i for i, name in enumerate(names)}
    width = max(map(len, chains))
    lengths = np.array([len(chain) for chain in chains])
    tags = np.zeros((len(chains), width))
    cells, columns = [], []
    for i, (chain, own) in enumerate(zip(chains, labels)):
        tags[i, : len(own)] = own
        for t, found in enumerate(chain):
            for name in found:
                cells.append(i * width + t)
                columns.append(number[name])
    cells, columns = np.array(cells), np.array(columns)
    inside = np.arange(width) < lengths[:, None]
    seen = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            seen[a, b] = ((tags[:, :-1] == a) & (tags[:, 1:] == b) & inside[:, 1:]).sum()
    first = np.array([(tags[:, 0] == 0).sum(), (tags[:, 0] == 1).sum()], float)
    values = np.zeros(len(names) + 1 + 4 + 2)
    values[len(names)] = -2.0
    moment, spread = np.zeros_like(values), np.zeros_like(values)
    k = len(names)
    for step in range(1, TRAINING_STEPS + 1):
        flat = np.full(len(chains) * width, values[k])
        np.add.at(flat, cells, values[columns])
        moves, start = values[k + 1 : k + 5].reshape(2, 2), values[k + 5 :]
        marginals, pairs = forward_backward(flat.reshape(tags.shape), lengths, moves, start)
        miss = np.where(inside, tags - marginals, 0.0)
        gradient = np.concatenate(
            [
                np.bincount(columns, miss.ravel()[cells], minlength=k),
                [miss.sum()],
                (seen - pairs).ravel(),
                first - np.array([(1 - marginals[:, 0]).sum(), marginals[:, 0].sum()]),
            ]
        ) - PENALTY * values
        moment = 0.9 * moment + 0.1 * gradient
        spread = 0.99 * spread + 0.01 * gradient**2
        values += (
            LEARNING_RATE
            * (moment / (1 - 0.9**step))
            / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
        )
    model.weights = dict(zip(names, values[:k].tolist()))
    model.bias = float(values[k])
    model.transitions, model.start = values[k + 1 : k + 5].reshape(2, 2), values[k + 5 :]


def _train_scoring(evidence: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps; classes weigh the same."""
    weight = np.where(toxic == 1, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (1 - toxic).sum()))
    weight = weight * len(toxic)
    beta = np.zeros(evidence.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(evidence @ beta, -30, 30)))
        gradient = evidence.T @ (weight * (toxic - p)) - 0.05 * beta
        curve = (evidence * (weight * p * (1 - p))[:, None]).T @ evidence
        beta = beta + np.linalg.solve(curve + 0.05 * np.eye(len(beta)), gradient)
    return beta


def train(rows: list[tuple[str, int]]) -> Field:
    """The model of labelled texts. Near copies of a text count once."""
    seen: set[int] = set()
    texts, toxic = [], []
    for text, label in rows:
        marks = sketch(text, 6).tolist()
        if sum(mark in seen for mark in marks) < max(1, len(marks) // 2):
            texts.append(text)
            toxic.append(label)
        seen.update(marks)
    counts = (Counter(), Counter())
    for label in (1, 0):  # what only clean documents have is never weighed, nor counted
        for text in (text for text, own in zip(texts, toxic) if own == label):
            found = {name for word in set(WORD.findall(text)) for name in features(word)}
            counts[label].update(found if label else found & counts[1].keys())
    n_clean, n_toxic = toxic.count(0), toxic.count(1)
    model = Field()
    lean = {}
    share = n_toxic / max(1, len(texts))
    needed = math.log(max(1, len(counts[1]))) + SURE
    for name, n in counts[1].items():
        other = counts[0][name]
        ratio = math.log((n + 0.5) / (n_toxic + 1)) - math.log((other + 0.5) / (n_clean + 1))
        if ratio < LEANING:
            continue
        evidence = n * math.log(n / (n + other) / share)
        if other:
            evidence += other * math.log(other / (n + other) / (1 - share))
        if evidence >= needed:
            lean[name] = ratio
    if not lean or not n_clean:
        return model
    chains, labels = [], []
    model.weights = lean
    for text, label in zip(texts, toxic):
        for spans, _ in chains_of(text, model.emission):
            found = [[name for name in features(text[a:b]) if name in lean] for a, b in spans]
            chains.append(found)
            labels.append(
                [int(label and any(lean[name] >= STRONG for name in names)) for names in found]
            )
    _train_field(model, sorted(lean), chains, labels)
    known: dict[str, float | None] = {}
    slices = (texts[at : at + SLICE_ROWS] for at in range(0, len(texts), SLICE_ROWS))
    evidence = np.array([_evidence(p) for some in slices for _, p in _scored(model, some, known)])
    model.scoring = _train_scoring(evidence, np.array(toxic, float))
    return model


def fit(documents: DataFrame, labels: DataFrame) -> Field:
    """Learn from labelled rows that are not held out.

    A bounded sample by hash order is used: at most TOXIC_SAMPLE and
    CLEAN_SAMPLE documents; a doc_id with both labels counts as toxic. Of rows
    that repeat a doc_id the text with the smallest hash is learnt from, so the
    driver gets one text per sampled id. Without labels of either kind nothing
    is toxic.
    """
    usable = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .where(~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("labelled_id"))
        .agg(F.max("toxic").alias("toxic"))
    )
    some = [
        usable.where(F.col("toxic") == label)
        .orderBy(F.xxhash64("labelled_id"), "labelled_id")
        .limit(n)
        for label, n in ((1, TOXIC_SAMPLE), (0, CLEAN_SAMPLE))
    ]
    chosen = F.broadcast(some[0].unionByName(some[1]))
    rows = documents.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("labelled_id"))
    text = F.coalesce("text", F.lit(""))
    first = F.min(F.struct(F.xxhash64(text).alias("hash"), text.alias("text")))["text"]
    found = rows.groupBy("doc_id", "toxic").agg(first.alias("text")).collect()
    return train([(r["text"], r["toxic"]) for r in sorted(found, key=lambda r: (r["doc_id"], r["text"]))])


def score_toxicity(documents: DataFrame, model: Field, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted and spans of every whole text.

    Only the text decides. A text is cut in chains, its sentences or 64 words
    of a longer one; chains without a weighed token carry no evidence. `spans`
    lists start:end in code points of tokens that are more likely toxic than
    not. Null and empty texts get the score of no evidence. One result row per
    input row, repeated rows and null ids (not held out) included; no other
    column is read.
    """
    rows = documents.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text")
    )

    def work(columns: dict[str, list]) -> dict[str, list]:
        hold()
        found = _scored(model, columns["text"], known)
        evidence = np.array([_evidence(p) for _, p in found])
        scores = 1 / (1 + np.exp(-np.clip(evidence @ model.scoring, -30, 30)))
        return {
            "doc_id": columns["doc_id"],
            "held_out": columns["held_out"],
            "score": scores.tolist(),
            "predicted": [int(score >= threshold) for score in scores],
            "spans": [
                ",".join(f"{a}:{b}" for (a, b), p in zip(spans, chances) if p >= 0.5)
                for spans, chances in found
            ],
        }

    known: dict[str, float | None] = {}
    schema = "doc_id long, held_out boolean, score double, predicted int, spans string"
    return map_slices(rows, work, schema)


def drop_toxic(documents: DataFrame, model: Field, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not predicted toxic, all columns as they came."""
    known: dict[str, float | None] = {}

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        for part in parts:
            share = SLICE_BYTES / max(1, part.nbytes)
            step = max(1, min(SLICE_ROWS, int(part.num_rows * share)))
            for start in range(0, part.num_rows, step):
                piece = part.slice(start, step)
                texts = [text or "" for text in piece.column(at).to_pylist()]
                evidence = np.array([_evidence(p) for _, p in _scored(model, texts, known)])
                scores = 1 / (1 + np.exp(-np.clip(evidence @ model.scoring, -30, 30)))
                yield piece.filter(pa.array(scores < threshold))

    at = documents.columns.index("text")
    importable(documents.sparkSession)
    return documents.mapInArrow(batches, documents.schema)
