"""Toxic spans and document scores from a linear-chain conditional random field."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heapreplace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swayscan.llm.tables import written

ROWS = 1000  # training documents of each label, at most
ALIKE = 0.8  # share of common runs of words from which a training text is a near copy
PREFIXES = range(2, 9)
STEPS = 40  # of the fit
SEQUENCE = 256  # tokens of a training sequence; longer texts give several
TOKENS = 1 << 21  # tokens scored at once
KEPT = 200_000  # words that a worker remembers
THRESHOLD = 0.3
_WORD = re.compile(r"\w+")


def features(word: str) -> list[str]:
    """A word by itself and by its beginnings, in lower case."""
    word = word.lower()
    return ["=" + word, *(word[:n] for n in PREFIXES if n < len(word))]


@dataclass
class Model:
    """Weights of one chain with two states, clean and toxic, and of the document score."""

    weights: dict[str, float]  # of features, for toxic over clean
    bias: float
    change: np.ndarray  # 2 x 2, from state to state
    score: np.ndarray  # of the intercept and of what ``summary`` returns
    memory: dict[str, float] = field(default_factory=dict)

    def emission(self, word: str) -> float:
        known = self.memory.get(word)
        if known is None:
            weights = self.weights
            known = self.bias + sum([weights[f] for f in features(word) if f in weights])
            if len(self.memory) >= KEPT:
                self.memory.clear()
            self.memory[word] = known
        return known


def _sides(change: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Log odds of the next state if this state's log odds are x."""
    return np.logaddexp(change[0, 1], change[1, 1] + x) - np.logaddexp(change[0, 0], change[1, 0] + x)


def messages(emissions: np.ndarray, lengths: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log odds of every token; texts lie end to end, in order of falling length.

    All texts advance together, one token a step.
    """
    starts = np.cumsum(lengths) - lengths
    forward, backward = emissions.copy(), np.zeros_like(emissions)
    longest = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(longest), side="left")  # texts with more than t tokens
    for t in range(1, longest):
        at = starts[: alive[t]] + t
        forward[at] += _sides(change, forward[at - 1])
    back = change.T
    for t in range(longest - 2, -1, -1):
        at = starts[: alive[t + 1]] + t
        backward[at] = _sides(back, emissions[at + 1] + backward[at + 1])
    return forward, backward


def marginals(emissions: np.ndarray, lengths: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Probability that each token is toxic."""
    forward, backward = messages(emissions, lengths, change)
    return 1 / (1 + np.exp(-np.clip(forward + backward, -60, 60)))


def summary(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per text: log odds that any token is toxic, expected toxic tokens (logged), and their share."""
    out = np.zeros((len(lengths), 3))
    some = np.flatnonzero(lengths)
    starts = (np.cumsum(lengths) - lengths)[some]
    if len(some):
        none = np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-9)), starts)
        total = np.add.reduceat(p, starts)
        out[some, 0] = np.clip(np.log(np.maximum(-np.expm1(none), 1e-9)) - none, -12, 12)
        out[some, 1] = np.log1p(total)
        out[some, 2] = total / lengths[some]
    out[lengths == 0, 0] = -12
    return out


def _distinct(texts: list[str]) -> list[str]:
    """Texts without near copies of earlier ones, so that a large group of copies counts once.

    A near copy shares ALIKE of the two texts' runs of four words. Texts with a least hash in common are compared by
    all their runs; texts that merely share a passage are all kept.
    """
    kept: list[tuple[str, set[str]]] = []
    met: dict[tuple[int, int], list[int]] = {}
    for text in texts:
        words = _WORD.findall(text.lower())
        parts = {" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))}
        least = [(seed, min(xxhash.xxh64_intdigest(p, seed) for p in parts)) for seed in range(4)]
        near = {i for key in least for i in met.get(key, ())}
        if any(len(parts & kept[i][1]) >= ALIKE * len(parts | kept[i][1]) for i in near):
            continue
        for key in least:
            met.setdefault(key, []).append(len(kept))
        kept.append((text, parts))
    return [text for text, _ in kept]


def telling_features(toxic: list[set[str]], clean: list[set[str]]) -> set[str]:
    """Features that explain why documents are labelled toxic: those that mark their toxic tokens.

    Greedy: each time the feature that is in most documents not yet explained, less what its share of clean documents
    would give; explained documents keep half of their weight. At equal gain the longer feature is taken.
    """
    n1, n0 = max(len(toxic), 1), max(len(clean), 1)
    held, found = (Counter(f for doc in docs for f in doc) for docs in (toxic, clean))
    least = max(2.5, 0.006 * n1)
    docs: dict[str, list[int]] = {f: [] for f, n in held.items() if n >= least and n / n1 >= 8 * (found[f] + 0.5) / n0}
    for i, doc in enumerate(toxic):
        for f in doc & docs.keys():
            docs[f].append(i)
    weight, chosen = np.ones(len(toxic)), set()
    gain = lambda f: weight[docs[f]].sum() - 3 * found[f] * n1 / n0
    heap = [(-gain(f), -len(f), f) for f in docs]
    heapify(heap)
    while heap:  # gains only fall, so a feature that still leads is the best
        now = gain(heap[0][2])
        if now < least:
            heappop(heap)
        elif now < -heap[0][0] - 1e-9:
            heapreplace(heap, (-now, *heap[0][1:]))
        else:
            best = heappop(heap)[2]
            chosen.add(best)
            weight[docs[best]] *= 0.5
    return chosen


def fit(toxic: list[str], clean: list[str], n_toxic: int, n_clean: int) -> Model:
    """Fit on labelled texts; n_toxic and n_clean are the labels of all training rows, for the document score.

    The labels are of documents. A token counts as toxic if its document does and it has a telling feature, so each
    training text becomes a labelled token sequence. The chain's weights maximise the sequences' likelihood less a
    small penalty (full-batch Adam steps over pieces of the texts); the document score is a logistic regression on ``summary``.
    """
    texts = [(t, 1) for t in _distinct(toxic)] + [(t, 0) for t in _distinct(clean)]
    words = [_WORD.findall(t) for t, _ in texts]
    bags = [{f for w in set(map(str.lower, ws)) for f in features(w)} for ws in words]
    marks = telling_features([b for b, (_, y) in zip(bags, texts) if y], [b for b, (_, y) in zip(bags, texts) if not y])
    names = sorted(marks)
    number = {f: i for i, f in enumerate(names)}
    memory: dict[str, list[int]] = {}
    rows, cols, toxic_token = [], [], np.zeros(sum(map(len, words)), bool)
    order = sorted(range(len(texts)), key=lambda i: -len(words[i]))
    label, whole = np.array([texts[i][1] for i in order]), np.array([len(words[i]) for i in order], np.int64)
    pieces = sorted(
        ((i, at, min(SEQUENCE, len(words[i]) - at)) for i in order for at in range(0, len(words[i]), SEQUENCE)),
        key=lambda piece: -piece[2],
    )
    lengths = np.array([n for _, _, n in pieces], np.int64)
    at = 0
    for i, start, n in pieces:
        for w in words[i][start : start + n]:
            if w not in memory:
                memory[w] = [number[f] for f in features(w) if f in number]
            if memory[w]:
                rows += [at] * len(memory[w])
                cols += memory[w]
                toxic_token[at] = bool(texts[i][1])
            at += 1
    rows, cols = np.array(rows, np.int64), np.array(cols, np.int64)
    theta = np.zeros(len(names) + 5)
    theta[len(names)] = -3.0
    moment, spread = np.zeros_like(theta), np.zeros_like(theta)
    total = max(1, int(toxic_token.sum()))
    first = np.zeros(len(toxic_token), bool)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    later = np.flatnonzero(~first)
    pairs = np.bincount(2 * toxic_token[later - 1] + toxic_token[later], minlength=4)
    for step in range(1, STEPS + 1 if len(toxic_token) else 1):
        emissions = theta[len(names)] + np.bincount(rows, theta[cols], minlength=len(toxic_token))
        change = theta[len(names) + 1 :].reshape(2, 2)
        forward, backward = messages(emissions, lengths, change)
        p = 1 / (1 + np.exp(-np.clip(forward + backward, -60, 60)))
        # expected moves between states, from the messages on both sides of each pair of tokens
        left, right = forward[later - 1], emissions[later] + backward[later]
        joint = np.stack([change[a, b] + a * left + b * right for a in (0, 1) for b in (0, 1)])
        joint = np.exp(joint - joint.max(axis=0))
        expected = (joint / joint.sum(axis=0)).sum(axis=1)
        miss = toxic_token - p
        slope = np.r_[np.bincount(cols, miss[rows], minlength=len(names)), miss.sum(), pairs - expected] / total
        slope -= 0.002 * np.r_[theta[: len(names)], 0, theta[len(names) + 1 :]]
        moment, spread = 0.9 * moment + 0.1 * slope, 0.99 * spread + 0.01 * slope**2
        theta += 0.25 * (moment / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
    model = Model({f: float(w) for f, w in zip(names, theta)}, float(theta[len(names)]), theta[len(names) + 1 :].reshape(2, 2), np.zeros(4))
    emissions = np.array([model.emission(w) for i in order for w in words[i]], float)
    x = np.c_[np.ones(len(whole)), summary(marginals(emissions, whole, model.change), whole)]
    share = np.where(label == 1, n_toxic / max(1, label.sum()), n_clean / max(1, (1 - label).sum()))
    share = share / share.sum() * len(share) if len(share) else share
    beta = np.zeros(4)
    for _ in range(50 if len(share) else 0):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (share * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 0.1, 0.1, 0.1])
        beta += np.linalg.solve(hessian, x.T @ (share * (label - p)) - np.array([1e-3, 0.1, 0.1, 0.1]) * beta)
    model.score = beta if len(share) else np.array([-12.0, 0, 0, 0])
    return model


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    rows: int = ROWS,
) -> Model:
    """Fit on at most ``rows`` whole texts of each label (0 or 1), those of the least hashed id; all labels are counted.

    ``labels`` has an id and a label; labels of ids without a text, and null ids or labels, are left out. Only ids are
    joined with the labels; texts are read for the chosen ids, and the driver gets that sample, whose size ``rows``
    bounds.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    named = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter("label in (0, 1)")
    narrow = written(source.select("id").join(named, "id"))
    counts = {r["label"]: r["count"] for r in narrow.groupBy("label").count().collect()}
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    chosen = narrow.distinct().withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= rows)
    sample = source.join(F.broadcast(written(chosen.select("id", "label"))), "id").select("label", "id", "text")
    texts: dict[int, list[str]] = {0: [], 1: []}
    for row in sorted(sample.toLocalIterator(), key=lambda r: (r["id"], r["text"])):
        texts[row["label"]].append(row["text"])
    return fit(texts[1], texts[0], counts.get(1, 0), counts.get(0, 0))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score, predicted, spans)`` per row of ``docs``, from the whole text.

    score (0 to 1) is the probability of a toxic document; predicted is 1 from ``THRESHOLD`` on; spans is an array
    of ``start, end`` in code points of words that are toxic with a probability of a half or more. A null text
    counts as empty; it has no spans and the score of a text without words. Repeated rows repeat.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def solve(model: Model, ids: pa.Array, texts: list[str], held: list[np.ndarray]) -> pa.RecordBatch:
        lengths = np.array([len(h) for h in held], np.int64)
        order = np.argsort(-lengths, kind="stable")
        p = marginals(np.concatenate([np.empty(0), *[held[i] for i in order]]), lengths[order], model.change)
        x = np.empty((len(held), 3))
        x[order] = summary(p, lengths[order])
        result = 1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(x)), x] @ model.score, -30, 30)))
        ends = np.cumsum(lengths[order])
        spans: list[list[dict[str, int]]] = [[] for _ in held]
        for n in np.unique(np.searchsorted(ends, np.flatnonzero(p >= 0.5), side="right")):
            doc = int(order[n])
            bad = p[ends[n] - lengths[doc] : ends[n]] >= 0.5
            spans[doc] = [{"start": m.start(), "end": m.end()} for m, b in zip(_WORD.finditer(texts[doc]), bad) if b]
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(result), pa.array((result >= THRESHOLD).astype(np.int32)), pa.array(spans, spans_type)],
            names=["id", "score", "predicted", "spans"],
        )

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in it:
            texts, held, first, count = [], [], 0, 0
            for n, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                words = _WORD.findall(text)
                texts.append(text)
                held.append(np.fromiter(map(model.emission, words), np.float64, len(words)))
                count += len(words)
                if count >= TOKENS or n + 1 == batch.num_rows:
                    yield solve(model, batch.column(0).slice(first, len(held)), texts, held)
                    texts, held, first, count = [], [], n + 1, 0

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(batches, f"id {kind}, score double, predicted int, spans array<struct<start: long, end: long>>")
