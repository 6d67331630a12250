"""Quality classifier: naive Bayes support vectors.

Indicators of hashed unigrams and bigrams are scaled by the log ratio of their
smoothed counts in the two classes; a linear model with hinge loss is fitted to them
by dual coordinate descent, and pulled towards its mean weight.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surgeline.llm import kernels as K
from surgeline.llm.shared import doc_chunks, text_bytes, tune

#: Hashed indicators; labelled rows that are fitted to, each as a whole.
CELLS, SAMPLE = 1 << 18, 5000
SMOOTH, COST, PULL, EPOCHS = 1.0, 1.0, 0.25, 12


def indicators(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct cells of each document's n-grams of tokens: all unigrams and bigrams, and by their form alone those that say a token three times, next to each other or every second time."""
    tokens, first = K.token_hashes(data, offs)
    pairs = K.gram_hashes(tokens, 2)
    for apart in (1, 2):
        if len(tokens) > 2 * apart:
            thrice = (tokens[: -2 * apart] == tokens[apart:-apart]) & (tokens[: -2 * apart] == tokens[2 * apart :])
            pairs[: len(thrice)][thrice] = np.uint64(apart)
    one, two = (tokens & np.uint64(CELLS - 1)).astype(np.int32), (pairs & np.uint64(CELLS - 1)).astype(np.int32)
    return [np.unique(np.concatenate([one[a:b], two[a : max(a, b - 1)]])) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def count_ratios(cells: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log ratio of each indicator's smoothed share of its class's indicators, good (y over 0) to bad."""
    good, bad = np.full(CELLS, SMOOTH), np.full(CELLS, SMOOTH)
    for c, t in zip(cells, y):
        (good if t > 0 else bad)[c] += 1
    return np.log(good / good.sum()) - np.log(bad / bad.sum())


def descend(cells: list[np.ndarray], x: list[np.ndarray], y: np.ndarray, most: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float, np.ndarray]:
    """Dual coordinate descent for hinge loss: weights, bias and duals, of which most bounds each. x: values at cells."""
    w, bias, alpha = np.zeros(CELLS), 0.0, np.zeros(len(y))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(y)).tolist():
            c, v, t = cells[i], x[i], y[i]
            gradient = t * (w[c] @ v + bias) - 1
            now = min(max(alpha[i] - gradient / (v @ v + 1.0), 0.0), most[i])
            if now != alpha[i]:
                step = (now - alpha[i]) * t
                w[c] += step * v
                bias += step
                alpha[i] = now
    return w, bias, alpha


def fit(cells: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Weights of the CELLS indicators and, last, of the constant; slope and offset of the score's logistic curve."""
    y = np.where(labels > 0, 1.0, -1.0)
    ratio = count_ratios(cells, y)
    x = []
    for c in cells:
        v = ratio[c]
        x.append(v / max(np.sqrt(v @ v), 1e-12))
    share = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9))
    w, _, _ = descend(cells, x, y, COST * share)
    mean = np.abs(w).mean()
    w = (1 - PULL) * mean * np.sign(w) + PULL * w if mean > 0 else w
    w = w * ratio
    norm = [max(np.sqrt(ratio[c] @ ratio[c]), 1e-12) for c in cells]
    margin = np.array([w[c].sum() / n for c, n in zip(cells, norm)])
    # logistic curve through the margins, with softened targets
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(margin.std(), 1e-9)
    z = margin / scale
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((p - target) * z).sum() + 1e-3 * a, (p - target).sum()])
        s = p * (1 - p)
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step /= max(1.0, np.abs(step).max())
        a, b = a - step[0], b - step[1]
    return np.stack([w, ratio]), a / scale, b


def train(batches):
    """Arrow function of one task over (label, cells): the model's numbers as bytes."""
    import pyarrow as pa

    labels, cells = [], []
    for batch in batches:
        labels += batch.column(0).to_pylist()
        cells += [c.values.to_numpy() for c in batch.column(1)]
    if len(set(labels)) == 2:
        w, a, b = fit(cells, np.array(labels))
        out = np.concatenate([w.ravel(), [a, b]])
    else:  # nothing to tell apart
        out = np.concatenate([np.zeros(2 * CELLS), [0.0, 3.0 * (sum(labels) * 2 - len(labels)) / max(1, len(labels))]])
    yield pa.RecordBatch.from_arrays([pa.array([out.astype("<f8").tobytes()], pa.binary())], ["model"])


def cells_of(batches):
    import pyarrow as pa

    for batch in batches:
        data, offs = text_bytes(batch.column(1))
        out = []
        for i, j in doc_chunks(offs):
            out += indicators(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["label", "cells"])


def fit_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Fits to at most sample labelled ids, the first by a hash, and of an id's texts to one. docs (id, text), labels (id, label)."""
    chosen = labels.where("id is not null and label is not null").groupBy("id").agg(F.min("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(sample)
    rows = docs.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = rows.select("label", F.coalesce("text", F.lit("")).alias("text"))
    got = rows.mapInArrow(cells_of, "label int, cells array<int>").repartition(1).sortWithinPartitions(F.xxhash64("cells"), "label").mapInArrow(train, "model binary").collect()
    return np.frombuffer(got[0]["model"], "<f8") if got else np.zeros(2 * CELLS + 2)


def scorer(model: np.ndarray):
    w, ratio, (a, b) = model[:CELLS].astype(np.float32), model[CELLS : 2 * CELLS].astype(np.float32), model[2 * CELLS :].tolist()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offs = text_bytes(batch.column(1))
            out = []
            for i, j in doc_chunks(offs):
                for c in indicators(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]):
                    norm = float(np.sqrt((ratio[c].astype(np.float64) ** 2).sum()))
                    out.append(a * float(w[c].sum(dtype=np.float64)) / max(norm, 1e-12) + b)
            score = 1 / (1 + np.exp(-np.clip(np.array(out, np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores every document: (id, score) with score in 0 to 1, higher where label 1 is likelier.

    labels (id, label 0 or 1): what may be learned from; ids and labels that are
    null are left out, of several labels of an id the least counts, and ids without
    a document do nothing. Only texts go into a score. Null texts are empty; they
    get the score of no indicators. Without labels of both classes all scores are
    equal. Repeated rows have equal scores. An empty table gives no rows. Other
    columns are not read. Texts are taken whole, in the fit as in the scores, however
    long; a text has at most CELLS indicators.
    """
    tune(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = fit_model(docs, labels.select("id", F.col("label").cast("int").alias("label")), sample)
    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(scorer(model), f"id {kind}, score double").withColumnRenamed("id", id_col)
