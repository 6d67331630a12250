"""Language of code-switched text by a linear-chain conditional random field.

Every word has a label. A label's score for a word is a sum over affixes, byte
n-grams and the word itself (the lexicon), all hashed; scores between neighbouring
labels are learned with them, from sequences in which stretches of labelled
documents alternate. Forward-backward gives each word's label probabilities, and a
document's language is the one with the most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surgeline.llm import kernels as K
from surgeline.llm.shared import text_bytes, tune

U = np.uint64
#: Hashed features; labelled rows of a language, and of all languages, that are fitted to, each as a whole.
CELLS, SAMPLE, ROWS = 1 << 17, 200, 4000
#: Parts in which a language's documents are ranked first.
SALTS = 64
#: Words of a training sequence, and turns of fitting.
SEQUENCE, TURNS = 50, 40
#: Numbers in the largest array of a block of training sequences; training words whose features are kept between turns, rather than made anew in each.
BLOCK, KEPT = 1 << 22, 1 << 20
UNKNOWN = "und"
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_features(data: np.ndarray, offs: np.ndarray) -> tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray]:
    """For the words that have a letter: cells of the fixed features; cells of the n-grams and where each word's begin; first word of each document."""
    data = K.LOWER[data]
    starts, ends, first = K.word_spans(data, offs, LETTER)
    prefix = K.prefix_hash(data)
    mask = U(CELLS - 1)

    def cell(a, b, salt):
        return (K.mix(K.span_hash(prefix, a, b) + U(salt)) & mask).astype(np.int32)

    fixed = [cell(starts, ends, 1)]
    for k in (1, 2, 3):
        fixed.append(cell(starts, np.minimum(starts + k, ends), 10 + k))
        fixed.append(cell(np.maximum(ends - k, starts), ends, 20 + k))
    size = ends - starts
    owner_at = np.cumsum(size) - size
    at = np.repeat(starts - owner_at, size) + np.arange(size.sum()) if len(size) else np.zeros(0, np.int64)
    grams = cell(at, np.minimum(at + 3, np.repeat(ends, size)), 30)
    return fixed, (grams, owner_at), first


def emissions(features, weights: np.ndarray) -> np.ndarray:
    fixed, (grams, at), _ = features
    out = np.add.reduceat(weights[grams], at, axis=0) if len(at) else np.zeros((0, weights.shape[1]), weights.dtype)
    for f in fixed:
        out += weights[f]
    return out


def forward_backward(scores: np.ndarray, first: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of chains, the rows first[i] up to first[i + 1]: each word's forward and backward sums, scaled to 1, the exponential of its scores, and that of the scores between labels."""
    e = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), "left")
    step = np.exp(between - between.max()).astype(e.dtype) if between.size else between
    alpha = np.empty_like(e)
    for t in range(longest):
        rows = begin[: active[t]] + t
        a = e[rows] if t == 0 else (alpha[rows - 1] @ step) * e[rows]
        alpha[rows] = a / a.sum(axis=1, keepdims=True)
    beta = np.empty_like(e)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        rows = begin[:n] + t
        more = active[t + 1] if t + 1 < longest else 0
        b = np.ones((n, e.shape[1]), e.dtype)
        if more:
            nxt = rows[:more] + 1
            b[:more] = (beta[nxt] * e[nxt]) @ step.T
        beta[rows] = b / b.sum(axis=1, keepdims=True)
    return alpha, beta, e, step


def posteriors(scores: np.ndarray, first: np.ndarray, between: np.ndarray) -> np.ndarray:
    """Label probabilities of each word."""
    alpha, beta, _, _ = forward_backward(scores, first, between)
    out = alpha * beta
    return out / out.sum(axis=1, keepdims=True) if len(out) else out


def gradients(scores: np.ndarray, first: np.ndarray, between: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log-likelihood of the labels y: its gradient by the words' scores, and by those between labels."""
    alpha, beta, e, step = forward_backward(scores, first, between)
    by_word = alpha * beta
    by_word /= -by_word.sum(axis=1, keepdims=True)
    by_word[np.arange(len(y)), y] += 1
    inside = np.ones(len(y), bool)
    inside[first[:-1][np.diff(first) > 0]] = False
    right = np.flatnonzero(inside)
    # neighbours' joint distribution: what comes before the left word, the step, and the right word with all behind it
    joint = alpha[right - 1][:, :, None] * step[None] * (e[right] * beta[right])[:, None, :]
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    by_pair = -joint.sum(axis=0)
    np.add.at(by_pair, (y[right - 1], y[right]), 1)
    return by_word, by_pair


def fit(texts: list[bytes], labels: np.ndarray, n: int, block: int = BLOCK, kept: int = KEPT) -> tuple[np.ndarray, np.ndarray]:
    """Weights (CELLS, n) and scores between labels (n, n), by full-batch adaptive gradients of the sequences' log-likelihood.

    The batch's gradient is summed over blocks of sequences. Beside the texts and the
    places of their words, memory is that of a block, and of kept words' features.
    """
    rng = np.random.default_rng(11)
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts, ends, first = K.word_spans(data, np.r_[0, np.cumsum([len(t) for t in texts])], LETTER)
    many = len(starts)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    # stretches of 3 to 25 words of one document, in random order, make the sequences
    cut = np.zeros(many, bool)
    cut[first[:-1][np.diff(first) > 0]] = True
    at_word = 0
    while at_word < many:
        cut[at_word] = True
        at_word += int(rng.integers(3, 26))
    head = np.flatnonzero(cut)
    tail = np.r_[head[1:], many]
    words = np.concatenate([np.arange(head[k], tail[k]) for k in rng.permutation(len(head)).tolist()]) if many else np.zeros(0, np.int64)
    words = words[: len(words) // SEQUENCE * SEQUENCE] if len(words) >= SEQUENCE else words
    y = labels[owner[words]]
    length = SEQUENCE if len(words) >= SEQUENCE else max(1, len(words))

    def features(a: int, b: int):
        """Of words a to b, set side by side; and each n-gram's word."""
        w = words[a:b]
        size = ends[w] - starts[w]
        to = np.cumsum(size + 1) - size - 1
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        beside = np.full(int(size.sum()) + len(w), 32, np.uint8)
        beside[np.repeat(to, size) + inside] = data[np.repeat(starts[w], size) + inside]
        found = word_features(beside, np.array([0, len(beside)]))
        grams, at = found[1]
        return found, np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(grams)]))

    step = max(1, block // (length * n * max(n, 8))) * length if n else 1
    ranges = [(a, min(a + step, len(words))) for a in range(0, len(words), step)]
    held = [features(*r) for r in ranges] if len(words) <= kept else None
    weights, between = np.zeros((CELLS, n)), np.zeros((n, n))
    seen_w, seen_b = np.full((CELLS, n), 1e-3), np.full((n, n), 1e-3)
    for _ in range(TURNS if len(words) else 0):
        g, gb = -0.05 * weights, -0.05 * between
        for i, (a, b) in enumerate(ranges):
            found, of_gram = held[i] if held else features(a, b)
            error, by_pair = gradients(emissions(found, weights), np.arange(0, b - a + 1, length), between, y[a:b])
            gb += by_pair
            for k in range(n):
                g[:, k] += np.bincount(found[1][0], error[of_gram, k], CELLS)
                for f in found[0]:
                    g[:, k] += np.bincount(f, error[:, k], CELLS)
        seen_w += g * g
        seen_b += gb * gb
        weights += 0.3 * g / np.sqrt(seen_w)
        between += 0.1 * gb / np.sqrt(seen_b)
    return weights, between


def train(batches):
    """Arrow function of one task over (lang, text), sorted: the languages and the model's numbers as bytes."""
    import pyarrow as pa

    langs, texts = [], []
    for batch in batches:
        langs += batch.column(0).to_pylist()
        texts += [((text or "") + " ").encode() for text in batch.column(1).to_pylist()]
    names = sorted(set(langs))
    weights, between = fit(texts, np.array([names.index(x) for x in langs], np.int64), len(names))
    yield pa.RecordBatch.from_arrays([pa.array([names], pa.list_(pa.string())), pa.array([weights.astype("<f4").tobytes()], pa.binary()), pa.array([between.astype("<f8").tobytes()], pa.binary())], ["names", "weights", "between"])


def sample_of(labelled: DataFrame, sample: int, rows: int) -> DataFrame:
    """(lang, text) of at most sample ids of each language, the first by a hash, and fewer of each where there are so many languages that all would be over rows; of an id's texts in a language one. labelled (id, text, lang)."""
    key = F.xxhash64(F.col("id").cast("string"))

    def first(df: DataFrame, *keys: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(key, "id"))
        return df.withColumn("rank", rank).where(F.col("rank") <= sample)

    # a language may hold most rows: the first of each of SALTS parts, then the first of those
    ids = labelled.where("lang is not null and id is not null").groupBy("id", "lang").agg(F.lit(1).alias("one")).select("id", "lang", F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(1)), F.lit(SALTS)).alias("salt"))
    chosen = first(first(ids, "lang", "salt"), "lang")
    many = chosen.where("rank = 1").count()
    if many > rows:
        raise ValueError(f"{many} languages: more than the {rows} rows that a model is fitted to")
    chosen = F.broadcast(chosen.where(F.col("rank") <= max(1, min(sample, rows // max(1, many)))).select("id", "lang"))  # at most rows
    return labelled.join(chosen, ["id", "lang"]).groupBy("id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("lang", "text")


def fit_model(labelled: DataFrame, sample: int = SAMPLE, rows: int = ROWS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Fits to a sample of labelled rows (sample_of), whole texts of each."""
    chosen = sample_of(labelled, sample, rows)
    got = chosen.repartition(1).sortWithinPartitions("lang", F.xxhash64("text")).mapInArrow(train, "names array<string>, weights binary, between binary").collect()
    if not got or not got[0]["names"]:
        return [], np.zeros((CELLS, 0), np.float32), np.zeros((0, 0))
    names = list(got[0]["names"])
    return names, np.frombuffer(got[0]["weights"], "<f4").reshape(CELLS, -1), np.frombuffer(got[0]["between"], "<f8").reshape(len(names), -1)


def labeller(names: list[str], weights: np.ndarray, between: np.ndarray):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offs = text_bytes(batch.column(1))
            n, k = len(batch), len(names)
            share = np.zeros((n, k))
            if k:
                features = word_features(data, offs)
                first = features[2]
                p = posteriors(emissions(features, weights), first, between)
                total = np.r_[np.zeros((1, k)), np.cumsum(p, axis=0, dtype=np.float64)]
                share = (total[first[1:]] - total[first[:-1]]) / np.maximum(np.diff(first), 1)[:, None]
            letters = np.r_[0, np.cumsum(LETTER[data] & (data < 128))]
            sure = letters[offs[1:]] > letters[offs[:-1]]
            pred, score = [], []
            for i, s in enumerate(sure.tolist()):
                if k and (s or any(c.isalpha() for c in batch.column(1)[i].as_py() or "")):
                    best = int(share[i].argmax())
                    pred.append(names[best])
                    score.append(float(np.clip(share[i, best], 0.0, 1.0)))
                else:
                    pred.append(UNKNOWN)
                    score.append(0.0)
            shares = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(share.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), shares], ["id", "lang_pred", "score", "shares"])

    return run


def identify(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every document: (id, lang_pred, score, shares).

    labelled (id, text, lang): what may be learned from; rows with a null id or
    language are left out. shares: each learned language's share of the words, in
    the languages' sorted order; score is the largest, and of equal ones the first
    is taken. A null text, or one without a letter, is und with score 0; so is
    every text where nothing was learned. Repeated rows have equal results. An
    empty table gives no rows. Other columns are not read. Texts are taken whole, in
    the fit as in the scores, however long.
    """
    tune(docs.sparkSession)
    model = fit_model(labelled, sample)
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(labeller(*model), f"id {kind}, lang_pred string, score double, shares array<double>")
    return out.withColumnRenamed("id", id_col)
