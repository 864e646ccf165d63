"""Toxicity by a small convolutional text classifier, trained here in numpy.

Tokens are lower-cased runs of letters, digits and non-ASCII bytes.  A token's vector is
the sum of hashed embeddings of the whole token and, as far as it is longer, of its first
four to seven bytes (endings vary more than stems);
filters of width 1, 2 and 3 run over the vectors, each is max-pooled over the whole text,
and a logistic layer reads the pools.  Buckets seen in fewer than three training texts
stay zero, so unknown words are silent.  Thresholds are calibrated by language, where the
language is guessed from a text's own function words; a score is shifted so that its
language's threshold is 0.5.  Labels, lang, source and doc_id are never inputs of a score.

Training takes at most ``sample`` labelled texts of each class, chosen by a hash of
doc_id, none longer than ``longest`` characters and ``characters`` in all; of rows that
share an id one text (the least) is learned from.  One task trains on that sample, and the
driver gets the model alone.  Scoring sees every whole text; since
the filters are linear, it adds up rows of one precomputed table per bucket.

Nulls: a null or empty text gets the score of no evidence; null labels are not learned
from.  Repeated rows are scored alike, and a score of 0.5 is a 1; of thresholds that do
equally well the middle of the widest gap between texts is taken.  Without labels of both
classes all scores are 0.  Very long texts are scored whole.  Extra columns stay if asked
for, but those named like the results, which replace them; an empty table gives none.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import eight_bytes, hash_ranges, mix, read_table, released, text_buffer, text_slices

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 12, 8, (1, 2, 3)
#: Bytes of the word beginnings that are features of longer words.
BEGINNINGS = (4, 5, 6, 7)
FEATURES = 1 + len(BEGINNINGS)
#: Bounds of the training sample: texts of each class, characters of a text and of all.
SAMPLE, LONGEST, CHARACTERS = 3000, 200_000, 150_000_000
#: How many clean texts there are to a toxic one: what a false alarm costs, against a miss.
COMMON_CLEAN = 4
#: Bytes of text scored at a time: their filter outputs take some two hundred times as many.
SLICE_BYTES = 250_000
SLOTS = [(w, j) for w in WIDTHS for j in range(w)]

# Function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on are with as at be this from or by an not",
    "de": "der die das und ist von den mit zu im für auf nicht ein eine sich des dem auch als",
    "fr": "le la les des et est une dans que qui pour au aux du pas sur par il elle un",
    "es": "el los las que y en una por con para es del se su al lo como más pero no",
}

_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Tokens:
    buckets: np.ndarray  # (tokens, FEATURES); 0 for none
    words: np.ndarray  # hash of each whole token
    first: np.ndarray  # where each text's tokens begin; one more at the end


def tokenise(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    data = _LOWER[data]
    inside = _CLASS[data].astype(bool)
    change = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    start, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    cut = np.unique(offsets[1:-1])
    cut = cut[(np.searchsorted(start, cut, side="left") > 0)]
    run = np.searchsorted(start, cut, side="left") - 1
    over = (cut > start[run]) & (cut < end[run]) if len(cut) else np.zeros(0, bool)
    if over.any():  # a token never spans two texts
        start, end = np.sort(np.concatenate([start, cut[over]])), np.sort(np.concatenate([end, cut[over]]))
    words = hash_ranges(data, start, end)
    view, length = eight_bytes(data), end - start
    buckets = np.empty((len(start), FEATURES), np.uint16)  # as many as BUCKETS
    buckets[:, 0] = np.maximum(words >> np.uint64(48), np.uint64(1))
    for column, n in enumerate(BEGINNINGS, 1):
        head = view[start] & np.uint64((1 << 8 * n) - 1)
        buckets[:, column] = np.where(length > n, np.maximum(mix(head + np.uint64(n)) >> np.uint64(48), np.uint64(1)), 0)
    return Tokens(buckets, words, np.searchsorted(start, offsets))


def _language_table() -> tuple[np.ndarray, np.ndarray]:
    names = [(w.encode(), i) for i, lang in enumerate(FUNCTION_WORDS) for w in FUNCTION_WORDS[lang].split()]
    data = np.frombuffer(b"".join(w for w, _ in names), np.uint8)
    end = np.cumsum([len(w) for w, _ in names])
    hashes = hash_ranges(data, end - [len(w) for w, _ in names], end)
    order = np.argsort(hashes)
    return hashes[order], np.array([i for _, i in names])[order]


def languages(tokens: Tokens) -> np.ndarray:
    """Each text's language by most function words; the number of languages where it has none."""
    known, of = _language_table()
    at = np.minimum(np.searchsorted(known, tokens.words), len(known) - 1)
    hit = np.flatnonzero(known[at] == tokens.words)
    text = np.searchsorted(tokens.first, hit, side="right") - 1
    n = len(FUNCTION_WORDS)
    counts = np.bincount(text * n + of[at[hit]], minlength=(len(tokens.first) - 1) * n).reshape(-1, n)
    return np.where(counts.max(axis=1, initial=0) > 0, counts.argmax(axis=1), n) if len(counts) else np.zeros(0, np.int64)


def _joined(parts: Iterable[Tokens]) -> tuple[Tokens, np.ndarray]:
    """Tokens of all parts without their words, which only each text's language is taken from."""
    buckets, counts, langs = [np.zeros((0, FEATURES), np.uint16)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for part in parts:
        buckets.append(part.buckets)
        counts.append(np.diff(part.first))
        langs.append(languages(part))
    return Tokens(np.concatenate(buckets), np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(np.concatenate(counts))])), np.concatenate(langs)


@dataclass
class Model:
    embedding: np.ndarray
    kernel: np.ndarray  # (slots, DIM, FILTERS)
    bias: np.ndarray  # (widths, FILTERS)
    out: np.ndarray  # (widths, FILTERS)
    out_bias: float
    shift: np.ndarray = field(default_factory=lambda: np.zeros(len(FUNCTION_WORDS) + 1))
    trained: bool = True

    def responses(self) -> np.ndarray:
        """What a bucket adds to each filter at each place of it: (BUCKETS, slots * FILTERS)."""
        return np.einsum("bd,sdf->bsf", self.embedding, self.kernel).reshape(len(self.embedding), -1).astype(np.float32)


def pooled(response: np.ndarray, first: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Max-pooled filter outputs (texts, widths, FILTERS); windows past the end of a text are padded with nothing."""
    n, texts = len(response), len(first) - 1
    r = response.reshape(n, len(SLOTS), FILTERS)
    out = np.zeros((texts, len(WIDTHS), FILTERS), np.float32)
    filled = np.flatnonzero(np.diff(first) > 0)
    if not len(filled):
        return np.maximum(out + bias, 0)
    last = np.zeros(n, bool)
    last[first[1:][filled] - 1] = True
    for k, w in enumerate(WIDTHS):
        z = r[:, SLOTS.index((w, 0))].copy()
        blocked = np.zeros(n, bool)
        for j in range(1, w):
            # the token j places on, if it is in the same text
            blocked[: n - j + 1] |= last[j - 1 :]
            ok = np.flatnonzero(~blocked[: n - j])
            z[ok] += r[ok + j, SLOTS.index((w, j))]
        out[filled, k] = np.maximum.reduceat(z, first[:-1][filled], axis=0)
    return np.maximum(out + bias, 0)


def _forward(model: Model, tokens: Tokens, table: np.ndarray) -> np.ndarray:
    response = table[tokens.buckets[:, 0]]
    for column in range(1, FEATURES):
        response += table[tokens.buckets[:, column]]
    return (pooled(response, tokens.first, model.bias) * model.out).sum(axis=(1, 2)) + model.out_bias


def train(texts: pa.ChunkedArray, labels: np.ndarray) -> Model:
    return learned((tokenise(*text_buffer(part["text"])) for part in text_slices(pa.table({"text": texts}))), labels)


def learned(parts: Iterable[Tokens], labels: np.ndarray | list[int], epochs: int = 6, batch: int = 64, rate: float = 0.02, seed: int = 1) -> Model:
    """Fit on whole texts by minibatch Adam; a fifth of them calibrates the thresholds.

    Labels may be a list that grows while the parts are read.
    """
    tokens, lang = _joined(parts)
    labels = np.asarray(labels, np.int64)
    rng = np.random.default_rng(seed)
    shape = (len(SLOTS), DIM, FILTERS)
    model = Model(np.zeros((BUCKETS, DIM)), rng.normal(0, 0.3, shape), np.zeros((len(WIDTHS), FILTERS)), rng.normal(0, 0.3, (len(WIDTHS), FILTERS)), 0.0)
    if not len(labels) or labels.min() == labels.max():
        model.out_bias, model.trained = -20.0, False
        return model
    counts = np.diff(tokens.first)
    held = rng.random(len(labels)) < 0.2
    learn = np.flatnonzero(~held)
    share = np.zeros((2, BUCKETS), np.int64)
    for i in learn:  # a text at a time, so that nothing is as long as all texts
        part = tokens.buckets[tokens.first[i] : tokens.first[i + 1]]
        for column in range(FEATURES):
            share[labels[i], np.unique(part[:, column])] += 1
    n = [max(1, int((labels[learn] == y).sum())) for y in (0, 1)]
    frequent = share[0] + share[1] >= 3
    frequent[0] = False
    odds = np.log((share[1] + 0.5) / (n[1] + 1)) - np.log((share[0] + 0.5) / (n[0] + 1))
    model.embedding[frequent] = rng.normal(0, 0.05, (int(frequent.sum()), DIM))
    model.embedding[frequent, 0] = np.clip(odds[frequent], -3, 6) / 3  # a warm start on one coordinate
    for w in WIDTHS:
        model.kernel[SLOTS.index((w, 0)), 0, : FILTERS // 2] += 0.5
    weight = np.where(labels == 1, len(labels) / (2 * labels.sum()), len(labels) / (2 * (1 - labels).sum()))
    params = {"kernel": model.kernel, "bias": model.bias, "out": model.out}
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in params.items()}
    squares, step = np.full(BUCKETS, 1e-3), 0
    for _ in range(epochs):
        rng.shuffle(learn)
        for at in range(0, len(learn), batch):
            ids = learn[at : at + batch]
            step += 1
            rows = np.concatenate([np.arange(tokens.first[i], tokens.first[i + 1]) for i in ids]) if len(ids) else np.zeros(0, np.int64)
            size = counts[ids]
            first = np.concatenate([[0], np.cumsum(size)])
            buckets = tokens.buckets[rows]
            vector = model.embedding[buckets[:, 0]]
            for column in range(1, FEATURES):
                vector += model.embedding[buckets[:, column]]
            response = np.einsum("td,sdf->tsf", vector, model.kernel, optimize=True)
            grads = {k: np.zeros_like(v) for k, v in params.items()}
            feature = np.zeros((len(ids), len(WIDTHS), FILTERS))
            where = np.zeros((len(ids), len(WIDTHS), FILTERS), np.int64)
            for b in range(len(ids)):
                a, e = first[b], first[b + 1]
                for k, w in enumerate(WIDTHS):
                    if a == e:
                        continue
                    z = response[a:e, SLOTS.index((w, 0))].copy()
                    for j in range(1, min(w, e - a)):
                        z[: e - a - j] += response[a + j : e, SLOTS.index((w, j))]
                    best = z.argmax(axis=0)
                    where[b, k] = a + best
                    feature[b, k] = z[best, np.arange(FILTERS)]
            active = feature + model.bias > 0
            feature = np.where(active, feature + model.bias, 0)
            logit = (feature * model.out).sum(axis=(1, 2)) + model.out_bias
            delta = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[ids]) * weight[ids] / len(ids)
            grads["out"] += np.einsum("b,bkf->kf", delta, feature)
            g = delta[:, None, None] * model.out * active * (size > 0)[:, None, None]
            grads["bias"] += g.sum(axis=0)
            touched, change = [], []
            for k, w in enumerate(WIDTHS):
                for j in range(w):
                    t = where[:, k] + j
                    inside = t < first[1:][:, None]
                    t = np.minimum(t, max(len(rows) - 1, 0))
                    gj = g[:, k] * inside
                    if not len(rows):
                        continue
                    s = SLOTS.index((w, j))
                    grads["kernel"][s] += np.einsum("bf,bfd->df", gj, vector[t])
                    touched.append(buckets[t].reshape(-1, FEATURES))
                    change.append((gj[:, :, None] * model.kernel[s].T[None]).reshape(-1, DIM))
            for k, v in params.items():
                m, q = moment[k]
                m *= 0.9
                m += 0.1 * grads[k]
                q *= 0.999
                q += 0.001 * grads[k] ** 2
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)
            model.out_bias -= rate * float(delta.sum()) * 5
            if touched:
                b3, c = np.concatenate(touched), np.concatenate(change)
                for column in range(FEATURES):
                    b = b3[:, column]
                    keep = frequent[b]
                    np.add.at(squares, b[keep], (c[keep] ** 2).mean(axis=1))
                    np.add.at(model.embedding, b[keep], -0.05 * c[keep] / np.sqrt(squares[b[keep]])[:, None])
    _calibrate(model, tokens, lang, labels, held if 0 < labels[held].sum() < held.sum() else np.ones(len(labels), bool))
    return model


def _calibrate(model: Model, tokens: Tokens, lang: np.ndarray, labels: np.ndarray, held: np.ndarray) -> None:
    """Choose each language's threshold for the fewest errors at common rates; few texts take the common one."""
    table = model.responses()
    logits = np.concatenate([_forward(model, part, table) for part in _parts(tokens, 100)])

    def best(rows: np.ndarray) -> float:
        x, y = logits[rows], labels[rows]
        order = np.argsort(x)
        x, y = x[order], y[order]
        missed = np.concatenate([[0], np.cumsum(y)]) / y.sum()
        false = 1 - np.concatenate([[0], np.cumsum(1 - y)]) / (1 - y).sum()
        cost = missed + COMMON_CLEAN * false
        ends = np.concatenate([[x[0] - 1], x, [x[-1] + 1]])
        at = np.flatnonzero(cost <= cost.min() + 1e-12)
        return float((ends[at] + ends[at + 1]).mean() / 2)  # the middle of the best gap

    common = best(np.flatnonzero(held))
    for i in range(len(model.shift)):
        rows = np.flatnonzero(held & (lang == i))
        enough = len(rows) >= 40 and 5 <= labels[rows].sum() <= len(rows) - 5
        model.shift[i] = best(rows) if enough else common


def _parts(tokens: Tokens, size: int = 500) -> Iterator[Tokens]:
    for at in range(0, len(tokens.first) - 1, size):
        first = tokens.first[at : at + size + 1]
        yield Tokens(tokens.buckets[first[0] : first[-1]], tokens.words[first[0] : first[-1]], first - first[0])


def score(model: Model, tokens: Tokens, table: np.ndarray) -> np.ndarray:
    if not len(tokens.first) - 1:
        return np.zeros(0)
    if not model.trained:
        return np.zeros(len(tokens.first) - 1)
    logits = _forward(model, tokens, table) - model.shift[languages(tokens)]
    return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST, characters: int = CHARACTERS) -> Model:
    """Train on a bounded sample of the labelled documents that are not held out."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.lit(7), F.col("doc_id"))
    chosen = [usable.filter(F.col("toxic") == y).orderBy(order, "doc_id").limit(sample) for y in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most two samples of ids
    # one text of each id, however many rows share it, and no more characters than a driver can take
    one = docs.filter(F.length("text") <= longest).join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    upto = F.sum(F.length("text").cast("long")).over(Window.orderBy(order, "doc_id"))  # of at most two samples
    rows = one.withColumn("_upto", upto).filter(F.col("_upto") <= characters).sortWithinPartitions("doc_id").select("text", "toxic")
    models = rows.mapInArrow(_fitted, "model binary").collect()  # the window has brought the sample to one task
    return Model(**pickle.loads(models[0]["model"])) if models else learned([], [])


@released
def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model that is learned from all rows of a task."""
    labels: list[int] = []

    def parts() -> Iterator[Tokens]:  # a text goes once its tokens are known
        for batch in batches:
            labels.extend(batch.column("toxic").to_pylist())
            for part in text_slices(batch.select(["text"])):
                yield tokenise(*text_buffer(part["text"]))

    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(learned(parts(), labels)))], pa.binary())], names=["model"])


def score_documents(docs: DataFrame, model: Model, columns: list[str] | None = None, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The given columns of docs (doc_id by default), score and predicted (or what names calls them)."""
    columns = [c for c in columns or ["doc_id"] if c not in names]  # what is scored here replaces columns of that name
    text = "text" if "text" in columns else "_text" + "_" * max(len(c) for c in columns)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain arrays of fixed size

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Model(**shared.value)
        table = fitted.responses()
        for batch in batches:
            for part in text_slices(batch, text, SLICE_BYTES):
                s = score(fitted, tokenise(*text_buffer(part[text])), table)
                kept = [part[c].combine_chunks() for c in columns]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(s, pa.float64()), pa.array((s >= 0.5).astype("int32"))], names=[*columns, *names])

    rows = docs.select(*[docs[c] for c in columns], *([] if text == "text" else [docs["text"].alias(text)]))
    schema = rows.select(*columns).schema.add(names[0], "double").add(names[1], "integer")
    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    scored = score_documents(docs.select(F.col("doc_id").cast("long"), "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
