"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

A word's input is its own vector (zero for words outside the vocabulary) and the mean vector of its character
4-grams, so inflected and unseen words are known by their parts. Overlapping windows of `window` words, `stride`
apart, cover the whole text. In a window two gated recurrent layers read the words forth and back, attention
weighs their states, and one logit comes out; the text's score is the logistic of its highest window's logit.
A word of more than 64 characters (a run of an unsegmented script, or words run together) is read whole, as pieces
of 64 that overlap by half; each counts as a word.

Training, in numpy on the driver: labels are of whole texts, so each step takes the highest window of each text
and descends on that. The sample is bounded by parameters: about `per_class` texts of either label, picked by
hash, of `train_chars` characters at most. Scoring reads every whole text.

Defined results: a null, empty or wordless text is one window without words; repeated rows score alike; several
labels of one doc_id count as toxic if one is; null labels and null doc_ids teach nothing; without both labels in
the sample every score is the share of toxic ones in it (0 if it is empty); an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_share, stage

_WORD = re.compile(r"[^\W_]+")
_GRAMS = 1 << 15
_LONG = 64  # characters; longer words are read in pieces of so many
_MOST_TYPES = 200_000  # words whose inputs a worker keeps at hand
_PART = 2048  # windows at once


@dataclass
class Model:
    words: dict[str, int]
    weights: dict[str, np.ndarray]
    window: int
    stride: int
    constant: float | None = None  # the score of every text, where nothing could be learned


def words_of(text: str | None, size: int = 1 << 20) -> Iterator[list[str]]:
    """Lower-case words, long ones in their pieces, in lists of those of about `size` characters."""
    text, start, most = text or "", 0, max(2 * size, 2 * _LONG)
    while start < len(text):
        end = start + size
        while end < len(text) and end - start < most and text[end].isalnum():
            end += 1
        yield [x for w in _WORD.findall(text[start:end].lower()) for x in (_pieces(w) if len(w) > _LONG else (w,))]
        # A run cut here goes on with the characters that a piece shares with the one before.
        inside = end - start >= most and end < len(text) and text[end].isalnum()
        start = end - _LONG // 2 if inside else end


def _pieces(word: str) -> list[str]:
    """A long run as pieces of _LONG characters, each of which begins in the middle of the one before."""
    return [word[k : k + _LONG] for k in range(0, len(word) - _LONG // 2, _LONG // 2)]


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character 4-grams of all words with a mark at either end, and where each word's begin."""
    marked = ["<" + w + ">>" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    h = codes[:-3] * np.uint64(0x9E3779B1) + codes[1:-2] * np.uint64(0x85EBCA77) + codes[2:-1] * np.uint64(0xC2B2AE3D) + codes[3:] * np.uint64(0x27D4EB2F)
    h = ((h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(49)).astype(np.int64)
    counts = sizes - 3
    starts = np.cumsum(sizes) - sizes
    first = np.cumsum(counts) - counts
    at = np.repeat(starts - first, counts) + np.arange(counts.sum())
    return h[at], first


def _inputs(w: dict[str, np.ndarray], ids: np.ndarray, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    counts = np.diff(np.append(first, len(grams)))
    mean = np.add.reduceat(w["gram"][grams], first, axis=0) / counts[:, None].astype(np.float32)
    return np.concatenate([w["word"][ids], mean], axis=1)


def _gate(x: np.ndarray) -> np.ndarray:
    return np.clip(0.25 * x + 0.5, 0, 1)


def _soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _layer(x: np.ndarray, mask: np.ndarray, u: np.ndarray, back: bool, keep: list | None = None) -> np.ndarray:
    """States [time, windows, units] of one gated layer over projected inputs [time, windows, 3 units]."""
    time, n, width = x.shape
    units = width // 3
    h, out = np.zeros((n, units), np.float32), np.empty((time, n, units), np.float32)
    for t in range(time - 1, -1, -1) if back else range(time):
        both = _gate(x[t, :, : 2 * units] + h @ u[:, : 2 * units])
        z, r = both[:, :units], both[:, units:]
        rh = r * h
        new = _soft(x[t, :, 2 * units :] + rh @ u[:, 2 * units :])
        if keep is not None:
            keep.append((t, h, z, r, rh, new))
        h = (h + z * (new - h)) * mask[t][:, None]
        out[t] = h
    return out


def _layer_back(d_out: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: list) -> tuple[np.ndarray, np.ndarray]:
    time, n, units = d_out.shape
    dx, du, dh = np.zeros((time, n, 3 * units), np.float32), np.zeros_like(u), np.zeros((n, units), np.float32)
    for t, h, z, r, rh, new in reversed(keep):
        dh = (dh + d_out[t]) * mask[t][:, None]
        d_new = dh * z * (1 - np.abs(new)) ** 2
        d_rh = d_new @ u[:, 2 * units :].T
        du[:, 2 * units :] += rh.T @ d_new
        d_both = np.concatenate([dh * (new - h), d_rh * h], axis=1)
        both = np.concatenate([z, r], axis=1)
        d_both *= 0.25 * ((both > 0) & (both < 1))
        du[:, : 2 * units] += h.T @ d_both
        dx[t] = np.concatenate([d_both, d_new], axis=1)
        dh = dh * (1 - z) + d_rh * r + d_both @ u[:, : 2 * units].T
    return dx, du


def _forward(w: dict[str, np.ndarray], projected: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of windows: ids [time, windows] into the projected inputs, mask 1 where there is a word."""
    half = projected.shape[1] // 2
    ahead, back = ([], []) if keep is not None else (None, None)
    x = projected[ids]
    states = np.concatenate([_layer(x[:, :, :half], mask, w["ahead"], False, ahead), _layer(x[:, :, half:], mask, w["back"], True, back)], axis=2)
    score = states @ w["attend"]
    weight = np.exp(score - score.max(axis=0)) * mask
    total = weight.sum(axis=0)
    weight = weight / np.where(total > 0, total, 1)
    pooled = np.einsum("tb,tbh->bh", weight, states)
    if keep is not None:
        keep.update(states=states, weight=weight, pooled=pooled, ahead=ahead, back=back)
    return pooled @ w["out"] + w["bias"][0]


def _gradients(w: dict[str, np.ndarray], keep: dict, ids: np.ndarray, mask: np.ndarray, x: np.ndarray, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
    states, weight = keep["states"], keep["weight"]
    d_pooled = d_logit[:, None] * w["out"]
    d_weight = np.einsum("tbh,bh->tb", states, d_pooled)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    d_states = weight[:, :, None] * d_pooled[None] + d_score[:, :, None] * w["attend"]
    units = w["ahead"].shape[0]
    dxa, dua = _layer_back(d_states[:, :, :units], mask, w["ahead"], keep["ahead"])
    dxb, dub = _layer_back(d_states[:, :, units:], mask, w["back"], keep["back"])
    d_projected = np.zeros((len(x), w["inner"].shape[1]), np.float32)
    np.add.at(d_projected, ids.ravel(), np.concatenate([dxa, dxb], axis=2).reshape(-1, d_projected.shape[1]))
    grads = {
        "out": keep["pooled"].T @ d_logit,
        "bias": np.array([d_logit.sum()]),
        "attend": np.einsum("tbh,tb->h", states, d_score),
        "ahead": dua,
        "back": dub,
        "inner": x.T @ d_projected,
        "shift": d_projected.sum(axis=0),
    }
    return grads, d_projected @ w["inner"].T


def _laid(sizes: np.ndarray, window: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over texts laid one after the other: places [time, windows] (past the end: -1) and each window's text."""
    count = 1 + np.maximum(0, -(-(sizes - window) // stride))
    of = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    start = nth * stride
    at = start[None, :] + np.arange(window)[:, None]
    inside = at < sizes[of][None, :]
    return np.where(inside, at + (np.cumsum(sizes) - sizes)[of][None, :], -1), inside.astype(np.float32), of


def _first_weights(seed: int, vocabulary: int, units: int, width: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    return {
        "word": normal(vocabulary, width, scale=0.05),
        "gram": normal(_GRAMS, width, scale=0.05),
        "inner": normal(2 * width, 6 * units, scale=0.5),
        "shift": np.zeros(6 * units, np.float32),
        "ahead": normal(units, 3 * units, scale=0.3),
        "back": normal(units, 3 * units, scale=0.3),
        "attend": normal(2 * units, scale=0.5),
        "out": normal(2 * units, scale=0.5),
        "bias": np.full(1, -1.0, np.float32),
    }


def fit(
    texts: list[str | None], toxic: list[int], window: int = 32, stride: int = 16, units: int = 8, width: int = 6, steps: int = 400, vocabulary: int = 20_000, seed: int = 7
) -> Model:
    """Train on texts with labels. Words and 4-grams start from the log-odds of the labels of texts they are in."""
    y = np.array(toxic, np.float32)
    if not 0 < y.sum() < len(y):
        return Model({}, {}, window, stride, float(y.mean()) if len(y) else 0.0)
    types: dict[str, int] = {}
    docs = [np.fromiter((types.setdefault(w, len(types)) for part in words_of(t) for w in part), np.int64) for t in texts]
    names = list(types)
    if not names:
        return Model({}, {}, window, stride, float(y.mean()))
    grams, first = _grams(names)
    bounds = np.append(first, len(grams))
    in_word = np.zeros((2, len(names)))
    in_gram = np.zeros((2, _GRAMS))
    for ids, label in zip(docs, toxic):
        own = np.unique(ids)
        in_word[int(label), own] += 1
        if len(own):
            in_gram[int(label), np.unique(np.concatenate([grams[bounds[i] : bounds[i + 1]] for i in own]))] += 1

    def odds(counts: np.ndarray) -> np.ndarray:
        clean, bad = (counts[k] + 0.5 for k in (0, 1))
        found = np.log(bad / (y.sum() + 1)) - np.log(clean / (len(y) - y.sum() + 1))
        seen = counts.sum(axis=0)
        return np.where(seen >= 4, np.clip(found, -4, 4) * seen / (seen + 8), 0).astype(np.float32)

    frequent = np.argsort(-in_word.sum(axis=0), kind="stable")[:vocabulary]
    frequent = frequent[in_word.sum(axis=0)[frequent] >= 4]
    known = np.zeros(len(names), np.int64)
    known[frequent] = np.arange(1, len(frequent) + 1)
    w = _first_weights(seed, len(frequent) + 1, units, width)
    w["word"][1:, 0] = odds(in_word)[frequent]
    w["gram"][:, 0] = odds(in_gram)
    w["word"][0] = 0
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    rng, step = np.random.default_rng(seed + 1), 0
    batches = -(-len(docs) // 64)
    for _ in range(-(-steps // batches)):
        for batch in np.array_split(rng.permutation(len(docs)), batches):
            step += 1
            laid, mask, of = _laid(np.array([len(docs[i]) for i in batch]), window, stride)
            flat = np.concatenate([docs[i] for i in batch] + [np.zeros(1, np.int64)])
            own, place = np.unique(flat, return_inverse=True)
            counts = bounds[own + 1] - bounds[own]
            at = np.repeat(bounds[own] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            parts, begin = grams[at], np.cumsum(counts) - counts
            x = _inputs(w, known[own], parts, begin)
            projected = x @ w["inner"] + w["shift"]
            ids = place[laid]
            logits = np.concatenate([_forward(w, projected, ids[:, k : k + _PART], mask[:, k : k + _PART]) for k in range(0, ids.shape[1], _PART)])
            order = np.lexsort((logits, of))
            best = order[np.append(np.flatnonzero(np.diff(of[order])), len(order) - 1)]
            keep: dict = {}
            top = _forward(w, projected, ids[:, best], mask[:, best], keep)
            d_logit = ((1 / (1 + np.exp(-top)) - y[batch]) / len(batch)).astype(np.float32)
            grads, d_x = _gradients(w, keep, ids[:, best], mask[:, best], x, d_logit)
            rate = 0.02 * max(0.0, 1 - step / steps) + 0.002
            for name, g in grads.items():
                _adam(w[name], moments[name], slice(None), g.astype(np.float32), rate, step)
            used = np.flatnonzero(np.abs(d_x).sum(axis=1))
            rows, back = np.unique(known[own][used], return_inverse=True)
            g = np.zeros((len(rows), width), np.float32)
            np.add.at(g, back, d_x[used, :width])
            _adam(w["word"], moments["word"], rows[rows > 0], g[rows > 0], rate, step)
            counts, begin = counts[used], begin[used]
            at = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            rows, back = np.unique(parts[at], return_inverse=True)
            g = np.zeros((len(rows), width), np.float32)
            np.add.at(g, back, np.repeat(d_x[used, width:] / counts[:, None], counts, axis=0))
            _adam(w["gram"], moments["gram"], rows, g, rate / 4, step)
    return Model({names[i]: k + 1 for k, i in enumerate(frequent)}, w, window, stride)


def _adam(value: np.ndarray, moments: tuple, rows, grad: np.ndarray, rate: float, step: int) -> None:
    m, v = moments
    m[rows] = 0.9 * m[rows] + 0.1 * grad
    v[rows] = 0.99 * v[rows] + 0.01 * grad**2
    value[rows] -= rate * m[rows] / (1 - 0.9**step) / (np.sqrt(v[rows] / (1 - 0.99**step)) + 1e-8)


class Scorer:
    """Scores texts in a worker; keeps the projected inputs of words it has met."""

    def __init__(self, model: Model):
        self.model, self.types, self.rows, self.n = model, {}, np.zeros((1, 1), np.float32), 0

    def _ids(self, words: list[str]) -> np.ndarray:
        types, w = self.types, self.model.weights
        new = [x for x in set(words) if x not in types]
        for k in range(0, len(new), 50_000):
            part = new[k : k + 50_000]
            grams, first = _grams(part)
            known = np.fromiter((self.model.words.get(x, 0) for x in part), np.int64, len(part))
            rows = _inputs(w, known, grams, first) @ w["inner"] + w["shift"]
            if self.n + len(part) > len(self.rows):
                self.rows = np.concatenate([self.rows[: self.n], np.empty((max(4096, self.n) + len(part), rows.shape[1]), np.float32)]) if self.n else np.empty((len(part) + 4096, rows.shape[1]), np.float32)
            self.rows[self.n : self.n + len(part)] = rows
            types.update(zip(part, range(self.n, self.n + len(part))))
            self.n += len(part)
        return np.fromiter(map(types.__getitem__, words), np.int64, len(words))

    def _logits(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The highest window's logit of each of the texts that are laid one after the other."""
        model = self.model
        laid, mask, of = _laid(sizes, model.window, model.stride)
        if not self.n:
            self._ids(["a"])
        ids = np.append(ids, 0)
        found = np.empty(laid.shape[1], np.float32)
        for k in range(0, len(found), _PART):
            found[k : k + _PART] = _forward(model.weights, self.rows, ids[laid[:, k : k + _PART]], mask[:, k : k + _PART])
        return np.maximum.reduceat(found, np.flatnonzero(np.append(1, np.diff(of))))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        model = self.model
        if model.constant is not None:
            return np.full(len(texts), model.constant)
        if not len(texts):
            return np.empty(0)
        best = np.full(len(texts), -np.inf)
        held: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            if held:
                found = self._logits(np.concatenate([x for _, x in held]), np.array([len(x) for _, x in held]))
                np.maximum.at(best, [i for i, _ in held], found)
                held.clear()
            if self.n > _MOST_TYPES:
                self.types, self.n = {}, 0

        total = 0
        for i, text in enumerate(texts):
            tail = np.empty(0, np.int64)
            pieces = 0
            for words in words_of(text):
                ids = np.concatenate([tail, self._ids(words)])
                pieces += 1
                held.append((i, ids))
                total += len(ids)
                # The next piece begins with the words whose windows this one may not have covered in step.
                tail = ids[max(0, len(ids) - model.window) :] if len(text or "") > 1 << 20 else tail
            if not pieces:
                held.append((i, tail))
            if total > 100_000:
                flush()
                total = 0
        flush()
        return 1 / (1 + np.exp(-best))


def learned_on(doc_id: Column) -> Column:
    """Rows whose labels may teach: crc32 of the id as text is not 1 modulo 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2500, train_chars: int = 8_000, **options) -> Model:
    """Fit a model on about per_class labelled texts of either class, of up to train_chars characters each."""
    known = labels.where("doc_id is not null and toxic is not null").where(learned_on(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = stage(known, "labels")
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect() if r.toxic in (0, 1)}
    share = [known.where((F.col("toxic") == k) & hashed_share(F.xxhash64("doc_id"), per_class, n)) for k, n in sizes.items()]
    rows = [tuple(r) for part in share for r in part.collect()]
    picked = docs.sparkSession.createDataFrame(rows, "doc_id long, toxic int")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.length("text") <= train_chars)
    texts = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = sorted(texts.collect())
    return fit([r.text for r in rows], [r.toxic for r in rows], **options)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns of docs and `score`, which replaces a column of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = [c for c in docs.columns if c.lower() != "score"]
    schema = type(docs.schema)([docs.schema[c] for c in own]).add("score", "double")
    at = own.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = scorer.scores(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=schema.names)

    return docs.select(*(F.col(f"`{c}`") for c in own)).mapInArrow(run, schema)
