"""Language-model scoring: a gated recurrent network with a class-factored softmax, state carried through a document.

Tokens are the words of the text, A-Z in lower case, and one end. The network's vocabulary are the most frequent
words; every other word is one of a number of groups by its first bytes, and within a group it has its smoothed
share of the group's tokens: P(class) P(member | class), times P(word | group) for words outside the vocabulary. All
words that no training document has share one unit of smoothing a group, but each is given it whole, as in the base
score; so over all possible unseen words the sum can exceed one.

Counts cover all training documents and are summed in Spark. The words frequent enough to number at most `head`
(and of 64 bytes at most) go to every task; all others meet their counts in a join, so nothing that grows with
the input is broadcast.

Training is numpy, by truncated backpropagation: windows of `steps` tokens, gradients end at a window, the state
goes on to the next one of the document. It starts on the driver from about `first_docs` documents picked by hash; then
each task descends over all of its training documents, a bounded batch of them at a time; what long documents have
left when the others are done goes on with its state beside the next batch. The tasks' weights are averaged by
tokens, in two levels.

Scoring runs documents side by side, each from its first token to its end with one state, in windows that bound
memory. Defined results: null text is empty and has its end only; repeated rows score alike; null doc_ids teach
nothing; without training documents every word is unseen and the network is untrained; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_share, stage, word_pieces

CLASSES, MEMBERS, UNITS = 64, 64, 16
GROUPS = 511  # of words outside the vocabulary; with the end they fill the first classes
_WORDS = CLASSES * MEMBERS - GROUPS - 1
_PREFIX = 3
_LANES = 256
_FIRST = 64  # lanes of the start: few, for many steps
_TRAINED = 512  # lanes of the rest: what numpy takes for a call is shared by so many tokens a step
_TOKENS = 4_000_000  # that a task holds at once
_DISTINCT = 400_000  # counted words that a task holds
_CHUNK = 1 << 14
_DENSE = ("state", "class", "class_bias", "member", "member_bias")


def group_of(word: bytes) -> int:
    """1 to GROUPS: the token of words outside the vocabulary."""
    return 1 + zlib.crc32(word[:_PREFIX]) % GROUPS


def first_weights(unigram: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """A network that gives each token its share, before it has learned anything. `unigram`: counts by token."""
    rng = np.random.default_rng(seed)
    share = np.log((unigram + 0.5) / (unigram + 0.5).sum()).reshape(CLASSES, MEMBERS)
    of_class = np.logaddexp.reduce(share, axis=1)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    return {
        "input": normal(CLASSES * MEMBERS, 3 * UNITS, scale=0.1),
        "state": normal(UNITS, 3 * UNITS, scale=0.25),
        "class": normal(UNITS, CLASSES, scale=0.05),
        "class_bias": of_class.astype(np.float32),
        "member": normal(CLASSES, UNITS, MEMBERS, scale=0.05),
        "member_bias": (share - of_class[:, None]).astype(np.float32),
    }


def _run(w: dict[str, np.ndarray], ids: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """States [time, lanes, units] after each input token, and the last ones; fresh marks the first token of a document.

    Inside, lanes are the last axis, so that each gate is one piece of memory. keep gets what backpropagation needs.
    """
    u, units = w["state"], UNITS
    gates, new_u = np.ascontiguousarray(u[:, : 2 * units].T), np.ascontiguousarray(u[:, 2 * units :].T)
    x = np.ascontiguousarray(w["input"][ids].transpose(0, 2, 1))
    states = np.empty((len(ids), units, ids.shape[1]), x.dtype)
    live, any_fresh, h = (~fresh).astype(x.dtype), fresh.any(axis=1), np.ascontiguousarray(h.T)
    for t in range(len(ids)):
        if any_fresh[t]:
            h = h * live[t]
        both = gates @ h
        both += x[t, : 2 * units]
        both *= 0.25
        both += 0.5
        np.maximum(both, 0, out=both)
        np.minimum(both, 1, out=both)
        z, r = both[:units], both[units:]
        rh = r * h
        new = new_u @ rh
        new += x[t, 2 * units :]
        slope = np.abs(new)
        slope += 1
        new /= slope
        if keep is not None:
            keep.append((h, both, rh, new, slope))
        out = states[t]
        np.subtract(new, h, out=out)
        out *= z
        out += h
        h = out
    return np.ascontiguousarray(states.transpose(0, 2, 1)), h.T


def _safe(w: dict[str, np.ndarray]) -> bool:
    """Whether no logit can leave the range of exp: units lie within -1 and 1, so weights bound the logits."""
    parts = ((w["class"], w["class_bias"], 0), (w["member"], w["member_bias"], 1))
    return all(float((np.abs(m).sum(axis=axis) + np.abs(b)).max()) < 80 for m, b, axis in parts)


def _exp_sums(x: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray]:
    """x becomes its exponentials, of differences to each row's largest if not safe; their sums, and the logarithm
    by which a row's logits exceed log-probabilities."""
    top = 0 if safe else x.max(axis=1)
    if not safe:
        x -= top[:, None]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    return total, top + np.log(total)


def _with_ones(states: np.ndarray) -> np.ndarray:
    """States with a last column of ones, which biases multiply."""
    wide = np.ones((len(states), UNITS + 1), states.dtype)
    wide[:, :UNITS] = states
    return wide


def _by_class(of: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order of goals by class, and the part of it that each class has."""
    order = np.argsort(of.astype(np.uint8), kind="stable")
    edges = np.searchsorted(of[order], np.arange(CLASSES + 1))
    return order, [(c, slice(edges[c], edges[c + 1])) for c in range(CLASSES) if edges[c + 1] > edges[c]]


def _layers(w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of both softmax layers, each with its biases as a last row."""
    return np.vstack([w["class"], w["class_bias"]]), np.concatenate([w["member"], w["member_bias"][:, None]], axis=1)


def _log_parts(x: np.ndarray, goal: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of the goals under the softmax of x; x becomes exponentials, with the sums given."""
    own = x[np.arange(len(goal)), goal]
    total, lost = _exp_sums(x, safe)
    return own - lost, total


def token_logs(w: dict[str, np.ndarray], states: np.ndarray, goals: np.ndarray) -> np.ndarray:
    """Natural log-probability of each goal token; states [n, units]."""
    safe, wide, (of_class, of_member) = _safe(w), _with_ones(states), _layers(w)
    order, parts = _by_class(goals >> 6)
    wide, goals = wide[order], goals[order]
    x = wide @ of_class
    found = _log_parts(x, goals >> 6, safe)[0]
    for c, at in parts:
        np.matmul(wide[at], of_member[c], out=x[at])
    found += _log_parts(x, goals & 63, safe)[0]
    logs = np.empty_like(found)
    logs[order] = found
    return logs


def _like(w: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Zeros for all weights but the inputs, as one array and as parts of it."""
    every, parts, at = np.zeros(sum(w[k].size for k in _DENSE), w["state"].dtype), {}, 0
    for name in _DENSE:
        parts[name] = every[at : at + w[name].size].reshape(w[name].shape)
        at += w[name].size
    return every, parts


def _descend(w: dict, sums: dict, ids: np.ndarray, fresh: np.ndarray, goals: np.ndarray, real: np.ndarray, h: np.ndarray, rate: float, full: int = 1) -> tuple[np.ndarray, float]:
    """One window of truncated backpropagation; returns the state after it and the summed log-probability.

    Gradients are means over the window's tokens, or over `full` if it has fewer, so that small windows move little.
    """
    keep: list = []
    states, last = _run(w, ids, fresh, h, keep)
    time, lanes = ids.shape
    units, kind = UNITS, states.dtype
    at = np.flatnonzero(real.ravel())
    goal = goals.ravel()[at]
    order, parts = _by_class(goal >> 6)
    at, goal = at[order], goal[order]
    safe, wide, (of_class, of_member) = _safe(w), _with_ones(states.reshape(-1, units)[at]), _layers(w)
    n, every_goal = kind.type(max(len(at), full)), np.arange(len(at))
    every, grads = _like(w)
    x = wide @ of_class
    logs, total = _log_parts(x, goal >> 6, safe)
    x /= total[:, None]
    x[every_goal, goal >> 6] -= 1
    both = wide.T @ x
    grads["class"][:], grads["class_bias"][:] = both[:units], both[units]
    d_flat = x @ w["class"].T
    for c, own in parts:
        np.matmul(wide[own], of_member[c], out=x[own])
    more, total = _log_parts(x, goal & 63, safe)
    x /= total[:, None]
    x[every_goal, goal & 63] -= 1
    for c, own in parts:
        both = wide[own].T @ x[own]
        grads["member"][c], grads["member_bias"][c] = both[:units], both[units]
        d_flat[own] += x[own] @ w["member"][c].T
    d_states = np.zeros((time * lanes, units), kind)
    d_states[at] = d_flat
    d_states = np.ascontiguousarray(d_states.reshape(time, lanes, units).transpose(0, 2, 1))
    u, du, dh = w["state"], grads["state"], np.zeros((units, lanes), kind)
    d_x = np.empty((time, 3 * units, lanes), kind)
    live, any_fresh = (~fresh).astype(kind), fresh.any(axis=1)
    gates, new_u = np.ascontiguousarray(u[:, : 2 * units]), np.ascontiguousarray(u[:, 2 * units :])
    for t in range(time - 1, -1, -1):
        h0, zr, rh, new, slope = keep[t]
        z, r = zr[:units], zr[units:]
        dh += d_states[t]
        d_new = d_x[t, 2 * units :]
        np.multiply(dh, z, out=d_new)
        d_new /= slope  # the slope of x / (1 + |x|) is 1 / (1 + |x|)^2
        d_new /= slope
        d_rh = new_u @ d_new
        both = d_x[t, : 2 * units]
        np.subtract(new, h0, out=both[:units])
        both[:units] *= dh
        np.multiply(d_rh, h0, out=both[units:])
        np.copyto(both, 0, where=(zr <= 0) | (zr >= 1))
        both *= 0.25
        du[:, 2 * units :] += rh @ d_new.T
        du[:, : 2 * units] += h0 @ both.T
        dh *= 1 - z
        d_rh *= r
        dh += d_rh
        dh += gates @ both
        if any_fresh[t]:
            dh *= live[t]
    tokens = ids.ravel()
    rows = np.flatnonzero(np.bincount(tokens, minlength=len(w["input"])))
    columns = np.ascontiguousarray(d_x.transpose(1, 0, 2)).reshape(3 * units, -1)
    d_input = np.array([np.bincount(tokens, column, len(w["input"]))[rows] for column in columns], kind).T / n
    logs += more
    sums["input"][rows] += d_input**2
    w["input"][rows] -= rate * d_input / np.sqrt(sums["input"][rows])
    every /= n
    seen = sums["dense"]
    seen += every * every
    every /= np.sqrt(seen)
    every *= -rate
    at = 0
    for name in _DENSE:
        w[name] += every[at : at + w[name].size].reshape(w[name].shape)
        at += w[name].size
    return last, float(logs.sum())


class Lanes:
    """Documents (arrays of tokens, each closed by its end) laid side by side, long lanes first.

    begun: documents of which a part was done: the rest, the last token and the state before it. Each starts a lane.
    """

    def __init__(self, docs: list[np.ndarray], lanes: int = _LANES, begun: list[tuple[np.ndarray, int, np.ndarray]] = ()):
        load = [(len(x[0]), k, []) for k, x in enumerate(begun)]
        load += [(0, k, []) for k in range(len(begun), max(len(begun), min(lanes, len(docs) + len(begun))))]
        heapq.heapify(load)
        for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
            size, k, own = heapq.heappop(load)
            own.append(i)
            heapq.heappush(load, (size + len(docs[i]), k, own))
        load.sort(key=lambda x: (-x[0], x[1]))
        self.sizes = np.array([x[0] for x in load], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        goals, of, counts = [np.empty(0, np.int16)], [], []
        self.previous = np.zeros(len(load), np.int64)
        self.state = np.zeros((len(load), UNITS), np.float32)
        for lane, (_, k, own) in enumerate(load):
            if k < len(begun):
                rest, self.previous[lane], self.state[lane] = begun[k]
                goals.append(rest)
                of.append(-1)
                counts.append(len(rest))
            for i in own:
                goals.append(docs[i])
                of.append(i)
                counts.append(len(docs[i]))
        self.goals = np.concatenate(goals)
        self.of = np.repeat(np.array(of, np.int32), counts)

    def rest(self, start: int, previous: np.ndarray, h: np.ndarray) -> tuple[list[np.ndarray], list[tuple[np.ndarray, int, np.ndarray]]]:
        """What lanes still have from place `start` on: documents not begun, and those begun."""
        docs, begun = [], []
        for lane in np.flatnonzero(self.sizes > start):
            own = self.goals[self.starts[lane] + start : self.starts[lane] + self.sizes[lane]]
            ends = np.flatnonzero(own == 0) + 1
            parts = np.split(own, ends[:-1])
            if previous[lane] != 0:
                begun.append((parts.pop(0), int(previous[lane]), h[lane].copy()))
            docs += parts
        return docs, begun

    def windows(self, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """ids, fresh, goals, real and document of each place, [time, lanes that go on]."""
        previous = self.previous
        for start in range(0, int(self.sizes.max(initial=0)), steps):
            lanes = int(np.searchsorted(-self.sizes, -start, side="left"))
            time = min(steps, int(self.sizes[0]) - start)
            places = np.arange(start, start + time)[:, None]
            real = places < self.sizes[:lanes]
            at = self.starts[:lanes] + np.where(real, places, 0)
            goals, of = np.where(real, self.goals[at], 0).astype(np.int64), np.where(real, self.of[at], 0)
            ids = np.concatenate([previous[None, :lanes], goals[:-1]])
            previous = goals[-1]
            yield ids, ids == 0, goals, real, of


def fresh_sums(w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Sums of squared gradients, by which steps shrink."""
    return {"input": np.full_like(w["input"], 1e-5), "dense": _like(w)[0] + np.float32(1e-5)}


def train_on(
    w: dict[str, np.ndarray], docs: list[np.ndarray], steps: int, rate: float, sums: dict[str, np.ndarray], lanes: int = _FIRST, begun: list = (), last: bool = True
) -> tuple[list, list]:
    """Descend over docs, in place. Unless these are the last, it stops when few lanes go on, and
    returns what they still have, to be laid beside other documents: those not begun, and those begun."""
    side, start = Lanes(docs, lanes, begun), 0
    h = side.state
    for ids, fresh, goals, real, _ in side.windows(steps):
        if not last and 4 * ids.shape[1] < len(side.sizes):
            return side.rest(start, ids[0], h)
        h, _ = _descend(w, sums, ids, fresh, goals, real, h[: ids.shape[1]], rate, lanes * steps)
        start += steps
    return [], []


def score_docs(w: dict[str, np.ndarray], docs: list[np.ndarray], steps: int) -> np.ndarray:
    """Natural log-probability of each document's tokens."""
    found, side = np.zeros(len(docs)), Lanes(docs)
    h = side.state
    for ids, fresh, goals, real, of in side.windows(steps):
        states, h = _run(w, ids, fresh, h[: ids.shape[1]])
        at = np.flatnonzero(real.ravel())
        logs = token_logs(w, states.reshape(-1, UNITS)[at], goals.ravel()[at])
        found += np.bincount(of.ravel()[at], weights=logs, minlength=len(docs))
    return found


@dataclass
class Counts:
    """What the training documents say about tokens; the table `all` is the only part that grows with them."""

    all: DataFrame  # word binary, c bigint
    docs: int
    tokens: int  # ends included
    distinct: int  # the end included, if there is one
    words: list[bytes] = field(default_factory=list)  # the head, frequent first
    head: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # their counts
    unigram: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES * MEMBERS))  # counts by the network's tokens
    groups: np.ndarray = field(default_factory=lambda: np.zeros(GROUPS + 1))  # logs of each group's smoothed size


def count_words(docs: DataFrame, head: int) -> Counts:
    """Counts over all documents (text binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        n = 0

        def out(end: bool) -> pa.RecordBatch:
            words, counts = list(held), list(held.values())
            held.clear()
            if end:
                words, counts = [*words, None], [*counts, n]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64())], names=["word", "c"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for words in word_pieces((text or b"").lower()):
                    held.update(words)
                n += 1
                if len(held) > _DISTINCT:
                    yield out(False)
        yield out(True)

    counted = stage(docs.select("text").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")
    ends = counted.where("word is null").first()
    words = counted.where("word is not null")
    ends = int(ends.c) if ends else 0
    # Counts by eighths of octaves and groups: small tables, whatever the input.
    octave, group = F.floor(F.log2(F.col("c")) * 8).cast("int"), (1 + F.crc32(F.substring("word", 1, _PREFIX)) % GROUPS).cast("int")
    bins = words.groupBy(octave.alias("octave")).agg(F.count("*").alias("n"), F.sum(F.when(F.length("word") <= 64, 1).otherwise(0)).alias("short"))
    sizes = words.groupBy(group.alias("g")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()
    low, taken = 1 << 30, 0
    for row in sorted(bins.collect(), key=lambda r: -r.octave):
        if taken + row.short > head:
            break
        low, taken = row.octave, taken + row.short
    top = words.where((octave >= low) & (F.length("word") <= 64)).toArrow()
    found = sorted(zip((-c for c in top.column("c").to_pylist()), top.column("word").to_pylist()))
    total, distinct = sum(int(r.c) for r in sizes) + ends, sum(int(r.n) for r in sizes) + (ends > 0)
    out = Counts(words, ends, total, distinct, [w for _, w in found], np.array([-c for c, _ in found], np.int64))
    size, kinds = np.zeros(GROUPS + 1), np.zeros(GROUPS + 1)
    for r in sizes:
        size[r.g], kinds[r.g] = r.c, r.n
    for w, c in zip(out.words[:_WORDS], out.head):
        g = group_of(w)
        size[g] -= c
        kinds[g] -= 1
    out.groups = np.log10(size + 0.5 * (kinds + 1))
    out.unigram[0] = ends
    out.unigram[1 : GROUPS + 1] = size[1:]
    known = out.head[:_WORDS]
    out.unigram[GROUPS + 1 : GROUPS + 1 + len(known)] = known
    return out


class Reader:
    """Turns texts into tokens in a worker, by the head of the counts."""

    def __init__(self, words: list[bytes], head: np.ndarray):
        self.at = {w: i for i, w in enumerate(words)}
        self.token = np.array([GROUPS + 1 + i if i < _WORDS else group_of(w) for i, w in enumerate(words)] + [0], np.int64)
        self.log = np.append(np.log10(head + 0.5), 0.0)

    def read(self, text: bytes | None) -> tuple[np.ndarray, list[bytes], int, float, float, np.ndarray]:
        """Tokens (end included), words outside the head, words of the head, summed log10(c + 0.5) of these, and of
        those outside the vocabulary; the group tokens."""
        tokens, tail, known, base, own = [], [], 0, 0.0, 0.0
        for words in word_pieces((text or b"").lower()):
            at = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
            ids = self.token[at]
            missing = np.flatnonzero(at < 0)
            if len(missing):
                other = [words[i] for i in missing]
                ids[missing] = [group_of(w) for w in other]
                tail += other
            logs = self.log[at]
            known += len(words) - len(missing)
            base += float(logs.sum())
            own += float(logs[at >= _WORDS].sum())
            tokens.append(ids)
        ids = np.concatenate([*tokens, np.zeros(1, np.int64)])
        return ids, tail, known, base, own, ids[(ids > 0) & (ids <= GROUPS)]


def learned_on(doc_id: Column) -> Column:
    """Rows that may teach: crc32 of the id as text is not 1 modulo 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 1


def _averaged(parts: DataFrame, tasks: int) -> list:
    """Weighted means of chunks of weights (chunk, part, tokens, data), in two levels."""

    def mean(group: pa.Table) -> pa.Table:
        weight = group.column("tokens").to_numpy().astype(np.float64)
        data = sum(w * np.frombuffer(x, np.float32) for w, x in zip(weight, group.column("data").to_pylist())) / weight.sum()
        columns = {"chunk": group.column("chunk")[:1], "part": group.column("part")[:1], "tokens": pa.array([int(weight.sum())])}
        return pa.table({**columns, "data": pa.array([data.astype(np.float32).tobytes()], pa.binary())})

    schema = "chunk int, part int, tokens bigint, data binary"
    some = parts.groupBy("chunk", F.pmod("part", F.lit(max(1, round(tasks**0.5))))).applyInArrow(mean, schema)
    return some.groupBy("chunk").applyInArrow(mean, schema).orderBy("chunk").collect()


_READ = "row bigint, doc_id bigint, teaches boolean, n_tokens bigint, tokens binary, tail array<struct<word:binary,n:bigint>>, known bigint, base double, own double"


def read_documents(docs: DataFrame, counts: Counts) -> DataFrame:
    """docs (doc_id, text binary, teaches) as tokens, two bytes each, with their words outside the head and the sums
    over those in it; a table, so that texts are taken apart once."""
    shared = docs.sparkSession.sparkContext.broadcast((counts.words, counts.head, counts.groups))
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])), pa.int64(), pa.float64(), pa.float64())
    names = [f.split(" ")[0] for f in _READ.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, head, groups = shared.value
        reader, held, total = Reader(words, head), [], 0

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
            held.clear()
            return batch

        for batch in batches:
            for row, doc_id, text, teaches in zip(*(c.to_pylist() for c in batch.columns)):
                ids, tail, known, base, own, grouped = reader.read(text)
                tail = [{"word": w, "n": n} for w, n in Counter(tail).items()]
                held.append((row, doc_id, teaches, len(ids), ids.astype("<i2").tobytes(), tail, known, base, own - float(groups[grouped].sum())))
                total += len(ids)
                if total >= _TOKENS // 4:
                    yield out()
                    total = 0
        if held:
            yield out()

    return stage(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "teaches").mapInArrow(run, _READ), "tokens")


def train(read: DataFrame, counts: Counts, steps: int = 16, rate: float = 0.2, first_docs: int = 800, first_tokens: int = 1500) -> dict[str, np.ndarray]:
    """The network's weights from the documents that teach, as read_documents gives them."""
    read = read.where("teaches")
    w = first_weights(counts.unigram)
    order = F.xxhash64("tokens", "doc_id")
    picked = read.where((F.col("n_tokens") <= first_tokens) & hashed_share(order, first_docs, counts.docs))
    sample = picked.groupBy(order.alias("order")).agg(F.min("tokens").alias("tokens")).collect()
    sums = fresh_sums(w)
    train_on(w, [np.frombuffer(r.tokens, "<i2") for r in sorted(sample)], steps, rate, sums)
    shared = read.sparkSession.sparkContext.broadcast((w, sums))
    every = read.select("tokens", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = ({k: v.copy() for k, v in x.items()} for x in shared.value)
        held, begun, total, seen, part = [], [], 0, 0, 0
        for batch in batches:
            for tokens, part in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(np.frombuffer(tokens, "<i2"))
                total, seen = total + len(held[-1]), seen + len(held[-1])
                if total >= _TOKENS // 4:
                    held, begun = train_on(own, held, steps, rate, sums, _TRAINED, begun, False)
                    total = 0
        if held or begun:
            train_on(own, held, steps, rate, sums, _TRAINED, begun)
        if seen:
            flat = np.concatenate([own[k].ravel() for k in sorted(own)])
            chunks = [flat[i : i + _CHUNK].tobytes() for i in range(0, len(flat), _CHUNK)]
            n = len(chunks)
            columns = [pa.array(range(n), pa.int32()), pa.array([part] * n, pa.int32()), pa.array([seen] * n, pa.int64()), pa.array(chunks, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "part", "tokens", "data"])

    parts = stage(every.mapInArrow(run, "chunk int, part int, tokens bigint, data binary"), "weights")
    rows = _averaged(parts, parts.select("part").distinct().count())
    if rows:
        flat, at = np.frombuffer(b"".join(r.data for r in rows), np.float32), 0
        for k in sorted(w):
            w[k] = flat[at : at + w[k].size].reshape(w[k].shape).copy()
            at += w[k].size
    return w


def score(docs: DataFrame, learned: Column | None = None, head: int = 300_000, steps: int = 64, **training) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text).

    `learned` says which rows teach (learned_on by default). base_score: log10 of smoothed unigrams; score: log10 of
    the network's probability of the text.
    """
    teaches = F.coalesce(learned_on(F.col("doc_id")) if learned is None else learned, F.lit(False))
    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"), teaches.alias("teaches"))
    counts = count_words(picked.where("teaches"), head)
    read = read_documents(picked, counts)
    shared = docs.sparkSession.sparkContext.broadcast(train(read, counts, **training))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, rows, held, total = shared.value, [], [], 0

        def out() -> pa.RecordBatch:
            logs = score_docs(w, held, steps) / np.log(10)
            batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(logs)], names=["row", "log"])
            rows.clear()
            held.clear()
            return batch

        for batch in batches:
            for row, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append(row)
                held.append(np.frombuffer(tokens, "<i2"))
                total += len(held[-1])
                if total >= _TOKENS:
                    yield out()
                    total = 0
        if rows:
            yield out()

    logs = stage(read.select("row", "tokens").mapInArrow(run, "row bigint, log double"), "scored")
    tail = read.select("row", F.inline("tail")).join(counts.all, "word", "left")
    tail = tail.groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("tail_log"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tail_known")
    )
    rows = read.select("row", "doc_id", "n_tokens", "known", "base", "own").join(logs, "row").join(tail, "row", "left")
    left = F.coalesce("tail_log", F.lit(0.0))
    each = float(np.log10(counts.tokens + 0.5 * (counts.distinct + 1)))
    end = float(np.log10(counts.docs + 0.5))
    return rows.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0)) + (1 if counts.docs else 0)).cast("bigint").alias("n_known"),
        F.lit(counts.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + left + end - F.col("n_tokens") * each).alias("base_score"),
        (F.col("own") + F.col("log") + left).alias("score"),
    )
