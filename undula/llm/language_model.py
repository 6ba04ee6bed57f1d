"""Scoring texts by a gated recurrent language model with a class-factored output.

Tokens are words (runs of characters other than ``[\\x20\\x09-\\x0D]``, A-Z lower-cased), then one end.  A
token's probability is that of its class, given the state, times its own within the class.  The most
frequent words fill classes of equal size, and within those a second softmax depends on the state.  All
other words fall into classes by their last two bytes; within those, a word has its add-one share of the
counts over the whole training corpus.  The recurrent unit is the
minimal gated one of Feng et al., "Were RNNs All We Needed?" (2024), whose gate and candidate depend on
the input alone: state = gate * state + (1 - gate) * candidate.  It is trained by truncated
backpropagation in numpy, on all training texts: they are dealt to tasks whose number grows with the corpus, each round
starts all tasks from the same parameters, and the parameters that they reach are averaged.  In scoring,
the state is carried from window to window through the whole text.

Counts of all words are a distributed table.  Only the most frequent ones, at most FREQUENT, are
broadcast; tokens outside them are looked up by a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.llm.common import crc_mod, cut, id_column, named, slices, text_array, text_bytes
from undula.llm.shingles import blank, hash_runs, lower, runs

#: Words whose counts are broadcast, at most; words with an output of their own, and their classes.
FREQUENT, OWN, OWN_CLASSES = 1 << 17, 2048, 32
#: Classes of the other words, and the class of the end.
SUFFIX_CLASSES = 32
#: Units of the state; steps of a window in training and in scoring; texts scored side by side.
HIDDEN, TRAIN_STEPS, STEPS, LANES = 24, 16, 64, 512
#: Training texts are cut into pieces of at most PIECE tokens, each trained on in one of ROUNDS; a task has
#: about TASK_TOKENS over all rounds, and lays BLOCK of them at a time into at most TRAIN_LANES lanes.
PIECE, ROUNDS, TASK_TOKENS, BLOCK, TRAIN_LANES = 4096, 4, 1 << 22, 1 << 18, 512
#: A corpus of fewer tokens is gone through repeatedly, at most MOST_PASSES times.
FEW_TOKENS, MOST_PASSES = 1 << 20, 4
#: Adam's rate in the first round; it falls evenly from round to round.
RATE = 1.6e-2
#: Distinct words that a task holds before it hands their counts on.
_HELD = 1_000_000
SIZE = OWN // OWN_CLASSES
END_CLASS = OWN_CLASSES + SUFFIX_CLASSES
CLASSES = END_CLASS + 1
# ids of input tokens: own words, then suffix classes, the end, the start
END_ID, START_ID = OWN + SUFFIX_CLASSES, OWN + SUFFIX_CLASSES + 1


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, suffix classes and n+1 offsets of the texts, ends left out."""
    data, at = text_bytes(texts)
    data = lower(data)
    starts, ends = runs(~blank(data), at)
    last = data[ends - 1].astype(np.int64)
    before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.int64)
    return hash_runs(data, starts, ends).view(np.int64), (last * 31 + before * 7) % SUFFIX_CLASSES, np.searchsorted(starts, at)


@dataclass
class Statistics:
    """What the model knows of the corpus: bounded, whatever its size."""

    total: int
    distinct: int
    docs: int
    hashes: np.ndarray  # frequent words, ascending
    counts: np.ndarray
    own: np.ndarray  # their ids in the network, or -1
    own_counts: np.ndarray  # by id
    suffix_mass: np.ndarray  # per suffix class: counts, distinct words and 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """The recurrent network: the state is a mean of what the inputs bring in, which their gates weigh."""

    def __init__(self, stats: Statistics, seed: int = 3):
        rng = np.random.default_rng(seed)
        norm = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        h = HIDDEN
        by_class = np.concatenate((stats.own_counts.reshape(OWN_CLASSES, SIZE).sum(1), stats.suffix_mass, [stats.docs])).astype(np.float64) + 1
        own = stats.own_counts.reshape(OWN_CLASSES, SIZE).astype(np.float64)
        self.p = {
            # gates begin so that units forget at different paces
            "gate": norm(START_ID + 1, h, by=0.3) + np.linspace(-2, 3, h, dtype=np.float32), "new": norm(START_ID + 1, h, by=0.5),
            "wc": norm(h, CLASSES, by=0.05), "bc": np.log(by_class / by_class.sum()).astype(np.float32),
            "wo": norm(OWN_CLASSES, SIZE, h, by=0.05), "bo": np.log((own + 1e-3) / (own + 1e-3).sum(1, keepdims=True)).astype(np.float32),
        }
        self.filled = own > 0  # places of classes that no word fills have no probability
        self.p["bo"][~self.filled] = -1e4

    @staticmethod
    def target_class(ids: np.ndarray) -> np.ndarray:
        """The class of each id."""
        return np.where(ids < OWN, ids // SIZE, np.where(ids < END_ID, ids - OWN + OWN_CLASSES, END_CLASS))

    def flat(self) -> np.ndarray:
        """All parameters in one vector."""
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> None:
        """Take the parameters from such a vector, which they share from then on."""
        self.p = self._views(flat)

    def _views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        ends = np.cumsum([v.size for v in self.p.values()])
        return {k: part.reshape(v.shape) for (k, v), part in zip(self.p.items(), np.split(flat, ends[:-1]), strict=True)}

    def train(self, blocks: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], rate: float) -> int:
        """Truncated backpropagation through windows of TRAIN_STEPS, with Adam; returns the number of tokens.

        A block has ids, the id before each, and where a state starts anew.
        """
        flat, total, turn = self.flat(), 0, 0
        self.load(flat)
        slope = np.zeros_like(flat)
        grads, m, v = self._views(slope), np.zeros_like(flat), np.zeros_like(flat)
        for y, x, fresh in blocks:
            total += len(y)
            lanes = min(TRAIN_LANES, max(1, len(y) // (16 * TRAIN_STEPS)))
            length = -(-len(y) // lanes)
            rest = (0, lanes * length - len(y))
            y = np.ascontiguousarray(np.pad(y, rest, constant_values=-1).reshape(lanes, length).T)
            x = np.ascontiguousarray(np.pad(x, rest, constant_values=START_ID).reshape(lanes, length).T)
            fresh = np.ascontiguousarray(np.pad(fresh, rest, constant_values=True).reshape(lanes, length).T)
            state = np.zeros((lanes, HIDDEN), np.float32)
            for t in range(0, length, TRAIN_STEPS):
                at = slice(t, t + TRAIN_STEPS)
                slope[:] = 0
                state, _ = self.window(x[at], y[at], fresh[at], state, grads)
                turn += 1
                slope *= min(1.0, 1.0 / (float(np.sqrt(np.dot(slope, slope))) + 1e-9))
                m += np.float32(0.1) * (slope - m)
                v += np.float32(0.01) * (slope * slope - v)
                flat -= np.float32(rate / (1 - 0.9**turn)) * m / (np.sqrt(v / np.float32(1 - 0.99**turn)) + np.float32(1e-6))
        return total

    def window(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, state: np.ndarray, g: dict[str, np.ndarray]) -> tuple[np.ndarray, float]:
        """Put the gradients of the mean loss over a window into g (zeros before); returns the state after it and that loss."""
        p, h = self.p, HIDDEN
        seen, place = np.unique(x, return_inverse=True)
        place, kept = place.reshape(x.shape), (~fresh).astype(state.dtype)[:, :, None]
        gate, new = _sigmoid(p["gate"][seen]), np.tanh(p["new"][seen])
        u, n = gate[place], new[place]
        pasts, states = np.empty_like(u), np.empty_like(u)
        past = state
        for s in range(len(x)):
            np.multiply(past, kept[s], out=pasts[s])
            past = np.subtract(pasts[s], n[s], out=states[s])
            past *= u[s]
            past += n[s]
        live = y >= 0
        target, out = y[live], states[live]
        each, row = 1 / out.dtype.type(max(1, len(target))), np.arange(len(target))
        cls = self.target_class(target)
        d, size = _exp(out @ p["wc"] + p["bc"])
        loss = np.log(size / d[row, cls]).sum()
        d *= (each / size)[:, None]
        d[row, cls] -= each
        g["wc"][:], g["bc"][:] = out.T @ d, d.sum(0)
        slope = d @ p["wc"].T
        by, ends = _by_class(cls)
        mine, places = out[by], target[by] % SIZE
        inner = np.empty_like(mine)
        for k in np.flatnonzero(np.diff(ends)):
            some = slice(ends[k], ends[k + 1])
            d, size = _exp(mine[some] @ p["wo"][k].T + p["bo"][k])
            row = np.arange(len(d))
            loss += np.log(size / d[row, places[some]]).sum()
            d *= (each / size)[:, None]
            d[row, places[some]] -= each
            np.matmul(d, p["wo"][k], out=inner[some])
            g["wo"][k], g["bo"][k] = d.T @ mine[some], d.sum(0)
        slope[by] += inner
        back = np.zeros_like(states)
        back[live] = slope
        through, carry = u * kept, np.zeros_like(state)
        for s in reversed(range(len(x))):
            back[s] += carry
            np.multiply(back[s], through[s], out=carry)
        both = np.concatenate((back * (pasts - n), back * (1 - u)), 2).reshape(-1, 2 * h)
        order = np.argsort(place.astype(np.int16), axis=None, kind="stable")
        by_id = np.add.reduceat(both[order], np.searchsorted(place.ravel()[order], np.arange(len(seen))))
        g["gate"][seen], g["new"][seen] = by_id[:, :h] * gate * (1 - gate), by_id[:, h:] * (1 - new * new)
        return past.copy(), float(loss * each)

    def ready(self) -> None:
        """Work out what scoring reuses: the gate of each id, and what it brings in."""
        self.gate = _sigmoid(self.p["gate"])
        self.brought = (1 - self.gate) * np.tanh(self.p["new"])

    def score(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 probability of each text's ids: of classes, and of own words within theirs."""
        p = self.p
        length = np.diff(offsets)
        out = np.zeros(len(length))
        order = np.argsort(-length, kind="stable")
        for first in range(0, len(order), LANES):
            lane = order[first : first + LANES]
            n = length[lane]
            state, before = np.zeros((len(lane), HIDDEN), np.float32), np.full(len(lane), START_ID)
            for t in range(0, int(n[0]), STEPS):
                steps = min(STEPS, int(n[0]) - t)
                active = int((n > t).sum())
                valid = t + np.arange(steps)[:, None] < n[None, :active]
                target = ids[np.minimum(offsets[lane[:active]][None, :] + t + np.arange(steps)[:, None], len(ids) - 1)]
                x = np.concatenate((before[None, :active], target[:-1]))
                gate, states = self.gate[x], self.brought[x]
                past = state[:active]
                for s in range(steps):
                    states[s] += past * gate[s]
                    past = states[s]
                state[:active], before[:active] = past, target[-1]
                some, wanted = states[valid], target[valid]
                owner = np.broadcast_to(np.arange(active), valid.shape)[valid]
                cls = self.target_class(wanted)
                d, size = _exp(some @ p["wc"] + p["bc"])
                part = np.log(d[np.arange(len(d)), cls] / size)
                by, ends = _by_class(cls)
                mine, places, more = some[by], wanted[by] % SIZE, np.empty(len(by), np.float32)
                for k in np.flatnonzero(np.diff(ends)):
                    at = slice(ends[k], ends[k + 1])
                    d, size = _exp(mine[at] @ p["wo"][k].T + p["bo"][k])
                    more[at] = np.log(d[np.arange(len(d)), places[at]] / size)
                part[by] += more
                out[lane[:active]] += np.bincount(owner, part.astype(np.float64), active)
        return out / np.log(10)


def _exp(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of the rows less their largest (in place; none below 1e-30), and their sums."""
    logits -= logits.max(1, keepdims=True)
    np.maximum(logits, -69, out=logits)
    np.exp(logits, out=logits)
    return logits, logits.sum(1)


def _by_class(cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of own words ordered by class, and n+1 offsets of the classes."""
    by = np.argsort(cls.astype(np.int16), kind="stable")
    ends = np.searchsorted(cls[by], np.arange(OWN_CLASSES + 1))
    return by[: ends[-1]], ends


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def handed(words: np.ndarray, kinds: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words), pa.array(kinds.astype(np.int32)), pa.array(n)], ["word", "suffix", "n"])

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words, kinds, n = (np.concatenate(x) for x in zip(*held, strict=True))
        new, first, back = np.unique(words, return_index=True, return_inverse=True)
        return new, kinds[first], np.bincount(back, n, len(new)).astype(np.int64)

    for part in slices(batches, "text"):
        words, kinds, _ = tokens(text_array(part.column("text")))
        new, first, n = np.unique(words, return_index=True, return_counts=True)
        held.append((new, kinds[first], n))
        if sum(len(x[0]) for x in held) > _HELD:
            held = [merged()]
            if len(held[0][0]) > _HELD // 2:
                yield handed(*held.pop())
    if held:
        yield handed(*merged())


def count_words(texts: DataFrame) -> DataFrame:
    """(word, suffix, n): the hash, suffix class and count of each word in the column `text`."""
    parts = texts.select("text").mapInArrow(_counted, "word bigint, suffix int, n bigint")
    return parts.groupBy("word").agg(F.min("suffix").alias("suffix"), F.sum("n").alias("n"))


def gather(counts: DataFrame, docs: int, frequent: int = FREQUENT) -> Statistics:
    """The bounded statistics that scoring needs; `counts` as from count_words, `docs` the number of texts."""
    level = F.floor(F.log2("n") * 8).cast("int")
    levels = counts.groupBy("suffix", level.alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()
    by_level: dict[int, int] = {}
    for r in levels:
        by_level[r.level] = by_level.get(r.level, 0) + r.words
    room, least = frequent, None
    for k in sorted(by_level, reverse=True):
        if by_level[k] > room:
            break
        room, least = room - by_level[k], k
    rows = counts.where(level >= least).select("word", "suffix", "n").toArrow() if least is not None else None
    word, suffix, n = (np.asarray(rows.column(c)) if rows else np.zeros(0, np.int64) for c in ("word", "suffix", "n"))
    top = np.lexsort((word, -n))[:OWN]
    own = np.full(len(word), -1)
    own[top] = np.arange(len(top))
    own_counts = np.zeros(OWN, np.int64)
    own_counts[: len(top)] = n[top]
    mass = np.ones(SUFFIX_CLASSES)
    for r in levels:
        mass[r.suffix] += r.n + r.words
    np.subtract.at(mass, suffix[top], n[top] + 1)
    order = np.argsort(word)
    return Statistics(sum(r.n for r in levels) + docs, sum(r.words for r in levels) + (docs > 0), docs, word[order], n[order], own[order], own_counts, mass)


def ids_of(words: np.ndarray, suffix: np.ndarray, stats: Statistics) -> tuple[np.ndarray, np.ndarray]:
    """The network's ids of words, and their places among the frequent ones or -1."""
    at = np.minimum(np.searchsorted(stats.hashes, words), max(0, len(stats.hashes) - 1))
    known = stats.hashes[at] == words if len(stats.hashes) else np.zeros(len(words), bool)
    own = stats.own[at] if len(stats.hashes) else np.full(len(words), -1)
    return np.where(known & (own >= 0), own, OWN + suffix), np.where(known, at, -1)


def _with_ends(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Put the end after each text's ids."""
    return np.insert(ids, at[1:], END_ID), at + np.arange(len(at))


def _pieces(sent):
    """The texts' ids with their ends, in pieces of at most PIECE; each knows the id before it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words, suffix, at = tokens(text_array(part.column("text")))
            ids, at = _with_ends(ids_of(words, suffix, sent.value)[0], at)
            pieces = -(-np.diff(at) // PIECE)
            owner = np.repeat(np.arange(len(pieces)), pieces)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = at[owner] + number * PIECE
            before = np.where(number > 0, ids[first - 1], START_ID)
            data = ids.astype("<i2")
            cuts = [data[a:b].tobytes() for a, b in zip(first, np.append(first[1:], len(ids)), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(owner)), pa.array(number), pa.array(before.astype(np.int32)), pa.array(cuts, pa.binary())], ["id", "number", "before", "ids"])

    return run


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, the id before each, and where pieces start; about BLOCK at a time."""
    held, size = [], 0
    for batch in batches:
        for before, ids in zip(batch.column("before").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            y = np.frombuffer(ids, "<i2").astype(np.int64)
            held.append((y, np.concatenate(([before], y[:-1])), np.arange(len(y)) == 0))
            size += len(y)
            if size >= BLOCK:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _trained(sent, rate: float):
    """The parameters that a task reaches from those sent, and its number of tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        start = net.flat()
        weight = net.train(_blocks(batches), rate)
        reached = net.flat()
        net.load(start)  # a worker is used again
        if weight:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([weight]), pa.array([reached.astype(np.float32).tobytes()], pa.binary())], ["part", "weight", "reached"])

    return run


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weight, total = 0, None
    for batch in batches:
        for own, one in zip(batch.column("weight").to_pylist(), batch.column("reached"), strict=True):
            weight += own
            one = np.frombuffer(one.as_buffer(), np.float32) * np.float64(own)
            total = one if total is None else total + one
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([total.tobytes()], pa.binary())], ["weight", "total"])


def fit(texts: DataFrame, stats: Statistics) -> Network:
    """Train on all texts (columns id, text), wholly.

    Pieces are dealt by a hash, to more tasks where there are more tokens; each belongs to one round.  A
    round's parameters are the tasks' mean, weighted by their tokens, summed in two steps.  Where pieces
    lie in more partitions than there are tasks to be, several make a task.
    """
    net = Network(stats)
    if stats.docs:
        context = texts.sparkSession.sparkContext
        tasks = math.ceil(stats.total / TASK_TOKENS)
        cuts = texts.mapInArrow(_pieces(context.broadcast(stats)), "id bigint, number bigint, before int, ids binary")
        keyed = cuts.select(F.xxhash64("id", "number", "ids").alias("key"), "before", "ids")
        pieces = cut(keyed.repartition(tasks, "key").sortWithinPartitions("key"))
        some = math.ceil(math.sqrt(tasks))
        passes = min(MOST_PASSES, max(1, FEW_TOKENS // stats.total))
        for k in range(passes * ROUNDS):
            sent = context.broadcast(net)
            mine = pieces.where(F.pmod("key", F.lit(ROUNDS)) == k % ROUNDS)
            reached = mine.coalesce(tasks).mapInArrow(_trained(sent, RATE * (1 - k / (passes * ROUNDS))), "part bigint, weight bigint, reached binary")
            sums = reached.repartition(some).sortWithinPartitions("part").mapInArrow(_summed, "weight bigint, total binary").collect()
            weight = sum(r.weight for r in sums)
            if weight:
                net.load((sum(np.frombuffer(r.total, np.float64) for r in sums) / weight).astype(np.float32))
            sent.destroy()
    net.ready()
    return net


def _scored(sent, extra: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, stats = sent.value
        for part in slices(batches, "text", 6 << 20):
            words, suffix, at = tokens(text_array(part.column("text")))
            ids, frequent = ids_of(words, suffix, stats)
            n, rows = np.diff(at), len(at) - 1
            owner = np.repeat(np.arange(rows), n)
            score = net.score(*_with_ends(ids, at))
            known, rare = frequent >= 0, ids >= OWN
            logs = np.log10(stats.counts + 1.0)
            base = np.bincount(owner[known], logs[frequent[known]], rows) + np.log10(stats.docs + 1.0)
            inside = known & rare  # frequent words without an output of their own
            score += np.bincount(owner[inside], logs[frequent[inside]], rows) - np.bincount(owner[rare], np.log10(stats.suffix_mass)[suffix[rare]], rows)
            # the others, each once for a text, are to be looked up
            other = np.flatnonzero(~known)
            order = other[np.lexsort((words[other], owner[other]))]
            w, o = words[order], owner[order]
            first = np.ones(len(w), bool)
            first[1:] = (w[1:] != w[:-1]) | (o[1:] != o[:-1])
            spot = np.flatnonzero(first)
            ends = pa.array(np.searchsorted(o[spot], np.arange(rows + 1)), pa.int32())
            times = np.diff(np.append(spot, len(w))).astype(np.int32)
            made = [pa.array(n + 1), pa.array(np.bincount(owner[known], minlength=rows) + int(stats.docs > 0)), pa.array(base), pa.array(score), pa.ListArray.from_arrays(ends, pa.array(w[spot])), pa.ListArray.from_arrays(ends, pa.array(times))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in extra), *made], [*extra, "n_tokens", "n_known", "base", "part", "others", "times"])

    return run


def score_texts(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text; returns id_col, n_tokens, n_known, train_tokens, base_score and score.

    The model learns from the rows where `learn` (a condition on `docs`) is true.  n_known counts tokens
    that occur in training, train_tokens all tokens there; base_score is the add-one unigram log10
    probability, score the model's.  A null text counts as empty: one end.  Without training texts every
    token is unknown.  Rows that repeat an id are told apart by their text; equal rows give equal
    results.  Ids are whole numbers.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text, own_id = F.coalesce(named(text_col), F.lit("")), id_column(docs, id_col)
    key = [F.xxhash64(own_id, text).alias("key"), F.xxhash64(F.lit(1), own_id, text).alias("mark")]  # 128 bits of id and text
    rows = docs.select(own_id.alias("id"), *key, text.alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    training = rows.where("learn").select("id", "text")
    counts = cut(count_words(training))
    stats = gather(counts, training.count())
    sent = spark.sparkContext.broadcast((fit(training, stats), stats))
    schema = "id bigint, key bigint, mark bigint, n_tokens bigint, n_known bigint, base double, part double, others array<bigint>, times array<int>"
    scored = cut(rows.select("id", "key", "mark", "text").mapInArrow(_scored(sent, ["id", "key", "mark"]), schema))
    once = scored.select("key", "mark", F.explode(F.arrays_zip("others", "times")).alias("o")).select("key", "mark", F.col("o.others").alias("word"), F.col("o.times").alias("times"))
    met = once.join(counts.select("word", "n"), "word").groupBy("key", "mark").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.sum("times").alias("more_known"))
    # equal rows were looked up together: each has its share
    copies = scored.groupBy("key", "mark").agg(F.count("*").alias("copies")).where("copies > 1")
    every = scored.drop("others", "times").join(met, ["key", "mark"], "left").join(copies, ["key", "mark"], "left")
    share = F.coalesce("copies", F.lit(1))
    more = F.coalesce(F.col("more") / share, F.lit(0.0))
    whole = float(np.log10(stats.total + stats.distinct + 1))
    return every.select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("n_known") + F.coalesce(F.col("more_known") / share, F.lit(0)).cast("bigint")).alias("n_known"),
        F.lit(int(stats.total)).cast("bigint").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        (F.col("part") + more).alias("score"),
    )


def learnable(id_col: str = "doc_id") -> Column:
    """The condition of the six folds that may be learned from."""
    return crc_mod(named(id_col), 7) != 2
