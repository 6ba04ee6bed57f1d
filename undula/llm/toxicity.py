"""Toxicity by a subsequence string-kernel support vector machine on Nyström landmarks.

A text is a bag of units: its words with punctuation taken out, spelled-out letters (``i d i o t``) put
together, and a mark set before each word.  A long word is a unit as a whole, and so are its overlapping
pieces, as an insult may be a small part of it.  Units of any length are compared whole by the gap-weighted
subsequence kernel of order three, scaled to 1 of a unit with itself, which tolerates letters put between
others.  The machine works on Nyström features of landmark units.  Labels are of whole texts, so it learns
from the most toxic-looking unit of each text labelled 1 and from the units of those labelled 0, picking
them anew in each round; a text's score is that of its most toxic-looking unit, calibrated.

The kernel's feature space is small (SYMBOLS**3 subsequences), so the expansion over landmarks is
summed once into a table over it: the same values, whatever the number of landmarks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm.common import Kept, crc_mod, id_column, named, slices, text_array, text_bytes
from undula.llm.shingles import blank, hash_runs, lower, runs

DECAY, LANDMARKS, ROUNDS = 0.6, 300, 4
#: The sample to fit on has at most so many texts of either label, none over SAMPLE_CHARS long.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 1200, 2400, 20_000
#: Symbols: 1 to 26 for A-Z, then further letters by their code points, at last the mark of a word's start.
SYMBOLS, MARK = 64, 63
#: Words of more than MOST symbols give, beside themselves, their pieces of PIECE symbols, STRIDE apart.
MOST, PIECE, STRIDE = 10, 8, 4
RIDGE = 2e-5
#: Units of toxic texts with a run of four symbols of this log-odds or more are all learned as toxic.
CLEAR = 4.0
_CACHE = 400_000
#: Units up to this length are listed subsequence by subsequence, longer ones gone through letter by letter.
_LISTED = 40
_ASCII = np.zeros(256, np.uint8)
_ASCII[97:123] = np.arange(1, 27)
for _digit, _letter in zip("0123456789", "oizeasgtbg", strict=True):
    _ASCII[ord(_digit)] = ord(_letter) - 96


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """The symbol of each code point of the basic plane, small and capital letters alike; 0 for what is no letter."""
    out = np.zeros(1 << 16, np.uint8)
    for c in range(0x80, 1 << 16):
        if chr(c).isalpha():
            out[c] = 27 + ord(chr(c).lower()[0]) % (MARK - 27)
    return out


def symbols(data: np.ndarray) -> np.ndarray:
    """The symbol of each character at its first byte, 0 elsewhere and for what is no letter or digit."""
    out = _ASCII[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        padded = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.int32)
        first, second, third = padded[lead], padded[lead + 1] & 63, padded[lead + 2] & 63
        point = np.where(first < 0xE0, (first & 31) << 6 | second, (first & 15) << 12 | second << 6 | third)
        out[lead] = np.where(first < 0xF0, _letters()[point], 0)  # beyond the basic plane: none
    return out


@dataclass
class Units:
    """Runs of symbols."""

    symbol: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def __len__(self) -> int:
        return len(self.first)

    def take(self, places: np.ndarray) -> Units:
        """These units, in this order."""
        return Units(self.symbol, self.first[places], self.last[places])

    def by_length(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of units of one length, and their symbols as a table, of about `most` subsequences at a time."""
        size = self.last - self.first
        order = np.argsort(size, kind="stable")
        for n in np.unique(size):
            group = order[np.searchsorted(size[order], n) : np.searchsorted(size[order], n, "right")]
            step = max(1, most // max(1, n * (n - 1) * (n - 2) // 6)) if n <= _LISTED else 1
            for i in range(0, len(group), step):
                some = group[i : i + step]
                yield some, self.symbol[self.first[some][:, None] + np.arange(n)[None, :]].astype(np.int64)


def units(texts: pa.Array) -> tuple[Units, np.ndarray, np.ndarray]:
    """All units of the texts in order, their hashes, and n+1 offsets."""
    data, at = text_bytes(texts)
    data = lower(data)
    symbol = symbols(data)
    keep = (symbol > 0) | blank(data)
    symbol, at = symbol[keep], np.concatenate(([0], np.cumsum(keep)))[at]
    starts, ends = runs(symbol > 0, at)
    single = (ends - starts) == 1
    if len(starts) > 1:
        text_of = np.searchsorted(at, starts, "right")
        joined = np.flatnonzero(single[:-1] & single[1:] & (text_of[:-1] == text_of[1:]))
        if len(joined):  # take out the blanks between single letters
            stay = np.ones(len(symbol), bool)
            gap = starts[joined + 1] - ends[joined]
            stay[np.repeat(ends[joined] - np.cumsum(gap) + gap, gap) + np.arange(gap.sum())] = False
            symbol, at = symbol[stay], np.concatenate(([0], np.cumsum(stay)))[at]
            starts, ends = runs(symbol > 0, at)
    if len(starts):
        marked = np.zeros(len(starts), np.int64) + MARK
        at, symbol = at + np.searchsorted(starts, at), np.insert(symbol, starts, marked)
        starts, ends = starts + np.arange(len(starts)), ends + np.arange(1, len(starts) + 1)
    size = ends - starts
    more = np.where(size > MOST, 1 + -(-(size - PIECE) // STRIDE), 0)
    owner = np.repeat(np.arange(len(size)), more + 1)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)  # 0: the word itself
    first = np.where(step > 0, np.minimum(starts[owner] + (step - 1) * STRIDE, ends[owner] - PIECE), starts[owner])
    last = np.where(step > 0, first + PIECE, ends[owner])
    return Units(symbol, first, last), hash_runs(symbol, first, last), np.searchsorted(starts[owner], at)


@lru_cache(maxsize=_LISTED + 1)
def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All subsequences of three of n places, and their weights."""
    places = np.array(list(combinations(range(n), 3)), np.int64).reshape(-1, 3)
    return places, DECAY ** (places[:, 2] - places[:, 0] + 1)


def _codes(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(units, subsequences) codes of units of one length, and the subsequences' weights."""
    places, weight = _triples(table.shape[1])
    scaled = table * SYMBOLS
    code = scaled[:, places[:, 0]]
    code += table[:, places[:, 1]]
    code *= SYMBOLS
    code += table[:, places[:, 2]]
    return code, weight


def own_kernel(table: np.ndarray) -> np.ndarray:
    """The kernel of each unit with itself before scaling; units of one length, by its recursion over prefixes."""
    rows, n = table.shape
    same = (table[:, :, None] == table[:, None, :]).astype(np.float64)
    below = np.ones((n + 1, n + 1, rows))
    for _ in range(2):  # orders one and two, weighted up to the ends of both prefixes
        now, inner = np.zeros((n + 1, n + 1, rows)), np.zeros((n + 1, n + 1, rows))
        for s in range(1, n + 1):
            for t in range(1, n + 1):
                inner[s, t] = DECAY * inner[s, t - 1] + DECAY**2 * same[:, s - 1, t - 1] * below[s - 1, t - 1]
                now[s, t] = DECAY * now[s - 1, t] + inner[s, t]
        below = now
    return DECAY**2 * np.einsum("rst,str->r", same, below[:n, :n])


def whole_features(symbol: np.ndarray) -> np.ndarray:
    """The weights of all SYMBOLS**3 subsequences of one unit, letter by letter."""
    out = np.zeros((SYMBOLS, SYMBOLS, SYMBOLS))  # last symbol first
    one, two = np.zeros(SYMBOLS), np.zeros((SYMBOLS, SYMBOLS))
    for c in symbol:
        out[c] += DECAY * two
        two *= DECAY
        two[:, c] += DECAY * one
        one *= DECAY
        one[c] += DECAY
    return out.transpose(1, 2, 0).ravel()


def kernel(a: Units, b: Units) -> np.ndarray:
    """The scaled subsequence kernel of all units of a with all of b (few)."""
    known = [(some, *_flat(table)) for some, table in b.by_length(1 << 16)]
    codes = np.unique(np.concatenate([code.ravel() for _, code, _ in known])) if known else np.zeros(0, np.int64)
    place = np.full(SYMBOLS**3, len(codes), np.int32)  # the last row stays 0
    place[codes] = np.arange(len(codes))
    rows = np.zeros((len(codes) + 1, len(b)), np.float32)
    for some, code, weight in known:
        np.add.at(rows, (place[code], some[:, None]), weight)
    out = np.zeros((len(a), len(b)), np.float32)
    for some, table in a.by_length(1 << 18):
        code, weight = _flat(table)
        for k in range(code.shape[1]):
            out[some] += rows[place[code[:, k]]] * weight[:, k : k + 1].astype(np.float32)
    return out


def _flat(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(units, subsequences) codes and weights, scaled to a kernel of 1 with itself; units of one length."""
    if table.shape[1] > _LISTED:
        dense = whole_features(table[0])
        code = np.flatnonzero(dense)
        return code[None], (dense[code] / np.linalg.norm(dense))[None]
    code, weight = _codes(table)
    norm = np.sqrt(np.maximum(own_kernel(table), 1e-12))
    return code, weight[None, :] / norm[:, None]


class Machine:
    """The trained machine: a table over subsequences, a bias and a calibration."""

    def __init__(self) -> None:
        self.table, self.bias = np.zeros(SYMBOLS**3, np.float32), -1.0
        self.slope, self.shift = 1.0, 0.0
        self._seen: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.float32))

    def rate(self, some: Units) -> np.ndarray:
        """The machine's value of each unit."""
        out = np.full(len(some), self.bias, np.float32)
        for places, table in some.by_length(1 << 19):
            if 3 <= table.shape[1] <= _LISTED:
                code, weight = _codes(table)
                out[places] += (self.table[code] @ weight.astype(np.float32)) / np.sqrt(own_kernel(table))
            elif table.shape[1] > _LISTED:
                dense = whole_features(table[0])
                out[places] += float(dense @ self.table) / np.linalg.norm(dense)
        return out

    def values(self, some: Units, hashes: np.ndarray) -> np.ndarray:
        """The same, with what earlier slices had looked up by hash."""
        new, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        known, value = self._seen
        at = np.minimum(np.searchsorted(known, new), max(0, len(known) - 1))
        have = known[at] == new if len(known) else np.zeros(len(new), bool)
        out = np.empty(len(new), np.float32)
        if have.any():
            out[have] = value[at[have]]
        out[~have] = self.rate(some.take(first[~have]))
        if len(known) > _CACHE:
            known, value = known[:0], value[:0]
            have[:] = False
        merged = np.concatenate((known, new[~have]))
        order = np.argsort(merged, kind="stable")
        self._seen = merged[order], np.concatenate((value, out[~have]))[order]
        return out[back]

    def best(self, texts: pa.Array) -> np.ndarray:
        """The value of each text's most toxic-looking unit; that of no unit is the bias."""
        found, hashes, at = units(texts)
        out = np.full(len(texts), self.bias, np.float32)
        some = np.flatnonzero(np.diff(at) > 0)
        if len(some):
            out[some] = np.maximum.reduceat(self.values(found, hashes), at[:-1][some])
        return out

    def probability(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * value + self.shift, -30, 30)))

    def fit(self, texts: list[str], labels: list[int], seed: int = 5) -> Machine:
        """Learn from texts and their labels; with one label alone, the machine stays at its prior."""
        y = np.array(labels, int)
        if len(set(labels)) < 2:
            self.slope, self.shift = 0.0, 3.0 if len(y) and y[0] else -3.0
            return self
        rng = np.random.default_rng(seed)
        body, hashes, at = units(text_array(pa.array(texts, pa.large_string())))
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        body = body.take(first)
        owner = np.repeat(np.arange(len(y)), np.diff(at))
        pair = np.unique(owner.astype(np.int64) * len(body) + which)
        owner, which = pair // len(body), pair % len(body)
        starts = np.searchsorted(owner, np.arange(len(y) + 1))
        fold = np.arange(len(y)) % 5 == 0  # kept back for the calibration
        value = first_value = self._first(body, owner, which, y, ~fold)
        for _ in range(ROUNDS):
            good, bad = [], []
            for i in np.flatnonzero(~fold & (np.diff(starts) > 0)):
                mine = which[starts[i] : starts[i + 1]]
                order = np.argsort(-value[mine], kind="stable")
                if y[i]:
                    good.append(mine[order[0]])
                    good.extend(mine[first_value[mine] >= CLEAR])
                else:
                    bad.extend(mine[order[:2]])
                    bad.append(mine[rng.integers(len(mine))])
            if not good or not bad:
                break
            self._train(body, np.array(good), np.array(bad), rng)
            value = self.rate(body)
        top = np.full(len(y), self.bias, np.float64)
        some = np.flatnonzero(np.diff(starts) > 0)
        top[some] = np.maximum.reduceat(value[which], starts[:-1][some]) if len(some) else []
        x, t = (top[fold], y[fold]) if len(set(y[fold])) > 1 else (top, y)
        t = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))
        self.slope, self.shift = 2.0, 0.0
        for _ in range(100):  # Platt's calibration, by damped Newton steps
            p = self.probability(x)
            d, h = t - p, np.maximum(p * (1 - p), 1e-9)
            inner = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
            step = np.clip(np.linalg.solve(inner, np.array([(d * x).sum(), d.sum()])), -2, 2)
            self.slope, self.shift = self.slope + float(step[0]), self.shift + float(step[1])
        self._seen = (np.zeros(0, np.uint64), np.zeros(0, np.float32))
        return self

    @staticmethod
    def _first(body: Units, owner: np.ndarray, which: np.ndarray, y: np.ndarray, use: np.ndarray) -> np.ndarray:
        """A first value of each unit: the best log-odds of its runs of four symbols over the texts."""
        value = np.full(len(body), -9.0)
        n1, n0 = max(1, int(y[use].sum())), max(1, int((1 - y[use]).sum()))
        size = np.maximum(body.last - body.first - 3, 0)
        unit = np.repeat(np.arange(len(body)), size)
        start = np.repeat(body.first - np.cumsum(size) + size, size) + np.arange(len(unit))
        b = body.symbol.astype(np.int64)
        _, code = np.unique(((b[start] * SYMBOLS + b[start + 1]) * SYMBOLS + b[start + 2]) * SYMBOLS + b[start + 3], return_inverse=True)
        ends = np.concatenate(([0], np.cumsum(size)))
        kinds = int(code.max()) + 1 if len(code) else 0
        seen = []
        for label in (0, 1):
            part = np.flatnonzero(use[owner] & (y[owner] == label))
            n = size[which[part]]
            spot = np.repeat(ends[which[part]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            keys = np.unique(np.repeat(owner[part], n) * kinds + code[spot])
            seen.append(np.bincount(keys % kinds if kinds else keys, minlength=kinds))
        odds = np.log((seen[1] + 1) / (n1 + 2)) - np.log((seen[0] + 1) / (n0 + 2)) + np.minimum(0, np.log((seen[1] + 1) / 6))
        np.maximum.at(value, unit, odds[code])
        return value

    def _train(self, body: Units, good: np.ndarray, bad: np.ndarray, rng: np.random.Generator) -> None:
        """A linear machine with squared hinge loss on the Nyström features of the landmarks."""
        good, times = np.unique(good, return_counts=True)
        bad, often = np.unique(bad, return_counts=True)
        lead, part = good[np.argsort(-times, kind="stable")], LANDMARKS // 3
        marks = np.unique(np.concatenate((lead[:part], rng.choice(lead, min(len(lead), part), replace=False), rng.choice(bad, min(len(bad), part), replace=False))))
        values, vectors = np.linalg.eigh(kernel(body.take(marks), body.take(marks)).astype(np.float64))
        live = values > 1e-4 * values.max()
        root = vectors[:, live] / np.sqrt(values[live])
        x = np.concatenate((kernel(body.take(good), body.take(marks)), kernel(body.take(bad), body.take(marks)))).astype(np.float64) @ root
        y = np.concatenate((np.ones(len(good)), -np.ones(len(bad))))
        share = np.concatenate((np.sqrt(times) / np.sqrt(times).sum(), np.sqrt(often) / np.sqrt(often).sum())) / 2
        x1 = np.hstack((x, np.ones((len(x), 1))))
        w, ridge = np.zeros(x1.shape[1]), RIDGE * np.eye(x1.shape[1])
        ridge[-1, -1] = 1e-9
        for _ in range(30):  # Newton's method on the squared hinge loss
            active = y * (x1 @ w) < 1
            scaled = x1[active] * share[active, None]
            new = np.linalg.solve(scaled.T @ x1[active] + ridge, scaled.T @ y[active])
            done = np.abs(new - w).max() < 1e-6
            w = w + (1.0 if _ < 4 else 0.5) * (new - w)
            if done:
                break
        w, b = w[:-1], w[-1]
        table, share = np.zeros(SYMBOLS**3), root @ w
        for some, found in body.take(marks).by_length(1 << 16):
            code, weight = _flat(found)
            np.add.at(table, code, weight * share[some][:, None])
        self.table, self.bias = table.astype(np.float32), float(b)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: tuple[int, int, int] = (SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS)) -> Machine:
    """Learn from a bounded sample of labelled texts.

    At most sample[0] ids labelled 1 and sample[1] labelled 0, those of the least hashes, are wanted; of
    their texts no longer than sample[2] characters, as many of the least hashes are gathered on the driver,
    and nothing else.  Null labels are no labels; an id that is labelled both ways counts as each.
    """
    marked = labels.select(id_column(labels, id_col).alias("id"), named(label_col).cast("int").alias("label")).dropna().distinct()
    least = lambda k, n: marked.where(F.col("label") == k).orderBy(F.xxhash64(F.lit("toxicity"), "id"), "id").limit(n)
    wanted = least(1, sample[0]).unionByName(least(0, sample[1]))
    texts = docs.select(id_column(docs, id_col).alias("id"), named(text_col).alias("text")).where(F.char_length("text") <= sample[2])
    # the wanted labels are as few as `sample` says
    some = texts.join(F.broadcast(wanted), "id").orderBy(F.xxhash64("id", "text", "label")).limit(sample[0] + sample[1]).collect()
    return Machine().fit([r.text for r in some], [r.label for r in some]) if some else Machine()


def score(docs: DataFrame, machine: Machine, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Score every whole text; returns `keep` and score, 0 to 1, higher where label 1 is likelier.

    Null, empty and blank texts have the score of a text without any unit.  Repeated rows each give a
    row; an empty table gives an empty result.  A kept column named score comes out as score_kept.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    kept = Kept(keep, ("score",))
    rows = docs.select(named(text_col).alias("text"), *kept.inside())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for part in slices(batches, "text", 1 << 20):
            value = own.probability(own.best(text_array(part.column("text"))).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept.names), pa.array(value)], [*kept.names, "score"])

    done = rows.mapInArrow(run, kept.schema(rows, "score double"))
    return done.select(*kept.outside(), "score")


def learnable(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of the three folds that may be learned from."""
    return rows.where(crc_mod(named(id_col), 4) != 2)
