"""Language identification with interpolated Kneser-Ney character models.

One model of order 4 per language. Texts are lower-cased, everything but letters becomes a space, runs of
spaces one. A gram of up to four characters packs into 64 bits (characters beyond the BMP share one code), which
is the hash the tables are sorted by; lookups go over whole batches, by two hash slots for grams of order 4 and by binary
search for those that are not there and for lower orders.

Only the counts of the highest order are taken from the corpus (all training rows, counted per task and summed); all
lower orders are continuation counts of its types. The model holds every gram of the corpus, for discounts, continuation
counts and the rejection bound need the rare ones: the driver and each Python worker hold it whole, so their memory
bounds the number of distinct grams, not a setting.

A text gets the language of the lowest cross-entropy per character. It is rejected if that lies too far above what the
language's own texts have. Mean and deviation per character are taken from the training counts with each gram left
out of its own estimate. How far whole texts stray from the mean is calibrated by cross-validation over all labelled rows:
they are dealt into FOLDS folds by their texts' hash, each row is scored by models fitted to the other folds, and the
bound is mean + slack * (long + short * deviation / sqrt(characters)), where long and short are such that one in 1/risk of
the rows of LONG characters or more, or of fewer, lies beyond slack = 1; rows for which another language is found
do not count. So next to no text of a language that was learned is rejected, and a short text only if it is very odd.
A fold at a time is scored, so that beside the model itself one fold's models are held.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import Scratch, bounded_batches, spans_of_rows, utf8

ORDER, FOLDS = 4, 5
#: Texts of so many characters or more are long. The long and short of calibrations with fewer than LEAST or 1/risk rows of a
#: kind: among fewer, none can be the one in 1/risk, and the bound would be whatever the strangest of them has.
LONG, LEAST, UNCALIBRATED = 100, 50, (1.0, 2.0)
_MASK = [np.uint64((1 << 16 * k) - 1) for k in range(4)] + [np.uint64(2**64 - 1)]
_FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([chr(i).isalpha() for i in range(0x10000)]))
    return _LETTER[0]


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams of order 4 that end at each character of the normalised texts, the texts' offsets among them, and
    their numbers of letters."""
    lower = [t.lower() for t in texts]
    n = np.array([len(t) for t in lower], np.int64)
    c = np.frombuffer(("   " + "   ".join(lower)).encode("utf-32-le", "surrogatepass"), np.uint32)
    start = np.cumsum(n + 3) - n
    letter = _letters()[np.minimum(c, 0xFFFF)]
    if len(high := np.flatnonzero(c > 0xFFFF)):
        kinds, which = np.unique(c[high], return_inverse=True)
        letter[high] = np.array([chr(k).isalpha() for k in kinds])[which]
    own = np.ones(len(c), bool)
    for k in (1, 2, 3):
        own[start - k] = False
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep |= ~own
    counted = np.concatenate([[0], np.cumsum(letter & own)])
    letters = counted[start + n] - counted[start]
    c = np.where(letter, np.minimum(c, 0xFFFF), 32).astype(np.uint64)[keep]
    own = own[keep]
    gram = c.copy()
    for k in (1, 2, 3):
        gram[k:] |= c[:-k] << np.uint64(16 * k)
    # after a text's last letter its first gap space is kept as part of the gap: it isn't predicted
    at = np.concatenate([[0], np.cumsum(keep)])
    ends = np.concatenate([[0], np.cumsum(own)])
    low, high = ends[at[start]], ends[at[start + n]]
    return gram[own], np.append(low, high[-1:] if len(high) else [0]), letters


def _runs(texts: pa.Array, step: int):
    _, offsets = utf8(texts)
    for first, end in spans_of_rows(offsets, step):
        yield [t or "" for t in texts.slice(first, end - first).to_pylist()]


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, fold, gram (packed), c: how often each gram of order 4 occurs in the texts of each language and fold."""

    def count(batches):
        held: dict[tuple[str, int], list] = {}
        size = 0

        def merged(parts):
            g, which = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
            return g, np.bincount(which, np.concatenate([x for _, x in parts])).astype(np.int64)

        def rows():
            for (name, fold), parts in held.items():
                g, c = merged(parts)
                yield pa.record_batch([pa.array([name] * len(g), pa.string()), pa.array([fold] * len(g), pa.int32()), pa.array(g.view(np.int64)), pa.array(c)], ["lang", "fold", "gram", "c"])

        for batch in batches:
            places: dict[tuple[str, int], list] = {}
            for k, key in enumerate(zip(batch["lang"].to_pylist(), batch["fold"].to_pylist(), strict=True)):
                places.setdefault(key, []).append(k)
            for key, mine in places.items():
                for texts in _runs(batch["text"].take(pa.array(mine, pa.int64())), 1 << 19):
                    g, c = np.unique(_codes(texts)[0], return_counts=True)
                    held.setdefault(key, []).append((g, c))
                    size += len(g)
                    if len(held[key]) > 8:
                        before = sum(len(x) for x, _ in held[key])
                        held[key] = [merged(held[key])]
                        size += len(held[key][0][0]) - before
            if size > 2_000_000:
                yield from rows()
                held, size = {}, 0
        yield from rows()

    bounded_batches(docs.sparkSession)
    return _labelled(docs, text, lang).mapInArrow(count, "lang string, fold int, gram long, c long").groupBy("lang", "fold", "gram").agg(F.sum("c").alias("c"))


def _labelled(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, text, fold of the rows that have both; equal texts are in one fold."""
    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    return known.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int").alias("fold"))


class _KneserNey:
    """One language: at each order the sorted grams with their (continuation) counts, and the sorted contexts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, alphabet: int):
        order = np.argsort(grams)
        g, c = grams[order], counts[order].astype(np.float64)
        self.alphabet, self.tables = alphabet, {}
        for k in range(ORDER, 0, -1):
            context, first = np.unique(g >> np.uint64(16), return_index=True) if k > 1 else (np.zeros(1, np.uint64), np.zeros(1, np.int64))
            once, twice = (c == 1).sum(), (c == 2).sum()
            discount = once / (once + 2 * twice) if once else 0.5
            self.tables[k] = (g, c, context, np.add.reduceat(c, first), np.diff(np.append(first, len(g))), discount)
            if k > 1:
                g, n = np.unique(g & _MASK[k - 1], return_counts=True)
                c = n.astype(np.float64)

    def p(self, k: int, grams: np.ndarray, left_out: int = 0) -> np.ndarray:
        if k == 0:
            return np.full(len(grams), 1 / self.alphabet)
        g, c, context, total, types, discount = self.tables[k]
        lower = self.p(k - 1, grams & _MASK[k - 1])
        at, there = _find(g, grams)
        own = np.where(there, c[at], 0) - left_out
        at, there = _find(context, grams >> np.uint64(16) if k > 1 else np.zeros(len(grams), np.uint64))
        whole = np.maximum(total[at] - left_out, 1)
        kinds = np.minimum(types[at], whole)
        return np.where(there, (np.maximum(own - discount, 0) + discount * kinds * lower) / whole, lower)

    def backoff(self, k: int, contexts: np.ndarray) -> np.ndarray:
        _, _, context, total, types, discount = self.tables[k]
        at, there = _find(context, contexts)
        return np.where(there, discount * types[at] / total[at], 1.0)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _slot(grams: np.ndarray, which: int, shift: int) -> np.ndarray:
    return ((grams * np.uint64(_FACTORS[which])) >> np.uint64(shift)).view(np.int64)


class _Slots:
    """Where grams are among sorted keys: a key is in one of two hash slots, or else in neither and has to be searched. 16 bytes
    a key at most."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.shift = keys, 64 - max(4, int(len(keys)).bit_length())
        self.places, rest = [], np.arange(len(keys), dtype=np.int32)
        for which in range(len(_FACTORS)):
            place = np.zeros(1 << 64 - self.shift, np.int32)
            slot = _slot(keys[rest], which, self.shift)
            place[slot] = rest
            self.places.append(place)
            rest = rest[place[slot] != rest]

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A place for each gram, and the grams of which it isn't the key."""
        at = self.places[0][_slot(grams, 0, self.shift)]
        left = np.flatnonzero(self.keys[at] != grams)
        for which, place in enumerate(self.places[1:], 1):
            at[left] = place[_slot(grams[left], which, self.shift)]
            left = left[self.keys[at[left]] != grams[left]]
        return at, left


@dataclass
class Model:
    """langs; by order the sorted grams of any language with log2 probabilities in each, and the sorted contexts
    with log2 backoff weights; by language log2 of what is left for a letter never seen, and mean and deviation of its own
    bits per character."""

    langs: list[str]
    tables: dict
    contexts: dict
    unseen: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray
    stray: tuple[float, float] = UNCALIBRATED
    #: What a process has found out for its lookups; it isn't sent.
    held: dict = field(default_factory=dict)

    def bound(self, lang: np.ndarray, n: np.ndarray, slack: float) -> np.ndarray:
        """Bits per character beyond which a text of n characters is rejected."""
        return self.mean[lang] + slack * (self.stray[0] + self.stray[1] * self.deviation[lang] / np.sqrt(np.maximum(n, 1)))

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """log2 probability of each gram's last character in each language."""
        if "slots" not in self.held:
            self.held["slots"] = _Slots(self.tables[ORDER][0])
        at, left = self.held["slots"].find(gram)
        out = self.tables[ORDER][1].take(at, axis=0)
        out[left] = 0
        for k in range(ORDER, 0, -1):
            if not len(left):
                return out
            own = gram[left] & _MASK[k]
            keys, rows = self.tables[k]
            at, there = _find(keys, own)
            out[left[there]] += rows[at[there]]
            left, own = left[~there], own[~there]
            if k > 1:
                keys, rows = self.contexts[k]
                at, there = _find(keys, own >> np.uint64(16))
                out[left[there]] += rows[at[there]]
        out[left] += self.unseen
        return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang", calibration_rows: int | None = None, risk: float = 0.001) -> Model | None:
    """The models of all languages in docs; rows without text or language are not used. None if no text has a letter.

    All other rows are learned from, and all of them calibrate (see the module). calibration_rows has no effect any more; it
    is taken for the calls that have it.
    """
    scratch = Scratch(docs.sparkSession)
    counts = scratch.stored(gram_counts(docs, text, lang), "grams")
    whole = _collected(counts.groupBy("lang", "gram").agg(F.sum("c").alias("c")))
    model = fitted(whole)
    if model is not None:
        model.stray = _strays(scratch, _labelled(docs, text, lang), counts, whole, model, risk)
    scratch.clear()
    return model


def _collected(counts: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())  # a row a language
    tables = {name: counts.where(F.col("lang") == name).select("gram", "c").toArrow() for name in langs}
    return {name: (t["gram"].to_numpy().view(np.uint64), t["c"].to_numpy()) for name, t in tables.items()}


def _less(counts: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    if other is None or not len(other[0]):
        return counts
    order = np.argsort(other[0])
    at, there = _find(other[0][order], counts[0])
    c = counts[1] - np.where(there, other[1][order][at], 0)
    return counts[0][c > 0], c[c > 0]


def _strays(scratch: Scratch, known: DataFrame, counts: DataFrame, whole: dict, model: Model, risk: float) -> tuple[float, float]:
    """The long and short of the bound, from the bits of each row under the models of the other folds (see the module)."""
    means = dict(zip(model.langs, zip(model.mean.tolist(), model.deviation.tolist(), strict=True), strict=True))
    mean, deviation = [F.create_map(*[F.lit(x) for name, v in means.items() for x in (name, v[k])])[F.col("lang")] for k in (0, 1)]
    more, long = F.col("p.bits") - mean, F.col("p.n") >= LONG
    far = F.when(long, more).otherwise(more * F.sqrt("p.n") / F.greatest(deviation, F.lit(1e-9)))
    scored = []
    for fold in range(FOLDS):
        theirs = _collected(counts.where(F.col("fold") == fold).drop("fold"))
        others = fitted({name: _less(x, theirs.get(name)) for name, x in whole.items()}) if theirs else None
        if others is not None:
            sent = _sent(known, others)
            rows = known.where(F.col("fold") == fold).select("lang", _scorer(sent, raw=True)(F.col("text")).alias("p"))
            # a filter on p would be pushed below, and every text scored twice: rows that do not count are null
            counts_here = F.expr("p.letters > 0 and p.lang = lang")
            scored.append(scratch.stored(rows.select(long.alias("long"), F.when(counts_here, far).alias("far")), "strays"))
            sent.destroy()
    if not scored:
        return UNCALIBRATED
    rows = reduce(DataFrame.union, scored)
    found = [_percentile(rows.where(which).select("far"), 1 - risk) for which in (F.col("long"), ~F.col("long"))]
    return tuple(max(far, 0.0) if n >= max(LEAST, 1 / risk) else usual for (far, n), usual in zip(found, UNCALIBRATED, strict=True))


def _percentile(values: DataFrame, share: float, bins: int = 4096, most: int = 10_000) -> tuple[float | None, int]:
    """The exact percentile of values' only column, as Spark's percentile interpolates it, and the number of values.

    Histograms narrow the range until at most `most` values are left, which are collected: no task or driver holds all."""
    v = F.col(values.columns[0])
    n, low, high = values.agg(F.count(v), F.min(v), F.max(v)).first()
    place = share * max(n - 1, 0)
    first, last = math.floor(place), math.ceil(place)
    between = lambda a, b: a + (b - a) * (place - first)
    before, within = 0, n
    while within > most and low < high:
        number = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1))
        found = values.where(v.between(low, high)).groupBy(number.alias("bin")).agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).orderBy("bin").collect()
        ends = before + np.cumsum([r["n"] for r in found])
        a, b = np.searchsorted(ends, [first, last], side="right")
        if a != b:
            return between(found[a]["high"], found[b]["low"]), n
        before, within, low, high = int(ends[a]) - found[a]["n"], found[a]["n"], found[a]["low"], found[a]["high"]
    if not n or low == high:
        return low, n
    own = sorted(r[0] for r in values.where(v.between(low, high)).collect())
    return between(own[first - before], own[last - before]), n


def fitted(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model | None:
    counts = {name: x for name, x in counts.items() if len(x[0])}
    if not counts:
        return None
    alphabet = len(np.unique(np.concatenate([g & _MASK[1] for g, _ in counts.values()]))) + 1
    own = {name: _KneserNey(g, c, alphabet) for name, (g, c) in counts.items()}
    tables, contexts = {}, {}
    for k in range(ORDER, 0, -1):
        g = np.unique(np.concatenate([m.tables[k][0] for m in own.values()]))
        tables[k] = g, np.log2(np.stack([m.p(k, g) for m in own.values()], 1)).astype(np.float32)
        if k > 1:
            x = np.unique(np.concatenate([m.tables[k][2] for m in own.values()]))
            contexts[k] = x, np.log2(np.maximum(np.stack([m.backoff(k, x) for m in own.values()], 1), 1e-12)).astype(np.float32)
    mean, deviation = [], []
    for m in own.values():
        g, c = m.tables[ORDER][:2]
        bits = -np.log2(np.maximum(m.p(ORDER, g, left_out=1), 1e-12))
        mean.append(float((c * bits).sum() / c.sum()))
        deviation.append(float(np.sqrt((c * (bits - mean[-1]) ** 2).sum() / c.sum())))
    unseen = np.log2([max(m.backoff(1, np.zeros(1, np.uint64))[0], 1e-12) / alphabet for m in own.values()])
    return Model(list(own), tables, contexts, unseen.astype(np.float32), np.array(mean), np.array(deviation))


def predictor(docs: DataFrame, model: Model | None, slack: float = 2.0, trust: int = 40, raw: bool = False):
    """A function from a text column to struct(lang, score, bits, letters, rejected, n); with raw, nothing is rejected.

    lang is `und` for texts that are null or have no letter (or if there is no model); these are rejected with score 0.
    score is the language's posterior if the evidence of at most `trust` characters counts, times a falling factor
    if bits (cross-entropy per character) lie beyond the rejection bound. Whole texts are scored, in runs that hold
    one text at least.
    """
    return _scorer(_sent(docs, model), slack, trust, raw)


def _sent(docs: DataFrame, model: Model | None) -> Broadcast:
    bounded_batches(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(model and vars(model) | {"held": {}})


def _scorer(sent: Broadcast, slack: float = 2.0, trust: int = 40, raw: bool = False):
    step = max(1 << 15, (1 << 20) // max(1, len(sent.value["langs"]) if sent.value else 1))

    def predict(texts: pa.Array) -> pa.Array:
        m = Model(**sent.value) if sent.value else None
        lang, score, bits, letters, rejected, lengths = [], [], [], [], [], []
        for run in _runs(texts, step):
            gram, at, count = _codes(run)
            letters.append(count)
            n = np.diff(at)
            lengths.append(n)
            if m is None:
                total = np.zeros((len(n), 1))
            else:
                total = np.zeros((len(n), len(m.langs)))
                for low in range(0, len(gram), step):  # a long text comes in pieces
                    high = min(low + step, len(gram))
                    first, last = np.searchsorted(at, low, side="right") - 1, np.searchsorted(at, high)
                    rows = np.arange(first, last)
                    rows = rows[(np.maximum(at[rows], low) < np.minimum(at[rows + 1], high))]
                    total[rows] += np.add.reduceat(m.bits(gram[low:high]), np.maximum(at[rows], low) - low, axis=0, dtype=np.float64)
            per = -total / np.maximum(n, 1)[:, None]
            best = per.argmin(1)
            own = per[np.arange(len(n)), best]
            weight = np.exp2(np.minimum(n, trust)[:, None] * (own[:, None] - per))
            post = 1 / weight.sum(1)
            none = count == 0 if m is not None else np.ones(len(n), bool)
            if m is not None:
                bound = m.bound(best, n, slack) if not raw else np.full(len(n), np.inf)
                post = post * np.minimum(1, np.exp2(bound - own))
                lang += [("und" if x else m.langs[b]) for x, b in zip(none, best, strict=True)]
                rejected.append(none | (own > bound))
            else:
                lang += ["und"] * len(n)
                rejected.append(none)
            score.append(np.where(none, 0.0, np.clip(post, 0, 1)))
            bits.append(own)
        whole = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(whole(score, float).astype(float)), pa.array(whole(bits, float).astype(float)), pa.array(whole(letters, np.int64).astype(np.int64)), pa.array(whole(rejected, bool).astype(bool)), pa.array(whole(lengths, np.int64).astype(np.int64))], ["lang", "score", "bits", "letters", "rejected", "n"])

    return F.arrow_udf(predict, "lang string, score double, bits double, letters long, rejected boolean, n long")


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """crc32 of the id as text modulo folds equals fold; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))
