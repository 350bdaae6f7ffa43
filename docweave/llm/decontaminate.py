"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by document, as search engines do it: a run of texts becomes one segment row that
holds, for each indexed term, the sorted positions of that term in the segment (texts lie one after
the other with a gap, so a position is enough to know its document). Segments are written to the shared folder.
A search reads the index alone. In each segment every query phrase starts from its rarest term there; the
lists of its other terms, rarest first, are shifted by their offset in the phrase and intersected. Nothing is shuffled:
a phrase that occurs in a third of all documents only makes longer lists in every segment.

Queries come in blocks of bounded size (`block_words` words), so what is broadcast has a fixed bound. If one block
holds them all, only its terms are indexed; else all terms are, once, and every block searches that index.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import bounded_batches, free_name, spans_of_rows, stored, utf8
from docweave.llm.words import ALNUM, word_hashes

#: Text bytes of one segment, unless one text is longer.
SEGMENT = 1 << 21
#: Places between two texts of a segment; no phrase or proximity window reaches across.
GAP = 4096
INDEX = "segment_docs array<struct<doc_id:string,tkey:long,n_words:long>>, starts array<long>, terms array<long>, ends array<long>, positions array<int>"


def vocabulary(texts) -> np.ndarray:
    """The distinct term hashes of some texts, sorted."""
    return np.unique(word_hashes(*utf8(pa.array(texts, pa.string())), ALNUM)[0])


def build_index(docs: DataFrame, terms: np.ndarray | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row (INDEX) per segment of docs, with the postings of the given terms (None: of all).

    doc_id is kept as a string (null stays null), tkey is xxhash64 of the text, null and empty texts have no
    words. starts has each document's first position, ends each term's end in positions.
    """
    bounded_batches(docs.sparkSession)
    sent = None if terms is None else docs.sparkSession.sparkContext.broadcast(terms)

    def segments(batches):
        for batch in batches:
            data, offsets = utf8(batch["text"])
            for first, end in spans_of_rows(offsets, SEGMENT):
                h, at = word_hashes(data, offsets[first : end + 1], ALNUM)
                n = np.diff(at)
                starts = at[:-1] + GAP * np.arange(end - first)
                place = np.arange(len(h)) + GAP * np.repeat(np.arange(end - first), n)
                if sent is not None:
                    known = sent.value
                    k = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                    mine = known[k] == h if len(known) else np.zeros(len(h), bool)
                    h, place = h[mine], place[mine]
                order = np.argsort(h, kind="stable")
                h, place = h[order], place[order]
                last = np.flatnonzero(np.append(h[1:] != h[:-1], True)) if len(h) else np.zeros(0, np.int64)
                ids = pa.StructArray.from_arrays([batch["doc_id"][first:end], batch["tkey"][first:end], pa.array(n)], ["doc_id", "tkey", "n_words"])
                lists = [ids, pa.array(starts), pa.array(h[last].view(np.int64)), pa.array(last + 1), pa.array(place.astype(np.int32))]
                yield pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists], ["segment_docs", "starts", "terms", "ends", "positions"])

    # xxhash64 of null is its seed; an empty text and a null one both have no words
    return docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.xxhash64(text).alias("tkey"), F.col(text).alias("text")).mapInArrow(segments, INDEX)


class Segment:
    """A row of the index."""

    def __init__(self, starts, terms, ends, positions):
        self.starts, self.positions = starts, positions
        self.terms, self.low, self.high = terms.view(np.uint64), np.concatenate([[0], ends[:-1]]), ends

    def lists(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end in positions of each wanted term's list."""
        if not len(self.terms):
            return np.zeros(wanted.shape, np.int64), np.zeros(wanted.shape, np.int64)
        k = np.minimum(np.searchsorted(self.terms, wanted), len(self.terms) - 1)
        known = self.terms[k] == wanted
        return np.where(known, self.low[k], 0), np.where(known, self.high[k], 0)

    def phrases(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """windows: a phrase of equal length per row. Returns window and first position of each exact match."""
        low, high = self.lists(windows)
        order = np.argsort(high - low, axis=1, kind="stable")
        rows = np.arange(len(windows))
        width = (high - low)[rows, order[:, 0]]
        keep = np.flatnonzero(width)
        first, width = low[keep, order[keep, 0]], width[keep]
        w = np.repeat(keep, width)
        place = self.positions[np.repeat(first - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))].astype(np.int64) - order[w, 0]
        for k in range(1, windows.shape[1]):
            if not len(w):
                break
            off = order[w, k]
            hit = self._holds(low[w, off], high[w, off], place + off)
            w, place = w[hit], place[hit]
        return w, place

    def _holds(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Is value[i] in positions[low[i]:high[i]]? (binary search, all at once)"""
        end = high.copy()
        while True:
            wide = low < high
            if not wide.any():
                break
            mid = (low + high) >> 1
            less = wide & (self.positions[np.minimum(mid, len(self.positions) - 1)] < value)
            low = np.where(less, mid + 1, low)
            high = np.where(wide & ~less, mid, high)
        return (low < end) & (self.positions[np.minimum(low, max(len(self.positions) - 1, 0))] == value)

    def near(self, words: np.ndarray, within: int) -> np.ndarray:
        """Positions of the rarest of the distinct words from which all the others are at most `within` words away."""
        words = np.unique(words)
        low, high = self.lists(words)
        order = np.argsort(high - low, kind="stable")
        place = self.positions[low[order[0]] : high[order[0]]].astype(np.int64)
        for k in order[1:]:
            own = self.positions[low[k] : high[k]].astype(np.int64)
            if not len(own):
                return place[:0]
            after = np.searchsorted(own, place)
            gap = np.minimum(np.where(after < len(own), np.abs(own[np.minimum(after, len(own) - 1)] - place), within + 1), np.where(after > 0, np.abs(place - own[np.maximum(after - 1, 0)]), within + 1))
            place = place[gap <= within]
        return place


def _row(batch: pa.RecordBatch, k: int, name: str) -> np.ndarray:
    return batch[name][k].values.to_numpy(zero_copy_only=False)


def windows_of(items, size: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct windows of the (id, text) items, by length: windows, then (window, item) links. A shorter item
    is one window, one without words none."""
    data, offsets = utf8(pa.array([t for _, t in items], pa.string()))
    h, at = word_hashes(data, offsets, ALNUM)
    found: dict[int, list] = {}
    for k, (low, high) in enumerate(zip(at[:-1], at[1:], strict=True)):
        if low < high:
            own = np.lib.stride_tricks.sliding_window_view(h[low:high], min(size, high - low))
            found.setdefault(own.shape[1], []).append((own, np.full(len(own), k)))
    out = []
    for parts in found.values():
        distinct, which = np.unique(np.concatenate([x for x, _ in parts]), axis=0, return_inverse=True)
        links = np.unique(np.stack([which.ravel(), np.concatenate([x for _, x in parts])], 1), axis=0)
        out.append((distinct, links[:, 0], links[:, 1]))
    return out


def phrase_matches(index: DataFrame, items: list, size: int = 13) -> DataFrame:
    """For each document of the index (in its order): doc_id (string), tkey, n_words, items (sorted distinct ids of
    those with a window in it, as strings) and hits (the word ranges [first, end) that windows cover, merged).
    items: (id, text) pairs, of a bounded number."""
    sent = index.sparkSession.sparkContext.broadcast(([str(i) for i, _ in items], windows_of(items, size)))

    def search(batches):
        names, groups = sent.value
        for batch in batches:
            for k in range(len(batch)):
                s = Segment(*(_row(batch, k, c) for c in ("starts", "terms", "ends", "positions")))
                docs = batch["segment_docs"][k].values
                spans, found = [], []
                for windows, link_window, link_item in groups:
                    w, place = s.phrases(windows)
                    spans.append(np.stack([place, place + windows.shape[1]], 1))
                    doc = np.searchsorted(s.starts, place, side="right") - 1
                    pairs = np.unique(np.stack([doc, w], 1), axis=0)
                    begin, end = np.searchsorted(link_window, pairs[:, 1]), np.searchsorted(link_window, pairs[:, 1], side="right")
                    width = end - begin
                    item = link_item[np.repeat(begin - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))]
                    found.append(np.stack([np.repeat(pairs[:, 0], width), item], 1))
                yield _answers(docs, s.starts, names, spans, found)

    return index.mapInArrow(search, "doc_id string, tkey long, n_words long, items array<string>, hits array<struct<first:long,end:long>>")


def _answers(docs, starts, names, spans, found) -> pa.RecordBatch:
    spans = np.concatenate(spans) if spans else np.zeros((0, 2), np.int64)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    if len(spans):
        reach = np.maximum.accumulate(spans[:, 1])
        new = np.append(True, spans[1:, 0] > reach[:-1])
        begin = spans[new, 0]
        end = np.maximum.reduceat(spans[:, 1], np.flatnonzero(new))
    else:
        begin = end = np.zeros(0, np.int64)
    doc = np.searchsorted(starts, begin, side="right") - 1
    n = np.bincount(doc, minlength=len(starts))
    hits = pa.StructArray.from_arrays([pa.array(begin - starts[doc] if len(doc) else begin), pa.array(end - starts[doc] if len(doc) else end)], ["first", "end"])
    mine: dict[int, list] = {}
    if found:
        for d, i in np.unique(np.concatenate(found), axis=0):
            mine.setdefault(int(d), []).append(names[i])
    lists = pa.array([sorted(set(mine.get(k, ()))) for k in range(len(starts))], pa.list_(pa.string()))
    return pa.record_batch([docs.field("doc_id"), docs.field("tkey"), docs.field("n_words"), lists, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), hits)], ["doc_id", "tkey", "n_words", "items", "hits"])


def proximity_matches(index: DataFrame, items: list, within: int = 20) -> DataFrame:
    """doc_id (string), tkey, item_id, word: each place of an item's rarest word (in its segment) that has all
    the other distinct words of the item at most `within` (< GAP) words away, in one document."""
    data, offsets = utf8(pa.array([t for _, t in items], pa.string()))
    h, at = word_hashes(data, offsets, ALNUM)
    sent = index.sparkSession.sparkContext.broadcast([(str(i), h[at[k] : at[k + 1]]) for k, (i, _) in enumerate(items) if at[k] < at[k + 1]])

    def search(batches):
        for batch in batches:
            for k in range(len(batch)):
                s = Segment(*(_row(batch, k, c) for c in ("starts", "terms", "ends", "positions")))
                docs = batch["segment_docs"][k].values
                for name, own in sent.value:
                    place = s.near(own, within)
                    if len(place):
                        doc = np.searchsorted(s.starts, place, side="right") - 1
                        yield pa.record_batch([docs.field("doc_id").take(pa.array(doc)), docs.field("tkey").take(pa.array(doc)), pa.array([name] * len(place), pa.string()), pa.array(place - s.starts[doc])], ["doc_id", "tkey", "item_id", "word"])

    return index.mapInArrow(search, "doc_id string, tkey long, item_id string, word long")


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int):
    """The benchmark's rows in blocks of about block_words bytes / 4 at most, each collected by itself."""
    sized = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // (4 * block_words)))
    for k in range(n):
        yield n, [tuple(r) for r in sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", block_words: int = 5_000_000) -> DataFrame:
    """doc_id, tkey, n_words, items, hits and n_hit of every row of docs (see phrase_matches; doc_id as in docs).

    Null and empty texts, and items without words, match nothing. Items of a null id count for the hits and
    appear as 'None'. Repeated rows each get their row. Other columns are not looked at.
    """
    kind = docs.schema[doc_id].dataType
    index, parts = None, []
    for n, items in _blocks(benchmark, item_id, text, block_words):
        if index is None:
            index = stored(build_index(docs, vocabulary([t for _, t in items]) if n == 1 else None, text, doc_id), "index")
        matches = phrase_matches(index, items, size)
        if n > 1:
            parts.append(stored(matches.where("size(items) > 0").dropDuplicates(["tkey", "n_words"]), "matches"))
    found = matches if n == 1 else _joined(index, parts)
    width = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["first"])
    return found.withColumn("n_hit", width).withColumn("doc_id", F.col("doc_id").cast(kind))


def _joined(index: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """The blocks' answers put together. A document's text decides them, so its hash and length in words are the key;
    there is a row at most for each block and key."""
    both = parts[0]
    for more in parts[1:]:
        both = both.unionByName(more)
    both = both.groupBy("tkey", "n_words").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    over = lambda a, x: F.when(F.size(a) == 0, F.array(x)).when(F.element_at(a, -1)["end"] < x["first"], F.concat(a, F.array(x))).otherwise(F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["first"].alias("first"), F.greatest(F.element_at(a, -1)["end"], x["end"]).alias("end")))))
    none = F.array().cast("array<struct<first:bigint,end:bigint>>")
    both = stored(both.withColumn("hits", F.aggregate("hits", none, over)), "matches")
    return index.select(F.explode("segment_docs").alias("d")).select("d.*").join(both, ["tkey", "n_words"], "left").select("doc_id", "tkey", "n_words", F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("hits", none).alias("hits"))


def without(docs: DataFrame, found: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs whose id and text are not in found (rows of contamination's result)."""
    key, own_id, own_key = (free_name(docs, x) for x in ("tkey", "gone_id", "gone_key"))
    gone = stored(found.select(F.col("doc_id").alias(own_id), F.col("tkey").alias(own_key)).distinct(), "gone")
    same = (F.col(key) == F.col(own_key)) & F.col(f"`{doc_id}`").eqNullSafe(F.col(own_id))
    return docs.withColumn(key, F.xxhash64(text)).join(gone, same, "left_anti").select(docs.columns)
