"""Near-duplicate components by tensored MinHash banding, with every link confirmed on full shingle sets.

Tensoring: a document has two small collections of minhash tuples, A (`a_tuples` tuples of `a_rows`
values) and B (`b_tuples` of `b_rows`). The key of table (i, j) is the pair of the i-th tuple of A and the
j-th of B, so `a_tuples * b_tuples` tables need only `a_tuples * a_rows + b_tuples * b_rows` minhash
functions - about the square root of what independent bands would. Two documents of similarity s meet in
some table with probability (1 - (1 - s**a_rows)**a_tuples) * (1 - (1 - s**b_rows)**b_tuples).

Scale. Documents with the same shingle set are one node from the start. Tables hold hashes and node ids only;
a tuple that nobody shares is dropped before pairs are formed. Within a bucket every member is checked
against one leader (the member that meets most others anywhere, so usually the original of a group), never
against all others. Buckets whose members still belong to different components afterwards get the exact
treatment: they are dealt into blocks (bounded by rows and by shingles) of which each meets each, bucket by bucket or
all buckets that hang together as one, whichever moves fewer rows. Only links that join components leave a task. Candidates are never capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import Scratch, bounded_batches, free_name, spans_of_rows, stored, utf8
from docweave.llm.components import connected_components
from docweave.llm.words import SPACED, mix, word_hashes

#: Text bytes whose shingles are in memory together, unless one text is longer.
_STEP = 1 << 19
#: Rows and shingles of one block of a bucket that is compared exactly.
BLOCK_ROWS, BLOCK_SHINGLES = 1000, 1_000_000
#: Nodes (of 24 bytes) that may be broadcast to pick out texts; above it, they are joined by shuffle.
BROADCAST_NODES = 400_000


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each row's distinct shingles, sorted, and the row offsets. A row of fewer words has its
    whole sequence as one shingle, a row without words has none."""
    h, at = word_hashes(data, offsets, SPACED)
    n = np.diff(at)
    count = np.where(n >= words, n - words + 1, (n > 0).astype(np.int64))
    row = np.repeat(np.arange(len(n)), count)
    first = at[:-1][row] + (np.arange(len(row)) - (np.cumsum(count) - count)[row])
    length = np.minimum(n, words)[row]
    out = length.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    for k in range(words):
        here = length > k
        out[here] = mix(out[here] + h[first[here] + k] * np.uint64(2 * k + 1))
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    out, row = out[new], row[new]
    return out, np.searchsorted(row, np.arange(len(n) + 1))


def _runs(texts, words: int):
    data, offsets = utf8(texts)
    for first, end in spans_of_rows(offsets, _STEP):
        yield shingles(data, offsets[first : end + 1], words)


def _signer(words: int, a: tuple[int, int], b: tuple[int, int]):
    seeds = np.random.default_rng(20).integers(1, 2**63, (a[0] * a[1] + b[0] * b[1], 2), np.uint64) | np.uint64(1)

    def sign(texts: pa.Array) -> pa.Array:
        node, size, sides = [], [], ([], [])
        for own, at in _runs(texts, words):
            n = np.diff(at)
            full = n > 0
            starts = at[:-1][full]
            ids = np.zeros((len(n), 2), np.uint64)
            least = np.zeros((int(full.sum()), len(seeds)), np.uint64)
            if len(starts):
                for k, salt in enumerate((0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F)):
                    ids[full, k] = np.add.reduceat(mix(own * np.uint64(salt) + np.uint64(k)), starts)
                for k, (factor, plus) in enumerate(seeds):
                    x = own * factor + plus
                    x ^= x >> np.uint64(32)
                    least[:, k] = np.minimum.reduceat(x * (plus | np.uint64(1)), starts)
            used = 0
            for side, (tuples, rows) in zip(sides, (a, b), strict=True):
                h = np.zeros((len(n), tuples), np.uint64)
                for t in range(tuples):
                    x = np.full(len(starts), used + 1, np.uint64)
                    for _ in range(rows):
                        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + least[:, used])
                        used += 1
                    h[full, t] = x
                side.append(h)
            size.append(n)
            node.append(ids)
        ids = np.concatenate(node) if node else np.zeros((0, 2), np.uint64)
        count = np.concatenate(size) if size else np.zeros(0, np.int64)
        lists = []
        for side, (tuples, _) in zip(sides, (a, b), strict=True):
            flat = np.concatenate(side).view(np.int64).ravel() if side else np.zeros(0, np.int64)
            lists.append(pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * tuples), pa.array(flat)))
        as_bytes = pa.Array.from_buffers(pa.binary(16), len(ids), [None, pa.py_buffer(np.ascontiguousarray(ids).tobytes())]).cast(pa.binary())
        return pa.StructArray.from_arrays([as_bytes, pa.array(count), *lists], ["node", "n", "a", "b"])

    return F.arrow_udf(sign, "node binary, n long, a array<long>, b array<long>")


def _setter(words: int):
    def sets(texts: pa.Array) -> pa.Array:
        found, ends = [], [np.zeros(1, np.int64)]
        for own, at in _runs(texts, words):
            found.append(own)
            ends.append(at[1:] + ends[-1][-1])
        flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
        return pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), pa.array(flat.view(np.int64)))

    return F.arrow_udf(sets, "array<long>")


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    words: int = 5,
    percent: int = 80,
    a: tuple[int, int] = (10, 2),
    b: tuple[int, int] = (7, 1),
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, component (an id that holds for null ids too, null without words) and
    tkey (xxhash64 of the text) for every row of docs.

    Two rows are linked if 100 * intersection >= percent * union of their sets of `words`-word shingles (A-Z
    lower-cased, words parted by ASCII white space). component_id is the smallest id reachable; kept says
    that it is the row's own. Null and empty texts have no shingles and no links; a null id stays null unless
    it is linked with rows that have one; its kept is false. Repeated ids are separate rows. Columns of other
    names are not looked at.
    """
    bounded_batches(docs.sparkSession)
    signed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("tkey"), F.length(text).alias("tlen"), _signer(words, a, b)(F.col(text)).alias("s"))
    signed = stored(signed.select("doc_id", "tkey", "tlen", "s.*"), "signatures")
    scratch = Scratch(docs.sparkSession)
    nodes = scratch.stored(signed.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.min(F.struct("tkey", "tlen", "n", "a", "b")).alias("s")).select("node", "doc_id", "copies", "s.*"), "nodes")
    edges = _links(docs, text, nodes, words, percent, scratch)
    roots = connected_components(edges)
    by_root = roots.join(nodes.select("node", "doc_id"), "node").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    members = roots.join(by_root, "root").select("node", "root", "component_id")
    alone = nodes.where("copies > 1").select("node", F.col("node").alias("root"), F.col("doc_id").alias("component_id")).join(roots, "node", "left_anti")
    known = stored(members.unionByName(alone), "components")
    scratch.clear()
    out = signed.select("doc_id", "n", "node", "tkey").join(known, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
        F.when(F.col("n") > 0, F.coalesce("root", "node")).alias("component"),
        "tkey",
    )


def _links(docs: DataFrame, text: str, nodes: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """Edges a, b between nodes of which the components are those of all links that the tables meet."""
    tuples = lambda c, side: F.transform(c, lambda x, i: F.xxhash64(x, i + F.lit(1000 * side)))
    one = nodes.select("node", F.explode(F.concat(tuples("a", 0), tuples("b", 1))).alias("h"))
    shared = scratch.stored(one.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "shared")
    met = one.join(shared, "h").groupBy("node").agg(F.collect_set("h").alias("met"), F.sum("c").alias("rank")).join(nodes.select("node", "n", tuples("a", 0).alias("a"), tuples("b", 1).alias("b")), "node")
    met = met.select("node", "n", "rank", F.array_intersect("a", "met").alias("a"), F.array_intersect("b", "met").alias("b"))
    pair = F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.xxhash64(x, y))))
    keys = scratch.stored(met.select("node", "rank", "n", F.explode(pair).alias("key")), "keys")
    leaders = scratch.stored(keys.groupBy("key").agg(F.count("*").alias("c"), F.max(F.struct("rank", "node", "n")).alias("l")).where("c > 1").select("key", "c", F.col("l.node").alias("leader"), F.col("l.n").alias("leader_n")), "leaders")
    buckets = scratch.stored(keys.join(leaders, "key"), "buckets")
    near = (F.least("n", "leader_n") * 100 >= F.greatest("n", "leader_n") * percent) & (F.col("node") != F.col("leader"))
    stars = scratch.stored(buckets.where(near).select("node", "leader").distinct(), "stars")
    sets = _sets(docs, text, nodes, buckets.select("node").distinct(), words, scratch)
    size = lambda x: F.size(x)
    first = stars.join(sets, "node").withColumnRenamed("set", "own").join(sets.select(F.col("node").alias("leader"), "set"), "leader")
    both = F.size(F.array_intersect("own", "set"))
    edges = scratch.stored(first.where(both * 100 >= (size("own") + size("set") - both) * percent).select(F.col("node").alias("a"), F.col("leader").alias("b")), "links")
    roots = connected_components(edges)
    open_ = scratch.stored(buckets.select("key", "node", "n").join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root")), "open")
    left = open_.groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("weight"), F.min("root").alias("low"), F.max("root").alias("high"), F.min("node").alias("head"), F.bit_xor(F.xxhash64("node")).alias("who"))
    # two members were compared by the star; the same members under another key need no second look
    left = left.where("c > 2 and low <> high").groupBy("who", "c").agg(F.min(F.struct("key", "weight", "head")).alias("k")).select("k.*", "c")
    left = scratch.stored(left.withColumn("blocks", _blocks_of("c", "weight")), "left")
    rows = scratch.stored(open_.join(left.select("key", "head"), "key").select("key", "node", "n", "root", "head"), "rows")
    # buckets of a group overlap: they are compared as one where that moves fewer rows than bucket by bucket
    groups = connected_components(rows.select(F.col("node").alias("a"), F.col("head").alias("b"))).withColumnRenamed("root", "group")
    members = scratch.stored(rows.select("node", "n", "root").distinct().join(groups, "node"), "members")
    keyed = left.join(groups.withColumnRenamed("node", "head"), "head").select("key", "group", "c", "blocks")
    cost = keyed.groupBy("group").agg(F.sum(F.col("c") * F.col("blocks")).alias("cost"))
    sizes = members.groupBy("group").agg(F.count("*").alias("c"), F.sum("n").alias("weight")).withColumn("blocks", _blocks_of("c", "weight"))
    whole = scratch.stored(sizes.join(cost, "group").where(F.col("c") * F.col("blocks") <= F.col("cost")).select("group", "blocks"), "whole")
    as_one = members.join(whole, "group").select(F.hex("group").alias("key"), "node", "root", "blocks")
    single = rows.select("key", "node", "root").join(keyed.join(whole, "group", "left_anti").select("key", "blocks"), "key").select(F.col("key").cast("string").alias("key"), "node", "root", "blocks")
    dealt = as_one.unionByName(single).withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "root").join(sets, "node")
    more = dealt.groupBy("key", "lo", "hi").applyInArrow(_block(percent), "a binary, b binary")
    return edges.unionByName(scratch.stored(more, "links"))


def _blocks_of(rows: str, weight: str):
    return F.greatest(F.ceil(F.col(rows) / BLOCK_ROWS), F.ceil(F.col(weight) / BLOCK_SHINGLES)).cast("int")


def _sets(docs: DataFrame, text: str, nodes: DataFrame, wanted: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """node, set (array of shingle hashes) of the wanted nodes, from one text of each."""
    some = scratch.stored(wanted.join(nodes, "node").select("node", "tkey", "tlen"), "wanted")
    picked = F.broadcast(some) if some.count() <= BROADCAST_NODES else some
    texts = docs.select(F.col(text).alias("text"), F.xxhash64(text).alias("tkey"), F.length(text).alias("tlen")).join(picked, ["tkey", "tlen"])
    found = texts.select("node", _setter(words)(F.col("text")).alias("set"))
    return scratch.stored(found.groupBy("node").agg(F.first("set").alias("set")), "sets")


def _block(percent: int):
    def link(table: pa.Table) -> pa.Table:
        node, root = table["node"].to_pylist(), table["root"].to_pylist()
        flat = table["set"].combine_chunks()
        values = np.asarray(flat.flatten())
        n = np.diff(np.asarray(flat.offsets))
        edges = linked(values, n, root, percent)
        return pa.table({"a": pa.array([node[i] for i, _ in edges], pa.binary()), "b": pa.array([node[j] for _, j in edges], pa.binary())})

    return link


def linked(values: np.ndarray, n: np.ndarray, root: list, percent: int) -> list[tuple[int, int]]:
    """Pairs of rows that join the components of all pairs with 100 * intersection >= percent * union, given
    the rows' sets one after the other and the component that each row is known to be in."""
    names = {r: k for k, r in enumerate(dict.fromkeys(root))}
    part = np.array([names[r] for r in root])
    if len(names) < 2:
        return []
    row = np.repeat(np.arange(len(n)), n)
    order = np.argsort(values, kind="stable")
    v, row = values[order], row[order]
    new = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    post_end = np.append(new[1:], len(v))
    which = np.empty(len(v), np.int64)
    which[order] = np.repeat(np.arange(len(new)), post_end - new)
    at = np.concatenate([[0], np.cumsum(n)])
    edges = []
    for i in range(len(n)):
        own = which[at[i] : at[i + 1]]
        own = own[post_end[own] - new[own] > 1]
        if not len(own):
            continue
        count = np.zeros(len(n), np.int64)
        low, width = new[own], post_end[own] - new[own]
        where = np.repeat(low - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
        count += np.bincount(row[where], minlength=len(n))
        hit = (count * 100 >= (n[i] + n - count) * percent) & (part != part[i])
        for j in np.flatnonzero(hit):
            if part[j] != part[i]:
                edges.append((i, int(j)))
                part[part == part[j]] = part[i]
    return edges


def representatives(docs: DataFrame, found: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay if each component of found (near_duplicates' result, written) keeps one: that of the
    smallest id, nulls last, then of the smallest text hash. Of rows that agree in both one stays. Rows without words all stay."""
    full = found.where("n_shingles > 0")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")
    best = stored(full.groupBy("component").agg(F.count("*").alias("rows"), F.min(place).alias("best")).where("rows > 1"), "best")
    grouped = full.join(best, "component").select("doc_id", "tkey", (place == F.col("best")).alias("stays"))
    gone = stored(grouped.where(~F.col("stays")).select("doc_id", "tkey").distinct(), "gone")
    twice = stored(grouped.where("stays").groupBy("doc_id", "tkey").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id", "tkey"), "twice")
    key, own_id, own_key = (free_name(docs, x) for x in ("tkey", "gone_id", "gone_key"))
    keyed = docs.withColumn(key, F.xxhash64(text))
    pick = lambda a, b, how: a.join(b.withColumnsRenamed({"doc_id": own_id, "tkey": own_key}), (F.col(key) == F.col(own_key)) & F.col(f"`{doc_id}`").eqNullSafe(F.col(own_id)), how)
    kept = pick(keyed, F.broadcast(gone) if gone.count() <= BROADCAST_NODES else gone, "left_anti")
    if not twice.isEmpty():
        kept = pick(kept, twice, "left_anti").unionByName(pick(kept, twice, "left_semi").dropDuplicates([key, doc_id]))
    return kept.select(docs.columns)
