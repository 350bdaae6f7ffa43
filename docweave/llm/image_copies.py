"""Cropped and edited copies of images, by local descriptors.

Corners are found at several scales (the smaller eigenvalue of the gradient products, local maxima), each gets the direction of its
intensity centroid, and 256 pairs of points, turned by it, are compared: the descriptor. Descriptors meet in Hamming tables: sixteen
pieces of 24 bits, each looked up as it is and with one bit flipped. Two descriptors that differ in fewer than 20 bits meet for
sure, others with falling probability (0.96 at 32 bits, 0.75 at 40, if these are spread evenly); the full distance is checked after.
The matches of two images are verified by
a similarity transform (scale, turn, shift) that is fitted to their places; enough that agree with one make a copy.

Equal images (byte for byte) are one class: equal queries are asked once, equal matches count once. Images never move; the
queries' descriptors come to them in blocks of a fixed size, each broadcast by itself.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import bounded_batches, stored

BITS = 256
#: Where the pieces of 24 bits begin, in bytes: ten side by side, more across them.
STARTS = (0, 3, 6, 9, 12, 15, 18, 21, 24, 27, 29, 1, 7, 13, 19, 25)
#: A piece as it is and with one bit flipped.
FLIPS = np.array([0, *(1 << k for k in range(24))], np.uint32)
#: Pairs of descriptors compared at once.
PAIRS = 1 << 20
#: Query descriptors (of about 150 bytes) that are broadcast at once.
BLOCK_CODES = 150_000
SCALES = (1.0, 0.84, 0.71, 0.59)
RADIUS = 9
#: A corner is the strongest place within so many pixels at its scale. Every such place counts, however many there are.
APART = 5
_PAIRS = np.random.default_rng(11).normal(0, RADIUS / 2.2, (BITS, 4)).clip(-RADIUS + 1, RADIUS - 1)


def read_image(data: bytes) -> np.ndarray | None:
    """Grey values of a binary PGM (P5, 8 bits); None for anything else. Other formats need a decoder that is not here."""
    stream = io.BytesIO(data)
    fields: list[bytes] = []
    while len(fields) < 4:
        line = stream.readline()
        if not line:
            return None
        fields += line.split(b"#")[0].split()
    if fields[0] != b"P5" or fields[3] != b"255" or not (fields[1].isdigit() and fields[2].isdigit() and len(fields[1] + fields[2]) < 12):
        return None
    width, height = int(fields[1]), int(fields[2])
    pixels = stream.read(width * height)
    return np.frombuffer(pixels, np.uint8).reshape(height, width) if len(pixels) == width * height else None


def write_image(grey: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (grey.shape[1], grey.shape[0]) + np.clip(np.rint(grey), 0, 255).astype(np.uint8).tobytes()


def resized(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear."""
    y, x = np.linspace(0, grey.shape[0] - 1, height), np.linspace(0, grey.shape[1] - 1, width)
    y0, x0 = np.minimum(y.astype(int), max(grey.shape[0] - 2, 0)), np.minimum(x.astype(int), max(grey.shape[1] - 2, 0))
    y1, x1 = np.minimum(y0 + 1, grey.shape[0] - 1), np.minimum(x0 + 1, grey.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    g = grey.astype(np.float32)
    return (g[y0][:, x0] * (1 - fx) + g[y0][:, x1] * fx) * (1 - fy) + (g[y1][:, x0] * (1 - fx) + g[y1][:, x1] * fx) * fy


def _smooth(a: np.ndarray, times: int = 1) -> np.ndarray:
    """Binomial weights of three by three along the last two axes; beyond the edge is the edge."""
    for _ in range(times):
        out = a * 2
        out[..., 1:, :] += a[..., :-1, :]
        out[..., :1, :] += a[..., :1, :]
        out[..., :-1, :] += a[..., 1:, :]
        out[..., -1:, :] += a[..., -1:, :]
        a = out * 2
        a[..., 1:] += out[..., :-1]
        a[..., :1] += out[..., :1]
        a[..., :-1] += out[..., 1:]
        a[..., -1:] += out[..., -1:]
        a *= 1 / 16
    return a


def _highest(a: np.ndarray, axis: int) -> np.ndarray:
    """The maximum of each window of 2 * APART + 1 values along an axis, by windows of doubled length."""
    cut = lambda x, low, high: x[low:high] if axis == 0 else x[:, low:high]
    wanted, length = 2 * APART + 1, 1
    while length < wanted:
        step = min(length, wanted - length)
        n = a.shape[axis] - step
        a = np.maximum(cut(a, 0, n), cut(a, step, n + step))
        length += step
    return a


def descriptors(grey: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, y, scale, angle) in the image's own pixels and the 32 bytes of each corner at each scale."""
    places, codes = [], []
    disk = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1].astype(np.float32)
    disk = disk[:, disk[0] ** 2 + disk[1] ** 2 <= RADIUS * RADIUS].astype(int)
    edge = RADIUS + 3
    for scale in SCALES:
        height, width = int(round(grey.shape[0] * scale)), int(round(grey.shape[1] * scale))
        if min(height, width) < 2 * edge + 3:
            continue
        g = _smooth(resized(grey, height, width) if scale != 1 else grey.astype(np.float32))
        gy, gx = np.gradient(g)
        a, b, c = _smooth(np.stack([gx * gx, gx * gy, gy * gy]), 2)
        strength = (a + c) / 2 - np.sqrt(((a - c) / 2) ** 2 + b * b)
        inner = strength[edge:-edge, edge:-edge]
        around = _highest(_highest(strength[edge - APART : height - edge + APART, edge - APART : width - edge + APART], 0), 1)
        y, x = np.nonzero((inner > 1.0) & (inner >= around))
        if not len(y):
            continue
        y, x = y + edge, x + edge
        s = _smooth(g)
        around = s[y[:, None] + disk[0], x[:, None] + disk[1]]
        angle = np.arctan2((around * disk[0]).sum(1), (around * disk[1]).sum(1))
        cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
        at = lambda u, v: s[np.clip(np.rint(y[:, None] + sin * u + cos * v), 0, height - 1).astype(int), np.clip(np.rint(x[:, None] + cos * u - sin * v), 0, width - 1).astype(int)]  # noqa: B023, E731
        codes.append(np.packbits(at(_PAIRS[:, 0], _PAIRS[:, 1]) < at(_PAIRS[:, 2], _PAIRS[:, 3]), axis=1))
        places.append(np.stack([x / scale, y / scale, np.full(len(x), 1 / scale), angle], 1))
    return (np.concatenate(places), np.concatenate(codes)) if places else (np.zeros((0, 4)), np.zeros((0, BITS // 8), np.uint8))


def features(images: DataFrame, image: str = "image", key: str = "class") -> DataFrame:
    """key, x, y, scale, angle and code (c0 to c3) of each corner; nothing for null and unreadable images."""

    def find(batches):
        for batch in batches:
            parts = []
            for k, data in enumerate(batch["image"]):
                grey = read_image(data.as_py()) if data.is_valid else None
                if grey is not None and grey.size:
                    place, code = descriptors(grey)
                    parts.append((np.full(len(place), k), place, code))
            if parts:
                row, place, code = (np.concatenate(x) for x in zip(*parts, strict=True))
                longs = np.ascontiguousarray(code).view(np.int64)
                yield pa.record_batch([batch["key"].take(pa.array(row)), *[pa.array(place[:, k].astype(np.float32)) for k in range(4)], *[pa.array(longs[:, k]) for k in range(4)]], ["key", "x", "y", "scale", "angle", "c0", "c1", "c2", "c3"])

    bounded_batches(images.sparkSession)
    return images.select(F.col(key).alias("key"), F.col(image).alias("image")).mapInArrow(find, "key binary, x float, y float, scale float, angle float, c0 long, c1 long, c2 long, c3 long")


def _pieces(code: np.ndarray) -> np.ndarray:
    data = np.ascontiguousarray(code).view(np.uint8).astype(np.uint32)
    return np.stack([data[:, k] | data[:, k + 1] << 8 | data[:, k + 2] << 16 for k in STARTS])


def _tables(rows: pa.Table) -> tuple:
    """Query descriptors with, for each piece of their codes, the pieces in order and whose they are."""
    code = np.stack([rows[f"c{k}"].to_numpy() for k in range(4)], 1)
    place = np.stack([rows[c].to_numpy() for c in ("x", "y", "scale", "angle")], 1)
    pieces = _pieces(code)
    order = np.argsort(pieces, axis=1, kind="stable").astype(np.int32)
    return code, place, np.take_along_axis(pieces, order, 1), order, rows["key"].to_pylist()


def _present(tables: tuple) -> list[np.ndarray]:
    """For each piece a bit for every value: whether a query has it."""
    out = []
    for keys in tables[2]:
        there = np.zeros(1 << 24, bool)
        there[keys] = True
        out.append(np.packbits(there, bitorder="little"))
    return out


def _met(code: np.ndarray, tables: tuple, present: list[np.ndarray], most_bits: int) -> np.ndarray:
    """(own row, query row, differing bits) of pairs of which some piece differs in one bit at most, and all in most_bits at most."""
    own_pieces, found = _pieces(code), [np.zeros((0, 3), np.int64)]
    for own, keys, order, bits in zip(own_pieces, tables[2], tables[3], present, strict=True):
        probes = (own[:, None] ^ FLIPS).ravel()
        hit = np.flatnonzero(bits[probes >> 3] >> (probes & 7).astype(np.uint8) & 1)
        low = np.searchsorted(keys, probes[hit])
        width = np.searchsorted(keys, probes[hit], side="right") - low
        ends = np.cumsum(width)
        for start in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
            at = np.arange(start, min(start + PAIRS, int(ends[-1])))
            probe = np.searchsorted(ends, at, side="right")
            b = hit[probe] // len(FLIPS)
            q = order[low[probe] + at - (ends[probe] - width[probe])]
            far = np.bitwise_count(code[b] ^ tables[0][q]).sum(1, dtype=np.int64)
            near = far <= most_bits
            found.append(np.stack([b[near], q[near], far[near]], 1))
    return np.unique(np.concatenate(found), axis=0)


def _nearest(places: np.ndarray) -> np.ndarray:
    """Of the matches of two images (place, query's place, differing bits) for each place of the query the nearest in bits."""
    places = places[np.lexsort((*places[:, :4].T, places[:, 8], *places[:, 4:8].T))]
    new = np.append(True, (places[1:, 4:8] != places[:-1, 4:8]).any(1))
    return places[new]


def _by_chance(places: np.ndarray, slack: float) -> float:
    """How many of these matches may agree with a transform though they match by chance, with a margin of five: those that
    fall into a circle of slack pixels when they are spread over the area that they lie in."""
    area = np.prod(np.ptp(places[:, :2], axis=0) + 1)
    return 5 * len(places) * np.pi * slack * slack / area


def _agreeing(b: np.ndarray, q: np.ndarray, slack: float) -> int:
    """Of matched places (x, y, scale, angle; q the query's), how many agree with one similarity transform: each match's own is a guess, fitted
    to those near it and then to those that agree. slack: pixels at the corners' scale."""
    zb, zq = b[:, 0] + 1j * b[:, 1], q[:, 0] + 1j * q[:, 1]
    guess = b[:, 2] / q[:, 2] * np.exp(1j * (b[:, 3] - q[:, 3]))
    bound = slack * np.maximum(b[:, 2], 1.0)
    best = 0
    for k in range(len(b)):
        turn, shift = guess[k], zb[k] - guess[k] * zq[k]
        # the guess errs in turn and scale: the further a place is from its own, the more
        near = np.abs(turn * zq + shift - zb) <= bound + 0.35 * np.abs(turn) * np.abs(zq - zq[k])
        for _ in range(4):
            if near.sum() < 2:
                break
            mq, mb = zq[near].mean(), zb[near].mean()
            spread = (np.abs(zq[near] - mq) ** 2).sum()
            if spread == 0:
                break
            turn = (np.conj(zq[near] - mq) * (zb[near] - mb)).sum() / spread
            shift = mb - turn * mq
            near = np.abs(turn * zq + shift - zb) <= bound
        else:
            if 0.1 <= np.abs(turn) <= 10:
                best = max(best, min(len(np.unique(zq[near])), len(np.unique(zb[near]))))
                if 2 * best > len(b):  # no other transform has more
                    break
    return best


def copies(images: DataFrame, queries: DataFrame, most_bits: int = 40, least_inliers: int = 6, slack: float = 3.0) -> DataFrame:
    """images: image; queries: image. Returns query_class, class (SHA-256 of the images) and inliers, for every class of equal
    images that shows an original or copy of the query's: at least least_inliers corners of it, and more where so many match that
    some agree by chance, match and agree on one place.

    Other columns are not looked at; null and unreadable images match nothing.
    """
    spark = images.sparkSession
    digest = F.unhex(F.sha2("image", 256)).alias("class")
    asked = stored(features(queries.where("image is not null").select(digest, "image").dropDuplicates(["class"])), "features")
    # equal images are not moved to find that they are: their matches are equal
    there = features(images.where("image is not null").select(digest, "image"))
    blocks = max(1, -(-asked.count() // BLOCK_CODES))
    if blocks > 1:
        there = stored(there, "features")
    parts = []
    for k in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("key", "x", "y", "scale"), F.lit(blocks)) == k)
        sent = spark.sparkContext.broadcast(_tables(own.toArrow()))

        def match(batches, sent=sent):
            tables = sent.value
            present = _present(tables)
            for batch in batches:
                code = np.stack([batch[f"c{k}"].to_numpy(zero_copy_only=False) for k in range(4)], 1)
                place = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in ("x", "y", "scale", "angle")], 1)
                b, q, far = _met(code, tables, present, most_bits).T
                names = pa.array([tables[4][i] for i in q], pa.binary())
                places = np.concatenate([place[b], tables[1][q], far[:, None]], 1).astype(np.float32)
                yield pa.record_batch([names, batch["key"].take(pa.array(b)), pa.FixedSizeListArray.from_arrays(pa.array(places.ravel()), 9).cast(pa.list_(pa.float32()))], ["query_class", "class", "places"])

        parts.append(there.mapInArrow(match, "query_class binary, class binary, places array<float>"))
    met = parts[0]
    for more in parts[1:]:
        met = met.unionByName(more)

    def verify(column: pa.Array) -> pa.Array:
        out = []
        for p in (_nearest(np.array(x, np.float64)) for x in column.to_pylist()):
            n = _agreeing(p[:, :4], p[:, 4:8], slack)
            out.append(n if n >= least_inliers + _by_chance(p, slack) else 0)
        return pa.array(out, pa.int64())

    whole = met.groupBy("query_class", "class").agg(F.collect_set("places").alias("places")).where(F.size("places") >= least_inliers)
    return whole.select("query_class", "class", F.arrow_udf(verify, "long")("places").alias("inliers")).where(F.col("inliers") >= least_inliers)


def turned(grey: np.ndarray, degrees: float) -> np.ndarray:
    """Bilinear, about the middle; what comes from outside is the edge."""
    h, w = grey.shape
    y, x = np.mgrid[:h, :w].astype(float) - np.array([h / 2, w / 2])[:, None, None]
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    u, v = np.clip(c * x + s * y + w / 2, 0, w - 1.001), np.clip(c * y - s * x + h / 2, 0, h - 1.001)
    i, j = v.astype(int), u.astype(int)
    fy, fx = v - i, u - j
    return (grey[i, j] * (1 - fx) + grey[i, j + 1] * fx) * (1 - fy) + (grey[i + 1, j] * (1 - fx) + grey[i + 1, j + 1] * fx) * fy


#: What is done to drawn pictures.
EDITS = {
    "cropped, brighter": lambda g, rng: g[len(g) // 8 :, len(g) // 8 :] * 0.75 + 50,
    "turned": lambda g, rng: turned(g, rng.uniform(5, 355)),
    "scaled": lambda g, rng: resized(g, round(len(g) * 0.8), round(len(g[0]) * 0.8)),
    "noisy": lambda g, rng: g + rng.normal(0, 6, g.shape),
}


def rendered(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", side: int = 96, edited: bool = True) -> DataFrame:
    """id, original, edited (binary PGM) and edit for a table of vectors, where pictures are wanted and there are none: the original
    is a texture drawn from the vector's bytes, and so is which of EDITS is done to it (null unless edited)."""

    def draw(column: pa.Array) -> pa.Array:
        out = []
        for v in column.to_pylist():
            if v is None:
                out.append(None)
                continue
            rng = np.random.default_rng(np.frombuffer(np.array([x if x is not None else 0 for x in v], np.float32).tobytes() + bytes(4), np.uint32))
            grey = resized(rng.uniform(0, 255, (40, 40)), side, side) * 0.7 + resized(rng.uniform(0, 255, (12, 12)), side, side) * 0.3
            original = write_image(grey)
            if not edited:
                out.append({"original": original, "edited": None, "edit": None})
                continue
            edit = list(EDITS)[rng.integers(len(EDITS))]
            out.append({"original": original, "edited": write_image(EDITS[edit](read_image(original).astype(np.float32), rng)), "edit": edit})
        return pa.array(out, pa.struct([("original", pa.binary()), ("edited", pa.binary()), ("edit", pa.string())]))

    return vectors.select(F.col(id_column).alias("id"), F.arrow_udf(draw, "original binary, edited binary, edit string")(F.col(vector)).alias("p")).select("id", "p.*")
