"""Copies among images by local descriptors.

Each image is searched for FAST corners on several scales; a corner's patch is turned by its
intensity centroid and binary tests in the turned patch make a 128-bit descriptor. Descriptors go
to Hamming tables: those that agree on a table's bits meet in a bucket. Matching descriptors
(Hamming distance at most ``NEAR``) vote, by the similarity transform they imply, and images whose
votes agree on one transform are copies, cropped, scaled, turned or edited alike.

Equal images are one image before any table (by digest of their pixels). All images of a bucket meet
in pairs, large buckets in tiles; each pair is one candidate however many buckets it shares. Candidate
pairs are packed by the two parts of all images that they lie in, so a descriptor goes once to each
pair of parts that needs it, not to each pair of images. There every candidate is verified but those
that verified links have joined already, so a group of n copies costs about n verifications and sends
the links of a spanning forest. Components of these: a row per image with its class.

Random likeness of two patches grows with the square of the images, at a rate set by ``TABLE_BITS``;
what it costs is verification, never a result.

Cases: an image that can't be decoded, is null, or has under ``LEAST`` corners can only equal others
exactly; nulls in ids are dropped; repeated rows share a class, and of rows of one
id each keeps its own image's class; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm.common import cut, release, ship, small_batches
from querent.llm.components import components
from querent.llm.simhash import dealt

#: Scales are close to each other, so that descriptors of a copy of any size differ in few bits and keys can be long.
SCALES, CORNERS = tuple(1.118**-k for k in range(7)), 14
#: Half a patch's side, and what a turned patch and its smoothing reach.
PATCH, RADIUS = 9, 14
THRESHOLD, ARC = 12, 9
BITS, TABLES, TABLE_BITS = 128, 2, 45
#: Hamming distance of matching descriptors; matching places that agree on a transform; corners needed; a place's side.
NEAR, AGREE, LEAST, PLACE = 24, 8, 6, 6
#: Matches of a pair up to which pairs are verified many at once.
MATCHES = 128
#: Images are in ``CELLS`` parts, or more of ``CELL`` images; pairs of two parts are verified together, packed by ``PAIRS``.
CELLS, CELL, PAIRS = 3, 20_000, 200_000

_CIRCLE = [(0, -3), (1, -3), (2, -2), (3, -1), (3, 0), (3, 1), (2, 2), (1, 3), (0, 3), (-1, 3), (-2, 2), (-3, 1), (-3, 0), (-3, -1), (-2, -2), (-1, -3)]
_RNG = np.random.default_rng(20)
_TESTS = np.clip(np.round(_RNG.normal(0, PATCH / 1.8, (BITS, 4))), -PATCH, PATCH)
_SHUFFLED = np.concatenate([_RNG.permutation(BITS) for _ in range(-(-TABLES * TABLE_BITS // BITS))])
_CHOSEN = np.stack([_SHUFFLED[t * TABLE_BITS : (t + 1) * TABLE_BITS] for t in range(TABLES)])  # disjoint while bits last
_YY, _XX = np.mgrid[-PATCH : PATCH + 1, -PATCH : PATCH + 1]
_DISC = (_XX**2 + _YY**2) <= PATCH**2


def encode(image: np.ndarray) -> bytes:
    """A grey image as bytes: portable graymap, deflated."""
    h, w = image.shape
    return zlib.compress(b"P5 %d %d 255\n" % (w, h) + np.ascontiguousarray(image, np.uint8).tobytes(), 1)


def decode(data: bytes | None) -> np.ndarray | None:
    try:
        head, _, body = zlib.decompress(data).partition(b"\n")
        kind, w, h, top = head.split()
        return np.frombuffer(body, np.uint8).reshape(int(h), int(w)) if (kind, top) == (b"P5", b"255") else None
    except (TypeError, ValueError, zlib.error):
        return None


def patterns(side: int, seed: int = 3) -> np.ndarray:
    """64 fixed patterns: noise with the 1/f spectrum of natural images, so that every scale has corners."""
    f = np.hypot(*np.meshgrid(np.fft.fftfreq(side), np.fft.fftfreq(side)))
    weight = np.where(f > 0, np.exp(-((f / 0.22) ** 4)) / np.maximum(f, 1 / side), 0)
    noise = np.fft.ifft2(np.fft.fft2(np.random.default_rng(seed).standard_normal((64, side, side))) * weight).real
    return noise / noise.std((1, 2), keepdims=True)


_PATTERNS = patterns(96)


def render(vector: list[float] | None) -> np.ndarray:
    """A grey image of a vector: its values weigh 64 fixed patterns, so that images have
    corners of their own and near vectors have near images. A null or zero vector is plain grey."""
    v = np.zeros(64)
    if vector is not None:
        given = np.nan_to_num(np.array([x if x is not None else 0.0 for x in vector], float)[:64])
        v[: len(given)] = given
    v /= max(np.linalg.norm(v), 1e-12)
    return np.round(128 + 50 * np.tensordot(v, _PATTERNS, 1)).clip(0, 255).astype(np.uint8)


def _sampled(im: np.ndarray, scale: float, dy: float, dx: float) -> np.ndarray:
    """Bilinear samples, each moved by a part of a target pixel."""

    def along(side: int, move: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(max(1, int(side * scale))) + 0.5 + move) / scale - 0.5, 0, side - 1)
        low = at.astype(int)
        return low, np.minimum(low + 1, side - 1), (at - low).astype(np.float32)

    (y0, y1, fy), (x0, x1, fx) = along(im.shape[0], dy), along(im.shape[1], dx)
    rows = im[y0] * (1 - fy[:, None]) + im[y1] * fy[:, None]
    return rows[:, x0] * (1 - fx) + rows[:, x1] * fx


def resize(image: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear; a pixel of a smaller image is the mean of four samples."""
    im = image.astype(np.float32)
    if scale >= 1:
        return _sampled(im, scale, 0, 0)
    return sum(_sampled(im, scale, dy, dx) for dy in (-0.25, 0.25) for dx in (-0.25, 0.25)) / 4


def corners(im: np.ndarray) -> np.ndarray:
    """y, x of the strongest FAST corners, away from the border, none beside a stronger one."""
    b = RADIUS + 1
    h, w = im.shape
    if h <= 2 * b or w <= 2 * b:
        return np.zeros((0, 2), int)
    mid = im[b : h - b, b : w - b]
    ring = np.stack([im[b + dy : h - b + dy, b + dx : w - b + dx] for dx, dy in _CIRCLE]) - mid
    score = np.zeros(mid.shape, np.float32)
    for side in (ring > THRESHOLD, ring < -THRESHOLD):
        twice = np.concatenate([side, side[: ARC - 1]])
        run = twice[: len(_CIRCLE)].copy()
        for k in range(1, ARC):
            run &= twice[k : k + len(_CIRCLE)]
        score = np.maximum(score, run.any(0) * np.abs(ring).sum(0))
    padded = np.pad(score, 1)
    around = np.max([padded[1 + dy : 1 + dy + mid.shape[0], 1 + dx : 1 + dx + mid.shape[1]] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)], axis=0)
    y, x = np.nonzero((score > 0) & (score >= around))
    best = np.lexsort((x, y, -score[y, x]))[:CORNERS]
    return np.stack([y[best], x[best]], 1) + b


def describe(image: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Key points (x, y in the image, scale, angle) and packed descriptors."""
    points, codes = [], []
    if image is None:
        return np.zeros((0, 4), np.float32), np.zeros((0, BITS // 8), np.uint8)
    for scale in SCALES:
        im = resize(image, scale) if scale != 1 else image.astype(np.float32)
        at = corners(im)
        if not len(at):
            continue
        smooth = sum(np.roll(im, d, 0) for d in (-1, 0, 1))
        smooth = sum(np.roll(smooth, d, 1) for d in (-1, 0, 1)) / 9
        patch = smooth[at[:, 0, None, None] + _YY, at[:, 1, None, None] + _XX] * _DISC
        angle = np.arctan2((patch * _YY).sum((1, 2)), (patch * _XX).sum((1, 2)))
        c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]

        def value(dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
            x, y = np.round(c * dx - s * dy).astype(int), np.round(s * dx + c * dy).astype(int)
            return smooth[at[:, 0, None] + y, at[:, 1, None] + x]

        bits = value(_TESTS[:, 0], _TESTS[:, 1]) < value(_TESTS[:, 2], _TESTS[:, 3])
        codes.append(np.packbits(bits, axis=1))
        points.append(np.stack([at[:, 1] / scale, at[:, 0] / scale, np.full(len(at), 1 / scale), angle], 1).astype(np.float32))
    if not points:
        return np.zeros((0, 4), np.float32), np.zeros((0, BITS // 8), np.uint8)
    return np.concatenate(points), np.concatenate(codes)


def table_keys(codes: np.ndarray) -> np.ndarray:
    """One 64-bit key a descriptor and table: the table's chosen bits, mixed with its number."""
    bits = np.unpackbits(codes, axis=1)
    blank = np.zeros((len(codes), 64 - TABLE_BITS), np.uint8)
    mixed = [(np.packbits(np.concatenate([bits[:, chosen], blank], 1), axis=1).view(np.uint64)[:, 0] ^ np.uint64(t << 56)) * np.uint64(0x9E3779B97F4A7C15) for t, chosen in enumerate(_CHOSEN)]
    return np.concatenate(mixed).view(np.int64) if len(codes) else np.zeros(0, np.int64)


def consensus(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Places of two images that match and agree on one similarity transform, of the first transform with
    ``AGREE`` of them, or of the best one; 0 if under ``AGREE`` match."""
    (pa_, ca), (pb, cb) = a, b
    if len(ca) < LEAST or len(cb) < LEAST:
        return 0
    wide = [np.ascontiguousarray(c).view(np.uint64) for c in (ca, cb)]
    distance = sum(np.bitwise_count(a[:, None] ^ b[None]) for a, b in zip(wide[0].T, wide[1].T, strict=True))
    near = distance <= NEAR
    if near.any(1).sum() < AGREE:
        return 0
    i, j = np.nonzero(near & (distance == distance.min(1, keepdims=True)))
    scale = pb[j, 2] / pa_[i, 2]
    turn = pb[j, 3] - pa_[i, 3]
    c, s = scale * np.cos(turn), scale * np.sin(turn)
    tx, ty = pb[j, 0] - (c * pa_[i, 0] - s * pa_[i, 1]), pb[j, 1] - (s * pa_[i, 0] + c * pa_[i, 1])
    # corners of several scales at one place count once: a likeness of one place is not a copy
    places = [np.unique(p[m, :2] // PLACE @ (1, 10_000), return_inverse=True)[1] for p, m in ((pa_, i), (pb, j))]
    best = 0
    for k in range(0, len(i), 8):  # every match proposes, until one has enough to agree
        x = c[k : k + 8, None] * pa_[i, 0] - s[k : k + 8, None] * pa_[i, 1] + tx[k : k + 8, None]
        y = s[k : k + 8, None] * pa_[i, 0] + c[k : k + 8, None] * pa_[i, 1] + ty[k : k + 8, None]
        inside = (x - pb[j, 0]) ** 2 + (y - pb[j, 1]) ** 2 <= 9
        for own in inside[inside.sum(1) >= AGREE]:
            best = max(best, min(len(set(q[own].tolist())) for q in places))
        if best >= AGREE:
            break
    return best


def render_table(vectors: DataFrame) -> DataFrame:
    """``image_id, image``: every row's vector as an image, for tables without a media column."""
    ship(vectors.sparkSession)
    small_batches(vectors.sparkSession)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([encode(render(v)) for v in b.column("embedding").to_pylist()], pa.binary())], ["image_id", "image"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "image_id long, image binary")


def _pack(points: np.ndarray) -> bytes:
    """Key points in six bytes each: place, scale and angle in steps."""
    out = np.zeros(len(points), np.dtype([("x", "<u2"), ("y", "<u2"), ("s", "u1"), ("a", "i1")]))
    if len(points):
        out["x"], out["y"] = np.round(points[:, 0] * 8), np.round(points[:, 1] * 8)
        out["s"], out["a"] = np.round(points[:, 2] * 64), np.round(points[:, 3] * 127 / np.pi)
    return out.tobytes()


def _unpack(points: bytes, codes: bytes) -> tuple[np.ndarray, np.ndarray]:
    p = np.frombuffer(points, np.dtype([("x", "<u2"), ("y", "<u2"), ("s", "u1"), ("a", "i1")]))
    return np.stack([p["x"] / 8, p["y"] / 8, p["s"] / 64, p["a"] * np.pi / 127], 1).astype(np.float32), np.frombuffer(codes, np.uint8).reshape(-1, BITS // 8)


def _places(points: np.ndarray) -> np.ndarray:
    """A number of the place of each key point."""
    return points[:, :2] // PLACE @ (1, 10_000)


def agreeing(x: tuple[np.ndarray, np.ndarray], others: list[tuple[np.ndarray, np.ndarray]], first: list[bool]) -> np.ndarray:
    """Whether ``consensus`` of an image and each of the others reaches ``AGREE``, for many at once; ``first``:
    whether the image comes before the other. Pairs of over ``MATCHES`` matches go to ``consensus`` itself."""
    points, codes = x
    n = [len(c) for _, c in others]
    starts, owner = np.cumsum([0, *n[:-1]]), np.repeat(np.arange(len(n)), n)
    theirs, many = np.concatenate([p for p, _ in others]), np.concatenate([c for _, c in others])
    distance = np.zeros((len(codes), len(many)), np.uint8)
    for a, b in zip(*[np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint64).T) for c in (codes, many)], strict=True):
        for k in range(0, len(a), 8):  # as much as a core's cache holds
            distance[k : k + 8] += np.bitwise_count(a[k : k + 8, None] ^ b)
    near = distance <= NEAR
    at = _places(points)
    hit = np.logical_or.reduceat(near, starts, axis=1).astype(np.float32)
    may = ((np.unique(at)[:, None] == at).astype(np.float32) @ hit > 0).sum(0) >= AGREE  # matches at enough places, wherever
    before = np.array(first)
    i, j = np.divmod(np.flatnonzero(near & may[owner]), len(many))
    o = owner[j]
    least = np.where(before[o], np.minimum.reduceat(distance, starts, axis=1)[i, o], distance.min(0)[j])
    own = distance[i, j] == least
    i, j, o = i[own], j[own], o[own]
    size = np.bincount(o, minlength=len(n))
    out = np.zeros(len(n), bool)
    for k in np.flatnonzero(size > MATCHES).tolist():
        out[k] = (consensus(x, others[k]) if first[k] else consensus(others[k], x)) >= AGREE
    use = np.flatnonzero(((size >= AGREE) & (size <= MATCHES))[o])
    use = use[np.argsort(o[use], kind="stable")]
    if not len(use):
        return out
    i, j, o = i[use], j[use], o[use]
    swap = ~before[o, None]
    mine, other = points[i], theirs[j]
    small, large = np.where(swap, other, mine), np.where(swap, mine, other)
    scale, turn = large[:, 2] / small[:, 2], large[:, 3] - small[:, 3]
    c, s = scale * np.cos(turn), scale * np.sin(turn)
    tx, ty = large[:, 0] - (c * small[:, 0] - s * small[:, 1]), large[:, 1] - (s * small[:, 0] + c * small[:, 1])
    # every match proposes to all matches of its pair
    many = size[o]
    rep = np.repeat(np.arange(len(o)), many)
    to = np.arange(len(rep)) - np.repeat(np.cumsum(many) - many - np.searchsorted(o, o), many)
    sx, sy, lx, ly = (np.ascontiguousarray(v)[to] for v in (small[:, 0], small[:, 1], large[:, 0], large[:, 1]))
    cr, sr = c[rep], s[rep]
    inside = np.flatnonzero((cr * sx - sr * sy + tx[rep] - lx) ** 2 + (sr * sx + cr * sy + ty[rep] - ly) ** 2 <= 9)
    inside = inside[(np.bincount(rep[inside], minlength=len(o)) >= AGREE)[rep[inside]]]
    rep, to = rep[inside], to[inside]
    if not len(rep):
        return out
    begin = np.flatnonzero(np.r_[True, rep[1:] != rep[:-1]])
    agreed = np.full(len(begin), len(at) + len(theirs))
    for p in (small, large):  # distinct places of a proposal, as bits
        places, which = np.unique(o * (1 << 40) + _places(p).astype(np.int64), return_inverse=True)
        rank = (which - np.searchsorted(places, o * (1 << 40)))[to]
        words = [np.where(rank // 64 == w, np.uint64(1) << (rank % 64).astype(np.uint64), np.uint64(0)) for w in range(rank.max() // 64 + 1)]
        agreed = np.minimum(agreed, sum(np.bitwise_count(np.bitwise_or.reduceat(w, begin)).astype(int) for w in words))
    out[o[rep[begin[agreed >= AGREE]]]] = True
    return out


def _part(v: np.ndarray, parts: int) -> np.ndarray:
    """Which of the parts of all images an image is in."""
    return ((v.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def copies(images: DataFrame) -> DataFrame:
    """``image_id, class_id, n_corners`` of every image; class: smallest id among its copies."""
    spark = images.sparkSession
    ship(spark)
    small_batches(spark)

    def run(batches):
        for b in batches:
            made = [describe(decode(x)) for x in b.column("image").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("image_id"), b.column("pixels"), pa.array([_pack(p) for p, _ in made], pa.binary()), pa.array([c.tobytes() for _, c in made], pa.binary())], ["image_id", "pixels", "points", "codes"])

    digest = F.unhex(F.sha2(F.coalesce("image", F.lit(b"")), 256)).alias("pixels")
    own = images.filter("image_id is not null").select("image_id", digest, "image")
    made = own.mapInArrow(run, "image_id long, pixels binary, points binary, codes binary")
    described = cut(made.groupBy("pixels").agg(F.min_by(F.struct("points", "codes"), "image_id").alias("x"), F.min("image_id").alias("v")).select("pixels", "v", "x.points", "x.codes"))

    def keys(batches):
        for b in batches:
            made = [np.unique(table_keys(np.frombuffer(c, np.uint8).reshape(-1, BITS // 8))) for c in b.column("codes").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("v").to_numpy(), [len(k) for k in made])), pa.array(np.concatenate([np.zeros(0, np.int64), *made]))], ["v", "key"])

    keyed = described.filter(F.length("codes") >= LEAST * BITS // 8).select("v", "codes").mapInArrow(keys, "v long, key long")
    cells = max(CELLS, -(-described.count() // CELL))
    met = dealt(keyed.select(F.col("v").alias("fp"), F.lit(0).alias("m"), F.col("key").alias("k")))

    def pair(batches):
        def packed(parts: list[np.ndarray]):
            a, b = np.unique(np.concatenate(parts), axis=0).T
            ga, gb = _part(a, cells), _part(b, cells)
            a, b = np.where(ga <= gb, a, b), np.where(ga <= gb, b, a)
            cell = np.minimum(ga, gb) * cells + np.maximum(ga, gb)
            order = np.argsort(cell, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(cell[order]) != 0, True])
            rows = np.stack([a, b], 1)[order]
            yield pa.RecordBatch.from_arrays([pa.array(cell[order][edges[:-1]]), pa.array([rows[lo:hi].tobytes() for lo, hi in zip(edges, edges[1:], strict=False)], pa.binary())], ["cell", "pairs"])

        parts, held = [], 0
        for batch in batches:
            values = batch.column(0)
            flat, offsets = values.values.field("fp").to_numpy(), values.offsets.to_numpy()
            for lo, hi in zip(offsets, offsets[1:], strict=False):
                own = np.sort(flat[lo:hi])
                for k in range(len(own) - 1):
                    parts.append(np.stack([np.full(len(own) - k - 1, own[k]), own[k + 1 :]], 1))
                    held += len(own) - k - 1
                    if held >= PAIRS:
                        yield from packed(parts)
                        parts, held = [], 0
        if parts:
            yield from packed(parts)

    def sent(batches):
        for batch in batches:
            own = _part(batch.column("v").to_numpy(), cells)
            for k in range(cells):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(own, k) * cells + np.maximum(own, k)), *batch.columns], ["cell", "v", "points", "codes"])

    def verify(batches):
        def linked(pairs: list[bytes], own: dict):
            both = np.unique(np.frombuffer(b"".join(pairs), np.int64).reshape(-1, 2), axis=0)
            edges = np.flatnonzero(np.r_[True, both[1:, 0] != both[:-1, 0], True])
            to, tree = {}, []

            def top(v: int) -> int:
                while (up := to.get(v, v)) != v:
                    to[v] = v = to.get(up, up)
                return v

            for lo, hi in zip(edges, edges[1:], strict=False):
                a = int(both[lo, 0])
                x = _unpack(*own[a])
                for k in range(lo, hi, 64):
                    others = [b for b in both[k : min(hi, k + 64), 1].tolist() if top(a) != top(b)]  # the rest is linked already
                    held = agreeing(x, [_unpack(*own[b]) for b in others], [a < b for b in others]).tolist() if others else []
                    for b, agrees in zip(others, held, strict=True):
                        if agrees and top(a) != top(b):
                            to[top(a)] = top(b)
                            tree.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in tree], pa.int64()) for k in range(2)], ["a", "b"])

        at, own, pairs = None, {}, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["cell"] != at:
                    if pairs:
                        yield from linked(pairs, own)
                    at, own, pairs = r["cell"], {}, []
                if r["pairs"] is None:
                    own[r["v"]] = r["points"], r["codes"]
                else:
                    pairs.append(r["pairs"])
        if pairs:
            yield from linked(pairs, own)

    pairs = cut(met.mapInArrow(pair, "cell long, pairs binary"))
    del met, keyed, made
    release(spark)  # the tables' rows are read no more
    # an image's descriptors once to each cell of its part, however many pairs it is in there; cells without pairs need none
    spread = described.filter(F.length("codes") >= LEAST * BITS // 8).select("v", "points", "codes").mapInArrow(sent, "cell long, v long, points binary, codes binary")
    sides = spread.join(F.broadcast(pairs.select("cell").distinct()), "cell", "left_semi").select("cell", "v", "points", "codes", F.lit(None).cast("binary").alias("pairs"))
    lists = pairs.select("cell", F.lit(None).cast("long").alias("v"), F.lit(None).cast("binary").alias("points"), F.lit(None).cast("binary").alias("codes"), "pairs")
    # a stated number of ranges, several a cell: few bytes here are much work, and a hash would put some cells together
    links = sides.unionAll(lists).repartitionByRange(2 * cells * (cells + 1), "cell").sortWithinPartitions("cell", F.col("pairs").isNotNull()).mapInArrow(verify, "a long, b long")
    roots = components(links)
    placed = described.select("pixels", "v", (F.length("codes") / (BITS // 8)).cast("long").alias("n_corners")).join(roots, F.col("v") == F.col("vertex"), "left")
    placed = cut(placed.select("pixels", "v", "n_corners", F.coalesce("root", "v").alias("root")))
    named = placed.join(placed.groupBy("root").agg(F.min("v").alias("class_id")), "root").select("pixels", "class_id", "n_corners")
    return own.select("image_id", "pixels").join(named, "pixels").select("image_id", "class_id", "n_corners")
