"""Benchmark decontamination by latent semantic retrieval.

1. A pass counts in how many passages of the corpus each benchmark word occurs. Words in more than
   ``COMMON`` of all passages carry no weight, but every item keeps its ``OWN`` rarest words.
2. A pass sketches the Gram matrix of all passages over the words kept: Z = T'T * Omega for a
   Gaussian Omega, summed over partitions. With idf weights D, Y = D Z is the Gram matrix of TF-IDF
   times D^-1 Omega, so the randomised (Nystrom) decomposition of Y and Omega' Z gives the leading
   right singular vectors of the TF-IDF matrix.
3. A pass folds the windows of every text into that space; items whose cosine reaches ``COSINE``
   are candidates, and so are those that the window holds by ``HELD``. A candidate is confirmed on all
   words: by the longest common subsequence's share of the item's words, and of its answer's (its last
   sentence). The more of the item is reworded, the more of the answer must stand (``CONFIRM``).
   Paraphrases that reword little or insert words pass; unrelated passages share only common words.

The vocabulary is the benchmark's: its size follows the benchmark, not the corpus. Windows are
16-word blocks taken 2, 4 or 8 at a time, so that every item up to 112 words lies whole in a window
of its class; longer items are searched by overlapping pieces of 40 words, one of which any 56 words in a row hold. A window with fewer than
``SHARED`` weighted words can't hold half an item's rarest words and is not folded in.

Items that stand in a text word for word are found apart from the space, by one of their words kept;
their own words are the window, of cosine 1.

Cases: null or blank texts and items match nothing; repeated items and documents match alike, each
row for itself; an empty benchmark or corpus gives no matches; items under ``LEAST`` words are too short
for a subsequence to tell from chance and match only where they stand word for word, items without words
nowhere; very long texts are read whole; other columns are ignored (``matches``) or stay (``clean``), whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm.common import frugal, ship, small_batches
from querent.llm.names import Lookup, words

BLOCK, RANK, EXTRA = 16, 256, 8
#: Words of an item that is searched whole; of a piece of a longer one, and between the beginnings of two
#: pieces: every run of 56 words of a long item holds a whole piece.
WHOLE, PIECE, STRIDE = 112, 40, 16
SIZES = (2, 4, 8)
COMMON, OWN, SHARED = 0.005, 6, 3
COSINE = 0.5
#: Or the window's part along the item is as long as so much of the item: other words in it don't count against it.
HELD = 0.75
#: Shares of the item's words in the longest common subsequence, and what share of the answer's each asks for.
CONFIRM = ((0.9, 0.0), (0.75, 0.5), (0.5, 0.8))
LEAST = 6
#: Passages, and benchmark words in them, that are worked on at a time.
CHUNK, HITS = 20_000, 200_000


def words_of(text: str | None) -> list[int]:
    """Names of a text's words: lower-cased, parted by ASCII characters other than letters and digits."""
    return next((n.tolist() for _, n, _ in words([text])), [])


def answer_of(text: str) -> list[int]:
    """The item's last sentence of at least three words; all of it if there is none."""
    parts = [words_of(p) for p in re.split(r"(?<=[.?!:])\s+|\n", text)]
    return next((p for p in reversed(parts) if len(p) >= 3), words_of(text))


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        if m := at.get(y):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def confirms(share: float, answer: float) -> bool:
    """Whether these shares of an item and of its answer in a window show the item."""
    return any(share >= s and answer >= a for s, a in CONFIRM)


class Items:
    """The benchmark's pieces and answers, as words."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.words, self.answers = [], [], []
        for item, text in rows:
            own, answer = words_of(text), answer_of(text or "")
            if not own:
                continue
            # pieces cover every word; the last one ends at the item's end, where its answer stands
            size, last = (len(own), 0) if len(own) <= WHOLE else (PIECE, len(own) - PIECE)
            for k in [*range(0, last, STRIDE), last]:
                piece = own[k : k + size]
                self.ids.append(item)
                self.words.append(piece)
                self.answers.append(answer[-size:] if k == last else piece[-8:])
        # 0: found word for word only
        self.size = [next((s for s in SIZES if (s - 1) * BLOCK >= len(w)), SIZES[-1]) if len(w) >= LEAST else 0 for w in self.words]


def passages(batches, lookup: Lookup):
    """Ids and passage numbers of many texts at a time, and the number of passages."""
    ids, blocks, n, held = [], [], 0, 0
    for b in batches:
        for _, names, bounds in words(b.column(0).to_pylist()):
            own, at = lookup.find(names)
            count = -(-np.diff(bounds) // (4 * BLOCK))
            text = np.searchsorted(bounds, at, "right") - 1
            ids.append(own)
            blocks.append(n + (np.cumsum(count) - count)[text] + (at - bounds[text]) // (4 * BLOCK))
            n += int(count.sum())
            held += len(own)
            if held > HITS or n > CHUNK:
                yield np.concatenate(ids), np.concatenate(blocks), n
                ids, blocks, n, held = [], [], 0, 0
    yield np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate([np.zeros(0, np.int64), *blocks]), n


def fold(vectors: np.ndarray, ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of the vectors of token ranges [a, b): first tokens of all, second tokens, and so on."""
    order = np.argsort(a - b, kind="stable")
    begin, counts = a[order], (b - a)[order]
    total = np.zeros((len(a), vectors.shape[1]), np.float32)
    for k in range(int(counts[0]) if len(counts) else 0):
        m = np.searchsorted(-counts, -k)
        total[:m] += vectors[ids[begin[:m] + k]]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return total[back]


def frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many passages each word occurs, and the number of passages, over the whole corpus."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of the benchmark's size

    def run(batches):
        known = sent.value
        v, n = len(known), 0
        df = np.zeros(v, np.int64)
        for ids, blk, more in passages(batches, Lookup(known)):
            df += np.bincount(np.unique(blk * v + ids) % v, minlength=v) if len(ids) else 0
            n += more
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *used.tolist()], pa.int32()), pa.array([n, *df[used].tolist()], pa.int64())], ["term", "n"])

    counts = {r.term: r.n for r in docs.select("text").mapInArrow(frugal(run), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return np.array([counts.get(i, 0) for i in range(len(vocabulary))]), counts.get(-1, 0)


def sketch(docs: DataFrame, vocabulary: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Omega and Z over the whole corpus. Each partition sends a row a word; rows of a word add up."""
    spark = docs.sparkSession
    width = RANK + EXTRA
    sent = spark.sparkContext.broadcast(vocabulary)

    def gaussian() -> np.ndarray:
        return np.random.default_rng(seed).standard_normal((width, len(sent.value)))

    def run(batches):
        known = sent.value
        om = np.ascontiguousarray(gaussian().T, np.float32)
        z = np.zeros(om.shape)
        for ids, blk, _ in passages(batches, Lookup(known)):
            if len(ids):
                edges = np.flatnonzero(np.r_[True, blk[1:] != blk[:-1], True])
                sums = fold(om, ids, edges[:-1], edges[1:])  # T Omega: a row a passage
                row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
                order = np.argsort(ids, kind="stable")
                word = ids[order]
                edges = np.flatnonzero(np.r_[True, word[1:] != word[:-1], True])
                z[word[edges[:-1]]] += fold(sums, row[order], edges[:-1], edges[1:])
        used = np.flatnonzero(z.any(1))
        flat = z[used].astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([r.tobytes() for r in flat], pa.binary())], ["term", "z"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for term, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                row = np.frombuffer(z, np.float32).astype(float)
                total[term] = total[term] + row if term in total else row
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([r.tobytes() for r in total.values()], pa.binary())], ["term", "z"])

    z = np.zeros((len(vocabulary), width))
    made = docs.select("text").mapInArrow(frugal(run), "term int, z binary").repartition("term").mapInArrow(frugal(add), "term int, z binary")
    for r in made.toLocalIterator():  # a row a word of the benchmark
        z[r.term] = np.frombuffer(bytes(r.z))
    return gaussian(), z


def space(df: np.ndarray, z: np.ndarray, n: int, omega: np.ndarray) -> np.ndarray:
    """Word vectors: idf times right singular vectors of the passages' TF-IDF matrix."""
    idf = np.log((1 + n) / (1 + df)) + 0.05
    y = idf[:, None] * z
    core = omega @ z
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > max(values.max(initial=0), 1e-12) * 1e-9
    left, sigma, _ = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    rank = min(RANK, int((sigma > 1e-9).sum()))
    return (idf[:, None] * left[:, :rank]).astype(np.float32)


def windows(ids: np.ndarray, block: np.ndarray, size: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token ranges [a, b) of the windows of ``size`` blocks with enough tokens, and the blocks
    [low, high) that windows of an equal range span. ``block`` is ascending, below n."""
    ends = np.arange(1, n + 1)
    a, b = np.searchsorted(block, ends - size), np.searchsorted(block, ends)
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:] - 1, n - 1] if n else first
    good = b[first] - a[first] >= SHARED
    first, last = first[good], last[good]
    return a[first], b[first], np.maximum(first + 1 - size, 0), last + 1


def _anchor(lookup: Lookup, own: list[int], weight: np.ndarray) -> tuple[int, int]:
    """The word kept that weighs most, and its first place in the piece."""
    ids, at = lookup.find(np.array(own, np.uint64))
    best = int(np.argmax(weight[ids]))
    return int(ids[best]), int(at[best])


def finder(items: Items, lookup: Lookup, vectors: np.ndarray):
    """A function from texts to ``{(text's index, item_id): (lcs share, answer share, cosine)}``."""
    sums = np.stack([vectors[lookup.find(np.array(own, np.uint64))[0]].sum(0) for own in items.words])
    length = np.linalg.norm(sums, axis=1)
    sums = (sums / np.maximum(length[:, None], 1e-9)).astype(np.float32)
    least = np.maximum(HELD * length, 1e-6).astype(np.float32)
    # verbatim pieces are found by the word kept that is rarest by weight, whatever their cosine
    weight = np.linalg.norm(vectors, axis=1)
    anchor_id, anchor_at = (np.array(x) for x in zip(*[_anchor(lookup, own, weight) for own in items.words], strict=True))
    by_id = np.argsort(anchor_id, kind="stable")
    sizes = np.array([len(own) for own in items.words])
    ends = np.array([[own[0], own[-1]] for own in items.words], np.uint64)
    wholes = [np.array(own, np.uint64) for own in items.words]

    def verbatim(names: np.ndarray, bounds: np.ndarray, ids: np.ndarray, at: np.ndarray):
        """Texts and pieces whose words stand in the text one after the other."""
        low, high = np.searchsorted(anchor_id[by_id], ids), np.searchsorted(anchor_id[by_id], ids, "right")
        n = high - low
        k = by_id[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        begin = np.repeat(at, n) - anchor_at[k]
        end = begin + sizes[k]
        j = np.searchsorted(bounds, np.repeat(at, n), "right") - 1
        ok = (begin >= bounds[j]) & (end <= bounds[j + 1])
        k, begin, end, j = k[ok], begin[ok], end[ok], j[ok]
        ok = (names[begin] == ends[k, 0]) & (names[end - 1] == ends[k, 1])
        for x, lo, hi, text in zip(k[ok].tolist(), begin[ok].tolist(), end[ok].tolist(), j[ok].tolist(), strict=True):
            if np.array_equal(names[lo:hi], wholes[x]):
                yield text, items.ids[x], 1.0, lcs(items.answers[x], items.words[x]) / len(items.answers[x]), 1.0

    of = {s: own for s in SIZES if len(own := np.array([k for k, x in enumerate(items.size) if x == s]))}

    def confirmed(names: np.ndarray, bounds: np.ndarray):
        """Confirmed windows of some texts. Blocks of different texts lie apart."""
        ids, at = lookup.find(names)
        yield from verbatim(names, bounds, ids, at)
        count = -(-np.diff(bounds) // BLOCK) + SIZES[-1]
        starts, n = np.cumsum(count) - count, int(count.sum())
        text = np.searchsorted(bounds, at, "right") - 1
        block = starts[text] + (at - bounds[text]) // BLOCK
        for size, own in of.items():
            a, b, low, high = windows(ids, block, size, n)
            for part in range(0, len(a), 20_000):
                s = slice(part, part + 20_000)
                window = fold(vectors, ids, a[s], b[s])
                norm = np.sqrt(np.einsum("ij,ij->i", window, window))
                cos = window @ sums[own].T
                rows, cols = np.nonzero(cos >= np.minimum(np.maximum(COSINE * norm, 1e-6)[:, None], least[own]))
                for r, c in zip(rows.tolist(), cols.tolist(), strict=True):
                    k, j = int(own[c]), int(text[a[part + r]])
                    lo, hi = max(0, int(low[part + r] - starts[j])), int(high[part + r] - starts[j])
                    found = names[bounds[j] + lo * BLOCK : min(bounds[j] + hi * BLOCK, bounds[j + 1])].tolist()
                    if sum(map(set(found).__contains__, items.words[k])) < CONFIRM[-1][0] * len(items.words[k]):
                        continue  # no subsequence can be longer
                    share = lcs(items.words[k], found) / len(items.words[k])
                    if share >= CONFIRM[-1][0]:
                        answer = lcs(items.answers[k], found) / len(items.answers[k])
                        if confirms(share, answer):
                            yield j, items.ids[k], share, answer, float(cos[r, c] / norm[r])

    def find(texts: list[str | None]) -> dict[tuple[int, int], tuple]:
        best: dict[tuple[int, int], tuple] = {}
        for first, names, bounds in words(texts):
            for j, item, *found in confirmed(names, bounds):
                best[first + j, item] = max(best.get((first + j, item), ()), tuple(found))
        return best

    return find


MATCH = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double"


def model(docs: DataFrame, benchmark: DataFrame, seed: int = 5) -> tuple[Items, Lookup, np.ndarray] | None:
    """The benchmark's items and the latent space of the whole corpus; None without items.

    The benchmark is read on the driver: it is an evaluation set, small by its nature and apart
    from the corpus's growth."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    items = Items([(r.item_id, r.text) for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator()])
    if not items.words:
        return None
    every = sorted({w for piece in items.words for w in piece})
    df, n = frequencies(docs, np.array(every, np.uint64))
    count = dict(zip(every, df.tolist(), strict=True))
    kept = {w for w in every if count[w] <= COMMON * n}
    for piece in items.words:
        kept |= set(sorted(set(piece), key=lambda w: (count[w], w))[:OWN])
    vocabulary = np.array(sorted(kept), np.uint64)
    omega, z = sketch(docs, vocabulary, seed)
    return items, Lookup(vocabulary), space(np.array([count[w] for w in sorted(kept)]), z, n, omega)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, cosine, lcs_share, answer_share``: contaminated documents with the items
    that they hold, the best confirmed window of each pair."""
    made = model(docs, benchmark)
    if made is None:
        return docs.sparkSession.createDataFrame([], MATCH)
    sent = docs.sparkSession.sparkContext.broadcast(made)  # of the benchmark's size

    def run(batches):
        find = finder(*sent.value)
        for b in batches:
            ids, best = b.column("doc_id").to_pylist(), find(b.column("text").to_pylist())
            keys = sorted(best)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[j] for j, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.int64()), *[pa.array([best[k][x] for k in keys], pa.float64()) for x in (2, 0, 1)]],
                ["doc_id", "item_id", "cosine", "lcs_share", "answer_share"],
            )

    return docs.select("doc_id", "text").mapInArrow(frugal(run), MATCH)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns as they are."""
    made = model(docs, benchmark)
    if made is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(made)  # of the benchmark's size

    def run(batches):
        find = finder(*sent.value)
        for b in batches:
            dirty = {j for j, _ in find(b.column("text").to_pylist())}
            yield b.filter(pa.array([i not in dirty for i in range(b.num_rows)], pa.bool_()))

    return docs.mapInArrow(frugal(run), docs.schema)
