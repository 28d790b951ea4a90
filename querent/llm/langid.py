"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds labelled text. A text is parsed greedily into the fewest
phrases that occur in that text: each phrase is a longest match, read off the automaton. Phrases
times the bits that name a phrase (log2 of the training length), a character, estimate the cross
entropy; the language with the least wins, ties going to the smaller name.

Texts are lower-cased; every letter of the labelled text stands for itself in all languages, letters
seen nowhere for one symbol that no automaton knows, any other character for a separator. Texts are
stepped through in segments, all segments of a batch at once as arrays. A segment is first parsed as
if a phrase began there, then its head again from where the segment before really ends; both parses
meet after a few phrases, or else the whole segment is parsed again. So the phrases are those of the whole text.

The labelled sample is bounded: ``SAMPLE_DOCS`` documents a language at most, by hash order, shorter
than ``SAMPLE_LONG`` characters first, and no further document once ``SAMPLE_CHARS`` are reached.

Cases: a null text, or one without letters, is ``und`` with score 0; null languages teach nothing;
repeated rows get equal answers; without any labelled text all is ``und``; an empty table gives no rows; very long
texts are read whole, some segments at a time; extra columns are kept, but for those named like the output.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from querent.llm.common import ship, small_batches

SAMPLE_DOCS, SAMPLE_LONG, SAMPLE_CHARS = 60, 8_000, 40_000
#: Characters of a segment, and of its head.
SEGMENT, HEAD = 512, 64


def sample(docs: DataFrame, use: Column) -> dict[str, str]:
    """The bounded labelled sample, joined a language."""
    order = Window.partitionBy("lang").orderBy(F.length("text") > SAMPLE_LONG, F.xxhash64("doc_id"), "doc_id", "text")
    rows = docs.filter(use & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    rows = rows.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= SAMPLE_DOCS).orderBy("lang", "k").collect()
    out: dict[str, list[str]] = {}
    for r in rows:
        kept = out.setdefault(r.lang, [])
        if not kept or sum(map(len, kept)) + len(r.text) <= SAMPLE_CHARS:
            kept.append(r.text)
    return {k: "\n".join(v) for k, v in out.items() if any(map(str.isalpha, "".join(v)))}


def automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton of a code sequence."""
    to, link, length, last = [{}], [-1], [0], 0
    for c in codes.tolist():
        cur = len(to)
        to.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = cur
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(to)
                to.append(dict(to[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return to


def packed(to: list[dict[int, int]], symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of transitions laid over each other: state s goes by symbol c to ``follow[base[s] + c]`` if
    ``owner[base[s] + c]`` is s, and nowhere if not."""
    room = 4 * sum(map(len, to)) + 2 * symbols
    taken, base = bytearray(room + symbols), [0] * len(to)
    owner, follow = np.full(room + symbols, -1, np.int32), np.zeros(room + symbols, np.int32)
    rng = np.random.default_rng(0)
    tries = iter(())
    for s in sorted(range(len(to)), key=lambda s: -len(to[s])):
        own = to[s]
        while True:
            b = next(tries, None)
            if b is None:
                tries = iter(rng.integers(0, room, 1 << 16).tolist())
            elif not any(taken[b + c] for c in own):
                break
        base[s] = b
        for c, q in own.items():
            taken[b + c] = 1
            owner[b + c], follow[b + c] = s, q
    return np.array(base, np.int32), owner, follow


class Parser:
    """Automata of all languages in one set of arrays; states and places are numbered through."""

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        self.alphabetic = np.fromiter((chr(p).isalpha() if not 0xD800 <= p < 0xE000 else False for p in range(0x110000)), bool, 0x110000)
        letters = sorted({ch for t in texts.values() for ch in t.lower() if ch.isalpha()})
        symbols = len(letters) + 2  # separator, letters, unknown letters
        self.code = np.where(self.alphabetic, symbols - 1, 0).astype(np.uint16 if symbols < 1 << 16 else np.int32)
        self.code[[ord(ch) for ch in letters]] = np.arange(1, symbols - 1)
        bases, owners, follows, self.dead, self.first, self.bits = [], [], [], [], [], []
        states = places = 0
        for lang in self.langs:
            codes = self.encode(texts[lang])
            to = automaton(codes)
            root = to[0]
            base, owner, follow = packed(to, symbols)
            # one more state, where every text starts and what follows a symbol seen nowhere: no phrase is open
            dead = states + len(to)
            bases.append(np.append(base, 0) + places)
            owners.append(np.where(owner >= 0, owner + states, -1))
            follows.append(follow + states)
            self.dead.append(dead)
            self.first.append([states + root[c] if c in root else dead for c in range(symbols)])
            self.bits.append(math.log2(len(codes) + 1))
            states, places = dead + 1, places + len(owner)
        if self.langs:
            self.base, self.owner, self.follow = (np.concatenate(x).astype(np.int32) for x in (bases, owners, follows))
            self.first = np.array(self.first, np.int32)
            self.dead = np.array(self.dead, np.int32)[:, None]

    def encode(self, text: str) -> np.ndarray:
        return self.code[np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")]

    def steps(self, grid: np.ndarray, sizes: np.ndarray, state: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """States after, and phrases begun in, characters low to high of segments (columns, longest first)."""
        state, begun = state.copy(), np.zeros(state.shape, np.int32)
        left = np.searchsorted(-sizes, -np.arange(low, high), "left")  # segments that have a character there
        for row, m in zip(grid[low:high], left.tolist(), strict=True):
            if not m:
                break
            now = state[:, :m]
            place = self.base[now] + row[:m]
            goes = self.owner[place] == now
            state[:, :m] = np.where(goes, self.follow[place], self.first[:, row[:m]])
            begun[:, :m] += ~goes
        return state, begun

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text (row) by each language (column)."""
        codes = [self.encode(t) for t in texts]
        count = np.array([-(-len(c) // SEGMENT) for c in codes])
        owner = np.repeat(np.arange(len(texts)), count)
        size = np.full(len(owner), SEGMENT)
        ends = np.cumsum(count)
        size[ends[count > 0] - 1] = [(len(c) - 1) % SEGMENT + 1 for c in codes if len(c)]
        grid = np.zeros(len(owner) * SEGMENT, self.code.dtype)
        for c, e, k in zip(codes, ends.tolist(), count.tolist(), strict=True):
            grid[(e - k) * SEGMENT : (e - k) * SEGMENT + len(c)] = c
        order = np.argsort(-size, kind="stable")
        grid = np.ascontiguousarray(grid.reshape(-1, SEGMENT)[order].T)
        sizes, place = size[order], np.empty(len(order), int)
        place[order] = np.arange(len(order))
        fresh = np.repeat(self.dead, len(order), 1)
        mid, head = self.steps(grid, sizes, fresh, 0, HEAD)
        end, tail = self.steps(grid, sizes, mid, HEAD, SEGMENT)
        begun = head + tail
        later = np.flatnonzero(np.r_[False, owner[1:] == owner[:-1]]) if len(owner) else np.zeros(0, int)
        while len(later):  # segments whose predecessor's end is new
            own, before = place[later], place[later - 1]
            by_size = np.argsort(own, kind="stable")  # columns stay longest first
            own, before, later = own[by_size], before[by_size], later[by_size]
            real, first = self.steps(grid[:, own], sizes[own], end[:, before], 0, HEAD)
            begun[:, own] = first + tail[:, own]
            apart = np.flatnonzero((real != mid[:, own]).any(0))
            mid[:, own] = real
            again, rest = self.steps(grid[:, own[apart]], sizes[own[apart]], real[:, apart], HEAD, SEGMENT)
            tail[:, own[apart]] = rest
            begun[:, own[apart]] = first[:, apart] + rest
            new = (again != end[:, own[apart]]).any(0)
            end[:, own[apart]] = again
            later = later[apart[new]] + 1
            later = later[later < len(owner)]
            later = later[owner[later] == owner[later - 1]]
        return np.stack([np.bincount(owner, weights=c[place], minlength=len(texts)) for c in begun], 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        rows = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.langs else []
        begin, size = 0, 0
        for k, i in enumerate(rows):
            size += len(texts[i])
            if size > 1_500_000 or k == len(rows) - 1:
                part = rows[begin : k + 1]
                cost = self.phrases([texts[j] for j in part]) * np.array(self.bits)
                best = cost.argmin(1)
                ranked = np.sort(cost, 1)
                for j, b, r in zip(part, best.tolist(), ranked, strict=True):
                    langs[j] = self.langs[b]
                    scores[j] = float(r[1] / (r[0] + r[1])) if len(r) > 1 else 1.0
                begin, size = k + 1, 0
        return langs, scores


_PARSERS: dict[bytes, Parser] = {}


def parser(texts: dict[str, str]) -> Parser:
    """This worker's automata of a sample; built once, one is kept."""
    key = hashlib.sha256(repr(sorted(texts.items())).encode()).digest()
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = Parser(texts)
    return _PARSERS[key]


def identify(docs: DataFrame, texts: dict[str, str], column: str = "text") -> DataFrame:
    """Append ``lang_pred`` and ``score``; the column named is all that a prediction sees."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(texts)  # bounded by the sample's parameters
    docs = docs.drop("lang_pred", "score")

    def run(batches):
        p = parser(sent.value)
        for b in batches:
            langs, scores = p.predict(b.column(column).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def held_out() -> Column:
    """The fold that teaches nothing: crc32 of the id's text, modulo 5, is 0; a null id is in it."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def report(docs: DataFrame) -> DataFrame:
    """Learn from the documents outside the fold and predict all."""
    texts = sample(docs, ~held_out())
    made = identify(docs.select("doc_id", "text"), texts)
    return made.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
