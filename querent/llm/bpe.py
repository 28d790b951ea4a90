"""Byte-level BPE by recursive queries in an embedded SQL engine, one engine per Python worker.

A text is split by the tokenizer's pattern; each match is a word. The distinct words of a batch
that this worker has not met go to the engine as token-position rows (one row per byte); a
recursive query joins neighbours with the merge table and contracts, in every word at once, the
leftmost pair of least rank, until no pair is left. Decoding joins ids with the token table and
aggregates their bytes in order of position.

A word of over ``SHORT_WORD`` bytes (a run of blanks, unspaced script) goes through a recursive query
that contracts all occurrences of its least pair in a round, from the left, where that provably is
what one after the other would do: if no token that such a contraction could lead to has a lesser
rank. Other pairs go one a round. Rounds are run some at a time, so that memory stays bounded.

Cases: null text is the empty text (no ids, empty bytes); repeated rows are encoded alike; ties in
rank go to the leftmost pair; the word cache is bounded by ``CACHE_WORDS``, and only saves work; an
empty table gives no rows; very long texts are read whole, and a single word of over ``LONG_WORD``
bytes, which would need thousands of rounds over all of its bytes, is coded by a heap under the same law;
columns named like the output are replaced, others stay.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from querent.llm.common import frugal, ship, small_batches, trim

#: Words whose ids a worker keeps.
CACHE_WORDS = 200_000
#: Bytes of a word up to which one pair a round is contracted, and above which a heap replaces the queries.
SHORT_WORD, LONG_WORD = 64, 20_000
#: Bytes of new words in one recursive query, rows of all rounds in one sweep, and ids in one decoding query.
SEED_BYTES, SWEEP_ROWS, DECODE_IDS = 200_000, 2_000_000, 400_000

CONTRACT = """
WITH RECURSIVE state(w, round, pos, id, npos, nid) AS (
  SELECT w, 0, pos, id, pos + 1, lead(id) OVER (PARTITION BY w ORDER BY pos) FROM seed
  UNION ALL
  (WITH best AS (
     SELECT s.w, min(m.merged::BIGINT * 65536 + s.pos) AS k
     FROM state s JOIN merges m ON m.l = s.id AND m.r = s.nid GROUP BY s.w),
   hit AS (
     SELECT b.w, a.pos, (b.k // 65536)::INTEGER AS merged, a.npos AS gone, z.npos, z.nid
     FROM best b JOIN state a ON a.w = b.w AND a.pos = b.k % 65536 JOIN state z ON z.w = a.w AND z.pos = a.npos)
   SELECT s.w, s.round + 1, s.pos,
          CASE WHEN s.pos = h.pos THEN h.merged ELSE s.id END,
          CASE WHEN s.pos = h.pos THEN h.npos ELSE s.npos END,
          CASE WHEN s.pos = h.pos THEN h.nid WHEN s.npos = h.pos THEN h.merged ELSE s.nid END
   FROM state s JOIN hit h ON h.w = s.w
   WHERE s.pos <> h.gone)
), last AS (SELECT w, max(round) AS round FROM state GROUP BY w)
SELECT s.w, s.id FROM state s JOIN last l ON s.w = l.w AND s.round = l.round ORDER BY s.w, s.pos
"""

SWEEP = """
WITH RECURSIVE state(w, round, pos, id, npos, nid) AS (
  SELECT w, 0, pos, id, lead(pos) OVER (PARTITION BY w ORDER BY pos), lead(id) OVER (PARTITION BY w ORDER BY pos) FROM seed
  UNION ALL
  (WITH pair AS (
     SELECT s.w, s.pos, s.npos, m.merged, m.safe FROM state s JOIN merges m ON m.l = s.id AND m.r = s.nid WHERE s.round < $rounds),
   best AS (SELECT w, min(merged) AS merged, min(merged::BIGINT << 32 | pos) & 4294967295 AS pos FROM pair GROUP BY w),
   chosen AS (
     SELECT p.*, p.pos IS DISTINCT FROM lag(p.npos) OVER (PARTITION BY p.w ORDER BY p.pos) AS opens
     FROM pair p JOIN best b ON b.w = p.w AND b.merged = p.merged AND (p.safe OR b.pos = p.pos)),
   runs AS (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY w ORDER BY pos) AS run FROM chosen),
   hit AS (SELECT w, pos, npos AS gone, merged FROM runs QUALIFY row_number() OVER (PARTITION BY w, run ORDER BY pos) % 2 = 1),
   rest AS (
     SELECT s.w, s.round, s.pos, coalesce(h.merged, s.id) AS id
     FROM state s SEMI JOIN best b ON b.w = s.w LEFT JOIN hit h ON h.w = s.w AND h.pos = s.pos ANTI JOIN hit g ON g.w = s.w AND g.gone = s.pos)
   SELECT w, round + 1, pos, id, lead(pos) OVER (PARTITION BY w ORDER BY pos), lead(id) OVER (PARTITION BY w ORDER BY pos) FROM rest)
), last AS (SELECT w, max(round) AS round FROM state GROUP BY w)
SELECT s.w, s.pos, s.id, s.round FROM state s JOIN last l ON s.w = l.w AND s.round = l.round
"""

#: Token bytes stand in the table as Latin-1 characters, so that they join as text.
DECODE = """
SELECT i.d, array_to_string(list(t.s ORDER BY i.pos), '') AS s
FROM ids i JOIN tokens t ON t.id = i.id GROUP BY i.d
"""


def splitter(pattern: str):
    """The pattern's findall. Where a text lies in the basic plane, classes spelled out as ranges let
    the plain regular expression engine, which is faster, find the same matches."""
    import regex

    full = regex.compile(pattern)
    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))

    def spelled(name: str) -> str:
        return "".join(f"\\u{ord(m[0][0]):04x}-\\u{ord(m[0][-1]):04x}" for m in regex.finditer(f"{name}+", plane))

    letters, numbers, blanks = spelled(r"\p{L}"), spelled(r"\p{N}"), spelled(r"\s")
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{blanks}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\S", f"[^{blanks}]").replace(r"\s", f"[{blanks}]")
    if "\\p" in plain:
        return full.findall
    quick, beyond = re.compile(plain), re.compile("[^\\u0000-\\uffff]")
    return lambda text: (full if beyond.search(text) else quick).findall(text)


class Codec:
    """Encoder and decoder of one vocabulary, given as the bytes of a rank file and the pattern."""

    def __init__(self, rank_file: bytes, pattern: str):
        import duckdb

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.split = splitter(pattern)
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.cache: dict[str, bytes] = {}
        self.sql = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "preserve_insertion_order": False, "temp_directory": ""})
        rows = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        left, right, merged = (np.array(c, np.int32) for c in zip(*rows, strict=True))
        # a part that is merged later than a whole it is part of: contracting it could lead to that lesser rank
        late = np.concatenate([left[left > merged], right[right > merged]])
        merges = pa.table({"l": left, "r": right, "merged": merged, "safe": ~np.isin(merged, late)})
        tokens = pa.table([pa.array(list(self.ranks.values()), pa.int32()), pa.array([t.decode("latin-1") for t in self.ranks])], ["id", "s"])
        self.sql.execute("CREATE TABLE merges AS SELECT * FROM merges").execute("CREATE TABLE tokens AS SELECT * FROM tokens")

    def contract(self, words: list[bytes]) -> list[bytes]:
        """Ids, packed as little-endian 32-bit integers, of short words."""
        lengths = np.array([len(w) for w in words])
        starts = np.cumsum(lengths) - lengths
        w = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        pos = (np.arange(len(w)) - np.repeat(starts, lengths)).astype(np.int32)
        seed = pa.table({"w": w, "pos": pos, "id": self.byte_id[np.frombuffer(b"".join(words), np.uint8)]})
        self.sql.register("seed", seed)
        out = self.sql.execute(CONTRACT).fetchnumpy()
        self.sql.unregister("seed")
        ends = np.cumsum(np.bincount(out["w"], minlength=len(words))) * 4
        packed = out["id"].astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def sweep(self, words: list[bytes]) -> list[bytes]:
        """The same of longer words, some rounds at a time."""
        lengths = np.array([len(w) for w in words])
        w = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        pos = (np.arange(len(w)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        state, done = (w, pos, self.byte_id[np.frombuffer(b"".join(words), np.uint8)]), []
        while len(state[0]):
            rounds = max(1, SWEEP_ROWS // len(state[0]))
            self.sql.register("seed", pa.table(dict(zip(("w", "pos", "id"), state, strict=True))))
            out = self.sql.execute(SWEEP, {"rounds": rounds}).fetchnumpy()
            self.sql.unregister("seed")
            ended = out["round"] < rounds
            done.append([out[c][ended] for c in ("w", "pos", "id")])
            state = tuple(np.asarray(out[c][~ended], np.int32) for c in ("w", "pos", "id"))
        w, pos, ids = (np.concatenate(c) for c in zip(*done, strict=True))
        order = np.lexsort((pos, w))
        ends = np.cumsum(np.bincount(w, minlength=len(words))) * 4
        packed = ids[order].astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def contract_long(self, word: bytes) -> bytes:
        """The same law on one long word: a heap of (rank, position) with links between neighbours."""
        ids, ranks, inside = [bytes([b]) for b in word], self.ranks, True
        nxt, prev = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r, i, ids[i] + ids[i + 1]) for i in range(len(ids) - 1) if (r := ranks.get(ids[i] + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = nxt[i] if ids[i] is not None else len(ids)
            if j >= len(ids) or ids[i] + ids[j] != joined:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = joined, None
            nxt[i] = k = nxt[j]
            if k < len(ids):
                prev[k] = i
                if (r := ranks.get(joined + ids[k])) is not None:
                    heapq.heappush(heap, (r, i, joined + ids[k]))
            if (h := prev[i]) >= 0 and (r := ranks.get(ids[h] + joined)) is not None:
                heapq.heappush(heap, (r, h, ids[h] + joined))
        return np.array([ranks[t] for t in ids if t is not None], "<u4").tobytes()

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that the cache lacks; the cache keeps them while it has room."""
        known: dict[str, bytes] = {}
        raw = {w: w.encode("utf-8", "surrogatepass") for w in words}
        known.update((w, self.contract_long(r)) for w, r in raw.items() if len(r) > LONG_WORD)
        short = [w for w, r in raw.items() if len(r) <= SHORT_WORD]
        long = [w for w, r in raw.items() if SHORT_WORD < len(r) <= LONG_WORD]
        for own, method in ((short, self.contract), (long, self.sweep)):
            batch, size = [], 0
            for w in [*own, None]:
                if batch and (w is None or size + len(raw[w]) > SEED_BYTES):
                    known.update(zip(batch, method([raw[x] for x in batch]), strict=True))
                    batch, size = [], 0
                if w is not None:
                    batch.append(w)
                    size += len(raw[w])
        if len(self.cache) + len(known) <= CACHE_WORDS:
            self.cache.update(known)
        return known

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text."""
        split = [self.split(t) if t else [] for t in texts]
        known = self.learn(set().union(*split).difference(self.cache))
        cached = self.cache.get
        if known:
            fresh = known.get
            return [b"".join([cached(w) or fresh(w) for w in ws]) for ws in split]
        return [b"".join(map(cached, ws)) for ws in split]

    def decode(self, packed: list[bytes]) -> list[bytes]:
        """Bytes of each id sequence; an id outside the vocabulary gives no bytes."""
        out, batch, size = [b""] * len(packed), [], 0
        for i in range(len(packed) + 1):
            if batch and (i == len(packed) or size + len(packed[i]) // 4 > DECODE_IDS):
                n = [len(packed[k]) // 4 for k in batch]
                d = np.repeat(np.array(batch, np.int32), n)
                ids = pa.table({"d": d, "pos": np.arange(len(d), dtype=np.int32), "id": np.frombuffer(b"".join(packed[k] for k in batch), "<u4").astype(np.int32)})
                self.sql.register("ids", ids)
                for k, text in self.sql.execute(DECODE).fetchall():
                    out[k] = text.encode("latin-1")
                self.sql.unregister("ids")
                batch, size = [], 0
            if i < len(packed) and packed[i]:
                batch.append(i)
                size += len(packed[i]) // 4
        return out


_CODECS: dict[bytes, Codec] = {}


def codec(rank_file: bytes, pattern: str) -> Codec:
    """This worker's codec of a vocabulary; one is kept."""
    key = hashlib.sha256(rank_file + pattern.encode()).digest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(rank_file, pattern)
    return _CODECS[key]


def groups(batch: pa.RecordBatch, column: str, limit: int = 3_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` characters at most; a longer text is alone."""
    size, begin = 0, 0
    for i, v in enumerate(batch.column(column)):
        n = len(v.as_buffer()) if v.is_valid else 0
        if i > begin and size + n > limit:
            yield begin, i
            size, begin = 0, i
        size += n
    if batch.num_rows > begin:
        yield begin, batch.num_rows


def load(path: str | None = None) -> tuple[bytes, str]:
    """A rank file's bytes, by default of the public multilingual vocabulary, and the pattern."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, column: str = "text", ids: str = "ids", decoded: str | None = None, packed: bool = False) -> DataFrame:
    """Append ``ids`` of a text column (array<int>; ``packed``: binary, 4 little-endian bytes an id)
    and, if named, ``decoded`` (binary: the ids put back into bytes).

    Columns of the same names are replaced. The vocabulary file is read on the driver and
    broadcast: its size is fixed by the tokenizer, not by the data."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark, 1000)
    vocabulary = spark.sparkContext.broadcast(load(path))
    docs = docs.drop(ids, *([decoded] if decoded else []))
    schema = StructType([*docs.schema.fields, StructField(ids, BinaryType() if packed else ArrayType(IntegerType()))])
    if decoded:
        schema = schema.add(decoded, "binary")

    def run(batches):
        c = codec(*vocabulary.value)
        for b in batches:
            for lo, hi in groups(b, column):
                part = b.slice(lo, hi - lo)
                codes = c.encode(part.column(column).to_pylist())
                if packed:
                    cols = [*part.columns, pa.array(codes, pa.binary())]
                else:
                    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in codes])]).astype(np.int32)
                    cols = [*part.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(codes), "<i4")))]
                if decoded:
                    cols.append(pa.array(c.decode(codes), pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, [*part.schema.names, ids, *([decoded] if decoded else [])])
                del part, codes, cols
                trim()

    return docs.mapInArrow(frugal(run), schema)


def decode(df: DataFrame, path: str | None = None, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Append the bytes of an id array column; null ids give null."""
    spark = df.sparkSession
    ship(spark)
    small_batches(spark, 1000)
    vocabulary = spark.sparkContext.broadcast(load(path))
    df = df.drop(decoded)

    def run(batches):
        c = codec(*vocabulary.value)
        for b in batches:
            packed = [None if x is None else np.array(x, "<u4").tobytes() for x in b.column(ids).to_pylist()]
            done = c.decode([p or b"" for p in packed])
            col = pa.array([None if p is None else d for p, d in zip(packed, done, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, col], [*b.schema.names, decoded])

    return df.mapInArrow(frugal(run), StructType([*df.schema.fields, StructField(decoded, BinaryType())]))
