"""Quality classifier by co-training of two views.

View A sees the text: shares of byte classes, lengths, repetition, and words that the labelled
sample shows to go with a label. View B sees the page's metadata: source, language, declared
length. Both start from labelled documents; each round each view scores all other documents of the
corpus, the texts of which it is most confident on either side are taken from all of them, and the
other view learns from these. A fold of the labels of its own then calibrates each view (Platt) and
a logistic blend of the calibrated views scores every document. Two heads are trained in this way:
good quality, and toxicity; a document is kept if it is good and not toxic.

Labels come from a sample bounded by ``SAMPLE`` documents, by hash order of the id: three fifths
train, a fifth calibrates the views' confidence in the rounds, a fifth the result. All else reads
every whole text of the corpus. A task sends ``ADD`` small rows a view and side at most.

Cases: null text is empty; unseen or null sources and languages give no evidence; null labels
teach nothing; several labels of one document average; without labels of both classes a head says 0.5
for quality and 0 for toxicity, and all is kept; repeated rows get equal scores; equal texts teach once;
ties in confidence go by the text's hash; very long texts are read whole; an empty table gives no rows;
extra columns stay, but for those named like the output.
"""

from __future__ import annotations

import copy
import math
import re
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from querent.llm.common import frugal, ship, small_batches

#: Bound of the labelled sample.
SAMPLE = 4000
#: Rounds, and texts that a view passes on in one, of either side, from this confidence.
ROUNDS, ADD = 3, 50
CONFIDENT = 0.95
#: G statistic from which a word is evidence, of quality and of toxicity (which is a matter of words), and
#: the words one head keeps.
EVIDENCE, WORDS = (20.0, 12.0), 400
#: How firmly the blend holds to the text's view, unless the last fold says otherwise.
TRUST = 5.0
#: Lengths of the words' beginnings that are features too: they tell inflected and compound words.
STEMS = (4, 6)

_WORD = re.compile(r"[^\W\d_]+")
_LETTERS = bytes(c if _WORD.match(chr(c)) else 32 for c in range(256))  # of Latin-1
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "blank": b" \t", "line": b"\n", "stop": b".,;:?", "bang": b"!", "mark": b"#$%&*|~^@=<>{}[]\\/_+"}
_MAP = np.zeros((256, len(_CLASSES)))
for _i, _c in enumerate(_CLASSES.values()):
    _MAP[list(_c), _i] = 1


def spoken(text: str) -> list[str]:
    """A text's words, lower-cased."""
    low = text.lower()
    try:
        return low.encode("latin-1").translate(_LETTERS).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORD.findall(low)


def measures(text: str, words: list[str], own: set[str]) -> list[float]:
    """Dense features of a text, of its words and their set."""
    raw = text.encode("utf-8", "replace")
    share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _MAP / max(1, len(raw))
    again = sum(map(eq, words, words[1:])) / max(1, len(words) - 1)
    return [*np.minimum(share * 10, 5), math.log1p(len(words)), len(own) / max(1, len(words)), 3 * again, sum(map(len, words)) / max(1, len(words)) / 5]


def beginnings(own: set[str], n: int) -> set[str]:
    return {w[:n] for w in own if len(w) > n}


def content(text: str | None) -> tuple[np.ndarray, set[str]]:
    """Dense features of the text, and its set of words and of their beginnings."""
    words = spoken(text or "")
    own = set(words)
    return np.array(measures(text or "", words, own)), own.union(*[{w + "*" for w in beginnings(own, n)} for n in STEMS])


class Content:
    """``content`` for a task that needs some of the sparse features only."""

    def __init__(self, heads: tuple[Head, ...]):
        names = {f for h in heads if not h.constant for f in h.views["A"].names}
        self.words = {f for f in names if f[-1] != "*"}
        self.stems = [(n, {f[:-1] for f in names if f[-1] == "*" and len(f) == n + 1}) for n in STEMS]

    def of(self, text: str | None) -> tuple[np.ndarray, set[str]]:
        words = spoken(text or "")
        own = set(words)
        said = own & self.words
        for n, known in self.stems:
            said.update([w + "*" for w in known & beginnings(own, n)] if known else ())
        return np.array(measures(text or "", words, own)), said


def metadata(source: str | None, lang: str | None, n_chars: int | None) -> set[str]:
    """Categorical features of the page's metadata."""
    n = int(math.log2(1 + max(0, n_chars or 0)))
    return {f"s:{source}", f"l:{lang}", f"n:{n}"}


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, near: tuple[float, ...] = ()) -> np.ndarray:
    """Logistic regression by Newton steps; weights are drawn to ``near``, or to 0; the last column of x
    is the intercept and free."""
    pen = np.full(x.shape[1], ridge)
    pen[-1] = 1e-6
    w = np.zeros(x.shape[1])
    w[: len(near)] = near
    prior = w.copy()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = np.maximum(p * (1 - p), 1e-6) * weight
        step = np.linalg.solve((x.T * h) @ x + np.diag(pen), x.T @ (weight * (p - y)) + pen * (w - prior))
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def chosen(sets: list[set[str]], y: np.ndarray, weight: np.ndarray, least: float, most: int) -> list[str]:
    """Features that go with the label, by the G statistic of the weighted two-by-two table."""
    with_, n1, n = Counter(), float((weight * y).sum()), float(weight.sum())
    pos: Counter = Counter()
    for s, yy, ww in zip(sets, y, weight, strict=True):
        for f in s:
            with_[f] += ww
            pos[f] += ww * yy
    out = []
    for f, a in with_.items():
        if a < 3 or a > n - 1:
            continue
        g = 0.0
        for got, total in ((pos[f], n1), (a - pos[f], n - n1)):
            for o, e in ((got, total * a / n), (total - got, total * (n - a) / n)):
                g += 2 * o * math.log(o / e) if o > 1e-9 and e > 1e-9 else 0
        if g >= least:
            out.append((-g, f))
    return [f for _, f in sorted(out)[:most]]


class View:
    """A linear classifier over dense features (scaled here) and chosen sparse ones."""

    def __init__(self, dense: np.ndarray, sets: list[set[str]], y: np.ndarray, weight: np.ndarray, least: float):
        self.names = chosen(sets, y, weight, least, WORDS)
        self.mean, self.scale = dense.mean(0), dense.std(0) + 1e-3
        self.index = {f: i for i, f in enumerate(self.names)}
        self.w = fit(self.matrix(dense, sets), y, weight)

    def matrix(self, dense: np.ndarray, sets: list[set[str]]) -> np.ndarray:
        d = dense.shape[1]
        x = np.zeros((len(sets), d + len(self.names) + 1))
        x[:, :d] = np.clip((dense - self.mean) / self.scale, -5, 5)
        for i, s in enumerate(sets):
            for f in self.index.keys() & s:
                x[i, d + self.index[f]] = 1
        x[:, -1] = 1
        return x

    def logits(self, dense: np.ndarray, sets: list[set[str]]) -> np.ndarray:
        return self.matrix(dense, sets) @ self.w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def line(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and intercept that turn logits into probabilities."""
    ones = np.ones(len(y))
    return fit(np.stack([z, ones], 1), y, ones, 0.1)


def says(view: View, v: str, rows: list[tuple]) -> np.ndarray:
    """Logits of a view for (dense, words, metadata) rows."""
    if not rows:
        return np.zeros(0)
    return view.logits(np.stack([r[0] for r in rows]) if v == "A" else np.zeros((len(rows), 0)), [r[1] if v == "A" else r[2] for r in rows])


class Head:
    """Two views of one label, co-trained, calibrated and blended."""

    def __init__(self, rows: list[tuple], y: np.ndarray, evidence: float):
        """rows: (dense, words, metadata) of labelled documents, in hash order."""
        self.evidence = evidence
        fold = np.arange(len(y)) % 5
        parts = [fold < 3, fold == 3, fold == 4]
        few = lambda parts: min([min((y[p] > 0.5).sum(), (y[p] <= 0.5).sum()) for p in parts]) < 2
        if few(parts):  # too few for three folds: one calibrates both
            parts = [fold < 3, fold >= 3, fold >= 3]
        self.constant = bool(few(parts))
        train, self.checks, self.last = [([r for r, p in zip(rows, part, strict=True) if p], y[part]) for part in parts]
        self.given = {v: (*train, np.ones(len(train[1]))) for v in "AB"}

    def learn(self) -> None:
        """Both views, from what each has been given, and their confidence."""
        if self.constant:
            return
        self.views, self.lines = {}, {}
        for v, (rows, y, weight) in self.given.items():
            dense = np.stack([r[0] for r in rows]) if v == "A" else np.zeros((len(rows), 0))
            self.views[v] = View(dense, [r[1] if v == "A" else r[2] for r in rows], y, weight, self.evidence if v == "A" else 4.0)
            self.lines[v] = line(says(self.views[v], v, self.checks[0]), self.checks[1])

    def sure(self, v: str, rows: list[tuple]) -> np.ndarray:
        """A view's probabilities."""
        z = says(self.views[v], v, rows)
        return sigmoid(z * self.lines[v][0] + self.lines[v][1])

    def taught(self) -> Head:
        """This head without the rows it learns from: what tasks need to say how sure it is."""
        own = copy.copy(self)
        del own.given, own.checks, own.last
        return own

    def teach(self, v: str, rows: list[tuple], label: int) -> None:
        """Give a view what the other one is sure of."""
        old, y, weight = self.given[v]
        self.given[v] = [*old, *rows], np.append(y, np.full(len(rows), float(label))), np.append(weight, np.full(len(rows), 0.3))

    def finish(self) -> None:
        """Calibrate and blend on the last fold; forget the rest."""
        if not self.constant:
            rows, y = self.last
            z = {v: says(self.views[v], v, rows) for v in "AB"}
            self.platt = {v: line(z[v], y) for v in "AB"}
            ones = np.ones(len(y))
            # the blend may only trust a view, never turn it round
            blend = fit(np.stack([*[z[v] * self.platt[v][0] + self.platt[v][1] for v in "AB"], ones], 1), y, ones, TRUST, (1.0, 0.0))
            self.blend = np.array([max(blend[0], 0.1), max(blend[1], 0.0), blend[2]])
        del self.given, self.checks, self.last

    def score(self, rows: list[tuple], default: float) -> np.ndarray:
        if self.constant or not rows:
            return np.full(len(rows), default)
        za = self.views["A"].logits(np.stack([r[0] for r in rows]), [r[1] for r in rows])
        zb = self.views["B"].logits(np.zeros((len(rows), 0)), [r[2] for r in rows])
        z = sum(self.blend[i] * (z * self.platt[v][0] + self.platt[v][1]) for i, (v, z) in enumerate((("A", za), ("B", zb)))) + self.blend[2]
        return sigmoid(z)


FEATURES = "h long, doc_id long, dense array<double>, words array<string>, source string, lang string, n_chars long"


def featured(rows: DataFrame) -> dict[int, tuple]:
    """``{text's hash: (dense, words, metadata, doc_id)}`` of a bounded number of documents."""

    def run(batches):
        for b in batches:
            made = [content(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("h"), b.column("doc_id"), pa.array([d.tolist() for d, _ in made], pa.list_(pa.float64())), pa.array([sorted(w) for _, w in made], pa.list_(pa.string())), b.column("source"), b.column("lang"), b.column("n_chars")],
                ["h", "doc_id", "dense", "words", "source", "lang", "n_chars"],
            )

    out: dict[int, tuple] = {}
    for r in rows.select("h", "doc_id", "text", "source", "lang", "n_chars").mapInArrow(frugal(run), FEATURES).toLocalIterator():
        new = (np.array(r.dense), set(r.words), metadata(r.source, r.lang, r.n_chars), r.doc_id)
        if r.h not in out or (r.doc_id or 0) < (out[r.h][3] or 0):
            out[r.h] = new
    return out


def confident(docs: DataFrame, heads: list[Head], known: list[set[int]]) -> dict[int, list[tuple[int, int | None]]]:
    """For each head, view and side (4 head + 2 view + side) the texts (hash, an id) of the whole corpus
    of which it is most confident, without those ``known`` to the view that is to learn."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((tuple(h.taught() for h in heads), known))  # weights; hashes of texts in training, bounded by SAMPLE, ROUNDS and ADD

    def run(batches):
        own, known = sent.value
        best: dict[int, dict[int, tuple]] = {k: {} for k in range(8)}
        read = Content(own)
        for b in batches:
            hashes, ids = b.column("h").to_pylist(), b.column("doc_id").to_pylist()
            rows = [(*read.of(t), metadata(s, la, n)) for t, s, la, n in zip(*[b.column(c).to_pylist() for c in ("text", "source", "lang", "n_chars")], strict=True)]
            for k in range(8):
                head, v = own[k // 4], "AB"[k // 2 % 2]
                if head.constant or not rows:
                    continue
                if k % 2 == 0:
                    p = head.sure(v, rows)
                sure = p if k % 2 else 1 - p
                for i in np.flatnonzero(sure >= CONFIDENT).tolist():
                    if hashes[i] not in known[k]:
                        best[k][hashes[i]] = max(best[k].get(hashes[i], (0.0, 0)), (round(float(sure[i]), 9), -(ids[i] if ids[i] is not None else -1)))
                if len(best[k]) > 4 * ADD:
                    best[k] = dict(sorted(best[k].items(), key=lambda x: (-x[1][0], x[0]))[:ADD])
        rows = [(k, h, c, -i) for k in best for h, (c, i) in sorted(best[k].items(), key=lambda x: (-x[1][0], x[0]))[:ADD]]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.float64(), pa.int64()))], ["k", "h", "sure", "doc_id"])

    found = docs.select("h", "doc_id", "text", "source", "lang", "n_chars").mapInArrow(frugal(run), "k int, h long, sure double, doc_id long")
    one = found.groupBy("k", "h").agg(F.max("sure").alias("sure"), F.min("doc_id").alias("doc_id"))
    first = one.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("sure"), "h"))).filter(F.col("r") <= ADD)
    out: dict[int, list[tuple[int, int | None]]] = {k: [] for k in range(8)}
    for r in first.orderBy("k", "r").collect():  # 8 ADD rows
        out[r.k].append((r.h, r.doc_id if r.doc_id >= 0 else None))
    return out


def learn(docs: DataFrame, labels: DataFrame) -> tuple[Head, Head]:
    """The quality and the toxicity head, from the labelled sample and all other documents."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    docs = docs.select("doc_id", "text", "source", "lang", "n_chars", F.xxhash64("text").alias("h"))
    given = {
        r.doc_id: (r.q, r.t)
        for r in labels.filter("doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("q"), F.avg("toxic").alias("t")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()
    }
    wanted = spark.createDataFrame([(i,) for i in sorted(given)] or [(None,)], "doc_id long")
    seen = featured(docs.join(F.broadcast(wanted), "doc_id", "left_semi"))  # SAMPLE ids
    of = {row[3]: h for h, row in sorted(seen.items())}
    heads = []
    for k in (0, 1):
        ids = [i for i in given if i in of and given[i][k] is not None]
        heads.append(Head([seen[of[i]][:3] for i in ids], np.array([float(given[i][k] > 0.5) for i in ids]), EVIDENCE[k]))
    known = [set(seen) for _ in range(8)]  # by teacher: what its pupil has
    for _ in range(ROUNDS if not all(h.constant for h in heads) else 0):
        for h in heads:
            h.learn()
        found = confident(docs, heads, known)
        ids = sorted({i for rows in found.values() for _, i in rows if i is not None})
        hashes = sorted({h for rows in found.values() for h, _ in rows})
        if not hashes:
            break
        more = featured(docs.filter((F.col("doc_id").isin(ids) | F.col("doc_id").isNull()) & F.col("h").isin(hashes)))
        for k, rows in found.items():
            heads[k // 4].teach("BA"[k // 2 % 2], [more[h][:3] for h, _ in rows if h in more], k % 2)
            known[k] |= {h for h, _ in rows}
            known[k ^ 1] |= {h for h, _ in rows}
    for h in heads:
        h.learn()
        h.finish()
    return heads[0], heads[1]


def judged(heads: tuple[Head, Head], read: Content, texts: list, sources: list, langs: list, sizes: list) -> tuple[np.ndarray, np.ndarray]:
    """Quality and toxicity of some documents."""
    rows = [(*read.of(t), metadata(s, la, n)) for t, s, la, n in zip(texts, sources, langs, sizes, strict=True)]
    return heads[0].score(rows, 0.5), heads[1].score(rows, 0.0)


def score(docs: DataFrame, heads: tuple[Head, Head]) -> DataFrame:
    """Append ``quality_score``, ``toxic_score`` and ``keep``; columns of these names are replaced."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    sent = spark.sparkContext.broadcast(heads)  # some hundred weights
    docs = docs.drop("quality_score", "toxic_score", "keep")

    def run(batches):
        read = Content(sent.value)
        for b in batches:
            q, x = judged(sent.value, read, *[b.column(c).to_pylist() for c in ("text", "source", "lang", "n_chars")])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(q), pa.array(x), pa.array((q >= 0.5) & (x < 0.5))], [*b.schema.names, "quality_score", "toxic_score", "keep"])

    return docs.mapInArrow(frugal(run), StructType([*docs.schema.fields, StructField("quality_score", DoubleType()), StructField("toxic_score", DoubleType()), StructField("keep", BooleanType())]))


def keep(docs: DataFrame, heads: tuple[Head, Head]) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, all columns as they are."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    sent = spark.sparkContext.broadcast(heads)  # some hundred weights

    def run(batches):
        read = Content(sent.value)
        for b in batches:
            q, x = judged(sent.value, read, *[b.column(c).to_pylist() for c in ("text", "source", "lang", "n_chars")])
            yield b.filter(pa.array((q >= 0.5) & (x < 0.5)))

    return docs.mapInArrow(frugal(run), docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, learn(docs, labels))
