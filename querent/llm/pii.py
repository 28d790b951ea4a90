"""Personal data by weak supervision.

Base patterns (email, ip, card, phone) give spans that always stay. Looser patterns give further
candidates. Labelers vote on every candidate: a strict check of its form (regex), a gazetteer
(top-level domains, card issuers, country codes), its context (words before it) and its borders.
Expectation-maximisation over the counted vote patterns of all documents estimates how reliable
each labeler is for each kind; the posteriors then train a logistic span classifier over the
votes and the span's shape, which accepts or refuses the candidates.

Counts cover all documents. What reaches the driver is one row a distinct pattern of votes and
shape, and there are at most some thousands of those by construction, whatever the input's size.

Cases: null text is empty; spans count code points, end exclusive; at equal starts kinds keep the
order of ``KINDS``; a candidate that overlaps a base span or an earlier accepted one is dropped;
repeated rows get equal results; with no candidates at all nothing beyond the base is accepted.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from querent.llm.common import frugal, ship, small_batches

KINDS = ["email", "ip", "card", "phone", "ssn", "secret"]
BASE = KINDS[:4]
#: A candidate beyond the base is accepted from this probability.
ACCEPT = 0.9
ROUNDS = 30

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9][0-9.]*")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]+(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z0-9-]+)+"),
    "phone": re.compile(r"\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}(?![0-9.-])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "secret": re.compile(r"\b(?:sk|pk|ghp|AKIA|xox[bp])[-_]?[A-Za-z0-9_-]{16,}|(?<![0-9A-Za-z])[0-9a-f]{32,128}(?![0-9A-Za-z])"),
}
_DOMAINS = {"com", "org", "net", "edu", "gov", "info", "io", "co", "de", "fr", "es", "uk", "eu", "it", "nl", "us"}
_WORDS = {
    "email": re.compile(r"mail|contact|write|reach", re.I),
    "ip": re.compile(r"\bip\b|server|host|addr", re.I),
    "card": re.compile(r"card|visa|credit|pay|account", re.I),
    "phone": re.compile(r"tel|phone|call|fax|mobile|cell", re.I),
    "ssn": re.compile(r"ssn|social|security", re.I),
    "secret": re.compile(r"key|token|secret|passw|auth|api", re.I),
}
_AGAINST = re.compile(r"version|isbn|section|figure|page|order|sha|commit|checksum|md5|hash", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += (d * 2 - 9 * (d > 4)) if i % 2 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The fixed patterns' spans, by start and kind. Leftmost and not overlapping within a kind."""
    out, past = [], 0
    if "@" in text:
        for m in _AT.finditer(text):
            at = m.start()
            low = at
            while low > past and (text[low - 1].isascii() and (text[low - 1].isalnum() or text[low - 1] in "._%+-")):
                low -= 1
            if low < at:
                out.append((low, m.end(), "email"))
                past = m.end()
    digits = False
    for run in _DIGITS.finditer(text):
        digits = True
        if run[0].count(".") >= 3:
            for m in _IP.finditer(run[0]):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                    out.append((run.start() + m.start(), run.start() + m.end(), "ip"))
    if digits:
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                n = re.sub("[ -]", "", m[0])
                if 14 <= len(n) <= 19 and luhn(n):
                    out.append((*m.span(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of the looser patterns that no base span overlaps."""
    found = []
    if "(" in text or "[" in text:
        found += [(*m.span(), "email") for m in _LOOSE["email"].finditer(text)] if re.search(r"[\[(](?:at|AT)[\])]", text) else []
    for kind in ("phone", "ssn", "secret"):
        if kind == "secret" or _DIGITS.search(text):  # a secret may have none
            found += [(*m.span(), kind) for m in _LOOSE[kind].finditer(text)]
    out, past, k = [], 0, 0
    for a, b, kind in sorted(found, key=lambda s: (s[0], KINDS.index(s[2]))):
        while k < len(base) and base[k][1] <= a:
            k += 1
        if a >= past and not any(x < b and a < y for x, y, _ in base[max(0, k - 4) : k + 4]):
            out.append((a, b, kind))
            past = b
    return out


def votes(text: str, a: int, b: int, kind: str) -> tuple[int, int, int, int]:
    """Regex, gazetteer, context and border labelers: 1 for, -1 against, 0 no opinion."""
    span, before = text[a:b], text[max(0, a - 32) : a]
    digits = re.sub("[^0-9]", "", span)
    if kind == "email":
        form = 1 if "@" in span else 0
        gazetteer = 1 if re.split(r"[.\s\])]+", span)[-1].lower() in _DOMAINS else -1
    elif kind == "ip":
        form = 1
        gazetteer = -1 if span.startswith("0.") else 1 if span.startswith(("10.", "192.168.", "127.")) else 0
    elif kind == "card":
        form = 1 if luhn(digits) else -1
        gazetteer = 1 if digits[0] in "3456" else -1
    elif kind == "phone":
        form = 1 if span[0] == "+" else 0 if 10 <= len(digits) <= 15 else -1
        gazetteer = 1 if span[:2] in ("+1", "+3", "+4") or digits[-7:-4] == "555" else 0
    elif kind == "ssn":
        form = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
        gazetteer = 0
    else:
        form = 1 if not re.fullmatch("[0-9a-f]+", span) else 1 if len(set(span)) >= 8 else -1
        gazetteer = 1 if span.startswith(("sk", "pk", "ghp", "AKIA", "xox")) else 0
    context = 1 if _WORDS[kind].search(before) else -1 if _AGAINST.search(before) else 0
    left, right = text[a - 1 : a], text[b : b + 1]
    border = -1 if left.isalnum() or right.isalnum() else 1
    return form, gazetteer, context, border


def pattern(text: str, a: int, b: int, kind: str) -> tuple:
    """Kind, votes and bucketed shape: all that EM and the classifier see of a span."""
    span = text[a:b]
    digits = sum(c in "0123456789" for c in span) / len(span)
    return (kind, *votes(text, a, b, kind), min(5, int(math.log2(len(span)))), int(digits * 3.999), min(3, sum(not c.isalnum() for c in span) // 2))


def reliabilities(counts: dict[tuple, int]) -> dict[tuple, float]:
    """Posterior of each pattern being personal data, by EM over labelers' votes within a kind.

    Each labeler has a true and a false positive rate among its votes; abstaining tells nothing.
    Rates start above chance, which fixes which class is which, and have a weak prior."""
    out: dict[tuple, float] = {}
    for kind in KINDS:
        rows = [(p, n) for p, n in sorted(counts.items()) if p[0] == kind]
        if not rows:
            continue
        v = np.array([p[1:5] for p, _ in rows], float)
        n = np.array([c for _, c in rows], float)
        prior, hit, false = 0.5, np.full(4, 0.8), np.full(4, 0.2)
        for _ in range(ROUNDS):
            on = np.where(v > 0, np.log(hit), np.where(v < 0, np.log(1 - hit), 0)).sum(1) + math.log(prior)
            off = np.where(v > 0, np.log(false), np.where(v < 0, np.log(1 - false), 0)).sum(1) + math.log(1 - prior)
            q = 1 / (1 + np.exp(np.clip(off - on, -500, 500)))
            scale = n.sum() / 20 + 1  # the prior weighs as one vote in twenty
            prior = float(((q * n).sum() + scale) / (n.sum() + 2 * scale))
            yes, no = (q * n)[:, None], ((1 - q) * n)[:, None]
            hit = ((yes * (v > 0)).sum(0) + 0.8 * scale) / ((yes * (v != 0)).sum(0) + scale)
            false = ((no * (v > 0)).sum(0) + 0.2 * scale) / ((no * (v != 0)).sum(0) + scale)
        out |= {p: float(x) for (p, _), x in zip(rows, q, strict=True)}
    return out


def features(p: tuple) -> np.ndarray:
    kind, *v, length, digits, marks = p
    x = np.zeros(6 + 8 + 6 + 4 + 4)
    x[KINDS.index(kind)] = 1
    for j, vote in enumerate(v):
        x[6 + 2 * j] = vote > 0
        x[7 + 2 * j] = vote < 0
    x[14 + length], x[20 + digits], x[24 + marks] = 1, 1, 1
    return x


def train(counts: dict[tuple, int]) -> np.ndarray:
    """Weights of the span classifier: logistic regression on EM's posteriors, by counts."""
    soft = reliabilities(counts)
    if not soft:
        return np.zeros(28)
    keys = sorted(soft)
    x, y = np.array([features(k) for k in keys]), np.array([soft[k] for k in keys])
    w = np.log1p(np.array([counts[k] for k in keys], float))
    w /= w.sum()
    weights = np.zeros(x.shape[1])
    for _ in range(300):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-x @ weights))
        grad = x.T @ (w * (p - y)) + 1e-3 * weights
        step = np.linalg.solve((x.T * (w * p * (1 - p))) @ x + 1e-3 * np.eye(x.shape[1]), grad)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def find_spans(text: str, weights: np.ndarray) -> tuple[list, list]:
    """Base spans, and all spans."""
    base = base_spans(text)
    more = [s for s in candidates(text, base) if 1 / (1 + math.exp(-float(features(pattern(text, *s)) @ weights))) >= ACCEPT]
    return base, sorted([*base, *more], key=lambda s: (s[0], KINDS.index(s[2]))) if more else base


def joined(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def learn(docs: DataFrame, column: str = "text") -> np.ndarray:
    """The span classifier of a corpus: counts of vote patterns over all texts, EM, training."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            n: Counter = Counter()
            for text in b.column(0).to_pylist():
                if text:
                    base = base_spans(text)
                    n.update("|".join(map(str, pattern(text, *s))) for s in [*base, *candidates(text, base)])
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["pattern", "n"])

    rows = docs.select(column).mapInArrow(frugal(run), "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    return train({(k, *map(int, rest)): r.n for r in rows for k, *rest in [r.pattern.split("|")]})


def detect(docs: DataFrame, weights: np.ndarray | None = None, column: str = "text") -> DataFrame:
    """Append ``base_spans`` and ``all_spans`` (kind:start:end, comma-joined); columns of these names are replaced."""
    weights = learn(docs, column) if weights is None else weights
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    docs = docs.drop("base_spans", "all_spans")

    def run(batches):
        for b in batches:
            found = [find_spans(t or "", weights) for t in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([joined(x) for x, _ in found], pa.string()), pa.array([joined(y) for _, y in found], pa.string())], [*b.schema.names, "base_spans", "all_spans"])

    return docs.mapInArrow(frugal(run), StructType([*docs.schema.fields, StructField("base_spans", StringType()), StructField("all_spans", StringType())]))


def redact(docs: DataFrame, weights: np.ndarray | None = None, column: str = "text") -> DataFrame:
    """The same rows with every found span replaced by ``<KIND>``; null texts stay null. Overlapping
    spans become one, named by the first."""
    weights = learn(docs, column) if weights is None else weights
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)

    def clean(text: str | None) -> str | None:
        spans = find_spans(text, weights)[1] if text else []
        if not spans:
            return text
        out, at = [], 0
        for a, b, kind in spans:
            if a >= at:
                out += [text[at:a], f"<{kind.upper()}>"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches):
        for b in batches:
            i = b.schema.get_field_index(column)
            yield b.set_column(i, b.schema.field(i), pa.array(map(clean, b.column(i).to_pylist()), pa.string()))

    return docs.mapInArrow(frugal(run), docs.schema)


def report(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """Per document: counts of base kinds, digest of base spans, all spans."""
    weights = learn(docs) if weights is None else weights
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    schema = StructType([StructField("doc_id", LongType()), *[StructField(f"n_{k}", LongType()) for k in BASE], StructField("base_sha256", StringType()), StructField("spans", StringType())])

    def run(batches):
        for b in batches:
            found = [find_spans(t or "", weights) for t in b.column("text").to_pylist()]
            counts = [Counter(k for _, _, k in base) for base, _ in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array([c[k] for c in counts], pa.int64()) for k in BASE], pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x, _ in found]), pa.array([joined(y) for _, y in found], pa.string())],
                schema.fieldNames(),
            )

    return docs.select("doc_id", "text").mapInArrow(frugal(run), schema)
