"""Personal data by patterns and a skip-chain conditional random field.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers found by fixed patterns in linear time.
The field then labels every token that holds a digit or an ``@`` (other tokens cannot be personal data here). Its
potentials: a node weight from the token's shape, a chain weight between neighbours, and a skip weight between tokens of
one document that are alike (same last seven digits, or same text but for case and outer marks), however far apart.
Tokens under a base span are observed; a text without one is labelled like any other, from shapes and links alone. Loopy sum-product passes messages until labels agree; tokens whose belief in a
kind is at least one half become added spans. Weights are learned piecewise, from counts over a bounded sample of rows
(``SAMPLE``, those with the smallest hash of the id), whole texts.

Each token is linked with the one like it before and with the first one like it, so links grow with the tokens however
often one is repeated. Defined cases: a null or empty text has no spans; repeated rows each give a row; spans of equal
start are listed in the order of ``KINDS``; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from headwind.llm.tables import keep, slices, texts

# fixed values: the kinds and their patterns
KINDS = ("email", "ip", "card", "phone")
LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
SAMPLE = 3_000  # rows that weights are learned from
SHAPES = 5_000  # shapes with a weight of their own
ROUNDS = 10
DAMPING = 0.5
CAUTION = 2.0  # how much the shape alone counts against a kind that no pattern confirmed
ALIKE = 20.0  # pairs of alike tokens taken to agree before any are counted; only pairs that patterns confirm count
SLICE = 128
TOGETHER = 20_000  # tokens of several texts that pass messages in one go; a text is never cut
OTHER = len(KINDS)  # the label of tokens that are nothing personal

_CANDIDATE = re.compile(r"[0-9@]")
_SPACE = re.compile(r"\s")
_DIGITS = re.compile(r"[0-9]+")
_LETTERS = re.compile(r"[^\W\d_]+")

Span = tuple[int, int, int]  # start, kind, end


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A local part reaches back from its ``@`` at most to the last match, and never over another ``@``."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL_PART.match(text, start - 1):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, (done := found.end())
        at = text.find("@", max(done, at + 1))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """A run of dotted numbers is taken four at a time."""
    for run in DOTTED.finditer(text):
        parts, at = run[0].split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def luhn(digits: str) -> bool:
    doubled = "0246813579"
    return sum(int(doubled[int(d)]) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """All base spans by start, then kind; code points, end exclusive."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        out += [(s, 1, e) for s, e in _ips(text)]
        for m in CARD.finditer(text):
            if 14 <= m.end() - m.start() <= 37:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """The tokens (between white space) that hold a digit or an ``@``."""
    out, done = [], 0
    found = _CANDIDATE.search(text)
    while found:
        start = found.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        space = _SPACE.search(text, found.end())
        done = space.start() if space else len(text)
        out.append((start, done))
        found = _CANDIDATE.search(text, done)
    return out


def shape(token: str) -> str:
    """Digit runs by length, letter runs as one mark, other characters as they are."""
    marked = _LETTERS.sub("a", token[:200])
    return _DIGITS.sub(lambda m: f"d{min(len(m[0]), 20)}", marked)[:32]


def alike(token: str) -> str:
    """What tokens that are alike have in common; empty for tokens too short to tell."""
    if "@" in token:
        return "@" + token.strip(".,;:!?()[]<>\"'").lower()
    digits = "".join(_DIGITS.findall(token))
    if len(digits) >= 7:
        return digits[-7:]
    word = token.strip(".,;:!?()[]<>\"'|").lower()
    return "=" + word if len(word) >= 5 else ""


def observed(tokens: list[tuple[int, int]], spans: list[Span]) -> list[int]:
    """The kind of the base span over each token, -1 where there is none."""
    out, k = [-1] * len(tokens), 0
    for i, (start, end) in enumerate(tokens):
        while k < len(spans) and spans[k][2] <= start:
            k += 1
        for s, kind, e in spans[k:]:
            if s >= end:
                break
            if e > start:
                out[i] = kind
                break
    return out


class Weights:
    """Log potentials: by shape, between neighbours, between alike tokens."""

    def __init__(self, counts: dict[tuple, int]):
        n = OTHER + 1
        shapes: dict[str, np.ndarray] = {}
        prior, chain, agree, differ = np.ones(n), np.full((n, n), 0.5), ALIKE, 1.0
        for (what, a, b), c in counts.items():
            if what == "shape":
                shapes.setdefault(a, np.zeros(n))[int(b)] += c
                prior[int(b)] += c
            elif what == "chain":
                chain[int(a), int(b)] += c
            elif what == "skip":
                agree, differ = agree + c * (a == b), differ + c * (a != b)
        prior /= prior.sum()
        penalty = np.array([-CAUTION] * OTHER + [0.0])
        self.default = np.log(np.array([1e-4] * OTHER + [1.0])) + penalty
        self.shapes = {s: np.log((v + prior) / (v.sum() + 1.0)) + penalty for s, v in shapes.items()}
        marginal = chain.sum(1, keepdims=True) * chain.sum(0, keepdims=True) / chain.sum()
        self.chain = np.clip(np.log(chain / marginal), -2.0, 2.0)
        self.skip = np.eye(n) * float(np.clip(np.log(agree / differ), 0.0, 6.0))


def edges_of(text: str, tokens: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Pairs of neighbours and pairs of alike tokens."""
    chain = [(i, i + 1) for i in range(len(tokens) - 1) if tokens[i + 1][0] - tokens[i][1] <= 8 and text[tokens[i][1] : tokens[i + 1][0]].isspace()]
    near = set(chain)
    first: dict[str, int] = {}
    last: dict[str, int] = {}
    skip = []
    for i, (start, end) in enumerate(tokens):
        key = alike(text[start:end])
        if key:
            if key in last:
                skip += [(j, i) for j in {first[key], last[key]} if (j, i) not in near]
            first.setdefault(key, i)
            last[key] = i
    return chain, skip


def infer(unary: np.ndarray, edges: np.ndarray, potentials: np.ndarray, kind: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Beliefs by loopy sum-product in logs, for many documents at once; ``kind`` picks each edge's potential."""
    if not len(edges):
        out = unary - unary.max(1, keepdims=True)
        return np.exp(out) / np.exp(out).sum(1, keepdims=True)
    source = np.concatenate([edges[:, 0], edges[:, 1]])
    target = np.concatenate([edges[:, 1], edges[:, 0]])
    table = np.concatenate([potentials[kind], potentials[kind].transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(edges), 2 * len(edges)), np.arange(len(edges))])
    message = np.zeros((len(source), unary.shape[1]))
    for _ in range(rounds):
        total = unary.copy()
        np.add.at(total, target, message)
        out = (total[source] - message[back])[:, :, None] + table
        top = out.max(1)
        fresh = top + np.log(np.exp(out - top[:, None, :]).sum(1))
        fresh -= fresh.max(1, keepdims=True)
        message = DAMPING * message + (1 - DAMPING) * fresh
    total = unary.copy()
    np.add.at(total, target, message)
    total = np.exp(total - total.max(1, keepdims=True))
    return total / total.sum(1, keepdims=True)


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and not (text[start].isalnum() or text[start] in "+("):
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    return start, end


def added_spans(values: list[str], base: list[list[Span]], weights: Weights) -> list[list[Span]]:
    """The spans that the field adds to the base spans of each text."""
    out: list[list[Span]] = [[] for _ in values]
    held, unary, edges, kinds = [], [], [], []

    def label() -> None:
        beliefs = infer(np.array(unary), np.array(edges, dtype=np.int64).reshape(-1, 2), np.stack([weights.chain, weights.skip]), np.array(kinds, dtype=np.int64))
        best, sure = beliefs.argmax(1), beliefs.max(1) >= 0.5
        for d, at, tokens, seen in held:
            text, before = values[d], None
            for i, (start, end) in enumerate(tokens):
                kind = int(best[at + i])
                if seen[i] >= 0 or kind == OTHER or not sure[at + i]:
                    before = None
                    continue
                lo, hi = trimmed(text, start, end)
                if before is not None and out[d] and out[d][-1][1] == kind and text[before:start].isspace() and start - before <= 8:
                    out[d][-1] = (out[d][-1][0], kind, hi)
                elif hi > lo:
                    out[d].append((lo, kind, hi))
                before = end
        for whole in (held, unary, edges, kinds):
            whole.clear()

    for d, (text, spans) in enumerate(zip(values, base)):
        tokens = candidates(text)
        seen = observed(tokens, spans)
        if -1 not in seen:
            continue
        size = len(unary)
        for (start, end), kind in zip(tokens, seen):
            if kind >= 0:
                unary.append(np.where(np.arange(OTHER + 1) == kind, 0.0, -30.0))
            else:
                unary.append(weights.shapes.get(shape(text[start:end]), weights.default))
        chain, skip = edges_of(text, tokens)
        edges += [(size + i, size + j) for i, j in chain + skip]
        kinds += [0] * len(chain) + [1] * len(skip)
        held.append((d, size, tokens, seen))
        if len(unary) >= TOGETHER:
            label()
    if held:
        label()
    return out


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Weights:
    """Weights from the counts over at most ``sample`` rows."""
    keyed = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t"))
    picked = keyed.select("id").orderBy(F.xxhash64("id"), "id").limit(sample).distinct()
    rows = keyed.join(F.broadcast(keep(picked, "pii-sample")), "id", "left_semi")  # at most ``sample`` ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple] = Counter()
        for batch in slices(batches, SLICE):
            for text in texts(batch.column(0)):
                tokens = candidates(text)
                label = [OTHER if k < 0 else k for k in observed(tokens, base_spans(text))]
                for (start, end), k in zip(tokens, label):
                    counts["shape", shape(text[start:end]), str(k)] += 1
                chain, skip = edges_of(text, tokens)
                counts.update(("chain", str(label[i]), str(label[j])) for i, j in chain)
                counts.update(("skip", str(label[i]), str(label[j])) for i, j in skip if max(label[i], label[j]) < OTHER)
        keys = list(counts)
        columns = {name: pa.array([k[at] for k in keys], pa.string()) for at, name in enumerate(("what", "a", "b"))}
        yield pa.RecordBatch.from_pydict(columns | {"n": pa.array([counts[k] for k in keys], pa.int64())})

    counted = rows.select("t").mapInArrow(run, "what string, a string, b string, n long").groupBy("what", "a", "b").agg(F.sum("n").alias("n"))
    pairs = counted.where("what <> 'shape'")  # one row for each pair of labels
    shapes = counted.where("what = 'shape'").orderBy(F.desc("n"), "a", "b").limit(SHAPES)
    return Weights({(r["what"], r["a"], r["b"]): r["n"] for r in pairs.union(shapes).collect()})


def find(docs: DataFrame, weights: Weights | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of base spans, their digest and all spans, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights or learn(docs, id_col, text_col))  # SHAPES small vectors at most

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            values = texts(batch.column(1))
            base = [base_spans(t) for t in values]
            more = added_spans(values, base, shared.value)
            columns = {"doc_id": batch.column(0)}
            for k, name in enumerate(KINDS):
                columns[f"n_{name}"] = pa.array([sum(s[1] == k for s in b) for b in base], pa.int64())
            columns["base_sha256"] = pa.array([hashlib.sha256(told(b).encode()).hexdigest() for b in base], pa.string())
            columns["spans"] = pa.array([told(sorted(b + a)) for b, a in zip(base, more)], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, SCHEMA)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or group of overlapping spans, replaced by the name of its first kind."""
    out, done = [], 0
    for start, kind, end in spans:
        if start >= done:
            out += [text[done:start], f"<{KINDS[kind].upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, weights: Weights | None = None, id_col: str = "doc_id", text_col: str = "text", n_col: str = "n_chars") -> DataFrame:
    """All rows and columns, with personal data in the text replaced and the number of characters set anew; null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(weights or learn(docs, id_col, text_col))
    schema: StructType = docs.schema
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            raw = batch.column(at).to_pylist()
            values = texts(batch.column(at))
            base = [base_spans(t) for t in values]
            more = added_spans(values, base, shared.value)
            clean = [None if r is None else masked(t, sorted(b + a)) for r, t, b, a in zip(raw, values, base, more)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(clean, pa.string()) if k == at else batch.column(k) for k in range(batch.num_columns)], names=batch.schema.names
            )

    out = docs.mapInArrow(run, schema)
    if n_col in docs.columns:
        out = out.withColumn(n_col, F.char_length(text_col).cast(schema[n_col].dataType))
    return out
