"""Personal data by patterns and a skip-chain conditional random field.

The patterns give base spans, which always stay. The random field then labels
every token that holds a digit or an at sign; all other tokens can only be
"none", so the field falls apart into short chains of such tokens. Neighbouring
tokens share a chain potential, and repeated tokens of a document, however far
apart, share a skip potential: tokens are alike when they have the same digits
(seven or more) or the same letters. Loopy message passing makes their labels
agree, so that a number written once in full is found again where only a part
of it stands. Tokens labelled with great certainty outside all base spans are
added as spans.

Weights are fitted on a bounded sample of documents (``SAMPLE_DOCS``) whose
tokens are labelled by the base spans; inference reads every whole text. Skip
edges join a token to the one before it of its kind, so there are never more
edges than tokens.

Null texts count as empty and have no spans. Repeated rows give repeated
results, and an empty table an empty one. Only doc_id and text are read, so
other columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.llm.common import bounded_sample, from_text, slices

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
LABELS = NONE + 1
#: Documents with a digit or an at sign that the weights are fitted on.
SAMPLE_DOCS = 600
#: Texts above this length are left out of the fit, which bounds what the driver holds.
SAMPLE_CHARS = 20_000
#: Certainty that an added span needs.
CERTAIN = 0.9
ROUNDS = 12
DAMPING = 0.3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Digits are taken whole: a match that fails from the start of a run of digits fails from inside it too.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_TOKEN_END = re.compile(r"\s|$")
_DIGITS = re.compile(r"[0-9]+")


class Span(NamedTuple):
    kind: int
    start: int
    end: int


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each at sign, the longest run of local letters to its left that no earlier match took."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        free = domain.end() if domain else at + 1
        if domain:
            yield start, domain.end()
        at = text.find("@", free)


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns by kind and start; matches that fail their test are dropped, not tried again."""
    found = [Span(0, *span) for span in _emails(text)]
    for hit in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in hit[0].split(".")):
            found.append(Span(1, *hit.span()))
    for hit in _CARD.finditer(text):
        digits = _digits(hit[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(Span(2, *hit.span()))
    for hit in _PHONE.finditer(text):
        if 9 <= len(_digits(hit[0])) <= 15:
            found.append(Span(3, *hit.span()))
    return found


def tokens(text: str) -> list[tuple[int, int]]:
    """Tokens between white space that hold a digit or an at sign."""
    found, at = [], 0
    while hit := _TRIGGER.search(text, at):
        start, at = hit.start(), _TOKEN_END.search(text, hit.start()).start()
        floor = found[-1][1] if found else 0
        while start > floor and not text[start - 1].isspace():
            start -= 1
        found.append((start, at))
    return found


def features(text: str, spans: Sequence[tuple[int, int]]) -> np.ndarray:
    """One row per token: what it holds, and whether its neighbour in the text is a token too."""
    rows = []
    for i, (start, end) in enumerate(spans):
        token = text[start:end]
        core = token.strip(".,;:!?\"'<>[]{}()")
        digits = _digits(token)
        n = len(digits)
        letters = any(c.isalpha() for c in token)
        dots = core.count(".")
        joined = i > 0 and start - spans[i - 1][1] == 1
        follows = i + 1 < len(spans) and spans[i + 1][0] - end == 1
        rows.append(
            (
                1,
                "@" in core.strip("@"),
                "@" in token and "." in core.rpartition("@")[2],
                token.startswith("+"),
                token.startswith("(") and token.endswith(")"),
                n > 0 and not letters,
                1 <= n <= 4,
                5 <= n <= 8,
                9 <= n <= 12,
                13 <= n <= 19,
                n > 19,
                13 <= n <= 19 and luhn(digits),
                not letters and dots == 3,
                "-" in core,
                letters,
                joined,
                follows,
                joined and text[spans[i - 1][0]] == "+",
            )
        )
    return np.array(rows, dtype=float).reshape(len(rows), N_FEATURES)


N_FEATURES = 18


def edges(text: str, spans: Sequence[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(token, token, type): 0 between neighbours in the text, 1 between a token and the last one like it."""
    found, last = [], {}
    for i, (start, end) in enumerate(spans):
        if i and start - spans[i - 1][1] == 1:
            found.append((i - 1, i, 0))
        token = text[start:end]
        digits = _digits(token)
        like = digits if len(digits) >= 7 else token.strip(".,;:!?\"'<>[]{}()").lower()
        if like in last:
            found.append((last[like], i, 1))
        last[like] = i
    return found


def labels(spans: Sequence[tuple[int, int]], base: Sequence[Span]) -> np.ndarray:
    """The kind of the base span that a token overlaps, or none."""
    out = np.full(len(spans), NONE)
    starts, ends = [a for a, _ in spans], [b for _, b in spans]
    for kind, start, end in reversed(base):
        out[bisect_right(ends, start) : bisect_left(starts, end)] = kind
    return out


class SkipChainField:
    """Weights of the tokens' features and of the chain and skip edges."""

    def __init__(self, weights: np.ndarray, potentials: np.ndarray):
        self.weights, self.potentials = weights, potentials

    @classmethod
    def fit(cls, texts: Sequence[str], steps: int = 300, rate: float = 1.0) -> SkipChainField:
        """Token weights by softmax regression, edge potentials by smoothed counts of label pairs."""
        rows, kinds = [np.zeros((0, N_FEATURES))], [np.zeros(0, dtype=int)]
        counts = np.full((2, LABELS, LABELS), 0.5)
        for text in texts:
            spans = tokens(text)
            known = labels(spans, base_spans(text))
            rows.append(features(text, spans))
            kinds.append(known)
            for a, b, kind in edges(text, spans):
                counts[kind, known[a], known[b]] += 1
                counts[kind, known[b], known[a]] += 1
        x, y = np.vstack(rows), np.concatenate(kinds)
        counts[1] += 2 * np.eye(LABELS)  # alike tokens rather agree, also where the sample has none
        weights = np.zeros((N_FEATURES, LABELS))
        weights[0, NONE] = 1.0
        wanted = np.eye(LABELS)[y]
        for _ in range(steps if len(x) else 0):
            scores = x @ weights
            scores = np.exp(scores - scores.max(axis=1, keepdims=True))
            scores /= scores.sum(axis=1, keepdims=True)
            weights -= rate * (x.T @ (scores - wanted) / len(x) + 1e-4 * weights)
        share = counts / counts.sum(axis=(1, 2), keepdims=True)
        one = share.sum(axis=2)
        return cls(weights, np.log(share / (one[:, :, None] * one[:, None, :])))

    def marginals(self, rows: np.ndarray, links: np.ndarray) -> np.ndarray:
        """Label probabilities of the tokens by loopy message passing over all edges at once."""
        unary = rows @ self.weights
        unary = unary - np.logaddexp.reduce(unary, axis=1, keepdims=True)
        if len(links):
            source = np.concatenate([links[:, 0], links[:, 1]])
            target = np.concatenate([links[:, 1], links[:, 0]])
            shared = self.potentials[np.concatenate([links[:, 2], links[:, 2]])]
            back = np.roll(np.arange(len(source)), len(links))
            sent = np.zeros((len(source), LABELS))
            for _ in range(ROUNDS):
                belief = unary.copy()
                np.add.at(belief, target, sent)
                new = np.logaddexp.reduce((belief[source] - sent[back])[:, :, None] + shared, axis=1)
                new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
                sent = DAMPING * sent + (1 - DAMPING) * new
            np.add.at(unary, target, sent)
        return np.exp(unary - np.logaddexp.reduce(unary, axis=1, keepdims=True))

    def added(self, text: str, base: Sequence[Span]) -> list[Span]:
        """Spans of certain tokens outside the base spans; neighbours of one kind become one span."""
        spans = tokens(text)
        if len(spans) < 2 and base or not spans:
            return []  # one token, and the patterns have it
        links = np.array(edges(text, spans), dtype=int).reshape(-1, 3)
        chances = self.marginals(features(text, spans), links)
        taken = labels(spans, base) != NONE
        out: list[Span] = []
        for i, kind in enumerate(chances.argmax(axis=1).tolist()):
            if kind == NONE or taken[i] or chances[i, kind] < CERTAIN:
                continue
            start, end = _trimmed(text, *spans[i])
            if out and out[-1].kind == kind and start - out[-1].end <= 2 and i and not taken[i - 1]:
                out[-1] = Span(kind, out[-1].start, end)
            elif start < end:
                out.append(Span(kind, start, end))
        return out


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A token without the signs around it."""
    while end > start and not text[end - 1].isalnum():
        end -= 1
    while start < end and not (text[start].isalnum() or text[start] in "+("):
        start += 1
    return start, end


def fit_field(docs: DataFrame, sample: int = SAMPLE_DOCS) -> SkipChainField:
    """Fit on so many documents, the first by a hash of their text, that hold a digit or an at sign."""
    some = docs.select("text").where(F.col("text").rlike("[0-9@]") & (F.length("text") <= SAMPLE_CHARS))
    return SkipChainField.fit([row.text for row in bounded_sample(some, sample, "text").collect()])


_SPAN_LIST = "array<struct<kind:string,start:int,end:int>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_spans(docs: DataFrame, field: SkipChainField | None = None) -> DataFrame:
    """doc_id, base spans and all spans, each by kind and start: (kind, start, end) in code points, end exclusive."""
    field = field or fit_field(docs)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            base, every = [], []
            for text in batch["text"].to_pylist():
                own = base_spans(text or "")
                more = field.added(text or "", own)
                base.append([(KINDS[k], a, b) for k, a, b in sorted(own)])
                every.append([(KINDS[k], a, b) for k, a, b in sorted(own + more)])
            columns = [batch["doc_id"], pa.array(base, _ARROW_SPANS), pa.array(every, _ARROW_SPANS)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        found, f"doc_id long, base {_SPAN_LIST}, spans {_SPAN_LIST}"
    )


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def span_report(spans: DataFrame) -> DataFrame:
    """Counts of the base spans by kind, the digest of their list, and the list of all spans."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return spans.select(
        "doc_id", *map(count, KINDS), F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"), _listed("spans").alias("spans")
    )


def digest(base: Sequence[Span]) -> str:
    """What ``base_sha256`` holds, for one document."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in base).encode()).hexdigest()


def redacted(docs: DataFrame, field: SkipChainField) -> DataFrame:
    """``row``, all columns of a document, and ``hidden``, its text with every span replaced by its kind in angle brackets."""
    return from_text(
        docs, "hidden", T.StringType(), pa.string(), lambda: lambda texts: [None if t is None else redact(t, field) for t in texts]
    )


def redact(text: str, field: SkipChainField) -> str:
    """A text with its spans replaced; overlapping ones become one."""
    base = base_spans(text)
    spans = sorted(base + field.added(text, base), key=lambda s: (s.start, s.kind))
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])
