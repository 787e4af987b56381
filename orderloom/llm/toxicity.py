"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters are word lists and patterns; each either fires on a text or does not. Some
lists are fixed, ``LEARNT_LISTS`` more hold words and beginnings of words that mark
toxic texts among the labelled rows. How voters fire together is summed over all
documents, in a few hundred numbers. The label model explains these numbers by a hidden class: the
covariance of two voters is p (1 - p) times the product of how much oftener each
fires on toxic texts, so the covariances are of rank one but for pairs of voters
that depend on each other beyond the class. A rank-one fit by absolute errors
gives every voter its rates on toxic and clean texts, but for the learnt lists,
which have those of the labelled sample; what is left over gives the correlated
pairs. The posterior of a text takes each voter that fires at its rates
given the one it depends on most, so dependent voters do not count twice; a voter
that does not fire abstains, as its words may be of another language.

A logistic regression on counts of words, beginnings of words and voters is
trained on the posteriors of a bounded sample and scores all whole texts. Labels serve for the share of toxic
texts, for the start of the fit and for the learnt word lists; rows held out are
never used, and no score depends on anything but the text.

Bounded: the classifier and the learnt lists come from ``FIT_DOCS`` labelled
documents, half of them toxic if there are so many, the first of each label by a
hash of their identifier; their whole texts stay in tasks, only ``TERMS`` terms
and the rows of features reach the driver. Of several texts of one doc_id the
sample takes one.

Null texts count as empty; a text on which nothing fires gets the score of its
absence. Repeated rows get equal scores. An empty table gives no scores; without
labels of both kinds the share of toxic texts is ``PRIOR`` and the fit starts from
the fixed lists. A row without doc_id is scored and not held out. Other columns
may have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.llm.bpe import Bounded
from orderloom.llm.common import bounded_sample, from_text, slices, stored
from orderloom.llm.quality import held_out

FIT_DOCS = 4000
TERMS = 256
LEARNT = 48
LEARNT_LISTS = 4
#: Log odds from which a term marks toxic texts by itself; surer ones with less are common words.
MARKED = 2.0
#: Standard errors that a term must be away from telling nothing: the root of its likelihood ratio.
SURE = 4.5
#: Terms looked at for each one taken, as many of them are words with the same beginning.
SPARE = 16
PRIOR = 0.1
THRESHOLD = 0.5

# Words that insult, by language and kind.
LEXICONS = {
    "persons": "bastard cretin clown creep dimwit dolt dumbass dunce fool freak halfwit idiot imbecile jerk loser lowlife moron numbskull pig scumbag simpleton twit wimp",
    "degrading": "brainless clueless despicable disgusting dumb filthy hopeless idiotic moronic nasty pathetic repulsive retarded shameful stupid ugly useless vile worthless",
    "refuse": "crap filth garbage maggot parasite rubbish scum sewer trash vermin waste",
    "profane": "arse ass bitch bullshit damn fuck fucking hell piss shit slut whore",
    "hostile": "despise die hate hang kill loathe murder punch strangle",
    "german": "abschaum arschloch bescheuert blöd dreck dumm dummkopf ekelhaft erbärmlich hässlich idiot idioten müll schwachkopf trottel verlierer versager widerlich wertlos",
    "french": "abruti connard crétin débile dégoûtant idiote imbécile inutile merde minable moche nul ordure pathétique pourriture raté salaud stupide",
    "spanish": "asqueroso basura cerdo escoria estúpida estúpido fracasado idiota imbécil inútil maldito mierda patético payaso perdedor tonto",
}
_FIXED = {name: frozenset(words.split()) for name, words in LEXICONS.items()}
_ALL_FIXED = frozenset().union(*_FIXED.values())

_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"[*@$!#]+(?=[^\W\d_])")
_STRETCHED = re.compile(r"([^\W\d_])\1{3,}")
_SHOUTED = re.compile(r"[A-Z]{3,}\b\W+(?:[A-Z]{3,}\b\W+){3}")
_EXCLAIMED = re.compile(r"[!?]{2,}")
_ADDRESSED = re.compile(r"\b(?:you|your|youre|du|dein|deine|tu|toi|usted|eres)\s+(?:are\s+|such\s+|a\s+|an\s+|bist\s+|es\s+|un\s+|une\s+|so\s+)*([^\W\d_]+)")

PATTERNS = ("addressed", "masked", "stretched", "shouted", "exclaimed", "several", "repeated", "learnt_often")
_PREFIXES = (4, 5, 6)
#: Tokens that a task remembers with their marks, and tokens without any.
CACHED_WORDS = 60_000
UNMARKED_WORDS = 400_000
#: Longer tokens are looked at anew each time, so that the cache stays small.
CACHED_LENGTH = 64


def word_counts(text: str) -> Counter[str]:
    return Counter(_WORD.findall(text.lower()))


def terms_of(word: str) -> list[str]:
    """A word and its beginnings, which end in a hyphen."""
    return [word, *(f"{word[:k]}-" for k in _PREFIXES if len(word) >= k)]


class Voters(NamedTuple):
    """Lists of words and beginnings, learnt ones included, then the patterns; before them the classifier's terms."""

    terms: list[str]
    lists: dict[str, frozenset[str]]

    @property
    def names(self) -> list[str]:
        return [*self.lists, *PATTERNS]

    def counter(self) -> Callable[[str], np.ndarray]:
        """A function from a text to how often each term occurs and how much evidence each voter has."""
        width = len(self.terms) + len(self.lists)
        learnt = [len(self.terms) + i for i, name in enumerate(self.lists) if name.startswith("learnt")]
        masked, stretched, exclaimed = (width + PATTERNS.index(name) for name in ("masked", "stretched", "exclaimed"))
        members = [*([term] for term in self.terms), *self.lists.values()]
        whole: dict[str, list[int]] = {}
        starts: dict[str, list[int]] = {}
        for place, own in enumerate(members):
            for term in own:
                (starts if term.endswith("-") else whole).setdefault(term.rstrip("-"), []).append(place)
        begun = starts.keys()

        def looked_at(token: str) -> tuple[list[int], list[str]] | None:
            """Where a token without spaces counts, as often as it does, and its insults."""
            plain = token.isalpha()
            # Most tokens are one word that nothing marks; four equal letters would leave three fewer kinds.
            if plain and token not in whole and token[:4] not in begun and token[:5] not in begun and token[:6] not in begun:
                if len(set(token)) > len(token) - 3 or not _STRETCHED.search(token):
                    return None
            places, insults = [], []
            for word in (token,) if plain else _WORD.findall(token):
                hits = set(whole.get(word, ()))
                for k in _PREFIXES:
                    if len(word) >= k and word[:k] in begun:
                        hits.update(starts[word[:k]])
                places += hits
                if len(word) > 3 and _STRETCHED.search(word):
                    places.append(stretched)
                if hits and word in _ALL_FIXED:
                    insults.append(word)
            if not plain:
                places += [masked for hit in _MASKED.finditer(token) if hit.start() and token[hit.start() - 1].isalpha()]
                places += [exclaimed for _ in _EXCLAIMED.finditer(token)]
            return (places, insults) if places else None

        known, unmarked = Bounded(looked_at, CACHED_WORDS), set()

        def count(text: str) -> np.ndarray:
            found, insults = [0] * (width + len(PATTERNS)), Counter()
            counted = Counter(text.lower().split())
            for token in set(counted).difference(unmarked):
                core = token.rstrip(".,;:")  # stops at the end change nothing
                hit = known[core] if len(core) <= CACHED_LENGTH else looked_at(core)
                if hit is not None:
                    n = counted[token]
                    for place in hit[0]:
                        found[place] += n
                    for word in hit[1]:
                        insults[word] += n
                elif len(token) <= CACHED_LENGTH:
                    if len(unmarked) >= UNMARKED_WORDS:
                        unmarked.clear()
                    unmarked.add(token)
            found[width:] = (
                sum(hit[1].lower() in _ALL_FIXED for hit in _ADDRESSED.finditer(text)) if insults else 0,
                found[masked],
                found[stretched],
                sum(1 for _ in _SHOUTED.finditer(text)),
                found[exclaimed],
                len(insults) > 1,
                any(n > 1 for n in insults.values()),
                sum(found[place] for place in learnt) > 2,
            )
            return np.array(found, dtype=np.int64)

        return count


class LabelModel(NamedTuple):
    """What voters fire on toxic and on clean texts, and which of them depend on each other."""

    prior: float
    toxic: np.ndarray
    clean: np.ndarray
    correlation: np.ndarray
    parent: list[int]

    def evidence(self, fired: np.ndarray) -> np.ndarray:
        """The log ratio of both classes for rows of 0 and 1; a voter that does not fire abstains."""
        total = np.zeros(len(fired))
        for voter, up in enumerate(self.parent):
            alone = np.log(self.toxic[voter] / self.clean[voter])
            if up < 0:
                total += np.where(fired[:, voter] > 0, alone, 0.0)
            else:
                after = np.log(self._given(voter, up, self.toxic) / self._given(voter, up, self.clean))
                total += np.where(fired[:, voter] > 0, np.where(fired[:, up] > 0, after, alone), 0.0)
        return total

    def _given(self, voter: int, up: int, rates: np.ndarray) -> float:
        """How often a voter fires in one class where the one it depends on fired."""
        own, other = rates[voter], rates[up]
        both = own * other + self.correlation[voter, up] * np.sqrt(own * (1 - own) * other * (1 - other))
        return float(np.clip(both / other, max(1e-4, own + other - 1), 1 - 1e-4))

    def posterior(self, fired: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The chance of the toxic class; what silence says is set so that the weighted mean is the prior."""
        evidence, low, high = self.evidence(fired), -40.0, 40.0
        for _ in range(60):
            base = (low + high) / 2
            mean = float(weight @ _logistic(evidence + base))
            low, high = (base, high) if mean < self.prior else (low, base)
        return _logistic(evidence + (low + high) / 2)


def _logistic(logits: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits, -50, 50)))


def fit_label_model(n: int, moments: np.ndarray, prior: float, start: np.ndarray, anchored: np.ndarray | bool = False) -> LabelModel:
    """From the number of texts and how many of them each pair of voters fired on together.

    ``start`` is a first guess of each voter's correlation with the class; its sign says which class is toxic.
    ``anchored`` voters keep it: those learnt from labels, which may mark a kind of toxic text, such as one
    language, that no other voter shares, so that firing together says nothing about them.
    """
    moments = moments / max(1, n)
    means = np.diag(moments).copy()
    spread = np.sqrt(np.maximum(means * (1 - means), 1e-12))
    seen = (means > 0) & (means < 1)
    links = np.where(seen[:, None] & seen[None], (moments - np.outer(means, means)) / np.outer(spread, spread), 0.0)
    np.fill_diagonal(links, 0.0)
    apart = ~np.eye(len(means), dtype=bool)
    load = np.where(seen, start, 0.0)
    for _ in range(200):  # least absolute errors by reweighting; dependent pairs lose their weight
        weight = apart / np.maximum(np.abs(links - np.outer(load, load)), 0.01)
        new = (weight * links) @ load / np.maximum(weight @ load**2, 1e-9)
        new = np.clip(np.where(seen, np.where(anchored, start, new), 0.0), -0.98, 0.98)
        if np.abs(new - load).max(initial=0.0) < 1e-7:
            break
        load = 0.5 * (load + new)
    gap = load * spread / np.sqrt(prior * (1 - prior))
    clean = np.clip(means - prior * gap, 1e-4, 0.999)
    toxic = np.clip(means + (1 - prior) * gap, 1e-4, 0.999)
    rest = np.where(apart & seen[:, None] & seen[None], links - np.outer(load, load), 0.0)
    within = np.sqrt(prior * toxic * (1 - toxic) + (1 - prior) * clean * (1 - clean))
    correlation = np.clip(rest * np.outer(spread, spread) / np.maximum(np.outer(within, within), 1e-12), -0.95, 0.95)
    correlation[np.abs(rest) < max(0.05, 4 / np.sqrt(max(1, n)))] = 0.0
    return LabelModel(prior, toxic, clean, correlation, _forest(np.abs(correlation)))


def _forest(strength: np.ndarray) -> list[int]:
    """Each voter's parent (-1: none) in a forest of the strongest pairs."""
    size = len(strength)
    parent, best = [-1] * size, np.zeros(size)
    left = set(range(size))
    while left:
        voter = max(left, key=lambda v: (best[v], -v))
        if best[voter] == 0:
            parent[voter] = -1
        left.remove(voter)
        for other in left:
            if strength[voter, other] > best[other]:
                best[other], parent[other] = strength[voter, other], voter
    return parent


class Classifier(NamedTuple):
    """Weights of terms and of voters."""

    voters: Voters
    weights: np.ndarray
    bias: float

    def scorer(self) -> Callable[[list[str | None]], list[float]]:
        count = self.voters.counter()

        def scores(texts: list[str | None]) -> list[float]:
            logits = [self.weights @ np.log1p(count(text or "")) + self.bias for text in texts]
            return _logistic(np.array(logits)).tolist()

        return scores


def train(x: np.ndarray, target: np.ndarray, rounds: int = 400, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels; both classes weigh the same as their share."""
    weights, bias = np.zeros(x.shape[1]), 0.0
    moment, power = np.zeros(len(weights) + 1), np.zeros(len(weights) + 1)
    for step in range(1, rounds + 1 if len(x) else 1):
        error = (_logistic(x @ weights + bias) - target) / len(x)
        slope = np.append(x.T @ error + decay * weights, error.sum())
        moment, power = 0.9 * moment + 0.1 * slope, 0.99 * power + 0.01 * slope**2
        move = 0.05 * moment / (1 - 0.9**step) / (np.sqrt(power / (1 - 0.99**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, float(bias)


def _mapped(df: DataFrame, schema: str, kinds: list[pa.DataType], rows: Callable[[list, list], Iterable[tuple]]) -> DataFrame:
    """Rows made from the texts and labels of short slices."""
    names = [field.split()[0] for field in schema.split(", ")]

    def mapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = list(rows(batch["text"].to_pylist(), batch["toxic"].to_pylist()))
            columns = list(zip(*made)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return df.mapInArrow(mapped, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCS) -> DataFrame:
    """text and toxic of at most so many labelled documents that are not held out, half of each label; a stored table."""
    own = labels.select("doc_id", "toxic").where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1))
    halves = [bounded_sample(own.where(F.col("toxic") == label).distinct(), most // 2, "doc_id") for label in (0, 1)]
    chosen = stored(halves[0].unionByName(halves[1]), "labelled").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # bounded
    return stored(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "sample")


def telling_terms(sample: DataFrame, most: int = TERMS) -> list[tuple[str, float]]:
    """The words and beginnings that tell the sample's labels best, with their log odds; rare ones tell nothing.

    They are ranked by the likelihood ratio of two shares against one for both labels. Log odds over their standard
    error would rank a term low that no clean text has, however many toxic ones have it. A term is left out if one
    of its beginnings is as sure.
    """
    sizes = {row.toxic: row["count"] for row in sample.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return []
    seen = _mapped(
        sample,
        "word string, toxic int",
        [pa.string(), pa.int32()],
        lambda texts, marks: ((word, mark) for text, mark in zip(texts, marks) for word in {t for w in word_counts(text) for t in terms_of(w)}),
    )
    least = max(4, sizes[1] // 100)
    counted = seen.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    share = (F.col("toxic") + 0.5) / F.lit(sizes[1] + 1.0)
    other = (F.col("clean") + 0.5) / F.lit(sizes[0] + 1.0)
    odds = F.log(share / (1 - share)) - F.log(other / (1 - other))
    held, both = F.col("toxic") + F.col("clean"), sizes[0] + sizes[1]

    def gain(part: Column, of: int, whole: Column) -> Column:
        """What a share of its own adds to the log likelihood of one label's texts."""
        return F.when(part > 0, part * F.log(part * both / (of * whole))).otherwise(0.0)

    pairs = [(F.col("toxic"), sizes[1]), (F.col("clean"), sizes[0])]
    gained = sum((gain(n, of, held) + gain(of - n, of, both - held) for n, of in pairs), F.lit(0.0))
    sure = F.sqrt(2 * F.greatest(gained, F.lit(0.0)))
    telling = counted.where(held >= least).select("word", odds.alias("odds"), sure.alias("sure")).where(F.col("sure") > SURE)
    taken: dict[str, float] = {}
    for row in telling.orderBy(F.desc("sure"), F.length("word"), "word").limit(SPARE * most).collect():
        if len(taken) < most and not any(beginning in taken for beginning in terms_of(row.word.rstrip("-"))[1:] if beginning != row.word):
            taken[row.word] = row.odds
    return list(taken.items())


def pair_moments(docs: DataFrame, voters: Voters) -> tuple[int, np.ndarray]:
    """The number of texts, and on how many of them two voters fire together, over all documents."""
    size = len(voters.names)

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, count = 0, np.zeros((size, size), dtype=np.int64), voters.counter()
        for batch in slices(batches):
            texts = batch["text"].to_pylist()
            fired = (np.array([count(t) for t in texts], dtype=np.int64).reshape(len(texts), -1)[:, -size:] > 0).astype(np.int64)
            n, total = n + len(texts), total + fired.T @ fired
        values = [n, *total.ravel().tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values, pa.int64())], names=["place", "n"])

    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    sums = texts.mapInArrow(summed, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).orderBy("place").collect()
    values = [row.n for row in sums] or [0] * (1 + size * size)
    return values[0], np.array(values[1:], dtype=float).reshape(size, size)


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCS) -> tuple[Classifier, LabelModel]:
    """The classifier and the label model behind it."""
    sample = labelled_sample(docs, labels, most)
    telling = telling_terms(sample)
    voters = Voters(sorted(term for term, _ in telling), {**_FIXED, **_learnt_lists(telling)})
    before, width = len(voters.terms), len(voters.terms) + len(voters.names)

    def mapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = voters.counter()
        for batch in slices(batches):
            counts = [count(t).tolist() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(counts, pa.list_(pa.int64()))], names=["toxic", "counts"])

    drawn = sample.select("toxic", "text").mapInArrow(mapped, "toxic int, counts array<long>").collect()  # at most `most` rows
    drawn.sort(key=lambda r: (r.toxic, r.counts))
    x = np.log1p(np.array([row.counts for row in drawn], dtype=float).reshape(-1, width))
    truth = np.array([row.toxic for row in drawn], dtype=float)

    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).agg(F.avg("toxic").alias("share")).first()
    both = len(set(truth.tolist())) == 2
    prior = min(0.9, max(0.001, known.share)) if both else PRIOR
    fired = x[:, before:] > 0
    balance = np.full(len(truth), 1 / max(1, len(truth)))
    start = np.array([0.3 if name in _FIXED else 0.0 for name in voters.names])
    if both:
        balance = np.where(truth > 0, prior / truth.mean(), (1 - prior) / (1 - truth.mean())) / len(truth)
        gap, mean = fired[truth > 0].mean(axis=0) - fired[truth == 0].mean(axis=0), balance @ fired
        start = np.clip(gap * np.sqrt(prior * (1 - prior) / np.maximum(mean * (1 - mean), 1e-9)), -0.95, 0.95)
    model = fit_label_model(*pair_moments(docs, voters), prior, start, np.array([both and name.startswith("learnt") for name in voters.names]))
    weights, bias = train(x, model.posterior(fired.astype(int), balance))
    if not len(x):
        weights, bias = _without_sample(model, before), float(np.log(prior / (1 - prior)))
    return Classifier(voters, weights, bias), model


def _learnt_lists(telling: list[tuple[str, float]]) -> dict[str, frozenset[str]]:
    """The surest terms that mark toxic texts, none of which begins another, dealt to several lists."""
    chosen: list[str] = []
    for term, odds in telling:
        start = term.rstrip("-")
        if odds >= MARKED and len(chosen) < LEARNT and not any(start.startswith(c.rstrip("-")) or c.startswith(start) for c in chosen):
            chosen.append(term)
    return {f"learnt{i}": frozenset(chosen[i::LEARNT_LISTS]) for i in range(LEARNT_LISTS)}


def _without_sample(model: LabelModel, before: int) -> np.ndarray:
    """Weights from the voters' rates where there is nothing to train on."""
    return np.append(np.zeros(before), np.log(model.toxic / model.clean) / np.log(2))


def scored(docs: DataFrame, model: Classifier) -> DataFrame:
    """``row``, all columns of a document, and ``score``, the chance that it is toxic."""
    return from_text(docs, "score", T.DoubleType(), pa.float64(), model.scorer)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model, _ = fit(docs, labels)
    found = scored(docs.select("doc_id", "text"), model).select("row.doc_id", "score")
    aside = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return found.select("doc_id", aside.alias("held_out"), "score").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
