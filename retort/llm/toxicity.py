"""Toxicity by a gap-weighted subsequence kernel, Nyström landmarks and a support vector machine.

The kernel compares words by the subsequences of three characters that they share within a span of six, each weighted
by DECAY to the power of its span: a gapped or padded insult keeps most of its subsequences. The machine learns from
words of labelled sentences, of which a toxic document only says that some are toxic, so the toxic words are those with a
significantly toxic n-gram, and rounds of training add the clean words that come too near. Long words, and texts without
blanks, are cut into overlapping windows, in training as in scoring. The most frequent characters have a number of their
own, all others share these numbers by a hash. With fixed landmarks the decision function is one weight per
subsequence, which makes scoring a table look-up.
"""

from __future__ import annotations

import heapq
import math
import pickle
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.llm.common import documents

DECAY, SPAN = 0.6, 6
#: Fitting uses at most this many labelled documents of each class, chosen by a hash of doc_id; everything is scored.
TOXIC_SAMPLE, CLEAN_SAMPLE = 700, 1500
LANDMARKS, NEGATIVES, ALPHABET, ROUNDS = 160, 5_000, 63, 4
#: The machine's cost of a violated margin, and the weight of all toxic words against that of all clean ones.
COST, BALANCE = 10.0, 0.2
#: Words longer than this are scored by overlapping windows.
WINDOW = 24
REMEMBERED = 1 << 18
#: Words whose margins are worked out at once.
AT_ONCE = 8192
_STEPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_APART = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")


def units(text: str) -> set[str]:
    """The distinct lower-cased words of a text; a run of three or more single characters is one more word."""
    text = text.lower()
    words = text.split()
    out = set(words)
    if sum(len(w) == 1 for w in words) > 2:
        out.update("".join(run.split()) for run in _APART.findall(text))
    return out


def _core(word: str) -> str:
    """A word without the punctuation around it."""
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return word[a:b]


def _windows(word: str) -> list[str]:
    """A word's core, or overlapping windows of one that is longer than a window."""
    word = _core(word)
    return [word] if len(word) <= WINDOW else [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def _norms(n: int) -> np.ndarray:
    """By length, the square root of the sum of squared weights of all positions of a subsequence."""
    out = np.zeros(n + 1)
    for _, b in _STEPS:
        out += np.maximum(0, np.arange(n + 1) - b) * DECAY ** (2 * (b + 1))
    return np.sqrt(np.maximum(out, 1e-12))


@dataclass
class Model:
    """What scoring needs: the alphabet, a weight per subsequence, and the document's logistic model."""

    alphabet: dict[str, int]
    weights: np.ndarray
    bias: float
    document: tuple[float, ...] = ()

    def margins(self, words: list[str]) -> np.ndarray:
        """The machine's margin for each word; so many words at a time that the arrays stay small."""
        parts = [self._margins(words[at : at + AT_ONCE]) for at in range(0, len(words), AT_ONCE)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _margins(self, words: list[str]) -> np.ndarray:
        pieces, owner = [], []
        for k, word in enumerate(words):
            cut = _windows(word)
            pieces += cut
            owner += [k] * len(cut)
        sums, sizes = _score_pieces(pieces, self.alphabet, self.weights)
        out = np.full(len(words), -np.inf)
        np.maximum.at(out, np.array(owner), sums / _norms(WINDOW + 2)[sizes] + self.bias)
        return out

    def probability(self, best: list[float]) -> float:
        """The chance that a document with these largest margins is toxic."""
        x = _document_features(best)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, sum(a * b for a, b in zip(self.document, x, strict=True))))))


def _document_features(best: list[float]) -> list[float]:
    best = [max(-2.0, min(2.0, x)) for x in best[:2]] + [-2.0] * (2 - len(best[:2]))
    return [best[0], best[1], 1.0]


def _coded(pieces: list[str], alphabet: dict[str, int]):
    """All words as numbers in one array, apart by zeros, with their starts and lengths."""
    gap = "\0" * SPAN
    joined = gap.join(f"\x01{p}\x02" for p in pieces) + gap
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    top = max(map(ord, alphabet), default=2) + 1
    table = np.zeros(top + 1, np.int64)
    for c, k in alphabet.items():
        table[ord(c)] = k
    sizes = np.array([len(p) + 2 for p in pieces])
    starts = np.concatenate(([0], np.cumsum(sizes + SPAN)[:-1]))
    code = table[np.minimum(points, top)]
    other = (code == 0) & (points > 2)
    code[other] = 3 + points[other].astype(np.int64) * 40_503 % 65_521 % (ALPHABET - 2)
    return code, starts, sizes


def _score_pieces(pieces, alphabet, weights):
    code, starts, sizes = _coded(pieces, alphabet)
    size = ALPHABET + 1
    total = np.zeros(len(code))
    n = len(code) - SPAN
    for a, b in _STEPS:
        total[:n] += DECAY ** (b + 1) * weights[(code[:n] * size + code[a : n + a]) * size + code[b : n + b]]
    return np.add.reduceat(total, starts), sizes


def _kernel(words: list[str], landmarks: list[str], alphabet: dict[str, int]) -> np.ndarray:
    """Normalised kernel of words and landmarks."""
    size = (ALPHABET + 1) ** 3
    norms = _norms(WINDOW + 2)
    out = np.zeros((len(words), len(landmarks)))
    for k, landmark in enumerate(landmarks):
        sums, sizes = _score_pieces(words, alphabet, _features(landmark, alphabet, size))
        out[:, k] = sums / norms[sizes] / norms[len(landmark) + 2]
    return out


def _features(word: str, alphabet: dict[str, int], size: int) -> np.ndarray:
    code, _, _ = _coded([word], alphabet)
    out = np.zeros(size)
    n, base = len(code) - SPAN, ALPHABET + 1
    for a, b in _STEPS:
        x, y, z = code[:n], code[a : n + a], code[b : n + b]
        fine = (x > 0) & (y > 0) & (z > 0)
        np.add.at(out, ((x * base + y) * base + z)[fine], DECAY ** (b + 1))
    return out


def _squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 20) -> np.ndarray:
    """A linear support vector machine with squared hinge loss, by Newton steps; the last weight is the bias."""
    x = np.hstack((x, np.ones((len(x), 1))))
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    w = np.zeros(x.shape[1])
    active = np.ones(len(x), bool)
    for _ in range(rounds):
        xa = x[active] * cost[active, None]
        w = np.linalg.solve(ridge + 2 * xa.T @ x[active], 2 * xa.T @ y[active])
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w


def _telling(bags: list[set[str]], clean: Counter, n_clean: int) -> set[str]:
    """Words of toxic documents with a character 4- or 5-gram that is significantly more frequent there, and more than 20 times.

    A word that clean documents hold too must itself be that much more frequent in toxic ones. Significance is a
    log-likelihood ratio over documents, at a level that allows for the number of grams tried.
    """
    grams = lambda w: {f"\x01{w}\x02"[i : i + n] for n in (4, 5) for i in range(len(w) + 3 - n)}
    bad: Counter = Counter()
    for bag in bags:
        bad.update({g for w in bag for g in grams(w)})
    tried = len(bad)
    bad = Counter({g: n for g, n in bad.items() if n > 2})
    good: Counter = Counter()
    for w, n in clean.items():
        for g in grams(w) & bad.keys():
            good[g] += n
    n_bad = len(bags)
    least = 2 * math.log(max(tried, 2)) + 2
    telling = set()
    for g, n in bad.items():
        m = good[g]
        p, q, r = n / n_bad, m / n_clean, (n + m) / (n_bad + n_clean)
        if p > 20 * q:
            ratio = n * math.log(p / r) + (m * math.log(q / r) if m else 0) + ((n_bad - n) * math.log((1 - p) / (1 - r)) if p < 1 else 0) + ((n_clean - m) * math.log((1 - q) / (1 - r)) if q < 1 else 0)
            if 2 * ratio > least:
                telling.add(g)
    often = Counter(w for bag in bags for w in bag)
    return {w for w, n in often.items() if n / n_bad > 20 * clean[w] / n_clean and grams(w) & telling}


def fit(sample: list[tuple[int, list[str]]], totals: tuple[int, int] | None = None, seed: int = 7) -> Model:
    """Trains on (toxic, distinct words) of labelled documents.

    totals: how many clean and toxic documents the sample stands for; it may hold the classes in other shares.
    """
    one: dict[str, str] = {}  # equal words share one string
    bag = lambda words: {one.setdefault(c, c) for w in words for c in _windows(w) if c}
    bags = [bag(words) for toxic, words in sample if toxic]
    n_clear = len(sample) - len(bags)
    clean = Counter(w for toxic, words in sample if not toxic for w in bag(words))
    letters = Counter(c for bag in bags for w in bag for c in w) + Counter(c for w in clean for c in w)
    alphabet = {"\x01": 1, "\x02": 2} | {c: k + 3 for k, (c, _) in enumerate(letters.most_common(ALPHABET - 2)) if ord(c) < 0x10000}
    size = (ALPHABET + 1) ** 3
    positive = sorted(_telling(bags, clean, n_clear)) if bags and clean else []
    if not positive:
        return Model(alphabet, np.zeros(size, np.float32), -1.0, (0.0, 0.0, math.log((len(bags) + 0.5) / (n_clear + 0.5))))
    rng = np.random.default_rng(seed)
    often = Counter(w for bag in bags for w in bag)
    seen = np.array([often[w] for w in positive], float)
    words = sorted(clean.keys() - set(positive))
    weight = np.array([clean[w] for w in words], float) ** 0.5
    chosen = {words[i] for i in rng.choice(len(words), min(NEGATIVES, len(words)), False, weight / weight.sum())}
    model = None
    for _ in range(ROUNDS):
        negative = sorted(chosen)
        own = _spread(sorted(positive, key=lambda w: (-often[w], w)), LANDMARKS // 2, alphabet)
        landmarks = own + [negative[i] for i in rng.choice(len(negative), min(LANDMARKS - len(own), len(negative)), False)]
        value, vector = np.linalg.eigh(_kernel(landmarks, landmarks, alphabet))
        half = vector / np.sqrt(np.maximum(value, 1e-4))
        x = _kernel(positive + negative, landmarks, alphabet) @ half
        y = np.concatenate((np.ones(len(positive)), -np.ones(len(negative))))
        # frequent toxic words count more; all of them together as much as a share of the clean ones
        cost = np.concatenate((COST * BALANCE * len(negative) * seen**0.5 / (seen**0.5).sum(), np.full(len(negative), COST)))
        w = _squared_hinge(x, y, cost)
        norms = _norms(WINDOW + 2)
        table = sum(b * _features(mark, alphabet, size) / norms[len(mark) + 2] for b, mark in zip(half @ w[:-1], landmarks, strict=True))
        model = Model(alphabet, table.astype(np.float32), float(w[-1]))
        margin = model.margins(words)
        hard = {words[i] for i in np.argsort(-margin)[: NEGATIVES // 4] if margin[i] > -0.9}
        if hard <= chosen:
            break
        chosen |= hard
    every = sorted({w for _, own in sample for w in own})
    known = dict(zip(every, model.margins(every).tolist(), strict=True))
    rows = [_document_features(heapq.nlargest(2, map(known.__getitem__, own))) for _, own in sample]
    truth = np.array([float(toxic) for toxic, _ in sample])
    stands = np.where(truth > 0, (totals or (0, 1))[1] / max(truth.sum(), 1), (totals or (1, 0))[0] / max((1 - truth).sum(), 1)) if totals else np.ones(len(truth))
    model.document = tuple(_logistic(np.array(rows), truth, stands / stands.mean()))
    return model


def _spread(words: list[str], n: int, alphabet: dict[str, int]) -> list[str]:
    """n of the words, each the one that is least like those taken before."""
    taken = [words[0]]
    nearest = _kernel(words, taken, alphabet)[:, 0]
    while len(taken) < min(n, len(words)):
        taken.append(words[int(nearest.argmin())])
        nearest = np.maximum(nearest, _kernel(words, taken[-1:], alphabet)[:, 0])
    return taken


def _logistic(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = x.T @ (x * (cost * p * (1 - p))[:, None]) + penalty
        w = w - np.linalg.solve(h, x.T @ (cost * (p - y)) + penalty @ w)
    return w


def held_out(doc_id):
    """Rows that training never sees."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits the model to a bounded sample of the labelled documents that are not held out.

    A class gives at most as many documents as its sample says, of rows that share a doc_id one, each with all its
    different words; so one task gets the words of a bounded number of documents. It fits, and the driver gets the model alone.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = (F.xxhash64("doc_id"), "doc_id")
    picked = known.where("toxic = 1").orderBy(*order).limit(TOXIC_SAMPLE).unionByName(known.where("toxic = 0").orderBy(*order).limit(CLEAN_SAMPLE))
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text")

    def words(batches):
        for batch in batches:
            bags = [sorted(units(t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(bags, pa.list_(pa.string()))], names=["toxic", "words"])

    clean, toxic = known.agg(F.sum((F.col("toxic") == 0).cast("long")), F.sum((F.col("toxic") == 1).cast("long"))).first()
    totals = clean or 0, toxic or 0

    def learn(batches):
        one: dict[str, str] = {}  # documents share their equal words
        sample = []
        for batch in batches:
            for kind, own in zip(batch.column(0), batch.column(1), strict=True):
                sample.append((kind.as_py(), [one.setdefault(w, w) for w in own.as_py()]))
        del one
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(sorted(sample), totals))], pa.binary())], names=["model"])

    found = texts.mapInArrow(words, "toxic int, words array<string>").repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit([], totals)  # a plan without rows may have no task


def score_toxicity(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """Adds ``held_out, score, predicted`` to the columns of ``docs``.

    ``score`` is the estimated chance that a document is labelled toxic, from its whole text alone; ``predicted`` is 1 from
    ``least`` on. Null and empty texts get the score of a text without words. doc_id may be null (not held out) or repeated;
    own columns named like the new ones are replaced. With no labels of a class the score is that class's share.
    A map over the documents: no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    own = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    at = own.index("text")

    def score(batches):
        model = shared.value
        young: dict[str, float] = {}
        old: dict[str, float] = {}
        for batch in batches:
            texts = batch.column(at).to_pylist()
            scores: list[float] = []
            for k in range(0, len(texts), 128):
                bags = [units(t or "") for t in texts[k : k + 128]]
                if len(young) >= REMEMBERED:
                    young, old = {}, young
                new = [w for w in {w for bag in bags for w in bag} if w not in young]
                missing = []
                for w in new:
                    if (m := old.get(w)) is None:
                        missing.append(w)
                    else:
                        young[w] = m
                young.update(zip(missing, model.margins(missing).tolist(), strict=True))
                scores += [model.probability(heapq.nlargest(2, map(young.__getitem__, bag))) for bag in bags]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*own, "score"])

    kind = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own)
    out = docs.select(*own).mapInArrow(score, f"{kind}, score double")
    return out.withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False))).withColumn("predicted", (F.col("score") >= least).cast("int"))


def op9_toxicity(spark, sf_dir):
    """The contract's columns over all documents."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return score_toxicity(docs, documents(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
