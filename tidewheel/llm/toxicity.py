"""Toxicity by a support vector machine on a gapped subsequence string kernel with Nyström landmarks.

The kernel of two strings counts common subsequences of three characters, gaps allowed up
to a span of five, each weighted by DECAY for every skipped character, and is normalised.
Latin letters are folded to 26 classes, letters of other scripts to thousands (by a hash of
the lower-case base letter); subsequences of the first have features of their own, those
with any of the second share as many again by a hash. So the kernel's feature space is
small enough to be written out: the machine trained on kernel values against landmarks is
folded into one weight for each subsequence, and scoring a string is a sum.

Labels belong to documents, offence to a few words of them. Training is therefore by
multiple instances: of each toxic document the units that stand out, or else the one that scores highest,
are witnesses, units of other documents are counterexamples, and machine and witnesses are refined in
turn. A document's score is that of its highest unit, on a logistic scale. Units are words,
long words in overlapping windows, and runs of single characters put together.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.common import held_out

DECAY = 0.5
#: Places of the second and third character after the first.
PATTERNS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
CLASSES = 32
#: Classes of letters that are not Latin come after CLASSES. Features: those of the CLASSES, and as many hashed ones.
OTHERS, PLAIN, SPACE = 4096, CLASSES**3, 2 * CLASSES**3
LETTERS, START, END, DIGIT, SIGN, OTHER = range(1, 27), 27, 28, 29, 30, 31
WINDOW, STEP = 24, 12
LANDMARKS = 256
#: Deviations from which a word of toxic documents is a witness by its frequency alone.
SURE = 4.0
#: Part of a document's highest surprise from which its other words are witnesses too.
NEAR_BEST = 0.8
REMEMBERED = 400_000
#: Signs and digits that stand for letters.
LOOKALIKES = {"@": "a", "0": "o", "1": "i", "!": "i", "3": "e", "$": "s", "5": "s", "7": "t"}
_ENDS = ".,;:!?\"'()[]{}<>|*#%&_-+=~`/\\…«»„“”‘’–—"


def _class_of(c: str) -> int:
    base = unicodedata.normalize("NFD", LOOKALIKES.get(c, c))[:1].lower()[:1]
    if "a" <= base <= "z":
        return ord(base) - 96
    if c.isdigit():
        return DIGIT
    if not c.isalpha() and (ord(c) < 0x900 or unicodedata.category(c)[0] != "M"):  # marks of later scripts are vowels
        return SIGN
    return CLASSES + (ord(base) * 0x9E3779B1 >> 8) % OTHERS


_NEAR = 0x600
_TABLE = np.array([_class_of(chr(c)) for c in range(_NEAR)], dtype=np.int64)
_FAR: dict[int, int] = {}


def _classes(points: np.ndarray) -> np.ndarray:
    """Classes of code points; those beyond the table are worked out when met, and remembered."""
    out = _TABLE[np.minimum(points, _NEAR - 1)]
    far = np.flatnonzero(points >= _NEAR)
    if len(far):
        each, at = np.unique(points[far], return_inverse=True)
        for p in each.tolist():
            if p not in _FAR:
                _FAR[p] = _class_of(chr(p))
        out[far] = np.array([_FAR[p] for p in each.tolist()], dtype=np.int64)[at]
    return out


def _codes(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(classes of all units' characters, with marks at both ends; the unit of each)."""
    text = "".join(units)
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    sizes = np.array([len(u) for u in units], dtype=np.int64) + 2
    ends = np.cumsum(sizes)
    codes = np.zeros(ends[-1], dtype=np.int64)
    inner = np.ones(len(codes), dtype=bool)
    inner[ends - 1] = inner[ends - sizes] = False
    codes[inner] = _classes(points)
    codes[ends - sizes], codes[ends - 1] = START, END
    heard = codes != SIGN  # signs put between letters are left out
    return codes[heard], np.repeat(np.arange(len(units)), sizes)[heard]


def features(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, subsequence, value) of the normalised feature vectors, sorted, without repeats."""
    if not units:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    codes, unit = _codes(units)
    other = bool(len(codes)) and int(codes.max()) >= CLASSES
    keys, weights = [], []
    for a, b in PATTERNS:
        n = len(codes) - b
        if n <= 0:
            continue
        same = unit[:n] == unit[b:]
        x, y, z = codes[:n], codes[a : a + n], codes[b:]
        key = x << 10 | y << 5 | z
        if other:  # any class beyond the plain ones: a hashed feature
            mixed = (((x * 0x9E3779B1 + y) * 0x85EBCA6B + z) * 0xC2B2AE35) >> 17 & PLAIN - 1
            key = np.where((x | y | z) >= CLASSES, PLAIN | mixed, key)
        keys.append((unit[:n] << 16 | key)[same])
        weights.append(np.full(len(keys[-1]), DECAY ** (b - 2)))
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], np.concatenate(weights)[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    value, key = np.add.reduceat(weight, first), key[first]
    unit = key >> 16
    norm = np.sqrt(np.bincount(unit, value * value, minlength=len(units)))
    return unit, key & SPACE - 1, value / norm[unit]


def columns(units: list[str]) -> np.ndarray:
    """The feature vectors of units, a column for each."""
    unit, code, value = features(units)
    out = np.zeros((SPACE, len(units)), dtype=np.float32)
    out[code, unit] = value
    return out


def kernel(units: list[str], landmarks: np.ndarray) -> np.ndarray:
    """Kernel values of units against landmarks (a feature vector in each column)."""
    out = np.zeros((len(units), landmarks.shape[1]))
    for at in range(0, len(units), 128):
        unit, code, value = features(units[at : at + 128])
        if len(unit):
            first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            out[at + unit[first]] = np.add.reduceat(landmarks[code] * value.astype(np.float32)[:, None], first, axis=0)
    return out


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Weights (the last: the bias) of a linear machine with squared hinge loss, by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3

    def loss(w: np.ndarray) -> float:
        return float(w @ ridge @ w + (cost * np.maximum(0, 1 - y * (x @ w)) ** 2).sum())

    now = loss(w)
    for _ in range(rounds):
        wrong = np.flatnonzero(y * (x @ w) < 1)
        part, c = x[wrong], cost[wrong]
        step = np.linalg.solve(ridge + (part * c[:, None]).T @ part, part.T @ (c * y[wrong])) - w
        size = 1.0
        while size > 1e-4 and (then := loss(w + size * step)) >= now:
            size /= 2
        if size <= 1e-4 or now - then < 1e-6 * now:
            break
        w, now = w + size * step, then
    return w


def units(text: str | None) -> list[str]:
    """Lower-cased words of a whole text, and the runs of four and more single-character words put together."""
    words = (text or "").lower().split()
    raw = (text or "").encode("utf-32-le", "replace") if text and not text.isascii() else (text or "").encode()
    data = np.frombuffer(raw, dtype=np.uint8 if not text or text.isascii() else np.uint32)
    blank = np.concatenate([[True], data <= 32, [True]])
    single = np.flatnonzero(blank[:-2] & ~blank[1:-1] & blank[2:])
    if len(single) >= 4:
        runs = np.split(single, np.flatnonzero(np.diff(single) != 2) + 1)
        words += ["".join(chr(data[i]) for i in r).lower() for r in runs if len(r) >= 4]
    return words


def _bare(word: str) -> str:
    return word.strip(_ENDS)


def _windows(word: str) -> list[str]:
    bare = _bare(word)
    return [bare] if len(bare) <= WINDOW + STEP else [bare[at : at + WINDOW] for at in range(0, len(bare) - STEP, STEP)]


class Model:
    """Weights of subsequences, and the logistic scale of a document's highest unit."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, middle: float):
        self.weights, self.bias, self.slope, self.middle = weights.astype(np.float32), bias, slope, middle
        self.trained = bool(self.weights.any())  # else nothing could be learned, and all texts score alike
        self.known: dict[str, float] = {}

    def raw(self, words: list[str]) -> np.ndarray:
        """The machine's value of each word: of its highest window."""
        cut = [_windows(w) for w in words]
        flat = [x for c in cut for x in c]
        unit, code, value = features(flat)
        each = np.bincount(unit, self.weights[code] * value, minlength=len(flat)) + self.bias
        sizes = np.array([len(c) for c in cut])
        return np.maximum.reduceat(each, np.cumsum(sizes) - sizes) if len(words) else np.zeros(0)

    def highest(self, texts: list[str | None]) -> np.ndarray:
        """The value of each text's highest unit; -inf for a text without any."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        all_units = [units(t) for t in texts]
        new: set[str] = set()
        for u in all_units:
            new.update(u)
        fresh = [w for w in new if w not in self.known]
        for at in range(0, len(fresh), 8192):
            part = fresh[at : at + 8192]
            self.known.update(zip(part, self.raw(part).tolist()))
        get = self.known.__getitem__
        return np.array([max(map(get, u), default=-np.inf) for u in all_units])

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (np.maximum(self.highest(texts), -1e3) - self.middle), -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, middle) of the logistic curve through labels, with Platt's softened targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.clip(x, -5, 5)
    design = np.stack([x, np.ones(len(x))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p) + 1e-9)[:, None]).T @ design + 1e-4 * np.eye(2), design.T @ (target - p) - 1e-4 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    slope = max(w[0], 1e-3)
    return float(slope), float(-w[1] / slope)


def fit(texts: list[str], toxic: np.ndarray, rounds: int = 3) -> Model:
    """A model from labelled texts; with labels of one kind only, every score is near that label."""
    if not len(texts) or toxic.min() == toxic.max():
        known = len(texts) > 0
        return Model(np.zeros(SPACE), 0.0, 1e-3 * known, 3e3 if known and toxic.max() == 0 else -3e3)
    rng = np.random.default_rng(11)
    index: dict[str, int] = {}
    bags = [np.array(sorted({index.setdefault(x, len(index)) for w in units(t) for x in _windows(w) if x}), dtype=np.int64) for t in texts]
    words = np.array(list(index), dtype=object)
    if not len(words):
        return Model(np.zeros(SPACE), 0.0, 0.0, 0.0)
    n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
    pos, neg = (np.bincount(np.concatenate([b for b, y in zip(bags, toxic) if y == k] + [np.zeros(0, np.int64)]), minlength=len(words)) for k in (1, 0))
    share = (pos + neg + 1) / (n1 + n0 + 2)
    # How far a word's share of toxic documents lies above that of the others, in deviations.
    surprise = (pos / n1 - neg / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    clean = np.flatnonzero(neg)
    picked = np.union1d(clean[np.argsort(-neg[clean], kind="stable")[:1500]], rng.permutation(clean)[:3000])
    marked = (surprise >= SURE) & (pos / n1 >= 4 * (neg + 1) / n0)
    raw, hard = surprise, np.zeros(0, np.int64)
    model = None
    for turn in range(rounds):
        count = np.zeros(len(words), np.int64)
        for bag, y in zip(bags, toxic):
            if y and len(bag):
                # Words that stand out about as much as any of the document: of copies of one document all words stand out.
                bar = NEAR_BEST * surprise[bag].max()
                clear = bag[marked[bag] & (surprise[bag] >= bar) & ((raw[bag] > 0) | (turn == 0))]
                count[clear] += 1
                if not len(clear) and (turn or not marked.any()):  # first from the plain cases
                    count[bag[(raw[bag] - 10 * (neg[bag] > 0)).argmax()]] += 1
        yes = np.flatnonzero(count)
        no = np.setdiff1d(np.union1d(picked, hard), yes)
        top = yes[np.argsort(-count[yes], kind="stable")[: LANDMARKS // 2]]
        marks = np.concatenate([top, rng.permutation(no)[: LANDMARKS - len(top)]])
        vectors = columns(list(words[marks]))
        spread, basis = np.linalg.eigh((vectors.T @ vectors).astype(np.float64))
        good = spread > 1e-4 * spread.max()
        root = basis[:, good] / np.sqrt(spread[good])
        x = kernel(list(words[np.concatenate([yes, no])]), vectors) @ root
        y = np.where(np.arange(len(x)) < len(yes), 1.0, -1.0)
        cost = np.concatenate([0.5 * np.minimum(count[yes], 20), np.full(len(no), 0.5)])
        w = _svm(x, y, cost)
        weights = np.concatenate([vectors[at : at + 4096].astype(np.float64) @ (root @ w[:-1]) for at in range(0, len(vectors), 4096)])
        model = Model(weights, float(w[-1]), 1.0, 0.0)
        raw = np.concatenate([model.raw(list(words[at : at + 4096])) for at in range(0, len(words), 4096)])
        hard = np.unique(np.array([b[raw[b].argmax()] for b, y in zip(bags, toxic) if not y and len(b)], dtype=np.int64))
    highest = np.array([raw[b].max() if len(b) else -np.inf for b in bags])
    model.slope, model.middle = _logistic(highest, toxic)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = 800) -> Model:
    """A model from at most `rows` toxic and `rows` other labelled documents, chosen by a hash of their ids, none held out.

    Of several texts of an id the one with the least hash counts. That sample, bounded by
    `rows`, goes to one task; only the model reaches the driver.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = known.where("label > 0").orderBy(*order).limit(rows).union(known.where("label <= 0").orderBy(*order).limit(rows))
    # At most 2 * rows ids and labels: a broadcast of known size.
    met = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    found = met.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text", "label")).alias("r")).select("doc_id", "r.text", "r.label")
    made = found.repartition(1).mapInArrow(_fitted, "model binary").first()
    return pickle.loads(made.model) if made else fit([], np.zeros(0))


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fits the model where the sample is, on one executor."""
    rows = sorted({(i, t or "", y) for b in batches for i, t, y in zip(*(c.to_pylist() for c in b.columns))})
    model = fit([t for _, t, _ in rows], np.array([y > 0 for _, _, y in rows], dtype=np.int64))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def _scored(batches: Iterator[pa.RecordBatch], sent, text: int, name: str) -> Iterator[pa.RecordBatch]:
    model = sent.value
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            score = model.score(part.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*part.schema.names, name])


def scores(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs and, as a column of that name, the score of each text; a column of docs with the name is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.drop(name).withColumn("text", F.col("text").cast("string"))
    at = rows.columns.index("text")
    return rows.mapInArrow(lambda it: _scored(it, sent, at, name), T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5, rows: int = 800) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Whole texts are scored. Null and empty texts have no unit and score lowest. Labels of
    held-out ids are never read; of several labels of an id the highest counts. No usable
    label: score 0.5. Repeated rows and null ids return as they are; further columns of
    docs are ignored.
    """
    model = train(docs, labels, label, rows)
    out = scores(docs.select(F.col("doc_id").cast("bigint"), "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
