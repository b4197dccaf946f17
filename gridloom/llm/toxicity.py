"""Toxicity scores from a subsequence string kernel, Nyström landmarks and a support vector machine.

A text is cut into spans: its words, runs of single characters read as one word, and neighbouring words that together
spell a landmark. The kernel of two spans counts the three-letter subsequences they share, each weighted by DECAY to the
power of the stretch it covers (at most STRETCH characters), and is normalised; so gaps and inserted characters weaken a
match without undoing it. A span is also read without its punctuation, and the better reading counts.

Labels belong to whole texts, of which one sentence is what makes them toxic, so training takes each toxic text's
witness, its highest-scoring span, against the spans of clean texts, and chooses witnesses anew after each fit. The
landmark words and copies of them with a letter put in count as witnesses too. Landmarks
are words that set toxic training texts apart, frequent words of clean ones, and the words of clean texts most often
nearest to the first. What sets words apart is the significance of their counts among words that are as frequent. The kernel to the landmarks, whitened by
Nyström's method, feeds a linear machine with squared hinge loss, and a logistic curve turns a text's highest decision
into a score. Since the kernel is a sum over subsequences, the fitted machine folds into one weight per subsequence.

The classifier is fitted on at most ``per_class`` labelled texts of each class, drawn by a hash of the id; all texts are
scored whole.

Cases: null and blank texts, and texts without a span of three letters, get the score of an empty text; rows of labels
with a null id or label are ignored, several labels of an id count as toxic if one does; without training rows of both
classes every score is the share of toxic rows (0 with none); repeated rows are scored each.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.text import Batches, map_batches, saved

DECAY, STRETCH, LONGEST = 0.7, 6, 32
CODES = 1 << 18
PUNCTUATION = re.compile(r"[\W_]+")
SENTENCE = re.compile(r"(?<=[.!?\n])\s+|\n")
LANDMARKS, PLAIN_LANDMARKS, ROUNDS, SPANS_PER_TEXT = 160, 48, 3, 10
#: Of all words that are in one number of training texts, so many are taken for landmarks apart by chance at most.
CHANCE = 0.1
#: Weight of clean spans in the fit; those of toxic texts weigh 1.
CLEAN_WEIGHT = 4.0


def letters(words: list[str]) -> np.ndarray:
    """Words of one length -> six-bit letters: a to z, 35 classes for all other characters, and marks of the word's start
    (two) and end."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1).astype(np.int64)
    marked = np.full((len(words), points.shape[1] + 3), 62)
    marked[:, 1], marked[:, -1] = 63, 0
    marked[:, 2:-1] = np.where((points >= 97) & (points <= 122), points - 96, 27 + points % 35)
    return marked


def subsequences(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions i < j < k of subsequences of a word of n letters, and their weights."""
    found = [(i, j, k) for i in range(n) for k in range(i + 2, min(n, i + STRETCH)) for j in range(i + 1, k)]
    i, j, k = np.array(found, np.int64).reshape(-1, 3).T
    return i, j, k, DECAY ** (k - i + 1.0)


def windows(word: str) -> list[str]:
    """The word, or overlapping parts of a very long one."""
    if len(word) <= LONGEST:
        return [word]
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def features(words: list[str]):
    """(positions, codes, weights, norms) for groups of words of one length from 3 to LONGEST."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths[lengths >= 3]):
        i, j, k, weight = subsequences(int(n) + 3)
        for at in np.array_split(np.flatnonzero(lengths == n), 1 + (lengths == n).sum() * len(weight) // 2_000_000):
            c = letters([words[x] for x in at])
            codes = c[:, i] << 12 | c[:, j] << 6 | c[:, k]
            order = np.argsort(codes, axis=1)
            ordered = np.take_along_axis(codes, order, 1)
            fresh = np.ones(codes.shape, bool)
            fresh[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
            starts = np.flatnonzero(fresh)
            sums = np.add.reduceat(weight[order].ravel(), starts)
            norms = np.sqrt(np.bincount(starts // codes.shape[1], sums**2, minlength=len(at)))
            yield at, codes, weight, norms


@dataclass
class Landmarks:
    """Normalised features of landmark words: ``row[code]`` is the code's row in ``matrix`` (0: in no landmark)."""

    words: list[str]
    row: np.ndarray
    matrix: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> Landmarks:
        entries = []
        for at, codes, weight, norms in features(words):
            entries += [(code, x, w / norm) for x, row, norm in zip(at, codes, norms, strict=True) for code, w in zip(row, weight, strict=True)]
        row = np.zeros(CODES, np.int32)
        used = sorted({e[0] for e in entries})
        row[used] = np.arange(1, len(used) + 1)
        matrix = np.zeros((len(used) + 1, len(words)), np.float32)
        for code, x, w in entries:
            matrix[row[code], x] += w
        return cls(words, row, matrix)

    def kernel(self, words: list[str]) -> np.ndarray:
        """Kernel of each word to each landmark; words shorter than three letters have none."""
        out = np.zeros((len(words), len(self.words)), np.float32)
        for at, codes, weight, norms in features(words):
            rows = self.row[codes]
            for t in range(codes.shape[1]):
                live = np.flatnonzero(rows[:, t])
                out[at[live]] += self.matrix[rows[live, t]] * np.float32(weight[t])
            out[at] /= norms[:, None]
        return out


def spans(text: str, splits: dict[str, set[str]]) -> list[str]:
    """Lower-case spans of a text. ``splits`` maps the beginnings of landmarks to their ends."""
    words = text.lower().split()
    single = [i for i, w in enumerate(words) if len(w) == 1]
    extra = []
    if len(single) > 2:
        at = np.array(single)
        for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
            if len(run) > 2:
                extra.append("".join(words[run[0] : run[-1] + 1]))
    for i, w in enumerate(words[:-1]):
        if w in splits and PUNCTUATION.sub("", words[i + 1]) in splits[w]:
            extra.append(w + PUNCTUATION.sub("", words[i + 1]))
    return words + extra


def readings(span: str) -> list[str]:
    bare = PUNCTUATION.sub("", span)
    return windows(span) + (windows(bare) if bare != span else [])


@dataclass
class Machine:
    weights: np.ndarray  # one per subsequence code
    bias: float
    slope: float
    offset: float
    splits: dict[str, set[str]]

    def decisions(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.bias)
        for at, codes, weight, norms in features(words):
            out[at] += (self.weights[codes] @ weight) / norms
        return out

    def learn(self, new: list[str], known: dict[str, float]) -> None:
        """Adds the decisions of new spans to ``known``."""
        parts = [readings(s) for s in new]
        flat = self.decisions([w for p in parts for w in p])
        at = 0
        for s, p in zip(new, parts, strict=True):
            known[s] = max(flat[at : at + len(p)].max(initial=self.bias), self.bias)
            at += len(p)

    def score(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * decision + self.offset, -50, 50)))


def split_pairs(words: list[str]) -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for w in words:
        for i in range(2, len(w) - 1):
            out.setdefault(w[:i], set()).add(w[i:])
    return out


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 3000.0, steps: int = 40) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss: Newton steps on the rows within the margin, until these stay the same."""
    x = np.c_[x, np.ones(len(x))]
    weight = weight / weight.sum()
    ridge = np.full(x.shape[1], 1 / c)
    ridge[-1] = 1e-9
    w, active = np.zeros(x.shape[1]), np.ones(len(x), bool)
    for step in range(steps):
        part = x[active] * weight[active, None]
        full = np.linalg.solve(2 * part.T @ x[active] + np.diag(ridge), 2 * part.T @ y[active])
        w = full if step < steps // 2 else (w + full) / 2
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def logistic(d: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve with smoothed targets (Platt)."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.full(len(y), 1 / len(y))
    x, w = np.c_[d, np.ones(len(d))], np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        gradient = x.T @ (weight * (p - target)) + 1e-4 * w
        w -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2), gradient)
    return float(w[0]), float(w[1])


def augmented(words: list[str]) -> list[str]:
    """Each word with a letter put in at each of its inner places."""
    return [w[:i] + "xqz"[i % 3] + w[i:] for w in words for i in range(1, len(w))]


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """``doc_id, text, toxic`` of the labelled training texts, at most ``per_class`` of a class."""
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isNotNull() & learn)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    return docs.join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id")  # at most 2 * per_class small rows


def choose_landmarks(rows: DataFrame) -> tuple[list[str], list[str]]:
    """Words that set toxic texts apart, and frequent words of clean ones."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [{PUNCTUATION.sub("", w) for w in (t or "").lower().split()} for t in batch.column(0).to_pylist()]
        words = [[w for w in ws if 3 <= len(w) <= LONGEST] for ws in words]
        toxic = np.repeat(batch.column(1).to_numpy(), [len(w) for w in words])
        return pa.RecordBatch.from_arrays([pa.array([w for ws in words for w in ws], pa.string()), pa.array(toxic, pa.int32())], ["word", "toxic"])

    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    counts = map_batches(rows.select("text", "toxic"), run, "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    counts = saved(counts)
    n1, n0 = max(n.get(1, 0), 1), max(n.get(0, 0), 1)
    rate_a, rate_b = F.col("a") / n1, (F.col("b") + 0.5) / n0
    # the likelihood ratio of counts that are split as the texts are; its chance is below exp(-half of it)
    part = lambda k, share: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / ((F.col("a") + F.col("b")) * F.lit(share)))).otherwise(0.0)
    ratio = 2 * (part("a", n1 / (n1 + n0)) + part("b", n0 / (n1 + n0)))
    both = (F.col("a") + F.col("b")).alias("both")
    alike = counts.groupBy(both).agg(F.count("*").alias("tested"))  # a row for each number of texts, 2 * per_class at most
    tested = counts.withColumn("both", both).join(F.broadcast(alike), "both")
    apart = tested.filter((F.col("a") >= 3) & (ratio >= 2 * F.log(F.col("tested") / CHANCE)) & (rate_a > 10 * rate_b)).orderBy(F.desc(rate_a * F.log(rate_a / rate_b)), "word").limit(LANDMARKS)
    plain = counts.filter((F.length("word") > 3) & (rate_a < 1.5 * rate_b)).orderBy(F.desc("b"), "word").limit(PLAIN_LANDMARKS)
    return [r.word for r in apart.collect()], [r.word for r in plain.collect()]


def hardest_spans(rows: DataFrame, landmarks: Landmarks, n_apart: int, splits: dict[str, set[str]]) -> DataFrame:
    """``bag, toxic, span``: the spans of each text, sentence by sentence, that are nearest to a landmark apart."""
    shared = rows.sparkSession.sparkContext.broadcast(landmarks)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        ids, texts, toxic = (batch.column(i).to_pylist() for i in range(3))
        for at in range(0, len(ids), 300):
            part = [{r for sentence in SENTENCE.split(t or "") for s in spans(sentence, splits) for r in readings(s) if len(r) > 2} for t in texts[at : at + 300]]
            words = sorted(set().union(*part))
            near = dict(zip(words, shared.value.kernel(words)[:, :n_apart].max(axis=1, initial=0), strict=True))
            for bag, y, found in zip(ids[at:], toxic[at:], part, strict=False):
                best = sorted(found, key=lambda w: (-near[w], w))[:SPANS_PER_TEXT]
                out += [(bag, y, s) for s in best or [""]]
        bags, ys, words = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(bags, pa.int64()), pa.array(ys, pa.int32()), pa.array(words, pa.string())], ["bag", "toxic", "span"])

    return map_batches(rows.select("doc_id", "text", "toxic"), run, "bag long, toxic int, span string")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000) -> Machine:
    """The machine of at most ``per_class`` labelled training texts of each class."""
    rows = saved(training_rows(docs, labels, per_class))
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = n.get(1, 0) / max(sum(n.values()), 1)
    constant = Machine(np.zeros(CODES), 0.0, 0.0, float(np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -20, 20)), {})
    apart, plain = choose_landmarks(rows)
    if not n.get(0) or not n.get(1) or not apart:
        return constant
    splits = split_pairs(apart)
    landmarks = Landmarks.of(apart + plain)
    found = hardest_spans(rows, landmarks, len(apart), splits).collect()  # 2 * per_class * SPANS_PER_TEXT words at most
    bags: dict[int, tuple[int, list[str]]] = {}
    for r in found:
        bags.setdefault(r.bag, (r.toxic, []))[1].append(r.span)
    words = sorted({r.span for r in found})
    number = {w: i for i, w in enumerate(words)}
    more = apart + augmented(apart)
    near_clean = Counter(r.span for r in found if not r.toxic and len(r.span) > 2)
    landmarks = Landmarks.of(list(dict.fromkeys(apart + plain + [w for w, _ in near_clean.most_common(PLAIN_LANDMARKS * 4)])))
    kernel = np.r_[landmarks.kernel(words), landmarks.kernel(more)].astype(float)
    values, vectors = np.linalg.eigh(landmarks.kernel(landmarks.words).astype(float))
    keep = values > 1e-3
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    x = kernel @ whiten
    clean = np.array(sorted({number[s] for toxic, ss in bags.values() if not toxic for s in ss}))
    toxic_bags = [np.array([number[s] for s in ss]) for toxic, ss in bags.values() if toxic]
    decision = kernel[:, : len(apart)].max(axis=1)
    extra = np.arange(len(words), len(words) + len(more))
    for _ in range(ROUNDS):
        # a text whose witness looks like clean words tells nothing about toxic ones
        witness = np.unique([b[np.argmax(decision[b])] for b in toxic_bags])
        usable = np.setdiff1d(witness, clean)
        positive = np.r_[usable if len(usable) else witness, extra]
        at = np.r_[positive, clean]
        y = np.r_[np.ones(len(positive)), -np.ones(len(clean))]
        weight = np.r_[np.full(len(positive), 1 / len(positive)), np.full(len(clean), CLEAN_WEIGHT / len(clean))]
        w, bias = squared_hinge(x[at], y, weight)
        decision = x @ w + bias
    per_landmark = whiten @ w
    weights = np.r_[0.0, landmarks.matrix[1:] @ per_landmark][landmarks.row]
    tops = np.array([decision[[number[s] for s in ss]].max() for _, ss in bags.values()])
    slope, offset = logistic(np.maximum(tops, bias), np.array([float(t) for t, _ in bags.values()]))
    return Machine(weights, bias, slope, offset, splits)


def score_documents(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", per_class: int = 3000) -> DataFrame:
    """doc_id, held_out, score, predicted, span (the one that decided) for each row."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows, labels, per_class))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 5 == 0
    state: dict[str, dict[str, float]] = {}

    def run(batches: Batches) -> Batches:
        machine = shared.value
        known = state.setdefault("known", {})
        for batch in batches:
            texts = batch.column(2).to_pylist()
            tops, why = [], []
            for at in range(0, len(texts), 500):
                cut = [spans(t or "", machine.splits) for t in texts[at : at + 500]]
                if len(known) > 500_000:
                    known.clear()
                machine.learn(list({s for c in cut for s in c if s not in known}), known)
                best = [max(c, key=known.__getitem__, default=None) for c in cut]
                tops += [machine.bias if s is None else known[s] for s in best]
                why += best
            score = machine.score(np.array(tops))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(why, pa.string())], ["doc_id", "held_out", "score", "predicted", "span"])

    return rows.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, span string")
