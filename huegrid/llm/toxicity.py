"""Toxicity: a support vector machine on a gapped subsequence string kernel with Nystroem landmarks.

The kernel of two words is the product of their weighted counts of common character subsequences of length three, each
spread over at most ``SPAN`` characters and weighted by ``DECAY`` for every character that it skips; word starts and ends
count as characters. So ``idiot``, ``idi-ot`` and ``i.d.i.o.t###`` stay close. A sentence is a bag of words, and the
label of a document says whether it has an offending sentence: all sentences of a document labelled 0 are negative, and
of a document labelled 1 the sentence with the highest margin is positive, represented by its witness word
(multiple-instance SVM). Landmarks are witnesses and hard negative words; the Nystroem map sends a word to
``W^-1/2 k(landmarks, word)``, and a squared-hinge SVM is fitted there. As the kernel has an explicit feature space, the
fitted function folds into one weight for each character triple, so scoring a word costs a few dozen look-ups.
A document's score is a logistic function of its highest margin and of the number of words above zero.

The fit uses at most ``sample`` labelled documents a class (the first ones by a hash of their id, of those with at most
``longest`` characters); scoring covers every
word of every document. Nothing but the text enters a score.

Defined results: null and empty texts score like a text without offending words; rows with a null id are scored and not
held out; repeated rows give repeated results; with no labelled rows of either class the score is the share of label 1
(0 without any); extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huegrid.llm.common import Vocabulary, by_size, doc_bucket, slices, table, tidy, words_of

SPAN, DECAY, WIDTH = 6, 0.6, 24
OFFSETS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]
N_CODES = 64**3
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
SPACED = re.compile(rb"(?:(?<=\s)|^)(?:\S\s){2,}\S(?=\s|$)")


def _alphabet() -> np.ndarray:
    """A code 1..61 for each code point below 65536: letters and digits on their own, the others shared."""
    code = np.array([38 + c % 24 for c in range(65536)], np.uint8)
    code[:128] = 37
    for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789"):
        code[ord(c)] = 1 + i
    return code


ALPHABET = _alphabet()


def word_matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Character codes of each word between start and end marks, zero-padded; long words become overlapping rows.
    The second array says which word a row belongs to."""
    rows, owner = [], []
    for k, word in enumerate(words):
        text = word.decode("utf-8", "replace").lower()
        if len(text) <= WIDTH:
            rows.append("\x02" + text + "\x03")
        else:
            text = "\x02" + text + "\x03"
            rows.extend(text[i : i + WIDTH + 2] for i in range(0, len(text) - WIDTH // 2, WIDTH // 2))
        owner.extend([k] * (len(rows) - len(owner)))
    points = np.zeros((len(rows), WIDTH + 2), np.uint32)
    for start in range(0, len(rows), 50_000):
        some = rows[start : start + 50_000]
        joined = "".join(r.ljust(WIDTH + 2, "\x00") for r in some)
        points[start : start + len(some)] = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).reshape(len(some), WIDTH + 2)
    out = ALPHABET[np.minimum(points, 65535)]
    out[points == 0], out[points == 2], out[points == 3] = 0, 62, 63
    return out, np.array(owner, np.int64)


def subsequences(matrix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each way to skip: codes of the character triples, which of them exist, and their weight."""
    wide = matrix.astype(np.int32)
    for i, j in OFFSETS:
        first, second, third = wide[:, : wide.shape[1] - j], wide[:, i : wide.shape[1] - j + i], wide[:, j:]
        yield (first << 12) | (second << 6) | third, third > 0, DECAY ** (j - 2)


def _norms(matrix: np.ndarray) -> np.ndarray:
    """Length of a word's feature vector, as if no triple occurred twice in it."""
    n = (matrix > 0).sum(1)
    total = np.zeros(len(n))
    for _, j in OFFSETS:
        total += np.maximum(n - j, 0) * DECAY ** (2 * (j - 2))
    return np.sqrt(np.maximum(total, 1))


def _linear(words: list[bytes], weights: np.ndarray) -> np.ndarray:
    """For each word the highest product of its (normed) feature vector rows with the weights."""
    out = np.full(len(words), -np.inf)
    for part in slices(len(words), 10_000):
        matrix, owner = word_matrix(words[part])
        total = np.zeros(len(matrix))
        for codes, there, weight in subsequences(matrix):
            total += weight * np.where(there, weights[codes], 0).sum(1)
        np.maximum.at(out, part.start + owner, total / _norms(matrix))
    return out


def _features(words: list[bytes], weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The normed feature vectors in coordinates: row (word), code, value; of a long word, the row with the highest product with the weights."""
    matrix, owner = word_matrix(words)
    total = np.zeros(len(matrix)) if weights is None else sum(w * np.where(there, weights[codes], 0).sum(1) for codes, there, w in subsequences(matrix)) / _norms(matrix)
    order = np.lexsort((-total, owner))
    matrix = matrix[order[np.unique(owner[order], return_index=True)[1]]]
    norms, parts = _norms(matrix), []
    for codes, there, weight in subsequences(matrix):
        row, at = np.nonzero(there)
        parts.append((row, codes[row, at], weight / norms[row]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _close_triples(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the triples of each word that skip at most one character, and where each word's codes start."""
    parts, counts = [], np.zeros(len(words) + 1, np.int64)
    for part in slices(len(words), 20_000):
        matrix, owner = word_matrix(words[part])
        near = [(codes, there) for (codes, there, _), (_, j) in zip(subsequences(matrix), OFFSETS, strict=True) if j <= 3]
        codes = np.concatenate([c for c, _ in near], axis=1)
        there = np.concatenate([t for _, t in near], axis=1)
        parts.append(codes[there])  # row by row
        np.add.at(counts, part.start + owner + 1, there.sum(1))
    return (np.concatenate(parts) if parts else np.empty(0, np.int32)), np.cumsum(counts)


@dataclass
class Model:
    weights: np.ndarray  # of each character triple
    bias: float
    logistic: np.ndarray  # of margin, log count, 1
    constant: float | None = None

    def margins(self, words: list[bytes]) -> np.ndarray:
        return _linear(words, self.weights) + self.bias

    def score(self, best: np.ndarray, count: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(best), self.constant)
        return 1 / (1 + np.exp(-np.clip(evidence(best, count) @ self.logistic, -30, 30)))


def evidence(best: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.stack([np.clip(best, -3, 3), np.log1p(count), np.ones(len(best))], 1)


def joined_spacing(text: str | None) -> str | None:
    """Letters set apart by single spaces, joined again as a further word."""
    if not text or len(text) < 5:
        return text
    found = SPACED.findall(text.encode("utf-8", "surrogatepass"))
    return text + "\n" + "\n".join(re.sub(rb"\s", b"", x).decode("utf-8", "replace") for x in found) if found else text


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Squared-hinge linear SVM by Newton steps on the active rows."""
    beta, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-4
    for _ in range(30):
        active = y * (x @ beta) < 1
        xa, ca = x[active], cost[active]
        new = np.linalg.solve(ridge + (xa * ca[:, None]).T @ xa, xa.T @ (ca * y[active]))
        if np.allclose(new, beta, atol=1e-6):
            break
        beta = beta + (new - beta) * (1.0 if _ < 15 else 0.5)
    return beta


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w, ridge = np.zeros(x.shape[1]), np.diag([0.05] * (x.shape[1] - 1) + [0.01])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[str | None], labels: list[int], landmarks: int = 160, rounds: int = 4, seed: int = 7) -> Model:
    """Fit on whole texts with labels 0 and 1."""
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(N_CODES, np.float32), 0.0, np.zeros(3), float(y.mean()) if len(y) else 0.0)
    random, vocabulary = np.random.default_rng(seed), {}
    bags: list[list[np.ndarray]] = []  # of each document, its sentences' words
    for text in texts:
        sentences = [words_of(s) for s in SENTENCE.split(joined_spacing(text) or "")]
        bags.append([np.array(sorted({vocabulary.setdefault(w, len(vocabulary)) for w in s}), np.int64) for s in sentences if s])
    words = list(vocabulary)
    flat = [np.unique(np.concatenate(b)) if b else np.empty(0, np.int64) for b in bags]
    n, times = np.bincount(y, minlength=2), np.zeros((2, len(words)))
    for f, label in zip(flat, y, strict=True):
        times[label, f] += 1
    # A witness is a word that documents of label 1 have several times as often; mislabelled ones may have none.
    able = (times[1] + 0.5) / n[1] > 4 * (times[0] + 0.5) / n[0]
    clean = np.nonzero((times[0] > 0) & ~able)[0]
    # Where to look first: triples that documents of label 1 have more often.
    code, ends = _close_triples(words)
    seen = np.zeros((2, N_CODES))
    for f, label in zip(flat, y, strict=True):
        have = np.zeros(N_CODES, bool)
        for w in f:
            have[code[ends[w] : ends[w + 1]]] = True
        seen[label] += have
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    weights, bias = np.where(seen[1] + seen[0] >= 3, odds, 0).astype(np.float32), 0.0
    hard = np.empty(0, np.int64)
    for turn in range(rounds):
        margin = _linear(words, weights) + bias
        floor = np.quantile(margin[clean], 0.999) if len(clean) else -np.inf
        margin = np.where(able, margin, -np.inf)
        witness = []
        for b, label in zip(bags, y, strict=True):
            if label and b:
                sentence = max(b, key=lambda s: margin[s].max())
                witness.append(sentence[margin[sentence].argmax()])
        witness = np.array(witness, np.int64)
        if turn:  # a document whose witness looks clean is taken for mislabelled
            kept = witness[margin[witness] > max(floor, 0 if turn > 1 else floor)]
            witness = kept if len(kept) else witness[np.isfinite(margin[witness])]
        else:
            witness = witness[able[witness]]
        if not len(witness):
            break
        worst = clean[np.argsort(-(_linear([words[k] for k in clean], weights)), kind="stable")[:3000]] if len(clean) else clean
        hard = np.unique(np.concatenate([hard, worst, random.choice(clean, min(len(clean), 3000), replace=False)])) if len(clean) else hard
        chosen, times = np.unique(witness, return_counts=True)
        marks = np.concatenate([chosen[np.argsort(-times, kind="stable")[: landmarks // 2]], random.choice(hard, min(len(hard), landmarks // 2), replace=False)]) if len(hard) else chosen[:landmarks]
        marks = np.unique(marks)
        mrow, mcode, mvalue = _features([words[k] for k in marks], weights)
        used, compact = np.unique(mcode, return_inverse=True)
        space = np.zeros((len(used) + 1, len(marks)), np.float32)
        np.add.at(space, (compact, mrow), mvalue)
        gram = space.T @ space
        value, vector = np.linalg.eigh(gram.astype(np.float64))
        good = value > 1e-6 * value.max()
        root = vector[:, good] / np.sqrt(value[good])  # Nystroem: W^-1/2, without null directions
        rows = np.concatenate([witness, hard])
        k = np.zeros((len(rows), len(marks)), np.float32)
        for part in slices(len(rows), 400):
            r, c, v = _features([words[i] for i in rows[part]], weights)
            at = np.searchsorted(used, c)
            at[(at == len(used)) | (used[np.minimum(at, len(used) - 1)] != c)] = len(used)
            keep = at < len(used)
            dense = np.zeros((part.stop - part.start, len(used)), np.float32)
            np.add.at(dense, (r[keep], at[keep]), v[keep])
            k[part] = dense @ space[:-1]
        x = np.column_stack([k @ root, np.ones(len(rows))])
        target = np.concatenate([np.ones(len(witness)), -np.ones(len(hard))])
        cost = np.where(target > 0, 20.0 * max(1.0, len(hard) / max(1, len(witness)) / 4), 20.0)
        beta = _svm(x, target, cost)
        weights = np.zeros(N_CODES, np.float32)
        weights[used] = space[:-1] @ (root @ beta[:-1])
        bias = float(beta[-1])
    model = Model(weights, bias, np.zeros(3))
    margin = model.margins(words)
    best = np.array([margin[f].max() if len(f) else -3 for f in flat])
    count = np.array([(margin[f] > 0).sum() for f in flat])
    model.logistic = _logistic(evidence(best, count), y)
    if model.logistic[0] <= 0 or model.logistic[1] < 0:  # both must speak for label 1; else the margin alone
        alone = _logistic(evidence(best, count)[:, [0, 2]], y)
        model.logistic = np.array([alone[0], 0, alone[1]])
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int, held_out: int | None = 5, longest: int = 200_000) -> DataFrame:
    """(text, toxic) of at most ``sample`` labelled documents of each class, the first by a hash of their id."""
    rows = labels.select("doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    if held_out:
        rows = rows.where(doc_bucket(held_out) != 0)
    rows = rows.withColumn("o", F.xxhash64("doc_id"))
    some = None
    for label in (0, 1):
        part = rows.where(F.col("toxic") == label).orderBy("o", "doc_id").limit(sample).select("doc_id", "toxic")
        some = part if some is None else some.union(part)
    return docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= longest).join(F.broadcast(some.dropDuplicates(["doc_id"])), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic")


def train(docs: DataFrame, labels: DataFrame, sample: int = 1500, held_out: int | None = 5) -> Model:
    rows = sorted(labelled_sample(docs, labels, sample, held_out).collect(), key=lambda r: r.doc_id)
    return fit([r.text for r in rows], [r.toxic for r in rows])


@tidy
def _scores(batches: Iterator[pa.RecordBatch], model: Model, name: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    vocabulary, margin, turn = Vocabulary(), np.empty(0), 0
    for batch in batches:
        for part in by_size(batch.column("text")):
            rows = batch.slice(part.start, part.stop - part.start)
            ids, ends = vocabulary.encode([joined_spacing(t) for t in rows.column("text").to_pylist()])
            if turn != vocabulary.turn:
                margin, turn = np.empty(0), vocabulary.turn
            margin = np.concatenate([margin, model.margins(vocabulary.words(len(margin)))])
            best, count = np.full(rows.num_rows, -3.0), np.zeros(rows.num_rows)
            for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                if b > a:
                    m = margin[ids[a:b]]
                    best[i] = m.max()
                    if best[i] > 0:
                        count[i] = len(np.unique(ids[a:b][m > 0]))
            score = model.score(best, count)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), pa.array(score, pa.float64())], [*keep, name])


def with_score(docs: DataFrame, model: Model, name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all of them by default) and the score of every row, without a shuffle."""
    keep = docs.columns if keep is None else keep
    if name in keep:
        raise ValueError(f"documents have a column {name} already; give the score another name")
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(name, T.DoubleType())])
    return rows.mapInArrow(lambda b: _scores(b, model, name, keep), schema)


def op7_toxicity(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(doc_bucket(5) == 0, F.lit(False))
    return with_score(docs, model, keep=["doc_id"]).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
