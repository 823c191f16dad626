"""Toxicity: a support vector machine on a gap-weighted subsequence string kernel with Nystroem landmarks.

Kernel. For a landmark z and a stretch w of a word, at most ``MOST_INSERTED`` letters longer than z: the mean, over the
subsequence lengths 4 and 5, of the gap-weighted subsequence kernel K_p(w, z) divided by K_p(z, z), capped at 1; the best
stretch of a word counts. Each skipped letter costs the factor ``DECAY``, so that a word with one letter
inserted keeps about 0.7 of its similarity and one with two about half of it. A word's other characters than letters are
dropped first (``i.d.i.o.t`` is ``idiot``), and runs of single letters count as one more word. Values under ``FLOOR`` count
as 0. A sentence's similarity to a landmark is that of its nearest word.

Training, on the driver, on a bounded sample of labelled rows: at most ``max_per_class`` of either class (the smallest hashes
of their ids) and at most ``max_bytes`` of their text; a text of more than a sixteenth of that is not trained on. The
landmarks are the letter sequences that, one after another, occur in most toxic rows (each counts half as much for every
landmark it has already) and in hardly any other. Similarities are whitened by the landmarks' own kernel matrix. A
squared-hinge machine is trained on sentences, where a toxic row's label counts for its highest-scoring sentence (found anew
in each of a few rounds) and another row's for all of its sentences; each landmark, alone, and again with two letters
inserted, is a virtual toxic sentence. A logistic curve turns a row's highest sentence score into a probability.

Scoring is one pass over the whole texts without any shuffle; the model is a few KB. Kernels are computed once a distinct
word, and only for words that share enough letters with a landmark.

Defined results. Null, empty or blank text: the score of a row without any similar word. Labelled rows of that kind, or of
words of fewer than three letters, are trained on as rows without landmarks. No toxic or no other labelled row: every score
is the share of toxic rows, or 0 without any labels. Rows labelled several times count as toxic if one of them is. Rows that
repeat an id are each scored. Columns of the input are carried in a struct, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

LENGTHS = (4, 5)
DECAY, FLOOR = 0.7, 0.1
MAX_WORD, OVERLAP = 48, 24
LONGEST = 12
MOST_INSERTED = 2
CACHE = 400_000
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_LEET = str.maketrans("013457@", "oieasta")
_END = re.compile(r"[.!?][\"')\]]*$")
START = "^"  # stands before each word as a letter of its own


def letters(word: str) -> str:
    """Lower-case letters of a word; digits and @ inside of a word that has letters stand for the letters they look like."""
    word = word.lower()
    if word.isalpha():
        return word
    if any(c.isalpha() for c in word):
        word = word.translate(_LEET)
    return _NOT_LETTERS.sub("", word)


def coded(words: list[str], width: int) -> np.ndarray:
    """Letters as numbers 1 to 63 (rare ones share numbers), 0 behind the end."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    out = np.zeros((len(words), width), np.uint8)
    at = np.arange(len(raw)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(words)), lengths), at] = np.where((raw >= 97) & (raw < 123), raw - 96, np.where(raw == ord(START), 27, 28 + raw % 36))
    return out


def subsequence_kernel(w: np.ndarray, z: np.ndarray, decay: float = DECAY) -> np.ndarray:
    """K_p for p in LENGTHS of pairs of coded words, one pair a row: shape (pairs, len(LENGTHS))."""
    n, width, tall = len(w), w.shape[1], z.shape[1]
    decay = np.float32(decay)
    out = np.zeros((n, len(LENGTHS)), np.float32)
    same = [[((w[:, i] == z[:, j]) & (w[:, i] > 0)).astype(np.float32) * (decay * decay) for j in range(tall)] for i in range(width)]
    before = None  # K' of the length before, for prefixes of w and z; 1 for length 0
    scratch = np.empty(n, np.float32)
    for p in range(1, max(LENGTHS) + 1):
        total = np.zeros(n, np.float32)
        now = np.zeros((width + 1, tall + 1, n), np.float32) if p < max(LENGTHS) else None
        for i in range(p - 1, width):
            run = np.zeros(n, np.float32)
            for j in range(p - 1, tall):
                ended = same[i][j] if before is None else np.multiply(same[i][j], before[i, j], out=scratch)
                if p in LENGTHS:
                    total += ended
                if now is not None:
                    run *= decay
                    run += ended
                    np.multiply(now[i, j + 1], decay, out=now[i + 1, j + 1])
                    now[i + 1, j + 1] += run
        if p in LENGTHS:
            out[:, LENGTHS.index(p)] = total
        before = now
    return out


class Similarity:
    """Kernel values of words against fixed landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.coded = coded(landmarks, max(map(len, landmarks), default=1))
        self.lengths = np.array([len(z) for z in landmarks], np.int64)
        self.own = subsequence_kernel(self.coded, self.coded)
        self.mask = self._masks(self.coded)
        # A common subsequence of p letters has at least this many different ones.
        self.least = np.array([min((len(set(z[:k] + z[k + 1 :])) if len(z) > min(LENGTHS) else len(set(z))) - (len(z) - 1 - min(LENGTHS) if len(z) > min(LENGTHS) else 0) for k in range(len(z))) for z in landmarks])

    @staticmethod
    def _masks(codes: np.ndarray) -> np.ndarray:
        return np.bitwise_or.reduce(np.where(codes > 0, np.uint64(1) << codes.astype(np.uint64), np.uint64(0)), axis=-1)

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the word, landmark, value) of all values from FLOOR on."""
        found = []
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        for a in range(0, len(order), 4096):
            at = np.array(order[a : a + 4096])
            group = [words[k] for k in at]
            codes = coded(group, max(map(len, group), default=1) or 1)
            for length in np.unique(self.lengths):  # landmarks of one length at a time, so that none is padded
                marks = np.flatnonzero(self.lengths == length)
                width = int(min(length + MOST_INSERTED, codes.shape[1]))
                windows = np.lib.stride_tricks.sliding_window_view(codes, width, 1)
                masks = self._masks(windows)
                # A shorter word has one window; the first one holds all of it.
                masks[:, 1:][windows[:, 1:, -1] == 0] = 0
                w, o, j = np.nonzero(np.bitwise_count(masks[:, :, None] & self.mask[marks]) >= np.maximum(self.least[marks], 1))
                best = np.zeros((len(at), len(marks)), np.float32)
                for b in range(0, len(w), 16384):
                    x, y = windows[w[b : b + 16384], o[b : b + 16384]], marks[j[b : b + 16384]]
                    raw = subsequence_kernel(x, self.coded[y, :length])
                    has = self.own[y] > 0
                    value = np.where(has, raw / np.maximum(self.own[y], 1e-30), 0).clip(0, 1).sum(1) / np.maximum(has.sum(1), 1)
                    np.maximum.at(best, (w[b : b + 16384], j[b : b + 16384]), value.astype(np.float32))
                i, k = np.nonzero(best >= FLOOR)
                found.append((at[i], marks[k], best[i, k]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(c) for c in zip(*found))


class Sentences:
    """Sparse sentence vectors of texts: similarities of their nearest words."""

    def __init__(self, landmarks: list[str]):
        self.kernel = Similarity(landmarks)
        self.known: set[str] = set()  # words that have been compared
        self.rows: dict[str, tuple] = {}  # those of them that are similar to a landmark

    def learn(self, words: set[str]) -> None:
        new = words - self.known
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            self.rows.clear()
            new = words
        self.known |= new
        owners: dict[str, list[str]] = {}
        for w in new:
            bare = START + letters(w)
            for a in range(0, max(1, len(bare) - OVERLAP), MAX_WORD - OVERLAP):
                owners.setdefault(bare[a : a + MAX_WORD], []).append(w)
        parts = list(owners)
        if self.kernel.landmarks:
            for k, z, v in zip(*(c.tolist() for c in self.kernel.of(parts))):
                for w in owners[parts[k]]:
                    self.rows[w] = (*self.rows.get(w, ()), (z, v))

    def of(self, texts: list[str | None]) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
        """For each text: (landmarks, similarities) of each of its sentences that has any."""
        group: list[list[str]] = []
        size = 0
        for k, t in enumerate(texts):
            group.append(words_of(t))
            size += len(group[-1])
            if size >= 100_000 or k == len(texts) - 1:  # so that the words of a group fit the cache
                different = [set(ws) for ws in group]
                self.learn(set().union(*different))
                similar = self.rows.keys()
                for ws, d in zip(group, different):
                    near = similar & d
                    yield self._one(ws, near) if near else []
                group, size = [], 0

    def _one(self, ws: list[str], near: set[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        out: dict[int, dict[int, float]] = {}
        sentence, at = 0, 0
        for k in [k for k, w in enumerate(ws) if w in near]:
            sentence += sum(1 for w in ws[at:k] if _END.search(w))
            at = k
            best = out.setdefault(sentence, {})
            for z, v in self.rows[ws[k]]:
                best[z] = max(v, best.get(z, 0.0))
        return [(np.fromiter(s.keys(), np.int32), np.fromiter(s.values(), np.float32)) for s in out.values()]


def words_of(text: str | None) -> list[str]:
    """Words between blanks; runs of four or more single letters follow as words of their own."""
    if not text:
        return []
    ws = text.split()
    single = [k for k, w in enumerate(ws) if len(w) == 1]
    runs: list[str] = []
    a = 0
    while a + 3 < len(single):
        b = a
        while b + 1 < len(single) and single[b + 1] == single[b] + 1:
            b += 1
        if b - a >= 3:
            runs.append("".join(ws[single[a] : single[b] + 1]))
        a = b + 1
    return ws + runs


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray  # of the landmarks' similarities, the whitening included
    bias: float
    slope: float
    shift: float
    constant: float | None = None

    def probability(self, texts: list[str | None], sentences: Sentences) -> list[float]:
        if self.constant is not None:
            return [self.constant] * len(texts)
        top = np.array([max([0.0, *(float(self.weights[z] @ v) for z, v in doc)]) for doc in sentences.of(texts)]) + self.bias
        return (1 / (1 + np.exp(-(self.slope * top + self.shift).clip(-500, 500)))).tolist()


SIZE, BITS = 5, 6


def _joined(text: str) -> str:
    """The text's different words, START before each, in lines."""
    return "\n" + "\n".join(sorted({b for w in set(words_of(text)) if len(b := START + letters(w)) >= SIZE})) + "\n"


def _grams(joined: str) -> np.ndarray:
    """The different sequences of SIZE letters as numbers."""
    c = coded([joined], len(joined))[0].astype(np.int32)
    c[np.frombuffer(joined.encode("utf-32-le"), "<u4") == 10] = 0
    n = max(0, len(c) - SIZE + 1)
    own = [c[k : k + n] for k in range(SIZE)]
    whole = np.logical_and.reduce([x > 0 for x in own])
    return np.unique(sum(x << BITS * (SIZE - 1 - k) for k, x in enumerate(own))[whole])


def choose_landmarks(texts: list[str], toxic: np.ndarray, most: int) -> tuple[list[str], list[int]]:
    """Sequences of 5 to LONGEST letters (the start of a word counts as one), by greedy weighted cover of the toxic texts,
    and how many of these have each."""
    joined = [_joined(t) for t, x in zip(texts, toxic) if x]
    grams = [_grams(j) for j in joined]
    doc = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])
    known, gram, support = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    other = np.zeros(len(known) + 1, np.int64)
    for t, x in zip(texts, toxic):
        if not x and len(g := _grams(_joined(t))):
            at = np.searchsorted(known, g)
            other[at[known[np.minimum(at, len(known) - 1)] == g] if len(known) else []] += 1
    penalty = 4 * len(joined) / max(1, int((~toxic).sum())) * other[:-1]
    least = max(5, len(joined) // 100)
    able = (support >= least) & (support > 2 * penalty)
    place = np.cumsum(able) - 1
    keep = able[gram]
    doc, gram = doc[keep], place[gram[keep]]
    known, penalty = known[able], penalty[able]
    need = np.ones(len(joined))
    tried = np.zeros(len(known), bool)
    out: dict[str, int] = {}
    while len(out) < most and len(known):
        count = np.bincount(gram, weights=need[doc], minlength=len(known))
        gain = np.where(tried, -np.inf, count - penalty)
        best = int(np.argmax(gain))
        tried[best] = True
        if count[best] < least or gain[best] <= count[best] / 2:
            break
        members = doc[gram == best]
        z = _most_common(joined, members, int(known[best]))
        while len(z) < LONGEST:  # grow while nearly all of these texts have the longer sequence too
            longer: dict[str, int] = {}
            for d in members.tolist():
                for s in _around(joined[d], z):
                    longer[s] = longer.get(s, 0) + 1
            top = max(longer, key=lambda s: (longer[s], s), default=None)
            if top is None or longer[top] < 0.9 * len(members):
                break
            z = top
        tried |= np.isin(known, _grams(z))  # its parts tell nothing more
        out.setdefault(z, len(members))
        need[members] /= 2  # a text may need several, as words may be missing or altered elsewhere
    return list(out), list(out.values())


def _most_common(joined: list[str], members: np.ndarray, number: int) -> str:
    """The sequence that a number stands for: rare letters share numbers, so the most common one counts."""
    seen: dict[str, int] = {}
    checked: dict[str, bool] = {}
    for d in members[:50].tolist():
        t = joined[d]
        for s in {t[k : k + SIZE] for k in range(len(t) - SIZE + 1)}:
            if s not in checked:
                checked[s] = "\n" not in s and _grams(s).tolist() == [number]
            if checked[s]:
                seen[s] = seen.get(s, 0) + 1
    return max(seen, key=lambda s: (seen[s], s))


def _around(text: str, z: str) -> set[str]:
    """Sequences of one more letter, before or behind, of all occurrences."""
    found, at = set(), text.find(z)
    while at >= 0:
        if text[at - 1] != "\n":
            found.add(text[at - 1 : at + len(z)])
        if text[at + len(z)] != "\n":
            found.add(text[at : at + len(z) + 1])
        at = text.find(z, at + 1)
    return found


class Vectors:
    """Sparse rows of landmark similarities; dense only in chunks, and whitened then."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], m: int):
        self.m = m
        self.ends = np.cumsum([len(z) for z, _ in rows], dtype=np.int64)
        self.z = np.concatenate([z for z, _ in rows]) if rows else np.zeros(0, np.int32)
        self.v = np.concatenate([v for _, v in rows]) if rows else np.zeros(0, np.float32)

    def __len__(self) -> int:
        return len(self.ends)

    def dense(self, a: int, b: int) -> np.ndarray:
        out = np.zeros((b - a, self.m))
        x, y = int(self.ends[a - 1]) if a else 0, int(self.ends[b - 1]) if b else 0
        of = np.searchsorted(self.ends[a:b], np.arange(x, y), "right")
        out[of, self.z[x:y]] = self.v[x:y]
        return out

    def chunks(self) -> Iterator[tuple[int, int, np.ndarray]]:
        for a in range(0, len(self), 4096):
            b = min(a + 4096, len(self))
            yield a, b, self.dense(a, b)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ w for _, _, x in self.chunks()]) if len(self) else np.zeros(0)


def squared_hinge(parts: list[tuple[Vectors, float, np.ndarray]], white: np.ndarray, cost: float = 1.0) -> tuple[np.ndarray, float]:
    """Damped Newton steps on w.w/2 + cost * sum(weight * max(0, 1 - y f)^2) over whitened rows, with a bias.

    ``parts``: (rows, label, weight of each). The result is the weight of each landmark's similarity, and the bias."""
    m = len(white)
    w = np.zeros(m + 1)
    ridge = np.diag(np.r_[np.ones(m), 1e-3])
    for _ in range(60):
        left, right = ridge.copy(), np.zeros(m + 1)
        for rows, y, weight in parts:
            for a, b, x in rows.chunks():
                x1 = np.c_[x @ white, np.ones(b - a)]
                active = y * (x1 @ w) < 1
                scaled = x1[active] * (cost * weight[a:b][active])[:, None]
                left += scaled.T @ x1[active]
                right += y * scaled.sum(0)
        new = np.linalg.solve(left, right)
        done = np.abs(new - w).max() < 1e-8
        w = new if done else 0.5 * (new + w)
        if done:
            break
    return white @ w[:-1], float(w[-1])


def logistic(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """slope and shift of P(y = 1 | f), by ridge Newton steps, the slope kept positive."""
    x = np.c_[f, np.ones(len(f))]
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - y) + 1e-3 * w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 1e-6), float(w[1])


def train(texts: list[str], toxic: np.ndarray, n_landmarks: int = 64) -> Model:
    none = np.zeros(0)
    flat = Model([], none, 0.0, 0.0, 0.0, float(toxic.mean()) if len(toxic) else 0.0)
    if not toxic.any() or toxic.all():
        return flat
    marks, support = choose_landmarks(texts, toxic, n_landmarks)
    if not marks:
        return flat
    m = len(marks)
    sentences = Sentences(marks)
    i, j, v = sentences.kernel.of(marks)
    kernel = np.zeros((m, m))
    kernel[i, j] = v
    own = (kernel + kernel.T) / 2
    values, vectors = np.linalg.eigh(own)
    white = vectors / np.sqrt(np.maximum(values, 1e-3))
    # Every row has a sentence that is near to nothing, besides those that are near to a landmark.
    empty = (np.zeros(0, np.int32), np.zeros(0, np.float32))
    rows: tuple[list, list] = ([], [])
    ends: tuple[list[int], list[int]] = ([], [])
    for t, doc in zip(toxic, sentences.of(texts)):
        rows[int(t)].extend([empty, *doc])
        ends[int(t)].append(len(rows[int(t)]))
    negative, positive = (Vectors(r, m) for r in rows)
    starts = [np.r_[0, np.array(e[:-1], np.int64)] for e in ends]

    def best(score: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The place of the highest-scoring row of each document."""
        stop = np.r_[start[1:], len(score)]
        return np.array([a + int(np.argmax(score[a:b])) for a, b in zip(start, stop)])

    alone = [(np.arange(m, dtype=np.int32), (kernel[k] * s).astype(np.float32)) for s in (1.0, DECAY**2) for k in range(m)]
    virtual = Vectors(alone, m)
    shares = np.tile(np.maximum(1.0, np.array(support) / 8), 2)
    witness = best(np.concatenate([x.max(1) for _, _, x in positive.chunks()]), starts[1])
    for _ in range(5):
        chosen = Vectors([rows[1][k] for k in witness], m)
        parts = [(chosen, 1.0, np.ones(len(chosen))), (virtual, 1.0, shares), (negative, -1.0, np.ones(len(negative)))]
        weights, bias = squared_hinge(parts, white)
        again = best(positive.dot(weights), starts[1])
        if (again == witness).all():
            break
        witness = again
    tops = [x.dot(weights)[best(x.dot(weights), s)] for x, s in zip((negative, positive), starts)]
    tops.append(virtual.dot(weights))
    slope, shift = logistic(np.concatenate(tops) + bias, np.repeat([0.0, 1.0, 1.0], [len(t) for t in tops]))
    return Model(marks, weights, bias, slope, shift)


def _scored(model: Model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sentences = Sentences(model.landmarks)
        for whole in batches:
            for batch in slices(whole, "text"):
                scores = model.probability(batch.column("text").to_pylist(), sentences)
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores, pa.float64())], names=["row", "score"])

    return rows


def fold(id_col: str) -> Column:
    """crc32 of the id's decimal text, modulo 5."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_per_class: int = 2000, max_bytes: int = 8 << 20
) -> Model:
    """Train on rows outside of fold 0: of either class, at most ``max_per_class`` rows and ``max_bytes`` of text reach the driver."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label")).dropna().filter(fold("id") != 0)
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    order = F.xxhash64("id")
    sample = [known.filter(cond).orderBy(order, "id").limit(max_per_class) for cond in ("label = 1", "label <> 1")]
    sample = sample[0].union(sample[1])  # 2 * max_per_class rows at most
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sizes = texts.join(F.broadcast(sample), "id").groupBy("id").agg(F.max("label").alias("label"), F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size"), order.alias("at"))
    left = {True: max_bytes, False: max_bytes}
    taken: dict = {}
    for r in sorted(sizes.collect(), key=lambda r: (r.at, r.id)):
        if r["size"] <= min(left[r.label == 1], max_bytes // 16):
            left[r.label == 1] -= r["size"]
            taken[r.id] = r.label == 1
    if not taken:
        return train([], np.zeros(0, bool))
    ids = docs.sparkSession.createDataFrame([(i,) for i in taken], T.StructType([T.StructField("id", texts.schema["id"].dataType)]))
    # Rows that repeat an id count once.
    rows = texts.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("text").alias("text")).toArrow().to_pylist()
    rows.sort(key=lambda r: r["id"])
    return train([r["text"] or "" for r in rows], np.array([taken[r["id"]] for r in rows], bool))


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``row`` (the input's other columns) and ``score``."""
    carried = [c for c in docs.columns if c != text_col] or [text_col]
    row = F.struct(*(F.col(f"`{c}`") for c in carried)).alias("row")
    schema = T.StructType([*docs.select(row).schema, T.StructField("score", T.DoubleType())])
    return docs.select(row, F.col(f"`{text_col}`").alias("text")).mapInArrow(_scored(model), schema)
