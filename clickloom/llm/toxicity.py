"""Toxicity by a support vector machine on a gap-weighted subsequence string kernel, with Nyström landmarks.

Words are lower-cased, without outer marks; a word with inner marks is also read without them, a run of single characters also as
one word, and a very long token in overlapping windows. The kernel of two words compares their subsequences of three characters
(word ends count as characters): one that spans s characters weighs DECAY**s, up to SPAN characters, so gapped and
inserted-character spellings still meet the plain one. Its power DEGREE is a kernel too. The kernel of two sentences is the sum over all pairs of
their distinct words, so a sentence's image is the sum of its words' images, and a sentence's decision the bias and the sum of
what its words add. A sentence of more than PIECE words is read in pieces.

The machine is trained on sentences. A labelled document is a bag of them: clean documents have clean sentences alone, a toxic
one has a toxic one somewhere. Training starts from all sentences of toxic documents against those of clean ones (a bounded
sample), each document of equal weight; then the documents are scored, the highest sentence of each and those of the TOP highest of a toxic one
that count as toxic stand for it, and the machine is fitted again to these and to copies of them in which every longer word has a
letter put in, ROUNDS times. Images are Nyström projections on LANDMARKS landmarks: words that more toxic documents hold
than chance allows, chosen greedily so that all such words are near one, and frequent clean words. The landmarks
only span the space; what is toxic is learned from the sentences. A logistic curve turns the TOP highest sentences of a document
into a probability.

Kernel values come from a table of the landmarks' subsequences, in numpy over all words of a length, for every word. Texts
are scored whole, each distinct word once while a worker's table holds it.

Training is bounded: at most MAX_TOXIC and MAX_CLEAN labelled documents, those with the smallest hashes, about MAX_SENTENCES of
their sentences for the first fit, and CANDIDATES words of each class to choose landmarks from. Null and empty texts get the score of a text
whose sentences add nothing; without toxic and clean labels to learn from every text gets the smoothed base rate. Labels that
contradict each other count as toxic. A row without doc_id is scored and is not held out. Repeated rows get equal scores; ties need no
order; very long texts are scored whole; an empty table gives no rows; other columns are not read (`without_toxic` carries them along).
"""

from __future__ import annotations

import math
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import given_back, in_arrow, without_gc, written

#: Bounds of the training sample, in documents.
MAX_TOXIC, MAX_CLEAN = 4_000, 8_000
#: Sentences of either class for the first fit, about.
MAX_SENTENCES = 12_000
#: Words of either class that landmarks are chosen from.
CANDIDATES = 2_000
LANDMARKS, CLEAN_LANDMARKS = 224, 32
#: The kernel, which is about 1 for equal words, is taken to this power: near spellings count, chance resemblance hardly.
DEGREE = 3
RIDGE = 1e-3
DECAY, SPAN = 0.7, 8
#: Fits after the first one.
ROUNDS = 3
#: Decision below which a clean sentence is let go from the next fit.
SURE = -1.1
#: Highest sentences that a document is judged by.
TOP = 3
#: Words in a piece of a sentence at most.
PIECE = 10
#: Longer tokens are read in windows of this many characters.
LONG = 24
TABLE_WORDS = 800_000

_OUTER = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_]+")
_SINGLES = re.compile(r"(?:(?<=\s)|^)(?:[^\W_]\s+){2,}[^\W_](?=\s|$)")
#: What every run of single characters holds; it begins with a set of characters, which is found much faster.
_PAIR = re.compile(r"\s[^\W_]\s+[^\W_](?:\s|$)")
#: White space after an end mark, and new lines; it begins with a set of characters too.
_SENTENCE = re.compile(r"\s(?:(?<=[.!?]\s)|(?<=\n))")


def units(token: str) -> list[str]:
    """The words that a lower-case token is read as."""
    word = token.strip(string.punctuation)
    if not word.isalnum():
        word = _OUTER.sub("", word)
        if not word:
            return []
    out = [word]
    if not word.isalnum() and (bare := _INNER.sub("", word)):
        out.append(bare)
    return [x for w in out for x in ([w] if len(w) <= LONG else [w[i : i + LONG] for i in range(0, len(w) - LONG // 2, LONG // 2)])]


def pieces(text: str | None) -> Iterator[list[str]]:
    """The tokens of each sentence, or piece of one; a run of three single characters or more is one token besides. A very long token's windows make pieces of their own."""
    low = (text or "").lower()
    spaced = _PAIR.search(low) is not None and _SINGLES.search(low) is not None
    for sentence in _SENTENCE.split(low):
        own = sentence.split()
        if not own:
            continue
        if spaced:
            own += ["".join(x.split()) for x in _SINGLES.findall(sentence)]
        if max(map(len, own)) > 2 * LONG:
            long = [t for t in own if len(t) > 2 * LONG]
            own = [t for t in own if len(t) <= 2 * LONG]
            for token in long:
                windows = units(token)
                yield from (windows[k : k + PIECE] for k in range(0, len(windows), PIECE))
        for k in range(0, len(own), PIECE):
            yield own[k : k + PIECE]


def _gaps():
    return [(d, e, DECAY ** (e + 1)) for e in range(2, SPAN) for d in range(1, e)]


def _norm(length: int) -> float:
    """Norm of a word of so many characters (with both ends) whose subsequences are all distinct."""
    return math.sqrt(sum(max(0, length - e) * w * w for _, e, w in _gaps())) or 1.0


def _scales(codes: np.ndarray, size: int) -> np.ndarray:
    """What the kernel of each word is divided by: the norm for its length, more where it repeats sequences of three characters. Any scale that
    depends on the word alone keeps the kernel positive; this one keeps it near 1 for equal words."""
    length = codes.shape[1]
    keys = np.sort((codes[:, :-2] * size + codes[:, 1:-1]) * size + codes[:, 2:], axis=1)
    if keys.shape[1] < 2:
        return np.full(len(codes), _norm(length), np.float32)
    first = np.ones(keys.shape, bool)
    first[:, 1:] = keys[:, 1:] != keys[:, :-1]
    run = np.flatnonzero(first.ravel())
    counts = np.diff(np.append(run, keys.size))
    squares = np.bincount(run // keys.shape[1], counts.astype(float) ** 2, minlength=len(codes))
    return (_norm(length) * np.sqrt(squares / keys.shape[1])).astype(np.float32)


class Alphabet:
    """Characters of the landmarks; all others are one that matches nothing."""

    def __init__(self, strings: list[str]):
        chars = sorted({c for s in strings for c in s})
        self.size = len(chars) + 3
        self.code = np.zeros(0x110000, dtype=np.int32)
        for k, c in enumerate(chars):
            self.code[ord(c)] = k + 3  # 0: others, 1 and 2: the ends

    def rows(self, strings: list[str], length: int) -> np.ndarray:
        """Codes of strings of one length, with both ends."""
        out = np.empty((len(strings), length + 2), dtype=np.int64)
        out[:, 0], out[:, -1] = 1, 2
        out[:, 1:-1] = self.code[np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)].reshape(len(strings), length)
        return out


def _by_length(strings: list[str]):
    groups: dict[int, list[int]] = {}
    for k, s in enumerate(strings):
        groups.setdefault(len(s), []).append(k)
    for length, own in groups.items():
        for at in range(0, len(own), 20_000):
            yield length, own[at : at + 20_000]


class Kernel:
    """Kernel of words with the landmarks: the landmarks' subsequence weights as a dense table with a row for each subsequence that any of them has."""

    def __init__(self, landmarks: list[str]):
        self.alphabet = Alphabet(landmarks)
        n = self.alphabet.size
        self.row = np.zeros(n**3, dtype=np.int32)
        entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for length, own in _by_length(landmarks):
            codes = self.alphabet.rows([landmarks[k] for k in own], length)
            scale = _scales(codes, n)[:, None]
            for d, e, w in _gaps():
                if e < length + 2:
                    key = self._keys(codes, d, e)
                    entries.append((key, np.repeat(own, key.shape[1]).reshape(key.shape), np.broadcast_to(w / scale, key.shape)))
        every = np.unique(np.concatenate([k.ravel() for k, _, _ in entries]))
        self.row[every] = np.arange(1, len(every) + 1)
        self.table = np.zeros((len(every) + 1, len(landmarks)), dtype=np.float32)
        for key, own, w in entries:
            np.add.at(self.table, (self.row[key], own), w)

    def _keys(self, codes: np.ndarray, d: int, e: int) -> np.ndarray:
        m, n = codes.shape[1] - e, self.alphabet.size
        key = codes[:, :m] * n
        key += codes[:, d : d + m]
        key *= n
        key += codes[:, e : e + m]
        return key

    def __call__(self, strings: list[str]) -> np.ndarray:
        out = np.zeros((len(strings), self.table.shape[1]), dtype=np.float32)
        for length, every in _by_length(strings):
            for at in range(0, len(every), 1_000):
                own = every[at : at + 1_000]
                codes = self.alphabet.rows([strings[k] for k in own], length)
                total, buffer = (np.zeros((len(own), self.table.shape[1]), dtype=np.float32) for _ in range(2))
                for e in range(2, min(SPAN, length + 2)):
                    # subsequences of one span weigh the same: they are summed first
                    summed = np.zeros_like(total)
                    for d in range(1, e):
                        rows = self.row[self._keys(codes, d, e)]
                        for c in range(rows.shape[1]):
                            own_rows = rows[:, c]
                            met = np.flatnonzero(own_rows)  # most subsequences are no landmark's
                            if 2 * len(met) < len(own_rows):
                                summed[met] += self.table[own_rows[met]]
                            else:
                                np.take(self.table, own_rows, axis=0, out=buffer, mode="clip")
                                summed += buffer
                    summed *= np.float32(DECAY ** (e + 1))
                    total += summed
                out[own] = total / _scales(codes, self.alphabet.size)[:, None]
        return out

    def image(self, strings: list[str]) -> np.ndarray:
        near = self(strings)
        out = near.copy()
        for _ in range(DEGREE - 1):  # numpy's power is much slower
            out *= near
        return out


def evidence(top: np.ndarray) -> np.ndarray:
    """What the logistic curve weighs: the highest decision, what the next ones are above 0, and 1."""
    return np.column_stack([np.clip(top[:, 0], -2, 2), np.clip(top[:, 1:], 0, 2), np.ones(len(top))])


class Machine:
    """The fitted decision, and the logistic curve of a document's highest sentences."""

    def __init__(self, kernel: Kernel, beta: np.ndarray, bias: float):
        self.kernel, self.beta, self.bias = kernel, beta.astype(np.float32), bias
        self.curve = np.array([2.0, *[0.0] * TOP])
        self.adds: dict[str, float] = {}
        self.of_units: dict[str, float] = {}

    def __getstate__(self):
        return {**self.__dict__, "adds": {}, "of_units": {}}

    def learn(self, found: set[str]) -> None:
        """What the tokens that the table lacks add to a sentence."""
        if len(self.adds) > TABLE_WORDS:
            self.adds = {}
        if len(self.of_units) > TABLE_WORDS:
            self.of_units = {}
        new = list(found.difference(self.adds))
        if not new:
            return
        parts = [units(t) for t in new]
        fresh = list({u for p in parts for u in p}.difference(self.of_units))
        for at in range(0, len(fresh), 20_000):
            own = fresh[at : at + 20_000]
            self.of_units.update(zip(own, (self.kernel.image(own) @ self.beta).tolist(), strict=True))
        get = self.of_units.__getitem__
        self.adds.update((token, get(part[0]) if len(part) == 1 else sum(map(get, part))) for token, part in zip(new, parts, strict=True))

    def top(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[list[str]]]]:
        """Decisions on the TOP highest sentences of each text, and their distinct tokens; a text with fewer sentences has empty ones."""
        out, best = np.full((len(texts), TOP), self.bias), []
        for first in range(0, len(texts), 200):
            split = [[set(p) for p in pieces(t)] for t in texts[first : first + 200]]
            with without_gc():
                self.learn(set().union(*(p for own in split for p in own)))
            get = self.adds.__getitem__
            for k, own in enumerate(split, first):
                scores = [sum(map(get, p)) for p in own]
                order = sorted(range(len(own)), key=scores.__getitem__, reverse=True)[:TOP]
                for j, i in enumerate(order):
                    out[k, j] = max(out[k, j], self.bias + scores[i])
                best.append([sorted(own[i]) for i in order])
        return out, best

    def probability(self, top: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence(top) @ self.curve, -30, 30)))


def images(kernel: Kernel, sentences: list[list[str]]) -> np.ndarray:
    """Images of sentences (their distinct tokens), before the Nyström projection: sums over their words."""
    words = list({u for s in sentences for t in s for u in units(t)})
    place = {w: k for k, w in enumerate(words)}
    out = np.zeros((len(sentences), kernel.table.shape[1]), dtype=np.float32)
    own = np.vstack([kernel.image(words[at : at + 20_000]) for at in range(0, len(words), 20_000)]) if words else out[:0]
    for k, s in enumerate(sentences):
        at = [place[u] for t in s for u in units(t)]
        if at:
            out[k] = own[at].sum(axis=0)
    return out


def respelled(sentence: list[str]) -> list[str]:
    """A sentence with a letter put into each word of four or more; place and letter follow from the word."""
    out = []
    for word in sentence:
        if len(word) >= 4:
            h = zlib.crc32(word.encode())
            k = 1 + h % (len(word) - 1)
            word = word[:k] + chr(97 + (h >> 8) % 26) + word[k:]
        out.append(word)
    return out


def projected(kernel: Kernel, root: np.ndarray, sentences: list[list[str]]) -> np.ndarray:
    """Projected images of sentences, and a 1 for the bias."""
    out = np.ones((len(sentences), root.shape[1] + 1), np.float32)
    out[:, :-1] = images(kernel, sentences) @ root
    return out


def standing(kernel: Kernel, root: np.ndarray, top: np.ndarray, best: list[list[list[str]]], toxic: list[bool]) -> list[np.ndarray]:
    """For each document, projected images of the sentences that stand for it, and of their respelled copies."""
    sentences, sizes = [], []
    for own_top, own_best, bad in zip(top, best, toxic, strict=True):
        own = [s for k, s in enumerate(own_best) if k == 0 or bad and own_top[k] > 0] or [[]]
        sentences += own + [respelled(s) for s in own]
        sizes.append(2 * len(own))
    return np.split(projected(kernel, root, sentences), np.cumsum(sizes)[:-1])


def projection(kernel: Kernel, landmarks: list[str]) -> np.ndarray:
    """The inverse root of the landmarks' own kernel matrix, without directions of hardly any extent."""
    values, vectors = np.linalg.eigh(kernel.image(landmarks).astype(float))
    whole = values > 1e-4 * values.max()
    return vectors[:, whole] / np.sqrt(values[whole])


def fit(kernel: Kernel, root: np.ndarray, parts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, let_go: float = 0.0) -> tuple[Machine, np.ndarray]:
    """A linear squared-hinge machine on projected images and its weights for them, by Newton's method with halved steps; both classes weigh the same.

    parts: the rows, in several arrays that are never joined; sums run over blocks of them. let_go: weight of clean rows that are not here, as they cost nothing.
    """
    rows = [part[at : at + 4_096] for part in parts for at in range(0, len(part), 4_096)]
    ends = np.cumsum([len(x) for x in rows])
    blocks = [(x, slice(end - len(x), end)) for x, end in zip(rows, ends.tolist(), strict=True)]
    y = np.where(labels, 1.0, -1.0)
    cost = np.where(labels, 0.5 / max(1e-12, weight[labels].sum()), 0.5 / max(1e-12, weight[~labels].sum() + let_go)) * weight
    penalty = np.append(np.full(root.shape[1], RIDGE), 1e-9)

    def decisions(w: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ w for x in rows])

    def loss(w: np.ndarray) -> float:
        return float((cost * np.maximum(0, 1 - y * decisions(w)) ** 2).sum() + (penalty * w * w).sum())

    w = np.zeros(len(penalty))
    now = loss(w)
    for _ in range(60):
        active = y * decisions(w) < 1
        left, right = np.diag(penalty), np.zeros(len(w))
        for x, own in blocks:
            a = x[active[own]].astype(float)
            weighed = a * cost[own][active[own]][:, None]
            left += weighed.T @ a
            right += weighed.T @ y[own][active[own]]
        target = np.linalg.solve(left, right)
        step = 1.0
        while (then := loss(w + step * (target - w))) > now and step > 1e-4:
            step /= 2
        w, gain, now = w + step * (target - w), now - then, min(now, then)
        if gain < 1e-9:
            break
    return Machine(kernel, root @ w[:-1], float(w[-1])), w


def covering(words: list[str], weight: np.ndarray, n: int) -> list[str]:
    """So many of the words, taken one by one: each time the one that most raises the words' (weighed) highest kernel values."""
    like = np.hstack([Kernel(words[at : at + 300]).image(words) for at in range(0, len(words), 300)])
    most, taken = np.zeros(len(words), dtype=np.float32), []
    for _ in range(min(n, len(words))):
        gain = weight.astype(np.float32) @ np.maximum(like - most[:, None], 0)
        gain[taken] = -1
        taken.append(int(np.argmax(gain)))
        most = np.maximum(most, like[:, taken[-1]])
    return [words[k] for k in taken]


def _curve(top: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights of the highest sentences and a shift, with smoothed targets, by Newton's method."""
    n1, n0 = labels.sum(), (~labels).sum()
    y = np.where(labels, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = evidence(top)
    w = np.append(np.full(top.shape[1], 0.5), 0.0)
    ridge = 1e-2 * np.append(np.ones(top.shape[1]), 0.0)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-6)
        step = np.linalg.solve(hessian, x.T @ (p - y) + ridge * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def trained(toxic_words: dict[str, float], clean_words: list[str], sentences, documents) -> Machine:
    """First fit on sentences(kernel, root), then ROUNDS on the highest sentences that documents(machine, root) finds, and the curve.

    sentences: projected images of toxic and of clean sentences, and the weights of both. documents: top scores, labels, projected images of the
    highest sentences and of their respelled copies, of toxic documents and of clean ones, and the document of each toxic image among the toxic ones.
    Images are held once: parts of the clean ones are kept apart and only thinned out.
    """
    landmarks = covering(list(toxic_words), np.array(list(toxic_words.values())), LANDMARKS - CLEAN_LANDMARKS)
    landmarks += [w for w in clean_words if w not in set(landmarks)][:CLEAN_LANDMARKS]
    kernel = Kernel(landmarks)
    root = projection(kernel, landmarks)
    bad, own, bad_weight, own_weight = sentences(kernel, root)
    clean, let_go = [(own, own_weight)], 0.0
    del own, own_weight
    for turn in range(ROUNDS + 1):
        weight = np.concatenate([bad_weight, *(x for _, x in clean)])
        machine, w = fit(kernel, root, [bad, *(x for x, _ in clean)], np.arange(len(weight)) < len(bad), weight, let_go)
        # sentences that the machine is sure of cost nothing: only their weight is kept
        for k, (own, own_weight) in enumerate(clean):
            hard = own @ w > SURE
            clean[k], let_go = (own[hard], own_weight[hard]), let_go + float(own_weight[~hard].sum())
        bad = own = None  # else kept while the next ones come
        # highest sentences of clean documents join all that were met before; a toxic document is the sentences that are highest now
        top, toxic, bad, more, of = documents(machine, root)
        clean.append((more, np.ones(len(more))))
        bad_weight = 1 / np.bincount(of)[of]
        del more
    # a respelled document is as toxic as the one that it copies
    again = bad @ w
    copies = [np.sort(own[len(own) // 2 :])[::-1][:TOP] for own in (again[of == k] for k in range(int(toxic.sum())))]
    respelled_top = np.array([np.append(x, np.full(TOP - len(x), machine.bias)) for x in copies]).reshape(-1, TOP)
    machine.curve = _curve(np.vstack([top, respelled_top]), np.append(toxic, np.ones(len(respelled_top), bool)))
    return machine


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """id, text and label of the bounded sample of labelled documents outside the held-out fold, written; equal texts are one document."""
    usable = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = usable.where(~held_out("doc_id"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    own = usable.where("toxic = 1").orderBy(*order).limit(MAX_TOXIC).unionByName(usable.where("toxic = 0").orderBy(*order).limit(MAX_CLEAN))
    sample = F.broadcast(own.select(F.col("doc_id").alias("labelled"), "toxic"))  # at most MAX_TOXIC + MAX_CLEAN rows
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(sample, F.col("doc_id") == F.col("labelled"))
    return written(rows.groupBy(F.xxhash64("text").alias("id")).agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic")))


def held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _words_by_class(rows: DataFrame, prior: float) -> tuple[dict[str, float], list[str]]:
    """Words to choose landmarks from: those that toxic documents hold more often than chance allows, with their log-likelihood gain, and the most frequent others."""

    def run(batches):
        for batch in batches:
            out: list[tuple[str, int]] = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += [(u, toxic) for u in {u for p in pieces(text) for t in p for u in units(t)} if len(u) > 2]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int32())], names=["word", "toxic"])

    each = in_arrow(rows.select("text", "toxic"), run, "word string, toxic int")
    counts = written(each.groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")), 8)
    rate = F.col("a") / (F.col("a") + F.col("b"))
    gain = F.col("a") * F.log(rate / prior) + F.when(F.col("b") > 0, F.col("b") * F.log((1 - rate) / (1 - prior))).otherwise(0.0)
    toxic = counts.where("a > 0").withColumn("rate", rate).where(F.col("rate") > prior).select("word", gain.alias("gain")).orderBy(F.desc("gain"), "word").limit(CANDIDATES).collect()
    clean = counts.where((F.col("a") == 0) | (rate <= prior)).orderBy(F.desc("b"), "word").limit(CANDIDATES).collect()
    return {r.word: r.gain for r in toxic}, [r.word for r in clean]


def fitted(docs: DataFrame, labels: DataFrame) -> Machine | float:
    """A machine learned from the labelled documents that are not held out; a base rate where they show nothing to learn."""
    rows = training_rows(docs, labels)
    n, n_toxic, size = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    if not n_toxic or n_toxic == n:
        return (n_toxic + 1) / (n + 2)
    toxic_words, clean_words = _words_by_class(rows, n_toxic / n)
    if not toxic_words:
        return (n_toxic + 1) / (n + 2)
    context = rows.sparkSession.sparkContext
    sizes = {r.toxic: r.size for r in rows.groupBy("toxic").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("size")).collect()}
    # sentences have some 60 characters; of each document an even share is taken, one at least
    share = {k: min(1.0, MAX_SENTENCES * 60 / max(1, v)) for k, v in sizes.items()}

    def sentences(kernel: Kernel, root: np.ndarray):
        shared = context.broadcast((kernel, root))

        def run(batches):
            for batch in batches:
                own, toxic, weight = [], [], []
                for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    every = [sorted(set(p)) for p in pieces(text)]
                    step = max(1, round(1 / share[label]))
                    picked = every[::step]
                    own += picked
                    toxic += [label] * len(picked)
                    weight += [1 / len(picked)] * len(picked) if picked else []
                near = [x.tobytes() for x in projected(*shared.value, own)]
                yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(weight, pa.float64()), pa.array(near, pa.binary())], names=["toxic", "weight", "image"])

        got = in_arrow(rows.select("text", "toxic"), run, "toxic int, weight double, image binary").toArrow()  # about twice MAX_SENTENCES and a row for each document of the sample at most
        shared.destroy()
        toxic, weight = got["toxic"].to_numpy() == 1, got["weight"].to_numpy()
        return *_floats(got["image"], root.shape[1] + 1, toxic), weight[toxic], weight[~toxic]

    def documents(machine: Machine, root: np.ndarray):
        given_back(rows.sparkSession)  # what the fit before has freed
        shared = context.broadcast((machine, root))

        def run(batches):
            for batch in batches:
                own, root = shared.value
                top, best = own.top(batch.column(0).to_pylist())
                near = [x.tobytes() for x in standing(own.kernel, root, top, best, [x == 1 for x in batch.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([pa.array(top.tolist(), pa.list_(pa.float64())), batch.column(1), pa.array(near, pa.binary())], names=["top", "toxic", "images"])

        got = in_arrow(rows.select("text", "toxic"), run, "top array<double>, toxic int, images binary").toArrow()  # a row for each document of the bounded sample
        shared.destroy()
        toxic = got["toxic"].to_numpy() == 1
        sizes = pc.binary_length(got["images"]).to_numpy()[toxic] // (4 * (root.shape[1] + 1))
        return np.array(got["top"].to_pylist()), toxic, *_floats(got["images"], root.shape[1] + 1, toxic), np.repeat(np.arange(len(sizes)), sizes)

    machine = trained(toxic_words, clean_words, sentences, documents)
    given_back(rows.sparkSession)
    return machine


def _floats(column: pa.ChunkedArray, width: int, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of so many numbers from serialized ones, toxic ones and others."""
    parts = [np.zeros((0, width), np.float32)], [np.zeros((0, width), np.float32)]
    for bad, x in zip(toxic.tolist(), (v.as_buffer() for chunk in column.chunks for v in chunk), strict=True):
        parts[not bad].append(np.frombuffer(x, np.float32).reshape(-1, width))
    return np.vstack(parts[0]), np.vstack(parts[1])


def scored(docs: DataFrame, machine: Machine | float) -> DataFrame:
    """doc_id, probability of toxicity and the distinct words of the most toxic sentence of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        own = shared.value
        for batch in batches:
            if isinstance(own, float):
                score, words = np.full(batch.num_rows, own), [""] * batch.num_rows
            else:
                top, best = own.top(batch.column(1).to_pylist())
                score, words = own.probability(top), [" ".join(x[0]) if x else "" for x in best]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(words, pa.string())], names=["doc_id", "score", "sentence"])

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, score double, sentence string")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below the threshold, with their own columns, scored in the same pass that reads them."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))

    def run(batches):
        own = shared.value
        for batch in batches:
            if isinstance(own, float):
                yield batch
            else:
                top, _ = own.top(batch.column(batch.schema.get_field_index("text")).to_pylist())
                yield batch.filter(pa.array(own.probability(top) < threshold))

    return in_arrow(docs, run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: toxicity of every document, learned from labels outside the held-out fold."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    out = scored(docs, fitted(docs, labels))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
