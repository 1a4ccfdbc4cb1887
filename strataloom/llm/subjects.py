"""Subject areas of each document (problem 8).

A sentence is the mean of its words' vectors, a word the mean of its own and its subwords' embeddings; independent logistic outputs say which subjects a
sentence deals with, and a document has the subjects of at least two of its sentences. Labels are given for documents only, so the sentences' targets are re-estimated in
each epoch. The partitions of the bounded training sample take every step together: each computes the gradient of its part of the batch, all gradients are summed over the partitions, and
all make the same step (one barrier stage, whose tasks exchange gradients among themselves; neither weights nor gradients pass through the driver).
"""

from __future__ import annotations

import hmac
import pickle
import re
import secrets
import socket
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_sample, cut

BUCKETS, PAIRS, DIM = 1 << 15, 1 << 14, 16
_FENCE = re.compile(r"(?m)^[ \t]*(`{3,}+|~{3,}+)([^\n]*)")
#: Lines of code that aren't comments; they hold no sentences.
_CODE = re.compile(
    r"(?m)^[ \t]*(?:(?:async\s+)?def\s|return\b|import\s|from\s+\S+\s+import\b|class\s+\w+\s*[:({]|func\s|(?:export\s+)?(?:function|const|let|var)\s|(?:public|private|protected)\s|git\s|make\s|[\w.$\[\]'\"]+\s*(?::?=|\+=)\s).*$"
    r"|^.*[{};][ \t]*$"
)
_CODE_SIGNS = (" = ", "def ", "return ", "import ", "function ", "const ", "{", "git ")
#: Words, split where capitals begin, and ends of sentences: a mark before white space, an empty line, a line break before anything but a small letter.
_TOKEN = re.compile(r"[A-ZÀ-Þ]?[a-zß-öø-ÿ]+|[A-ZÀ-Þ]+(?![a-zß-öø-ÿ])|[^\W\d_]+|\d+|[.!?]+(?=\s)|\n(?![ \t]*(?:[#/*>;]+[ \t]*)?[a-zß-öø-ÿ])|\n[ \t]*\n")


def _unfenced(text: str) -> str:
    """The text without fenced blocks. A block ends at a bare fence of its mark that is at least as long; a fence that nothing closes is a single line."""
    marks = list(_FENCE.finditer(text))
    longest = {"`": 0, "~": 0}
    after = []  # the longest bare fence of the same mark further down
    for m in reversed(marks):
        c = m[1][0]
        after.append(longest[c])
        if not m[2].strip():
            longest[c] = max(longest[c], len(m[1]))
    after.reverse()
    out, at, i = [], 0, 0
    while i < len(marks):
        m = marks[i]
        out.append(text[at : m.start()])
        if after[i] >= len(m[1]):
            i += 1
            while marks[i][1][0] != m[1][0] or len(marks[i][1]) < len(m[1]) or marks[i][2].strip():
                i += 1
        at = marks[i].end()
        i += 1
    out.append(text[at:])
    return "\n".join(out)


def tokens(text: str) -> list[str]:
    """Words and sentence ends of a text. Fenced blocks and lines of code are left out; comment marks, bullets and line breaks inside a sentence end nothing."""
    if "``" in text or "~~~" in text:
        text = _unfenced(text)
    if any(x in text for x in _CODE_SIGNS):
        text = _CODE.sub("", text)
    return _TOKEN.findall(text)


def read_sentences(texts: Iterable[str | None], bag: Bag) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all sentences of at least 3 words, the words in each, and the text each belongs to."""
    ids: list[int] = []
    size = []
    for t in texts:
        x = bag.ids(tokens(t)) if t else []
        ids += x
        ids.append(0)
        size.append(len(x) + 1)
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    all_ids = np.array(ids, np.int64)
    row = np.repeat(np.arange(len(size)), size)
    ends = np.flatnonzero(all_ids == 0)
    starts = np.r_[0, ends[:-1] + 1]
    n = ends - starts
    keep = n >= 3
    starts, n, ends = starts[keep], n[keep], ends[keep]
    at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return all_ids[at], n, row[ends]


def _features(word: str) -> list[int]:
    """Buckets of a word and its subwords of 3 to 5 letters."""
    out = [zlib.crc32(word.encode()) % BUCKETS]
    w = f"<{word}>"
    if len(w) > 4:
        for n in (3, 4, 5):
            out += [zlib.crc32(w[i : i + n].encode()) % BUCKETS for i in range(len(w) - n + 1)]
    return out


class Bag:
    """Words by number, with their features once for each word; letter case and the value of numbers don't count. Number 0 ends a sentence."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.feats: list[list[int]] = [[0]]
        self.codes: list[int] = [0]

    def ids(self, words: list[str]) -> list[int]:
        number = self.number
        try:
            return [number[w] for w in words]
        except KeyError:
            for w in words:
                if w not in number:
                    number[w] = self._new(w)
            return [number[w] for w in words]

    def _new(self, w: str) -> int:
        if not w[0].isalnum():
            return 0
        base = "0" if w[0].isdigit() else w.lower()
        if base not in self.number:
            self.number[base] = len(self.feats)
            self.feats.append(_features(base))
            self.codes.append(zlib.crc32(base.encode()) & 0x7FFFFFFF)
        return self.number[base]

    def arrays(self, since: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features, how many of each word, and codes, of the words numbered `since` and later."""
        feats = self.feats[since:]
        n = np.array([len(f) for f in feats], np.int64)
        return np.concatenate([np.array(f, np.int64) for f in feats]) if feats else np.zeros(0, np.int64), n, np.array(self.codes[since:], np.int64)


def _pairs(ids: np.ndarray, n: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """For each word the bucket of it and the next one of its sentence; -1 at the end of a sentence."""
    out = np.full(len(ids), -1, np.int64)
    if len(ids) > 1:
        c = codes[ids]
        out[:-1] = ((c[:-1] * 31 + c[1:] * 1000003) >> 3) % PAIRS
        out[np.cumsum(n) - 1] = -1
    return out


class Weights:
    def __init__(self, subjects: int, seed: int = 1):
        r = np.random.default_rng(seed)
        self.emb = r.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.pair = r.normal(0, 0.02, (PAIRS, DIM)).astype(np.float32)
        self.out = r.normal(0, 0.1, (DIM, subjects)).astype(np.float32)
        self.bias = np.full(subjects, -2.0, np.float32)

    def parts(self) -> list[np.ndarray]:
        return [self.emb, self.pair, self.out, self.bias]

    def pack(self) -> list[bytes]:
        return [p.tobytes() for p in self.parts()]

    @staticmethod
    def unpack(data: list[bytes], subjects: int) -> Weights:
        w = Weights.__new__(Weights)
        shapes = [(BUCKETS, DIM), (PAIRS, DIM), (DIM, subjects), (subjects,)]
        w.emb, w.pair, w.out, w.bias = (np.frombuffer(d, np.float32).reshape(s).copy() for d, s in zip(data, shapes))
        return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _word_vectors(w: Weights, feats: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.add.reduceat(w.emb[feats], np.cumsum(n) - n, axis=0) / n[:, None] if len(n) else np.zeros((0, DIM), np.float32)


def _scores(w: Weights, bag: Bag, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log-odds of each sentence and subject."""
    return Scorer(w, bag).scores(ids, n)


class Scorer:
    """The outputs are linear in the words, so the share of each word and pair is computed once."""

    MOST = 400_000

    def __init__(self, w: Weights, bag: Bag | None = None):
        self.w, self.bag = w, bag or Bag()
        self.pair = w.pair @ w.out
        self.word = np.zeros((0, w.out.shape[1]), np.float32)
        self.codes = np.zeros(0, np.int64)

    def scores(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        if not len(n):
            return np.zeros((0, self.w.out.shape[1]), np.float32)
        if len(self.word) < len(self.bag.feats):
            feats, fn, codes = self.bag.arrays(len(self.word))
            self.word = np.concatenate([self.word, _word_vectors(self.w, feats, fn) @ self.w.out])
            self.codes = np.concatenate([self.codes, codes])
        p = _pairs(ids, n, self.codes)
        total = self.word[ids]
        total[p >= 0] += self.pair[p[p >= 0]]
        return np.add.reduceat(total, np.cumsum(n) - n, axis=0) / n[:, None] * SHARP + self.w.bias

    def counts(self, texts: list[str | None], thresholds: Iterable[float]) -> list[np.ndarray]:
        """For each threshold, of each text and subject the number of sentences that score over it."""
        if len(self.bag.feats) > self.MOST:  # forget, so that memory stays bounded
            self.__init__(self.w)
        ids, n, row = read_sentences(texts, self.bag)
        z = self.scores(ids, n)
        at = np.flatnonzero(np.diff(row, prepend=-1))
        out = []
        for t in thresholds:
            c = np.zeros((len(texts), z.shape[1]), np.int64)
            if len(row):
                c[row[at]] = np.add.reduceat((z > t).astype(np.int64), at, axis=0)
            out.append(c)
        return out

    def count(self, texts: list[str | None], threshold: float) -> np.ndarray:
        return self.counts(texts, [threshold])[0]


#: The mean of a sentence is multiplied by this, so that one telling word among ten can decide.
SHARP = 6.0


def _targets(z: np.ndarray, doc: np.ndarray, labels: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Targets of the sentences and what counts of them. At first a sentence has all subjects of its document. Later, of a document with a subject those of its sentences
    that look like it, at least two; of a document without it none, and the one that looks most like it may be a passing mention and isn't counted."""
    y = labels[doc].astype(np.float32)
    mask = np.ones_like(y)
    if first:
        return y, mask
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    ends = np.r_[starts[1:], len(doc)]
    t = np.zeros_like(y)
    for a, b in zip(starts, ends):
        part = z[a:b]
        for s in np.flatnonzero(labels[doc[a]]):
            like = part[:, s] > 0
            if like.sum() < 2:
                like[np.argsort(-part[:, s], kind="stable")[:2]] = True
            t[a:b, s] = like
        best = part.argmax(axis=0)
        for s in np.flatnonzero((part[best, np.arange(part.shape[1])] > 0) & (labels[doc[a]] == 0)):
            mask[a + best[s], s] = 0
    return t, mask


class Meeting:
    """The tasks of a barrier stage exchange messages: the first listens, the others send it theirs and get everybody's. Who connects must show the token that the tasks were told through
    Spark. A lost task breaks the connections, and with them the stage, which Spark then starts anew."""

    def __init__(self, ctx: BarrierTaskContext, patience: float = 600):
        hosts = [x.address.rpartition(":")[0] or x.address for x in ctx.getTaskInfos()]
        self.peers: list[socket.socket] = []
        self.first = ctx.partitionId() == 0
        if self.first:
            door = socket.create_server(("", 0), backlog=len(hosts))
            door.settimeout(patience)
            port, token = door.getsockname()[1], secrets.token_hex(32)
            ctx.allGather(f"{port} {token}")
            by_rank: dict[int, socket.socket] = {}
            while len(by_rank) < len(hosts) - 1:
                c, _ = door.accept()
                c.settimeout(patience)
                said, rank = self._exactly(c, 64), self._exactly(c, 4)
                if hmac.compare_digest(said, token.encode()):
                    by_rank[int.from_bytes(rank)] = c
                else:
                    c.close()
            door.close()
            self.peers = [by_rank[k] for k in sorted(by_rank)]
        else:
            port, token = ctx.allGather("")[0].split()
            c = socket.create_connection((hosts[0], int(port)), patience)
            c.sendall(token.encode() + ctx.partitionId().to_bytes(4))
            self.peers = [c]
        for c in self.peers:
            c.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    @staticmethod
    def _exactly(c: socket.socket, n: int) -> bytes:
        out = bytearray()
        while len(out) < n:
            got = c.recv(min(1 << 20, n - len(out)))
            if not got:
                raise ConnectionError("a task of the stage is gone")
            out += got
        return bytes(out)

    @classmethod
    def _take(cls, c: socket.socket) -> bytes:
        return cls._exactly(c, int.from_bytes(cls._exactly(c, 8)))

    def gather(self, message: bytes) -> list[bytes]:
        """Everybody's messages, in the order of the tasks."""
        if not self.first:
            self.peers[0].sendall(len(message).to_bytes(8) + message)
            return pickle.loads(self._take(self.peers[0]))
        all_ = [message, *map(self._take, self.peers)]
        back = pickle.dumps(all_, protocol=5)
        for c in self.peers:
            c.sendall(len(back).to_bytes(8) + back)
        return all_

    def close(self) -> None:
        for c in self.peers:
            c.close()


class Trainer:
    """Adagrad over the sentences of one partition's texts, in step with the other partitions. `gather` gives all partitions' messages in their order; alone it is the identity."""

    def __init__(self, w: Weights, texts: list[str], labels: np.ndarray, gather: Callable[[bytes], list[bytes]], rate: float = 0.2):
        self.w, self.labels, self.gather, self.rate, self.size = w, labels, gather, rate, len(texts)
        self.bag = Bag()
        self.ids, self.n, self.doc = read_sentences(texts, self.bag)
        self.feats, self.fn, codes = self.bag.arrays()
        self.pair_of = _pairs(self.ids, self.n, codes)
        self.start, self.fstart = np.cumsum(self.n) - self.n, np.cumsum(self.fn) - self.fn
        self.first_sentence = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.squares = [np.full(p.shape, 1e-3, np.float32) for p in w.parts()]

    def gradient(self, docs: np.ndarray, t: np.ndarray, mask: np.ndarray) -> tuple[int, list[tuple]]:
        """Sentences of a batch, and of each part of the weights the rows that change and the sum of their gradients."""
        w = self.w
        sent = np.concatenate([np.arange(self.first_sentence[k], self.first_sentence[k + 1]) for k in docs]) if len(docs) else np.zeros(0, np.int64)
        if not len(sent):
            return 0, []
        ln = self.n[sent]
        pos = np.repeat(self.start[sent] - (np.cumsum(ln) - ln), ln) + np.arange(ln.sum())
        words, back = np.unique(self.ids[pos], return_inverse=True)
        wn = self.fn[words]
        fpos = np.repeat(self.fstart[words] - (np.cumsum(wn) - wn), wn) + np.arange(wn.sum())
        f = self.feats[fpos]
        tok = (np.add.reduceat(w.emb[f], np.cumsum(wn) - wn, axis=0) / wn[:, None])[back]
        p = self.pair_of[pos]
        has = p >= 0
        tok[has] += w.pair[p[has]]
        s = np.add.reduceat(tok, np.cumsum(ln) - ln, axis=0) / ln[:, None] * SHARP
        g = (_sigmoid(s @ w.out + w.bias) - t[sent]) * mask[sent]
        gtok = np.repeat((g @ w.out.T) * (SHARP / ln[:, None]), ln, axis=0).astype(np.float32)
        gword = _sum_by(back, gtok, len(words)) / wn[:, None]
        rows, gemb = _sum_rows(f, np.repeat(gword, wn, axis=0))
        prows, gpair = _sum_rows(p[has], gtok[has])
        dense = [(None, (s.T @ g).astype(np.float32)), (None, g.sum(axis=0).astype(np.float32))]
        return len(sent), [(rows.astype(np.int32), gemb.astype(np.float32)), (prows.astype(np.int32), gpair.astype(np.float32)), *dense]

    def step(self, mine: tuple[int, list[tuple]]) -> None:
        """One step by the gradients of all partitions, summed in their order, so that all weights stay the same everywhere."""
        all_ = [pickle.loads(m) for m in self.gather(pickle.dumps(mine, protocol=5))]
        total = sum(n for n, _ in all_)
        for k, part in enumerate(self.w.parts()):
            grads = [g[k] for n, g in all_ if n]
            if not grads:
                continue
            if grads[0][0] is None:
                at, grad = slice(None), sum(g for _, g in grads)
            else:
                at, grad = _sum_rows(np.concatenate([r for r, _ in grads]), np.concatenate([g for _, g in grads]))
            grad = grad * (8 / total)
            self.squares[k][at] += grad * grad
            part[at] -= self.rate * grad / np.sqrt(self.squares[k][at])

    def epochs(self, count: int, first: bool, batch: int, seed: int) -> None:
        """`batch` documents of this partition a step, as many steps in all partitions as the largest needs."""
        steps = max(-(-pickle.loads(m) // batch) for m in self.gather(pickle.dumps(self.size)))
        r = np.random.default_rng(seed)
        for _ in range(count):
            t, mask = _targets(_scores(self.w, self.bag, self.ids, self.n), self.doc, self.labels, first) if len(self.n) else (np.zeros((0, 0)),) * 2
            order = r.permutation(self.size)
            for a in range(steps):
                self.step(self.gradient(order[a * batch : (a + 1) * batch], t, mask))

    def restart(self) -> None:
        for q in self.squares:
            q[...] = 1e-3


def _sum_by(index: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    order = np.argsort(index, kind="stable")
    at = np.flatnonzero(np.r_[True, index[order][1:] != index[order][:-1]])
    out = np.zeros((size, rows.shape[1]), np.float32)
    out[index[order][at]] = np.add.reduceat(rows[order], at, axis=0)
    return out


def _sum_rows(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(index):
        return index, rows
    order = np.argsort(index, kind="stable")
    sorted_ = index[order]
    at = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    return sorted_[at], np.add.reduceat(rows[order], at, axis=0)


def clean_labels(labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, subject): each label as spelt in `subjects`, null for a document labelled as having none. Labels that name no subject are dropped."""
    norm = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", " ")
    known = subjects.where("subject is not null").select("subject", norm(F.col("subject")).alias("k")).dropDuplicates(["k"])
    given = labels.where("doc_id is not null").select("doc_id", norm(F.col("subject")).alias("k")).distinct()
    return given.join(known, "k", "left").where("k is null or subject is not null").select("doc_id", "subject").distinct()


def training_sample(docs: DataFrame, labels: DataFrame, subjects: DataFrame, sample_docs: int) -> DataFrame:
    """(doc_id, text, given) of at most `sample_docs` labelled documents, those with the smallest hashes of their ids."""
    given = clean_labels(labels, subjects).groupBy("doc_id").agg(F.array_sort(F.collect_set("subject")).alias("given"))
    chosen = bounded_sample(given, ["doc_id"], sample_docs)
    texts = docs.where("text is not null").select("doc_id", "text")
    return texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])


class SubjectModel:
    def __init__(self, names: list[str], packed: list[bytes], threshold: float):
        self.names, self.packed, self.threshold = names, packed, threshold


def train_subjects(docs: DataFrame, labels: DataFrame, subjects: DataFrame, sample_docs: int = 5_000, workers: int = 4, rounds: int = 4, steps: int = 30, batch: int = 48) -> SubjectModel:
    """Fit on a sample of at most `sample_docs` labelled documents in `workers` partitions (no more than the cluster runs at once), which take each step together, `batch` documents in all. A round
    takes at least `steps` steps of twelve documents a partition and at least one epoch. The first half of the rounds gives sentences the
    subjects of their documents. An eighth of the sample, held out, chooses the round and the threshold. The fit is bounded; every document is scored. A lost task starts the stage, and so the
    fit, anew, with the same result."""
    spark = docs.sparkSession
    names = [r.subject for r in subjects.where("subject is not null").select("subject").distinct().orderBy("subject").collect()]
    alone = spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true"  # barrier stages need executors that stay
    workers = 1 if alone else max(1, min(workers, spark.sparkContext.defaultParallelism))
    held = F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(8)) == 0
    part = F.pmod(F.xxhash64("doc_id"), F.lit(workers)).cast("int").alias("part")
    sample = cut(training_sample(docs, labels, subjects, sample_docs).select("doc_id", "text", "given", held.alias("held"), part))
    index = {s: i for i, s in enumerate(names)}

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches) or [pd.DataFrame(columns=["doc_id", "text", "given", "held"])]).sort_values("doc_id")
        meeting = Meeting(BarrierTaskContext.get()) if workers > 1 else None
        gather = meeting.gather if meeting else lambda m: [m]
        y = np.zeros((len(rows), len(index)), np.int8)
        for i, given in enumerate(rows["given"]):
            for s in given:
                if s in index:
                    y[i, index[s]] = 1
        out = rows["held"].to_numpy(bool)
        mine, kept = rows[~out], rows[out]
        w = Weights(len(index))
        t = Trainer(w, mine["text"].tolist(), y[~out], gather)
        most = max(pickle.loads(m) for m in gather(pickle.dumps(len(mine))))
        count = max(1, min(8, -(-steps * 48 // max(1, most))))
        best = (-1.0, 0.0, w.pack())
        for rd in range(rounds if most else 0):
            t.restart()
            t.epochs(count, rd < rounds / 2, -(-batch // workers), seed=rd)
            f1, threshold = _held_out(kept["text"].tolist(), y[out], w, gather)
            if f1 > best[0]:
                best = (f1, threshold, w.pack())
        if meeting:
            meeting.close()
        if meeting is None or meeting.first:
            yield pd.DataFrame([[best[1], *best[2]]], columns=["threshold", "emb", "pair", "out", "bias"])

    schema = "threshold double, emb binary, pair binary, out binary, bias binary"
    placed = sample.repartition(workers, "part").select("doc_id", "text", "given", "held")
    best = placed.mapInPandas(fit, schema, barrier=workers > 1).collect()
    if not best:  # nothing to learn from
        return SubjectModel(names, Weights(len(names)).pack(), 0.0)
    return SubjectModel(names, [bytes(x) for x in best[0][1:]], best[0][0])


GRID = tuple(x / 4 for x in range(-6, 11))


def _held_out(texts: list[str], y: np.ndarray, w: Weights, gather: Callable[[bytes], list[bytes]]) -> tuple[float, float]:
    """The best F1 of all partitions' documents and subjects over the thresholds of GRID, and its threshold, the lowest where they are alike."""
    said = [c >= 2 for c in Scorer(w).counts(texts, GRID)]
    mine = np.array([[(p & (y > 0)).sum(), p.sum(), (y > 0).sum()] for p in said], float)
    total = sum(pickle.loads(m) for m in gather(pickle.dumps(mine)))
    f1 = 2 * total[:, 0] / np.maximum(1, total[:, 1] + total[:, 2])
    return float(f1.max()), GRID[int(np.argmax(f1 >= f1.max() - 0.001))]


def tag_subjects(docs: DataFrame, model: SubjectModel, least: int = 2) -> DataFrame:
    """(doc_id, subject, n_sentences) for each document and subject with at least `least` sentences, in one pass without a shuffle. Null and
    empty texts have no subjects; repeated rows repeat theirs; a text of any length is read whole."""
    sent = docs.sparkSession.sparkContext.broadcast(model.packed)
    names, threshold = model.names, model.threshold

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(Weights.unpack(sent.value, len(names)))
        for pdf in batches:
            n = scorer.count(pdf["text"].tolist(), threshold)
            row, sub = np.nonzero(n >= least)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[row], "subject": np.array(names, object)[sub], "n_sentences": n[row, sub]})

    return docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInPandas(run, "doc_id bigint, subject string, n_sentences bigint")


def composition(tags: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents and characters by subject, '' for those without one; a document with several subjects counts for each."""
    d = docs.where("doc_id is not null").select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("n")).dropDuplicates(["doc_id"])
    return d.join(tags.select("doc_id", "subject").distinct(), "doc_id", "left").groupBy(F.coalesce("subject", F.lit("")).alias("subject")).agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_chars"))
