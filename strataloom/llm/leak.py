"""Documents that hold passages of held-out test items (problem 6).

Every passage of an item (a window of 12 words) is split into error-budget-plus-one pieces; a document region within the budget holds one of them unchanged
(pigeonhole). Exact piece hits are looked up by hash, and each is verified with Myers' bit-parallel distance, run over all hits of a batch at
once. The index of the items is sent to the tasks block by block, each under a checked size; documents are only read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Dropped before words are found: soft hyphen, zero-width and direction marks.
INVISIBLE = dict.fromkeys([0xAD, 0x34F, 0x180E, *range(0x200B, 0x2010), *range(0x2060, 0x2065), 0xFEFF])
WORD = re.compile(r"[^\W_]+")
_ODD = re.compile(r"[\u00ad\u034f\u180e\u200b-\u200f\u2060-\u2064\ufeff]")


def words(text: str) -> list[str]:
    """Runs of letters or digits in lower case."""
    if not text.isascii() and _ODD.search(text):
        text = text.translate(INVISIBLE)
    return WORD.findall(text.lower())


def myers(pattern_eq: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of pattern_eq (rows x text positions, bit j set where pattern word j equals the text word) the smallest edit distance of the
    pattern (m <= 63 words) to any part of the text, and the first position where such a part ends."""
    n, width = pattern_eq.shape
    one, full = np.uint64(1), np.uint64((1 << m) - 1)
    top = np.uint64(m - 1)
    pv, mv = np.full(n, full, np.uint64), np.zeros(n, np.uint64)
    score = np.full(n, m, np.int32)
    best, at = score.copy(), np.full(n, -1, np.int32)
    for i in range(width):
        eq = pattern_eq[:, i]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = (mv | ~(xh | pv)) & full
        mh = pv & xh & full
        score += ((ph >> top) & one).astype(np.int32)
        score -= ((mh >> top) & one).astype(np.int32)
        ph, mh = (ph << one) & full, (mh << one) & full
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv
        better = score < best
        best[better] = score[better]
        at[better] = i
    return best, at


def spans(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers from each first to before its end, one after the other."""
    n = end - first
    return np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class PieceIndex:
    """All pieces of all passages of a block of items."""

    def __init__(self, items: list[tuple[int, list[str]]], passage: int, budget: int):
        if not 0 <= budget < passage <= 63:
            raise ValueError("0 <= budget < passage <= 63")
        self.passage, self.budget = passage, budget
        vocab: dict[str, int] = {}
        self.ids = np.array([i for i, _ in items], np.int64)
        seqs = [np.array([vocab.setdefault(w, len(vocab) + 1) for w in ws], np.int64) for _, ws in items]
        self.vocab = vocab
        cuts = np.linspace(0, passage, budget + 2).astype(int)
        windows, owner = [], []
        for k, s in enumerate(seqs):
            for a in range(len(s) - passage + 1):
                windows.append(s[a : a + passage])
                owner.append(k)
        # Items repeat passages; each passage is looked up and verified once, for all items that hold it.
        self.windows, which = np.unique(np.array(windows, np.int64).reshape(-1, passage), axis=0, return_inverse=True)
        held = np.unique(which.reshape(-1) * np.int64(len(items) or 1) + np.array(owner, np.int64))
        self.owner = held % (len(items) or 1)
        self.owned = np.searchsorted(held // (len(items) or 1), np.arange(len(self.windows) + 1))
        self.pieces = []  # of each piece: offset, length, sorted hashes, where each hash's windows begin and end in its row of self.order
        self.order = np.zeros((budget + 1, len(self.windows)), np.int64)
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            h = self.hashes(self.windows[:, a:b])
            self.order[p] = order = np.argsort(h, kind="stable")
            unique, first = np.unique(h[order], return_index=True)
            self.pieces.append((a, b - a, unique, first, np.append(first[1:], len(h))))

    @staticmethod
    def hashes(rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(rows.shape[1]):
                h = (h ^ rows[:, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        return h

    def match(self, texts: list[str], step: int = 200_000) -> pd.DataFrame:
        """(row, item, distance) of each text and item with a passage within the budget. Hits are verified in lots of about `step` in order of place, so that many of them take no more memory than few."""
        gap, get = self.passage + 2 * self.budget + 1, self.vocab.get
        stream, row_of = [], []
        pad = [0] * gap
        for t in texts:
            ids = [get(w, 0) for w in words(t)] if t else []
            stream += ids
            stream += pad
            row_of.append(len(ids) + gap)
        seq = np.concatenate([np.zeros(gap, np.int64), np.array(stream, np.int64)])
        row = np.concatenate([np.zeros(gap, np.int64), np.repeat(np.arange(len(texts)), row_of)])
        found: list[np.ndarray] = []  # of each piece hit: where its passage would start, where its windows begin and end, the piece
        for p, (offset, size, unique, first, end) in enumerate(self.pieces):
            if not len(unique):
                continue
            known = np.flatnonzero(seq[: len(seq) - size + 1])
            for j in range(1, size):
                known = known[seq[known + j] != 0]
            if not len(known):
                continue
            h = self.hashes(np.lib.stride_tricks.sliding_window_view(seq, size)[known])
            k = np.minimum(np.searchsorted(unique, h), len(unique) - 1)
            hit = unique[k] == h
            at, k = known[hit], k[hit]
            found.append(np.stack([at - offset, first[k], end[k], np.full(len(k), p)]))
        out = [pd.DataFrame({"row": [], "item": [], "distance": []}, dtype=np.int64)]
        if found:
            hits = np.concatenate(found, axis=1)
            hits = hits[:, np.argsort(hits[0], kind="stable")]
            lots = np.flatnonzero(np.diff(np.cumsum(hits[2] - hits[1]) // step)) + 1
            for a, b in zip([0, *lots], [*lots, hits.shape[1]]):
                out.append(self.verified(seq, row, *hits[:, a:b]))
        r = pd.concat(out).groupby(["row", "item"], as_index=False)["distance"].min()
        r["item"] = self.ids[r["item"].to_numpy(np.int64)] if len(r) else r["item"]
        return r

    def verified(self, seq: np.ndarray, row: np.ndarray, start: np.ndarray, first: np.ndarray, end: np.ndarray, piece: np.ndarray) -> pd.DataFrame:
        """(row, place of the item, distance) of the hits whose region is within the budget."""
        pair = np.unique(np.repeat(start, end - first) * len(self.windows) + self.order[np.repeat(piece, end - first), spans(first, end)])
        start, w = np.divmod(pair, len(self.windows))
        region = seq[np.clip(start[:, None] + np.arange(-self.budget, self.passage + self.budget), 0, len(seq) - 1)]
        pattern = self.windows[w]
        bits = np.uint64(1) << np.arange(self.passage, dtype=np.uint64)
        # A window and a region with fewer equal words than the passage less the budget can't be within it; most chance hits end here.
        eq = np.zeros(region.shape, np.uint64)
        for j in range(self.passage):
            eq |= np.where(region == pattern[:, j : j + 1], bits[j], np.uint64(0))
        seen = np.bitwise_or.reduce(eq, axis=1)
        enough = np.bitwise_count(seen) >= self.passage - self.budget
        best, _ = myers(eq[enough], self.passage)
        ok = best <= self.budget
        r = pd.DataFrame({"row": row[start[enough][ok] + self.passage // 2], "w": w[enough][ok], "distance": best[ok].astype(np.int64)}).groupby(["row", "w"], as_index=False).min()
        first, end = self.owned[r["w"].to_numpy()], self.owned[r["w"].to_numpy() + 1]
        r = r.loc[np.repeat(np.arange(len(r)), end - first), ["row", "distance"]].assign(item=self.owner[spans(first, end)])
        return r.groupby(["row", "item"], as_index=False)["distance"].min()


def find_leaks(docs: DataFrame, items: DataFrame, passage: int = 12, budget: int = 2, block_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, distance): documents with a region at most `budget` word edits from a passage of `passage` words of an item, and the
    smallest such distance; 0 means that the document holds the passage word for word.

    docs: doc_id, text; items: item_id, text. Items are taken in blocks of at most `block_chars` characters, as many as there are, so that what
    the tasks hold is bounded; each block reads the documents once. Items with fewer words than a passage, null and
    blank texts have no pairs. Copies of a document, repeated rows and repeated items count as one pair per id.
    """
    spark = docs.sparkSession

    def blocks() -> Iterator[list[tuple[int, list[str]]]]:
        one, size = [], 0
        for r in items.where("item_id is not null and text is not null").select("item_id", "text").distinct().orderBy("item_id").toLocalIterator():
            if one and size + len(r.text) > block_chars:
                yield one
                one, size = [], 0
            one.append((r.item_id, words(r.text)))
            size += len(r.text)
        yield one

    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    out = None
    for block in blocks():  # the driver holds one at a time: a sent block lies on disk
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            index = PieceIndex(sent.value, passage, budget)
            for pdf in batches:
                m = index.match(pdf["text"].tolist())
                ids = pdf["doc_id"].to_numpy()[m["row"].to_numpy(np.int64)]
                yield pd.DataFrame({"doc_id": ids, "item_id": m["item"].to_numpy(np.int64), "distance": m["distance"].to_numpy(np.int32)})

        one = texts.mapInPandas(run, "doc_id bigint, item_id bigint, distance int")
        out = one if out is None else out.unionAll(one)
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def leak_report(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Of each item the number of documents that hold a passage exactly, and of those that only come near."""
    n = pairs.groupBy("item_id").agg(F.count_if(F.col("distance") == 0).alias("n_exact"), F.count_if(F.col("distance") > 0).alias("n_near"))
    return items.select("item_id").distinct().join(n, "item_id", "left").fillna(0, ["n_exact", "n_near"])
