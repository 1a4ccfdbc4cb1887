"""Credentials in source code, found and redacted (problem 1).

Candidate values are taken from every text in whatever form they are written. Strict patterns label the clear cases among them and keep silent about the rest; a logistic
regression on character Markov likelihood, value shape, surrounding identifiers and path features is trained on a bounded sample of the labelled ones,
calibrated on held-out ones, and scores every candidate. What scores above the threshold is reported and redacted.
"""

from __future__ import annotations

import gzip
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bounded_sample, cut
from .secret_forms import (
    ABOUT, HASHY, HEX, IDENT, KNOWN, PATHLIKE, PLACEHOLDER, PREFIX, REFERENCE, URLLIKE, UUID, Candidate, candidates, decoded, key_words, names_credential, wordy,
)

#: Forms whose notation says that a secret stands there.
TOLD = frozenset(("url", "conn", "cli", "netrc", "known", "pem"))
_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-.+/=!@#$%^&*:~"
_SIZE = len(_ALPHABET) + 2  # 0: edge, 1: other
_CODE = np.ones(256, np.int64)
_CODE[np.frombuffer(_ALPHABET.encode(), np.uint8)] = np.arange(2, _SIZE)
#: Lengths of digests in hexadecimal digits.
DIGESTS = (32, 40, 64, 96, 128)
_CONFIG = frozenset("ini toml yaml yml json env properties cfg conf xml sh".split())
_DOCS = frozenset("md mdx rst txt".split())


_DIGITS, _UPPER, _LOWER = (dict.fromkeys(map(ord, x)) for x in ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
_WORD_MARK_DIGITS = re.compile(r"[A-Za-z]+(?:[-_.#@][A-Za-z]+)*[-_.#@]?\d+!?$")
_ALGORITHM = re.compile(r"(?i)(?:sha\d+|md5|sri|bcrypt|\$2[aby]\$|\$argon|pbkdf2)[:\-$]")
_CALLS = re.compile(r"\w[.(\[]\w*[(\[]|->|::|\(\)")


def shape(value: str) -> dict[str, float]:
    """What the characters of a value look like, the whole value through."""
    n = len(value)
    digits, upper, lower = n - len(value.translate(_DIGITS)), n - len(value.translate(_UPPER)), n - len(value.translate(_LOWER))
    classes = bool(digits) + bool(upper) + bool(lower) + (n > digits + upper + lower)
    is_hex = bool(HEX.match(value))
    return {
        "entropy": -sum(k / n * math.log2(k / n) for k in Counter(value).values()) / 6,
        "digits": digits / n, "upper": upper / n, "lower": lower / n, "marks": (n - digits - upper - lower) / n,
        "classes>1": float(classes > 1), "classes>2": float(classes > 2), "classes>3": float(classes > 3), "len<8": float(n < 8), "len<16": float(8 <= n < 16), "len<24": float(16 <= n < 24), "len<48": float(24 <= n < 48), "len>=48": float(n >= 48),
        "hex": float(is_hex), "digest_size": float(is_hex and n in DIGESTS), "word_mark_digits": float(bool(_WORD_MARK_DIGITS.match(value))), "decodes": float(n >= 8 and decoded(value) is not None),
    }


def _dense(value: str) -> bool:
    """Random letters and digits, as in tokens and base64."""
    return len(value) >= 16 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and len(set(value)) >= 10 and not _WORD_MARK_DIGITS.match(value)


def _path(value: str) -> bool:
    return bool(PATHLIKE.match(value)) and not ("." not in value and len(value) >= 20 and any(c.isdigit() for c in value) and any(c.isupper() for c in value) and any(c.islower() for c in value))


def _prefixed(value: str) -> bool:
    return bool(KNOWN.search(value) or PREFIX.match(value))


def _last(ws: list[str]) -> str:
    return next((w for w in reversed(ws) if not w.isdigit()), "")


def stand_in(value: str) -> bool:
    """A placeholder or a reference, also where it is encoded; it stands where a credential would."""
    if PLACEHOLDER.search(value) or REFERENCE.search(value):
        return True
    text = decoded(value) if len(value) >= 8 else None
    return bool(text and PLACEHOLDER.search(text.rsplit(":", 1)[-1]))


def weak_label(form: str, key: str, value: str) -> int | None:
    """1 or 0 where a strict pattern tells, None where none does: those candidates are left to the model.

    Credentials: private keys, tokens with a public prefix, passwords in addresses, connection strings and commands, and dense values under a name that names a credential. None: UUIDs,
    digests by name or mark, numbers, addresses, paths and calls, and values under other names, or names of something about a credential, that aren't dense. Stand-ins aren't learned from: the exact check after the score keeps them out.
    """
    if form == "pem":
        return 1
    if stand_in(value):
        return None
    if UUID.match(value) or _ALGORITHM.match(value):
        return 0
    if form in TOLD or _prefixed(value):
        return 1
    if form in ("header", "prose"):
        return None
    ws, named = key_words(key), names_credential(key)
    if not named and set(ws) & HASHY:
        return 0
    plain = bool(URLLIKE.match(value) or _path(value) or _CALLS.search(value) or value.replace(".", "").replace(",", "").isdigit())
    about = _last(ws) in ABOUT
    if plain or (about or not named) and not _dense(value):
        return 0
    if named and not about and _dense(value) and not (IDENT.match(value) and wordy(value) and not HEX.match(value)) and not set(ws) & HASHY:
        return 1
    return None


@dataclass
class SecretModel:
    words: dict[str, int]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    likelihood: np.ndarray  # log-likelihood ratio of each pair of characters
    slope: float
    offset: float
    threshold: float

    def score(self, rows: list[tuple]) -> np.ndarray:
        """Calibrated probability of each (form, key, value, comment, path)."""
        if not rows:
            return np.zeros(0)
        if not len(self.weights):
            return np.array([float(weak_label(*r[:3]) == 1) for r in rows])
        x = (_matrix(rows, self.words, self.likelihood) - self.mean) / self.scale
        z = x @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -30, 30)))


def _codes(value: str) -> np.ndarray:
    return np.concatenate(([0], _CODE[np.frombuffer(value.encode("latin-1", "replace"), np.uint8)], [0]))


def _tokens(key: str, path: str) -> list[str]:
    ws = key_words(key)
    return [f"w:{w}" for w in ws] + [f"l:{_last(ws)}"] + [f"p:{a} {b}" for a, b in zip(ws, ws[1:])] + [f"d:{x}" for x in path.lower().split("/")[2:-1] if x.isalpha()]


def _matrix(rows: list[tuple], words: dict[str, int], likelihood: np.ndarray) -> np.ndarray:
    dense, tags = [], []
    for i, (form, key, value, comment, path) in enumerate(rows):
        c = _codes(value)
        ext = path.rsplit(".", 1)[-1].lower() if "." in path else ""
        ws = key_words(key)
        named, about = names_credential(key), _last(ws) in ABOUT
        told = form in TOLD or form in ("header", "prose") or named and not about or _prefixed(value)
        dense.append([
            float(likelihood[c[:-1], c[1:]].mean()), *shape(value).values(), float(told), float(told and HEX.match(value) is not None), float(told and wordy(value)), float(form == "header"), float(form == "prose"), float(form == "pieces"), float(comment), float(named), float(named and about), float(bool(set(ws) & HASHY)),
            float(bool(IDENT.match(value)) and wordy(value)), float(ext in _CONFIG), float(ext in _DOCS), float("/test" in path or path.startswith("test")),
        ])
        tags += [(i, words[t]) for t in _tokens(key, path) if t in words]
    out = np.zeros((len(rows), len(dense[0]) + len(words)), np.float32)
    d = np.array(dense, np.float32)
    out[:, : d.shape[1]] = d
    if tags:
        a, b = np.array(tags).T
        out[a, d.shape[1] + b] = 1
    return out


def fit(rows: list[tuple], threshold: float = 0.5, penalty: float = 0.3, vocabulary: int = 300, rounds: int = 12) -> SecretModel:
    """Fit on those (form, key, value, comment, path) rows that a strict pattern labels. A third of them, told by a hash of the value, is held out for the calibration."""
    told = sorted((r, label) for r in set(rows) if (label := weak_label(*r[:3])) is not None)
    rows, y = [r for r, _ in told], np.array([label for _, label in told], float)
    held = np.array([(sum(map(ord, r[2])) * 2654435761 >> 7) % 3 == 0 for r in rows], bool)
    train = ~held
    if not (y[train] == 1).any() or not (y[train] == 0).any():  # too little to learn from: the patterns decide
        return SecretModel({}, np.zeros(0), np.zeros(0), np.zeros(0), np.zeros((0, 0)), 1.0, 0.0, threshold)
    # Markov likelihood of secret values against the other values.
    counts = np.full((2, _SIZE, _SIZE), 0.05)
    for r, label, h in zip(rows, y, held):
        if not h:
            c = _codes(r[2])
            np.add.at(counts[int(label)], (c[:-1], c[1:]), 1 / len(c))
    p = counts / counts.sum(axis=2, keepdims=True)
    likelihood = np.log(p[1]) - np.log(p[0])
    n = Counter(t for r, h in zip(rows, held) if not h for t in set(_tokens(r[1], r[4])))
    words = {t: i for i, (t, k) in enumerate(sorted(n.items(), key=lambda x: (-x[1], x[0]))[:vocabulary]) if k > 2}
    x = _matrix(rows, words, likelihood)
    w = np.ones(len(y))
    mean, scale = x[train].mean(axis=0), np.maximum(x[train].std(axis=0), 0.05)
    x = (x - mean) / scale
    one = np.concatenate([np.ones((len(x), 1), np.float32), x], axis=1)
    a, b, wt = one[train], y[train], w[train]
    beta = np.zeros(a.shape[1])
    ridge = np.full(a.shape[1], penalty)
    ridge[0] = 1e-6
    for _ in range(rounds):  # iteratively reweighted least squares
        z = np.clip(a @ beta, -30, 30)
        q = 1 / (1 + np.exp(-z))
        g = a.T @ (wt * (q - b)) + ridge * beta
        h = (a * (wt * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(h, g)
        beta -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    slope, offset = 1.0, 0.0
    if (y[held] == 1).any() and (y[held] == 0).any():  # Platt scaling
        z, b, wt = one[held] @ beta, y[held], w[held]
        n1, n0 = (b == 1).sum(), (b == 0).sum()
        target = np.where(b == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(slope * z + offset, -30, 30)))
            r, v = wt * (q - target), np.maximum(wt * q * (1 - q), 1e-6)
            h = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-3]])
            s = np.linalg.solve(h, np.array([(r * z).sum() + 1e-3 * (slope - 1), r.sum()]))
            slope, offset = slope - s[0], offset - s[1]
            if np.abs(s).max() < 1e-6:
                break
        if slope <= 0:
            slope, offset = 1.0, 0.0
    return SecretModel(words, mean, scale, beta, likelihood, float(slope), float(offset), threshold)


def usable(value: str) -> bool:
    """The exact check after the score: neither a placeholder nor a reference, whatever the model says."""
    return not stand_in(value)


FOUND = "src_table string, record_key string, line_no int, form string, key string, value string, comment boolean, path string, label int"


def extract(records: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Candidates of all records: src_table, record_key, path, text or gz (a gzip stream, read as UTF-8), with the label of the strict patterns. paths (src_table, record_key, path), one row for each record,
    gives the paths of records that don't know theirs; it meets the candidates, not the texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in FOUND.split(", ")]
        for pdf in batches:
            out = []
            for src, key, path, text, gz in zip(pdf["src_table"], pdf["record_key"], pdf["path"], pdf["text"], pdf["gz"]):
                if gz is not None:
                    raw = _whole(gz)
                    text = raw.decode("utf-8", "replace") if raw is not None else None
                for c in candidates(text) if text else ():
                    out.append((src, key, c.line, c.form, c.key, c.value, c.comment, _folder(path), weak_label(c.form, c.key, c.value)))
            yield pd.DataFrame(out, columns=names).astype({"label": "Int32"})

    found = records.mapInPandas(run, FOUND)
    if paths is None:
        return found
    known = paths.select("src_table", F.col("record_key").alias("_k"), _folder_of(F.col("path")).alias("_p"))
    met = found.withColumn("_k", F.lower("record_key")).join(known, ["src_table", "_k"], "left")
    return met.withColumn("path", F.coalesce("_p", "path")).drop("_k", "_p")


def _folder_of(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    dot = F.when(F.contains(name, F.lit(".")), F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise("")
    return F.when(path == "", "").otherwise(F.concat(F.substring(path, F.lit(1), F.char_length(path) - F.char_length(name)), F.lit("f"), dot))


def _folder(path: str | None) -> str:
    """A path without the file's own name, which says too much about a single file; its ending stays."""
    name = (path or "").rpartition("/")[2]
    return path[: len(path) - len(name)] + "f" + name[name.rfind(".") :] * ("." in name) if path else ""


def content_paths(files: DataFrame) -> DataFrame:
    """(src_table, record_key, path): a path for each content, the first in order of those that use it; keys in lower case."""
    return files.where("content_hash is not null").groupBy(F.lower("content_hash").alias("record_key")).agg(F.min("file_path").alias("path")).select(F.lit("blobs").alias("src_table"), "record_key", "path")


def _whole(gz: bytes) -> bytes | None:
    """The content of a sound gzip stream; a damaged one has none."""
    try:
        return gzip.decompress(gz)
    except (OSError, EOFError, ValueError, zlib.error):
        return None


def train(found: DataFrame, sample_rows: int = 16_000, sample_chars: int = 400, threshold: float = 0.5) -> SecretModel:
    """Fit on at most `sample_rows` distinct labelled candidates of up to `sample_chars` characters, a quarter of them credentials: those with the smallest hashes, so that the choice
    doesn't depend on the order of rows. Only the sample is bounded: all candidates of any length are scored, whole."""
    cols = ["form", "key", "value", "comment", "path"]
    short = found.where(F.col("label").isNotNull() & (F.char_length("value") <= sample_chars))
    rows = short.groupBy("label", "form", "key", "value").agg(F.min("comment").alias("comment"), F.min("path").alias("path"))
    taken = [bounded_sample(rows.where(F.col("label") == y), ["form", "key", "value"], n).select(*cols) for y, n in ((1, sample_rows // 4), (0, sample_rows - sample_rows // 4))]
    return fit([tuple(r[c] for c in cols) for df in taken for r in df.collect()], threshold)


def find_secrets(records: DataFrame, paths: DataFrame | None = None, sample_rows: int = 16_000, threshold: float = 0.5) -> DataFrame:
    """(src_table, record_key, line_no, form, key, label, score) of every credential in `records`.

    records: src_table, record_key, path, text, gz; paths: see extract. Null and empty texts and damaged streams have none; repeated records repeat their rows;
    extra columns are not read. Candidates of all texts are written once, the model is fitted on a bounded sample, every candidate is scored.
    """
    found = cut(extract(records.select("src_table", "record_key", "path", "text", "gz"), paths))
    model = train(found, sample_rows, threshold=threshold)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            score = _score(model, pdf)
            ok = score >= model.threshold
            ok[ok] = [usable(v) for v in pdf["value"][ok]]
            yield pdf.loc[ok, ["src_table", "record_key", "line_no", "form", "key", "label"]].assign(score=score[ok])

    return found.mapInPandas(run, "src_table string, record_key string, line_no int, form string, key string, label int, score double")


def _score(model: SecretModel, pdf: pd.DataFrame) -> np.ndarray:
    rows = list(zip(pdf["form"], pdf["key"], pdf["value"], pdf["comment"], pdf["path"]))
    return np.concatenate([model.score(rows[a : a + 4096]) for a in range(0, len(rows), 4096)] or [np.zeros(0)])


def redact_text(text: str, model: SecretModel, path: str = "", mark: str = "REDACTED") -> tuple[str, int]:
    """The text with every credential's value replaced by `mark`, and how many. Quotes, keys, addresses and BEGIN and END lines stay."""
    found = [c for c in candidates(text) if usable(c.value)]
    score = model.score([(c.form, c.key, c.value, c.comment, _folder(path)) for c in found])
    hits = [c for c, s in zip(found, score) if s >= model.threshold]
    for a, b in sorted({s for c in hits for s in c.spans}, reverse=True):
        text = text[:a] + mark + text[b:]
    return text, len(hits)


def redact(records: DataFrame, model: SecretModel) -> DataFrame:
    """(src_table, record_key, redacted, n_redacted) of every readable record, in one pass without a shuffle. Bytes that aren't UTF-8 stay as they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for src, key, path, text, gz in zip(pdf["src_table"], pdf["record_key"], pdf["path"], pdf["text"], pdf["gz"]):
                if gz is not None:
                    raw = _whole(gz)
                    text = raw.decode("utf-8", "surrogateescape") if raw is not None else None
                if text is None:
                    continue
                clean, n = redact_text(text, model, path or "")
                out.append((src, key, clean.encode("utf-8", "surrogateescape"), n))
            yield pd.DataFrame(out, columns=["src_table", "record_key", "redacted", "n_redacted"])

    return records.mapInPandas(run, "src_table string, record_key string, redacted binary, n_redacted int")


def with_paths(records: DataFrame, paths: DataFrame) -> DataFrame:
    """records whose blank paths are those of `paths`; only records without a path meet it."""
    blank = F.coalesce(F.col("path"), F.lit("")) == ""
    known = paths.select("src_table", F.col("record_key").alias("_k"), F.col("path").alias("_p"))
    met = records.where(blank).withColumn("_k", F.lower("record_key")).join(known, ["src_table", "_k"], "left").withColumn("path", F.coalesce("_p", "path")).select(*records.columns)
    return records.where(~blank).unionByName(met)


def archive_records(blobs: DataFrame, chunks: DataFrame, evidence: DataFrame) -> DataFrame:
    """Contents, retrieval rows and shown passages as records. A content has no path of its own: see content_paths."""
    no_gz, none = F.lit(None).cast("binary").alias("gz"), F.lit(None).cast("string")
    return (
        chunks.select(F.lit("chunks").alias("src_table"), F.col("chunk_id").alias("record_key"), F.col("file_path").alias("path"), "text", no_gz)
        .unionByName(blobs.select(F.lit("blobs").alias("src_table"), F.col("content_hash").alias("record_key"), F.lit("").alias("path"), none.alias("text"), F.col("compressed_content").alias("gz")))
        .unionByName(
            evidence.select(
                F.lit("evidence_items").alias("src_table"), F.concat_ws(":", F.col("answer_id").cast("string"), "id").alias("record_key"), F.col("file_path").alias("path"), F.col("snippet").alias("text"), no_gz
            )
        )
        .where("record_key is not null")
    )
