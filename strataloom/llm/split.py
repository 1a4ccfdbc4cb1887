"""Oversized chunks in pieces under a limit (problem 3).

A recursive hierarchy of separators: units (definitions of listed symbols, headings), paragraphs, lines, sentences, words, characters.
A piece is packed greedily up to the last separator of the highest level that lies within the limit. A cut at a unit needs no overlap;
any other repeats the last 20 lines before it, or 200 characters where it falls inside a line. Where 20 lines leave no room for the next line,
as many as do are repeated, but 200 characters at least.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .units import body_line, unit_lines

_SENTENCE = re.compile(r"[.!?;](?=\s)\s*")
_WORD = re.compile(r"\s+")


def _after(pattern: re.Pattern, text: str, low: int, high: int) -> int | None:
    """The end of the last match that ends within (low, high]."""
    at = None
    for m in pattern.finditer(text, low, high):
        if low < m.end() <= high:
            at = m.end()
    return at


def cut_points(text: str, units: list[int], limit: int, lines: int, chars: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of the cut at its end) of each piece, as offsets into text; units: line indexes."""
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    if starts[-1] == len(text):
        starts.pop()
    at_unit = sorted({starts[i] for i in units if i < len(starts)})
    paragraphs = [s for s in starts if s >= 2 and text[s - 2 : s] == "\n\n" or s >= 3 and text[s - 3 : s] == "\n\r\n"]
    out, start, done = [], 0, 0  # text before `done` is in earlier pieces
    while len(text) - start > limit:
        top = start + limit

        def last(of: list[int]) -> int | None:
            k = bisect_right(of, top)  # noqa: B023
            return of[k - 1] if k and of[k - 1] > done else None  # noqa: B023

        for kind, at in (("unit", last(at_unit)), ("paragraph", last(paragraphs)), ("line", last(starts))):
            if at is not None:
                break
        else:
            kind, at = "sentence", _after(_SENTENCE, text, done, top)
            if at is None:
                kind, at = "word", _after(_WORD, text, done, top)
            if at is None:
                kind, at = "character", top
        out.append((start, at, kind))
        done = at
        if kind == "unit":
            start = at
        elif kind in ("paragraph", "line"):
            k = bisect_right(starts, at) - 1
            back = max(k - lines, 0)  # also into the piece before, where this one is shorter
            new = min((starts[k + 1] if k + 1 < len(starts) else len(text)) - at, limit - limit // 2)
            while back < k and at - starts[back] > limit - new:
                back += 1  # long lines: as many of them as leave room for the next line, or for half a piece where that is longer
            if k - back < lines:
                start = max(0, min(starts[back], at - min(chars, limit // 2)))
            else:
                start = starts[back]
        else:
            start = max(0, at - min(chars, limit // 2))
    out.append((start, len(text), "end"))
    return out


def pieces(text: str, kind: str | None, symbols: list[str], path: str | None, language: str | None, start_line: int | None, limit: int, lines: int, chars: int) -> Iterator[tuple]:
    units = unit_lines(text, kind, symbols, path, language)
    all_lines = text.split("\n")
    first = body_line(all_lines)
    known = start_line or 0
    if not known:
        for x in all_lines[:first]:
            if m := re.match(r"Lines: (\d+)-", x):
                known = int(m[1])
    starts = [0]
    for x in all_lines:
        starts.append(starts[-1] + len(x) + 1)
    order = sorted(units)
    spans = []  # (first line, last line, symbol): a symbol reaches to the next unit, one with members to the end of its last member
    for a, b in zip(order, [*order[1:], len(all_lines)]):
        if units[a]:
            spans.append((a, b - 1, units[a]))
    cuts = cut_points(text, order, limit, lines, chars)
    for n, (a, b, cut) in enumerate(cuts, 1):
        la, lb = bisect_right(starts, a) - 1, bisect_right(starts, max(a, b - 1)) - 1
        new = bisect_right(starts, cuts[n - 2][1]) - 1 if n > 1 else 0
        names = list(dict.fromkeys(s for x, y, s in spans if x <= lb and y >= la))
        of = lambda i: known + max(i - first, 0) if known else 0
        yield n, len(cuts), text[a:b], of(la), of(lb), la + 1, lb + 1, names, cut, (cuts[n - 2][1] - a if n > 1 else 0), [i + 1 for i in order if new <= i <= lb]


SCHEMA = (
    "chunk_id string, piece_no int, n_pieces int, text string, start_line int, end_line int, text_start_line int, text_end_line int, "
    "symbol_names array<string>, cut string, overlap_chars int, unit_lines array<int>"
)


def split_oversized(chunks: DataFrame, limit: int = 4000, overlap_lines: int = 20, overlap_chars: int = 200) -> DataFrame:
    """The pieces of every chunk whose text has more than `limit` characters; put together without overlaps, they are the text again.

    start_line and end_line are lines of the file (0 where unknown), text_start_line and text_end_line lines of the chunk's text; unit_lines
    are the text lines in the piece's new part on which a unit starts, line 1 among them. Repeated rows give one set of pieces. A chunk without text or id, or under the
    limit, gives none; null symbols, kinds or lines count as unknown. Only oversized rows leave the JVM; extra columns are not read.
    """
    if limit < 2:
        raise ValueError("limit must be at least 2")
    cols = ["chunk_id", "kind", "text", "symbol_names", "file_path", "language", "start_line"]
    big = chunks.where(F.char_length("text") > limit).where("chunk_id is not null").select(*cols).dropDuplicates(["chunk_id", "kind", "text", "symbol_names", "file_path", "start_line"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                line = 0 if pd.isna(r.start_line) else int(r.start_line)
                symbols = [] if r.symbol_names is None else list(r.symbol_names)
                for p in pieces(r.text, r.kind, symbols, r.file_path, r.language, line, limit, overlap_lines, overlap_chars):
                    rows.append((r.chunk_id, *p))
            yield pd.DataFrame(rows, columns=names)

    return big.mapInPandas(run, SCHEMA)
