"""Problem 1: oversized items cut at natural boundaries by lexical cohesion.

The words of an item are taken in units of UNIT; the similarity of the BLOCK units before and after each gap falls
where the topic changes, and the depth of such a valley is how far the similarity rises on both sides of it. A piece
ends at the natural boundary of greatest depth within its window: the upper half of the allowed size, then the rest of
it. Paragraph, line and sentence ends go before word ends, and these before a cut inside a word. Each later piece then
begins ``overlap`` characters before the end of the one before, or up to the next word start after that.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import codepoints as cp

LIMIT, OVERLAP = 6000, 150
UNIT, BLOCK, DIMENSIONS = 20, 5, 256
PARAGRAPH, LINE, SENTENCE, WORD, HARD, END = "paragraph", "line", "sentence", "word", "none", "end"
BONUS = {PARAGRAPH: 0.2, LINE: 0.1, SENTENCE: 0.0}  # added to the depth, as valleys are measured only every UNIT words
NATURAL = (PARAGRAPH, LINE, SENTENCE)
WINDOW = 1 << 18  # characters that are worked on at a time: about 20 MB
ARRAY = "array<struct<start:int,end:int,cut:string>>"


def depths(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the gaps between units, and the depth of the similarity's valley at each."""
    starts, ends = cp.word_runs(points, np.array([0, len(points)]))
    units = len(starts) // UNIT
    if units < 3:
        return np.zeros(0, np.int64), np.zeros(0)
    starts, ends = starts[: units * UNIT], ends[: units * UNIT]
    slot = (cp.run_hashes(cp.lowered()[points], starts, ends) % np.uint64(DIMENSIONS)).astype(np.int64)
    table = np.bincount(np.repeat(np.arange(units), UNIT) * DIMENSIONS + slot, minlength=units * DIMENSIONS).reshape(units, DIMENSIONS).astype(np.float32)
    table *= np.log((units + 1) / ((table > 0).sum(0) + 0.5)).astype(np.float32)  # words that are everywhere tell nothing
    sums = np.concatenate([np.zeros((1, DIMENSIONS), np.float32), np.cumsum(table, 0)])
    gap = np.arange(1, units)
    left = sums[gap] - sums[np.maximum(gap - BLOCK, 0)]
    right = sums[np.minimum(gap + BLOCK, units)] - sums[gap]
    alike = (left * right).sum(1) / np.maximum(np.sqrt((left**2).sum(1) * (right**2).sum(1)), 1e-9)
    around = np.lib.stride_tricks.sliding_window_view(np.pad(alike, 2 * BLOCK, constant_values=-1.0), 2 * BLOCK + 1)
    n = len(alike)
    return starts[gap * UNIT], (around[:n].max(1) - alike) + (around[2 * BLOCK : 2 * BLOCK + n].max(1) - alike)


def boundaries(points: np.ndarray) -> dict[str, np.ndarray]:
    """Places where a piece may end, by kind: after line ends, after final signs that white space follows, after words."""
    n = len(points)
    white = cp.classes()[points] == cp.SPACE
    line = np.isin(points, [10, 13, 0x85, 0x2028, 0x2029])
    final = np.isin(points, [ord(c) for c in ".!?;…。"])
    closing = np.isin(points, [ord(c) for c in "\"')]»”’"])
    follows = np.append(white[1:], True)
    last_line = line & ~np.append(line[1:] & ~((points[:-1] == 13) & (points[1:] == 10)), False)
    last_line &= ~((points == 13) & np.append(points[1:] == 10, False))
    line_end = np.flatnonzero(last_line) + 1
    # a line end is a paragraph's if the line before it is blank
    content = np.flatnonzero(~white)
    breaks = np.concatenate([[0], np.cumsum(line & ~((points == 10) & np.append(False, points[:-1] == 13)))])
    k = np.searchsorted(content, line_end) - 1
    before = np.where(k >= 0, content[np.maximum(k, 0)] + 1, 0) if len(content) else np.zeros(len(line_end), np.int64)
    blank = breaks[line_end] - breaks[before] >= 2
    ends = final & follows
    shut = closing & follows & np.append(False, final[:-1])
    return {
        PARAGRAPH: line_end[blank],
        LINE: line_end[~blank],
        SENTENCE: np.flatnonzero(ends | shut) + 1,
        WORD: np.flatnonzero(~white & follows) + 1,
    }


class _Window:
    """What is known of a part of a text: places where a piece may end with their scores and kinds, and word ends and starts."""

    def __init__(self, text: str, begin: int, end: int):
        self.end, last = end, end == len(text)
        points = np.frombuffer(text[begin:end].encode("utf-32-le"), np.uint32)
        gaps, depth = depths(points)
        kinds = boundaries(points)
        places, scores, names = [], [], []
        for number, kind in enumerate(NATURAL):
            p = kinds[kind]
            p = p if last else p[p < len(points)]  # the window's end is none of the text
            d = np.zeros(len(p))
            if len(gaps):
                k = np.searchsorted(gaps, p)
                lo, hi = np.maximum(k - 1, 0), np.minimum(k, len(gaps) - 1)
                d = depth[np.where(np.abs(gaps[lo] - p) <= np.abs(gaps[hi] - p), lo, hi)]
            places.append(p + begin)
            scores.append(d + BONUS[kind])
            names.append(np.full(len(p), number, np.int8))
        place = np.concatenate(places)
        order = np.argsort(place, kind="stable")
        self.place, self.score, self.name = place[order], np.concatenate(scores)[order], np.concatenate(names)[order]
        words = kinds[WORD]
        self.words = (words if last else words[words < len(points)]) + begin
        white = cp.classes()[points] == cp.SPACE
        self.word_start = np.flatnonzero(~white & np.append(begin == 0, white[:-1])) + begin


def spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP, window: int = WINDOW) -> list[tuple[int, int, str]]:
    """(start, end, kind of cut) of the pieces of a text; one piece if it is within the limit. Besides the text itself only a
    window of it is worked on at a time, so that memory doesn't grow with it; words are weighed within the window."""
    n = len(text)
    if n <= limit:
        return [(0, n, END)]
    margin = max(2 * limit, 2000)
    window = max(window, 4 * margin)
    view = _Window(text, 0, min(n, window))
    out, start, least = [], 0, 2 * overlap + 1
    while n - start > limit:
        if view.end < n and start + limit + margin > view.end:
            view = _Window(text, max(0, start - margin), min(n, start - margin + window))
        end, cut = -1, HARD
        top = start + limit
        for low in (start + max(limit // 2, least), start + least):
            a, b = np.searchsorted(view.place, [low, top + 1])
            if b > a:
                k = int(a + view.score[a:b].argmax())
                end, cut = int(view.place[k]), NATURAL[view.name[k]]
                break
        if end < 0:
            b = int(np.searchsorted(view.words, top + 1))
            if b and view.words[b - 1] >= start + least:
                end, cut = int(view.words[b - 1]), WORD
        if end < 0:
            end = top
            while end > start + least and unicodedata.category(text[end])[0] == "M":
                end -= 1
        out.append((start, end, cut))
        begin = end - overlap
        if begin > 0 and cp.classes()[ord(text[begin - 1])] != cp.SPACE:
            k = int(np.searchsorted(view.word_start, begin))
            if k < len(view.word_start) and view.word_start[k] < end:
                begin = int(view.word_start[k])
        start = begin
    out.append((start, n, END))
    return out


def pieces_of(text: Column | str, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """Array of (start, end, cut) of a text's pieces; null for a null text."""
    if overlap < 0 or 4 * overlap + 4 > limit:
        raise ValueError("the limit must be at least four overlaps")

    @F.arrow_udf(ARRAY)
    def run(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cut", pa.string())]))
        return pa.array([None if t is None else [dict(zip(("start", "end", "cut"), s, strict=True)) for s in spans(t, limit, overlap)] for t in texts.to_pylist()], kind)

    return run(F.col(text) if isinstance(text, str) else text)


def split_oversized(df: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True, whole: bool = False) -> DataFrame:
    """(id_col, piece_no, start, end, cut[, text]) of every row whose text has more than ``limit`` characters. No shuffle.

    Rows within the limit come out as one piece if ``whole``, else not at all; null texts never. Repeated rows come out
    repeatedly, a null id stays null, an empty table gives an empty one, other columns are left out.
    """
    big = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter("_text is not null" if whole else F.length("_text") > limit)
    cutting = big.select("_id", *(["_text"] if with_text else []), F.posexplode(pieces_of("_text", limit, overlap)).alias("_no", "_p"))
    out = cutting.select(F.col("_id").alias(id_col), F.col("_no").alias("piece_no"), "_p.*", *([F.expr("substring(_text, _p.start + 1, _p.end - _p.start)").alias("text")] if with_text else []))
    return out
