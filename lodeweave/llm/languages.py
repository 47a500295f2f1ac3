"""Problem 8: the language of documents and of their segments by language-bitmask n-gram filters.

The filter is a bit-sliced Bloom filter: a table of bit masks, a bit for each language (beyond 64 languages several). An n-gram of checked samples
sets its language's bit in HASHES places; looking an n-gram up is an AND of HASHES masks and gives all languages that
may contain it. A sentence counts these masks, per-language hits are corrected by the share of false positives that the
fill of the language's slice implies, and n-grams of few languages weigh more. Sentences of a text are then decided
together: a change of language must be worth SWITCH weighted hits, so that names, codes and quotations make none.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import codepoints as cp

SIZES = (3, 4, 5)  # letters of an n-gram; word ends count as one
HASHES = 2
BITS = 19  # a table has 2**BITS masks: 1 MB for up to 16 languages, whatever the data
PATTERNS = 12  # languages up to which hits are counted by mask
MAX_SAMPLES = 2000  # checked rows the filter is made from, at most, the same share of each language
MAX_LABELLED = 2500  # rows of the data with a usable label, of up to LABELLED_CHARS, that widen it, at most
LABELLED_CHARS = 3000
SEEN = 3  # texts of a language an n-gram must be in to widen its slice,
RATE = 0.2  # and the least share of its rate in the language where it is most common
SWITCH = 6.0
SLICE = 1 << 18  # characters decided at once, so that counts stay in the processor's cache
MIN_WORDS = 3  # words of letters that make a sentence
#: Other spellings of language codes. Every language of the samples is known by its own code besides.
SPELLINGS = {
    "en": ["eng", "english"],
    "de": ["deu", "ger", "german"],
    "fr": ["fra", "fre", "french"],
    "es": ["spa", "spanish"],
    "pt": ["por", "portuguese"],
    "it": ["ita", "italian"],
    "nl": ["nld", "dut", "dutch"],
    "pl": ["pol", "polish"],
    "el": ["ell", "gre", "greek"],
}
ARRAY = "array<struct<lang:string,confidence:double,start:int,end:int>>"
DROPPED = 0xFFFFFFFF


@lru_cache(1)
def folding() -> np.ndarray:
    """Code point to lower-case base letter; marks and invisible signs to DROPPED, all else to a space."""
    out = np.where(cp.classes() == cp.LETTER, np.arange(0x110000, dtype=np.uint32), np.uint32(32))
    for c in [*range(0x2500), *range(0xFB00, 0xFFF0), *range(0x1D400, 0x1D800)]:
        if unicodedata.category(chr(c)) in ("Mn", "Me", "Cf"):
            out[c] = DROPPED
            continue
        base = unicodedata.normalize("NFKD", chr(c))[0].lower()
        base = unicodedata.normalize("NFKD", base)[0]
        if unicodedata.category(base)[0] == "L":
            out[c] = ord({"ł": "l", "ς": "σ", "ß": "s", "ø": "o", "đ": "d"}.get(base, base))
    return out


def folded(points: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters with one space between words and at the ends of each owner, and the owner of each."""
    f = folding()[points]
    kept = f != DROPPED
    f, owner = f[kept], owner[kept]
    if not len(f):
        return f, owner
    change = np.flatnonzero(owner[1:] != owner[:-1]) + 1
    f, owner = np.insert(f, change, 32), np.insert(owner, change, owner[change])
    f, owner = np.concatenate([[np.uint32(32)], f, [np.uint32(32)]]), np.concatenate([owner[:1], owner, owner[-1:]])
    kept = np.ones(len(f), bool)
    kept[1:] = (f[1:] != 32) | (f[:-1] != 32)
    return f[kept], owner[kept]


def ngrams(f: np.ndarray, owner: np.ndarray):
    """(key, owner) of the n-grams of each size that lie within a word and its ends."""
    word = f != 32
    key, inner = f.astype(np.uint64), np.ones(len(f), bool)
    for n in range(2, max(SIZES) + 1):
        m = len(f) - n + 1
        if m <= 0:
            return
        key = key[:m] * np.uint64(0x100000001B3) + f[n - 1 :]
        inner = inner[:m]
        if n > 2:
            inner = inner & word[n - 2 : n - 2 + m]
        if n in SIZES:
            here = np.flatnonzero(inner & (owner[:m] == owner[n - 1 :]))
            yield key[here], owner[here]


class Filter:
    """The bit-sliced filter of some languages."""

    def __init__(self, samples: list[tuple[str, str]]):
        self.langs = sorted({lang for lang, _ in samples})
        many = len(self.langs)
        kind = np.uint16 if many <= 16 else np.uint32 if many <= 32 else np.uint64
        self.tables = [np.zeros(1 << BITS, kind) for _ in range(max(1, -(-many // 64)))]
        for k, lang in enumerate(self.langs):
            points, at = cp.buffer([t for x, t in samples if x == lang])
            owner = np.searchsorted(at, np.arange(len(points)), "right") - 1
            for h, _ in ngrams(*folded(points, owner)):
                self._mark(k, h)
        self._settle()

    def widen(self, labelled: list[tuple[str, str]]) -> None:
        """Add n-grams of labelled texts. Only texts that the filter so far takes for their label, in one language, count."""
        values = [t for _, t in labelled]
        found = [s for a, b in cp.slices(values, SLICE) for s in segments(self, values[a:b])]
        rates: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k, lang in enumerate(self.langs):
            texts = [t for (x, t), s in zip(labelled, found, strict=True) if x == lang and s and len(s) == 1 and s[0][0] == lang]
            if not texts:
                continue
            points, at = cp.buffer(texts)
            owner = np.searchsorted(at, np.arange(len(points)), "right") - 1
            grams = []
            for h, who in ngrams(*folded(plain_words(points, owner)[0], owner)):
                order = np.argsort(h, kind="stable")  # texts stay in order within an n-gram
                h, who = h[order], who[order]
                grams.append(h[np.append(True, (h[1:] != h[:-1]) | (who[1:] != who[:-1]))])
            gram, n = np.unique(np.concatenate(grams), return_counts=True)
            rates.append((gram[n >= SEEN], n[n >= SEEN] / len(texts), np.full((n >= SEEN).sum(), k)))
        if not rates:
            return
        gram, rate, lang = (np.concatenate(x) for x in zip(*rates, strict=True))
        distinct, where = np.unique(gram, return_inverse=True)
        most = np.zeros(len(distinct))
        np.maximum.at(most, where, rate)
        for k in range(len(self.langs)):
            self._mark(k, gram[(lang == k) & (rate >= RATE * most[where])])
        self._settle()

    def _mark(self, k: int, grams: np.ndarray) -> None:
        table = self.tables[k // 64]
        for place in self._places(grams):
            table[place] |= table.dtype.type(1 << k % 64)

    def _has(self, k: int, masks: list[np.ndarray]) -> np.ndarray:
        m = masks[k // 64]
        return m & m.dtype.type(1 << k % 64) != 0

    def _settle(self) -> None:
        many = len(self.langs)
        self.false = np.array([self._has(k, self.tables).mean() for k in range(many)]) ** HASHES
        #: What an n-gram weighs by the number of languages that have it.
        self.weight = 1 - np.log(np.maximum(np.arange(many + 1), 1)) / np.log(max(many, 2))
        if many <= PATTERNS:
            self.bits = ((np.arange(1 << many)[:, None] >> np.arange(many)) & 1).astype(float)

    @staticmethod
    def _places(key: np.ndarray) -> list[np.ndarray]:
        return [((key * np.uint64(k)) >> np.uint64(64 - BITS)).view(np.int64) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[:HASHES]]

    def scores(self, points: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
        """Weighted hits of each owner in each language, corrected for false positives."""
        many, seen, hits = len(self.langs), np.zeros(owners, np.int64), [(np.zeros(0, np.int64), [t[:0] for t in self.tables])]
        for h, who in ngrams(*folded(points, owner)):
            places = self._places(h)
            masks = [t.take(places[0]) for t in self.tables]
            for place in places[1:]:
                for m, t in zip(masks, self.tables, strict=True):
                    m &= t.take(place)
            known = np.flatnonzero(masks[0]) if len(masks) == 1 else np.flatnonzero(np.any([m != 0 for m in masks], axis=0))
            seen += np.bincount(who, minlength=owners)
            hits.append((who[known], [m[known] for m in masks]))
        who, masks = np.concatenate([w for w, _ in hits]), [np.concatenate(m) for m in zip(*(m for _, m in hits), strict=True)]
        if many <= PATTERNS:
            counts = np.bincount(who * len(self.bits) + masks[0], minlength=owners * len(self.bits)).reshape(owners, len(self.bits))
            total = counts.astype(np.float64) @ (self.bits * self.weight[self.bits.sum(1).astype(int)][:, None])
        else:
            weight = self.weight[np.sum([np.bitwise_count(m) for m in masks], axis=0, dtype=np.int64)]
            total = np.stack([np.bincount(who[at], weight[at], owners) for at in (np.flatnonzero(self._has(k, masks)) for k in range(many))], axis=1)
        return np.maximum(total - seen[:, None] * self.false, 0) / (1 - self.false)


def plain_words(points: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points with codes (runs of letters, digits, _, - and / that hold a digit or _) blanked, and the first letters of the words of two letters or more that are left."""
    kind = cp.classes()[points]
    digit = (kind == cp.NUMBER) | (points == ord("_"))
    inside = (kind == cp.LETTER) | digit | np.isin(points, [ord("-"), ord("/")])
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (owner[1:] != owner[:-1])
    run = np.cumsum(first)
    coded = np.bincount(run[digit], minlength=int(run[-1]) + 1) > 0
    blank = inside & coded[run]
    letters = (kind == cp.LETTER) & ~blank
    word = letters.copy()
    word[:-1] &= letters[1:] & (owner[1:] == owner[:-1])
    word[-1] = False
    word[1:] &= ~letters[:-1] | (owner[1:] != owner[:-1])
    return np.where(blank, np.uint32(32), points), np.flatnonzero(word)


def sentence_starts(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where sentences begin: at texts, after line ends, and after final signs (with closing signs) that white space follows."""
    n = len(points)
    line = np.isin(points, [10, 11, 12, 13, 0x85, 0x2029])
    final = np.isin(points, [ord(c) for c in ".!?;·…。"])
    closing = np.isin(points, [ord(c) for c in "\"')]»”’"])
    white = cp.classes()[points] == cp.SPACE
    ends = line.copy()
    for back in range(3):  # a final sign, up to two closing ones, white space
        hit = final.copy()
        for j in range(1, back + 1):
            hit[:-j] &= closing[j:]
            hit[-j:] = False
        hit[: n - back - 1] &= white[back + 1 :]
        hit[n - back - 1 :] = False
        where = np.flatnonzero(hit) + back
        ends[where] = True
    start = np.zeros(n, bool)
    start[at[:-1][at[:-1] < n]] = True
    start[1:] |= ends[:-1]
    return np.flatnonzero(start)


def best_path(score: np.ndarray, switch: float) -> list[int]:
    """The language of each sentence, where every change costs ``switch``."""
    total, back = score[0].copy(), []
    for row in score[1:]:
        top = int(total.argmax())
        stay = total >= total[top] - switch
        back.append(np.where(stay, np.arange(len(total)), top))
        total = np.where(stay, total, total[top] - switch) + row
    path = [int(total.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def segments(flt: Filter, texts: list[str]) -> list[list[tuple[str, float, int, int]] | None]:
    """(language, confidence, start, end) of the segments of each text; None for a text without any sentence."""
    points, at = cp.buffer(texts)
    if not len(points):
        return [None] * len(texts)
    starts = sentence_starts(points, at)
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(points))))
    plain, word = plain_words(points, owner)
    words = np.bincount(owner[word], minlength=len(starts))
    score = flt.scores(plain, owner, len(starts)) * (words >= MIN_WORDS)[:, None]  # fewer words are no sentence and follow their neighbours
    text_of = np.searchsorted(at, starts, "right") - 1
    out: list = [None] * len(texts)
    edges = np.append(np.flatnonzero(np.diff(text_of, prepend=-1)), len(starts))
    best = score.argmax(1)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        real = np.flatnonzero(score[a:b].max(1) > 0) + a
        if not len(real):
            continue
        row, whole = int(text_of[a]), score[a:b]
        same = best[real] == best[real[0]]
        path = [int(best[real[0]])] * (b - a) if same.all() else best_path(whole, SWITCH)
        begin, segs = 0, []
        for i in range(1, b - a + 1):
            if i == b - a or path[i] != path[begin]:
                total = whole[begin:i].sum(0)
                first, second = np.partition(total, -2)[[-1, -2]] if len(total) > 1 else (total[0], 0.0)
                share = (first - second) / first if first > 0 else 0.0
                end = int(starts[a + i] if i < b - a else at[row + 1]) - int(at[row])
                segs.append((flt.langs[path[begin]], round(float(share), 6), int(starts[a + begin] - at[row]), end))
                begin = i
        out[row] = segs
    return out


def train(samples: DataFrame, labelled: DataFrame | None = None, lang_col: str = "lang", text_col: str = "text", max_samples: int = MAX_SAMPLES, max_labelled: int = MAX_LABELLED) -> Filter:
    """The filter made from at most ``max_samples`` checked rows, of each language as many as of the others, chosen by a
    hash of their text (rows without text or language are passed over), widened by at most ``max_labelled`` rows (id,
    label, text) of the data itself, chosen by a hash of their id."""
    rows = samples.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna()
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    each = max(1, max_samples // max(1, len(counts)))
    order = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    if any(n > each for n in counts.values()):  # about twice as many reach the driver, at least
        shares = samples.sparkSession.createDataFrame([(k, min(1 << 30, int((2 * each + 20) / n * (1 << 30)))) for k, n in counts.items()], "lang string, share long")
        rows = rows.join(F.broadcast(shares), "lang").filter(order <= F.col("share"))
    chosen: dict[str, list[tuple[int, str]]] = {}
    for r in rows.select("lang", "text", order.alias("o")).collect():
        chosen.setdefault(r["lang"], []).append((r["o"], r["text"]))
    flt = Filter([(lang, t) for lang in sorted(chosen) for _, t in sorted(chosen[lang])[:each]])
    if labelled is not None and max_labelled:
        usable = labelled.toDF("id", "label", "text").filter(F.col("label").isNotNull())
        share = min(1.0, 4 * max_labelled / max(1, usable.select("label").count()))  # so that few rows besides the sample reach the driver
        few = usable.filter((F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= int(share * (1 << 30))) & F.length("text").between(1, LABELLED_CHARS))
        flt.widen([(r[0], r[1]) for r in few.orderBy(F.xxhash64("id", F.lit(1))).select("label", "text").limit(max_labelled).collect()])
    return flt


def detect(text: Column | str, flt: Filter) -> Column:
    """Segments of a text in reading order; null for null, empty and blank texts and texts without any sentence."""

    @F.arrow_udf(ARRAY)
    def run(texts: pa.Array) -> pa.Array:
        values, out = [t or "" for t in texts.to_pylist()], []
        for a, b in cp.slices(values, SLICE):
            out += segments(flt, values[a:b])
        kind = pa.list_(pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.array([None if s is None else [dict(zip(("lang", "confidence", "start", "end"), x, strict=True)) for x in s] for s in out], kind)

    return run(F.col(text) if isinstance(text, str) else text)


def normal_label(label: Column, langs: list[str], spellings: dict[str, list[str]] | None = None) -> Column:
    """The code among ``langs`` of a label in any spelling (case, spaces, region, three letters, English name); null if it
    names none of them. Spellings: other names of a code (default: those of nine languages)."""
    known = SPELLINGS if spellings is None else spellings
    names = {name.lower(): code for code in langs for name in [code, *known.get(code, [])]}
    if not names:
        return F.lit(None).cast("string")
    whole = F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))
    code = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(code, whole), F.try_element_at(code, F.regexp_extract(whole, r"^(\p{L}+)(?:[-_].*)?$", 1)))


def label_languages(df: DataFrame, samples: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", spellings: dict[str, list[str]] | None = None) -> DataFrame:
    """(id_col, seg_no, lang, confidence, start, end, label, label_state), one row per segment; label_state is ok, missing or wrong.

    Rows whose text is null, blank or without any sentence have no segment and do not come out. A label is wrong if it is
    not the language of the largest segment. Repeated rows come out repeatedly, an empty table gives an empty one, other
    columns are left out.
    """
    langs = sorted(r[0] for r in samples.select("lang").dropna().distinct().collect())  # a row per language
    label = normal_label(F.col(label_col), langs, spellings)
    flt = train(samples, df.select(F.col(id_col), label, F.col(text_col)))
    found = df.select(F.col(id_col), label.alias("label"), detect(text_col, flt).alias("_segs")).filter("_segs is not null")
    main = F.expr("array_max(transform(_segs, s -> struct(s.end - s.start as size, s.lang as lang))).lang")
    state = F.when(F.col("label").isNull(), "missing").when(F.col("label") != main, "wrong").otherwise("ok")
    return found.withColumn("label_state", state).select(id_col, "label", "label_state", F.size("_segs").alias("n_segments"), F.posexplode("_segs").alias("_pos", "_seg")).select(
        id_col, (F.col("_pos") + 1).alias("seg_no"), F.col("_seg.lang").alias("lang"), F.col("_seg.confidence").alias("confidence"), F.col("_seg.start").alias("start"), F.col("_seg.end").alias("end"), "label", "label_state", "n_segments"
    )
