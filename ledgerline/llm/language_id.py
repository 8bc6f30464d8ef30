"""Language identification: script ranges, then a Viterbi path over per-word scores."""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.llm.common import private, slices, spread

#: Training documents of one language at most; the model is a classifier fitted on a bounded sample.
SAMPLE = 1500
#: Characters of one language's training documents at most, but for the document that crosses the bound.
SAMPLE_CHARS = 20_000_000
#: Entries of a process's cache of word scores, and the bytes of text whose paths are found together.
CACHE, SLICE = 300_000, 4 << 20
#: First code points of script ranges, ascending; the ranges end where the next one starts.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
)
_STARTS = np.array([a for a, _ in SCRIPTS])
_NAMES = sorted({s for _, s in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(s) for _, s in SCRIPTS])
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_WHOLE = np.uint64(1 << 63)


class _Letters(dict):
    """Translates what is neither a letter (Unicode category L) nor a mark (M) to a space."""

    def __missing__(self, c: int) -> int:
        self[c] = out = c if unicodedata.category(chr(c))[0] in "LM" else 32
        return out


_LETTERS = _Letters()
_RUN = re.compile(r"[^ ]+")


def _has_letter(word: str) -> bool:
    return word.isalpha() or any(map(str.isalpha, word))


def words_of(text: str | None) -> list[str]:
    """The words of a text: runs of letters and marks with a letter among them."""
    runs = (text or "").translate(_LETTERS)
    words = runs.split()
    return words if runs.replace(" ", "").isalpha() else list(filter(_has_letter, words))


def word_spans(text: str | None) -> list[tuple[int, int]]:
    """Where the words of a text stand."""
    return [m.span() for m in _RUN.finditer((text or "").translate(_LETTERS)) if _has_letter(m[0])]


def _lowered(words: list[str]) -> list[str]:
    return "\n".join(words).lower().split("\n") if words else []


def scripts_of(points: np.ndarray) -> np.ndarray:
    """The script (its place in the sorted names) that each code point falls in."""
    return _SCRIPT[np.searchsorted(_STARTS, points, side="right") - 1]


def gram_keys(words: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """The keys of the words' features and the words' first code points.

    Features are the 1-, 2- and 3-grams of ``<word>`` and the whole word, each
    kind as (keys, the number for each word), word after word. An n-gram's key
    is its code points in 21 bits each; a whole word's is a hash.
    """
    width = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    points = np.frombuffer(f"<{'><'.join(words)}>".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    first = np.cumsum(width) - width
    place = np.arange(len(points)) - np.repeat(first, width)
    left = np.repeat(width, width) - place
    two = np.append(points[:-1] | points[1:] << np.uint64(21), points[-1:])
    three = np.append(two[:-2] | points[2:] << np.uint64(42), two[-2:])
    with np.errstate(over="ignore"):
        h = np.add.reduceat((points + _ODD[1]) * (_ODD[0] + place.astype(np.uint64) * _ODD[2]), first)
        h = (h ^ h >> np.uint64(31)) * _ODD[1]
    return [(points, width), (two[left > 1], width - 1), (three[left > 2], width - 2), (h | _WHOLE, np.ones(len(words), np.int64))], points[first + 1].astype(np.int64)


class Slots:
    """Positions of distinct non-zero keys, in an open-addressed table that is read by arrays of keys."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys) - 1).bit_length() + 1)
        self.shift, self.mask, self.unseen = np.uint64(64 - bits), (1 << bits) - 1, len(keys)
        self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.full(1 << bits, len(keys), np.int32)
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = self.keys[at] == 0
            spots, one = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[one]
            self.keys[spots], self.rows[spots] = keys[todo[put]], todo[put]
            rest = np.delete(np.arange(len(todo)), put)
            todo, at = todo[rest], at[rest] + 1 & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys ^ keys >> np.uint64(32)) * _ODD[0] >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, their number for one that isn't there."""
        at = self._home(keys)
        out = self.rows[at]
        left = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != 0))
        out[self.keys[at] == 0] = self.unseen
        at = at[left]
        while len(left):
            at = at + 1 & self.mask
            there = self.keys[at]
            out[left] = np.where(there == keys[left], self.rows[at], self.unseen)
            on = (there != keys[left]) & (there != 0)
            left, at = left[on], at[on]
        return out


@dataclass
class Model:
    """Languages, the places of the features' keys, the table of log shares (the last row: unseen), and each script's languages."""

    langs: list[str]
    slots: Slots
    table: np.ndarray
    scripts: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def words(self, words: list[str]) -> np.ndarray:
        """Mean log share of each word's features, scaled by the root of its length; far lower for languages without its script."""
        kinds, first = gram_keys(words)
        total, n = np.zeros((len(words), len(self.langs))), np.zeros(len(words))
        for keys, count in kinds:
            total += np.add.reduceat(self.table[self.slots(keys)], np.cumsum(count) - count, axis=0)
            n += count
        width = kinds[0][1]
        out = total / n[:, None] * (2 * np.sqrt(width - 1))[:, None]
        fits = self.scripts[scripts_of(first)]
        fits = fits | ~fits.any(axis=1, keepdims=True)
        return np.where(fits, out, out.min(axis=1, keepdims=True) - 20)


class Scores:
    """Scores of words, remembered up to a bound."""

    kept: Scores | None = None

    def __init__(self, model: Model):
        self.model, self.seen, self.rows = model, {}, np.zeros((1024, len(model.langs)), np.float32)

    @classmethod
    def of(cls, model: Model) -> Scores:
        """This process's scores under the model: a reused worker keeps them from task to task."""
        if cls.kept is None or cls.kept.model.name != model.name:
            cls.kept = cls(model)
        return cls.kept

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.seen) > CACHE:
            self.seen.clear()
        new = list(set(words).difference(self.seen))
        if new:
            at, need = len(self.seen), len(self.seen) + len(new)
            if need > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((max(need, len(self.rows)), self.rows.shape[1]), np.float32)])
            for lo in range(0, len(new), 16_384):
                part = new[lo : lo + 16_384]
                self.rows[at + lo : at + lo + len(part)] = self.model.words(part)
            self.seen.update(zip(new, range(at, need), strict=True))
        return self.rows[np.fromiter(map(self.seen.__getitem__, words), dtype=np.int64, count=len(words))]


def training_sample(docs: DataFrame, text: str, lang: str, doc_id: str, sample: int, chars: int) -> DataFrame:
    """(lang, t) of at most ``sample`` rows of each language, of ``chars`` characters but for the row that crosses the bound.

    Rows come in the order of md5(doc_id), then md5(text). A hash threshold from the
    languages' row counts leaves about three halves of the sample before rows
    are ranked, so that no task sees a whole language.
    """
    rows = private(docs, id=doc_id, lang=lang, t=text).where("lang is not null").select(
        "lang", "t", F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))).alias("o"), F.md5(F.coalesce("t", F.lit(""))).alias("x"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.conv(F.substring("o", 1, 8), 16, 10).cast("double") / float(1 << 32)
    near = rows.join(F.broadcast(counts), "lang").where(share * F.col("n") <= 1.5 * sample + 50)
    w = W.partitionBy("lang").orderBy("o", "x")
    size = F.coalesce(F.char_length("t"), F.lit(0))
    before = F.coalesce(F.sum(size).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return near.withColumns({"r": F.row_number().over(w), "before": before}).where((F.col("r") <= sample) & (F.col("before") < chars)).select("lang", "t")


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE, chars: int = SAMPLE_CHARS, least: float = 0.01) -> Model:
    """Learn shares of n-grams and words from a bounded sample of each language (``training_sample``).

    They are counted on the executors and summed by Spark; those seen fewer
    than three times in the sample are dropped, and what the driver gets is
    bounded by the sample. A language uses a script if ``least`` of its letters
    are in it. Rows without a language teach nothing; null and empty texts have
    no words; an empty table gives a model without languages.
    """
    rows = training_sample(docs, text, lang, doc_id, sample, chars)

    def count(batches):
        held: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for la, t in zip(batch.column("lang").to_pylist(), batch.column("t").to_pylist(), strict=True):
                held[la].update(_lowered(words_of(t)))
        for la, c in held.items():
            words = list(c)
            if not words:
                yield pa.RecordBatch.from_pydict({"lang": [la], "script": pa.array([None], pa.int32()), "g": pa.array([0], pa.int64()), "n": pa.array([0], pa.int64())})
                continue
            times = np.fromiter(c.values(), dtype=np.int64, count=len(c))
            kinds, first = gram_keys(words)
            keys, at = np.unique(np.concatenate([k for k, _ in kinds]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([np.repeat(times, m) for _, m in kinds])).astype(np.int64)
            in_script = np.bincount(scripts_of(first), weights=times * (kinds[0][1] - 2), minlength=len(_NAMES)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({
                "lang": [la] * (len(keys) + len(_NAMES)), "script": pa.array([None] * len(keys) + list(range(len(_NAMES))), pa.int32()),
                "g": np.concatenate([keys.view(np.int64), np.zeros(len(_NAMES), np.int64)]), "n": np.concatenate([n, in_script])})

    counts = rows.mapInArrow(count, "lang string, script int, g long, n long").groupBy("lang", "script", "g").agg(F.sum("n").alias("n"))
    got = counts.where("n > 2 or script is not null or g = 0").toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    of = got.column("lang").combine_chunks().dictionary_encode() if got.num_rows else pa.array([], pa.string()).dictionary_encode()
    own = np.array([langs.index(x) for x in of.dictionary.to_pylist()], np.int64)[of.indices.to_numpy()]
    script, n = got.column("script").fill_null(-1).to_numpy(), got.column("n").to_numpy()
    grams = (script < 0) & (n > 0)
    keys, at = np.unique(got.column("g").to_numpy()[grams].view(np.uint64), return_inverse=True)
    table = np.zeros((len(keys) + 1, len(langs)))
    table[at, own[grams]] = n[grams]
    letters = np.zeros((len(_NAMES), len(langs)))
    letters[script[script >= 0], own[script >= 0]] = n[script >= 0]
    return Model(langs, Slots(keys), np.log((table + 0.5) / (table.sum(axis=0) + 1)).astype(np.float32), letters >= least * np.maximum(letters.sum(axis=0), 1))


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The best path of languages for many texts at a time.

    ``scores`` has the words of all texts one after the other, ``lengths`` the
    words of each. The path of a text maximises the sum of its words' scores
    less ``penalty`` for each change of language.
    """
    k = scores.shape[1]
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    best = scores[first[size > 0]].copy()
    came = np.zeros((len(scores), k), np.int16)
    rows = np.arange(k)
    final = np.zeros((len(lengths), k))
    live = int((size > 0).sum())
    for t in range(1, int(size[0]) if len(size) else 0):
        more = int(np.searchsorted(-size, -t, side="left"))  # texts with more than t words
        final[more:live] = best[more:live]
        best, live = best[:more], more
        top = best.argmax(axis=1)
        jump = best[np.arange(more), top][:, None] - penalty
        stay = best >= jump
        came[first[:more] + t] = np.where(stay, rows, top[:, None])
        best = np.where(stay, best, jump) + scores[first[:more] + t]
    final[:live] = best[:live]
    path = np.zeros(len(scores), np.int64)
    now = final.argmax(axis=1)
    for t in range(int(size[0]) - 1 if len(size) else -1, -1, -1):
        n = int(np.searchsorted(-size, -t, side="left"))
        path[first[:n] + t] = now[:n]
        if t:
            now[:n] = came[first[:n] + t, now[:n]]
    return path


def label_spans(scores: Scores, texts: list[str | None], penalty: float, with_spans: bool = True):
    """For each text: (language, share of its letters, list of (start, end, language)) or None if it has no letter."""
    model = scores.model
    if with_spans:
        edges = [np.array(word_spans(t), np.int64).reshape(-1, 2) for t in texts]
        words = [t[a:b] for t, e in zip(texts, edges, strict=True) for a, b in e.tolist()]
        lengths = np.array([len(e) for e in edges])
    else:
        found = [words_of(t) for t in texts]
        words = [w for f in found for w in f]
        lengths = np.array([len(f) for f in found])
    if not words:
        return [None] * len(texts)
    path = viterbi(scores(_lowered(words)), lengths, penalty)
    k = len(model.langs)
    owner = np.repeat(np.arange(len(texts)), lengths)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    letters = np.bincount(owner * k + path, weights=size, minlength=len(texts) * k).reshape(len(texts), k)
    top, share = letters.argmax(axis=1), letters.max(axis=1) / np.maximum(letters.sum(axis=1), 1)
    out, at = [], 0
    for i, n in enumerate(lengths.tolist()):
        if not n:
            out.append(None)
            continue
        spans = []
        if with_spans:
            own, e = path[at : at + n], edges[i]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [n]])
            spans = [(int(e[a, 0]), int(e[b - 1, 1]), model.langs[own[a]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        at += n
        out.append((model.langs[int(top[i])], float(share[i]), spans))
    return out


def identify(docs: DataFrame, model: Model, text: str = "text", carry: tuple[str, ...] = ("doc_id",), penalty: float = 6.0, with_spans: bool = True) -> DataFrame:
    """The ``carry`` columns, lang_pred, score and, if asked for, spans (array of start, end, lang in code points).

    lang_pred is the language with most letters on the Viterbi path and score
    its share of the letters. Null texts, texts without a letter (Unicode
    category L), and all texts under a model without languages are ``und`` with
    score 0 and no spans. A word of a script that no language of the model uses
    keeps all languages as candidates. Whole texts are read, however long; ties
    go to the language first by name; repeated rows get equal answers; an empty
    table gives no rows.
    """
    rows = spread(docs).select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text}`").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        scores = Scores.of(m)
        for batch in batches:
            for part in slices(batch, "__text", max(SLICE // 16, SLICE * 4 // max(4, len(m.langs)))):
                texts = part.column("__text").to_pylist()
                told = label_spans(scores, texts, penalty, with_spans) if m.langs else [None] * len(texts)
                cols = [part.column(c) for c in carry] + [pa.array([x[0] if x else "und" for x in told]), pa.array([x[1] if x else 0.0 for x in told])]
                if with_spans:
                    cols.append(pa.array([[{"start": a, "end": b, "lang": la} for a, b, la in x[2]] if x else [] for x in told], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays(cols, names=[*carry, "lang_pred", "score", *["spans"] * with_spans])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("__text").schema)
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double" + ", spans array<struct<start:int,end:int,lang:string>>" * with_spans)
