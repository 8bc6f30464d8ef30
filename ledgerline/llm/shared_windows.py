"""Word windows that different documents share, whatever their length in bytes.

Each window of ``words`` words belongs to the run of word grams with the least
hash in it, its anchor. Equal windows have equal anchors, so only windows under
an anchor that different texts have can be shared; those are counted. Words are
what stands between white space; words, windows and, where windows are counted,
texts are known by 64-bit hashes. Texts may be of any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import SPACE_CHARS, materialize, slices

WORDS, GRAM = 51, 16
#: Bytes of text hashed, and words whose windows are made, at a time.
CHUNK = 1 << 20
#: Anchors that different texts have are told by a broadcast of up to this many 8-byte keys.
BROADCAST_KEYS = 500_000
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407))
_BASE = np.uint64(0x9E3779B97F4A7C17)
_SPACE = np.isin(np.arange(256), list(SPACE_CHARS.encode()))
with np.errstate(over="ignore"):
    _BYTE = (np.arange(1, 257, dtype=np.uint64) * _ODD[0]) ^ (np.arange(1, 257, dtype=np.uint64) * _ODD[1] >> np.uint64(29))
    _BYTE = (_BYTE * _ODD[2] ^ (_BYTE * _ODD[2] >> np.uint64(32))) * _ODD[3] | np.uint64(1)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, first byte) of every word of ``data``."""
    hashes, starts, at = [], [], 0
    t = np.frombuffer(data, np.uint8)
    while at < len(t):
        end = at + CHUNK  # on to the end of the word there
        while end < len(t) and not (space := _SPACE[t[end : end + CHUNK]]).any():
            end += CHUNK
        end = min(len(t), end + int(space.argmax())) if end < len(t) else len(t)
        part = t[at:end]
        blank = _SPACE[part]
        edges = np.flatnonzero(np.diff(blank, prepend=True, append=True))
        first, sizes = edges[::2], edges[1::2] - edges[::2]
        if len(first):
            before = np.cumsum(sizes) - sizes
            with np.errstate(over="ignore"):
                power = np.multiply.accumulate(np.full(sizes.max(), _BASE))
                h = np.add.reduceat(_BYTE[part[~blank]] * power[np.arange(sizes.sum()) - np.repeat(before, sizes)], before)
                h = (h ^ h >> np.uint64(32)) * _ODD[3]
            hashes.append(h ^ h >> np.uint64(29))
            starts.append(first + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def _joined(h: np.ndarray, words: int) -> np.ndarray:
    """A 64-bit hash of every ``words`` words in a row."""
    out, done, power, width = None, 0, h, 1
    with np.errstate(over="ignore"):
        for step in range(words.bit_length()):
            if words & width:
                m = len(h) - done - width + 1
                out = power if out is None else (out[:m] * _ODD[4] ^ out[:m] >> np.uint64(32)) * _ODD[0] + power[done : done + m]
                done += width
            if 2 * width <= words:
                power = power[:-width] * _ODD[step % 4] + power[width:]
                power ^= power >> np.uint64(31)
                width *= 2
        return out ^ out >> np.uint64(32)


def windows(texts: list[bytes], words: int = WORDS):
    """For parts of ``texts``: (text's index, hash, anchor) of every window of ``words`` words."""
    h, starts = word_hashes(b"\n".join(texts))
    owner = np.searchsorted(np.cumsum([0, *[len(t) + 1 for t in texts]]), starts, side="right") - 1
    gram = min(GRAM, words)
    w = words - gram + 1
    for at in range(0, max(0, len(h) - words + 1), CHUNK):
        part, own = h[at : at + CHUNK + words - 1], owner[at : at + CHUNK + words - 1]
        with np.errstate(over="ignore"):
            g = _joined(part, gram) * _ODD[1]
        n = len(g)
        ranked = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
        ranked[:n] = (g & np.uint64(0xFFFFFFFFFF000000)) | np.arange(n, dtype=np.uint64)
        ranked = ranked.reshape(-1, w)
        ahead = np.minimum.accumulate(ranked, axis=1).ravel()
        back = np.minimum.accumulate(ranked[:, ::-1], axis=1)[:, ::-1].ravel()
        m = n - w + 1
        least = (np.minimum(back[:m], ahead[w - 1 : w - 1 + m]) & np.uint64(0xFFFFFF)).astype(np.int64)
        inside = np.flatnonzero(own[:m] == own[words - 1 :])
        yield own[inside], _joined(part, words)[inside], g[least[inside]]


def _marks(words: int):
    """mapInArrow over (tk, key, t): each anchor of a text (tk, key, h), the text's number of windows in one row of its and 0 in others."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "t", 4 << 20):
                seen = np.zeros(len(part), np.int64)
                owners, anchors = [], []
                for own, _, anchor in windows(part.column(2).to_pylist(), words):
                    seen += np.bincount(own, minlength=len(part))
                    first = np.flatnonzero((np.diff(own, prepend=-1) != 0) | (np.diff(anchor, prepend=np.uint64(0)) != 0))
                    owners.append(own[first])
                    anchors.append(anchor[first])
                if owners and len(own := np.concatenate(owners)):
                    count = np.where(np.diff(own, prepend=-1) != 0, seen[own], 0)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), part.column(1).take(pa.array(own)), pa.array(np.concatenate(anchors).view(np.int64)), pa.array(count)], names=["tk", "key", "h", "n"])

    return run


def shared_anchors(keyed: DataFrame, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(tk, hs): the anchors of each text that other texts have too; (key, n): the number of windows of each text that occurs more than once.

    ``keyed`` is (tk, key, t): the MD5 of a text, its XXH64 and its bytes.
    """
    if words < 1:
        raise ValueError("words must be 1 or more")
    long_enough = keyed.select("tk", "key", "t").where(F.octet_length("t") >= 2 * words - 1)
    marks = materialize(long_enough.mapInArrow(_marks(words), "tk binary, key long, h long, n long"), "shared-anchors")
    often = marks.groupBy("h").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most").select("h")
    often = materialize(often, "shared-often")
    wanted = marks.join(F.broadcast(often) if often.count() <= BROADCAST_KEYS else often, "h").groupBy("tk").agg(F.collect_set("h").alias("hs"))
    copied = marks.where("n > 0").groupBy("key").agg(F.count("*").alias("copies"), F.max("n").alias("n")).where("copies > 1").select("key", "n")
    return wanted, copied


def candidates(text: bytes, hs: list[int], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash, places) of each distinct window of ``text`` under the anchors ``hs``."""
    wanted = np.array(hs, np.int64).view(np.uint64)
    found = [w[np.isin(anchor, wanted)] for _, w, anchor in windows([text], words)]
    w, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return w.view(np.int64), n


def _rows(batches):
    """Over (key, ws, ns): one row for each window, (w, key, n)."""
    for batch in batches:
        keys, ws, ns = batch.columns
        yield pa.RecordBatch.from_arrays([ws.flatten(), pa.array(np.repeat(keys.to_numpy(), np.diff(ws.offsets.to_numpy()))), ns.flatten()], names=["w", "key", "n"])


def _shared(batches):
    """Over (w, key, n) sorted by w: the rows of windows that more than one key has, summed by key."""
    last: list = []

    def close(w, key, n):
        first = np.flatnonzero(np.diff(w, prepend=~w[:1]) != 0)
        several = np.minimum.reduceat(key, first) < np.maximum.reduceat(key, first)
        several = np.repeat(several, np.diff(first, append=len(w)))
        keys, at = np.unique(key[several], return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(at, n[several], len(keys)).astype(np.int64))], names=["key", "n"])

    for batch in batches:
        w, key, n = (batch.column(i).to_numpy() for i in range(3))
        if not len(w):
            continue
        if last and last[0][0][0] == w[-1]:  # all of one window
            last.append((w, key, n))
            continue
        cut = int(np.searchsorted(w, w[-1]))
        ready = [*last, (w[:cut], key[:cut], n[:cut])]
        last = [(w[cut:], key[cut:], n[cut:])]
        if sum(len(x[0]) for x in ready):
            yield close(*(np.concatenate(x) for x in zip(*ready, strict=True)))
    if last:
        yield close(*(np.concatenate(x) for x in zip(*last, strict=True)))


def count_shared(held: DataFrame, copied: DataFrame) -> DataFrame:
    """(key, n): the places in each text where a window starts that another text or copy holds too.

    ``held`` is (key, ws, ns), the candidates of each text; ``copied`` is as
    ``shared_anchors`` gives it, and tells all the windows of a text that occurs
    more than once, whatever ``held`` repeats of it.
    """
    rows = held.where("ws is not null").select("key", "ws", "ns").mapInArrow(_rows, "w long, key long, n long")
    both = rows.repartition("w").sortWithinPartitions("w").mapInArrow(_shared, "key long, n long")
    summed = both.groupBy("key").agg(F.sum("n").alias("n")).select("key", F.struct(F.lit(0).alias("all"), "n").alias("x"))
    return summed.unionByName(copied.select("key", F.struct(F.lit(1).alias("all"), "n").alias("x"))).groupBy("key").agg(F.max("x").alias("x")).select("key", "x.n")
