"""Removal of long repeated byte strings with suffix arrays built by two-stage sorting.

The suffixes that matter are those that start a window of ``length`` bytes.
Each window belongs to the anchor with the least hash of the k-grams in it; equal
windows have equal anchors, so windows whose anchor hash occurs once are done,
and the others meet under that hash. A task takes the pieces of text of many
anchors and sorts their suffixes in two stages. Windows under an anchor too
frequent for one task are dealt out by further anchors of theirs, under other
orders of the k-grams.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize, private, slices, spread
from ledgerline.llm.shared_windows import candidates, count_shared, shared_anchors

GRAM = 64
CHUNK = 1 << 20
#: Suffixes that one suffix array holds, about.
BATCH = 150_000
#: An anchor of more pieces is dealt out by further anchors of its windows, in this many rounds at most; what is still together then has its windows counted.
HOT, ROUNDS = 20_000, 12
#: Texts that hold repeated anchors are found by a broadcast of up to this many 16-byte keys.
BROADCAST_KEYS = 500_000
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def _gram_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every GRAM-byte string of ``data``."""
    n = len(data)
    h = np.ndarray((n - 7,), dtype="<u8", buffer=data, strides=(1,)).copy()
    with np.errstate(over="ignore"):
        width, odd = 8, iter(_ODD)
        h *= np.uint64(next(odd))
        h ^= h >> np.uint64(29)
        while width < GRAM:
            c = np.uint64(next(odd))
            h = h[:-width] * c + h[width:]
            h ^= h >> np.uint64(31)
            width *= 2
        h *= np.uint64(_ODD[0])
    return h


def anchors(data: bytes, length: int, order: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window start, windows) of each run of windows that share their anchor under one of many orders of the k-grams."""
    w = length - GRAM + 1
    out = []
    for at in range(0, max(0, len(data) - length + 1), CHUNK):
        part = data[at : at + CHUNK + length - 1]
        h = _gram_hashes(part)
        for _ in range(order):
            with np.errstate(over="ignore"):
                h = (h ^ h >> np.uint64(32)) * np.uint64(_ODD[3])
        n = len(h)
        own = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(n, dtype=np.uint64)
        rows = -(-n // w)
        grid = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
        grid[:n] = own
        grid = grid.reshape(rows, w)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        m = n - w + 1
        least = (np.minimum(back[:m], ahead[w - 1 : w - 1 + m]) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(least)) + 1])
        out.append((h[least[first]], first + at, np.diff(np.concatenate([first, [m]]))))
    if not out:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def suffix_array(buf: bytes, ends: np.ndarray, active: list[tuple[int, int]], depth: int) -> np.ndarray:
    """The starts within ``active`` (first, windows) in the order of their suffixes, compared to ``depth`` bytes at least.

    ``buf`` is pieces one after the other, ``ends[i]`` the end of the piece of
    byte i. Two stages: a suffix smaller than its successor (or last in its
    piece) is sorted directly; the rest are induced by a scan of the buckets
    of first bytes, all the suffixes of a bucket that are in place at a time.
    """
    t = np.frombuffer(buf, np.uint8)
    n = len(t)
    pos = np.arange(n)
    last = pos == ends - 1
    nxt = np.append(t[1:], 0)
    decided = last | (t != nxt)
    small = last | (t < nxt)
    # equal neighbours take the type of the next byte that differs
    to = np.minimum.accumulate(np.where(decided, pos, n)[::-1])[::-1]
    small = small[to]
    use = np.zeros(n, bool)
    follow = np.minimum.accumulate(np.where(small, pos, n)[::-1])[::-1]  # next directly sorted suffix
    want = np.zeros(n, bool)
    for first, windows in active:
        want[first : first + windows] = True
        use[first : follow[first + windows - 1] + 1] = True
    direct = np.flatnonzero(use & small).tolist()
    stop = ends
    direct.sort(key=lambda i: buf[i : min(i + depth, stop[i])])
    direct = np.array(direct, dtype=np.int64)
    induced = use & ~small
    entering: list[list[np.ndarray]] = [[] for _ in range(256)]
    by_byte = [direct[t[direct] == c] for c in range(256)] if len(direct) else [direct] * 256
    order = []

    def induce(found: np.ndarray, c: int) -> np.ndarray:
        before = found[found > 0] - 1
        before = before[induced[before] & ~last[before]]
        b = t[before]
        for x in np.unique(b[b > c]):
            entering[x].append(before[b == x])
        return before[b == c]

    for c in range(256):
        found = np.concatenate(entering[c]) if entering[c] else np.zeros(0, np.int64)
        while len(found):
            order.append(found)
            found = induce(found, c)
        if len(by_byte[c]):
            order.append(by_byte[c])
            induce(by_byte[c], c)
    out = np.concatenate(order) if order else np.zeros(0, np.int64)
    return out[want[out]]


def common_prefixes(buf: bytes, sa: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix but the first, the bytes it shares with the one before it in ``sa``, up to ``depth``, in steps of 8."""
    lcp = np.zeros(max(0, len(sa) - 1), np.int64)
    words = np.ndarray((max(0, len(buf) - 7),), dtype="<u8", buffer=buf, strides=(1,)) if len(buf) > 7 else None
    alive = np.arange(len(lcp))
    for at in [*range(0, depth - 7, 8), *[depth - 8] * (depth % 8 > 0)]:  # the last step may overlap the one before
        a, b = sa[alive] + at, sa[alive + 1] + at
        alive = alive[words[a] == words[b]]
        if not len(alive):
            break
        lcp[alive] = at + 8
    return lcp


def repeated_starts(pieces: list[tuple[bytes, int, int]], length: int) -> list[np.ndarray]:
    """For each (piece, windows, copies), the window starts whose window occurs again, in any piece or copy."""
    if all(c > 1 for _, _, c in pieces):
        return [np.arange(w) for _, w, _ in pieces]
    lens = np.array([len(p) for p, _, _ in pieces])
    offs = np.concatenate([[0], np.cumsum(lens)])[:-1]
    buf = b"".join(p for p, _, _ in pieces)
    sa = suffix_array(buf, np.repeat(offs + lens, lens), [(int(o), w) for o, (_, w, _) in zip(offs, pieces, strict=True)], length)
    same = np.flatnonzero(common_prefixes(buf, sa, length) >= length)
    hit = np.zeros(len(buf) + 1, bool)
    hit[sa[same]] = True
    hit[sa[same + 1]] = True
    return [np.arange(w) if c > 1 else np.flatnonzero(hit[o : o + w]) for o, (_, w, c) in zip(offs, pieces, strict=True)]


def _spans(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The union of [s, s + length) as (first, end) arrays."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.diff(starts) > length) + 1
    return starts[np.concatenate([[0], cut])], starts[np.concatenate([cut - 1, [len(starts) - 1]])] + length


def _sort_groups(length: int):
    """mapInArrow over (h, piece, windows, tk, a, copies) sorted by (h, piece): removed spans (tk, lo, hi)."""

    def solve(batch):
        tks, los, his = [], [], []
        for (_, _, copies), starts, own in zip([x[0] for x in batch], repeated_starts([x[0] for x in batch], length), [x[1] for x in batch], strict=True):
            lo, hi = _spans(starts, length)
            for tk, a in own:
                tks += [tk] * len(lo)
                los.append(lo + a)
                his.append(hi + a)
        if not tks:
            return None
        return pa.RecordBatch.from_arrays([pa.array(tks, pa.binary()), pa.array(np.concatenate(los), pa.int64()), pa.array(np.concatenate(his), pa.int64())], names=["tk", "lo", "hi"])

    def run(batches):
        ready, group, now, size = [], [], None, 0

        def close():
            # a group with one piece that occurs once has no repeat
            if len(group) > 1 or group and group[0][0][2] > 1:
                ready.extend(group)
                return sum(x[0][1] for x in group if True)
            return 0

        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512).to_pydict()
                for h, piece, w, tk, a, n in zip(*[part[c] for c in ("h", "piece", "windows", "tk", "a", "copies")], strict=True):
                    if h != now:
                        size += close()
                        group, now = [], h
                        if size > BATCH:
                            if (out := solve(ready)) is not None:
                                yield out
                            ready, size = [], 0
                    if group and group[-1][0][0] == piece:
                        old = group[-1]
                        group[-1] = ((piece, w, old[0][2] + n), old[1])
                        old[1].append((tk, a))
                    else:
                        group.append(((piece, w, n), [(tk, a)]))
        close()
        if ready and (out := solve(ready)) is not None:
            yield out

    return run


def _pieces(length: int):
    """mapInArrow over (tk, t, list of (h, a, c, n, hot)): one row for each anchor with its piece of text."""

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 64):
                out = {k: [] for k in ("h", "piece", "windows", "tk", "a", "copies", "hot")}
                for r in batch.slice(lo, 64).to_pylist():
                    for x in r["xs"]:
                        out["h"].append(x["h"])
                        out["piece"].append(r["t"][x["a"] : x["a"] + x["c"] + length - 1])
                        out["windows"].append(x["c"])
                        out["tk"].append(r["tk"])
                        out["a"].append(x["a"])
                        out["copies"].append(x["copies"])
                        out["hot"].append(x["hot"])
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("h", pa.int64()), ("piece", pa.binary()), ("windows", pa.int32()), ("tk", pa.binary()), ("a", pa.int64()), ("copies", pa.int64()), ("hot", pa.bool_())]))

    return run


_PIECE = "h long, piece binary, windows int, tk binary, a long, copies long"


def _split(length: int, order: int):
    """mapInArrow over pieces: the runs of each piece's windows that share a further anchor, keyed by both hashes."""

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 256):
                out = {k: [] for k in ("h", "piece", "windows", "tk", "a", "copies")}
                for r in batch.slice(lo, 256).to_pylist():
                    h, first, count = anchors(r["piece"], length, order)
                    with np.errstate(over="ignore"):
                        both = ((h ^ np.int64(r["h"]).view(np.uint64)) * np.uint64(_ODD[2])).view(np.int64)
                    for x, f, c in zip(both.tolist(), first.tolist(), count.tolist(), strict=True):
                        for k, v in zip(out, (x, r["piece"][f : f + c + length - 1], c, r["tk"], r["a"] + f, r["copies"]), strict=True):
                            out[k].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("h", pa.int64()), ("piece", pa.binary()), ("windows", pa.int32()), ("tk", pa.binary()), ("a", pa.int64()), ("copies", pa.int64())]))

    return run


def _sorted_spans(pieces: DataFrame, length: int) -> DataFrame:
    """(tk, lo, hi) from the suffix arrays of pieces, grouped by h."""
    return pieces.repartition("h").sortWithinPartitions("h", "piece").mapInArrow(_sort_groups(length), "tk binary, lo long, hi long")


def _counted_spans(pieces: DataFrame, length: int) -> DataFrame:
    """(tk, lo, hi) of pieces whose windows are counted by their content, the MD5 of their bytes."""
    windows = pieces.select("tk", "a", "copies", F.posexplode(F.expr(f"transform(sequence(1, windows), i -> unhex(md5(substring(piece, i, {length}))))")).alias("s", "wh"))
    again = windows.groupBy("wh").agg(F.sum("copies").alias("n")).where("n > 1").select("wh")
    lo = F.col("a") + F.col("s")
    return windows.join(again, "wh").select("tk", lo.alias("lo"), (lo + length).alias("hi"))


def _hot_spans(pieces: DataFrame, length: int, hot: int) -> DataFrame:
    """(tk, lo, hi) for the pieces of anchors too frequent for one task.

    Equal pieces are merged first. Then each round deals windows out by one more
    anchor of theirs, which equal windows share whatever stands around them,
    until a group is small enough for one suffix array. Groups that resist
    ``ROUNDS`` rounds have their windows counted by content.
    """
    named = pieces.withColumn("pk", F.unhex(F.md5("piece")))
    todo = materialize(named.groupBy("h", "pk").agg(F.first("piece").alias("piece"), F.first("windows").alias("windows"), F.sum("copies").alias("copies")).select("h", "piece", "windows", F.col("pk").alias("tk"), F.lit(0).cast("long").alias("a"), "copies"), "suffix-hot")
    found = []
    for order in range(1, ROUNDS + 1):
        made = materialize(todo.mapInArrow(_split(length, order), _PIECE), "suffix-split")
        sizes = made.groupBy("h").agg(F.count("*").alias("n"), F.sum("copies").alias("m"))
        big = materialize(sizes.where(F.col("n") > hot).select("h"), "suffix-big")
        small = made.join(sizes.where((F.col("n") <= hot) & (F.col("m") > 1)).select("h"), "h", "left_semi")
        found.append(_sorted_spans(small, length))
        if big.isEmpty():
            break
        todo = materialize(made.join(big, "h", "left_semi"), "suffix-hot")
    else:
        found.append(_counted_spans(todo, length))
    spans = found[0]
    for part in found[1:]:
        spans = spans.unionByName(part)
    spans = materialize(spans.select(F.col("tk").alias("pk"), "lo", "hi").distinct(), "suffix-hot-spans")
    return named.select("pk", "tk", "a").join(spans, "pk").select("tk", (F.col("lo") + F.col("a")).alias("lo"), (F.col("hi") + F.col("a")).alias("hi"))


def repeated_spans(docs: DataFrame, length: int = 400, text: str = "text", hot: int = HOT) -> DataFrame:
    """(tk, spans) for each distinct text that has bytes covered by a ``length``-byte string that starts anywhere else too.

    tk is the MD5 of the text, spans an array of (lo, hi), which may overlap.
    Anchors of equal texts are merged before they meet the others of their hash.
    """
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} or more")
    rows = docs.select(F.col(f"`{text}`").cast("binary").alias("t")).where(F.col("t").isNotNull())
    keyed = rows.select(F.unhex(F.md5("t")).alias("tk"), "t").where(F.octet_length("t") >= length)

    def find(batches):
        for batch in batches:
            for part in slices(batch, "t", 4 << 20):
                got = [(tk, *anchors(t, length)) for tk, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([tk for tk, h, _, _ in got for _ in range(len(h))], pa.binary()),
                    pa.array(np.concatenate([x[1] for x in got]).view(np.int64)),
                    pa.array(np.concatenate([x[2] for x in got]).astype(np.int64)),
                    pa.array(np.concatenate([x[3] for x in got]).astype(np.int32)),
                ], names=["tk", "h", "a", "c"])

    every = keyed.mapInArrow(find, "tk binary, h long, a long, c int").groupBy("h", "tk", "a", "c").agg(F.count("*").alias("copies"))
    marks = materialize(every, "suffix-anchors")
    # written, so that the join below has two plain sides and Spark can split a frequent anchor's rows
    often = materialize(marks.groupBy("h").agg(F.count("*").alias("n"), F.sum("copies").alias("m")).where("m > 1").select("h", (F.col("n") > hot).alias("hot")), "suffix-often")
    wanted = materialize(marks.join(often, "h").groupBy("tk").agg(F.collect_list(F.struct("h", "a", "c", "copies", "hot")).alias("xs")), "suffix-wanted")
    some = wanted.select("tk")
    texts = keyed.join(F.broadcast(some) if some.count() <= BROADCAST_KEYS else some, "tk", "left_semi").groupBy("tk").agg(F.first("t").alias("t")).join(wanted, "tk")
    pieces = texts.select("tk", "t", "xs").mapInArrow(_pieces(length), "h long, piece binary, windows int, tk binary, a long, copies long, hot boolean")
    any_hot = not often.where("hot").isEmpty()
    if any_hot:
        pieces = materialize(pieces, "suffix-pieces")
    spans = _sorted_spans(pieces.where("not hot").drop("hot"), length)
    if any_hot:
        spans = spans.unionByName(_hot_spans(pieces.where("hot").drop("hot"), length, hot))
    return spans.groupBy("tk").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def cut(text: bytes, spans) -> tuple[bytes, int, int]:
    """(remaining bytes, removed bytes, maximal removed runs)."""
    parts, at, removed, runs = [], 0, 0, 0
    end = -1
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if lo > end:
            runs += 1
            parts.append(text[max(at, 0) : lo])
            removed += hi - lo
            at = end = hi
        elif hi > end:
            removed += hi - end
            at = end = hi
    parts.append(text[at:])
    return b"".join(parts), removed, runs


def remove_repeats(docs: DataFrame, length: int = 400, text: str = "text", doc_id: str = "doc_id", keep_text: bool = True, hot: int = HOT, words: int = 0) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept][, n_shared_windows]) for every document.

    A byte goes if it is covered by a ``length``-byte string that starts
    anywhere else as well: in another document, a copy, or the same document,
    overlaps included. Strings are judged on the input. Matches never cross
    documents. Null texts count as empty; texts shorter than ``length`` are
    kept whole; equal rows are copies of each other, so all their bytes go if
    they are long enough; null ids stay; an empty table gives no rows.
    ``kept`` (binary) holds the remaining bytes, which need not be valid UTF-8.
    Texts may be of any length; other columns can't clash.
    With ``words``, ``n_shared_windows`` is the number of places in a text where
    that many words start which another document holds too: passages told by
    words, however few bytes they have. It takes no part in the removal.
    """
    docs = spread(private(docs, doc_id=doc_id, text=text))
    spans = repeated_spans(docs, length, "text", hot)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("t"))
    rows = rows.select("doc_id", "t", F.unhex(F.md5("t")).alias("tk"), F.xxhash64("t").alias("key"))
    if words:
        wanted, copied = shared_anchors(rows, words)
        spans = spans.join(wanted, "tk", "full")
    joined = rows.join(spans, "tk", "left").select("doc_id", "t", "spans", *["key", "hs"] * bool(words))
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()} | ({"kept": pa.binary()} if keep_text else {})
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    if words:
        kinds |= {"key": pa.int64(), "ws": pa.list_(pa.int64()), "ns": pa.list_(pa.int64())}
        schema += ", key long, ws array<long>, ns array<long>"

    def run(batches):
        before = None
        for batch in batches:
            for lo in range(0, len(batch), 128):
                out = {k: [] for k in kinds}
                for r in batch.slice(lo, 128).to_pylist():
                    rest, removed, runs = cut(r["t"], r["spans"])
                    values = [r["doc_id"], len(r["t"]), removed, runs, hashlib.sha256(rest).hexdigest(), *[rest] * keep_text]
                    if words:
                        # copies mostly stand together; one of them tells their windows
                        values += [r["key"], *(candidates(r["t"], r["hs"], words) if r["hs"] and r["key"] != before else (None, None))]
                        before = r["key"]
                    for k, v in zip(out, values, strict=True):
                        out[k].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema(list(kinds.items())))

    out = joined.mapInArrow(run, schema)
    if words:
        out = materialize(out, "suffix-shared")
        shared = count_shared(out, copied).withColumnRenamed("n", "n_shared_windows")
        out = out.drop("ws", "ns").join(shared, "key", "left").drop("key").fillna(0, "n_shared_windows")
    return out
