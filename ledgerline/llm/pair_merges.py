"""The merges of a byte-level BPE model, applied to many pieces of text at once."""

from __future__ import annotations

import numpy as np

#: Bytes of the longest piece, and the bits that hold a place in it.
LONGEST, BITS = 64, 6
#: What stands for the rank of a pair that no merge joins, and for an empty place of the hash table.
NONE, EMPTY = np.int32(2**31 - 1 << BITS & 2**31 - 1), np.uint64(2**64 - 1)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def byte_chars() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class PairMerges:
    """Encodes pieces as the model does: the pair of the lowest rank is joined, the leftmost of these first, until no merge is left.

    Pieces of one length are the columns of a matrix. A step joins one pair of
    each, which makes all columns one shorter; those that join no more are
    done. So there are as many steps as the longest piece has bytes, whatever
    the number of pieces.
    """

    def __init__(self, model: dict):
        """model: the model of a tokenizer's JSON form. Raises ValueError if it isn't plain BPE over all bytes."""
        if model.get("type") != "BPE" or any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "ignore_merges")):
            raise ValueError("not plain BPE")
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        try:
            self.single = np.array([vocab[c + end] for end in ("", suffix) for c in byte_chars()], np.int32)
            pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
            ranks = {(vocab[a], vocab[b]): i for i, (a, b) in enumerate(pairs)}
            self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        except KeyError as e:
            raise ValueError(f"not in the vocabulary: {e}") from None
        if len(pairs) >= int(NONE) >> BITS:
            raise ValueError("too many merges")
        keys = self._key(*np.array([*ranks], np.int64).reshape(-1, 2).T)
        size = max(8, int(np.ceil(np.log2(4 * len(keys) + 1))))
        self.shift, self.mask = np.uint64(64 - size), 2**size - 1
        self.keys, self.ranks = np.full(2**size, EMPTY), np.full(2**size, NONE)
        ranks, at = np.array([*ranks.values()], np.int32) << BITS, self._place(keys)
        while len(keys):  # where several go to one place, one stays and the others go on
            free = self.keys[at] == EMPTY
            self.keys[at[free]] = keys[free]
            mine = self.keys[at] == keys
            self.ranks[at[mine]] = ranks[mine]
            keys, ranks, at = keys[~mine], ranks[~mine], at[~mine] + 1 & self.mask
        #: Ranks of the pairs of single bytes, the second as a piece's last one from 256 on.
        self.byte_ranks = self.rank(np.repeat(self.single, 512), np.tile(self.single, 512)).reshape(512, 512)

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys * MULTIPLIER >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids, shifted by BITS."""
        key = self._key(a, b)
        at = self._place(key)
        met = self.keys[at]
        out = np.where(met == key, self.ranks[at], NONE)
        left = np.flatnonzero((met != key) & (met != EMPTY))
        while len(left):
            at[left] = at[left] + 1 & self.mask
            met = self.keys[at[left]]
            hit = met == key[left]
            out[left[hit]] = self.ranks[at[left[hit]]]
            left = left[~hit & (met != EMPTY)]
        return out

    def encode(self, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of pieces one after the other, the number of ids of each); a piece is the ``size`` bytes, 1 to LONGEST, of data from ``first`` on."""
        order = np.argsort(size.astype(np.uint8), kind="stable")
        bounds = np.searchsorted(size[order], np.arange(LONGEST + 2))
        n, done = np.ones(len(first), np.int64), []
        place = np.arange(LONGEST, dtype=np.int32)[:, None]
        who, ids, ranks = order[:0], np.zeros((LONGEST, 0), np.int32), np.zeros((LONGEST - 1, 0), np.int32)
        for length in range(LONGEST, 0, -1):
            fresh = order[bounds[length] : bounds[length + 1]]
            if len(fresh):
                raw = data[first[fresh] + place[:length]].astype(np.int64)
                raw[-1] += 256
                who = np.concatenate([who, fresh])
                ids = np.concatenate([ids[:length], self.single[raw]], axis=1)
                ranks = np.concatenate([ranks[: length - 1], self.byte_ranks[raw[:-1], raw[1:]]], axis=1)
            if not len(who):
                ids, ranks = ids[: length - 1], ranks[: max(0, length - 2)]
                continue
            if length == 1:
                done.append((who, ids))
                break
            best = (ranks | place[: length - 1]).min(axis=0)
            go = best < NONE
            if not go.all():
                done.append((who[~go], ids[:, ~go]))
                n[who[~go]] = length
                who, best = who[go], best[go]
                ids, ranks = np.compress(go, ids, axis=1), np.compress(go, ranks, axis=1)
            at, new, col = best & LONGEST - 1, self.made[best >> BITS], np.arange(len(who))
            ids = np.where(place[: length - 1] > at, ids[1:], ids[:-1])
            ids[at, col] = new
            ranks = np.where(place[: length - 2] > at, ranks[1:], ranks[:-1])
            x = np.flatnonzero(at > 0)
            ranks[at[x] - 1, x] = self.rank(ids[at[x] - 1, x], new[x])
            x = np.flatnonzero(at < length - 2)
            ranks[at[x], x] = self.rank(new[x], ids[at[x] + 1, x])
        out, starts = np.empty(n.sum(), np.int32), np.cumsum(n) - n
        for pieces, made in done:
            out[starts[pieces] + place[: len(made)]] = made
        return out, n
