"""Token ids as length-delimited binary records with checksums and a separate offset index.

A data file is a row of frames. A frame is the payload's length (8 bytes),
the masked checksum of those 8 bytes (4), the payload, and the payload's
masked checksum (4). A payload is a flag byte (1: the id is null), the
document's id (8), and its token ids, 2 bytes each where the vocabulary has at
most 65,536 entries, otherwise 4. All numbers are little-endian. The index
file has the frame's offset and the number of tokens (8 bytes each) for every
record, then their masked checksum, so a reader can fetch records in any order.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from itertools import pairwise
from random import Random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize, scratch_path, slices
from ledgerline.llm.pair_merges import LONGEST, PairMerges

#: Encoded words that stay of a process's table when it has twice as many; those not met lately drop out.
CACHE = 400_000
#: Bytes of text that are split at once, about.
SLICE = 8 << 20
HEAD, FOOT, PAYLOAD = "<QI", "<I", "<Bq"
HEAD_SIZE, FOOT_SIZE, PAYLOAD_SIZE = map(struct.calcsize, (HEAD, FOOT, PAYLOAD))
INDEX = np.dtype([("offset", "<u8"), ("n_tokens", "<u8")])
BUFFER = 4 << 20


def masked(data: bytes) -> int:
    """The rotated and shifted CRC-32 of ``data``: a checksum that can itself be stored among checksummed data."""
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


_KEPT: dict[str, Encoder] = {}


def _strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


#: Kinds of bytes in case-folded words: letters of ASCII and Latin-1 (both bytes of these), ASCII marks, and the rest. A byte that continues a letter follows 0xC3, or else one of the rest.
LETTER, MARK, OTHER = 0, 1, 2
KINDS = np.full(256, OTHER, np.uint8)
KINDS[[*range(0x61, 0x7B), 0xC3, *(x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7))]] = LETTER
KINDS[[x for x in range(0x21, 0x7F) if not chr(x).isalnum()]] = MARK
#: Bytes of plain words in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x80:0x9F] += 0x20


def _bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of strings one after the other, where each begins and the last ends)."""
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int32, len(words) + 1, 4 * words.offset).astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def _plain(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which words are letters with closing marks or without, where the marks of each begin)."""
    kinds = KINDS[data]
    marks = np.concatenate([[0], np.cumsum(kinds == MARK)])
    # what can't stand where it does: the rest anywhere, a letter after a mark, a mark first
    wrong = kinds == OTHER
    wrong[1:] |= (kinds[1:] == LETTER) & (kinds[:-1] == MARK)
    start = ends[:-1][ends[1:] > ends[:-1]]
    wrong[start] = kinds[start] != LETTER
    wrong = np.concatenate([[0], np.cumsum(wrong)])
    begin = ends[1:] - (marks[ends[1:]] - marks[ends[:-1]])
    fits = (begin > ends[:-1]) & (begin - ends[:-1] <= LONGEST) & (ends[1:] - begin <= LONGEST)
    return fits & (wrong[ends[1:]] == wrong[ends[:-1]]), begin


def _gather(ids: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(runs of ``n`` ids from ``first`` on, one after the other; where each begins and the last ends)."""
    at = np.concatenate([[0], np.cumsum(n)])
    return ids[np.repeat(first - at[:-1], n) + np.arange(at[-1])], at


class Encoder:
    """Encodes whole texts to ids; odd words met lately come from a bounded table.

    Of a tokenizer whose normalizer and splitter never join what ASCII white
    space parts, a text's ids are its words' ids in order; ``_wordwise`` tries
    that on a probe, and texts of any other tokenizer are encoded whole. Arrow
    splits the texts and finds the distinct words. A word of Latin-1 letters
    with closing marks is two pieces, the letters and the marks, for a
    tokenizer that folds case and splits at the end of letters. If its model is
    plain byte-level BPE (``_merges`` tries it), the pieces are encoded all at
    once by ``PairMerges``. Other words are encoded one by one as they stand if
    the table doesn't have them, and texts that hold a marker of a special
    token in one call.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tok.get_vocab_size() <= 65_536 else "<u4"
        self.special = [x.content for x in self.tok.get_added_tokens_decoder().values()]
        #: Word to row; row i has the ids ``ids[ends[i]:ends[i + 1]]`` and was last met in call ``met[i]``.
        self.rows: dict[str, int] = {}
        self.ids, self.ends, self.met, self.calls = np.zeros(0, self.kind), np.zeros(1, np.int64), np.zeros(0, np.int64), 0
        self.folds = all(self._whole(x) == self._whole(x.lower()) for x in ("WORD Étude", "Some Words, MORE"))
        self.wordwise = self._wordwise()
        self.merges = self._merges() if self.folds and self.wordwise else None

    @classmethod
    def of(cls, path: str) -> Encoder:
        """This process's encoder: a reused worker keeps its table from task to task."""
        if path not in _KEPT:
            _KEPT[path] = cls(path)
        return _KEPT[path]

    def _whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _wordwise(self) -> bool:
        probe = "Some words,  two spaces\nand a line\t(A tab) it's 12.5 é\u00fc \u4e2d\u6587 end. "
        words = (probe.encode().lower() if self.folds else probe.encode()).split()
        return self._whole(probe) == [i for w in words for i in self._whole(w.decode())]

    def _merges(self) -> PairMerges | None:
        """The model's merges, if they give plain words the tokenizer's ids; else None."""
        form = json.loads(self.tok.to_str())
        if "ByteLevel" not in json.dumps(form.get("pre_tokenizer")):
            return None
        try:
            merges = PairMerges(form["model"])
        except ValueError:
            return None
        letters, marks = "aàbcçdeéèfghiîjklmnñoöpqrsßtuüvwxyÿzÀÉÖÞ", [chr(x) for x in np.flatnonzero(KINDS == MARK)]
        rng = Random(0)
        words = ["word", "étude", "straße", "zx" * 20, *("".join(rng.choices(letters, k=1 + i % 24)) for i in range(600))]
        words += [f"{x}{m}" for x in words[:2] for m in [*marks, *(x * 3 for x in marks), *(x + y for x in marks for y in marks)]]
        data, ends = _bytes(pa.array(words))
        plain, begin = _plain(data, ends)
        ids, n = self._together(merges, data, ends[:-1], begin, ends[1:])
        return merges if plain.all() and [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [self._whole(w) for w in words] else None

    def pack(self, ids: list[int]) -> bytes:
        """Little-endian ids in the width of the vocabulary."""
        return np.array(ids, self.kind).tobytes()

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of texts encoded one by one."""
        got = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for ids in got for i in ids], self.kind), np.array([len(ids) for ids in got], np.int64)

    @staticmethod
    def _together(merges: PairMerges, data: np.ndarray, first: np.ndarray, begin: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of plain words: letters from ``first`` to ``begin``, marks from there to ``last``."""
        two = last > begin
        ends = np.cumsum(1 + two)
        pieces, sizes = np.repeat(first, 1 + two), np.repeat(begin - first, 1 + two)
        pieces[ends[two] - 1], sizes[ends[two] - 1] = begin[two], (last - begin)[two]
        ids, n = merges.encode(LOWER[data], pieces, sizes)
        return ids, np.diff(np.concatenate([[0], np.cumsum(n)])[ends], prepend=0)

    def _learn(self, words: list[str]) -> np.ndarray:
        """Adds words to the table; returns their rows."""
        ids, n = self._each(words)
        rows = np.arange(len(self.rows), len(self.rows) + len(words))
        self.rows.update(zip(words, rows.tolist(), strict=True))
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(n)])
        self.met = np.concatenate([self.met, np.zeros(len(words), np.int64)])
        return rows

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where those of each word begin, number of ids of each)."""
        plain, ids = np.zeros(len(words), bool), np.zeros(0, self.kind)
        first, n = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        if self.merges:
            data, ends = _bytes(words)
            plain, begin = _plain(data, ends)
            ids, n[plain] = self._together(self.merges, data, ends[:-1][plain], begin[plain], ends[1:][plain])
            first[plain] = np.cumsum(n[plain]) - n[plain]
        odd = np.flatnonzero(~plain)
        if len(odd):
            strings = _strings(words.take(pa.array(odd)))
            rows = np.array([self.rows.get(w, -1) for w in strings], np.int64)
            new = np.flatnonzero(rows < 0)
            if len(new):
                rows[new] = self._learn([strings[i] for i in new.tolist()])
            self.met[rows] = self.calls
            more, at = self._fetch(rows)
            first[odd], n[odd] = len(ids) + at[:-1], np.diff(at)
            ids = np.concatenate([ids.astype(self.kind), more])
        return ids.astype(self.kind, copy=False), first, n

    def _fetch(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of rows one after the other, where each row's begin and the last's end)."""
        return _gather(self.ids, self.ends[rows], self.ends[rows + 1] - self.ends[rows])

    def _forget(self) -> None:
        """Leaves the CACHE words met last."""
        words = list(self.rows)
        keep = np.sort(np.argsort(-self.met, kind="stable")[:CACHE])
        self.rows = {words[i]: k for k, i in enumerate(keep.tolist())}
        self.ids, self.ends = self._fetch(keep)
        self.met = self.met[keep]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of texts one after the other, where each text's begin and the last's end); texts are strings or UTF-8 bytes without nulls."""
        texts = texts.cast(pa.string())
        if not self.wordwise:
            ids, n = self._each(texts.to_pylist())
            return ids, np.concatenate([[0], np.cumsum(n)])
        if len(self.rows) > 2 * CACHE:
            self._forget()
        self.calls += 1
        marked = np.zeros(len(texts), bool)
        for x in self.special:  # in any case, as folding may make a marker of what is none
            marked |= pc.match_substring(texts, x, ignore_case=self.folds).to_numpy(zero_copy_only=False)
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if self.folds else texts)
        found = split.flatten().dictionary_encode()
        ids, first, n = self._distinct(found.dictionary)
        words = found.indices.to_numpy()
        ids, at = _gather(ids, first[words], n[words])
        at = at[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])]
        if marked.any():
            parts = [self._whole(texts[i].as_py()) if m else ids[at[i] : at[i + 1]] for i, m in enumerate(marked.tolist())]
            ids = np.concatenate([np.array(x, self.kind) for x in parts])
            at = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, at

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """The packed ids of each text."""
        ids, at = self.encode(pa.array(texts, pa.binary()))
        return [ids[a:b].tobytes() for a, b in pairwise(at.tolist())]


def write_records(docs: DataFrame, tokenizer: str, end_id: int, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Encode ``docs`` in ascending order of id into shards below ``path``; returns the manifest, already written.

    Manifest: shard, file, n_docs, n_ids. A shard is one range of ids; rows
    with one id are ranged by their text too. A task writes under a name of its
    own attempt and renames at its end, so attempts never mix.
    """
    keys = [F.col("doc_id").asc_nulls_first(), F.col("x")]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"), F.xxhash64(text).alias("x"))
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "t").select("doc_id", "t")

    def run(batches):
        task = TaskContext.get()
        shard = task.partitionId()
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        name = f"shard-{shard:06d}"
        tmp = f"{root}/.{name}-{task.taskAttemptId()}"
        enc = Encoder.of(tokenizer)
        wide = np.dtype(enc.kind).itemsize
        end = enc.pack([end_id])
        n_docs = n_ids = at = 0
        index: list[tuple[int, int]] = []
        with fs.open_output_stream(f"{tmp}.rec") as data, fs.open_output_stream(f"{tmp}.idx") as idx:
            crc = 0
            for batch in batches:
                for part in slices(batch, "t", SLICE):
                    docs_ids, frames = part.column("doc_id").to_pylist(), []
                    ids, starts = enc.encode(part.column("t"))
                    for d, (a, b) in zip(docs_ids, pairwise(starts.tolist()), strict=True):
                        body = struct.pack(PAYLOAD, d is None, d or 0) + ids[a:b].tobytes() + end
                        size = struct.pack("<Q", len(body))
                        frames += [size, struct.pack(FOOT, masked(size)), body, struct.pack(FOOT, masked(body))]
                        n = b - a + 1
                        index.append((at, n))
                        at += len(body) + HEAD_SIZE + FOOT_SIZE
                        n_ids += n
                    data.write(b"".join(frames))
                    n_docs += len(docs_ids)
                    raw = np.array(index, dtype=INDEX).tobytes()
                    crc = zlib.crc32(raw, crc)
                    idx.write(raw)
                    index.clear()
            idx.write(struct.pack(FOOT, (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF))
        if not n_docs:
            for ext in ("rec", "idx"):
                fs.delete_file(f"{tmp}.{ext}")
            return
        for ext in ("rec", "idx"):
            fs.move(f"{tmp}.{ext}", f"{root}/{name}.{ext}")
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [f"{path}/{name}"], "width": pa.array([wide], pa.int32()), "n_docs": [n_docs], "n_ids": [n_ids]})

    return materialize(ranged.mapInArrow(run, "shard int, file string, width int, n_docs long, n_ids long"), "token-manifest")


def read_index(file: str) -> np.ndarray:
    """The offset index of one shard, its checksum checked."""
    fs, p = pafs.FileSystem.from_uri(f"{file}.idx")
    with fs.open_input_stream(p) as f:
        raw = f.read()
    if struct.unpack(FOOT, raw[-4:])[0] != masked(raw[:-4]):
        raise ValueError(f"{file}.idx: checksum")
    return np.frombuffer(raw[:-4], dtype=INDEX)


def _payload(file: str, head: bytes, body: bytes, foot: bytes) -> bytes:
    if struct.unpack(FOOT, head[8:])[0] != masked(head[:8]) or struct.unpack(FOOT, foot)[0] != masked(body):
        raise ValueError(f"{file}.rec: checksum")
    return body


def read_record(file: str, width: int, offset: int) -> tuple[int | None, np.ndarray]:
    """One record by its offset: (doc_id, token ids)."""
    fs, p = pafs.FileSystem.from_uri(f"{file}.rec")
    with fs.open_input_file(p) as f:
        head = f.read_at(HEAD_SIZE, offset)
        n = struct.unpack(HEAD, head)[0]
        rest = f.read_at(n + FOOT_SIZE, offset + HEAD_SIZE)
    body = _payload(file, head, rest[:n], rest[n:])
    null, d = struct.unpack_from(PAYLOAD, body)
    return (None if null else d), np.frombuffer(body, dtype=f"<u{width}", offset=PAYLOAD_SIZE)


def read_records(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, read back from the files; every checksum is checked."""
    w = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    bases = manifest.select("file", "width", F.coalesce(F.sum("n_ids").over(w), F.lit(0)).alias("base"))
    shards = bases.repartition(max(1, manifest.count()))

    def run(batches):
        for batch in batches:
            for s in batch.to_pylist():
                fs, p = pafs.FileSystem.from_uri(f"{s['file']}.rec")
                at, ids, starts, ns, crcs = s["base"], [], [], [], []
                counts = read_index(s["file"])["n_tokens"]
                with fs.open_input_stream(p, buffer_size=BUFFER) as f:
                    for n in counts:
                        head = f.read(HEAD_SIZE)
                        size = struct.unpack(HEAD, head)[0]
                        body = _payload(s["file"], head, f.read(size), f.read(FOOT_SIZE))
                        null, d = struct.unpack_from(PAYLOAD, body)
                        tokens = np.frombuffer(body, dtype=f"<u{s['width']}", offset=PAYLOAD_SIZE)
                        if len(tokens) != n:
                            raise ValueError(f"{s['file']}: index and records differ")
                        ids.append(None if null else d)
                        starts.append(at)
                        ns.append(len(tokens))
                        crcs.append(zlib.crc32(tokens.astype("<u4").tobytes()))
                        at += len(tokens)
                        if len(ids) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, ns, crcs)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                            ids, starts, ns, crcs = [], [], [], []
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, ns, crcs)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Write ``docs`` as token records and read them back; returns (manifest, records read).

    Null and empty texts become the end id alone; null ids come first; rows
    that share an id keep all their records, ordered by a hash of the text and
    then the text; an empty table writes no shard and returns no rows. Shards
    need a store that pyarrow's file systems reach (local or shared folders,
    HDFS, S3), by default the shared folder of the session.
    """
    spark: SparkSession = docs.sparkSession
    manifest = write_records(docs, tokenizer, end_id, path or scratch_path(spark, "tokens"), text, doc_id)
    return manifest, read_records(manifest)
