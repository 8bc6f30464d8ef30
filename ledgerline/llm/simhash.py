"""SimHash near-dedup by a self-join of binary tries, and groups by exact similarity of shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import connected_components, materialize, private, spread

#: Node pairs that one step of the traversal holds at most.
FRONTIER = 1 << 20
#: A block's group above this many fingerprints is dealt out anew by a second block.
GROUP = 50_000
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def fingerprints_of(text: bytes, shingle: int, tables: int = 1) -> np.ndarray:
    """The SimHashes of one UTF-8 text under ``tables`` hash functions, the first of them XXH64; without words all are 0."""
    words = text.lower().split()
    if not words:
        return np.zeros(tables, "<u8")
    if len(words) <= shingle:
        parts: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        parts = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
        n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(p, 42) for p in parts), dtype="<u8", count=n)
    ones = np.zeros(64 * tables, np.int64)
    step = 65_536 // tables
    for at in range(0, n, step):
        part = h[at : at + step]
        each = np.empty((len(part), tables), "<u8")
        each[:, 0] = part
        with np.errstate(over="ignore"):
            for j in range(1, tables):
                x = (each[:, j - 1] ^ (each[:, j - 1] >> np.uint64(29))) * _MIX[0]
                each[:, j] = x ^ (x >> np.uint64(32))
        ones += np.unpackbits(each.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, bitorder="little").view("<u8")


def fingerprint_of(text: bytes, shingle: int) -> int:
    """The SimHash of one UTF-8 text."""
    return int(fingerprints_of(text, shingle)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp long) for every document; null and empty texts have fingerprint 0."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            fps = np.fromiter((fingerprint_of(t.as_py() or b"", shingle) for t in texts), dtype="<u8", count=len(texts))
            yield pa.RecordBatch.from_arrays([ids, pa.array(fps.view("<i8"))], names=["doc_id", "fp"])

    rows = spread(private(docs, doc_id=doc_id, t=text)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("t").cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def trie_pairs(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int, leaves):
    """Yield arrays (i, j) of positions, i < j, of fingerprints in one group that differ in ``budget`` bits or fewer.

    ``fps`` is sorted within each group [start, end): a trie node is then a
    range. The traversal starts with each group's root paired with itself and
    goes down one bit a step with all node pairs together; pairs over the
    budget go, as do single leaves paired with themselves. A frontier that grows
    too large is halved and the halves run one after the other.
    """
    todo = [(0, starts, ends, starts, ends, np.zeros(len(starts), np.int8))]
    zeros: dict[int, np.ndarray] = {}
    while todo:
        depth, al, ah, bl, bh, err = todo.pop()
        if depth == 64:
            yield from leaves(al, ah, bl, bh)
            continue
        if len(al) > FRONTIER:
            half = len(al) // 2
            todo.append((depth, *[x[half:] for x in (al, ah, bl, bh, err)]))
            todo.append((depth, *[x[:half] for x in (al, ah, bl, bh, err)]))
            continue
        z = zeros.get(depth)
        if z is None:
            bit = (fps >> np.uint64(63 - depth)) & np.uint64(1)
            z = np.concatenate([[0], np.cumsum(bit == 0)]).astype(np.int64)
            if len(fps) < 100_000:
                zeros[depth] = z
        am, bm = al + z[ah] - z[al], bl + z[bh] - z[bl]
        own = al == bl
        parts = [
            (al, am, bl, bm, err, np.ones(len(al), bool)),
            (am, ah, bm, bh, err, np.ones(len(al), bool)),
            (al, am, bm, bh, err + 1, np.ones(len(al), bool)),
            (am, ah, bl, bm, err + 1, ~own),
        ]
        kept = []
        for pl, ph, ql, qh, e, ok in parts:
            ok = ok & (e <= budget) & (ph > pl) & (qh > ql) & ~((pl == ql) & (ph - pl == 1))
            kept.append([x[ok] for x in (pl, ph, ql, qh, e)])
        nxt = [np.concatenate(x) for x in zip(*kept, strict=True)]
        if len(nxt[0]):
            todo.append((depth + 1, *nxt))


def _leaves(al, ah, bl, bh):
    """Pairs of the leaves; equal fingerprints in one leaf are chained."""
    own = al == bl
    for k in np.flatnonzero(own & (ah - al > 1)):
        i = np.arange(al[k], ah[k] - 1)
        yield i, i + 1
    yield al[~own], bl[~own]


def _local_roots(n: int, pairs) -> np.ndarray:
    """The smallest position that each position reaches by pairs."""
    label = np.arange(n)
    for i, j in pairs:
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        while len(i):
            low = np.minimum(label[i], label[j])
            if (label[i] == low).all() and (label[j] == low).all():
                break
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return label


def _join_groups(budget: int):
    """mapInArrow over (g, fp, node) sorted by g and fp: links (src, dst) from nodes to their group's root."""

    def links(parts):
        g, fp, node = (np.concatenate(x) for x in zip(*parts, strict=True))
        cut = np.flatnonzero(np.diff(g)) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(g)]])
        many = ends - starts > 1
        if not many.any():
            return None
        root = _local_roots(len(g), trie_pairs(fp, starts[many], ends[many], budget, _leaves))
        moved = np.flatnonzero(root != np.arange(len(g)))
        return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[root[moved]])], names=["src", "dst"])

    def run(batches):
        held: list[tuple] = []  # parts of the rows since the start of the last group
        for batch in batches:
            g, fp, node = (batch.column(i).to_numpy() for i in range(3))
            if not len(g):
                continue
            last = int((g == g[-1]).argmax())  # the last group may go on
            if last or held and held[-1][0][0] != g[0]:
                if last:
                    held.append((g[:last], fp[:last].view(np.uint64), node[:last]))
                if (out := links(held)) is not None:
                    yield out
                held = []
            held.append((g[last:], fp[last:].view(np.uint64), node[last:]))
        if held and (out := links(held)) is not None:
            yield out

    return run


def _blocks(bits: int, budget: int) -> list[tuple[int, int]]:
    """(shift, width) of budget + 1 blocks over the lowest ``bits`` bits."""
    n = budget + 1
    edges = [bits * i // n for i in range(n + 1)]
    return [(edges[i], edges[i + 1] - edges[i]) for i in range(n)]


def _value(shift: int, width: int):
    return F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND(F.lit((1 << width) - 1))


def links(prints: DataFrame, budget: int = 3, group: int = GROUP) -> DataFrame:
    """(src, dst) links between nodes; their components are those of all pairs within ``budget`` bits.

    ``prints`` has t (a table's number), fp and node.
    Two fingerprints that differ in at most ``budget`` bits agree in one of
    budget + 1 blocks, so each block's value is a key that brings every such
    pair together. A key with more than ``group`` rows is dealt out by a
    second block of the bits outside the first, again without loss. The trie
    self-join runs within a key and gives links to a root, not all pairs.
    """
    carry = ["fp", "node"]
    blocks = _blocks(64, budget)
    first = prints.select("t", *carry, F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), _value(s, w).alias("v")) for i, (s, w) in enumerate(blocks)
    ])).alias("k")).select("t", *carry, F.col("k.i").alias("i"), F.col("k.v").alias("v"))
    hot = materialize(first.groupBy("t", "i", "v").agg(F.count("*").alias("n")).where(F.col("n") > group).select("t", "i", "v", F.lit(True).alias("hot")), "simhash-hot")
    if hot.isEmpty():
        keyed = first.select(F.xxhash64("t", "i", "v").alias("g"), *carry)
    else:
        per = [[] for _ in range(budget + 1)]
        for i, (s, w) in enumerate(blocks):
            spots = [*range(s), *range(s + w, 64)]  # the bits outside this block
            for m, (lo, n) in enumerate(_blocks(len(spots), budget)):
                runs: list[list[int]] = []
                for p in spots[lo : lo + n]:
                    if runs and sum(runs[-1]) == p:
                        runs[-1][1] += 1
                    else:
                        runs.append([p, 1])
                per[m].append(F.when(F.col("i") == i, F.struct(F.lit(m).alias("m"), F.xxhash64(*[_value(a, c) for a, c in runs]).alias("x"))))
        whole = F.array(F.struct(F.lit(-1).alias("m"), F.lit(0).cast("long").alias("x")))
        deal = F.explode(F.when(F.col("hot"), F.array(*[F.coalesce(*p) for p in per])).otherwise(whole))
        keyed = first.join(hot, ["t", "i", "v"], "left").select("t", "i", "v", *carry, deal.alias("d")).select(F.xxhash64("t", "i", "v", "d.m", "d.x").alias("g"), *carry)
    ready = keyed.select("g", *carry).repartition("g").sortWithinPartitions("g", F.shiftrightunsigned("fp", 1), "fp")
    return ready.mapInArrow(_join_groups(budget), "src long, dst long")


def near_dedup(docs: DataFrame, shingle: int = 3, budget: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id) for every document.

    Documents link where their fingerprints differ in at most ``budget`` bits;
    component_id is the smallest doc_id reachable by links. Null, empty and
    blank texts have fingerprint 0, which links like any other; whole texts
    count, however long; other columns can't clash; equal rows stay rows; null ids stay null and never name a component (a component
    without any id has a null component_id); an empty table gives no rows.
    """
    rows = materialize(fingerprints(docs, shingle, text, doc_id), "simhash-fp")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-nodes")
    roots = connected_components(links(nodes.select(F.lit(0).alias("t"), "fp", F.col("fp").alias("node")), budget))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rows.join(named.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def fp_hex(fp):
    """16 lower-case hex digits of a fingerprint."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


#: One text in SPARSE is looked at for common shingles: those that SEEN of them hold, the COMMON most frequent at most.
SPARSE, SEEN, COMMON = 16, 8, 1_000_000
#: Shared shingles, and the nodes whose sets are compared, are broadcast up to this many, beyond it the other side is shuffled.
BROADCAST_NODES = 500_000


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's ``shingle``-word shingles, ascending; a shorter text is one shingle."""
    words = text.lower().split()
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(w) for w in words), dtype="<u8", count=len(words)) if words else np.zeros(1, np.uint64)
    k = min(shingle, len(h))
    x = np.full(len(h) - k + 1, len(words) and k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            x = ((x ^ (x >> np.uint64(29))) * _MIX[0]) ^ h[j : j + len(x)]
        x = (x ^ (x >> np.uint64(31))) * _MIX[1]
        x ^= x >> np.uint64(32)
    return np.unique(x.view(np.int64))


def _prefix(h: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first |h| - ceil(similarity |h|) + 1 of a set, common shingles last: sets that are similar share one of them."""
    n = len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1
    late = np.isin(h, common, assume_unique=True)
    return np.concatenate([h[~late], h[late]])[:n]


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(node, h): the shingle set of each distinct text of ``rows`` (node, t)."""

    def run(batches):
        for batch in batches:
            got = [shingle_set(t.as_py() or b"", shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.int64()))], names=["node", "h"])

    return rows.select("node", "t").mapInArrow(run, "node long, h array<long>").groupBy("node").agg(F.first("h").alias("h"))


def _alike(pairs: DataFrame, rows: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The (src, dst) of ``pairs`` whose shingle sets have a Jaccard similarity of ``similarity`` or more."""
    need = materialize(pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "similar-need")
    sets = materialize(_sets(rows.join(F.broadcast(need) if need.count() <= BROADCAST_NODES else need, "node", "left_semi"), shingle), "similar-sets")
    both = pairs.join(sets.select(F.col("node").alias("src"), F.col("h").alias("a")), "src").join(sets.select(F.col("node").alias("dst"), F.col("h").alias("b")), "dst")
    told = both.select("src", "dst", (F.size("a") + F.size("b")).alias("n"), F.size(F.array_intersect("a", "b")).alias("same"))
    return materialize(told.where(F.col("same") >= F.lit(similarity) * (F.col("n") - F.col("same")) - 1e-9).select("src", "dst"), "similar-links")


def similar_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(node, d, root) for each distinct text: node is ``text_node``, d its smallest id (null: last), root names its group.

    Texts link where their sets of ``shingle``-word shingles have a Jaccard
    similarity of ``similarity`` or more, counted on the sets.
    Candidates share a shingle of their prefixes (``_prefix``), which loses no
    such pair under any order of the shingles. Shingles that a sample of the
    texts shows to be common come last in it; the sample sets nothing but that
    order. In each shingle's group, all are compared with two members first;
    then every pair that these links leave in different components is.
    Null and empty texts are one group. Whole texts count, however long; other
    columns can't clash; an empty table gives no rows. Texts are known by a
    64-bit hash: of two different ones that share it, one is taken for the other.
    """
    rows = spread(private(docs, id=doc_id, text=text)).select(text_node(F.col("text")).alias("node"), F.coalesce(F.col("id").cast("long"), F.lit((1 << 63) - 1)).alias("d"), F.col("text").cast("binary").alias("t"))
    seen = _sets(rows.where(F.pmod("node", F.lit(SPARSE)) == 0), shingle).select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= SEEN)
    top = seen.orderBy(F.desc("n"), "h").limit(COMMON).select("h").toArrow().column("h").to_numpy()
    common = docs.sparkSession.sparkContext.broadcast(np.sort(top))

    def run(batches):
        for batch in batches:
            got = [shingle_set(t.as_py() or b"", shingle) for t in batch.column(2)]
            first = [_prefix(h, common.value, similarity) for h in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(h) for h in got], pa.int32()), pa.array(first, pa.list_(pa.int64()))], names=["node", "d", "n", "prefix"])

    made = rows.mapInArrow(run, "node long, d long, n int, prefix array<long>")
    nodes = materialize(made.groupBy("node").agg(F.min("d").alias("d"), F.first("n").alias("n"), F.first("prefix").alias("prefix")), "similar-nodes")
    each = nodes.select("node", "n", F.explode("prefix").alias("h"))
    shared = materialize(each.groupBy("h").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi"), "similar-shared")
    keyed = materialize(each.join(F.broadcast(shared) if shared.count() <= BROADCAST_NODES else shared, "h"), "similar-keyed")

    def fits(a: str, b: str):
        return F.least(a, b) >= F.lit(similarity) * F.greatest(a, b) - 1e-9

    def enough(a: str, b: str):
        # what two sets share beyond their prefixes is at most what the larger holds there
        return F.col("c") + F.ceil(F.lit(similarity) * F.greatest(a, b) - 1e-9) - 1 >= F.lit(similarity / (1 + similarity)) * (F.col(a) + F.col(b)) - 1e-9

    def ordered(a: str, b: str):
        return F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")

    stars = keyed.select("node", "n", F.explode(F.array("lo", "hi")).alias("m")).where("node <> m").groupBy("node", "n", "m").agg(F.count("*").alias("c"))
    stars = stars.join(nodes.select(F.col("node").alias("m"), F.col("n").alias("mn")), "m").where(fits("n", "mn") & enough("n", "mn"))
    stars = materialize(stars.select(*ordered("node", "m")).distinct(), "similar-stars")
    near = _alike(stars, rows, similarity, shingle)
    part = F.coalesce("root", "node").alias("part")
    parted = materialize(keyed.select("h", "node", "n").join(connected_components(near), "node", "left").select("h", "node", "n", part), "similar-parts")
    sizes = parted.groupBy("h", "part").agg(F.count("*").alias("c")).groupBy("h").agg(F.max(F.struct("c", "part")).alias("big"), F.count("*").alias("parts")).where("parts > 1")
    mixed = materialize(parted.join(sizes.select("h", F.col("big.part").alias("big")), "h"), "similar-mixed")
    a = mixed.where("part <> big").select("h", F.col("node").alias("an"), F.col("n").alias("a"), F.col("part").alias("ap"))
    b = mixed.select("h", F.col("node").alias("bn"), F.col("n").alias("b"), F.col("part").alias("bp"), (F.col("part") == F.col("big")).alias("main"))
    rest = a.join(b, "h").where((F.col("ap") != F.col("bp")) & (F.col("main") | (F.col("an") < F.col("bn"))) & fits("a", "b"))
    rest = rest.groupBy("an", "bn", "a", "b").agg(F.count("*").alias("c")).where(enough("a", "b")).select(*ordered("an", "bn")).distinct()
    rest = materialize(rest.join(stars, ["src", "dst"], "left_anti"), "similar-rest")
    roots = connected_components(near.unionByName(_alike(rest, rows, similarity, shingle)))
    return nodes.select("node", "d").join(roots, "node", "left").select("node", "d", F.coalesce("root", "node").alias("root"))


def text_node(text):
    """The 64-bit name of a text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def one_of_each(docs: DataFrame, shingle: int = 2, budget: int = 3, tables: int = 16, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay when each group of near copies by SimHash keeps one: its smallest id (a null id last).

    Documents link where their fingerprints under one of ``tables`` hash
    functions differ in at most ``budget`` bits; groups are the components of
    all such links. Null, empty and blank texts have fingerprint 0, which links
    like any other. All columns stay. Equal rows are copies, so one of them
    stays; of rows with the smallest id and different texts, one stays. Whole
    texts count, however long; an empty table gives no rows. A document's
    fingerprints together go by a 64-bit hash: of two that share it, the
    documents are one group.
    """
    own = {"__none": F.col(f"`{doc_id}`").isNull(), "__d": F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(0)), "__key": F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")))}
    kinds = pa.list_(pa.int64())

    def run(batches):
        for batch in batches:
            got = [fingerprints_of(t.as_py() or b"", shingle, tables).view("<i8") for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(got, kinds)], names=["none", "d", "key", "fps"])

    rows = spread(docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))).select(*own.values(), F.col(f"`{text}`").cast("binary").alias("t"))
    made = rows.mapInArrow(run, "none boolean, d long, key binary, fps array<long>")
    nodes = materialize(made.groupBy(F.xxhash64("fps").alias("node")).agg(F.min(F.struct("none", "d", "key")).alias("w"), F.first("fps").alias("fps")), "simhash-nodes")
    roots = connected_components(links(nodes.select(F.posexplode("fps").alias("t", "fp"), "node"), budget))
    best = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("w").alias("w"))
    best = best.select(F.col("w.none").alias("__none"), F.col("w.d").alias("__d"), F.col("w.key").alias("__key"))
    return docs.withColumns(own).join(best, [*own]).dropDuplicates([*own]).select(*[f"`{c}`" for c in docs.columns])
