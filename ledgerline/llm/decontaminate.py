"""Benchmark decontamination by winnowing (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import lower_ascii, materialize, private, settled

#: Words before A-Z are lowered: the complement of the separators, named by what it holds, which regular expressions match far faster.
WORDS = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: Texts with candidates are found by a broadcast of up to this many 32-byte keys, beyond it by a shuffled join.
BROADCAST_KEYS = 500_000
#: Benchmark fingerprints are broadcast up to this many rows (16 bytes each), beyond it both sides are shuffled.
BROADCAST_ROWS = 200_000


def _words(text):
    found = F.coalesce(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))
    # lower() is fast, and right for words of ASCII alone
    return F.transform(found, lambda w: F.when(F.octet_length(w) == F.char_length(w), F.lower(w)).otherwise(lower_ascii(w)))


def _shape(n: int) -> tuple[int, int]:
    """(k, w): k-grams and window for which any ``n`` words in a row hold a whole window."""
    k = (n + 1) // 2
    return k, n - k + 1


def _grams(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds ``g<n>`` for each length: the hashes of all k-grams of ``words`` in the shape for n."""
    out = df.withColumn("wh", F.expr("transform(words, w -> xxhash64(w))"))
    for n in lengths:
        k, _ = _shape(n)
        args = ", ".join(f"wh[i + {j}]" for j in range(k))
        out = out.withColumn(f"g{n}", F.expr(f"if(size(wh) >= {n}, transform(sequence(0, size(wh) - {k}), i -> xxhash64({n}, {args})), cast(array() as array<bigint>))"))
    return out.drop("wh")


def _prints(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds ``sel``: the distinct fingerprints of all lengths, the least k-gram hash of each window."""
    out = _grams(df, lengths)
    for n in lengths:
        _, w = _shape(n)
        if w > 1:
            least = ", ".join(f"g{n}[i + {j}]" for j in range(w))
            out = out.withColumn(f"g{n}", F.expr(f"if(size(g{n}) >= {w}, transform(sequence(0, size(g{n}) - {w}), i -> least({least})), cast(array() as array<bigint>))"))
    every = F.col(f"g{lengths[0]}") if len(lengths) == 1 else F.concat(*[F.col(f"g{n}") for n in lengths])
    return out.withColumn("sel", settled(F.array_distinct(every))).drop(*[f"g{n}" for n in lengths])


def _item_windows(benchmark: DataFrame, window: int, item_text: str, item_id: str) -> tuple[DataFrame, DataFrame]:
    """(items, windows): items has iw, the distinct texts' words; windows has wid, n, win and lid, the name of its list of ids, and ids."""
    items = materialize(
        private(benchmark, id=item_id, text=item_text).select(F.col("id").cast("string").alias("id"), _words(F.col("text")).alias("iw"))
        .where("size(iw) > 0").groupBy("iw").agg(F.collect_set("id").alias("ids")), "bench-items")
    n = F.least(F.lit(window), F.size("iw"))
    each = items.select("ids", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("iw") - n + 1), lambda i: F.slice("iw", i, n)))).alias("win"))
    ids = F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids"))))
    made = each.groupBy("win").agg(ids.alias("ids")).select(F.xxhash64("win").alias("wid"), F.size("win").alias("n"), "win", F.md5(F.to_json("ids")).alias("lid"), "ids")
    return items, materialize(made, "bench-windows")


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_text: str = "text", item_id: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """(hits, sets) of ``docs`` against the items' windows.

    hits: (key, n_hit, set) for each distinct text that holds a window, key
    being ``text_key``; sets: (set, items), each set of item ids once, however
    many texts have it. See ``decontaminate`` for their meaning.

    Winnowing finds the texts: with k-grams and windows shaped for a length,
    every shared run of that many words shares a fingerprint. In these texts a
    fingerprint's place gives the few windows that hold it, and these are
    compared with the distinct windows of all items, word by word, so that
    neither hash collisions nor items that share a passage multiply anything.
    """
    items, windows = _item_windows(benchmark, window, item_text, item_id)
    lengths = [r[0] for r in windows.select("n").distinct().orderBy("n").collect()]
    base = private(docs, t=text).select(text_key(F.col("t")).alias("key"), "t")
    if not lengths:
        return base.where("false").select("key", F.lit(0).cast("long").alias("n_hit"), F.lit("").alias("set")), base.where("false").select(F.lit("").alias("set"), F.array().cast("array<string>").alias("items"))
    known = windows.groupBy("n", "win").agg(F.first("wid").alias("wid")).select(F.col("win").alias("words"), "n")
    prints = _prints(known, lengths).select(F.explode("sel").alias("h")).distinct()
    prints = materialize(prints, "bench-prints")
    sides = F.broadcast(prints) if prints.count() <= BROADCAST_ROWS else prints
    exploded = _prints(base.select("key", _words(F.col("t")).alias("words")), lengths).select("key", F.explode("sel").alias("h"))
    keys = materialize(exploded.join(sides, "h", "left_semi").select("key").distinct(), "bench-keys")
    some = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    texts = materialize(base.join(some, "key", "left_semi").groupBy("key").agg(F.first("t").alias("t")), "bench-texts").select("key", _words(F.col("t")).alias("words"))
    grams = F.concat(*[F.expr(f"transform(g{n}, (h, j) -> named_struct('n', {n}, 'j', j, 'h', h))") for n in lengths])
    placed = _grams(texts, lengths).select("key", F.explode(settled(grams)).alias("g")).select("key", "g.*")
    spots = placed.join(sides, "h", "left_semi").groupBy("key").agg(F.collect_list(F.struct("n", "j")).alias("spots"))
    # a k-gram at place j lies in the windows that start from j - (n - k) to j
    starts = F.expr("""array_distinct(flatten(transform(spots, x -> if(least(x.j, size(words) - x.n) < greatest(0, x.j - shiftright(x.n, 1)), array(),
        transform(sequence(greatest(0, x.j - shiftright(x.n, 1)), least(x.j, size(words) - x.n)), s -> named_struct('n', x.n, 's', s))))))""")
    around = texts.join(spots, "key").select("key", "words", settled(starts).alias("starts"))
    tried = around.select("key", F.explode(settled(F.expr("transform(starts, x -> named_struct('s', x.s, 'n', x.n, 'win', slice(words, x.s + 1, x.n)))"))).alias("x")).select("key", "x.*", F.xxhash64("x.win").alias("wid"))
    met = materialize(tried.join(windows.select("wid", "win", "lid"), ["wid", "win"]).select("key", "s", "n", "lid"), "bench-met")
    covered = F.expr("""aggregate(array_sort(collect_list(struct(s, n))), named_struct('total', 0L, 'end', 0),
        (a, x) -> named_struct('total', a.total + greatest(0, x.s + x.n - greatest(x.s, a.end)), 'end', greatest(a.end, x.s + x.n)), a -> a.total)""")
    lids = F.array_sort(F.collect_set("lid"))
    hits = materialize(met.groupBy("key").agg(covered.alias("n_hit"), lids.alias("lids")).select("key", "n_hit", F.md5(F.array_join("lids", ",")).alias("set"), "lids"), "bench-hits")
    lists = windows.groupBy("lid").agg(F.first("ids").alias("ids"))
    sets = hits.groupBy("set").agg(F.first("lids").alias("lids")).select("set", F.explode("lids").alias("lid")).join(lists, "lid").groupBy("set").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("items"))
    return hits.select("key", "n_hit", "set"), sets


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(key, n_hit, items) for each distinct text of ``docs`` that holds a benchmark window; key is ``text_key``.

    A window is ``window`` consecutive words of an item; an item with fewer
    words, but not none, is one window. n_hit counts the document's words inside
    any occurrence; items are the ids, sorted as strings, of the items that have
    an occurring window.

    Null, empty and wordless texts and items have no windows. Repeated documents
    are one text here; repeated items count once, by id; an item without id
    hits, but isn't listed. Texts and items may be of any length; other columns
    can't clash; either table may be empty.
    """
    hits, sets = find(docs, benchmark, window, text, item_text, item_id)
    return hits.join(sets, "set").select("key", "n_hit", "items")


def text_key(text):
    """The key of a text; candidates of two texts with one key are told apart by the comparison of words."""
    return F.md5(F.coalesce(text, F.lit("")))


def n_words(text):
    """Words of a text as the windows count them."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")
