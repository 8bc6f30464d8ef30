"""Personal data: fixed patterns give seed entities, whose contexts become lexical patterns by bootstrapping.

A candidate is a piece of text that may be an identifier. Each candidate stands
in several contexts (patterns); patterns and the distinct strings found in them
(instances) make a graph. Spark scores it in rounds: a pattern by the share of
its instances that are believed to be of one kind, an instance by its accepted
patterns. Accepted patterns then mark the candidates that no seed explains.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize, private, slices, spread

KINDS = ("email", "ip", "card", "phone")
#: Kind of a long mixed hexadecimal string; a seed for contexts, not a base kind.
SECRET = "secret"
RANKED = (*KINDS, SECRET)
#: Distinct seeds and instances that a pattern needs, whatever the size of the table, and the least share of one kind.
SUPPORT, ACCEPT, ROUNDS = 5, 0.8, 3
#: Accepted patterns are broadcast up to this many, beyond it they are joined by a shuffle.
BROADCAST_PATTERNS = 200_000
#: Bytes of text that a task looks at together.
SLICE = 4 << 20
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\s\"'()\[\]{}<>,;|=]+")
_HEX = re.compile(r"(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]{24,}")
_DIGIT = re.compile(r"[0-9]")
_KEY = re.compile(r"([A-Za-z][\w-]*)[\"']?\s*[=:]\s*$")
_NAMED = re.compile(r"[A-Za-z][\w-]*:(?=[^/:])")
_WORTH = re.compile(r"[0-9@=:]")


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(t: str):
    """Matches of the mail pattern, found from each @ outward, so that long words cost their length once."""
    out, end, at = [], 0, t.find("@")
    while at >= 0:
        lo = at
        while lo > end and _LOCAL.match(t, lo - 1):
            lo -= 1
        m = _DOMAIN.match(t, at + 1) if lo < at else None
        end = at + 1  # no local part reaches over an @
        if m:
            out.append((lo, m.end()))
            end = m.end()
        at = t.find("@", end)
    return out


def base_spans(t: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind, then start."""
    out = [("email", a, b) for a, b in _emails(t)] if "@" in t else []
    if _DIGIT.search(t):
        out += [("ip", *m.span()) for m in _IP.finditer(t) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))]
        for m in _CARD.finditer(t):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in t:
        out += [("phone", *m.span()) for m in _PHONE.finditer(t) if 8 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15]
    return out


def _word(w: str) -> str:
    """A word as patterns hold it: lower case, digits made 9; a long one by its digest."""
    return _DIGIT.sub("9", w.lower()) if len(w) <= 64 else "#" + hashlib.md5(w.encode("utf-8", "surrogatepass")).hexdigest()


def _contexts(t: str, lo: int, hi: int, a: int, b: int, before: list[str], after: str) -> list[str]:
    """The patterns of the piece [a, b) on the line [lo, hi): two words before it, one, its key's name, the word after it, one on either side.

    ``before`` holds the last two chunks between spaces that end before the
    piece's own, ^ standing for the line's start, and ``after`` the next one, $
    standing for its end. What else the piece's own chunk holds counts as marks.
    """
    at = a
    while at > lo and not t[at - 1].isspace():
        at -= 1
    end = b
    while end < hi and not t[end].isspace():
        end += 1
    mark, close = _word(t[at:a]), _word(t[b:end])
    two, one = before
    out = [f"{one} {mark}*", f"*{close} {after}", f"{one} {mark}*{close} {after}"]
    if one != "^":
        out.append(f"{two} {one} {mark}*")
    key = _KEY.search(t, max(lo, a - 80), a) or _KEY.search(t[max(lo, a - 80) : a].rstrip("\"'"))
    if key:
        out.append(f"{_word(key[1])}=*")
    return out


def candidates(t: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, str | None, list[str]]]:
    """(start, end, kind or None, patterns) of each candidate, in order.

    Candidates are the base spans, the tokens beside them that hold a digit or
    an @, and what is named by a key (``key = value``, ``key: value``). A long
    hexadecimal token is a seed of its own kind.
    """
    if not _WORTH.search(t):
        return []
    taken = sorted((a, b, k) for k, a, b in base)
    out, at, n = [], 0, len(t)
    lo = 0
    while lo < n:
        hi = t.find("\n", lo)
        hi = n if hi < 0 else hi
        if _WORTH.search(t, lo, hi):
            found: list[tuple[int, int, str | None]] = []
            reach = lo
            for m in _TOKEN.finditer(t, lo, hi):
                a, b = m.span()
                while at < len(taken) and taken[at][0] < b:
                    found.append(taken[at])
                    reach = max(reach, taken[at][1])
                    at += 1
                if a < reach:
                    continue  # a part of a base span
                b -= len(m[0]) - len(m[0].rstrip(".:!?"))
                named = _NAMED.match(t, a, b)
                if named:
                    a = named.end()
                if a >= b:
                    continue
                if not (_DIGIT.search(t, a, b) or "@" in t[a:b]) and not (t[a - 1 : a] in "=:\"'" and _KEY.search(t[max(lo, a - 80) : a].rstrip("\"'"))) and not t[max(lo, a - 2) : a] in ("= ", ": "):
                    continue
                found.append((a, b, SECRET if _HEX.fullmatch(t, a, b) else None))
            if found:
                chunks = [m.span() for m in re.finditer(r"\S+", t[lo:hi])]
                starts = [lo + x for x, _ in chunks]
                i = 0
                for a, b, kind in sorted(set(found)):
                    while i + 1 < len(starts) and starts[i + 1] <= a:
                        i += 1
                    j = i
                    while j + 1 < len(starts) and starts[j + 1] < b:
                        j += 1
                    before = [_word(t[lo + chunks[x][0] : lo + chunks[x][1]]) if x >= 0 else "^" for x in (i - 2, i - 1)]
                    after = _word(t[lo + chunks[j + 1][0] : lo + chunks[j + 1][1]]) if j + 1 < len(chunks) else "$"
                    out.append((a, b, kind, _contexts(t, lo, hi, a, b, before, after)))
        lo = hi + 1
    return out


def _told(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def extract(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(rid, doc_id, n_email, n_ip, n_card, n_phone, base_sha256, found), one row for each document; rid names the row.

    found is an array of (kind: place in RANKED or null, a, b, x: digest of the
    lower-case string, ps: patterns): the seeds and the other candidates.
    Base spans all stand in it, as they come.
    """
    rows = spread(private(docs, doc_id=doc_id, t=text)).select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("t"), F.lit("")).alias("t"))
    one = pa.struct([("kind", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("x", pa.binary()), ("ps", pa.list_(pa.string()))])
    rank = {k: i for i, k in enumerate(RANKED)}

    def run(batches):
        for batch in batches:
            for part in slices(batch, "t", SLICE):
                counts, digests, found = [[] for _ in KINDS], [], []
                for t in part.column("t").to_pylist():
                    base = base_spans(t)
                    for n, k in zip(counts, KINDS, strict=True):
                        n.append(sum(s[0] == k for s in base))
                    digests.append(hashlib.sha256(_told(base).encode()).hexdigest())
                    got = candidates(t, base)
                    seen = {(k, a, b) for a, b, k, _ in got}
                    rows = [{"kind": rank.get(k), "a": a, "b": b, "x": hashlib.md5(t[a:b].lower().encode()).digest(), "ps": ps} for a, b, k, ps in got]
                    # base spans that no token starts
                    rows += [{"kind": rank[k], "a": a, "b": b, "x": None, "ps": []} for k, a, b in base if (k, a, b) not in seen]
                    found.append(rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("rid"), part.column("doc_id"), *[pa.array(n, pa.int64()) for n in counts], pa.array(digests), pa.array(found, pa.list_(one))],
                    names=["rid", "doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "found"])

    kind = "array<struct<kind:int,a:int,b:int,x:binary,ps:array<string>>>"
    return rows.mapInArrow(run, f"rid long, doc_id long, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, found {kind}")


def learn_patterns(extracted: DataFrame, rounds: int = ROUNDS, accept: float = ACCEPT, support: int = SUPPORT) -> DataFrame:
    """(p, kind, conf) of the contexts that hold one kind of identifier reliably; kind is a place in RANKED.

    A pattern's confidence in a kind is the mean belief that its distinct
    instances are of that kind; it is accepted at ``accept`` with ``support``
    such instances, fixed numbers at any size of the table. A seed is believed
    with 1 in its own kind alone; any other instance with 1 - product(1 - conf)
    over its accepted patterns of a kind, from the round after. Equal strings
    in one context are one instance, however often they occur.
    """
    each = extracted.select(F.explode("found").alias("f")).select("f.x", "f.kind", F.explode("f.ps").alias("p"))
    edges = materialize(each.groupBy("p", "x").agg(F.max("kind").alias("kind")), "pii-edges")
    sizes = edges.groupBy("p").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    seeds = edges.where("kind is not null").select("x", "kind").distinct().withColumn("c", F.lit(1.0))
    belief, scored = seeds, None
    for _ in range(rounds):
        told = edges.select("p", "x").join(belief, "x").groupBy("p", "kind").agg(F.sum("c").alias("c"), F.count("*").alias("k")).where(F.col("k") >= support)
        scored = materialize(told.join(sizes, "p").withColumn("conf", F.col("c") / F.col("n")).where(F.col("conf") >= accept).select("p", "kind", "conf"), "pii-patterns")
        miss = F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("conf"))))
        new = edges.where("kind is null").select("p", "x").join(scored, "p").groupBy("x", "kind").agg((1 - F.exp(miss)).alias("c"))
        belief = materialize(seeds.unionByName(new.join(seeds.select("x").distinct(), "x", "left_anti")), "pii-belief")
    return scored


def find(extracted: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, n_learned) for every document of ``extract``.

    Counts and base_sha256 are of the fixed patterns; spans lists these, the
    hexadecimal seeds, and the candidates that stand in an accepted pattern
    (of several, the most confident one names the kind; ties go to the kind
    first in RANKED, n_learned counts them), as kind:start:end, by kind, then
    start, in code points, end exclusive. Learned spans never overlap base
    ones. Null and empty texts have no spans; whole texts are searched, however
    long; repeated rows get equal answers; without patterns only seeds are
    found; other columns can't clash; an empty table gives no rows.
    """
    rows = extracted
    span = lambda kind, f: F.struct(kind.alias("k"), f["a"].alias("a"), f["b"].alias("b"))
    if patterns is None:
        rows = rows.withColumn("more", F.array().cast("array<struct<k:int,a:int,b:int>>"))
    else:
        known = F.broadcast(patterns) if patterns.count() <= BROADCAST_PATTERNS else patterns
        each = extracted.select("rid", F.explode(F.filter("found", lambda f: f["kind"].isNull())).alias("f")).select("rid", "f.a", "f.b", F.explode("f.ps").alias("p"))
        told = each.join(known, "p").groupBy("rid", "a", "b").agg(F.max_by("kind", F.struct("conf", -F.col("kind"))).alias("k"))
        rows = rows.join(told.groupBy("rid").agg(F.collect_list(F.struct("k", "a", "b")).alias("more")), "rid", "left")
    seeds = F.transform(F.filter("found", lambda f: f["kind"].isNotNull()), lambda f: span(f["kind"], f))
    spans = F.array_sort(F.concat(seeds, F.coalesce("more", F.array().cast("array<struct<k:int,a:int,b:int>>"))))
    name = F.array(*[F.lit(k) for k in RANKED])
    return rows.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", spans.alias("s"), F.greatest(F.size("more"), F.lit(0)).cast("long").alias("n_learned")).select(
        "doc_id", *[f"n_{k}" for k in KINDS], "base_sha256",
        F.array_join(F.transform("s", lambda x: F.concat_ws(":", F.get(name, x["k"]), x["a"], x["b"])), ",").alias("spans"),
        F.size("s").cast("long").alias("n_spans"), "n_learned",
    )
