"""The corpus operators against plain versions, on small tables with nulls, empty texts, ties, repeats and clashing columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerline.llm import decontaminate, language_id, line_dedup, lm_score, mixing, pii, quality_rules, shared_windows, simhash, suffix_dedup, token_output

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, node long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, la, s, 0, 7, 9) for i, t, la, s in rows], SCHEMA)


LONG = " ".join(f"w{i * 7919 % 1000}" for i in range(400))
ROWS = [
    (1, LONG, "en", "a"), (2, LONG, "en", "a"), (3, LONG.replace("w7 ", "x "), "en", "b"), (4, None, None, None), (5, "", "en", "a"),
    (6, "short text here", "en", "a"), (6, "short text here", "en", "a"), (None, "no id at all", "fr", None), (7, "été a@b.example.com\nA\nB\nC\nA\nB\nC", "fr", "b"),
    (8, "ip 10.0.0.1 " * 60, "de", "c"), (9, "\n \t", "de", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, ROWS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def plain_repeats(texts, n):
    """(removed bytes, spans, digest of the rest) of each text, byte by byte."""
    seen = collections.Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = set()
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone.update(range(i, i + n))
        out.append((len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(bytes(c for i, c in enumerate(t) if i not in gone)).hexdigest()))
    return out


def test_suffix_dedup(spark, docs, empty):
    rng = np.random.default_rng(9)
    passage = "".join(rng.choice(list("abcdefgh"), 260))
    more = [(100 + i, "".join(rng.choice(list("xyzuvw"), 150)) + passage[: 60 + 20 * i] + "".join(rng.choice(list("xyzuvw"), 150)), None, None) for i in range(12)]
    rows = [*ROWS, *more, (200, "ab" * 300, None, None)]
    texts = [(r[1] or "").encode() for r in rows]
    want = sorted([(r[0], len(t), *x) for r, t, x in zip(rows, texts, plain_repeats(texts, 100), strict=True)], key=str)
    for hot in (20_000, 2):
        got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(table(spark, rows), 100, hot=hot).collect()]
        assert sorted(got, key=str) == want
    assert suffix_dedup.remove_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.repeated_spans(docs, 50)


def test_suffix_dedup_over_a_very_long_text(spark):
    rng = np.random.default_rng(10)
    letters = list("abcdefghijklmnopqrstuvwxyz ")
    passage = "".join(rng.choice(letters, 500))
    at = (1 << 20) - 230  # over the edge of the pieces that anchors are found in
    long = "".join(rng.choice(letters, at)) + passage + "".join(rng.choice(letters, 90_000))
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(table(spark, [(1, long, None, None), (2, "start " + passage + " end", None, None)]), keep_text=False).collect()}
    assert got == {1: (500, 1), 2: (500, 1)}


def plain_shared(texts, n):
    """The places in each text where n words start that another of the texts holds too."""
    rows = [[tuple(w[i : i + n]) for i in range(len(w) - n + 1)] for w in ((t or "").encode().split() for t in texts)]
    holders = collections.Counter(x for r in rows for x in set(r))
    return [sum(holders[x] > 1 for x in r) for r in rows]


def test_passages_of_over_50_words_are_told_whatever_their_bytes(spark, empty, monkeypatch):
    rng = np.random.default_rng(11)

    def prose(n, size=4):
        return ["".join(rng.choice(list("abcdefghij"), rng.integers(1, size + 1))) for _ in range(n)]

    passages = [prose(n) for n in (50, 51, 52, 60, 75, 200)]
    texts = [LONG, LONG, LONG.replace("w7 ", "x "), None, "", " ", "a b c", "de " * 300, "de " * 60, "é\u00a0ü " * 55]
    for p in passages:
        assert len(" ".join(p)) < 400 or len(p) == 200
        texts += [" ".join([*prose(30), *p, *prose(40)]), "\n".join([*prose(7), *p]), " ".join(p + prose(80))]
    twice = " ".join(prose(60))
    texts += [" ".join([twice, *prose(9), twice]), " ".join(prose(400)), " ".join(passages[3]).upper()]  # none of these is shared
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    for words in (51, 5):
        got = sorted(suffix_dedup.remove_repeats(table(spark, rows), keep_text=False, words=words).collect())
        assert [r.n_shared_windows for r in got] == plain_shared(texts, words)
        if words == 51:
            assert all(r.n_removed == 0 and r.n_shared_windows > 0 for r in got[13:25])
    raw = [(t or "").encode() for t in texts]
    whole = [tuple(x.tolist() for x in part) for part in shared_windows.windows(raw, 51)]
    monkeypatch.setattr(shared_windows, "CHUNK", 70)
    parts = list(shared_windows.windows(raw, 51))
    assert len(parts) > 10 and [tuple(np.concatenate(x).tolist() for x in zip(*parts, strict=True))] == whole
    assert suffix_dedup.remove_repeats(empty, words=51).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(empty, words=-1)


def test_suffix_dedup_query_tells_short_passages(spark, tmp_path):
    from ledgerline.llm.queries import QUERIES

    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "one start " + passage, None, None), (2, passage + " another end", None, None), (3, "alone " * 70, None, None)]  # the third repeats within itself
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(QUERIES["op3_suffix_dedup"](spark, str(tmp_path)).collect())
    assert [(r.doc_id, r.n_removed, r.n_shared_windows) for r in got] == [(1, 0, 10), (2, 0, 10), (3, 420, 0)]


def test_simhash(spark, docs, empty):
    def plain(t):
        w = (t or "").encode().lower().split()
        parts = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = simhash.near_dedup(docs).collect()
    assert sorted([(r.doc_id, r.fp % (1 << 64)) for r in got], key=str) == sorted([(r[0], plain(r[1])) for r in ROWS], key=str)
    comp = {r.doc_id: r.component_id for r in got}
    assert comp[1] == comp[2] == 1 and comp[4] == comp[5] == comp[9] == 4
    assert simhash.near_dedup(empty).count() == 0


def test_trie_finds_every_pair(spark):
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    near = fps ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64))
    every = np.unique(np.concatenate([fps, near]))
    want = {(int(i), int(i + 1 + j)) for i in range(len(every)) for j in np.flatnonzero(np.bitwise_count(every[i + 1 :] ^ every[i]) <= 3)}
    got = simhash.trie_pairs(every, np.array([0]), np.array([len(every)]), 3, simhash._leaves)
    assert {(int(a), int(b)) for i, j in got for a, b in zip(np.minimum(i, j), np.maximum(i, j), strict=True)} == want
    df = spark.createDataFrame([(0, int(x.astype(np.int64)), int(x.astype(np.int64))) for x in every], "t int, fp long, node long")
    for group in (50_000, 1):  # the second deals every key out again
        links = {(r.src, r.dst) for r in simhash.links(df, 3, group).collect()}
        root = {int(x.astype(np.int64)): int(x.astype(np.int64)) for x in every}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            root[find(a)] = find(b)
        assert all(find(int(every[i].astype(np.int64))) == find(int(every[j].astype(np.int64))) for i, j in want)


def test_mixing(spark, docs, empty):
    got = mixing.mix(docs, carry=["doc_id", "source"]).select("doc_id", "source", "__mix.*").collect()
    assert len(got) == len(ROWS) and all(r.taken <= 2 * r.size for r in got)
    by = collections.defaultdict(lambda: [0, 0.0])
    for r in got:
        by[r.source][0] += r.taken
        by[r.source][1] = r.target
    assert all(abs(t - g) <= 1 for t, g in by.values())
    assert mixing.mix(empty).count() == 0


def test_quality_statistics(spark, docs, empty):
    for r in quality_rules.apply_rules(docs, [], carry=("doc_id", "text")).collect():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(cover))
        assert r.kept == (not r.base_failed)
    assert quality_rules.apply_rules(empty, []).count() == 0


def test_rules_find_a_threshold():
    rng = np.random.default_rng(1)
    rows = [({k: float(x) for k in quality_rules.FEATURES} | {"symbols_per_word": float(y)}, bool(y > 0.5), i) for i, (x, y) in enumerate(rng.random((600, 2)))]
    rules = quality_rules.learn_rules(rows)
    assert rules and sum(any(r.meets(x[0]) for r in rules) == x[1] for x in rows) > 570


def test_rules_catch_toxic_documents(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{j}" for j in rng.integers(0, 400, 60)) + (" You Idiot, moron!" if i % 5 == 0 else " you all"), "en", "a") for i in range(300)]
    docs = table(spark, rows)
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    out = quality_rules.apply_rules(docs, quality_rules.fit(docs, labels)).collect()
    assert {r.doc_id for r in out if not r.kept} == {i for i in range(300) if i % 5 == 0}


def test_rules_take_clashing_columns(spark):
    rng = np.random.default_rng(5)
    rows = [(7, i, " ".join(f"w{j}" for j in rng.integers(0, 400, 60)) + (" you idiot, moron" if i % 4 == 0 else "")) for i in range(120)]
    docs = spark.createDataFrame(rows, "id long, doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0), 3) for i in range(120)] * 2, "doc_id long, quality int, toxic int, id long")
    rules = quality_rules.fit(docs.unionByName(docs), labels)
    assert {r.doc_id for r in quality_rules.apply_rules(docs, rules).collect() if not r.kept} == set(range(0, 120, 4))


def test_quality_counts_and_verdicts(spark, docs):
    rules = quality_rules.Rules([quality_rules.Rule((("symbols_per_word", True, 0.5), ("n_words", False, 100.0))), quality_rules.Rule((("flagged_share", True, 0.01),))], ("bad",))
    rows = [(1, "#a $b <c> d|e f&g h%i j*k l m n", None, None), (2, "all good words here and there but one bad apple in all", None, None), (3, "all good words here and there with no such apple in it", None, None)]
    got = {r.doc_id: r for r in quality_rules.apply_rules(table(spark, rows), rules).collect()}
    for d, t, _, _ in rows:
        assert got[d].n_symbols == len(re.findall(r"[#*$%&|<>]", t))
    assert [(got[d].rule, got[d].kept) for d in (1, 2, 3)] == [(0, False), (1, False), (None, True)]


def test_simhash_components(spark):
    rng = np.random.default_rng(31)
    base = [int(x) for x in rng.integers(0, 1 << 62, 12)]
    fps = [b ^ (1 << int(k)) ^ (1 << int(j)) for b in base for k, j in rng.integers(0, 62, (6, 2))]
    every = sorted({f for f in fps})
    root = list(range(len(every)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(every)):
        for j in range(i):
            if (every[i] ^ every[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    want = {frozenset(every[j] for j in range(len(every)) if find(j) == find(i)) for i in range(len(every))}
    df = spark.createDataFrame([(0, f, f) for f in every], "t int, fp long, node long")
    got = collections.defaultdict(set)
    seen = {r.node: r.root for r in simhash.connected_components(simhash.links(df, 3)).collect()}
    for f in every:
        got[seen.get(f, f)].add(f)
    assert set(map(frozenset, got.values())) == want


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, " ".join(LONG.split()[50:62])), (2, "Short TEXT"), (3, None), (4, "..."), (5, "not there at all whatever")], "item_id long, text string")
    hits = {r.key: (r.n_hit, r["items"]) for r in decontaminate.decontaminate(docs, items).collect()}
    key = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert hits[key(LONG)] == (12, ["1"]) and hits[key("short text here")] == (2, ["2"])
    assert decontaminate.decontaminate(empty, items).count() == 0
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == 0


def test_decontamination_matches_plain_windows(spark):
    rng = np.random.default_rng(14)
    words = [f"v{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(words, n))
    items = [(f"i{k}", text(int(n))) for k, n in enumerate(rng.choice([1, 4, 10, 12, 29], 25))] + [("same", None), (None, "v1 v2 v3 v4"), ("x1", "v9 " * 40), ("x2", "v9 " * 12)]
    rows = []
    for d in range(60):
        t = text(int(rng.integers(0, 40)))
        if d % 3 == 0:
            own = items[int(rng.integers(0, 25))][1].split()
            a = int(rng.integers(0, len(own)))
            t += " " + " ".join(own[a : a + 14]) + " " + text(5)
        rows.append((d, t, None, None))
    rows += [(90, "v9 " * 3000, None, None), (91, "v9 " * 11, None, None)]
    want = {}
    for _, t, _, _ in rows:
        w, gone, ids = t.split(), set(), set()
        for name, x in items:
            x = (x or "").split()
            n = min(10, len(x))
            wins = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
            at = [i for i in range(len(w) - n + 1) if n and tuple(w[i : i + n]) in wins]
            gone.update(j for i in at for j in range(i, i + n))
            if at and name is not None:
                ids.add(name)
        if gone:
            want[hashlib.md5(t.encode()).hexdigest()] = (len(gone), sorted(ids))
    got = {r.key: (r.n_hit, r["items"]) for r in decontaminate.decontaminate(table(spark, rows), spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert got == want


def test_base_spans_match_the_patterns():
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    rng = np.random.default_rng(5)
    alphabet = list("a1@.-+ ()é,25") + ["10.0.0.1", "4111 1111 1111 1111", "x@y.z"]
    for _ in range(3000):
        t = "".join(rng.choice(alphabet, rng.integers(0, 14)))
        want = []
        for k, p in patterns.items():
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m[0])
                if k == "email" or k == "ip" and all(int(x) < 256 for x in m[0].split(".")) or k == "card" and 16 <= len(d) <= 19 and pii.luhn(d) or k == "phone" and 8 <= len(d) <= 15:
                    want.append((k, m.start(), m.end()))
        assert pii.base_spans(t) == want, t


def pii_spans(docs, learn=True):
    found = pii.extract(docs)
    return {r.doc_id: r for r in pii.find(found, pii.learn_patterns(found) if learn else None).collect()}


def test_pii_contexts(spark, docs, empty):
    rows = [(i, f'here token = "{hashlib.sha1(str(i).encode()).hexdigest()}" ends', "en", "a") for i in range(20)] + [(99, 'here token = "plain-key-77" ends', "en", "a")]
    got = pii_spans(table(spark, rows))
    assert got[99].spans == "secret:14:26" and got[3].spans == "secret:14:54"
    assert pii_spans(empty) == {} and pii_spans(docs)[4].spans == ""


def test_learned_patterns_find_what_no_fixed_pattern_sees(spark):
    rng = np.random.default_rng(4)
    filler = [f"word{i}" for i in range(300)]
    words = lambda n: " ".join(rng.choice(filler, n))
    rows = []
    for i in range(30):
        rows.append((i, f"{words(4)} mail: user{i}@host{i}.example.com {words(3)}", "en", "a"))
        rows.append((100 + i, f"10.1.{i}.7 logged in {words(5)}", "en", "a"))
        rows.append((200 + i, f"{words(3)} call me at +1 (555) 555-{1000 + i} {words(2)}", "en", "a"))
        rows.append((300 + i, f"{words(6)} number {i * 37} {words(4)}", "en", "a"))
    planted = {900: ("x y mail: bob@internal z", "email", "bob@internal"), 901: ("fe80::17 logged in now", "ip", "fe80::17"), 902: ("please call me at 5550199 today", "phone", "5550199"), 903: ("mail: eve(at)host", None, None)}
    rows += [(d, t, "en", "a") for d, (t, _, _) in planted.items()]
    docs = table(spark, rows)
    got, plain = pii_spans(docs), pii_spans(docs, learn=False)
    for d in (900, 901, 902):
        t, kind, x = planted[d]
        assert plain[d].spans == "" and got[d].spans == f"{kind}:{t.index(x)}:{t.index(x) + len(x)}" and got[d].n_learned == 1
    assert all(got[300 + i].spans == "" for i in range(30))
    for r in got.values():
        assert r.base_sha256 == plain[r.doc_id].base_sha256 and r.n_spans == len(list(filter(None, r.spans.split(","))))


def test_pii_counts_and_digests(spark, docs):
    text = 'x@y.example.com 10.0.0.1 4111 1111 1111 1111 +1 (555) 555-1234 "4111111111111111"'
    base = pii.base_spans(text)
    r = pii_spans(table(spark, [(1, text, None, None)]))[1]
    assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
    assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
    assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in base)
    long = "a" * 300_000 + "@" + "b" * 300_000 + " 10.0.0.1 " + "1" * 200_000
    assert pii_spans(table(spark, [(1, long, None, None)]))[1].n_ip == 1


def test_tokens_round_trip(spark, docs, empty):
    from tokenizers import Tokenizer

    from ledgerline.llm.queries import tokenizer_path

    tok = Tokenizer.from_file(tokenizer_path())
    manifest, read = token_output.token_output(docs, tokenizer_path())
    got = sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in read.collect()], key=str)
    plain = [(r[0], np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")) for r in ROWS]
    assert got == sorted([(d, len(x), zlib.crc32(x.tobytes())) for d, x in plain], key=str)
    part = manifest.first()
    at = token_output.read_index(part.file)[-1]
    assert len(token_output.read_record(part.file, part.width, int(at["offset"]))[1]) == at["n_tokens"]
    assert token_output.token_output(empty, tokenizer_path())[1].count() == 0


def test_encoders_of_other_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["Some Words,  twice\n\nNEW lines\t1.5%", "", "  é Über  \u4e2d\u6587", "it's <|endoftext|> done", "x" * 3000 + " Yes"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = str(public_tokenizers.path(name))
        tok, enc = Tokenizer.from_file(path), token_output.Encoder(path)
        assert enc([t.encode() for t in texts]) == [enc.pack(tok.encode(t, add_special_tokens=False).ids) for t in texts]


class Counted:
    """A tokenizer that counts the strings it is given."""

    def __init__(self, tok):
        self.tok, self.n = tok, 0

    def encode_batch_fast(self, texts, **how):
        self.n += len(texts)
        return self.tok.encode_batch_fast(texts, **how)

    def encode(self, text, **how):
        self.n += 1
        return self.tok.encode(text, **how)


def test_new_words_are_encoded_many_at_once():
    from tokenizers import Tokenizer

    from ledgerline.llm.queries import tokenizer_path

    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdeéüßÀX"), 7)) + rng.choice(["", ",", ".)", "***", "!?"]) for _ in range(5000)]
    texts = [" ".join(words[i : i + 50]) for i in range(0, 5000, 50)]
    tok, enc = Tokenizer.from_file(tokenizer_path()), token_output.Encoder(tokenizer_path())
    counted = {k: Counted(x) for k, x in vars(enc).items() if isinstance(x, Tokenizer)}
    vars(enc).update(counted)
    assert enc([t.encode() for t in texts]) == [enc.pack(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    assert sum(x.n for x in counted.values()) < 50


def test_plain_words_are_encoded_without_the_tokenizer():
    from tokenizers import Tokenizer

    from ledgerline.llm.queries import tokenizer_path

    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdeéüßÀXthing"), rng.integers(1, 33))) + rng.choice(["", ",", ".)", "***", "!?"]) for _ in range(3000)]
    texts = [" ".join(words[i : i + 50]) for i in range(0, 3000, 50)]
    texts += ["  " + "x" * n + "!" * m + "\n" for n in (1, 63) for m in (0, 1, 64)]
    tok, enc = Tokenizer.from_file(tokenizer_path()), token_output.Encoder(tokenizer_path())
    counted = {k: Counted(x) for k, x in vars(enc).items() if isinstance(x, Tokenizer)}
    vars(enc).update(counted)
    assert enc([t.encode() for t in texts]) == [enc.pack(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    assert sum(x.n for x in counted.values()) <= 1  # the empty word before the white space that a text begins with


def test_pair_merges_join_the_lowest_rank_first_and_the_leftmost_of_these():
    from tokenizers import Tokenizer, models

    from ledgerline.llm import pair_merges

    rng = np.random.default_rng(5)
    for end in ("", "</w>"):
        vocab = {c + e: None for e in ("", end) for c in pair_merges.byte_chars()}
        merges = []
        while len(merges) < 300:  # drawn at random, so that a string has several ways and a later merge may come before one of its parts
            a, b = (str(x) for x in rng.choice([x for x in vocab if set(x.removesuffix(end) if end else x) <= set("abc")], 2))
            if not (end and a.endswith(end)) and (a, b) not in merges and len(a + b) < 20:
                merges.append((a, b))
                vocab[a + b] = None
        rng.shuffle(merges)
        merges = [(str(a), str(b)) for a, b in merges]
        vocab = {x: i for i, x in enumerate(vocab)}
        tok = Tokenizer(models.BPE(vocab, merges, **({"end_of_word_suffix": end} if end else {})))
        words = ["".join(rng.choice(list("abc"), rng.integers(1, 65))) for _ in range(500)] + ["a" * n for n in range(1, 65)]
        size = np.array([len(w) for w in words])
        ids, n = pair_merges.PairMerges({"type": "BPE", "vocab": vocab, "merges": merges, "end_of_word_suffix": end}).encode(np.frombuffer("".join(words).encode(), np.uint8), np.cumsum(size) - size, size)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [tok.encode(w).ids for w in words]


def test_odd_texts_are_encoded_as_the_tokenizer_does(monkeypatch):
    from tokenizers import Tokenizer

    from ledgerline.llm.queries import tokenizer_path

    monkeypatch.setattr(token_output, "CACHE", 100)
    tok, enc = Tokenizer.from_file(tokenizer_path()), token_output.Encoder(tokenizer_path())
    rng = np.random.default_rng(3)
    parts = [*"abzABZéÉüßẞİıſÅÿŸ×÷Σςªº中0129.,!?;:'\"-_#*&(", "\u212a", "\u0301", "\u00a0", "\u2003", "\x1c", "\x85", "\0", "\u200b", "'s", "'T", "<|endoftext|>", "<|EndOfText|>", *" \n\t\r\x0b\x0c" * 3]
    texts = ["", " ", "<|ENDOFTEXT|>", *("".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(2000))]
    got = [x for i in range(0, len(texts), 100) for x in enc([t.encode() for t in texts[i : i + 100]])]
    assert got == [enc.pack(tok.encode(t, add_special_tokens=False).ids) for t in texts]


def test_tokens_start_where_the_ids_before_end(spark, docs):
    from ledgerline.llm.queries import tokenizer_path

    rows = sorted(token_output.token_output(docs, tokenizer_path())[1].collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r[0] for r in ROWS), key=lambda d: (d is not None, d or 0))
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows[:-1]]]).tolist()


def test_language(spark, docs, empty):
    words = {"en": "the cat sat with that thing", "fr": "le été dans une forêt où", "el": "το σπίτι είναι μεγάλο"}
    train = table(spark, [(i, words[la] * 3, la, "s") for i in range(40) for la in words])
    model = language_id.fit(train)
    asked = table(spark, [(1, words["fr"], None, None), (2, words["el"] + " the cat sat with that", "x", None), (3, None, "en", None), (4, "12 .", "en", None)])
    got = {r.doc_id: r for r in language_id.identify(asked, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["fr", "el", "und", "und"]
    assert {s.lang for s in got[2].spans} == {"el", "en"}
    assert language_id.identify(empty, language_id.fit(empty)).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, language_id.fit(empty)).collect()} == {"und"}


def test_lm_score(spark, docs, empty):
    import math

    held = F.coalesce(F.col("doc_id") % 7 == 2, F.lit(False))
    c = collections.Counter(w for r in ROWS if not (r[0] is not None and r[0] % 7 == 2) for w in lm_score.tokens_of((r[1] or "").encode()))
    n, v = sum(c.values()), len(c)
    want = sorted((str(r[0]), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in lm_score.tokens_of((r[1] or "").encode())), 6)) for r in ROWS)
    got = lm_score.score(docs, held).collect()
    assert sorted((str(r.doc_id), round(r.base_score, 6)) for r in got) == want and all(r.score < 0 and r.train_tokens == n for r in got)
    assert lm_score.score(empty, held, rounds=1).count() == 0


def test_lm_score_is_the_models_probability(spark):
    import math

    import pyarrow as pa

    rng = np.random.default_rng(21)
    words = [f"u{i}" for i in range(300)]
    p = 1 / np.arange(1, 301)
    rows = [(i, " ".join(rng.choice(words, 60, p=p / p.sum())) + " tail" + " once%d" % i, None, None) for i in range(80)]
    docs = table(spark, rows)
    held = F.col("doc_id") % 5 == 0
    base = docs.select(F.col("text").cast("binary").alias("t"), held.alias("held_out"), F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)).cast("int").alias("part"))
    model, counts = lm_score.fit(base, frequent=400, clustered=300)  # so that all three kinds of words occur
    assert {0, 1} < {0, *model.cls.tolist()} and model.weights[lm_score.NODES :].any()
    known = {np.int64(r.h).astype(np.uint64).item() if r.h >= 0 else r.h + (1 << 64): r.c for r in counts.collect()}
    spot = {int(k): i for i, k in enumerate(model.keys)}

    def name(w):
        return int(lm_score.coded_tokens(pa.array([w], pa.binary()))[0][0]) if w else int(lm_score._EMPTY)

    def softmax(node, past):
        z = model.weights[node].astype(float).copy()
        for r in model.rows(past, np.array([node]))[1:]:
            z += model.weights[r[0]]
        return np.exp(z) / np.exp(z).sum()

    def prob(h, past):
        top = softmax(0, past)
        if h not in spot:
            return top[0] * (known.get(h, 0) + 1) / model.rare_total
        i = spot[h]
        c, s, leaf = model.cls[i], model.sub[i], model.leaf[i]
        if c == 1:
            return top[1] * model.counts[i] / model.counts[model.cls == 1].sum()
        return top[c] * softmax(1 + c, past)[s] * softmax(1 + lm_score.WIDTH + c * lm_score.WIDTH + s, past)[leaf]

    def pasts(hs):
        return lm_score.history(np.array(hs, np.uint64), np.arange(len(hs)))

    # the probabilities of all words, one of them unknown, add up to one
    past = pasts([name(w) for w in lm_score.tokens_of(rows[3][1].encode())])[:, [7]]
    assert abs(sum(prob(h, past) for h in known) + prob(1, past) - 1) < 1e-4
    got = {r.doc_id: r.score for r in lm_score.score_with(docs, held, model, counts).collect()}
    for d, t, _, _ in rows[:10]:
        hs = [name(w) for w in lm_score.tokens_of(t.encode())]
        every = pasts(hs)
        want = sum(math.log10(prob(h, every[:, [i]])) for i, h in enumerate(hs))
        assert abs(want - got[d]) < 1e-3 * abs(want)


def test_word_hashes_are_of_the_bytes():
    import pyarrow as pa

    words = [b"a", b"b", b"ab", b"ba", b"aa", b"a" * 100_000, "é".encode()]
    h = lm_score.word_hashes(pa.array([b"x", *words], pa.binary()).slice(1))
    assert len(set(h.tolist())) == len(words)
    assert h.tolist() == [int(lm_score.word_hashes(pa.array([w], pa.binary()))[0]) for w in words]


def test_token_hashes_are_of_the_words():
    import pyarrow as pa

    texts = [None, b"", b" ", b"a", b" a  B\tc\n", b"x" * 100_000 + b" y", b"\n\r\x0b\x0c", "é Ünï z".encode(), b"", b"t \x00 \x1f \x85 u", b"  ", None]
    for lo, hi in ((0, 12), (3, 9), (5, 6), (10, 12), (4, 4)):
        h, n = lm_score.coded_tokens(pa.array([b"q r", *texts], pa.binary()).slice(1 + lo, hi - lo))
        words = [lm_score.tokens_of(t) for t in texts[lo:hi]]
        assert n.tolist() == [len(w) for w in words]
        assert h.tolist() == [int(lm_score.word_hashes(pa.array([x], pa.binary()))[0]) if x else int(lm_score._EMPTY) for w in words for x in w]
    keys = np.array([0, 1, 5, 1 << 63, (1 << 64) - 1], np.uint64)
    assert lm_score.Places(keys).of(np.array([5, 2, (1 << 64) - 1, 0, (1 << 63) + 1, 1 << 63], np.uint64)).tolist() == [2, -1, 4, 0, -1, 3]
    assert lm_score.Places(keys[:0]).of(keys).tolist() == [-1] * 5


def test_lm_gradient_is_the_plain_one_and_takes_less():
    """The sums by outcome over the whole table, as they once were made, are the plain version."""
    import time

    import pyarrow as pa

    rng = np.random.default_rng(7)
    words = np.array([f"u{i}" for i in range(600)])
    p = 1 / np.arange(1, 601)
    texts = pa.array([" ".join(rng.choice(words, 300, p=p / p.sum())).encode() for _ in range(60)], pa.binary())
    keys, counts = np.unique(lm_score.coded_tokens(texts)[0], return_counts=True)
    keys, counts = keys[counts > 2], counts[counts > 2]
    paths = [rng.integers(1, lm_score.WIDTH, len(keys)), rng.integers(0, lm_score.WIDTH, len(keys)), rng.integers(0, lm_score.WIDTH, len(keys))]
    m = lm_score.Model(keys, counts.astype(float), paths, 18_060, 600, 17)
    m.weights += rng.normal(size=m.weights.shape).astype(np.float32) / 10
    m.here()
    size = len(m.weights)

    def plain():
        out = np.zeros((lm_score.WIDTH, size), np.float32)
        h, n = lm_score.coded_tokens(texts)
        for sl, past in lm_score._windows(h, n, 1 << 17):
            for _, outcome, on in m.steps(m.spots(h)[sl], past):
                z = np.clip(sum(m.weights[r].astype(float) for r in on), -80, 80)
                off = -np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
                off[np.arange(len(off)), outcome] += 1
                off = np.ascontiguousarray(off.T)
                for r in on:
                    for j in range(lm_score.WIDTH):
                        out[j] += np.bincount(r, off[j], size)
        return out.T

    def new():
        out = np.zeros((size, lm_score.WIDTH))
        lm_score.add_gradient(m, texts, out)
        return out

    def least(f):
        took = []
        for _ in range(3):
            at = time.process_time()
            f()
            took.append(time.process_time() - at)
        return min(took)

    assert np.allclose(new(), plain(), rtol=1e-3, atol=1e-3) and least(new) < 0.8 * least(plain)


def test_line_dedup(spark, docs, empty):
    got = line_dedup.line_dedup(docs).collect()
    assert len(got) == len(ROWS) and line_dedup.line_dedup(empty).count() == 0
    text = "\n".join(f"line {i}" for i in range(30))
    two = {r.doc_id: r for r in line_dedup.line_dedup(table(spark, [((1 << 63) - 1, text, None, None), (2, "first\n" + text, None, None), (None, text, None, None)])).collect()}
    assert two[2].kept == "first\n" + text and two[(1 << 63) - 1].kept == "" and two[None].n_removed_lines == 30


def test_line_dedup_takes_whole_shared_runs(spark):
    rng = np.random.default_rng(12)
    line = lambda: " ".join(f"w{x}" for x in rng.integers(0, 500, 9))
    passages = [[line() for _ in range(n)] for n in (3, 3, 4, 5, 7, 12)]
    rows, shared = [], collections.Counter()
    for d in range(40):
        lines = [line() for _ in range(int(rng.integers(1, 6)))]
        for k in rng.choice(len(passages), 2, replace=False):
            lines += passages[k] + [line() for _ in range(int(rng.integers(1, 4)))]
            shared[d] += len(passages[k])
        rows.append((d, "\n".join(lines), None, None))
    got = line_dedup.line_dedup(table(spark, rows)).collect()
    assert sum(r.n_removed_lines for r in got) == sum(shared.values()) - sum(map(len, passages))
    every = {x for _, t, _, _ in rows for x in t.split("\n")}
    assert {x for r in got for x in r.kept.split("\n")} >= every  # some copy of every line stays


def test_line_dedup_is_linear_in_the_text(spark):
    text = "\n".join(f"row {i}" for i in range(120_000))
    got = {r.doc_id: r.n_removed_lines for r in line_dedup.line_dedup(table(spark, [(1, text, None, None), (2, text, None, None)])).collect()}
    assert got == {1: 0, 2: 120_000}



def test_viterbi_is_the_best_path():
    import itertools

    rng = np.random.default_rng(8)
    lengths = rng.integers(0, 6, 12)
    scores = rng.normal(size=(int(lengths.sum()), 3)) * 4
    for penalty in (0.0, 1.5, 6.0):
        path, at = language_id.viterbi(scores, lengths, penalty), 0

        def worth(own, mine, penalty=penalty):
            return sum(mine[i, x] for i, x in enumerate(own)) - penalty * sum(a != b for a, b in itertools.pairwise(own))

        for n in lengths.tolist():
            mine, own = scores[at : at + n], path[at : at + n]
            assert n == 0 or worth(own, mine) >= max(worth(x, mine) for x in itertools.product(range(3), repeat=n)) - 1e-9
            at += n


def test_language_words_are_letters():
    assert [language_id.words_of(t) for t in ("²", "½ ① Ⅷ", "12_ab3c", None, "é́", "́")] == [[], [], ["ab", "c"], [], ["é́"], []]
    hindi = "हिन्दी में"
    assert language_id.words_of(hindi) == hindi.split()
    assert [hindi[a:b] for a, b in language_id.word_spans(hindi)] == hindi.split()


def test_language_scores_match_a_plain_model(spark):
    import math

    words = {"en": "the cat sat with that thing", "fr": "le été dans une forêt où"}
    model = language_id.fit(table(spark, [(i, words[la], la, "s") for i in range(4) for la in words]))
    counts = {la: collections.Counter() for la in words}

    def grams(w):
        x = f"<{w}>"
        return [x[i : i + k] for k in (1, 2, 3) for i in range(len(x) - k + 1)] + ["whole " + w]

    for la, text in words.items():
        for w in text.split():
            for g in grams(w):
                counts[la][g] += 4
    total = {la: sum(c.values()) for la, c in counts.items()}
    for w in ("the", "cap", "forêt", "x"):
        shares = {la: [math.log((counts[la][g] + 0.5) / (total[la] + 1)) for g in grams(w)] for la in words}
        want = [sum(x) / len(x) * 2 * math.sqrt(len(w) + 1) for _, x in sorted(shares.items())]
        got = model.words([w])[0]
        assert np.allclose(got, want, atol=1e-3)


def test_language_takes_clashing_columns_and_long_texts(spark):
    words = {"en": "the cat sat with that thing ", "fr": "le été dans une forêt où "}
    rows = [(9, i, words[la] * (3000 if i == 0 else 2), la) for i in range(4) for la in words]
    docs = spark.createDataFrame(rows, "id long, doc_id long, text string, lang string")
    model = language_id.fit(docs)
    got = language_id.identify(docs, model, with_spans=False).collect()
    assert model.langs == ["en", "fr"] and sorted(r.lang_pred for r in got) == ["en"] * 4 + ["fr"] * 4
    assert language_id.training_sample(docs, "text", "lang", "doc_id", 2, 10**9).count() == 4
    assert language_id.training_sample(docs, "text", "lang", "doc_id", 4, 10).count() == 2
