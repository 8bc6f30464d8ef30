"""Quality rules: a learned decision list over document statistics (DataFrame functions only)."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import SPACE_CHARS, WORD_PATTERN, materialize, private, settled, spread

#: Labelled documents that the rules are learned from at most: those first in the order of md5(doc_id).
SAMPLE = 10_000
#: Words that mark toxic documents: the most that are taken, the toxic documents that must hold one, and their least share of those that do.
FLAGGED, FLAGGED_SUPPORT, FLAGGED_PRECISION = 1_000, 5, 0.9
SYMBOLS = "#*$%&|<>"
#: What separates words when they are looked up.
BETWEEN = SPACE_CHARS + ".,;:!?\"'()[]{}/\\_-" + SYMBOLS
#: What the rules may test, as SQL over the statistics.
FEATURES = {
    "n_words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "flagged_share": "n_flagged / greatest(n_words, 1)",
}


def _count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _plain_words(text: Column) -> Column:
    """The lower-case words of a text without punctuation, among empty strings."""
    return F.split(F.translate(F.lower(text), BETWEEN, " " * len(BETWEEN)), " ", -1)


def statistics(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), window: int = 5, flagged: tuple[str, ...] = ()) -> DataFrame:
    """The ``carry`` columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_digits, n_marks, n_flagged (words in ``flagged``).

    All within the row: no shuffle. Repeated windows are found by sorting the
    64-bit hashes of a document's windows, only where not all are distinct.
    Null and empty texts have zero everywhere.
    """
    w = window
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("__row"),
        F.regexp_extract_all(t, F.lit(WORD_PATTERN), F.lit(0)).alias("words"),
        F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0).alias("lines"),
        F.length(F.translate(t, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        _count_of(t, SYMBOLS).alias("n_symbols"),
        _count_of(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        _count_of(t, "0123456789").alias("n_digits"),
        _count_of(t, "!?").alias("n_marks"),
        (F.size(F.filter(_plain_words(t), lambda x: x.isin(*flagged))) if flagged else F.lit(0)).cast("long").alias("n_flagged"),
    )
    rest = ["__row", "word_chars", "n_symbols", "n_upper", "n_digits", "n_marks", "n_flagged"]
    hashed = base.select(
        *rest, F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("transform(words, x -> xxhash64(x))").alias("wh"),
    )
    rest += ["n_words", "n_lines", "n_dup_lines"]
    args = ", ".join(f"wh[i + {j}]" for j in range(w))
    grams = hashed.select(*rest, F.expr(f"if(size(wh) >= {w}, transform(sequence(0, size(wh) - {w}), i -> xxhash64({args})), array())").alias("g"))
    pairs = grams.select(*rest, F.expr("if(size(array_distinct(g)) < size(g), sort_array(transform(g, (x, i) -> struct(x as h, i as i))), array())").alias("s"))
    twice = pairs.select(*rest, F.expr("""sort_array(transform(
        filter(s, (x, j) -> (j > 0 and s[greatest(j - 1, 0)].h = x.h) or (j < size(s) - 1 and s[least(j + 1, size(s) - 1)].h = x.h)), x -> x.i))""").alias("p"))
    covered = F.expr(f"aggregate(transform(p, (x, j) -> if(j = size(p) - 1, {w}, least({w}, p[least(j + 1, size(p) - 1)] - x))), 0, (a, x) -> a + x)")
    return twice.select("__row.*", *rest[1:], covered.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    """The fixed rules: too few words, or over a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, is_at_least, threshold); a document that meets all is rejected."""

    tests: tuple[tuple[str, bool, float], ...]

    def sql(self) -> str:
        return " and ".join(f"({FEATURES[f]}) {'>=' if up else '<='} {x!r}D" for f, up, x in self.tests) or "true"

    def meets(self, row: dict) -> bool:
        return all(row[f] >= x if up else row[f] <= x for f, up, x in self.tests)


class Rules(list):
    """A decision list and the words that its rules count."""

    def __init__(self, rules=(), flagged: tuple[str, ...] = ()):
        super().__init__(rules)
        self.flagged = flagged


def learn_rules(rows: list[tuple[dict, bool, int]], most: int = 12, tests: int = 3, cuts: int = 24, precision: float = 0.9, support: int = 5) -> list[Rule]:
    """Sequential covering over (features, reject, split) rows: grow a conjunction by FOIL gain, prune it, keep it, drop what it covers.

    A rule is grown on two thirds of the rows and pruned from its end on the
    rest, by (p - n) / (p + n); it is kept if at least ``precision`` of what it
    covers is labelled for rejection, with ``support`` such rows. Learning
    stops at the first rule that isn't kept.
    """
    rules: list[Rule] = []
    left = rows
    for _ in range(most):
        grow = [r for r in left if r[2] % 3]
        prune = [r for r in left if not r[2] % 3]
        chosen: list[tuple[str, bool, float]] = []
        now = grow
        while len(chosen) < tests:
            p0, n0 = sum(r[1] for r in now), sum(not r[1] for r in now)
            if not p0 or not n0:
                break
            best = (0.0, None)
            for f in FEATURES:
                spread = sorted(now, key=lambda r: r[0][f])
                values = [r[0][f] for r in spread]
                above = [0]
                for r in spread:
                    above.append(above[-1] + r[1])
                marks = sorted({values[min(len(values) - 1, i * len(values) // cuts)] for i in range(1, cuts)} | {values[i] for i in range(0, len(values)) if spread[i][1]} if len(values) < 200 else {values[min(len(values) - 1, i * len(values) // cuts)] for i in range(1, cuts)} | set(sorted({r[0][f] for r in now if r[1]})[:: max(1, p0 // cuts)]))
                lo = 0
                for x in marks:
                    while lo < len(values) and values[lo] < x:
                        lo += 1
                    hi = lo
                    while hi < len(values) and values[hi] == x:
                        hi += 1
                    for up, p, n in ((True, p0 - above[lo], (len(values) - lo) - (p0 - above[lo])), (False, above[hi], hi - above[hi])):
                        if p and p + n < len(values):
                            gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                            if gain > best[0] + 1e-9:
                                best = (gain, (f, up, float(x)))
            if best[1] is None:
                break
            chosen.append(best[1])
            now = [r for r in now if Rule((best[1],)).meets(r[0])]
        if not chosen:
            break

        def worth(n_tests: int) -> float:
            rule = Rule(tuple(chosen[:n_tests]))
            met = [r[1] for r in prune if rule.meets(r[0])]
            return (2 * sum(met) - len(met)) / len(met) if met else -1.0

        size = max(range(1, len(chosen) + 1), key=lambda k: (worth(k), -k))
        rule = Rule(tuple(chosen[:size]))
        met = [r[1] for r in left if rule.meets(r[0])]
        if sum(met) < support or sum(met) < precision * len(met):
            break
        rules.append(rule)
        left = [r for r in left if not rule.meets(r[0])]
    return rules


def learn_words(rows: DataFrame, text: str = "text", toxic: str = "toxic") -> tuple[str, ...]:
    """The words that occur in toxic rows and hardly in others, most frequent first."""
    words = rows.select(F.col(toxic).alias("toxic"), F.explode(F.array_distinct(_plain_words(F.col(text)))).alias("w")).where("w <> ''")
    told = words.groupBy("w").agg(F.count_if("toxic").alias("k"), F.count("*").alias("n")).where((F.col("k") >= FLAGGED_SUPPORT) & (F.col("k") >= FLAGGED_PRECISION * F.col("n")))
    return tuple(r["w"] for r in told.orderBy(F.desc("k"), "w").limit(FLAGGED).collect())


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", quality: str = "quality", toxic: str = "toxic", sample: int = SAMPLE) -> Rules:
    """Learn the decision list from labelled documents (quality 0 or toxic 1: reject).

    At most ``sample`` labelled ids, first in the order of md5(doc_id), reach
    the driver, each with one row of statistics; of an id's texts the smallest
    counts. Rows without id or either label are left out; an id with several
    labels counts as rejected if one says so. Rows that
    the base rules fail teach as well: rules learned without them caught fewer
    held-out toxic documents. The words that mark toxic documents are learned
    from the rows that rules grow on. Extra columns don't matter; without
    labels there are no rules.
    """
    order = F.md5(F.col("id").cast("string"))
    low, harm = F.col("low") == 0, F.col("harm") == 1
    told = private(labels, id=doc_id, low=quality, harm=toxic)
    known = told.select("id", F.coalesce(low | harm, low, harm).alias("bad"), F.coalesce(harm, F.lit(False)).alias("toxic")).dropna().groupBy("id").agg(F.max("bad").alias("bad"), F.max("toxic").alias("toxic"))
    chosen = known.orderBy(order, "id").limit(sample)
    rows = private(docs, id=doc_id, text=text).join(F.broadcast(chosen), "id").groupBy("id", "bad", "toxic").agg(F.min("text").alias("text"))
    rows = materialize(rows, "quality-sample")
    flagged = learn_words(rows.where(F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 0))
    measured = statistics(rows, "text", ("id", "bad"), flagged=flagged).select("id", "bad", *[F.expr(f"double({x})").alias(k) for k, x in FEATURES.items()])
    return Rules(learn_rules([({k: r[k] for k in FEATURES}, bool(r["bad"]), zlib.crc32(str(r["id"]).encode())) for r in sorted(measured.collect(), key=lambda r: (str(r["id"]), tuple(r)))]), flagged)


def rejected(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional expression over the statistics: the number of the rule that rejects, or null."""
    out = None
    for i, r in enumerate(rules):
        out = F.when(F.expr(r.sql()), F.lit(i)) if out is None else out.when(F.expr(r.sql()), F.lit(i))
    return F.lit(None).cast("int") if out is None else out


def apply_rules(docs: DataFrame, rules: list[Rule], text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns, the statistics, base_failed, rule (int, null if none rejects) and kept.

    Null, empty and blank texts have no words and fail the base rules. Without
    labelled rows there are no rules, and the base rules alone decide. Repeated
    rows are judged alike; whole texts are judged, however long; other columns
    than ``carry`` can't clash; an empty table gives no rows.
    """
    stats = statistics(spread(docs), text, carry, flagged=getattr(rules, "flagged", ()))
    told = stats.withColumn("base_failed", base_failed()).withColumn("rule", rejected(rules))
    return told.withColumn("kept", settled(~F.col("base_failed") & F.col("rule").isNull()))
