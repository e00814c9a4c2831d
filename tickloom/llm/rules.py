"""Quality rules: a decision list learned from labelled statistics, as ordered Spark conditions.

Statistics of whole texts are SQL expressions on each row. Sequential covering learns the
list: it grows a conjunction of thresholds that best picks out bad documents among those no
earlier rule took, prunes it on rows held back, and goes on while rules are precise. The list
becomes one chain of CASE WHEN conditions. No Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.samples import fold, labelled
from tickloom.sources.scratch import Scratch

#: Characters that part words, and those counted as symbols.
_WHITE, _SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: Labelled documents of each label that rules are learned from.
PER_LABEL = 1500
#: Rules at most, conditions in a rule at most, and thresholds tried for each statistic.
MOST_RULES, MOST_CONDITIONS, CUTS = 8, 3, 24
#: A rule must be this precise on the rows it was pruned on, and take this many.
PRECISION, SUPPORT = 0.9, 5


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def base(text: Column | str = "text") -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text; a null one is empty."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda v: F.length(F.translate(v, _WHITE, "")) > 0)
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(text, _WHITE, "")).cast("long"),
        "n_symbols": _count(text, _SYMBOLS),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": _repeated(words).cast("long"),
    }


def _repeated(words: Column, n: int = 3) -> Column:
    """Words inside windows of n words that occur twice or more among words.

    Windows are compared by 64-bit hashes. Texts whose windows all differ end there; in the
    others equal windows are neighbours after sorting, and each start in order covers n words
    or as many as lie before the next. Each array is bound once, as the variable of a lambda:
    Spark would else make it anew for each element of the next.
    """
    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))

    def starts(ordered: Column) -> Column:
        def has_twin(e: Column, i: Column) -> Column:
            same = lambda at: F.coalesce(F.get(ordered, at)["h"] == e["h"], F.lit(False))
            return same(i + 1) | same(i - 1)

        return F.array_sort(F.transform(F.filter(ordered, has_twin), lambda e: e["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(n), F.coalesce(F.get(at, k + 1) - p, F.lit(n)))), F.lit(0), lambda s, v: s + v)

    def repeated(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda v, i: F.struct(v.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_through(_through(ordered, starts), covered))

    return _through(words, lambda w: F.when(F.size(w) <= n, F.lit(0)).otherwise(_through(hashes(w), repeated)))


def _through(value: Column, use) -> Column:
    """use(value) with value computed once, as the variable of a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def statistics(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """docs' doc_id, and columns named in also, with the base statistics and the ratios that rules are made of.

    Extra columns are left out; a null or empty text has zeros; repeated rows give repeated rows.
    """
    text = F.coalesce("text", F.lit(""))
    letters = F.greatest(F.lit(1), F.length(F.translate(text, _WHITE, "")))
    more = {
        "n_upper": _count(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_marks": _count(text, "!?"),
        "n_chars": letters.cast("long"),
        "n_distinct": F.size(F.array_distinct(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))).cast("long"),
    }
    out = docs.select("doc_id", *also, *[c.alias(n) for n, c in (base() | more).items()])
    per = lambda a, b: F.col(a) / F.greatest(F.lit(1), F.col(b))
    return out.withColumns({
        "symbol_share": per("n_symbols", "n_chars"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "upper_share": per("n_upper", "n_chars"),
        "mark_share": per("n_marks", "n_chars"),
        "word_length": per("word_chars", "n_words"),
        "distinct_share": per("n_distinct", "n_words"),
        "dup_lines_share": per("n_dup_lines", "n_words"),
    })


#: Statistics that rules may test.
FEATURES = ("symbol_share", "repeat_share", "upper_share", "mark_share", "word_length", "distinct_share", "dup_lines_share", "n_words")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.cut if self.above else row[self.feature] <= self.cut

    def column(self) -> Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:g}"


def _gain(bad: int, n: int, bad_before: int, n_before: int) -> float:
    """First-order information gain of narrowing n_before rows to n, of which bad are wanted."""
    return bad * (log2(bad / n) - log2(bad_before / n_before)) if bad and bad_before else 0.0


def _cuts(feature: str, rows: list[dict]) -> list[float]:
    """Thresholds between neighbouring values, at even ranks."""
    values = sorted({r[feature] for r in rows})
    step = max(1, len(values) // CUTS)
    return [round((a + b) / 2, 6) for a, b in zip(values[:-1:step], values[1::step], strict=False)]


def _mask(rows: list[dict], holds) -> int:
    """The rows for which holds is true, as the bits of a number."""
    return int("".join("1" if holds(r) else "0" for r in reversed(rows)) or "0", 2)


def learn(rows: list[dict]) -> list[tuple[Condition, ...]]:
    """An ordered list of rules that take bad rows (label 0), from rows of statistics and label.

    Two thirds of the rows grow rules, one third prunes and judges them. A rule that is not
    precise enough on the latter ends the list; with one label only it is empty.
    """
    grow, judge = [r for i, r in enumerate(rows) if i % 3], rows[::3]
    tests = [Condition(f, above, cut) for f in FEATURES for cut in _cuts(f, grow) for above in (True, False)]
    grown = {c: _mask(grow, c.holds) for c in tests}
    judged = {c: _mask(judge, c.holds) for c in tests}
    bad_grow, bad_judge = (_mask(part, lambda r: r["label"] == 0) for part in (grow, judge))
    left, left_judge = (1 << len(grow)) - 1, (1 << len(judge)) - 1
    rules: list[tuple[Condition, ...]] = []

    def judged_by(rule: tuple[Condition, ...]) -> tuple[int, int, int]:
        taken = left_judge
        for c in rule:
            taken &= judged[c]
        return taken, taken.bit_count(), (taken & bad_judge).bit_count()

    def worth(rule: tuple[Condition, ...]) -> float:
        _, n, bad = judged_by(rule)
        return (2 * bad - n) / n if n else -1.0

    while len(rules) < MOST_RULES and left & bad_grow:
        rule: tuple[Condition, ...] = ()
        inside = left
        while len(rule) < MOST_CONDITIONS:
            n, bad = inside.bit_count(), (inside & bad_grow).bit_count()
            gains = [(_gain((inside & m & bad_grow).bit_count(), max(1, (inside & m).bit_count()), bad, n), c) for c, m in grown.items()]
            gain, best = max(gains, key=lambda g: g[0], default=(0.0, None))
            if bad == n or gain <= 1e-9:
                break
            rule, inside = (*rule, best), inside & grown[best]
        if not rule:
            break
        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda q: (round(worth(q), 9), -len(q)))
        taken, n, bad = judged_by(rule)
        if n < SUPPORT or bad < PRECISION * n:
            break
        rules.append(rule)
        left_judge &= ~taken
        inside = left
        for c in rule:
            inside &= grown[c]
        left &= ~inside
    return rules


def fit(docs: DataFrame, labels: DataFrame, label: str, per_label: int = PER_LABEL) -> list[tuple[Condition, ...]]:
    """Rules learned from labels' column label (1 good, 0 bad, by doc_id) on about per_label documents of each.

    A document labelled twice takes the lower label; null labels, null ids and null texts teach
    nothing, rows that repeat id and text teach once. Without documents of both labels there is no rule.
    """
    per = {0: per_label, 1: per_label}
    some = labelled(Scratch(docs.sparkSession), docs, labels, label, per, strict=True)
    rows = statistics(some, ("label",)).select("label", *FEATURES).collect()  # near per_label rows a label, as distinct ones are drawn
    return learn(sorted((r.asDict() for r in rows), key=lambda r: tuple(r.values())))


def verdict(rules: list[tuple[Condition, ...]]) -> Column:
    """The number of the first rule that takes a row, from 1; 0 if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, k) if out is None else out.when(test, k)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(docs: DataFrame, rules: list[tuple[Condition, ...]]) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and rule (the number of the rule that took the row, or 0).

    A null or empty text has no words, so it fails the base and is not kept; a null doc_id stays.
    Repeated rows come back as often, with the same verdict; a value equal to a rule's cut is not
    above it. Other columns of docs are left out; an empty table gives no row.
    """
    return statistics(docs).withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "rule": verdict(rules),
    }).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: verdicts on all documents, learned from the labels outside fold 1 of 3."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, fit(docs, labels.where(fold("doc_id", 3) != 1), "quality"))
