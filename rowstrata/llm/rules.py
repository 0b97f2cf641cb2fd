"""Quality rules: learned decision lists over native text statistics.

``with_statistics`` computes the statistics with DataFrame functions alone.
``learn`` grows and prunes conjunctions of thresholds by sequential covering on
a bounded labelled sample; ``verdict`` turns the list into one ordered Spark
conditional. No Python runs on the executors.

Defined results: a null text has no words and fails the base rules, as does any
text under ten words; repeated rows are judged alike; labels that are null or
missing are not learned from; without both kinds of label no rule is learned
and the base rules decide; extra columns are carried through; statistics are
named with the prefix asked for, and replace columns that have such a name (an empty prefix
replaces ``n_words`` and the like).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 0.2
#: Labelled rows that are learned from, at most.
SAMPLE = 20_000
#: Fit parameters: cut points tried per statistic, conditions per rule, rules per list. They bound the conditional's length;
#: covering also ends where no rule is precise enough. At sf0.1 the list has fewer rules than the bound.
CUTS, CONDITIONS, RULES = 64, 4, 12
#: A rule must be so precise on the pruning rows, and hold for so many rows.
PRECISION, SUPPORT = 0.95, 8


def windows(hashes: Column, window: int = WINDOW) -> Column:
    """The hash of every window of an array of word hashes."""
    gram = lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(window)))
    return F.when(F.size(hashes) >= window, F.transform(F.sequence(F.lit(0), F.size(hashes) - window), gram)).otherwise(F.array().cast("array<bigint>"))


def _once(value: Column) -> Column:
    """``value``, in a projection that no filter is pushed through.

    A filter on a statistic would otherwise be rewritten in terms of the text,
    with every array expression again inside the function over its elements.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def with_statistics(docs: DataFrame, text_col: str = "text", prefix: str = "", window: int = WINDOW) -> DataFrame:
    """Add the statistics of each whole text, named ``prefix`` + name.

    Windows are compared by 64-bit hash within a text. Positions are sorted
    only for the texts in which some window repeats.
    """
    p = prefix
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    t, w, g, r = (f"__{p}{x}" for x in ("text", "words", "grams", "placed"))
    df = docs.withColumn(t, text)
    df = df.withColumn(w, F.transform(F.filter(F.split(F.col(t), common.GAP), lambda x: x != ""), lambda x: F.xxhash64(x)))
    df = df.withColumn(g, windows(F.col(w), window))
    placed = F.sort_array(F.transform(F.col(g), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn(r, F.when(F.size(F.array_distinct(F.col(g))) < F.size(g), placed))
    shared = F.transform(F.col(r), lambda x, i: F.when((x["h"] == F.get(F.col(r), i - 1)["h"]) | (x["h"] == F.get(F.col(r), i + 1)["h"]), x["i"]))
    df = df.withColumn(r, F.when(F.col(r).isNotNull(), F.sort_array(F.array_compact(shared))))
    covered = F.transform(F.col(r), lambda x, i: F.least(F.coalesce(F.get(F.col(r), i + 1) - x, F.lit(window)), F.lit(window)))
    lines = F.filter(F.split(F.col(t), "\n"), lambda x: F.length(F.translate(x, common.BLANKS, "")) > 0)
    length = F.length(t)
    df = df.withColumns(
        {
            f"{p}n_words": F.size(w).cast("long"),
            f"{p}word_chars": F.length(F.translate(F.col(t), common.BLANKS, "")).cast("long"),
            f"{p}n_symbols": (length - F.length(F.translate(F.col(t), SYMBOLS, ""))).cast("long"),
            f"{p}n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            f"{p}n_lines": F.size(lines).cast("long"),
            f"{p}n_upper": (length - F.length(F.regexp_replace(F.col(t), r"\p{Lu}+", ""))).cast("long"),
            f"{p}n_marks": (length - F.length(F.translate(F.col(t), "!?", ""))).cast("long"),
            f"{p}n_digits": (length - F.length(F.translate(F.col(t), "0123456789", ""))).cast("long"),
            f"{p}n_repeat_words": _once(F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")),
        }
    )
    return df.drop(t, w, g, r)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_upper", "n_marks", "n_digits", "n_repeat_words")
#: Ratios that rules may test: name -> (numerator, denominator).
RATIOS = {
    "symbol_share": ("n_symbols", "word_chars"), "upper_share": ("n_upper", "word_chars"), "mark_share": ("n_marks", "word_chars"), "digit_share": ("n_digits", "word_chars"),
    "repeat_share": ("n_repeat_words", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"), "word_length": ("word_chars", "n_words"), "line_words": ("n_words", "n_lines"),
}


def ratio(name: str, prefix: str = "") -> Column:
    over, under = RATIOS[name]
    return F.coalesce(F.try_divide(F.col(f"{prefix}{over}").cast("double"), F.col(f"{prefix}{under}").cast("double")), F.lit(0.0))


def base_failed(prefix: str = "", least: int = LEAST_WORDS, share: float = MOST_REPEATED) -> Column:
    return (F.col(f"{prefix}n_words") < least) | (100 * F.col(f"{prefix}n_repeat_words") > int(100 * share) * F.col(f"{prefix}n_words"))


@dataclass(frozen=True)
class Test:
    """One threshold: ``name >= cut`` if above, else ``name < cut``."""

    name: str
    above: bool
    cut: float

    def holds(self, value: float) -> bool:
        return (value >= self.cut) == self.above

    def column(self, prefix: str = "") -> Column:
        x = ratio(self.name, prefix)
        return x >= F.lit(self.cut) if self.above else x < F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<'} {self.cut:.6g}"


@dataclass(frozen=True)
class Rule:
    tests: tuple[Test, ...]
    precision: float
    support: int

    def __str__(self) -> str:
        return f"reject if {' and '.join(map(str, self.tests))} (precision {self.precision:.3f}, rows {self.support})"


Rows = list[tuple[dict[str, float], bool]]


def _cuts(values: list[float]) -> list[float]:
    """Midpoints between distinct values at evenly spaced ranks."""
    distinct = sorted(set(values))
    step = max(1, len(distinct) // CUTS)
    return [(a + b) / 2 for a, b in zip(distinct[:-1:step], distinct[1::step])]


def _grow(rows: Rows) -> list[Test]:
    """Add the test of the highest information gain until no good row is left inside."""
    tests: list[Test] = []
    while len(tests) < CONDITIONS:
        bad = sum(y for _, y in rows)
        if not bad or bad == len(rows):
            break
        now, best, gain = math.log2(bad / len(rows)), None, 1e-9
        for name in RATIOS:
            ordered = sorted((x[name], y) for x, y in rows)
            total, i, b = len(ordered), 0, 0
            for cut in _cuts([v for v, _ in ordered]):
                while i < total and ordered[i][0] < cut:
                    b, i = b + ordered[i][1], i + 1
                for above, n, k in ((False, i, b), (True, total - i, bad - b)):
                    if k and (got := k * (math.log2(k / n) - now)) > gain:
                        best, gain = Test(name, above, cut), got
        if best is None:
            break
        tests.append(best)
        rows = [r for r in rows if best.holds(r[0][best.name])]
    return tests


def _inside(tests: list[Test], rows: Rows) -> Rows:
    return [r for r in rows if all(t.holds(r[0][t.name]) for t in tests)]


def _worth(tests: list[Test], rows: Rows) -> float:
    got = _inside(tests, rows)
    bad = sum(y for _, y in got)
    return (2 * bad - len(got)) / len(got) if got else -1.0


def learn_list(rows: Rows, precision: float = PRECISION, support: int = SUPPORT) -> list[Rule]:
    """Sequential covering over (statistics, is_bad) rows: grow on two thirds, prune on the rest.

    Tests are dropped from the end of a rule while its worth on the pruning
    rows doesn't fall; a rule enters the list if it is precise on all rows that
    remain, and takes the rows it covers away.
    """
    rules: list[Rule] = []
    rest = list(rows)
    while len(rules) < RULES and any(y for _, y in rest):
        growing = [r for i, r in enumerate(rest) if i % 3 != 2]
        pruning = [r for i, r in enumerate(rest) if i % 3 == 2]
        tests = _grow(growing)
        while len(tests) > 1 and _worth(tests[:-1], pruning) >= _worth(tests, pruning):
            tests = tests[:-1]
        got = _inside(tests, rest) if tests else []
        bad = sum(y for _, y in got)
        if len(got) < support or bad < precision * len(got):
            break
        rules.append(Rule(tuple(tests), bad / len(got), len(got)))
        rest = [r for r in rest if not all(t.holds(r[0][t.name]) for t in tests)]
    return rules


def learn(docs: DataFrame, labels: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> list[Rule]:
    """The decision list for ``labels.quality = 0``, from at most ``sample`` labelled documents.

    Only those are measured, and only rows that pass the base rules count. The
    held-out third (crc32(doc_id) mod 3 = 1) is never learned from.
    """
    few = common.labelled_sample(labels.select("doc_id", "quality"), "quality", sample).withColumnRenamed("doc_id", "__id")
    wanted = docs.select("doc_id", F.col(text_col).alias("text")).join(F.broadcast(few), F.col("doc_id") == F.col("__id"))
    measured = with_statistics(wanted, "text").where(~base_failed())
    values = F.struct(*(ratio(n).alias(n) for n in RATIOS))
    # one row per id even where ids repeat, so the sample's bound holds
    rows = measured.groupBy("doc_id").agg(F.min(F.struct(values.alias("x"), F.col("quality"))).alias("r")).orderBy(F.xxhash64("doc_id"), "doc_id").select("r.x", "r.quality").collect()
    return learn_list([(r["x"].asDict(), r["quality"] == 0) for r in rows])


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """The number of the first rule that holds, from 1; 0 if none: an ordered conditional."""
    out = None
    for k, rule in enumerate(rules, 1):
        holds = rule.tests[0].column(prefix)
        for test in rule.tests[1:]:
            holds = holds & test.column(prefix)
        out = F.when(holds, k) if out is None else out.when(holds, k)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with its statistics, base_failed, rule and kept, all named with ``prefix``."""
    df = with_statistics(docs, text_col, prefix)
    df = df.withColumn(f"{prefix}base_failed", base_failed(prefix)).withColumn(f"{prefix}rule", verdict(rules, prefix))
    return df.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & (F.col(f"{prefix}rule") == 0))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the verdict of the learned list for all documents."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learn(docs, common.table(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
