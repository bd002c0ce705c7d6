"""Quality rules as a short-circuit cascade, in DataFrame operations only."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradarium.llm.common import SPACE, SPACE_CHARS, let, stored

SYMBOLS = "#*$%&|<>"
#: Documents drawn at random: on them costs and selectivities are estimated. They change the order of rules only.
SAMPLE_ROWS = 500
#: How many times each cost is measured; the median counts.
REPEATS = 2


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def removed(text: Column, chars: str) -> Column:
    """How many of these one-byte characters the text has."""
    rest = text
    for c in chars:
        rest = F.replace(rest, F.lit(c))
    return (F.octet_length(text) - F.octet_length(rest)).cast("long")


def after(array: Column, n: int) -> Column:
    """The elements from the n-th on, counted from 0."""
    return F.slice(array, F.lit(n + 1), F.size(array))


def repeated_words(w: Column) -> Column:
    """Words that lie in a window of three words which the text has twice or more. Windows are compared by a 64-bit
    hash; sorted with their positions, equal ones are neighbours, so no window is compared with all others."""
    pairs = F.zip_with(w, after(w, 1), lambda a, b: F.xxhash64(a, b))
    windows = F.slice(F.zip_with(pairs, after(w, 2), lambda a, b: F.xxhash64(a, b)), F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))

    def placed(hashes: Column) -> Column:
        return F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(s: Column) -> Column:
        equal = F.zip_with(s, after(s, 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(equal, lambda x: x.isNotNull()))))

    def covered(p: Column) -> Column:
        steps = F.zip_with(p, after(p, 1), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda n, x: n + x)

    return let(windows, lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0).cast("long")).otherwise(let(let(placed(x), twice), covered)))


def lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


class Measures:
    """Counts of a whole text, which must not be null, and of its words, split once by the caller. Each is computed
    where it is used."""

    def __init__(self, text: Column, w: Column | None = None):
        self.text, self.w = text, w

    def n_words(self) -> Column:
        return F.size(self.w).cast("long")

    def n_repeat_words(self) -> Column:
        return repeated_words(self.w)

    def word_chars(self) -> Column:
        return (F.char_length(self.text) - removed(self.text, SPACE_CHARS)).cast("long")

    def n_symbols(self) -> Column:
        return removed(self.text, SYMBOLS)

    def has_dup_lines(self) -> Column:
        """More than half of the lines with a word are equal to an earlier one."""
        return let(lines(self.text), lambda x: 2 * F.size(F.array_distinct(x)) < F.size(x))

    def n_shouts(self) -> Column:
        return (F.char_length(self.text) - F.char_length(F.replace(self.text, F.lit("!!")))).cast("long")


class Counted(Measures):
    """The same where the counts that are asked for anyway stand in columns; the others are still computed in place."""

    def __init__(self, text: Column):
        super().__init__(text)
        for name in ("n_words", "n_repeat_words", "word_chars", "n_symbols"):
            setattr(self, name, lambda name=name: F.col(f"__{name}"))

    def has_dup_lines(self) -> Column:
        return 2 * F.col("__n_dup_lines") > F.col("__n_lines")


def counted(docs: DataFrame, text: Column) -> DataFrame:
    """docs with the columns that Counted reads."""
    m = Measures(text)
    by_word = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    by_line = let(lines(text), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    rows = docs.withColumns({"__w": by_word, "__l": by_line, "__word_chars": m.word_chars(), "__n_symbols": m.n_symbols()})
    return rows.withColumns({"__n_words": F.col("__w.n_words"), "__n_repeat_words": F.col("__w.n_repeat_words"), "__n_lines": F.col("__l.n"), "__n_dup_lines": F.col("__l.dup")}).drop("__w", "__l")


@dataclass(frozen=True)
class Rule:
    """reject(measures) is true for a text to refuse."""

    name: str
    reject: Callable[[Measures], Column]


#: Fixed thresholds. The first two are the base rules.
RULES = (
    Rule("few_words", lambda m: m.n_words() < 50),
    Rule("repeated_words", lambda m: 100 * m.n_repeat_words() > 50 * m.n_words()),
    Rule("symbols", lambda m: 10 * m.n_symbols() > m.n_words()),
    Rule("duplicate_lines", lambda m: m.has_dup_lines()),
    Rule("long_words", lambda m: m.word_chars() > 12 * m.n_words()),
    Rule("short_words", lambda m: 2 * m.word_chars() < 5 * m.n_words()),
    Rule("shouts", lambda m: 3 * m.n_shouts() > 2 * m.n_words()),
)


def sampled(docs: DataFrame, text: str, sample_rows: int) -> DataFrame:
    """(t, w, and what Counted reads): whole texts and their words, a random share of all partitions of about sample_rows
    rows, stored as one part, so that a job over it is one task."""
    body = F.coalesce(F.col(text), F.lit(""))
    share = min(1.0, sample_rows / max(1, docs.count()))
    texts = docs.select(body.alias("t")).sample(False, share, seed=1).repartition(1)
    return stored(counted(texts.select("t", words(F.col("t")).alias("w")), F.col("t")), "rule_sample")


def rule_costs(sample: DataFrame, rules: tuple[Rule, ...] = RULES, measures: Measures | None = None) -> list[float]:
    """Seconds that each rule takes over the sample with the measures that the query will use: the least of REPEATS runs
    less that of a job that only reads the texts and words, after a run of each that doesn't count."""
    m = measures or Measures(F.col("t"), F.col("w"))
    read = F.sum(F.octet_length("t") + F.size("w"))
    jobs = [sample.agg(read), *[sample.agg(read, F.sum(r.reject(m).cast("int"))) for r in rules]]
    took: list[list[float]] = [[] for _ in jobs]
    for k in range(REPEATS + 1):
        for job, seconds in zip(jobs, took, strict=True):
            began = time.perf_counter()
            job.collect()  # one row
            if k:
                seconds.append(time.perf_counter() - began)
    least = [min(t) for t in took]
    return [max(t - least[0], 1e-4) for t in least[1:]]


def rule_order(rejects: dict[tuple[bool, ...], int], costs: list[float]) -> list[tuple[int, int]]:
    """(rule, texts it rejects of those that all rules before it let through): at each place the rule that rejects most
    of the survivors per second, of equal ones the cheaper. rejects: how many texts each combination of rules rejects."""
    left, order = set(range(len(costs))), []
    while left:
        hits = {k: sum(n for c, n in rejects.items() if c[k] and not any(c[j] for j, _ in order)) for k in left}
        best = min(left, key=lambda k: (-hits[k] / costs[k], costs[k], k))
        order.append((best, hits[best]))
        left.remove(best)
    return order


def ordered_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS, known: bool = False) -> list[tuple[Rule, float, int]]:
    """(rule, seconds, sampled texts rejected of those that are left) in the order of the cascade. known: the rules read
    counts that are there anyway, and are measured so."""
    sample = sampled(docs, text, sample_rows)
    m = Counted(F.col("t")) if known else Measures(F.col("t"), F.col("w"))
    counts = sample.groupBy(*[F.coalesce(r.reject(m), F.lit(False)).alias(f"r{k}") for k, r in enumerate(rules)]).count()
    rejects = {tuple(r)[:-1]: r["count"] for r in counts.collect()}  # at most a row for each combination in the sample
    costs = rule_costs(sample, rules, m)
    return [(rules[k], costs[k], hits) for k, hits in rule_order(rejects, costs)]


def rejected(order: list[tuple[Rule, float, int]], measures: Measures) -> Column:
    """Whether a rule rejects the text. The branches of a CASE run one after the other, so a rejected text meets no later
    rule. The order never decides whether a text is rejected."""
    verdict = F.when(F.lit(False), F.lit(True))
    for rule, _, _ in order:
        verdict = verdict.when(rule.reject(measures), F.lit(True))
    return verdict.otherwise(F.lit(False))


def quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept; columns of docs with
    these names are replaced.

    These counts are asked for here, so the cascade reads them where a rule needs one, and computes the others in its
    turn; keep_good() computes every count only when its rule's turn comes. A null or empty text has no words, fails
    the base rules and is not kept. Each row is judged by itself: repeated rows agree, other columns may be null, texts
    of any length are read whole. No rows give no rows.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    new = [*counts, "base_failed", "kept"]
    docs = docs.drop(*new)
    order = ordered_rules(docs, rules, text, known=True)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = counted(docs, body)
    rows = rows.withColumns({c: F.col(f"__{c}") for c in counts})
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = F.when(failed, F.lit(False)).otherwise(~rejected(order, Counted(body)))
    return rows.withColumn("base_failed", failed).withColumn("kept", kept).select(*docs.columns, *new)


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that no rule rejects, with the columns of docs; nulls, repeats and long texts as in quality(). Words are
    split once, everything else is computed only for the texts that are still left at its rule's turn."""
    body = F.coalesce(F.col(text), F.lit(""))
    order = ordered_rules(docs, rules, text)
    return docs.where(~let(words(body), lambda w: rejected(order, Measures(body, w))))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
p AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM p) WHERE n > 1),
c AS (SELECT doc_id, CAST(count(DISTINCT i + o) AS BIGINT) AS n FROM r, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
b AS (SELECT w.doc_id, w.text, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM w LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT (10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars > 12 * n_words OR 2 * word_chars < 5 * n_words
        OR 3 * (length(text) - length(replace(text, '!!', ''))) > 2 * n_words) AS kept FROM f
"""
