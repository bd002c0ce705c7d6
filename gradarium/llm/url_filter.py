"""URL filter: host and path rules, and pattern rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from re import _parser as parser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Verdict, host, path. A rule fits its host and all subdomains if the path starts with its path.
HOST_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Names whose hosts are blocked where no host rule fits.
BLOCKED_NAMES = (
    "casino", "free-bets", "cheap-pills", "adult-videos?", "(xxx|porn)", "payday-loans?", "poker", "slots", "jackpot", "betting", "sportsbook",
    "viagra", "cialis", "replica-watches", "(escort|escorts)", "(webcam|webcams)", "nude", "warez", "(torrent|torrents)", "keygen", "cracks",
)
#: Patterns over the rest of a lower-cased url. Each needs one literal token of [a-z0-9]+.
BLOCKED_PLACES = (r"/wp-login\.php([/?#]|$)", r"/phishing/", r"/malware/", r"/doorway/[0-9]+", r"/cgi-bin/click\.cgi([/?#]|$)", r"[?&]adclick=[0-9]+", r"/xmlrpc\.php([/?#]|$)")
PATTERNS = (*[rf"//([^/?#]*[.-])?{name}([.-][^/?#]*)?([/?#:]|$)" for name in BLOCKED_NAMES], *BLOCKED_PLACES)


@dataclass(frozen=True)
class PatternRule:
    pattern: str
    clauses: tuple[frozenset[str], ...]  # of each, every url that the pattern matches holds a token


ALNUM = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Spelled-out strings that a run of a pattern may have.
SPELLINGS = 64


@dataclass(frozen=True)
class Part:
    """A piece of a pattern: the strings of letters and digits that it spells (None: it may match other things), whether
    what it matches surely begins or ends with something else than a letter or digit, whether it may match nothing, and
    clauses that hold inside of it."""

    spells: frozenset[str] | None = None
    left: bool = False
    right: bool = False
    empty: bool = False
    needs: tuple[frozenset[str], ...] = ()


BREAK, ANYTHING = Part(None, True, True, False), Part(None, False, False, True)


def _edge(parts: list[Part], side: str) -> bool:
    """Whether all that a sequence can begin (or end) with is no letter or digit; true also for what is empty."""
    for p in parts if side == "left" else parts[::-1]:
        if not getattr(p, side):
            return False
        if not p.empty:
            return True
    return True


def _members(items: list) -> tuple[set[str], bool]:
    """(letters and digits of a character class, whether it has nothing else)."""
    sure, negated = set(), False
    kinds = {"CATEGORY_DIGIT": r"\d", "CATEGORY_NOT_DIGIT": r"\D", "CATEGORY_WORD": r"\w", "CATEGORY_NOT_WORD": r"\W", "CATEGORY_SPACE": r"\s", "CATEGORY_NOT_SPACE": r"\S"}
    own = True
    for op, value in items:
        name = str(op)
        if name == "NEGATE":
            negated = True
        elif name == "CATEGORY":
            sure |= {c for c in ALNUM if re.match(kinds[str(value)], c, re.ASCII)}
            own &= str(value) == "CATEGORY_DIGIT"
        else:
            low, high = value if name == "RANGE" else (value, value)
            sure |= {c for c in ALNUM if low <= ord(c) <= high or low <= ord(c.upper()) <= high}
            own &= chr(low) in ALNUM and chr(high) in ALNUM and chr(low).isdigit() == chr(high).isdigit()
    return (set(ALNUM) - sure, False) if negated else (sure, own)


def _ways(tree) -> list[list[Part]]:
    """The sequences of parts of which each match of a parsed pattern has one: choices are multiplied out while they are few."""
    out: list[list[Part]] = [[]]
    for op, value in tree:
        name = str(op)
        if name == "LITERAL":
            c = chr(value).lower()
            new = [[Part(frozenset([c])) if c in ALNUM else BREAK]]
        elif name == "IN":
            found, own = _members(value)
            new = [[BREAK if not found else Part(frozenset(found)) if own and len(found) <= 16 else Part()]]
        elif name == "AT":
            new = [[BREAK if "NON_BOUNDARY" not in str(value) else ANYTHING]]
        elif name in ("SUBPATTERN", "ATOMIC_GROUP"):
            new = _ways(value[3] if name == "SUBPATTERN" else value)
        elif name == "BRANCH":
            new = [w for x in value[1] for w in _ways(x)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, x = value
            own = _ways(x)
            if (least, most) == (1, 1):
                new = own
            elif (least, most) == (0, 1):
                new = [[], *own]
            else:
                new = [[_summed(own, least == 0)]]
        elif name in ("ANY", "NOT_LITERAL"):
            new = [[Part()]]
        else:  # looks around, references
            new = [[ANYTHING]]
        if len(out) * len(new) > SPELLINGS:
            new = [[_summed(new, False)]]
        out = [a + b for a in out for b in new]
    return out


def _summed(ways: list[list[Part]], optional: bool) -> Part:
    """One part that stands for all ways; what each of them requires inside of itself is required of it."""
    edges = (all(_edge(w, side) for w in ways) for side in ("left", "right"))
    return Part(None, *edges, optional or any(all(p.empty for p in w) for w in ways), () if optional else tuple(_required(ways)))


def _required(ways: list[list[Part]]) -> list[frozenset[str]]:
    """Clauses that hold whichever way a match goes: those of all ways, or else the shortest of each way together."""
    each = [list(dict.fromkeys([*_clauses(w), *[c for p in w for c in p.needs]])) for w in ways]
    common = [c for c in each[0] if all(c in e for e in each)]
    if common or not all(each):
        return common
    return [frozenset().union(*[min(e, key=lambda c: (len(c), -min(map(len, c)), sorted(c))) for e in each])]


def _spelled(parts: list[Part]) -> frozenset[str] | None:
    """The strings that a sequence spells, if it spells only letters and digits, and not too many of them."""
    whole = frozenset([""])
    for p in parts:
        if p.spells is None or len(whole) * len(p.spells) > SPELLINGS:
            return None
        whole = frozenset(a + b for a in whole for b in p.spells)
    return whole


def _clauses(parts: list[Part]) -> list[frozenset[str]]:
    """Runs of spelling parts between things that cannot continue a token: each match holds one of the run's strings as a
    whole token."""
    out, k = [], 0
    while k < len(parts):
        end = k
        while end < len(parts) and parts[end].spells is not None:
            end += 1
        if end > k:
            spelled = _spelled(parts[k:end])
            sides = any(not p.empty for p in parts[:k]) and _edge(parts[:k], "right") and any(not p.empty for p in parts[end:]) and _edge(parts[end:], "left")
            if spelled and "" not in spelled and sides:
                out.append(spelled)
        k = end + 1
    return out


def pattern_rule(pattern: str) -> PatternRule:
    """The clauses of a pattern: sets of tokens of which every url that it matches holds one, whole. Literals count where
    nothing beside them can continue the token, so neither at the pattern's own ends nor beside wild cards; a choice gives
    the tokens of all its ways, something that may be left out gives none."""
    clauses = _required(_ways(parser.parse(pattern, re.ASCII)))
    if not clauses:
        raise ValueError(f"no literal token in {pattern!r}")
    return PatternRule(pattern, tuple(dict.fromkeys(clauses)))


def rarest_token_index(patterns: tuple[str, ...], frequency: dict[str, int] | None = None) -> dict[str, list[str]]:
    """token -> patterns. A rule stands under the tokens of its rarest clause, by `frequency` in urls, then by use in rules,
    then by length: a clause of one token, or of several where the pattern has a choice."""
    rules = [pattern_rule(p) for p in patterns]
    used = Counter(t for r in rules for c in r.clauses for t in c)
    index: dict[str, list[str]] = defaultdict(list)
    total = lambda count, c: sum(count.get(t, 0) for t in c)
    for r in rules:
        for t in min(r.clauses, key=lambda c: (total(frequency or {}, c), total(used, c), -min(map(len, c)), sorted(c))):
            index[t].append(r.pattern)
    return dict(index)


def token_frequency(urls: DataFrame, url: str, patterns: tuple[str, ...]) -> dict[str, int]:
    """How many times the urls hold each token that the rules use: at most one row for each such token."""
    own = sorted({t for p in patterns for c in pattern_rule(p).clauses for t in c})
    used = F.broadcast(urls.sparkSession.createDataFrame([(t,) for t in own], "t string"))  # as large as the rules
    found = urls.select(F.explode(F.array_distinct(F.split(F.lower(F.col(url)), "[^a-z0-9]+"))).alias("t"))
    return {r[0]: r[1] for r in found.join(used, "t").groupBy("t").count().collect()}


class PatternIndex:
    """token -> patterns, as a hash table: each token of a url fetches what stands under it, and only that runs."""

    def __init__(self, index: dict[str, list[str]]):
        self.index, self.compiled, self.ran = index, {}, 0

    def blocks(self, url: str) -> bool:
        met = set()
        for token in re.findall("[a-z0-9]+", url):
            for pattern in self.index.get(token, ()):
                if pattern not in met:
                    met.add(pattern)
                    self.ran += 1
                    search = self.compiled.get(pattern)
                    if search is None:
                        search = self.compiled[pattern] = re.compile(pattern, re.ASCII).search
                    if search(url):
                        return True
        return False


def _upper_a_to_z(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def filter_urls(pages: DataFrame, url: str = "url", rules=HOST_RULES, patterns: tuple[str, ...] = PATTERNS) -> DataFrame:
    """pages with host, path, rule and verdict; columns of pages with these names are replaced.

    The longest fitting host rule (host and path together) decides. Where none fits, the tokens of the url fetch
    the patterns that stand under one of them in a hash table, and only those run: block if one matches, else allow.
    The table is as large as the rules, not the pages; only urls without a host rule go to Python, no other column.
    A null url, or one without ://, has an empty host and path and no rule; patterns are still asked. Every row is
    judged by itself, so repeated rows agree; urls of any length are read whole. No rows give no rows.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    whole = F.coalesce(F.col(url), F.lit(""))
    held = pages.sparkSession.sparkContext.broadcast(rarest_token_index(tuple(patterns), token_frequency(pages, url, tuple(patterns))))

    @F.pandas_udf("boolean")
    def hit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = PatternIndex(held.value)
        for urls in batches:
            yield urls.map(lambda u: u is not None and index.blocks(u)).astype(bool)

    rest = F.when(F.instr(whole, "://") > 0, F.expr("substr(__url, instr(__url, '://') + 3)")).otherwise(F.lit(""))
    rows = pages.withColumn("__url", whole).withColumn("__rest", rest)
    rows = rows.withColumns({"host": _upper_a_to_z(F.regexp_extract("__rest", r"^[^/?#]*", 0)), "path": F.regexp_extract("__rest", r"^[^/?#]*([^?#]*)", 1)})
    fits = {f"{h}{p}": (v, ((F.col("host") == h) | F.endswith("host", F.lit(f".{h}"))) & F.startswith("path", F.lit(p))) for v, h, p in rules}
    longest = sorted(fits, key=lambda r: (-len(r), r))
    rows = rows.withColumn("rule", F.coalesce(*[F.when(fits[r][1], F.lit(r)) for r in longest], F.lit(None).cast("string")))
    ruled = F.coalesce(*[F.when(F.col("rule") == r, F.lit(fits[r][0])) for r in longest], F.lit(None).cast("string"))
    verdict = F.coalesce(ruled, F.when(hit(F.when(F.col("rule").isNull(), F.lower("__url"))), "block").otherwise("allow"))
    return rows.select(*pages.columns, "host", "path", "rule", verdict.alias("verdict"))


def _sql_rules() -> str:
    longest = sorted(HOST_RULES, key=lambda r: -len(r[1] + r[2]))
    return " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in longest)


ORACLE = f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE {_sql_rules()} END AS rule FROM p)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for v, h, p in HOST_RULES)}
    WHEN {" OR ".join(f"regexp_matches(lower(url), '{p}')" for p in PATTERNS)} THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
