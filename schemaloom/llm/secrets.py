"""Secret scan with a trigram inverted index; DataFrame functions only.

Every rule is a regular expression. Its parsed form gives a Boolean trigram query:
an OR of alternatives, each an AND of trigrams that a match must contain (in lower
case). The index holds postings (trigram, key of the text) for the trigrams that
some rule asks for; intersecting the postings of an alternative gives its candidate
keys. Candidates are verified with the expression itself. Rules from which no
mandatory trigram follows scan every text.

The key of a text is a 64-bit hash: equal texts share postings, and a collision
only adds a candidate that verification rejects.

Spans count code points, the end is exclusive. Matches of one kind are leftmost
and do not overlap; a match whose value is too short is dropped after it was
consumed. Defined cases: null text is empty and has no spans; equal texts have
equal spans; spans of different kinds may overlap.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.arrow import as_text

#: Alternatives a query may have before its shortest strings are given up.
MOST_ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    #: Valid for Java, RE2 and Python alike.
    pattern: str
    #: Group whose length counts, and its least length.
    group: int = 0
    least: int = 1


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


BASE = [
    Rule("assign", "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + ")"
         r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),  # 20 characters or more: a shorter run has no longer run inside
    Rule("hex", "[0-9a-f]{24,}"),
]
MORE = [
    Rule("pem", "-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("login", "[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._~%-]{1,80}:[A-Za-z0-9._~%!$&*+=-]{3,80}@"),
]
RULES = BASE + MORE


# --- trigram queries ------------------------------------------------------------
Query = list[frozenset[str]]  # OR of ANDs; an empty alternative is always true


def _trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i:i + 3] for i in range(len(s) - 2))


def _both(a: Query, b: Query) -> Query:
    """AND of two queries; the less selective one is given up if the product is too large."""
    if len(a) * len(b) > MOST_ALTERNATIVES:
        return max(a, b, key=lambda q: min(map(len, q)))
    return list({x | y for x in a for y in b})


def _strings(op, value) -> set[str] | None:
    """All strings that a parsed item matches, in lower case, if they are few."""
    name = str(op)
    if name == "LITERAL":
        return {chr(value).lower()}
    if name == "IN":
        if all(str(o) == "LITERAL" for o, _ in value):
            return {chr(v).lower() for _, v in value}
        return None
    if name == "SUBPATTERN":
        return _sequence_strings(value[-1])
    if name == "BRANCH":
        parts = [_sequence_strings(p) for p in value[1]]
        return set().union(*parts) if all(p is not None for p in parts) else None
    if name in ("MAX_REPEAT", "MIN_REPEAT"):
        low, high, inner = value
        one = _sequence_strings(inner)
        if one is None or high > 4 or len(one) ** high > MOST_ALTERNATIVES:
            return None
        return {"".join(p) for n in range(low, high + 1) for p in itertools.product(one, repeat=n)}
    return None


def _sequence_strings(items) -> set[str] | None:
    out = {""}
    for op, value in items:
        more = _strings(op, value)
        if more is None or len(out) * len(more) > MOST_ALTERNATIVES:
            return None
        out = {a + b for a in out for b in more}
    return out


def _sequence_query(items) -> Query:
    found: Query = [frozenset()]
    exact = {""}

    def close():
        nonlocal found, exact
        found, exact = _both(found, list({_trigrams(s) for s in exact})), {""}

    for op, value in items:
        more = _strings(op, value)
        if more is not None and len(exact) * len(more) <= MOST_ALTERNATIVES:
            exact = {a + b for a in exact for b in more}
            continue
        close()
        name = str(op)
        if more is not None:
            exact = more
        elif name == "SUBPATTERN":
            found = _both(found, _sequence_query(value[-1]))
        elif name == "BRANCH":
            found = _both(found, [alt for part in value[1] for alt in _sequence_query(part)])
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
            found = _both(found, _sequence_query(value[2]))
    close()
    return found


def trigram_query(pattern: str) -> Query:
    """OR of trigram sets of which one is in every match; empty if the rule must scan fully."""
    query = _sequence_query(re._parser.parse(pattern))
    if not all(query):
        return []
    return [q for q in query if not any(other < q for other in query)]


# --- index and candidates -------------------------------------------------------
def text_key(text: str = "text") -> Column:
    return F.xxhash64(F.col(text))


def postings(docs: DataFrame, trigrams: list[str], text: str = "text") -> DataFrame:
    """(trigram, key) of every wanted trigram of every text, in lower case."""
    low = F.lower(F.col(text))
    there = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams]))
    return docs.select(text_key(text).alias("key"), F.explode(there).alias("trigram")).distinct()


def candidates(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """(key, kinds): texts whose postings satisfy the query of a rule that has one."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    wanted = sorted({t for q in queries.values() for alt in q for t in alt})
    if not wanted:
        return docs.sparkSession.createDataFrame([], "key long, kinds array<string>")
    per_key = postings(docs, wanted, text).groupBy("key").agg(F.collect_set("trigram").alias("there"))  # at most the wanted ones

    def holds(alternative):
        ts = sorted(alternative)
        return F.size(F.array_intersect("there", F.array(*map(F.lit, ts)))) == len(ts)

    def satisfied(query):
        found = holds(query[0])
        for alternative in query[1:]:
            found |= holds(alternative)
        return found

    kinds = F.array_compact(F.array(*[F.when(satisfied(q), F.lit(k)) for k, q in queries.items()]))
    return per_key.select("key", kinds.alias("kinds")).where(F.size("kinds") > 0)


# --- spans ----------------------------------------------------------------------
SPAN = "struct<start:int,rank:int,kind:string,end:int>"


def spans_of(rule: Rule, rank: int, text: Column) -> Column:
    """Spans of one rule in a text, in order."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    gaps = F.split(text, rule.pattern, -1)
    rows = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(whole, F.length).alias("size"), F.transform(value, F.length).alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("spans"))

    def step(acc, row):
        begin = acc["at"] + row["gap"]
        end = begin + F.coalesce(row["size"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(row["value"] >= rule.least, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    none = F.expr(f"cast(array() as array<{SPAN}>)")
    return F.when(F.size(whole) > 0, F.aggregate(rows, start, step, lambda acc: acc["spans"])).otherwise(none)


def scan(docs: DataFrame, text: str = "text", spans: str = "spans", rules: list[Rule] = RULES) -> DataFrame:
    """Append the spans of all rules, ordered by start and then by rule.

    ``array<struct<start, rank, kind, end>>``; rank is the rule's position.
    """
    docs = as_text(docs, text)
    columns = [c for c in docs.columns if c != spans]
    searched = {r.kind for r in rules if trigram_query(r.pattern)}
    found = candidates(docs.select(text), rules, text).withColumnsRenamed({"key": "__key", "kinds": "__kinds"})
    keyed = docs.withColumn("__key", text_key(text)).join(found, "__key", "left")
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    parts = []
    for rank, rule in enumerate(rules):
        one = spans_of(rule, rank, F.col(text))
        if rule.kind in searched:
            one = F.when(F.array_contains("__kinds", rule.kind), one)
        parts.append(F.coalesce(one, none))
    return keyed.select(*[F.col(f"`{c}`") for c in columns], F.array_sort(F.concat(*parts)).alias(spans))


def written(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """Replace every span by its kind in brackets; overlapping spans become one. Null texts stay null."""
    found = scan(docs, text, "__spans", rules)
    t = F.col(text)

    def step(acc, s):
        gap = F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))))
        new = F.struct(s["end"].alias("at"), F.concat(gap, F.lit("["), s["kind"], F.lit("]")).alias("out"))
        longer = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["at"], new).otherwise(longer)

    clean = F.aggregate("__spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                        lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))
    return found.withColumn(text, F.when(F.size("__spans") > 0, clean).otherwise(t)).drop("__spans")
