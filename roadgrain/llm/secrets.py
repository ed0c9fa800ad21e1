"""Secret scans over a trigram inverted index. DataFrame functions only.

A rule's Boolean trigram query is derived from its regex: the pattern's parse
tree gives, for every part, the strings it can match where they are few, else
how it can begin and end and which trigrams it must hold; texts and queries are
in lower case. A text's postings are the vocabulary's trigrams that stand in
it. Queries intersect them in the row that holds the text, so that no text is
shuffled; candidates are verified by the regex itself. A rule whose query is
always true scans every text. ``postings`` and ``candidates`` are the same
index as a table, for texts that are searched again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Strings kept apart per part of a pattern, and characters of a class that are listed.
STRINGS, LISTED = 64, 16
#: A query in disjunctive form: sets of trigrams, of one of which a text must hold all.
Query = frozenset[frozenset[str]]
ALWAYS: Query = frozenset([frozenset()])


def _either(conjunctions: set[frozenset[str]]) -> Query:
    """The disjunction, without what a weaker member makes needless."""
    return frozenset(x for x in conjunctions if not any(y < x for y in conjunctions))


def _all(*queries: Query) -> Query:
    """The conjunction; one that would have too many members leaves out its longer queries."""
    out = ALWAYS
    for q in sorted(queries, key=len):
        if len(out) * len(q) <= STRINGS:
            out = _either({x | y for x in out for y in q})
    return out


def _holds(strings: frozenset[str]) -> Query:
    """The query that every text with one of the strings satisfies."""
    return _either({frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in strings})


@dataclass(frozen=True)
class Part:
    """What is known of a part of a pattern: all strings it matches (or None), else strings of
    which one begins each match, and one ends it, and the query that each satisfies."""

    exact: frozenset[str] | None
    begins: frozenset[str] = frozenset([""])
    ends: frozenset[str] = frozenset([""])
    query: Query = ALWAYS

    def open(self) -> Part:
        """The same without exact strings."""
        if self.exact is None:
            return self
        return Part(None, frozenset(x[:3] for x in self.exact), frozenset(x[-3:] for x in self.exact), _holds(self.exact))

    def then(self, other: Part) -> Part:
        if self.exact is not None and other.exact is not None and len(self.exact) * len(other.exact) <= STRINGS:
            return Part(frozenset(x + y for x in self.exact for y in other.exact))
        a, b = self.open(), other.open()
        few = lambda xs, ys: frozenset(x + y for x in xs for y in ys) if len(xs) * len(ys) <= STRINGS else frozenset([""])
        middle = _holds(few(self.exact if self.exact is not None else a.ends, other.exact if other.exact is not None else b.begins))
        begins = few(self.exact, b.begins) if self.exact is not None else a.begins
        ends = few(a.ends, other.exact) if other.exact is not None else b.ends
        return Part(None, frozenset(x[:3] for x in begins), frozenset(x[-3:] for x in ends), _all(a.query, middle, b.query))

    def alternatively(self, other: Part) -> Part:
        if self.exact is not None and other.exact is not None and len(self.exact | other.exact) <= STRINGS:
            return Part(self.exact | other.exact)
        a, b = self.open(), other.open()
        return Part(None, a.begins | b.begins, a.ends | b.ends, _either(a.query | b.query))


ANYTHING, NOTHING_YET = Part(None), Part(frozenset([""]))


def _part(tree) -> Part:
    """The Part of a sequence of the standard parser's (operation, argument) pairs."""
    out = NOTHING_YET
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            one = Part(frozenset([chr(arg).lower()]))
        elif name == "IN" and all(str(k) in ("LITERAL", "RANGE") for k, _ in arg):
            codes = {c for k, v in arg for c in ([v] if str(k) == "LITERAL" else range(v[0], min(v[1], v[0] + 999) + 1))}
            low = frozenset(chr(c).lower() for c in codes)
            one = Part(low) if len(low) <= LISTED else ANYTHING
        elif name == "SUBPATTERN":
            one = _part(arg[3])
        elif name == "BRANCH":
            one = reduce(Part.alternatively, [_part(x) for x in arg[1]])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, inner = arg
            piece = _part(inner)
            if most == 1:
                one = piece.alternatively(NOTHING_YET) if least == 0 else piece
            elif least == 0:
                one = ANYTHING
            else:  # once at both ends, with more of it between
                one = reduce(Part.then, [piece] * min(least, 8))
                one = one if least == most <= 8 else one.open()
        elif name == "AT":
            one = NOTHING_YET
        else:  # nothing is known of other parts
            one = ANYTHING
        out = out.then(one)
    return out


@lru_cache
def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of a regex, in lower case; ALWAYS: no trigram is mandatory."""
    return _part(re._parser.parse(pattern)).open().query


@dataclass(frozen=True)
class Rule:
    """kind: name in the results; pattern: regex (in what Java and Python share); value: group
    that must have min_chars characters; quick: a pattern that long enough matches satisfy."""

    kind: str
    pattern: str
    min_chars: int
    value: int = 0
    base: bool = False
    quick: str | None = None


#: In the order in which kinds of one start are listed.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16, 0, True, r"AKIA[A-Z0-9]{12}"),
    Rule("hex", r"[0-9a-f]+", 32, 0, True, r"[0-9a-f]{32}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", 39),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 20),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 20),
    Rule("bearer", r"Bearer\x20+[A-Za-z0-9._~+/-]{20,}=*", 20),
)


def trigrams(rules: tuple[Rule, ...] = RULES) -> list[str]:
    """The vocabulary of the index: all trigrams of the rules' queries."""
    return sorted({t for r in rules for conjunction in trigram_query(r.pattern) for t in conjunction})


def _postings(text: Column, rules: tuple[Rule, ...]) -> Column:
    """The vocabulary's trigrams that stand in a text."""
    known = F.array(*[F.lit(t) for t in trigrams(rules)])
    return F.transform(F.array(F.lower(text)), lambda low: F.filter(known, lambda t: F.contains(low, t)))[0]


def _satisfied(query: Query, have: Column) -> Column:
    """Whether a text's postings satisfy a query."""
    sides = [reduce(Column.__and__, [F.array_contains(have, t) for t in sorted(conjunction)], F.lit(True)) for conjunction in sorted(query, key=sorted)]
    return reduce(Column.__or__, sides)


def _kinds(have: Column, rules: tuple[Rule, ...]) -> Column:
    """The kinds of rules with a query that a text's postings satisfy."""
    return F.array_compact(F.array(*[F.when(_satisfied(trigram_query(r.pattern), have), F.lit(r.kind)) for r in rules if trigram_query(r.pattern) != ALWAYS]))


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id") -> DataFrame:
    """The inverted index as rows (trigram, doc_id) over every whole text (null: none)."""
    return docs.select(F.explode(_postings(F.col("text"), rules)).alias("trigram"), F.col(id_col).alias("doc_id"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, kinds): the documents that satisfy rules' queries, by intersecting postings."""
    have = index.groupBy("doc_id").agg(F.collect_set("trigram").alias("have"))
    return have.select("doc_id", _kinds(F.col("have"), rules).alias("kinds")).where(F.size("kinds") > 0)


def spans(rule: Rule, text: Column) -> Column:
    """array<struct<start, ord, kind, end>> (code points, end exclusive) of the rule's
    leftmost non-overlapping matches that are long enough."""
    pieces, matches = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    values = matches if rule.value == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.value))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:string,end:int,value:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        row = F.struct(start.alias("start"), F.lit(rule.kind).alias("kind"), end.alias("end"), F.length(x["v"]).alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(x["v"]) >= rule.min_chars, F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out"))

    zipped = F.arrays_zip(F.slice(pieces, 1, F.size(matches)).alias("p"), matches.alias("m"), values.alias("v"))
    return F.aggregate(zipped, state, step, lambda acc: acc["out"])


def _numbered(found: Column, ordinal: int) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(ordinal).alias("ord"), s["kind"].alias("kind"), s["end"].alias("end")))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text, found) for every row of docs (null text: empty), without a shuffle.

    found: array<struct<start, ord, kind, end>> of all rules, by start and then
    rule order (ties: rule order). Repeated rows are scanned alike; very long
    texts are scanned whole; other columns, whatever their names, are ignored;
    an empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # a generated column, so that the postings are not made again for every rule
    have = texts.select("doc_id", "text", F.explode(F.array(_postings(F.col("text"), rules))).alias("have"))
    able = have.select("doc_id", "text", F.explode(F.array(_kinds(F.col("have"), rules))).alias("kinds"))
    empty = F.array().cast("array<struct<start:int,kind:string,end:int,value:int>>")
    parts = []
    for i, rule in enumerate(rules):
        hit = F.rlike("text", F.lit(rule.quick or rule.pattern))
        if trigram_query(rule.pattern) != ALWAYS:
            hit = F.array_contains("kinds", rule.kind) & hit
        parts.append(_numbered(F.when(hit, spans(rule, F.col("text"))).otherwise(empty), i))
    return able.select("doc_id", "text", F.array_sort(F.concat(*parts)).alias("found"))


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kinds = F.transform("found", lambda s: s["kind"])
    n = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    base = F.filter("found", lambda s: s["kind"].isin("assign", "access", "hex"))
    return got.select("doc_id", *n, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))
