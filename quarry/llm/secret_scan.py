"""Secret scan over a trigram inverted index, in DataFrame operations only.

1. From each rule's pattern a Boolean trigram query is derived: alternatives of sets of trigrams,
   one of which must occur in full wherever the rule matches (lower-cased, so the query
   also holds for rules that ignore case).
2. The inverted index has a posting (trigram, text) per distinct text and trigram that
   some rule asks for; copies of a text share their postings.
3. A rule's alternatives are intersections of postings: a text with as many postings
   among an alternative's trigrams as it has trigrams is a candidate.
4. Candidates are verified with the pattern.  Rules without mandatory trigrams scan every text.

A span is the whole match, leftmost and non-overlapping per rule, in code points; matches
whose checked group is shorter than ``least`` are dropped after matching.

Defined results: null and empty texts have no spans; a null id is kept; repeated rows give equal
rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, text_key, text_or_empty

#: Strings that a part of a pattern may stand for before the derivation stops enumerating.
MOST_STRINGS = 64
MOST_ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0      # the group whose length is checked
    least: int = 1


# The three base rules, then public formats of well-known keys.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES


# -- trigram queries ------------------------------------------------------------------------

Alternatives = frozenset  # of frozensets of trigrams; the empty set inside means "anything"
ANYTHING: Alternatives = frozenset([frozenset()])


def _least(alternatives) -> Alternatives:
    """Without the alternatives that another one implies."""
    given = frozenset(alternatives)
    out = frozenset(a for a in given if not any(b < a for b in given))
    return out if len(out) <= MOST_ALTERNATIVES else ANYTHING


def _both(x: Alternatives, y: Alternatives) -> Alternatives:
    if len(x) * len(y) > MOST_ALTERNATIVES ** 2:
        return x
    both = _least(a | b for a in x for b in y)
    return x if both == ANYTHING else both


def _of_strings(strings) -> Alternatives:
    return _least(frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings)


def _parts(items):
    """(strings, query) of a sequence of parsed items: the finite set of strings it can be (lower
    case), or None, and what must occur besides."""
    op = re._constants
    query, run, exact = ANYTHING, {""}, True
    for kind, arg in items:
        if kind is op.LITERAL:
            strings, own = {chr(arg).lower()}, ANYTHING
        elif kind is op.IN and not any(k is op.NEGATE or k is op.CATEGORY for k, _ in arg):
            size = sum(1 if k is op.LITERAL else a[1] - a[0] + 1 for k, a in arg)
            codes = [] if size > 2 * MOST_STRINGS else [
                c for k, a in arg for c in ([a] if k is op.LITERAL else range(a[0], a[1] + 1))]
            strings = {chr(c).lower() for c in codes}
            strings, own = (strings if 0 < len(strings) <= 8 else None), ANYTHING
        elif kind is op.SUBPATTERN:
            strings, own = _parts(arg[3])
        elif kind is op.BRANCH:
            each = [_parts(b) for b in arg[1]]
            strings = set().union(*[s for s, _ in each]) if all(s is not None for s, _ in each) else None
            own = _least(a for s, q in each for a in (q if s is None else _both(q, _of_strings(s))))
            if strings is not None:
                own = ANYTHING
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            low, high, inner = arg
            one, own = _parts(inner)
            if one is not None and high <= 4 and len(one) ** int(high) <= MOST_STRINGS:
                strings = {"".join(x) for n in range(low, int(high) + 1) for x in product(sorted(one), repeat=n)}
                own = ANYTHING
            else:
                strings = None
                own = (own if one is None else _of_strings(one)) if low else ANYTHING
        elif kind is op.AT:
            continue
        else:
            strings, own = None, ANYTHING
        if strings is not None and len(strings) * len(run) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
        else:
            exact = False
            query = _both(query, _of_strings(run))
            run = {""}
            if strings is not None and len(strings) <= MOST_STRINGS:
                run = set(strings)
        query = _both(query, own)
    return (run, query) if exact else (None, _both(query, _of_strings(run)))


def trigram_query(pattern: str) -> Alternatives:
    """Alternatives of trigram sets; every match of the pattern contains all of one of them."""
    strings, query = _parts(re._parser.parse(pattern))
    return query if strings is None else _both(query, _of_strings(strings))


# -- index, candidates, verification --------------------------------------------------------

def postings(docs: DataFrame, trigrams: list[str], text_col: str = "text") -> DataFrame:
    """The inverted index: (trigram, key) once for each distinct text and trigram in it."""
    low = F.lower(text_or_empty(text_col))
    found = docs.select(text_key(text_or_empty(text_col)).alias("key"),
                        F.array(*[F.contains(low, F.lit(g)) for g in trigrams]).alias("has"))
    names = F.array(*[F.lit(g) for g in trigrams])
    grams = found.select("key", F.explode(F.arrays_zip(names.alias("trigram"), F.col("has"))).alias("x"))
    return materialize(grams.where("x.has").select(F.col("x.trigram").alias("trigram"), "key").distinct(),
                       "llm-trigrams")


def candidates(index: DataFrame, queries: dict[str, Alternatives]) -> DataFrame:
    """(key, rules): the rules that may match a text, from the postings alone."""
    spark = index.sparkSession
    wanted = [(rule, n, g, len(grams)) for rule, alternatives in queries.items()
              for n, grams in enumerate(sorted(map(sorted, alternatives))) for g in grams]
    asked = spark.createDataFrame(wanted, "rule string, alternative int, trigram string, needs int")
    hits = (index.join(F.broadcast(asked), "trigram")       # a few rows for each rule
            .groupBy("key", "rule", "alternative", "needs").agg(F.count(F.lit(1)).alias("has")))
    return hits.where("has = needs").groupBy("key").agg(F.collect_set("rule").alias("rules"))


def _running(sizes: Column) -> Column:
    """Running sums of an array, in steps of 128 so that long arrays stay cheap."""
    step = 128

    def total(x):
        return F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)

    def upto(i, blocks):
        whole = F.floor(i / step).cast("int")
        return total(F.slice(blocks, 1, whole)) + total(
            F.slice(sizes, whole * step + 1, (i % step + 1).cast("int")))

    n = F.size(sizes)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / step).cast("int")),
                         lambda b: total(F.slice(sizes, b * step + 1, F.lit(step))))
    return F.transform(F.array(blocks), lambda bs: F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: upto(i, bs)))[0]


def _ends(no: int) -> Column:
    """Lengths from one match's end to the next one's.  (Arrays go in as arguments: what a lambda
    refers to by itself may be computed anew for every element.)"""
    before = F.slice(f"g{no}", F.lit(1), F.size(f"m{no}"))
    return F.zip_with(f"m{no}", before, lambda m, g: F.length(m) + F.length(g))


def _passing(no: int, rule: Rule) -> Column:
    """The spans of a rule's matches that are long enough."""
    m, e, v = f"m{no}", f"e{no}", f"v{no}"
    long_enough = F.filter(F.arrays_zip(m, e, v), lambda x: F.length(x[v]) >= rule.least)
    return F.transform(long_enough, lambda x: F.struct(
        (x[e] - F.length(x[m])).alias("start"), F.lit(no).alias("rule_no"), x[e].alias("stop"),
        F.lit(rule.kind).alias("kind")))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id",
                 text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, text, ``spans`` -- an array of (start, rule_no,
    stop, kind), ordered -- and the columns in ``keep`` as a struct ``kept``."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q != ANYTHING}
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"),
                       *([F.struct(*keep).alias("kept")] if keep else []))
    if indexed:
        trigrams = sorted({g for q in indexed.values() for a in q for g in a})
        may = candidates(postings(docs, trigrams, text_col), indexed).withColumnRenamed("key", "c_key")
        rows = rows.withColumn("key", text_key(F.col("text"))).join(may, F.col("key") == F.col("c_key"), "left")
    else:
        rows = rows.withColumn("rules", F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    passing = []
    for no, r in enumerate(rules):
        asked = F.lit(True) if r.kind not in indexed else F.coalesce(
            F.array_contains("rules", r.kind), F.lit(False))
        found = F.when(asked, F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).otherwise(none)
        rows = rows.withColumn(f"m{no}", found)
        some = F.size(f"m{no}") > 0
        # text before each match: what lies between the matches, since the pattern splits the text
        rows = rows.withColumn(f"g{no}", F.when(some, F.split("text", r.pattern, -1)).otherwise(none))
        rows = rows.withColumn(f"v{no}", F.col(f"m{no}") if not r.group else F.when(
            some, F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group))).otherwise(none))
        rows = rows.withColumn(f"n{no}", _ends(no))
        rows = rows.withColumn(f"e{no}", F.when(some, _running(F.col(f"n{no}"))).otherwise(
            F.array().cast("array<bigint>")))
        passing.append(_passing(no, r))
    return rows.select("doc_id", "text", *(["kept"] if keep else []),
                       F.sort_array(F.concat(*passing)).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redacted(text: Column, spans: Column, mask: str = "[{kind}]") -> Column:
    """The text with every span replaced by a mark that names its kind; spans that
    overlap one that begins earlier (or ranks first) melt into it."""
    before, after = mask.split("{kind}")
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(a, s):
        apart = s["start"] >= a["at"]
        gap = F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        return F.struct(
            F.when(apart, F.concat(a["out"], F.array(gap, F.concat(F.lit(before), s["kind"], F.lit(after))))
                   ).otherwise(a["out"]).alias("out"),
            F.greatest(a["at"], s["stop"]).alias("at"))

    done = F.aggregate(spans, state, step)
    tail = F.substring(text, (done["at"] + 1).cast("int"), F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(done["out"], ""), tail))


def without_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with every secret in the text replaced by a mark;
    ``n_chars`` (if there is such a column) follows a text that changed."""
    flag = "text_was_null"
    while flag in docs.columns:
        flag += "_"
    marked = docs.withColumn(flag, F.col(text_col).isNull())
    others = tuple(c for c in marked.columns if c != text_col)
    found = find_secrets(marked, rules, id_col, text_col, keep=others)
    new = redacted(F.col("text"), F.col("spans"))
    found = found.withColumn("new", F.when(F.col(f"kept.{flag}"), F.lit(None)).otherwise(new))
    return found.select(*[
        F.col("new").alias(c) if c == text_col else
        F.when(F.size("spans") > 0, F.length("new").cast(t)).otherwise(F.col(f"kept.`{c}`")).alias(c) if c == "n_chars"
        else F.col(f"kept.`{c}`").alias(c) for c, t in docs.dtypes])
