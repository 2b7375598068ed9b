"""Secret scan with a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: a conjunction of alternatives, each a
set of trigrams of which a match must contain one.  The index holds, for every trigram that some query names, the
texts that contain it, in posting lists of bounded blocks.  Intersecting and uniting postings gives each rule's
candidates, which alone are verified by the expression itself.  Rules without mandatory trigrams scan all texts.

All of it is DataFrame expressions; only the derivation of the queries, over the list of rules, is plain Python.
"""

from __future__ import annotations

import re._constants as kinds
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import col, durable, let, text_of

BLOCK_BITS = 10      # a posting list holds the texts of one of 2**BLOCK_BITS or more blocks
BLOCK_ROWS = 4096    # texts per block, about
MOST_TEXTS = 64      # spellings of one part of an expression that are followed


@dataclass(frozen=True)
class Rule:
    """``least``: characters that group ``group`` of a match must have at least."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# The base kinds in their order.
BASE = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    # Runs are matched whole, so asking for the length in the expression finds the same spans as dropping short ones.
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
]
# The method's own kinds, in order.
MORE = [
    Rule("temporary", r"ASIA[A-Z0-9]{16}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("github_fine", r"github_pat_[A-Za-z0-9_]{22,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("slack_hook", r"hooks\.slack\.com/services/[A-Za-z0-9/]{20,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("google_oauth", r"ya29\.[A-Za-z0-9_-]{20,}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("pypi", r"pypi-[A-Za-z0-9_-]{50,}"),
    Rule("hub", r"hf_[A-Za-z0-9]{30,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9_.=/+-]{20,}"),
    Rule("account_key", r"AccountKey=[A-Za-z0-9+/=]{40,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,80}:[^\s:/@]{3,80}@[A-Za-z0-9.-]+"),
]


def _spellings(node) -> set[str] | None:
    """All lower-case texts that a part of an expression can match, or None where there are too many."""
    op, arg = node
    if op is kinds.LITERAL:
        return {chr(arg).lower()}
    if op is kinds.IN:
        out = set()
        for kind, value in arg:
            if kind is kinds.LITERAL:
                out.add(chr(value).lower())
            elif kind is kinds.RANGE and value[1] - value[0] < MOST_TEXTS:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 5 else None
    if op is kinds.SUBPATTERN:
        return _sequence_spellings(arg[3])
    if op is kinds.BRANCH:
        parts = [_sequence_spellings(x) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
        low, high, inner = arg
        if high <= 5 and (own := _sequence_spellings(inner)) is not None:
            out, now = set(), {""}
            for k in range(high + 1):
                if k >= low:
                    out |= now
                now = {a + b for a in now for b in own}
                if len(out) + len(now) > MOST_TEXTS:
                    return None
            return out
    return None


def _sequence_spellings(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        own = _spellings(node)
        if own is None or len(out) * len(own) > MOST_TEXTS:
            return None
        out = {a + b for a in out for b in own}
    return out


def _required(nodes) -> list[frozenset[str]]:
    """Clauses over a sequence of parts: every match holds at least one trigram of each clause."""
    clauses: list[frozenset[str]] = []
    run: set[str] = {""}

    def close():
        """The spellings of an unbroken run of parts; the k-th trigrams of all of them form one clause."""
        if min(map(len, run)) >= 3:
            for k in range(min(map(len, run)) - 2):
                clauses.append(frozenset(x[k:k + 3] for x in run))

    for node in nodes:
        own = _spellings(node)
        if own is not None and len(run) * len(own) <= MOST_TEXTS:
            run = {a + b for a in run for b in own}
            continue
        close()
        run = own if own is not None else {""}
        op, arg = node
        if own is None and op is kinds.SUBPATTERN:
            clauses.extend(_required(arg[3]))
        elif own is None and op is kinds.BRANCH:      # one trigram of some clause of every branch
            parts = [_required(x) for x in arg[1]]
            if all(parts):
                clauses.append(frozenset().union(*(min(p, key=len) for p in parts)))
        elif own is None and op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and arg[0] >= 1:
            clauses.extend(_required(arg[2]))
    close()
    return clauses


def trigram_query(pattern: str) -> list[list[str]]:
    """A conjunction of disjunctions of lower-case trigrams that every match satisfies; empty without any."""
    clauses = sorted({tuple(sorted(c)) for c in _required(parser.parse(pattern)) if all(x.isascii() for x in c)}, key=lambda c: (len(c), c))
    return [list(c) for c in clauses[:4]]      # a shorter conjunction only lets more candidates through


def candidates(texts: DataFrame, queries: dict[int, list[list[str]]]) -> DataFrame:
    """One row (key, rules) per text key that some rule's query admits; ``texts`` has key and text.

    The key is a hash of the text, so copies share one posting.  Should two texts share a key, their postings
    unite and verification sorts them out: a candidate is never lost.
    """
    grams = sorted({g for q in queries.values() for c in q for g in c})
    listed = F.array(*[F.lit(g) for g in grams])
    # The lower-case text is bound once; as a plain column it would be made anew for every trigram.
    held = texts.select("key", let(F.lower("text"), lambda low: F.filter(listed, lambda g: low.contains(g))).alias("grams"))
    postings = durable(held.where(F.size("grams") > 0).select("key", F.explode("grams").alias("gram")).distinct(), "postings")
    blocks = max(1 << BLOCK_BITS, -(-postings.count() // BLOCK_ROWS))
    # A block of texts has bounded lists, however common a trigram is.
    lists = (postings.withColumn("block", F.pmod("key", F.lit(blocks))).groupBy("block", "gram")
             .agg(F.collect_list("key").alias("keys")))
    index = lists.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "keys"))).alias("index"))
    none = F.array().cast("array<bigint>")

    def admitted(query: list[list[str]]) -> Column:
        out = None
        for clause in query:
            some = F.array_distinct(F.flatten(F.array(*[F.coalesce(F.try_element_at("index", F.lit(g)), none) for g in clause])))
            out = some if out is None else F.array_intersect(out, some)
        return out

    def of_rule(r: int) -> Column:
        return F.transform(admitted(queries[r]), lambda k: F.struct(k.alias("key"), F.lit(r).alias("rule")))

    each = F.flatten(F.array(*[of_rule(r) for r in queries]))
    return index.select(F.inline(each)).groupBy("key").agg(F.collect_set("rule").alias("rules"))


SPAN = "array<struct<start:bigint,rank:int,end:bigint>>"


def _matches(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of the matches of a rule, in code points, leftmost first and without overlap.

    The pieces between the matches and the matches alternate, so a match starts where the lengths before it add
    up to; lengths are summed once, in order.
    """
    pattern = F.lit(rule.pattern)
    between = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x).cast("long"))
    inside = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.length(x).cast("long"))
    measured = inside if rule.group == 0 else F.transform(
        F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda x: F.length(x).cast("long"))
    zipped = F.arrays_zip(F.slice(between, F.lit(1), F.size(inside)).alias("gap"), inside.alias("own"), measured.alias("size"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin, end = acc["at"] + x["gap"], acc["at"] + x["gap"] + x["own"]
        span = F.array(F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end")))
        kept = F.when(x["size"] >= rule.least, F.concat(acc["out"], span)).otherwise(acc["out"])
        return F.struct(end.alias("at"), kept.alias("out"))

    return F.when(text.rlike(rule.pattern), F.aggregate(zipped, start, step)["out"]).otherwise(F.array().cast(SPAN))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: list[Rule] | None = None) -> DataFrame:
    """One row per input row: ``id_col``, n_<kind> of each base kind, base_sha256, spans.

    Null counts as an empty text.  spans lists kind:start:end of all matches by start, then kind in the order of
    the rules, comma-joined; base_sha256 is the SHA-256 of the same text over base kinds alone.  Positions count
    code points, ends are exclusive.  Repeated rows and null identifiers come out as they went in; other columns
    are not touched; an empty table gives an empty result.
    """
    rules = [*BASE, *(MORE if more is None else more)]
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    texts = df.select(col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    found = durable(candidates(texts.select("key", "text"), queries), "candidates")
    both = texts.join(found, "key", "left")
    none = F.array().cast(SPAN)
    spans = []
    for i, rule in enumerate(rules):
        own = _matches(F.col("text"), rule, i)
        spans.append(F.when(F.array_contains("rules", i), own).otherwise(none) if i in queries else own)
    kinds_of = F.array(*[F.lit(r.kind) for r in rules])

    def listed(array: Column) -> Column:
        return F.array_join(F.transform(array, lambda s: F.concat_ws(
            ":", kinds_of[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(rank: int) -> Column:
        return F.size(F.filter("all", lambda s: s["rank"] == rank)).cast("long")

    base = F.filter("all", lambda s: s["rank"] < len(BASE))
    return (both.select("id", F.array_sort(F.concat(*spans)).alias("all")).select(
        F.col("id").alias(id_col),
        *[number(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("all")).alias("spans")))
