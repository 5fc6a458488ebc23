"""Secret scans through an inverted index of trigrams (DataFrame functions only).

From each rule's regular expression a Boolean query over trigrams is derived
that every match must satisfy: an AND of parts, each an OR of strings, each an
AND of the string's trigrams. The postings of the rules' trigrams are
intersected by counting, and only documents that satisfy a rule's query are
matched against its expression. Rules without a mandatory trigram, such as
runs of hexadecimal digits, scan every document.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stored

#: A part of a query lists this many strings at most; beyond it, the part ends and the next begins.
MAX_STRINGS = 16
#: Candidates that are sent to all tasks at most (some 60 bytes each); more of them meet the documents in a shuffled join.
MAX_BROADCAST_CANDIDATES = 200_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` in the common subset of Java's, RE2's and Python's expressions; the match, or its ``group``, has ``least`` characters.

    A rule of ``any_case`` is written in lower case and matched in the text with A-Z in lower case.
    """

    name: str
    pattern: str
    any_case: bool = False
    group: int = 0
    least: int = 1


#: The first three are the base kinds; the others are public formats of well-known credentials.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""", any_case=True, group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}", least=24),  # runs are maximal, so the floor may stand in the expression
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("url_login", r"://[^\x20\x09-\x0D/:@]{1,64}:[^\x20\x09-\x0D/:@]{1,64}@"),
)
BASE = 3

#: A query: parts, all of which hold; a part: strings, one of which occurs.
Query = list[set[str]]


def trigrams(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)}


def _strings(op, arg) -> set[str] | None:
    """All strings that a node matches, if they are few."""
    if op is sre.LITERAL:
        return {chr(arg)}
    if op is sre.IN and arg[0][0] is not sre.NEGATE:
        chars: set[str] = set()
        for kind, x in arg:
            if kind is sre.LITERAL:
                chars.add(chr(x))
            elif kind is sre.RANGE and x[1] - x[0] < MAX_STRINGS:
                chars |= {chr(c) for c in range(x[0], x[1] + 1)}
            else:
                return None
        return chars if len(chars) <= MAX_STRINGS else None
    if op is sre.SUBPATTERN:
        return _sequence_strings(arg[3])
    if op is sre.BRANCH:
        every = [_sequence_strings(x) for x in arg[1]]
        return None if None in every or len(all_of := set().union(*every)) > MAX_STRINGS else all_of
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = arg
        one = _sequence_strings(inner)
        if one is None or high == sre.MAXREPEAT:
            return None
        found: set[str] | None = set()
        for times in range(low, high + 1):
            found |= (power := _power(one, times)) or set()
            if power is None or len(found) > MAX_STRINGS:
                return None
        return found
    return None


def _power(strings: set[str], times: int) -> set[str] | None:
    out = {""}
    for _ in range(times):
        out = {a + b for a in out for b in strings}
        if len(out) > MAX_STRINGS:
            return None
    return out


def _sequence_strings(nodes) -> set[str] | None:
    out = {""}
    for op, arg in nodes:
        more = _strings(op, arg)
        if more is None or len(out := {a + b for a in out for b in more}) > MAX_STRINGS:
            return None
    return out


def _sequence_query(nodes) -> Query:
    """Parts that any match of the sequence satisfies, as runs of nodes with few strings."""
    parts, run = [], {""}

    def end():
        nonlocal run
        if all(len(x) >= 3 for x in run):
            parts.append(run)
        run = {""}

    for op, arg in nodes:
        more = _strings(op, arg)
        if more is not None and len(joined := {a + b for a in run for b in more}) <= MAX_STRINGS:
            run = joined
            continue
        end()
        if more is not None:
            run = more
        elif op is sre.SUBPATTERN:
            parts += _sequence_query(arg[3])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
            parts += _sequence_query(arg[2])
    end()
    return parts


def trigram_query(pattern: str) -> Query:
    """Parts of lower-case strings; empty if no trigram is mandatory."""
    return [{x.lower() for x in part} for part in _sequence_query(_parser.parse(pattern))]


def _clauses(rules: tuple[Rule, ...]) -> list[tuple[str, int, int, int, str, int]]:
    """(rule, parts of its query, part, string, trigram, trigrams of the string)."""
    out = []
    for rule in rules:
        query = trigram_query(rule.pattern)
        for p, part in enumerate(query):
            for s, string in enumerate(sorted(part)):
                out += [(rule.name, len(query), p, s, t, len(trigrams(string))) for t in sorted(trigrams(string))]
    return out


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits as two longs: rows with equal keys are equal for all practical purposes."""
    name = doc_id.cast("string")
    return F.struct(F.xxhash64(name, text).alias("a"), F.xxhash64(F.lit(1), name, text).alias("b"))


def index(docs: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """(trigram, key): postings of the distinct trigrams of ``docs`` (key, text), A-Z in lower case.

    ``wanted`` keeps the postings that given queries ask for; without it, all are listed, for queries to come.
    """
    # arrays of characters, as places in a string are found by counting from its start
    chars = docs.select("key", F.split(ascii_lower(F.coalesce("text", F.lit(""))), "").alias("c")).filter(F.size("c") >= 3)
    grams = F.transform(F.sequence(F.lit(2), F.size("c") - 1), lambda i: F.concat(F.get("c", i - 2), F.get("c", i - 1), F.get("c", i)))
    own = F.array_distinct(grams) if wanted is None else F.array_intersect(grams, F.array(*map(F.lit, wanted)))
    return chars.select("key", F.explode(own).alias("trigram"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rules): documents whose postings satisfy the queries of the named rules."""
    spark = postings.sparkSession
    clauses = spark.createDataFrame(_clauses(rules), "rule string, parts int, part int, string int, trigram string, need int")
    return (
        postings.join(F.broadcast(clauses), "trigram")  # some trigrams per rule
        .groupBy("key", "rule", "parts", "part", "string", "need")
        .agg(F.count("*").alias("n"))
        .filter("n >= need")  # repeated rows repeat their postings; a candidate too many is only verified in vain
        .groupBy("key", "rule", "parts")
        .agg(F.count_distinct("part").alias("n"))
        .filter("n = parts")
        .groupBy("key")
        .agg(F.collect_set("rule").alias("rules"))
    )


def _text(rule: Rule) -> Column:
    return ascii_lower(F.col("text")) if rule.any_case else F.col("text")


def _matches(rule: Rule) -> Column:
    """Array of (rule, i, gap, length, good): the matches in order, each with the characters between it and the one before."""
    text = _text(rule)
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    zipped = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), found.alias("m"), measured.alias("g"))
    rows = F.transform(
        zipped,
        lambda z, i: F.struct(
            F.lit(rule.name).alias("rule"), i.alias("i"), F.length(z["gap"]).alias("gap"), F.length(z["m"]).alias("length"), (F.length(z["g"]) >= rule.least).alias("good")
        ),
    )
    return F.filter(rows, lambda z: z["length"].isNotNull())  # the last gap has no match


def spans(docs: DataFrame, found: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rule, start, end): matches in ``docs`` (key, text), in characters; ``found`` has the candidates' (key, rules)."""
    by_index = {c[0] for c in _clauses(rules)}
    if found.limit(MAX_BROADCAST_CANDIDATES + 1).count() <= MAX_BROADCAST_CANDIDATES:
        found = F.broadcast(found)
    none = F.array().cast("array<struct<rule:string,i:int,gap:int,length:int,good:boolean>>")
    scanned = docs.select("key", F.concat(none, *[F.when(_text(r).rlike(r.pattern), _matches(r)).otherwise(none) for r in rules if r.name not in by_index]).alias("m"))
    checked = docs.join(found, "key").select("key", F.concat(none, *[F.when(F.array_contains("rules", r.name), _matches(r)).otherwise(none) for r in rules if r.name in by_index]).alias("m"))
    # repeated rows have equal keys: their matches fall together before positions are summed
    rows = scanned.unionByName(checked).select("key", F.explode("m").alias("m")).select("key", "m.*").repartition("key", "rule").dropDuplicates(["key", "rule", "i"])
    before = F.sum(F.col("gap") + F.col("length")).over(Window.partitionBy("key", "rule").orderBy("i"))
    return rows.select("key", "rule", "good", (before - F.col("length")).alias("start"), before.alias("end")).filter("good").drop("good")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs``: all its columns, then ``found``, an array of (start, rank, rule, end) in order.

    ``start`` and ``end`` (exclusive) count code points; ``rank`` is the rule's
    place in ``rules``, which orders spans with the same start. Matches of one
    rule are leftmost and do not overlap; those that are too short are dropped
    after they have taken their place.

    Null and empty texts have no spans, and neither have texts of fewer than three
    characters by rules that need a trigram. Texts of any length are taken whole.
    Repeated rows repeat their result. Other columns pass through; one named
    ``found`` is replaced. An empty table gives an empty one.
    """
    kept = [c for c in docs.columns if c != "found"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("key"))
    texts = rows.select("key", F.col(f"row.`{text}`").alias("text"))
    wanted = sorted({c[4] for c in _clauses(rules)})
    found = stored(candidates(index(texts, wanted), rules))
    rank = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.name, k)])
    listed = (
        spans(texts, found, rules)
        .groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("start"), F.element_at(rank, F.col("rule")).alias("rank"), F.col("rule"), F.col("end")))).alias("found"))
    )
    listed = stored(listed)
    none = F.array().cast(listed.schema["found"].dataType)
    return rows.join(listed, "key", "left").select(*[F.col(f"row.`{c}`").alias(c) for c in kept], F.coalesce("found", none).alias("found"))
