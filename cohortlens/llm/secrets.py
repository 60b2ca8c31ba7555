"""Secret scan with a trigram inverted index.

Each rule's regular expression gives a Boolean query over trigrams that every
match must hold.  Postings of those trigrams are intersected, and only the
texts that are left are searched with the expression.  A rule whose expression
has no mandatory trigram searches every text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .exprs import clear_of, interleave, let, pieces_and_matches, running_sums, set_apart

try:  # the parser of the standard library's expressions
    from re import _parser as sre
except ImportError:  # its place in older versions
    import sre_parse as sre


@dataclass(frozen=True)
class Rule:
    """A kind of secret: an expression, and the least length of one of its groups."""
    kind: str
    pattern: str
    group: int = 0
    min_length: int = 1


#: Fixed values of the task: the three kinds that are always reported.
BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: Published formats of further credentials.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("stripe", r"[sr]k_(?:live|test)_[A-Za-z0-9]+", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("key_block", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1),
)
RULES = BASE_RULES + MORE_RULES
MAX_ALTERNATIVES = 64
GAP = "\0"


def _strings(parsed) -> list[str]:
    """Alternatives of an expression as literal text with GAP for anything else."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            step = [chr(arg).lower()]
        elif name == "IN" and len(arg) <= 6 and all(str(o) == "LITERAL" for o, _ in arg):
            step = sorted({chr(v).lower() for _, v in arg})
        elif name == "BRANCH":
            step = [s for branch in arg[1] for s in _strings(branch)]
        elif name == "SUBPATTERN":
            step = _strings(arg[-1])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, body = arg
            inner = _strings(body)
            if low == 0:
                step = ["", *inner] if high == 1 else [GAP]
            else:
                step = [s if low == high == 1 else s + GAP + s if low > 1 else s + GAP for s in inner]
        elif name == "AT":
            step = [""]
        else:
            step = [GAP]
        if len(out) * len(step) > MAX_ALTERNATIVES:
            step = [GAP]
        out = [a + b for a in out for b in step]
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of trigrams (lower case) of which every match holds one in
    full; an empty list if some match need not hold any."""
    clauses = set()
    for text in _strings(sre.parse(pattern)):
        runs = re.split(f"{GAP}+", text)
        clauses.add(frozenset(r[i:i + 3] for r in runs for i in range(len(r) - 2) if r[i:i + 3].isascii()))
    if frozenset() in clauses:
        return []
    return sorted((c for c in clauses if not any(d < c for d in clauses)), key=sorted)


def postings(docs: DataFrame, keys: Sequence[str], text: str, trigrams: Sequence[str]) -> DataFrame:
    """The inverted index of the given trigrams: one row per trigram and text that holds it."""
    lowered = docs.select(*keys, F.lower(text).alias("_low"))
    held = F.array(*[F.when(F.col("_low").contains(t), F.lit(t)) for t in trigrams])
    return lowered.select(*keys, F.explode(F.array_compact(held)).alias("trigram"))


def candidates(docs: DataFrame, keys: Sequence[str], text: str, rules: Sequence[Rule]) -> DataFrame:
    """Texts that satisfy a rule's trigram query, with the kinds to search for."""
    clauses = [(r.kind, f"{r.kind}/{n}", len(c), t) for r in rules
               for n, c in enumerate(trigram_query(r.pattern)) for t in sorted(c)]
    table = docs.sparkSession.createDataFrame(clauses, "kind string, clause string, n int, trigram string")
    index = postings(docs, keys, text, sorted({c[3] for c in clauses})).distinct()
    # The rule table has one row per trigram of a rule: its size is that of the rules.
    hits = index.join(F.broadcast(table), "trigram").groupBy(*keys, "kind", "clause", "n").agg(F.count("*").alias("held"))
    return hits.where("held = n").groupBy(*keys).agg(F.collect_set("kind").alias("_kinds"))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Spans of a rule in a text as structs that sort by start, then by rule."""
    def placed(pieces, found):
        sized = F.zip_with(F.slice(pieces, 1, F.size(found)), found,
                           lambda p, m: (F.length(p) + F.length(m)).cast("bigint"))
        ends = running_sums(sized)
        measured = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
        every = F.transform(F.arrays_zip(ends.alias("e"), found.alias("m"), measured.alias("g")), lambda x: F.struct(
            (x["e"] - F.length(x["m"])).alias("start"), F.lit(order).alias("rank"), x["e"].alias("end"),
            F.lit(rule.kind).alias("kind"), F.length(x["g"]).alias("size")))
        return F.transform(F.filter(every, lambda s: s["size"] >= rule.min_length), lambda s: s.dropFields("size"))
    return pieces_and_matches(text, rule.pattern, placed)


SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                 rules: Sequence[Rule] = RULES) -> DataFrame:
    """Every column of ``docs`` and ``secret_spans``: all spans of all rules by
    start, then in the rules' order; matches of a rule are leftmost and do not
    overlap.  Positions count code points, ends are exclusive.

    A null or empty text has no spans.  Null ids and repeated rows are kept,
    each with the spans of its own text; a column that already is named
    ``secret_spans`` is replaced.
    """
    indexed = [r for r in rules if trigram_query(r.pattern)]
    docs, at, restored = set_apart(clear_of(docs, ["secret_spans"]))
    keyed = docs.select("*", F.col(at(id_col)).alias("_key"), F.xxhash64(at(text)).alias("_hash"), F.col(at(text)).alias("_text"))
    if indexed:
        found = candidates(keyed, ["_key", "_hash"], "_text", indexed).withColumnsRenamed({"_key": "_k", "_hash": "_h"})
        keyed = keyed.join(found, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h")), "left")
    else:
        keyed = keyed.withColumn("_kinds", F.lit(None).cast("array<string>"))
    empty = F.array().cast(SPAN)
    parts = []
    for order, rule in enumerate(rules):
        # The bound form of a minimum length finds the same texts, and far fewer than the bare expression.
        wanted = F.array_contains("_kinds", rule.kind) if rule in indexed else F.col("_text").rlike(_least(rule))
        parts.append(F.when(wanted, _spans(F.col("_text"), rule, order).cast(SPAN)).otherwise(empty))
    spans = F.array_sort(F.concat(*parts))
    # Spans come first: inside a lambda a name also finds the columns of its own selection.
    return keyed.withColumn("_spans", spans).select(*restored.values(), F.col("_spans").alias("secret_spans"))


def _least(rule: Rule) -> str:
    """A test that every text with a span of the rule passes: for a bare
    ``class+`` its repetition, else the expression itself."""
    bare = re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)
    return f"{bare[1]}{{{rule.min_length}}}" if bare and rule.group == 0 else rule.pattern


def joined(spans: Column, kinds: Sequence[str] | None = None) -> Column:
    """Spans as text, ``kind:start:end`` joined by commas."""
    kept = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(list(kinds)))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                               s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", spans: str = "secret_spans", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``spans`` put out of the text by a mask;
    overlapping spans share one.  A text without spans stays as it is."""
    t, s = F.col(f"`{text}`"), F.col(f"`{spans}`")

    def merge(done, x):
        last = F.element_at(done, -1)
        return F.when((F.size(done) > 0) & (x["start"] < F.try_element_at(done, F.lit(-1))["end"]), F.concat(
            F.slice(done, F.lit(1), F.size(done) - 1),
            F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        ).otherwise(F.concat(done, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end")))))

    def cut(found):
        def kept(start, end):
            return F.substring(t, (start + 1).cast("int"), (end - start).cast("int"))
        before = F.transform(found, lambda x, i: F.concat(
            kept(F.when(i > 0, F.get(found, i - 1)["end"]).otherwise(F.lit(0).cast("bigint")), x["start"]), F.lit(mask)))
        return F.concat(F.array_join(before, ""), kept(F.element_at(found, -1)["end"], F.length(t).cast("bigint")))

    merged = F.aggregate(s, F.array().cast("array<struct<start:bigint,end:bigint>>"), merge)
    return docs.withColumn(text, F.when(F.size(s) > 0, let(merged, cut)).otherwise(t))
