"""Personal data by weak supervision, in DataFrame and SQL functions throughout.

One pass over the texts finds the candidates of every kind - the base patterns'
matches and those of broader patterns (national phone numbers, written-out
addresses, IPv6) - with their surroundings, as an array column of the document's
row; the text itself is never shuffled.  Labelers then vote on each candidate
(+1, -1 or 0, abstain): the base pattern, the check rules, gazetteers, the words
before it, and its edges.  Expectation-maximisation over the counts of vote patterns
(at most 4 kinds x 3^5 rows, whatever the input) estimates each labeler's
reliability, and the resulting label probabilities train the final span
classifier, a naive Bayes over categorical span features whose expected counts
Spark aggregates.  Base spans always stay; the classifier adds candidates that pass
their kind's check rule, that it finds at least ``min_probability`` likely and that
overlap no base span.

Defined results: null text is empty; null ids and repeated rows pass through row by
row; a table without candidates has empty spans; other columns do not matter.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.common import Scratch

KINDS = ("email", "ip", "card", "phone")
MARK = "\x01"
# The base patterns.  Possessive quantifiers match the same spans (no later part of a
# pattern can use what they take) and neither backtrack nor recurse on long runs.
BASE = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BROAD = {
    "email": r"[A-Za-z0-9._%+-]++ ?[\[(][aA][tT][\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(][dD][oO][tT][\])]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])",
}
#: Gazetteers and context words (this operator's own, a parameter's defaults).
TLDS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "example", "test", "invalid")
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "82", "86", "91")
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|reach|write)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|from|login)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|payment|carte|karte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|fax|telefon|téléphone|teléfono)\b",
}
AGAINST = r"(?i)\b(?:version|isbn|order|invoice|serial|page|section|id|no|nr|ref)\b[^a-z]*$"
LABELERS = ("pattern", "rule", "gazetteer", "context", "edges")

_SPAN = "array<struct<s:int,m:string,l:string,r:string>>"


def _any(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(words) + ")"


def _needs(kind: str, broad: bool) -> Column:
    """A cheap necessary condition for a match in the text."""
    t = F.col("t")
    if kind == "email":
        low = F.lower(t)
        return (F.instr(low, "at]") + F.instr(low, "at)") > 0) if broad else F.instr(t, "@") > 0
    if kind == "phone" and not broad:
        return F.instr(t, "+") > 0
    if kind == "ip" and broad:
        return t.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:")
    return t.rlike("[0-9]")


def _parts(kind: str, broad: bool) -> Column:
    """Gap, match, gap, ..., gap: one pass of the pattern marks its matches, then the marks split."""
    rx = (BROAD if broad else BASE)[kind]
    return F.when(_needs(kind, broad), F.split(F.regexp_replace("t", rx, f"{MARK}$0{MARK}"), MARK, -1)).otherwise(F.array(F.lit("")))


def _spans(parts: str) -> str:
    """Matches with their start in code points and their surroundings, from the parts."""
    return f"""if(size({parts}) < 3, cast(array() as {_SPAN}),
      aggregate(sequence(0, cast((size({parts}) - 3) / 2 as int)),
        named_struct('pos', 0, 'out', cast(array() as {_SPAN})),
        (a, i) -> named_struct(
          'pos', a.pos + length({parts}[2 * i]) + length({parts}[2 * i + 1]),
          'out', concat(a.out, array(named_struct('s', a.pos + length({parts}[2 * i]), 'm', {parts}[2 * i + 1],
                                                  'l', right({parts}[2 * i], 24), 'r', left({parts}[2 * i + 2], 8))))),
        a -> a.out))"""


DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
LUHN = f"""aggregate(transform(sequence(1, length({DIGITS})), i -> cast(substring(reverse({DIGITS}), i, 1) as int) * (2 - i % 2)),
           0, (a, v) -> a + if(v > 9, v - 9, v)) % 10 = 0"""
#: A dotted part of at most 255, leading zeros allowed.
OCTET = "^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"


def _passes(kind: str) -> str:
    if kind == "email":
        return "true"
    if kind == "ip":
        return f"forall(split(x.m, '[.]', -1), p -> p rlike '{OCTET}')"
    if kind == "card":
        return f"(length({DIGITS}) between 12 and 19) and if(length({DIGITS}) between 12 and 19, {LUHN}, false)"
    return f"length({DIGITS}) between 9 and 15"


def _votes(kind: str, broad: bool) -> str:
    """The labelers' votes, a struct of tinyints."""
    ok = "true" if broad and kind != "phone" else _passes(kind)
    gazetteer = {
        "email": f"if(x.m rlike '(?i)[.\\\\])] ?{_any(TLDS)}$', 1, -1)",
        "ip": "if(x.m rlike '^(?:0+|255)[.]', -1, if(x.m rlike '^[1-9]', 1, 0))",
        "card": f"if({DIGITS} rlike '^(?:4|5[1-5]|2[2-7]|3[47]|6)', 1, -1)",
        "phone": f"if(x.m rlike '^[+]{_any(CALLING)}', 1, 0)",
    }[kind]
    against = AGAINST.replace("\\", "\\\\")
    cue = CUES[kind].replace("\\", "\\\\")
    return f"""named_struct(
      'pattern', cast({'0' if broad else f'if({ok}, 1, -1)'} as tinyint),
      'rule', cast(if({ok}, 1, -1) as tinyint),
      'gazetteer', cast({gazetteer} as tinyint),
      'context', cast(if(x.l rlike '{cue}', 1, if(x.l rlike '{against}', -1, 0)) as tinyint),
      'edges', cast(if(x.l rlike '[A-Za-z0-9.]$' or x.r rlike '^[A-Za-z0-9]', -1, 1) as tinyint))"""


def _candidate(kind: str, broad: bool) -> str:
    votes = _votes(kind, broad)
    base = "false" if broad else _passes(kind)
    return f"""x -> named_struct('s', x.s, 'e', x.s + length(x.m), 'k', {KINDS.index(kind)}, 'base', {base}, 'v', {votes},
      'f', array(concat('len', least(length(x.m), 40) div 3), concat('dig', least(length({DIGITS}), 20)),
                 concat('sep', regexp_replace(regexp_replace(x.m, '[A-Za-z0-9]+', ''), '(.)(?=.*\\\\1)', '')),
                 concat('pre', if(x.l = '', '^', regexp_replace(regexp_replace(right(x.l, 1), '[A-Za-z]', 'a'), '[0-9]', '9'))),
                 concat('post', if(x.r = '', '$', regexp_replace(regexp_replace(left(x.r, 1), '[A-Za-z]', 'a'), '[0-9]', '9')))))"""


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, c): the candidates of every document as an array; base matches that pass their rule have ``base``."""
    t = F.coalesce(F.col("text"), F.lit(""))
    # The mark itself, should a text hold it, becomes another character that no pattern takes.
    df = docs.select("doc_id", F.when(F.instr(t, MARK) > 0, F.translate(t, MARK, "\x02")).otherwise(t).alias("t"))
    asked = [(k, False) for k in KINDS] + [(k, True) for k in BROAD]
    df = df.select("doc_id", *[_parts(k, b).alias(f"p{i}") for i, (k, b) in enumerate(asked)])
    df = df.select("doc_id", *[F.expr(_spans(f"p{i}")).alias(f"p{i}") for i in range(len(asked))])
    df = df.select("doc_id", *[F.expr(f"transform(p{i}, {_candidate(k, b)})").alias(f"p{i}") for i, (k, b) in enumerate(asked)])
    return df.select("doc_id", F.concat(*[f"p{i}" for i in range(len(asked))]).alias("c"))


def estimate(patterns: list, rounds: int = 50) -> tuple[dict, dict]:
    """EM over (k, votes, n) rows: (probability of each (k, votes), reliability of each (k, labeler)).

    One reliability per kind and labeler: the chance that a vote, when cast, is right."""
    prob = {(k, v): (1.0 if sum(v) > 0 else 0.0 if sum(v) < 0 else 0.5) for k, v, _ in patterns}
    right: dict = {}
    for _ in range(rounds):
        share, right = {}, {}
        for kind in {k for k, _, _ in patterns}:
            own = [(v, n, prob[k, v]) for k, v, n in patterns if k == kind]
            share[kind] = (sum(n * p for _, n, p in own) + 1) / (sum(n for _, n, _ in own) + 2)
            for j in range(len(LABELERS)):
                cast = sum(n for v, n, _ in own if v[j])
                good = sum(n * (p if v[j] > 0 else 1 - p) for v, n, p in own if v[j])
                right[kind, j] = min(0.99, max(0.5, (good + 8) / (cast + 10)))
        for k, v in prob:
            z = log(share[k] / (1 - share[k])) + sum(x * log(right[k, j] / (1 - right[k, j])) for j, x in enumerate(v))
            prob[k, v] = 1 / (1 + exp(-max(-30.0, min(30.0, z))))
    return prob, right


def find(docs: DataFrame, min_probability: float = 0.9, smoothing: float = 1.0) -> DataFrame:
    """(doc_id, base, spans): arrays of (s, e, k), sorted by start, then kind as listed."""
    scratch = Scratch(docs.sparkSession, "pii")
    rows = scratch.save(candidates(docs.select("doc_id", "text")), "candidates")
    each = rows.select(F.explode("c").alias("x")).select("x.k", "x.v", "x.f")
    counted = each.groupBy("k", *[F.col(f"v.{name}").alias(name) for name in LABELERS]).agg(F.count("*").alias("n")).collect()
    prob, _ = estimate([(r["k"], tuple(r[name] for name in LABELERS), r["n"]) for r in counted])  # at most 4 x 3^5 rows
    code = F.concat_ws("|", F.col("k"), *[F.col(f"v.{name}") for name in LABELERS])
    known = _lookup({"|".join(map(str, (k, *v))): p for (k, v), p in prob.items()})
    votes = [F.concat(F.lit(name), F.col(f"v.{name}").cast("string")) for name in LABELERS]
    labelled = each.select("k", F.coalesce(known[code], F.lit(0.0)).alias("p"), F.concat("f", F.array(*votes)).alias("f"))
    sums = labelled.select("k", "p", F.explode("f").alias("f")).groupBy("k", "f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    totals = {r["k"]: (r["yes"], r["no"]) for r in labelled.groupBy("k").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()}
    weights = {}
    for r in sums.collect():  # feature values are bounded: lengths, digit counts, punctuation sets, edge characters
        yes, no = totals[r["k"]]
        weights[f"{r['k']}|{r['f']}"] = log((r["yes"] + smoothing) / (yes + 2 * smoothing)) - log((r["no"] + smoothing) / (no + 2 * smoothing))
    for k, (yes, no) in totals.items():
        weights[f"{k}|"] = log((yes + smoothing) / (no + smoothing))
    scored = rows.withColumn("w", _lookup(weights))
    vote_features = ", ".join(f"concat('{name}', x.v.{name})" for name in LABELERS)
    score = f"""aggregate(concat(array(''), x.f, array({vote_features})), cast(0 as double),
                (a, f) -> a + coalesce(w[concat(x.k, '|', f)], cast(0 as double)))"""
    limit = log(min_probability / (1 - min_probability))
    slim = "x -> named_struct('s', x.s, 'k', x.k, 'e', x.e)"
    return scored.select(
        "doc_id",
        F.expr(f"array_sort(transform(filter(c, x -> x.base), {slim}))").alias("base"),
        F.expr(f"""array_sort(transform(filter(c, x -> x.base or (x.v.rule > 0 and {score} >= {limit}
                   and not exists(c, y -> y.base and y.s < x.e and x.s < y.e))), {slim}))""").alias("spans"),
    )


def _lookup(values: dict[str, float]) -> Column:
    if not values:
        return F.expr("cast(map() as map<string,double>)")
    return F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*[F.lit(float(v)) for v in values.values()]))


def joined(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')")


def count_of(spans: str, kind: str) -> Column:
    return F.expr(f"cast(size(filter({spans}, x -> x.k = {KINDS.index(kind)})) as long)")
