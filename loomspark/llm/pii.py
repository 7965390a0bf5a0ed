"""Personal data by weak supervision, with DataFrame functions only.

Regex labelers with their checks (length, Luhn, parts up to 255) give the base spans, which always stay. Looser
patterns add candidates of the same kinds (obfuscated addresses, national numbers, grouped cards, long IP addresses) and
of one more, ``secret`` (access keys, tokens and passwords). On every candidate labelers vote: the pattern, the check, a
gazetteer of cue words just before the span, the characters around it, and its shape. Expectation-maximisation over the
counts of vote patterns (at most 2**5 a kind, so a table of fixed size) estimates each labeler's reliability and the
probability that a candidate is personal data. These probabilities, weighted by the counts, train the final classifier: a
naive Bayes model over the votes and the span's length class. A looser candidate becomes a span if this model scores it
at 0.5 or more and it overlaps no base span; no labeler decides alone. A candidate of a strict pattern whose check fails
is a lesson for the model and never a span.

Positions are code points, end exclusive. They come from the pieces between matches: the text is split by the
pattern and the lengths of pieces and matches are added up, so no text leaves the JVM and no row is exploded
unless it has a candidate. Work is in proportion to the text, however many matches it has.

Nulls: a null text is empty; a null doc_id stays null. Rows that repeat an id are kept apart. Empty tables give
empty results; extra columns are not read. Very long digit runs are matched by possessive loops, which need no stack.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize

KINDS = ("email", "ip", "card", "phone")
#: Kinds of which there are looser candidates only come after the others.
ALL_KINDS = (*KINDS, "secret")

# Base patterns, written so that Java needs neither backtracking over a run nor recursion. They match what these do:
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+
#   phone \+[0-9][\x20().0-9-]+[0-9]
# A match can only begin inside a run of its first characters right after the match before (\G).
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Looser candidates: obfuscated addresses, national phone numbers, grouped or 13-digit card numbers, long IP addresses,
# assignments to a secret's name and long tokens of letters and digits. Lengths are the formats' own.
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?[\[(] ?at ?[\])] ?[a-z0-9-]{1,63}+(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[a-z0-9-]{1,63}+){1,6}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}[. /][0-9]{4}[. /][0-9]{4}[. /][0-9]{1,4}(?![0-9])",
    "phone": r"(?<![0-9+(])(?:\([0-9]{2,5}\) ?|0?[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,5}(?![0-9])",
    "secret": r"(?i)(?<![a-z0-9])(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)[\"']?\s?[=:]\s?[\"']?[^\s\"',;]{6,}+|(?<![a-z0-9_+/-])(?=[a-z_+/-]*+[0-9])(?=[0-9_+/-]*+[a-z])[a-z0-9_+/-]{20,}+",
}
#: A text without these characters has no match, and most texts are spared the pattern.
NEEDS = {"email": r"@|(?i)[\[(] ?at ?[\])]", "ip": r"[0-9]\.[0-9]|:[0-9A-Fa-f]{1,4}:", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]|[0-9][ .-][0-9]|\([0-9]", "secret": r"(?i)(?:password|passwd|pwd|token|secret|key)[\"']?\s?[=:]|[a-z0-9_+/-]{20}"}
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|courriel|correo|kontakt|reach)\W*(?:\w+\W+)?$",
    "ip": r"(?i)\b(?:ip|ipv[46]|address|host|server|adresse|direcci.n|from)\W*(?:\w+\W+)?$",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|carte|tarjeta|karte|payment|iban|account)\W*(?:\w+\W+)?$",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|t.l.phone|llame|telefon|tel.fono|whatsapp|sms)\W*(?:\w+\W+)?$",
    "secret": r"(?i)\b(?:password|passwd|pwd|token|secret|key|credentials?|login|bearer|aws|auth\w*)\W*(?:\w+\W+)?$",
}
CONTEXT = 40  # characters before a candidate that the cue labeler sees
VOTES = ("strict", "check", "cue", "edges", "shape")
ROUNDS = 50
BLOCK = 500  # matches that one inner fold adds up
_MATCH = "struct<kind:string,strict:boolean,start:int,match:string,before:string,after:string>"


def _starts(text: Column, pattern: str, kind: str, strict: bool) -> Column:
    """Array of a pattern's matches with their starts and what stands around them, from split pieces and their lengths.

    Folds of BLOCK matches run inside a fold over blocks, so that a text with very many matches costs no square of them.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(f"array<{_MATCH}>")

    def whole(both):
        ps, ms = both["ps"], both["ms"]

        def step(acc, i):
            piece, match = F.element_at(ps, i), F.element_at(ms, i)
            start = acc["at"] + F.length(piece)
            item = F.struct(F.lit(kind).alias("kind"), F.lit(strict).alias("strict"), start.alias("start"), match.alias("match"), F.substring(piece, -CONTEXT, CONTEXT).alias("before"), F.substring(F.element_at(ps, i + 1), 1, 1).alias("after"))
            return F.struct((start + F.length(match)).alias("at"), F.concat(acc["out"], F.array(item)).alias("out"))

        def block(acc, b):
            some = F.sequence(b * BLOCK + 1, F.least((b + 1) * BLOCK, F.size(ms)))
            inner = F.aggregate(some, F.struct(acc["at"].alias("at"), none.alias("out")), step)
            return F.get(F.transform(F.array(inner), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out"))), F.lit(0))

        blocks = F.sequence(F.lit(0), F.floor((F.size(ms) - 1) / BLOCK).cast("int"))
        return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{_MATCH}>>").alias("out")), block, lambda acc: F.flatten(acc["out"]))

    made = F.get(F.transform(F.array(F.struct(pieces.alias("ps"), found.alias("ms"))), whole), F.lit(0))
    return F.when(text.rlike(pattern), made).otherwise(none)


def _luhn(digits: Column) -> Column:
    """Luhn's check of a digit string."""
    n = F.length(digits)
    doubled = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + F.when((n - i) % 2 == 1, doubled(_digit(digits, i))).otherwise(_digit(digits, i)))
    return total % 10 == 0


def _digit(digits: Column, i: Column) -> Column:
    return digits.substr(i, F.lit(1)).cast("int")


def _valid(kind: Column, match: Column) -> Column:
    """The kind's check of a match."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    parts = F.forall(F.split(match, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(p.try_cast("decimal(38,0)"), F.lit(999)) <= 255))
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", parts)
        .when(kind == "card", F.when(n.between(14, 19), _luhn(digits)).otherwise(F.lit(False)))
        .when(kind == "secret", match.rlike("[0-9]") & match.rlike("[A-Za-z]"))
        .otherwise(n.between(10, 15))
    )


def candidates(docs: DataFrame) -> DataFrame:
    """One row per candidate span: row, kind, base (strict pattern and check passed), strict, start, stop, votes."""
    text = F.col("text")
    none = F.array().cast(f"array<{_MATCH}>")
    lists = [F.when(text.rlike(NEEDS[kind]), _starts(text, pattern, kind, strict)).otherwise(none) for strict, patterns in ((True, BASE), (False, LOOSE)) for kind, pattern in patterns.items()]
    found = docs.withColumn("found", F.concat(*lists)).filter(F.size("found") > 0)
    rows = found.select("row", F.explode("found").alias("m")).select("row", "m.*", (F.col("m.start") + F.length("m.match")).alias("stop"))
    kind, match = F.col("kind"), F.col("match")
    # a looser candidate is held against what its kind's check asks of the plain form
    plain = F.when(kind == "card", F.regexp_replace(match, "[^0-9]", "")).otherwise(match)
    valid = F.when(F.col("strict"), _valid(kind, match)).otherwise(F.when(kind.isin("card", "phone", "secret"), _valid(kind, plain)).otherwise(F.lit(True)))
    cue = F.lit(False)
    for k in ALL_KINDS:
        cue = F.when(kind == k, F.col("before").rlike(CUES[k])).otherwise(cue)
    cue = cue | ((kind == "secret") & match.rlike(r"[=:]"))  # an assignment carries its cue
    n = F.length(F.regexp_replace(match, "[^0-9]", ""))
    shape = (
        F.when(kind == "email", match.rlike(r"(?i)(?:\.|dot[\])]? ?)(?:[a-z]{2,6})$"))
        .when(kind == "ip", ~match.rlike(r"^0\."))
        .when(kind == "card", n.isin(15, 16) & match.rlike(r"^(?:3[47]|4|5[1-5]|6011|65)"))
        .when(kind == "secret", match.rlike(r"^(?:AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|eyJ|AIza)|(?:^|[=:\s\"'])[0-9a-f]{12,}+[\"']?$|(?:^|[=:\s\"'])[A-Z0-9]{16,}+[\"']?$"))
        .otherwise(match.rlike(r"^\+[1-9]|^\(") & n.between(10, 13))
    )
    edges = ~F.substring(F.col("before"), -1, 1).rlike(r"[\p{L}\p{N}_@/=+-]") & ~F.col("after").rlike(r"[\p{L}\p{N}_@/=]")
    size = F.length(match)
    return rows.select(
        "row", "kind", (F.col("strict") & valid).alias("base"), "strict", "start", "stop",
        F.col("strict").cast("int").alias("v_strict"), valid.cast("int").alias("v_check"), cue.cast("int").alias("v_cue"), edges.cast("int").alias("v_edges"), F.coalesce(shape, F.lit(False)).cast("int").alias("v_shape"),
        F.when(size < 12, 0).when(size < 16, 1).when(size < 24, 2).when(size < 40, 3).otherwise(4).alias("size_class"),
    )


def expectation_maximisation(counts: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[float], list[float], dict[tuple[int, ...], float]]:
    """(prior, P(vote | personal), P(vote | not), P(personal | votes)) of binary labelers from the counts of vote patterns."""
    total = sum(n for _, n in counts)
    k = len(counts[0][0]) if counts else len(VOTES)
    post = {v: 0.02 + 0.96 * sum(v) / max(1, k) for v, _ in counts}  # majority vote to begin with
    prior, yes, no = 0.5, [0.5] * k, [0.5] * k
    for _ in range(rounds if total else 0):
        pos = sum(n * post[v] for v, n in counts)
        prior = min(0.999, max(0.001, (pos + 1) / (total + 2)))
        yes = [(sum(n * post[v] * v[i] for v, n in counts) + 1) / (pos + 2) for i in range(k)]
        no = [(sum(n * (1 - post[v]) * v[i] for v, n in counts) + 1) / (total - pos + 2) for i in range(k)]
        for v, _ in counts:
            a = math.log(prior) + sum(math.log(p if x else 1 - p) for x, p in zip(v, yes, strict=True))
            b = math.log(1 - prior) + sum(math.log(p if x else 1 - p) for x, p in zip(v, no, strict=True))
            post[v] = 1 / (1 + math.exp(min(700.0, b - a)))
    if total and sum(n * post[v] * sum(v) for v, n in counts) * (total - sum(n * post[v] for v, n in counts)) < sum(n * (1 - post[v]) * sum(v) for v, n in counts) * sum(n * post[v] for v, n in counts):
        post = {v: 1 - p for v, p in post.items()}  # the class with more votes is the personal one
        prior, yes, no = 1 - prior, no, yes
    return prior, yes, no, post


def train(cands: DataFrame) -> dict[str, tuple[float, list[float], list[float]]]:
    """Per kind: the classifier's bias and its log-odds for each vote and size class.

    Only counts by (kind, votes, size class) reach the driver: at most 5 * 32 * 5 rows, whatever the input's size.
    """
    votes = [f"v_{v}" for v in VOTES]
    table = cands.groupBy("kind", *votes, "size_class").count().collect()
    out = {}
    for kind in ALL_KINDS:
        rows = [(tuple(r[v] for v in votes), r["size_class"], r["count"]) for r in table if r["kind"] == kind]
        by: dict[tuple[int, ...], int] = {}
        for v, _, n in rows:
            by[v] = by.get(v, 0) + n
        prior, yes, no, post = expectation_maximisation(sorted(by.items()))
        # the final classifier is fitted to the posteriors; size classes are a feature that no labeler has
        pos = sum(n * post[v] for v, _, n in rows)
        neg = sum(n * (1 - post[v]) for v, _, n in rows)
        size = [math.log((sum(n * post[v] for v, s, n in rows if s == c) + 1) / (pos + 5)) - math.log((sum(n * (1 - post[v]) for v, s, n in rows if s == c) + 1) / (neg + 5)) for c in range(5)]
        bias = math.log((pos + 1) / (neg + 1))
        odds = [x for i in range(len(VOTES)) for x in (math.log(1 - yes[i]) - math.log(1 - no[i]), math.log(yes[i]) - math.log(no[i]))]
        out[kind] = (bias, odds, size)
    return out


def score(cands: DataFrame, model: dict[str, tuple[float, list[float], list[float]]]) -> DataFrame:
    """Adds ``probability`` of each candidate."""
    logit = F.lit(0.0)
    for kind, (bias, odds, size) in model.items():
        x = F.lit(bias)
        for i, v in enumerate(VOTES):
            x = x + F.when(F.col(f"v_{v}") == 1, odds[2 * i + 1]).otherwise(odds[2 * i])
        x = x + F.element_at(F.array(*[F.lit(s) for s in size]), F.col("size_class") + 1)
        logit = F.when(F.col("kind") == kind, x).otherwise(logit)
    return cands.withColumn("probability", 1 / (1 + F.exp(-logit)))


def find(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document row: doc_id, the base counts and digest, all spans and their number."""
    base = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = base.select("doc_id")
    n = ids.agg(F.count("doc_id").alias("n"), F.count_distinct("doc_id").alias("d"), F.count(F.lit(1)).alias("all")).first()
    if n["n"] == n["d"] == n["all"]:
        rows = base.withColumn("row", F.col("doc_id"))
    else:  # ids that are null or repeat: number the rows once, in a written table
        rows = materialize(base.withColumn("row", F.monotonically_increasing_id()), "pii-rows")
    cands = materialize(candidates(rows), "pii-candidates")
    scored = score(cands, train(cands)).filter(F.col("base") | (~F.col("strict") & (F.col("probability") >= threshold)))
    # an added span goes if a base span overlaps it: one that begins no later and ends after its start, or the next one that begins
    w = W.partitionBy("row").orderBy("start", "stop")
    to, at = F.when(F.col("base"), F.col("stop")), F.when(F.col("base"), F.col("start"))
    reach = F.max(to).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    follows = F.min(at).over(w.rowsBetween(W.currentRow, W.unboundedFollowing))
    scored = scored.withColumn("hit", ~F.col("base") & (F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(follows < F.col("stop"), F.lit(False)))).filter("not hit")
    order = F.create_map(*[x for i, k in enumerate(ALL_KINDS) for x in (F.lit(k), F.lit(i))])
    item = F.struct("start", order[F.col("kind")].alias("rank"), "kind", "stop", "base")
    # a document's spans are as many as its text holds; grouping by row keeps them with it
    by = scored.groupBy("row").agg(F.array_sort(F.collect_set(item)).alias("s"))
    show = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    base_only = F.filter("s", lambda x: x["base"])
    of = lambda k: F.size(F.filter("s", lambda x: x["base"] & (x["kind"] == k))).cast("long")
    per = by.select("row", *[of(k).alias(f"n_{k}") for k in KINDS], F.sha2(show(base_only), 256).alias("base_sha256"), show(F.col("s")).alias("spans"), F.size("s").cast("long").alias("n_spans"))
    out = rows.select("row", "doc_id").join(per, "row", "left")
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS], F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"))
