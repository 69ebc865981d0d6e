"""Personal data by weak supervision (operator 9).

Base rules are patterns with checks; their spans always stay.  Looser patterns
give further candidates.  On every candidate five labelers vote for, against
or not at all: the base rule, a check of its form, a gazetteer, words around
it and the characters at its borders.  Expectation-maximisation over the
counts of vote patterns in the whole corpus estimates how reliable each
labeler is, and its posteriors train a logistic span classifier, which decides
on the candidates that no base rule holds.  DataFrame functions only; what
reaches the driver is a table of counts by votes and form, of bounded size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binsight.llm.catalog import register
from binsight.llm.common import fresh, table, written

KINDS = ("email", "ip", "card", "phone")
#: Possessive quantifiers and the look-behinds only spare the matcher work: the matches are those of the plain patterns.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?[\[(]\x20?(?:at|AT)\x20?[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(]\x20?(?:dot|DOT)\x20?[\])])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,18}+(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{2,4}\)\x20?|[0-9]{3}[.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
}
#: What a text must contain for a pattern to be tried on it.
NEEDS = {("email", "base"): "@", ("phone", "base"): "+", ("ip", "base"): ".", ("ip", "loose"): ":"}
NEEDS_MATCH = {("card", "base"): r"[0-9](?:[\x20-]?[0-9]){11}", ("card", "loose"): r"[0-9](?:[\x20-]?[0-9]){12}",
                ("phone", "loose"): r"[0-9]{3}[\x20.-][0-9]{3}", ("email", "loose"): r"[\[(]\x20?(?:at|AT)\x20?[\])]"}
LABELERS = ("rule", "form", "gazetteer", "context", "border")
CONTEXT, BORDER = 40, 1
CUES = {
    "email": r"(?i)mail|contact|write|kontakt|correo|courriel|@",
    "ip": r"(?i)\bip\b|host|server|addr|adress|direcci|login",
    "card": r"(?i)card|visa|master|amex|karte|tarjeta|carte|credit",
    "phone": r"(?i)phone|call|tel|mobil|fax|anruf|llam|appel",
}
COUNTER = r"(?i)version|isbn|order|invoice|serial|\bid\b|\bno\b|build|§|page"
#: Gazetteers: top-level domains, issuers' first digits, country codes.
DOMAINS = r"(?i)\.\x20?(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu|it|nl|ch|at|us|ca)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[4-8]|6)"
COUNTRIES = r"^\+\x20?(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
RESERVED = r"^(?:0+|10|127|255|192\.168|169\.254)\."
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


def _cut(text: Column, pattern: str) -> Column:
    """The text in turns of what doesn't match and what does."""
    return F.split(F.regexp_replace(text, F.lit(pattern), F.lit("\u0001$0\u0001")), "\u0001", -1)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total, i):
        x = F.substr(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def holds(kind: str, hit: Column) -> Column:
    """Whether a match of a base pattern passes its check."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return hit.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    n = F.length(_digits(hit))
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(12, 19), luhn(_digits(hit))).otherwise(False)


def _vote(against: Column, for_: Column) -> Column:
    return F.when(for_, 1).when(against, -1).otherwise(0)


def votes(kind: str, hit: Column, before: Column, after: Column, base: bool) -> list[Column]:
    yes, no = F.lit(True), F.lit(False)
    if kind == "email":
        form = _vote(yes, hit.rlike(r"[A-Za-z]{2}$"))
        gazetteer = _vote(no, hit.rlike(DOMAINS))
    elif kind == "ip":
        form = _vote(yes, ~hit.rlike(r"(?:^|\.)0[0-9]"))
        gazetteer = _vote(hit.rlike(RESERVED), ~hit.rlike(RESERVED))
    elif kind == "card":
        form = F.lit(1) if base else F.when(luhn(_digits(hit)), 1).otherwise(-1)
        gazetteer = _vote(yes, _digits(hit).rlike(ISSUERS))
    else:
        form = _vote(yes, F.length(_digits(hit)).between(9, 15))
        gazetteer = _vote(hit.startswith("+"), hit.rlike(COUNTRIES))
    context = _vote(before.rlike(COUNTER), before.rlike(CUES[kind]))
    inside = F.right(before, F.lit(1)).rlike(r"[\p{L}\p{N}_]") | F.left(after, F.lit(1)).rlike(r"[\p{L}\p{N}_]")
    return [F.lit(1 if base else 0), form, gazetteer, context, _vote(inside, ~inside)]


def _judged(kind: str, base: bool, parts: Column, i: Column) -> list[Column]:
    """Votes and form of the i-th part (from 0), which matches."""
    hit, before = F.element_at(parts, i + 1), F.right(F.element_at(parts, i), F.lit(CONTEXT))
    after = F.left(F.element_at(parts, i + 2), F.lit(BORDER))
    own = [v.cast("int").alias(name) for v, name in zip(votes(kind, hit, before, after, base), LABELERS, strict=True)]
    return [*own, F.least(F.floor(F.length(hit) / 4), F.lit(7)).cast("int").alias("length"),
            hit.rlike(r"[\x20-]").cast("int").alias("parted")]


def _spans(kind: str, base: bool, parts: Column) -> Column:
    """Candidates in ``parts``: start, no (of the kind), end, base, votes and form."""
    number = KINDS.index(kind)
    shape = f"array<struct<start:int,no:int,end:int,base:boolean,{','.join(f'{x}:int' for x in LABELERS)},length:int,parted:int>>"

    def add(acc, part):
        size, i = F.length(part), acc["i"]
        keep = (i % 2 == 1) & (holds(kind, part) if base else F.lit(True))
        span = F.struct(acc["at"].alias("start"), F.lit(number).alias("no"), (acc["at"] + size).alias("end"),
                        F.lit(base).alias("base"), *_judged(kind, base, parts, i))
        return F.struct((acc["at"] + size).alias("at"), (i + 1).alias("i"),
                        F.when(keep, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).cast(shape).alias("found"))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast(shape).alias("found"))
    none = F.array().cast(shape)
    return F.when(F.size(parts) > 1, F.aggregate(parts, start, add, lambda acc: acc["found"])).otherwise(none)


def _tried(kind: str, how: str, text: Column) -> Column:
    if need := NEEDS.get((kind, how)):
        return text.contains(need)
    return text.rlike(NEEDS_MATCH[kind, how])


def candidates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, any more) -> doc_id, base and loose: arrays of candidate spans."""
    keep = ["doc_id"]
    text = F.translate(F.coalesce("text", F.lit("")), "\u0001", "\u0002")  # the mark of a cut; no pattern has either
    rows = docs.select(*keep, text.alias("_text"))
    whole = F.array().cast("array<string>")
    cuts = {(k, how): F.when(_tried(k, how, F.col("_text")), _cut(F.col("_text"), p)).otherwise(whole).alias(f"_{k}_{how}")
            for how, patterns in (("base", BASE), ("loose", LOOSE)) for k, p in patterns.items()}
    rows = rows.select(*keep, *cuts.values())
    rows = rows.select(*keep, *(F.concat(*(_spans(k, how == "base", F.col(f"_{k}_{how}")) for k in KINDS)).alias(how)
                                for how in ("base", "loose")))
    clear = F.filter("loose", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return rows.select(*keep, F.array_sort("base").alias("base"), clear.alias("loose"))


def _features(kind: str, row) -> list[str]:
    return ([f"{kind}"] + [f"{x}={row[x]}" for x in LABELERS[1:]]
            + [f"{kind} length={row['length']}", f"{kind} parted={row['parted']}"])


def estimated(counts: list, rounds: int = 30) -> list[float]:
    """Expectation-maximisation: the probability that candidates of each row are personal data.

    ``counts``: rows of no, votes and n.  Labelers are taken as independent
    given the truth; the votes' majority is the first guess.
    """
    post = [1 / (1 + math.exp(-sum(r[x] for x in LABELERS))) for r in counts]
    for _ in range(rounds if counts else 0):
        prior = {}
        for no in {r["no"] for r in counts}:
            own = [(q, r["n"]) for q, r in zip(post, counts, strict=True) if r["no"] == no]
            prior[no] = (sum(q * n for q, n in own) + 1) / (sum(n for _, n in own) + 2)
        said = {}
        for x in LABELERS:
            for y in (0, 1):
                mass = {v: 1.0 for v in (-1, 0, 1)}
                for q, r in zip(post, counts, strict=True):
                    mass[r[x]] += r["n"] * (q if y else 1 - q)
                total = sum(mass.values())
                for v, m in mass.items():
                    said[x, y, v] = math.log(m / total)
        post = [1 / (1 + math.exp(min(500, max(-500, math.log(1 - prior[r["no"]]) - math.log(prior[r["no"]])
                                              + sum(said[x, 0, r[x]] - said[x, 1, r[x]] for x in LABELERS))))) for r in counts]
    return post


def fitted(counts: list, post: list[float], rounds: int = 200, rate: float = 1.0, decay: float = 1e-3) -> dict[str, float]:
    """Logistic regression on the posteriors: weights by feature."""
    weight: dict[str, float] = {}
    slope: dict[str, float] = {}
    # counts weigh by their logarithm: a frequent form doesn't silence the others
    rows = [(_features(KINDS[r["no"]], r), q, 1 + math.log(r["n"])) for r, q in zip(counts, post, strict=True)]
    mass = sum(n for _, _, n in rows)
    for _ in range(rounds):
        grad: dict[str, float] = {}
        for names, q, n in rows:
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, sum(weight.get(x, 0.0) for x in names)))))
            for x in names:
                grad[x] = grad.get(x, 0.0) + n * (p - q) / mass
        for x, g in grad.items():
            g += decay * weight.get(x, 0.0)
            slope[x] = slope.get(x, 1e-9) + g * g
            weight[x] = weight.get(x, 0.0) - rate * g / math.sqrt(slope[x])
    return weight


def train(found: DataFrame) -> dict[str, float]:
    """Weights of the span classifier from all candidates (base, loose) of a corpus."""
    by = ["no", *LABELERS, "length", "parted"]
    counts = (found.select(F.explode(F.concat("base", "loose")).alias("s")).select("s.*").groupBy(*by)
              .agg(F.count("*").alias("n")).orderBy(*by).collect())  # at most 4 * 3^5 * 8 * 2 rows
    return fitted(counts, estimated(counts))


def accepted(kind: Column, form: list[tuple[str, Column]], weights: dict[str, float]) -> Column:
    """Whether the classifier takes a candidate of these votes and this form as personal data."""
    if not weights:
        return F.lit(False)
    known = F.create_map(*[F.lit(x) for k, v in sorted(weights.items()) for x in (k, v)])
    names = [kind] + [F.concat(F.lit(f"{x}="), v.cast("string")) for x, v in form if x in LABELERS[1:]]
    names += [F.concat(kind, F.lit(f" {x}="), v.cast("string")) for x, v in form if x in ("length", "parted")]
    score = F.lit(0.0)
    for name in names:
        score = score + F.coalesce(F.try_element_at(known, name), F.lit(0.0))
    return score >= 0


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["no"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, any more) -> a row per row: doc_id, n_email, n_ip,
    n_card, n_phone, base_sha256, spans, n_added.

    Null texts count as empty: no spans.  Spans are in code points, end
    exclusive; added ones have the base rules' kinds.  No rows in, no rows out.
    """
    found = written(candidates(docs.select("doc_id", "text")), "pii")
    weights = train(found)
    kinds = F.array(*map(F.lit, KINDS))
    form = lambda s: [(x, s[x]) for x in (*LABELERS, "length", "parted")]
    added = F.filter("loose", lambda s: accepted(F.element_at(kinds, s["no"] + 1), form(s), weights))
    rows = found.withColumn("added", added)
    numbers = F.transform("base", lambda s: s["no"])
    counts = [F.size(F.filter(numbers, lambda no: no == F.lit(KINDS.index(k)))).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
                       _joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def _replaced(kind: str, how: str, weights: dict[str, float], cuts: str):
    """For transform(): a part that is personal data becomes its kind, others stay."""
    def part(x, i):
        if how == "base":
            judged = holds(kind, x)
        else:
            form = zip((*LABELERS, "length", "parted"), _judged(kind, False, F.col(cuts), i), strict=True)
            judged = accepted(F.lit(kind), list(form), weights)
        return F.when((i % 2 == 1) & judged, F.lit(f"[{kind.upper()}]")).otherwise(x)

    return part


def redacted(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """All columns of docs, with personal data in text replaced by its kind in brackets.

    Kind after kind, base rules before loose ones: what an earlier kind has
    replaced no later one sees.  A null text stays null.
    """
    out, cuts = fresh("_text", docs.columns), fresh("_parts", docs.columns)
    rows = docs.withColumn(out, F.col("text"))
    for how, patterns in (("base", BASE), ("loose", LOOSE)):
        for kind, pattern in patterns.items():
            clean = F.translate(out, "\u0001", "\u0002")
            rows = rows.withColumn(cuts, F.when(_tried(kind, how, F.col(out)), _cut(clean, pattern)))
            whole = F.array_join(F.transform(cuts, _replaced(kind, how, weights, cuts)), "")
            rows = rows.withColumn(out, F.when(F.size(cuts) > 1, whole).otherwise(F.col(out))).drop(cuts)
    return rows.withColumn("text", F.col(out)).drop(out)


@register("op9_pii")
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal(table(spark, sf_dir, "documents"))
