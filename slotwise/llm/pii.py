"""Personal data: base spans by fixed patterns, further spans by weak supervision. DataFrame functions only.

Base kinds are email, ip, card and phone, each the leftmost non-overlapping matches of its pattern that pass the kind's own
check; a match that fails is dropped and not tried again at a later character. They are always reported.

Further candidates are runs of eight or more of ``[A-Za-z0-9_+/-]`` that hold a digit and overlap no base span: keys, tokens
and passwords. Labelers vote yes, no or nothing on every candidate: by its pattern, by gazetteers (words of
credentials, known issuer prefixes, common endings of hosts) and by the text before it. Expectation maximisation over the counts
of vote patterns, of which there is a fixed number, estimates the reliability of each labeler and a posterior for each pattern;
a logistic span classifier on votes and shape is trained on these posteriors, and decides. It is a plain expression, so both
passes over the texts read each row by itself and shuffle nothing but the counts.

A null text counts as empty: no span. Without candidates the classifier keeps its starting weights. Ties: spans
are ordered by start, then by kind in the order above, "secret" last. Repeated rows give repeated results. Possessive patterns
keep the time linear for long runs of one class.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import written

KINDS = ("email", "ip", "card", "phone", "secret")

# A match can only begin where its first run begins or where the last match ended; saying so keeps the search linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SECRET = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{8,}+"

#: Where a pattern cannot match, texts are passed over cheaply.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "secret": r"[0-9]"}
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "secret": SECRET}

# Gazetteers of the labelers: words that name a credential, first digits of card issuers, ends of host names.
CREDENTIAL_WORDS = ("password", "passwd", "pwd", "token", "secret", "apikey", "api_key", "api-key", "access_key", "auth", "bearer", "credential")
ISSUER_PREFIXES = ("34", "35", "36", "37", "38", "4", "51", "52", "53", "54", "55", "6011", "62", "65")
HOST_ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu")

CONTEXT_CHARS = 24
EM_ROUNDS = 8
FIT_ROUNDS = 15


def found(text: Column, kind: str) -> Column:
    """array<struct<start, end, value, before>>: all matches of the kind's pattern, in code points, and the text before each."""
    pattern = F.lit(PATTERNS[kind])
    parts = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(0)).alias("value"), F.split(text, PATTERNS[kind], -1).alias("gap"))
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def add(state: Column, part: Column) -> Column:
        begin = state["at"] + F.length(part["gap"])
        end = begin + F.length(part["value"])
        one = F.struct(begin.alias("start"), end.alias("end"), part["value"].alias("value"), F.right(part["gap"], F.lit(CONTEXT_CHARS)).alias("before"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(one)).alias("spans"))

    matched = F.filter(parts, lambda p: p["value"].isNotNull())
    spans = F.aggregate(matched, start, add, lambda s: s["spans"])
    return F.when(text.rlike(HINTS[kind]), spans).otherwise(none)


def passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def of_kind(text: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.transform(
        F.filter(found(text, kind), lambda s: passes(kind, s["value"])),
        lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), s["value"].alias("value"), s["before"].alias("before")),
    )


# -- labelers -------------------------------------------------------------------------------------------------------


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(rank: Column, value: Column, before: Column) -> dict[str, Column]:
    """1 (personal), -1 (not) or 0 (no opinion) of each labeler on one candidate."""
    low, near = F.lower(value), F.lower(before)
    digits = F.regexp_replace(value, "[^0-9]", "")
    ending = F.regexp_extract(low, r"\.([a-z0-9-]+)$", 1)
    secret = rank == KINDS.index("secret")
    credential = "(" + "|".join(CREDENTIAL_WORDS) + r")['\"]?\s*(:|=|is)?\s*['\"]?$"
    return {
        "pattern": _vote(low.rlike("^(?=.*[a-f])[0-9a-f]{12,}$") | low.rlike("^(sk|pk|ghp|akia)[_-]?[a-z0-9]{12,}$") | ~secret, low.rlike("^[a-z]+[0-9]{1,2}$|^[0-9/_+-]+$") & secret),
        "gazetteer": F.when(rank == 0, _vote(ending.isin(*HOST_ENDINGS), ending == ""))
        .when(rank == 2, _vote(digits.rlike("^(" + "|".join(ISSUER_PREFIXES) + ")"), digits.rlike("^0")))
        .when(secret, _vote(low.rlike("^(" + "|".join(CREDENTIAL_WORDS) + ")"), low.rlike("(isbn|http|www|version|page)")))
        .otherwise(0),
        "context": _vote(near.rlike(credential), near.rlike(r"(isbn|page|version|chapter|figure|no\.)\s*$")),
        "mixture": _vote(low.rlike("[0-9][a-z]+[0-9]") & (F.length(digits) * 4 >= F.length(value)), low.rlike("^[0-9]+$") & secret),
        "length": _vote(F.length(value) >= 16, F.length(value) < 10),
    }


LABELERS = ("pattern", "gazetteer", "context", "mixture", "length")


def shape(value: Column) -> dict[str, Column]:
    """Coarse features, so that candidates fall into a fixed number of groups."""
    size = F.length(value)
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return {
        "long": F.least(F.floor(size / 8), F.lit(4)) / 4,
        "digits": F.floor(4 * digits / F.greatest(size, F.lit(1))) / 4,
    }


@dataclass
class SpanModel:
    """Reliabilities by labeler, P(vote | truth), and the weights of the span classifier."""

    prior: float = 0.5
    given_yes: dict[str, tuple[float, float]] = field(default_factory=lambda: {x: (0.6, 0.1) for x in LABELERS})
    given_no: dict[str, tuple[float, float]] = field(default_factory=lambda: {x: (0.1, 0.6) for x in LABELERS})
    bias: float = 0.0
    weights: dict[str, float] = field(default_factory=lambda: {x: 1.0 for x in LABELERS} | {"long": 0.0, "digits": 0.0})

    def posterior(self, vote: dict[str, Column]) -> Column:
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for name in LABELERS:
            (yes1, yes0), (no1, no0) = self.given_yes[name], self.given_no[name]
            odds = odds + F.when(vote[name] == 1, math.log(yes1 / no1)).when(vote[name] == -1, math.log(yes0 / no0)).otherwise(
                math.log((1 - yes1 - yes0) / (1 - no1 - no0))
            )
        return 1 / (1 + F.exp(-odds))

    def probability(self, feature: dict[str, Column]) -> Column:
        total = F.lit(self.bias)
        for name, weight in self.weights.items():
            total = total + F.lit(weight) * feature[name]
        return 1 / (1 + F.exp(-total))


def learned(docs: DataFrame, em_rounds: int = EM_ROUNDS, fit_rounds: int = FIT_ROUNDS) -> SpanModel:
    """EM over the counts of vote patterns, then logistic regression on its posteriors, by aggregates of one row each."""
    text = F.coalesce("text", F.lit(""))
    each = docs.select(F.explode(F.concat(*(of_kind(text, k) for k in KINDS))).alias("c"))
    ballot = votes(F.col("c.rank"), F.col("c.value"), F.col("c.before")) | shape(F.col("c.value"))
    counts = written(each.select(*(v.alias(k) for k, v in ballot.items())).groupBy(*ballot).agg(F.count("*").alias("n")), "votes").coalesce(1)
    column = {k: F.col(k) for k in ballot}

    model = SpanModel()
    for _ in range(em_rounds):
        q = model.posterior(column)
        sums = counts.withColumn("q", q).agg(
            F.sum("n").alias("all"),
            F.sum(F.col("n") * F.col("q")).alias("yes"),
            *(
                F.sum(F.when(F.col(x) == v, F.col("n") * (F.col("q") if truth else 1 - F.col("q"))).otherwise(0.0)).alias(f"{x}_{truth}_{k}")
                for x in LABELERS
                for truth in (1, 0)
                for k, v in enumerate((1, -1))
            ),
        ).first()
        if not sums["all"]:
            return model
        yes, no = sums["yes"], sums["all"] - sums["yes"]
        smooth = 0.01 * sums["all"] + 1  # keeps every rate off 0 and 1
        model.prior = min(0.99, max(0.01, yes / sums["all"]))
        for x in LABELERS:
            model.given_yes[x] = tuple((sums[f"{x}_1_{k}"] + smooth) / (yes + 3 * smooth) for k in (0, 1))
            model.given_no[x] = tuple((sums[f"{x}_0_{k}"] + smooth) / (no + 3 * smooth) for k in (0, 1))

    aims = written(counts.withColumn("q", model.posterior(column)), "span-aims").coalesce(1)
    for _ in range(fit_rounds):
        p = model.probability(column)
        step = aims.withColumn("miss", F.col("n") * (F.col("q") - p)).agg(
            F.sum("n").alias("all"), F.sum("miss").alias("bias"), *(F.sum(F.col("miss") * F.col(x)).alias(x) for x in model.weights)
        ).first()
        model.bias += 4.0 * step["bias"] / step["all"]
        for x in model.weights:
            model.weights[x] += 4.0 * (step[x] / step["all"] - 0.001 * model.weights[x])
    return model


def spans(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """The documents with ``base`` and ``spans``: array<struct<start, rank, end>>, in order. Kinds by rank are KINDS."""
    model = model or learned(docs)
    rows = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    slim = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))
    rows = rows.withColumn("base", F.sort_array(F.transform(F.concat(*(of_kind(F.col("_text"), k) for k in KINDS[:4])), slim)))

    def wanted(s: Column) -> Column:
        feature = votes(s["rank"], s["value"], s["before"]) | shape(s["value"])
        free = F.forall("base", lambda b: (b["end"] <= s["start"]) | (b["start"] >= s["end"]))
        return (model.probability(feature) >= 0.5) & free

    more = F.transform(F.filter(of_kind(F.col("_text"), "secret"), wanted), slim)
    return rows.withColumn("spans", F.sort_array(F.concat("base", more))).drop("_text")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def count_of(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(kind))).cast("long")


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; n_chars follows the text."""
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(state: Column, s: Column) -> Column:
        gap = F.substring("text", state["at"] + 1, s["start"] - state["at"])
        more = F.concat(state["parts"], F.array(gap, F.get(names, s["rank"])))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], more).otherwise(state["parts"]).alias("parts"))

    rest = lambda state: F.concat(F.array_join(state["parts"], ""), F.substring("text", state["at"] + 1, F.length("text")))
    text = F.when(F.size("spans") > 0, F.aggregate("spans", start, add, rest)).otherwise(F.col("text"))
    return spans(docs).select("doc_id", text.alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long"))
