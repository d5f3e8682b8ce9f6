"""Personal data by weak supervision, in DataFrame functions only.

Base spans come from fixed patterns with checks (octets, Luhn, digit counts). Looser patterns propose
more candidates. Labelers vote on every candidate, 1 for personal data, 0 against, or not at all:

* ``regex``: whether the strict pattern and its checks took it;
* ``gazetteer``: known top-level domains, calling codes, card issuers, reserved address blocks;
* ``context``: words before it that go with its kind, or with version, order and page numbers;
* ``form``: whether it stands alone or inside a longer word or number.

Candidates are summed up by kind, votes and form features, a table of a bounded number of rows.
Expectation-maximisation over it estimates how reliable each labeler is for each kind, without any
labels; the posteriors then train the final span classifier, naive Bayes over votes and features.
Base spans always stay; a looser candidate is added where the classifier gives it ``ACCEPT`` or more.

Positions are code points. ``regexp_extract_all`` gives the matches and ``split`` the text between
them, so their lengths add up to positions, and the pieces give each match its context; a long text with
many matches costs in proportion to both. The patterns are the plain ones in a form that Java
matches in linear time: a possessive quantifier where giving back cannot help, and a start at a run's
begin or at the last match's end, as every other start in the run ends the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versio.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOOSE_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\([Aa][Tt]\)|\[[Aa][Tt]\]|@)\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\([Dd][Oo][Tt]\)|\[[Dd][Oo][Tt]\])\x20?[A-Za-z0-9-]{1,63}+){1,8}+"
LOOSE_PHONE = r"(?<![0-9A-Za-z.+-])\(?[0-9]{2,4}+\)?(?:[\x20./-]\(?[0-9]{2,5}+\)?){2,5}+(?![0-9A-Za-z-])"

#: Gazetteers and context words, as fixed values.
DOMAINS = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "io", "co", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at", "be", "us", "ca", "au", "jp", "cn", "in", "br", "mx", "ar", "ru", "pl", "se", "no", "dk", "fi", "pt", "example", "test")
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "98")
WORDS_FOR = {
    "email": "mail|contact|write|reach|correo|courriel|adress",
    "ip": r"\bip\b|host|server|addr|login|client|node|proxy",
    "card": "card|visa|credit|pay|tarjeta|carte|karte|amex|master",
    "phone": "phone|tel|call|fax|mobile|cell|sms|whatsapp|llam|appel|ruf|handy",
}
WORDS_AGAINST = "version|release|isbn|issn|order|invoice|page|section|figure|table|build|serial|part no|item"
BEFORE = 32
VOTES, FORMS = ("regex", "gazetteer", "context", "form"), ("parts", "long")
ROUNDS, ACCEPT = 12, 0.9


#: Items that a fold appends to one array before it starts the next: appending copies the array.
RUN = 256
SPAN = "struct<s:int,e:int,m:string,before:string,after:string>"


def scanned(items: str, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], out: str) -> Column:
    """What ``step(state, item) -> (state, output)`` gives for each item of an array column, in order; ``out`` is the
    outputs' type. Arrays grow in runs of ``RUN``, so a text with many matches costs little more than in proportion."""
    none = F.expr(f"cast(array() as array<{out}>)")

    def one(seen: Column, x: Column) -> Column:
        after, made = step(seen["state"], x)
        return F.struct(after.alias("state"), F.concat(seen["out"], F.array(made)).alias("out"))

    def run(seen: Column, part: Column) -> Column:
        start = F.struct(seen["state"].alias("state"), none.alias("out"))
        return F.aggregate(part, start, one, lambda x: F.struct(x["state"].alias("state"), F.concat(seen["out"], x["out"]).alias("out")))

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / RUN).cast("int")), lambda i: F.slice(items, i * RUN + 1, F.lit(RUN)))
    return F.when(F.size(items) > 0, F.aggregate(runs, F.struct(state.alias("state"), none.alias("out")), run, lambda x: x["out"])).otherwise(none)


def located(docs: DataFrame, found: dict[str, tuple[str, Column]]) -> DataFrame:
    """``docs`` with an array of ``SPAN`` for each name: all matches of its pattern in the text (not null), leftmost and
    non-overlapping, with the ``BEFORE`` characters before and the one after; none where the condition is false.

    Positions and contexts come from the pieces between the matches, so the text is gone through once a pattern.
    """
    t, none = F.col("text"), F.expr("cast(array() as array<string>)")
    names = list(found)
    docs = docs.withColumns({f"_{x}_{k}": F.when(where, c).otherwise(none) for k, (pattern, where) in found.items()
                             for x, c in (("m", F.regexp_extract_all(t, F.lit(pattern), F.lit(0))), ("b", F.split(t, pattern, -1)))})

    def pieces(k: str) -> Column:
        m, b, n = f"_m_{k}", f"_b_{k}", F.size(f"_m_{k}")
        return F.arrays_zip(F.slice(b, F.lit(1), n).alias("p"), F.col(m).alias("m"), F.slice(b, F.lit(2), n).alias("q"), F.slice(m, F.lit(2), n).alias("r"))

    docs = docs.withColumns({f"_z_{k}": pieces(k) for k in names})

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        s = state["at"] + F.char_length(x["p"])
        e = s + F.char_length(x["m"])
        after = F.when(x["q"] != "", F.left(x["q"], F.lit(1))).otherwise(F.coalesce(F.left(x["r"], F.lit(1)), F.lit("")))
        before = F.right(F.concat(state["tail"], x["p"]), F.lit(BEFORE))
        made = F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"), before.alias("before"), after.alias("after"))
        return F.struct(e.alias("at"), F.right(F.concat(state["tail"], x["p"], x["m"]), F.lit(BEFORE)).alias("tail")), made

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"))
    docs = docs.withColumns({k: scanned(f"_z_{k}", start, step, SPAN) for k in names})
    return docs.drop(*[f"_{x}_{k}" for k in names for x in "mbz"])


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    def double(i: Column) -> Column:
        d = F.substring(F.reverse(number), i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.char_length(number)), double), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def octet(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.char_length(short) <= 3) & (F.when(F.char_length(short) <= 3, short).otherwise("999").cast("int") <= 255)


def is_ip(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), octet)


def is_card(m: Column) -> Column:
    d = digits(m)
    return F.when(F.char_length(d).between(12, 19), luhn(d)).otherwise(False)


def is_phone(m: Column) -> Column:
    return F.char_length(digits(m)).between(9, 15)


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc, text) with one array of spans for each kind of base span."""
    t = F.col("text")
    number = t.rlike(r"[0-9][\x20-]?[0-9]")
    found = located(docs.select("doc", "text"), {
        "email": (EMAIL, F.contains(t, F.lit("@"))), "ip": (IP, t.rlike(r"[0-9]\.[0-9]")), "card": (CARD, number), "phone": (PHONE, t.rlike(r"\+[0-9]"))})
    return found.select(
        "doc", "text", "email", F.filter("ip", lambda x: is_ip(x["m"])).alias("ip"),
        F.filter("card", lambda x: is_card(x["m"])).alias("card"), F.filter("phone", lambda x: is_phone(x["m"])).alias("phone"),
    )


def free(docs: DataFrame, names: list[str], taken: list[str]) -> DataFrame:
    """``docs`` whose arrays ``names`` keep the spans that overlap none of the arrays ``taken``: all are sorted together
    by start, and each span is held against the furthest end before it and the next start after it."""
    tagged = "struct<s:int,t:int,e:int,m:string,before:string,after:string>"

    def tag(k: str, t: int) -> Column:
        return F.transform(k, lambda x: F.struct(x["s"].alias("s"), F.lit(t).alias("t"), x["e"].alias("e"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after")))

    def ahead(reach: Column, x: Column) -> tuple[Column, Column]:
        good = (x["t"] == 1) & (reach <= x["s"])
        return F.when(x["t"] == 0, F.greatest(reach, x["e"])).otherwise(reach), x.withField("t", F.when(x["t"] == 0, 0).when(good, 1).otherwise(2))

    def back(start: Column, x: Column) -> tuple[Column, Column]:
        good = (x["t"] == 1) & (start >= x["e"])
        return F.when(x["t"] == 0, x["s"]).otherwise(start), x.withField("t", F.when(good, 1).otherwise(0))

    docs = docs.withColumns({f"_all_{k}": F.array_sort(F.concat(*[tag(x, 0) for x in taken], tag(k, 1))) for k in names})
    docs = docs.withColumns({f"_all_{k}": F.reverse(scanned(f"_all_{k}", F.lit(0), ahead, tagged)) for k in names})
    docs = docs.withColumns({f"_all_{k}": scanned(f"_all_{k}", F.lit(2**31 - 1), back, tagged) for k in names})
    left = {k: F.transform(F.reverse(F.filter(f"_all_{k}", lambda x: x["t"] == 1)), lambda x: F.struct(*[x[c].alias(c) for c in ("s", "e", "m", "before", "after")])) for k in names}
    return docs.withColumns(left).drop(*[f"_all_{k}" for k in names])


def candidates(base: DataFrame) -> DataFrame:
    """Adds ``found``: all candidates with their votes and forms, base spans first."""
    t = F.col("text")
    rows = located(base, {"_email": (LOOSE_EMAIL, t.rlike(r"@|\([Aa][Tt]\)|\[[Aa][Tt]\]")), "_phone": (LOOSE_PHONE, t.rlike(r"[0-9]\)?[\x20./-]\(?[0-9]"))})
    rows = rows.withColumn("_phone", F.filter("_phone", lambda x: is_phone(x["m"])))
    rows = free(rows, ["_email", "_phone"], list(KINDS))

    def voted(spans: Column, kind: str, strict: int) -> Column:
        def vote(x: Column) -> Column:
            m, d = x["m"], digits(x["m"])
            before, next_, last = F.lower(x["before"]), x["after"], F.right(x["before"], F.lit(1))
            gazetteer = {
                "email": F.lower(F.substring_index(m, ".", -1)).isin(*DOMAINS),
                "ip": ~m.rlike(r"^(?:0|255|22[4-9]|23[0-9])\."),
                "card": d.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"),
                "phone": d.rlike(f"^(?:00)?(?:{'|'.join(CALLING)})") if strict else d.rlike("^0[1-9]|^[2-9][0-9]{2}"),
            }[kind]
            context = F.when(before.rlike(WORDS_FOR[kind]), 1).when(before.rlike(WORDS_AGAINST), 0)
            alone = ~last.rlike("[A-Za-z0-9_]") & ~next_.rlike("[A-Za-z0-9_]")
            parts = F.size(F.split(m, r"[\x20./()-]+")) > 3
            return F.struct(
                x["s"].alias("s"), x["e"].alias("e"), F.lit(KINDS.index(kind)).alias("kind"), F.lit(strict).alias("regex"), gazetteer.cast("int").alias("gazetteer"),
                context.cast("int").alias("context"), alone.cast("int").alias("form"), parts.cast("int").alias("parts"), (x["e"] - x["s"] > 16).cast("int").alias("long"))

        return F.transform(spans, vote)

    every = [voted(F.col(k), k, 1) for k in KINDS] + [voted(F.col("_email"), "email", 0), voted(F.col("_phone"), "phone", 0)]
    return rows.select("doc", *KINDS, F.concat(*every).alias("found"))


def _log_odds(weights: dict, names: tuple[str, ...]) -> Column:
    """Sum of a candidate's log odds by kind, from {(kind, name): (P(1 | yes), P(1 | no))} and {kind: prior}."""
    out = None
    for kind in range(len(KINDS)):
        prior = weights[kind]
        total = F.lit(math.log(prior / (1 - prior)))
        for name in names:
            yes, no = weights[kind, name]
            v = F.col(name)
            total = total + F.when(v == 1, math.log(yes / no)).when(v == 0, math.log((1 - yes) / (1 - no))).otherwise(0.0)
        out = F.when(F.col("kind") == kind, total) if out is None else out.when(F.col("kind") == kind, total)
    return out


def _reestimate(patterns: DataFrame, posterior: Column, names: tuple[str, ...], belief: dict) -> dict:
    """Priors by kind and rates by kind and name, with ``belief`` as a few cases of their own."""
    yes, no = F.col("n") * F.col("_p"), F.col("n") * (1 - F.col("_p"))
    sums = [F.sum(yes).alias("yes"), F.sum(no).alias("no")]
    for c in names:
        sums += [F.sum(F.when(F.col(c) == 1, yes).otherwise(0.0)).alias(f"{c}_1y"), F.sum(F.when(F.col(c) == 1, no).otherwise(0.0)).alias(f"{c}_1n"),
                 F.sum(F.when(F.col(c).isNotNull(), yes).otherwise(0.0)).alias(f"{c}_y"), F.sum(F.when(F.col(c).isNotNull(), no).otherwise(0.0)).alias(f"{c}_n")]
    out = dict(belief)
    for r in patterns.withColumn("_p", posterior).groupBy("kind").agg(*sums).collect():  # a row for each kind
        k = r["kind"]
        out[k] = min(max((r["yes"] + 2) / (r["yes"] + r["no"] + 4), 1e-3), 1 - 1e-3)
        for c in names:
            y, n = belief[k, c]
            out[k, c] = ((r[f"{c}_1y"] + 8 * y) / (r[f"{c}_y"] + 8), (r[f"{c}_1n"] + 8 * n) / (r[f"{c}_n"] + 8))
    return out


def _pair(x: float | tuple[float, float]) -> tuple[float, float]:
    return x if isinstance(x, tuple) else (x, x)


def fit(found: DataFrame, rounds: int = ROUNDS) -> dict:
    """EM over the vote patterns, then the span classifier; both see every candidate."""
    keys = ("kind", *VOTES, *FORMS)
    # explode() would first ask for the array's size, and that question be pushed down with all that makes the array.
    rows = found.select(F.explode_outer("found").alias("x")).select("x.*").where(F.col("kind").isNotNull())
    patterns = stored(rows.groupBy(*keys).agg(F.count("*").cast("double").alias("n")).coalesce(1), "pii-patterns")
    belief: dict = {k: 0.5 for k in range(len(KINDS))}
    belief |= {(k, c): {"regex": (0.9, 0.1), "gazetteer": (0.8, 0.3), "context": (0.8, 0.2), "form": (0.9, 0.4)}[c] for k in range(len(KINDS)) for c in VOTES}
    weights = belief
    for _ in range(rounds):
        before, weights = weights, _reestimate(patterns, 1 / (1 + F.exp(-_log_odds(weights, VOTES))), VOTES, belief)
        if max(abs(a - b) for k in before for a, b in zip(_pair(before[k]), _pair(weights[k]), strict=True)) < 1e-3:
            break
    posterior = 1 / (1 + F.exp(-_log_odds(weights, VOTES)))
    features = VOTES + FORMS
    return _reestimate(patterns, posterior, features, belief | {(k, c): (0.5, 0.5) for k in range(len(KINDS)) for c in FORMS})


def listed(spans: Column) -> Column:
    """kind:start:end of an array of (s, k, e), in order."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def personal_data(docs: DataFrame, doc: str = "doc_id", text: str = "text", rounds: int = ROUNDS, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans): base spans by kind and listed, and all
    spans listed, added ones among them.

    One row for each input row, repeated ones too; null and empty texts have no spans. Other columns
    are not read. Without candidates there is nothing to learn, and nothing is added.
    """
    source = docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = candidates(base_spans(source))
    weights = fit(found, rounds)

    def place(x: Column, kind: Column) -> Column:
        return F.struct(x["s"].alias("s"), kind.alias("k"), x["e"].alias("e"))

    def placed(kind: str) -> Column:
        return F.transform(kind, lambda x: place(x, F.lit(KINDS.index(kind))))

    base = F.concat(*[placed(k) for k in KINDS])
    features = VOTES + FORMS

    def chance(x: Column) -> Column:
        total = None
        for kind in range(len(KINDS)):
            prior = weights[kind]
            odds = F.lit(math.log(prior / (1 - prior)))
            for c in features:
                yes, no = weights[kind, c]
                odds = odds + F.when(x[c] == 1, math.log(yes / no)).when(x[c] == 0, math.log((1 - yes) / (1 - no))).otherwise(0.0)
            total = F.when(x["kind"] == kind, odds) if total is None else total.when(x["kind"] == kind, odds)
        return total

    least = math.log(accept / (1 - accept))
    added = F.transform(F.filter("found", lambda x: (x["regex"] == 0) & (chance(x) >= least)), lambda x: place(x, x["kind"]))
    return found.select(
        F.col("doc").alias("doc_id"), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        listed(base).alias("base"), listed(F.concat(base, added)).alias("spans"),
    )


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")
