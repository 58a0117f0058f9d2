"""Personal data by weak supervision, in built-in functions only.

Four fixed patterns give the base spans. Wider patterns propose candidates of these kinds, and
of two more: secrets (keys, tokens, quoted passwords) and names of persons. Labelers
(strict shapes, checksums and the variety of characters, gazetteers, words around the
candidate in four languages) vote for or against each, or abstain. Expectation-maximisation
over the counts of vote patterns of the whole corpus estimates how reliable each labeler is for
each kind, and with that how likely each pattern is personal data. A logistic classifier
trained on these probabilities decides on every candidate; accepted ones that touch no base
span are added to it.

Learning sees one table: how often each pattern of kind, votes and features occurs. It has at
most 6 * 3^5 * 2^5 = 46,656 rows, whatever the corpus; it is collected once, and the rounds are a
few sums over it on the driver. A candidate is described once, and its score is a sum of numbers
looked up by its votes.

Defined results: a null text counts as empty; a text without candidates has no spans; with no candidates
at all nothing is learned or added. Very long texts are labelled whole, in linear time. Repeated rows are labelled one
by one. An empty table gives no rows. The key and other columns pass through unchanged; columns called like
a result are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylag.llm.names import unused

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret", "name")

# The base patterns, written so that a match never starts inside a run that has failed
# already and never backtracks into one: same matches, linear time.
BASE_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Only whole runs of 14 to 19 digits: what the plain pattern drops later is not matched.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Wider shapes for candidates; the kind of a numeric one follows from its shape.
WIDE_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\x20?[(\[](?:at|AT)[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[](?:dot|DOT)[)\]]\x20?)[A-Za-z0-9-]++)*+"
WIDE_NUMBER = r"(?<![0-9])[+(]{0,2}[0-9](?:[\x20().-]{0,2}[0-9]){6,}+"
# A long run, with a digit, of the characters that keys are written in, or a quoted value that something is set to.
WIDE_SECRET = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+={0,2}|(?<=[=:][\x20]?[\x22'])[^\x22'\s]{8,200}+(?=[\x22'])"

# Gazetteers and context words.
TOP_LEVEL_DOMAINS = ["com", "org", "net", "edu", "gov", "io", "info", "biz", "de", "fr", "es", "uk", "it", "nl", "eu", "us", "ca", "ch", "at", "be", "pl", "se", "jp", "cn", "in", "br", "au", "ru", "mx"]
CALLING_CODES = ["1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91"]
CARD_PREFIXES = "^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5|4))"
SECRET_PREFIXES = "^(?:AKIA|ASIA|gh[opsur]_|github_pat_|glpat-|xox[abprs]-|sk[-_]|pk[-_]|AIza|eyJ|ya29)"
FIRST_NAMES = [
    "James", "John", "Robert", "Michael", "William", "David", "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan",
    "Hans", "Klaus", "Jürgen", "Wolfgang", "Stefan", "Andreas", "Ursula", "Sabine", "Petra", "Heike", "Katrin", "Anke",
    "José", "Juan", "Carlos", "Manuel", "Javier", "Miguel", "María", "Carmen", "Lucía", "Pilar", "Dolores", "Isabel",
    "Jean", "Pierre", "Michel", "Philippe", "Jacques", "François", "Marie", "Nathalie", "Isabelle", "Monique", "Camille", "Sylvie",
]
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Herrn", "Frau", "Señor", "Señora", "Señorita", "Sr", "Sra", "Don", "Doña", "Monsieur", "Madame", "Mademoiselle", "Mme", "Mlle"]
WORDS_FOR = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write to|reach|kontakt|correo|courriel)\W{0,8}$",
    "ip": r"(?i)\b(?:ip|address|host|server|login from|client|adresse|dirección)\W{0,8}$",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment|karte|tarjeta|carte)\W{0,8}$",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|telefon|teléfono|téléphone)\W{0,8}$",
    "secret": r"(?i)(?:token|secret|passw(?:or)?d|pwd|passphrase|api[_ -]?key|access[_ -]?key|private[_ -]?key|credentials?|authorization|bearer|passwort|kennwort|contraseña|mot de passe)\W{0,6}$",
    "name": r"(?i)\b(?:name is|named|signed by|sincerely|regards|i am|ich heiße|mein name ist|gezeichnet|me llamo|mi nombre es|firmado por|je m.appelle|mon nom est|signé par)\W{0,8}$",
}
WORDS_AGAINST = r"(?i)\b(?:version|release|isbn|issn|doi|order|invoice|part|serial|section|chapter|id|token|key|hash|sha|no|nr|number|pages?)\W{0,8}$"
# Long runs that stand after these are names of contents, not secrets.
SECRET_AGAINST = r"(?i)\b(?:sha-?[0-9]{0,3}|md5|commit|checksum|digest|revision|etag|hash|blob|tree|version|build|isbn|doi|uuid|https?)\W{0,8}$"
CAPITALISED = r"\p{Lu}[\p{L}'-]{1,30}+"
WIDE_NAME = rf"(?<![\p{{L}}\p{{N}}])(?:(?:{'|'.join(TITLES)})\.?\x20)?(?:{CAPITALISED}\x20{CAPITALISED}(?:\x20{CAPITALISED})?)"
# Texts that may hold a candidate: all titles and first names start with a plain capital.
MAYBE_NAME = rf"(?=[A-Z])(?<![\p{{L}}\p{{N}}])(?:(?:{'|'.join(TITLES)})\.?\x20\p{{Lu}}|(?:{'|'.join(FIRST_NAMES)})\x20\p{{Lu}})"
# What they may hold instead, without the first letter, which may be a capital.
NAME_WORDS = ["ame is ", "amed ", "igned by ", "incerely", "egards", "ch heiße ", "ein name ist ", "ezeichnet", "e llamo ", "i nombre es ", "irmado por ", "e m'appelle ", "e m’appelle ", "on nom est ", "igné par "]
CONTEXT_CHARS = 40

LABELERS = ("shape", "check", "gazetteer", "context", "warning")
FEATURES = ("has_plus", "has_paren", "has_separator", "joined_before", "joined_after")
EM_ROUNDS = 15
ACCEPTED = 0.9

SPAN = "array<struct<start:int,end:int,text:string>>"


# -- spans -----------------------------------------------------------------


def located(text: Column, pattern: str, possible: Column) -> Column:
    """Matches of the pattern with their code-point offsets; none where `possible` is false.

    The text between matches gives the offsets: matches and gaps alternate.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    pairs = F.zip_with(gaps, found, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("text")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["text"])
        span = F.struct(start.alias("start"), end.alias("end"), x["text"].alias("text"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    none = F.array().cast(SPAN)
    spans = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    return F.when(possible, spans).otherwise(none)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def doubled(number: Column) -> tuple[Column, Column]:
    """The last 19 digits filled to 20, and the same with each digit doubled (its digits added)."""
    filled = F.lpad(F.right(number, F.lit(19)), 20, "0")
    return filled, F.translate(filled, "0123456789", "0246813579")


def luhn(filled: Column, twice: Column) -> Column:
    """Whether digits pass the Luhn check, given as `doubled` gives them."""
    total = reduce(lambda a, b: a + b, [F.substring(twice if place % 2 == 1 else filled, place, 1).cast("int") for place in range(1, 21)])
    return total % 10 == 0


def octets(text: Column) -> Column:
    """Whether all dotted parts are at most 255, whatever their leading zeros."""
    return ~text.rlike(r"(?:^|\.)0*+(?:[0-9]{4}|2[6-9][0-9]|25[6-9]|[3-9][0-9]{2})")


def base_spans(text: Column) -> dict[str, Column]:
    """Per kind, the leftmost non-overlapping matches that pass their check."""
    found = {
        "email": located(text, BASE_PATTERNS["email"], text.contains("@")),
        "ip": located(text, BASE_PATTERNS["ip"], text.rlike(r"[0-9]\.[0-9]")),
        "card": located(text, BASE_PATTERNS["card"], text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9]")),
        "phone": located(text, BASE_PATTERNS["phone"], text.contains("+")),
    }
    numbered = F.transform(found["card"], lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.struct(*[c.alias(n) for n, c in zip(("filled", "twice"), doubled(digits(x["text"])))]).alias("d")))
    cards = F.filter(numbered, lambda x: luhn(x["d"]["filled"], x["d"]["twice"]))
    return {
        "email": found["email"],
        "ip": F.filter(found["ip"], lambda x: octets(x["text"])),
        "card": cards,
        "phone": F.filter(found["phone"], lambda x: F.length(digits(x["text"])).between(10, 15)),
    }


def tagged(spans: Column, kind: str) -> Column:
    rank = ALL_KINDS.index(kind)
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end")))


def span_list(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["start"], x["end"])), ",")


# -- candidates, labelers, features ----------------------------------------


def candidates(text: Column) -> Column:
    """array<struct<start, end, text, kind, before, after>> of everything that may be personal data."""
    found = {
        "email": located(text, WIDE_EMAIL, text.rlike(r"@|[(\[](?:at|AT)[)\]]")),
        "number": located(text, WIDE_NUMBER, text.rlike("[0-9]")),
        "secret": located(text, WIDE_SECRET, (text.rlike("[0-9]") & text.rlike(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20}")) | text.rlike(r"[=:][\x20]?[\x22']")),
        "name": located(text, WIDE_NAME, text.rlike(MAYBE_NAME) | reduce(lambda a, b: a | b, [text.contains(w) for w in NAME_WORDS])),
    }

    def described(x: Column, kind: Column) -> Column:
        first = F.greatest(x["start"] - CONTEXT_CHARS, F.lit(0))
        before = F.substr(text, first + 1, x["start"] - first)
        after = F.substr(text, x["end"] + 1, F.lit(1))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), kind.alias("kind"), before.alias("before"), after.alias("after"))

    def number_kind(x: Column) -> Column:
        quad = x["text"].rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$")
        return F.when(quad, "ip").when(F.length(digits(x["text"])) >= 13, F.when(x["text"].startswith("+"), "phone").otherwise("card")).otherwise("phone")

    def of_kind(spans: Column, kind: str) -> Column:
        return F.transform(spans, lambda x: described(x, number_kind(x) if kind == "number" else F.lit(kind)))

    return F.concat(*[of_kind(spans, kind) for kind, spans in found.items()])


def measured(found: Column) -> Column:
    """The candidates with what several labelers look at, worked out once."""

    def more(c: Column) -> Column:
        number = digits(c["text"])
        filled, twice = doubled(number)
        return F.struct(
            *[c[n].alias(n) for n in ("start", "end", "text", "kind", "before", "after")],
            number.alias("number"), F.length(number).alias("size"), filled.alias("filled"), twice.alias("twice"),
            F.when(c["kind"] == "secret", F.size(F.array_distinct(F.split(c["text"], "")))).otherwise(0).alias("variety"),
        )

    return F.transform(found, more)


def vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def votes(c: Column) -> dict[str, Column]:
    """Per labeler 1 (personal data), -1 (not) or 0 (abstains) for a measured candidate."""
    text, kind, number, size = c["text"], c["kind"], c["number"], c["size"]

    def by_kind(**cases: Column) -> Column:
        first, *others = cases
        return reduce(lambda done, k: done.when(kind == k, cases[k]), others, F.when(kind == first, cases[first])).otherwise(0)

    no = F.lit(False)
    mixed = text.rlike("[0-9]") & text.rlike("[A-Za-z]")
    return {
        "shape": by_kind(
            email=vote(text.rlike(r"(?:\.|dot[)\]]\x20?)[A-Za-z]{2,12}$"), ~text.rlike(r"(?i)\.|dot")),
            ip=vote(octets(text), ~octets(text)),
            card=vote(text.rlike(r"^[0-9]{15,16}$|^[0-9]{4}(?:[\x20-][0-9]{4}){3}$|^[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}$"), size > 19),
            phone=vote(text.rlike(r"^\+[0-9]|^\([0-9]{3}\)|^[0-9]{3}[.\x20-][0-9]{3}[.\x20-][0-9]{4}$") & (size >= 10), (size < 8) | (size > 15)),
            # Whole hexadecimal digests, or runs of mixed case and digits; words with hyphens and paths are neither.
            secret=vote(text.rlike(r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$") | (mixed & text.rlike("[a-z]") & text.rlike("[A-Z]") & ~text.rlike("[/-].*[/-].*[/-]")), text.rlike(r"^[A-Za-z/_-]+$|^[0-9_/+-]+$")),
            name=vote(text.rlike(rf"^(?:{'|'.join(TITLES)})\b"), text.rlike(r"\p{Lu}{3}")),
        ),
        "check": by_kind(
            email=vote(no, text.rlike(r"\.\.|^\.|--")),
            ip=vote(no, text.rlike(r"(?:^|\.)0[0-9]")),
            card=vote(luhn(c["filled"], c["twice"]), ~luhn(c["filled"], c["twice"])),
            phone=vote((size >= 10) & (size <= 15) & text.rlike(r"[\x20().-]"), text.rlike("^[0-9]+$")),
            # Random keys use many characters.
            secret=vote(mixed & (c["variety"] >= 10), c["variety"] < 6),
            name=vote(no, text.rlike(r"(\p{L}+)\x20\1$")),
        ),
        "gazetteer": by_kind(
            email=vote(F.lower(F.regexp_extract(text, r"([A-Za-z]+)$", 1)).isin(TOP_LEVEL_DOMAINS), no),
            ip=vote(~text.rlike(r"^(?:0|22[4-9]|2[3-5][0-9])\."), text.rlike(r"^(?:0|22[4-9]|2[3-5][0-9])\.")),
            card=vote(number.rlike(CARD_PREFIXES), ~number.rlike(CARD_PREFIXES)),
            phone=vote(text.rlike(rf"^\+(?:{'|'.join(CALLING_CODES)})"), no),
            secret=vote(text.rlike(SECRET_PREFIXES), no),
            name=vote(text.rlike(rf"(?<!\p{{L}})(?:{'|'.join(FIRST_NAMES)})\x20"), no),
        ),
        "context": by_kind(**{k: vote(c["before"].rlike(WORDS_FOR[k]), no) for k in ALL_KINDS}),
        "warning": by_kind(**{k: vote(no, c["before"].rlike(SECRET_AGAINST if k == "secret" else WORDS_AGAINST)) for k in ALL_KINDS}),
    }


def features(c: Column) -> dict[str, Column]:
    text = c["text"]
    found = {
        "has_plus": text.startswith("+"),
        "has_paren": text.rlike(r"[()\[\]]"),
        "has_separator": text.rlike(r"[\x20-]"),
        "joined_before": c["before"].rlike(r"[A-Za-z0-9]$"),
        "joined_after": c["after"].rlike(r"^[A-Za-z0-9]"),
    }
    return {name: value.cast("int") for name, value in found.items()}


def judged(found: Column) -> Column:
    """array<struct<start, end, kind, votes..., features...>> of measured candidates: kind as its place among ALL_KINDS."""
    place = F.array(*[F.lit(k) for k in ALL_KINDS])

    def struct(c: Column) -> Column:
        kind = F.array_position(place, c["kind"]).cast("int") - 1
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), kind.alias("kind"), *[v.alias(n) for n, v in {**votes(c), **features(c)}.items()])

    return F.transform(found, struct)


def pattern_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """How often each combination of kind, votes and features occurs in all texts."""
    each = docs.select(F.explode(judged(measured(candidates(F.coalesce(F.col(text), F.lit(""))))))).select("col.*")
    return each.groupBy("kind", *LABELERS, *FEATURES).agg(F.count(F.lit(1)).alias("n"))


# -- learning --------------------------------------------------------------


@dataclass
class Model:
    """Reliabilities by kind and labeler, P(vote | personal) and P(vote | not), and the weights of the span classifier."""

    reliability: dict[str, dict[str, dict[int, tuple[float, float]]]]
    prior: dict[str, float]
    bias: dict[str, float]
    weights: dict[str, dict[str, float]]  # by kind: <labeler>_for, <labeler>_against, <feature>

    def score(self, c: Column) -> Column:
        """Probability that a judged candidate is personal data; kinds without candidates in training get none."""
        kind = c["kind"]

        def of_kind(value: Callable[[str], float]) -> Column:
            return F.array(*[F.lit(float(value(k))) for k in ALL_KINDS])

        total = F.get(of_kind(lambda k: self.bias.get(k, -1e9)), kind)
        for name in LABELERS:
            table = [self.weights.get(k, {}).get(f"{name}_{side}", 0.0) if side else 0.0 for k in ALL_KINDS for side in ("against", None, "for")]
            total = total + F.get(F.array(*[F.lit(w) for w in table]), kind * 3 + c[name] + 1)
        for name in FEATURES:
            total = total + c[name] * F.get(of_kind(lambda k, name=name: self.weights.get(k, {}).get(name, 0.0)), kind)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def beliefs(votes_of: np.ndarray, n: np.ndarray, rounds: int) -> tuple[np.ndarray, float, dict[str, dict[int, tuple[float, float]]]]:
    """Expectation-maximisation for one kind: the probability of each vote pattern, the prior, and the labelers' reliabilities."""
    belief = 1 / (1 + np.exp(-1.5 * votes_of.sum(axis=1)))  # the majority vote to begin with
    prior, reliability = 0.5, {}
    for _ in range(rounds):
        yes, no = n * belief, n * (1 - belief)
        # One pseudo-count each keeps every probability above zero.
        prior = (yes.sum() + 1) / (n.sum() + 2)
        odds = np.full(len(n), math.log(prior / (1 - prior)))
        for i, name in enumerate(LABELERS):
            shares = {v: tuple(float((side[votes_of[:, i] == v].sum() + 1) / (side.sum() + 3)) for side in (yes, no)) for v in (-1, 0, 1)}
            reliability[name] = shares
            for v, (a, b) in shares.items():
                odds[votes_of[:, i] == v] += math.log(a / b)
        belief = 1 / (1 + np.exp(-odds))
    return belief, float(prior), reliability


def logistic(inputs: np.ndarray, p: np.ndarray, n: np.ndarray, penalty: float = 0.001, rounds: int = 50) -> np.ndarray:
    """Bias and weights of a logistic regression on soft labels, by Newton's method; the bias bears no penalty."""
    design = np.column_stack([np.ones(len(inputs)), inputs])
    share = n / n.sum()
    ridge = np.full(design.shape[1], penalty)
    ridge[0] = 1e-9
    weights = np.zeros(design.shape[1])
    for _ in range(rounds):
        guess = 1 / (1 + np.exp(-(design @ weights)))
        slope = design.T @ (share * (guess - p)) + ridge * weights
        curve = (design * (share * guess * (1 - guess))[:, None]).T @ design + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        weights = weights - step * min(1.0, 4 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return weights


def fit(docs: DataFrame, text: str = "text", rounds: int = EM_ROUNDS) -> Model | None:
    """Learn from all texts; None without candidates. One job; what it collects is bounded by the number of patterns."""
    rows = pattern_counts(docs, text).collect()
    if not rows:
        return None
    model = Model({}, {}, {}, {})
    for place, kind in enumerate(ALL_KINDS):
        own = sorted((r for r in rows if r["kind"] == place), key=tuple)
        if not own:
            continue
        votes_of, described, n = (np.array([[r[c] for c in names] for r in own], float) for names in (LABELERS, FEATURES, ["n"]))
        belief, model.prior[kind], model.reliability[kind] = beliefs(votes_of, n[:, 0], rounds)
        sides = {f"{name}_{side}": votes_of[:, i] == sign for i, name in enumerate(LABELERS) for side, sign in (("for", 1), ("against", -1))}
        found = logistic(np.column_stack([*sides.values(), described]).astype(float), belief, n[:, 0])
        model.bias[kind] = float(found[0])
        model.weights[kind] = dict(zip([*sides, *FEATURES], found[1:].tolist()))
    return model


# -- results ---------------------------------------------------------------


def label(docs: DataFrame, model: Model | None, text: str = "text", accepted: float = ACCEPTED, base: str = "base", spans: str = "spans") -> DataFrame:
    """The frame with base and all spans: arrays of (start, rank of kind, end), sorted."""
    columns = [c for c in docs.columns if c not in (base, spans)]
    *names, wide, own, all_spans = unused(docs, *[f"_{k}" for k in KINDS], "_wide", "_own", "_all")
    whole = F.coalesce(F.col(text), F.lit(""))
    found_by_kind = dict(zip(names, base_spans(whole).values()))
    found = docs.withColumns(found_by_kind | ({wide: candidates(whole)} if model else {}))
    found = found.withColumn(own, F.array_sort(F.concat(*[tagged(F.col(name), kind) for name, kind in zip(names, KINDS)])))
    if model is None:
        return found.select(*columns, F.col(own).alias(base), F.col(own).alias(spans))
    free = F.filter(wide, lambda c: ~F.exists(own, lambda b: (c["start"] < b["end"]) & (b["start"] < c["end"])))
    found = found.withColumn(wide, judged(measured(free)))
    good = F.filter(wide, lambda c: model.score(c) >= accepted)
    more = F.transform(good, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("rank"), c["end"].alias("end")))
    found = found.withColumn(all_spans, F.array_sort(F.concat(own, more)))
    return found.select(*columns, F.col(own).alias(base), F.col(all_spans).alias(spans))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in ALL_KINDS])

    def step(acc: Column, x: Column) -> Column:
        gap = F.substr(text, acc["at"] + 1, x["start"] - acc["at"])
        out = F.concat(acc["out"], F.array(F.concat(gap, F.get(names, x["rank"]))))
        later = F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(x["start"] < acc["at"], later).otherwise(F.struct(x["end"].alias("at"), out.alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(done)
