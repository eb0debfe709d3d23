"""Personal data by weak supervision, with built-in Spark functions only.

Labelers of three sorts (regular expressions for form and validity, gazetteers, and the words before and behind) vote on
every candidate span: +1 personal, -1 not, 0 no opinion. They are written for each kind of span and may contradict each
other: a number of a card's form whose checksum fails, a telephone number of an area that doesn't exist, a first name
before "Street". Spans are counted by family, votes and features; there are at most len(FAMILIES) * CODES such patterns, so the
driver sees a table of bounded size however large the corpus is.

Expectation-maximisation on the votes estimates each labeler's reliability and each vote pattern's probability, apart for
each family of kinds. Base spans vote along: what the exact rules find teaches what a card or a telephone number looks
like where those rules fail (they drop a whole run of digits when a number stands right behind another one). A logistic span
classifier is then trained on these probabilities, on votes and on features that no labeler sees (length, shape,
neighbours), and compiled into a Spark expression.

Base spans (email, ip, card, phone by their exact rules) always stay; those that the classifier doubts are counted. It
decides on all others: numbers (cards, telephones, accounts, papers that the rules miss) and names. These are looked for
in the text with its base spans hidden, so none overlaps one. The rules' expressions are rewritten to be linear on
long runs, with the same matches.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import saved
from textquarry.llm.spans import as_spans, digits, found, joined, let, luhn, masked, mod97, redacted

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "number", "name"]
LABELERS = ["form", "check", "gazetteer", "before", "behind"]
#: How many times as often a labeler is right as wrong, in the opinion that EM starts from: a checksum is nearly a proof.
OPINIONS = {"form": 2.0, "check": 9.0, "gazetteer": 2.0, "before": 3.0, "behind": 3.0}
#: Spans whose labelers mean the same; those of kind number belong to cards, phones, accounts or others by their look.
FAMILIES = ["email", "ip", "cards", "phones", "accounts", "others", "names"]
#: Features beside the votes: how many values each has.
FEATURES = {"length": 4, "shape": 4, "left": 3, "right": 3}
VOTES = 3 ** len(LABELERS)
CODES = VOTES * math.prod(FEATURES.values())

#: A run is entered at its start or where the match before ended (\G).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
#: Maximal runs of 12 to 19 digits; shorter and longer ones fail anyway and hide nothing.
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){11,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"

#: Numbers one by one, also where they stand in a row: telephones, accounts (by form, or after a word for an account or
#: papers), social security numbers, cards in groups, national telephones, plain runs.
DIALLED = r"(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}\x20?+[A-Z0-9]{4}(?:\x20?+(?=[A-Z]{0,3}[0-9])[A-Z0-9]{4}){1,6}+(?:\x20?+(?=[A-Z]{0,2}[0-9])[A-Z0-9]{1,3})?+(?![0-9A-Za-z])"
PAPERS = r"(?:passport|reisepass|passeport|pasaporte|account|konto|compte|cuenta|iban)(?:\x20?(?:no|nr|number|nummer|numéro|número))?"
LETTERED = rf"(?<![0-9A-Za-z])(?=[A-Z]{{1,3}}[ -]?[0-9])(?<=(?i:{PAPERS})[ :.#]{{1,3}})[A-Z]{{1,3}}[ -]?+[0-9A-Z]{{5,15}}+(?![0-9A-Za-z])"
SOCIAL = r"(?<![0-9A-Za-z.+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
GROUPED = r"(?<![0-9A-Za-z.+])[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}(?![0-9A-Za-z])"
NATIONAL = r"(?<![0-9A-Za-z.+])(?:\(?[0-9]{2,4}\)?[ -][0-9]{3,4}[ -][0-9]{3,4}|0[0-9]{2,4}[ -][0-9]{5,8}|[0-9]{3}[ -][0-9]{4})(?![0-9A-Za-z])"
PLAIN = r"(?<![0-9A-Za-z.+])[0-9]{7,19}+(?![0-9A-Za-z])"
NUMBER = f"(?:{DIALLED}|{IBAN}|{LETTERED}|{SOCIAL}|{GROUPED}|{NATIONAL}|{PLAIN})"

#: Frequent first names and surnames of the four languages; the parameter `names` adds to the first names.
FIRST_NAMES = (
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah "
    "Charles Karen Christopher Lisa Daniel Nancy Matthew Betty Anthony Margaret Mark Sandra Donald Ashley Steven Emily Andrew Kimberly "
    "Paul Donna Joshua Michelle Kenneth Carol Kevin Amanda Brian Dorothy George Melissa Edward Deborah "
    "Hans Peter Klaus Jürgen Ursula Monika Petra Sabine Andreas Stefan Wolfgang Karin Helmut Renate Dieter Ingrid Uwe Birgit Bernd Gabriele "
    "Günter Heike Manfred Martina Werner Claudia Frank Anja Matthias Katrin "
    "Jean Pierre Michel Nathalie Isabelle Sylvie Nicolas Camille Philippe Catherine Alain Françoise Patrick Monique Jacques Christine "
    "Bernard Sophie Laurent Valérie François Chantal Thierry Julie "
    "José Antonio Manuel María Carmen Ana Francisco Javier Luis Laura Juan Isabel Carlos Dolores Miguel Pilar Ángel Cristina Jesús Marta "
    "Pedro Elena Alejandro Lucía"
).split()
SURNAMES = (
    "Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson Martin Lee Thompson White Harris Clark "
    "Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Bauer Richter Klein Wolf Schröder Neumann "
    "Bernard Dubois Robert Richard Petit Durand Leroy Moreau Simon Laurent Lefebvre Michel Garcia Roux "
    "García Rodríguez González Fernández López Martínez Sánchez Pérez Gómez Martín Jiménez Ruiz Hernández Díaz"
).split()
#: Words of places, institutions and licences that look like parts of names.
NO_NAMES = (
    "Street St Avenue Road Square Park Bridge Hill River Lake County City Town University College School Institute Church Hospital Museum "
    "General Public License Licence Software Foundation Apache Creative Commons Version Inc Ltd GmbH Company Corporation Bank Press "
    "Straße Platz Universität Gesellschaft Rue Place Université Société Calle Plaza Universidad Sociedad Saint San Santa"
).split()
#: Titles and greetings that names follow, words after them that are none, and what comes before authors.
TITLES = r"(?:mr|mrs|ms|miss|dr|prof|herrn?|frau|fräulein|monsieur|madame|mademoiselle|mme|señor|señora|señorita|sra?|don|doña)"
GREETINGS = r"(?:dear|hello|hi|hallo|liebe|lieber|bonjour|cher|chère|hola|estimado|estimada|querido|querida)"
CUES = r"(?:written by|author|signed|sincerely|my name is|ich heiße|je m'appelle|me llamo|name|autor|auteur|verfasser)"
NAMELESS = r"(?i)^(?:sir|madam|all|everyone|everybody|team|friends?|customers?|readers?|colleagues?|kunden?|freunde?|kollegen|leser|damen|amis?|clients?|amigos?|clientes?|world|there|god|lord)\b"
WORD = r"\p{Lu}(?:[\p{L}\p{M}]|['’-][\p{L}\p{M}])++"
PERSON = rf"(?:(?:von|van|de|der|den|del|della|di|da|du|la|le|zu|zum)\x20){{0,3}}+(?:\p{{Lu}}\.\x20?){{0,3}}+{WORD}(?:\x20{WORD}){{0,2}}+"
#: Telephone country codes, card issuers' first digits with the lengths they go with, ranges of addresses that name no host, countries of accounts.
CALLING = r"^\+(?:1(?=[^0-9]*[2-9])|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
ISSUERS = r"^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|(?:5[1-5]|2[2-7]|65|35)[0-9]{14}|6011[0-9]{12}|3[47][0-9]{13})$"
UNROUTED = r"^(?:0|10|127|255|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\."
ACCOUNTS = r"^(?:AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LI|LT|LU|LV|MT|NL|NO|PL|PT|RO|SE|SI|SK)"
ROLES = r"(?i)^(?:no-?reply|test|user|info|admin|support|webmaster|postmaster|sales|example)@"
DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|de|fr|es|uk|eu|io|info)$"
#: By kind: words before that speak for and against personal data, and words behind that do.
CONTEXTS = {
    "email": (r"(?:e-?mail|contact|write|reach|correo|courriel|kontakt)", r"(?:example of|regex)", r"^\W*(?:for|or call|phone|fax)\b", r"^\W*(?:is an example|regex)"),
    "ip": (r"(?:\bip\b|address|host|server|client|from|adresse|dirección)", r"(?:version|release|section|\bv)\W*$", r"^\W*(?:port|connected|logged)\b", r"^\W*(?:release|build|version|beta)"),
    "card": (r"(?:card|visa|master|amex|credit|payment|karte|carte|tarjeta)", r"(?:isbn|order|serial|invoice|tracking)", r"^\W*(?:exp|cvv|cvc|valid|gültig)", r"^\W*(?:isbn|items|units|bytes|rows)"),
    "phone": (r"(?:phone|tel|call|fax|mobile|cell|contact|telefon|téléphone|teléfono)", r"(?:version|offset|utc|gmt)", r"^\W*(?:ext|or e-?mail|fax|mobile)", r"^\W*(?:units|items|bytes|rows|points)"),
    "number": (
        r"(?:phone|tel|call|fax|mobile|ssn|social security|passport|account|iban|card|visa|credit|id number)(?: ?(?:no|nr|number|nummer|numéro|número))?\W*$",
        r"(?:isbn|issn|order|version|page|serial|year|invoice|tracking|no\.)\W*$",
        r"^\W*(?:exp|cvv|cvc|valid|ext)\b",
        r"^\W*(?:items|units|bytes|rows|pages|points|euros?|dollars|people|times|km|kg|%|€|\$)",
    ),
    "name": (
        rf"(?:(?<!\p{{L}})(?:{TITLES}|{GREETINGS})|{CUES}|\bby)\W*$",
        r"(?:saint|san|st\.|rue|street|calle|straße|university of|city of)\W*$",
        r"^,? (?:said|says|wrote|writes|told|asked|sagte|schrieb|dit|écrit|dijo|phd|md|jr|sr)\b",
        r"^ (?:street|avenue|road|square|university|college|school|foundation|license|gmbh|inc|ltd|straße|platz)",
    ),
}


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def name_pattern(names: list[str]) -> str:
    """Listed first names with a capitalised word, capitalised words with a listed surname, and whatever follows a title, a greeting or a cue."""
    titled = rf"(?<=(?<!\p{{L}})(?iu:{TITLES}\.?|{GREETINGS})\x20)(?!(?iu:{TITLES}\.?\x20)){PERSON}"
    cued = rf"(?<=(?<!\p{{L}})(?iu:{CUES})[:,]?\x20){WORD}(?:\x20{WORD}){{1,2}}+"
    return rf"(?<!\p{{L}})(?=[\p{{Lu}}vdlz])(?:{titled}|{cued}|{_any(names)} \p{{Lu}}\p{{Ll}}+|\p{{Lu}}\p{{Ll}}+ {_any(SURNAMES)}(?!\p{{L}}))"


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, F.lit(1))
    return F.coalesce(out.when(no, F.lit(-1)) if no is not None else out, F.lit(0))


def _votes(kind: str, m: Column, names: list[str]) -> list[Column]:
    value = m["value"]
    number = digits(value)
    near, against, behind, against_behind = CONTEXTS[kind]
    before, after = F.lower(m["before"]), F.lower(m["after"])
    plain, social, iban, lettered = value.rlike("^[0-9]+$"), value.rlike(f"^{SOCIAL}$"), value.rlike("^[A-Z]{2}[0-9]{2}"), value.rlike("^[A-Z]")
    dialled, of_card = value.startswith("+"), value.rlike(r"^[0-9 -]+$") & F.length(number).between(12, 19)
    local = F.regexp_extract(value, "^([^@]*)@", 1)
    titled = before.rlike(rf"(?<!\p{{L}}){TITLES}\W*$")
    by_kind = {
        "email": lambda: [
            _vote(value.rlike(r"\.[A-Za-z]{2,}$"), F.lit(True)),
            _vote((F.length(local) <= 64) & ~local.rlike(r"^\.|\.\.|\.$"), F.lit(True)),
            F.when(value.rlike(ROLES), -1).when(value.rlike(DOMAINS), 1).otherwise(0),
        ],
        "ip": lambda: [_vote(~value.rlike(r"(?:^|\.)0[0-9]"), F.lit(True)), _vote(~value.rlike(r"\.(?:0|255)$"), F.lit(True)), _vote(~value.rlike(UNROUTED), F.lit(True))],
        "card": lambda: [_vote(value.rlike(f"^{GROUPED}$"), ~plain), _vote(luhn(value), F.lit(True)), _vote(number.rlike(ISSUERS), F.lit(True))],
        "phone": lambda: [_vote(value.rlike(f"^{DIALLED}$"), F.lit(True)), _vote(F.length(number).between(9, 15), F.lit(True)), _vote(value.rlike(CALLING), F.lit(True))],
        # the same votes as those of cards and telephones, where it looks like one
        "number": lambda: [
            _vote(dialled | lettered | social | value.rlike(f"^(?:{GROUPED}|{NATIONAL})$"), ~plain),
            F.when(dialled, _vote(F.length(number).between(9, 15), F.lit(True))).when(iban, _vote(mod97(value), F.lit(True))).when(social, _vote(~value.rlike("^(?:000|666|9)|-00-|0000$"), F.lit(True))).when(of_card, _vote(luhn(value), F.lit(True))).otherwise(0),
            F.when(dialled, _vote(value.rlike(CALLING), F.lit(True))).when(iban, _vote(value.rlike(ACCOUNTS), F.lit(True))).when(of_card, _vote(number.rlike(ISSUERS), F.lit(True))).otherwise(0),
        ],
        "name": lambda: [
            _vote(~value.rlike(NAMELESS) & (titled | value.rlike(r"[ .]")), value.rlike(NAMELESS)),
            F.when(value.rlike(NAMELESS) | value.rlike(rf"(?:^|\x20){_any(NO_NAMES)}(?:\x20|$)"), -1).when(value.rlike(r"\p{Lu}\.|^(?:von|van|de|del|di|du)\x20"), 1).otherwise(0),
            _vote(value.rlike(rf"^{_any(names)}(?:\x20|$)") | value.rlike(rf"(?:^|\x20){_any(SURNAMES)}$")),
        ],
    }
    return [*by_kind[kind](), _vote(before.rlike(near), before.rlike(against)), _vote(after.rlike(behind), after.rlike(against_behind))]


def _family(kind: str, m: Column) -> Column:
    number = F.when(m["value"].startswith("+"), 3).when(m["value"].rlike("^[A-Z]"), 4).when(F.length(digits(m["value"])).between(12, 19), 2).otherwise(5)
    return number if kind == "number" else F.lit({"email": 0, "ip": 1, "card": 2, "phone": 3, "name": 6}[kind])


def _features(m: Column) -> list[Column]:
    """length, shape, left and right neighbour: what the classifier sees beside the votes."""
    value = m["value"]
    size = F.length(value)

    def beside(c: Column) -> Column:
        return F.when(c.rlike(r"^\s?$"), 0).when(c.rlike(r"^[\p{L}\p{N}]$"), 1).otherwise(2)

    return [
        F.when(size <= 8, 0).when(size <= 11, 1).when(size <= 15, 2).otherwise(3),
        F.when(value.rlike("^[0-9]+$"), 0).when(value.rlike("^[0-9 -]+$"), 1).when(value.rlike("^[+(]"), 2).otherwise(3),
        beside(F.right(m["before"], F.lit(1))),
        beside(F.left(m["after"], F.lit(1))),
    ]


def _coded(votes: list[Column], features: list[Column]) -> Column:
    """Votes and features as one number below CODES."""
    out, scale = F.lit(0), 1
    for value, size in [*((v + 1, 3) for v in votes), *zip(features, FEATURES.values(), strict=True)]:
        out, scale = out + value.cast("int") * scale, scale * size
    return out


def decoded(code: int) -> list[int]:
    """The votes of a code."""
    return [code // 3**i % 3 - 1 for i in range(len(LABELERS))]


def _slots(code, get):
    """Values of the classifier's features: votes, the pair of check and gazetteer, the others; `get` is x // a % b."""
    out, scale = [], 1
    for size in [3] * len(LABELERS) + list(FEATURES.values()):
        out.append(get(code, scale, size))
        scale *= size
    return [*out, out[1] * 3 + out[2]]


SLOTS = [3] * len(LABELERS) + [*FEATURES.values(), 9]


def _base(text: Column) -> dict[str, Column]:
    return {
        "email": found(text, EMAIL),
        "ip": F.filter(found(text, IP), lambda m: _is_address(m["value"])),
        "card": F.filter(found(text, CARD), lambda m: luhn(m["value"])),
        "phone": F.filter(found(text, PHONE), lambda m: _is_dialled(m["value"])),
    }


def _is_address(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike(r"^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _is_dialled(value: Column) -> Column:
    return F.length(digits(value)).between(9, 15)


def _without_base(text: Column) -> Column:
    """The text with base spans hidden; longer kinds first, so that none is cut by a shorter one."""
    hide = [(PHONE, _is_dialled), (CARD, luhn), (EMAIL, lambda v: F.lit(True)), (IP, _is_address)]

    def hidden(t: Column, rest: list) -> Column:
        # each text is bound to a name, as masked() reads it several times
        return let(masked(t, *rest[0]), lambda x: hidden(x, rest[1:])) if rest else t

    return hidden(text, hide)


def candidates(docs: DataFrame, keep: list[Column], text: str, names: list[str] = FIRST_NAMES) -> DataFrame:
    """keep, base (spans) and votes (array of start, kind, end, family, code for all candidates, base spans included)."""
    txt = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    more = let(_without_base(txt), lambda t: F.struct(found(t, NUMBER).alias("number"), found(t, name_pattern(names)).alias("name")))
    df = docs.select(*keep, *[c.alias(f"_{k}") for k, c in _base(txt).items()], more.alias("_more"))
    base = F.concat(*[as_spans(F.col(f"_{k}"), i) for i, k in enumerate(BASE)])

    def voted(kind: str) -> Column:
        number = KINDS.index(kind)
        spans = F.col(f"_{kind}") if kind in BASE else F.col("_more")[kind]
        return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end"), _family(kind, m).alias("family"), _coded(_votes(kind, m, names), _features(m)).alias("code")))

    return df.withColumns({"base": base, "votes": F.concat(*map(voted, KINDS))}).drop("_more", *[f"_{k}" for k in BASE])


@dataclass(frozen=True)
class SpanModel:
    """Per family: prior and reliabilities, P(vote | personal) and P(vote | not), by labeler; the classifier's weights by family, slot and value."""

    prior: dict[int, float] = field(default_factory=dict)
    reliability: dict[int, dict[str, tuple[dict[int, float], dict[int, float]]]] = field(default_factory=dict)
    bias: dict[int, float] = field(default_factory=dict)
    weights: dict[int, list[list[float]]] = field(default_factory=dict)

    def score(self, family: int, code: int) -> float:
        if family not in self.weights:
            return 0.5
        slots = _slots(code, lambda c, a, b: c // a % b)
        return _sigmoid(self.bias[family] + sum(w[v] for w, v in zip(self.weights[family], slots, strict=True)))

    def score_of(self, vote: Column) -> Column:
        """The same score of an element of `votes` as an expression: a few look-ups."""
        families = range(len(FAMILIES))
        z = F.get(F.array(*[F.lit(self.bias.get(f, 0.0)) for f in families]), vote["family"])
        slots = _slots(vote["code"], lambda c, a, b: F.floor(c / a).cast("int") % b)
        for j, (slot, size) in enumerate(zip(slots, SLOTS, strict=True)):
            flat = [w for f in families for w in (self.weights[f][j] if f in self.weights else [0.0] * size)]
            z = z + F.get(F.array(*map(F.lit, flat)), vote["family"] * size + slot)
        return 1 / (1 + F.exp(-z))


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def reliabilities(counts: dict[int, int], rounds: int = 40) -> tuple[float, dict[str, tuple[dict[int, float], dict[int, float]]], dict[int, float]]:
    """EM on the counts of vote patterns: prior, reliabilities among votes given and P(personal) by pattern.

    It starts from OPINIONS, which stay worth a tenth of each class, so that with few spans or unanimous votes the classes
    keep their meaning. A labeler without an opinion on a span says nothing about it.
    """
    total = sum(counts.values())
    post = {p: _sigmoid(sum(v * math.log(odds) for v, odds in zip(decoded(p), OPINIONS.values(), strict=True))) for p in counts}
    prior, table = 0.5, [({}, {}) for _ in LABELERS]
    for _ in range(rounds):
        mass = sum(n * post[p] for p, n in counts.items())
        prior = (mass + 1) / (total + 2)
        table = []
        for j, odds in enumerate(OPINIONS.values()):
            a, b = (1 + mass / 10) / (odds + 1), (1 + (total - mass) / 10) / (odds + 1)
            yes, no = {-1: a, 1: odds * a}, {-1: odds * b, 1: b}
            for p, n in counts.items():
                if v := decoded(p)[j]:
                    yes[v] += n * post[p]
                    no[v] += n * (1 - post[p])
            table.append(({v: x / sum(yes.values()) for v, x in yes.items()}, {v: x / sum(no.values()) for v, x in no.items()}))
        for p in counts:
            post[p] = _sigmoid(math.log(prior / (1 - prior)) + sum(math.log(table[j][0][v] / table[j][1][v]) for j, v in enumerate(decoded(p)) if v))
    return prior, dict(zip(LABELERS, table, strict=True)), post


def classifier(rows: list[tuple[int, float, float]], rounds: int = 200) -> tuple[float, list[list[float]]]:
    """Logistic regression on (code, weight, probability): steps of Newton's method along the diagonal, small enough for features that overlap."""
    bias, weights = 0.0, [[0.0] * n for n in SLOTS]
    slots = [(_slots(code, lambda c, a, b: c // a % b), w, y) for code, w, y in rows]
    for _ in range(rounds):
        slope, bend = [[0.0] * n for n in SLOTS], [[1.0] * n for n in SLOTS]
        slope_b, bend_b = 0.0, 1.0
        for values, w, y in slots:
            p = _sigmoid(bias + sum(weights[j][v] for j, v in enumerate(values)))
            gap, curve = w * (y - p), w * p * (1 - p)
            slope_b, bend_b = slope_b + gap, bend_b + curve
            for j, v in enumerate(values):
                slope[j][v] += gap
                bend[j][v] += curve
        rate = 2 / (len(SLOTS) + 1)
        bias += rate * slope_b / bend_b
        for j, w in enumerate(weights):
            for v in range(len(w)):
                w[v] += rate * (slope[j][v] - 0.1 * w[v]) / bend[j][v]
    return bias, weights


def fitted(counts: dict[tuple[int, int], int]) -> SpanModel:
    """From the spans' counts by (family, code): EM, then the classifier on its outcome, for each family.

    A span weighs the less the more others look like it (the square root of their number counts in all), so a frequent
    pattern can't drown the rest.
    """
    prior, reliability, bias, weights = {}, {}, {}, {}
    for family in sorted({f for f, _ in counts}):
        codes = {c: n for (f, c), n in counts.items() if f == family}
        patterns = defaultdict(int)
        for code, n in codes.items():
            patterns[code % VOTES] += n
        prior[family], reliability[family], post = reliabilities(patterns)
        bias[family], weights[family] = classifier([(c, math.sqrt(n), post[c % VOTES]) for c, n in sorted(codes.items())])
    return SpanModel(prior, reliability, bias, weights)


def fit(voted: DataFrame) -> SpanModel:
    """From the counts of all candidates' votes: a table of bounded size."""
    rows = voted.select(F.explode("votes").alias("v")).groupBy(F.col("v.family").alias("family"), F.col("v.code").alias("code")).count().collect()
    return fitted({(r["family"], r["code"]): r["count"] for r in rows})


def added(model: SpanModel, least: float = 0.5) -> Column:
    """The spans of `votes` that are not base ones and that the classifier takes for personal."""
    chosen = F.filter("votes", lambda v: (v["kind"] >= len(BASE)) & (model.score_of(v) > least))
    return F.transform(chosen, lambda v: F.struct(v["start"].alias("start"), v["kind"].alias("kind"), v["end"].alias("end")))


def personal_data(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", names: list[str] | None = None) -> DataFrame:
    """Per document: doc, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_number, n_name, n_doubted.

    n_doubted counts the base spans that the classifier takes for no personal data; they stay in spans all the same.
    `names` adds first names to the gazetteer; they go into the plan, so give thousands, not millions. Null texts are empty and have no spans; repeated rows
    each get a row; other columns are ignored. With no candidates at all the model is neutral and adds nothing.
    """
    voted, _ = saved(candidates(docs, [F.col(f"`{doc}`").alias("id")], text, FIRST_NAMES + list(names or [])), "votes")
    model = fit(voted)

    def count(kind: str, column: str) -> Column:
        return F.size(F.filter(column, lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    doubted = F.size(F.filter("votes", lambda v: (v["kind"] < len(BASE)) & (model.score_of(v) < 0.5))).cast("long")
    out = voted.withColumn("more", added(model))
    return out.select(F.col("id").alias(doc), *[count(k, "base") for k in BASE], F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), joined(F.concat("base", "more"), KINDS).alias("spans"), count("number", "more"), count("name", "more"), doubted.alias("n_doubted"))


def redact(docs: DataFrame, *, text: str = "text", length: str | None = None, names: list[str] | None = None) -> DataFrame:
    """docs with the spans in `text` replaced by their kinds in brackets and `length` (if named) set to the new length.

    All columns stay, whatever their names; a null text stays null. Texts are searched once: rows and votes are written
    to the shared folder.
    """
    columns = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{text}`").alias("txt"))
    voted, _ = saved(candidates(whole, [F.col("row")], "txt", FIRST_NAMES + list(names or [])), "private")
    txt = F.col("row").getField(text)
    clean = redacted(txt, F.concat("base", added(fit(voted))), KINDS)
    out = voted.withColumn("clean", F.when(txt.isNotNull(), clean))
    return out.select(*[F.col("clean").alias(c) if c == text else F.length("clean").cast(docs.schema[c].dataType).alias(c) if c == length else F.col("row").getField(c).alias(c) for c in columns])
