"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust a score.

Everything is a DataFrame expression. Spans are in code points, end exclusive.

Defined results: a null text counts as empty (no spans); repeated rows give repeated results; an
empty table gives an empty one; spans that start together stand in the order of KINDS; very long
texts take time in proportion to their length; other columns of the input are kept by `detect` and
never read, whatever their names (`pii_*` columns it adds win over columns of the same name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import let, match_spans, no_spans

# Possessive quantifiers and the \G-or-not-after test keep the leftmost matches of the plain patterns
# (nothing that follows could make them give characters back) but take linear time and constant stack
# on very long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# Only runs that can have the digits of a card: as runs are maximal, the shorter ones need no span.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Kinds the method adds to the four base ones.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])"  # where one may start; every such place is tried
#: Characters of an IBAN by country: the registry, and the countries that use one without being in it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST AO CV GW MZ", 26: "IS TR DZ IR", 27: "BI DJ FR GR IT MC MR SM CF CG CM GA GQ KM MG TD",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV BF BJ CI MA ML NE SN TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN_WIDTH = 48  # more than 34 characters, the spaces between groups of four and one that follows


def iban_pattern() -> str:
    """An IBAN at the start of a string, as long as its country's are; of unlisted codes the longest run of groups."""
    bounded = [rf"(?:{'|'.join(c.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items()]
    listed = "|".join(" ".join(IBAN_LENGTHS.values()).split())
    unlisted = rf"(?!{listed})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}+(?:\x20?[A-Z0-9]{{1,3}})?"
    return rf"^(?:{'|'.join([*bounded, unlisted])})(?![A-Za-z0-9])"


SSN = r"(?<![0-9-])(?!000|666|9[0-9]{2})[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
LOCAL_PHONE = r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9.-])"

OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)"
#: Credentials that their own form gives away: cloud and service keys, signed web tokens, private key blocks.
CREDENTIAL = (
    r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|AIza[0-9A-Za-z_-]{35}|xox[abprs]-[0-9A-Za-z-]{10,200}"
    r"|eyJ[A-Za-z0-9_-]{8,2000}+\.[A-Za-z0-9_-]{8,2000}+\.[A-Za-z0-9_-]{8,2000}+)(?![A-Za-z0-9_])|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
)
CREDENTIAL_GATE = r"AKIA|ASIA|gh[pousr]_|AIza|xox[abprs]-|eyJ|PRIVATE KEY-----"
# A value that is assigned to a telling name; entropy then tells it from a word of prose.
ASSIGNED = r"(?i)(?<![A-Za-z0-9])(?:password|passwd|pwd|secret|token|(?:api|access|secret|private|auth)[_-]?(?:key|token))[\"']?\x20{0,2}[:=]\x20{0,2}[\"']?"
SECRET = ASSIGNED + r"[A-Za-z0-9_.~+/=@!#$%^&*-]{8,200}"
ENTROPY = 2.5  # bits a character

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "local_phone", "credential", "secret")

#: kind -> (score on its own, words that raise it when they stand near)
CONTEXT = {
    "email": (0.9, ("mail", "e-mail", "contact", "write")),
    "ip": (0.6, ("ip", "address", "host", "server", "login")),
    "card": (0.8, ("card", "visa", "credit", "payment", "karte", "tarjeta", "carte")),
    "phone": (0.8, ("phone", "tel", "call", "mobile", "fax")),
    "iban": (0.9, ("iban", "account", "bank", "konto", "cuenta", "compte")),
    "ssn": (0.5, ("ssn", "social", "security", "taxpayer")),
    "local_phone": (0.5, ("phone", "tel", "call", "mobile", "fax")),
    "credential": (0.9, ("key", "aws", "token", "credentials", "access")),
    "secret": (0.7, ("login", "user", "username", "credentials", "auth", "account")),
}
WINDOW, BOOST, KEEP = 40, 0.35, 0.5


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def luhn(d: Column) -> Column:
    """True if a string of at most 20 digits passes Luhn; leading zeros add nothing."""
    s = F.lpad(d, 20, "0")
    twice = F.translate(s, "0123456789", "0246813579")
    parts = [F.substring(twice if i % 2 else s, i, 1).cast("int") for i in range(1, 21)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total % 10 == 0


def mod97(hit: Column) -> Column:
    """ISO 13616: move four characters to the end, letters become 10 to 35, remainder by 97 is 1."""
    s = F.regexp_replace(hit, " ", "")
    turned = F.concat(F.substr(s, F.lit(5)), F.substring(s, 1, 4))
    values = F.transform(F.split(turned, ""), lambda ch: F.conv(ch, 36, 10))
    number = F.array_join(values, "")
    return F.aggregate(F.split(number, ""), F.lit(0), lambda acc, ch: F.when(ch == "", acc).otherwise((acc * 10 + ch.cast("int")) % 97)) == 1


def entropy(s: Column) -> Column:
    """Bits a character of a short string."""
    share = lambda c: F.size(F.filter(F.split(s, ""), lambda x: x == c)) / F.length(s)
    return F.aggregate(F.array_distinct(F.filter(F.split(s, ""), lambda x: x != "")), F.lit(0.0), lambda a, c: let(share(c), lambda p: a - p * F.log2(p)))


def telling(s: Column) -> Column:
    """Whether an assigned value looks made and not written: letters and digits, and of high entropy."""
    return F.regexp_like(s, F.lit("[0-9]")) & F.regexp_like(s, F.lit("[A-Za-z]")) & (entropy(s) >= ENTROPY)


def found(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind: array<struct<start,end,hit>>."""
    has_digit = F.regexp_like(text, F.lit("[0-9]"))
    pattern, gate, ok = {
        "email": (EMAIL, F.contains(text, F.lit("@")), None),
        "ip": (IP, F.regexp_like(text, F.lit(r"[0-9]\.[0-9]")), lambda h: F.regexp_like(h, F.lit(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"))),
        "card": (CARD, has_digit, lambda h: F.length(digits(h)).between(14, 19) & luhn(digits(h))),
        "phone": (PHONE, F.contains(text, F.lit("+")), lambda h: F.length(digits(h)).between(10, 15)),
        "iban": (IBAN, F.regexp_like(text, F.lit(r"[A-Z]{2}[0-9]{2}")), lambda h: F.length(F.regexp_replace(h, " ", "")).between(15, 34) & mod97(h)),
        "ssn": (SSN, F.regexp_like(text, F.lit(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")), None),
        "local_phone": (LOCAL_PHONE, F.regexp_like(text, F.lit(r"[0-9]{3}[-.][0-9]{4}")), None),
        "credential": (CREDENTIAL, F.regexp_like(text, F.lit(CREDENTIAL_GATE)), None),
        "secret": (SECRET, F.regexp_like(text, F.lit(ASSIGNED)), telling),
    }[kind]
    spans = F.when(gate, match_spans(text, pattern)).otherwise(no_spans())
    if kind == "secret":  # the span is the value alone
        value = lambda h: F.regexp_replace(h, "^" + ASSIGNED, "")
        spans = F.transform(spans, lambda s: let(value(s["hit"]), lambda v: F.struct((s["end"] - F.length(v)).alias("start"), s["end"].alias("end"), v.alias("hit"))))
    if kind == "iban":
        whole = lambda s: F.regexp_extract(F.substr(text, s["start"] + 1, F.lit(IBAN_WIDTH)), iban_pattern(), 0)
        spans = F.transform(spans, lambda s: let(whole(s), lambda h: F.struct(s["start"].alias("start"), (s["start"] + F.length(h)).alias("end"), h.alias("hit"))))
    return F.filter(spans, lambda s: ok(s["hit"])) if ok else spans


def scored(text: Column, spans: Column, kind: str) -> Column:
    """Spans of a kind with their place in KINDS and a score from nearby context words."""
    alone, words = CONTEXT[kind]
    pattern = r"(?i)(?<![\p{L}])(?:" + "|".join(w.replace("-", r"\-") for w in words) + r")(?![\p{L}])"

    def one(s: Column) -> Column:
        near = F.concat(F.substr(text, F.greatest(s["start"] - WINDOW, F.lit(0)) + 1, F.least(s["start"], F.lit(WINDOW))), F.lit(" "), F.substr(text, s["end"] + 1, F.lit(WINDOW)))
        score = F.least(F.lit(1.0), F.lit(alone) + F.when(F.regexp_like(near, F.lit(pattern)), F.lit(BOOST)).otherwise(F.lit(0.0)))
        return F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), s["end"].alias("end"), F.lit(kind).alias("kind"), score.alias("score"))

    return F.transform(spans, one)


def detect(docs: DataFrame, text: str = "text", keep: float = KEEP) -> DataFrame:
    """Add pii_spans: array<struct<start,k,end,kind,score>> by start, then kind as listed in KINDS.

    Base kinds stay whatever their score; a kind the method adds stays only with a score of `keep`
    or more and where no base span overlaps it.
    """
    src = docs.withColumn("pii_text", F.coalesce(F.col(text), F.lit("")))
    t = F.col("pii_text")
    for kind in KINDS:  # a projection of their own, so that each list is made once
        src = src.withColumn(f"pii_{kind}", found(t, kind))
    base = F.concat(*[scored(t, F.col(f"pii_{k}"), k) for k in BASE])
    added = F.concat(*[scored(t, F.col(f"pii_{k}"), k) for k in KINDS[len(BASE):]])
    src = src.withColumn("pii_base", base)
    added = F.filter(added, lambda a: (a["score"] >= keep) & ~F.exists(F.col("pii_base"), lambda b: (b["start"] < a["end"]) & (a["start"] < b["end"])))
    src = src.withColumn("pii_spans", F.array_sort(F.concat("pii_base", added)))
    return src.drop("pii_text", "pii_base", *[f"pii_{k}" for k in KINDS])


def redact(docs: DataFrame, text: str = "text", keep: float = KEEP) -> DataFrame:
    """Replace each span by [KIND]; overlapping spans become one replacement named by the first."""
    df = detect(docs, text, keep)
    t = F.coalesce(F.col(text), F.lit(""))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.substr(t, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate("pii_spans", zero, step, lambda acc: F.concat(acc["out"], F.substr(t, acc["at"] + 1)))
    return df.withColumn(text, F.when(F.col(text).isNull(), F.lit(None)).when(F.size("pii_spans") == 0, t).otherwise(done))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """The columns of op4; `scores` has the score of each of `spans`, in their order, n_secret credentials and secrets, n_spans all."""
    df = detect(docs.select("doc_id", "text"))
    base = F.filter("pii_spans", lambda s: s["k"] < len(BASE))
    count = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    secrets = F.size(F.filter("pii_spans", lambda s: s["kind"].isin("credential", "secret"))).cast("long").alias("n_secret")
    return df.select("doc_id", *[count(k) for k in BASE], secrets, F.size("pii_spans").cast("long").alias("n_spans"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"), F.array_join(F.transform("pii_spans", lambda s: F.format_string("%.2f", s["score"])), ",").alias("scores"))
