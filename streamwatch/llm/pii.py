"""Personal data in texts: patterns propose spans, checksums confirm them, context words adjust their scores.

DataFrame operations only. Spans are found kind by kind with two scans of the text: the matches and the pieces between
them. Positions (code points, end exclusive) are sums of lengths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths are summed up in runs of so many matches, so that a text with very many stays cheap.
RUN = 256
#: Characters on each side of a match in which context words count.
CONTEXT = 48


#: Characters of an account number by the countries that use such numbers.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = "|".join(rf"(?:{'|'.join(codes.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items())


@dataclass(frozen=True)
class Kind:
    """base: stays whatever its score. need: a text without a match of it has no match of the pattern."""

    name: str
    pattern: str
    need: str
    base: bool
    score: float
    words: str
    against: str = "example|sample|version|test"


#: A run's first character starts any match in it, hence the look-behinds; \G lets the next match follow the last one.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True, 0.9, "mail|contact|write|kontakt|correo|courriel"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", True, 0.6, "ip|host|server|address|login|adresse"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]", True, 0.8, "card|visa|credit|payment|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", True, 0.7, "phone|call|tel|mobile|fax|telefon"),
    Kind("iban", rf"(?<![A-Za-z0-9])(?:{IBAN})(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", False, 0.8, "iban|bank|account|konto|compte|cuenta"),
    Kind("national_id", r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])", "-", False, 0.3, "ssn|social|security|national"),
)
#: Spans that the method adds need such a score.
THRESHOLD = 0.5
LIFT = 0.3


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check; every second digit from the right counts twice, as its digit sum."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    twice = lambda i: F.when((n - i) % 2 == 1, value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0)).otherwise(value(i))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + twice(i)) % 10 == 0


def mod97(match: Column) -> Column:
    """Whether an account number is 1 modulo 97 with its first four characters moved to the end and letters as 10 to 35."""
    plain = F.regexp_replace(match, r"\x20", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    code = lambda i: F.ascii(F.substring(turned, i, F.lit(1)))
    step = lambda a, i: F.when(code(i) < 65, a * 10 + code(i) - 48).otherwise(a * 100 + code(i) - 55) % 97
    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(match) > 40, False).otherwise(F.when(F.length(_digits(match)).between(14, 19), luhn(_digits(match))).otherwise(False))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    if kind == "iban":
        return mod97(match)
    return F.lit(True)


def _sums(lengths: Column) -> Column:
    """The sum up to and with each element: within runs first, then the runs' own sums are added."""
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(lengths) - 1) / RUN).cast("int"))), lambda k: F.slice(lengths, k * RUN + 1, RUN))
    step = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["sums"], F.array(a["at"] + x)).alias("sums"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("sums"))
    inner = F.transform(runs, lambda run: F.aggregate(run, zero, step, lambda a: a["sums"]))
    begun = F.aggregate(inner, zero, lambda a, s: F.struct((a["at"] + F.coalesce(F.element_at(s, -1), F.lit(0))).alias("at"), F.concat(a["sums"], F.array(a["at"])).alias("sums")), lambda a: a["sums"])
    return F.flatten(F.zip_with(inner, begun, lambda s, at: F.transform(s, lambda x: x + at)))


def with_matches(df: DataFrame, text: str, kind: Kind, prefix: str = "_") -> DataFrame:
    """Adds the kind's matches and the pieces around them (one more than matches)."""
    col = F.col(text)
    there = F.contains(col, F.lit(kind.need)) if len(kind.need) == 1 else col.rlike(kind.need)
    none = F.array().cast("array<string>")
    m, p = f"{prefix}m_{kind.name}", f"{prefix}p_{kind.name}"
    df = df.withColumn(m, F.when(there, F.regexp_extract_all(col, F.lit(kind.pattern), F.lit(0))).otherwise(none))
    return df.withColumn(p, F.when(F.size(m) > 0, F.split(col, kind.pattern, -1)).otherwise(none))


def _score(kind: Kind, left: Column, right: Column) -> Column:
    around = F.lower(F.concat_ws(" ", F.right(left, F.lit(CONTEXT)), F.substring(right, 1, CONTEXT)))
    lift = F.when(around.rlike(rf"\b(?:{kind.words})"), LIFT).otherwise(0.0) - F.when(around.rlike(rf"\b(?:{kind.against})\b"), LIFT / 2).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.lit(kind.score) + lift), 3)


def kept(kind: Kind, prefix: str = "_") -> Column:
    """For each match, whether it stays: confirmed, and a base kind or of enough score."""
    m, p = F.col(f"{prefix}m_{kind.name}"), F.col(f"{prefix}p_{kind.name}")
    if kind.base:
        return F.transform(m, lambda x: _confirmed(kind.name, x))
    return F.transform(m, lambda x, i: _confirmed(kind.name, x) & (_score(kind, F.get(p, i), F.get(p, i + 1)) >= THRESHOLD))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds spans: an array of (start, kind_no, kind, end, score, match) in order of start, then kind.

    Matches of a kind are leftmost and don't overlap; those that fail their check are dropped without retries. Null
    texts count as empty. Columns of docs keep their names; those that begin with _pii_ are replaced.
    """
    pre = "_pii_"
    df = docs.withColumn(f"{pre}text", F.coalesce(F.col(text), F.lit("")))
    for kind in KINDS:
        df = with_matches(df, f"{pre}text", kind, pre)
    # code points up to the end of each piece and match in turn
    for kind in KINDS:
        m, p = F.col(f"{pre}m_{kind.name}"), F.col(f"{pre}p_{kind.name}")
        ends = _sums(F.transform(m, lambda x, i: (F.length(F.get(p, i)) + F.length(x)).cast("long")))
        df = df.withColumn(f"{pre}e_{kind.name}", F.when(F.size(m) > 0, ends).otherwise(F.array().cast("array<bigint>")))
    arrays = []
    for no, kind in enumerate(KINDS):
        m, p, e = (F.col(f"{pre}{x}_{kind.name}") for x in "mpe")
        spans = F.transform(m, lambda x, i: F.struct(
            (F.get(e, i) - F.length(x)).alias("start"), F.lit(no).alias("kind_no"), F.lit(kind.name).alias("kind"), F.get(e, i).alias("end"),
            _score(kind, F.get(p, i), F.get(p, i + 1)).alias("score"), x.alias("match"), _confirmed(kind.name, x).alias("ok"),
        ))
        arrays.append(F.filter(spans, lambda s: s["ok"] & (F.lit(kind.base) | (s["score"] >= THRESHOLD))))
    df = df.withColumn("spans", F.array_sort(F.concat(*arrays)))
    return df.drop(*[c for c in df.columns if c.startswith(pre)])


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts of the base kinds, base_sha256, spans as text, and n_more (added spans).

    Null and empty texts have no spans. Null ids and repeated rows are answered row by row; an empty table gives none.
    """
    base = [k.name for k in KINDS if k.base]
    found = find(docs.select("doc_id", "text"))
    own = F.filter("spans", lambda s: s["kind"].isin(base))
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(_listed(own), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), (F.size("spans") - F.size(own)).cast("long").alias("n_more"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of a kind that stays replaced by the kind in brackets, kind after kind (KINDS' order).

    A later kind is looked for in what the earlier ones left. Null texts stay null; n_chars, if there, follows the text.
    """
    names = docs.columns
    # the row is one column, so that none of its own is overwritten, whatever it is called
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_pii_row"), F.coalesce(F.col(text), F.lit("")).alias("_pii_text"))
    for kind in KINDS:
        df = with_matches(df, "_pii_text", kind, "_pii_")
        df = df.withColumn("_pii_k", kept(kind, "_pii_"))
        m, p, k = F.col(f"_pii_m_{kind.name}"), F.col(f"_pii_p_{kind.name}"), F.col("_pii_k")
        parts = F.transform(m, lambda x, i: F.concat(F.get(p, i), F.when(F.get(k, i), F.lit(f"[{kind.name.upper()}]")).otherwise(x)))
        df = df.withColumn("_pii_text", F.when(F.exists(k, lambda x: x), F.concat(F.array_join(parts, ""), F.element_at(p, -1))).otherwise(F.col("_pii_text")))
    own = lambda c: F.col("_pii_row").getField(c)
    new = F.when(own(text).isNotNull(), F.col("_pii_text"))
    values = {text: new} | ({"n_chars": F.when(new.isNotNull(), F.length(new)).otherwise(own("n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {})
    return df.select(*[values.get(c, own(c)).alias(c) for c in names])
