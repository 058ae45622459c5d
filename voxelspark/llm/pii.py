"""Personal data: regular expressions propose spans, checksums and ranges confirm them, context words set the score.

Everything runs as Spark SQL functions. The pieces of a text between the matches of an expression give the matches'
places: a match starts behind all pieces and matches before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL, HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: Kind -> expression. Starts inside a run of the same characters can't match where the run's start doesn't, so a
#: guard skips them; possessive loops keep the search linear in texts of any length.
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[{HOST}]++(?:\.[{HOST}]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+)(.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
}
BASE_KINDS = ["email", "ip", "card", "phone"]
#: Needed characters, as a cheap test before the expression.
NEEDS = {"email": "[@]", "phone": "[+][0-9]", "iban": "[A-Z][A-Z][0-9][0-9]"}
#: Kind -> (score of a confirmed match, words near it, before or after, that raise the score).
SCORES = {
    "email": (0.95, "mail|contact|write"),
    "ip": (0.6, "ip|host|server|address|login"),
    "card": (0.8, "card|visa|master|amex|credit|tarjeta|carte|karte"),
    "phone": (0.7, "phone|tel|call|fax|mobile|llame|appel|anruf"),
    "iban": (0.8, "iban|account|bank|cuenta|compte|konto"),
    "national_id": (0.3, "ssn|social|tax|security|id"),
    "local_phone": (0.3, "phone|tel|call|fax|mobile|llame|appel|anruf"),
}
BOOST, ACCEPT, CONTEXT_CHARS = 0.3, 0.5, 48
#: Neighbouring matches that can lie within the context; the shortest match has five characters.
NEIGHBOURS = CONTEXT_CHARS // 5 + 1


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _mod_97(iban: Column) -> Column:
    """Remainder of an account number, its first four characters moved behind, letters as 10 to 35."""
    plain = F.regexp_replace(iban, " ", "")
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    values = F.transform(F.split(moved, ""), lambda c: F.when(c == "", F.lit(None)).when(c <= "9", F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    step = lambda acc, v: F.when(v.isNull(), acc).when(v > 9, (acc * 100 + v) % 97).otherwise((acc * 10 + v) % 97)
    return F.aggregate(values, F.lit(0), step)


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(x, r"\."), part)
    if kind == "card":
        return F.length(_digits(x)).between(16, 19) & F.call_function("luhn_check", _digits(x))
    if kind == "phone":
        return F.length(_digits(x)).between(8, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(x, " ", "")).between(15, 34) & (_mod_97(x) == 1)
    if kind == "national_id":
        return ~x.rlike("^(000|666|9..)|-00-|-0000$")
    return F.lit(True)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: list[str] | None = None) -> DataFrame:
    """One row for each row: the id, and for each kind an array of (start, end, score) in code points, end exclusive.

    Base kinds keep every confirmed match; the other kinds keep those that reach the accepted score with their context.
    Null or empty text: empty arrays. Repeated rows and ties: each row is searched alone. Null ids are carried. Extra
    columns are ignored. An empty table gives an empty result. Texts of any length are searched whole. No shuffle.
    """
    kinds = list(PATTERNS) if kinds is None else kinds
    none = F.array().cast("array<string>")
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    matches = {}
    for kind in kinds:
        hit = F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))
        matches[kind] = F.when(F.col("text").rlike(NEEDS.get(kind, "[0-9]")), hit).otherwise(none)
    found = found.select("doc_id", "text", *[c.alias(f"m_{k}") for k, c in matches.items()])
    gaps = {k: F.when(F.size(f"m_{k}") > 0, F.split("text", PATTERNS[k], -1)).otherwise(none) for k in kinds}
    found = found.select("doc_id", *[f"m_{k}" for k in kinds], *[c.alias(f"g_{k}") for k, c in gaps.items()])

    def starts(kind: str) -> Column:
        zipped = F.zip_with(f"m_{kind}", F.slice(f"g_{kind}", 1, F.size(f"m_{kind}")), lambda m, g: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct((acc["at"] + x["g"] + x["m"]).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x["g"])).alias("out"))
        return F.aggregate(zipped, zero, step, lambda acc: acc["out"])

    def pieces(kind: str) -> Column:
        """The ends of each gap, with the match behind it as blanks: what contexts are made of."""
        ends = lambda g: F.when(F.length(g) > 2 * CONTEXT_CHARS, F.concat(F.left(g, F.lit(CONTEXT_CHARS)), F.right(g, F.lit(CONTEXT_CHARS)))).otherwise(g)
        blank = lambda m: F.repeat(F.lit(" "), F.least(F.coalesce(F.length(m), F.lit(0)), F.lit(CONTEXT_CHARS)))
        return F.zip_with(f"g_{kind}", f"m_{kind}", lambda g, m: F.struct(ends(g).alias("gap"), F.concat(ends(g), blank(m)).alias("both")))

    found = found.select("*", *[starts(k).alias(f"s_{k}") for k in kinds], *[pieces(k).alias(f"p_{k}") for k in kinds])

    def spans(kind: str) -> Column:
        score, words = SCORES[kind]

        def span(m: Column, i: Column) -> Column:
            start = F.get(F.col(f"s_{kind}"), i)
            piece = F.col(f"p_{kind}")
            earlier = F.slice(piece, F.greatest(i + 1 - NEIGHBOURS, F.lit(1)), F.least(i, F.lit(NEIGHBOURS)))
            before = F.right(F.concat(F.array_join(earlier["both"], ""), F.get(piece, i)["gap"]), F.lit(CONTEXT_CHARS))
            after = F.left(F.array_join(F.slice(piece, i + 2, F.lit(NEIGHBOURS + 1))["both"], ""), F.lit(CONTEXT_CHARS))
            near = F.lower(before).rlike(rf"\b(?:{words})") | F.lower(after).rlike(rf"\b(?:{words})")
            boosted = F.least(F.lit(1.0), F.lit(score) + F.when(near, BOOST).otherwise(0.0))
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), F.round(boosted, 3).alias("score"), _valid(kind, m).alias("valid"))

        kept = F.filter(F.transform(f"m_{kind}", span), lambda x: x["valid"] & (F.lit(kind in BASE_KINDS) | (x["score"] >= ACCEPT)))
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score")))

    return found.select("doc_id", *[F.when(F.size(f"m_{k}") > 0, spans(k)).otherwise(F.array().cast("array<struct<start:int,end:int,score:double>>")).alias(k) for k in kinds])


def pii_digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of their spans, and all spans as text."""
    kinds = [c for c in found.columns if c != "doc_id"]

    def texts(kind: str) -> Column:
        return F.transform(kind, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))

    base = F.array_join(F.concat(*[texts(k) for k in BASE_KINDS]), ",")
    every = F.array_join(F.concat(*[texts(k) for k in [*BASE_KINDS, *[k for k in kinds if k not in BASE_KINDS]]]), ",")
    scores = F.concat(*[F.transform(k, lambda x: x["score"]) for k in kinds])
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS], F.sha2(base, 256).alias("base_sha256"), every.alias("spans"), F.coalesce(F.array_max(scores), F.lit(0.0)).alias("max_score"))
