"""Personal data replaced by format-preserving pseudonyms, in DataFrame functions only.

Numbers and dates are found by pattern, validated (Luhn, IBAN checksum, octets, calendar), and permuted within
their format by a keyed Feistel network: a card stays a valid card, a date a date, and equal values get equal
pseudonyms in every document, so links between documents survive. The permutation can be undone with the key.
Mail addresses have no fixed format; they become a keyed name under a reserved domain.

Every document is handled by itself: it is split at its candidates, the candidates are replaced, and the
pieces are joined again. Nothing is shuffled, and documents without a candidate are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "card", "iban", "phone", "ssn", "ip", "date")

# Patterns begin and end at word borders, and their repetitions are bounded, so a text is scanned in linear time.
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9\-])",
    "iban": _BEFORE + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _AFTER,
    "date": r"(?<![\p{L}\p{N}.\-/])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![\p{L}\p{N}\-/])",
    "ssn": r"(?<![\p{L}\p{N}\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}\-])",
    "ip": r"(?<![\p{L}\p{N}.])(?:" + _OCTET + r"\.){3}" + _OCTET + r"(?!\.?[\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .\-]?[0-9]{2,4}){2,3}"
    r"|\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4})(?![.\-/]?[\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}\-])[0-9](?:[ \-]?[0-9]){12,18}" + _AFTER,
}
ANY = "|".join(f"(?:{PATTERNS[k]})" for k in ("email", "iban", "date", "ssn", "ip", "phone", "card"))

#: Days of 400 Gregorian years, which always have the same number: 773 * 189.
_DAYS, _DAY_ZERO = 146097, "1700-01-01"


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once; inside a lambda an expression is computed at every use."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def _keyed(key: str, tweak: str, turn: Column, half: Column, below: Column) -> Column:
    """A pseudo-random number below `below`, of at most 15 digits, for one half in one turn."""
    digest = F.sha2(F.concat_ws(":", F.lit(key), F.lit(tweak), turn.cast("string"), half.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), below)


def feistel(value: Column, high: Column, low: Column, key: str, tweak: str, undo: bool = False) -> Column:
    """A keyed permutation of 0 .. high * low - 1. The halves run over `high` and `low`; their product fits a long."""
    turns = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if undo else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    sign = -1 if undo else 1
    start = F.struct(F.call_function("div", value, low).alias("a"), F.pmod(value, low).cast("long").alias("b"))

    def turn(state: Column, r: Column) -> Column:
        a, b = state["a"], state["b"]
        even = r % 2 == 0
        return F.struct(
            F.when(even, F.pmod(a + sign * _keyed(key, tweak, r, b, high), high)).otherwise(a).cast("long").alias("a"),
            F.when(even, b).otherwise(F.pmod(b + sign * _keyed(key, tweak, r, a, low), low)).cast("long").alias("b"),
        )

    return F.aggregate(turns, start, turn, lambda s: s["a"] * low + s["b"])


def _ten(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**k).cast("long") for k in range(19)]), (n + 1).cast("int"))


def _digits_permuted(digits: Column, key: str, tweak: str, undo: bool) -> Column:
    """A string of 2 to 18 digits, permuted among all strings of its length."""

    def permuted(state: Column) -> Column:
        n = state["n"]
        number = feistel(state["value"], state["high"], state["low"], key, tweak, undo)
        return F.lpad(number.cast("string"), n, "0")

    def sized(d: Column) -> Column:
        n = F.length(d)
        half = F.floor(n / 2)
        return F.struct(
            n.alias("n"), d.cast("long").alias("value"), _ten(n - half).alias("high"), _ten(half).alias("low")
        )

    return _let(_let(digits, sized), permuted)


def _only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _into(shape: Column, digits: Column) -> Column:
    """`shape` with its digits replaced one by one."""

    def fill(d: Column) -> Column:
        return F.aggregate(
            F.split(shape, ""),
            F.struct(F.lit("").alias("text"), F.lit(0).alias("used")),
            lambda s, c: F.when(
                c.between("0", "9"),
                F.struct(F.concat(s["text"], F.substr(d, s["used"] + 1, F.lit(1))).alias("text"), (s["used"] + 1).alias("used")),
            ).otherwise(F.struct(F.concat(s["text"], c).alias("text"), s["used"].alias("used"))),
            lambda s: s["text"],
        )

    return _let(digits, fill)


def luhn_sum(digits: Column, first: int) -> Column:
    """Luhn sum modulo 10; the last digit is doubled if `first` is 1, else the one before it."""
    return F.aggregate(
        F.reverse(F.split(digits, "")),
        F.struct(F.lit(0).alias("sum"), F.lit(first).alias("turn")),
        lambda s, c: F.struct(
            (s["sum"] + F.when(s["turn"] == 0, c.cast("int")).otherwise(F.substr(F.lit("0246813579"), c.cast("int") + 1, F.lit(1)).cast("int"))).alias("sum"),
            (1 - s["turn"]).alias("turn"),
        ),
        lambda s: s["sum"] % 10,
    )


def _mod97(alphanumeric: Column) -> Column:
    """The remainder by 97 of a string whose letters count from 10 to 35."""
    return F.aggregate(
        F.split(alphanumeric, ""),
        F.lit(0),
        lambda r, c: F.when(c.between("0", "9"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97),
    )


def _iban_checked(text: Column) -> Column:
    plain = F.regexp_replace(text, " ", "")
    return _mod97(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))) == 1


def _card(text: Column, key: str, undo: bool) -> Column:

    def checked(other: Column) -> Column:
        return F.concat(other, F.pmod(10 - luhn_sum(other, 1), F.lit(10)).cast("string"))

    body = _let(_only_digits(text), lambda d: F.substr(d, F.lit(1), F.length(d) - 1))
    return _into(text, _let(_digits_permuted(body, key, "card", undo), checked))


def _iban(text: Column, key: str, undo: bool) -> Column:
    """Country and letters stay; the last digits are permuted, and the check digits computed anew."""

    def moved(digits: Column) -> Column:
        kept = F.greatest(F.length(digits) - 18, F.lit(0))
        return F.concat(F.substr(digits, F.lit(1), kept), _digits_permuted(F.substr(digits, kept + 1), key, "iban", undo))

    def changed(plain: Column) -> Column:
        country, body = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5))

        def checked(account: Column) -> Column:
            check = F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
            return F.concat(country, check, account)

        return _let(_into(body, _let(_only_digits(body), moved)), checked)

    def spaced(value: Column) -> Column:  # spaces go back where they were
        return F.aggregate(
            F.split(text, ""),
            F.struct(F.lit("").alias("text"), F.lit(0).alias("used")),
            lambda s, c: F.when(
                c == " ", F.struct(F.concat(s["text"], c).alias("text"), s["used"].alias("used"))
            ).otherwise(
                F.struct(F.concat(s["text"], F.substr(value, s["used"] + 1, F.lit(1))).alias("text"), (s["used"] + 1).alias("used"))
            ),
            lambda s: s["text"],
        )

    return _let(_let(F.regexp_replace(text, " ", ""), changed), spaced)


def _phone(text: Column, key: str, undo: bool) -> Column:
    """The country code stays."""

    def moved(rest: Column) -> Column:
        return _into(rest, _digits_permuted(_only_digits(rest), key, "phone", undo))

    code = F.regexp_extract(text, r"^(\+[0-9]{1,3}(?=[ .\-(]))?", 0)
    return F.concat(code, _let(F.substr(text, F.length(code) + 1), moved))


def _ip(text: Column, key: str, undo: bool) -> Column:
    parts = F.split(text, r"\.")
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n * 256 + p.cast("long"))
    side = F.lit(65536).cast("long")

    def dotted(other: Column) -> Column:
        return F.concat_ws(".", *[F.pmod(F.shiftright(other, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])

    return _let(feistel(number, side, side, key, "ip", undo), dotted)


_DATE_FORMS = (("-", "yyyy-MM-dd"), ("/", "dd/MM/yyyy"), (".", "dd.MM.yyyy"))


def _date_of(text: Column) -> Column:
    """The day a text names, null if there is none. Slashes may put the month first."""
    iso = F.when(text.contains("-"), text).otherwise(
        F.concat_ws("-", F.substr(text, F.lit(7), F.lit(4)), F.substr(text, F.lit(4), F.lit(2)), F.substr(text, F.lit(1), F.lit(2)))
    )
    swapped = F.concat_ws("-", F.substr(text, F.lit(7), F.lit(4)), F.substr(text, F.lit(1), F.lit(2)), F.substr(text, F.lit(4), F.lit(2)))
    return F.coalesce(iso.try_cast("date"), F.when(text.contains("/"), swapped.try_cast("date")))


def _date(text: Column, key: str, undo: bool) -> Column:
    zero = F.lit(_DAY_ZERO).cast("date")
    # a month-first date stays month-first, or it would name another day when read back
    month_first = text.contains("/") & (F.substr(text, F.lit(4), F.lit(2)).cast("int") > 12)

    def moved(day: Column) -> Column:
        era = F.pmod(day, F.lit(_DAYS))
        other = feistel(era, F.lit(773).cast("long"), F.lit(189).cast("long"), key, "date", undo)
        return F.date_add(zero, (day - era + other).cast("int"))

    def written(other: Column) -> Column:
        forms = F.coalesce(*[F.when(text.contains(sign), F.date_format(other, form)) for sign, form in _DATE_FORMS])
        return F.when(month_first, F.date_format(other, "MM/dd/yyyy")).otherwise(forms)

    return _let(_let(F.datediff(_date_of(text), zero).cast("long"), moved), written)


def _email(text: Column, key: str) -> Column:
    name = F.sha2(F.concat_ws(":", F.lit(key), F.lit("email"), F.lower(text)), 256)
    return F.concat(F.lit("user-"), F.substring(name, 1, 16), F.lit("@example.invalid"))


def kind_of(text: Column) -> Column:
    """The kind of a candidate, null if it does not validate."""
    digits = _only_digits(text)

    def whole(kind: str) -> Column:
        return text.rlike(f"^(?:{PATTERNS[kind]})$")

    return (
        F.when(text.contains("@"), F.lit("email"))
        .when(whole("iban"), F.when(_iban_checked(text) & (F.length(_only_digits(F.substr(text, F.lit(5)))) > 1), F.lit("iban")))
        .when(whole("date"), F.when(_date_of(text).isNotNull(), F.lit("date")))
        .when(whole("ssn"), F.lit("ssn"))
        .when(whole("ip"), F.lit("ip"))
        .when(whole("phone"), F.lit("phone"))
        .when(whole("card"), F.when((luhn_sum(digits, 0) == 0) & digits.rlike("[1-9]"), F.lit("card")))
    )


def pseudonym(text: Column, kind: Column, key: str, undo: bool = False) -> Column:
    """The pseudonym of a value of a kind; with `undo` the value of a pseudonym, but for mail addresses."""
    return (
        F.when(kind == "email", text if undo else _email(text, key))
        .when(kind == "card", _card(text, key, undo))
        .when(kind == "iban", _iban(text, key, undo))
        .when(kind == "phone", _phone(text, key, undo))
        .when(kind == "ssn", _into(text, _digits_permuted(_only_digits(text), key, "ssn", undo)))
        .when(kind == "ip", _ip(text, key, undo))
        .when(kind == "date", _date(text, key, undo))
        .otherwise(text)
    )


def _is(kind: str):
    return lambda k: k == kind


def pseudonymise(
    docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", undo: bool = False
) -> DataFrame:
    """One row per input row: id, text, n_pii, and a count per kind (n_email, n_card, ...).

    A null text stays null, with counts of zero; a text without personal data stays as it is. Repeated rows
    give repeated results; other columns are ignored; an empty table gives an empty result. `undo` gives back
    what was there, but for mail addresses and for dates with slashes that put the month first.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # no pattern matches without a digit or an at sign: most texts are passed by one scan for either
    candidates = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    found = F.coalesce(candidates, F.array().cast("array<string>"))
    # a generator keeps the optimiser from computing these once for every use
    rows = rows.withColumn("found", F.explode(F.array(found)))
    rows = rows.withColumn("kinds", F.explode(F.array(F.transform("found", kind_of))))
    replaced = F.zip_with("found", "kinds", lambda value, kind: pseudonym(value, kind, key, undo))
    between = F.split(text, ANY, -1)
    joined = F.array_join(F.flatten(F.zip_with(between, replaced, lambda b, r: F.array(b, F.coalesce(r, F.lit(""))))), "")
    personal = F.filter("kinds", lambda k: k.isNotNull())
    counts = [F.size(F.filter("kinds", _is(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return rows.select(
        F.col("id").alias(id_col),
        F.when(F.size(personal) > 0, joined).otherwise(text).alias("text"),
        F.size(personal).cast("long").alias("n_pii"),
        *counts,
    )
