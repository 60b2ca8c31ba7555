"""Format-preserving pseudonyms for personal data.

Validated values (payment cards by check digit, account numbers by remainder,
dates by the calendar, and so on) are permuted within their own format by a keyed
Feistel network: the same value has the same pseudonym in every text, different
values have different ones, and a pseudonym passes the same validation.  With the
key the permutation can be reversed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .exprs import clear_of, interleave, let, pieces_and_matches, set_apart

ROUNDS = 8
#: Written formats, in the order in which they are tried at a place.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
FORMATS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9A-Za-z./-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2})(?![0-9A-Za-z/-]|\.[0-9])",
    "ssn": r"(?<![0-9-])(?!000|666)[0-8][0-9]{2}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{13,19})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+1[ .-]?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[2-9][0-9]{2}[.-][2-9][0-9]{2}[.-][0-9]{4})(?![0-9])",
}
ANY = "|".join(FORMATS.values())
DATE_STYLES = (("^....-", "yyyy-MM-dd"), (r"^..\.", "dd.MM.yyyy"), ("^../", "MM/dd/yyyy"))
FIRST_DAY, DAYS = "1900-01-01", 73049      # to 2099-12-31
DAY_HALVES = (271, 270)                    # their product is just above DAYS


def _digest(key: str, *parts) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[p if isinstance(p, Column) else F.lit(p) for p in parts]), 256)


def _draw(key: str, *parts) -> Column:
    return F.conv(F.substring(_digest(key, *parts), 1, 15), 16, 10).cast("bigint")


def _rounds(backward: bool) -> Column:
    steps = range(ROUNDS, 0, -1) if backward else range(1, ROUNDS + 1)
    return F.array(*[F.lit(i) for i in steps])


def permute_pair(left: Column, right: Column, wide_l, wide_r, key: str, tag: str, backward: bool = False) -> Column:
    """Struct ``(l, r)``: a keyed permutation of the pairs below ``wide_l`` and ``wide_r``."""
    sign = -1 if backward else 1

    def step(s, i):
        return F.when(i % 2 == 1, F.struct(F.pmod(s["l"] + sign * (_draw(key, tag, i, s["r"]) % wide_l), wide_l).alias("l"), s["r"].alias("r"))
                      ).otherwise(F.struct(s["l"].alias("l"), F.pmod(s["r"] + sign * (_draw(key, tag, i, s["l"]) % wide_r), wide_r).alias("r")))
    wide_l, wide_r = (w if isinstance(w, Column) else F.lit(w).cast("bigint") for w in (wide_l, wide_r))
    return F.aggregate(_rounds(backward), F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r")), step)


def _turned(text: Column, digest: Column, sign: int) -> Column:
    """``text`` with each ASCII digit and letter moved on within its class by the bytes of a digest."""
    def turn(c, shift):
        code = F.ascii(c)
        out = c
        for first, size in ((48, 10), (65, 26), (97, 26)):
            out = F.when((code >= first) & (code < first + size) & (F.length(c) == 1),
                         F.char(F.pmod(code - first + sign * shift, F.lit(size)) + first)).otherwise(out)
        return out
    at = F.sequence(F.lit(1), F.length(text))
    moved = F.transform(at, lambda i: turn(F.substring(text, i, F.lit(1)), F.conv(F.substring(digest, 2 * i - 1, F.lit(2)), 16, 10).cast("int")))
    return F.when(F.length(text) > 0, F.array_join(moved, "")).otherwise(text)


def permute_text(text: Column, key: str, tag: str, backward: bool = False) -> Column:
    """A keyed permutation of a text of up to 64 characters that keeps digits
    digits, letters letters in their case, and everything else."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.lit(64)).alias("r"))
    sign = -1 if backward else 1

    def step(s, i):
        return F.when(i % 2 == 1, F.struct(_turned(s["l"], _digest(key, tag, i, s["r"]), sign).alias("l"), s["r"].alias("r"))
                      ).otherwise(F.struct(s["l"].alias("l"), _turned(s["r"], _digest(key, tag, i, s["l"]), sign).alias("r")))
    return let(F.aggregate(_rounds(backward), start, step), lambda s: F.concat(s["l"], s["r"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _filled(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced by ``digits`` in order."""
    at = F.sequence(F.lit(1), F.length(form))
    return F.array_join(F.transform(at, lambda i: F.when(F.substring(form, i, F.lit(1)).rlike("[0-9]"), F.substring(
        digits, F.length(_digits(F.substring(form, F.lit(1), i))), F.lit(1))).otherwise(F.substring(form, i, F.lit(1)))), "")


def _number(text: Column) -> Column:
    return F.coalesce(F.when(text != "", text.cast("bigint")), F.lit(0).cast("bigint"))


def _power(n: Column) -> Column:
    return F.concat(F.lit("1"), F.repeat(F.lit("0"), n.cast("int"))).cast("bigint")


def luhn_sum(digits: Column) -> Column:
    """Sum of a number's digits, every second from the last but one doubled."""
    def add(s, i):
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return s + F.when(i % 2 == 1, d).otherwise(F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def remainder_97(text: Column) -> Column:
    """Remainder by 97 of an account number read as digits, letters counting 10 to 35."""
    def add(s, i):
        code = F.ascii(F.substring(text, i, F.lit(1)))
        return F.when(code < 58, (s * 10 + code - 48) % 97).otherwise((s * 100 + code - 55) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add)


def _card(m: Column, key: str, backward: bool) -> Column:
    def body(d):
        n = F.length(d) - 2                   # between the first digit and the check digit
        half = F.floor(n / 2).cast("int")
        pair = permute_pair(_number(F.substring(d, F.lit(2), half)), _number(F.substring(d, half + 2, n - half)),
                            _power(half), _power(n - half), key, "card", backward)
        def sealed(p):
            middle = F.concat(F.substring(d, 1, 1), F.lpad(p["l"].cast("string"), half, F.lit("0")), F.lpad(p["r"].cast("string"), n - half, F.lit("0")))
            return let(middle, lambda x: F.concat(x, F.pmod(10 - luhn_sum(F.concat(x, F.lit("0"))) % 10, F.lit(10)).cast("string")))
        return F.when(luhn_sum(d) % 10 == 0, _filled(m, let(pair, sealed))).otherwise(m)
    return let(_digits(m), body)


def _iban(m: Column, key: str, backward: bool) -> Column:
    body, country = F.substring(m, F.lit(5), F.lit(30)), F.substring(m, 1, 2)
    def sealed(b):
        check = 98 - remainder_97(F.concat(b, country, F.lit("00")))
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), b)
    # Check digits below 02 and 99 also pass the remainder but are never issued.
    issued = F.substring(m, 3, 2).cast("int").between(2, 98)
    return F.when((remainder_97(F.concat(body, F.substring(m, 1, 4))) == 1) & issued,
                  let(permute_text(body, key, "iban", backward), sealed)).otherwise(m)


def _ip(m: Column, key: str, backward: bool) -> Column:
    o = F.split(m, r"\.")
    part = [F.get(o, F.lit(i)).cast("bigint") for i in range(4)]
    pair = permute_pair(part[0] * 256 + part[1], part[2] * 256 + part[3], 65536, 65536, key, "ip", backward)
    return let(pair, lambda p: F.concat_ws(".", *[x.cast("bigint").cast("string") for x in (
        F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256)]))


def _date(m: Column, key: str, backward: bool) -> Column:
    a, b = DAY_HALVES

    def once(day):
        return let(permute_pair(F.floor(day / b), day % b, a, b, key, "date", backward), lambda p: p["l"] * b + p["r"])

    out = m
    for mark, style in DATE_STYLES:
        day = F.datediff(F.try_to_date(m, style), F.lit(FIRST_DAY).cast("date")).cast("bigint")
        # Cycle walking: permute again while outside the calendar's range.  Each step leaves it with a
        # chance of 0.2%, so 60 steps are never used up.
        walked = let(once(day), lambda first: F.aggregate(F.sequence(F.lit(1), F.lit(60)), first, lambda s, _: F.when(s < DAYS, s).otherwise(once(s))))
        out = F.when(m.rlike(mark) & (day >= 0) & (day < DAYS), F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), walked.cast("int")), style)).otherwise(out)
    return out


def _ssn(m: Column, key: str, backward: bool) -> Column:
    area, group, serial = F.substring(m, 1, 3).cast("bigint"), F.substring(m, 5, 2).cast("bigint"), F.substring(m, 8, 4).cast("bigint")
    pair = permute_pair(F.when(area > 666, area - 2).otherwise(area - 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn", backward)
    return let(pair, lambda p: F.concat_ws("-", *[F.lpad(x.cast("bigint").cast("string"), n, "0") for x, n in (
        (F.when(p["l"] >= 665, p["l"] + 2).otherwise(p["l"] + 1), 3), (F.floor(p["r"] / 9999) + 1, 2), (p["r"] % 9999 + 1, 4))]))


def _phone(m: Column, key: str, backward: bool) -> Column:
    """The first digits of area and exchange stay, so that a valid number stays one."""
    def body(d):
        n = F.substring(d, -10, F.lit(10))
        pair = permute_pair(F.substring(n, 2, 2).cast("bigint"), F.substring(n, 5, 6).cast("bigint"), 100, 10 ** 6, key, "phone", backward)
        return _filled(m, let(pair, lambda p: F.concat(
            F.substring(d, F.lit(1), F.length(d) - 10), F.substring(n, 1, 1), F.lpad(p["l"].cast("string"), 2, "0"),
            F.substring(n, 4, 1), F.lpad(p["r"].cast("string"), 6, "0"))))
    return let(_digits(m), body)


def _email(m: Column, key: str, backward: bool) -> Column:
    return F.concat(permute_text(F.regexp_extract(m, "^([^@]*)@", 1), key, "email", backward), F.regexp_extract(m, "@.*$", 0))


MASKS = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}


def kind_of(match: Column) -> Column:
    """The format that a match has; formats are tried in order, as in the search."""
    kinds = [F.when(match.rlike(f"^(?:{pattern})$"), F.lit(kind)) for kind, pattern in FORMATS.items()]
    return F.coalesce(*kinds)


def pseudonym(match: Column, key: str, backward: bool = False) -> Column:
    """The pseudonym of a matched value; one that is not valid stays."""
    out = match
    for kind, pattern in reversed(FORMATS.items()):
        out = F.when(match.rlike(f"^(?:{pattern})$"), MASKS[kind](match, key, backward)).otherwise(out)
    return out


def pseudonymize(docs: DataFrame, key: str, text: str = "text", backward: bool = False) -> DataFrame:
    """``docs`` with every validated value in ``text`` replaced by its pseudonym,
    and ``n_pii`` (bigint) and ``pii_kinds`` (their kinds in order, joined by commas).

    Found are e-mail addresses (the part before the @ is permuted), account
    numbers, addresses of computers, dates from 1900 to 2099, social security
    numbers, cards and phone numbers; what fails its validation stays and is not
    counted.  A value that is permuted onto itself is counted.  ``backward``
    restores the original values.  A null text stays null with nothing found;
    repeated rows are kept; columns with the added names are replaced.
    """
    docs, at, restored = set_apart(clear_of(docs, ["n_pii", "pii_kinds"]))
    t = F.col(at(text))

    def rewrite(pieces, found):
        moved = F.transform(found, lambda m: F.struct(
            pseudonym(m, key, backward).alias("to"), F.when(valid(m), kind_of(m)).alias("kind")))
        return let(moved, lambda r: F.struct(interleave(pieces, F.transform(r, lambda x: x["to"])).alias("text"),
                                             F.filter(F.transform(r, lambda x: x["kind"]), lambda k: k.isNotNull()).alias("kinds")))

    # Every format holds an @ or a digit: texts without one are not searched.
    done = F.when(t.rlike("[0-9@]"), pieces_and_matches(t, ANY, rewrite))
    out = docs.withColumn("_done", done)
    columns = [F.coalesce(F.col("_done.text"), t).alias(name) if name.lower() == text.lower() else c for name, c in restored.items()]
    kinds = F.coalesce(F.col("_done.kinds"), F.array().cast("array<string>"))
    return out.select(*columns, F.size(kinds).cast("bigint").alias("n_pii"), F.array_join(kinds, ",").alias("pii_kinds"))


def valid(match: Column) -> Column:
    """Whether a match passes the validation of its format."""
    kind = kind_of(match)
    d = _digits(match)
    dates = F.coalesce(*[F.when(match.rlike(mark), F.try_to_date(match, style)) for mark, style in DATE_STYLES])
    account = remainder_97(F.concat(F.substring(match, F.lit(5), F.lit(30)), F.substring(match, 1, 4))) == 1
    return F.when(kind == "card", luhn_sum(d) % 10 == 0).when(kind == "date", dates.isNotNull()).when(
        kind == "iban", account & F.substring(match, 3, 2).cast("int").between(2, 98)).otherwise(kind.isNotNull())
