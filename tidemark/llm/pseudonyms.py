"""Format-preserving pseudonyms, in DataFrame functions only.

Numbers, dates and addresses in a text are checked and then permuted within their own format by a keyed Feistel network:
a 16-digit card number becomes another one with a right check digit, a date another date written alike, an IPv4 address
another address. A permutation gives different values different pseudonyms and equal values equal ones in all documents,
and who has the key can undo it. Addresses of mail and secrets are not numbers; their letters and digits are replaced by
those of a keyed digest, which also keeps equal values linked but is not undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Days of a block within which dates are permuted, and the first day of the first of four blocks.
DAY_BLOCK, FIRST_DAY, BLOCKS = 1 << 16, "1600-01-01", 4

_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_.+-])", r"(?![\p{L}\p{N}_]|[.-]\p{N})"
# Numbers with checks of their own: 3-2-4 groups, and account numbers in plain or spaced writing.
SOCIAL = r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}"
IBAN = r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)"
# Patterns by kind, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-À-ɏ])[A-Za-z0-9._%+\-À-ɏ]{1,64}@(?:[A-Za-z0-9À-ɏ-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9A-Fa-f]{32,128}|AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9_-]{20,200}|ghp_[A-Za-z0-9]{36})(?![\p{L}\p{N}])",
    "ip": _BEFORE + r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)" + r"(?![\p{L}\p{N}_]|\.\p{N})",
    "date": _BEFORE + r"(?:\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])|\d{4}/(?:0[1-9]|1[0-2])/(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])\.(?:0[1-9]|1[0-2])\.\d{4}|(?:(?:0[1-9]|[12]\d|3[01])/(?:0[1-9]|1[0-2])|(?:0[1-9]|1[0-2])/(?:0[1-9]|[12]\d|3[01]))/\d{4})" + _AFTER,
    "phone": r"(?<![\p{L}\p{N}_.-])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+[1-9]\d{6,14}|\+(?=(?:[ .()-]{0,2}\d){7})[1-9]\d{0,2}(?:[ .-]?\(\d{1,4}\))?[ .-]?\d{1,8}(?:[ .-]\d{2,8}){1,6})" + _AFTER,
    "number": _BEFORE + r"(?:\d{9,19}|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,3})?|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5}|" + SOCIAL + "|" + IBAN + ")" + _AFTER,
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _keyed(key: str, *parts) -> Column:
    """60 bits of a keyed digest as a long."""
    text = F.concat_ws("|", F.lit(key), *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.sha2(F.sha2(text, 256), 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, tweak, undo: bool = False) -> Column:
    """The pair (left, right), numbers below their sizes, permuted (or put back): a struct of l and r."""

    def forward(state: Column, turn: Column) -> Column:
        size = F.when(turn % 2 == 0, left_size).otherwise(right_size)
        return F.struct(state["r"].alias("l"), F.pmod(state["l"] + _keyed(key, tweak, turn, state["r"]), size).alias("r"))

    def backward(state: Column, turn: Column) -> Column:
        size = F.when(turn % 2 == 0, left_size).otherwise(right_size)
        return F.struct(F.pmod(state["r"] - _keyed(key, tweak, turn, state["l"]), size).alias("l"), state["l"].alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    turns = F.sequence(F.lit(0), F.lit(ROUNDS - 1)) if not undo else F.sequence(F.lit(ROUNDS - 1), F.lit(0))
    return F.aggregate(turns, start, backward if undo else forward)


def permuted_digits(digits: Column, key: str, tweak, undo: bool = False) -> Column:
    """Another string of as many digits (2 to 36)."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    size = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    pair = feistel(F.substring(digits, F.lit(1), half).cast("long"), F.substring(digits, half + 1, n - half).cast("long"), size(half), size(n - half), key, tweak, undo)
    return _let(pair, lambda p: F.concat(F.lpad(p["l"].cast("string"), half, "0"), F.lpad(p["r"].cast("string"), n - half, "0")))


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def check_digit(payload: Column) -> Column:
    """The Luhn digit that belongs behind the payload."""
    digits = F.reverse(F.split(payload, ""))
    value = lambda d, i: F.when(i % 2 == 1, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0))
    return F.pmod(-F.aggregate(F.transform(F.filter(digits, lambda d: d != ""), value), F.lit(0), lambda a, x: a + x), F.lit(10))


def _refilled(shape: Column, digits: Column) -> Column:
    """The shape with its digits replaced in order."""

    def put(state: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        out = F.concat(state["out"], F.when(is_digit, F.substring(state["rest"], 1, 1)).otherwise(c))
        return F.struct(out.alias("out"), F.when(is_digit, F.substr(state["rest"], F.lit(2))).otherwise(state["rest"]).alias("rest"))

    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), digits.alias("rest")), put)["out"]


def pseudonym_number(value: Column, key: str, undo: bool = False) -> Column:
    """A number of 9 to 19 digits; what its last digit is above the Luhn digit stays, so a right card number gives a right one."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    payload = F.substr(digits, F.lit(1), F.length(digits) - 1)
    above = F.pmod(F.right(digits, F.lit(1)).cast("int") - check_digit(payload), F.lit(10))
    fresh = permuted_digits(payload, key, "number", undo)
    return _refilled(value, _let(fresh, lambda p: F.concat(p, F.pmod(check_digit(p) + above, F.lit(10)).cast("string"))))


def pseudonym_phone(value: Column, key: str, undo: bool = False) -> Column:
    """The last ten digits change, a country code before them stays; of a number with a + and up to ten digits all but the first three change."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    kept = F.when(value.startswith("+") & (F.length(digits) <= 10), 3).otherwise(F.length(digits) - 10)
    rest = F.length(digits) - kept
    fresh = _refilled(value, F.concat(F.substr(digits, F.lit(1), kept), permuted_digits(F.right(digits, rest), key, "phone", undo)))
    return F.when(rest >= 2, fresh).otherwise(value)


def pseudonym_social(value: Column, key: str, undo: bool = False) -> Column:
    """A number in 3-2-4 groups: area 001 to 899 but 666, group and serial not zero."""
    part = lambda i: F.split_part(value, F.lit("-"), F.lit(i)).cast("long")
    area = part(1) - 1 - F.when(part(1) > 666, 1).otherwise(0)
    size = lambda n: F.lit(n).cast("long")
    pair = feistel(area * 99 + part(2) - 1, part(3) - 1, size(898 * 99), size(9999), key, "social", undo)

    def put(p: Column) -> Column:
        area = F.floor(p["l"] / 99) + 1
        area = area + F.when(area >= 666, 1).otherwise(0)
        return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in ((area, 3), (p["l"] % 99 + 1, 2), (p["r"] + 1, 4))])

    return _let(pair, put)


def iban_check(country: Column, rest: Column) -> Column:
    """The two check digits, 2 to 98, that belong to a country and what follows the check digits."""
    signs = F.filter(F.split(F.concat(rest, country, F.lit("00")), ""), lambda c: c != "")
    step = lambda a, c: F.when(c.rlike("^[0-9]$"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return 98 - F.aggregate(signs, F.lit(0), step)


def pseudonym_iban(value: Column, key: str, undo: bool = False) -> Column:
    """The digits after the check digits change; check digits of 02 to 98 stay as far from the right ones as they are, others stay."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    country, given, rest = F.substring(plain, 1, 2), F.substring(plain, 3, 2), F.substr(plain, F.lit(5))
    digits = F.regexp_replace(rest, "[^0-9]", "")
    above = given.cast("int") - iban_check(country, rest)

    def put(p: Column) -> Column:
        check = 2 + F.pmod(iban_check(country, _refilled(rest, p)) - 2 + above, F.lit(97))
        return F.concat(F.when(given.between("02", "98"), F.lpad(check.cast("string"), 2, "0")).otherwise(given), p)

    return F.when(F.length(digits) >= 2, _refilled(value, _let(permuted_digits(digits, key, "iban", undo), put))).otherwise(value)


def pseudonym_ip(value: Column, key: str, undo: bool = False) -> Column:
    part = lambda i: F.split_part(value, F.lit("."), F.lit(i)).cast("long")
    side = F.lit(1 << 16).cast("long")
    pair = feistel(part(1) * 256 + part(2), part(3) * 256 + part(4), side, side, key, "ip", undo)
    return _let(pair, lambda p: F.concat_ws(".", *[x.cast("string") for side in (p["l"], p["r"]) for x in (F.floor(side / 256), side % 256)]))


def _moved_day(number: Column, key: str, undo: bool) -> Column:
    """A day number moved within its block."""
    inside = number % DAY_BLOCK
    side = F.lit(256).cast("long")
    pair = feistel(F.floor(inside / 256), inside % 256, side, side, key, F.floor(number / DAY_BLOCK), undo)
    return _let(pair, lambda p: number - inside + p["l"] * 256 + p["r"])


def pseudonym_date(value: Column, key: str, undo: bool = False) -> Column:
    """A date from FIRST_DAY on moves within its block of DAY_BLOCK days; later ones, and days that do not exist, stay.

    Days come first where years come last, unless only a month can: such a date moves on until its day is above 12 again.
    """
    iso = value.rlike("^[0-9]{4}[-/]")
    mark = F.when(iso, F.substring(value, 5, 1)).otherwise(F.substring(value, 3, 1))
    month_first = ~iso & (F.substring(value, 4, 2) > "12")
    day_first = F.concat_ws("-", F.right(value, F.lit(4)), F.substring(value, 4, 2), F.substring(value, 1, 2))
    text = F.when(iso, F.translate(value, "/", "-")).when(month_first, F.concat_ws("-", F.right(value, F.lit(4)), F.substring(value, 1, 2), F.substring(value, 4, 2))).otherwise(day_first)
    first = F.lit(FIRST_DAY).cast("date")
    number = F.datediff(F.try_to_date(text, "yyyy-MM-dd"), first).cast("long")
    late = lambda n: F.dayofmonth(F.date_add(first, n.cast("int"))) > 12

    def step(state: Column, _: Column) -> Column:
        again = _let(_moved_day(state["n"], key, undo), lambda n: F.struct(n.alias("n"), late(n).alias("done")))
        return F.when(state["done"], state).otherwise(again)

    # Four in ten steps miss: all of 64 do so never in practice.
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(number.alias("n"), F.lit(False).alias("done")), step)["n"]
    moved = F.when(month_first, walked).otherwise(_moved_day(number, key, undo))
    part = lambda d, at, n: F.substring(d, at, n)
    written = _let(
        F.date_format(F.date_add(first, moved.cast("int")), "yyyy-MM-dd"),
        lambda d: F.when(iso, F.concat(part(d, 1, 4), mark, part(d, 6, 2), mark, part(d, 9, 2)))
        .when(month_first, F.concat(part(d, 6, 2), mark, part(d, 9, 2), mark, part(d, 1, 4)))
        .otherwise(F.concat(part(d, 9, 2), mark, part(d, 6, 2), mark, part(d, 1, 4))),
    )
    return F.when(number.between(0, BLOCKS * DAY_BLOCK - 1), written).otherwise(value)


def _digest_like(value: Column, key: str, kind: str, hexadecimal: bool) -> Column:
    """Letters and digits replaced by those of a keyed digest of the value without regard to case; marks and case stay."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), F.lower(value)), 512)

    def put(c: Column, i: Column) -> Column:
        number = F.conv(F.substr(_digest, i % 126 + 1, F.lit(3)), 16, 10).cast("int")
        if hexadecimal:
            letter = F.substr(F.lit("abcdef"), number % 6 + 1, F.lit(1))
        else:
            letter = F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), number % 26 + 1, F.lit(1))
        return F.when(c.rlike("^[0-9]$"), (number % 10).cast("string")).when(c.rlike(r"^\p{Lu}$"), F.upper(letter)).when(c.rlike(r"^\p{L}$"), letter).otherwise(c)

    def build(d: Column) -> Column:
        nonlocal _digest
        _digest = d
        return F.array_join(F.transform(F.split(value, ""), put), "")

    _digest = digest
    return _let(digest, build)


def pseudonym_email(value: Column, key: str) -> Column:
    """All but the last part of the domain is replaced."""
    last = F.regexp_extract(value, r"\.[A-Za-z]+$", 0)
    return F.concat(_digest_like(F.substr(value, F.lit(1), F.length(value) - F.length(last)), key, "email", False), last)


def pseudonym_secret(value: Column, key: str) -> Column:
    is_hex = value.rlike("^[0-9A-Fa-f]+$")
    return F.when(is_hex, _digest_like(value, key, "secret", True)).otherwise(_digest_like(value, key, "secret", False))


def kind_of(value: Column) -> Column:
    out = None
    for kind, pattern in PATTERNS.items():
        test = value.rlike(f"^(?:{pattern})$")
        out = F.when(test, F.lit(kind)) if out is None else out.when(test, F.lit(kind))
    return out


def pseudonym(value: Column, key: str, undo: bool = False) -> Column:
    kind = kind_of(value)
    same = value if undo else None
    return (
        F.when(kind == "email", same if undo else pseudonym_email(value, key))
        .when(kind == "secret", same if undo else pseudonym_secret(value, key))
        .when(kind == "ip", pseudonym_ip(value, key, undo))
        .when(kind == "date", pseudonym_date(value, key, undo))
        .when(kind == "phone", pseudonym_phone(value, key, undo))
        .when((kind == "number") & value.rlike(f"^{SOCIAL}$"), pseudonym_social(value, key, undo))
        .when((kind == "number") & value.rlike("^[A-Z]"), pseudonym_iban(value, key, undo))
        .when(kind == "number", pseudonym_number(value, key, undo))
        .otherwise(value)
    )


def pseudonymised(docs: DataFrame, key: str, undo: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in text, and n_email, n_secret, n_ip, n_date, n_phone and n_number added (columns of these names are replaced).

    A null text stays null with counts of 0, an empty one stays empty. Rows are answered one by one, equal rows alike;
    doc_id is not read. Whole texts are searched, however long; a text without a digit or an @ is passed on as it is.
    Dates are those from 1600 to 2317 in the forms 2024-05-31, 2024/05/31, 31.05.2024, 31/05/2024 and 05/31/2024. With ``undo`` numbers, phones, dates
    and IPv4 addresses get their first values back.
    """
    counts = [f"n_{kind}" for kind in PATTERNS]
    rest = [c for c in docs.columns if c not in counts]
    able = F.col("text").rlike("[0-9@]")
    found = docs.select(*rest, F.when(able, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).alias("__found"))
    hit = F.size("__found") > 0
    swapped = F.transform("__found", lambda m: pseudonym(m, key, undo))
    pieces = F.split("text", ANY, -1)
    # One piece more than finds: each piece but the last is followed by its find.
    text = F.array_join(F.zip_with(pieces, swapped, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    kinds = F.transform("__found", kind_of)
    count = lambda kind: F.size(F.filter("__kinds", lambda k: k == kind))
    many = [F.when(hit, count(kind)).otherwise(0).cast("long").alias(f"n_{kind}") for kind in PATTERNS]
    changed = found.withColumn("__kinds", F.when(hit, kinds)).withColumn("__text", F.when(hit, text).otherwise(F.col("text")))
    return changed.select(*[F.col("__text").alias("text") if c == "text" else c for c in rest], *many)
