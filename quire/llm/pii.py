"""Operator 1: format-preserving Feistel pseudonyms for personal data, in SQL functions only.

Validated values (payment cards by Luhn, IBANs by mod 97, social security
numbers, IP addresses, phone numbers and calendar dates) are permuted within
their own format by a keyed Feistel network; e-mail addresses letter by letter.
The permutation depends on the key, the kind and the canonical value alone, so
a value gets the same pseudonym in every document and different values of a
kind stay different. Check digits are made valid again, separators stay.

Numbers run through an alternating Feistel network over Z_a x Z_b, whose
product is the exact size of the format (SSN 88902 x 9999; the 146097 days of
1800 to 2199 as 189 x 773), so no cycle walking is needed. Digit and letter
strings run through a network over their two halves that shifts each character
within its class.

Defined cases: a null text gives null; values that fail validation (a wrong
check digit, 30 February, an octet over 255) stay; repeated rows are rewritten
alike; an empty table gives an empty result; a very long text is one value,
rewritten whole (Spark's limit: 2 GB a value). Other columns pass through,
whatever they are called; where one is called n_values or n_<kind>, ours gets
underscores after its name. No row moves: there is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

ROUNDS = 10
KINDS = ("email", "ip", "date", "ssn", "iban", "card", "phone")

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
IP = r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)"
DATE = r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}([/.-])\d{1,2}\1\d{4})(?![\w-]|[./]\d)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?!\w)"
CARD = r"(?<!\w)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}(?:[ -]?\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{5})(?!\w)"
PHONE = (
    r"(?<![\w+])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,4}"
    r"|(?:1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4})(?!\w)"
)
PATTERN = "|".join(f"(?:{p})" for p in (EMAIL, IP, DATE, SSN, IBAN, CARD, PHONE))


def _number(text: Column) -> Column:
    return text.cast("bigint")


def _hash(*parts: Column) -> Column:
    """60 keyed bits."""
    return _number(F.conv(F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 15), 16, 10))


def feistel_number(x: Column, a: int, b: int, key: str, tweak: str) -> Column:
    """A keyed permutation of 0 .. a*b - 1."""
    start = F.struct(F.floor(x / b).cast("bigint").alias("l"), F.pmod(x, F.lit(b)).cast("bigint").alias("r"))

    def one(s, i):
        mix = lambda v: _hash(F.lit(key), F.lit(tweak), i, v)
        return F.when(
            i % 2 == 0, F.struct(F.pmod(s["l"] + F.pmod(mix(s["r"]), F.lit(a)), F.lit(a)).cast("bigint").alias("l"), s["r"].alias("r"))
        ).otherwise(F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(mix(s["l"]), F.lit(b)), F.lit(b)).cast("bigint").alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, one, lambda s: s["l"] * b + s["r"])


def feistel_text(x: Column, key: str, tweak: str) -> Column:
    """A keyed permutation of the strings with the digits, small and capital ASCII letters in the same places."""
    half = F.floor(F.length(x) / 2).cast("int")
    start = F.struct(F.substr(x, F.lit(1), half).alias("l"), F.substr(x, half + 1).alias("r"))

    def shifted(text, i, other):
        def one(c, j):
            code, h = F.ascii(c), _hash(F.lit(key), F.lit(tweak), i, j, other)
            moved = lambda first, n: F.chr(F.lit(first) + F.pmod(code - first + F.pmod(h, F.lit(n)), F.lit(n)).cast("int"))
            return (
                F.when(code.between(48, 57), moved(48, 10))
                .when(code.between(97, 122), moved(97, 26))
                .when(code.between(65, 90), moved(65, 26))
                .otherwise(c)
            )

        return F.array_join(F.transform(F.split(text, ""), one), "")

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
        start,
        lambda s, i: F.struct(s["r"].alias("l"), shifted(s["l"], i, s["r"]).alias("r")),
        lambda s: F.concat(s["l"], s["r"]),
    )


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _refill(template: Column, chars: Column, klass: str) -> Column:
    """The template with its characters of a class replaced, in order, by ``chars``."""
    place = lambda i: F.length(F.regexp_replace(F.substr(template, F.lit(1), i + 1), f"[^{klass}]", ""))
    return F.array_join(
        F.transform(F.split(template, ""), lambda c, i: F.when(c.rlike(f"[{klass}]"), F.substr(chars, place(i), F.lit(1))).otherwise(c)), ""
    )


def luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """Luhn's sum; doubled_last: the last digit counts double (a payload without its check digit)."""
    n = F.length(digits)

    def one(c, i):
        d = _number(c) * F.when((n - 1 - i) % 2 == (0 if doubled_last else 1), 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), one), F.lit(0).cast("bigint"), lambda s, d: s + d)


def mod97(text: Column) -> Column:
    """The remainder by 97 of a string in which A is 10 and Z is 35."""

    def one(s, c):
        code = F.ascii(c)
        return F.when(code.between(48, 57), (s * 10 + code - 48) % 97).otherwise((s * 100 + code - 55) % 97).cast("bigint")

    return F.aggregate(F.split(text, ""), F.lit(0).cast("bigint"), one)


def _email(m: Column, key: str) -> Column:
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    tld = F.substring_index(domain, ".", -1)
    name = F.substr(domain, F.lit(1), F.length(domain) - F.length(tld) - 1)
    return F.concat(feistel_text(local, key, "email"), F.lit("@"), feistel_text(name, key, "domain"), F.lit("."), tld)


def _octets(m: Column) -> list[Column]:
    return [_number(F.split_part(m, F.lit("."), F.lit(i))) for i in range(1, 5)]


def _ip_valid(m: Column) -> Column:
    return F.greatest(*_octets(m)) <= 255


def _ip(m: Column, key: str) -> Column:
    o = _octets(m)
    x = feistel_number(((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3], 65536, 65536, key, "ip")
    return F.concat_ws(".", *[F.pmod(F.shiftright(x, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])


def _date_parts(m: Column) -> tuple[Column, Column, Column, Column, Column]:
    """year, month, day, whether the day comes first, separator. Slashes mean m/d/y unless the first part is over 12."""
    iso = m.rlike(r"^\d{4}-")
    sep = F.when(iso, "-").otherwise(F.regexp_extract(m, r"[/.-]", 0))
    p = [_number(F.split_part(m, sep, F.lit(i))) for i in (1, 2, 3)]
    day_first = ~iso & ((sep != "/") | (p[0] > 12))
    year = F.when(iso, p[0]).otherwise(p[2])
    month = F.when(iso | day_first, p[1]).otherwise(p[0])
    day = F.when(iso, p[2]).when(day_first, p[0]).otherwise(p[1])
    return year, month, day, day_first, sep


def _date_valid(m: Column) -> Column:
    y, mo, d, _, _ = _date_parts(m)
    last = F.dayofmonth(F.last_day(F.make_date(y.cast("int"), mo.cast("int"), F.lit(1))))
    return F.when(y.between(1800, 2199) & mo.between(1, 12), (d >= 1) & (d <= last)).otherwise(False)


def _date(m: Column, key: str) -> Column:
    y, mo, d, day_first, sep = _date_parts(m)
    start = F.to_date(F.lit("1800-01-01"))
    x = F.date_diff(F.make_date(y.cast("int"), mo.cast("int"), d.cast("int")), start).cast("bigint")
    new = F.date_add(start, feistel_number(x, 189, 773, key, "date").cast("int"))
    padded = m.rlike(r"^\d{2}[/.-]\d{2}[/.-]")
    two = lambda c: F.when(padded, F.lpad(c.cast("string"), 2, "0")).otherwise(c.cast("string"))
    day, month, year = two(F.dayofmonth(new)), two(F.month(new)), F.year(new).cast("string")
    return (
        F.when(m.rlike(r"^\d{4}-"), F.date_format(new, "yyyy-MM-dd"))
        .when(day_first, F.concat(day, sep, month, sep, year))
        .otherwise(F.concat(month, sep, day, sep, year))
    )


def _ssn_parts(m: Column) -> list[Column]:
    return [_number(F.split_part(m, F.lit("-"), F.lit(i))) for i in (1, 2, 3)]


def _ssn_valid(m: Column) -> Column:
    area, group, serial = _ssn_parts(m)
    return area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = _ssn_parts(m)
    index = (F.when(area > 666, area - 2).otherwise(area - 1) * 99 + group - 1) * 9999 + serial - 1
    x = feistel_number(index, 898 * 99, 9999, key, "ssn")
    left = F.floor(x / 9999)
    a = F.floor(left / 99)
    pad = lambda c, n: F.lpad(c.cast("bigint").cast("string"), n, "0")
    return F.concat_ws("-", pad(F.when(a >= 665, a + 2).otherwise(a + 1), 3), pad(left % 99 + 1, 2), pad(x % 9999 + 1, 4))


def _iban_valid(m: Column) -> Column:
    s = F.regexp_replace(m, " ", "")
    return mod97(F.concat(F.substr(s, F.lit(5)), F.substring(s, 1, 4))) == 1


def _iban(m: Column, key: str) -> Column:
    s = F.regexp_replace(m, " ", "")
    country = F.substring(s, 1, 2)
    account = feistel_text(F.substr(s, F.lit(5)), key, "iban")
    check = F.lpad((98 - mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    return _refill(m, F.concat(country, check, account), "A-Z0-9")


def _card_valid(m: Column) -> Column:
    return luhn_sum(_digits(m), False) % 10 == 0


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    payload = feistel_text(F.substr(d, F.lit(1), F.length(d) - 1), key, "card")
    return _refill(m, F.concat(payload, F.pmod(10 - luhn_sum(payload, True) % 10, F.lit(10)).cast("string")), "0-9")


def _phone(m: Column, key: str) -> Column:
    """The country code stays: 1 and 7, or two digits after another +. The rest is permuted, so +1 and national writings agree."""
    d = _digits(m)
    code = F.when(~m.startswith("+"), F.length(d) - 10).when(d.rlike("^[17]"), 1).otherwise(2).cast("int")
    return _refill(m, F.concat(F.substr(d, F.lit(1), code), feistel_text(F.substr(d, code + 1), key, "phone")), "0-9")


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def pseudonym(m: Column, key: str) -> Column:
    """struct(kind, new) for one match of PATTERN; kind null: the value isn't valid and stays."""
    cases = {
        "email": (m.contains("@"), None, _email),
        "ip": (m.rlike(_whole(IP)), _ip_valid, _ip),
        "date": (m.rlike(_whole(DATE)), _date_valid, _date),
        "ssn": (m.rlike(_whole(SSN)), _ssn_valid, _ssn),
        "iban": (m.rlike("^[A-Z]{2}"), _iban_valid, _iban),
        "card": (m.rlike(_whole(CARD)), _card_valid, _card),
    }
    same = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("new"))
    done = F.struct(F.lit("phone").alias("kind"), _phone(m, key).alias("new"))
    for kind, (is_kind, valid, new) in reversed(cases.items()):
        made = F.struct(F.lit(kind).alias("kind"), new(m, key).alias("new"))
        done = F.when(is_kind, F.when(valid(m), made).otherwise(same) if valid else made).otherwise(done)
    return done


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with its text rewritten, n_values replaced in all, and n_<kind> for each kind; ``key`` is the secret of the permutation."""
    if not key:
        raise ValueError("a key is needed: without one anybody can undo the pseudonyms")
    others = [c for c in docs.columns if c != "text"]
    taken = [*others, "text"]
    names = [free_name(taken, n) for n in ("n_values", *(f"n_{k}" for k in KINDS))]
    text = F.col("_row.text")
    # Every pattern needs a digit or an @; most texts have neither and skip the search.
    matches = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    # Columns of the input may have any name, so they travel in a struct.
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).withColumn("_m", matches)
    found = found.withColumn("_p", F.when(F.size("_m") > 0, F.transform("_m", lambda m: pseudonym(m, key))))
    pieces = F.split(text, PATTERN, -1)
    joined = F.array_join(F.zip_with(pieces, F.concat(F.transform("_p", lambda p: p["new"]), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    of = lambda kind: lambda p: p["kind"] == kind
    count = lambda test: F.coalesce(F.size(F.filter("_p", test)), F.lit(0)).cast("long")
    tests = [lambda p: p["kind"].isNotNull(), *(of(k) for k in KINDS)]
    made = found.select("_row", F.when(F.col("_p").isNull(), text).otherwise(joined).alias("_text"), F.struct(*[count(t).alias(f"c{i}") for i, t in enumerate(tests)]).alias("_counts"))
    return made.select(*[F.col(f"_row.`{c}`").alias(c) for c in others], F.col("_text").alias("text"), *[F.col(f"_counts.c{i}").alias(n) for i, n in enumerate(names)])
