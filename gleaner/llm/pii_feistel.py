"""Format-preserving pseudonyms for personal numbers, dates and addresses, all in column expressions.

A value that passes its kind's validation becomes a list of symbols, each with the number
of values it may take. A keyed Feistel network adds to one half of the symbols numbers
drawn from SHA-256 of the other half, in turn, which permutes the values of a format: equal
values get equal pseudonyms in all documents, different values of a format different ones.
Check digits are computed anew, so that pseudonyms are valid as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import columns_of, free_name, text_or_empty

ROUNDS = 8
#: Characters that are permuted within their own class; all others stay in place.
CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþßÿ",
           "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ", "αβγδεζηθικλμνξοπρςστυφχψω", "абвгдежзийклмнопрстуфхцчшщъыьэюя")
ALL = "".join(CLASSES)

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Lengths of account numbers by country, as the IBAN register has them.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU"}
#: Calling codes are prefix-free: these, and three digits otherwise.
CALLING = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Digits behind the calling code, where a country has one length for all its numbers.
PHONE_LENGTHS = {8: "45 47 65 852", 9: "33 34 351 41 48 27 61 380 420 421", 10: "1 7 20 52 57 90 91 92"}
SSN = r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
IP = rf"(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])"
DATE = r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9])"
#: One more digit of a phone number; a blank parts its groups only where no other value begins.
DIGIT = rf"(?:(?:[.-]| (?!{IP}|{DATE}|{SSN}))?\(?[0-9]\)?+)"
TRUNK = r"(?:[ .-]?\(0\))?+"


def _by_length(lengths: dict[int, str], form) -> str:
    return "|".join(form("|".join(names.split(" ")), n) for n, names in lengths.items())


PHONE_FIXED = _by_length(PHONE_LENGTHS, lambda codes, n: rf"\+(?:{codes}){TRUNK}{DIGIT}{{{n}}}(?![0-9])")
IBAN_FIXED = _by_length(IBAN_LENGTHS, lambda countries, n: rf"(?:{countries})[0-9]{{2}}(?: ?[0-9A-Z]){{{n - 4}}}(?![\p{{L}}\p{{N}}])")
#: What may stand in a text, in order of preference at one place. Numbers of a known length end there, others by their groups.
FORMS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++){1,8}",
    "ip": rf"(?<![\p{{N}}.]){IP}",
    "date": rf"(?<![0-9]){DATE}",
    "ssn": rf"(?<![0-9-]){SSN}",
    "iban": rf"(?<![\p{{L}}\p{{N}}])(?=[A-Z]{{2}}[0-9]{{2}})(?:{IBAN_FIXED}|[A-Z]{{2}}[0-9]{{2}}(?:[0-9A-Z]{{11,30}}|(?: [0-9A-Z]{{4}}){{2,7}}(?: [0-9A-Z]{{1,3}})?)(?![\p{{L}}\p{{N}}]))",
    "phone": rf"(?<![\p{{L}}\p{{N}}+])(?:{PHONE_FIXED}|\+[0-9]{DIGIT}{{6,14}}(?![0-9])|\([0-9]{{3}}\) ?[0-9]{{3}}[ .-][0-9]{{4}}(?![0-9])|[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}}(?![0-9]))",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
}
ANY = "|".join(FORMS.values())
#: Days of the years 1900 to 2099: 17 * 4297.
FIRST_DAY, DAYS, SLOW, FAST = "1900-01-01", 73049, 17, 4297


def _ints(column: Column) -> Column:
    return column.cast("array<int>")


def permuted(symbols: Column, sizes: Column, tweak: Column) -> Column:
    """``symbols`` (each below its entry of ``sizes``) after a keyed Feistel network; ``tweak`` holds the key and the format."""
    half = F.floor(F.size(symbols) / 2).cast("int")
    rest = F.size(symbols) - half
    start = F.struct(F.slice(symbols, F.lit(1), half).alias("a"), F.slice(sizes, F.lit(1), half).alias("na"),
                     F.slice(symbols, half + 1, rest).alias("b"), F.slice(sizes, half + 1, rest).alias("nb"))

    def turn(held: Column, step: Column) -> Column:
        def moved(x: Column, i: Column) -> Column:
            drawn = F.sha2(F.concat_ws(":", tweak, step.cast("string"), i.cast("string"), F.array_join(held["b"].cast("array<string>"), ",")), 256)
            added = F.conv(F.substring(drawn, 1, 14), 16, 10).cast("long")
            return ((x + added) % F.element_at(held["na"], i + 1)).cast("int")
        return F.struct(held["b"].alias("a"), held["nb"].alias("na"), F.transform(held["a"], moved).alias("b"), held["na"].alias("nb"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda held: F.concat(held["a"], held["b"]))


def _spelled(text: Column, tweak: Column) -> Column:
    """``text`` with its characters permuted within their classes."""
    marks = F.split(text, "(?!^)(?!$)")
    place = F.transform(marks, lambda c: F.instr(F.lit(ALL), c))

    def by_class(p: Column, give) -> Column:
        out, end = None, 0
        for letters in CLASSES:
            begin, end = end, end + len(letters)
            held = (p > begin) & (p <= end)
            out = F.when(held, give(begin, len(letters))) if out is None else out.when(held, give(begin, len(letters)))
        return out

    symbols = _ints(F.transform(place, lambda p: F.coalesce(by_class(p, lambda begin, n: p - 1 - begin), F.lit(0))))
    sizes = _ints(F.transform(place, lambda p: F.coalesce(by_class(p, lambda begin, n: F.lit(n)), F.lit(1))))
    base = F.transform(place, lambda p: F.coalesce(by_class(p, lambda begin, n: F.lit(begin)), F.lit(-1)))
    # The format is part of the tweak, so that each format has a permutation of its own.
    shape = F.concat_ws(":", tweak, F.array_join(sizes.cast("array<string>"), ","))
    new = permuted(symbols, sizes, shape)
    out = F.transform(F.arrays_zip(marks.alias("c"), base.alias("base"), new.alias("new")), lambda z: F.when(
        z["base"] < 0, z["c"]).otherwise(F.substring(F.lit(ALL), z["base"] + z["new"] + 1, F.lit(1))))
    return F.when(F.length(text) == 0, text).otherwise(F.array_join(out, ""))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_sum(digits: Column, doubled_first: bool) -> Column:
    """Luhn sum of a string of digits read from its end; ``doubled_first`` where the check digit is not among them."""
    read = F.transform(F.split(F.reverse(digits), "(?!^)(?!$)"), lambda c: c.cast("int"))
    odd = 0 if doubled_first else 1
    each = F.transform(read, lambda d, i: F.when(i % 2 == odd, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.coalesce(d, F.lit(0)))


def iban_rest(moved: Column) -> Column:
    """Remainder by 97 of an account number whose country and check digits stand at its end."""
    marks = F.split(moved, "(?!^)(?!$)")
    return F.aggregate(marks, F.lit(0), lambda s, c: F.when(
        c.rlike("[0-9]"), (s * 10 + F.coalesce(c.cast("int"), F.lit(0))) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97))


def _slashed(text: Column, month: int, day: int) -> Column:
    return F.concat_ws("-", F.substring(text, 7, 4), F.substring(text, month, 2), F.substring(text, day, 2)).try_cast("date")


def _day(text: Column) -> Column:
    """The date that ``text`` writes, in whichever form, null where there is none; slashed ones month first, or else day first."""
    iso = F.regexp_replace(text, "/", "-").try_cast("date")
    dotted = _slashed(text, 4, 1)
    return F.when(text.rlike("^[0-9]{4}"), iso).when(text.contains("."), dotted).otherwise(
        F.coalesce(_slashed(text, 1, 4), _slashed(text, 4, 1)))


def pseudonym(value: Column, key: str) -> Column:
    """Pseudonym of one match of the FORMS, null where the value is not valid."""
    def tweak(kind: str) -> Column:
        return F.lit(f"{key}:{kind}")

    def into(form: Column, marks: Column, held: str = "[0-9]") -> Column:
        """``form`` with its digits replaced by ``marks`` one after the other, so that equal numbers agree however they are parted."""
        return F.aggregate(F.split(form, "(?!^)(?!$)"), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), lambda a, c: F.when(
            c.rlike(held), F.struct(F.concat(a["out"], F.substring(marks, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))).otherwise(
            F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at"))), lambda a: a["out"])

    at = F.instr(value, F.lit("@"))
    name = F.substring(value, F.lit(1), at - 1)
    # Names with letters outside the classes are masked whole: those letters have no pseudonyms of their kind.
    masked = F.concat(F.lit("x"), F.substring(F.sha2(F.concat_ws(":", tweak("name"), name), 256), 1, 24))
    email = F.concat(F.when(name.rlike(f"[^{ALL}._%+-]"), masked).otherwise(_spelled(name, tweak("email"))), F.substring(value, at, F.length(value)))

    octets = F.split(value, r"\.")
    ip = F.array_join(permuted(_ints(octets), F.array_repeat(F.lit(256), 4), tweak("ip")).cast("array<string>"), ".")

    day = F.datediff(_day(value), F.lit(FIRST_DAY).cast("date"))
    at_day = permuted(F.array((day % SLOW).cast("int"), F.floor(day / SLOW).cast("int")), F.array(F.lit(SLOW), F.lit(FAST)), tweak("date"))
    new_day = F.date_add(F.lit(FIRST_DAY).cast("date"), at_day[1] * SLOW + at_day[0])
    date = F.when((day >= 0) & (day < DAYS), F.when(value.rlike("^[0-9]{4}-"), F.date_format(new_day, "yyyy-MM-dd")).when(
        value.rlike("^[0-9]{4}/"), F.date_format(new_day, "yyyy/MM/dd")).when(
        value.contains("."), F.date_format(new_day, "dd.MM.yyyy")).when(
        _slashed(value, 1, 4).isNull(), F.date_format(new_day, "dd/MM/yyyy")).otherwise(F.date_format(new_day, "MM/dd/yyyy")))

    # Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999.
    parts = _ints(F.split(value, "-"))
    area = F.when(parts[0] > 666, parts[0] - 2).otherwise(parts[0] - 1)
    new_ssn = permuted(F.array(area, parts[1] - 1, parts[2] - 1), F.array(F.lit(898), F.lit(99), F.lit(9999)), tweak("ssn"))
    new_area = F.when(new_ssn[0] >= 665, new_ssn[0] + 2).otherwise(new_ssn[0] + 1)
    ssn = F.format_string("%03d-%02d-%04d", new_area, new_ssn[1] + 1, new_ssn[2] + 1)

    plain = F.regexp_replace(value, " ", "")
    country = F.substring(plain, 1, 2)
    body = _spelled(F.substring(plain, F.lit(5), F.length(plain)), F.concat(tweak("iban"), country))
    check = F.lit(98) - iban_rest(F.concat(body, country, F.lit("00")))
    iban = F.when(iban_rest(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1,
                  F.concat(country, F.lpad(check.cast("string"), 2, "0"), into(F.substring(value, F.lit(5), F.length(value)), body, "[0-9A-Z]")))

    # The calling code stays, and a trunk zero in brackets, which is no part of the number.
    front = F.regexp_extract(value, rf"^\+{CALLING}{TRUNK}", 0)
    code = F.regexp_extract(value, rf"^\+{CALLING}", 0)
    local = F.substring(value, F.length(front) + 1, F.length(value))
    n_digits = F.length(_digits(value))
    phone = F.when((n_digits >= 7) & (n_digits <= 15), F.concat(front, into(local, _spelled(
        _digits(local), F.concat(tweak("phone"), code)))))

    digits = _digits(value)
    front = _spelled(F.substring(digits, F.lit(1), F.length(digits) - 1), tweak("card"))
    card = F.when((luhn_sum(digits, False) % 10 == 0) & digits.rlike("[1-9]"), into(value, F.concat(
        front, ((F.lit(10) - luhn_sum(front, True) % 10) % 10).cast("string"))))

    return (F.when(at > 0, email).when(value.rlike(f"^(?:{FORMS['ip']})$"), ip).when(value.rlike(f"^(?:{FORMS['date']})$"), date)
            .when(value.rlike(f"^(?:{FORMS['ssn']})$"), ssn).when(value.rlike("^[A-Z]{2}"), iban)
            .when(value.rlike(f"^(?:{FORMS['phone']})$"), phone).otherwise(card))


def pseudonymised(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with the valid personal values of ``text`` replaced by their pseudonyms under ``key``.

    Rows and columns stay; ``count`` names a further column for the number of replaced values. A null text
    stays null and counts 0, an empty text stays empty. Values that fail their validation (a wrong check
    digit, a day that is none) stay as they are. The mail domain and a phone number's country code stay.
    """
    if count and count in docs.columns:
        raise ValueError(f"column exists already: {count}")
    whole = text_or_empty(text)
    found = F.regexp_extract_all(whole, F.lit(ANY), F.lit(0))
    names, old, new = docs.columns, free_name(docs, "__found"), free_name(docs, "__new")
    held = docs.select(*columns_of(docs), found.alias(old))
    held = held.select("*", F.transform(old, lambda v: pseudonym(v, key)).alias(new))
    gaps = F.split(F.col(f"`{text}`"), ANY, -1)
    pieces = F.transform(F.arrays_zip(gaps.alias("gap"), F.col(old).alias("old"), F.col(new).alias("new")),
                         lambda z: F.concat(z["gap"], F.coalesce(z["new"], z["old"], F.lit(""))))
    changed = F.when(F.size(old) > 0, F.array_join(pieces, "")).otherwise(F.col(f"`{text}`"))
    out = [changed.alias(c) if c == text else F.col(f"`{c}`") for c in names]
    if count:
        out.append(F.size(F.filter(new, lambda x: x.isNotNull())).cast("long").alias(count))
    return held.select(*out)
