"""Format-preserving pseudonyms for personal data, by keyed Feistel networks.

A value that passes its format's validation is permuted within that format: a card number becomes
another card number with a right check digit, a date another date.  The permutation depends on the
key and the kind only, so equal values have equal pseudonyms in every document, and two values
never share one.

| kind | validated by | permuted |
|---|---|---|
| e-mail address | form, length of the local part | characters of the local part, each within its class |
| IBAN | mod 97 | characters of the account part within their class; check digits follow |
| payment card, 13 to 19 digits | Luhn | all digits but the last, which follows |
| US social security number | area, group, serial ranges | number within those ranges |
| telephone number | form (+ and 8 to 15 digits, or 3-3-4) | its digits |
| IPv4 address | octets up to 255 | the 32 bits |
| date 1900-2099 (Y-M-D, Y/M/D, D.M.Y, M/D/Y, D/M/Y) | calendar | the day, within the same notation |

Everything is built-in SQL: the text is cut at the matches of one pattern, the matches are mapped,
and the pieces are put together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# Groups of a run of digits that are searched for cards in one step; a card may reach into the next.
STEP = 128
# Blanks that may stand between the groups of a card: the plain one, no-break, figure, thin and narrow ones.
_BLANK = r"[ \u00a0\u2007\u2009\u202f]"
_SEPARATOR = r"[ \u00a0\u2007\u2009\u202f-]"
# Alternatives in order of preference; a digit or letter may not continue on either side.
_EMAIL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)+"
# Lengths of the registered countries: what follows such an account is no part of it.  Others take the general form.
IBAN_LENGTHS = {
    15: "NO", 16: "BE BI", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BF BJ CF CG CI CM DJ DZ FR GR IT KM MC MG ML MR NE SM SN TD TG", 28: "AL AZ BY CV CY DO GT GW HN HU LB MA MZ NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
_NATIONAL = "|".join(
    rf"(?:{names.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    for n, names in IBAN_LENGTHS.items()
)
_SSN = r"\d{3}-\d{2}-\d{4}"
_PHONE = r"\+\d{1,3}(?:[ .-]?\(\d{1,4}\)|[ .-]?\d{1,4})(?:[ .-]?\d{2,4}){1,5}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}"
_IPV4 = r"\d{1,3}(?:\.\d{1,3}){3}"
_DATE = r"\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4}"
# A run of digits, of any length, may hold more than a card; it ends before a blank that opens one of the forms above.
# Some part from its start on must have the digits of a card; the run itself is taken without backtracking, group by group.
_NEXT = rf"(?:{_BLANK}(?!(?:{_DATE}|{_SSN}|{_IPV4}|{_PHONE})(?![A-Za-z0-9]))|-)"
_CARD = rf"(?=\d(?:{_NEXT}?\d){{12,119}}(?![A-Za-z0-9]))\d++(?:{_NEXT}\d++(?![A-Za-z]))*+"
PATTERN = (
    rf"(?<![A-Za-z0-9._%+-]){_EMAIL}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:{_NATIONAL})(?![A-Za-z0-9])|(?<![A-Za-z0-9]){_IBAN}(?![A-Za-z0-9])"
    rf"|(?<![A-Za-z0-9.+-])(?:{_DATE})(?![A-Za-z0-9]|[./-]\d)|(?<![A-Za-z0-9.+-]){_SSN}(?![A-Za-z0-9]|-\d)"
    rf"|(?<![A-Za-z0-9.]){_IPV4}(?![A-Za-z0-9]|\.\d)|(?<![A-Za-z0-9+])(?:{_PHONE})(?![A-Za-z0-9]|[.-]\d)"
    rf"|(?<![A-Za-z0-9]){_CARD}(?![A-Za-z0-9])"
)
_FIRST_DAY = "1900-01-01"
# 73,049 days from 1900 to 2099 are 17 times 4,297; the ranges of social security numbers are
# 898 areas times 99 groups, and 9,999 serials.
_DAYS = (17, 4297)
_SSN_RANGE = (898 * 99, 9999)
_IP_RANGE = (65536, 65536)


def _let(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _hash(key: str, kind: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), *[p.cast("string") for p in parts]).cast("binary"), 512)


def permute_number(value: Column, ranges: tuple[int, int], key: str, kind: str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of ``0 .. a*b - 1`` for ``ranges = (a, b)``: halves are added modulo a and b in turn."""
    a, b = ranges

    def step(acc: Column, i: Column) -> Column:
        def added(half: Column, other: Column, modulus: int) -> Column:
            drawn = F.conv(F.substring(_hash(key, kind, i, other), 1, 15), 16, 10).cast("bigint")
            return F.pmod(half + drawn, F.lit(modulus).cast("bigint"))

        even = i % 2 == 0
        left = F.when(even, added(acc["l"], acc["r"], a)).otherwise(acc["l"])
        right = F.when(even, acc["r"]).otherwise(added(acc["r"], acc["l"], b))
        return F.struct(left.alias("l"), right.alias("r"))

    start = F.struct(F.floor(value / F.lit(b)).cast("bigint").alias("l"), F.pmod(value, F.lit(b)).cast("bigint").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step, lambda acc: acc["l"] * b + acc["r"])


_CLASSES = (("0123456789", 10), ("abcdefghijklmnopqrstuvwxyz", 26), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 26))


def permute_characters(value: Column, key: str, kind: str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of strings in which every ASCII letter and digit stays in its class.

    The halves are the first and second half of the string; each is shifted, character by
    character, by a hash of the other.  Other characters stay.  Up to 84 characters.
    """

    def shifted(half: Column, other: Column, i: Column) -> Column:
        def one(drawn: Column) -> Column:
            def shift(c: Column, at: Column) -> Column:
                by = F.conv(F.substring(drawn, at * 3 + 1, F.lit(3)), 16, 10).cast("int")
                out = c
                for letters, n in _CLASSES:
                    place = F.instr(F.lit(letters), c)
                    out = F.when(c.rlike(f"^[{letters[0]}-{letters[-1]}]$"), F.substring(F.lit(letters), F.pmod(place - 1 + by, F.lit(n)) + 1, F.lit(1))).otherwise(out)
                return out

            return F.array_join(F.transform(F.filter(F.split(half, ""), lambda c: c != ""), shift), "")

        return _let(_hash(key, kind, i, F.length(half), other), one)

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        left = F.when(even, shifted(acc["l"], acc["r"], i)).otherwise(acc["l"])
        right = F.when(even, acc["r"]).otherwise(shifted(acc["r"], acc["l"], i))
        return F.struct(left.alias("l"), right.alias("r"))

    cut = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), cut).alias("l"), F.substring(value, cut + 1, F.length(value)).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step, lambda acc: F.concat(acc["l"], acc["r"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def _refill(form: Column, characters: Column) -> Column:
    """Put new characters into the places of letters and digits of ``form``, in order."""

    def place(acc: Column, c: Column) -> Column:
        fits = c.rlike("^[A-Za-z0-9]$")
        return F.struct(
            F.concat(acc["s"], F.when(fits, F.substring(characters, acc["i"], F.lit(1))).otherwise(c)).alias("s"),
            F.when(fits, acc["i"] + 1).otherwise(acc["i"]).alias("i"),
        )

    return F.aggregate(F.split(form, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("i")), place, lambda acc: acc["s"])


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, the last digit counted once; 0 modulo 10 if valid."""

    def weigh(acc: Column, x: Column) -> Column:
        return acc + x

    doubled = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")),
    )
    return F.aggregate(doubled, F.lit(0), weigh)


def mod97(iban: Column) -> Column:
    """An IBAN's remainder after moving its first four characters to the end; 1 if valid."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(
        F.filter(F.split(turned, ""), lambda c: c != ""),
        F.lit(0),
        lambda r, c: _let(value(c), lambda v: F.when(v < 10, (r * 10 + v) % 97).otherwise((r * 100 + v) % 97)),
    )


def _email(v: Column, key: str) -> Column:
    local, domain = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
    return F.when(F.length(local) <= 64, F.concat(permute_characters(local, key, "email"), F.lit("@"), domain)).otherwise(v)


def _iban(v: Column, key: str) -> Column:
    def of(plain: Column) -> Column:
        body = permute_characters(F.substring(plain, F.lit(5), F.length(plain)), key, "iban")

        def checked(new: Column) -> Column:
            blank = F.concat(F.substring(plain, 1, 2), F.lit("00"), new)
            check = F.lpad((98 - mod97(blank)).cast("string"), 2, "0")
            return _refill(v, F.concat(F.substring(plain, 1, 2), check, new))

        valid = F.length(plain).between(15, 34) & (mod97(plain) == 1)
        return F.when(valid, _let(body, checked)).otherwise(v)

    return _let(F.replace(v, F.lit(" "), F.lit("")), of)


def _valid_card(digits: Column) -> Column:
    return F.length(digits).between(13, 19) & (luhn_sum(digits) % 10 == 0) & ~digits.rlike("^0+$")


def _card(v: Column, key: str) -> Column:
    """A valid card number with its digits permuted."""

    def of(digits: Column) -> Column:
        body = permute_characters(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")

        def checked(new: Column) -> Column:
            check = F.pmod(F.lit(0) - luhn_sum(F.concat(new, F.lit("0"))), F.lit(10))
            return _refill(v, F.concat(new, check.cast("string")))

        return F.when(_valid_card(digits), _let(body, checked)).otherwise(v)

    return _let(_digits(v), of)


# Groups of digits that a part of a run must have to count as a card of its own; the whole run may have any.
_GROUPED = rf"^\d{{3,}}(?:{_SEPARATOR}\d{{3,}})*(?:{_SEPARATOR}\d{{1,2}})?$"


def _cards(v: Column, key: str) -> Column:
    """A run of digits: the whole of it if it is a card, else the cards that start and end with groups of it.

    From left to right the longest valid part from each group on is taken; a part that starts with the
    run may have groups of any length.
    """
    groups = F.regexp_extract_all(v, F.lit(rf"\d+{_SEPARATOR}?"), F.lit(0))

    def cut(parts: Column) -> Column:
        def part(start: Column, count: Column) -> Column:
            return F.regexp_replace(F.array_join(F.slice(parts, start, count), ""), f"{_SEPARATOR}$", "")

        def step(acc: Column, at: Column) -> Column:
            def longest(counts: Column) -> Column:
                fits = F.filter(counts, lambda n: _let(part(at, n), lambda p: (F.length(_digits(p)).between(13, 19)) & ((at == 1) | p.rlike(_GROUPED)) & _valid_card(_digits(p))))
                return F.coalesce(F.array_max(fits), F.lit(0))

            most = F.least(F.lit(19), F.size(parts) - at + 1)

            def taken(n: Column) -> Column:
                text = F.when(n > 0, F.concat(_card(part(at, n), key), F.regexp_extract(F.element_at(parts, at + n - 1), f"{_SEPARATOR}?$", 0)))
                return F.struct(
                    F.concat(acc["s"], text.otherwise(F.element_at(parts, at))).alias("s"), (at + F.greatest(n, F.lit(1))).alias("next")
                )

            return F.when(at < acc["next"], acc).otherwise(_let(longest(F.sequence(F.lit(1), most)), taken))

        # Texts of steps are kept apart until the end, so that a run of any length is copied once.
        def block(acc: Column, b: Column) -> Column:
            first = b * STEP + 1
            places = F.sequence(first, F.least(first + (STEP - 1), F.size(parts)))
            inner = F.aggregate(places, F.struct(F.lit("").alias("s"), acc["next"].alias("next")), step)
            return _let(inner, lambda x: F.struct(F.concat(acc["s"], F.array(x["s"])).alias("s"), x["next"].alias("next")))

        start = F.struct(F.array().cast("array<string>").alias("s"), F.lit(1).alias("next"))
        blocks = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / F.lit(STEP)).cast("int"))
        return F.aggregate(blocks, start, block, lambda acc: F.array_join(acc["s"], ""))

    several = v.rlike(_SEPARATOR)
    return F.when(_valid_card(_digits(v)), _card(v, key)).when(several & (F.length(_digits(v)) > 13), _let(groups, cut)).otherwise(v)


def _ibans(v: Column, key: str) -> Column:
    """The longest valid account that starts with a group of ``v``, from the left; what stands around it stays."""
    groups = F.regexp_extract_all(v, F.lit("[^ ]+ ?"), F.lit(0))

    def cut(parts: Column) -> Column:
        def piece(start: Column, count: Column) -> Column:
            return F.array_join(F.slice(parts, start, count), "")

        def valid(p: Column) -> Column:
            plain = lambda q: q.rlike(f"^{_IBAN}$") & F.length(F.replace(q, F.lit(" "), F.lit(""))).between(15, 34) & (mod97(F.replace(q, F.lit(" "), F.lit(""))) == 1)
            return _let(F.rtrim(p), plain)

        size = F.size(parts)
        spans = F.flatten(F.transform(F.sequence(F.lit(1), size), lambda at: F.transform(F.sequence(size - at + 1, F.lit(1)), lambda n: F.struct(at.alias("at"), n.alias("n")))))

        def written(x: Column) -> Column:
            body = piece(x["at"], x["n"])
            bare = F.rtrim(body)
            tail = F.substring(body, F.length(bare) + 1, F.lit(1))
            new = F.concat(piece(F.lit(1), x["at"] - 1), _iban(bare, key), tail, piece(x["at"] + x["n"], size))
            return F.when(x.isNotNull(), new).otherwise(v)

        return _let(F.get(F.filter(spans, lambda x: valid(piece(x["at"], x["n"]))), F.lit(0)), written)

    whole = F.replace(v, F.lit(" "), F.lit(""))
    return F.when(F.length(whole).between(15, 34) & (mod97(whole) == 1), _iban(v, key)).when(v.contains(" "), _let(groups, cut)).otherwise(v)


def _ssn(v: Column, key: str) -> Column:
    area, group, serial = (F.split_part(v, F.lit("-"), F.lit(i)).cast("bigint") for i in (1, 2, 3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    number = ((area - 1 - (area > 666).cast("int")) * 99 + group - 1) * 9999 + serial - 1

    def written(n: Column) -> Column:
        index = F.floor(n / F.lit(99 * 9999)).cast("bigint")
        new_area = index + 1 + (index >= 665).cast("int")
        return F.format_string("%03d-%02d-%04d", new_area, F.pmod(F.floor(n / F.lit(9999)).cast("bigint"), F.lit(99)) + 1, F.pmod(n, F.lit(9999)) + 1)

    return F.when(valid, _let(permute_number(number, _SSN_RANGE, key, "ssn"), written)).otherwise(v)


def _phone(v: Column, key: str) -> Column:
    """The digits after a leading country code of +1 to +999 as written before the first separator."""
    def of(code: Column) -> Column:
        digits = _digits(F.substring(v, F.length(code) + 1, F.length(v)))
        valid = F.length(_digits(v)).between(8, 15)
        return F.when(valid, F.concat(code, _refill(F.substring(v, F.length(code) + 1, F.length(v)), permute_characters(digits, key, "phone")))).otherwise(v)

    return _let(F.regexp_extract(v, r"^(\+\d{1,3})(?=[ .(-])", 1), of)


def _ip(v: Column, key: str) -> Column:
    octets = [F.split_part(v, F.lit("."), F.lit(i)).cast("bigint") for i in (1, 2, 3, 4)]
    valid = (octets[0] <= 255) & (octets[1] <= 255) & (octets[2] <= 255) & (octets[3] <= 255)
    number = ((octets[0] * 256 + octets[1]) * 256 + octets[2]) * 256 + octets[3]
    written = lambda n: F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])
    return F.when(valid, _let(permute_number(number, _IP_RANGE, key, "ip"), written)).otherwise(v)


def _date(v: Column, key: str) -> Column:
    first = F.lit(_FIRST_DAY).cast("date")
    parts = F.split(v, r"[-./]")
    number = lambda i: F.element_at(parts, i).cast("int")
    iso = v.rlike(r"^\d{4}")
    dotted = v.contains(".")
    month_first = ~iso & ~dotted & (number(1) <= 12)
    year = F.when(iso, number(1)).otherwise(number(3))
    month = F.when(iso, number(2)).when(month_first, number(1)).otherwise(number(2))
    day = F.when(iso, number(3)).when(month_first, number(2)).otherwise(number(1))
    parsed = F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")
    # Day-first slashes are told from month-first ones by a day above 12: their pseudonyms must have one too.
    late = ~iso & ~dotted & ~month_first
    permute = lambda n: permute_number(n, _DAYS, key, "date")
    fits = lambda n: F.dayofmonth(F.date_add(first, n.cast("int"))) > 12
    walked = lambda n: F.aggregate(F.sequence(F.lit(1), F.lit(80)), permute(n), lambda acc, _: F.when(fits(acc), acc).otherwise(permute(acc)))
    padded = F.length(F.element_at(parts, 1)) + F.length(F.element_at(parts, 2)) == 4

    def written(n: Column) -> Column:
        new = F.date_add(first, n.cast("int"))
        wide = F.when(iso, F.when(v.contains("-"), F.date_format(new, "yyyy-MM-dd")).otherwise(F.date_format(new, "yyyy/MM/dd")))
        wide = wide.when(dotted, F.date_format(new, "dd.MM.yyyy")).when(month_first, F.date_format(new, "MM/dd/yyyy"))
        narrow = F.when(dotted, F.date_format(new, "d.M.yyyy")).when(month_first, F.date_format(new, "M/d/yyyy")).otherwise(F.date_format(new, "d/M/yyyy"))
        return F.when(iso | padded, wide.otherwise(F.date_format(new, "dd/MM/yyyy"))).otherwise(narrow)

    def shifted(n: Column) -> Column:
        return F.when(n.between(0, _DAYS[0] * _DAYS[1] - 1), _let(F.when(late, walked(n)).otherwise(permute(n)), written)).otherwise(v)

    return F.when(parsed.isNotNull(), _let(F.datediff(parsed, first).cast("bigint"), shifted)).otherwise(v)


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one match of ``PATTERN``; a value that fails its validation stays, but for valid cards and accounts in it."""
    whole = lambda p: f"^(?:{p})$"
    found = F.when(value.contains("@"), _email(value, key))
    for form, use in ((_IBAN, _ibans), (_DATE, _date), (_SSN, _ssn), (_IPV4, _ip), (_PHONE, _phone)):
        found = found.when(value.rlike(whole(form)), use(value, key))
    return found.otherwise(_cards(value, key))


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, text, n_values)``: the text with pseudonyms, and how many values were replaced.

    A null text stays null with 0 values; an empty text stays empty.  Texts without a validated
    value come back unchanged, byte for byte.  Repeated rows give equal rows, null ids are kept, an
    empty table gives none; other columns are ignored, so their names cannot clash.
    """
    body = F.col("_text")
    rows = docs.select(F.col(id_col), F.col(text).alias("_text"))
    matches = F.when(body.rlike(r"\d|@"), F.regexp_extract_all(body, F.lit(PATTERN), F.lit(0)))
    found = rows.withColumn("_found", matches)
    mapped = found.withColumn("_mapped", F.when(F.size("_found") > 0, F.transform("_found", lambda v: pseudonym(v, key))))
    gaps = F.split(body, PATTERN, -1)
    joined = F.array_join(F.zip_with(gaps, "_mapped", lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    changed = F.size(F.filter(F.zip_with("_found", "_mapped", lambda a, b: a != b), lambda x: x))
    hit = F.col("_mapped").isNotNull()
    return mapped.select(
        id_col, F.when(hit, joined).otherwise(body).alias("text"), F.when(hit, changed).otherwise(0).cast("bigint").alias("n_values")
    )
