"""PII: format-preserving Feistel pseudonyms, in DataFrame functions only.

What is found and validated in a text is replaced by a keyed permutation within its own format, so
equal values get equal pseudonyms in every document and different values different ones:

* card numbers (13 to 19 digits that pass the Luhn test): all digits but the last are permuted,
  the last is the new check digit; blanks and hyphens stay. Where a longer run of groups of digits doesn't pass as a whole, every
  part of it that is written like a card (one group, 4-4-4-4 and on, 4-6-4, 4-6-5) and passes is replaced, the longest first;
* IBANs (of the country's length, that pass the mod-97 test): country and format stay, new check digits;
* social security numbers: permuted among the valid ones (area, group and serial not zero...);
* North American phone numbers: permuted among the valid area codes, exchanges and lines;
  other international numbers: the digits after the first three;
* IPv4 addresses (each octet at most 255): permuted among all addresses;
* dates of 1900 to 2099 that exist: permuted among those days, written in their own format;
* e-mail addresses: the local part, letter for letter of its class (letters beyond Latin-1 stay), the domain stays;
* access keys, and the values of password/secret/token/api key assignments (names in any case, with any prefix) up to a
  blank or a quote: likewise; signs inside a value stay.

Numbers use a Feistel network on Z_a x Z_b with modular addition (a permutation for any
a, b; where a x b exceeds the domain, cycle walking); strings one on two halves with
addition character by character within the character's class. The round function is SHA-2 of key,
kind, round and the other half.

Matches and the stretches between them come from one pattern, line by line; lines without a digit, @, =
or colon aren't searched, and everything that isn't replaced stays byte for byte. There is no shuffle.

``KEY`` is a public default for tests and reports: whoever knows the key can undo the permutations, so give a secret one
where pseudonyms leave the house.

Very long texts are searched line by line, whole; an empty text or table stays empty. Defined results: null text stays null with no matches; what fails its validation stays; a value in
two formats of dates stays linked by its day; repeated rows give equal results; all other columns
pass through, existing columns of the outputs' names are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
KEY = "panelcast"
#: The length of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27,
    "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20}
_IBAN = "|".join("(?:" + "|".join(c for c, n in IBAN_LENGTHS.items() if n == length) + r")\d{2}(?: ?[A-Z0-9]){" + str(length - 4) + "}"
                 for length in sorted(set(IBAN_LENGTHS.values()), reverse=True))
_SECRET_NAME = r"(?i:password|passwd|secret|token|api_key|apikey|api-key)"
#: The formats, in the order in which they are tried.
FORMATS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}",
    "secret": r"(?<![A-Za-z0-9])" + _SECRET_NAME + r" {0,2}[=:] {0,2}[\"']{0,1}[^\s\"'.,;:][^\s\"']{6,}[^\s\"'.,;:]",
    "access_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "iban": r"\b(?=[A-Z]{2}\d{2})(?:" + _IBAN + r")(?![A-Za-z0-9])",
    "date": r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/]|[.-]\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ipv4": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "phone": r"(?<![\d+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\d+(])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)"
             r"|(?<![\d.+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-]|\.\d)|(?<![\d+])\+[2-9]\d(?:[ .-]?\d){6,12}(?!\d)",
    "card": r"(?<![\d+-])\d(?:[ -]?\d){12,200}(?!\d)",
}
PATTERN = "|".join(f"(?:{p})" for p in FORMATS.values())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hash_number(key: str, kind: str, step: Column, value: Column, modulus: int) -> Column:
    text = F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 14), 16, 10).cast("long") % modulus


def feistel_number(x: Column, a: int, b: int, key: str, kind: str) -> Column:
    """A permutation of 0 .. a*b-1."""
    def step(s: Column, i: Column) -> Column:
        left, right = s["l"], s["r"]
        even = i % 2 == 0
        return F.struct(
            F.when(even, (left + _hash_number(key, kind, i, right, a)) % a).otherwise(left).alias("l"),
            F.when(even, right).otherwise((right + _hash_number(key, kind, i, left, b)) % b).alias("r"))

    def run(v: Column) -> Column:
        start = F.struct(F.floor(v / b).cast("long").alias("l"), (v % b).cast("long").alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])

    return let(x, run)


def walked_number(x: Column, size: int, a: int, b: int, key: str, kind: str, walks: int = 16) -> Column:
    """A permutation of 0 .. size-1 by cycle walking on a*b >= size numbers."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(walks)), feistel_number(x, a, b, key, kind),
                       lambda s, _: F.when(s < size, s).otherwise(feistel_number(s, a, b, key, kind)))


def _shifted(s: Column, code: Column, hexes: bool) -> Column:
    """Each character of ``s`` moved within its class by two hex digits of ``code``."""
    ranges = [("0", "9"), ("a", "f" if hexes else "z"), ("A", "F" if hexes else "Z")]
    ranges += [] if hexes else [("à", "ö"), ("ø", "ÿ"), ("À", "Ö"), ("Ø", "Þ")]
    classes = F.array(*[F.struct(F.lit(ord(low)).alias("low"), F.lit(ord(high) - ord(low) + 1).alias("n")) for low, high in ranges])

    def moved(t: Column, j: Column) -> Column:
        by = F.conv(F.substr(t["code"], j * 2 + 1, F.lit(2)), 16, 10).cast("int")

        def one(c: Column) -> Column:
            own = let(F.ascii(c), lambda x: F.transform(F.filter(classes, lambda k: x.between(k["low"], k["low"] + k["n"] - 1)),
                                                        lambda k: F.char(k["low"] + (x - k["low"] + by) % k["n"])))
            return F.coalesce(F.get(own, F.lit(0)), c)
        return let(F.substr(t["s"], j + 1, F.lit(1)), one)

    def all_moved(t: Column) -> Column:
        n = F.length(t["s"])
        return F.when(n == 0, t["s"]).otherwise(F.array_join(
            F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda j: moved(t, j)), ""))

    return let(F.struct(s.alias("s"), code.alias("code")), all_moved)


def feistel_text(s: Column, key: str, kind: str, hexes: bool = False) -> Column:
    """A permutation of the strings with the classes of ``s`` (at most 128 characters a half)."""
    def code(i: Column, other: Column) -> Column:
        base = F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), other)
        return F.concat(F.sha2(base, 512), F.sha2(F.concat(base, F.lit("+")), 512))

    def step(t: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, _shifted(t["l"], code(i, t["r"]), hexes)).otherwise(t["l"]).alias("l"),
                        F.when(even, t["r"]).otherwise(_shifted(t["r"], code(i, t["l"]), hexes)).alias("r"))

    def run(v: Column) -> Column:
        half = F.floor(F.length(v) / 2).cast("int")
        start = F.struct(F.substr(v, F.lit(1), half).alias("l"), F.substr(v, half + 1, F.length(v)).alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda t: F.concat(t["l"], t["r"]))

    return let(s, run)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def _refill(mask: Column, digits: Column) -> Column:
    """``mask`` with its digits replaced by ``digits`` one after the other."""
    def run(v: Column) -> Column:
        def put(t: Column, i: Column) -> Column:
            c = F.substr(v["mask"], i, F.lit(1))
            is_digit = c.rlike("[0-9]")
            return F.struct(F.concat(t["o"], F.when(is_digit, F.substr(v["digits"], t["n"] + 1, F.lit(1))).otherwise(c)).alias("o"),
                            (t["n"] + is_digit.cast("int")).alias("n"))
        return F.aggregate(F.sequence(F.lit(1), F.length(v["mask"])), F.struct(F.lit("").alias("o"), F.lit(0).alias("n")), put,
                           lambda t: t["o"])

    return let(F.struct(mask.alias("mask"), digits.alias("digits")), run)


def _luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """Luhn sum; whether the last digit is one of those that count double."""
    def run(v: Column) -> Column:
        n = F.length(v)

        def add(total: Column, i: Column) -> Column:
            d = F.substr(v, i, F.lit(1)).cast("int")
            twice = (n - i) % 2 == (0 if doubled_last else 1)
            return total + F.when(twice, F.when(d >= 5, d * 2 - 9).otherwise(d * 2)).otherwise(d)

        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)

    return let(digits, run)


def _card(m: Column, key: str) -> Column:
    def good(digits: Column) -> Column:
        return let(digits, lambda d: F.when(F.length(d).between(13, 19), _luhn_sum(d, False) % 10 == 0).otherwise(F.lit(False)))

    def replaced(part: Column) -> Column:
        def checked(d: Column, body: Column) -> Column:
            check = (F.lit(10) - _luhn_sum(body, True) % 10) % 10
            return _refill(part, F.concat(body, check.cast("string")))
        return let(_digits(part), lambda d: let(feistel_text(F.substr(d, F.lit(1), F.length(d) - 1), key, "card"), lambda body: checked(d, body)))

    def parts(tokens: Column) -> Column:
        """``tokens``: groups of digits and single blanks or hyphens in turn."""
        groups = ((F.size(tokens) + 1) / 2).cast("int")
        size = lambda i, k: F.coalesce(F.length(F.get(tokens, i + 2 * k)), F.lit(0))
        text = lambda i, n: F.array_join(F.slice(tokens, i + 1, 2 * n - 1), "")

        def written(i: Column, n: Column) -> Column:
            """Whether n groups from here are a run of their own or written like a card."""
            fours = (size(i, 0) == 4) & (size(i, 1) == 4) & (size(i, 2) == 4)
            return ((i == 0) & (n == groups)) | (n == 1) | ((n == 3) & (size(i, 0) == 4) & (size(i, 1) == 6) & size(i, 2).between(4, 5)) | (
                (n == 4) & fours & size(i, 3).between(1, 4)) | ((n == 5) & fours & (size(i, 3) == 4) & size(i, 4).between(1, 3))

        def step(s: Column, i: Column) -> Column:
            """At the i-th token: what is written out so far, and the token up to which it reaches."""
            tried = F.when(i % 2 == 0, F.filter(F.array(groups, F.lit(5), F.lit(4), F.lit(3), F.lit(1)), lambda n: F.when(
                written(i, n), good(_digits(text(i, n)))).otherwise(F.lit(False))))
            done = let(F.get(tried, F.lit(0)), lambda n: F.when(n.isNull(), F.struct(
                F.concat(s["o"], F.get(tokens, i)).alias("o"), (i + 1).alias("at"))).otherwise(F.struct(
                    F.concat(s["o"], replaced(text(i, n))).alias("o"), (i + 2 * n - 1).alias("at"))))
            return F.when(i < s["at"], s).otherwise(done)

        start = F.struct(F.lit("").alias("o"), F.lit(0).alias("at"))
        return F.aggregate(F.sequence(F.lit(0), F.size(tokens) - 1), start, step, lambda s: s["o"])

    return let(F.regexp_extract_all(m, F.lit("([0-9]+|[ -])"), F.lit(1)), parts)


def _mod97(s: Column) -> Column:
    """s as the number of an IBAN (letters 10 to 35), modulo 97."""
    def run(v: Column) -> Column:
        def add(total: Column, i: Column) -> Column:
            c = F.substr(v, i, F.lit(1))
            return F.when(c.rlike("[0-9]"), (total * 10 + c.cast("int")) % 97).otherwise((total * 100 + F.ascii(c) - 55) % 97)
        return F.aggregate(F.sequence(F.lit(1), F.length(v)), F.lit(0), add)

    return let(s, run)


def _iban(m: Column, key: str) -> Column:
    plain = F.regexp_replace(m, " ", "")
    country, rest = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5), F.length(plain))

    def run(new: Column) -> Column:
        check = F.lpad((F.lit(98) - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
        return let(F.concat(country, check, new), lambda whole: F.when(
            m.contains(" "), F.trim(F.regexp_replace(whole, "(.{4})", "$1 "))).otherwise(whole))

    good = _mod97(F.concat(rest, country, F.substr(plain, F.lit(3), F.lit(2)))) == 1
    return F.when(good, let(feistel_text(rest, key, "iban"), run)).otherwise(m)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substr(m, F.lit(p), F.lit(n)).cast("long") for p, n in ((1, 3), (5, 2), (8, 4)))
    good = (area.between(1, 899)) & (area != 666) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)  # 898 areas

    def run(new: Column) -> Column:
        a = F.floor(new / (99 * 9999))
        a = F.when(a + 1 >= 666, a + 2).otherwise(a + 1)
        return F.format_string("%03d-%02d-%04d", a, F.floor(new / 9999) % 99 + 1, new % 9999 + 1)

    new = feistel_number((place * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, key, "ssn")
    return F.when(good, let(new, run)).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    def run(d: Column) -> Column:
        ten = F.substr(d, F.length(d) - 9, F.lit(10))
        north = ~m.startswith("+") | (m.startswith("+1") & (F.length(d) == 11))
        area, exchange, line = (F.substr(ten, F.lit(p), F.lit(n)).cast("long") for p, n in ((1, 3), (4, 3), (7, 4)))
        new = feistel_number(((area - 200) * 800 + exchange - 200) * 10000 + line, 640_000, 10_000, key, "phone")
        text = let(new, lambda v: F.format_string(
            "%03d%03d%04d", F.floor(v / 8_000_000) + 200, F.floor(v / 10_000) % 800 + 200, v % 10_000))
        head = F.when(F.length(d) == 11, F.lit("1")).otherwise(F.lit(""))
        other = F.concat(F.substr(d, F.lit(1), F.lit(3)), feistel_text(F.substr(d, F.lit(4), F.length(d)), key, "phone"))
        return (F.when(north & (area >= 200) & (exchange >= 200), _refill(m, F.concat(head, text)))
                .when(~north, _refill(m, other)).otherwise(m))

    return let(_digits(m), run)


def _ipv4(m: Column, key: str) -> Column:
    def run(parts: Column) -> Column:
        number = F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s * 256 + x)
        new = feistel_number(number, 65_536, 65_536, key, "ipv4")
        text = let(new, lambda v: F.concat_ws(".", *(F.floor(v / 256 ** k % 256).cast("string") for k in (3, 2, 1, 0))))
        return F.when(F.forall(parts, lambda x: x <= 255), text).otherwise(m)

    return let(F.transform(F.split(m, r"\."), lambda x: x.cast("long")), run)


_FIRST_DAY, _DAYS = "1900-01-01", 73_049  # to 2099-12-31


def _date(m: Column, key: str) -> Column:
    slash, year_first = m.rlike(r"^\d{1,2}/"), m.rlike(r"^\d{4}")
    a, b = F.regexp_extract(m, r"^(\d+)", 1), F.regexp_extract(m, r"^\d+[-/.](\d+)", 1)
    c = F.regexp_extract(m, r"(\d+)$", 1)
    made = lambda y, mo, d: F.try_to_date(F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    us = slash & made(c, a, b).isNotNull()  # month first if that is a date, else day first
    day = F.when(year_first, made(a, b, c)).when(us, made(c, a, b)).otherwise(made(c, b, a))

    def run(number: Column) -> Column:
        new = F.date_add(F.lit(_FIRST_DAY).cast("date"), walked_number(number, _DAYS, 271, 270, key, "date").cast("int"))
        return F.when(number.between(0, _DAYS - 1), let(new, written)).otherwise(m)

    def written(new: Column) -> Column:
        return (F.when(year_first & m.contains("-"), F.date_format(new, "yyyy-MM-dd"))
                .when(year_first, F.date_format(new, "yyyy/MM/dd"))
                .when(us, F.date_format(new, "MM/dd/yyyy")).when(slash, F.date_format(new, "dd/MM/yyyy"))
                .otherwise(F.date_format(new, "dd.MM.yyyy")))

    return let(F.datediff(day, F.lit(_FIRST_DAY).cast("date")).cast("long"), run)


def _email(m: Column, key: str) -> Column:
    at = F.instr(m, "@")
    local = F.substr(m, F.lit(1), at - 1)
    return F.concat(feistel_text(local, key, "email"), F.substr(m, at, F.length(m)))


_NAME = r"^([A-Za-z_-]+ *[=:] *[\"']?)"


def _secret(m: Column, key: str) -> Column:
    name, value = F.regexp_extract(m, _NAME, 1), F.regexp_replace(m, _NAME, "")

    def chunks(v: Column, hexes: bool) -> Column:
        # feistel_text moves at most 128 characters a half
        starts = F.sequence(F.lit(0), F.floor((F.length(v) - 1) / 256).cast("int"))
        return F.array_join(F.transform(starts, lambda i: feistel_text(F.substr(v, i * 256 + 1, F.lit(256)), key, "secret", hexes)), "")

    return F.concat(name, let(value, lambda v: F.when(v.rlike("^[0-9a-fA-F]+$"), chunks(v, True)).otherwise(chunks(v, False))))


def _access_key(m: Column, key: str) -> Column:
    return F.concat(F.substr(m, F.lit(1), F.lit(4)), feistel_text(F.substr(m, F.lit(5), F.length(m)), key, "access_key"))


_MAKERS = {"email": _email, "secret": _secret, "access_key": _access_key, "iban": _iban, "date": _date, "ssn": _ssn,
           "ipv4": _ipv4, "phone": _phone, "card": _card}
#: A match's kind by its own form.
_FORMS = {"secret": "^" + _SECRET_NAME + " *[=:]", "email": r"@", "access_key": r"^(?:AKIA|ASIA)[A-Z0-9]{16}$", "iban": r"^[A-Z]{2}\d{2}[A-Z0-9 ]{8,}$",
          "date": r"^(?:\d{4}[-/]\d{2}[-/]\d{2}|\d{1,2}[/.]\d{1,2}[/.]\d{4})$", "ssn": r"^\d{3}-\d{2}-\d{4}$",
          "ipv4": r"^\d{1,3}(?:\.\d{1,3}){3}$", "phone": r"^(?:\+[\d .()-]+|\(\d{3}\)[\d .-]+|\d{3}[.-]\d{3}[.-]\d{4})$",
          "card": r"^\d(?:[ -]?\d){12,200}$"}


def kind_of(m: Column) -> Column:
    out = None
    for kind, form in _FORMS.items():
        out = F.when(m.rlike(form), kind) if out is None else out.when(m.rlike(form), kind)
    return out


def pseudonym(m: Column, kind: Column, key: str = KEY) -> Column:
    out = None
    for name, make in _MAKERS.items():
        out = F.when(kind == name, make(m, key)) if out is None else out.when(kind == name, make(m, key))
    return out


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str = KEY, out_col: str | None = None,
                 found_col: str | None = None) -> DataFrame:
    """``docs`` with the text pseudonymised (in ``out_col``, by default in place); ``found_col`` gets
    an array of (kind, value, pseudonym) of what was replaced, in the text's order."""
    out_col, text = out_col or text_col, F.col(text_col)
    others = [F.col(c) for c in docs.columns if c not in (out_col, found_col)]
    none = F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>")

    def replaced(line: Column) -> Column:
        matches = F.transform(F.regexp_extract_all(line, F.lit(PATTERN), F.lit(0)), lambda m: F.struct(m.alias("m"), kind_of(m).alias("k")))
        return F.transform(matches, lambda s: F.struct(
            s["k"].alias("kind"), s["m"].alias("value"), pseudonym(s["m"], s["k"], key).alias("pseudonym")))

    def joined(s: Column) -> Column:
        between = F.split(s["line"], PATTERN, -1)
        return F.when(F.size(s["found"]) == 0, s["line"]).otherwise(F.array_join(F.zip_with(
            between, s["found"], lambda a, f: F.concat(a, F.coalesce(f["pseudonym"], F.lit("")))), ""))

    # no format goes over a line's end, and most lines hold none of these characters
    lines = F.transform(F.split(text, "\n", -1), lambda line: F.struct(
        line.alias("line"), F.when(line.rlike("[0-9@=:]"), replaced(line)).otherwise(none).alias("found")))
    hit = F.coalesce(text.rlike("[0-9@=:]"), F.lit(False))
    done = docs.withColumn("__lines", F.when(hit, lines))
    out = [F.when(hit, F.array_join(F.transform("__lines", joined), "\n")).otherwise(text).alias(out_col)]
    if found_col:
        every = F.flatten(F.transform(F.coalesce(F.col("__lines"), F.array().cast(done.schema["__lines"].dataType)), lambda s: s["found"]))
        out.append(F.filter(every, lambda f: f["value"] != f["pseudonym"]).alias(found_col))
    made = done.select(*others, *out)
    places = [c for c in docs.columns if c != found_col] + [c for c in (out_col, found_col) if c and (c not in docs.columns or c == found_col)]
    return made.select(*dict.fromkeys(places))
