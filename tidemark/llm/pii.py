"""Format-preserving pseudonyms for personal data, in DataFrame functions alone (operator 10).

Numbers and dates that validate (card numbers by their check digit, IBANs by their remainder, addresses by their
octets, dates by the calendar) and the identifiers around them are permuted by a keyed Feistel network inside their own
format: digits stay digits, letters stay letters of their case, dates stay dates, check digits stay right. The
permutation depends on key, kind and format only, so one value has one pseudonym in all documents and two values of a
kind never share one.

Dates are those from 1900 to 2099 written YYYY-MM-DD, or DD and MM and YYYY with dots, strokes or hyphens between. What
can only be month, day, year keeps that order: days from 13 to 28 move among each other with month and year, days 29
and 30 likewise, and the 31st to other 31sts. Of IPv6 addresses only those of eight groups are looked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HEX, UPPER_HEX, KEYCHARS = "0123456789abcdef", "0123456789ABCDEF", UPPER + DIGITS
#: Dates from 1900-01-01 on, as days; two halves of 270 x 271 days reach to 2100-05-01 and need no second try.
FIRST_DAY, DAY_SPAN = "1900-01-01", (270, 271)
YEARS = (1900, 2099)
_D, _M, _Y = r"(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|1[0-2])", r"(?:19|20)\d\d"
_HEX4 = r"[0-9A-Fa-f]{1,4}"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: What is looked for, in this order at each place. Each alternative starts at a digit, a letter or a plus sign.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9](?:[A-Za-z0-9.\-]{0,251}[A-Za-z0-9])?\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?i:password|passwd|secret|token|api_?key)\s{0,3}[=:]\s{0,3}[\"']?[0-9A-Fa-f]{12,}+(?![A-Za-z0-9+/_])",
    "token": r"(?<![A-Za-z0-9])(?i:password|passwd|secret|token|api_?key)\s{0,3}[=:]\s{0,3}[\"']?(?=[A-Za-z+/_\-]*\d)[A-Za-z0-9+/_\-]{12,}+={0,2}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "access_key": r"(?<![A-Za-z0-9])A[KS]IA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "date": r"(?<![\d.\-/])(?:19\d\d|20\d\d)-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\d\-/]|\.\d)",
    "day_first": rf"(?<![\d.\-/])(?:{_D}/{_M}/{_Y}|{_D}\.{_M}\.{_Y}|{_D}-{_M}-{_Y})(?![\d\-/]|\.\d)",
    "month_first": rf"(?<![\d.\-/])(?:{_M}/{_D}/{_Y}|{_M}\.{_D}\.{_Y}|{_M}-{_D}-{_Y})(?![\d\-/]|\.\d)",
    "ipv6": rf"(?<![0-9A-Za-z:])(?:{_HEX4}:){{7}}{_HEX4}(?![0-9A-Za-z:])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ssn": r"(?<![\d\-])(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d\-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .\-]?\(\d{2,4}\)[ .\-]?\d{3}[ .\-]?\d{4}|\+\d{1,3}[ .\-]\d{2,4}[ .\-]\d{3,4}[ .\-]\d{3,4}|\(\d{3}\) ?\d{3}-\d{4}|\+\d{10,15}|(?<![\d.\-/])\d{3}-\d{3}-\d{4}(?!-))(?!\d)",
    # A run of groups stops before what may be an address or an e-mail name; valid spans are looked for inside.
    "card": r"(?<![\d.\-])(?:\d{4}[ \-]){4,}\d{1,7}(?![\d\-]|\.\d|[A-Za-z0-9._%+\-]{0,63}@)|(?<![\d.\-])(?:\d{4}[ \-]){3}\d{1,7}(?![\d\-])|(?<![\d.\-])\d{13,19}(?!\d)",
}
ALL = "|".join(f"(?:{p})" for p in PATTERNS.values())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _feistel(values: Column, radices: Column, tweak: Column) -> Column:
    """Permute ``values`` (array<int>), entry i below ``radices`` [i], keyed by ``tweak``.

    Halves are changed in turn by adding digits of SHA-256 over the tweak, the round and the other half; a half's digest
    is taken once, and the blocks of the stream from that, so the work is in proportion to the values.
    """

    def turn(acc: Column, number: Column) -> Column:
        words = F.concat_ws("|", tweak, number.cast("string"), F.array_join(acc["r"].cast("array<string>"), ","))
        blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), ((F.size(acc["l"]) - 1) / 16).cast("int")))
        stream = let(F.sha2(words.cast("binary"), 256), lambda w: F.transform(blocks, lambda b: F.sha2(F.concat_ws("|", w, b.cast("string")).cast("binary"), 256)))
        digits = lambda bits, i: F.substring(F.element_at(bits, (i / 16).cast("int") + 1), (i % 16) * 4 + 1, F.lit(4))
        add = lambda bits: F.transform(
            acc["l"], lambda v, i: ((v + F.conv(digits(bits, i), 16, 10).cast("int")) % F.element_at(acc["lr"], i + 1)).cast("int")
        )
        return F.struct(acc["r"].alias("l"), let(stream, add).alias("r"), acc["rr"].alias("lr"), acc["lr"].alias("rr"))

    half = (F.size(values) / 2).cast("int")
    part = lambda a: (F.slice(a, F.lit(1), half), F.slice(a, half + 1, F.size(a) - half))
    (left, right), (left_r, right_r) = part(values), part(radices)
    start = F.struct(left.alias("l"), right.alias("r"), left_r.alias("lr"), right_r.alias("rr"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)  # an even number: halves are back in place
    return let(done, lambda x: F.concat(x["l"], x["r"]))


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Weighted sum of a digit string; the last digit is doubled if ``doubled`` is 0, the one before if 1."""
    each = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == doubled, (c.cast("int") * 2) % 10 + (c.cast("int") >= 5).cast("int")).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, v: a + v)


def luhn_valid(digits: Column) -> Column:
    return (_luhn_sum(digits, 1) % 10 == 0) & F.length(digits).between(13, 19) & (F.regexp_replace(digits, "0", "") != "")


def kind_of(m: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        bare = pattern if kind != "card" else r"[\d \-]{13,}"
        out = F.when(m.rlike(f"^(?:{bare})$"), F.lit(kind)).otherwise(out)
    return out


def _alphabets(kind: Column, place: Column, apart: Column) -> Column:
    """Alphabets at a place of a value; a secret keeps digits and the cases of letters apart up to the place ``apart``."""
    of = lambda *letters: F.array(*map(F.lit, letters))
    secret = F.when(place <= apart, of(DIGITS, HEX[10:], UPPER_HEX[10:])).when(apart > 0, of(UPPER_HEX)).otherwise(of(HEX))
    letters = of(DIGITS, LOWER, UPPER)
    arrays = {"email": letters, "token": letters, "iban": letters, "secret": secret, "ipv6": of(HEX, UPPER_HEX), "access_key": of(KEYCHARS)}
    out = of(DIGITS)
    for k, letters in arrays.items():
        out = F.when(kind == k, letters).otherwise(out)
    return out


def _free(m: Column, kind: Column) -> Column:
    """First and last place whose character may move, and the place up to which a secret's alphabets are kept apart.

    A secret in lower case has none. One in upper case has its first letter, which so stays a letter, and one of mixed
    case all: the three kinds of values go to values of their own kind and never share a pseudonym.
    """
    n = F.length(m)
    hex_value = F.regexp_extract(m, r"([0-9A-Fa-f]+)$", 1)
    token = F.length(F.regexp_extract(m, r"([A-Za-z0-9+/_\-]+={0,2})$", 1))
    value = F.length(hex_value)
    head = F.length(F.regexp_extract(hex_value, "^([0-9]*[A-F])[0-9A-F]*$", 1))
    apart = F.when((kind != "secret") | ~hex_value.rlike("[A-F]"), F.lit(0)).when(head > 0, n - value + head).otherwise(n)
    country = F.length(F.regexp_extract(m, r"^(\+\d{1,3}(?=[ .(\-]))?", 1))
    first = F.when(kind == "secret", n - value + 1).when(kind == "token", n - token + 1).when(kind == "iban", F.lit(5)).when(kind == "access_key", F.lit(5)).when(kind == "phone", country + 1).when(kind == "card", F.lit(2)).otherwise(F.lit(1))
    last = F.when(kind == "email", F.instr(m, "@") - 1).when(kind == "card", n - 1).otherwise(n)
    return F.struct(first.alias("first"), last.alias("last"), apart.alias("apart"))


def _string(m: Column, kind: Column, key: str) -> Column:
    """Pseudonym of a string: each free character moves inside the alphabet that holds it."""

    def placed(range_: Column) -> Column:
        letter = lambda c, i: F.when(
            (i + 1).between(range_["first"], range_["last"]), F.try_element_at(F.filter(_alphabets(kind, i + 1, range_["apart"]), lambda a: F.instr(a, c) > 0), F.lit(1))
        )
        return F.transform(_chars(m), lambda c, i: F.struct(i.alias("at"), c.alias("c"), letter(c, i).alias("a")))

    def moved(places: Column) -> Column:
        moving = F.filter(places, lambda p: p["a"].isNotNull())
        radices = F.transform(moving, lambda p: F.length(p["a"]))
        form = F.array_join(F.transform(places, lambda p: F.coalesce(F.length(p["a"]).cast("string"), p["c"])), ",")
        shape = F.when(kind.isin("card", "phone", "ssn"), F.size(moving).cast("string")).when(kind == "iban", F.concat(F.substring(m, 1, 2), F.array_join(F.transform(moving, lambda p: F.substring(p["a"], 1, 1)), ""))).otherwise(form)
        values = F.transform(moving, lambda p: F.instr(p["a"], p["c"]) - 1)
        return let(_feistel(values, radices, F.concat_ws("|", F.lit(key), kind, shape)), lambda v: spelled(places, moving, v))

    def spelled(places: Column, moving: Column, values: Column) -> Column:
        # Moved and fixed characters, put in order by their places.
        moved = F.transform(moving, lambda p, i: F.struct(p["at"], F.substring(p["a"], F.element_at(values, i + 1) + 1, F.lit(1)).alias("c")))
        fixed = F.transform(F.filter(places, lambda p: p["a"].isNull()), lambda p: F.struct(p["at"], p["c"]))
        return F.array_join(F.transform(F.sort_array(F.concat(moved, fixed)), lambda x: x["c"]), "")

    return let(let(_free(m, kind), placed), moved)


def _with_check_digit(s: Column) -> Column:
    body = F.regexp_replace(F.substring(s, F.lit(1), F.length(s) - 1), r"\D", "")
    return F.concat(F.substring(s, F.lit(1), F.length(s) - 1), ((10 - _luhn_sum(body, 0) % 10) % 10).cast("string"))


def _ip(m: Column, key: str) -> Column:
    moved = _feistel(F.split(m, r"\.").cast("array<int>"), F.array_repeat(F.lit(256), 4), F.lit(f"{key}|ip"))
    return F.array_join(moved.cast("array<string>"), ".")


def _date(m: Column, key: str) -> Column:
    """A calendar date becomes another one between 1900-01-01 and 2100-05-01."""
    a, b = DAY_SPAN
    first = F.to_date(F.lit(FIRST_DAY))

    def fresh(n: Column) -> Column:
        moved = _feistel(F.array((n / b).cast("int"), n % b), F.array(F.lit(a), F.lit(b)), F.lit(f"{key}|date"))
        day = let(moved, lambda v: F.element_at(v, 1) * b + F.element_at(v, 2))
        return F.when(n.between(0, a * b - 1), F.date_format(F.date_add(first, day), "yyyy-MM-dd")).otherwise(m)

    return let(F.coalesce(F.datediff(F.try_to_date(m, "yyyy-MM-dd"), first), F.lit(-1)), fresh)


def _day_month_year(m: Column, key: str) -> Column:
    """A date written day, month, year becomes another one; what stands between stays."""
    iso = F.concat(F.substring(m, 7, 4), F.lit("-"), F.substring(m, 4, 2), F.lit("-"), F.substring(m, 1, 2))
    spell = lambda d: F.concat(F.substring(d, 9, 2), F.substring(m, 3, 1), F.substring(d, 6, 2), F.substring(m, 6, 1), F.substring(d, 1, 4))
    return F.when(F.try_to_date(iso, "yyyy-MM-dd").isNotNull(), let(_date(iso, key), spell)).otherwise(m)


def _month_day_year(m: Column, key: str) -> Column:
    """A date that can only be month, day, year: its day stays in its class (13 to 28, 29 and 30, 31)."""
    number = lambda at, n: F.substring(m, at, n).cast("int")
    month, day, year = number(1, 2), number(4, 2), number(7, 4)
    of = lambda *v: F.array(*map(F.lit, v))
    low, count = F.when(day <= 28, 13).when(day <= 30, 29).otherwise(31), F.when(day <= 28, 16).when(day <= 30, 2).otherwise(1)
    months = F.when(day <= 28, of(*range(1, 13))).when(day <= 30, of(1, *range(3, 13))).otherwise(of(1, 3, 5, 7, 8, 10, 12))

    def moved(months: Column) -> Column:
        values = F.array(year - YEARS[0], (F.array_position(months, month) - 1).cast("int"), day - low)
        radices = F.array(F.lit(YEARS[1] - YEARS[0] + 1), F.size(months), count)
        spell = lambda v: F.concat(
            F.lpad(F.element_at(months, F.element_at(v, 2) + 1).cast("string"), 2, "0"), F.substring(m, 3, 1), F.lpad((F.element_at(v, 3) + low).cast("string"), 2, "0"), F.substring(m, 6, 1), (F.element_at(v, 1) + YEARS[0]).cast("string")
        )
        tweak = F.concat_ws("|", F.lit(f"{key}|month_first"), low.cast("string"))
        return F.when(F.array_contains(months, month), let(_feistel(values, radices, tweak), spell)).otherwise(m)

    return let(months, moved)


def iban_remainder(compact: Column) -> Column:
    """An IBAN without blanks as a number, letters from 10 on and its first four characters last, modulo 97."""
    turned = F.concat(F.substr(compact, F.lit(5)), F.substring(compact, 1, 4))
    step = lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(_chars(turned), F.lit(0), step)


def _with_iban_digits(s: Column) -> Column:
    bare = F.replace(s, F.lit(" "), F.lit(""))
    check = 98 - iban_remainder(F.concat(F.substring(bare, 1, 2), F.lit("00"), F.substr(bare, F.lit(5))))
    return F.concat(F.substring(s, 1, 2), F.lpad(check.cast("string"), 2, "0"), F.substr(s, F.lit(5)))


def _card_runs(m: Column) -> Column:
    """A run of five or more groups cut into cards, marked ``c``, rests of cards ``r`` and what lies between, ``p``.

    Each start is tried. The first valid span of four groups is a card, then the next one behind it; groups that only a
    valid span overlapping it holds are a rest, so no valid span stays as it is.
    """

    def cut(groups: Column) -> Column:
        valid = F.transform(groups, lambda g, i: (i + 4 <= F.size(groups)) & luhn_valid(F.regexp_replace(F.array_join(F.slice(groups, i + 1, F.lit(4)), ""), r"\D", "")))
        return let(valid, lambda v: F.filter(F.split(spans(groups, v), r"\|"), lambda x: F.length(x) > 1))

    def spans(groups: Column, valid: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            group, starts = F.element_at(groups, i), F.element_at(valid, i)
            held = F.exists(F.slice(valid, F.greatest(F.lit(1), i - 3), F.least(F.lit(4), i)), lambda x: x)
            digits = F.regexp_replace(group, r"\D", "")
            begun = lambda mark: F.concat(acc["s"], F.lit("|p"), F.regexp_replace(group, r"\d", ""), F.lit(f"|{mark}"), digits)
            grown = F.when((acc["left"] > 0) | (held & ~starts & (acc["left"] < 0)), F.concat(acc["s"], group)).when(starts, begun("c")).when(held, begun("r")).otherwise(F.concat(acc["s"], F.lit("|p"), group))
            left = F.when(acc["left"] > 0, acc["left"] - 1).when(starts, F.lit(3)).when(held, F.lit(-1)).otherwise(F.lit(0))
            return F.struct(grown.alias("s"), left.alias("left"))

        return F.aggregate(F.sequence(F.lit(1), F.size(groups)), F.struct(F.lit("").alias("s"), F.lit(0).alias("left")), step)["s"]

    return let(F.regexp_extract_all(m, F.lit(r"[ \-]?\d+"), F.lit(0)), cut)


def pseudonyms(m: Column, key: str) -> Column:
    """The parts (m, p) of one match of ALL and their pseudonyms; a part that doesn't validate stays as it is.

    All matches but runs of card groups have one part.
    """

    def of(part: Column) -> Column:
        text, kind = part["m"], part["kind"]
        other = let(_string(text, kind, key), lambda s: F.when(kind == "card", _with_check_digit(s)).when(kind == "iban", _with_iban_digits(s)).otherwise(s))
        p = F.when(kind == "date", _date(text, key)).when(kind == "day_first", _day_month_year(text, key)).when(kind == "month_first", _month_day_year(text, key)).when(kind == "ip", _ip(text, key)).when(kind.isNotNull() & part["ok"], other).otherwise(text)
        return F.struct(text.alias("m"), p.alias("p"))

    def whole(kind: Column) -> Column:
        ok = F.when(kind == "card", luhn_valid(F.regexp_replace(m, r"\D", ""))).when(kind == "iban", let(F.replace(m, F.lit(" "), F.lit("")), lambda c: F.length(c).between(15, 34) & (iban_remainder(c) == 1))).otherwise(True)
        return F.array(F.struct(m.alias("m"), kind.alias("kind"), F.coalesce(ok, F.lit(False)).alias("ok")))

    run = F.transform(_card_runs(m), lambda x: F.struct(F.substr(x, F.lit(2)).alias("m"), F.when(x.startswith("c"), "card").when(x.startswith("r"), "rest").alias("kind"), F.lit(True).alias("ok")))
    parts = F.when(m.rlike(r"^(?:\d{4}[ \-]){4,}\d{1,7}$"), run).otherwise(let(kind_of(m), whole))
    return F.transform(parts, of)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match of ALL."""
    return F.array_join(F.transform(pseudonyms(m, key), lambda x: x["p"]), "")


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """Replace ``text`` by the same text with pseudonyms under the secret ``key``; who has the key can undo them.

    With ``count``, a column of that name tells how many values were replaced; one that is there already is replaced.
    All other columns stay, whatever their names, and rows stay where they are. Null stays null, empty stays empty, an
    empty table stays empty, repeated rows are treated alike; the rest of a text is kept to the letter. A text that
    holds neither a digit nor an @ isn't searched.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    t = F.col(f"`{text}`").cast("string")
    found = F.when(t.rlike("[0-9@]"), F.regexp_extract_all(t, F.lit(ALL), F.lit(0)))
    held = "__pairs"
    while held in docs.columns:
        held += "_"
    staged = docs.withColumn(held, F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda m: pseudonyms(m, key)))
    between = F.split(t, ALL, -1)
    joined = F.array_join(F.transform(between, lambda s, i: F.concat(s, F.coalesce(F.array_join(F.transform(F.try_element_at(F.col(held), i + 1), lambda x: x["p"]), ""), F.lit("")))), "")
    if count:
        staged = staged.withColumn(count, F.size(F.filter(F.flatten(held), lambda p: p["m"] != p["p"])))
    return staged.withColumn(text, F.when(F.size(held) > 0, joined).otherwise(t)).drop(held)
