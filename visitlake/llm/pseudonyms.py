"""Private numbers and dates replaced by keyed permutations within their format, in SQL expressions only."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
FIRST_DAY, DAYS = "1900-01-01", 73_049  # 1900-01-01 to 2099-12-31, 17 x 4297 days
_DAY_SIDES = (17, 4_297)

#: what a candidate looks like; whether it is valid is decided afterwards
PATTERNS = {
    "email": r"[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    # (ddd) with or without a country code; country code and groups; ten digits by - or .; a country code and digits alone
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\d)+])\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
             r"|(?<![\d+])\+\d{1,3}[ .-]\d{2,4}[ .-]\d{3,4}[ .-]\d{4}(?!\d)|(?<![\d+.-])\d{3}-\d{3}-\d{4}(?![\d-])|(?<![\d+.-])\d{3}\.\d{3}\.\d{4}(?!\d|\.\d)"
             r"|(?<![\d+])\+\d{11,15}(?!\d)",
    # groups of four, groups of 4, 6 and 5, or 13 to 19 digits alone
    "card": r"(?<![\d.-])(?:\d{4}[ -]){3}\d{4}(?![\d-])|(?<![\d.-])\d{4}[ -]\d{6}[ -]\d{5}(?![\d-])|(?<![\d.-])\d{13,19}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)",
    # year first by -, or last by / or .; days and months with one or two digits
    "date": r"(?<![\d-])\d{4}-\d{1,2}-\d{1,2}(?![\d-])|(?<![\d/.])\d{1,2}([/.])\d{1,2}\1\d{4}(?![\d/])",
}
KINDS = tuple(PATTERNS)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: a text without any of these has no candidate: spares most texts the large pattern
MAYBE = r"@|\d"


def _noise(secret: str, kind: str, round_: Column, half: Column) -> Column:
    """60 keyed bits for a round."""
    digest = F.sha2(F.concat_ws("|", F.lit(secret), F.lit(kind), round_.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is worked out once, however often `then` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def feistel(number: Column, left: Column, right: Column, secret: str, kind: str, back: bool = False) -> Column:
    """A keyed permutation of 0 to left * right - 1: its two digits in the mixed base take turns adding noise from the other.

    `back` undoes it. `left` and `right` are at most 10^9, so all sums fit a bigint.
    """
    sign = -1 if back else 1

    def step(state: Column, i: Column) -> Column:
        l, r = state["l"], state["r"]
        moved_l = F.pmod(l + F.lit(sign) * F.pmod(_noise(secret, kind, i, r), left), left)
        moved_r = F.pmod(r + F.lit(sign) * F.pmod(_noise(secret, kind, i, l), right), right)
        even = i % 2 == 0
        return F.struct(F.when(even, moved_l).otherwise(l).alias("l"), F.when(even, r).otherwise(moved_r).alias("r"))

    rounds = list(range(ROUNDS))[::-1 if back else 1]
    rest = F.pmod(number, right)
    # less its rest the number is a multiple, so the quotient is exact even where doubles are not
    start = F.struct(F.round((number - rest) / right).cast("bigint").alias("l"), rest.alias("r"))
    return F.aggregate(F.array(*[F.lit(i) for i in rounds]), start, step, lambda s: s["l"] * right + s["r"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _permute_digits(digits: Column, secret: str, kind: str, back: bool) -> Column:
    """A digit string as a keyed permutation of all strings of its length (2 to 18 digits), halves as the two sides."""
    n = F.char_length(digits)
    cut = F.floor(n / 2).cast("int")  # 10 to the 9th at most
    a, b = F.pow(F.lit(10), cut).cast("bigint"), F.pow(F.lit(10), n - cut).cast("bigint")
    number = F.substr(digits, F.lit(1), cut).cast("bigint") * b + F.substr(digits, cut + 1).cast("bigint")
    return F.lpad(feistel(number, a, b, secret, kind, back).cast("string"), n, F.lit("0"))


def _put_digits(shape: Column, digits: Column) -> Column:
    """`shape` with its digits replaced, in order, by `digits`."""
    places = F.sequence(F.lit(1), F.char_length(shape))

    def at(i: Column) -> Column:
        c = F.substr(shape, i, F.lit(1))
        nth = F.char_length(_digits(F.substr(shape, F.lit(1), i)))
        return F.when(c.between("0", "9"), F.substr(digits, nth, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(places, at), "")


def luhn_sum(digits: Column) -> Column:
    """Sum of a card number whose last digit is the check digit; valid if 10 divides it."""
    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.char_length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.char_length(digits) - 1), F.lit(0), add)


def _card(found: Column, secret: str, back: bool) -> Column:
    def checked(payload: Column) -> Column:
        check = F.pmod(10 - F.pmod(luhn_sum(F.concat(payload, F.lit("0"))), F.lit(10)), F.lit(10))
        return F.concat(payload, check.cast("string"))

    def moved(d: Column) -> Column:
        payload = _permute_digits(F.substr(d, F.lit(1), F.char_length(d) - 1), secret, "card", back)
        return F.when(F.pmod(luhn_sum(d), F.lit(10)) == 0, let(let(payload, checked), lambda new: _put_digits(found, new)))

    return let(_digits(found), moved)


def _phone(found: Column, secret: str, back: bool) -> Column:
    """The last ten digits are permuted, what is before them of the country code stays."""
    def moved(d: Column) -> Column:
        national = _permute_digits(F.substr(d, F.char_length(d) - 9), secret, "phone", back)
        return let(F.concat(F.substr(d, F.lit(1), F.char_length(d) - 10), national), lambda new: _put_digits(found, new))

    return let(_digits(found), moved)


def _ssn(found: Column, secret: str, back: bool) -> Column:
    area, group, serial = (F.substring(found, at, n).cast("bigint") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - 1 - F.when(area > 666, 1).otherwise(0)  # 898 areas
    def shaped(moved: Column) -> Column:
        area_at = F.floor(moved / (99 * 9999)).cast("bigint")
        return F.concat_ws("-", F.lpad((area_at + 1 + F.when(area_at >= 665, 1).otherwise(0)).cast("string"), 3, "0"),
                           F.lpad((F.pmod(F.floor(moved / 9999).cast("bigint"), F.lit(99)) + 1).cast("string"), 2, "0"),
                           F.lpad((F.pmod(moved, F.lit(9999)) + 1).cast("string"), 4, "0"))

    moved = feistel((place * 99 + group - 1) * 9999 + serial - 1, F.lit(898 * 99).cast("bigint"), F.lit(9999).cast("bigint"), secret, "ssn", back)
    return F.when(valid, let(moved, shaped))


def _ip(found: Column, secret: str, back: bool) -> Column:
    parts = F.transform(F.split(found, r"\."), lambda p: p.cast("bigint"))
    side = F.lit(65_536).cast("bigint")
    number = F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, p: s * 256 + p)
    moved = feistel(number, side, side, secret, "ip", back)
    scales = F.array(*[F.lit(2 ** s).cast("bigint") for s in (24, 16, 8, 0)])
    new = let(moved, lambda m: F.array_join(F.transform(scales, lambda s: F.pmod(F.floor(m / s).cast("bigint"), F.lit(256)).cast("string")), "."))
    return F.when(F.forall(parts, lambda p: p <= 255), new)


def _date(found: Column, secret: str, back: bool) -> Column:
    """Year first, or day and month before the year; where day first is no date, month first is tried. A date with a one-digit part gets
    a pseudonym without leading zeros."""
    slashed = F.translate(found, ".", "/")
    iso = F.try_to_timestamp(found, F.lit("yyyy-M-d")).cast("date")
    day_first = F.try_to_timestamp(slashed, F.lit("d/M/yyyy")).cast("date")
    month_first = F.try_to_timestamp(slashed, F.lit("M/d/yyyy")).cast("date")
    padded = F.char_length(found) == 10
    day = F.datediff(F.coalesce(iso, day_first, month_first), F.lit(FIRST_DAY).cast("date")).cast("bigint")
    moved = feistel(day, *[F.lit(n).cast("bigint") for n in _DAY_SIDES], secret, "date", back)

    def shaped(date: Column) -> Column:
        def either(long: str, short: str) -> Column:
            return F.when(padded, F.date_format(date, long)).otherwise(F.date_format(date, short))

        text = (F.when(iso.isNotNull(), either("yyyy-MM-dd", "yyyy-M-d"))
                .when(day_first.isNotNull(), either("dd/MM/yyyy", "d/M/yyyy")).otherwise(either("MM/dd/yyyy", "M/d/yyyy")))
        return F.when(found.contains("."), F.translate(text, "/", ".")).otherwise(text)

    return F.when(day.between(0, DAYS - 1), let(F.date_add(F.lit(FIRST_DAY).cast("date"), moved.cast("int")), shaped))


def _email(found: Column, secret: str, back: bool) -> Column:
    """Mail addresses have no fixed format to permute in: the whole address becomes a keyed name, equal for equal addresses."""
    if back:
        return found
    return F.concat(F.lit("user-"), F.substring(F.sha2(F.concat_ws("|", F.lit(secret), F.lit("email"), F.lower(found)), 256), 1, 16), F.lit("@pseudonym.invalid"))


_WORK = {"email": _email, "phone": _phone, "card": _card, "ssn": _ssn, "ip": _ip, "date": _date}


def kind_of(found: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        out = F.when(found.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def pseudonym(kind: Column, found: Column, secret: str, back: bool = False) -> Column:
    """The replacement of a candidate, or NULL where it is not valid."""
    out = F.lit(None).cast("string")
    for name in reversed(KINDS):
        out = F.when(kind == name, _WORK[name](found, secret, back)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, secret: str, text_col: str = "text", back: bool = False) -> DataFrame:
    """`docs` with private values of the text replaced, and `pii`: an array of (kind, start, pseudonym) in order of the text.

    Card numbers (Luhn), phone numbers, social security numbers, IPv4 addresses and dates that are valid are permuted under `secret`
    among the valid values of the same format: separators stay, check digits hold, dates remain dates from 1900 to 2099. Equal values
    get equal pseudonyms in every document, different ones different pseudonyms. Mail addresses become keyed names. Candidates that
    fail their check stay as they are. `start` counts characters of the new text. `back` restores all but mail addresses and dates
    that put the month first; of a date with a one-digit part it restores the day, but perhaps not whether zeros lead.

    Accepted formats: phones with the area code in parentheses, with a country code and groups, as ten digits by hyphens or dots, or as
    + and 11 to 15 digits; cards of 13 to 19 digits, alone, in fours, or in groups of 4, 6 and 5; dates with the year first (-) or last
    (/ or .); social security numbers with hyphens; dotted IPv4 addresses. The comments at `PATTERNS` say the same of each.

    NULL and empty texts stay and have an empty `pii`; a text may be of any length. A column named pii is replaced, others stay.
    """
    text = F.col(f"`{text_col}`")
    hit = text.rlike(MAYBE)
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    marked = F.transform(found, lambda m: F.struct(m.alias("found"), kind_of(m).alias("kind")))
    replaced = F.transform(marked, lambda m: F.struct(m["found"].alias("found"), m["kind"].alias("kind"),
                                                     pseudonym(m["kind"], m["found"], secret, back).alias("new")))
    rows = docs.withColumn("__hits", F.when(hit, replaced).otherwise(F.array().cast(_HITS)))
    rows = rows.withColumn("__between", F.when(F.size("__hits") > 0, F.split(text, ANY, -1)))
    parts = F.transform("__between", lambda gap, i: F.concat(gap, F.coalesce(F.get(F.col("__hits"), i)["new"], F.get(F.col("__hits"), i)["found"], F.lit(""))))
    rows = rows.withColumn(text_col, F.when(F.size("__hits") > 0, F.array_join(parts, "")).otherwise(text))

    def walk(state: Column, i: Column) -> Column:
        h, gap = F.get(F.col("__hits"), i), F.get(F.col("__between"), i)
        start = state["at"] + F.char_length(gap)
        item = F.struct(h["kind"].alias("kind"), start.alias("start"), h["new"].alias("pseudonym"))
        return F.struct((start + F.char_length(F.coalesce(h["new"], h["found"]))).alias("at"),
                        F.when(h["new"].isNotNull(), F.concat(state["out"], F.array(item))).otherwise(state["out"]).alias("out"))

    empty = F.array().cast("array<struct<kind:string,start:int,pseudonym:string>>")
    spans = F.aggregate(F.sequence(F.lit(0), F.size("__hits") - 1), F.struct(F.lit(0).alias("at"), empty.alias("out")), walk, lambda s: s["out"])
    rows = rows.withColumn("pii", F.when(F.size("__hits") > 0, spans).otherwise(empty))
    return rows.drop("__hits", "__between")


_HITS = "array<struct<found:string,kind:string,new:string>>"
