"""Format-preserving pseudonyms for personal data and secrets.

Values are found by pattern and validated (Luhn for card numbers, mod 97 for IBANs, octets for addresses,
the calendar for dates). A validated value is replaced by a keyed permutation of itself within its own format:
an eight-round Feistel network over the two halves of the string, each round adding a keyed hash of one half
to the other, character by character within its class (digits stay digits, letters keep their case, all other
characters stay). The permutation is one-to-one for each kind and length, so equal values stay linked across
documents and different values stay apart. Check digits are computed anew; addresses permute their four octets,
dates their day within the 400-year cycle of the calendar, so results are valid values again. E-mail addresses
keep their domain, phone numbers their country code.

Everything is a DataFrame expression: a text is split at the matches, each match is replaced, and the pieces
are joined. Only texts that hold a match are rebuilt.

Of a secret the name and the sign stay, with or without quotes around the name; values in quotes may hold blanks. A number after
a plus sign without separators keeps its first three digits, which hold the country code.

Defined results: a null or empty text stays as it is; a text of any length is searched whole, and a value of any length permuted
whole; a text without matches is returned unchanged; a match that does not validate stays; repeated rows are treated
each; an empty table gives no rows; all other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import let, unused

#: The registered query's key. Whoever knows a key can undo its pseudonyms: pass a secret one.
DEMONSTRATION_KEY = "demonstration"
ROUNDS = 8

#: kind -> pattern, in the order they are tried at a position
PATTERNS: dict[str, str] = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}+(?![A-Za-z0-9-])",
    "secret": r"(?=[APSTapst])(?:(?<!\w)AKIA[0-9A-Z]{16}(?!\w)|(?<![^\W_])(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)(?:[_-]\w++)*+[\"']?(?:\h*+|\s{0,3})"
    r"(?:[=:](?:\h*+|\s{0,3})(?:\"[^\"\n]{3,}+\"|'[^'\n]{3,}+'|[\"']?[^\s\"']{6,}+)|=\h*+[^\s\"'=]{3,}+))",
    "iban": r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "date": r"(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![\w/-])",
    "ip": r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "card": r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])",
    "phone": r"(?<![\w.+-])(?:\+[0-9]{9,15}|(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4})(?![\w-])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Length of the calendar's cycle, and the two radices its days are permuted in.
CYCLE_DAYS, CYCLE_RADICES = 146097, (189, 773)
#: 2000-01-01, a first day of the cycle, in days since 1970-01-01.
CYCLE_START = 10957
#: Months with a 29th in every year, and with a 31st; leap years within a cycle of 400.
MONTHS_29, MONTHS_31 = (1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12), (1, 3, 5, 7, 8, 10, 12)
LEAP_YEARS = tuple(y for y in range(0, 400, 4) if y % 100 or y == 0)


def _keyed(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 256)


def _number(seed: Column) -> Column:
    """A non-negative whole number under 2**48 from a hash."""
    return F.conv(F.substring(seed, 1, 12), 16, 10).cast("long")


def _at(s: Column, i: Column) -> Column:
    return F.substring(s, i, F.lit(1))


def _add(half: Column, seed: Column) -> Column:
    """``half`` with a keyed amount added to every character, within its class."""
    # 84 characters use up a block of the key stream; a longer half draws as many blocks as it takes.
    block = lambda b: F.concat(*[F.sha2(F.concat_ws("\x1f", seed, (4 * b + k).cast("string")), 256) for k in range(4)])
    stream = F.transform(F.sequence(F.lit(0), F.floor((F.length(half) - 1) / 84).cast("int")), block)

    def shifted(stream: Column, c: Column, i: Column) -> Column:
        own = F.get(stream, F.floor(i / 84).cast("int"))
        amount = F.conv(F.substring(own, F.pmod(i, F.lit(84)) * 3 + 1, F.lit(3)), 16, 10).cast("int")

        def within(first: str, size: int) -> Column:
            base = F.lit(ord(first))
            return F.char(base + F.pmod(F.ascii(c) - base + amount, F.lit(size)))

        return (
            F.when(c.between("0", "9"), within("0", 10))
            .when(c.between("a", "z"), within("a", 26))
            .when(c.between("A", "Z"), within("A", 26))
            .otherwise(c)
        )

    size = F.length(half)
    return F.when(size == 0, half).otherwise(
        let(stream, lambda s: F.array_join(F.transform(F.split(half, "", -1), lambda c, i: shifted(s, c, i)), ""))
    )


def permute_string(s: Column, kind: str, key: str) -> Column:
    """Keyed one-to-one map of strings of equal length and character classes."""
    cut = F.ceil(F.length(s) / 2).cast("int")
    halves = F.struct(F.substring(s, F.lit(1), cut).alias("a"), F.substring(s, cut + 1, F.length(s)).alias("b"))

    def turn(x: Column, r: Column) -> Column:
        seed = lambda other: _keyed(key, F.lit(kind), r.cast("string"), F.length(s).cast("string"), other)
        return F.when(
            F.pmod(r, F.lit(2)) == 0, F.struct(_add(x["a"], seed(x["b"])).alias("a"), x["b"].alias("b"))
        ).otherwise(F.struct(x["a"].alias("a"), _add(x["b"], seed(x["a"])).alias("b")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), halves, turn, lambda x: F.concat(x["a"], x["b"]))


def permute_number(n: Column, radices: tuple[int, int], kind: str, key: str) -> Column:
    """Keyed one-to-one map of the whole numbers under the product of ``radices``."""
    first, second = (F.lit(r).cast("long") for r in radices)
    start = F.struct(F.floor(n / second).cast("long").alias("a"), F.pmod(n, second).cast("long").alias("b"))

    def turn(x: Column, r: Column) -> Column:
        seed = lambda other: _number(_keyed(key, F.lit(kind), r.cast("string"), other.cast("string")))
        return F.when(
            F.pmod(r, F.lit(2)) == 0, F.struct(F.pmod(x["a"] + seed(x["b"]), first).alias("a"), x["b"].alias("b"))
        ).otherwise(F.struct(x["a"].alias("a"), F.pmod(x["b"] + seed(x["a"]), second).alias("b")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda x: x["a"] * second + x["b"])


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit is not doubled."""
    size = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = _at(digits, i).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(F.pmod(size - i, F.lit(2)) == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), add)


def refill(template: Column, digits: Column) -> Column:
    """``template`` with its digits replaced by ``digits`` in order."""
    def put(i: Column) -> Column:
        c = _at(template, i)
        return F.when(c.between("0", "9"), _at(digits, F.length(digits_of(F.substring(template, F.lit(1), i))))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(template)), put), "")


def card(s: Column, key: str) -> Column:
    """A card number of the same length and layout with a right check digit; null if ``s`` fails Luhn."""
    def new(d: Column) -> Column:
        body = permute_string(F.substring(d, F.lit(1), F.length(d) - 1), "card", key)
        check = F.pmod(F.lit(10) - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
        return F.when(F.pmod(luhn_sum(d), F.lit(10)) == 0, refill(s, F.concat(body, check.cast("string"))))

    return let(digits_of(s), new)


def _mod97(s: Column) -> Column:
    """The remainder by 97 of a string whose letters count as 10 to 35."""
    def step(r: Column, i: Column) -> Column:
        c = _at(s, i)
        return F.when(c.between("0", "9"), F.pmod(r * 10 + c.cast("int"), F.lit(97))).otherwise(F.pmod(r * 100 + F.ascii(c) - 55, F.lit(97)))

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), step)


def iban(s: Column, key: str) -> Column:
    """An IBAN of the same country and layout with right check digits; null if ``s`` fails mod 97."""
    def new(plain: Column) -> Column:
        country, body = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
        moved = permute_string(body, "iban", key)
        check = F.lpad((F.lit(98) - _mod97(F.concat(moved, country, F.lit("00")))).cast("string"), 2, "0")
        whole = F.concat(country, check, moved)
        spaced = F.array_join(
            F.transform(
                F.sequence(F.lit(1), F.length(s)),
                lambda i: F.when(_at(s, i) == " ", F.lit(" ")).otherwise(_at(whole, F.length(F.regexp_replace(F.substring(s, F.lit(1), i), " ", "")))),
            ),
            "",
        )
        return F.when((_mod97(F.concat(body, F.substring(plain, 1, 4))) == 1) & F.length(plain).between(15, 34), spaced)

    return let(F.regexp_replace(s, " ", ""), new)


def ip(s: Column, key: str) -> Column:
    """An address for an address; null where an octet is over 255."""
    octets = F.transform(F.split(s, r"\."), lambda o: o.cast("long"))

    def new(o: Column) -> Column:
        whole = F.aggregate(o, F.lit(0).cast("long"), lambda t, x: t * 256 + x)
        parts = lambda m: F.concat_ws(".", *[F.pmod(F.shiftright(m, 8 * k), F.lit(256)).cast("string") for k in (3, 2, 1, 0)])
        return F.when(F.forall(o, lambda x: x <= 255), let(permute_number(whole, (65536, 65536), "ip", key), parts))

    return let(octets, new)


def _day_first(s: Column, key: str) -> Column:
    """A date dd/MM/yyyy whose day is over 12, for such a date: days 13 to 28, 29, 30 and 31 are permuted each among
    themselves, so that no month-first reading ever comes out."""
    day, month, year = (F.substring(s, at, n).cast("long") for at, n in ((1, 2), (4, 2), (7, 4)))
    era, within = F.floor(year / 400) * 400, F.pmod(year, F.lit(400))

    def written(day: Column, month: Column, year: Column) -> Column:
        return F.format_string("%02d/%02d/%04d", day, month, era + year)

    def listed(months: tuple[int, ...]) -> Column:
        names = F.array(*[F.lit(m) for m in months])
        n = within * len(months) + F.array_position(names, month.cast("int")) - 1
        return let(
            permute_number(n, (400, len(months)), f"date{len(months)}", key),
            lambda p: written(day, F.get(names, F.pmod(p, F.lit(len(months))).cast("int")), F.floor(p / len(months))),
        )

    leap = F.array(*[F.lit(y) for y in LEAP_YEARS])
    return (
        F.when(
            day < 29,
            let(
                permute_number((within * 12 + month - 1) * 16 + day - 13, (4800, 16), "date16", key),
                lambda p: written(F.pmod(p, F.lit(16)) + 13, F.pmod(F.floor(p / 16), F.lit(12)) + 1, F.floor(p / 192)),
            ),
        )
        .when(day == 31, listed(MONTHS_31))
        .when(month != 2, listed(MONTHS_29))
        .otherwise(
            let(
                permute_number(F.array_position(leap, within.cast("int")).cast("long") - 1, (len(LEAP_YEARS), 1), "date_leap", key),
                lambda p: written(day, month, F.get(leap, p.cast("int"))),
            )
        )
    )


def date(s: Column, key: str) -> Column:
    """A date for a date in the same layout, within the same 400 years; null where ``s`` is no date.

    A slashed date is month-first where that reading is valid and stays so; day-first dates are a space of their own.
    """
    iso = F.when(s.contains("/"), F.concat_ws("-", F.substring(s, 7, 4), F.substring(s, 1, 2), F.substring(s, 4, 2))).otherwise(s)
    swapped = F.concat_ws("-", F.substring(s, 7, 4), F.substring(s, 4, 2), F.substring(s, 1, 2))
    month_first = F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date")
    day_first = F.try_to_timestamp(swapped, F.lit("yyyy-MM-dd")).cast("date")

    def new(d: Column, pattern: str) -> Column:
        days = F.unix_date(d).cast("long") - CYCLE_START
        moved = permute_number(F.pmod(days, F.lit(CYCLE_DAYS)), CYCLE_RADICES, "date", key)
        return F.date_format(F.date_from_unix_date((F.floor(days / CYCLE_DAYS) * CYCLE_DAYS + moved + CYCLE_START).cast("int")), pattern)

    return (
        F.when(~s.contains("/"), new(month_first, "yyyy-MM-dd"))
        .when(month_first.isNotNull(), new(month_first, "MM/dd/yyyy"))
        .when(day_first.isNotNull(), _day_first(s, key))
    )


def email(s: Column, key: str) -> Column:
    return F.concat(permute_string(F.substring_index(s, "@", 1), "email", key), F.lit("@"), F.substring_index(s, "@", -1))


def phone(s: Column, key: str) -> Column:
    """The country code stays; null where there are fewer than nine digits or more than fifteen."""
    code = F.regexp_extract(s, r"^(\+[0-9]{1,3}[ .-]?)?", 1)
    rest = F.substring(s, F.length(code) + 1, F.length(s))
    return F.when(F.length(digits_of(s)).between(9, 15), F.concat(code, refill(rest, permute_string(digits_of(rest), "phone", key))))


def secret(s: Column, key: str) -> Column:
    head = F.regexp_extract(s, r"^(AKIA|[\w-]+[\"']?[\s\h]*[=:][\s\h]*[\"']?)", 1)
    return F.concat(head, permute_string(F.substring(s, F.length(head) + 1, F.length(s)), "secret", key))


REPLACERS: dict[str, Callable[[Column, str], Column]] = {
    "email": email,
    "secret": secret,
    "iban": iban,
    "date": date,
    "ip": ip,
    "ssn": lambda s, key: refill(s, permute_string(digits_of(s), "ssn", key)),
    "card": card,
    "phone": phone,
}


def replaced(match: Column, key: str) -> Column:
    """(kind, value) for a match; kind null and the match itself where no kind validates."""
    def tried(kind: str, pattern: str) -> Column:
        return F.when(
            match.rlike(f"^(?:{pattern})$"),
            let(REPLACERS[kind](match, key), lambda v: F.when(v.isNotNull(), F.struct(F.lit(kind).alias("kind"), v.alias("value")))),
        )

    kept = F.struct(F.lit(None).cast("string").alias("kind"), match.alias("value"))
    return F.coalesce(*[tried(k, p) for k, p in PATTERNS.items()], kept)


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced under ``key``, and an array ``replaced`` of counts by kind."""
    found, out = unused("own_found", docs), unused("replaced", docs)
    text = F.col(text_col)
    docs = docs.withColumn(found, F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    new = F.transform(F.col(found), lambda match: replaced(match, key))
    pieces = F.split(text, ANY, -1)
    joined = let(new, lambda r: F.struct(
        F.array_join(F.flatten(F.zip_with(pieces, r, lambda p, x: F.array(p, F.coalesce(x["value"], F.lit(""))))), "").alias("text"),
        F.aggregate(r, F.array(*[F.lit(0)] * len(PATTERNS)), lambda t, x: F.zip_with(
            t, F.array(*[F.coalesce((x["kind"] == k).cast("int"), F.lit(0)) for k in PATTERNS]), lambda a, b: a + b
        )).alias("counts"),
    ))
    docs = docs.withColumn(out, F.when(F.size(found) > 0, joined))
    return docs.withColumns(
        {text_col: F.coalesce(F.col(f"{out}.text"), text), out: F.coalesce(F.col(f"{out}.counts"), F.array(*[F.lit(0)] * len(PATTERNS)))}
    ).drop(found)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with pseudonyms, and how many of each kind it holds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = pseudonymize(docs, DEMONSTRATION_KEY)
    return out.select("doc_id", "text", *[F.get("replaced", F.lit(i)).alias(f"n_{k}") for i, k in enumerate(PATTERNS)])
