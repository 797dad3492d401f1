"""Format-preserving pseudonyms for personal data, in DataFrame functions.

One pattern finds candidates; each is validated by its kind: card numbers by
their check digit, social security numbers and dates by their ranges, addresses
by their octets.  What is valid is replaced by a value of the same kind and
format.  Numbers and dates go through a keyed Feistel network over exactly the
valid values of their kind, a bijection: equal values get equal pseudonyms in
every document and spelling, different ones different pseudonyms.  The round
function is a keyed SHA-256.  Mail addresses and secrets, which have no such
range, get a keyed hash in their format.  Candidates that are not valid stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskframe.llm.frames import col, free_name, others

ROUNDS = 8
KINDS = ("email", "secret", "phone", "ip", "date", "ssn", "card")
# In the order in which they are tried at a place.
# No group is repeated without a bound, since the engine matches such groups by
# recursion; unbounded parts are single classes.
_SSN, _ISO_DATE = "[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9]{4}-[0-9]{2}-[0-9]{2}"
_SECRET_NAME = r"(?i:token|secret|password|passwd|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?"
PATTERNS = {
    "email": r"[\p{L}\p{N}._%+-]{1,64}@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){1,10}",
    # A value goes up to white space or a quote, without marks that end a clause.
    "secret": _SECRET_NAME + r"[^\s\"']{3,}[^\s\"'.,;]",
    "phone": (r"\+[0-9]{1,3}[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
              # National, told from other numbers by its groups.
              r"|(?<![0-9.-])(?:1[ .-])?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
              # International in other groups, of 8 to 15 digits.
              r"|\+(?=[0-9](?:[ .()-]{0,2}[0-9]){7,14}(?![0-9]))[0-9]{1,3}(?:[ .()-]{1,2}[0-9]{1,8}){1,6}(?![0-9])"),
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "date": r"(?<![0-9])(?:[0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}|[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{4})(?![0-9])",
    "ssn": rf"(?<![0-9]){_SSN}(?![0-9])",
    # A whole run of digit groups that starts with 13 digits, up to where it ends or a
    # social security number or date begins.
    "card": (r"(?<![0-9])(?=[0-9](?:[ -]?[0-9]){12})[0-9][0-9 -]*?(?<=[0-9])(?![0-9])"
             rf"(?:(?![ -][0-9])|(?=[ -](?:{_SSN}|{_ISO_DATE})(?![0-9])))"),
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _hash(key: str, kind: str, *parts: Column) -> Column:
    """Hex digits of a keyed hash."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), *[p.cast("string") for p in parts], F.lit(key)), 256)


def feistel(left: Column, right: Column, a: int, b: int, key: str, kind: str) -> Column:
    """A keyed permutation of pairs below (a, b), as a struct of l and r."""
    def other(i: Column, half: Column, modulus: int) -> Column:
        return F.conv(F.substring(_hash(key, kind, i, half), 1, 15), 16, 10).cast("long") % modulus

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")),
        lambda s, i: F.struct(
            F.when(i % 2 == 1, (s["l"] + other(i, s["r"], a)) % a).otherwise(s["l"]).alias("l"),
            F.when(i % 2 == 0, (s["r"] + other(i, s["l"], b)) % b).otherwise(s["r"]).alias("r")))


def _using(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(payload: Column) -> Column:
    """The check digit that follows these digits."""
    weighted = F.transform(
        F.split(F.reverse(payload), ""),
        lambda c, i: F.when(i % 2 == 1, c.cast("int")).when(c.cast("int") > 4, c.cast("int") * 2 - 9)
        .otherwise(c.cast("int") * 2))
    total = F.aggregate(weighted, F.lit(0), lambda s, x: s + x)
    return ((10 - total % 10) % 10).cast("string")


def _padded(x: Column, n) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def _filled(m: Column, digits: Column) -> Column:
    """The match with its digits replaced in order."""
    return F.aggregate(
        F.split(m, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")),
        lambda s, c: F.when(
            c.rlike("[0-9]"), F.struct(F.concat(s["out"], digits.substr(s["k"], F.lit(1))).alias("out"),
                                       (s["k"] + 1).alias("k")))
        .otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k"))),
        lambda s: s["out"])


def _email(m: Column, key: str) -> Column:
    h = _hash(key, "email", F.lower(m))
    return F.concat(F.lit("u"), F.substring(h, 1, 12), F.lit("@h"), F.substring(h, 13, 8), F.lit(".example"))


def _secret(m: Column, key: str) -> Column:
    """Secrets of equal spelling, case included, get equal pseudonyms."""
    def made(v: Column) -> Column:
        h = F.substring(_hash(key, "secret", v), 1, 16)
        long = F.substring(F.repeat(F.concat(h, F.reverse(h)), F.ceil(F.length(v) / 32).cast("int")), F.lit(1), F.length(v))
        return F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(v)),
                        F.when(v == F.upper(v), F.upper(long)).otherwise(long))

    return _using(F.regexp_extract(m, f"(?s)^{_SECRET_NAME}(.*)$", 1), made)


def _phone(m: Column, key: str) -> Column:
    """The last ten digits are permuted, or six of an international number that has no more."""
    def made(d: Column) -> Column:
        n = F.length(d)

        def of_last(half: int) -> Column:
            local = F.substring(d, n - 2 * half + 1, F.lit(2 * half))
            return _using(
                feistel(F.substring(local, 1, half), F.substring(local, half + 1, half), 10**half, 10**half, key,
                        "phone" if half == 5 else "phone6"),
                lambda s: _filled(m, F.concat(
                    F.substring(d, F.lit(1), n - 2 * half), _padded(s["l"], half), _padded(s["r"], half))))

        return F.when(m.startswith("+") & (n <= 10), of_last(3)).otherwise(of_last(5))

    return _using(_digits(m), made)


def _ip(m: Column, key: str) -> Column:
    def made(o: Column) -> Column:
        at = [F.get(o, F.lit(i)).cast("int") for i in range(4)]
        return F.when(F.array_max(o.cast("array<int>")) <= 255, _using(
            feistel(at[0] * 256 + at[1], at[2] * 256 + at[3], 1 << 16, 1 << 16, key, "ip"),
            lambda s: F.concat_ws(".", *[x.cast("string") for h in (s["l"], s["r"])
                                         for x in (F.floor(h / 256), h % 256)])))

    return _using(F.split(m, r"\."), made)


# The days of 1800 to 2199, a whole cycle of the calendar: 146,097 = 189 * 773.
_FIRST_DAY, _DAY_HALVES = "1800-01-01", (189, 773)


def _date(m: Column, key: str) -> Column:
    def made(p: Column) -> Column:
        first = m.rlike("^[0-9]{4}")
        part = [F.get(p, F.lit(i)) for i in range(3)]

        def read(year: Column, month: Column, day: Column) -> Column:
            return F.try_to_timestamp(F.concat_ws("-", year, month, day), F.lit("yyyy-MM-dd")).cast("date")

        # Day first where that is a date, else month first.
        european, american = read(part[2], part[1], part[0]), read(part[2], part[0], part[1])
        day = F.when(first, read(part[0], part[1], part[2])).otherwise(F.coalesce(european, american))
        number = F.datediff(day, F.lit(_FIRST_DAY).cast("date"))
        a, b = _DAY_HALVES
        return _using(number, lambda n: F.when((n >= 0) & (n < a * b), _using(
            feistel(F.floor(n / b), n % b, a, b, key, "date"),
            lambda s: _using(
                F.date_add(F.lit(_FIRST_DAY).cast("date"), (s["l"] * b + s["r"]).cast("int")),
                lambda d: _filled(m, F.when(first, F.date_format(d, "yyyyMMdd")).when(
                    european.isNotNull(), F.date_format(d, "ddMMyyyy")).otherwise(F.date_format(d, "MMddyyyy")))))))

    return _using(F.split(m, "[-/.]"), made)


def _ssn(m: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        area, group = F.substring(d, 1, 3).cast("int"), F.substring(d, 4, 2).cast("int")
        serial = F.substring(d, 6, 4).cast("int")
        valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
        # The 898 areas in order, without 000 and 666.
        index = F.when(area > 666, area - 2).otherwise(area - 1)
        return F.when(valid, _using(
            feistel(index * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn"),
            lambda s: _using(F.floor(s["l"] / 99), lambda k: _filled(m, F.concat(
                _padded(F.when(k > 664, k + 2).otherwise(k + 1), 3), _padded(s["l"] % 99 + 1, 2),
                _padded(s["r"] + 1, 4))))))

    return _using(_digits(m), made)


def _card_number(m: Column, key: str) -> Column:
    """The pseudonym of what is a card number, else null."""
    def made(d: Column) -> Column:
        n = F.length(d)
        payload = F.substring(d, F.lit(1), n - 1)

        def of_length(k: int) -> Column:
            # k digits before the check digit, in two halves.
            a, b = 10 ** (k // 2), 10 ** (k - k // 2)
            return _using(
                feistel(F.substring(payload, 1, k // 2), F.substring(payload, k // 2 + 1, k - k // 2), a, b, key, f"card{k}"),
                lambda s: F.concat(_padded(s["l"], k // 2), _padded(s["r"], k - k // 2)))

        new = F.when(n == 13, of_length(12))
        for k in range(13, 19):
            new = new.when(n == k + 1, of_length(k))
        return _using(new, lambda p: _filled(m, F.concat(p, _luhn(p))))

    return _using(_digits(m), made)


# Digit groups are taken in blocks, so that a result grows by blocks.
_BLOCK = 64


def _cards(m: Column) -> Column:
    """The digit groups of a run, joined where they make a card number: from the left,
    the most groups of 13 to 19 digits with a valid check digit.

    A group of more than 19 digits belongs to no number.  Work is linear in the
    number of groups, but for the list of blocks.
    """
    def valid(d: Column) -> Column:
        n = F.length(d)
        return n.between(13, 19) & (_luhn(F.substring(d, F.lit(1), n - 1)) == F.substring(d, n, F.lit(1)))

    def cut(groups: Column) -> Column:
        def joined(i: Column, n: Column) -> Column:
            return F.array_join(F.slice(groups, i, n), "")

        def step(s: Column, i: Column) -> Column:
            def taken(ns: Column) -> Column:
                n = F.coalesce(F.get(ns, F.lit(0)), F.lit(0))
                text = joined(i, F.greatest(n, F.lit(1)))
                return F.struct(
                    F.concat(s["parts"], F.array(F.struct(text.alias("text"), (n > 0).alias("card")))).alias("parts"),
                    (i + F.greatest(n, F.lit(1))).cast("int").alias("next"))

            most = F.least(F.size(groups) - i + 1, F.lit(19))
            sizes = F.filter(F.sequence(most, F.lit(1), F.lit(-1)), lambda n: valid(_digits(joined(i, n))))
            return F.when(i < s["next"], s).otherwise(_using(sizes, taken))

        part = "array<struct<text:string,card:boolean>>"

        def block(s: Column, first: Column) -> Column:
            last = F.least(first + _BLOCK - 1, F.size(groups))
            inner = F.aggregate(
                F.sequence(first, last), F.struct(F.array().cast(part).alias("parts"), s["next"].alias("next")), step)
            return _using(inner, lambda x: F.struct(
                F.concat(s["blocks"], F.array(x["parts"])).alias("blocks"), x["next"].alias("next")))

        return F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.size(groups), F.lit(1)), F.lit(_BLOCK)),
            F.struct(F.array().cast(f"array<{part}>").alias("blocks"), F.lit(1).alias("next")),
            block, lambda s: F.flatten(s["blocks"]))

    return _using(F.regexp_extract_all(m, F.lit("[ -]?[0-9]+"), F.lit(0)), cut)


def _card(m: Column, key: str) -> Column:
    """The run with its card numbers replaced; null without any."""
    return _using(_cards(m), lambda parts: F.when(F.exists(parts, lambda x: x["card"]), F.array_join(
        F.transform(parts, lambda x: F.when(x["card"], _card_number(x["text"], key)).otherwise(x["text"])), "")))


_MAKE = {"email": _email, "secret": _secret, "phone": _phone, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card}


def pseudonymise(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The frame with `text` pseudonymised and `n_<kind>`, how many of each kind
    were replaced (long).

    A null text stays null, with counts of zero.  Columns named n_<kind> are
    replaced.
    """
    new = [f"n_{k}" for k in KINDS]
    found, gaps = free_name(df, "pii_found"), free_name(df, "pii_gaps")
    kept = others(df, new)

    def replaced(m: Column) -> Column:
        kind, made, n = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit("")), F.lit(1)
        for k, p in PATTERNS.items():
            # A lookbehind at the start of the match holds for what was found.
            is_kind = m.rlike(f"^(?:{p})$")
            kind, made = kind.when(is_kind, F.lit(k)), made.when(is_kind, _MAKE[k](m, key))
            if k == "card":
                n = F.when(kind == k, F.size(F.filter(_cards(m), lambda x: x["card"]))).otherwise(n)
        return F.struct(m.alias("was"), kind.alias("kind"), made.alias("now"), n.alias("n"))

    # Nothing of any kind is without a digit, an at sign or an assignment.
    maybe = col(text).rlike("[0-9@]|(?i:token|secret|passw|api[_-]?key)")
    staged = df.select(*map(col, kept)).withColumn(
        found, F.when(maybe, F.transform(F.regexp_extract_all(col(text), F.lit(ANY), F.lit(0)), replaced)))
    staged = staged.withColumn(gaps, F.when(F.size(found) > 0, F.split(col(text), ANY, -1)))
    joined = F.concat(
        F.array_join(F.zip_with(F.slice(F.col(gaps), 1, F.size(found)), F.col(found),
                                lambda g, x: F.concat(g, F.coalesce(x["now"], x["was"]))), ""),
        F.element_at(F.col(gaps), -1))
    count = {k: F.coalesce(F.aggregate(
        F.filter(F.col(found), lambda x: (x["kind"] == k) & x["now"].isNotNull()), F.lit(0), lambda s, x: s + x["n"]), F.lit(0))
        for k in KINDS}
    return staged.select(
        *[F.when(F.size(found) > 0, joined).otherwise(col(c)).alias(c) if c == text else col(c) for c in kept],
        *[F.greatest(count[k], F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS])
