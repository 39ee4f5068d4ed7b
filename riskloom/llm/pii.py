"""Format-preserving pseudonyms for personal values in text, in DataFrame functions alone.

Found values are validated and then permuted with a key inside their own format, by a Feistel network of eight
rounds over two halves with additions modulo the halves' sizes. It is a bijection, so equal values get equal
pseudonyms in all documents and different ones stay different; who has the key can turn it round.

=======  ==========================================================================  ==============================
kind     valid                                                                       what is permuted
=======  ==========================================================================  ==============================
email    a name, @ and a domain with a top level                                     the name's letters and digits
date     a day of the calendar from 1900-01-01 to 2099-08-04, also before a time     the day, in the same notation
iban     country, check digits and account that are 1 modulo 97                      the account's letters and digits;
                                                                                     the check digits are made right again
ip       four numbers up to 255                                                      the address
ipv6     up to eight groups of hexadecimal digits, one gap                           all digits
card     13 to 19 digits with a right check digit                                    all digits but the check digit,
                                                                                     which is made right again
ssn      three groups; first not 000, 666 or 9xx, others not all zero                all digits
phone    + and 8 to 15 digits, or ten digits in groups                               digits after the country code
=======  ==========================================================================  ==============================

Punctuation and capitals stay where they are; names that differ only in capitals stay linked. Dates are yyyy-mm-dd,
yyyy/mm/dd, dd/mm/yyyy, dd.mm.yyyy, and mm/dd/yyyy where the second number is a day above 12, the last three also
without leading zeros. A day is linked in all notations, but for those that not every day can be told in (mm/dd, or no
leading zeros): there the permutation is repeated until the notation fits, which keeps it a bijection. What is not valid
is left alone. Nulls: a null text stays null and has no values. Texts of any length are searched whole. Rows are handled
one by one, so repeated rows and ids don't matter; an empty table gives no rows. All columns are kept; n_values is
replaced if there is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.columns import carried, let, restored

ROUNDS = 8
NAME, DOMAIN = r"[A-Za-z0-9._%+-]+", r"(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
PATTERNS = {
    "email": rf"(?<![\w.%+-]){NAME}@{DOMAIN}",
    "date": r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4}|[1-9]\d?/[1-9]\d?/\d{4}|[1-9]\d?\.[1-9]\d?\.\d{4})(?:(?=[Tt]\d\d:?\d\d)|(?![\w/-]))(?!\.\d)",
    "iban": r"(?<![\w-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w-])",
    "ipv6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*::)(?:[0-9A-Fa-f]{1,4}:){0,6}(?::[0-9A-Fa-f]{1,4}){1,7}|(?:[0-9A-Fa-f]{1,4}:){1,6}:)(?![\w:])",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w)(?!\.\d)",
    "card": r"(?<![\w-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{5})(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?:(?<!\w)\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|(?<!\w)\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}|(?<![\w.-])\d{3}([.-])\d{3}[.-]\d{4})(?!\w)",
}
ANY = "|".join(PATTERNS.values()).replace("([.-])", "[.-]")
#: Days from the first: a square, so that the halves are alike.
FIRST_DAY, DAY_HALF = "1900-01-01", 270
#: Steps in search of a day that fits a notation; more than half of all days fit each, so that more are never needed.
WALK = 90


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with valid values replaced, and n_values, how many there were."""
    rows = carried(docs).withColumn("body", F.col(f"row.`{text}`").cast("string"))
    found = F.regexp_extract_all("body", F.lit(f"({ANY})"), 1)
    rows = rows.withColumn("found", F.transform(found, lambda m: F.struct(m.alias("m"), pseudonym(m, key).alias("p"))))
    gaps = F.split("body", ANY, -1)
    joined = F.array_join(F.zip_with(gaps, F.col("found"), lambda g, f: F.concat(g, F.coalesce(f["p"], f["m"], F.lit("")))), "")
    changed = F.size(F.filter("found", lambda f: f["p"].isNotNull()))
    rows = rows.withColumn("n_values", F.coalesce(changed, F.lit(0)).cast("long"))
    new = {text: F.when(F.col("n_values") > 0, joined).otherwise(F.col("body")), "n_values": F.col("n_values")}
    return restored(rows, [*[c for c in docs.columns if c != "n_values"], "n_values"], **new)


def pseudonym(value: Column, key: str, back: bool = False) -> Column:
    """Of one value, or null where it is not valid; ``back`` turns a pseudonym round."""
    is_ = {kind: value.rlike(f"^(?:{pattern})$") for kind, pattern in PATTERNS.items()}
    digits = F.regexp_replace(value, r"\D", "")
    return F.coalesce(
        F.when(is_["email"], _email(value, key, back)),
        F.when(is_["date"], _date(value, key, back)),
        F.when(is_["iban"], _iban(value, key, back)),
        F.when(is_["ipv6"], _ipv6(value, key, back)),
        F.when(is_["ip"], _ip(value, key, back)),
        F.when(is_["card"], let(digits, lambda d: F.when((F.length(d) >= 13) & (_luhn(d) == 0), _refill(value, _card(d, key, back))))),
        F.when(is_["ssn"] & ~value.rlike("^(?:000|666|9)|-00-|-0000$"), _refill(value, _digits(digits, key, "ssn", back))),
        F.when(is_["phone"] & F.length(digits).between(8, 15), _phone(value, key, back)),
    )


def feistel(left: Column, right: Column, sizes: tuple[Column, Column], tweak: Column, key: str, back: bool) -> Column:
    """(left, right) permuted within their sizes; in each round one half is moved by a keyed hash of the other."""
    tweak = F.concat_ws("|", F.lit(key), tweak)

    def move(half: Column, other: Column, turn: Column, size: Column) -> Column:
        hashed = F.conv(F.substring(F.sha2(F.concat_ws("|", tweak, turn.cast("string"), other.cast("string")), 256), 1, 15), 16, 10).cast("long")
        return F.pmod(half - F.pmod(hashed, size), size) if back else F.pmod(half + F.pmod(hashed, size), size)

    def turn(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, move(s["left"], s["right"], i, sizes[0])).otherwise(s["left"]).alias("left"),
            F.when(odd, s["right"]).otherwise(move(s["right"], s["left"], i, sizes[1])).alias("right"),
        )

    turns = F.array(*[F.lit(i) for i in (range(ROUNDS, 0, -1) if back else range(1, ROUNDS + 1))])
    return F.aggregate(turns, F.struct(left.cast("long").alias("left"), right.cast("long").alias("right")), turn)


def _digits(digits: Column, key: str, kind: str, back: bool) -> Column:
    """A string of up to 36 digits, permuted."""

    def permuted(d: Column) -> Column:
        n = F.length(d)
        u = F.floor(n / 2).cast("int")
        size = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
        left = F.when(u == 0, F.lit(0)).otherwise(F.substring(d, F.lit(1), u).cast("long"))
        halves = feistel(left, F.substring(d, u + 1, n - u).cast("long"), (size(u), size(n - u)), F.concat_ws("|", F.lit(kind), n.cast("string")), key, back)
        return let(halves, lambda h: F.concat(F.when(u == 0, F.lit("")).otherwise(F.lpad(h["left"].cast("string"), u, "0")), F.lpad(h["right"].cast("string"), n - u, "0")))

    return let(digits, lambda d: F.when(F.length(d) == 0, d).otherwise(permuted(d)))


def _letters(letters: Column, key: str, tweak: Column, back: bool, alphabet: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """Letters of an alphabet, permuted in pieces of up to 24, as numbers of its base."""
    radix = len(alphabet)
    base = "0123456789abcdefghijklmnop"[:radix]

    def piece(x: Column, at: Column) -> Column:
        n = F.length(x)
        u = F.floor(n / 2).cast("int")
        size = lambda k: F.pow(F.lit(float(radix)), k).cast("decimal(20,0)").cast("long")
        number = lambda s: F.coalesce(F.conv(F.translate(s, alphabet, base), radix, 10).cast("long"), F.lit(0))
        text = lambda v, k: F.when(k == 0, F.lit("")).otherwise(F.translate(F.lpad(F.lower(F.conv(v.cast("string"), 10, radix)), k, "0"), base, alphabet))
        left = F.when(u == 0, F.lit(0)).otherwise(number(F.substring(x, F.lit(1), u)))
        halves = feistel(left, number(F.substring(x, u + 1, n - u)), (size(u), size(n - u)), F.concat_ws("|", F.lit("letters"), tweak, at.cast("string"), n.cast("string")), key, back)
        return let(halves, lambda h: F.concat(text(h["left"], u), text(h["right"], n - u)))

    pieces = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / 24).cast("int")), lambda k: let(F.substring(s, k * 24 + 1, F.lit(24)), lambda x: piece(x, k)))
    return let(letters, lambda s: F.when(F.length(s) == 0, s).otherwise(F.array_join(pieces(s), "")))


def _refill(value: Column, characters: Column, kind: str = r"\d") -> Column:
    """``value`` with its characters of a kind replaced one after the other."""
    places = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, i, F.lit(1)))
    zipped = lambda c: F.array_join(F.zip_with(F.split(value, kind, -1), places(c), lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), "")
    return let(characters, lambda c: F.when(F.length(c) == 0, value).otherwise(zipped(c)))


def _email(value: Column, key: str, back: bool) -> Column:
    written, domain = F.substring_index(value, "@", 1), F.lower(F.substring_index(value, "@", -1))
    letters = lambda n: F.regexp_replace(n, "[^a-z]", "")
    digits = lambda n: F.regexp_replace(n, "[^0-9]", "")
    # Letters first, by the domain; then digits, so that a name without letters is permuted too.
    parts = lambda n: F.struct(_letters(letters(n), key, domain, back).alias("l"), _digits(digits(n), key, "email", back).alias("d"))
    new = let(F.lower(written), lambda n: let(parts(n), lambda p: _refill(_refill(n, p["l"], "[a-z]"), p["d"], "[0-9]")))
    return F.concat(_capitals(new, written), F.lit("@"), F.substring_index(value, "@", -1))


def _capitals(new: Column, old: Column) -> Column:
    """``new`` with capitals where ``old``, of the same length, has them."""
    letter = lambda c, i: F.substring(c, i, F.lit(1))
    places = F.sequence(F.lit(1), F.length(old))
    return F.when(old == F.lower(old), new).otherwise(
        let(new, lambda n: F.array_join(F.transform(places, lambda i: F.when(letter(old, i).rlike("[A-Z]"), F.upper(letter(n, i))).otherwise(letter(n, i))), ""))
    )


def _date(value: Column, key: str, back: bool) -> Column:
    mark = F.when(value.contains("-"), "-").when(value.contains("/"), "/").otherwise(".")
    parts = F.split(F.translate(value, "/.", "--"), "-")
    year_first, bare = F.length(F.get(parts, 0)) == 4, F.length(value) < 10
    number_at = lambda k: F.get(parts, k).cast("int")
    american = ~year_first & (mark == "/") & (number_at(1) > 12)
    month = F.when(american, number_at(0)).otherwise(number_at(1))
    year, first = (F.when(year_first, number_at(k)).otherwise(number_at(2 - k)) for k in (0, 2))
    of_month = F.when(american, number_at(1)).otherwise(first)
    day = F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, of_month), "yyyy-MM-dd")
    size, start = F.lit(DAY_HALF), F.lit(FIRST_DAY).cast("date")
    calendar = lambda n: F.date_add(start, n.cast("int"))

    def fits(n: Column) -> Column:
        """Whether the day can be told in the notation: mm/dd needs a day above 12, no leading zeros something under 10."""
        d, m = F.dayofmonth(calendar(n)), F.month(calendar(n))
        return (~american | (d > 12)) & (~bare | (m < 10) | (~american & (d < 10)))

    def move(n: Column) -> Column:
        halves = feistel(F.floor(n / DAY_HALF), n % DAY_HALF, (size, size), F.lit("date"), key, back)
        return let(halves, lambda h: h["left"] * DAY_HALF + h["right"])

    def moved(n: Column) -> Column:
        more = lambda x, _: F.when(fits(x), x).otherwise(move(x))
        return F.when(~american & ~bare, move(n)).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), move(n), more))

    def written(n: Column) -> Column:
        form = lambda p: F.date_format(calendar(n), p)
        two = lambda x, y: F.when(bare, F.concat(form(x), mark, form(y))).otherwise(F.concat(form(x * 2), mark, form(y * 2)))
        rest = F.when(american, two("M", "d")).otherwise(two("d", "M"))
        return F.when(year_first, F.concat(form("yyyy"), mark, form("MM"), mark, form("dd"))).otherwise(F.concat(rest, mark, form("yyyy")))

    return let(F.datediff(day, start).cast("long"), lambda n: F.when(n.between(0, DAY_HALF**2 - 1), let(moved(n), written)))


def _iban(value: Column, key: str, back: bool) -> Column:
    """The account is permuted by its kinds of characters; the check digits follow from it and the country."""
    plain = F.regexp_replace(value, " ", "")

    def rest(text: Column) -> Column:
        """A number of digits and letters (as two digits each) modulo 97."""

        def step(r: Column, i: Column) -> Column:
            c = F.substring(text, i, F.lit(1))
            return F.when(c.rlike("[0-9]"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)

        return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), step)

    check = lambda account, country: F.lpad((98 - let(F.concat(account, country, F.lit("00")), rest)).cast("string"), 2, "0")

    def moved(v: Column) -> Column:
        country, account = F.substring(v, 1, 2), F.substring(v, F.lit(5), F.length(v) - 4)
        letters = F.lower(F.regexp_replace(account, "[0-9]", ""))
        digits = F.regexp_replace(account, "[A-Z]", "")
        shape = F.concat_ws("|", F.lit("iban"), country, F.regexp_replace(F.regexp_replace(account, "[A-Z]", "A"), "[0-9]", "0"))
        new = let(
            F.struct(F.upper(_letters(letters, key, shape, back)).alias("l"), _digits(digits, key, "iban", back).alias("d")),
            lambda p: _refill(_refill(F.regexp_replace(F.regexp_replace(account, "[A-Z]", "a"), "[0-9]", "#"), p["l"], "a"), p["d"], "#"),
        )
        told = let(new, lambda n: F.concat(country, check(n, country), n))
        right = F.substring(v, 3, 2) == check(account, country)
        return F.when(right & F.length(v).between(15, 34), let(told, lambda t: _refill(value, t, "[A-Z0-9]")))

    return let(plain, moved)


def _ipv6(value: Column, key: str, back: bool) -> Column:
    """All digits, in the same groups. Groups and gap must make up eight."""
    groups = F.size(F.filter(F.split(value, ":"), lambda g: g != ""))
    shape = F.concat_ws("|", F.lit("ipv6"), F.regexp_replace(F.lower(value), "[0-9a-f]", "0"))
    digits = F.lower(F.regexp_replace(value, ":", ""))
    gaps = F.size(F.split(value, "::")) - 1
    valid = F.when(gaps == 0, groups == 8).otherwise((gaps == 1) & groups.between(1, 7))
    new = _refill(F.lower(value), _letters(digits, key, shape, back, "0123456789abcdef"), "[0-9a-f]")
    return F.when(valid, F.when(value == F.lower(value), new).otherwise(F.when(value == F.upper(value), F.upper(new))))


def _ip(value: Column, key: str, back: bool) -> Column:
    octet = lambda k: F.get(F.split(value, r"\."), k).cast("int")
    valid = (octet(0) < 256) & (octet(1) < 256) & (octet(2) < 256) & (octet(3) < 256)
    size = F.lit(65536)
    halves = feistel(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), (size, size), F.lit("ip"), key, back)
    text = lambda h: F.concat_ws(".", *[x.cast("string") for half in (h["left"], h["right"]) for x in (F.floor(half / 256), half % 256)])
    return F.when(valid, let(halves, text))


def _luhn(digits: Column) -> Column:
    """The check sum modulo ten; 0 if the last digit is right."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10


def _card(digits: Column, key: str, back: bool) -> Column:
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    check = lambda b: F.pmod(10 - _luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")
    return let(_digits(body, key, "card", back), lambda b: F.concat(b, check(b)))


def _phone(value: Column, key: str, back: bool) -> Column:
    code = F.regexp_extract(value, r"^(\+1(?=[ .(-]|\d{10}$)|\+\d{1,3}(?=[ .(-])|\+\d)", 1)
    rest = F.substring(value, F.length(code) + 1, F.length(value))
    return F.concat(code, _refill(rest, _digits(F.regexp_replace(rest, r"\D", ""), key, "phone", back)))
