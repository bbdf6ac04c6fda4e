"""Operator 7: format-preserving pseudonyms for personal data, in DataFrame functions alone."""

from __future__ import annotations

import functools
import secrets
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from steelyard.llm.common import table

ROUNDS = 8
#: The setting that holds the secret key of the queries, and the key of demonstrations where it is unset.
KEY_SETTING, DEMO_KEY = "spark.steelyard.pseudonym.key", "steelyard-demo-key"

#: Countries by the length of their IBANs, which says where one in groups of four ends.
IBANS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_GROUPED = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" [A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBANS.items())

#: The shape of each kind, in the order in which they are tried. The labels of a domain are never given back, since
#: Java takes a frame of the stack for each that it may give back; the look behind a label says where giving back would have ended.
SHAPES = {
    "email": r"(?<![._%+\-])[\p{L}\p{N}][\p{L}\p{N}._%+\-]*+@[\p{L}\p{N}](?:[\p{L}\p{N}\-]*+\.[\p{L}\p{N}][\p{L}\p{N}\-]*+(?![\p{L}\p{N}_]))++",
    "secret": r"[0-9a-fA-F]{32,128}",
    "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|" + _GROUPED,
    "ip": r"(?<![0-9]\.)[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?!\.[0-9])",
    "date": r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}",
    "ssn": r"(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-)",
    "card": r"[0-9]{13,19}|[0-9]{4}[ \-][0-9]{4}[ \-][0-9]{4}[ \-][0-9]{1,7}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5}",
    "phone": r"(?:\+[0-9]{1,3}[ .\-]?)?\([0-9]{3}\)[ .\-]?[0-9]{3}[ .\-][0-9]{4}|(?:\+[0-9]{1,3}[ .\-])?[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}|\+[0-9]{1,3}(?:[ \-]?[0-9]{2,4}){2,4}(?!\.[0-9])|\+[0-9]{8,15}|[0-9]{3} [0-9]{3} [0-9]{4}|0[0-9](?: [0-9]{2}){4}|0[0-9]{1,4}(?: [0-9]{2,4}){2}",
}
ANY = r"(?<![\p{L}\p{N}_])(?:" + "|".join(f"(?:{p})" for p in SHAPES.values()) + r")(?![\p{L}\p{N}_])"

#: 400 Gregorian years have 146097 = 773 * 189 days; dates are permuted among those from this day on.
FIRST_DAY, DAYS = "1800-01-01", (773, 189)
#: Of those, 88497 = 9833 * 9 are after the 12th of a month: only these can be told to be written month-first.
LATE_DAYS = (9833, 9)


def _prf(key: str, kind: str, i: Column, x: Column, below: Column) -> Column:
    """A number under ``below`` from the keyed hash of kind, round and half."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), x.cast("string"), below.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), below)


def feistel(x: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """The keyed permutation of ``0 .. a*b-1`` at ``x``: halves modulo a and b take turns to be shifted
    by the keyed hash of the other, so any product of two sizes is permuted without leaving it."""

    def turn(s: Column, i: Column) -> Column:
        left = F.when(i % 2 == 1, F.pmod(s["l"] + _prf(key, kind, i, s["r"], s["a"]), s["a"])).otherwise(s["l"])
        right = F.when(i % 2 == 0, F.pmod(s["r"] + _prf(key, kind, i, s["l"], s["b"]), s["b"])).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"), s["a"].alias("a"), s["b"].alias("b"))

    a, b = a.cast("long"), b.cast("long")
    start = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, b).alias("r"), a.alias("a"), b.alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: s["l"] * s["b"] + s["r"])


def _let(value: Column, f) -> Column:
    """f(value), with the value computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _laid(digits: Column, like: Column) -> Column:
    """The digits of one string in the layout of another with as many."""
    chars = F.split(digits, "", -1)
    return _let(chars, lambda d: F.array_join(F.transform(F.split(like, "[0-9]", -1), lambda gap, i: F.concat(gap, F.coalesce(F.get(d, i), F.lit("")))), ""))


def _permuted_digits(d: Column, key: str, kind: str) -> Column:
    """As many digits (18 at most), permuted among all strings of that length."""
    low = F.floor(F.length(d) / 2)
    ten = lambda n: F.element_at(F.array(*[F.lit(10**k) for k in range(10)]), (n + 1).cast("int"))
    # the length is part of the kind of value: it goes into the keyed hash by way of a and b
    return F.lpad(feistel(d.cast("long"), ten(F.length(d) - low), ten(low), key, kind).cast("string"), F.length(d), "0")


def _card(m: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        body = _permuted_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
        return _let(body, lambda p: F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.concat(p, c.cast("string"))), lambda x: F.call_function("luhn_check", x)), 0))

    valid = lambda d: F.call_function("luhn_check", d) & (F.length(d) <= 19) & ~d.rlike("^0+$")
    return _let(_digits(m), lambda d: F.when(valid(d), _laid(new(d), m)).otherwise(m))


def _phone(m: Column, key: str) -> Column:
    # the last ten digits are permuted (all, where there are fewer), the country code stays
    def new(d: Column) -> Column:
        n = F.least(F.length(d), F.lit(10))
        return F.concat(F.substring(d, F.lit(1), F.length(d) - n), _permuted_digits(F.substring(d, F.length(d) - n + 1, n), key, "phone"))

    return _let(_digits(m), lambda d: F.when(F.length(d).between(8, 15), _laid(new(d), m)).otherwise(m))


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    number = lambda o: F.get(o, 0) * 16777216 + F.get(o, 1) * 65536 + F.get(o, 2) * 256 + F.get(o, 3)
    dotted = lambda x: F.concat_ws(".", *[F.pmod(F.floor(x / 256**k), F.lit(256)).cast("string") for k in (3, 2, 1, 0)])
    new = lambda o: _let(feistel(number(o), F.lit(65536), F.lit(65536), key, "ip"), dotted)
    return _let(octets, lambda o: F.when(F.array_max(o) <= 255, new(o)).otherwise(m))


def _ssn(m: Column, key: str) -> Column:
    part = lambda i, n: F.substring(m, i, n).cast("long")
    area = part(1, 3)
    valid = (area >= 1) & (area <= 899) & (area != 666) & (part(5, 2) >= 1) & (part(8, 4) >= 1)
    x = ((F.when(area > 666, area - 2).otherwise(area - 1)) * 99 + part(5, 2) - 1) * 9999 + part(8, 4) - 1

    def shown(y: Column) -> Column:
        head = F.floor(y / 9999)
        a = F.floor(head / 99)
        a = F.when(a >= 665, a + 2).otherwise(a + 1)
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((head % 99 + 1).cast("string"), 2, "0"), F.lpad((y % 9999 + 1).cast("string"), 4, "0"))

    return F.when(valid, _let(feistel(x, F.lit(897 * 99), F.lit(9999), key, "ssn"), shown)).otherwise(m)


def _date(m: Column, key: str) -> Column:
    # what cannot be day-first is read month-first, and permuted among the dates that cannot be day-first,
    # so that no pseudonym stands for two dates
    first, iso, mark = F.to_date(F.lit(FIRST_DAY)), m.contains("-"), F.regexp_extract(m, "[/.]", 0)
    read = lambda *p: F.datediff(F.concat_ws("-", *p).try_cast("date"), first)
    day = lambda x: F.date_add(first, feistel(x.cast("long"), F.lit(DAYS[0]), F.lit(DAYS[1]), key, "date").cast("int"))
    start = lambda month: F.make_date((F.lit(int(FIRST_DAY[:4])) + F.floor(month / 12)).cast("int"), (month % 12 + 1).cast("int"), F.lit(1))

    def late(x: Column) -> Column:
        """The permuted date of a late day: days are numbered without the first 12 of each month."""
        d = F.date_add(first, x)
        k = x - 12 * ((F.year(d) - int(FIRST_DAY[:4])) * 12 + F.month(d))

        def back(k: Column) -> Column:
            about = F.floor(k * 4800 / (LATE_DAYS[0] * LATE_DAYS[1]))
            near = F.transform(F.sequence(F.greatest(about - 1, F.lit(0)), F.least(about + 1, F.lit(4799))), lambda i: F.struct(i.alias("i"), (k - F.datediff(start(i), first) + 12 * i).alias("left")))
            return _let(F.array_max(F.filter(near, lambda c: c["left"] >= 0)), lambda c: F.date_add(start(c["i"]), (c["left"] + 12).cast("int")))

        return _let(feistel(k.cast("long"), F.lit(LATE_DAYS[0]), F.lit(LATE_DAYS[1]), key, "late date"), back)

    def new(p: Column) -> Column:
        a, b, c = (F.get(p, i) for i in range(3))
        short = F.exists(p, lambda x: F.length(x) == 1)
        show = lambda v, like: F.when(short & ~like.startswith("0"), v.cast("string")).otherwise(F.lpad(v.cast("string"), 2, "0"))
        known = lambda x: x.between(0, DAYS[0] * DAYS[1] - 1)
        usual = lambda d: F.when(iso, F.concat_ws("-", F.year(d), show(F.month(d), b), show(F.day(d), c))).otherwise(F.concat(show(F.day(d), a), mark, show(F.month(d), b), mark, F.year(d)))
        turned = lambda d: F.concat(show(F.month(d), a), mark, show(F.day(d), b), mark, F.year(d))
        return _let(
            F.struct(F.when(iso, read(a, b, c)).otherwise(read(c, b, a)).alias("n"), F.when(~iso, read(c, a, b)).alias("t")),
            lambda x: F.when(known(x["n"]), _let(day(x["n"]), usual)).when(x["n"].isNull() & known(x["t"]), _let(late(x["t"]), turned)).otherwise(m),
        )

    return _let(F.split(m, "[-/.]"), new)


def _mod97(s: Column) -> Column:
    """The remainder by 97 of a string of digits and capitals, which count 10 to 35."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0), lambda r, c: (F.when(c.rlike("[0-9]"), r * 10).otherwise(r * 100) + value(c)) % 97)


def _iban(m: Column, key: str) -> Column:
    # digits of the account are permuted, in halves of up to 18 digits; the check digits follow
    def of(m: Column, was: Column) -> Column:
        bank = F.substring(m, F.lit(5), F.length(m) - 4)
        valid = _mod97(F.concat(bank, F.substring(m, 1, 4))) == 1

        def new(b: Column) -> Column:
            d = _digits(b)
            halves = F.concat(_permuted_digits(F.substring(d, 1, 18), key, "iban"), F.when(F.length(d) > 18, _permuted_digits(F.substring(d, 19, 18), key, "iban2")).otherwise(""))
            body = F.when(F.length(d) > 1, _laid(halves, b)).otherwise(b)
            country = F.substring(m, 1, 2)
            return _let(body, lambda y: F.concat(country, F.lpad((98 - _mod97(F.concat(y, country, F.lit("00")))).cast("string"), 2, "0"), y))

        grouped = lambda y: F.when(was.contains(" "), F.regexp_replace(y, "(.{4})(?=.)", "$1 ")).otherwise(y)
        return F.when(valid, _let(_let(bank, new), grouped)).otherwise(was)

    return _let(F.replace(m, F.lit(" "), F.lit("")), lambda x: of(x, m))


def _hashed(m: Column, key: str, kind: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), F.lower(m)), 256)


def _email(m: Column, key: str) -> Column:
    h = _hashed(m, key, "email")
    return F.concat(F.substring(h, 1, 12), F.lit("@"), F.substring(h, 13, 8), F.lit(".example"))


def _secret(m: Column, key: str) -> Column:
    return F.substring(F.repeat(_hashed(m, key, "secret"), 2), F.lit(1), F.length(m))


MAKERS = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match; a value of no valid kind stays as it is."""
    out = F.when(F.lit(False), m)
    for kind, shape in SHAPES.items():
        out = out.when(m.rlike(f"^(?:{shape})$"), MAKERS[kind](m, key))
    return out.otherwise(m)


def secret_key(spark: SparkSession) -> str:
    """The key in the session's settings; in a local session, as in tests, a demonstration key where there is none. On
    a cluster that is an error, since the demonstration key is known to everyone."""
    if key := spark.conf.get(KEY_SETTING, None):
        return key
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{KEY_SETTING} is unset: pseudonyms by the demonstration key can be undone by anyone")
    return DEMO_KEY


@functools.cache
def _drawn_key(application: str) -> str:
    return secrets.token_hex(32)


def query_key(spark: SparkSession) -> str:
    """The key of the queries: :func:`secret_key`, and on a cluster where the setting is unset one that is drawn at random
    for this application and not stored. All its queries give the same pseudonyms; those of another application differ, so
    what must be joined with them needs the setting."""
    if spark.conf.get(KEY_SETTING, None) or spark.sparkContext.master.startswith("local"):
        return secret_key(spark)
    warnings.warn(f"{KEY_SETTING} is unset: the key of the pseudonyms is drawn for this application alone", stacklevel=2)
    return _drawn_key(spark.sparkContext.applicationId)


def pseudonymize(docs: DataFrame, *, key: str, text: str = "text", count: str | None = "n_replaced") -> DataFrame:
    """Replace personal data in ``text`` by pseudonyms of the same format; add how many were replaced.

    Emails, IPv4 addresses, dates, social security numbers, payment cards (Luhn), phone numbers, IBANs
    (mod 97) and hexadecimal secrets are found by shape, and numbers and dates are validated; what fails
    stays. Dates are year-month-day with dashes, or with slashes or dots day-first, month-first where day-first
    is no date, of the years 1800 to 2199 in four digits. IBANs are in one piece, or in groups of four where
    their country's length is known. Phones without a plus have three, three and four digits, or begin with
    0 and have single spaces. Numbers and dates map by a keyed Feistel permutation within their format, so the pseudonym is
    valid too, differs for different values and is the same for equal values in any document; emails and
    secrets, which are no numbers, map by a keyed hash. Each text is cut at its matches once and joined
    again. ``key`` is the secret that the pseudonyms depend on.

    A null text stays null and an empty one empty, with 0 replaced; a very long text is one row like others;
    of shapes that match at one place the first in :data:`SHAPES` is taken; repeated rows get the same
    pseudonyms; an empty table gives no rows; an input column named as ``count`` gives way.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))
    pairs = F.transform(found, lambda m: F.struct(m.alias("was"), pseudonym(m, key).alias("now")))
    parts = F.split(F.col(text), ANY, -1)
    joined = lambda ps: F.struct(
        F.array_join(F.zip_with(parts, ps, lambda t, p: F.concat(t, F.coalesce(p["now"], F.lit("")))), "").alias("text"),
        F.size(F.filter(ps, lambda p: p["was"] != p["now"])).cast("long").alias("n"),
    )
    plain = F.struct(F.col(text).alias("text"), F.lit(0).cast("long").alias("n"))
    own = [c for c in docs.columns if count is None or c.lower() != count.lower()]
    # the row's own columns stay together, so none of them meets a name used here
    out = docs.select(F.struct(*own).alias("_row"), F.when(F.col(text).rlike(ANY), _let(pairs, joined)).otherwise(plain).alias("_out"))
    kept = [F.col("_out.text").alias(text) if c == text else F.col("_row").getField(c).alias(c) for c in own]
    return out.select(*kept, *([F.col("_out.n").alias(count)] if count else []))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), key=query_key(spark))
