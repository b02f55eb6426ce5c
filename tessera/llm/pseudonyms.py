"""Operator 6, PII by format-preserving Feistel pseudonyms (DataFrame functions only).

Values are found by pattern, validated, and permuted inside their own format by an eight-round
Feistel network keyed with SHA-256, so equal values stay equal across documents and what is no
valid value stays as it is:

- card numbers of 13 to 19 digits (Luhn): the payload is permuted and the check digit set anew;
  separators stay where they are and do not matter to the pseudonym. Digit groups beside a card
  are no part of it: from each group on, the longest run of whole groups that is valid counts,
- dates from 1900 to 2100 (yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy, dd/mm/yyyy): permuted among the
  73,414 days of that span, written the same way,
- telephone numbers in international form of 7 to 15 digits, spaced, bracketed or in one piece: the digits behind the country code, which is
  told from the digits, so that all spellings of a number get one pseudonym; a trunk zero as (0) is no part of it,
- social security numbers (ddd-dd-dddd, no 000, 666, 9dd, 00 or 0000 groups): permuted among the valid ones,
- IPv4 addresses: permuted among the addresses whose four numbers have as many digits, and leading
  zeros where these have them,
- e-mail addresses: letters and digits of the local part permuted within their kinds. The domain
  stays as it is, in clear.

Telephone numbers without a country code, IBANs, IPv6 addresses, names and places are not looked for and stay in clear.

A Feistel network can be run backwards by whoever has the key, so there is no default key: keep it
apart from the data. All of it is one projection: no shuffle, no Python. Texts without digits and @ are only scanned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Days from 1900-01-01 to 2100-12-31 are 517 * 142.
DAYS_A, DAYS_B, FIRST_DAY = 517, 142, "1900-01-01"

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IPV4 = r"(?<![0-9])(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9]|[./-][0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])"
#: The first digit group of a card candidate; group 1 is the longest candidate from there.
CARD_HEAD = r"(?<![0-9A-Za-z])(?=([0-9](?:[ -]?[0-9]){12,18})(?![0-9A-Za-z]))[0-9]+"
PHONE_DIGITS = (7, 15)
ANY = "|".join((EMAIL, IPV4, DATE, SSN, PHONE, CARD_HEAD))


def _whole(p: str) -> str:
    return f"^(?:{p})$"


def _number(seed: Column, modulus: Column) -> Column:
    """A number below modulus from a string, by 15 hex digits of its SHA-256."""
    return F.pmod(F.conv(F.substring(F.sha2(seed, 256), 1, 15), 16, 10).cast("long"), modulus.cast("long"))


def _shift(part: Column, seed: Column) -> Column:
    """part with its lower-case letters, capitals and digits each moved within their kind by a key stream drawn from seed."""
    stream = F.sha2(seed, 256)
    chars = F.split(part, "")

    def one(c: Column, i: Column) -> Column:
        k = F.conv(F.substring(stream, F.pmod(i * 2, F.lit(60)) + 1, F.lit(3)), 16, 10).cast("int")
        move = lambda base, n: F.char(F.lit(base) + F.pmod(F.ascii(c) - base + k, F.lit(n)))
        return F.when(c.between("0", "9"), move(48, 10)).when(c.between("a", "z"), move(97, 26)).when(c.between("A", "Z"), move(65, 26)).otherwise(c)

    return F.array_join(F.transform(F.filter(chars, lambda c: c != ""), one), "")


def feistel_text(value: Column, kind: str, key: str) -> Column:
    """A keyed permutation of the ASCII strings that have value's pattern of letters, capitals and digits."""
    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), half).alias("l"), F.substring(value, half + 1, F.length(value)).alias("r"))

    def turn(a: Column, i: Column) -> Column:
        tweak = lambda other: F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), other)
        left = F.when(i % 2 == 0, _shift(a["l"], tweak(a["r"]))).otherwise(a["l"])
        return F.struct(left.alias("l"), F.when(i % 2 == 1, _shift(a["r"], tweak(a["l"]))).otherwise(a["r"]).alias("r"))

    out = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)
    return F.concat(out["l"], out["r"])


def feistel_pair(left: Column, right: Column, a: int | Column, b: int | Column, kind: str, key: str) -> Column:
    """A keyed permutation of pairs below (a, b), as a struct of l and r."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))

    def turn(x: Column, i: Column) -> Column:
        tweak = lambda other: F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), other.cast("string"))
        l2 = F.when(i % 2 == 0, F.pmod(x["l"] + _number(tweak(x["r"]), a), a.cast("long"))).otherwise(x["l"])
        return F.struct(l2.alias("l"), F.when(i % 2 == 1, F.pmod(x["r"] + _number(tweak(x["l"]), b), b.cast("long"))).otherwise(x["r"]).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn's sum of a string of digits whose last one is the check digit's place."""
    doubled = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    one = lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int"))
    return F.aggregate(F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), one), F.lit(0), lambda a, b: a + b)


def _refill(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced by `digits`, in order."""
    chars = F.filter(F.split(shape, ""), lambda c: c != "")
    put = lambda a, c: F.when(c.between("0", "9"), F.struct(F.concat(a["s"], F.substring(digits, a["n"] + 1, F.lit(1))).alias("s"), (a["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["n"].alias("n")))
    return F.aggregate(chars, F.struct(F.lit("").alias("s"), F.lit(0).alias("n")), put)["s"]


def _card(v: Column, key: str) -> Column:
    payload = feistel_text(F.substring(_digits(v), F.lit(1), F.length(_digits(v)) - 1), "card", key)
    check = F.pmod(10 - F.pmod(_luhn_sum(F.concat(payload, F.lit("0"))), F.lit(10)), F.lit(10))
    return _refill(v, F.concat(payload, check.cast("string")))


def _day(v: Column) -> Column:
    """The date, null if it isn't one."""
    year_first = F.substring(v, 5, 1).isin("-", "/")
    y, m, d = F.when(year_first, F.substring(v, 1, 4)).otherwise(F.substring(v, 7, 4)), F.when(year_first, F.substring(v, 6, 2)).otherwise(F.substring(v, 4, 2)), F.when(year_first, F.substring(v, 9, 2)).otherwise(F.substring(v, 1, 2))
    return F.concat_ws("-", y, m, d).try_cast("date")


def _date(v: Column, key: str) -> Column:
    n = F.datediff(_day(v), F.lit(FIRST_DAY).cast("date"))
    p = feistel_pair(F.floor(n / DAYS_B), F.pmod(n, F.lit(DAYS_B)), DAYS_A, DAYS_B, "date", key)
    out = F.date_add(F.lit(FIRST_DAY).cast("date"), (p["l"] * DAYS_B + p["r"]).cast("int"))
    return F.when(F.substring(v, 5, 1) == "-", F.date_format(out, "yyyy-MM-dd")).when(F.substring(v, 5, 1) == "/", F.date_format(out, "yyyy/MM/dd")).when(F.substring(v, 3, 1) == ".", F.date_format(out, "dd.MM.yyyy")).otherwise(F.date_format(out, "dd/MM/yyyy"))


def _ip(v: Column, key: str) -> Column:
    """Each number stays in its class: as many digits, with or without a leading zero."""
    texts = [F.split(v, r"\.")[i] for i in range(4)]
    zero = [F.startswith(t, F.lit("0")) & (F.length(t) > 1) for t in texts]
    # the least number of a class and how many it has: 0-9, 10-99, 100-255; 00-09, 000-099
    least = [F.when(z | (F.length(t) == 1), 0).when(F.length(t) == 2, 10).otherwise(100).cast("long") for t, z in zip(texts, zero)]
    many = [F.when(F.length(t) == 1, 10).when(F.length(t) == 2, F.when(z, 10).otherwise(90)).otherwise(F.when(z, 100).otherwise(156)).cast("long") for t, z in zip(texts, zero)]
    n = [t.cast("long") - low for t, low in zip(texts, least)]
    p = feistel_pair(n[0] * many[1] + n[1], n[2] * many[3] + n[3], many[0] * many[1], many[2] * many[3], "ip", key)
    new = [F.floor(p["l"] / many[1]), F.pmod(p["l"], many[1]), F.floor(p["r"] / many[3]), F.pmod(p["r"], many[3])]
    return F.concat_ws(".", *[F.lpad((x + low).cast("string"), F.length(t), F.lit("0")) for x, low, t in zip(new, least, texts)])


def _email(v: Column, key: str) -> Column:
    return F.concat(feistel_text(F.substring_index(v, "@", 1), "email", key), F.lit("@"), F.substring_index(v, "@", -1))


def _card_in(c: Column) -> Column:
    """The longest valid card that c, a candidate, starts with and that ends where one of its digit groups does; null if there is none."""
    ends = F.filter(F.sequence(F.length(c), F.lit(13), F.lit(-1)), lambda e: F.substring(c, e + 1, F.lit(1)).isin("", " ", "-"))
    runs = F.transform(ends, lambda e: F.substring(c, F.lit(1), e))
    return F.get(F.filter(runs, lambda r: (F.length(_digits(r)) >= 13) & r.rlike("[0-9]$") & (F.pmod(_luhn_sum(_digits(r)), F.lit(10)) == 0)), F.lit(0))


#: The country codes of one and of two digits; all others have three.
COUNTRY_1 = ("1", "7")
COUNTRY_2 = ("20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")
#: Area numbers run from 1 to 899 without 666, group numbers from 1 to 99, serial numbers from 1 to 9999.
AREAS, GROUPS, SERIALS, NO_AREA = 898, 99, 9999, 666


def _phone(v: Column, key: str) -> Column:
    shape = F.replace(v, F.lit("(0)"), F.lit("(_)"))
    digits = _digits(shape)
    code = F.when(F.substring(digits, 1, 1).isin(*COUNTRY_1), 1).when(F.substring(digits, 1, 2).isin(*COUNTRY_2), 2).otherwise(3)
    national = feistel_text(F.substring(digits, code + 1, F.length(digits)), "phone", key)
    return F.replace(_refill(shape, F.concat(F.substring(digits, F.lit(1), code), national)), F.lit("(_)"), F.lit("(0)"))


def _ssn(v: Column, key: str) -> Column:
    area, group, serial = (F.split(v, "-")[i].cast("long") for i in range(3))
    place = F.when(area < NO_AREA, area - 1).otherwise(area - 2)
    p = feistel_pair(place * GROUPS + group - 1, serial - 1, AREAS * GROUPS, SERIALS, "ssn", key)
    place = F.floor(p["l"] / GROUPS)
    area = F.when(place < NO_AREA - 1, place + 1).otherwise(place + 2)
    return F.format_string("%03d-%02d-%04d", area, F.pmod(p["l"], F.lit(GROUPS)) + 1, p["r"] + 1)


def kind_of(v: Column) -> Column:
    """email, ip, date, ssn, phone, or null for a match that isn't valid. Cards are told by _card_in."""
    octets = F.forall(F.split(v, r"\."), lambda o: o.cast("int") <= 255)
    day = _day(v)
    return (
        F.when(v.rlike(_whole(EMAIL)), F.lit("email"))
        .when(v.rlike(_whole(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")), F.when(octets, F.lit("ip")))
        .when(v.rlike(r"^(?:[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})$"), F.when(day.between(F.lit(FIRST_DAY).cast("date"), F.lit("2100-12-31").cast("date")), F.lit("date")))
        .when(v.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(~v.rlike(r"^(?:000|666|9)|-00-|-0000$"), F.lit("ssn")))
        .when(v.startswith("+"), F.when(F.length(_digits(F.replace(v, F.lit("(0)"), F.lit("")))).between(*PHONE_DIGITS), F.lit("phone")))
    )


def pseudonym(v: Column, kind: Column, key: str) -> Column:
    return (
        F.when(kind == "email", _email(v, key)).when(kind == "ip", _ip(v, key)).when(kind == "date", _date(v, key)).when(kind == "ssn", _ssn(v, key))
        .when(kind == "phone", _phone(v, key)).when(kind == "card", _card(v, key)).otherwise(v)
    )


KINDS = ("email", "ip", "date", "ssn", "phone", "card")


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with text replaced, plus n_email, n_ip, n_date, n_ssn, n_phone and n_card (values replaced).

    Null texts stay null with counts of 0; texts without values stay as they are. Repeated rows
    get equal results, an empty table none. Columns of docs named like a count are replaced.
    """
    keep = [c for c in docs.columns if c not in {f"n_{k}" for k in KINDS}]
    text = F.col(text_col)
    # a cheap scan: every pattern of ANY needs a digit or an @
    none = F.array().cast("array<string>")
    found = lambda group: F.coalesce(F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(group))), none)
    out = docs.select(*keep, found(0).alias("_found"), found(1).alias("_runs"))
    # m is what the pattern took, v the value, which for a card goes on behind its first group
    out = out.withColumn("_cards", F.transform("_runs", lambda c: F.when(c != "", _card_in(c))))
    value = lambda m, c: F.struct(m.alias("m"), F.coalesce(c, m).alias("v"), F.when(c.isNotNull(), F.lit("card")).otherwise(kind_of(m)).alias("k"))
    out = out.withColumn("_pairs", F.zip_with("_found", "_cards", value))
    out = out.withColumn("_new", F.transform("_pairs", lambda p: F.struct(p["m"].alias("m"), F.length(p["v"]).alias("n"), p["k"].alias("k"), pseudonym(p["v"], p["k"], key).alias("new"))))
    steps = F.zip_with(F.split(text, ANY, -1), F.col("_new"), lambda gap, t: F.struct(gap.alias("gap"), t.alias("t")))

    def step(a: Column, x: Column) -> Column:
        """The part of a gap and a match that no earlier card covers (skip characters of it), and how far a card reaches on."""
        gap, m = F.length(x["gap"]), F.coalesce(F.length(x["t"]["m"]), F.lit(0))
        inside = a["skip"] > gap
        rest = F.when(inside, F.substring(x["t"]["m"], a["skip"] - gap + 1, m)).otherwise(F.concat(F.substring(x["gap"], a["skip"] + 1, gap), F.coalesce(x["t"]["new"], F.lit(""))))
        part = F.struct(F.coalesce(rest, F.lit("")).alias("s"), F.when(~inside, x["t"]["k"]).alias("k"))
        skip = F.when(inside, F.greatest(a["skip"] - gap - m, F.lit(0))).otherwise(F.coalesce(x["t"]["n"] - m, F.lit(0)))
        return F.struct(F.array_append(a["parts"], part).alias("parts"), skip.alias("skip"))

    start = F.struct(F.array().cast("array<struct<s:string,k:string>>").alias("parts"), F.lit(0).alias("skip"))
    out = out.withColumn("_parts", F.when(F.size("_found") > 0, F.aggregate(steps, start, step)["parts"]))
    whole = F.transform("_parts", lambda p: p["s"])
    is_a = lambda k: lambda p: p["k"] == k
    counts = [F.coalesce(F.size(F.filter("_parts", is_a(k))), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select(*[F.when(F.size("_found") > 0, F.array_join(whole, "")).otherwise(text).alias(text_col) if c == text_col else F.col(c) for c in keep], *counts)
