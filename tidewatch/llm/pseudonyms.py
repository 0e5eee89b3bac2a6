"""Format-preserving pseudonyms for personal numbers, dates and addresses, in DataFrame operations only.

One regular expression finds the candidates of a text; each is validated (Luhn sums, octets, real
dates, digit counts) and, if valid, permuted within its own format by a keyed Feistel network:
a value is two numbers l and r of known ranges, and each round adds a keyed hash of one to the other,
modulo its range. That is one to one for any ranges and can be reversed with the key, and the same
value gets the same pseudonym in every document.

* cards: the digits before the check digit are permuted, the check digit is made anew, separators stay
* phones: the digits after the country code are permuted, punctuation stays
* social security numbers: the nine digits are permuted, hyphens stay
* addresses of hosts: the 32 bits are permuted
* dates of 1900-01-01 to 2100-01-01: the day number is permuted, the notation stays
* mail addresses: all digits and letters of the local part are permuted as digits and letters,
  lengths and the domain stay

Defined cases: null text stays null and empty text empty; candidates that aren't valid are left as they are;
null and repeated ids and repeated rows give one row each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.columns import let

#: What a candidate looks like; the first form that fits at a place is taken.
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
DATE = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d/-])"
HOST = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)"
CARD = r"(?<![\d.-])(?:\d{13,19}|\d{4}(?: \d{4}){2,3}(?: \d{1,3})?|\d{4}(?:-\d{4}){2,3}(?:-\d{1,3})?)(?![\d-])"
CANDIDATE = "|".join((MAIL, DATE, HOST, SOCIAL, PHONE, CARD))

KINDS = ("mail", "date", "host", "social", "phone", "card")
ROUNDS = 10
#: 1900-01-01 and 73,050 days from it, as 150 x 487.
FIRST_DAY, DAY_PARTS = "1900-01-01", (150, 487)


def _noise(key: str, kind: str, round_: Column, value: Column, extra: Column) -> Column:
    """60 keyed bits of a number."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), round_.cast("string"), value.cast("string"), extra.cast("string"))
    return F.conv(F.left(F.sha2(text, 256), F.lit(15)), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_range: Column, right_range: Column, key: str, kind: str, extra: Column, reverse: bool = False) -> Column:
    """struct(l, r): the keyed permutation of (left, right), or its inverse."""
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if reverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    sign = -1 if reverse else 1

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        noise = _noise(key, kind, i, F.when(even, acc["r"]).otherwise(acc["l"]), extra)
        return F.struct(
            F.when(even, F.pmod(acc["l"] + sign * F.pmod(noise, left_range), left_range)).otherwise(acc["l"]).alias("l"),
            F.when(even, acc["r"]).otherwise(F.pmod(acc["r"] + sign * F.pmod(noise, right_range), right_range)).alias("r"),
        )

    return F.aggregate(rounds, F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def _permuted_digits(digits: Column, key: str, kind: str, reverse: bool) -> Column:
    """The digits (2 to 36 of them) as two halves, permuted."""
    def halves(d: Column) -> Column:
        n = F.char_length(d)
        half = (n / 2).cast("int")
        rest = n - half
        power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
        moved = feistel(F.left(d, half).cast("long"), F.right(d, rest).cast("long"), power(half), power(rest), key, kind, n, reverse)
        return let(moved, lambda m: F.concat(F.lpad(m["l"].cast("string"), half, "0"), F.lpad(m["r"].cast("string"), rest, "0")))

    return let(digits, halves)


def _refilled(text: Column, digits: Column) -> Column:
    """``text`` with its digits replaced in order."""
    begin = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def fill(d: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            digit = c.rlike("^[0-9]$")
            return F.struct(
                F.concat(acc["out"], F.when(digit, F.substring(d, acc["at"], F.lit(1))).otherwise(c)).alias("out"),
                (acc["at"] + F.when(digit, 1).otherwise(0)).alias("at"),
            )

        return F.aggregate(F.split(text, ""), begin, step, lambda acc: acc["out"])

    return let(digits, fill)


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits whose last is the check digit."""
    n = F.char_length(digits)
    each = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: let(
            F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1), lambda v: v - F.when(v > 9, 9).otherwise(0)
        ),
    )
    return F.aggregate(each, F.lit(0), lambda acc, v: acc + v)


def _card(text: Column, key: str, reverse: bool) -> Column:
    def moved(d: Column) -> Column:
        body = _permuted_digits(F.left(d, F.char_length(d) - 1), key, "card", reverse)
        return let(body, lambda b: F.concat(b, F.pmod(F.lit(10) - F.pmod(_luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")))

    return let(_digits(text), lambda d: F.when(_luhn_sum(d) % 10 == 0, _refilled(text, moved(d))))


def _phone(text: Column, key: str, reverse: bool) -> Column:
    """The country code runs to the first separator, or is one digit."""
    code = F.regexp_extract(text, r"^\+\d{1,3}(?=[ .(-])|^\+\d", 0)
    rest = F.substring(text, F.char_length(code) + 1, F.char_length(text))
    count = F.char_length(_digits(text))
    return F.when((count >= 8) & (count <= 15), F.concat(code, _refilled(rest, _permuted_digits(_digits(rest), key, "phone", reverse))))


def _social(text: Column, key: str, reverse: bool) -> Column:
    return _refilled(text, _permuted_digits(_digits(text), key, "social", reverse))


def _host(text: Column, key: str, reverse: bool) -> Column:
    octets = F.transform(F.split(text, r"\."), lambda o: o.cast("int"))

    def moved(o: Column) -> Column:
        wide = F.lit(65536).cast("long")
        pair = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], wide, wide, key, "host", F.lit(4), reverse)
        parts = lambda p: F.concat_ws(".", (p["l"] / 256).cast("int"), p["l"] % 256, (p["r"] / 256).cast("int"), p["r"] % 256)
        # leading zeros would not survive a round trip
        plain = F.concat_ws(".", o) == text
        return F.when((F.array_max(o) < 256) & plain, let(pair, parts))

    return let(octets, moved)


def _date(text: Column, key: str, reverse: bool) -> Column:
    forms = ((r"^\d{4}-", "yyyy-MM-dd"), (r"\.", "dd.MM.yyyy"), ("/", "MM/dd/yyyy"))
    total = DAY_PARTS[0] * DAY_PARTS[1]

    def moved(form: str) -> Column:
        day = F.datediff(F.try_to_timestamp(text, F.lit(form)).cast("date"), F.lit(FIRST_DAY).cast("date"))

        def permuted(d: Column) -> Column:
            a, b = (F.lit(x).cast("long") for x in DAY_PARTS)
            pair = feistel((d / DAY_PARTS[1]).cast("int"), d % DAY_PARTS[1], a, b, key, "date", F.lit(total), reverse)
            shown = lambda p: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (p["l"] * DAY_PARTS[1] + p["r"]).cast("int")), form)
            return F.when((d >= 0) & (d < total), let(pair, shown))

        return let(day, permuted)

    out = F.when(text.rlike(forms[0][0]), moved(forms[0][1]))
    for pattern, form in forms[1:]:
        out = out.when(text.rlike(pattern), moved(form))
    return out


#: Letters and digits that a mail address's local part is made of, by class; each class maps to itself.
_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _mail(text: Column, key: str, reverse: bool) -> Column:
    """Both halves of the local part shift each other's signs within their classes, by keyed hashes: a Feistel network over signs."""
    local, domain = F.substring_index(text, "@", 1), F.substring_index(text, "@", -1)

    def shifted(half: Column, other: Column, i: Column, sign: int) -> Column:
        noise = F.sha2(F.concat_ws("|", F.lit(key), F.lit("mail"), i.cast("string"), other), 256)

        def one(c: Column, at: Column) -> Column:
            bits = F.conv(F.substring(noise, F.pmod(at, F.lit(30)) * 2 + 1, F.lit(4)), 16, 10).cast("int") + at
            out = F.when(F.lit(False), c)
            for signs in _CLASSES:
                place = F.instr(F.lit(signs), c)
                out = out.when((place > 0) & (c != ""), F.substring(F.lit(signs), F.pmod(place - 1 + sign * F.pmod(bits, F.lit(len(signs))), F.lit(len(signs))) + 1, F.lit(1)))
            return out.otherwise(c)

        return F.array_join(F.transform(F.split(half, ""), one), "")

    def moved(l: Column) -> Column:
        half = F.ceil(F.char_length(l) / 2).cast("int")
        rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if reverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
        sign = -1 if reverse else 1

        def step(acc: Column, i: Column) -> Column:
            even = i % 2 == 0
            return F.struct(
                F.when(even, shifted(acc["l"], acc["r"], i, sign)).otherwise(acc["l"]).alias("l"),
                F.when(even, acc["r"]).otherwise(shifted(acc["r"], acc["l"], i, sign)).alias("r"),
            )

        begin = F.struct(F.left(l, half).alias("l"), F.substring(l, half + 1, F.char_length(l)).alias("r"))
        return F.aggregate(rounds, begin, step, lambda acc: F.concat(acc["l"], acc["r"]))

    return F.concat(let(local, moved), F.lit("@"), domain)


def _kind(text: Column) -> Column:
    whole = lambda pattern: text.rlike(f"^(?:{pattern})$")
    return (
        F.when(F.contains(text, F.lit("@")), "mail").when(text.startswith("+"), "phone").when(whole(r"\d{1,3}(?:\.\d{1,3}){3}"), "host")
        .when(whole(r"\d{3}-\d{2}-\d{4}"), "social").when(whole(DATE), "date").otherwise("card")
    )


def _moved(kind: Column, text: Column, key: str, reverse: bool) -> Column:
    makers = {"mail": _mail, "date": _date, "host": _host, "social": _social, "phone": _phone, "card": _card}
    out = F.when(F.lit(False), text)
    for name, make in makers.items():
        out = out.when(kind == name, make(text, key, reverse))
    return out


def pseudonymised(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", reverse: bool = False) -> DataFrame:
    """(doc_id, text, pii) of every document: the text with pseudonyms, and kind and pseudonym of each valid value in order.

    With ``reverse``, and the same key, pseudonyms turn back into what they stand for.
    """
    text = F.col(f"`{text_col}`").cast("string")

    def replaced(found: Column) -> Column:
        def one(m: Column) -> Column:
            return let(_kind(m), lambda k: F.struct(k.alias("kind"), m.alias("was"), _moved(k, m, key, reverse).alias("now")))

        return F.transform(found, one)

    def joined(done: Column) -> Column:
        # pieces and values take turns
        parts = F.zip_with(F.split(text, CANDIDATE, -1), done, lambda p, d: F.concat(p, F.coalesce(d["now"], d["was"], F.lit(""))))
        valid = F.transform(F.filter(done, lambda d: d["now"].isNotNull()), lambda d: F.struct(d["kind"].alias("kind"), d["now"].alias("pseudonym")))
        return F.struct(F.array_join(parts, "").alias("text"), valid.alias("pii"))

    found = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    # Texts without digits and @ are passed by.
    done = F.when(text.rlike("[0-9@]"), let(found, lambda f: let(replaced(f), joined)))
    none = F.array().cast("array<struct<kind:string,pseudonym:string>>")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("plain"), done.alias("done"))
    return rows.select("doc_id", F.coalesce("done.text", "plain").alias("text"), F.coalesce("done.pii", none).alias("pii"))
