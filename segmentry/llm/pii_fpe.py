"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Found: e-mail addresses, IPv4 addresses, phone numbers, payment cards (Luhn), IBANs (mod 97), US social security numbers,
calendar dates of 1800 to 2199, and credentials. Numbers and dates are validated first; what fails stays as it is. A
value is written as an array of numbers with a radix each, and a keyed Feistel network permutes exactly the product of
these radices: even and odd places take turns, and each turn adds SHA-512 of the key, the kind, the turn and the other
places. The result is written back in the value's own format, with check digits made anew, so it passes the same
validation. As the permutation depends on key and kind only, equal values have equal pseudonyms in all documents and
different ones of the same format have different ones.

    e-mail        letters and digits of the local part, each within its class; the domain stays
    IPv4          four numbers of 0-255
    phone         digits after the country code; North American area and exchange codes keep their first digit's class
    card          all but the first digit (the network) and the last (the check digit, made anew)
    IBAN          letters and digits after the check digits (made anew)
    SSN           88,902 valid area-group pairs x 9,999 serials
    date          189 x 773 days = the 400 years of the calendar's cycle; d/m/y is tried before m/d/y
    credential    what a name such as password= introduces; letters and digits, each within its class (a-f in hexadecimal ones)

Values may have any length. Edge cases: a null text stays null with 0 pseudonyms, an empty one stays empty; texts of any
length are read once; equal rows stay and change alike; of values that could be of two kinds the first kind of the table
below that validates counts (the leftmost match first); an empty table gives no rows; a column named like an output is
replaced, all others pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spare

#: For tests and the catalogue's query; it is no secret.
DEMO_KEY = "not a secret"
TURNS = 8
#: Places that are permuted together.
BLOCK = 64

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAME = r"(?i:password|passwd|pwd|secret|token|api_?key|access_?key)"
#: Kind and what it looks like, in the order in which they are tried at a place. A credential is what its name introduces,
#: quoted or up to white space; after a colon or a blank it has a digit or a sign inside, as prose may follow there too.
#: The credential's is the first group of ``ANY``, so that a match tells whether it was introduced.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]*[A-Za-z0-9])+",
    "credential": rf"((?<=\b{_NAME} ?[=:] ?[\"'])[^\s\"']{{4,}}(?=[\"'])|(?<=\b{_NAME}=)[^\s\"'<>]{{5,}}[A-Za-z0-9]|(?<=\b{_NAME} ?[=:] ?)(?=[^\s\"'<>]*(?:[0-9]|[^\w\s\"'<>][A-Za-z0-9]))[^\s\"'<>]{{5,}}[A-Za-z0-9])",
    "key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "date": r"(?<![\w./-])(?:\d{4}(?<ymd>[-/.])\d{1,2}\k<ymd>\d{1,2}|\d{1,2}(?<dmy>[-/.])\d{1,2}\k<dmy>\d{4})(?!\w|[-/]\d)",
    "phone": r"(?<!\w)\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w.-])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\w)",
    "card": r"(?<![\w.])(?:\d{13,19}|\d{4}(?<gap>[ -])\d{4}\k<gap>\d{4}\k<gap>\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w])",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: Every kind has a digit, an @ or a credential's name; texts without them are not searched.
NAMED = rf"{_NAME} ?[=:]"
HINT = r"[0-9@]|(?i:passw|pwd|secret|token|api_?key|access_?key)"



def _digits(text: Column) -> Column:
    """The digits of a text as an array of numbers."""
    return F.transform(F.split(F.regexp_replace(text, "[^0-9]", ""), ""), lambda c: c.cast("int"))


def _luhn_sum(digits: Column) -> Column:
    """Of an array whose last place is not doubled."""
    n = F.size(digits)
    doubled = F.transform(digits, lambda d, i: F.when((n - i) % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d)


def _mod97(text: Column) -> Column:
    """Of letters and digits read as a decimal number, with A = 10 to Z = 35."""
    return F.aggregate(
        F.split(text, ""), F.lit(0),
        lambda a, c: F.when(c.rlike("^[0-9]$"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )


def _date_of(v: Column) -> Column:
    """A validated date as a struct (day, kind of order), or null: y first, d/m/y, or m/d/y."""
    parts = F.split(v, "[-/.]")
    iso = lambda y, m, d: F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")
    first = iso(parts[0], parts[1], parts[2])
    return F.when(F.length(parts[0]) == 4, F.struct(first.alias("day"), F.lit("ymd").alias("order"))).when(
        iso(parts[2], parts[1], parts[0]).isNotNull(), F.struct(iso(parts[2], parts[1], parts[0]).alias("day"), F.lit("dmy").alias("order"))
    ).otherwise(F.struct(iso(parts[2], parts[0], parts[1]).alias("day"), F.lit("mdy").alias("order")))


def _kind(v: Column, introduced: Column) -> Column:
    """The kind of a value that was found, or null if its validation fails; what is introduced is a credential whatever its shape."""
    flat = F.regexp_replace(v, " ", "")
    area, group, serial = F.substring(v, 1, 3).try_cast("int"), F.substring(v, 5, 2), F.substring(v, 8, 4)
    day = _date_of(v)["day"]
    whole = lambda k: v.rlike(rf"^(?:{KINDS[k]})$")
    return (
        F.when(introduced, "credential").when(v.rlike("^[^@]+@[^@]+$"), "email")
        .when(whole("ip"), "ip")
        .when(v.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(area.between(1, 899) & (area != 666) & (group != "00") & (serial != "0000"), "ssn"))
        .when(whole("date"), F.when(F.year(day).between(1800, 2199), "date"))
        .when(whole("phone"), "phone")
        .when(v.rlike(r"^[0-9 -]+$") & whole("card"), F.when(_luhn_sum(_digits(v)) % 10 == 0, "card"))
        .when(v.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9 ]{9,}$") & (_mod97(F.concat(F.substring(flat, F.lit(5), F.length(flat)), F.substring(flat, 1, 4))) == 1), "iban")
        .when(v.rlike(r"^(?:AKIA|ASIA)[A-Z0-9]{16}$"), "key")
    )


def feistel(numbers: Column, radixes: Column, key: str, tweak: Column, back: bool = False) -> Column:
    """A keyed permutation of the product of the radixes; ``back`` inverts it. Arrays of longs of any length.

    Blocks of ``BLOCK`` places are permuted one after another; each block's tweak is a digest of the tweak and the values
    of the block before, so a change in one block changes all that follow.
    """
    start = F.struct(F.array().cast("array<bigint>").alias("done"), tweak.alias("tweak"))
    cuts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(numbers) - 1) / BLOCK).cast("int")))

    def step(state: Column, b: Column) -> Column:
        part = lambda a: F.slice(a, b * BLOCK + 1, F.lit(BLOCK))
        return F.transform(F.array(_block(part(numbers), part(radixes), key, state["tweak"], back)), lambda made: F.struct(
            F.concat(state["done"], made).alias("done"),
            F.sha2(F.concat_ws(",", state["tweak"], F.transform(made if back else part(numbers), lambda x: x.cast("string"))), 256).alias("tweak")))[0]

    return F.aggregate(cuts, start, step, lambda state: state["done"])


def _block(numbers: Column, radixes: Column, key: str, tweak: Column, back: bool) -> Column:
    """The network over one block: 64 places take 32 numbers of 32 bits in each turn, two digests."""
    turns = F.array(*[F.lit(t) for t in (range(TURNS - 1, -1, -1) if back else range(TURNS))])

    def turn(state: Column, t: Column) -> Column:
        other = F.filter(state, lambda x, i: i % 2 != t % 2)
        message = F.concat_ws("|", F.lit(key), tweak, t.cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ","))
        digest = F.concat(F.sha2(F.concat(message, F.lit("|a")), 512), F.sha2(F.concat(message, F.lit("|b")), 512))
        # bound by an outer lambda, so that the digest is made once for each turn
        return F.transform(F.array(digest), lambda d: F.transform(state, lambda x, i: F.when(
            i % 2 == t % 2,
            F.pmod(x + F.lit(-1 if back else 1) * F.conv(F.substring(d, F.floor(i / 2).cast("int") * 8 + 1, F.lit(8)), 16, 10).cast("bigint"), F.get(radixes, i)),
        ).otherwise(x)))[0]

    return F.aggregate(turns, numbers, turn)


def _kept(v: Column, kind: Column) -> tuple[Column, Column]:
    """How many characters at the begin and the end are no part of the permuted body."""
    before = F.when(kind == "card", 1).when(kind.isin("iban", "key"), 4).when(
        kind == "phone", F.when(v.startswith("+"), F.least(F.length(F.regexp_extract(v, r"^\+\d+", 0)), F.lit(4))).otherwise(0)
    ).otherwise(0)
    after = F.when(kind == "card", 1).when(kind == "email", F.length(v) - F.instr(v, "@") + 1).otherwise(0)
    return before, after


def _written(core: Column, kind: Column) -> Column:
    """Letters and digits as structs (n, radix, first code)."""
    hexadecimal = core.rlike("^[0-9a-f]+$") & (kind == "credential")
    american = (kind == "phone") & (F.length(core) == 10)

    def one(c: Column, i: Column) -> Column:
        code = F.ascii(c)
        make = lambda low, radix: F.struct((code - low).cast("bigint").alias("n"), F.lit(radix).cast("bigint").alias("radix"), F.lit(low).alias("low"))
        return (
            F.when((code <= 57) & american & i.isin(0, 3), F.when(code >= 50, make(50, 8)).otherwise(make(48, 2)))
            .when(code <= 57, make(48, 10)).when(code <= 90, make(65, 26)).when(hexadecimal, make(97, 6)).otherwise(make(97, 26))
        )

    return F.transform(F.split(core, ""), one)


def pseudonym(v: Column, kind: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of a validated value; ``back`` gives the value of a pseudonym."""
    before, after = _kept(v, kind)
    body = F.substring(v, before + 1, F.length(v) - before - after)
    core = F.regexp_replace(body, "[^A-Za-z0-9]", "")
    places = _written(core, kind)
    octets = F.transform(F.split(v, r"\."), lambda o: F.struct(o.cast("bigint").alias("n"), F.lit(256).cast("bigint").alias("radix"), F.lit(0).alias("low")))
    area = F.substring(v, 1, 3).try_cast("bigint")
    pair = lambda a, ra, b, rb: F.array(*[F.struct(n.cast("bigint").alias("n"), F.lit(r).cast("bigint").alias("radix"), F.lit(0).alias("low")) for n, r in ((a, ra), (b, rb))])
    ssn = pair((area - 1 - (area > 666).cast("int")) * 99 + F.substring(v, 5, 2).try_cast("bigint") - 1, 88902, F.substring(v, 8, 4).try_cast("bigint") - 1, 9999)
    date = _date_of(v)
    days = F.date_diff(date["day"], F.lit("1800-01-01").cast("date"))
    dates = pair(F.floor(days / 773), 189, days % 773, 773)
    numbers = F.when(kind == "ip", octets).when(kind == "ssn", ssn).when(kind == "date", dates).otherwise(places)
    # each step is bound once by a lambda over an array of one
    bind = lambda value, then: F.transform(F.array(value), then)[0]

    def put(p: Column) -> Column:
        made = feistel(F.transform(p, lambda x: x["n"]), F.transform(p, lambda x: x["radix"]), key, kind, back)
        return bind(made, lambda n: render(p, n))

    def render(p: Column, n: Column) -> Column:
        pad = lambda x, w: F.lpad(x.cast("string"), w, "0")
        ip = F.array_join(F.transform(n, lambda x: x.cast("string")), ".")
        index = F.floor(n[0] / 99)
        ssn_text = F.concat(pad(index + 1 + (index >= 665).cast("int"), 3), F.lit("-"), pad(n[0] % 99 + 1, 2), F.lit("-"), pad(n[1] + 1, 4))
        day = F.date_add(F.lit("1800-01-01").cast("date"), (n[0] * 773 + n[1]).cast("int"))
        sep = F.regexp_extract(v, r"([-/.])", 1)
        width = F.when(F.length(v) == 10, 2).otherwise(1)
        y, m, d = F.year(day).cast("string"), F.month(day).cast("string"), F.day(day).cast("string")
        m, d = (F.when(F.length(x) < width, F.lpad(x, 2, "0")).otherwise(x) for x in (m, d))
        date_text = F.when(date["order"] == "ymd", F.concat(y, sep, m, sep, d)).when(date["order"] == "dmy", F.concat(d, sep, m, sep, y)).otherwise(F.concat(m, sep, d, sep, y))
        chars = F.transform(n, lambda x, i: F.chr(x + F.get(p, i)["low"]))
        signs = F.split(body, "[A-Za-z0-9]", -1)
        shown = F.array_join(F.flatten(F.transform(signs, lambda c, i: F.array(c, F.coalesce(F.get(chars, i), F.lit(""))))), "")
        head, tail = F.substring(v, F.lit(1), before), F.substring(v, F.length(v) - after + 1, after)

        def checked(b: Column) -> Column:
            plain = F.regexp_replace(b, " ", "")
            remainder = _mod97(F.concat(plain, F.substring(v, 1, 2), F.lit("00")))
            iban = F.concat(F.substring(v, 1, 2), pad(98 - remainder, 2), b)
            card = F.concat(head, b, ((10 - _luhn_sum(F.concat(_digits(F.concat(head, b)), F.array(F.lit(0)))) % 10) % 10).cast("string"))
            return F.when(kind == "iban", iban).when(kind == "card", card).otherwise(F.concat(head, b, tail))

        return F.when(kind == "ip", ip).when(kind == "ssn", ssn_text).when(kind == "date", date_text).otherwise(bind(shown, checked))

    return bind(numbers, put)


def pseudonymise(docs: DataFrame, key: str, text: str = "text", out: str = "text", count: str = "n_pseudonyms") -> DataFrame:
    """``out`` is the text with every validated value replaced, ``count`` how many were. ``key`` is to be kept secret."""
    column = F.col(text)
    seen, named, done = spare(docs, "_found", "_named", "_made")
    find = lambda group: F.when(column.rlike(HINT), F.regexp_extract_all(column, F.lit(ANY), F.lit(group)))
    # the second array is looked for only where a name can introduce something
    introduced = F.when(column.rlike(NAMED), find(1))
    searched = docs.withColumns({seen: find(0), named: introduced})
    made = searched.withColumn(done, F.transform(seen, lambda v, i: F.transform(F.array(_kind(v, F.coalesce(F.get(named, i) != "", F.lit(False)))), lambda k: F.struct(
        F.when(k.isNull(), v).otherwise(pseudonym(v, k, key)).alias("value"), k.alias("kind")))[0]))
    between = F.split(column, ANY, -1)
    joined = F.array_join(F.flatten(F.transform(between, lambda t, i: F.array(t, F.coalesce(F.get(done, i)["value"], F.lit(""))))), "")
    some = F.size(F.coalesce(seen, F.array().cast("array<string>"))) > 0
    counted = F.when(some, F.size(F.filter(done, lambda m: m["kind"].isNotNull()))).otherwise(0)
    others = [c for c in docs.columns if c not in (out, count)]
    position = {c: F.col(c) for c in others} | {out: F.when(some, joined).otherwise(column).alias(out)}
    order = [c for c in docs.columns if c != count]
    order += [c for c in (out,) if c not in order]
    return made.select(*[position[c] for c in order], counted.cast("long").alias(count))
