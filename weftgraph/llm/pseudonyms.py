"""Format-preserving Feistel pseudonyms for numbers and dates in texts.

Found are card numbers (Luhn), international phone numbers, IPv4 addresses,
IBANs (mod 97), numbers of the form 123-45-6789, dates from 1900 to 2099 and
the local parts of e-mail addresses.  What fails its validation stays as it
is; of a run of digit groups that is no card as a whole, sub-runs are tried
whose groups, but the last, have three digits or more, so that tables of small
numbers stay.  Each valid value is permuted among the values of its format by a keyed
Feistel network over its two halves, so that

* equal values get equal pseudonyms, in all documents and under any
  separators, and different values get different ones,
* lengths, letter case, separators, the first digit of a card, the country of
  a phone number or IBAN, the form of a date and the domain of an address
  stay, and check digits are valid again.

The two halves of a string are mixed-radix numbers (10 for a digit, 26 for a
letter, 8 for the first digits of North American area and exchange codes);
a round adds a SHA-256 of the other half.  A date is one of the 17 * 4297 days
of the two centuries.  Where a permuted value is no valid one (a number that
starts with 000), it is permuted again until it is, which stays one to one.
All is built-in expressions on one row, no shuffle.

The key is the caller's secret: who has it can undo every pseudonym, so there
is no default.  Dates with slashes are read day first where that is a date, so
03/05/1987 links with 1987-05-03; phone numbers are cut into calling code and
rest by the published list of codes, so separators do not matter.

Null texts stay null with no findings; empty texts stay empty.  Repeated rows
come back each; a very long text takes memory in proportion to its length;
other columns, whatever their names, are not read; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
DAYS = (17, 4297)
WALKS = 64  # a value is invalid with odds of about 1 in 9, so 64 in a row do not happen

KINDS = ("email", "phone", "iban", "ip", "date", "ssn", "card")
_EMAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
#: North American numbers have ten digits after +1; what follows them is not theirs.
_PHONE = r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}"
_IBAN = r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}|[A-Z]{2}\d{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?"
#: The one- and two-digit calling codes of E.164; all others have three digits.
_CALLING = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
_IP = r"\d{1,3}(?:\.\d{1,3}){3}"
_DATE = r"\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4}"
_SSN = r"\d{3}-\d{2}-\d{4}"
_TAIL = r"(?![\p{L}\p{N}_@]|[.-]\d)"
#: A whole run of digit groups; it ends before a value of another kind and before a group that belongs to a word.
_GROUP = r"\d++(?!(?:-\d++)*+(?:[\p{L}\p{N}_@]|\.\d))"
_CARD = rf"(?=\d(?:[ -]?\d){{12}}){_GROUP}(?:[ -](?!(?:{_EMAIL}|{_IP}|{_DATE}|{_SSN}){_TAIL}){_GROUP})*+"
FORMS = dict(zip(KINDS, (_EMAIL, _PHONE, _IBAN, _IP, _DATE, _SSN, r"\d[\d -]{12,}+")))
PATTERN = r"(?<![\p{L}\p{N}_.@+-])(?:" + "|".join({**FORMS, "card": _CARD}[k] for k in KINDS) + ")" + _TAIL
#: Groups of cards as they are printed.
_PRINTED = r"^(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?:\1\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{4,5})$"


def _hash(key: str, round_: Column, half: Column, label: str) -> Column:
    text = F.concat_ws("|", F.lit(key), F.lit(label), round_.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def _feistel(left: Column, left_n: Column, right: Column, right_n: Column, key: str, label: str) -> Column:
    """struct(l, r): both halves after ROUNDS alternating additions."""

    def step(a, i):
        odd = i % 2 == 1
        l = F.when(odd, (a.l + _hash(key, i, a.r, label)) % left_n).otherwise(a.l)  # noqa: E741
        r = F.when(odd, a.r).otherwise((a.r + _hash(key, i, a.l, label)) % right_n)
        return F.struct(l.alias("l"), r.alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of non-negative longs."""
    return F.call_function("div", a, b)


def _radix(c: Column) -> Column:
    return F.when(c.between("0", "9"), 10).when(c.between("A", "Z"), 26).when(c.between("a", "z"), 26).otherwise(1)


def _least(c: Column) -> Column:
    """The first character of c's alphabet."""
    return F.when(c.between("0", "9"), F.lit("0")).when(c.between("A", "Z"), F.lit("A")).when(c.between("a", "z"), F.lit("a")).otherwise(c)


def _permuted(s: Column, key: str, label: str, phone: bool = False) -> Column:
    """A string with its letters and digits permuted, 24 characters at a time."""
    chars = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, F.lit(1)))
    if phone:  # of ten digits the first and fourth are 2 to 9 in a valid number
        def places(c, i):
            high = ((i == 0) | (i == 3)) & (F.length(s) == 10) & (c >= "2")
            return F.struct(F.when(high, 8).otherwise(_radix(c)).alias("n"), F.when(high, F.lit("2")).otherwise(_least(c)).alias("a"), c.alias("c"))
    else:
        def places(c, i):
            return F.struct(_radix(c).alias("n"), _least(c).alias("a"), c.alias("c"))

    def part(k):
        p = F.slice(F.transform(chars, places), k * 24 + 1, F.lit(24))
        return _permuted_part(p, key, label)

    return F.when(F.length(s) > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / 24).cast("int")), part), "")).otherwise(s)


def _permuted_part(p: Column, key: str, label: str) -> Column:
    half = F.ceil(F.size(p) / 2).cast("int")
    one = F.lit(1).cast("long")

    def value(x):
        return F.aggregate(x, F.lit(0).cast("long"), lambda v, d: v * d.n + (F.ascii(d.c) - F.ascii(d.a)) * F.when(d.n > 1, 1).otherwise(0))

    def many(x):
        return F.aggregate(x, one, lambda v, d: v * d.n)

    def written(v, x):
        """Digits of v from the last place to the first."""
        def whole(acc, d):
            c = F.when(d.n > 1, F.chr(F.ascii(d.a) + acc.v % d.n)).otherwise(d.c)
            return F.struct(_div(acc.v, d.n.cast("long")).alias("v"), F.concat(c, acc.s).alias("s"))

        return F.aggregate(F.reverse(x), F.struct(v.cast("long").alias("v"), F.lit("").alias("s")), whole, lambda a: a.s)

    def out(h):
        a, b = F.slice(p, F.lit(1), half), F.slice(p, half + 1, F.size(p) - half)
        return F.concat(written(h.l, a), written(h.r, b))

    a, b = F.slice(p, F.lit(1), half), F.slice(p, half + 1, F.size(p) - half)
    done = _feistel(value(a), many(a), value(b), many(b), key, label)
    # one evaluation of the network: bind it as the element of an array
    return F.get(F.transform(F.array(done), out), F.lit(0))


def _refilled(shape: Column, digits: Column) -> Column:
    """``shape`` with its letters and digits replaced in turn by ``digits``."""
    def step(acc, i):
        c = F.substring(shape, i, F.lit(1))
        plain = c.rlike("[A-Za-z0-9]")
        put = F.when(plain, F.substring(digits, acc.k + 1, F.lit(1))).otherwise(c)
        return F.struct((acc.k + plain.cast("int")).alias("k"), F.concat(acc.s, put).alias("s"))

    start = F.struct(F.lit(0).alias("k"), F.lit("").alias("s"))
    return F.aggregate(F.sequence(F.lit(1), F.length(shape)), start, step, lambda a: a.s)


def _luhn(digits: Column, shift: int) -> Column:
    """Luhn sum; ``shift`` 0 where the last digit is the check digit, 1 where it is missing."""
    def step(acc, i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return acc + F.when((i + shift) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step)


def _mod97(s: Column) -> Column:
    def step(acc, i):
        c = F.substring(s, i, F.lit(1))
        return F.when(c.between("A", "Z"), (acc * 100 + F.ascii(c) - 55) % 97).otherwise((acc * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), step)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with one evaluation of ``value``."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _card_valid(d: Column) -> Column:
    return F.length(d).between(13, 19) & (_luhn(d, 0) % 10 == 0) & d.rlike("[1-9]")


def _card(m: Column, key: str) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")

    def new(d):
        body = F.concat(F.substring(d, 1, 1), _permuted(F.substring(d, F.lit(2), F.length(d) - 2), key, "card"))
        return _bound(body, lambda b: F.concat(b, ((10 - _luhn(b, 1) % 10) % 10).cast("string")))

    return _bound(digits, lambda d: F.when(_card_valid(d), _refilled(m, new(d))))


def _card_places(m: Column) -> Column:
    """array of struct(rank, at, size): the cards in a run of digit groups, in order, none over another.

    The whole run is tried first, then sub-runs between separators: those
    grouped as cards are printed, then the others, longer ones first.
    """
    sizes = F.transform(F.regexp_extract_all(m, F.lit(r"\d+"), 0), lambda g: F.length(g))
    first = F.struct(F.lit(1).alias("at"), F.lit(0).alias("size"))
    groups = F.slice(F.aggregate(sizes, F.array(first), lambda a, n: F.concat(a, F.array(F.struct((F.element_at(a, -1).at + F.element_at(a, -1).size + (F.size(a) > 1).cast("int")).alias("at"), n.alias("size"))))), 2, 1_000_000_000)

    def from_(groups):
        def ends(g, i):
            return F.transform(F.slice(groups, i + 1, F.lit(19)), lambda e: F.struct(g["at"].alias("at"), (e["at"] + e["size"] - g["at"]).alias("size")))

        def ranked(x):
            sub = F.substring(m, x["at"], x["size"])
            whole = x["size"] == F.length(m)
            printed = sub.rlike(_PRINTED)
            wide = sub.rlike(r"^(?:\d{3,}[ -])*\d+$")
            valid = (whole | wide) & _card_valid(F.regexp_replace(sub, "[^0-9]", ""))
            rank = F.when(whole, 0).when(printed, 1).otherwise(2)
            return F.struct(F.when(valid, rank).alias("rank"), (-x["size"]).alias("short"), x["at"].alias("at"), x["size"].alias("size"))

        found = F.filter(F.transform(F.filter(F.flatten(F.transform(groups, ends)), lambda x: x["size"].between(13, 37)), ranked), lambda x: x["rank"].isNotNull())
        none = F.array().cast("array<struct<rank:int,short:int,at:int,size:int>>")
        apart = lambda a, x: ~F.exists(a, lambda y: (x["at"] < y["at"] + y["size"]) & (y["at"] < x["at"] + x["size"]))
        taken = F.aggregate(F.array_sort(found), none, lambda a, x: F.when(apart(a, x), F.concat(a, F.array(x))).otherwise(a))
        return F.array_sort(F.transform(taken, lambda x: F.struct(x["at"].alias("at"), x["size"].alias("size"))))

    return _bound(groups, from_)


def _card_pieces(m: Column, key: str) -> Column:
    """The run in pieces, struct(found, kind, pseudonym); what is no card has no pseudonym."""
    kind = F.lit("card")
    piece = lambda t, value: F.struct(t.alias("found"), kind.alias("kind"), value.alias("pseudonym"))
    rest = F.lit(None).cast("string")

    def step(acc, x):
        card = F.substring(m, x["at"], x["size"])
        gap = F.substring(m, acc["next"], x["at"] - acc["next"])
        return F.struct((x["at"] + x["size"]).alias("next"), F.concat(acc["out"], F.array(piece(gap, rest), piece(card, _card(card, key)))).alias("out"))

    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<found:string,kind:string,pseudonym:string>>").alias("out"))
    return F.aggregate(_card_places(m), start, step, lambda a: F.concat(a["out"], F.array(piece(F.substring(m, a["next"], F.length(m)), rest))))


def _phone(m: Column, key: str) -> Column:
    country = F.regexp_extract(m, _CALLING, 0)
    rest = F.substring(m, F.length(country) + 1, F.lit(100))
    digits = F.regexp_replace(rest, "[^0-9]", "")
    return _bound(digits, lambda d: F.when(F.length(d).between(6, 14), F.concat(country, _refilled(rest, _permuted(d, key, "phone", True)))))


def _iban(m: Column, key: str) -> Column:
    """Of an IBAN in groups the last one or two may be other words: the longest valid run of groups counts."""

    def whole(t):
        def new(plain):
            body, head = F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 2)
            valid = (_mod97(F.concat(body, F.substring(plain, 1, 4))) == 1) & F.length(plain).between(15, 34)

            def checked(b):
                check = (98 - _mod97(F.concat(b, head, F.lit("00")))).cast("string")
                return _refilled(t, F.concat(head, F.lpad(check, 2, "0"), b))

            return F.when(valid, _bound(_permuted(body, key, "iban"), checked))

        return _bound(F.regexp_replace(t, " ", ""), new)

    def without(n):
        cut = F.regexp_replace(m, rf"(?: [A-Z0-9]+){{{n}}}$", "")
        return F.when(cut != m, F.concat(whole(cut), F.substring(m, F.length(cut) + 1, F.length(m))))

    return F.coalesce(whole(m), without(1), without(2))


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    valid = F.forall(octets, lambda x: x <= 255)

    def new(h):
        return F.concat_ws(".", *[x.cast("string") for half in (h.l, h.r) for x in (_div(half, F.lit(256)), half % 256)])

    o = lambda i: F.get(octets, F.lit(i))
    n = F.lit(65536).cast("long")
    return F.when(valid, _bound(_feistel(o(0) * 256 + o(1), n, o(2) * 256 + o(3), n, key, "ip"), new))


def _date(m: Column, key: str) -> Column:
    forms = ("yyyy-MM-dd", "d.M.yyyy", "d/M/yyyy", "M/d/yyyy")
    whole = F.length(m) == 10
    first, n = F.lit("1900-01-01").cast("date"), DAYS[0] * DAYS[1]
    out = F.lit(None).cast("string")

    def moved(shape):
        def new(h):
            return F.date_format(F.date_add(first, (h.l * DAYS[1] + h.r).cast("int")), shape)

        def of(d):
            long = lambda x: F.lit(x).cast("long")
            halves = _feistel(_div(d.cast("long"), long(DAYS[1])), long(DAYS[0]), d % DAYS[1], long(DAYS[1]), key, "date")
            return F.when(d.between(0, n - 1), _bound(halves, new))

        return of

    for f in reversed(forms):
        day = F.datediff(F.try_to_timestamp(m, F.lit(f)).cast("date"), first)
        wide = f if "-" in f else f.replace("d", "dd").replace("M", "MM")
        sep = next(c for c in "-./" if c in f)
        # date_format takes constant patterns: one branch for each width
        named = F.when(whole, _bound(day, moved(wide))).otherwise(_bound(day, moved(f)))
        out = F.when(m.contains(sep), F.coalesce(named, out)).otherwise(out)
    return out


def _ssn(m: Column, key: str) -> Column:
    invalid = lambda d: d.rlike(r"^(?:000|666|9)|^...00|0000$")

    def walked(d):
        first = _permuted(d, key, "ssn")
        return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), first, lambda x, _: F.when(invalid(x), _permuted(x, key, "ssn")).otherwise(x))

    digits = F.regexp_replace(m, "-", "")
    return _bound(digits, lambda d: F.when(~invalid(d), _refilled(m, walked(d))))


def _email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(_permuted(local, key, "email"), F.substring(m, F.length(local) + 1, F.lit(400)))


_MAKERS = {"email": _email, "phone": _phone, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card}


def _pseudonym(m: Column, key: str) -> Column:
    """array of struct(found, kind, pseudonym): the pieces of a match; pseudonym null where nothing is valid."""
    kind = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for k in [k for k in reversed(KINDS) if k != "card"]:
        here = m.rlike(f"^(?:{FORMS[k]})$")
        kind = F.when(here, F.lit(k)).otherwise(kind)
        value = F.when(here, _MAKERS[k](m, key)).otherwise(value)
    one = F.array(F.struct(m.alias("found"), kind.alias("kind"), value.alias("pseudonym")))
    other = m.rlike("^(?:" + "|".join(FORMS[k] for k in KINDS if k != "card") + ")$")
    return F.when(m.rlike(f"^(?:{FORMS['card']})$") & ~other, _card_pieces(m, key)).otherwise(one)


def pseudonymised(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, findings, n_replaced`` for each row; ``text`` with pseudonyms.

    ``findings`` lists (found, kind, pseudonym) of the replaced values.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    base = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("_t"))
    some = F.col("_t").rlike("[0-9@]")
    base = base.select("doc_id", "_t", F.when(some, F.regexp_extract_all("_t", F.lit(PATTERN), 0)).otherwise(F.array().cast("array<string>")).alias("_m"))
    base = base.select("doc_id", "_t", F.transform("_m", lambda m: _pseudonym(m, key)).alias("_f"))
    between = F.split("_t", PATTERN, -1)
    put = F.transform("_f", lambda pieces: F.array_join(F.transform(pieces, lambda f: F.coalesce(f.pseudonym, f.found)), ""))
    joined = F.array_join(F.flatten(F.zip_with(between, put, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    replaced = F.filter(F.flatten("_f"), lambda f: f.pseudonym.isNotNull())
    out = base.select("doc_id", F.when(F.size("_f") > 0, joined).otherwise(F.col("_t")).alias("text"), F.coalesce(replaced, F.array().cast(base.schema["_f"].dataType.elementType)).alias("findings"))
    return out.select("*", F.size("findings").cast("long").alias("n_replaced"))
