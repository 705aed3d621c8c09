"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

One pattern finds all values but cards; octets, calendar and digit counts are part of it. Cards are found in what lies
between these, from the text's groups of digits, so a run that fails the Luhn sum hides no value in or behind it and the
time is linear in the text. What is found is permuted within its format: a card number becomes another with a right check
digit, a date another date, and letters, digits and separators stay what they are. The permutation depends
on the key, the kind and the digits or letters alone, so equal values get equal pseudonyms in
every document and, without the key, can't be traced back. All steps are DataFrame functions.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.arrays import let, sums_ahead
from lexiforge.llm.common import free_names

#: Where a session may hold the key.
KEY_CONF = "spark.lexiforge.pii.key"
ROUNDS = 8
#: Dates are permuted within windows of days from FIRST_DAY on. A window's days are the product of the two halves'
#: radices; WINDOWS whole ones and what is left of the 3,652,059 days to 9999-12-31 cover each day once.
FIRST_DAY = "0001-01-01"
WINDOW, WINDOWS, LAST_WINDOW = (270, 270), 50, (39, 181)

#: Month and day of any year, and of leap years.
DAYS = [("0[13578]|1[02]", "0[1-9]|[12][0-9]|3[01]"), ("0[469]|11", "0[1-9]|[12][0-9]|30"), ("02", "0[1-9]|1[0-9]|2[0-8]")]
LEAP = "(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)"
YEAR = "(?!0000)[0-9]{4}"
ISO_DATE = "|".join([*(f"{YEAR}-(?:{m})-(?:{d})" for m, d in DAYS), f"(?!0000){LEAP}-02-29"])
DAY_FIRST = "|".join(x for s in ("/", r"\.") for x in (*(f"(?:{d}){s}(?:{m}){s}{YEAR}" for m, d in DAYS), f"29{s}02{s}(?!0000){LEAP}"))

# The kinds in the order in which the pattern tries them at a place. Runs are possessive or short and begin behind
# a look-behind, so that matching takes linear time on any text. Only formats bound a run's length: a domain name has at
# most 127 labels, a phone 15 digits.
OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
IP = rf"(?<![0-9])(?<![0-9]\.)(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])"
DATE = rf"(?<![0-9/.-])(?:{ISO_DATE}|{DAY_FIRST})(?![0-9/-])"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
#: A run of so many digits: what a card can be, before its Luhn sum is worked out.
CARD_DIGITS = range(13, 20)
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
PHONE_HEAD = r"(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\)|[ .-][0-9]{1,4}|[0-9]{1,4})"
#: Of all ends of a phone only those with 8 to 15 digits ahead count; written out, as Java wants a look-behind's length.
PHONE_DIGIT = "[ .()-]{0,2}[0-9]"
PHONE_END = rf"(?![0-9])(?<=\+{PHONE_DIGIT * 8}{f'(?:{PHONE_DIGIT})?' * 7})"


def patterns() -> dict[str, str]:
    """The pattern of each kind but cards. A phone ends ahead of another kind's value, or what may be a card, if what is left is a phone."""
    phone = rf"{PHONE_HEAD}(?:[ .-]?[0-9]{{2,5}}){{1,4}}{PHONE_END}"
    return {
        "secret": r"(?i:(?:api[_-]?key|token|secret|password|passwd)\s*+[=:]\s*+[\"'][^\"'\s]{8,}+[\"'])",
        "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,}+(?![A-Za-z0-9-])",
        "ip": IP,
        "phone": f"{phone}(?=[ .-]?(?:{IP}|{DATE}|{SSN}|{CARD}))|{phone}",
        "date": DATE,
        "ssn": SSN,
    }


PATTERNS = patterns()
KINDS = (*PATTERNS, "card")
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these has no candidate; the cheap test comes first.
HINT = r"[0-9@\"']"


def feistel(values: Column, radices: Column, key: Column) -> Column:
    """values (array<int>, each below its radix) keyed-permuted: the halves take turns in shifting each other.

    Each round adds to every place of one half a keyed hash of the other half, modulo the place's
    radix, which the same rounds backwards undo; so it is a permutation for any radices. A hash is SHA-512 of
    ``key|round|other half`` in hex, four digits for a place; places from 32 on take those of the SHA-512
    of ``hash|k`` for each 32 places.
    """
    def round_(v: Column, r: Column, radices: Column) -> Column:
        half = F.floor(F.size(v) / 2).cast("int")
        first = r % 2 == 0
        other = F.when(first, F.slice(v, half + 1, F.size(v))).otherwise(F.slice(v, F.lit(1), half))
        h = F.sha2(F.concat_ws("|", key, r.cast("string"), F.array_join(other.cast("array<string>"), ",")), 512)
        more = lambda h: F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / 32).cast("int")), lambda k: F.when(k == 0, h).otherwise(F.sha2(F.concat_ws("|", h, k.cast("string")), 512)))
        at = lambda i: F.when(first, i).otherwise(i - half)
        part = lambda hs, i: F.substring(F.get(hs, F.floor(at(i) / 32).cast("int")), (4 * (at(i) % 32) + 1).cast("int"), F.lit(4))
        add = lambda hs, i: F.conv(part(hs, i), 16, 10).cast("int")
        mine = lambda i: F.when(first, i < half).otherwise(i >= half)
        shift = lambda hs: F.transform(v, lambda x, i: F.when(mine(i), F.pmod(x + add(hs, i), F.get(radices, i))).otherwise(x))
        return let(let(h, more), shift)

    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return let(radices, lambda radices: F.aggregate(rounds, values, lambda v, r: round_(v, r, radices)))


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def permuted_text(text: Column, key: Column, free: Column | None = None) -> Column:
    """Digits to digits, letters to letters of the same case, the rest as it is. free: which places may change."""
    c = F.transform(_chars(text), lambda c, i: F.struct(c.alias("c"), F.ascii(c).alias("a"), (free(i) if free else F.lit(True)).alias("free")))
    of = lambda x: (
        F.when(~x["free"], F.lit(None))
        .when(x["a"].between(48, 57), F.struct(F.lit(10).alias("radix"), F.lit(48).alias("base")))
        .when(x["a"].between(97, 122), F.struct(F.lit(26).alias("radix"), F.lit(97).alias("base")))
        .when(x["a"].between(65, 90), F.struct(F.lit(26).alias("radix"), F.lit(65).alias("base")))
    )
    c = F.transform(c, lambda x: F.struct(x["c"].alias("c"), (x["a"] - of(x)["base"]).alias("v"), of(x)["radix"].alias("radix"), of(x)["base"].alias("base")))
    zero = F.struct(F.lit(0).alias("k"), F.lit("").alias("s"))

    def fill(c: Column, new: Column) -> Column:
        put = lambda a, x: F.struct(
            (a["k"] + F.when(x["radix"].isNull(), 0).otherwise(1)).alias("k"),
            F.concat(a["s"], F.when(x["radix"].isNull(), x["c"]).otherwise(F.chr(F.get(new, a["k"]) + x["base"]))).alias("s"),
        )
        return F.aggregate(c, zero, put, lambda a: a["s"])

    used = lambda c: F.filter(c, lambda x: x["radix"].isNotNull())
    new = lambda u: feistel(F.transform(u, lambda x: x["v"]), F.transform(u, lambda x: x["radix"]), key)
    return let(c, lambda c: let(let(used(c), new), lambda n: fill(c, n)))


def _digits(text: Column) -> Column:
    return F.transform(_chars(F.regexp_replace(text, "[^0-9]", "")), lambda c: c.cast("int"))


def luhn(digits: Column, check: bool = True) -> Column:
    """Sum of the digits of array<int>, every other doubled, the last being the check digit or standing ahead of it."""
    n = F.size(digits)
    doubled = lambda x, i: F.when((n - i) % 2 == (0 if check else 1), F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)
    return F.aggregate(F.transform(digits, doubled), F.lit(0), lambda a, x: a + x)


def _refill(text: Column, digits: Column) -> Column:
    """text with its digits, in order, replaced by those of array<int>."""
    zero = F.struct(F.lit(0).alias("k"), F.lit("").alias("s"))
    is_digit = lambda c: c.between("0", "9")
    put_with = lambda digits: lambda a, c: F.struct(
        (a["k"] + F.when(is_digit(c), 1).otherwise(0)).alias("k"),
        F.concat(a["s"], F.when(is_digit(c), F.get(digits, a["k"]).cast("string")).otherwise(c)).alias("s"),
    )
    return let(digits, lambda digits: F.aggregate(_chars(text), zero, put_with(digits), lambda a: a["s"]))


def _card(v: Column, key: Column) -> Column:
    d = _digits(v)
    payload = F.slice(d, F.lit(1), F.size(d) - 1)
    new = feistel(payload, F.transform(payload, lambda _: F.lit(10)), key)
    return let(new, lambda new: _refill(v, F.concat(new, F.array(F.pmod(-luhn(new, False), F.lit(10))))))


def _ip(v: Column, key: Column) -> Column:
    octets = F.split(v, r"\.").cast("array<int>")
    return F.array_join(feistel(octets, F.transform(octets, lambda _: F.lit(256)), key).cast("array<string>"), ".")


def _iso(v: Column) -> Column:
    """The date that a candidate says, day before month but for ISO dates, or null."""
    at = lambda a, n: F.substring(v, a, n)
    dashed = F.substring(v, 5, 1) == "-"
    iso = F.when(dashed, v).otherwise(F.concat_ws("-", at(7, 4), at(4, 2), at(1, 2)))
    return F.when(iso.rlike("^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$"), F.try_to_date(iso, "yyyy-MM-dd"))


def _date(v: Column, key: Column) -> Column:
    """A day of the same window, so that every day from 0001-01-01 to 9999-12-31 is one's pseudonym."""
    first = F.lit(FIRST_DAY).cast("date")
    days = F.date_diff(_iso(v), first)
    window = F.least(F.floor(days / (WINDOW[0] * WINDOW[1])).cast("int"), F.lit(WINDOWS))
    radix = lambda k: F.when(window < WINDOWS, WINDOW[k]).otherwise(LAST_WINDOW[k])
    inside = days - window * (WINDOW[0] * WINDOW[1])
    halves = F.array(F.floor(inside / radix(1)).cast("int"), (inside % radix(1)).cast("int"))
    new = feistel(halves, F.array(radix(0), radix(1)), F.concat_ws("|", key, window.cast("string")))
    day = let(new, lambda n: F.date_add(first, (days - inside + F.get(n, F.lit(0)) * radix(1) + F.get(n, F.lit(1))).cast("int")))
    mark = F.substring(v, 3, 1)
    iso = F.date_format(day, "yyyy-MM-dd")
    return F.when(F.substring(v, 5, 1) == "-", iso).otherwise(F.concat(F.substring(iso, 9, 2), mark, F.substring(iso, 6, 2), mark, F.substring(iso, 1, 4)))


def _ssn(v: Column, key: Column) -> Column:
    """Area 001 to 899 without 666, group 01 to 99 and serial 0001 to 9999, each a digit of its own radix."""
    area, group, serial = (F.substring(v, at, n).cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))
    values = F.array(area - 1 - F.when(area > 666, 1).otherwise(0), group - 1, serial - 1)
    new = feistel(values, F.array(F.lit(898), F.lit(99), F.lit(9999)), key)
    back = lambda n: F.format_string("%03d-%02d-%04d", n[0] + 1 + F.when(n[0] >= 665, 1).otherwise(0), n[1] + 1, n[2] + 1)
    return let(new, back)


# The country codes of one and two digits (ITU-T E.164); all others have three.
CODES_OF_ONE = "[17]"
CODES_OF_TWO = "2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"


def _phone(v: Column, key: Column) -> Column:
    """The country code stays; it and the other digits alone, however they are set, say what these become."""
    d = _digits(v)
    code = F.when(F.regexp_like(v, F.lit(rf"^\+{CODES_OF_ONE}")), 1).otherwise(F.when(F.regexp_like(F.regexp_replace(v, "[^0-9]", ""), F.lit(f"^(?:{CODES_OF_TWO})")), 2).otherwise(3))
    rest = F.slice(d, code + 1, F.size(d))
    head = F.slice(d, F.lit(1), code)
    return _refill(v, F.concat(head, feistel(rest, F.transform(rest, lambda _: F.lit(10)), F.concat_ws("|", key, F.array_join(head.cast("array<string>"), "")))))


def _email(v: Column, key: Column) -> Column:
    """Every letter and digit but those of the last label."""
    stop = F.length(v) - F.length(F.substring_index(v, ".", -1))
    return permuted_text(v, key, lambda i: i < stop)


def _secret(v: Column, key: Column) -> Column:
    head = F.regexp_extract(v, "^[^\"']*[\"']", 0)
    body = F.substring(v, F.length(head) + 1, F.length(v) - F.length(head) - 1)
    return F.concat(head, permuted_text(body, key), F.substring(v, -1, 1))


def kind_of(v: Column) -> Column:
    """The first kind but card whose pattern a value is, or null."""
    out = F.lit(None).cast("string")
    for k in reversed(PATTERNS):
        out = F.when(v.rlike(f"^(?:{PATTERNS[k]})$"), F.lit(k)).otherwise(out)
    return out


GROUP = "[0-9]+"
GROUPS = "array<struct<v:string,done:boolean>>"
#: A letter per group: a for one where no card begins, the k-th behind it for one where k groups are a value.
TAKEN = "|".join(f"{chr(97 + k)}.{{{k - 1}}}" for k in range(1, CARD_DIGITS.stop))


def groups(found: Column, cut: Column) -> tuple[Column, Column]:
    """(what lies between groups, the groups): the values found, marked as done, and the digits of the pieces that may hold a card."""
    may = lambda p: p.rlike(CARD)
    between = F.flatten(F.transform(cut, lambda p: F.when(may(p), F.split(p, GROUP, -1)).otherwise(F.array(p))))
    as_group = lambda v, done: F.struct(v.alias("v"), F.lit(done).alias("done"))
    none = F.array().cast(GROUPS)
    digits = lambda p: F.when(may(p), F.transform(F.regexp_extract_all(p, F.lit(GROUP), F.lit(0)), lambda v: as_group(v, False))).otherwise(none)
    value = lambda i: F.when(i < F.size(found), F.array(as_group(F.get(found, i), True))).otherwise(none)
    return between, F.flatten(F.transform(cut, lambda p, i: F.concat(digits(p), value(i))))


def marked(between: Column, group: Column) -> Column:
    """The letters of TAKEN. A card is the longest run of whole groups, one blank or dash between two, with a right Luhn sum."""
    def longest(between: Column, group: Column, i: Column) -> Column:
        def step(a: Column, j: Column) -> Column:
            joined = (j == 0) | F.get(between, i + j).isin(" ", "-")
            g = F.get(group, i + j)
            longer = F.when(a["digits"].isNotNull() & joined & ~g["done"], F.concat(a["digits"], g["v"]))
            longer = let(longer, lambda d: F.when(F.length(d) < CARD_DIGITS.stop, d))
            passes = lambda d: (F.length(d) >= CARD_DIGITS.start) & F.call_function("luhn_check", d)
            return let(longer, lambda d: F.struct(d.alias("digits"), F.when(passes(d), j + 1).otherwise(a["best"]).alias("best")))

        zero = F.struct(F.lit("").alias("digits"), F.lit(0).alias("best"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(CARD_DIGITS.stop - 2)), zero, step, lambda a: a["best"])

    def letter(between: Column, group: Column, g: Column, i: Column) -> Column:
        alone = F.length(g["v"]) >= CARD_DIGITS.start
        some = alone | F.coalesce(F.get(between, i + 1).isin(" ", "-"), F.lit(False))
        return F.when(g["done"], F.lit("b")).when(some, F.chr(longest(between, group, i) + 97)).otherwise(F.lit("a"))

    made = lambda between, group: F.array_join(F.transform(group, lambda g, i: letter(between, group, g, i)), "")
    return let(between, lambda between: let(group, lambda group: made(between, group)))


def settled(between: Column, group: Column, letters: Column) -> Column:
    """array<struct<cut, kind, original>>: each value, card or not, with the text ahead of it; last the rest of the text, without a value.

    Letters are taken from the left, so of values that overlap the first one stays.
    """
    def one(between, group, joined, sizes, ahead, i):
        at = F.get(ahead, i).cast("int")
        first = at + F.get(sizes, i)["gap"]
        cut = F.concat(F.array_join(F.slice(joined, at + 1, F.get(sizes, i)["gap"]), ""), F.get(between, first))
        original = lambda: F.concat(F.get(group, first)["v"], F.array_join(F.slice(joined, first + 2, F.get(sizes, i)["value"] - 1), ""))
        is_value = F.get(sizes, i)["value"] > 0
        kind = lambda v: F.when(F.get(group, first)["done"], kind_of(v)).otherwise(F.lit("card"))
        return let(F.when(is_value, original()), lambda v: F.struct(cut.alias("cut"), F.when(v.isNotNull(), kind(v)).alias("kind"), v.alias("original")))

    gaps, values = F.split(letters, TAKEN, -1), F.regexp_extract_all(letters, F.lit(TAKEN), F.lit(0))
    sizes = F.zip_with(gaps, values, lambda g, v: F.struct(F.length(g).alias("gap"), F.coalesce(F.length(v), F.lit(0)).alias("value")))
    total = lambda sizes: F.transform(sizes, lambda x: (x["gap"] + x["value"]).cast("long"))
    whole = lambda between, group, joined, sizes: let(sums_ahead(total(sizes)), lambda ahead: F.transform(sizes, lambda _, i: one(between, group, joined, sizes, ahead, i)))
    joined = lambda between, group: F.zip_with(F.slice(between, F.lit(1), F.size(group)), group, lambda b, g: F.concat(b, g["v"]))
    return let(between, lambda b: let(group, lambda g: let(joined(b, g), lambda j: let(sizes, lambda s: whole(b, g, j, s)))))


def pseudonym(kind: Column, v: Column, key: str) -> Column:
    made = {"secret": _secret, "email": _email, "ip": _ip, "phone": _phone, "date": _date, "card": _card, "ssn": _ssn}
    out = v
    for k in reversed(KINDS):
        out = F.when(kind == k, made[k](v, F.lit(f"{key}|{k}"))).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str | None = None, text: str = "text", name: str = "pii") -> DataFrame:
    """docs with text pseudonymised and a column pii, array<struct<kind, start, original, pseudonym>>, added.

    start counts code points from 0 in the original text. Cards are looked for between the other kinds' values, from the
    left, the longest of those that begin at a place. Runs that fail their kind's check stay as they are, but for values within them. A null text stays null and, like an empty or clean one, has no entry; rows, repeated
    ones too, stay rows, and an empty table stays empty. Texts of any length are taken whole, and no value is too long. All
    other columns stay, but one called as the added one is to be is replaced. Whoever knows the key can trace
    pseudonyms back: without one, nor one in the session's ``spark.lexiforge.pii.key``, a random key holds for this call.
    """
    key = key or docs.sparkSession.conf.get(KEY_CONF, None) or secrets.token_hex(16)
    t = F.col(text)
    some = F.coalesce(t.rlike(HINT), F.lit(False)) & F.coalesce(t.rlike(f"{PATTERN}|{CARD}"), F.lit(False))
    # Rows of the plan, so that every step's arrays are made once.
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    found_, cut_, between_, group_, letters_ = free_names([*kept, name], "_found", "_cut", "_between", "_group", "_letters")
    rows = docs.select(*kept, F.when(some, F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))).alias(found_), F.when(some, F.split(t, PATTERN, -1)).alias(cut_))
    between, group = groups(F.col(found_), F.col(cut_))
    any_ = F.col(found_).isNotNull()
    rows = rows.select(*kept, F.when(any_, between).alias(between_), F.when(any_, group).alias(group_))
    any_ = F.size(group_) > 0
    rows = rows.select(*kept, between_, group_, F.when(any_, marked(F.col(between_), F.col(group_))).alias(letters_))
    any_ = F.coalesce(F.col(letters_).rlike("[^a]"), F.lit(False))
    rows = rows.select(*kept, F.when(any_, settled(F.col(between_), F.col(group_), F.col(letters_))).alias(found_))
    any_ = F.col(found_).isNotNull()
    new = F.transform(found_, lambda x: x.withField("pseudonym", F.coalesce(pseudonym(x["kind"], x["original"], key), x["original"])))
    rows = rows.select(*kept, F.when(any_, new).alias(found_))
    joined = F.array_join(F.transform(found_, lambda x: F.concat(x["cut"], F.coalesce(x["pseudonym"], F.lit("")))), "")
    sizes = F.transform(found_, lambda x: (F.length(x["cut"]) + F.coalesce(F.length(x["original"]), F.lit(0))).cast("long"))
    entry = lambda ahead: F.transform(
        found_,
        lambda x, i: F.struct(x["kind"].alias("kind"), (F.get(ahead, i) + F.length(x["cut"])).cast("int").alias("start"), x["original"].alias("original"), x["pseudonym"].alias("pseudonym")),
    )
    pii = F.filter(let(sums_ahead(sizes), entry), lambda x: x["kind"].isNotNull())
    pii = F.when(any_, pii).otherwise(F.array().cast("array<struct<kind:string,start:int,original:string,pseudonym:string>>"))
    return rows.select(*[F.when(any_, joined).otherwise(t).alias(text) if c == text else F.col(c) for c in kept], pii.alias(name))
