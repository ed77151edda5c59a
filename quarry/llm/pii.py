"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Candidates are found by pattern, validated (check digits, octets, calendar), and permuted within their
format by a keyed Feistel network, so equal values get equal pseudonyms in every document and the original
can be restored with the key. Texts without a candidate take no other path than the pattern test.

Kinds: card numbers (13 to 19 digits with a valid check digit, which the pseudonym has too), phone numbers
with separators or an international prefix (ten digits at most are permuted, never the first), social-security-like
numbers, IPv4 addresses (a permutation of all addresses), dates of 1800 to 2199 as year-month-day,
day.month.year or month/day/year, e-mail addresses (a keyed hash of the local part; this alone cannot be
restored). Numbers that fail validation stay as they are. IPv6 addresses and day/month/year are not found.

Defined cases: a null text stays null with no counts; empty and very long texts, copies and repeated rows
are handled like any others; an empty table gives an empty result; other columns pass through, but columns
named like the ones that are added give way to them.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents

ROUNDS = 8
KINDS = ("email", "card", "ssn", "ip", "date", "phone")
PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9_][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "card": r"(?<![\w.-])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\w)",
    "date": r"(?<![\w./-])(?:(?:1[89]|2[01])\d\d-\d{2}-\d{2}|\d{2}([./])\d{2}\1(?:1[89]|2[01])\d\d)(?![\w-])",
    "phone": r"(?<![\w(.+-])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}|\+\d{8,15}|\+\d{1,3}(?:[ .-]\d{2,8}){2,5}|0\d{1,4}[/-]\d{5,8}|0\d(?:[ .]\d{2}){4})(?![\w-])",
}
#: 400 years, in which the calendar repeats: 146,097 days are a grid of 773 x 189.
_EPOCH, _DAYS, _GRID = "1800-01-01", 146097, (773, 189)


def _hash60(key: str, i: Column, x: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(key), i, x), 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, left: Column, right: Column, left_size: Column, right_size: Column, back: bool = False) -> tuple[Column, Column]:
    """Permute pairs of 0 <= left < left_size, 0 <= right < right_size; ``back`` inverts."""
    sign = -1 if back else 1
    turns = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def turn(s: Column, i: Column) -> Column:
        l, r = s["l"], s["r"]
        on_left = F.struct(F.pmod(l + sign * F.pmod(_hash60(key, i, r), left_size), left_size).alias("l"), r.alias("r"))
        on_right = F.struct(l.alias("l"), F.pmod(r + sign * F.pmod(_hash60(key, i, l), right_size), right_size).alias("r"))
        return F.when(i % 2 == 0, on_left).otherwise(on_right)

    out = F.aggregate(turns, F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)
    return out["l"], out["r"]


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permute_digits(key: str, digits: Column, back: bool = False) -> Column:
    """Permute strings of 2 to 19 digits among those of the same length."""
    n = F.length(digits)
    a = F.floor(n / 2).cast("int")
    b = n - a
    l, r = feistel(key, F.substring(digits, F.lit(1), a).cast("long"), F.substring(digits, a + 1, b).cast("long"), _power(a), _power(b), back)
    return F.concat(F.lpad(l.cast("string"), a, "0"), F.lpad(r.cast("string"), b, "0"))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _in_form_of(form: Column, digits: Column) -> Column:
    """``digits`` with the separators of ``form``."""
    one = lambda i: F.substring(form, i, F.lit(1))
    nth = lambda i: F.substring(digits, F.length(_digits(F.substring(form, F.lit(1), i))), F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), lambda i: F.when(one(i).rlike("[0-9]"), nth(i)).otherwise(one(i))), "")


def _card(key: str, v: Column, back: bool) -> Column:
    d = _digits(v)
    body = permute_digits(key, F.substring(d, F.lit(1), F.length(d) - 1), back)
    check = F.element_at(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda c: F.call_function("luhn_check", F.concat(body, c.cast("string")))), 1)
    return F.when(F.call_function("luhn_check", d), _in_form_of(v, F.concat(body, check.cast("string")))).otherwise(v)


def _ssn(key: str, v: Column, back: bool) -> Column:
    """Area, group and serial are permuted each among its valid values: areas 001 to 899 but 666, no zero group or serial."""
    area, group, serial = (v.substr(*at).cast("long") for at in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    # 898 areas and 989,901 pairs of group and serial; the area skips 666.
    l, r = feistel(key, area - 1 - (area > 666).cast("long"), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), back)
    made = F.concat_ws("-", F.lpad((l + 1 + (l >= 665).cast("long")).cast("string"), 3, "0"), F.lpad((F.floor(r / 9999) + 1).cast("string"), 2, "0"), F.lpad((r % 9999 + 1).cast("string"), 4, "0"))
    return F.when(valid, made).otherwise(v)


def _ip(key: str, v: Column, back: bool) -> Column:
    o = F.transform(F.split(v, r"\."), lambda x: x.cast("long"))
    l, r = feistel(key, o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), back)
    made = F.concat_ws(".", F.floor(l / 256), l % 256, F.floor(r / 256), r % 256)
    plain = F.forall(F.split(v, r"\."), lambda x: (x.cast("int") <= 255) & (x == x.cast("int").cast("string")))
    return F.when(plain, made).otherwise(v)


def _date(key: str, v: Column, back: bool) -> Column:
    # Parts by the form: year-month-day, day.month.year, month/day/year.
    iso, dotted = v.substr(5, 1) == "-", v.substr(3, 1) == "."
    part = lambda *at: F.when(iso, v.substr(*at[0])).when(dotted, v.substr(*at[1])).otherwise(v.substr(*at[2]))
    day = F.try_to_date(F.concat_ws("-", part((1, 4), (7, 4), (7, 4)), part((6, 2), (4, 2), (1, 2)), part((9, 2), (1, 2), (4, 2))), "yyyy-MM-dd")
    n = F.datediff(day, F.lit(_EPOCH).cast("date"))
    l, r = feistel(key, F.floor(n / _GRID[1]), n % _GRID[1], F.lit(_GRID[0]), F.lit(_GRID[1]), back)
    made = F.date_add(F.lit(_EPOCH).cast("date"), (l * _GRID[1] + r).cast("int")).cast("string")
    y, m, d = made.substr(1, 4), made.substr(6, 2), made.substr(9, 2)
    shown = F.when(iso, made).when(dotted, F.concat_ws(".", d, m, y)).otherwise(F.concat_ws("/", m, d, y))
    return F.when(day.isNotNull() & (n >= 0) & (n < _DAYS), shown).otherwise(v)


def _phone(key: str, v: Column, back: bool) -> Column:
    d = _digits(v)
    n = F.least(F.length(d) - 1, F.lit(10))
    head = F.substring(d, F.lit(1), F.length(d) - n)
    made = F.concat(head, permute_digits(key, F.substring(d, F.length(d) - n + 1, n), back))
    return F.when(F.length(d).between(7, 15), _in_form_of(v, made)).otherwise(v)


def _email(key: str, v: Column, back: bool) -> Column:
    local, host = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
    return v if back else F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws(":", F.lit(key), F.lower(local), F.lower(host)), 256), 1, 16), F.lit("@"), host)


_PERMUTE = {"email": _email, "card": _card, "ssn": _ssn, "ip": _ip, "date": _date, "phone": _phone}


def pseudonymise(docs: DataFrame, key: str, kinds: tuple[str, ...] = KINDS, text_col: str = "text", text_as: str = "masked", back: bool = False) -> DataFrame:
    """``docs`` with ``text_as`` and, for each kind, its number of candidates ``n_<kind>``; ``back`` restores.

    One pattern finds candidates of all kinds, leftmost first and in the order of ``kinds``. The text is the
    pieces between candidates, each followed by the next candidate's pseudonym.
    """
    whole = "|".join(f"(?:{PATTERNS[k]})" for k in kinds)
    text = F.col(text_col)
    is_kind = {k: lambda v, k=k: v.rlike(f"^(?:{PATTERNS[k]})$") for k in kinds}

    def permuted(v: Column) -> Column:
        out = None
        for k in kinds:
            made = _PERMUTE[k](f"{key}:{k}", v, back)
            out = F.when(is_kind[k](v), made) if out is None else out.when(is_kind[k](v), made)
        return out.otherwise(v)

    found_as, kinds_as = (next(n for k in range(len(docs.columns) + 1) if (n := f"{name}{k or ''}") not in docs.columns) for name in ("_found", "_kinds"))
    has = text.rlike(whole)
    found = docs.withColumn(found_as, F.when(has, F.regexp_extract_all(text, F.lit(whole), F.lit(0))))
    pieces = F.zip_with(F.split(text, whole, -1), F.transform(found_as, permuted), lambda p, m: F.concat(p, F.coalesce(m, F.lit(""))))
    first = F.when(text.isNotNull(), F.lit(0))
    # A candidate that fits several kinds counts for the first of them.
    kind_of = F.transform(found_as, lambda v: F.coalesce(*[F.when(is_kind[k](v), F.lit(k)) for k in kinds]))
    counted = found.withColumns({text_as: F.when(F.col(found_as).isNull(), text).otherwise(F.array_join(pieces, "")), kinds_as: kind_of})
    of = lambda k: F.size(F.filter(kinds_as, lambda x: x == k))
    counts = {f"n_{k}": F.when(F.col(kinds_as).isNotNull(), of(k)).otherwise(first) for k in kinds}
    return counted.withColumns(counts).drop(found_as, kinds_as)


def pseudonym_key(spark: SparkSession) -> str:
    """The session's ``spark.quarry.pseudonym.key``; where none is set, a fresh key that links values within this run alone."""
    return spark.conf.get("spark.quarry.pseudonym.key", None) or secrets.token_hex(16)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pseudonymise(docs, pseudonym_key(spark)).drop("text")
