"""Format-preserving pseudonyms for personal data, in SQL expressions only.

Each value found is validated and then moved within its own format by a keyed Feistel
permutation: a card number becomes another valid card number, a date another date. Equal
values get equal pseudonyms in every document, and different values different ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clustrial.llm.names import unused_name

ROUNDS = 8  # even, so that halves of unequal length come back in order
DIGITS, HEX, ALNUM = "0123456789", "0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyz"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_MONTH, _DAY, _YEAR = r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])", r"(?:1[89]|2[01])\d\d"
#: kind and pattern; of several that match at a place, the first holds. A match has a digit or an @.
PATTERNS: dict[str, str] = {
    # A domain has at most 127 labels; a group repeated without bound would recurse.
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,}+",
    "token": r"(?<![0-9A-Za-z])(?=[A-Fa-f]*+[0-9])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "iso_date": rf"(?<!\d)(?<!\d-){_YEAR}-{_MONTH}-{_DAY}(?!-?\d)",
    "day_date": rf"(?<!\d)(?<!\d/){_DAY}/{_MONTH}/{_YEAR}(?!/?\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?|\(\d{3}\) ?)\d{3,4}[ .-]?\d{3,4}(?!\d)",
    "ssn": r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?!-?\d)",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,4}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
}
COMBINED = "|".join(f"(?:{p})" for p in PATTERNS.values())
FIRST_DAY = "date'1800-01-01'"  # 400 years from here are 146097 = 189 * 773 days


def _text(value: str) -> str:
    return "r'" + value + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL that computes ``value`` once and uses it in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _chars(text: str) -> str:
    return f"filter(split({text}, ''), c -> c <> '')"


def _moved(text: str, stream: str, alphabet: str) -> str:
    """Each character of ``text`` moved along the alphabet by a byte of the hash ``stream``.

    The characters are taken apart once, and the hash is computed once: time grows with the
    length, not with its square.
    """
    step = "cast(conv(substr(bytes, (p % 32) * 2 + 1, 2), 16, 10) as int)"
    place = f"(locate(x, '{alphabet}') - 1 + {step}) % {len(alphabet)}"
    moved = f"array_join(transform({_chars(text)}, (x, p) -> substr('{alphabet}', {place} + 1, 1)), '')"
    return _let("bytes", stream, moved)


def permuted(text: str, alphabet: str, key: str, tweak: str) -> str:
    """SQL for the keyed permutation of strings over ``alphabet`` that keeps their length."""
    stream = f"sha2(concat_ws('|', {_text(key)}, '{tweak}', turn, half.b), 256)"
    turned = f"named_struct('a', half.b, 'b', {_moved('half.a', stream, alphabet)})"
    cut = f"cast(length({text}) / 2 as int)"
    halves = f"named_struct('a', substr({text}, 1, {cut}), 'b', substr({text}, {cut} + 1))"
    return f"aggregate(sequence(1, {ROUNDS}), {halves}, (half, turn) -> {turned}, half -> concat(half.a, half.b))"


def _permuted_day(day: str, key: str) -> str:
    """SQL for the keyed permutation of day numbers 0..146096."""

    def shift(other: str, size: int) -> str:
        stream = f"sha2(concat_ws('|', {_text(key)}, 'day', turn, half.{other}), 256)"
        return f"cast(conv(substr({stream}, 1, 12), 16, 10) as bigint) % {size}"

    left = f"named_struct('a', (half.a + {shift('b', 189)}) % 189, 'b', half.b)"
    right = f"named_struct('a', half.a, 'b', (half.b + {shift('a', 773)}) % 773)"
    start = f"named_struct('a', cast(({day}) % 189 as bigint), 'b', cast(({day}) div 189 as bigint))"
    return (
        f"aggregate(sequence(1, {ROUNDS}), {start}, (half, turn) -> if(turn % 2 = 1, {left}, {right}), "
        "half -> cast(half.b * 189 + half.a as int))"
    )


def _only(text: str, alphabet: str) -> str:
    return f"regexp_replace({text}, '[^{alphabet}]', '')"


def _put_back(text: str, new: str, alphabet: str) -> str:
    """``text`` with its characters of the alphabet replaced, in order, by those of ``new``."""
    between = f"split({text}, '[{alphabet}]', -1)"
    return f"array_join(zip_with({between}, concat({_chars(new)}, array('')), (s, c) -> concat(s, c)), '')"


def _check_digit(payload: str) -> str:
    digit = f"cast(substr({payload}, -c, 1) as int)"
    value = f"if(c % 2 = 1, 2 * {digit} - if({digit} > 4, 9, 0), {digit})"
    total = f"aggregate(sequence(1, length({payload})), 0, (total, c) -> total + {value})"
    return f"cast((10 - {total} % 10) % 10 as string)"


def _pseudonym(key: str) -> str:
    """SQL for what replaces the match ``m``; a match that fails its validation stays."""
    local = "lower(substring_index(m, '@', 1))"
    email = _let(
        "own", local,
        _let("fresh", permuted(_only("own", "a-z0-9"), ALNUM, key, "email"),
             f"concat({_put_back('own', 'fresh', ALNUM)}, '@', substring_index(m, '@', -1))"),
    )
    token = _let("fresh", permuted("lower(m)", HEX, key, "token"), "if(m = upper(m), upper(fresh), fresh)")
    octets = "split(m, '[.]')"
    as_hex = f"array_join(transform({octets}, o -> lpad(lower(hex(cast(o as int))), 2, '0')), '')"
    ip = _let(
        "fresh", permuted(as_hex, HEX, key, "ip"),
        "array_join(transform(sequence(0, 3), o -> conv(substr(fresh, 2 * o + 1, 2), 16, 10)), '.')",
    )

    def date(pattern: str) -> str:
        moved = f"date_format(date_add({FIRST_DAY}, {_permuted_day('day', key)}), '{pattern}')"
        # Days that a month lacks fail the conversion and stay as they are.
        day = f"datediff(cast(try_to_timestamp(m, '{pattern}') as date), {FIRST_DAY})"
        return _let("day", day, f"if(day is null, m, {moved})")

    country = r"regexp_extract(m, r'^\+\d{1,3}(?=[ .(-])', 0)"
    phone = _let(
        "own", f"substr(m, length({country}) + 1)",
        _let("fresh", permuted(_only("own", "0-9"), DIGITS, key, "phone"),
             f"concat({country}, {_put_back('own', 'fresh', DIGITS)})"),
    )
    valid = "(s rlike '^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$')"
    walked = f"aggregate(sequence(1, 64), {_only('m', '0-9')}, (s, walk) -> if(walk > 1 and {valid}, s, {permuted('s', DIGITS, key, 'ssn')}))"
    ssn = _let("fresh", walked, _put_back("m", "fresh", DIGITS))
    payload = "substr(own, 1, length(own) - 1)"
    card = _let(
        "own", _only("m", "0-9"),
        f"if(right(own, 1) <> {_check_digit(payload)}, m, "
        + _let("body", permuted(payload, DIGITS, key, "card"),
               _let("fresh", f"concat(body, {_check_digit('body')})", _put_back("m", "fresh", DIGITS)))
        + ")",
    )
    made = {
        "email": email, "token": token, "ip": ip, "iso_date": date("yyyy-MM-dd"),
        "day_date": date("dd/MM/yyyy"), "phone": phone, "ssn": ssn, "card": card,
    }
    cases = " ".join(
        f"when m rlike {_text('^(?:' + PATTERNS[kind] + ')$')} then named_struct('kind', '{kind}', 'new', {sql})"
        for kind, sql in made.items()
    )
    return f"case {cases} else named_struct('kind', '', 'new', m) end"


def pseudonymise(
    df: DataFrame, key: str, text_column: str = "text", found_column: str = "pii_found"
) -> DataFrame:
    """``df`` with personal data in its text replaced, and an array of what was replaced.

    All columns stay; ``found_column`` has a struct ``kind, old, new`` for each value
    replaced, in order. It takes the place of a column of that name. Kinds: mail addresses
    (the local part moves), secret tokens of 32 hexadecimal digits or more, IPv4 addresses,
    dates of 1800 to 2199, phone numbers after their country code, social security numbers
    and card numbers. Numbers that fail their check digit, and days that no month has, stay.
    Missing and empty texts stay as they are, repeated rows are changed alike, and an empty
    table stays empty. Time grows in proportion to a text, whatever it holds. Nothing is shuffled.

    ``key`` is the secret: the same key gives the same pseudonyms, in whatever separators a
    number is written.
    """
    text = F.col(text_column)
    combined = F.lit(COMBINED)
    hits, new = (unused_name(df, name) for name in ("hits", "new"))
    marked = df.withColumn(hits, F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, combined, F.lit(0))))
    marked = marked.withColumn(new, F.expr(f"transform(`{hits}`, m -> {_pseudonym(key)})"))
    between = F.split(text, COMBINED, -1)
    put = F.zip_with(
        between, F.concat(F.transform(new, lambda x: x["new"]), F.array(F.lit(""))), lambda a, b: F.concat(a, b)
    )
    pairs = F.zip_with(hits, new, lambda m, x: F.struct(x["kind"].alias("kind"), m.alias("old"), x["new"].alias("new")))
    changed = F.filter(pairs, lambda x: x["old"] != x["new"])
    nothing = F.array().cast("array<struct<kind:string,old:string,new:string>>")
    return marked.withColumns(
        {
            text_column: F.when(F.size(hits) > 0, F.array_join(put, "")).otherwise(text),
            found_column: F.coalesce(changed, nothing),
        }
    ).drop(hits, new)
