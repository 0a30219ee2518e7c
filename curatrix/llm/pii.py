"""Format-preserving Feistel pseudonyms for personal data, in SQL functions only.

One pattern finds candidates; each is validated by its kind and then permuted within its format by a keyed
Feistel network: digits stay digits, letters stay letters of their case, separators stay in place. Equal values
get equal pseudonyms in every document (under one key), also when separators or case differ.

kind | validated by | permuted
card | 13 to 19 digits, Luhn sum | all digits but the last, which is set anew so that the sum holds
iban | mod 97 | everything after the check digits, which are set anew
ssn | area, group and serial in range | all digits
phone | 10 to 15 digits in a phone's punctuation, or after a plus | all digits but a country code
ip | four octets | the octets
date | a day of the years 1800 to 2199 | the day among those 146,097 days
mac, key, token | their forms | letters and digits
password | a digit in the value after its label | letters and digits
email | its form | all but the last domain label

Null texts stay null; empty and clean texts are unchanged, and so are numbers that no kind validates.
Rows are independent: ties, repeats and very long texts need nothing more. Other columns are kept, whatever their names; one named like
the counting column is replaced. The key must be given. It enters the plan as a scalar subquery over a local table, so no plan, log or event shows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 6
#: The setting that holds the key; Spark redacts settings with "secret" in their names.
SETTING = "spark.curatrix.pii.secret"
# Country codes of one and two digits in international phone numbers; all others have three.
COUNTRY = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|53|54|55|56|57|58|60|61|62|63|64|65|66|81|82|84|86|90|91|92|93|94|95|98"
#: Days in 400 years are 189 * 773: the two halves of the network for dates.
EPOCH, HALVES = "1800-01-01", (189, 773)

_HEX = r"(?<![\p{L}\p{N}_])(?=[0-9a-fA-F]*[a-fA-F])(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{16,64}(?![\p{L}\p{N}_])"
_SECRET = r"(?<![\p{L}\p{N}_])(?i:password|passwd|pwd|secret|token|api[_-]?key)(?:\s?[=:]\s?)[\"']?(?=[^\s\"'!#$%&*0-9]*[0-9])[^\s\"'!#$%&*]{6,}"
#: Candidates, in order of precedence at a place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": _SECRET,
    "key": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,60}|sk-[A-Za-z0-9]{20,60})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "mac": r"(?<![0-9A-Fa-f:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:-])",
    "token": _HEX,
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}(?:/[0-9]{1,2}/|\.[0-9]{1,2}\.|-[0-9]{1,2}-)[0-9]{4})(?![0-9/-]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9.-])(?:[0-9]{13,19}|[0-9]{4}(?:([ -])[0-9]{4})(?:\1[0-9]{4})(?:\1[0-9]{1,7})|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9]|[.-][0-9])",
    "phone": r"(?<![0-9(+.-])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?(?:[0-9]{1,4}[ .-]?){1,4}[0-9]{2,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}([ .-])[0-9]{3}\3[0-9]{4})(?![0-9]|[.-][0-9])",
}


def _pattern() -> str:
    out, groups = [], 0
    for p in PATTERNS.values():
        own = p.count("([ ")
        out.append(p)
        groups += own
    return "|".join(out)


#: All candidates. Groups are numbered over the whole pattern: 1 and 2 in card, 3 in phone.
PATTERN = _pattern()
#: Texts without such a character have no candidate.
ANY = "[0-9@=:]|AKIA|gh[pousr]_|sk-"


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(x: str, kind: str) -> str:
    p = PATTERNS[kind]
    return f"({x} rlike {_quote('^(?:' + p + ')$')})"


def _byte(h: str, i: str) -> str:
    return f"cast(conv(substring({h}, 2 * (({i} - 1) % 32) + 1, 2), 16, 10) as int)"


def _shift(c: str, b: str, hexa: bool) -> str:
    if hexa:
        of = "'0123456789abcdef'"
        return f"if({c} rlike '[0-9a-f]', substring({of}, pmod(instr({of}, {c}) - 1 + {b}, 16) + 1, 1), {c})"
    turn = lambda base, n: f"char({base} + pmod(ascii({c}) - {base} + {b}, {n}))"
    return f"case when {c} rlike '^[0-9]$' then {turn(48, 10)} when {c} rlike '^[a-z]$' then {turn(97, 26)} when {c} rlike '^[A-Z]$' then {turn(65, 26)} else {c} end"


def permuted(s: str, tag: str, key: str, hexa: bool = False) -> str:
    """SQL for the keyed permutation of string s, character class by character class; key is SQL too. Hexadecimal strings keep one case."""
    if hexa:
        return f"transform(array(named_struct('s', {s})), w -> if(w.s rlike '[A-F]', upper({_network('lower(w.s)', tag, key, True)}), {_network('w.s', tag, key, True)}))[0]"
    return _network(s, tag, key, False)


def _network(s: str, tag: str, key: str, hexa: bool) -> str:
    half = f"(length({s}) div 2)"
    seed = f"sha2(concat({key}, {_quote('|' + tag + '|')}, k, '|', length({s}), '|', lower(acc.r)), 256)"
    one = _shift("substring(x.l, i, 1)", _byte("x.h", "i"), hexa)
    added = f"transform(array(named_struct('l', acc.l, 'h', {seed})), x -> if(length(x.l) = 0, '', array_join(transform(sequence(1, greatest(1, length(x.l))), i -> {one}), '')))[0]"
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('l', substring({s}, 1, {half}), 'r', substring({s}, {half} + 1)),"
        f" (acc, k) -> named_struct('l', acc.r, 'r', {added}), acc -> concat(acc.l, acc.r))"
    )


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _placed(x: str, digits: str) -> str:
    """x with its digits replaced by those of the other string, in order."""
    at = f"length({_digits('substring(y.x, 1, i)')})"
    return f"transform(array(named_struct('x', {x}, 'd', {digits})), y -> array_join(transform(sequence(1, length(y.x)), i -> if(substring(y.x, i, 1) rlike '[0-9]', substring(y.d, {at}, 1), substring(y.x, i, 1))), ''))[0]"


def luhn(digits: str) -> str:
    """SQL for the Luhn sum of a digit string, modulo 10."""
    d = f"cast(substring(reverse({digits}), i, 1) as int)"
    return f"(aggregate(transform(sequence(1, length({digits})), i -> if(i % 2 = 1, {d}, (2 * {d}) div 10 + (2 * {d}) % 10)), cast(0 as bigint), (a, b) -> a + b) % 10)"


def mod97(iban: str) -> str:
    """SQL for an IBAN's remainder: 1 if it is valid. Spaces must be gone."""
    turned = f"concat(substring({iban}, 5), substring({iban}, 1, 4))"
    value = "instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1"
    return f"aggregate(filter(split({turned}, ''), c -> c <> ''), 0, (a, c) -> pmod(if({value} > 9, 100, 10) * a + {value}, 97))"


def _luhn_card(x: str, key: str) -> str:
    d = _digits(x)
    body = f"transform(array({permuted(f'substring({d}, 1, length({d}) - 1)', 'card', key)}), p -> concat(p, cast(pmod(10 - {luhn('concat(p, 0)')}, 10) as string)))[0]"
    return _placed(x, body)


def _iban(x: str, key: str) -> str:
    packed = f"replace({x}, ' ', '')"
    body = f"transform(array(concat(substring({packed}, 1, 2), '00', {permuted(f'substring({packed}, 5)', 'iban', key)})), p -> concat(substring(p, 1, 2), lpad(cast(98 - {mod97('p')} as string), 2, '0'), substring(p, 5)))[0]"
    put = "array_join(transform(sequence(1, length(y.x)), i -> if(substring(y.x, i, 1) = ' ', ' ', substring(y.d, length(replace(substring(y.x, 1, i), ' ', '')), 1))), '')"
    return f"transform(array(named_struct('x', {x}, 'd', {body})), y -> {put})[0]"


def _ip(x: str, key: str) -> str:
    o = f"transform(split({x}, '[.]'), q -> cast(q as int))"
    seed = f"sha2(concat({key}, '|ip|', k, '|', acc[2], '.', acc[3]), 256)"
    step = f"transform(array({seed}), h -> array(acc[2], acc[3], pmod(acc[0] + {_byte('h', '1')}, 256), pmod(acc[1] + {_byte('h', '2')}, 256)))[0]"
    return f"aggregate(sequence(1, {ROUNDS}), {o}, (acc, k) -> {step}, acc -> array_join(transform(acc, q -> cast(q as string)), '.'))"


def _ymd(x: str) -> str:
    """SQL for (kind of order, date) of a date's text; the date is null if there is no such day."""
    p = f"split({x}, '[./-]')"
    day = lambda y, m, d: f"try_cast(concat(lpad({p}[{y}], 4, '0'), '-', lpad({p}[{m}], 2, '0'), '-', lpad({p}[{d}], 2, '0')) as date)"
    return f"case when {x} rlike '^[0-9]{{4}}-' then named_struct('o', 'ymd', 'd', {day(0, 1, 2)}) when {x} rlike '/' and {day(2, 0, 1)} is not null then named_struct('o', 'mdy', 'd', {day(2, 0, 1)}) else named_struct('o', 'dmy', 'd', {day(2, 1, 0)}) end"


def _in_range(d: str) -> str:
    n = HALVES[0] * HALVES[1]
    return f"({d} is not null and datediff({d}, date'{EPOCH}') between 0 and {n - 1})"


def _date(x: str, key: str) -> str:
    a, b = HALVES
    f = lambda v, n: f"cast(conv(substring(sha2(concat({key}, '|date|', k, '|', {n}, '|', {v}), 256), 1, 12), 16, 10) as bigint)"
    right = f"pmod(acc.r + {f('acc.l', 0)}, {b})"
    step = f"transform(array({right}), r -> named_struct('l', pmod(acc.l + {f('r', 1)}, {a}), 'r', r))[0]"
    n = f"datediff(y.d, date'{EPOCH}')"
    day = f"aggregate(sequence(1, {ROUNDS // 2}), named_struct('l', cast({n} div {b} as bigint), 'r', cast({n} % {b} as bigint)), (acc, k) -> {step}, acc -> date_add(date'{EPOCH}', cast(acc.l * {b} + acc.r as int)))"
    sep = f"regexp_extract({x}, '[./-]', 0)"
    wide = f"({x} rlike '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' or {x} rlike '^[0-9]{{2}}[./-][0-9]{{2}}[./-]')"
    num = lambda v: f"if({wide}, lpad(cast({v} as string), 2, '0'), cast({v} as string))"
    year, month, dom = "lpad(cast(year(z) as string), 4, '0')", num("month(z)"), num("day(z)")
    shown = f"case y.o when 'ymd' then concat_ws({sep}, {year}, {month}, {dom}) when 'mdy' then concat_ws({sep}, {month}, {dom}, {year}) else concat_ws({sep}, {dom}, {month}, {year}) end"
    return f"transform(array({_ymd(x)}), y -> if({_in_range('y.d')}, transform(array({day}), z -> {shown})[0], {x}))[0]"


def _hexish(x: str) -> str:
    return f"({x} rlike '^[0-9a-fA-F]+$')"


def pseudonym(x: str, key: str) -> str:
    """SQL for the pseudonym of one candidate, under SQL for the key."""
    d = _digits(x)
    country = f"if({x} rlike '^[+]', regexp_extract({d}, '^({COUNTRY}|[0-9][0-9][0-9])', 1), '')"
    phone = f"concat({country}, {permuted(f'substring({d}, length({country}) + 1)', 'phone', key)})"
    head = f"regexp_extract({x}, {_quote('^(?i:password|passwd|pwd|secret|token|api[_-]?key)(?:[ \\t\\n]?[=:][ \\t\\n]?)[\"\\x27]?')}, 0)"
    value = f"substring({x}, length({head}) + 1)"
    secret = f"concat({head}, if({_hexish(value)}, {permuted(value, 'token', key, True)}, {permuted(value, 'secret', key)}))"
    label = f"regexp_extract({x}, '[.][A-Za-z]+$', 0)"
    email = f"concat({permuted(f'substring({x}, 1, length({x}) - length({label}))', 'email', key)}, {label})"
    stem = f"regexp_extract({x}, '^(AKIA|gh[pousr]_|sk-)', 0)"
    api = f"concat({stem}, {permuted(f'substring({x}, length({stem}) + 1)', 'key', key)})"
    ssn = f"not ({x} rlike '^(000|666|9..)|-00-|-0000$')"
    return f"""case
 when {_matches(x, 'email')} then {email}
 when {_matches(x, 'secret')} then {secret}
 when {_matches(x, 'key')} then {api}
 when {_matches(x, 'iban')} and {mod97(f"replace({x}, ' ', '')")} = 1 then {_iban(x, key)}
 when {_matches(x, 'mac')} then {permuted(x, 'mac', key, True)}
 when {_matches(x, 'token')} then {permuted(x, 'token', key, True)}
 when {_matches(x, 'ip')} then {_ip(x, key)}
 when {_matches(x, 'date')} then {_date(x, key)}
 when {_matches(x, 'ssn')} and {ssn} then {_placed(x, permuted(d, 'ssn', key))}
 when {x} rlike '^[0-9][0-9 -]+$' and length({d}) between 13 and 19 then if({luhn(d)} = 0, {_luhn_card(x, key)}, {x})
 when length({d}) between 10 and 15 and {x} rlike '^([+(]|[0-9]+[ .-])[0-9 .()-]+$' then {_placed(x, phone)}
 else {x} end"""


def key_of(spark: SparkSession, default: str | None = None) -> str:
    """The key in the session's setting, or the default."""
    key = spark.conf.get(SETTING, None) or default
    if not key:
        raise ValueError(f"{SETTING} is not set")
    return key


def pseudonymise(df: DataFrame, text: str = "text", key: str | None = None, count: str | None = "n_replaced") -> DataFrame:
    """df with pseudonyms in its text column, and with the number of values that were replaced unless count is None. No key: the setting's."""
    spark = df.sparkSession
    given = spark.createDataFrame([(key or key_of(spark),)], "key string")
    t = F.col(f"`{text}`")
    free = lambda name: next(n for n in (name + "_" * k for k in range(len(df.columns) + 1)) if n not in df.columns)
    found, new, held = map(free, ("_found", "_new", "_key"))
    values = F.when(t.rlike(ANY), F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    made = df.withColumns({found: values, held: given.scalar()})
    made = made.withColumn(new, F.expr(f"transform({found}, m -> {pseudonym('m', held)})"))
    parts = F.split(t, PATTERN, -1)
    whole: Column = F.array_join(F.flatten(F.zip_with(parts, new, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    made = made.withColumn(text, F.when(F.size(found) > 0, whole).otherwise(t))
    if count:
        differ = F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x))
        made = made.withColumn(count, F.coalesce(differ, F.lit(0)).cast("long"))
    return made.drop(found, new, held)
