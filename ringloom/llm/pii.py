"""PII: format-preserving Feistel pseudonyms, in Spark SQL expressions only.

Values that validate are replaced by a keyed permutation of their format, so
that equal values stay equal in all documents, whatever marks they are written
with, and different ones stay different:

- card numbers (13 to 19 digits, or groups 4-4-4-4 or 4-6-5, that pass Luhn): all digits between the first and the check
  digit are permuted, and the check digit is computed anew;
- phone numbers (with + and a country code, or three groups 3-3-4) and 3-2-4 social
  security numbers: the digits after the country code, which is told by the digits alone. Of ten
  digits the first is permuted within 0-1 or 2-9, so an area code stays one that is in use;
- IPv4 addresses (octets up to 255): permuted as 32 bits;
- ISO dates that exist, 1800-01-01 to 2199-12-31: permuted as days of that 400-year cycle;
- e-mail addresses (the part before @), access keys, and hexadecimal secrets after
  token, password, secret or key in any case: characters within their classes. Secrets that
  differ only in case are equal; a pseudonym is upper-case where the secret has only upper-case letters.

A Feistel network takes turns: one half's characters are shifted, each in its class, by
bytes of SHA-256 over the key, the kind, the round and the other half. IPv4
addresses and dates use the same with two numbers modulo the sizes of the halves.

A null text stays null and an empty one empty, with no values. One row per input row, ids
null or not, repeated or not; an empty table gives an empty one. Texts of any length are handled as
a whole. Numbers of the 3-2-4 format are replaced whether or not they were ever given out: one left
in the clear is worse than one replaced in vain. Columns of the caller, whatever their names, stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ROUNDS = 8
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: Kinds with their patterns, in order of preference. Each starts where no character of the value can lie before it.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])",
    "date": r"(?<![0-9-])(?:1[89]|2[01])[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?!-?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-?[0-9])",
    "phone": r"(?<![0-9+])\+[1-9][0-9]{0,2}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}(?!-?[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "key": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?<=(?i:token|password|passwd|secret|key) ?[=:] ?[\"']?)[0-9A-Fa-f]{16,64}(?![0-9A-Za-z])",
}
_ANY = "|".join(PATTERNS.values())
#: What every value has, a secret before it: a text without any of these has none.
_TRIGGER = "[0-9@=:]|AKIA"
#: Country codes: 1, 7, those of two digits, and all else three; none is the start of another.
_COUNTRY = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _rounds(start: str, odd: str, even: str) -> str:
    """Fold of ROUNDS over struct(a, b): odd rounds change a, even ones b."""
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> if(r % 2 = 1, named_struct('a', {odd}, 'b', s.b), named_struct('a', s.a, 'b', {even})))"


def _digest(key: str, kind: str, other: str) -> str:
    return f"sha2(concat_ws('|', {_lit(key)}, '{kind}', cast(r as string), {other}), 256)"


def _shifted(half: str, digest: str, hexadecimal: bool) -> str:
    """Each character moved in its class by the digest's byte of its place (32 places, then again)."""
    byte = f"cast(conv(substring(d, 2 * (i % 32) + 1, 2), 16, 10) as int) + i div 32"
    if hexadecimal:
        moved = f"substring('0123456789abcdef', 1 + (locate(c, '0123456789abcdef') - 1 + {byte}) % 16, 1)"
    else:
        turn = lambda low, n: f"char({low} + (ascii(c) - {low} + {byte}) % {n})"
        moved = f"case when c rlike '^[0-9]$' then {turn(48, 10)} when c rlike '^[a-z]$' then {turn(97, 26)} when c rlike '^[A-Z]$' then {turn(65, 26)} when c rlike '^[\\\\x01-\\\\x08]$' then {turn(1, 8)} when c rlike '^[\\\\x0E\\\\x0F]$' then {turn(14, 2)} else c end"
    chars = f"filter(split({half}, ''), z -> z <> '')"
    return f"array_join(zip_with(transform({chars}, (c, i) -> struct(c, i)), array_repeat({digest}, length({half})), (x, d) -> element_at(transform(array(x), y -> {moved.replace('(c,', '(y.c,').replace('(c)', '(y.c)').replace('when c ', 'when y.c ').replace('else c ', 'else y.c ').replace('(i %', '(y.i %').replace(' i div', ' y.i div')}), 1)), '')"


def permuted(value: str, kind: str, key: str, hexadecimal: bool = False) -> str:
    """SQL: the string value with its letters and digits permuted within their classes."""
    half = f"length({value}) div 2"
    start = f"named_struct('a', substring({value}, 1, {half}), 'b', substring({value}, 1 + {half}, 64))"
    out = _rounds(start, _shifted("s.a", _digest(key, kind, "s.b"), hexadecimal), _shifted("s.b", _digest(key, kind, "s.a"), hexadecimal))
    return f"element_at(transform(array({out}), q -> concat(q.a, q.b)), 1)"


def permuted_pair(a: str, b: str, m: int, n: int, kind: str, key: str) -> str:
    """SQL: struct(a, b) of numbers below m and n, permuted."""
    number = lambda other, size: f"cast(conv(substring({_digest(key, kind, other)}, 1, 12), 16, 10) as bigint) % {size}"
    start = f"named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint))"
    return _rounds(start, f"(s.a + {number('cast(s.b as string)', m)}) % {m}", f"(s.b + {number('cast(s.a as string)', n)}) % {n}")


def _luhn(digits: str, odd: str) -> str:
    """SQL: the Luhn sum; digits whose place from the end has the parity `odd` are doubled."""
    d = "cast(c as int)"
    return f"aggregate(transform(filter(split(reverse({digits}), ''), z -> z <> ''), (c, i) -> if(i % 2 = {odd}, {d} * 2 - if({d} > 4, 9, 0), {d})), 0, (t, x) -> t + x)"


def _filled(value: str, digits: str) -> str:
    """SQL: value with its digits replaced, one after another."""
    return f"aggregate(filter(split({value}, ''), z -> z <> ''), named_struct('o', '', 'i', 1), (s, c) -> if(c rlike '^[0-9]$', named_struct('o', concat(s.o, substring({digits}, s.i, 1)), 'i', s.i + 1), named_struct('o', concat(s.o, c), 'i', s.i)), s -> s.o)"


def _let(name: str, value: str, body: str) -> str:
    """SQL: body with name bound to value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def pseudonym(m: str, kind: str, key: str) -> str:
    """SQL: the pseudonym of the value m of a kind; m itself where it doesn't validate."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    if kind == "card":
        middle = permuted("substring(v, 2, length(v) - 2)", kind, key)
        made = _let("w", f"concat(substring(v, 1, 1), {middle})", f"concat(w, cast((10 - {_luhn('w', '0')} % 10) % 10 as string))")
        return _let("v", digits, f"if({_luhn('v', '1')} % 10 = 0, {_filled(m, made)}, {m})")
    if kind in ("phone", "ssn"):
        country = f"if(startswith({m}, '+'), regexp_extract(v, '^({_COUNTRY})', 1), '')"
        # ten digits: the first as one of eight characters, or of two
        first = "cast(substring(u, 1, 1) as int)"
        ten = _let("y", f"concat(char(if({first} >= 2, {first} - 1, {first} + 14)), substring(u, 2, 64))", _let("x", permuted("y", kind, key), "concat(cast(if(ascii(x) <= 8, ascii(x) + 1, ascii(x) - 14) as string), substring(x, 2, 64))"))
        made = _let("w", country, f"concat(w, {_let('u', 'substring(v, 1 + length(w), 64)', f'if(length(u) = 10, {ten}, {permuted(chr(117), kind, key)})')})")
        return _let("v", digits, _let("q", made, _filled(m, "q")))
    if kind == "ip":
        octet = lambda i: f"cast(element_at(split({m}, '[.]'), {i}) as bigint)"
        pair = permuted_pair(f"{octet(1)} * 256 + {octet(2)}", f"{octet(3)} * 256 + {octet(4)}", 65536, 65536, kind, key)
        return _let("v", pair, "concat_ws('.', v.a div 256, v.a % 256, v.b div 256, v.b % 256)")
    if kind == "date":
        # 400 years of the calendar are 146,097 = 189 * 773 days
        day = f"datediff(try_to_date({m}, 'yyyy-MM-dd'), DATE'1800-01-01')"
        pair = _let("v", day, permuted_pair("v div 773", "v % 773", 189, 773, kind, key))
        return f"if(try_to_date({m}, 'yyyy-MM-dd') is null, {m}, {_let('w', pair, 'cast(date_add(DATE' + _lit('1800-01-01') + ', cast(w.a * 773 + w.b as int)) as string)')})"
    if kind == "email":
        return f"concat({permuted(f'substring_index({m}, ' + _lit('@') + ', 1)', kind, key)}, '@', substring_index({m}, '@', -1))"
    if kind == "key":
        return f"concat('AKIA', {permuted(f'substring({m}, 5, 16)', kind, key)})"
    return _let("u", permuted(f"lower({m})", kind, key, hexadecimal=True), f"if({m} rlike '[A-F]' and not {m} rlike '[a-f]', upper(u), u)")


def _kind(m: str) -> str:
    """SQL: the kind of a found value, told by its own shape."""
    return (
        f"case when {m} like '%@%' then 'email' when startswith({m}, 'AKIA') then 'key' when {m} rlike '^([0-9]{{1,3}}[.]){{3}}[0-9]{{1,3}}$' then 'ip'"
        f" when {m} rlike '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' then 'date' when {m} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then 'ssn'"
        f" when startswith({m}, '+') or length(regexp_replace({m}, '[^0-9]', '')) = 10 and not {m} rlike '[A-Fa-f]' then 'phone'"
        f" when {m} rlike '^[0-9 -]+$' then 'card' else 'secret' end"
    )


def _free(name: str, taken: list[str]) -> str:
    """name, with underscores until no column is called so."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def pseudonymised(docs: DataFrame, key: str, values: str = "__values") -> DataFrame:
    """All columns of docs, with text pseudonymised, plus the kinds of replaced values in a column
    called `values` (with underscores after it where docs has such a column)."""
    m, p = _free("__m", docs.columns), _free("__p", docs.columns)
    text = F.col("text").cast("string")
    marked = docs.withColumn("text", text).withColumn(m, F.when(text.rlike(_TRIGGER), F.expr(f"regexp_extract_all(text, {_lit(_ANY)}, 0)")).otherwise(F.array().cast("array<string>")))
    cases = " ".join(f"when k = '{k}' then {pseudonym('m', k, key)}" for k in PATTERNS)
    made = marked.withColumn(p, F.expr(f"transform({m}, m -> {_let('k', _kind('m'), f'named_struct({_lit('k')}, k, {_lit('m')}, m, {_lit('p')}, case {cases} end)')})"))
    pieces = f"zip_with(split(text, {_lit(_ANY)}, -1), array_append(transform({p}, x -> x.p), ''), (a, b) -> concat(a, b))"
    made = made.withColumn("text", F.expr(f"if(size({m}) = 0, text, array_join({pieces}, ''))"))
    return made.withColumn(_free(values, docs.columns), F.expr(f"transform(filter({p}, x -> x.p <> x.m), x -> x.k)")).drop(m, p)


#: Used where spark.ringloom.pii.key is not set: for tests only, as anyone can undo it.
KEY = "ringloom"


def key_of(spark: SparkSession) -> str:
    """The secret of the permutation, from the session's setting spark.ringloom.pii.key."""
    return spark.conf.get("spark.ringloom.pii.key", KEY)


def pseudonymise(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text, n_values, kinds (sorted, distinct). Other columns are
    not looked at. key: the secret of the permutation; else the session's."""
    out = pseudonymised(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), key or key_of(docs.sparkSession))
    return out.select("doc_id", "text", F.size("__values").cast("long").alias("n_values"), F.array_sort(F.array_distinct("__values")).alias("kinds"))


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"))
