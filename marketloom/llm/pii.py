"""Surrogates for personal data, by DataFrame expressions alone.

Every detected entity is replaced by another of the same type, script, format and (for names after a title) gender.
Replacement is a keyed permutation of all strings with the entity's pattern of character classes, made so that nothing
maps to itself: it takes distinct entities to distinct surrogates, and equal ones to equal ones in every document, so
coreference holds without a lookup table. Whether it did is checked over a whole table's entities; a key under which
two of them met would be replaced by one derived from it.
"""

from __future__ import annotations

import itertools
import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import free_name, without_names, written

#: Titles that a person's name follows.
TITLES = "Mr|Mrs|Ms|Miss|Herr|Frau|Señor|Señora|Mme|Madame|Monsieur"
#: Detection patterns by type, tried in this order at each place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@(?:[A-Za-z0-9\-]{1,63}\.)+[A-Za-z]{2,24}",
    "secret": r"(?:(?<=[=:\"'])|(?<=[=:] ))(?<=\b(?i:token|password|passwd|secret|api_key|apikey) {0,3}[=:] {0,3}[\"']{0,1})[A-Za-z0-9+/_\-]{8,}",
    "cloud_key": r"\bA(?:KIA|SIA)[0-9A-Z]{16}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?!\w)|(?<![\w(])\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}(?!\w)|(?<![\w.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\w\-])",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "card": r"(?<![\w.\-])\d{4}(?:[ \-]?\d{4}){2}[ \-]?\d{1,7}(?![\w\-])",
    "person": rf"\p{{Lu}}(?<=\b(?:{TITLES})\.{{0,1}} .)\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A cheap test that every text with an entity passes.
HINT = rf"[0-9@=:]|A(?:KIA|SIA)[A-Z]|\b(?:{TITLES})\.? \p{{Lu}}"
#: Stands around entities while a text is taken apart; texts that hold it are taken apart the slower way.
MARK = "\u0001"
#: Given names by gender, for surrogates of persons whose given name is among them.
GIVEN_NAMES = {
    "f": (
        "Alice", "Amelia", "Anna", "Ana", "Beatrice", "Camille", "Carmen", "Charlotte", "Chloe", "Clara", "Claire", "Elena", "Elizabeth", "Emily", "Emma", "Eva", "Frida", "Grace", "Greta", "Hannah",
        "Heidi", "Helena", "Ingrid", "Isabel", "Jane", "Jeanne", "Jennifer", "Julia", "Karin", "Laura", "Lena", "Linda", "Louise", "Lucia", "Manon", "Margaret", "Maria", "Marie", "Marta", "Mary",
        "Nora", "Olivia", "Patricia", "Paula", "Pilar", "Rosa", "Ruth", "Sandra", "Sara", "Sarah", "Sofia", "Sophie", "Susan", "Teresa", "Ursula", "Vera", "Victoria", "Yvonne", "Zoe",
    ),
    "m": (
        "Adam", "Alexander", "Andrew", "Antonio", "Arthur", "Benjamin", "Bernard", "Bruno", "Carlos", "Charles", "Christian", "Daniel", "David", "Diego", "Dieter", "Edward", "Emil", "Felix", "Fernando", "Frank",
        "Frederic", "George", "Gustav", "Hans", "Henri", "Hugo", "Ivan", "Jack", "Jacques", "Jakob", "James", "Javier", "John", "Jonas", "Juan", "Julien", "Karl", "Leon", "Louis", "Luis",
        "Marco", "Mark", "Martin", "Max", "Michael", "Miguel", "Oliver", "Oscar", "Otto", "Paul", "Pedro", "Peter", "Pierre", "Robert", "Simon", "Stefan", "Thomas", "Victor", "William",
    ),
}
#: Country calling codes are 1, 7, these of two digits, and else three digits.
CALLING_CODE = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Rounds of the network on either side of the shift; steps that keep unlisted names off the lists; keys tried before giving up.
ROUNDS, WALK, KEYS = 3, 8, 5


def _alphabets() -> list[str]:
    """All letters beyond ASCII, upper and lower case apart, as alphabets of one script: the plain ones of Greek and Russian, and the others by block."""
    plain = ("αβγδεζηθικλμνξοπρσςτυφχψω", "абвгдежзийклмнопрстуфхцчшщъыьэюя")
    found: dict = {}
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        if unicodedata.category(c) in ("Lu", "Ll"):
            n_plain = next((n for n, p in enumerate(plain) if c in p + p.upper()), None)
            where = ("plain", n_plain) if n_plain is not None else (unicodedata.name(c).split()[0], code >> 7)
            found.setdefault((unicodedata.category(c), *where), []).append(c)
    # A letter alone in its block has none to move to there.
    out = {k: v for k, v in found.items() if len(v) > 1}
    for k, v in found.items():
        if len(v) == 1:
            out.setdefault((k[0], "rest"), []).extend(v)
    return ["".join(v) for v in out.values()]


#: Letters beyond ASCII, as alphabets that a letter is moved within.
ALPHABETS = _alphabets()


_fresh = itertools.count()


def _let(value: str, body: Callable[[str], str]) -> str:
    """``body`` of a name for ``value``, which is so worked out once. Expressions are SQL text here, as a plan of this depth is built far faster from one text."""
    name = f"v{next(_fresh)}"
    return f"element_at(transform(array({value}), {name} -> {body(name)}), 1)"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _kind(e: str) -> str:
    """The type of an entity as found; context-dependent types are told by elimination."""
    known = " ".join(f"WHEN {e} RLIKE {_text('^(?:' + PATTERNS[name] + ')$')} THEN '{name}'" for name in ("cloud_key", "iban", "ip", "phone", "ssn", "card"))
    person = _text(r"^\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?$")
    return f"CASE WHEN contains({e}, '@') THEN 'email' {known} WHEN {e} RLIKE {person} THEN 'person' ELSE 'secret' END"


#: Classes of ASCII characters; in secrets hexadecimal letters stay such, so that hexadecimal strings and others can't meet.
CLASSES, SECRET_CLASSES = ("09", "az", "AZ"), ("09", "af", "gz", "AF", "GZ")


def _shifted(c: str, n: str, tweak: str, alphabets: str) -> str:
    """One character moved on by ``n`` within its class (first and last ASCII character of each), or within its alphabet; others stay."""
    guarded = [(f"{tweak} <> 'secret' AND", x) for x in CLASSES] + [("", x) for x in SECRET_CLASSES]
    cases = [f"WHEN {guard} {c} BETWEEN '{x}' AND '{y}' THEN char({ord(x)} + pmod(ascii({c}) - {ord(x)} + {n}, {ord(y) - ord(x) + 1}))" for guard, (x, y) in guarded]
    own = _let(f"get(filter({alphabets}, a -> contains(a, {c})), 0)", lambda a: f"substring({a}, pmod(instr({a}, {c}) - 1 + {n}, length({a})) + 1, 1)")
    return f"CASE {' '.join(cases)} WHEN ascii({c}) > 127 THEN coalesce({own}, {c}) ELSE {c} END"


def _permuted(text: str, tweak: str, key: str, alphabets: str) -> str:
    """A keyed permutation of all strings with this pattern of character classes, in which none that holds a letter or digit stays.

    A Feistel network, then each character moved on by one, then the network undone: as the middle step leaves nothing
    in place, neither does the whole.
    """
    turns = f"array({', '.join(map(str, range(ROUNDS)))})"

    def moved(chars: str, by: str, k: str, sign: str) -> str:
        """``chars`` moved by amounts that depend on the key, the round and ``by``."""
        pad = f"sha2(cast(concat_ws('|', {_text(key)}, {tweak}, {k}, array_join({by}, '')) AS binary), 256)"
        amount = lambda h: f"{sign}(ascii(substring({h}, 1 + 2 * pmod(i, 31), 1)) * 16 + ascii(substring({h}, 2 + 2 * pmod(i, 31), 1)))"
        return _let(pad, lambda h: f"transform({chars}, (c, i) -> {_shifted('c', amount(h), tweak, alphabets)})")

    def network(t: str) -> str:
        half = f"cast(floor(length({t}) / 2) AS int)"
        start = f"named_struct('l', slice(split({t}, ''), 1, {half}), 'r', slice(split({t}, ''), {half} + 1, length({t})))"
        there = f"named_struct('l', s.r, 'r', {moved('s.l', 's.r', 'k', '')})"
        back = f"named_struct('l', {moved('s.r', 's.l', 'k', '-')}, 'r', s.l)"
        on = lambda side: f"transform({side}, c -> {_shifted('c', '1', tweak, alphabets)})"
        turned = f"aggregate({turns}, {start}, (s, k) -> {there}, s -> named_struct('l', {on('s.l')}, 'r', {on('s.r')}))"
        return f"aggregate(reverse({turns}), {turned}, (s, k) -> {back}, s -> array_join(concat(s.l, s.r), ''))"

    return _let(text, lambda t: f"CASE WHEN length({t}) > 0 THEN {network(t)} ELSE '' END")


def _luhn_digit(digits: str) -> str:
    """The check digit for a string of digits."""
    total = f"aggregate(transform(split(reverse({digits}), ''), (d, i) -> IF(i % 2 = 1, cast(d AS int), int(floor(cast(d AS int) * 2 / 10)) + cast(d AS int) * 2 % 10)), 0, (a, x) -> a + coalesce(x, 0))"
    return f"pmod(10 - {total} % 10, 10)"


def _refilled(pattern: str, digits: str) -> str:
    """``pattern`` with its digits replaced, in order, by ``digits``."""
    at = f"length(regexp_replace(substring({pattern}, 1, i + 1), '[^0-9]', ''))"
    return f"array_join(transform(split({pattern}, ''), (c, i) -> IF(c BETWEEN '0' AND '9', substring({digits}, {at}, 1), c)), '')"


def _spaced(pattern: str, text: str) -> str:
    """``text`` with blanks where ``pattern`` has them."""
    return f"array_join(transform(split({pattern}, ''), (c, i) -> IF(c = ' ', c, substring({text}, length(replace(substring({pattern}, 1, i + 1), ' ', '')), 1))), '')"


def _octets(e: str) -> str:
    return f"transform(split({e}, '[.]'), o -> cast(o AS int))"


def _canonical(e: str, kind: str) -> str:
    """What makes two mentions the same entity: case aside in addresses, format aside in numbers. A number with a country code is another than one without."""
    digits = f"regexp_replace({e}, '[^0-9]', '')"
    return (
        f"CASE {kind} WHEN 'email' THEN lower({e}) WHEN 'phone' THEN concat(IF(startswith({e}, '+'), '+', ''), {digits}) WHEN 'card' THEN {digits} WHEN 'ssn' THEN {digits} "
        f"WHEN 'ip' THEN array_join(transform({_octets(e)}, o -> cast(o AS string)), '.') WHEN 'iban' THEN replace({e}, ' ', '') ELSE {e} END"
    )


def _number(*parts: str) -> str:
    """A keyed number."""
    return f"cast(conv(substring(sha2(cast(concat_ws('|', {', '.join(parts)}) AS binary), 256), 1, 6), 16, 10) AS int)"


def _surrogate(e: str, key: str) -> str:
    alphabets = f"split({_text(' '.join(ALPHABETS))}, ' ')"
    listed = f"array({', '.join(_text(n) for names in GIVEN_NAMES.values() for n in names)})"
    known = f"named_struct('alphabets', {alphabets}, 'listed', {listed})"
    kind = lambda k: f"IF({_kind(e)} = 'person' AND array_contains({k}.listed, {_GIVEN.format(e)}), 'listed', {_kind(e)})"
    return _let(known, lambda k: _let(kind(k), lambda tweak: _let(_canonical(e, tweak), lambda norm: _replaced(e, tweak, norm, key, k))))


#: The first word of a name.
_GIVEN = "regexp_extract({0}, '^[^ ]+', 0)"


def canonical(e: str) -> Column:
    """The canonical form of the entity in the column ``e``."""
    return F.expr(_let(_kind(e), lambda kind: _canonical(e, kind)))


def surrogate(e: str, key: str) -> Column:
    """The replacement of the entity in the column ``e``."""
    return F.expr(_surrogate(e, key))


def _replaced(e: str, kind: str, norm: str, key: str, known: str) -> str:
    """What is kept at the start, what is permuted and what is kept at the end, by type; then the format of ``e`` is put back.

    All follow from the canonical form, so all formats of an entity get one surrogate. A card keeps its issuer's first
    digit, and a check digit that is as right or wrong as it was. An unlisted given name is permuted again while it is
    on a list, so names of the two kinds can't meet.
    """
    size = f"length({norm})"
    suffix = f"regexp_extract({norm}, '[.][a-z]{{2,24}}$', 0)"
    code = f"regexp_extract({norm}, {_text(CALLING_CODE)}, 1)"
    head = f"CASE {kind} WHEN 'phone' THEN {code} WHEN 'card' THEN left({norm}, 1) WHEN 'iban' THEN left({norm}, 2) WHEN 'cloud_key' THEN left({norm}, 4) WHEN 'listed' THEN {_given(e, key)} ELSE '' END"
    cut = lambda lo, n: f"substring({norm}, {lo}, {n})"
    body = (
        f"CASE {kind} WHEN 'email' THEN {cut(1, f'{size} - length({suffix})')} WHEN 'phone' THEN substring(replace({norm}, '+', ''), length({code}) + 1, {size}) WHEN 'card' THEN {cut(2, f'{size} - 2')} "
        f"WHEN 'iban' THEN {cut(3, size)} WHEN 'cloud_key' THEN {cut(5, size)} WHEN 'listed' THEN {cut(f'length({_GIVEN.format(e)}) + 1', size)} WHEN 'ip' THEN '' ELSE {norm} END"
    )
    again = f"{kind} = 'person' AND array_contains({known}.listed, {_GIVEN.format('w')})"
    moved = f"aggregate(sequence(0, {WALK}), {body}, (w, n) -> IF(n = 0 OR {again}, {_permuted('w', kind, key, f'{known}.alphabets')}, w))"
    check = lambda b: f"pmod({_luhn_digit(b)} + cast(right({norm}, 1) AS int) - {_luhn_digit(cut(1, f'{size} - 1'))}, 10)"

    def formatted(new: str) -> str:
        mail = f"array_join(zip_with(split({new}, ''), split({e}, ''), (new, old) -> IF(old BETWEEN 'A' AND 'Z', upper(new), new)), '')"
        card = _let(f"concat({new}, {check(new)})", lambda digits: _refilled(e, digits))
        by_kind = {"email": mail, "phone": _refilled(e, new), "ssn": _refilled(e, new), "card": card, "iban": _spaced(e, new), "ip": _address(e, key)}
        return f"CASE {kind} {' '.join(f"WHEN '{name}' THEN {made}" for name, made in by_kind.items())} ELSE {new} END"

    return _let(f"concat({head}, {moved}, IF({kind} = 'email', {suffix}, ''))", formatted)


def _address(e: str, key: str) -> str:
    """Each octet moves by a keyed amount that depends on the later ones, so the map can be undone from the last one back; the last always moves."""
    by = lambda parts: _number(_text(key), "'ip'", "i", f"array_join(slice({parts}, i + 2, 4), '.')")
    return _let(_octets(e), lambda parts: f"array_join(transform({parts}, (o, i) -> cast(pmod(o + IF(i = 3, 1 + pmod({by(parts)}, 255), {by(parts)}), 256) AS string)), '.')")


def _given(e: str, key: str) -> str:
    """Another given name of the same gender, never the same, by the rest of the name."""
    cases = []
    for names in GIVEN_NAMES.values():
        listed, given = f"array({', '.join(map(_text, names))})", _GIVEN.format(e)
        turn = f"pmod({_number(_text(key), "'given'", f"regexp_replace({e}, '^[^ ]+', '')")}, {len(names) - 1})"
        cases.append(f"WHEN array_contains({listed}, {given}) THEN element_at({listed}, 1 + pmod(cast(array_position({listed}, {given}) AS int) + {turn}, {len(names)}))")
    return f"CASE {' '.join(cases)} ELSE '' END"


def pieces(text: Column) -> Column:
    """The text taken apart: what lies between entities at even places, entities at odd ones. One pass of the patterns."""
    marked = F.split(F.regexp_replace(text, f"({ENTITY})", f"{MARK}$1{MARK}"), MARK, -1)
    between, found = F.split(text, ENTITY, -1), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    slow = F.flatten(F.transform(between, lambda b, i: F.when(i < F.size(found), F.array(b, F.get(found, i))).otherwise(F.array(b))))
    return F.when(~text.rlike(HINT), F.array(text)).when(text.contains(MARK), slow).otherwise(marked)


def _odd(apart: Column) -> Column:
    return F.filter(F.coalesce(apart, F.array().cast("array<string>")), lambda _, i: i % 2 == 1)


def entities(text: Column) -> Column:
    """All entities of a text, in order; none for a null text."""
    return _odd(pieces(text))


def _clashes(found: DataFrame, key: str) -> DataFrame:
    """``found``: a column e, an array of entities. One shuffle of distinct entities, combined before it."""
    distinct = found.select(F.explode("e").alias("e")).groupBy("e").agg(F.count("*").alias("mentions"))
    new = _let(_surrogate("e", key), lambda x: _let(_kind(x), lambda kind: _canonical(x, kind)))
    mapped = distinct.select(F.expr(_kind("e")).alias("kind"), canonical("e").alias("entity"), F.expr(new).alias("surrogate"))
    return mapped.groupBy("kind", "surrogate").agg(F.count_distinct("entity").alias("n_entities")).where("n_entities > 1")


def collisions(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Surrogates that stand for more than one entity; empty if distinctness holds."""
    return _clashes(docs.select(entities(F.col(text_col)).alias("e")), key)


def _distinct_key(found: DataFrame, key: str) -> str:
    """``key``, or the first key derived from it under which no two entities have one surrogate."""
    for k in range(KEYS):
        tried = f"{key}#{k}" if k else key
        if _clashes(found, tried).isEmpty():
            return tried
    raise ValueError(f"entities share surrogates under each of {KEYS} keys")


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", check: bool = True) -> DataFrame:
    """``docs`` with surrogates in ``text_col``, and ``n_entities``.

    Texts are taken apart once, into a written table; from its distinct entities it is made sure that no two share a
    surrogate, by another key if need be. ``check=False`` leaves the table and the check out, and moves nothing. A null
    text stays null with 0 entities; an empty one stays empty; repeated rows get equal texts; every other column passes
    through, whatever its name (an existing ``n_entities``, in any case, is replaced); texts of any length are whole.
    """
    columns = without_names(docs.columns, "n_entities")
    made = free_name(columns, "pieces")
    apart = docs.select(*[F.col(f"`{c}`") for c in columns if c != text_col], pieces(F.col(f"`{text_col}`")).alias(made))
    if check:
        apart = written(apart, "pieces")
        key = _distinct_key(apart.where(F.size(made) > 1).select(_odd(F.col(made)).alias("e")), key)
    new_text = F.expr(f"array_join(transform(`{made}`, (e, j) -> IF(j % 2 = 1, {_surrogate('e', key)}, e)), '')")
    n = F.greatest(F.coalesce(F.floor(F.size(made) / 2), F.lit(0)), F.lit(0)).cast("long")
    return apart.select(*[new_text.alias(c) if c == text_col else F.col(f"`{c}`") for c in columns], n.alias("n_entities"))
