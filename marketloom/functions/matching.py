"""Model matching: whether a title or URL speaks of a model, and of that one only. Native Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketloom.functions.base import let, lets, strings
from marketloom.functions.text import normalize_model, normalize_text

#: Tokens after a model's digits that make it another model.
SUFFIX_WORDS = (
    "PLUS PRO S T SE MAX LITE EVO GOLD DELUXE PREMIUM DI DE EG EU GB GER PL PP PA PB PC C I IC ID IPLUS EGO GX EGOGX II III IF NEW HID SI IH QH LEBAR ROTE IG SL B W BU BL WH "
    "GRAY GREY QD SJ BK LAC SY G N GE MI NANO GRT GRS GRH GR UNIQUE QAM ISLAND ELITE VTC CT AW KC AT ATC GL SS BB EBN DL AU GS YA WOK RB TB HB AS DHE DIL DHP DIU DSU SU SM TFT "
    "FZ ITG IS LINEAR IN RN IRN HS SP ES TORNADO SERIAL"
).split()
#: Words before a model's digits that say nothing.
COMMON_WORDS = (
    "BEP TU MAY HUT MUI LO VI SONG NUONG CHAU RUA CHEN BAT VOI KHOA DIEN KET SAT GIAO HANG BAO HANH NAM THUONG HIEU SAN PHAM DOI CHI HTTPS HTTP WWW COM VN NET ORG SELECT OPTION"
).split()
#: Suffixes that may be left out, and words that never may.
GENERIC_SUFFIXES = "GB SG EU BY GER PL VN B W S G R BL WH BU BK GY SL GR".split()
IMPORTANT_WORDS = "PLUS PRO SE IPLUS MAX LITE EVO S T EG EGO GX DI DE".split()


def _parts(token: Column) -> Column:
    """Letters, digits and rest of a token of capitals and digits; digits '' if it doesn't begin so."""
    piece = lambda k: F.regexp_extract(token, r"^([A-Z]*)([0-9]+)(.*)$", k)
    return F.struct(piece(1).alias("prefix"), piece(2).alias("digits"), piece(3).alias("suffix"))


def split_model(model: Column) -> Column:
    """Prefix, digits and suffix of a model's normal form; all '' unless it is letters, then a digit."""
    return let(normalize_model(model), _parts)


def tokens(text: Column) -> Column:
    """Runs of capitals and digits of the normal form of a text."""
    return F.regexp_extract_all(F.upper(normalize_text(text)), F.lit("[A-Z0-9]+"), F.lit(0))


def text_tokens(text: Column) -> Column:
    """Tokens of a title or URL, with digits joined over a hyphen."""
    return tokens(F.regexp_replace(F.coalesce(text, F.lit("")), r"([0-9]+)-([0-9]+)", "$1$2"))


def _before(toks: Column, i: Column, n: int) -> Column:
    start = F.greatest(F.lit(0), i - n)
    return F.slice(toks, start + 1, i - start)


def _full_prefix(toks: Column, i: Column, brand: Column) -> Column:
    """Up to four tokens before, without common words and the brand, and the token's own letters."""
    common = strings(COMMON_WORDS)
    brandish = lambda t: (brand != "") & (t.contains(brand) | brand.contains(t))
    kept = F.filter(_before(toks, i, 4), lambda t: ~F.array_contains(common, t) & ~brandish(t))
    own = F.regexp_extract(F.get(toks, i), r"^([A-Z]*)[0-9]", 1)
    return F.concat(F.array_join(kept, ""), F.when((own != "") & ~F.array_contains(common, own) & ~brandish(own), own).otherwise(""))


def _indices(toks: Column) -> Column:
    return F.transform(toks, lambda _, i: i)


def _digits_of(toks: Column, i: Column) -> Column:
    return F.regexp_extract(F.get(toks, i), r"^[A-Z]*([0-9]+)", 1)


def _prefix_conflict(toks: Column, parts: Column, model_tokens: Column, brand: Column) -> Column:
    at = F.get(F.filter(_indices(model_tokens), lambda i: _digits_of(model_tokens, i) == parts["digits"]), F.lit(0))
    own = F.when(at.isNotNull(), _full_prefix(model_tokens, at, brand)).otherwise(parts["prefix"])

    def clash(own: Column) -> Column:
        def differs(i: Column) -> Column:
            other = _full_prefix(toks, i, brand)
            return (_digits_of(toks, i) == parts["digits"]) & let(other, lambda o: (o != "") & ~o.endswith(own) & ~own.endswith(o))

        return (parts["digits"] != "") & (own != "") & F.exists(_indices(toks), differs)

    return let(own, clash)


def _matches_prefix(toks: Column, i: Column, prefix: Column) -> Column:
    own, joined = F.regexp_extract(F.get(toks, i), r"^([A-Z]*)[0-9]", 1), F.array_join(_before(toks, i, 3), "")
    needed = F.substring(prefix, F.lit(1), F.length(prefix) - F.length(own))
    return (prefix == "") | (own == prefix) | joined.endswith(prefix) | ((own != "") & prefix.endswith(own) & joined.endswith(needed))


def _whole_suffix(toks: Column, i: Column, suffix: Column) -> Column:
    """The token's own suffix and the run of suffix words (or parts of the model's suffix) that follows it."""
    words = strings(SUFFIX_WORDS)
    run = F.aggregate(
        F.slice(toks, i + 2, F.size(toks)),
        F.struct(F.lit("").alias("text"), F.lit(False).alias("ended")),
        lambda a, t: F.struct(
            F.when(~a["ended"] & (F.array_contains(words, t) | suffix.contains(t)), F.concat(a["text"], t)).otherwise(a["text"]).alias("text"),
            (a["ended"] | ~(F.array_contains(words, t) | suffix.contains(t))).alias("ended"),
        ),
        lambda a: a["text"],
    )
    return F.concat(F.regexp_extract(F.get(toks, i), r"^[A-Z]*[0-9]+(.*)$", 1), run)


def _suffix_conflict(toks: Column, parts: Column, brand_present: Column) -> Column:
    """``branded``, and ``bare`` for a judgement that leaves the brand aside: whether a token of the model's digits goes on differently."""
    model_suffix = parts["suffix"]

    def differs(found: Column) -> Column:
        extra_letters = lambda longer, shorter: F.substring(longer, F.length(shorter) + 1, F.length(longer)).rlike("[A-Z]")
        both = F.when(model_suffix.startswith(found), extra_letters(model_suffix, found)).when(found.startswith(model_suffix), extra_letters(found, model_suffix)).otherwise(True)
        one = F.when(model_suffix != "", model_suffix).otherwise(found)
        bare = F.regexp_replace(one, "[0-9]", "")
        generic = (bare != "") & F.array_contains(strings(GENERIC_SUFFIXES), bare)
        with_digit = one.rlike("[0-9]") & (one == model_suffix) & ~one.rlike("|".join(IMPORTANT_WORDS)) & (F.length(parts["digits"]) >= 3)
        clash = (found != model_suffix) & F.when((model_suffix != "") & (found != ""), both).otherwise(~generic)
        spared = ((model_suffix == "") | (found == "")) & with_digit
        return F.struct(clash.alias("bare"), spared.alias("spared"))

    here = F.filter(_indices(toks), lambda i: (_digits_of(toks, i) == parts["digits"]) & _matches_prefix(toks, i, parts["prefix"]))
    judged_here = F.when(parts["digits"] != "", F.transform(here, lambda i: let(_whole_suffix(toks, i, model_suffix), differs)))
    return let(judged_here, lambda h: F.struct(*[F.coalesce(F.exists(h, f), F.lit(False)).alias(k) for k, f in (("branded", lambda x: x["bare"] & ~(brand_present & x["spared"])), ("bare", lambda x: x["bare"]))]))


def _norm(value: Column | None) -> Column:
    return F.lit("") if value is None else normalize_model(value)


def _context(text: Column, model: Column, brand: Column | None) -> dict[str, Column]:
    """Tokens of the text, parts and tokens of the model, and the normalised brand."""
    return {"toks": text_tokens(text), "parts": split_model(model), "mt": tokens(model), "b": _norm(brand), "joined": normalize_model(F.regexp_replace(F.coalesce(text, F.lit("")), r"([0-9]+)-([0-9]+)", "$1$2"))}


def _conflicts(toks: Column, parts: Column, mt: Column, b: Column, joined: Column) -> tuple[Column, Column]:
    return _prefix_conflict(toks, parts, mt, b), _suffix_conflict(toks, parts, (b != "") & joined.contains(b))


def prefix_conflict(text: Column, model: Column, brand: Column | None = None) -> Column:
    """Whether the text has the model's digits behind another prefix."""
    return lets(_context(text, model, brand), lambda **c: _conflicts(**c)[0])


def suffix_conflict(text: Column, model: Column, brand: Column | None = None) -> Column:
    """Whether the text has the model's digits before a suffix that makes it another model."""
    return lets(_context(text, model, brand), lambda **c: _conflicts(**c)[1]["branded"])


def _bounded(text: Column, part: Column) -> Column:
    """Whether the first occurrence of ``part`` doesn't go on with digits on either side."""
    at = F.position(part, text)
    before, after = F.substring(text, at - 1, F.lit(1)), F.substring(text, at + F.length(part), F.lit(1))
    digit = r"^[0-9]$"
    clash = ((at > 1) & before.rlike(digit) & F.substring(part, 1, 1).rlike(digit)) | (after.rlike(digit) & F.substring(part, -1, 1).rlike(digit))
    return (part != "") & (at > 0) & ~clash


def longest_segment(model: Column) -> Column:
    """The longest of a model's parts that has three letters or digits; '' if none has."""
    pieces = F.filter(F.split(F.coalesce(model, F.lit("")), r"[\s\-_]+"), lambda s: F.length(F.regexp_replace(s, "[^a-zA-Z0-9]", "")) > 0)
    segments = F.filter(F.transform(pieces, normalize_model), lambda s: F.length(s) >= 3)
    return F.coalesce(F.aggregate(segments, F.lit("").cast("string"), lambda best, s: F.when(F.length(s) > F.length(best), s).otherwise(best)), F.lit(""))


def _model_side(model: Column, brand: Column | None) -> Column:
    """What is read of a model and a brand, whatever texts they meet."""
    read = {"nm": normalize_model(model), "mt": tokens(model), "b": _norm(brand), "longest": longest_segment(model)}
    return lets(read, lambda nm, mt, b, longest: F.struct(nm.alias("nm"), mt.alias("mt"), b.alias("b"), longest.alias("longest"), _parts(nm).alias("parts"), F.regexp_replace(nm, "[^0-9]", "").alias("digits")))


def _text_side(text: Column) -> Column:
    """What is read of a text, whatever models it meets."""
    hyphened = F.regexp_replace(text, r"([0-9]+)-([0-9]+)", "$1$2")

    def read(nt: Column) -> Column:
        joined = F.when(text.rlike("[0-9]-[0-9]"), normalize_model(hyphened)).otherwise(nt)
        return F.struct(nt.alias("nt"), joined.alias("joined"), text_tokens(text).alias("toks"), F.regexp_replace(nt, "[^0-9]", "").alias("digits"), F.regexp_extract_all(nt, F.lit("[0-9]+"), F.lit(0)).alias("runs"))

    return let(normalize_model(text), read)


def _decided(m: Column, x: Column) -> Column:
    nt, nm, b, digits, text_digits = x["nt"], m["nm"], m["b"], m["digits"], x["digits"]
    literal = _bounded(nt, nm) | ((F.length(digits) >= 3) & F.array_contains(x["runs"], digits)) | _bounded(nt, m["longest"])
    n = F.least(F.lit(4), F.length(digits), F.length(text_digits))
    head = lambda x: F.substring(x, F.lit(1), n)
    alike = digits.contains(text_digits) | ((n >= 3) & (head(digits) == head(text_digits)) & (F.length(digits) >= F.length(text_digits)))
    lenient = (b != "") & nt.contains(b) & (F.length(digits) >= 3) & (F.length(text_digits) >= 3) & alike
    prefix, suffix = _conflicts(x["toks"], m["parts"], m["mt"], b, x["joined"])
    # only a token with the model's digits is in conflict
    met = (m["parts"]["digits"] != "") & F.exists(x["toks"], lambda t: t.contains(m["parts"]["digits"]))
    none = F.struct(F.lit(False).alias("branded"), F.lit(False).alias("bare"))
    clash = F.struct((met & prefix).alias("prefix"), F.when(met, suffix).otherwise(none).alias("s"), ((nm != "") & (literal | lenient)).alias("like"))
    fields = lambda k: {"matched": k["like"] & ~k["prefix"] & ~k["s"]["branded"], "prefix": k["prefix"], "suffix": k["s"]["branded"], "bare_suffix": k["s"]["bare"]}
    return let(clash, lambda k: F.struct(*[v.alias(name) for name, v in fields(k).items()]))


def judged_each(texts: dict[str, Column], model: Column, brand: Column | None, body: Callable[..., Column]) -> Column:
    """``body`` of what ``judged`` says of each text, by its name, with its normal form (``nt``), and of the model's (``nm``) and brand's (``b``): model and brand are read once."""
    read = {"m": _model_side(model, brand)} | {k: _text_side(t) for k, t in texts.items()}

    def decide(m: Column, **sides: Column) -> Column:
        said = F.struct(*[_decided(m, x).alias(k) for k, x in sides.items()])
        return let(said, lambda s: body(nm=m["nm"], b=m["b"], nt={k: x["nt"] for k, x in sides.items()}, **{k: s[k] for k in sides}))

    return lets(read, decide)


def judged(text: Column, model: Column, brand: Column | None = None) -> Column:
    """``matched``, ``prefix`` and ``suffix`` (the conflicts), and ``bare_suffix`` (without the brand) of a text and a model, from one reading of both."""
    return judged_each({"t": text}, model, brand, lambda t, **rest: t)


def blocking_keys(text: Column, model: Column | None = None) -> Column:
    """Keys that a text and every model it can speak of (without a brand) have in common; of the text alone if no model is given.

    A model is found by its normal form, all its digits or its longest segment. What of these has digits shares a whole
    run of digits with the text's normal form, else its first three letters. A model without digits and with fewer than
    three letters has no key.
    """
    first_run = lambda x: F.regexp_extract(x, "[0-9]+", 0)
    if model is None:
        joined = lambda n: F.concat(F.regexp_extract_all(n, F.lit("[0-9]+"), F.lit(0)), F.when(F.length(n) >= 3, F.transform(F.sequence(F.lit(1), F.length(n) - 2), lambda i: F.substring(n, i, F.lit(3)))).otherwise(F.array().cast("array<string>")))
        return F.array_distinct(let(normalize_model(text), joined))
    key = lambda x: F.when(first_run(x) != "", first_run(x)).when(F.length(x) >= 3, F.substring(x, 1, 3))
    forms = F.struct(normalize_model(model).alias("nm"), longest_segment(model).alias("longest"))
    return let(forms, lambda m: F.array_distinct(F.filter(F.array(key(m["nm"]), key(m["longest"]), F.nullif(F.regexp_replace(m["nm"], "[^0-9]", ""), F.lit(""))), lambda x: x.isNotNull())))


def model_match(text: Column, model: Column, brand: Column | None = None) -> Column:
    """Whether a title or URL speaks of the model: four rules, from literal to lenient, none against a conflict."""
    return judged(text, model, brand)["matched"]
