"""Scalar text functions, all Column to Column and inside the JVM.

Offsets are code points from 0, as in the documents' own annotations."""

from __future__ import annotations

import functools
import itertools
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<text:string,start:int,end:int>"


#: Hangul syllables fall apart by a rule, into two or three letters each; a table of them would only be long.
_HANGUL = range(0xAC00, 0xD7A4)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), the value computed once however often f uses it: a variable of a lambda isn't computed anew, an expression may be."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _class(chars: list[int]) -> str:
    """A pattern's class of sorted code points: runs, in groups that a character outside their range passes at one comparison."""
    runs: list[list[int]] = []
    for n in chars:
        if runs and runs[-1][1] == n - 1:
            runs[-1][1] = n
        else:
            runs.append([n, n])
    one = lambda a, b: rf"\x{{{a:x}}}-\x{{{b:x}}}"
    groups = [f"[{one(g[0][0], g[-1][1])}&&[{''.join(one(*r) for r in g)}]]" for g in itertools.batched(runs, 16)]
    return f"[{one(chars[0], chars[-1])}&&[{''.join(groups)}]]"


@functools.lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str], str]:
    """Characters whose compatibility decomposition without marks is one character and, after
    them, the marks, which become nothing; those characters; what becomes of the others; and a pattern of these."""
    one, to, many, marks = [], [], {}, []
    for n in range(0x80, 0x30000):
        c = chr(n)
        if unicodedata.combining(c):
            marks.append(c)
        elif n not in _HANGUL and unicodedata.decomposition(c):
            d = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            if len(d) == 1 and d != c:
                one.append(c)
                to.append(d)
            elif d != c:
                many[c] = d
    return "".join(one + marks), "".join(to), many, _class([ord(c) for c in many])


def fold_accents(c: Column) -> Column:
    """NFKD without combining marks, for all scripts but Hangul syllables, which pass unchanged.

    ASCII passes as it is. Characters that become one character, and marks, which become
    none, go through translate(); the places of those that become several are found by one
    pattern and looked up, so that the work grows with the text and not with the tables."""
    one, to, many, pattern = _fold_tables()
    table = F.str_to_map(F.lit("\x01".join(f"{a}\x02{b}" for a, b in many.items())), F.lit("\x01"), F.lit("\x02"))

    def rare(s: Column) -> Column:
        around, found = F.split(s, pattern, -1), F.regexp_extract_all(s, F.lit(pattern), F.lit(0))
        return F.array_join(F.transform(F.arrays_zip(around.alias("g"), found.alias("m")), lambda x: F.concat(x["g"], F.coalesce(table[x["m"]], F.lit("")))), "")

    folded = let(F.translate(c, one, to), lambda s: F.when(s.rlike(pattern), rare(s)).otherwise(s))
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(folded)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


#: Tails of a taxon name that are authorship, in the order in which they are peeled.
AUTHORSHIP = (
    r"(?U)\s*\([^()]*\)\s*$",
    r"(?U)\s*,?\s*\d{4}\s*$",
    r"(?U)\s+[A-Z][A-Za-z'’.\-]*\.?$",
    r"(?Ui)\s+(?:van|von|de[nrl]?|del|della|di|da|la|le|el|du|dos|das|bin|ibn|ter|ten)$",
)
#: Rank qualifiers.
RANK_TAGS = r"(?Ui)\b(?:subsp|ssp|var|cf|aff|sp|spp|nr|gen|f)\.?\b"


def strip_authorship(c: Column) -> Column:
    """Peel trailing parentheses, years, capitalised authorities and particles until nothing changes.

    The passes are a fold, so that the expression stays small. A pass that changes
    anything takes off a character at least, so the length bounds them; those after the
    last change only look at a flag."""

    def peel(state: Column, _: Column) -> Column:
        s = state["s"]
        for p in AUTHORSHIP:
            s = F.regexp_replace(s, p, "")
        return F.when(state["more"], let(s, lambda x: F.struct(x.alias("s"), (x != state["s"]).alias("more")))).otherwise(state)

    # most names have no tail
    whole = lambda s: F.aggregate(F.sequence(F.lit(0), F.length(s)), F.struct(s.alias("s"), F.lit(True).alias("more")), peel, lambda state: state["s"])
    return F.trim(let(c, lambda s: F.when(s.rlike("|".join(f"(?:{p})" for p in AUTHORSHIP)), whole(s)).otherwise(s)))


def normalize_taxon(c: Column, compat: bool = True) -> Column:
    """The key of a taxon name. compat=False also drops a full stop that stands alone."""
    s = strip_authorship(F.trim(fold_accents(c)))
    s = F.regexp_replace(F.lower(s), RANK_TAGS, " ")
    s = F.trim(F.regexp_replace(s, "[^a-z0-9.]+", " "))
    return s if compat else collapse(F.regexp_replace(s, r"(?:^|(?<= ))\.(?= |$)", " "))


def normalize_place(c: Column) -> Column:
    """The key of a place name."""
    return F.trim(F.regexp_replace(F.lower(fold_accents(c)), "[^a-z0-9]+", " "))


def normalize_vernacular(c: Column) -> Column:
    """The key of a common name; hyphens stay."""
    return F.trim(F.regexp_replace(F.lower(fold_accents(c)), "[^a-z0-9-]+", " "))


def plain_lower(c: Column) -> Column:
    """Without accents, in lower case and trimmed; punctuation stays."""
    return F.trim(F.lower(fold_accents(c)))


def prefix3(c: Column) -> Column:
    """The blocking key: the first three characters without spaces."""
    return F.substring(F.replace(c, F.lit(" "), F.lit("")), 1, 3)


#: Fixed value: capital, at least two letters, white space, at least three letters.
BINOMIAL = r"(?U)(?=[A-Z])\b([A-Z][a-zäöüïëç]{2,})\s+([a-zäöüïëç]{3,})\b"
#: Fixed value: words of the common-name scan.
WORD = "[0-9A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+"


def running(numbers: Column, join: Callable[[Column, Column], Column], zero: int, block: int = 32, levels: int = 2) -> Column:
    """array<int> of what `join`, an associative function of two numbers, makes of the elements up to each.

    An array that grows by one element is copied each time, so it goes block by block:
    within a block from its own elements, before it from the blocks' totals, which are
    taken in the same way `levels` times and plainly then."""
    both = lambda a, b: join(a, b).cast("int")
    total = lambda a: F.aggregate(a, F.lit(zero), both)
    cut = lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / block).cast("int")), lambda b: F.slice(n, b * block + 1, F.lit(block)))
    within = lambda b, at: F.aggregate(
        b, F.struct(F.array().cast("array<int>").alias("out"), at.alias("at")),
        lambda a, x: F.struct(F.array_append(a["out"], both(a["at"], x)).alias("out"), both(a["at"], x).alias("at")), lambda a: a["out"],
    )
    if not levels:
        return within(numbers, F.lit(zero))
    before = lambda blocks: running(F.transform(blocks, total), join, zero, block, levels - 1)
    from_blocks = lambda blocks: let(before(blocks), lambda t: F.flatten(F.transform(blocks, lambda b, i: within(b, F.when(i == 0, F.lit(zero)).otherwise(F.get(t, i - 1))))))
    return let(numbers, lambda n: F.when(F.size(n) > 0, let(cut(n), from_blocks)).otherwise(F.array().cast("array<int>")))


def running_sums(numbers: Column) -> Column:
    """array<int> of the sums up to each element."""
    return running(numbers, lambda a, b: a + b, 0)


def ends_of(found: Column, around: Column) -> Column:
    """array<int> of the ends of matches, from their texts and those between them."""
    return let(around, lambda g: running_sums(F.transform(found, lambda m, i: F.length(m) + F.length(F.get(g, i)))))


def spans(text: Column, pattern: str | Column) -> Column:
    """All matches of a pattern that never matches empty, as array<struct<text,start,end>>, without a UDF.

    The text is computed once, and cut only where there is a match."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    none = F.array().cast(f"array<{SPAN}>")
    place = lambda m, e: F.struct(m.alias("text"), (e - F.length(m)).cast("int").alias("start"), e.alias("end"))
    each = lambda t, found: let(ends_of(found, F.split(t, pattern, -1)), lambda ends: F.transform(found, lambda m, i: place(m, F.get(ends, i))))
    return let(text, lambda t: let(F.regexp_extract_all(t, pattern, F.lit(0)), lambda found: F.when(F.size(found) > 0, each(t, found)).otherwise(none)))


def literal_pattern(c: Column) -> Column:
    """A pattern that matches the value of a column as it stands."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def find_spans(text: Column, term: Column, limit: int = 25) -> Column:
    """Places of a term, case-insensitive, not bounded by words, not overlapping; the first `limit` of them (a feature)."""
    low, q = F.lower(text), F.lower(term)
    found = spans(low, literal_pattern(q))
    out = F.transform(F.slice(found, 1, limit), lambda x: F.struct(term.alias("text"), x["start"].alias("start"), (x["start"] + F.length(term)).cast("int").alias("end")))
    return F.when(F.length(term) > 0, out).otherwise(F.array().cast(f"array<{SPAN}>"))


#: Leading geographic generics in order, with the feature classes that each implies.
HEADS = (
    (r"terminos? municipal(?:es)?", "PA"), (r"municipios?", "PA"), (r"localidad(?:es)?", "P"), (r"nucleos? de poblacion", "P"), (r"pedania", "P"),
    (r"provincias?", "A"), (r"comarcas?", "A"), (r"comunidad(?:es)? autonoma(?:s)?", "A"),
    (r"parques? (?:natural(?:es)?|nacional(?:es)?|regional(?:es)?)?", "L"), (r"reservas? (?:natural(?:es)?|de la biosfera)?", "L"), (r"parajes? natural(?:es)?", "L"),
    (r"espacios? natural(?:es)?", "L"), (r"monumentos? natural(?:es)?", "L"),
    (r"rios?", "H"), (r"arroyos?", "H"), (r"barrancos?", "H"), (r"ramblas?", "H"), (r"riberas?", "H"), (r"rieras?", "H"), (r"regatos?", "H"), (r"regueros?", "H"),
    (r"embalses?", "H"), (r"lagunas?", "H"), (r"pantanos?", "H"), (r"charcas?", "H"), (r"humedal(?:es)?", "H"), (r"balsas?", "H"), (r"marismas?", "H"), (r"estanques?", "H"),
    (r"sierras?", "T"), (r"montes?", "T"), (r"montanas?", "T"), (r"puertos?", "T"), (r"valles?", "T"), (r"picos?", "T"), (r"collados?", "T"), (r"cerros?", "T"), (r"lomas?", "T"),
    (r"altos?", "T"), (r"penas?", "T"), (r"macizos?", "T"), (r"cordilleras?", "T"), (r"cabos?", "T"), (r"puntas?", "T"),
)
#: Fixed value: what may stand between the generic and the proper name.
CONNECTOR = r"(?:de\s+(?:la\s+|los\s+|las\s+|el\s+)?|del\s+)?"
#: The generics whose pattern ends in an optional qualifier after a space; without compat that space goes with it.
_QUALIFIED = {
    r"parques? (?:natural(?:es)?|nacional(?:es)?|regional(?:es)?)?": r"parques?(?: (?:natural(?:es)?|nacional(?:es)?|regional(?:es)?))?",
    r"reservas? (?:natural(?:es)?|de la biosfera)?": r"reservas?(?: (?:natural(?:es)?|de la biosfera))?",
}


def head_patterns(compat: bool = True) -> list[tuple[str, str]]:
    return [(rf"^{g if compat else _QUALIFIED.get(g, g)}\s+{CONNECTOR}", classes) for g, classes in HEADS]


def strip_head(norm: Column, compat: bool = True) -> Column:
    """struct(core, hint): the name without its leading generic and the classes that this implies; else the name and null.

    Generics of one class stand together, so one pattern with a group for each class
    finds the first that fits; a key has no space at its end, so a core is left."""
    classes = list(dict.fromkeys(h for _, h in HEADS))
    groups = "|".join("(" + "|".join(g if compat else _QUALIFIED.get(g, g) for g, h in HEADS if h == c) + ")" for c in classes)
    pattern = rf"^(?:{groups})\s+{CONNECTOR}"
    hint = F.coalesce(*(F.when(F.regexp_extract(norm, pattern, i + 1) != "", c) for i, c in enumerate(classes)))
    return F.struct(F.regexp_replace(norm, pattern, "").alias("core"), F.when(norm.rlike(pattern), hint).alias("hint"))


#: The feature codes of each type, by feature class where the code has none, and the order of classes among equals.
CODE_TYPES = {
    "region": "ADM1", "province": "ADM2", "comarca": "ADM3", "municipality": "ADM4", "river": "STM STMI STMS STMM", "canal": "CNL CNLI",
    "water_body": "LK LKS RSV PND PNDS LGN", "wetland": "MRSH SWMP", "spring": "SPNG WLL", "relief": "MT MTS PK PKS HLL HLLS RDGE SRA CLF PLN VAL",
    "pass": "PASS", "cape": "CAPE PT", "protected_area": "PRK RESN RESV RESW RESF", "forest": "FRST",
}
CLASS_TYPES = {"A": "admin", "P": "municipality", "H": "water_body", "T": "relief", "L": "protected_area", "V": "place"}
CLASS_PRIORITY = {"P": 5, "A": 4, "T": 3, "H": 3, "L": 2, "V": 1}
KEEP_CLASSES = ("A", "P", "H", "T", "L", "V")


def _map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def place_type(fclass: Column, fcode: Column) -> Column:
    codes = {code: t for t, all_codes in CODE_TYPES.items() for code in all_codes.split()}
    return F.coalesce(_map(codes)[fcode], _map(CLASS_TYPES)[fclass], F.lit("place"))


def class_priority(fclass: Column) -> Column:
    return F.coalesce(_map(CLASS_PRIORITY)[fclass], F.lit(0))


#: Head nouns that give an unverified place its type, in order.
TYPE_HINTS = (
    ("river", "rio arroyo barranco rambla ribera"), ("water_body", "embalse laguna pantano charca humedal balsa"), ("relief", "sierra monte montes puerto valle pico collado cerro"),
    ("protected_area", "parque reserva zepa lic zec espacio paraje monumento"), ("trail", "canada vereda cordel colada via"), ("province", "provincia"), ("municipality", "termino municipio"),
)


def classify_place(norm: Column) -> Column:
    words = F.split(norm, r"(?U)\s+")
    out = F.lit("place")
    for t, heads in reversed(TYPE_HINTS):
        out = F.when(F.arrays_overlap(words, F.array(*map(F.lit, heads.split()))), t).otherwise(out)
    return out


#: Words that the comparison of answers leaves out, and answers that are none.
ARTICLES = "el la los las un una unos unas lo al del de".split()
TRIVIAL = "el la los las un una unos unas de del al en y o a que se lo por con".split()


def answer_tokens(c: Column | str) -> Column:
    """Lower case, punctuation to spaces, without articles; null is empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w]+"), lambda w: (w != "") & ~w.isin(ARTICLES))


def answer_norm(c: Column) -> Column:
    return F.array_join(answer_tokens(c), " ")


def numbered(tokens: Column) -> Column:
    """The tokens in order, each with how many equal ones are before it: a multiset as a set.

    Sorted once; the number is the distance to the first of a run of equal ones, so nothing is searched for."""
    at = lambda s: F.filter(F.transform(s, lambda _, i: i), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    run = lambda s, a, b: F.transform(F.slice(s, a + 1, b - a), lambda w, k: F.concat_ws(" ", w, k.cast("string")))
    runs = lambda s, first: F.flatten(F.transform(first, lambda a, j: run(s, a, F.coalesce(F.get(first, j + 1), F.size(s)))))
    return let(F.sort_array(tokens), lambda s: F.when(F.size(F.array_distinct(s)) == F.size(s), F.transform(s, lambda w: F.concat(w, F.lit(" 0")))).otherwise(let(at(s), lambda first: runs(s, first))))


def token_f1(pred: Column, gold: Column) -> Column:
    """F1 of the two multisets of tokens; both empty: 1, one empty: 0."""
    return tokens_f1(answer_tokens(pred), answer_tokens(gold))


def tokens_f1(p: Column, g: Column) -> Column:
    """The same of tokens that are there already."""

    def f1(p: Column, g: Column, same: Column) -> Column:
        np_, ng = F.size(p), F.size(g)
        return F.when((np_ == 0) & (ng == 0), 1.0).when((np_ == 0) | (ng == 0) | (same == 0), 0.0).otherwise(2.0 * same / (np_ + ng))

    # where one side has no token twice, what both have is what their sets share
    plain = lambda a: F.size(F.array_distinct(a)) == F.size(a)
    same = lambda p, g: F.when(p == g, F.size(p)).when(plain(p) | plain(g), F.size(F.array_intersect(p, g))).otherwise(F.size(F.array_intersect(numbered(p), numbered(g))))
    return let(F.struct(p.alias("p"), g.alias("g")), lambda x: let(same(x["p"], x["g"]), lambda n: f1(x["p"], x["g"], n)))


def exact_match(pred: Column, gold: Column) -> Column:
    return (answer_norm(pred) == answer_norm(gold)).cast("double")


def contains_match(pred: Column, gold: Column) -> Column:
    return contains_norm(answer_norm(pred), answer_norm(gold))


def contains_norm(p: Column, g: Column) -> Column:
    """The same of normal forms that are there already."""
    return (p != "") & (g != "") & (F.contains(p, g) | F.contains(g, p))


def trivial_answer(c: Column) -> Column:
    s = F.trim(c)
    return (F.length(s) < 3) | F.lower(s).isin(TRIVIAL)


def doc_of(example_id: Column) -> Column:
    return F.split_part(example_id, F.lit("::"), F.lit(1))


def tag_of(example_id: Column) -> Column:
    return F.split_part(example_id, F.lit("::"), F.lit(-1))


def parse_reply(raw: Column) -> Column:
    """The answers in a teacher's reply: the outermost braces, without thoughts, as map<string,string>; null if unreadable."""
    return F.from_json(F.regexp_extract(F.regexp_replace(raw, "(?s)<think>.*?</think>", ""), r"(?s)\{.*\}", 0), "map<string,string>")


def reply_span(answer: Column, text: Column) -> Column:
    """struct(answer, start) where the trimmed answer stands literally in the text, else null."""
    a = F.trim(F.btrim(F.trim(answer), F.lit('"')))
    at = F.call_function("locate", a, text)
    return F.when((a != "") & (at > 0), F.struct(a.alias("answer"), (at - 1).cast("int").alias("start")))
