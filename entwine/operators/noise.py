"""Noise on names and addresses, and its measurement, as column expressions.

An operator maps a column and the row's ``Draws`` to a column.  Draws are hashes of
the row's id, a seed and the draw's number, so a lost task draws the same again.
An operator that finds nothing to change returns its input; of a null it makes null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entwine.functions.lexicon import load_lexicon
from entwine.functions.text import domain_col, fold_col, literal_map

# Words and letters that noise puts in each other's place.
VOWELS, ACCENTED = "aeiouAEIOU", "áéíóúÁÉÍÓÚ"
LETTERS, LOOKALIKES = "oOlLiIsSeE", "0011115533"
LEADING, TRAILING = ("The", "Mr", "M/s", "The The"), ("Center", "Group", "Services")
LEGAL_PAIRS = (("Private Limited", "Pvt Ltd"), ("Limited", "Ltd"), ("Private", "Pvt"), ("Incorporated", "Inc"), ("Corporation", "Corp"), ("Company", "Co"), ("SARL", "S.A.R.L."), ("SAS", "S.A.S"))
STREET_PAIRS = (("Road", "Rd"), ("Street", "St"), ("Avenue", "Ave"), ("Boulevard", "Blvd"), ("Rue", "R."), ("Floor", "Fl"), ("Near", "Nr"), ("Opposite", "Opp"))
SHORT_FORMS = ("Inc", "Ltd", "LLC", "SARL", "SAS")
EXTRA_PARTS = ("Ground Floor", "Rear Entrance", "Block B", "Zone 2")
KEYBOARD = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
EMPTY_ADDRESS = 0.03
POSTAL = r"\b\d{5,6}\b"
_FAR = 1 << 30


class Draws:
    """Numbers of one row; every call is a draw of its own."""

    def __init__(self, key: Column, seed: int):
        self.key, self.seed, self.made = key, seed, 0

    def number(self) -> Column:
        self.made += 1
        return F.xxhash64(self.key, F.lit(self.seed), F.lit(self.made))

    def below(self, n: Column | int) -> Column:
        n = n if isinstance(n, Column) else F.lit(n)
        return F.pmod(self.number(), F.greatest(n, F.lit(1))).cast("int")

    def hits(self, share: Column | float) -> Column:
        return F.pmod(self.number(), F.lit(1_000_000)) < share * 1_000_000

    def one_of(self, values: tuple[str, ...]) -> Column:
        return F.get(F.array(*map(F.lit, values)), self.below(len(values)))

    def pick(self, items: Column) -> Column:
        """An item, null of none."""
        return F.get(items, self.below(F.size(items)))


Op = Callable[[Column, Draws], Column]


def _words(s: Column) -> Column:
    return F.filter(F.split(s, r"\s+"), lambda w: w != "")


def _parts(s: Column) -> Column:
    return F.filter(F.transform(F.split(s, ","), lambda p: F.trim(p)), lambda p: p != "")


def _letters(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.substring(s, i, F.lit(1)))


def _where(items: Column, test: Callable[[Column], Column]) -> Column:
    """Places, from 0, of the items that pass."""
    return F.filter(F.transform(items, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())


def _with(items: Column, at: Column, new: Column) -> Column:
    return F.concat(F.slice(items, F.lit(1), at), F.array(new), F.slice(items, at + 1, F.lit(_FAR)))


def _without(items: Column, at: Column) -> Column:
    return F.filter(items, lambda _, i: i != at)


def _set(items: Column, at: Column, new: Callable[[Column], Column]) -> Column:
    return F.transform(items, lambda x, i: F.when(i == at, new(x)).otherwise(x))


def _exchanged(items: Column, at: Column) -> Column:
    """The items with the one at ``at`` and its successor in each other's place."""
    return F.transform(items, lambda x, i: F.coalesce(F.when(i == at, F.get(items, at + 1)).when(i == at + 1, F.get(items, at)), x))


def _around(s: Column, at: Column, middle: Callable[[Column, Column], Column]) -> Column:
    """``s`` with ``middle(letter, rest)`` from place ``at`` on; ``s`` itself if the place is null."""
    return F.coalesce(F.concat(F.substring(s, F.lit(1), at), middle(F.substring(s, at + 1, F.lit(1)), F.substring(s, at + 2, F.lit(_FAR)))), s)


def _first(s: Column, pattern: Column, new: Column) -> Column:
    """The first match of a pattern replaced."""
    return F.regexp_replace(s, F.concat(F.lit("(?i)^(.*?)(?:"), pattern, F.lit(")")), F.concat(F.lit("$1"), new))


def _on(split: Callable[[Column], Column], sep: str, least: int, change: Callable[[Column, Draws], Column]) -> Op:
    """An operator on the words or parts of a text that has at least so many."""
    return lambda s, d: F.when(F.size(split(s)) >= least, F.array_join(change(split(s), d), sep)).otherwise(s)


def _alone(word: str) -> str:
    return rf"(?<!\w)\Q{word}\E(?!\w)"


def _replaced(pairs: tuple[tuple[str, str], ...]) -> Op:
    """One of the listed words that occur becomes its partner."""
    both = [(a, b) for x, y in pairs for a, b in ((x, y), (y, x))]

    def op(s: Column, d: Draws) -> Column:
        options = F.filter(F.array(*[F.when(s.rlike(f"(?i){_alone(a)}"), F.struct(F.lit(_alone(a)).alias("a"), F.lit(b).alias("b"))) for a, b in both]), lambda x: x.isNotNull())
        one = d.pick(options)
        return F.coalesce(_first(s, one["a"], one["b"]), s)

    return op


def change_case(s: Column, d: Draws) -> Column:
    return F.when(s == F.upper(s), F.initcap(s)).otherwise(F.upper(s))


def typo(s: Column, d: Draws) -> Column:
    """A letter is left out, doubled, changed for a look-alike or a neighbour on the keyboard, or comes late."""
    beside = {c: row[i + 1] if i + 1 < len(row) else row[i - 1] for line in KEYBOARD for row in (line, line.upper()) for i, c in enumerate(row)}
    kind, at = d.below(5), d.pick(_where(_letters(s), lambda c: c.rlike(r"\p{L}")))
    return _around(
        s, at,
        lambda c, z: F.when((kind == 0) & (F.length(s) > 1), z)
        .when(kind == 1, F.concat(c, c, z))
        .when(kind == 2, F.concat(F.translate(c, LETTERS, LOOKALIKES), z))
        .when(kind == 3, F.concat(F.translate(c, "".join(beside), "".join(beside.values())), z))
        .otherwise(F.concat(F.substring(z, 1, 1), c, F.substring(z, F.lit(2), F.lit(_FAR)))),
    )


def accent(s: Column, d: Draws) -> Column:
    at = d.pick(_where(_letters(s), lambda c: c.rlike(f"[{VOWELS}]")))
    return _around(s, at, lambda c, z: F.concat(F.translate(c, VOWELS, ACCENTED), z))


def no_accents(s: Column, d: Draws) -> Column:
    return F.translate(s, *_plain_letters())


@cache
def _plain_letters() -> tuple[str, str]:
    """Accented Latin letters and their bare forms, by decomposition."""
    import unicodedata

    whole = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    held = [(a, b) for a, b in whole if a != b and b.isascii()]
    return "".join(a for a, _ in held), "".join(b for _, b in held)


def filler(s: Column, d: Draws) -> Column:
    return F.when(d.below(2) == 0, F.concat(d.one_of(LEADING), F.lit(" "), s)).otherwise(F.concat(s, F.lit(" "), d.one_of(TRAILING)))


def domain(s: Column, d: Draws) -> Column:
    body = F.regexp_replace(F.lower(no_accents(s, d)), "[^a-z0-9]", "")
    return F.when(body == "", s).when(d.hits(0.3), F.concat(F.lit("#"), body)).otherwise(F.concat(body, F.lit(".com")))


drop_word = _on(_words, " ", 2, lambda w, d: _without(w, d.below(F.size(w))))
truncate = _on(_words, " ", 2, lambda w, d: F.slice(w, F.lit(1), 1 + d.below(F.size(w) - 1)))
last_first = _on(_words, " ", 2, lambda w, d: F.concat(F.slice(w, -1, 1), F.slice(w, F.lit(1), F.size(w) - 1)))
next_word = _on(_words, " ", 2, lambda w, d: _exchanged(w, d.below(F.size(w) - 1)))
bracket = _on(_words, " ", 2, lambda w, d: _set(w, 1 + d.below(F.size(w) - 1), lambda x: F.concat(F.lit("("), x, F.lit(")"))))
swap_legal, swap_street = _replaced(LEGAL_PAIRS), _replaced(STREET_PAIRS)


def legal(s: Column, d: Draws) -> Column:
    """A legal form goes or becomes another; a name without one gets one."""
    held = sorted({f for words in load_lexicon().legal for f in words}, key=len, reverse=True)
    one = rf"(?<!\w)(?:{'|'.join(held)})(?!\w)\.?"
    found = s.rlike(f"(?i){one}")
    bare = F.trim(_first(s, F.lit(one), F.lit("")))
    changed = F.when(d.hits(0.6) & (bare != ""), bare).otherwise(_first(s, F.lit(one), d.one_of(SHORT_FORMS)))
    return F.when(found, changed).otherwise(F.concat(s, F.lit(" "), d.one_of(SHORT_FORMS)))


def ampersand(s: Column, d: Draws) -> Column:
    sign, word = r"\s&\s", r"\s(?:et|and)\s"
    return F.when(s.rlike(sign), _first(s, F.lit(sign), d.one_of((" and ", " et ", " ")))).when(s.rlike(f"(?i){word}"), _first(s, F.lit(word), F.lit(" & "))).otherwise(s)


def abbreviate(s: Column, d: Draws) -> Column:
    """A word that has a listed short form takes it, else a long word is cut after three or four letters."""
    short = {word: a for a, word in sorted(load_lexicon().abbreviations.items()) if " " not in word}
    table = literal_map(short)
    w, bare = _words(s), lambda x: F.regexp_replace(F.lower(x), "[.,]", "")
    known = d.pick(_where(w, lambda x: F.map_contains_key(table, bare(x))))
    long = d.pick(_where(w, lambda x: x.rlike(r"^\p{L}{7,}$")))
    letters = 3 + d.below(2)
    listed = F.array_join(_set(w, known, lambda x: F.concat(F.element_at(table, bare(x)), F.when(x.endswith(","), ",").otherwise(""))), " ")
    cut = F.array_join(_set(w, long, lambda x: F.concat(F.substring(x, F.lit(1), letters), F.lit("."))), " ")
    return F.when(known.isNotNull(), listed).when(long.isNotNull(), cut).otherwise(s)


null_part = _on(_parts, ", ", 0, lambda p, d: _with(p, d.below(F.size(p) + 1), F.lit("NULL")))
extra_part = _on(_parts, ", ", 0, lambda p, d: _with(p, d.below(F.size(p) + 1), d.one_of(EXTRA_PARTS)))
drop_part = _on(_parts, ", ", 2, lambda p, d: _without(p, d.below(F.size(p))))
next_part = _on(_parts, ", ", 2, lambda p, d: _exchanged(p, d.below(F.size(p) - 1)))


def _dealt_anew(p: Column, d: Draws) -> Column:
    """Parts in the order of a hash, or turned by one where that is the old order."""
    number = d.number()
    new = F.transform(F.array_sort(F.transform(p, lambda x, i: F.struct(F.xxhash64(number, i).alias("h"), x.alias("x")))), lambda t: t["x"])
    return F.when(new == p, F.concat(F.slice(p, -1, 1), F.slice(p, F.lit(1), F.size(p) - 1))).otherwise(new)


def _unit_toggled(p: Column, d: Draws) -> Column:
    at = F.array_min(_where(p, lambda x: x.rlike(r"(?i)^(?:#|(?:unit|po box|suite|fl)\b)")))
    unit = F.when(d.below(2) == 0, F.concat(F.lit("Unit "), 1 + d.below(998))).otherwise(F.concat(F.lit("PO BOX "), 100 + d.below(9899)))
    return F.when(at.isNotNull(), _without(p, at)).otherwise(_with(p, F.least(F.size(p), F.lit(1)), unit))


shuffle_parts = _on(_parts, ", ", 2, _dealt_anew)
toggle_unit = _on(_parts, ", ", 0, _unit_toggled)


def swap_state(country: Column) -> Op:
    """The first part that is a state's name or short form becomes the other one."""
    other: dict[str, str] = {}
    for land, states in load_lexicon().states.items():
        for short, name in states.items():
            other[f"{land}|{short}"] = name.title()
            other.setdefault(f"{land}|{name}", short.upper())
    table = literal_map(other)
    key = lambda p: F.concat(country, F.lit("|"), F.lower(p))

    def change(p: Column, d: Draws) -> Column:
        at = F.array_min(_where(p, lambda x: F.map_contains_key(table, key(x))))
        return F.when(at.isNull(), p).otherwise(_set(p, at, lambda x: F.element_at(table, key(x))))

    return _on(_parts, ", ", 1, change)


def reformat_house(s: Column, d: Draws) -> Column:
    """The first number with a leading zero, a trailing hyphen or a hyphen inside."""
    n = F.regexp_extract(s, r"\b(\d+)\b", 1)
    inside = F.concat(F.substring(n, 1, 1), F.lit("-"), F.substring(n, F.lit(2), F.lit(_FAR)))
    forms = F.array(F.concat(F.lit("0"), n), F.concat(n, F.lit("-")), F.when(F.length(n) > 1, inside).otherwise(F.concat(F.lit("0"), n)))
    return F.when(n == "", s).otherwise(_first(s, F.lit(r"\b\d+\b"), d.pick(forms)))


def other_house(s: Column, d: Draws) -> Column:
    """The first number that is no postal code goes, moves by up to two, gets a suffix or becomes a range."""
    mark = r"\b(?!\d{5,6}\b)\d{1,9}\b"
    n = F.regexp_extract(s, f"({mark})", 1)
    value, step = n.cast("long"), F.get(F.array(*map(F.lit, (-2, -1, 1, 2))), d.below(4))
    kinds = F.array(F.lit(""), F.greatest(value + step, F.lit(1)).cast("string"), F.concat(n, F.lit(" "), d.one_of(("bis", "ter", "B"))), F.concat_ws("-", n, (value + 2).cast("string")))
    new = _first(s, F.lit(mark), d.pick(kinds))
    return F.when(n == "", s).otherwise(F.regexp_replace(F.regexp_replace(new, r"\s{2,}", " "), "^[ ,]+|[ ,]+$", ""))


def no_postal(s: Column, d: Draws) -> Column:
    return F.when(s.rlike(POSTAL), F.regexp_replace(F.regexp_replace(F.regexp_replace(s, POSTAL, ""), r"\s{2,}", " "), "^[ ,]+|[ ,]+$", "")).otherwise(s)


#: Operators of the one-or-two rule, and those that fire at measured rates.
NAME_NOISE: dict[str, Op] = {"case": change_case, "typo": typo, "accent": accent, "filler": filler, "drop": drop_word, "truncate": truncate, "domain": domain, "legal": swap_legal, "reorder": last_first}
RATED_NAME: dict[str, Op] = {
    "case": change_case, "accent": no_accents, "accent_add": accent, "bracket": bracket, "amp": ampersand, "abbrev": abbreviate,
    "legal": legal, "drop": drop_word, "add": filler, "reorder": next_word, "typo": typo, "domain": domain,
}
RATED_ADDRESS: dict[str, Op] = {
    "null_token": null_part, "case": change_case, "accent": no_accents, "accent_add": accent, "abbrev": abbreviate, "comp_drop": drop_part,
    "comp_add": extra_part, "comp_reorder": next_part, "house": other_house, "postal_drop": no_postal, "typo": typo,
}


def address_noise(country: Column) -> dict[str, Op]:
    return {
        "case": change_case, "null": null_part, "drop": drop_part, "shuffle": shuffle_parts,
        "street": swap_street, "state": swap_state(country), "house": reformat_house, "unit": toggle_unit,
    }


def _passes(df: DataFrame, column: str, ops: dict[str, Op], turn: dict[str, Column], d: Draws) -> DataFrame:
    """``column`` after the operators of turn 0 and then those of turn 1, one projection each; no change leaves it empty."""
    turns = {k: f"__{column}_{i}" for i, k in enumerate(turn)}
    df = df.withColumns({turns[k]: c for k, c in turn.items()})
    for number in (0, 1):
        for k, at in turns.items():
            # other rows hand the operator a null, which ends it at once
            new = ops[k](F.when(F.col(at) == number, F.col(column)), d)
            df = df.withColumn("__new", new).withColumn(column, F.when(F.trim("__new") != "", F.col("__new")).otherwise(F.col(column)))
    return df.drop("__new", *turns.values())


def one_or_two(df: DataFrame, seed: int) -> DataFrame:
    """(id, name, address, country): one or two different operators a side; some addresses go altogether."""
    d = Draws(F.col("id"), seed)
    for column, ops in (("name", NAME_NOISE), ("address", address_noise(F.col("country")))):
        first, step, two = d.below(len(ops)), d.below(len(ops) - 1), d.below(2)
        second = F.when(two == 0, F.pmod(first + 1 + step, F.lit(len(ops))))
        turn = {k: F.when(F.col(column) != "", F.when(first == i, 0).when(second == i, 1)) for i, k in enumerate(ops)}
        df = _passes(df, column, ops, turn, d)
    return df.withColumn("address", F.when(d.hits(EMPTY_ADDRESS), "").otherwise(F.col("address")))


def at_rates(df: DataFrame, rates: dict[str, dict[str, float]], seed: int) -> DataFrame:
    """(id, name, address, country): every operator fires by itself at its rate.

    It does so in one of two passes, by a draw, so any two operators follow each
    other in either order.
    """
    d = Draws(F.col("id"), seed)
    for column, ops in (("name", RATED_NAME), ("address", RATED_ADDRESS)):
        fired = {k: r for k, r in rates.get(column, {}).items() if r > 0 and k in ops}
        turn = {k: F.when((F.col(column) != "") & d.hits(r), d.below(2)) for k, r in fired.items()}
        df = _passes(df, column, ops, turn, d)
    return df


# Measuring ------------------------------------------------------------------------

NAME_KINDS = ("same", "null", "script", "case", "accent", "domain", "amp", "legal", "reorder", "drop", "add", "abbrev", "typo")
ADDRESS_KINDS = ("same", "null", "script", "null_token", "case", "accent", "comp_drop", "comp_add", "comp_reorder", "house", "postal_drop", "abbrev", "typo")
_NON_LATIN = r"[^\x{0}-\x{24F}\x{1E00}-\x{1EFF}\x{2000}-\x{206F}]"


def _is_null(s: Column) -> Column:
    return F.trim(F.lower(s)).isin("", "null", "none", "nan")


def _tokens(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit("([a-z0-9]+)"), F.lit(1))


def _below(a: Column, b: Column) -> Column:
    """Whether the distinct items of ``a`` are a proper subset of those of ``b``."""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) > 0)


def _is_short_for(short: Column, long: Column) -> Column:
    """Begins alike, and its letters follow in order."""
    return (F.length(short) < F.length(long)) & F.rlike(long, F.concat(F.lit("^"), F.array_join(_letters(short), ".*")))


def _edits(a: Column, b: Column) -> tuple[Column, Column]:
    """(a word became short, a word was misspelt) among the words of one side only."""
    gone, new = F.array_except(a, b), F.array_except(b, a)
    brief = lambda x, y: _is_short_for(x, y) | _is_short_for(y, x)
    slip = lambda x, y: (F.length(x) >= 4) & (F.length(y) >= 4) & (F.levenshtein(x, y) <= 2) & ~brief(x, y)
    return tuple(F.exists(gone, lambda x: F.exists(new, lambda y: f(x, y))) for f in (brief, slip))


def _common(a: Column, b: Column, fa: Column, fb: Column) -> dict[str, Column]:
    """Kinds that names and addresses share, by the texts and their folded forms."""
    script = a.rlike(_NON_LATIN) != b.rlike(_NON_LATIN)
    return {
        "same": F.lit(False), "null": F.lit(False), "script": script, "case": (F.lower(a) == F.lower(b)) | ((a != F.upper(a)) & (b == F.upper(b))),
        "accent": ~script & (F.lower(a) != fa) & (F.lower(b) == fb),
    }


def _settled(kinds: dict[str, Column], order: tuple[str, ...], a: Column, b: Column) -> Column:
    """Equal texts are only ``same``, and a text that went is only ``null``."""
    out = []
    for k in order:
        if k == "same":
            c = (a == b) | (_is_null(a) & _is_null(b))
        elif k == "null":
            c = (a != b) & _is_null(b) & ~_is_null(a)
        else:
            c = (a != b) & ~_is_null(b) & kinds[k]
        out.append(c.alias(k))
    return F.struct(*out)


def name_kinds(a: Column, b: Column, fa: Column, fb: Column) -> Column:
    """Which kinds of noise lead from one name to the other; several may."""
    forms = sorted({w for words in load_lexicon().legal for w in words})
    wa, wb = _tokens(fa), _tokens(fb)
    is_form = lambda w: w.isin(forms)
    form, rest = (lambda w: F.array_sort(F.array_distinct(F.filter(w, is_form)))), (lambda w: F.filter(w, lambda x: ~is_form(x)))
    ca, cb = rest(wa), rest(wb)
    joins = lambda s, w: s.contains("&") | F.array_contains(w, "and") | F.array_contains(w, "et")
    brief, slip = _edits(ca, cb)
    kinds = _common(a, b, fa, fb) | {
        "domain": domain_col(fb) & ~domain_col(fa), "amp": joins(a, wa) != joins(b, wb), "legal": form(wa) != form(wb),
        "reorder": (ca != cb) & (F.array_sort(ca) == F.array_sort(cb)), "drop": _below(cb, ca), "add": _below(ca, cb), "abbrev": brief, "typo": slip,
    }
    return _settled(kinds, NAME_KINDS, a, b)


def address_kinds(a: Column, b: Column, fa: Column, fb: Column) -> Column:
    wa, wb = _tokens(fa), _tokens(fb)
    plain = lambda w: F.filter(w, lambda x: x != "null")
    number = lambda f: F.regexp_extract(f, r"\b(?!\d{5,6}\b)(\d[\d/-]*[a-z]?)\b", 1)
    ca, cb = plain(wa), plain(wb)
    brief, slip = _edits(ca, cb)
    kinds = _common(a, b, fa, fb) | {
        "null_token": F.array_contains(wb, "null") & ~F.array_contains(wa, "null"),
        "comp_drop": F.size(_parts(b)) < F.size(_parts(a)), "comp_add": F.size(_parts(b)) > F.size(_parts(a)),
        "comp_reorder": (ca != cb) & (F.array_sort(ca) == F.array_sort(cb)), "house": (number(fa) != "") & (number(fa) != number(fb)),
        "postal_drop": a.rlike(POSTAL) & ~b.rlike(POSTAL), "abbrev": brief, "typo": slip,
    }
    return _settled(kinds, ADDRESS_KINDS, a, b)


def noise_rates(pairs: DataFrame, a: str, b: str, by: list[str], side: str = "name") -> DataFrame:
    """Mean of every kind by group, for pairs of names or (``side="address"``) addresses."""
    kinds, order = (name_kinds, NAME_KINDS) if side == "name" else (address_kinds, ADDRESS_KINDS)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    folded = pairs.select(*by, text(a).alias("__a"), text(b).alias("__b"), fold_col(text(a)).alias("__fa"), fold_col(text(b)).alias("__fb"))
    t = folded.select(*by, kinds(*(F.col(c) for c in ("__a", "__b", "__fa", "__fb"))).alias("__kinds"))
    return t.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col("__kinds").getField(k).cast("int")).alias(k) for k in order])
