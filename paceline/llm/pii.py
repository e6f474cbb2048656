"""Personal data: detected entities are replaced by keyed surrogates of their type.

Built-in expressions only.  A value has one surrogate in the whole corpus, made
by hashing it with a key, so mentions that belong together stay together.  A
surrogate keeps the format (digits for digits, letters for letters, separators
where they were), the script and the gender of a name, a card's check digit.
Cyrillic family names that differ in the ending of gender alone are one value.
Surrogates are checked over the corpus: no two values share one, and none is a
value that occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.session import materialize

#: Titles before names, by gender of the name they announce.
TITLES = {
    "m": ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Signor", "господин"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Signora", "госпожа"),
    # Of these the given name's ending decides.
    "": ("Dr", "Prof", "Dra"),
}

#: Names are put together from a start, a middle and an end.  Cyrillic family names stand
#: here as men have them; a woman's gets FEMININE at the end.
_GIVEN = {
    "m_latin": (("Al", "Ber", "Con", "Da", "Ed", "Fer", "Gil", "Har", "Jo", "Leo", "Mar", "Ro"), ("an", "ber", "di", "fre", "lan", "mon", "ri", "vi"), ("d", "l", "n", "rt", "s", "us")),
    "f_latin": (("A", "Bea", "Cla", "Da", "Eli", "Flo", "Gre", "He", "Jo", "Lu", "Ma", "Ro"), ("bri", "di", "la", "li", "ni", "ri", "sa", "vi"), ("a", "e", "lla", "na", "nne", "ra")),
    "m_cyrillic": (("Ан", "Бо", "Вик", "Гри", "Дми", "Лео", "Ма", "Па", "Ро", "Се", "Фё", "Юр"), ("га", "до", "ми", "ни", "ри", "ро", "та", "ти"), ("в", "й", "л", "н", "р", "с")),
    "f_cyrillic": (("А", "Ва", "Га", "Да", "Еле", "Жа", "Ири", "Ла", "Ма", "Ни", "Та", "Юли"), ("ви", "ди", "ли", "ми", "на", "ри", "си", "ти"), ("ва", "да", "ла", "на", "ра", "я")),
}
_FAMILY = {
    "latin": (("Bar", "Ben", "Cal", "Dor", "El", "Far", "Gal", "Hol", "Ken", "Lor", "Mar", "Nor", "Pel", "Ros", "Sal", "Tor", "Ver", "Wal"), ("an", "ber", "co", "den", "fi", "gar", "li", "mon", "ne", "ri", "so", "ta", "ven", "wi"), ("by", "der", "ford", "held", "lin", "man", "mer", "ner", "rio", "sen", "son", "ton", "vel", "well")),
    "cyrillic": (("Бар", "Вол", "Гор", "Дан", "Еф", "Жар", "Зар", "Кал", "Лар", "Мор", "Нов", "Пан", "Рад", "Сав", "Тар", "Фад"), ("а", "бо", "ви", "го", "де", "ки", "ло", "ми", "ни", "ра", "со", "ти"), ("ев", "ин", "ков", "лов", "нов", "ров", "тин", "шин")),
}

FEMININE = "а"

_TITLE = "|".join(sorted((t for g in TITLES.values() for t in g), key=len, reverse=True))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: First digits of cards, and the ways their numbers are grouped; at one place each reads one number at most.
_ISSUER = r"(?:[3-6]\d{3}|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720))"
_GROUPED = (
    rf"{_ISSUER}(?:[ -]?\d{{4}}){{3}}[ -]?\d{{1,3}}",
    rf"{_ISSUER}(?:[ -]?\d{{4}}){{2}}[ -]?\d{{1,7}}",
    r"3\d{3}[ -]?\d{6}[ -]?\d{4,5}",
)
_CARD = [rf"(?<![\p{{L}}\d]){g}(?![\p{{L}}\d])" for g in _GROUPED]
_SECRET_KEY = r"(?i:password|passwd|pwd|token|secret|api[_-]?key)"
_SECRET_HEAD = rf"{_SECRET_KEY}[\"']?[ \t]*[=:][ \t]*"
#: A part of a name: letters, with hyphens and apostrophes inside, or an initial.
_NAME_PART = r"\p{Lu}(?:\p{L}*(?:['’-](?!s(?!\p{L}))\p{L}+)+|\p{L}+|\.)"
_HEX = "[0-9A-Fa-f]{1,4}"

#: What is looked for, in the order in which overlapping readings are preferred.
PATTERNS: dict[str, str] = {
    "secret": rf"{_SECRET_HEAD}(?:\"[^\"\n]{{8,}}\"|'[^'\n]{{8,}}'|[\"']?[^\s\"'<>,;]{{7,}}[^\s\"'<>,;.!?)]\b?)",
    "key": r"\bAKIA[0-9A-Z]{12,20}\b",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "name": rf"(?<!\p{{L}})(?:{_TITLE})\.?\s{{1,3}}{_NAME_PART}(?:[ \t\x{{a0}}]{{1,3}}{_NAME_PART}){{0,3}}",
    "ip6": rf"(?<![\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![\w:])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)"
    r"|(?<![\d+])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d)",
    # Of these only numbers with a valid check digit are cards (see ``reading``).
    "card": "|".join(_CARD),
}

ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_NO_CARD = "|".join(f"(?:{p})" for kind, p in PATTERNS.items() if kind != "card")

#: A text with none of these signs, none of these title beginnings and no beginning of
#: an access key (which may be all letters) holds no entity; most texts end here,
#: after one pass for the signs and a search per beginning.
_SIGNS = "[0-9@=:]"
_BEGINNINGS = sorted(t for g in TITLES.values() for t in g)
_BEGINNINGS = [t for i, t in enumerate(_BEGINNINGS) if not any(t.startswith(x) for x in _BEGINNINGS[:i])] + ["AKIA"]

#: A surrogate that is taken is drawn again, so often at most.
ATTEMPTS = 40

_DIGIT_TYPES = ("phone", "card", "ssn")


def may_hold(text: Column) -> Column:
    """Whether a text can hold an entity at all."""
    out = text.rlike(_SIGNS)
    for beginning in _BEGINNINGS:
        out = out | text.contains(beginning)
    return out


def cards(text: Column) -> Column:
    """The card numbers of a text as alternatives of a pattern, longest first; '' if there are none.

    Every place is tried, so a number that is no card hides none that overlaps it.
    """
    tried = [F.regexp_extract_all(text, F.lit(f"(?=({p}))"), F.lit(1)) for p in _CARD]
    valid = F.filter(F.array_distinct(F.concat(*tried)), lambda c: _luhn_sum(F.regexp_replace(c, r"\D", "")) % 10 == 0)
    longest = F.sort_array(F.transform(valid, lambda c: F.struct(F.length(c).alias("n"), c.alias("c"))), asc=False)
    found = F.array_join(F.transform(longest, lambda x: x["c"]), "|")
    return F.when(text.rlike(r"\d{3}[ -]?\d{4}"), found).otherwise(F.lit(""))


def known_names(text: Column) -> Column:
    """The names of two parts or more that stand after a title somewhere in a text, as alternatives of a
    pattern, longest first; '' if there are none.  Without their title they are the same person's."""
    titled = F.regexp_extract_all(text, F.lit(PATTERNS["name"]), F.lit(0))
    bare = F.array_distinct(F.transform(titled, _bare))
    full = F.filter(bare, lambda x: x.rlike(r"\s\p{L}{2,}[^\s]*$") & x.rlike(r"^\p{L}{2,}"))
    longest = F.sort_array(F.transform(full, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))), asc=False)
    found = F.array_join(F.transform(longest, lambda x: F.regexp_replace(x["x"], r"([.|()\[\]{}*+?^$\\])", r"\\$1")), "|")
    has = F.lit(False)
    for title in (t for g in TITLES.values() for t in g):
        has = has | text.contains(title)
    return F.when(has, found).otherwise(F.lit(""))


def _bare(raw: Column) -> Column:
    """A name without its title."""
    return F.regexp_replace(raw, rf"^(?:{_TITLE})\.?\s{{1,3}}", "")


def reading(cards: Column, names: Column) -> Column:
    """The pattern that finds the entities of a text with these ``cards`` and known ``names``."""
    own = F.when(cards == "", F.lit("")).otherwise(F.concat(F.lit(r"|(?<![\p{L}\d])(?:"), cards, F.lit(r")(?![\p{L}\d])")))
    known = F.when(names == "", F.lit("")).otherwise(F.concat(F.lit(r"|(?<!\p{L})(?:"), names, F.lit(r")(?![\p{L}])")))
    return F.concat(F.lit(_NO_CARD), own, known)


def kind_of(raw: Column) -> Column:
    """The type of a found string: the first pattern that reads it whole."""
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in PATTERNS.items():
        out = out.when(raw.rlike(rf"^(?:{pattern})$"), F.lit(name))
    return out


def _pick(h: Column, at: int, options: tuple[str, ...]) -> Column:
    """One of the options by three hash digits from place ``at``."""
    n = F.conv(F.substring(h, at, 3), 16, 10).cast("int")
    return F.element_at(F.array(*map(F.lit, options)), n % len(options) + 1)


def _same_shape(value: Column, h: Column) -> Column:
    """Digits for digits, letters for letters of the same case (a to f within hexadecimal values), the rest kept."""
    hexadecimal = value.rlike("^[0-9a-f:]+$")
    n = lambda i: F.conv(F.substring(h, F.pmod(i * 2, F.lit(63)) + 1, F.lit(2)), 16, 10).cast("int")
    letters, capitals = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    # A first digit other than 0 stays other than 0, as numbers keep their length.
    mapped = F.transform(
        F.split(value, ""),
        lambda c, i: F.when(c.rlike("[1-9]"), F.when(i == 0, (n(i) % 9 + 1).cast("string")).otherwise((n(i) % 10).cast("string")))
        .when(c == "0", (n(i) % 10).cast("string"))
        .when(c.rlike("[a-f]") & hexadecimal, F.substring(F.lit(letters), n(i) % 6 + 1, F.lit(1)))
        .when(c.rlike("[a-z]"), F.substring(F.lit(letters), n(i) % 26 + 1, F.lit(1)))
        .when(c.rlike("[A-Z]"), F.substring(F.lit(capitals), n(i) % 26 + 1, F.lit(1)))
        .otherwise(c),
    )
    return F.array_join(mapped, "")


def _luhn_sum(digits: Column) -> Column:
    """The sum of a digit string under which a multiple of 10 is a valid number."""
    d = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)
        ),
    )
    return F.aggregate(d, F.lit(0), lambda a, x: a + x)


def iban_rest(iban: Column) -> Column:
    """An account number's remainder by 97, 1 if it is valid: first four signs last, letters as 10 to 35."""
    signs = F.split(F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4)), "")
    digit = lambda c: c.rlike("[0-9]")
    return F.aggregate(
        signs, F.lit(0), lambda a, c: F.when(digit(c), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    )


def _iban(value: Column, h: Column) -> Column:
    """The country kept, and check digits that are right."""
    country, body = F.substring(value, 1, 2), _same_shape(F.substring(value, F.lit(5), F.length(value)), h)
    check = F.lit(98) - iban_rest(F.concat(country, F.lit("00"), body))
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), body)


def _card(value: Column, h: Column) -> Column:
    """The first digit kept, in the range of cards with 2 first; a last digit that checks."""
    n = F.length(value)
    first = F.substring(value, 1, 1)
    head = F.concat(first, _same_shape(F.substring(value, F.lit(2), n - 2), h))
    ranged = (F.conv(F.substring(h, 61, 4), 16, 10).cast("int") % 500 + 2221).cast("string")
    head = F.when(first == "2", F.concat(ranged, F.substring(head, F.lit(5), n))).otherwise(head)
    check = (F.lit(10) - _luhn_sum(F.concat(head, F.lit("0"))) % 10) % 10
    return F.concat(head, check.cast("string"))


def surrogate(kind: Column, value: Column, key: str, attempt: int) -> Column:
    """The surrogate of an entity at an attempt.  Names get another middle every
    fourth attempt, numbers and secrets another sign every eighth, so there are
    enough of them for any number of values."""
    h = F.sha2(F.concat_ws("|", F.lit(key), kind, value, F.lit(str(attempt))), 256)
    octet = lambda at, low, n: (F.conv(F.substring(h, at, 4), 16, 10).cast("int") % n + low).cast("string")
    user, domain = F.split_part(value, F.lit("@"), F.lit(1)), F.split_part(value, F.lit("@"), F.lit(2))
    top = F.regexp_extract(domain, r"\.[a-z]+$", 0)

    def names(parts: tuple) -> Column:
        first, middle, last = parts
        return F.concat(*[_pick(h, 1 + 4 * k, p) for k, p in enumerate([first, *[middle] * (1 + attempt // 4), last])])

    out = F.when(kind == "email", F.concat(
        _same_shape(user, h), F.lit("@"), _same_shape(F.regexp_replace(domain, r"\.[a-z]+$", ""), F.sha2(h, 256)), top))
    # Public addresses: first number 11 to 98, none of it private or reserved.
    out = out.when(kind == "ip", F.concat_ws(".", octet(1, 11, 88), octet(5, 0, 256), octet(9, 0, 256), octet(13, 1, 254)))
    out = out.when(kind == "card", _card(value, h)).when(kind == "iban", _iban(value, h))
    # What makes a key one stays.
    out = out.when(kind == "key", F.concat(F.lit("AKIA"), _same_shape(F.substring(value, F.lit(5), F.length(value)), h)))
    for tag, parts in _GIVEN.items():
        out = out.when(kind == f"given_{tag}", names(parts))
    for tag, parts in _FAMILY.items():
        out = out.when(kind == f"family_{tag}", names(parts))
    more = F.substring(F.conv(F.substring(h, 50, 12), 16, 10), 1, attempt // 8)
    return out.otherwise(F.concat(_same_shape(value, h), more))


def _feminine(raw: Column) -> Column:
    """Whether a name stands after a woman's title, or after one that tells nothing and ends like a woman's."""
    neutral = rf"^(?:{'|'.join(TITLES[''])})(?:\.|\s)"
    return raw.rlike(rf"^(?:{'|'.join(TITLES['f'])})(?:\.|\s)") | raw.rlike(neutral) & _bare(raw).rlike(r"^\p{L}+[aаяe]\s")


def _stem(family: Column) -> Column:
    """A Cyrillic family name without what its gender adds: Петрова is Петров, Белая and Белый are one."""
    out = F.regexp_replace(family, "(?iu)(?<=\\p{L}(?:ов|ев|ёв|ин|ын))а$", "")
    return F.regexp_replace(out, "(?iu)(?<=\\p{L}{3})(?:ый|ий|ой|ая|яя)$", "")


def _entities(mentions: DataFrame) -> DataFrame:
    """Mentions (raw, titled, kind) with ``parts``: the values to be replaced, their kinds and, in names, the
    number of the word.  Initials are no values and stay.  ``titled`` is a name with the title it has elsewhere."""
    raw, titled, kind = F.col("raw"), F.col("titled"), F.col("kind")
    digits = F.regexp_replace(raw, r"\D", "")
    country = F.regexp_extract(raw, r"^\+\d{1,3}(?=[ .(-])", 0)
    value = (
        F.when(kind == "email", F.lower(raw))
        .when(kind == "secret", F.regexp_extract(raw, rf"^{_SECRET_HEAD}[\"']?(.*?)[\"']?$", 1))
        .when(kind == "phone", F.regexp_replace(F.expr("substring(raw, length(country) + 1)"), r"\D", ""))
        .when(kind == "iban", F.replace(raw, F.lit(" "), F.lit("")))
        .when(kind.isin("card", "ssn"), digits)
        .otherwise(raw)
    )
    gender = F.when(_feminine(titled), F.lit("f")).otherwise(F.lit("m"))
    words = F.split(_bare(raw), r"\s+")
    script = lambda w: F.when(w.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin"))
    part = lambda k, v, nr: F.struct(k.alias("kind"), v.alias("value"), nr.alias("nr"))

    def of_word(w: Column, i: Column) -> Column:
        family = part(F.concat(F.lit("family_"), script(w)), F.when(script(w) == "cyrillic", _stem(w)).otherwise(w), i)
        return F.when(i == F.size(words) - 1, family).otherwise(part(F.concat_ws("_", F.lit("given"), gender, script(w)), w, i))

    named = F.filter(F.transform(words, of_word), lambda p: ~p["value"].rlike(r"^\p{L}\.?$"))
    parts = F.when(kind == "name", named)
    return mentions.withColumn("country", F.when(kind == "phone", country).otherwise(F.lit(""))).withColumn(
        "parts", parts.otherwise(F.array(part(kind, value, F.lit(0))))
    )


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) of the distinct entities; surrogates are distinct
    within a kind and none of them is an entity's value.

    Values whose surrogate is taken draw again, the value of least hash keeping
    it, until none is left.
    """
    pending = materialize(entities.select("kind", "value").distinct(), "entities")
    values = pending.select("kind", F.col("value").alias("surrogate"))
    done: DataFrame | None = None
    for attempt in range(ATTEMPTS):
        drawn = pending.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), key, attempt))
        winner = drawn.groupBy("kind", "surrogate").agg(F.min(F.struct(F.xxhash64("value"), "value")).alias("w"))
        free = winner.select("kind", F.col("w.value").alias("value"), "surrogate").join(values, ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done, ["kind", "surrogate"], "left_anti")
        got = materialize(free.select("kind", "value", "surrogate"), "surrogates")
        done = got if done is None else done.unionByName(got)
        pending = pending.join(got, ["kind", "value"], "left_anti")
        if pending.isEmpty():
            return done
        pending = materialize(pending, "entities")
    raise RuntimeError("too few surrogates for so many values of one kind")


def _render(raw: Column, kind: Column, to: Column) -> Column:
    """A mention with its parts' surrogates ``to`` (by the parts' numbers) put where the values were."""
    one = F.element_at(to, F.lit(0))
    country = F.col("country")
    rest = F.expr("substring(raw, length(country) + 1)")
    # Digits (or, for account numbers, all but spaces) are taken from the surrogate in order.
    fill = lambda text, keep: F.aggregate(
        F.split(text, ""),
        F.struct(F.lit("").alias("s"), F.lit(1).alias("i")),
        lambda a, c: F.struct(
            F.concat(a["s"], F.when(c.rlike(keep), c).otherwise(F.substring(one, a["i"], F.lit(1)))).alias("s"),
            (a["i"] + F.when(c.rlike(keep), 0).otherwise(1)).alias("i"),
        ),
        # A surrogate may be longer than what it stands for.
        lambda a: F.concat(a["s"], F.substring(one, a["i"], F.length(one))),
    )
    title = F.regexp_extract(raw, rf"^(?:{_TITLE})\.?\s{{1,3}}", 0)
    bare = _bare(raw)
    words, gaps = F.split(bare, r"\s+"), F.regexp_extract_all(bare, F.lit(r"\s+"), F.lit(0))
    put = F.transform(words, lambda w, i: F.concat(F.coalesce(F.try_element_at(to, i), w), F.coalesce(F.get(gaps, i), F.lit(""))))
    ending = F.when(_feminine(F.col("titled")) & raw.rlike(r"\p{IsCyrillic}\p{L}*$"), F.lit(FEMININE)).otherwise(F.lit(""))
    head = F.regexp_extract(raw, rf"^({_SECRET_HEAD}[\"']?)", 1)
    tail = F.regexp_extract(raw, r"[\"']$", 0)
    return (
        F.when(kind == "name", F.concat(title, F.array_join(put, ""), ending))
        .when(kind == "secret", F.concat(head, one, tail))
        .when(kind == "email", F.when(raw == F.upper(raw), F.upper(one)).otherwise(one))
        .when(kind == "iban", fill(raw, " "))
        .when(kind.isin(*_DIGIT_TYPES), F.concat(country, fill(rest, r"\D")))
        .otherwise(one)
    )


def replace_entities(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text`` and the column n_replaced (long).

    ``key`` is a secret: who knows it can look surrogates up.  Texts without an entity
    stay byte for byte, null stays null; numbers that look like cards or accounts and do
    not check are none.  Equal values get equal surrogates wherever they stand; names of
    two parts or more that follow a title in a text are found in it without the title
    too.  Rows that repeat are replaced alike.  An empty table gives no rows; a column
    n_replaced is replaced.
    """
    names = [c for c in docs.columns if c != "n_replaced"]
    t = F.col(text)
    pattern = reading(F.col("__cards"), F.col("__names"))
    found = F.when(may_hold(t), F.regexp_extract_all(t, pattern, F.lit(0)))
    tagged = docs.select(*names).withColumn("__cards", F.when(may_hold(t), cards(t)).otherwise(F.lit("")))
    tagged = tagged.withColumn("__names", F.when(may_hold(t), known_names(t)).otherwise(F.lit("")))
    tagged = tagged.withColumn("__found", F.coalesce(found, F.array().cast("array<string>")))
    tagged = materialize(tagged.withColumn("__key", F.monotonically_increasing_id()), "tagged")
    plain = tagged.filter(F.size("__found") == 0)
    hit = tagged.filter(F.size("__found") > 0)
    # A name without its title is that of the first mention that has it.
    with_title = lambda x: F.filter("__found", lambda y: y.endswith(x) & y.rlike(rf"^(?:{_TITLE})\.?\s"))
    pair = F.transform("__found", lambda x: F.struct(x.alias("raw"), F.coalesce(F.get(with_title(x), F.lit(0)), x).alias("titled")))
    named_only = F.when(F.col("__names") == "", F.transform("__found", lambda x: F.struct(x.alias("raw"), x.alias("titled")))).otherwise(pair)
    mentions = hit.select("__key", F.posexplode(named_only).alias("at", "m")).select("__key", "at", "m.raw", "m.titled")
    mentions = mentions.withColumn("kind", F.coalesce(kind_of(F.col("raw")), F.lit("name")))
    # Account numbers that do not check stay as they are.
    mentions = mentions.filter((F.col("kind") != "iban") | (iban_rest(F.replace("raw", F.lit(" "), F.lit(""))) == 1))
    mentions = _entities(mentions)
    parts = mentions.select("__key", "at", "raw", "titled", F.col("kind").alias("mention"), "country", F.explode("parts").alias("part"))
    parts = materialize(
        parts.select("__key", "at", "raw", "titled", "mention", "country", "part.nr", "part.kind", "part.value"), "mentions"
    )
    named = parts.join(assign(parts, key), ["kind", "value"])
    done = (
        named.groupBy("__key", "at")
        .agg(
            F.first("raw").alias("raw"),
            F.first("titled").alias("titled"),
            F.first("mention").alias("mention"),
            F.first("country").alias("country"),
            F.map_from_entries(F.collect_list(F.struct("nr", "surrogate"))).alias("to"),
        )
        .withColumn("new", _render(F.col("raw"), F.col("mention"), F.col("to")))
        .groupBy("__key")
        .agg(F.map_from_entries(F.collect_list(F.struct("at", "new"))).alias("__new"))
    )
    between = F.split(t, pattern, -1)
    piece = lambda x, i: F.concat(x, F.coalesce(F.try_element_at("__new", i), F.get("__found", i), F.lit("")))
    filled = F.array_join(F.transform("__between", piece), "")
    replaced = hit.join(done, "__key", "left").withColumn("__between", between).withColumn(text, filled)
    zero = F.lit(0).cast("bigint").alias("n_replaced")
    return plain.select(*names, zero).unionByName(
        replaced.select(*names, F.coalesce(F.size("__new"), F.lit(0)).cast("bigint").alias("n_replaced"))
    )
