"""PII surrogates (native).

Detected entities are replaced by keyed surrogates of the same type and form:
letters by letters of the same case and script, digits by digits, separators
kept; names by names of the same gender and script; card numbers that pass the
Luhn check by numbers that pass it; octets by octets.

An entity is made of units in canonical form: an address in lower case, a number
without its separators, the bare value of a secret without its key word, a
surname, a first name. A unit has one surrogate over the whole corpus, so all
its written forms agree (coreference): «Mrs. Jennifer Miller», «Jennifer Miller»
and «Mrs. Miller» stay one person, of one surname. Surrogates of units are
checked: two units must not share one, and none may be a unit of the corpus;
what collides is drawn again with all its forms, until nothing collides. Made-up
names, addresses and secrets grow by a syllable or a sign with each further draw
after the third, so there is always room.

Listed first names are exchanged by a keyed permutation of their list (same
gender and script). Other first names, known by the title before them, become a
listed one joined with made-up syllables. After a title that says no gender, the
gender of an unlisted first name is drawn from the key.

Entities: e-mail addresses, secrets after a key word, US social security
numbers, IBANs, IPv4 addresses, payment-card-like numbers of 13 to 19 digits,
phone numbers, and person names (a title or a listed first name, then one or two
capitalised words). A name without title and listed first name is not found, and
a listed first name before any capitalised word counts as one.

Defined cases
    null text: stays null; empty text: stays empty; no entity: unchanged to the
    byte; null doc_id: replaced like any other; repeated rows: each replaced
    alike; empty table: no rows; all columns are kept, whatever their names.

Scale: surrogates come from a keyed hash inside the row, without any join. Only
distinct units are shuffled for the check. The few that collide form a table of
draws, joined by unit to the documents' units (never to the text), and by the
set of units, broadcast up to a counted bound and by shuffle beyond it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docdelta.llm.exprs import bind, let
from docdelta.plans.scratch import materialize

# What is recognised, in order of precedence.
TITLES = {"mr": "m", "mister": "m", "herr": "m", "monsieur": "m", "señor": "m", "sr": "m", "mrs": "f", "ms": "f", "miss": "f", "frau": "f", "madame": "f", "mademoiselle": "f", "señora": "f", "señorita": "f", "sra": "f", "dr": "n", "prof": "n", "г-н": "m", "г-жа": "f", "господин": "m", "госпожа": "f"}
FIRST = {
    "latin": {
        "m": ["James", "Robert", "Michael", "William", "Thomas", "Charles", "Daniel", "Matthew", "Anthony", "Joseph", "Friedrich", "Wolfgang", "Heinrich", "Jürgen", "François", "Guillaume", "Laurent", "Alejandro", "Fernando", "Santiago"],
        "f": ["Jennifer", "Elizabeth", "Barbara", "Margaret", "Patricia", "Jessica", "Rebecca", "Dorothy", "Victoria", "Katherine", "Hannelore", "Friederike", "Annegret", "Brigitte", "Françoise", "Geneviève", "Mathilde", "Guadalupe", "Valentina", "Esperanza"],
    },
    "cyrillic": {
        "m": ["Александр", "Дмитрий", "Сергей", "Николай", "Владимир", "Михаил", "Алексей", "Андрей", "Григорий", "Константин"],
        "f": ["Екатерина", "Анастасия", "Наталья", "Татьяна", "Светлана", "Людмила", "Валентина", "Маргарита", "Елизавета", "Александра"],
    },
}
SYLLABLES = {
    "latin": ["bar", "ben", "cal", "dor", "fen", "gar", "hal", "ker", "lan", "mar", "nor", "pel", "ros", "sal", "tor", "wen"],
    "cyrillic": ["бар", "вел", "гор", "дан", "жар", "зор", "кар", "лан", "мир", "нов", "пол", "рос", "сав", "тих", "фед", "чер"],
}
_NAME = r"\p{Lu}\p{Ll}+(?:[-']\p{Lu}\p{Ll}+)?"
_FIRSTS = "|".join(n for by in FIRST.values() for names in by.values() for n in names)
_TITLE = r"(?iu:" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")\.?\x20"
PATTERNS = {
    "email": r"[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "secret": r"(?i:(?:api[_-]?key|access[_-]?key|secret|token|password|passwd|pwd)\x20?[=:]\x20?[\"']?)[A-Za-z0-9+/_=.-]{8,}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv4": r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])|\+[0-9]{8,15}(?![0-9])",
    "name": rf"(?:{_TITLE}{_NAME}(?:\x20{_NAME})?|(?:{_FIRSTS})\x20{_NAME})(?!\p{{L}})",
}
_ANY = r"(?<![\p{L}\p{N}_@.+-])(?:" + "|".join(PATTERNS.values()) + ")"
# Every entity has one of these; a text without any is left as it is.
_HINT = rf"[0-9@=:]|\p{{Lu}}\p{{Ll}}+\.?\x20\p{{Lu}}|{_TITLE}\p{{Lu}}"
_UNITS = "array<struct<kind:string,value:string>>"
#: Draws after which a made-up surrogate may grow.
SHORT_DRAWS = 3


def _starts(entity: Column, pattern: str) -> Column:
    return entity.rlike(f"^(?:{pattern})$")


def kind_of(entity: Column) -> Column:
    out = F.when(_starts(entity, PATTERNS["email"]), "email")
    for kind in list(PATTERNS)[1:]:
        out = out.when(_starts(entity, PATTERNS[kind]), kind)
    return out.otherwise("name")


def _key_part(entity: Column) -> Column:
    """The part of a secret that stays: the key word and its sign."""
    return F.regexp_extract(entity, r"^((?i:api[_-]?key|access[_-]?key|secret|token|password|passwd|pwd)\x20?[=:]\x20?[\"']?)", 1)


# ---- units ----------------------------------------------------------------


def _title(entity: Column) -> Column:
    return F.regexp_extract(entity, f"^({_TITLE})", 1)


def _said_gender(title: Column) -> Column:
    word = F.lower(F.regexp_replace(title, r"[.\x20]", ""))
    return F.coalesce(*(F.when(word.isin([t for t, g in TITLES.items() if g == gender]), gender) for gender in "mf"), F.lit("n"))


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def _listed(word: Column) -> Column:
    return word.isin([n for by in FIRST.values() for names in by.values() for n in names])


def _unit(kind: Column | str, value: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), value.alias("value"))


def units_of(entity: Column) -> Column:
    """The units that a written entity is made of; a listed first name is none, as it needs no draw."""

    def named(e: Column) -> Column:
        title, words = _title(e), F.split(F.regexp_replace(e, f"^{_TITLE}", ""), " ")
        first = F.get(words, F.lit(0))
        family = F.array(_unit(F.concat(F.lit("surname-"), _script(F.element_at(words, -1))), F.element_at(words, -1)))
        given = F.array(_unit(F.concat_ws("-", F.lit("first"), _script(first), _said_gender(title)), first))
        return F.when((F.size(words) > 1) & ~_listed(first), F.concat(family, given)).otherwise(family)

    def told(e: Column, kind: Column) -> Column:
        bare = F.regexp_replace(e, "[^0-9A-Za-z+]", "")
        value = F.substring(e, F.length(_key_part(e)) + 1, F.length(e))
        return (
            F.when(kind == "name", named(e)).when(kind == "email", F.array(_unit("email", F.lower(e)))).when(kind == "secret", F.array(_unit("secret", value)))
            .when(kind == "ipv4", F.array(_unit("ipv4", e))).otherwise(F.array(_unit(kind, bare)))
        )

    return bind(entity, lambda e: bind(kind_of(e), lambda kind: told(e, kind)))


# ---- drawing --------------------------------------------------------------


def _nibbles(seed: Column, n: Column) -> Column:
    """At least n hex digits derived from the seed."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(n / 64).cast("int")), lambda i: F.sha2(F.concat_ws("|", seed, i.cast("string")).cast("binary"), 256)), "")


def _bytes(seed: Column, n: Column) -> Column:
    """At least n numbers from 0 to 255 derived from the seed, as an array."""
    pairs = F.regexp_extract_all(_nibbles(seed, n * 2), F.lit(".."), F.lit(0))
    return F.transform(pairs, lambda p: F.conv(p, 16, 10).cast("int"))


def _like(text: Column, seed: Column, skip: bool = False) -> Column:
    """Each letter or digit by another of its class; the rest stays.

    With ``skip`` (numbers, which are short), separators do not count, so that a
    number written with and without them gets the same digits.
    """
    return bind(_bytes(seed, F.length(text)), lambda stream: _like_stream(text, stream, skip))


def _like_stream(text: Column, stream: Column, skip: bool) -> Column:
    place = lambda i: F.length(F.regexp_replace(F.substring(text, F.lit(1), i), r"[^\p{L}\p{N}]", "")) if skip else i
    value = lambda i: F.get(stream, place(i))
    shift = lambda code, low, span, i: F.char(F.lit(low) + (code - low + value(i)) % span)
    cyr = lambda low, i: F.substring(F.lit("абвгдежзиклмнопрстуфхцчшэюя" if low else "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"), value(i) % 27 + 1, F.lit(1))

    def one(c: Column, i: Column) -> Column:
        code = F.ascii(c)
        return (
            F.when(c.rlike("^[0-9]$"), shift(code, 48, 10, i))
            .when(c.rlike("^[a-z]$"), shift(code, 97, 26, i))
            .when(c.rlike("^[A-Z]$"), shift(code, 65, 26, i))
            .when(c.rlike(r"^\p{IsCyrillic}$"), F.when(c.rlike(r"^\p{Lu}$"), cyr(0, i)).otherwise(cyr(1, i)))
            .when(c.rlike(r"^\p{Ll}$"), F.char(F.lit(97) + value(i) % 26))
            .when(c.rlike(r"^\p{Lu}$"), F.char(F.lit(65) + value(i) % 26))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, "", -1), one), "")


def _hex_like(text: Column, seed: Column) -> Column:
    """A hexadecimal string of the same length and case."""
    stream = F.substring(_nibbles(seed, F.length(text)), F.lit(1), F.length(text))
    return F.when(text.rlike("[A-F]"), F.upper(stream)).otherwise(stream)


def _octets(seed: Column) -> Column:
    return bind(_bytes(seed, F.lit(4)), lambda b: F.concat_ws(".", (F.get(b, F.lit(0)) % 223 + 1).cast("string"), *(F.get(b, F.lit(i)).cast("string") for i in (1, 2, 3))))


def _luhn(entity: Column, like: Column) -> Column:
    """Where the entity passes the Luhn check, the last digit is set so that the surrogate does."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    head = F.substring(like, F.lit(1), F.length(like) - 1)
    fits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(head, d.cast("string"))), lambda x: F.call_function("luhn_check", F.regexp_replace(x, "[^0-9]", "")))
    return F.when(F.call_function("luhn_check", digits), F.element_at(fits, 1)).otherwise(like)


def _made_up(seed: Column, script: str, syllables: Column) -> Column:
    part = F.array(*map(F.lit, SYLLABLES[script]))
    return F.initcap(F.array_join(F.transform(F.slice(_bytes(seed, syllables), F.lit(1), syllables), lambda b: F.element_at(part, b % len(SYLLABLES[script]) + 1)), ""))


def _pick(names: list[str], seed: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), F.conv(F.substring(seed, 1, 4), 16, 10).cast("int") % len(names) + 1)


def _seed(kind: Column, value: Column, key: str, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), kind, value, attempt.cast("string")).cast("binary"), 256)


def _growth(attempt: Column) -> Column:
    return F.greatest(F.lit(0), attempt - SHORT_DRAWS)


def _form(kind: Column, form: Column, seed: Column, attempt: Column) -> Column:
    """The surrogate of a unit that is no name, in a written form of it; a canonical unit is its own form."""
    grown = lambda text: F.when(attempt > SHORT_DRAWS, F.concat(text, F.substring(_nibbles(seed, attempt), F.lit(1), _growth(attempt)))).otherwise(text)
    mail, secret, card = kind == "email", kind == "secret", kind == "card"
    main = F.when(mail, F.substring_index(form, "@", 1)).otherwise(form)
    domain = F.substring_index(F.substring_index(form, "@", -1), ".", 1)
    after = lambda: F.concat(F.lit("@"), _like(domain, F.sha2(seed.cast("binary"), 256)), F.lit(".example.org"))
    free = F.when(secret & form.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), _hex_like(form, seed)).when(mail | secret, _like(main, seed)).otherwise(_like(form, seed, skip=True))
    return F.when(kind == "ipv4", _octets(seed)).otherwise(bind(free, lambda like: F.when(card, _luhn(form, like)).when(mail, F.concat(grown(like), after())).when(secret, grown(like)).otherwise(like)))


def _name(kind: Column, seed: Column, attempt: Column) -> Column:
    """The surrogate of a surname or of an unlisted first name."""
    out = F.lit(None).cast("string")
    for script in FIRST:
        out = F.when(kind == f"surname-{script}", _made_up(seed, script, 3 + _growth(attempt))).otherwise(out)
        drawn_m = F.substring(seed, -1, 1).isin(*"02468ace")
        first = F.when(kind.endswith("-m") | (kind.endswith("-n") & drawn_m), _pick(FIRST[script]["m"], seed)).otherwise(_pick(FIRST[script]["f"], seed))
        out = F.when(kind.startswith(f"first-{script}"), F.concat(first, F.lit("-"), _made_up(seed, script, 2 + _growth(attempt)))).otherwise(out)
    return out


def drawn(kind: Column, value: Column, key: str, attempt: Column) -> Column:
    """The surrogate of a unit; ``attempt`` counts the draws that collided."""
    named = kind.startswith("surname-") | kind.startswith("first-")
    return bind(_seed(kind, value, key, attempt), lambda seed: F.when(named, _name(kind, seed, attempt)).otherwise(_form(kind, value, seed, attempt)))


def _exchanged(word: Column, key: str) -> Column:
    """A listed first name by the next one in the keyed order of its list."""
    pairs = []
    for by in FIRST.values():
        for names in by.values():
            order = sorted(names, key=lambda n: hashlib.sha256(f"{key}|{n}".encode()).digest())
            pairs += zip(order, [*order[1:], order[0]], strict=True)
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in pairs for x in pair)), word)


def surrogate(entity: Column, key: str, attempt_of) -> Column:
    """The surrogate of a written entity; ``attempt_of`` gives the draw of a unit."""

    def named(e: Column, units: Column) -> Column:
        title, words = _title(e), F.split(F.regexp_replace(e, f"^{_TITLE}", ""), " ")
        unit = lambda u: bind(attempt_of(u), lambda n: bind(_seed(u["kind"], u["value"], key, n), lambda seed: _name(u["kind"], seed, n)))
        first = F.when(F.size(units) > 1, unit(F.get(units, F.lit(1)))).otherwise(_exchanged(F.get(words, F.lit(0)), key))
        return F.concat(title, F.when(F.size(words) > 1, F.concat(first, F.lit(" "))).otherwise(""), unit(F.get(units, F.lit(0))))

    def put(e: Column, units: Column) -> Column:
        u = F.get(units, F.lit(0))
        start = F.when(u["kind"] == "secret", _key_part(e)).otherwise("")
        form = F.substring(e, F.length(start) + 1, F.length(e))
        other = bind(attempt_of(u), lambda n: bind(_seed(u["kind"], u["value"], key, n), lambda seed: F.concat(start, _form(u["kind"], form, seed, n))))
        return F.when(u["kind"].startswith("surname-"), named(e, units)).otherwise(other)

    return bind(entity, lambda e: bind(units_of(e), lambda units: put(e, units)))


# ---- corpus ---------------------------------------------------------------


def _found(text: Column) -> Column:
    return F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def units(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct units (kind, value) of the corpus."""
    entities = docs.select(F.explode(_found(F.col(text))).alias("entity")).distinct()
    return entities.select(F.inline(units_of(F.col("entity")))).distinct()


def redrawn(found: DataFrame, key: str, patience: int = 50) -> DataFrame:
    """kind, value and attempt of the units whose first draw collides with another surrogate or a real unit.

    Of those that share a surrogate the first keeps it. Draws go on while there
    are collisions; only ``patience`` rounds in a row without fewer of them, which
    means that a fixed form has no room left, are an error.
    """
    put = lambda df: df.select("kind", "value", "attempt", drawn(F.col("kind"), F.col("value"), key, F.col("attempt")).alias("surrogate"))
    now = materialize(put(found.withColumn("attempt", F.lit(0))), "drawn")
    least, idle = None, 0
    while True:
        id_ = F.struct("kind", "value")
        owner = now.groupBy("surrogate").agg(F.min(id_).alias("owner"), F.count("*").alias("n")).filter("n > 1").drop("n")
        shared = now.join(owner, "surrogate").filter(id_ != F.col("owner")).select("kind", "value")
        real = now.join(found.select(F.col("value").alias("surrogate")).distinct(), "surrogate", "left_semi").select("kind", "value")
        again = materialize(shared.unionByName(real).distinct(), "again")
        left = again.count()
        if not left:
            return now.filter("attempt > 0").select("kind", "value", "attempt")
        idle = 0 if least is None or left < least else idle + 1
        least = left if least is None else min(left, least)
        if idle >= patience:
            raise RuntimeError(f"{left} surrogates still collide; their form has no room for so many entities")
        redone = now.join(again, ["kind", "value"]).select("kind", "value", (F.col("attempt") + 1).alias("attempt"))
        now = materialize(now.join(again, ["kind", "value"], "left_anti").unionByName(put(redone)), "drawn")


def replace(docs: DataFrame, key: str, text: str = "text", count: str | None = None, broadcast_rows: int = 500_000) -> DataFrame:
    """The rows with every entity replaced; ``count`` names a column for the number of replacements.

    ``key`` is a secret: who knows it can recompute the surrogates of a guess.
    """
    if not key:
        raise ValueError("a key is needed")
    found = materialize(units(docs, text), "units")
    odd = materialize(redrawn(found, key), "redrawn")
    names = docs.columns
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(f"`{text}`").alias("body"))
    inner = let(inner, found=_found(F.col("body")))
    n = odd.count()
    if n:
        # Draws by the set of units that a row has, never by its text.
        inner = inner.withColumn("s", F.array_sort(F.array_distinct(F.flatten(F.transform("found", units_of)))))
        sets = inner.filter(F.size("s") > 0).select("s").distinct()
        hit = sets.select("s", F.inline("s")).join(F.broadcast(odd) if n <= broadcast_rows else odd, ["kind", "value"])
        entry = F.struct(F.concat_ws("|", "kind", "value").alias("u"), "attempt")
        maps = materialize(hit.groupBy("s").agg(F.map_from_entries(F.collect_set(entry)).alias("m")), "maps")
        inner = inner.join(F.broadcast(maps) if maps.count() <= broadcast_rows else maps, "s", "left").drop("s")
        attempt_of = lambda u: F.coalesce(F.try_element_at("m", F.concat_ws("|", u["kind"], u["value"])), F.lit(0))
    else:
        attempt_of = lambda u: F.lit(0)
    inner = let(inner, put=F.transform("found", lambda e: surrogate(e, key, attempt_of)))
    pieces = F.split("body", _ANY, -1)
    built = F.array_join(F.zip_with(pieces, "put", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    whole = F.when(F.size("found") > 0, built).otherwise(F.col("body"))
    out = inner.select(*((whole if c == text else F.col("row").getField(c)).alias(c) for c in names), *([F.size("found").cast("long").alias(count)] if count else []))
    return out
