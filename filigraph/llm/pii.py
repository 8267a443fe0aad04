"""Personal data: keyed surrogates that keep type, script and format.

A surrogate only depends on the key, the kind and the value, so one value has one surrogate everywhere
(coreference). Characters are replaced within their own class by a keyed Feistel network over the two
halves of a value, which is a permutation of all values of one format (distinctness). A
check over all distinct values finds what still collides and gives it another round. Only
DataFrame expressions are used, and texts are rewritten where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigraph.llm.shared import cut, sized, text_key, text_or_empty

#: Titles by grammatical gender, as written before a name; several may follow each other.
MALE = "Mr|Herrn|Herr|Señor|Sr|Sir|Signor|Don|Monsieur|г-н|Κύριος"
FEMALE = "Mrs|Ms|Miss|Frau|Señora|Srta|Sra|Signora|Doña|Madame|Mme|Mlle|г-жа|Κυρία"
NEUTRAL = "Mx|Dr|Doctor|Doktor|Professor|Prof"
TITLES = f"{MALE}|{FEMALE}|{NEUTRAL}"
#: What stands in lower case before a family name. It stays.
PARTICLES = "de|del|della|di|da|dos|das|do|du|des|la|las|los|le|van|von|der|den|ter|ten|zu|zur|zum|vom|af|av|el|al|bin|ibn|y"
#: Given names are composed of one of 16 beginnings, 8 middles and 8 endings of their script and gender.
BEGINNINGS = {
    "latin": "Al Be Ca Da El Fa Ge Ha Il Jo Ka Le Ma No Or Pa".split(),
    "cyrillic": "Ал Бо Ва Га Да Ев Жа Зо Ил Ка Ла Ми На Ол Па Ро".split(),
    "greek": "Αλ Βα Γε Δη Ελ Ζη Θα Ιω Κα Λε Μα Νι Ξε Ορ Πα Σο".split(),
}
MIDDLES = {"latin": "ba de fi go li me no ra".split(), "cyrillic": "бо ва ди ли мо на ре са".split(), "greek": "βα δι λε μο νι ρα σα τη".split()}
ENDINGS = {
    ("m", "latin"): "n s r l ndo rt mir vin".split(),
    ("f", "latin"): "na la ra sa nda lia tte via".split(),
    ("n", "latin"): "li mi ri ke ni xi ry sy".split(),
    ("m", "cyrillic"): "н р м слав мир тин дар лий".split(),
    ("f", "cyrillic"): "на ра ла ва лия рия ста дия".split(),
    ("n", "cyrillic"): "я ша ня ля ка ся тя ни".split(),
    ("m", "greek"): "ς νης ρος λος τας κης δης μος".split(),
    ("f", "greek"): "να ρα λα νη σία ρία δα κη".split(),
    ("n", "greek"): "ρι νι λι τι κι μι δι σι".split(),
}
#: All given names by gender and script, in the order of their numbers.
GIVEN = {(g, s): [a + b + c for a in BEGINNINGS[s] for b in MIDDLES[s] for c in ends] for (g, s), ends in ENDINGS.items()}
_NAMES = 1024
#: A namesake gets this many other names of the list before one joins its permuted name to the list's.
_OTHERS_FIRST = 3
#: First code point and size of each character class that is permuted within itself.
CLASSES = (
    (0x30, 10), (0x61, 26), (0x41, 26), (0xE0, 23), (0xF8, 7), (0xC0, 23), (0xD8, 7), (0x430, 32), (0x410, 32), (0x3B1, 25), (0x391, 17),
    (0x3A3, 7), (0x5D0, 27), (0x621, 26), (0x3041, 86), (0x30A1, 90), (0x4E00, 20992), (0xAC00, 11172),
)
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: A name of two letters or more, with apostrophes and hyphens inside it, but without a genitive's; no title. Initials with and without stops.
_NAME = rf"(?!(?:{TITLES})(?!\p{{L}}))\p{{Lu}}(?:\p{{L}}++|['’-](?!s(?!\p{{L}}))\p{{L}})++"
_INITIAL = r"(?:(?:\p{Lu}\.){1,4}|\p{Lu}(?![\p{L}.'’]))"
_RUN_OF_TITLES = rf"(?:(?:{TITLES})\.? ){{1,4}}"
_FAMILY_NAME = rf"(?:(?:{PARTICLES}) ){{0,3}}{_NAME}"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9](?:[ .-]?[0-9]){5,12}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9-])[3-6](?:[ -]?[0-9]){12,18}(?![0-9])",
    "name": rf"(?<![\p{{L}}]){_RUN_OF_TITLES}(?:(?:{_NAME}|{_INITIAL}) ){{0,3}}{_FAMILY_NAME}",
}
#: The same patterns in this order, each behind a look at its first character; texts without an @ are read without the first.
_OTHERS = rf"(?=[0-9+(])(?:{'|'.join(PATTERNS[k] for k in ('ip', 'phone', 'ssn', 'card'))})|(?=[{''.join(sorted({t[0] for t in TITLES.split('|')}))}]){PATTERNS['name']}"
ENTITY = f"{PATTERNS['email']}|{_OTHERS}"
#: Country calling codes of one and two digits; all others have three.
CALLING_CODE = "^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3})"
#: An attempt of a name is so many times the attempt of its family name, plus that of its given name.
_FAMILY = 64


def _chars(code: Column) -> Column:
    """The character of a code point below 65536."""
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 4, "0")), "UTF-16BE")


def _shifted(text: Column, stream: Column) -> Column:
    """Each character moved within its class by the stream's next 16 bits; others stay."""

    def move(c: Column, i: Column) -> Column:
        code = F.ascii(c)
        by = F.conv(F.substring(stream, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        out = c
        for base, size in reversed(CLASSES):
            out = F.when((code >= base) & (code < base + size), _chars((code - base + by) % size + base)).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, ""), move), "")


def _stream(key: str, tweak: Column, turn: int, other: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}\u0001{turn}\u0001"), tweak, F.lit("\u0001"), other), 256)


def permuted(text: Column, key: str, tweak: Column, turns: int = 2) -> Column:
    """A keyed permutation of all texts of one format and tweak: a Feistel network over both halves."""
    half = F.floor(F.length(text) / 2).cast("int")
    state = F.struct(F.substring(text, F.lit(1), half).alias("a"), F.substring(text, half + 1, F.length(text)).alias("b"))
    step = lambda s, i: F.transform(
        F.array(F.struct(_shifted(s["a"], _stream(key, F.concat(tweak, i.cast("string")), 0, s["b"])).alias("a"), s["b"].alias("b"))),
        lambda t: F.struct(t["a"].alias("a"), _shifted(t["b"], _stream(key, F.concat(tweak, i.cast("string")), 1, t["a"])).alias("b")),
    )[0]
    return F.aggregate(F.sequence(F.lit(1), F.lit(turns)), state, step, lambda s: F.concat(s["a"], s["b"]))


def _luhn(digits: Column) -> Column:
    """The Luhn sum of the digits in front of a check digit, modulo 10."""
    values = F.transform(F.split(F.reverse(F.regexp_replace(digits, "[^0-9]", "")), ""), lambda c, i: F.when(i % 2 == 0, F.coalesce(c.try_cast("int"), F.lit(0)) * 2).otherwise(F.coalesce(c.try_cast("int"), F.lit(0))))
    return F.aggregate(values, F.lit(0), lambda s, v: (s + F.when(v > 9, v - 9).otherwise(v)) % 10)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _ip(value: Column, key: str, tweak: Column) -> Column:
    """A permutation of the 32 bits of an address."""
    octets = F.transform(F.split(value, "\\."), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    state = _let(octets, lambda o: F.struct((o[0] * 256 + o[1]).alias("a"), (o[2] * 256 + o[3]).alias("b")))
    mask = lambda turn, other: F.conv(F.substring(_stream(key, tweak, turn, other.cast("string")), 1, 4), 16, 10).cast("int")
    # a lambda of two parameters would get the element's place as the second
    left = lambda turn: lambda s: F.struct(((s["a"] + mask(turn, s["b"])) % 65536).alias("a"), s["b"].alias("b"))
    right = lambda turn: lambda s: F.struct(s["a"].alias("a"), ((s["b"] + mask(turn, s["a"])) % 65536).alias("b"))
    for turn in range(2):
        state = _let(_let(state, left(2 * turn)), right(2 * turn + 1))
    return _let(state, lambda s: F.concat_ws(".", *[x.cast("string") for x in (F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256)]))


def _titles(value: Column) -> Column:
    """The titles in front of a name, with the blank behind them."""
    return F.regexp_extract(value, f"^{_RUN_OF_TITLES}", 0)


def _untitled(value: Column) -> Column:
    return _let(F.length(_titles(value)), lambda n: F.substring(value, n + 1, F.length(value)))


def _short(value: Column) -> Column:
    """The first and the last word of a name without its titles."""
    return _let(F.split(_untitled(value), " "), lambda w: F.concat_ws(" ", w[0], F.element_at(w, -1)))


def _last(value: Column) -> Column:
    return F.element_at(F.split(value, " "), -1)


def _name(value: Column, key: str, attempt: Column) -> Column:
    """Titles and particles stay, initials are permuted; given names come from the list of their gender and script, the family name is permuted.

    The gender is that of the first title that has one. The family name depends on itself and the attempt's multiple of ``_FAMILY`` only, so all mentions share it.
    What is left of the attempt chooses other given names of the list, and at last joins the permuted given name to it, which tells namesakes apart.
    """
    own, script_of = attempt % _FAMILY, lambda family: F.when(family.rlike("^[\\u0400-\\u04FF]"), "cyrillic").when(family.rlike("^[\\u0370-\\u03FF\\u1F00-\\u1FFF]"), "greek").otherwise("latin")
    titles = F.transform(F.split(F.rtrim(_titles(value)), " "), lambda t: F.regexp_replace(t, "\\.$", ""))
    genders = F.filter(F.transform(titles, lambda t: F.when(t.rlike(f"^(?:{MALE})$"), "m").when(t.rlike(f"^(?:{FEMALE})$"), "f")), lambda g: g.isNotNull())
    table = lambda lists: F.create_map(*[x for k, names in lists.items() for x in (F.lit("".join(k)), F.array(*[F.lit(n) for n in names]))])

    def from_list(given: Column, gender: Column, script: Column) -> Column:
        number = (F.conv(F.substring(_stream(key, F.lit("name:"), 9, F.lower(given)), 1, 6), 16, 10).cast("int") + own * 331) % _NAMES
        name = _let(number, lambda n: F.concat(
            F.get(F.element_at(table(BEGINNINGS), script), F.floor(n / 64).cast("int")), F.get(F.element_at(table(MIDDLES), script), (F.floor(n / 8) % 8).cast("int")),
            F.get(F.element_at(table(ENDINGS), F.concat(gender, script)), (n % 8).cast("int")),
        ))
        return F.concat_ws("-", name, F.when(own > _OTHERS_FIRST, permuted(given, key, F.concat(F.lit("given:"), own.cast("string")))))

    def whole(parts: Column) -> Column:
        family, gender = F.element_at(parts, -1), F.coalesce(F.get(genders, F.lit(0)), F.lit("n"))
        script = script_of(family)
        given = lambda w: F.when(w.rlike("^\\p{Ll}"), w).when(w.rlike(f"^{_INITIAL}$"), permuted(w, key, F.lit("initial:"))).otherwise(from_list(w, gender, script))
        tweak = F.concat(F.lit("name:"), script, F.lit(":"), F.floor(attempt / _FAMILY).cast("string"))
        return F.array_join(F.concat(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), given), F.array(permuted(family, key, tweak))), " ")

    return F.concat(_titles(value), _let(F.split(_untitled(value), " "), whole))


def kind_of(value: Column) -> Column:
    """The kind of a matched value: the first pattern that takes all of it."""
    out = F.lit("name")
    for kind in ("card", "ssn", "phone", "ip", "email"):
        out = F.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    return out


def canonical(kind: Column, value: Column) -> Column:
    """What all spellings of one value share: lower case for addresses of mail, the digits of a card, country code and national digits of a phone number.

    A number in the national form with an area code in brackets has the country code 1.
    """
    digits = F.regexp_replace(value, "[^0-9]", "")
    whole = F.when(value.startswith("+"), digits).otherwise(F.concat(F.lit("1"), digits))
    phone = _let(whole, lambda d: _let(F.regexp_extract(d, CALLING_CODE, 1), lambda code: F.concat(code, F.lit("|"), F.substring(d, F.length(code) + 1, F.length(d)))))
    return F.when(kind == "email", F.lower(value)).when(kind == "phone", phone).when(kind == "card", digits).otherwise(value)


def _poured(digits: Column, value: Column) -> Column:
    """``value`` with its digits replaced by ``digits`` in turn."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))
    step = lambda s, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substring(digits, s["k"] + 1, F.lit(1))).alias("out"), (s["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k")))
    return F.aggregate(F.split(value, ""), start, step, lambda s: s["out"])


def dressed(kind: Column, value: Column, stand_in: Column) -> Column:
    """The surrogate of a canonical value in the spelling of one mention: its capitals, spaces, brackets and country code."""
    places = F.sequence(F.lit(1), F.greatest(F.length(stand_in), F.lit(1)))
    capitals = F.array_join(F.transform(places, lambda i: F.when(F.substring(value, i, F.lit(1)).rlike("[A-Z]"), F.upper(F.substring(stand_in, i, F.lit(1)))).otherwise(F.substring(stand_in, i, F.lit(1)))), "")
    phone = F.when(value.startswith("+"), F.replace(stand_in, F.lit("|"), F.lit(""))).otherwise(F.substring_index(stand_in, "|", -1))
    return F.when((kind == "email") & (value != F.lower(value)), capitals).when(kind == "phone", _poured(phone, value)).when(kind == "card", _poured(stand_in, value)).otherwise(stand_in)


def surrogate(kind: Column, value: Column, key: str, attempt: Column) -> Column:
    """The stand-in of a canonical value. All formats stay; a card number keeps its first digit and the state of its check
    digit, a phone number its country code, and an address of mail gets a reserved top-level domain."""
    tweak = F.concat(kind, F.lit(":"), attempt.cast("string"))
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    top = F.substring_index(domain, ".", -1)
    hosts = F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    email = F.concat(permuted(local, key, tweak), F.lit("@"), permuted(hosts, key, F.concat(tweak, F.lit("@"), top)), F.lit("."), top, F.lit(".example"))
    body = F.substring(value, F.lit(1), F.length(value) - 1)
    offset = F.right(value, F.lit(1)).try_cast("int") + _luhn(body)
    card = _let(F.concat(F.left(value, F.lit(1)), permuted(F.substring(body, F.lit(2), F.length(body)), key, F.concat(tweak, F.left(value, F.lit(1))))), lambda b: F.concat(b, F.pmod(offset - _luhn(b), F.lit(10)).cast("string")))
    code, national = F.substring_index(value, "|", 1), F.substring_index(value, "|", -1)
    phone = F.concat(code, F.lit("|"), permuted(national, key, F.concat(tweak, code)))
    return F.when(kind == "email", email).when(kind == "ip", _ip(value, key, tweak)).when(kind == "card", card).when(kind == "phone", phone).when(kind == "ssn", permuted(value, key, tweak)).otherwise(_name(value, key, attempt))


def _found(text: Column) -> Column:
    """All entities of a text, in its order."""
    with_mail, others = (F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (ENTITY, _OTHERS))
    return F.when(F.contains(text, F.lit("@")), with_mail).otherwise(others)


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, value): the distinct entities of all texts, by their canonical values."""
    found = docs.select(F.explode(_found(text_or_empty(text_col))).alias("value")).distinct()
    return found.select(kind_of(F.col("value")).alias("kind"), "value").select("kind", canonical(F.col("kind"), F.col("value")).alias("value")).distinct()


def settle(values: DataFrame, key: str, rounds: int = 12) -> DataFrame:
    """(kind, value, attempt, surrogate): no two values share a surrogate and no surrogate is a value of the corpus.

    Of values that collide the least keeps its surrogate, all others try again: a name with given names with other
    ones, a name without any with another family name, in which all names of the family follow.
    """
    parts = F.split("value", " ")
    short = (F.col("kind") == "name") & F.col("value").rlike(f"^{_RUN_OF_TITLES}(?:{_INITIAL} ){{0,3}}{_FAMILY_NAME}$")
    family = Window.partitionBy("kind", F.when(F.col("kind") == "name", F.element_at(parts, -1)).otherwise(F.col("value")))
    state = cut(values.withColumn("attempt", F.lit(0)), "entities")
    originals = state.select("kind", F.col("value").alias("surrogate"))
    for _ in range(rounds):
        tried = cut(state.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), key, F.col("attempt"))), "surrogates")
        place = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("attempt", "value"))
        ranked = tried.withColumn("place", place)
        taken = originals.withColumn("taken", F.lit(True))
        checked = ranked.join(taken, ["kind", "surrogate"], "left").withColumn("again", (F.col("place") > 1) | F.col("taken").isNotNull())
        if checked.where("again").isEmpty():
            return tried
        moved = F.max((F.col("again") & short).cast("int")).over(family)
        step = F.when(moved > 0, _FAMILY).otherwise(F.col("again").cast("int"))
        state = cut(checked.select("kind", "value", (F.col("attempt") + step).alias("attempt")), "entities")
    raise RuntimeError("some surrogates still collide")


#: A name in bare words, as a text that has it with a title mentions it again.
_BARE_BEFORE, _BARE_AFTER = r"(?<![\p{L}])(?:", r")(?!\p{L}|['’-](?!s(?!\p{L}))\p{L})"


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_entities, entities, text`` per input row: the whole text with surrogates for its entities.

    ``entities`` lists (kind, surrogate) in the order of the text. A name stands behind one to four titles and has up to four names, initials and particles. One that a
    text has with a title is also replaced where the text has it bare: in full, by its first and family name, or by its family name; other bare names are no entities. Null texts stay null and empty ones empty, with no entities;
    ids may be null or repeat. The key must be kept secret; with the same key reruns agree.
    """
    settled = settle(entities(docs, text_col), key)
    changed = settled.where("attempt > 0").select(F.concat_ws(":", "kind", "value").alias("named"), "attempt")
    text = F.col(text_col).cast("string").alias("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), text, F.explode(F.array(F.coalesce(_found(F.col(text_col).cast("string")), F.array().cast("array<string>")))).alias("first_found"))
    kind_and_value = lambda v: _let(kind_of(v), lambda k: F.struct(k.alias("kind"), canonical(k, v).alias("value")))
    name_of = lambda kv: F.concat_ws(":", kv["kind"], kv["value"])
    if changed.isEmpty():
        rows = rows.withColumn("attempts", F.create_map().cast("map<string,int>"))
    else:  # only the attempts of changed values meet their texts
        named = F.explode(F.transform("first_found", lambda v: name_of(kind_and_value(v)))).alias("named")
        touched = rows.select(text_key().alias("key"), named).distinct().join(changed, "named")
        attempts = cut(touched.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("named", "attempt"))).alias("attempts")), "attempts")
        rows = rows.join(sized(attempts, attempts.count()), text_key() == attempts["key"], "left").drop("key")
    attempt = lambda kv: F.coalesce(F.try_element_at(F.col("attempts"), name_of(kv)), F.lit(0))
    stand_in = lambda v: _let(kind_and_value(v), lambda kv: F.struct(kv["kind"].alias("kind"), _let(surrogate(kv["kind"], kv["value"], key, attempt(kv)), lambda s: dressed(kv["kind"], v, s)).alias("surrogate")))
    none = "array<struct<value:string,kind:string,surrogate:string>>"
    first = F.transform("first_found", lambda v: _let(stand_in(v), lambda s: F.struct(v.alias("value"), s["kind"].alias("kind"), s["surrogate"].alias("surrogate"))))
    rows = rows.select("doc_id", "text", F.explode(F.array(F.when(F.size("first_found") > 0, first).otherwise(F.array().cast(none)))).alias("first"))
    titled = F.filter("first", lambda e: e["kind"] == "name")
    pair = lambda e: F.array(*[F.struct(f(e["value"]).alias("value"), e["kind"].alias("kind"), f(e["surrogate"]).alias("surrogate")) for f in (_untitled, _short, _last)])
    rows = rows.withColumn("bare", F.explode(F.array(F.array_distinct(F.flatten(F.transform(titled, pair))))))
    longest_first = F.transform(F.sort_array(F.transform(F.array_distinct(F.col("bare.value")), lambda b: F.struct((-F.length(b)).alias("n"), b.alias("b")))), lambda x: x["b"])
    pattern = F.when(F.size("bare") > 0, F.concat(F.lit(f"{ENTITY}|{_BARE_BEFORE}"), F.replace(F.array_join(longest_first, "|"), F.lit("."), F.lit("\\.")), F.lit(_BARE_AFTER)))
    rows = rows.withColumn("pattern", F.explode(F.array(pattern)))

    by_pattern = lambda known, of_row: F.when(F.col("pattern").isNotNull(), of_row).otherwise(known)
    known = F.concat("first", "bare")
    again = F.transform(F.regexp_extract_all("text", F.col("pattern"), F.lit(0)), lambda v: F.get(F.filter(known, lambda e: e["value"] == v), F.lit(0)))
    shown = F.transform(by_pattern(F.col("first"), again), lambda e: F.struct(e["kind"].alias("kind"), e["surrogate"].alias("surrogate")))
    rows = rows.select("doc_id", "text", "pattern", F.explode(F.array(shown)).alias("entities"))
    pieces = by_pattern(F.split("text", ENTITY, -1), F.split("text", F.col("pattern"), -1))
    woven = F.array_join(F.flatten(F.zip_with(pieces, F.col("entities.surrogate"), lambda p, s: F.array(p, F.coalesce(s, F.lit(""))))), "")
    text = F.when(F.size("entities") > 0, woven).otherwise(F.col("text"))
    return rows.select("doc_id", F.size("entities").cast("long").alias("n_entities"), "entities", text.alias("text"))
