"""Surrogates for personal data, in DataFrame operations only.

Entities are e-mail, IPv4 and IPv6 addresses, phone, card, account and social security numbers, keys, secrets in hexadecimal and
names after a title. Each distinct entity gets a replacement drawn from a keyed hash of its canonical form, so the same
entity reads alike in every document and spelling (coreference), and the replacement keeps its type: digits stay digits
and letters letters of the same case, grouping and separators stay, a card number that passes its check digit still
does, an IP address stays one, a name keeps its title's gender, its script and its number of words. Parts of names are
replaced part by part, so a later "Mr Smith" still matches "Mr John Smith", and wherever
else they stand as words of the same text. A name is the whole run of capitalised words after a title, with inner
apostrophes and hyphens, initials and particles such as "von", which stay. Scripts without capitals have no names here;
cased scripts other than those of SYLLABLES get Latin surrogates.

Collision check: of entities of a type that draw the same replacement, or one that occurs as an entity itself, all but
the first draw again, until all replacements are distinct and none is an entity of the corpus. Where a format allows it,
later draws have more to choose from: longer invented words, larger numbers in the mail domain, reserved and then all IPv4
addresses behind 10.0.0.0/8. A type whose format has no replacement left after ROUNDS draws is an error that names it.
Initials change by a keyed permutation of their alphabet, so different ones stay different; capitals of no alphabet stay.

The key is the caller's secret: whoever knows it can look a replacement up.

Null and empty texts stay as they are. Repeated rows change alike; rows are matched by doc_id and the text's hash, so
null ids and ties do no harm. All columns pass through, but for one named
``n_entities``, which is added; only the text changes. An empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

# Titles that show a name's gender.
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Господин"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Госпожа"]
# Syllables of invented names per script; a word ends by gender.
SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "lu", "ma", "ne", "pi", "ro", "su", "ta", "ve", "li", "ko", "ru", "sa"],
    "cyrillic": ["ба", "де", "фи", "го", "лу", "ма", "не", "пи", "ро", "су", "та", "ве", "ли", "ко", "ру", "са"],
    "greek": ["βα", "δε", "φι", "γο", "λυ", "μα", "νε", "πι", "ρο", "συ", "τα", "βε", "λι", "κο", "ρυ", "σα"],
    "armenian": ["բա", "դե", "ֆի", "գո", "լու", "մա", "նե", "պի", "րո", "սու", "տա", "վե", "լի", "կո", "րու", "սա"],
}
ENDS = {"latin": ("n", "na", "r"), "cyrillic": ("н", "на", "р"), "greek": ("ν", "να", "ρ"), "armenian": ("ն", "նա", "ր")}
# First and last code point of alphabets whose capitals are permuted among themselves: Latin, with marks, extended, Greek,
# Cyrillic, Armenian.
ALPHABETS = [(0x41, 0x5A), (0xC0, 0xDE), (0x100, 0x17F), (0x391, 0x3A9), (0x400, 0x42F), (0x531, 0x556)]
# Draws before a type counts as used up.
ROUNDS = 300
PARTICLES = ["van", "von", "vom", "zu", "zum", "zur", "der", "den", "de", "del", "della", "di", "da", "dos", "do", "du", "la", "le", "el", "al", "bin", "ibn", "ter", "ten"]
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_H, _HEX = "[0-9A-Fa-f]{1,4}", "[0-9A-Fa-f:]"
_TITLE, _PARTICLE = "(?:" + "|".join(MALE + FEMALE) + ")", "(?:" + "|".join(PARTICLES) + ")"
# An apostrophe within a word, but for a genitive's.
_INNER = r"['’](?!s(?![\p{L}\p{M}]))(?=\p{L})"
# A capitalised word or an initial; not a title, the start of an address or of a key.
_NAME = (rf"(?!{_TITLE}(?![\p{{L}}\p{{M}}]))(?![\p{{L}}\p{{M}}\p{{N}}._%+'’-]*+@)(?!AKIA[0-9A-Z]{{16}})"
         rf"\p{{Lu}}(?:\.(?= \p{{Lu}})|(?:[\p{{L}}\p{{M}}]|{_INNER}|-(?=\p{{L}}))*+)")
# Parts of a name that get a surrogate each.
PART = rf"(?<![\p{{L}}\p{{M}}'’])(?!{_PARTICLE}(?![\p{{L}}\p{{M}}'’]))(?:[\p{{L}}\p{{M}}]|{_INNER})++"
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]*+\.)+[A-Za-z]{2,}",
    "phone": r"(?<![\d+])\+\d{1,3}(?:[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|(?:[ .-]\d{2,4}){3}|\d{7,12})(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])(?:1-)?\d{3}-\d{3}-\d{4}(?![\d-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "card": r"(?<![\dA-Za-z.])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\dA-Za-z])",
    "social": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    # Short runs such as a[1::2] or a::b are code; an address has three colons, or a digit and a group of three.
    "ip6": rf"(?<![\p{{L}}\p{{N}}:._])(?=(?:[0-9A-Fa-f]*+:){{3}}|(?={_HEX}*\d){_HEX}*[0-9A-Fa-f]{{3}})"
           rf"(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{6}}(?:{_OCTET}\.){{3}}{_OCTET}|(?:{_H}(?::{_H}){{0,6}})?::(?:(?:{_H}:){{0,5}}(?:{_OCTET}\.){{3}}{_OCTET}|{_H}(?::{_H}){{0,6}})?)"
           r"(?![\p{L}\p{N}:_]|\.\d)",
    "secret": r"(?<![A-Za-z0-9])(?=[0-9a-f]*\d)[0-9a-f]{16,128}(?![A-Za-z0-9])",
    "name": rf"(?<!\p{{L}}){_TITLE}\.? (?:{_PARTICLE} ){{0,3}}{_NAME}(?:(?: {_PARTICLE}){{0,3}} {_NAME}(?![\p{{N}}_]))*+",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
# A phone number's country code, which stays.
PREFIX = r"^\+(\d{1,3})(?=[ .(-])"
SCRIPTS = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "armenian": r"\p{IsArmenian}"}
# Cheap sign that every text with an entity has: each pattern needs a digit, an @, two colons, the key's first letters or a title.
SIGN = r"[0-9]|@|:[0-9A-Fa-f]{0,4}:|AKIA|(?:" + "|".join(MALE + FEMALE) + r")\.? "


PARTS = "array<struct<at:int,part:string,surrogate:string>>"


def matches(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def kind(value: Column) -> Column:
    """Type of a matched value: the first pattern that it is as a whole."""
    tests = [F.when(value.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in KINDS.items()]
    return F.coalesce(*tests, F.lit("secret"))


def _expanded(value: Column) -> Column:
    """An IPv6 address with all its groups, without leading zeros."""
    halves = F.split(F.lower(value), "::")
    groups = lambda half: F.transform(F.filter(F.split(half, ":"), lambda g: g != ""), lambda g: F.regexp_replace(g, r"^0+(?=[0-9a-f])", ""))
    left, right = groups(F.get(halves, F.lit(0))), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
    missing = F.lit(8) - F.size(left) - F.size(right) - F.when(value.contains("."), 1).otherwise(0)
    return F.concat_ws(":", left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)


def canonical(kind_: Column, value: Column) -> Column:
    value = F.when(kind_ == "phone", F.regexp_replace(value, r"^1-", "+1-")).when(kind_ == "ip6", _expanded(value)).otherwise(value)
    return (F.when(kind_ == "email", F.lower(value))
            .when(kind_ == "phone", F.concat(F.regexp_extract(value, PREFIX, 1), F.lit("|"), F.regexp_replace(F.regexp_replace(value, PREFIX, ""), r"\D", "")))
            .when(kind_.isin("card", "social"), F.regexp_replace(value, r"\D", ""))
            .when(kind_ == "account", F.replace(value, F.lit(" "), F.lit(""))).otherwise(value))


def _number(key: str, i: Column, size: Column) -> Column:
    """A number below ``size`` from the keyed hash of type, canonical form, attempt and place."""
    seed = F.concat_ws("|", F.lit(key), "kind", "canon", F.col("attempt").cast("string"), i.cast("string"))
    return F.pmod(F.conv(F.substring(F.sha2(seed, 256), 1, 12), 16, 10).cast("long"), size)


def _draw(key: str, i: Column, size: int) -> Column:
    return _number(key, i, F.lit(size)).cast("int")


def _pick(alphabet: str, place: Column) -> Column:
    return F.substring(F.lit(alphabet), place + 1, F.lit(1))


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _scrambled(key: str, text: Column, skip: int | Column = 0, letters: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """Digits to digits and letters to letters of the same case, but for the first ``skip`` characters."""
    def one(c: Column, i: Column) -> Column:
        return (F.when(i < skip, c).when(c.rlike(r"^\d$"), _pick("0123456789", _draw(key, i, 10)))
                .when(c.rlike(r"^\p{Lu}$"), _pick(letters.upper(), _draw(key, i, len(letters))))
                .when(c.rlike(r"^\p{L}$"), _pick(letters, _draw(key, i, len(letters)))).otherwise(c))

    return F.array_join(F.transform(_characters(text), one), "")


def _luhn(digits: Column) -> Column:
    """Sum of a digit string's check, from the right, modulo 10."""
    def value(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.reverse(_characters(digits)), value), F.lit(0), lambda a, x: a + x) % 10


def _card(key: str) -> Column:
    body = F.concat(F.substring("canon", 1, 1), F.expr("substring(scrambled, 2, length(scrambled) - 2)"))
    check = ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string")
    return F.when(_luhn(F.col("canon")) == 0, F.concat(body, check)).otherwise(F.concat(body, F.substring("scrambled", -1, 1)))


def _word(key: str) -> Column:
    """An invented name word in the original's script with the ending of its gender."""
    def of(script: str) -> Column:
        table = F.array(*[F.lit(s) for s in SYLLABLES[script]])
        size = len(SYLLABLES[script])
        parts = F.transform(F.sequence(F.lit(0), F.lit(2) + F.col("attempt")), lambda i: F.get(table, _draw(key, i, size)))
        ends = ENDS[script]
        end = F.when(F.col("kind") == "male", ends[0]).when(F.col("kind") == "female", ends[1]).otherwise(ends[2])
        return F.initcap(F.concat(F.array_join(parts, ""), end))

    return _by_script(of)


def _by_script(of: Callable[[str], Column]) -> Column:
    return F.coalesce(*[F.when(F.col("canon").rlike(p), of(s)) for s, p in SCRIPTS.items()], of("latin"))


def _initial(key: str) -> Column:
    """Another capital of the alphabet, by a keyed round through all of it; so no two initials get the same."""
    old, new = "", ""
    for first, last in ALPHABETS:
        capitals = [chr(c) for c in range(first, last + 1) if chr(c).isupper()]
        turn = sorted(capitals, key=lambda c: hashlib.sha256(f"{key}|initial|{c}".encode()).digest())
        old += "".join(turn)
        new += "".join(turn[1:] + turn[:1])
    return F.translate("canon", old, new)


def drawn(entities: DataFrame, key: str) -> DataFrame:
    """Add ``surrogate`` to (kind, canon, attempt): the replacement's canonical form."""
    k = F.col("kind")
    e = entities.withColumn("scrambled", F.when(k == "key", _scrambled(key, F.col("canon"), 4)).when(
        k == "phone", _scrambled(key, F.col("canon"), F.locate("|", "canon"))).when(k == "account", _scrambled(key, F.col("canon"), 2))
                            .when(k == "secret", _scrambled(key, F.col("canon"), 0, "abcdef")).otherwise(_scrambled(key, F.col("canon"))))
    local = F.substring_index("scrambled", "@", 1)
    domains = F.pow(F.lit(10), 3 + F.least("attempt", F.lit(11))).cast("long")
    tries = F.col("attempt")
    first = F.when(tries < 4, 10).when(tries < 16, 240 + _draw(key, F.lit(3), 15)).otherwise(1 + _draw(key, F.lit(3), 254))
    ip = F.concat_ws(".", first.cast("string"), *[_draw(key, F.lit(i), 256).cast("string") for i in range(3)])
    ip6 = F.concat_ws(":", F.lit("fd00"), *[F.lower(F.hex(_draw(key, F.lit(i), 65536))) for i in range(7)])
    surrogate = (F.when(k == "email", F.concat(local, F.lit("@mail"), _number(key, F.lit(-1), domains).cast("string"), F.lit(".example.org")))
                 .when(k == "ip", ip).when(k == "ip6", ip6).when(k == "card", _card(key)).when(k.isin("male", "female", "surname"), _word(key)).otherwise(F.col("scrambled")))
    return e.withColumn("surrogate", surrogate).drop("scrambled")


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) of distinct (kind, canon): distinct within a kind, and none an entity itself."""
    waiting = entities.select("kind", "canon").withColumn("attempt", F.lit(0))
    originals = entities.select("kind", F.col("canon").alias("surrogate"))
    done: list[DataFrame] = []
    for _ in range(ROUNDS):
        tried = materialise(drawn(waiting, key), "drawn")
        fresh = tried.join(originals, ["kind", "surrogate"], "left_anti")
        if done:
            fresh = fresh.join(reduce(DataFrame.unionAll, done).select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        first = materialise(fresh.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon")), "assigned")
        done.append(first.select("kind", "canon", "surrogate"))
        if len(done) > 8:
            done = [materialise(reduce(DataFrame.unionAll, done), "assigned")]
        waiting = tried.join(first, ["kind", "canon"], "left_anti").select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
        if waiting.isEmpty():
            return reduce(DataFrame.unionAll, done)
    kinds = [r["kind"] for r in waiting.select("kind").distinct().orderBy("kind").limit(len(KINDS) + 4).collect()]
    raise RuntimeError(f"no replacements left for entities of {', '.join(kinds)} after {ROUNDS} draws")


def _fitted(raw: Column, digits: Column) -> Column:
    """The digits in the places of the digits of a raw spelling."""
    chars = _characters(raw)
    count = lambda i: F.length(F.regexp_replace(F.substring(raw, F.lit(1), i + 1), r"\D", ""))
    return F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(r"^\d$"), F.substring(digits, count(i), F.lit(1))).otherwise(c)), "")


def replacements(values: DataFrame, key: str) -> DataFrame:
    """(value, kind, replacement, parts) of distinct matched values; parts are those of a name."""
    v = materialise(values.select("value", kind(F.col("value")).alias("kind")), "values")
    plain = v.where("kind <> 'name'").withColumn("canon", canonical(F.col("kind"), F.col("value")))
    title = F.regexp_extract("value", r"^\S+", 0)
    gender = F.when(F.replace(title, F.lit("."), F.lit("")).isin(MALE), "male").otherwise("female")
    names = v.where("kind = 'name'").select("value", gender.alias("gender"), title.alias("title"), F.regexp_replace("value", r"^\S+ ", "").alias("rest"))
    found = lambda text: F.regexp_extract_all(text, F.lit(PART), F.lit(0))
    words = names.select("value", "gender", F.size(found(F.col("rest"))).alias("n"), F.size(found(F.substring_index("rest", " ", -1))).alias("n_last"),
                         F.posexplode(found(F.col("rest"))).alias("at", "part"))
    kinds = F.when(F.col("at") >= F.col("n") - F.col("n_last"), "surname").when(F.length("part") == 1, "initial").otherwise(F.col("gender"))
    words = words.select("value", "at", "part", kinds.alias("kind"), F.initcap(F.lower("part")).alias("canon"))
    entities = materialise(plain.select("kind", "canon").unionAll(words.where("kind <> 'initial'").select("kind", "canon")).distinct(), "entities")
    table = materialise(assign(entities, key), "surrogates")
    p = plain.join(table, ["kind", "canon"])
    text, raw = F.col("surrogate"), F.col("value")
    spaced = F.regexp_replace(text, r"(.{4})(?=.)", "$1 ")
    fitted = (F.when(F.col("kind").isin("phone", "card", "social"), _fitted(raw, F.replace(text, F.lit("|"), F.lit("")))).when((F.col("kind") == "account") & raw.contains(" "), spaced)
              .when((F.col("kind") == "email") & (raw == F.upper(raw)), F.upper(text)).otherwise(text))
    p = p.select("value", "kind", fitted.alias("replacement"), F.lit(None).cast(PARTS).alias("parts"))
    w = words.join(table, ["kind", "canon"], "left").withColumn("attempt", F.lit(0))
    word = F.when(F.col("kind") == "initial", _initial(key)).otherwise(F.col("surrogate"))
    spelt = (F.when((F.length("part") > 1) & (F.col("part") == F.upper("part")), F.upper(word))
             .when(F.col("part").rlike(r"^\p{Ll}"), F.lower(word)).otherwise(word))
    n = w.withColumn("surrogate", spelt).groupBy("value").agg(F.array_sort(F.collect_list(F.struct("at", "part", "surrogate"))).alias("parts"))
    n = n.join(names.select("value", "title", "rest"), "value")
    between = F.transform(F.split("rest", PART), lambda x, i: F.concat(x, F.coalesce(F.get("parts", i)["surrogate"], F.lit(""))))
    n = n.select("value", F.lit("name").alias("kind"), F.concat(F.col("title"), F.lit(" "), F.array_join(between, "")).alias("replacement"), "parts")
    return p.unionAll(n)


def mask(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """All rows and columns, with entities of the text replaced, and ``n_entities``."""
    if not key:
        raise ValueError("surrogates need a secret key")
    columns = [c for c in docs.columns if c != "n_entities"]
    body = F.col(text)
    # The whole pattern decides; the sign spares it most texts.
    sign = F.coalesce(body.rlike(SIGN) & body.rlike(PATTERN), F.lit(False))
    row = [F.coalesce("doc_id", F.lit(0)).alias("_doc"), F.xxhash64("doc_id", text).alias("_row")]
    some = docs.where(sign).select(*row, F.array_distinct(matches(body)).alias("found")).where("size(found) > 0")
    found = materialise(some.select("_doc", "_row", F.explode("found").alias("value")).distinct(), "found")
    table = materialise(replacements(found.select("value").distinct(), key), "replacements")
    pair = lambda old, new, bare: F.struct(old.alias("old"), new.alias("new"), F.lit(bare).alias("bare"))
    long = F.filter(F.coalesce("parts", F.array().cast(PARTS)), lambda x: F.length(x["part"]) > 1)
    spellings = F.concat(F.array(pair(F.col("value"), F.col("replacement"), False)), F.transform(long, lambda x: pair(x["part"], x["surrogate"], True)),
                         F.transform(long, lambda x: pair(F.upper(x["part"]), F.upper(x["surrogate"]), True)))
    pairs = found.join(table, "value").select("_doc", "_row", F.explode(spellings).alias("x")).groupBy("_doc", "_row", "x.old").agg(
        F.min("x.new").alias("new"), F.min("x.bare").alias("bare"))
    each = pairs.groupBy("_doc", "_row").agg(
        F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("_map"),
        F.array_join(F.reverse(F.array_sort(F.collect_list(F.when(F.col("bare"), F.col("old"))))), "|").alias("_bare"))
    may = docs.where(sign).select(*columns, *row).join(each, ["_doc", "_row"], "left")
    # Entities first, then parts of the text's own names where they stand alone.
    alone = F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{M}])(?:"), F.col("_bare"), F.lit(r")(?![\p{L}\p{M}])"))
    pattern = F.when(F.length("_bare") > 0, alone).otherwise(F.lit(PATTERN))
    may = may.withColumn("_hits", F.when(F.col("_map").isNotNull(), F.regexp_extract_all(body, pattern, F.lit(0))))
    pieces = F.split(body, pattern)
    joined = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.try_element_at("_map", F.get("_hits", i)), F.lit("")))), "")
    new = F.when(F.col("_map").isNull(), body).otherwise(joined)
    may = may.select(*[new.alias(c) if c == text else F.col(c) for c in columns], F.coalesce(F.size("_hits"), F.lit(0)).alias("n_entities"))
    may = may.withColumn("n_entities", F.greatest("n_entities", F.lit(0)))
    rest = docs.where(~sign).select(*columns, F.lit(0).alias("n_entities"))
    return may.unionAll(rest)
