"""Surrogates for personal data, in DataFrame functions alone.

Entities are found by patterns: mail addresses, phone numbers, card and account
numbers, network addresses, and persons by title or known given name. Each different
entity gets one surrogate for the whole corpus, drawn from a keyed digest of its kind
and its normal form, so without the key nothing leads back.

* Format: digits stay digits and letters stay letters where they were, upper case stays
  upper case, a valid check digit stays valid, a country code and a top-level domain stay.
* Gender and script: given names come from lists by gender and script, surnames from
  syllables of the script.
* Coreference: the normal form leaves out what writing varies (separators, case), and
  names are replaced part by part, so the same number in two notations, one domain in
  two addresses, and "Mr. Hall" and "Mr. Tom Hall" keep their relation.
* Distinctness: a surrogate that two entities share, or that is an entity of the corpus
  itself, is drawn again for all but the smallest of them, until none is left.

The list of entities is aggregated before it is shuffled, and is joined to occurrences,
never collected. Texts meet their replacements by key, once.

Defined results: a missing text stays missing, one without entities is unchanged; equal
entities have equal surrogates in all rows; an empty table gives an empty result.
Columns of any name pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from labelaudit.llm.frames import hidden, shown
from labelaudit.operators.assemble import salted_join
from labelaudit.session import settle, store

# Titles and given names by gender, in three scripts; syllables of surnames.
TITLES = {
    "m": ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"],
}
GIVEN = {
    ("m", "Latin"): ["James", "Robert", "Thomas", "Daniel", "Peter", "Martin", "Carlos", "Pierre", "Hans", "Lucas", "Pablo", "Julien"],
    ("f", "Latin"): ["Mary", "Susan", "Laura", "Emma", "Anna", "Helen", "Carmen", "Claire", "Greta", "Julia", "Lucia", "Camille"],
    ("m", "Cyrillic"): ["Иван", "Пётр", "Павел", "Сергей", "Андрей", "Олег", "Николай", "Борис"],
    ("f", "Cyrillic"): ["Анна", "Мария", "Ольга", "Елена", "Ирина", "Вера", "Нина", "Софья"],
    ("m", "Greek"): ["Γιώργος", "Νίκος", "Κώστας", "Πέτρος", "Ανδρέας", "Σταύρος"],
    ("f", "Greek"): ["Μαρία", "Ελένη", "Άννα", "Σοφία", "Κατερίνα", "Δέσποινα"],
}
SYLLABLES = {
    "Latin": ["ba", "den", "fer", "ga", "hol", "ker", "lin", "mor", "nel", "po", "ros", "sen", "tal", "ver", "wi", "zan"],
    "Cyrillic": ["ба", "вел", "гор", "дан", "ков", "лин", "мар", "нев", "пол", "ров", "сен", "тар"],
    "Greek": ["βα", "δη", "κο", "λα", "μα", "νι", "πα", "ρο", "σα", "τζη", "φω", "χα"],
}
SCRIPTS = list(SYLLABLES)
#: Found, but not drawn: titles of either gender and common given names; names that are everyday words are left out.
NEUTRAL = ["Dr", "Prof", "Professor", "Doctor", "Mx", "Rev"]
MORE_GIVEN = {
    "m": "Aaron Adam Alan Albert Alexander Ahmed Ali Andrew Anthony Antonio Arthur Benjamin Brian Bruce Carl Charles "
    "Christopher David Dennis Diego Donald Douglas Edward Eric Ethan Fernando Francisco Frank François Gary George "
    "Gerald Gregory Günter Harold Heinrich Henry Jack Jacob Jacques Jason Javier Jean Jeffrey Jeremy John Jonathan "
    "Jorge José Joseph Joshua Juan Jürgen Karl Keith Kenneth Kevin Klaus Larry Lawrence Liam Louis Luis Manuel Marco "
    "Mark Matthew Michael Michel Miguel Mohamed Mohammed Muhammad Nathan Nicholas Noah Oliver Oscar Patrick Paul Pedro "
    "Philip Ralph Raymond Richard Roger Ronald Ryan Samuel Scott Sean Sebastian Sergio Stefan Stephen Steven Terry "
    "Timothy Tom Vincent Walter Werner William Wolfgang Zachary",
    "f": "Abigail Alice Amanda Amy Andrea Angela Ann Anne Ashley Barbara Beatrice Betty Beverly Brenda Carol Caroline "
    "Catherine Charlotte Cheryl Christina Christine Cynthia Deborah Debra Denise Diana Diane Donna Doris Dorothy "
    "Elena Elisabeth Elizabeth Emily Evelyn Fatima Frances Gloria Hannah Heather Heidi Ingrid Isabel Isabella "
    "Jacqueline Jane Janet Janice Jean-Marie Jennifer Jessica Joan Joyce Judith Judy Julie Karen Katherine Kathleen "
    "Kelly Kimberly Laura Lauren Linda Lisa Louise Madison Margaret Maria María Marie Marilyn Martha Megan Melissa "
    "Michelle Monika Nancy Natalie Nicole Olivia Pamela Patricia Rachel Rebecca Ruth Samantha Sandra Sara Sarah Sharon "
    "Shirley Sophia Sophie Stephanie Teresa Theresa Ursula",
}
_FEMALE = [n for (g, _), names in GIVEN.items() if g == "f" for n in names] + MORE_GIVEN["f"].split()


def _either_case(words: list[str]) -> str:
    """An expression of all words, also in upper case, the longer of two alike first."""
    both = {w for word in words for w in (word, word.upper())}
    heads: dict[str, list[str]] = {}
    for w in sorted(both, reverse=True):
        heads.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{h}(?:{'|'.join(rest)})" for h, rest in heads.items())


#: A part of a name: McDonald, O'Brien, Smith-Jones, HALL; between parts initials and particles may stand.
_WORD = r"\p{Lu}(?:['’](?!S(?!\p{L}))\p{Lu}|\p{L})++"
_NAME = rf"{_WORD}(?:-{_WORD})*+"
_PARTICLE = "van|von|der|den|de|da|di|del|della|dos|du|la|le|el|al|bin|ibn|ter|zu"
_NEXT = rf"(?: \p{{Lu}}\.){{0,2}}(?: (?:{_PARTICLE})){{0,3}} {_NAME}"
_TITLE = _either_case([t for titles in TITLES.values() for t in titles] + NEUTRAL)
_KNOWN = _either_case([n for names in GIVEN.values() for n in names] + " ".join(MORE_GIVEN.values()).split())
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: In order of precedence. A match starts where a run of its characters starts, so no text is read twice.
PATTERNS = {
    "mail": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)+",
    "address": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "address6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
    r"|(?=[0-9A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "social": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\)[ .\-]?|\d{3}[.\-])\d{3}[ .\-]\d{4}(?!\w)"
    r"|(?<![\w+])\+\d{1,3}(?:[ .\-]\d{2,4}){3,4}(?!\w)",
    "number": r"(?<![\w.\-])\d(?:[ \-]?\d){12,18}(?![\w\-])",
    "account": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "person": rf"(?<!\w)(?:(?:(?:{_TITLE})\.? )++(?:(?:\p{{Lu}}\. ){{1,2}}|(?:{_PARTICLE}) ){{0,3}}{_NAME}(?:{_NEXT}){{0,3}}"
    rf"|(?:{_KNOWN})(?:-{_NAME})?(?:{_NEXT}){{1,3}})(?!\w)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _chosen(pairs: list[tuple[Column, Column]], default: Column) -> Column:
    return reduce(lambda rest, p: F.when(p[0], p[1]).otherwise(rest), reversed(pairs), default)


def _only(pattern: str) -> str:
    return f"^(?:{pattern})$"


def script_of(name: Column) -> Column:
    return _chosen([(name.rlike(rf"\p{{Is{s}}}"), F.lit(s)) for s in SCRIPTS[1:]], F.lit(SCRIPTS[0]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _pieces(match: Column) -> Column:
    """The parts of a match: array of (kind, canon, raw); a part without a kind stays as it is."""
    none = F.lit(None).cast("string")

    def part(kind: Column, canon: Column, raw: Column) -> Column:
        return F.struct(kind.alias("kind"), canon.alias("canon"), raw.alias("raw"))

    words = F.split(match, " ")
    female = rf"^(?:{_either_case(TITLES['f'] + _FEMALE)})\b|^(?:(?:{_either_case(NEUTRAL)})\.? )+(?:{_either_case(_FEMALE)})\b"
    gender = F.when(match.rlike(female), "f").otherwise("m")

    def word(w: Column, i: Column) -> Column:
        name = F.initcap(w)
        kind = F.when(w.rlike(rf"^(?:(?:{_TITLE})\.?|{_PARTICLE})$"), none).when(
            i == F.size(words) - 1, F.concat(F.lit("surname "), script_of(w))
        )
        return part(kind.otherwise(F.concat(F.lit("given "), gender, F.lit(" "), script_of(w))), name, w)

    digits = _digits(match)
    canon = {
        "mail": F.lower(match),
        "address": match,
        "address6": F.lower(match),
        "social": digits,
        "phone": F.when(F.length(digits) >= 10, F.right(digits, F.lit(10))).otherwise(digits),
        "number": digits,
        "account": F.regexp_replace(match, " ", ""),
    }
    simple = [(match.rlike(_only(PATTERNS[k])), F.array(part(F.lit(k), c, match))) for k, c in canon.items()]
    return _chosen(simple, F.transform(words, word))


def occurrences(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Every part of every entity: keys, pos, idx, kind, canon, raw."""
    found = rows.select(*keys, F.posexplode(F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).alias("pos", "match"))
    parts = found.select(*keys, "pos", F.posexplode(_pieces(F.col("match"))).alias("idx", "part"))
    return parts.select(*keys, "pos", "idx", "part.*")


# -- surrogates ------------------------------------------------------------------------


def _digest(key: str, *values: Column) -> Column:
    inner = F.sha2(F.concat_ws("|", F.lit(key), *values), 256)
    return F.sha2(F.concat(F.lit(key), inner), 256)


def _number(digest: Column, i: Column) -> Column:
    """The i-th number from 0 to 65535 of a digest, over and over."""
    return F.conv(F.substr(digest, (i * 3) % 60 + 1, F.lit(4)), 16, 10).cast("int")


def _chars(value: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(value), F.lit(1))), lambda i: F.substr(value, i, F.lit(1))
    )


def _letter(number: Column, first: str, n: int) -> Column:
    return F.char(F.lit(ord(first)) + number % n)


def _like(value: Column, digest: Column) -> Column:
    """Another text of the same form: digits for digits, letters for letters."""

    def one(c: Column, i: Column) -> Column:
        n = _number(digest, i)
        return (
            F.when(c.rlike("[0-9]"), F.char(F.lit(48) + n % 10))
            .when(c.rlike("[a-z]"), _letter(n, "a", 26))
            .when(c.rlike("[A-Z]"), _letter(n, "A", 26))
            .otherwise(c)
        )

    return F.array_join(F.transform(_chars(value), one), "")


def luhn(digits: Column) -> Column:
    """The Luhn sum of ``digits``, the last one counting once, modulo 10."""

    def one(c: Column, i: Column) -> Column:
        twice = c.cast("int") * (1 + i % 2)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    parts = F.transform(_chars(F.reverse(digits)), one)
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10


def _picked(items: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in items]), (number % len(items) + 1).cast("int"))


def _several(items: list[str], digest: Column, more: Column, between: str) -> Column:
    """``more`` + 1 of ``items``, one after another."""
    picked = F.transform(F.sequence(F.lit(0), more), lambda i: _picked(items, _number(digest, i)))
    return F.array_join(picked, between)


def surrogate(key: str) -> Column:
    """The surrogate of the columns kind, canon and attempt, in normal form."""
    kind, canon, attempt = F.col("kind"), F.col("canon"), F.col("attempt")
    digest = _digest(key, kind, canon, attempt.cast("string"))
    like = _like(canon, digest)
    # later draws are longer, so that there are always enough of them
    longer = F.array_join(F.transform(F.sequence(F.lit(1), attempt), lambda i: _letter(_number(digest, i), "a", 26)), "")
    longer = F.when(attempt > 0, longer).otherwise("")
    local_part = F.substr(canon, F.lit(1), F.instr(canon, "@") - 1)
    mail = F.concat(_like(local_part, digest), longer, F.lit("@"), F.col("domain"))
    top = F.substring_index(canon, ".", -1)
    below = F.substr(canon, F.lit(1), F.length(canon) - F.length(top) - 1)
    domain = F.concat(_like(below, digest), longer, F.lit("."), top)
    octets = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_number(digest, i) % 254 + 1).cast("string"))
    local = F.regexp_extract(canon, r"^(10\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.)", 1)
    outside = F.array_join(octets, ".")
    inside = F.concat(local, F.substring_index(outside, ".", -3))  # a private network stays one
    inside = F.when(local == "10.", inside).otherwise(F.concat(local, F.substring_index(outside, ".", -2)))
    groups = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.substr(digest, i * 4 + 1, F.lit(4)))
    area = F.concat(  # the first digits of the area and of the exchange are 2 to 9
        F.char(F.lit(50) + _number(digest, F.lit(0)) % 8), F.substr(like, F.lit(2), F.lit(2)),
        F.char(F.lit(50) + _number(digest, F.lit(3)) % 8), F.substr(like, F.lit(5)),
    )
    kept = F.concat(F.left(canon, F.lit(1)), F.substr(like, F.lit(2)))  # the issuer's digit stays
    body = F.left(kept, F.length(kept) - 1)
    valid = F.concat(body, ((10 - luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))
    names = [(kind == f"given {g} {s}", _several(items, digest, attempt, "-")) for (g, s), items in GIVEN.items()]
    names += [
        (kind == f"surname {s}", F.initcap(_several(items, digest, attempt + 2, ""))) for s, items in SYLLABLES.items()
    ]
    return _chosen(
        [
            (kind == "mail", mail),
            (kind == "domain", domain),
            (kind == "address", F.when(local == "", outside).otherwise(inside)),
            (kind == "address6", F.concat(F.lit("2001:db8:"), F.array_join(groups, ":"))),
            (kind == "phone", F.when(F.length(canon) == 10, area).otherwise(like)),
            (kind == "number", F.when(luhn(canon) == 0, valid).otherwise(kept)),
            (kind == "social", F.concat((_number(digest, F.lit(0)) % 8 + 1).cast("string"), F.substr(like, F.lit(2)))),
            (kind == "account", F.concat(F.left(canon, F.lit(2)), F.substr(like, F.lit(3)))),
            *names,
        ],
        like,
    )


def _drawn(own: DataFrame, key: str, draw) -> DataFrame:
    """One surrogate per distinct (kind, canon) of ``own``: kind, canon, surrogate; all distinct, none an entity."""
    taken = own.select("kind", F.col("canon").alias("surrogate"))
    left, done, attempt = own, [], 0
    while not left.isEmpty():
        drawn = left.withColumn("attempt", F.lit(attempt)).withColumn("surrogate", draw(key)).drop("attempt")
        drawn = settle(drawn)
        free = drawn.join(taken, ["kind", "surrogate"], "left_anti")
        first = free.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon"))
        done.append(settle(first.select("kind", "canon", "surrogate")))
        taken = taken.union(done[-1].select("kind", "surrogate"))
        left = settle(left.join(done[-1], ["kind", "canon"], "left_anti"))
        attempt += 1
    return reduce(DataFrame.union, done) if done else own.select("kind", "canon").withColumn("surrogate", F.col("canon"))


def surrogates(entities: DataFrame, key: str, draw=surrogate) -> DataFrame:
    """One surrogate per distinct (kind, canon): kind, canon, surrogate; all distinct, none an entity.

    Domains of addresses are entities of their own: addresses of one domain stay together,
    and those of two domains apart.
    """
    own = entities.select("kind", "canon").distinct()
    own = settle(own.withColumn("_domain", F.when(F.col("kind") == "mail", F.substring_index("canon", "@", -1))))
    domains = own.where("_domain IS NOT NULL").select(F.lit("domain").alias("kind"), F.col("_domain").alias("canon")).distinct()
    domains = _drawn(settle(domains.withColumn("domain", F.lit(""))), key, draw)
    known = domains.select(F.col("canon").alias("_domain"), F.col("surrogate").alias("domain"))
    mails = salted_join(own.where("_domain IS NOT NULL"), known, "_domain", "canon")
    rest = own.where("_domain IS NULL").withColumn("domain", F.lit(""))
    return _drawn(settle(mails.drop("_domain").unionByName(rest.drop("_domain"))), key, draw)


def _filled(raw: Column, digits: Column) -> Column:
    """``raw`` with its last digits replaced, one by one, by ``digits``; the ones before stay."""
    values = F.concat(F.left(_digits(raw), F.greatest(F.length(_digits(raw)) - F.length(digits), F.lit(0))), digits)
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def one(a: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.struct(
            F.concat(a["out"], F.when(digit, F.substr(values, a["at"], F.lit(1))).otherwise(c)).alias("out"),
            (a["at"] + digit.cast("int")).alias("at"),
        )

    return F.aggregate(_chars(raw), start, one)["out"]


def _written(kind: Column, raw: Column, new: Column) -> Column:
    """A surrogate in the notation of the occurrence."""
    cased = F.array_join(
        F.zip_with(_chars(raw), _chars(new), lambda r, n: F.when(r.rlike("[A-Z]"), F.upper(n)).otherwise(n)), ""
    )
    spaced = F.aggregate(
        _chars(raw),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda a, c: F.struct(
            F.concat(a["out"], F.when(c == " ", c).otherwise(F.substr(new, a["at"], F.lit(1)))).alias("out"),
            (a["at"] + (c != " ").cast("int")).alias("at"),
        ),
    )["out"]
    shouted = (F.length(raw) > 1) & (raw == F.upper(raw))
    return (
        F.when(kind == "mail", cased)
        .when(kind.isin("phone", "number", "social"), _filled(raw, new))
        .when(kind == "account", spaced)
        .when(kind.isin("address", "address6"), new)
        .otherwise(F.when(shouted, F.upper(new)).otherwise(new))
    )


def _renamed(text: Column, person: Column) -> Column:
    """``text`` with the bare surname replaced, as such and in capitals; surrogates are nobody's surname."""
    for form in (lambda x: x, F.upper):
        name = F.concat(F.lit(r"(?<![\p{L}\w])"), form(person["canon"]), F.lit(r"(?![\p{L}\w])"))
        text = F.regexp_replace(text, name, form(person["surrogate"]))
    return text


def replace(docs: DataFrame, key: str, text: str = "text", doc_id: str = "doc_id", count: str = "n_entities") -> DataFrame:
    """The documents with every entity replaced, and how many there were."""
    rows, names = hidden(docs)
    body = F.col(names[text])
    rows = rows.withColumns({"_k1": F.xxhash64(names[doc_id]), "_k2": F.xxhash64(names[doc_id], names[text])})
    keys = ["_k1", "_k2"]
    found = store(occurrences(rows.select(*keys, names[text]), keys, names[text]), "entities")
    chosen = surrogates(found.where("kind IS NOT NULL"), key)
    joined = found.join(chosen, ["kind", "canon"], "left")
    new = F.when(F.col("surrogate").isNull(), F.col("raw")).otherwise(_written(F.col("kind"), F.col("raw"), F.col("surrogate")))
    parts = joined.select(*keys, "pos", F.struct("idx", new.alias("new")).alias("part"))
    whole = parts.groupBy(*keys, "pos").agg(F.sort_array(F.collect_set("part"))["new"].alias("new"))
    whole = whole.select(*keys, F.struct("pos", F.array_join("new", " ").alias("new")).alias("m"))
    per_text = whole.groupBy(*keys).agg(F.sort_array(F.collect_list("m"))["new"].alias("_new"))
    # a text's persons, by whose surnames alone it may go on
    persons = joined.where(F.col("kind").startswith("surname ") & (F.length("canon") > 1))
    persons = persons.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("canon", "surrogate"))).alias("_persons"))
    out = rows.join(per_text, keys, "left").join(persons, keys, "left")
    gaps = F.split(body, ANY, -1)
    none = F.array().cast("array<struct<canon:string,surrogate:string>>")
    gaps = F.transform(gaps, lambda g: F.aggregate(F.coalesce("_persons", none), g, _renamed))
    mended = F.array_join(F.zip_with(gaps, F.concat("_new", F.array(F.lit(""))), lambda g, n: F.concat(g, n)), "")
    out = out.withColumn(names[text], F.when(F.col("_new").isNull(), body).otherwise(mended))
    return shown(out, names, F.coalesce(F.size("_new"), F.lit(0)).alias(count))
