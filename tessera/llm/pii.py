"""Surrogates for personal data: keyed, of the same type and format, distinct and coreferent.

Mentions are found by patterns, behind cheap tests that most texts fail. Each has a canonical form (an address in lower
case, a number's digits), so that two spellings of one entity are one entity; a person's given name and surname are
entities of their own, so that a surname alone stays that of the full name. Every distinct entity gets a canonical
surrogate from a keyed hash, character by character within its class; surrogates that clash with each other or with any
entity of the table are drawn again, from the WIDEN-th draw on out of a space that grows with each draw, so distinct
entities stay distinct however many there are, and none turns into another. A mention is then dressed: the surrogate's
characters take the mention's punctuation and case. Expressions only; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, salted_join, unique_name

#: Given names by script and gender (fixed values).
GIVEN = {
    ("latin", "f"): ["Anna", "Clara", "Edith", "Helen", "Irene", "Julia", "Laura", "Maria", "Marta", "Nadia", "Paula", "Rosa", "Silvia", "Teresa", "Vera", "Wanda"],
    ("latin", "m"): ["Albert", "Bruno", "Carl", "Daniel", "Emil", "Frank", "Georg", "Hugo", "Ivan", "Jan", "Leon", "Martin", "Oscar", "Paul", "Thomas", "Victor"],
    ("cyrillic", "f"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Лидия", "Мария", "Нина", "Ольга", "Раиса", "София"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Павел", "Роман"],
    ("greek", "f"): ["Άννα", "Ελένη", "Ζωή", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία", "Χριστίνα"],
    ("greek", "m"): ["Ανδρέας", "Βασίλης", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος", "Σπύρος"],
}
#: Syllables that family names are made of, by script (fixed values).
SYLLABLES = {
    "latin": ["bal", "ber", "dan", "den", "fal", "gor", "han", "kel", "lan", "mar", "nor", "pen", "ral", "sen", "tor", "wal"],
    "cyrillic": ["бал", "бер", "вал", "гор", "дан", "жар", "зан", "кол", "лан", "мар", "нор", "пет", "рад", "сал", "тор", "хан"],
    "greek": ["βαλ", "γορ", "δαν", "ζαρ", "καλ", "λαν", "μαρ", "νορ", "παν", "ραδ", "σαλ", "τορ"],
}
#: Titles that tell a name, and its gender but for those of "n" (fixed values).
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"],
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"],
    "n": ["Dr", "Prof"],
}
#: Draws that keep a format as it is; the n-th one after them may add n characters.
WIDEN = 4
_TITLE = "|".join(t for kind in TITLES.values() for t in kind)
_GIVEN = "|".join(n for names in GIVEN.values() for n in names)
_WORD = r"\p{Lu}[\p{L}'’]++"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Patterns of each type, in order of precedence (fixed values). Repeated groups are possessive: Java matches them without recursion.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "secret": r"(?i:\b(?:token|password|passwd|secret|api[_-]?key)\b\s*+[=:]\s*+[\"']?)[A-Za-z0-9_/+\-]{8,}+",
    "key": r"\bAKIA[0-9A-Z]{16}\b",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    "phone": r"\+\d{1,3}[ .\-]?\(\d{2,4}\)[ .\-]?\d{3}[ .\-]?\d{4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|(?<![\d\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d\-])|\+\d{1,3}(?:[ .\-]\d{2,4}){2,5}(?!\d)",
    "card": r"(?<![\d.])(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3})(?!\d|\.\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?=\p{{Lu}})(?:(?:{_TITLE})\.? {_WORD}(?: {_WORD})?|(?:{_GIVEN}) {_WORD})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What of a mention is not the entity: labels of secrets, titles of names.
LEAD = {"secret": r"^(?i:(?:token|password|passwd|secret|api[_-]?key)\s*[=:]\s*[\"']?)", "key": "^AKIA", "name": rf"^(?:{_TITLE})\.? "}


def may_hold(text: Column) -> Column:
    """A cheap test that every text with a mention passes: a sign or word that some pattern needs."""
    lower = F.lower(text)
    word = lower.contains("token") | lower.contains("passw") | lower.contains("secret") | lower.contains("api")
    return text.contains("@") | text.contains("AKIA") | text.rlike(r"[0-9][0-9.\-() +]{5,}[0-9]") | word | text.rlike(PATTERNS["name"])


def kind_of(mention: Column) -> Column:
    """The type of a mention: the first whose pattern it is; "none" for a number like a card's without its checksum."""
    out = F.lit("name")
    for kind, p in reversed(PATTERNS.items()):
        is_kind = F.when(_luhn(F.regexp_replace(mention, r"\D", "")) == 0, "card").otherwise("none") if kind == "card" else F.lit(kind)
        out = F.when(mention.rlike(rf"^(?:{p})$"), is_kind).otherwise(out)
    return out


def lead_of(mention: Column, kind: Column) -> Column:
    """The part of a mention that stays."""
    out = F.lit("")
    for k, p in LEAD.items():
        out = F.when(kind == k, F.regexp_extract(mention, p, 0)).otherwise(out)
    return out


def parts_of(mention: Column, kind: Column, lead: Column) -> Column:
    """array<struct<kind, lead, body>>: a mention's entities with what stands before each; names of two words hold two."""
    body = F.substr(mention, F.char_length(lead) + 1)
    given, surname = F.substring_index(body, " ", 1), F.substring_index(body, " ", -1)

    def part(k: Column, before: Column, rest: Column) -> Column:
        return F.struct(k.alias("kind"), before.alias("lead"), rest.alias("body"))

    two = F.array(part(F.lit("given"), lead, given), part(F.lit("surname"), F.lit(" "), surname))
    one = F.array(part(F.when(kind == "name", "surname").otherwise(kind), lead, body))
    return F.when((kind == "name") & body.contains(" "), two).otherwise(one)


def entity_of(body: Column, kind: Column, lead: Column) -> Column:
    """The canonical form: digits of numbers, lower case of addresses, names capitalised, given ones with their gender, else as it is."""
    name = F.initcap(F.lower(body))
    gender = F.lit("n")
    for g in ("m", "f"):
        known = [n for (_, of), names in GIVEN.items() if of == g for n in names]
        gender = F.when((lead == "") & name.isin(known), g).otherwise(gender)
        gender = F.when(lead.rlike(rf"^(?:{'|'.join(TITLES['n'])})\b") & name.isin(known), g).otherwise(gender)
        gender = F.when(lead.rlike(rf"^(?:{'|'.join(TITLES[g])})\.? "), g).otherwise(gender)
    return (
        F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(body, r"\D", ""))
        .when(kind == "email", F.lower(body))
        .when(kind == "given", F.concat_ws(" ", gender, name))
        .when(kind == "surname", name)
        .otherwise(body)
    )


def _bound(value: Column, use) -> Column:
    """use(value), with value worked out once: what a lambda captures is worked out for each of its elements."""
    return F.transform(F.array(value), use)[0]


def _digest(key: str, *of: Column) -> Column:
    """A keyed hash."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *(c.cast("string") for c in of)), 256)


def _number(digest: Column, at) -> Column:
    """A number drawn at a place of a keyed hash."""
    return F.pmod(F.xxhash64(digest, at), F.lit(1 << 40))


def _char_from(letters: str, n: Column) -> Column:
    return F.substr(F.lit(letters), (n % len(letters) + 1).cast("int"), F.lit(1))


def _scrambled(text: Column, digest: Column) -> Column:
    """Text with every character replaced within its class: digits, letters of either case (hexadecimal in long strings of that), other letters by script."""
    hexadecimal = text.rlike("^(?=.*[a-f])(?=.*[0-9])[0-9a-f]{12,}$")

    def one(c: Column, n: Column) -> Column:
        return (
            F.when(c.rlike("[0-9]"), _char_from("0123456789", n))
            .when(c.rlike("[a-z]"), _char_from("abcdefghijklmnopqrstuvwxyz", n))
            .when(c.rlike("[A-Z]"), _char_from("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n))
            .when(c.rlike(r"\p{IsCyrillic}"), _char_from("абвгдежзиклмнопрстуфхцчшэюя", n))
            .when(c.rlike(r"\p{IsGreek}"), _char_from("αβγδεζηθικλμνξοπρστυφχψω", n))
            .when(c.rlike(r"\p{L}"), _char_from("éèêàçäöüßñíóáúâî", n))
            .otherwise(c)
        )

    def whole(d: Column) -> Column:
        letters = F.split(text, "")
        plain = F.transform(letters, lambda c, i: one(c, _number(d, i)))
        return F.concat_ws("", F.when(hexadecimal, F.transform(letters, lambda c, i: _char_from("0123456789abcdef", _number(d, i)))).otherwise(plain))

    return _bound(digest, whole)


def _luhn(digits: Column) -> Column:
    """The checksum of a number modulo 10."""
    def mark(c: Column, i: Column) -> Column:
        d = c.try_cast("int")  # null in what isn't a number, whose checksum nobody reads
        return F.when(i % 2 == 0, d).otherwise((d * 2) % 10 + F.when(d > 4, 1).otherwise(0))

    marks = F.transform(F.reverse(F.split(digits, "")), mark)
    return F.aggregate(marks, F.lit(0), lambda s, x: s + x) % 10


def surrogate_of(kind: Column, entity: Column, key: str, attempt: int) -> Column:
    """The canonical surrogate of an entity at an attempt. Numbers keep their first digit if it is not 0, cards their checksum, addresses their top-level domain.

    From attempt WIDEN on addresses of machines take any octets, and all types grow by a character each attempt.
    """
    digest = _digest(key, kind, entity, F.lit(attempt))
    more = max(0, attempt - WIDEN + 1)
    plain = _scrambled(F.concat(entity, F.lit("0" * more)), digest)
    first = F.concat(F.when(F.substr(entity, F.lit(1), F.lit(1)) == "0", F.substr(plain, F.lit(1), F.lit(1))).otherwise(F.substr(entity, F.lit(1), F.lit(1))), F.substr(plain, F.lit(2)))
    body = F.substr(first, F.lit(1), F.char_length(first) - 1)
    last = F.pmod(-_luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    top = F.substring_index(domain, ".", -1)
    inner = F.substr(domain, F.lit(1), F.char_length(domain) - F.char_length(top))
    host = _scrambled(inner, _digest(key, F.lit("domain"), inner, F.lit(attempt)))
    email = F.concat(_scrambled(F.concat(local, F.lit("x" * more)), digest), F.lit("@"), host, top)

    def octet(c: Column, n: Column) -> Column:
        if more:
            return (n % 255 + 1).cast("string")
        return F.when(F.char_length(c) == 1, n % 9 + 1).when(F.char_length(c) == 2, n % 90 + 10).otherwise(n % 156 + 100).cast("string")

    octets = _bound(digest, lambda d: F.concat_ws(".", F.transform(F.split(entity, r"\."), lambda c, i: octet(c, _number(d, i)))))
    ip = F.concat(octets, _scrambled(F.lit("0" * max(0, more - WIDEN)), digest))
    letters = F.when(kind == "given", F.substr(entity, F.lit(3))).otherwise(entity)
    script = F.when(letters.rlike(r"\p{IsCyrillic}"), "cyrillic").when(letters.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    gender = F.substr(entity, F.lit(1), F.lit(1))

    def pick() -> Column:
        out = F.lit("")
        for s in SYLLABLES:
            both = {g: GIVEN[s, g] for g in "fm"}
            for g, names in {**both, "n": both["f"] + both["m"]}.items():
                at = (_number(digest, F.lit(-1)) % len(names) + 1).cast("int")
                out = F.when((script == s) & (gender == g), F.element_at(F.array(*map(F.lit, names)), at)).otherwise(out)
        return out

    def syllable(i: int) -> Column:
        out = F.lit("")
        for s, parts in SYLLABLES.items():
            at = (_number(digest, F.lit(i)) % len(parts) + 1).cast("int")
            out = F.when(script == s, F.element_at(F.array(*map(F.lit, parts)), at)).otherwise(out)
        return out

    surname = F.initcap(F.concat(*(syllable(i) for i in range(4 + more))))
    given = F.concat(gender, F.lit(" "), pick(), *([F.lit("-"), F.initcap(F.concat(*(syllable(i) for i in range(1 + more))))] if more else []))
    return (
        F.when(kind == "card", F.concat(body, last))
        .when(kind.isin("phone", "ssn"), first)
        .when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "given", given)
        .when(kind == "surname", surname)
        .otherwise(plain)
    )


def dressed(body: Column, kind: Column, surrogate: Column) -> Column:
    """A canonical surrogate in the punctuation and case of a mention's entity."""
    rest = F.split(body, "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    digits = F.aggregate(  # numbers are short; what a surrogate has more goes to the end
        rest,
        start,
        lambda s, c: F.when(
            c.rlike(r"\d"), F.struct(F.concat(s["out"], F.substr(surrogate, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))
        ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
        lambda s: F.concat(s["out"], F.substr(surrogate, s["at"])),
    )
    cased = F.concat_ws("", F.zip_with(F.split(surrogate, ""), rest, lambda c, was: F.when(was.rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)))
    name = F.when(kind == "given", F.substr(surrogate, F.lit(3))).otherwise(surrogate)
    capital = F.when((F.char_length(body) > 1) & (F.upper(body) == body), F.upper(name)).otherwise(name)
    return F.when(kind.isin("phone", "card", "ssn"), digits).when(kind == "email", cased).when(kind.isin("given", "surname"), capital).otherwise(surrogate)


def surrogates(entities: DataFrame, key: str, keep: Scratch) -> DataFrame:
    """(kind, entity, surrogate) of the distinct (kind, entity): one surrogate each, no two alike within a type, none an entity of the table."""
    entities = keep.write(entities.distinct())
    open_, done, attempt = entities, None, 0
    while attempt == 0 or not open_.isEmpty():
        drawn = open_.withColumn("surrogate", surrogate_of(F.col("kind"), F.col("entity"), key, attempt))
        first = drawn.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity"))
        taken = entities if done is None else entities.unionByName(done.select("kind", F.col("surrogate").alias("entity")))
        free = first.join(taken.select("kind", F.col("entity").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        free = keep.write(free.select("kind", "entity", "surrogate"))
        done = free if done is None else done.unionByName(free)
        open_ = open_.join(free, ["kind", "entity"], "left_anti")
        attempt += 1
    return done


def replace_pii(docs: DataFrame, *, key: str, text: str = "text", count: str = "n_entities") -> DataFrame:
    """docs with every mention replaced in ``text``, and the number of mentions in column ``count``.

    ``key`` fixes the surrogates: the same key gives the same ones (but for clashes, which depend on the table). Names are
    those behind a title or with a known given name, in scripts that have capitals; other than Cyrillic and Greek ones
    get Latin surrogates. A null
    text stays null, with no mentions; an empty one stays empty; repeated rows get equal surrogates; an empty table
    gives no row. All other columns stay, clashing names included (if ``count`` is taken, underscores follow it).
    Documents without mentions pass by in one scan; the others, and the distinct entities, are written once and joined
    by entity, where a frequent entity's mentions may be split over tasks.
    """
    count = unique_name(count, docs.columns)
    keep = Scratch(docs.sparkSession, "pii")
    body = F.col(text)
    some = F.coalesce(F.when(may_hold(body), body.rlike(ANY)), F.lit(False))
    names = {x: unique_name(x, [*docs.columns, count]) for x in ("pii_row", "pii_found")}
    row, found = names["pii_row"], names["pii_found"]
    hits = keep.write(docs.where(some).withColumns({row: F.monotonically_increasing_id(), found: F.regexp_extract_all(body, F.lit(ANY), F.lit(0))}))
    at = hits.select(F.col(row).alias("row"), F.posexplode(found).alias("pos", "mention")).withColumn("type", kind_of(F.col("mention")))
    at = at.withColumn("start", lead_of(F.col("mention"), F.col("type")))
    at = at.select("row", "pos", F.posexplode(parts_of(F.col("mention"), F.col("type"), F.col("start"))).alias("part", "of"))
    at = at.select("row", "pos", "part", "of.kind", "of.lead", "of.body")
    at = keep.write(at.withColumn("entity", entity_of(F.col("body"), F.col("kind"), F.col("lead"))))
    real = F.col("kind") != "none"
    mapped = surrogates(at.where(real).select("kind", "entity"), key, keep)
    met = salted_join(at, mapped, ["kind", "entity"], F.struct("row", "pos"), "left")
    new = F.concat("lead", F.coalesce(dressed(F.col("body"), F.col("kind"), F.col("surrogate")), F.col("body")))
    parts = met.select("row", F.struct("pos", "part", new.alias("new")).alias("p"), (real & (F.col("part") == 0)).cast("int").alias("n"))
    lists = parts.groupBy("row").agg(F.array_sort(F.collect_list("p")).alias("new"), F.sum("n").cast("int").alias("n"))
    lists = lists.withColumnsRenamed({"row": row, "new": found + "_new", "n": found + "_n"})
    met = hits.join(lists, row)
    # what follows each entity: nothing after a given name, whose surname is next, else the text up to the next mention
    news = F.col(found + "_new")
    rebuilt = _bound(
        F.split(body, ANY, -1),
        lambda between: F.concat(
            between[0],
            F.concat_ws("", F.transform(news, lambda p, i: F.concat(p["new"], F.when(F.get(news, i + 1)["pos"] == p["pos"], F.lit("")).otherwise(F.get(between, p["pos"] + 1))))),
        ),
    )
    changed = met.select(*(rebuilt.alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns), F.col(found + "_n").alias(count))
    return docs.where(~some).withColumn(count, F.lit(0)).unionByName(changed)
