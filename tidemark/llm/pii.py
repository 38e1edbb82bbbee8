"""Personal data replaced by keyed, type-consistent surrogates, in DataFrame functions only.

Each entity has a type and a canonical form (digits of a number, lower case of an address), so
that every spelling of it gets the same surrogate, written in the spelling's own format. A name is
a title or a common given name and the run of capitalised words after it; it is keyed by its
surname, with or without title and given names, and a document's later mentions of that surname
alone follow. A phone is keyed by its last ten digits, with or without country code. Common given
names are exchanged one for one within their gender and script, others get made-up ones, initials
another letter. What is replaced keeps its kind: digits stay digits and letters letters, a card keeps its first digit and
checksum, a phone its country code, an octet its width, a name its gender and script. Surrogates
are checked over the whole corpus: no two entities share one and none is a real entity; an entity
that fails takes its next keyed attempt.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.workspace import Workspace, files_for

#: For demonstrations and tests; pass a secret of your own.
DEMO_KEY = "not a secret"
#: Attempts after which a surrogate gives up its format for a keyed label.
ATTEMPTS = 12

# Titles by gender, and common given names and surname syllables by script.
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Sra", "г-жа"], "n": ["Dr", "Prof"]}
NAMES = {
    ("latin", "m"): ["James", "John", "Robert", "Michael", "David", "Thomas", "Peter", "Paul", "Hans", "Karl", "Pierre", "Jean", "Carlos", "Miguel"],
    ("latin", "f"): ["Mary", "Linda", "Susan", "Karen", "Sarah", "Laura", "Anna", "Emma", "Greta", "Heidi", "Claire", "Sophie", "Carmen", "Elena"],
    ("cyrillic", "m"): ["Иван", "Пётр", "Сергей", "Дмитрий", "Николай", "Андрей"],
    ("cyrillic", "f"): ["Анна", "Мария", "Ольга", "Елена", "Татьяна", "Наталья"],
}
SYLLABLES = {
    "latin": ["bar", "bel", "cor", "dan", "fal", "gor", "hal", "kem", "lin", "mar", "nor", "pel", "ros", "sten", "tor", "val"],
    "cyrillic": ["бар", "бел", "вол", "гор", "дан", "зор", "кам", "лин", "мар", "нор", "пел", "рос", "сол", "тор", "хар", "чер"],
}

_PARTICLES = ["von", "van", "der", "den", "de", "da", "di", "du", "del", "della", "dos", "la", "le", "bin", "al", "el", "zu"]
_LETTER = r"[\p{L}\p{M}]"
#: A capitalised word of two letters or more, without a genitive's 's.
_WORD = rf"(?:\p{{Lu}}{_LETTER}++|\p{{Lu}}(?=['’]\p{{L}}))(?:['’\-](?!s(?!\p{{L}})){_LETTER}++)*+"
_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
_GIVEN = "|".join(n for ns in NAMES.values() for n in ns)
#: Up to three words or initials, with particles, and the surname.
_RUN = rf"(?:(?:{_WORD}|\p{{Lu}}\.)\x20){{0,3}}(?:(?:{'|'.join(_PARTICLES)})\x20){{0,3}}{_WORD}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"


def _address(script: str) -> str:
    """An address in letters of one script, so that it doesn't take in words of another before it."""
    local = rf"[\p{{Is{script}}}\p{{M}}0-9._%+\-]"
    return rf"(?<!{local}){local}++@(?:[\p{{Is{script}}}0-9\-]{{1,63}}\.){{1,8}}\p{{Is{script}}}{{2,24}}"


PATTERNS = {
    "email": rf"(?:{_address('Latin')}|{_address('Cyrillic')})",
    "token": r"(?<![0-9A-Za-z])(?=[A-Fa-f]{0,127}[0-9])(?:[0-9a-f]{32,128}+|[0-9A-F]{32,128}+)(?![0-9A-Za-z])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<![\d])(?:\d{4}(?:[ \-]\d{4}){3}|\d{13,19}+)(?!\d)",
    "phone": r"(?:(?<![\d+])\+\d{1,3}[ .\-]?\(?\d{2,4}\)?[ .\-]?\d{3,4}[ .\-]?\d{3,4}|(?<![\d+(])\(?\d{3}\)?[ .\-]\d{3}[.\-]\d{4})(?!\d)",
    "name": rf"(?=[A-ZЀ-ӿ])(?<!\p{{L}})(?:(?:{_TITLE})\.?\x20{_RUN}|(?:{_GIVEN})\x20{_RUN})",
}
_ANY = "(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
#: No entity starts between two ASCII letters, nor with another letter after one of its script: that
#: test first passes over most of a text. An address or a token may start after another letter.
ENTITY = r"(?!(?<=[A-Za-z])[A-Za-z]|(?=[^\x00-\x7F])(?:(?<=\p{IsLatin})\p{IsLatin}|(?<=\p{IsCyrillic})\p{IsCyrillic}))" + _ANY
#: Only names have neither a digit nor an at sign.
MARKS = "[0-9@]"


def has_entity(text: Column) -> Column:
    """Whether a text holds an entity; most texts are settled without the full pattern."""
    return F.coalesce(F.when(text.rlike(MARKS), text.rlike(ENTITY)).otherwise(text.rlike(PATTERNS["name"])), F.lit(False))


def kind_of(surface: Column) -> Column:
    """The type of a matched entity: the first pattern that fits it whole."""
    out = None
    for kind, pattern in PATTERNS.items():
        fits = surface.rlike(rf"^(?:{pattern})$")
        out = F.when(fits, kind) if out is None else out.when(fits, kind)
    return out.otherwise("name")


def canonical(kind: Column, surface: Column) -> Column:
    """One form for all spellings of an entity: of a name the surname, of a phone what follows its
    country code (the last ten digits)."""
    digits = F.regexp_replace(surface, r"\D", "")
    surname = F.substring_index(surface, " ", -1)
    return F.when(kind == "phone", F.right(digits, F.lit(10))).when(kind.isin("card", "ssn"), digits).when(kind == "name", F.lower(surname)).otherwise(F.lower(surface))


def _stream(*parts: Column) -> Column:
    """256 keyed hex digits."""
    seed = F.concat_ws("\x1f", *parts)
    return F.concat(F.sha2(F.concat(seed, F.lit("\x1fa")), 512), F.sha2(F.concat(seed, F.lit("\x1fb")), 512))


def _pick(stream: Column, i: Column, n: int | Column) -> Column:
    """A number below n from the i-th pair of digits (from 0, repeating after 64; two pairs each)."""
    return F.conv(F.substring(stream, F.pmod(i, F.lit(64)) * 4 + 1, F.lit(4)), 16, 10).cast("int") % n


def _nth(text: str, i: Column) -> Column:
    return F.substring(F.lit(text), i + 1, F.lit(1))


_DIGITS, _LETTERS, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
_CYRILLIC = "".join(chr(c) for c in range(0x430, 0x450))


def _chars(text: Column, each) -> Column:
    """``text`` with every character c at place i (from 0) replaced by each(c, i)."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0))), lambda i: each(F.substring(text, i + 1, F.lit(1)), i)), "")


def _like(stream: Column, c: Column, i: Column) -> Column:
    """A keyed character of c's kind: a digit, or a letter of its script."""
    letter = F.when(c.rlike(r"\p{IsCyrillic}"), _nth(_CYRILLIC, _pick(stream, i, 32))).otherwise(_nth(_LETTERS, _pick(stream, i, 26)))
    return F.when(c.rlike("[0-9]"), _nth(_DIGITS, _pick(stream, i, 10))).when(c.rlike(r"\p{L}"), letter).otherwise(c)


def _luhn(digits: Column) -> Column:
    """The checksum residue, 0 for valid card numbers."""
    n = F.length(digits)

    def value(i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), value), F.lit(0), lambda a, x: a + x) % 10


def with_surrogate(entities: DataFrame, key: str) -> DataFrame:
    """``entities`` (kind, canon, attempt) with surrogate, a canonical form of the same type."""
    k, c = F.lit(key), F.col("canon")
    df = entities.withColumn("_s", _stream(k, F.col("kind"), c, F.col("attempt").cast("string"))).withColumn("_n", F.length("canon"))
    s, n = F.col("_s"), F.col("_n")
    domain = F.substring_index(c, "@", -1)
    df = df.withColumn("_d", _stream(k, F.lit("domain"), domain)).withColumn("_domain", domain)
    labels = F.regexp_extract("_domain", r"^(.*)(\.[^.]*)$", 1)
    email = F.concat(_chars(F.substring_index(c, "@", 1), lambda x, i: _like(s, x, i)), F.lit("@"), _chars(labels, lambda x, i: _like(F.col("_d"), x, i)), F.regexp_extract("_domain", r"(\.[^.]*)$", 1))
    token = _chars(c, lambda x, i: _nth(_HEX, _pick(s, i, 16)))
    octets = F.split(c, r"\.")
    octet = lambda x, i: F.when(F.length(x) == 1, 1 + _pick(s, i, 9)).when(F.length(x) == 2, 10 + _pick(s, i, 90)).otherwise(100 + _pick(s, i, 156)).cast("string")
    ip = F.array_join(F.transform(octets, octet), ".")
    ssn = _chars(c, lambda x, i: F.when(i.isin(0, 3, 5), _nth("12345", _pick(s, i, 5))).otherwise(_nth(_DIGITS, _pick(s, i, 10))))
    # area and exchange don't start with 0 or 1
    phone = _chars(c, lambda x, i: F.when(i.isin(0) | (i == n - 10) | (i == n - 7), _nth("23456789", _pick(s, i, 8))).otherwise(_nth(_DIGITS, _pick(s, i, 10))))
    # the card's last digit restores the residue of its checksum
    body = F.concat(F.substring(c, 1, 1), F.substring(_chars(c, lambda x, i: _nth(_DIGITS, _pick(s, i, 10))), F.lit(2), n - 2))
    df = df.withColumn("_body", F.concat(body, F.lit("0")))
    card = F.concat(F.substring("_body", F.lit(1), n - 1), F.pmod(_luhn(c) - _luhn(F.col("_body")), F.lit(10)).cast("string"))
    df = df.withColumn(
        "surrogate",
        F.when(F.col("attempt") >= ATTEMPTS, F.concat(F.lit("["), F.col("kind"), F.lit("-"), F.substring(s, 1, 32), F.lit("]")))
        .when(F.col("kind") == "email", email)
        .when(F.col("kind") == "token", token)
        .when(F.col("kind") == "ip", ip)
        .when(F.col("kind") == "ssn", ssn)
        .when(F.col("kind") == "card", card)
        .when(F.col("kind") == "phone", phone)
        .otherwise(_name(s)),
    )
    return df.drop("_s", "_n", "_d", "_domain", "_body")


def _name(s: Column) -> Column:
    """A name of keyed syllables in the same script."""
    script = F.when(F.col("canon").rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    surname = F.lit("")
    for where, parts in SYLLABLES.items():
        listed = F.array(*[F.lit(p) for p in parts])
        made = F.array_join(F.transform(F.sequence(F.lit(1), 3 + F.col("attempt")), lambda i: F.get(listed, _pick(s, i, len(parts)))), "")
        surname = F.when(script == where, made).otherwise(surname)
    return surname


def _exchanged(key: str) -> dict[str, str]:
    """For each common given name another of its gender and script, one for one: each list goes
    round in a keyed order, so that given names of one surname stay distinct."""
    pairs: dict[str, str] = {}
    for names in NAMES.values():
        order = sorted((n.lower() for n in names), key=lambda n: hashlib.sha512(f"{key}\x1fgiven\x1f{n}".encode()).digest())
        pairs.update(zip(order, order[1:] + order[:1]))
    return pairs


def _initials(key: str) -> tuple[str, str]:
    """Capital letters and what stands for each."""
    turn = 1 + hashlib.sha512(f"{key}\x1finitial".encode()).digest()[0] % 24
    alphabets = [_LETTERS.upper(), _CYRILLIC.upper()]
    return "".join(alphabets), "".join(a[turn:] + a[:turn] for a in alphabets)


def bare_name(surface: Column) -> Column:
    """A name without its title."""
    return F.regexp_replace(surface, rf"^(?:{_TITLE})\.?\x20", "")


def first_words(kind: Column, surface: Column) -> Column:
    """The words of a name before its surname; of other kinds none."""
    words = F.split(bare_name(surface), " ")
    return F.when(kind == "name", F.slice(words, 1, F.size(words) - 1)).otherwise(F.array().cast("array<string>"))


def is_made_up(word: Column) -> Column:
    """Whether a name's word needs a made-up one: no particle, initial or common given name."""
    common = [n.lower() for names in NAMES.values() for n in names]
    return ~(word.isin(*_PARTICLES) | word.rlike(r"^\p{Lu}\.$") | F.lower(word).isin(*common))


def rendered(kind: Column, surface: Column, surrogate: Column, made: Column, key: str) -> Column:
    """``surrogate`` written as ``surface`` is: its punctuation, case, title and country code, and
    with the words before a surname exchanged; ``made`` (a map) has those that are made up."""
    held = F.regexp_replace(surface, r"\D", "")
    code = F.when(kind == "phone", F.left(held, F.greatest(F.length(held) - 10, F.lit(0)))).otherwise("")
    number = F.concat(code, surrogate)
    step = lambda a, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(a["s"], F.substring(number, a["k"] + 1, F.lit(1))).alias("s"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["k"].alias("k")))
    digits = F.aggregate(F.split(surface, ""), F.struct(F.lit("").alias("s"), F.lit(0).alias("k")), step, lambda a: a["s"])
    cased = _chars(surrogate, lambda c, i: F.when(F.substring(surface, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c))
    bare = bare_name(surface)
    title = F.left(surface, F.length(surface) - F.length(bare))
    common = F.create_map(*[F.lit(x) for pair in _exchanged(key).items() for x in pair])
    other = lambda w: F.coalesce(F.element_at(common, F.lower(w)), F.element_at(made, F.lower(w)))
    word = lambda w: F.when(w.isin(*_PARTICLES), w).when(w.rlike(r"^\p{Lu}\.$"), F.translate(w, *_initials(key))).otherwise(F.initcap(other(w)))
    label = F.startswith(surrogate, F.lit("["))
    last = F.when(label, surrogate).otherwise(F.initcap(surrogate))
    whole = F.array_join(F.concat(F.transform(first_words(kind, surface), word), F.array(last)), " ")
    name = F.concat(title, F.when((bare == F.upper(bare)) & ~label, F.upper(whole)).otherwise(whole))
    # a label keeps apart what shares it
    labelled = F.concat(F.when(code != "", F.concat(F.lit("+"), code, F.lit(" "))).otherwise(""), surrogate)
    return F.when(kind == "name", name).when(label, labelled).when(kind.isin("card", "phone", "ssn"), digits).otherwise(cased)


def surrogates(ws: Workspace, entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, surrogate for distinct ``entities`` (kind, canon), all surrogates distinct and
    none of them an entity. The smallest canonical form keeps a contested surrogate. A null canonical
    form has none; no entities give no rows."""
    real = entities.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("real"))
    settled, open_ = None, entities.withColumn("attempt", F.lit(0))
    for step in range(ATTEMPTS + 1):
        tried = ws.stage(with_surrogate(open_, key), f"tried-{step}")
        taken = real if settled is None else real.unionByName(settled.select("kind", "surrogate", F.lit(True).alias("real")))
        winners = tried.groupBy("kind", "surrogate").agg(F.min("canon").alias("winner")).join(taken.distinct(), ["kind", "surrogate"], "left").where("real is null").drop("real")
        marked = ws.stage(tried.join(winners, ["kind", "surrogate"], "left").withColumn("won", F.coalesce(F.col("winner") == F.col("canon"), F.lit(False))).drop("winner"), f"marked-{step}")
        won = marked.where("won").select("kind", "canon", "surrogate")
        settled = won if settled is None else settled.unionByName(won)
        open_ = marked.where("not won").select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
        if open_.isEmpty():
            return settled
    raise RuntimeError("keyed labels collide, which 128 bits should prevent")


def _alone(surname: Column) -> Column:
    """A pattern of a surname on its own: letters, hyphens and apostrophes mean themselves."""
    return F.concat(F.lit(r"(?<![\p{L}\p{M}])(?<!\p{L}['’\-])"), surname, F.lit(r"(?![\p{L}\p{M}]|-\p{L})"))


def replace_entities(docs: DataFrame, key: str = DEMO_KEY, count: str = "n_entities") -> DataFrame:
    """``docs`` with text rewritten and a new column ``count``, the number of entities.

    Texts without entities, null and empty ones pass unchanged (0 entities) and are not shuffled.
    Repeated rows, null ids and all other columns, of whatever names, are kept; a column named
    ``count`` is replaced.
    """
    ws = Workspace(docs.sparkSession, "pii", files_for(docs))
    docs = docs.drop(count)
    others = [c for c in docs.columns if c != "text"]
    text = F.col("text").cast("string")
    plain = docs.where(~has_entity(text)).withColumn(count, F.lit(0))
    # the caller's columns stay together, apart from the columns used here
    whole = docs.select(F.struct(F.lit(0), *[F.col(f"`{c}`") for c in others]).alias("row"), text.alias("text"))
    found = whole.where(has_entity(F.col("text"))).withColumn("found", F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)))
    # a written table gives each row an address that every later read agrees on
    rows = ws.stage(found, "rows").select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("line"))
    met = rows.select("file", "line", F.posexplode("found").alias("at", "surface"))
    kind, surface = F.col("kind"), F.col("surface")
    surfaces = met.select("surface").distinct().withColumn("kind", kind_of(surface)).withColumn("canon", canonical(kind, surface))
    surfaces = ws.stage(surfaces.withColumn("firsts", first_words(kind, surface)), "surfaces")
    made = surfaces.select("surface", F.explode("firsts").alias("word")).where(is_made_up(F.col("word"))).select("surface", F.lit("given").alias("kind"), F.lower("word").alias("canon"))
    new = surrogates(ws, surfaces.select("kind", "canon").unionByName(made.select("kind", "canon")).distinct(), key)
    given = made.distinct().join(new, ["kind", "canon"]).groupBy("surface").agg(F.map_from_entries(F.collect_list(F.struct("canon", "surrogate"))).alias("made"))
    nothing = F.create_map().cast("map<string,string>")
    spelled = surfaces.drop("firsts").join(new, ["kind", "canon"]).join(given, "surface", "left").select("surface", "kind", rendered(kind, surface, F.col("surrogate"), F.coalesce("made", nothing), key).alias("new"))
    last = lambda c: F.substring_index(c, " ", -1)
    spelled = ws.stage(spelled.withColumn("surname", F.when(kind == "name", F.struct(last("surface").alias("old"), last("new").alias("new")))), "spelled")
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("at", "new"))), lambda x: x["new"])
    news = met.join(spelled, "surface").groupBy("file", "line").agg(in_order.alias("new"), F.collect_set("surname").alias("surnames"))
    # what lies between entities, where the same people's surnames may stand alone
    gaps = F.split("text", ENTITY, -1)
    mentions = F.aggregate("surnames", F.lit(0), lambda n, s: n + F.aggregate("gaps", F.lit(0), lambda m, g: m + F.size(F.regexp_extract_all(g, _alone(s["old"]), F.lit(0)))))
    followed = F.transform("gaps", lambda g: F.aggregate("surnames", g, lambda t, s: F.regexp_replace(t, _alone(s["old"]), s["new"])))
    hit = rows.join(news, ["file", "line"]).withColumn("gaps", gaps).withColumn("mentions", mentions).withColumn("gaps", F.when(F.size("surnames") > 0, followed).otherwise(F.col("gaps")))
    merged = F.concat(F.array_join(F.zip_with(F.slice("gaps", 1, F.size("new")), "new", lambda g, n: F.concat(g, n)), ""), F.element_at("gaps", -1))
    back = [merged.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return plain.unionByName(hit.select(*back, (F.size("new") + F.col("mentions")).alias(count))).coalesce(files_for(docs))


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace_entities(docs).select("doc_id", "n_entities", "text")
