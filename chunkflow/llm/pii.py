"""Personal data: detected entities get keyed surrogates of the same type, script and format. DataFrame operations only.

An entity is a kind and a normal form (lower case, or digits only, with the + of a phone), so that all spellings of one entity are replaced
alike. The surrogate's core is drawn from a keyed hash of kind, normal form and attempt; rendering puts it into the
format of the match: separators, case, country code, issuer digit and check digit of a card, title of a person. Titles
give the gender of names, the name's own letters the script. Behind a titled mention, the words of the name are replaced
wherever they stand in the document, each by the same surrogate.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, saved, table

#: Setting of the session that holds the key of the surrogates. Without it a session draws one at random, and keeps it.
KEY = "spark.chunkflow.surrogate.secret"
#: Rounds without fewer collisions than before after which a format (say, of short phones) counts as used up.
STALLED = 30
#: Entities for each file of a round's state. A task that writes a file to a mounted store starts three processes for its permissions.
FILE_ROWS = 8192
#: Pairs of a text and an entity with an attempt above 0, up to which the attempts go to the texts and no text is shuffled.
SENT = 20_000

_MALE = "Mr|Herr|Monsieur|Señor|Sr|Don|Господин"
_FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|Doña|Госпожа"
#: Words that may stand with a capital behind a name; they are no names when they stand alone.
_NO_NAMES = "The This That And But For With From After When Then She His Her Der Die Das Und Ein Eine Les Des Une Los Las Una Del Que".lower().split()
_NAME = r"(?:\p{Lu}(?:[\p{L}\-]|['’](?!s(?!\p{L})))*\p{L})"
#: Kinds in the order in which they are tried at a place.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+\-]*+@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)+",
    "secret": r"(?i:password|passwd|pwd|secret|token|api[_\-]?key|access[_\-]?key|auth)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_\-./+]{8,}",
    "key": r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?:ghp_|sk-|xox[bp]-)[A-Za-z0-9\-]{16,}",
    "ipv6": r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![A-Za-z0-9:])|(?=[0-9A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,5}(?![A-Za-z0-9:])",
    "ip": r"(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d]|\.\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": r"\+1[ .\-]?(?:\(\d{3}\)|\d{3})[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)|\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]\d{2,4}(?!\d|\.\d{1,3}\.\d)){1,4}|\+\d{1,3}[ .\-]\d{6,12}(?!\d)|\+\d{8,15}(?!\d)|\(\d{3}\) ?\d{3}[\-. ]\d{4}(?!\d)|\d{3}[\-.]\d{3}[\-.]\d{4}(?!\d)",
    "card": r"(?:[3-6]\d{3}|222[1-9]|22[3-9]\d|2[3-6]\d{2}|27[01]\d|2720)(?:[ \-]?\d{4}){2}(?:[ \-]?\d{1,4})(?![\d])|3\d{3}[ \-]?\d{6}[ \-]?\d{5}(?!\d)",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "person": rf"(?:{_MALE}|{_FEMALE}|Dr|Prof)\.? {_NAME}(?: {_NAME}){{0,2}}",
}
#: Starts only where no ASCII letter or digit stands before.
ANY = "(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"

#: A phone with a country code, in normal form.
_CODE = r"\A\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{1,3})"

_CONSONANTS, _VOWELS = "bdfgklmnprstvz", "aeiou"
_RU_CONSONANTS, _RU_VOWELS = "бвгдклмнпрст", "аеиоу"


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def kind_of(m: Column) -> Column:
    out = F.lit("person")
    for k, p in reversed(list(PATTERNS.items())[:-1]):
        out = F.when(m.rlike(rf"\A(?:{p})\z"), F.lit(k)).otherwise(out)
    return out


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _value(kind: Column, m: Column) -> Column:
    """The part of a match that is replaced: a secret's value, a person's name."""
    return F.when(kind == "secret", F.regexp_extract(m, r"([A-Za-z0-9_\-./+]{8,})\z", 1)).when(kind == "person", F.regexp_replace(m, rf"\A(?:{_MALE}|{_FEMALE}|Dr|Prof)\.? ", "")).otherwise(m)


def _title(m: Column) -> Column:
    """Gender by the title: m, f or x."""
    return F.when(m.rlike(rf"\A(?:{_FEMALE})\b"), "f").when(m.rlike(rf"\A(?:{_MALE})\b"), "m").otherwise("x")


def _person_words(m: Column) -> Column:
    """The entities of a titled name, one for each word."""
    parts = F.split(_value(F.lit("person"), m), " ")
    last = F.size(parts) - 1
    return F.transform(parts, lambda w, i: F.concat(F.when(i == last, F.when(w.rlike("\\p{IsCyrillic}") & (_title(m) == "f"), "surname_f").otherwise("surname")).otherwise(F.concat(F.lit("given_"), _title(m))), F.lit(":"), F.lower(w)))


def names_of(matches: Column) -> Column:
    """Map of the lower-case words of a document's titled names to their entities.

    A word that occurs in several roles has one entity in the document: a given name of known gender goes first.
    """
    kind = lambda e: F.substring_index(e, ":", 1)
    rank = lambda e: F.when(kind(e) == "given_f", 0).when(kind(e) == "given_m", 1).when(kind(e) == "surname_f", 2).when(kind(e) == "surname", 3).otherwise(4)
    found = F.array_distinct(F.flatten(F.transform(F.filter(matches, lambda m: kind_of(m) == "person"), _person_words)))

    def of(es: Column) -> Column:
        words = F.array_distinct(F.transform(es, lambda e: F.substring_index(e, ":", -1)))
        best = lambda w: F.array_min(F.transform(F.filter(es, lambda e: F.substring_index(e, ":", -1) == w), lambda e: F.struct(rank(e).alias("r"), e.alias("e"))))["e"]
        return F.map_from_arrays(words, F.transform(words, best))

    return let(found, of)


def mentions(matches: Column) -> Column:
    """Pattern of everything that is replaced in a document with these matches: ANY, and the words of its names alone.

    A word counts as it was written or in capitals, from three letters on, unless it is one of _NO_NAMES.
    """
    words = F.flatten(F.transform(F.filter(matches, lambda m: kind_of(m) == "person"), lambda m: F.split(_value(F.lit("person"), m), " ")))
    words = F.filter(F.array_distinct(words), lambda w: (F.length(w) > 2) & ~F.lower(w).isin(_NO_NAMES))
    both = F.array_distinct(F.concat(words, F.transform(words, F.upper)))
    longest = F.reverse(F.array_sort(both))  # a name before its beginnings
    return let(longest, lambda ws: F.when(F.size(ws) > 0, F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}])(?:"), F.array_join(ws, "|"), F.lit(r")(?![\p{L}\p{N}])"))).otherwise(ANY))


def _ipv6(v: Column) -> Column:
    """Eight groups without leading zeros."""
    groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
    left, right = groups(F.substring_index(v, "::", 1)), groups(F.substring_index(v, "::", -1))
    whole = F.when(v.contains("::"), F.concat(left, F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right)), right)).otherwise(left)
    return F.array_join(F.transform(whole, lambda g: F.lower(F.conv(g, 16, 16))), ":")


def entities(m: Column, names: Column) -> Column:
    """The entities of a match, as an array of strings kind:normal. A person has one for each word of the name."""

    def of(k: Column) -> Column:
        v = _value(k, m)
        numeric = k.isin("phone", "card", "ssn")
        plain = F.concat(k, F.lit(":"), F.when(numeric, F.concat(F.when((k == "phone") & m.startswith("+"), "+").otherwise(""), _digits(m))).when(k == "iban", F.regexp_replace(m, " ", "")).when(k.isin("secret", "key"), v).when(k == "ipv6", _ipv6(F.lower(v))).otherwise(F.lower(v)))
        words = F.transform(F.split(v, " "), lambda w: F.coalesce(F.try_element_at(names, F.lower(w)), F.concat(F.lit("surname:"), F.lower(w))))
        return F.when(k == "person", words).when((k == "card") & _is_number(m), F.array().cast("array<string>")).otherwise(F.array(plain))

    return let(kind_of(m), of)


def _nibbles(h: Column, i: Column, n: int = 2) -> Column:
    """A number from n hex digits of the hash for place i; later places start over with another offset."""
    return (F.conv(F.substr(h, (i * n) % (126 - n) + 1, F.lit(n)), 16, 10).cast("int") + F.floor(i / 32).cast("int") * 7)


def _numbers(h: Column, start, n: Column) -> Column:
    """n decimal digits from the hash."""
    return F.when(n <= 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (_nibbles(h, i + start) % 10).cast("string")), ""))


def _luhn(d: Column) -> Column:
    """The check digit to append to digits d."""
    n = F.length(d)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + let(F.substr(d, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return ((10 - total % 10) % 10).cast("string")


def _is_number(m: Column) -> Column:
    """Whether a match has the shape of a card and not its check digit: it is no entity and stays."""
    d = _digits(m)
    return m.rlike(rf"\A(?:{PATTERNS['card']})\z") & let(d, lambda d: _luhn(F.substr(d, F.lit(1), F.length(d) - 1)) != F.right(d, F.lit(1)))


def _like(v: Column, h: Column, letters: int = 26) -> Column:
    """A digit for each digit, a letter of the same case for each ASCII letter, other characters as they are."""

    def one(c: Column, i: Column) -> Column:
        r = _nibbles(h, i)
        return F.when(c.rlike("[0-9]"), (r % 10).cast("string")).when(c.rlike("[a-z]"), F.char(r % letters + 97)).when(c.rlike("[A-Z]"), F.char(r % letters + 65)).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(v, ""), lambda c: c != ""), one), "")


def _name(kind: Column, word: Column, h: Column, attempt: Column) -> Column:
    """A name of three syllables, and one more for each attempt, so that names do not run out (70^12 in the end)."""

    def syllables(consonants: str, vowels: str) -> Column:
        one = lambda k: F.concat(F.substr(F.lit(consonants), _nibbles(h, 2 * k, 4) % len(consonants) + 1, F.lit(1)), F.substr(F.lit(vowels), _nibbles(h, 2 * k + 1, 4) % len(vowels) + 1, F.lit(1)))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.least(attempt + 2, F.lit(11))), one), "")

    latin, cyrillic = syllables(_CONSONANTS, _VOWELS), syllables(_RU_CONSONANTS, _RU_VOWELS)
    ru = F.concat(cyrillic, F.when(kind == "surname", "нов").when(kind == "surname_f", "нова").when(kind == "given_f", "на").otherwise("н"))
    en = F.concat(latin, F.when(kind.startswith("surname"), "ner").when(kind == "given_f", "lia").when(kind == "given_m", "rd").otherwise("n"))
    return F.when(word.rlike("\\p{IsCyrillic}"), ru).otherwise(en)


def core(entity: Column, attempt: Column, key: str = "") -> Column:
    """The surrogate of an entity (kind:normal), in normal form."""
    kind, value = F.substring_index(entity, ":", 1), F.expr("NULL")
    value = F.substr(entity, F.length(kind) + 2)
    digest = F.sha2(F.concat(F.lit(f"{key}|"), entity, F.lit("|"), attempt.cast("string")).cast("binary"), 512)

    def of(h: Column) -> Column:
        n = F.length(value)
        local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
        tld = F.substring_index(domain, ".", -1)
        host = F.concat(_like(F.substring_index(domain, ".", 1), F.reverse(h)), F.lit(".example."), F.when(tld.isin("com", "org", "net"), tld).otherwise("org"))
        email = F.concat(_like(local, h), F.lit("@"), host)
        ip = F.concat_ws(".", F.lit("10"), *((_nibbles(h, F.lit(k)) % 256).cast("string") for k in range(3)))
        issuer = F.when(value.startswith("2"), F.concat(F.lit("2"), (_nibbles(h, F.lit(50)) % 4 + 3).cast("string"))).otherwise(F.substr(value, F.lit(1), F.lit(1)))
        ipv6 = F.concat_ws(":", F.lit("2001"), F.lit("db8"), *(F.lower(F.conv(F.substr(h, F.lit(4 * k + 1), F.lit(4)), 16, 16)) for k in range(6)))
        card = let(F.concat(issuer, _numbers(h, 0, n - 1 - F.length(issuer))), lambda d: F.concat(d, _luhn(d)))
        code = F.regexp_extract(value, _CODE, 0)
        phone = F.concat(code, (_nibbles(h, F.lit(50)) % 8 + 2).cast("string"), _numbers(h, 0, n - F.length(code) - 1))
        ssn = F.concat(F.lit("9"), _numbers(h, 0, n - 1))
        iban = F.concat(F.substr(value, F.lit(1), F.lit(2)), _like(F.substr(value, F.lit(3)), h))
        secret = F.when(value.rlike(r"\A[0-9a-fA-F]+\z"), _like(value, h, 6)).otherwise(_like(value, h))
        stays = F.regexp_extract(value, r"\A(AKIA|ASIA|ghp_|sk-|xox[bp]-)", 1)
        token = F.concat(stays, _like(F.substr(value, F.length(stays) + 1), h))
        out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "ipv6", ipv6).when(kind == "card", card).when(kind == "phone", phone)
        return out.when(kind == "ssn", ssn).when(kind == "iban", iban).when(kind == "secret", secret).when(kind == "key", token).otherwise(_name(kind, value, h, attempt))

    return let(digest, of)


def _poured(m: Column, digits: Column) -> Column:
    """The match with its digits replaced one by one."""
    return F.array_join(F.transform(F.filter(F.split(m, ""), lambda c: c != ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substr(digits, F.length(_digits(F.substr(m, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), "")


def _cased(word: Column, new: Column) -> Column:
    return F.when((F.length(word) > 1) & (word == F.upper(word)), F.upper(new)).otherwise(F.initcap(new))


def surrogate(m: Column, attempts: Column, names: Column, key: str = "") -> Column:
    """The match with its entities replaced; attempts: map of entities that need another attempt than 0.

    Each surrogate is drawn in one place, as the driver holds and ships a copy of core() for each.
    """

    draw = lambda e: core(e, F.coalesce(F.try_element_at(attempts, e), F.lit(0)), key)

    def of(k: Column, es: Column, drawn: Column) -> Column:
        v, new = _value(k, m), F.get(drawn, F.lit(0))
        head = F.substr(m, F.lit(1), F.length(m) - F.length(v))
        names = F.array_join(F.zip_with(F.split(v, " "), drawn, _cased), " ")
        out = F.when(F.size(es) == 0, m).when(k.isin("phone", "card", "ssn"), _poured(m, _digits(new))).when(k == "person", F.concat(head, names))
        spaced = F.array_join(F.transform(F.filter(F.split(m, ""), lambda c: c != ""), lambda c, i: F.when(c == " ", " ").otherwise(F.substr(new, F.length(F.regexp_replace(F.substr(m, F.lit(1), i + 1), " ", "")), F.lit(1)))), "")
        out = out.when(k == "iban", spaced).when(k == "secret", F.concat(head, new))
        return out.when((k == "ipv6") & (m == F.upper(m)), F.upper(new)).otherwise(new)

    return let(F.struct(kind_of(m).alias("k"), entities(m, names).alias("es")), lambda s: let(F.transform(s["es"], draw), lambda drawn: of(s["k"], s["es"], drawn)))


def _sealing(key: str) -> Column:
    return F.unhex(F.sha2(F.lit(f"{key}|at rest").cast("binary"), 256))


def _sealed(df: DataFrame, name: str, key: str, *columns: str) -> DataFrame:
    """Like saved(), with the text columns encrypted in the files."""
    kept = saved(df.withColumns({c: F.aes_encrypt(F.col(c).cast("binary"), _sealing(key)) for c in columns}), name)
    out = kept.withColumns({c: F.aes_decrypt(F.col(c), _sealing(key)).cast("string") for c in columns})
    out.saved_at = kept.saved_at
    return out


def assigned(found: DataFrame, key: str = "", files: int | None = None) -> DataFrame:
    """Entities that need an attempt above 0: entity, attempt.

    found: the different entities. Of entities of one kind with one surrogate the smallest keeps it; the others, and
    entities whose surrogate is itself an entity of the texts, draw again until no two meet. What is written between the
    rounds is encrypted, in at most so many files, and removed when the next is written.
    """
    group = F.substring_index("entity", ":", 1)
    kept = lambda df: _sealed(df.coalesce(files) if files else df, "entities", key, "entity")
    state = kept(found.withColumn("attempt", F.lit(0)).withColumn("core", core(F.col("entity"), F.lit(0), key)))
    least, stalled = None, 0
    while True:
        owner = state.groupBy(group.alias("g"), "core").agg(F.min("entity").alias("owner"), F.count("*").alias("n")).where("n > 1").select("core", "g", "owner")
        same = state.withColumn("g", group).join(owner, ["core", "g"]).where("entity <> owner").select("entity")
        real = state.select(F.concat(group, F.lit(":"), F.lower("core")).alias("e")).distinct()
        real = real.join(state.select(F.lower("entity").alias("e")).distinct(), "e", "left_semi")
        taken = state.join(real, F.concat(group, F.lit(":"), F.lower("core")) == F.col("e"), "left_semi").select("entity")
        again = _sealed(same.union(taken).distinct(), "again", key, "entity")
        left = again.count()
        if not left:
            break
        least, stalled = (left, 0) if least is None or left < least else (least, stalled + 1)
        if stalled >= STALLED:
            raise RuntimeError(f"no form is free for {left} entities")
        more = state.join(again.withColumn("again", F.lit(1)), "entity", "left")
        more = more.withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0))).drop("again")
        more = kept(more.withColumn("core", F.when(F.col("attempt") > 0, core(F.col("entity"), F.col("attempt"), key)).otherwise(F.col("core"))))
        discard(state, again)
        state = more
    out = _sealed(state.where("attempt > 0").select("entity", "attempt"), "attempts", key, "entity")
    discard(state, again)
    return out


def key_of(spark: SparkSession) -> str:
    """The session's key."""
    key = spark.conf.get(KEY, None)
    if not key:
        spark.conf.set(KEY, key := secrets.token_hex(16))
    return key


def replace_pii(docs: DataFrame, key: str | None = None) -> DataFrame:
    """The rows with surrogates in text and n_entities added; every row and other column stays, n_chars is renewed.

    Texts without entities are unchanged; null stays null, with 0 entities. Repeated texts get the same replacements.
    Whole texts are searched. A column that is called n_entities is replaced. key: by default that of the session, so
    the same key gives the same surrogates. Rows without a match go straight through; of the others a copy with
    encrypted texts and their entities are kept in the shared folder until the driver ends, and only they meet the
    attempts. Few attempts are sent to the texts, which then stay where they were read; many are joined by a shuffle.
    """
    key = key_of(docs.sparkSession) if key is None else key
    others = [c for c in docs.columns if c not in ("text", "n_entities")]
    matched = F.coalesce(F.col("text").rlike(ANY), F.lit(False))
    clean = docs.where(~matched).select(*docs.drop("n_entities").columns, F.lit(0).cast("long").alias("n_entities"))

    hits = docs.where(matched).select(F.struct(F.lit(0), *others).alias("row"), F.col("text").alias("t"))
    hits = _sealed(hits, "pii", key, "t").withColumn("m", F.regexp_extract_all("t", F.lit(ANY), F.lit(0)))
    hits = hits.select("row", "t", names_of(F.col("m")).alias("names"), mentions(F.col("m")).alias("p"))
    hits = hits.withColumn("m", F.when(F.size("names") > 0, F.regexp_extract_all("t", "p", F.lit(0))).otherwise(F.regexp_extract_all("t", F.lit(ANY), F.lit(0))))
    hits = hits.withColumn("k", F.xxhash64("t").cast("string"))

    every = _sealed(hits.select("k", F.explode(F.array_distinct(F.flatten(F.transform("m", lambda m: entities(m, F.col("names")))))).alias("entity")), "pii-entities", key, "k", "entity")
    odd = assigned(every.select("entity").distinct(), key, -(-every.count() // FILE_ROWS) or 1)
    met = every.join(odd, "entity")
    attempts = met.groupBy("k").agg(F.map_from_entries(F.collect_set(F.struct("entity", "attempt"))).alias("a"))
    few = met.distinct().count() <= SENT
    hits = hits.join(F.broadcast(attempts) if few else attempts, "k", "left")
    gaps = F.when(F.size("names") > 0, F.split("t", F.col("p"), -1)).otherwise(F.split("t", ANY, -1))
    news = F.transform("m", lambda m: surrogate(m, F.col("a"), F.col("names"), key))
    text = F.concat(F.array_join(F.zip_with(F.slice(gaps, 1, F.size("m")), news, lambda g, n: F.concat(g, n)), ""), F.element_at(gaps, -1))
    done = hits.select("row", text.alias("t"), F.size(F.filter("m", lambda m: ~_is_number(m))).cast("long").alias("n"))

    def column(c: str) -> Column:
        kind = docs.schema[c].dataType
        return (F.col("t") if c == "text" else F.length("t") if c == "n_chars" else F.col("row")[c]).cast(kind).alias(c)

    return clean.unionByName(done.select(*(column(c) for c in docs.columns if c != "n_entities"), F.col("n").alias("n_entities")))


def op7_surrogate_pii(spark, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
