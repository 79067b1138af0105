"""Surrogates for personal data, in DataFrame operations only.

Detected entities are replaced by keyed, type-consistent ones: digits by digits and letters by letters in the format of the
mention, numbers with a Luhn check digit by others with one, valid IBANs by valid ones of the country, names by names of the
same script. A surrogate is drawn by an HMAC of the entity's canonical form under the caller's key; neither a mention's title
nor its spelling has a part in it, so all mentions of an entity get the same one (coreference). The ending of a given name
shows the gender that its titles have in most documents. A check over the distinct entities of the corpus finds
surrogates that two entities share, or that are entities themselves; all but one of the entities concerned are drawn again
with a counter, until different entities have different surrogates everywhere.
"""

from __future__ import annotations

import hashlib
import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm.common import cut, join_small, table

#: The session's setting that holds the key, and a key that protects nobody, for tests and checks.
KEY_SETTING, OPEN_KEY = "spark.vantage.surrogateKey", "vantage open key"
MALE, FEMALE, EITHER = "Mr|Herr|Herrn|Sr|Señor|Monsieur|Don|г-н", "Mrs|Ms|Miss|Mme|Mlle|Madame|Frau|Sra|Srta|Señora|Señorita|Doña|г-жа", "Dr|Prof"
PERSON = rf"(?=[MHSDPFг])(?<![\p{{L}}\p{{N}}])(?:{MALE}|{FEMALE}|{EITHER})\b\.?[ \t]+\p{{Lu}}[\p{{L}}'’-]++(?:[ \t]+\p{{Lu}}[\p{{L}}'’-]++){{0,2}}"
PATTERNS = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("card", r"(?<![A-Za-z0-9])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![A-Za-z0-9])"),
    ("card", r"(?<![A-Za-z0-9])[0-9]{4}(?: [0-9]{6} |-[0-9]{6}-)[0-9]{5}(?![A-Za-z0-9])"),
    ("ip6", r"(?<![A-Za-z0-9:.])(?=[A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=(?:[0-9A-Fa-f]*:){2,7}[0-9A-Fa-f]*(?![A-Za-z0-9:]))(?:[0-9A-Fa-f]{1,4}:)+(?::[0-9A-Fa-f]{1,4})+)(?![A-Za-z0-9:])"),
    ("ip", r"(?<![A-Za-z0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![A-Za-z0-9]|\.[0-9])"),
    ("ssn", r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])"),
    ("phone", r"(?<![A-Za-z0-9+])\+(?!1[ .(-])(?=(?:[ .()-]{0,2}[0-9]){7,15}(?![ .()-]{0,2}[0-9])(?![A-Za-z]))[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,6}(?![A-Za-z0-9])"),
    ("phone", r"(?<![A-Za-z0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![A-Za-z0-9])"),
    ("phone", r"(?<![A-Za-z0-9+])(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{4}(?![A-Za-z0-9])"),
    ("person", PERSON),
]
#: Any entity; no other white space or bracket is taken in.
ENTITY = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: What a text with an entity holds; only such texts are searched for entities.
HINT = f"[0-9@]|{PERSON}"
#: Rounds in which a surrogate may not be an entity of the corpus either, and in which it has the entity's length.
APART, SAME_LENGTH = 16, 48
#: Syllables and endings that names are made of, by script.
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe fi ga ge go ha he jo ka ke ki la le li lo ma me mi mo na ne ni no".split(),
    "cyrillic": "ба бе би бо ва ве ви во га ге да де ди до за зе ка ко ла ле ли ло ма ме ми мо на не ни но ра ре".split(),
    "greek": "βα βε βι βο γα γε γι δα δε δι δο ζα ζε θα θε κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο πα".split(),
    "armenian": "բա բե բի բո գա գե գի դա դե դի զա զե թա թե կա կե կի լա լե լի հա հե մա մե մի նա նե նի սա սե վա տա".split(),
}
ENDINGS = {
    "latin": {"m": "rd rt ns lf".split(), "f": "na ra lia nda".split(), "n": "ry ley rin sse".split(), "family": "mann sen ton vic".split()},
    "cyrillic": {"m": "рд рт нс льф".split(), "f": "на ра лия нда".split(), "n": "ри лей рин сса".split(), "family": "нко вич рук тин".split()},
    "greek": {"m": "ρος λος νας μων".split(), "f": "να ρα λια νθη".split(), "n": "ρι λι νι σι".split(), "family": "ιδης πουλος ακης ου".split()},
    "armenian": {"m": "մեն գեն վակ րամ".split(), "f": "նե ուհի իկ լիա".split(), "n": "րի լի սի նի".split(), "family": "յան ունի ենց ույան".split()},
}


def _let(value: Column, f) -> Column:
    """f(value), with the value computed once however often f uses it; a lambda's body else computes it for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _byte(digest: Column, i: Column) -> Column:
    """The i-th byte, from 0, of a hex digest of 64 bytes, around and around."""
    return F.conv(digest.substr((i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _luhn_rest(digits: Column) -> Column:
    """The Luhn sum of a digit string modulo 10."""

    def add(acc: Column, i: Column) -> Column:
        d = digits.substr(F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10


def _mod97(characters: Column) -> Column:
    """The number that digits and letters (A is 10) spell, modulo 97."""
    add = lambda acc, c: F.when(c.rlike("[0-9]"), acc * 10 + c.cast("int")).otherwise(acc * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(_chars(characters), F.lit(0), add)


def _hmac(key: str, message: Column) -> Column:
    """HMAC-SHA-512 in hex."""
    raw = key.encode()
    raw = (hashlib.sha512(raw).digest() if len(raw) > 128 else raw).ljust(128, b"\0")
    inner, outer = (F.lit(bytearray(c ^ pad for c in raw)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 512))), 512)


def surrogate(kind: Column, canon: Column, counter: Column, gender: Column, key: str) -> Column:
    """The surrogate of a part's canonical form; its characters stand for those of canon. gender: m, f or n, of given names."""
    digest = _hmac(key, F.concat_ws("\x1f", kind, canon, counter.cast("string")))
    return _let(digest, lambda d: _surrogate(kind, canon, counter, gender, d))


def _surrogate(kind: Column, canon: Column, counter: Column, gender: Column, digest: Column) -> Column:
    def character(c: Column, i: Column) -> Column:
        b = _byte(digest, i)
        first = (i == 0) & (c != "0")
        digit = F.when(first, 1 + b % 9).otherwise(b % 10).cast("string")
        return F.when(c.rlike("[0-9]"), digit).when(c.rlike("[a-z]"), F.char((97 + b % 26).cast("int"))).when(c.rlike("[A-Z]"), F.char((65 + b % 26).cast("int"))).otherwise(c)

    alike = F.array_join(F.transform(_chars(canon), character), "")
    octet = lambda o, i: F.when(F.length(o) == 1, _byte(digest, i) % 10).when(F.length(o) == 2, 10 + _byte(digest, i) % 90).otherwise(100 + _byte(digest, i) % 156).cast("string")
    ip = F.array_join(F.transform(F.split(canon, r"\."), octet), ".")

    hex_ = F.array_join(F.transform(_chars(canon), lambda c, i: F.lower(F.hex(_byte(digest, i) % 16))), "")

    def checked(digits: Column) -> Column:
        """The digits with the last one set so that the sum is 0 modulo 10."""
        head = digits.substr(F.lit(1), F.length(digits) - 1)
        return F.concat(head, ((10 - _luhn_rest(F.concat(head, F.lit("0")))) % 10).cast("string"))

    card = _let(alike, lambda digits: F.when(_luhn_rest(canon) == 0, _let(digits, checked)).otherwise(digits))
    longer = F.when(counter < SAME_LENGTH, F.lit("")).otherwise(F.concat(F.array_join(F.transform(F.sequence(F.lit(40), F.lit(49)), lambda i: (_byte(digest, i) % 10).cast("string")), "")))

    def bank(own: Column) -> Column:
        country, account = canon.substr(F.lit(1), F.lit(2)), own.substr(F.lit(5), F.length(own))
        check = F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
        valid = _mod97(F.concat(canon.substr(F.lit(5), F.length(canon)), canon.substr(F.lit(1), F.lit(4)))) == 1
        return F.concat(country, F.when(valid, check).otherwise(own.substr(F.lit(3), F.lit(2))), account)

    def name(script: str) -> Column:
        pool = F.array(*map(F.lit, SYLLABLES[script]))
        stem = F.array_join(F.transform(F.sequence(F.lit(0), F.least(2 + counter, F.lit(12))), lambda i: F.element_at(pool, _byte(digest, i) % len(SYLLABLES[script]) + 1)), "")
        end = lambda k: F.element_at(F.array(*map(F.lit, ENDINGS[script][k])), _byte(digest, F.lit(63)) % 4 + 1)
        return F.concat(stem, F.when(kind.startswith("family"), end("family")).when(gender == "m", end("m")).when(gender == "f", end("f")).otherwise(end("n")))

    # scripts without syllables of their own: letters of the name itself, dealt anew, more of them after a collision
    letters = _chars(canon)
    anew = F.array_join(F.transform(F.sequence(F.lit(1), F.size(letters) + counter), lambda i: F.element_at(letters, _byte(digest, i) % F.size(letters) + 1)), "")
    named = reduce(lambda other, script: F.when(kind.endswith(script), name(script)).otherwise(other), SYLLABLES, anew)
    return F.when(kind.rlike("^(given|family)"), named).when(kind == "ip", F.concat(ip, longer)).when(kind == "ip6", hex_).when(kind == "card", F.concat(card, longer)).when(kind == "iban", F.concat(_let(alike, bank), longer)).otherwise(F.concat(alike, longer))


def _fill(form: Column, filler: Column, class_: str) -> Column:
    """form with its characters of the class replaced, in order, by the filler's; upper case where form has it. What the filler
    has left over follows."""
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("n"))

    def filled(plain: Column) -> Column:
        def put(acc: Column, c: Column) -> Column:
            own = plain.substr(acc.n + 1, F.lit(1))
            hit = c.rlike(class_)
            new = F.when(~hit, c).when(c.rlike("[A-Z]"), F.upper(own)).otherwise(own)
            return F.struct(F.concat(acc.s, new).alias("s"), (acc.n + F.when(hit, 1).otherwise(0)).alias("n"))

        return F.aggregate(_chars(form), start, put, lambda acc: F.concat(acc.s, plain.substr(acc.n + 1, F.length(plain))))

    return _let(F.regexp_replace(filler, F.lit("[^A-Za-z0-9]"), F.lit("")), filled)


def entity_type(e: Column) -> Column:
    """The first pattern, in the order of PATTERNS, that the whole entity matches; lookarounds pass at its ends."""
    return reduce(lambda other, p: F.when(e.rlike(f"^(?:{p[1]})$"), F.lit(p[0])).otherwise(other), reversed(PATTERNS[:-1]), F.lit("person"))


def parts(e: Column) -> Column:
    """array of (kind, canon, form, before, gender): the parts of an entity that are replaced, with the literal text before each, and
    what its title says of a given name's gender (m, f or n)."""
    return _let(entity_type(e), lambda t: _parts(e, t))


def _parts(e: Column, t: Column) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    part = lambda kind, canon, form, before="", gender="n": F.struct(text(kind).alias("kind"), canon.alias("canon"), form.alias("form"), text(before).alias("before"), text(gender).alias("gender"))
    only = lambda s, c: F.regexp_replace(s, F.lit(f"[^{c}]"), F.lit(""))
    local, domain = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    top = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    label = domain.substr(F.lit(1), F.length(domain) - F.length(top))
    email = F.array(part("email_local", only(F.lower(local), "a-z0-9"), local), part("email_domain", only(F.lower(label), "a-z0-9"), label, "@"), part("keep", top, top))
    prefix = F.regexp_extract(e, r"^(\+[0-9]{1,3}[ .-]|\+[0-9](?=[0-9]))", 1)
    number = e.substr(F.length(prefix) + 1, F.length(e))
    phone = F.array(part("phone", only(number, "0-9"), number, prefix))
    title = F.regexp_extract(e, r"^([^ \t]+[ \t]+)", 1)
    gender = F.when(title.rlike(f"^(?:{MALE})\\b"), "m").when(title.rlike(f"^(?:{FEMALE})\\b"), "f").otherwise("n")
    names = F.split(e.substr(F.length(title) + 1, F.length(e)), r"[ \t]+")
    script = lambda w: reduce(lambda other, k: F.when(w.rlike(f"^\\p{{Is{k.capitalize()}}}"), F.lit(k)).otherwise(other), SYLLABLES, F.lit("own"))
    given = lambda i: i < F.size(names) - 1
    person = F.transform(names, lambda w, i: part(F.concat(F.when(given(i), "given_").otherwise("family_"), script(w)), F.lower(w), w, F.when(i == 0, title).otherwise(F.lit(" ")), F.when(given(i), gender).otherwise("n")))
    digits = F.array(part(t, only(e, "0-9"), e))
    groups = lambda s: F.filter(F.split(s, ":"), lambda g: g != "")
    head, tail = groups(F.substring_index(e, "::", 1)), F.when(e.contains("::"), groups(F.substring_index(e, "::", -1))).otherwise(F.array().cast("array<string>"))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(head) - F.size(tail)))
    ip6 = F.array(part("ip6", F.array_join(F.transform(F.concat(head, zeros, tail), lambda g: F.lpad(F.lower(g), 4, "0")), ""), e))
    return F.when(t == "email", email).when(t == "phone", phone).when(t == "iban", F.array(part("iban", only(e, "A-Z0-9"), e))).when(t == "ip", F.array(part("ip", e, e))).when(t == "ip6", ip6).when(t == "person", person).otherwise(digits)


def write_part(p: Column, counter: Column, gender: Column, key: str) -> Column:
    def written(s: Column) -> Column:
        named = F.when(p.form == F.upper(p.form), F.upper(s)).otherwise(F.initcap(s))
        whole = F.regexp_replace(s, "(.{4})(?=.)", "$1:")
        return F.when(p.kind.rlike("^(given|family)"), named).when(p.kind == "ip6", whole).when(p.kind.startswith("email") | (p.kind == "iban"), _fill(p.form, s, "[A-Za-z0-9]")).otherwise(_fill(p.form, s, "[0-9]"))

    return F.concat(p.before, F.when(p.kind == "keep", p.form).otherwise(_let(surrogate(p.kind, p.canon, counter, gender, key), written)))


def collisions(entities: DataFrame, key: str) -> DataFrame:
    """entities: (kind, canon, gender), distinct by kind and canon. Returns (kind, canon, counter) of those whose counter is not 0."""
    entities = cut(entities)
    open_, taken, out = entities, None, None
    for counter in range(1 << 20):
        tried = open_.withColumn("s", surrogate(F.col("kind"), F.col("canon"), F.lit(counter), F.col("gender"), key))
        others = entities.select("kind", F.col("canon").alias("s"))
        free = tried.join(others, ["kind", "s"], "left_anti") if counter < APART else tried.where("s <> canon")
        free = free if taken is None else free.join(taken, ["kind", "s"], "left_anti")
        won = cut(free.groupBy("kind", "s").agg(F.min("canon").alias("canon")))
        taken = won.select("kind", "s") if taken is None else cut(taken.union(won.select("kind", "s")))
        if counter:
            again = won.select("kind", "canon", F.lit(counter).alias("counter"))
            out = again if out is None else out.union(again)
        open_ = cut(open_.join(won, ["kind", "canon"], "left_anti").select("kind", "canon", "gender"))
        if not open_.count():
            break
    return entities.select("kind", "canon", F.lit(0).alias("counter")).where("false") if out is None else out


def replace(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", key: str | None = None) -> DataFrame:
    """docs with text's entities replaced, and n_entities. key: as given, or as the session's KEY_SETTING has it; else a fresh one
    that is not kept, so that surrogates of different runs cannot be related.

    Null text stays null and has no entities. Repeated rows are treated alike. An existing column n_entities is replaced.
    A surrogate never equals another entity's surrogate of its kind; where a format has no free value left, it gets longer.
    Texts are read twice, once to collect the entities and once to replace them: keeping each text beside its spans in
    between would write the whole corpus.
    """
    key = key or docs.sparkSession.conf.get(KEY_SETTING, None) or secrets.token_hex(32)
    kept = [c for c in docs.columns if c != "n_entities"]
    found = F.when(F.col(text).rlike(HINT), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    mentions = cut(docs.select(F.col(doc_id).alias("__vantage_id"), F.xxhash64(text).alias("__vantage_h"), found.alias("e")).where("size(e) > 0"))
    each = F.flatten(F.transform("e", lambda e: F.transform(parts(e), lambda p: F.struct(p.kind, p.canon, p.gender))))
    used = mentions.select("__vantage_id", "__vantage_h", F.explode(F.array_distinct(each)).alias("p")).select("__vantage_id", "__vantage_h", F.col("p.kind").alias("kind"), F.col("p.canon").alias("canon"), F.col("p.gender").alias("gender")).where("kind <> 'keep'")
    titles = lambda g: F.sum(F.when(F.col("gender") == g, 1).otherwise(0))
    gender = F.when(F.col("m") > F.col("f"), "m").when(F.col("f") > F.col("m"), "f").otherwise("n")
    entities = cut(used.groupBy("kind", "canon").agg(titles("m").alias("m"), titles("f").alias("f")).select("kind", "canon", gender.alias("gender")))
    told = entities.join(collisions(entities, key), ["kind", "canon"], "left").select("kind", "canon", F.coalesce("counter", F.lit(0)).alias("counter"), "gender")
    told = cut(told.where("counter > 0 OR gender <> 'n'"))
    # only the rows that mention an entity with a counter or a gender need to know it
    named = join_small(used.select("__vantage_id", "__vantage_h", "kind", "canon"), told, ["kind", "canon"])
    named = named.groupBy("__vantage_id", "__vantage_h").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\x1f", "kind", "canon"), F.struct("counter", "gender")))).alias("__vantage_told"))
    rows = docs.select(*kept, F.xxhash64(text).alias("__vantage_hash"), found.alias("__vantage_found"))
    named = cut(named)
    rows = join_small(rows, named, rows[doc_id].eqNullSafe(F.col("__vantage_id")) & (rows["__vantage_hash"] == F.col("__vantage_h")), "left")
    about = lambda p: F.element_at("__vantage_told", F.concat_ws("\x1f", p.kind, p.canon))
    write = lambda p: _let(about(p), lambda t: write_part(p, F.coalesce(t.counter, F.lit(0)), F.coalesce(t.gender, F.lit("n")), key))
    new = F.transform("__vantage_found", lambda e: F.array_join(F.transform(parts(e), write), ""))
    gaps = F.split(F.col(text), ENTITY, -1)
    whole = F.concat(F.array_join(F.zip_with(new, F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))), lambda s, g: F.concat(g, s)), ""), F.element_at(gaps, -1))
    replaced = F.when(F.size("__vantage_found") == 0, F.col(text)).otherwise(whole)
    return rows.select(*[(replaced.alias(c) if c == text else rows[c]) for c in kept], F.size("__vantage_found").cast("long").alias("n_entities"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace(docs, key=spark.conf.get(KEY_SETTING, None) or OPEN_KEY)
