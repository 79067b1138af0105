import hashlib
import hmac
import re

from pyspark.sql import functions as F

from vantage.llm import surrogates as s


def run(spark, texts, **options):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_entities string")
    return {r.doc_id: r for r in s.replace(docs, **options).collect()}


def test_formats_and_coreference(spark):
    got = run(spark, [
        "Mail JOHN.smith@Mail7.example.com or john.smith@mail7.example.com now",
        "call +1 (017) 555-7713 or +1 (017) 555 7713.",
        "ip 97.51.17.173, card 4111 1111 1111 1111 and 9807915762804490.",
        "Mr. John Smith met Mrs Anna Smith and Mr Smith; г-жа Анна Иванова",
        "DE89 3704 0044 0532 0130 00 ssn 123-45-6789",
        "nothing: 2024-01-02, 12 1234567, v1.2.3, 20k, a@b, 1.2.3",
        None, "", "card 4111-1111-1111-1111",
    ])
    mail = re.fullmatch(r"Mail ([A-Z]{4}\.[a-z]{5}@[A-Z][a-z]{3}\d\.[a-z]{7}\.com) or (\S+) now", got[0].text)
    assert mail and mail[1].lower() == mail[2] and "smith" not in mail[2]
    phone = re.fullmatch(r"call \+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1 \((\d{3})\) (\d{3}) (\d{4})\.", got[1].text)
    assert phone and phone.groups()[:3] == phone.groups()[3:] != ("017", "555", "7713")
    ip, card, plain = re.fullmatch(r"ip (\d\d\.\d\d\.\d\d\.\d{3}), card (\d{4} \d{4} \d{4} \d{4}) and (\d{16})\.", got[2].text).groups()
    assert all(int(o) < 256 for o in ip.split(".")) and ip != "97.51.17.173" and plain != "9807915762804490"
    digits = [int(c) for c in card if c != " "][::-1]
    assert (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0
    assert got[8].text == "card " + card.replace(" ", "-")
    male, family, female, family2, family3, f, g = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs (\w+) (\w+) and Mr (\w+); г-жа (\w+) (\w+)", got[3].text).groups()
    assert family == family2 == family3 != "Smith" and male != "John" and female.endswith("a") and f[-1] in "ая"
    assert all("а" <= c.lower() <= "я" for c in f + g)
    assert re.fullmatch(r"[A-Z]{2}\d\d \d{4} \d{4} \d{4} \d{4} \d\d ssn \d{3}-\d\d-\d{4}", got[4].text) and "3704" not in got[4].text
    assert got[5].text.startswith("nothing: 2024-01-02, 12 1234567, v1.2.3, 20k, a@b") and got[5].n_entities == 0
    assert got[6].text is None and got[7].text == "" and [got[i].n_entities for i in range(9)] == [2, 2, 3, 4, 2, 0, 0, 0, 1]


def test_keys_differ(spark):
    text = ["ask jane.doe@example.org"]
    assert run(spark, text, key="a")[0].text == run(spark, text, key="a")[0].text != run(spark, text, key="b")[0].text


def test_collisions_are_resolved(spark):
    """Dense formats: many short addresses in one domain, and two-digit octets."""
    mails = [f"{a}{b}@example.com" for a in "abcdefghij" for b in "0123456789"]
    ips = [f"1.1.1.{i}" for i in range(5)]
    got = run(spark, [f"to {m} end" for m in mails] + [f"at {i} end" for i in ips])
    new = [re.fullmatch(r"\w+ (\S+) end", got[i].text)[1] for i in range(len(mails) + len(ips))]
    assert len(set(new)) == len(new)
    assert not any(a == b for a, b in zip(new, mails + ips)) and not set(new[: len(mails)]) & set(mails)


def test_odd_rows(spark, odd, empty):
    frame, rows = odd
    got = s.replace(frame)
    assert set(got.columns) == set(frame.columns)
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(map(key, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(key, rows))
    assert s.replace(empty).count() == 0


def test_hot_entity_and_repeated_rows(spark):
    docs = spark.createDataFrame([(i // 2, "from the same.person@example.com again") for i in range(400)], "doc_id long, text string")
    got = {r.text for r in s.replace(docs).collect()}
    assert len(got) == 1 and "same.person" not in got.pop()


def test_two_digit_groups_other_cards_and_ipv6(spark):
    phones = ["+33 1 23 45 67 89", "+33 6 12 34 56 78", "+34 612 34 56 78", "+34612345678", "+49 30 1234 5678 90", "+33.6.12.34.56.78"]
    got = run(spark, [*(f"call {p}, now" for p in phones), "card 3782 822463 10005 or 3782-822463-10005", "at 2001:db8::8a2e:370:7334 or 2001:0DB8:0:0:0:8a2e:0370:7334.", "12:34:56 std::vector a::b aa:bb:cc:dd:ee:01 +12 34"])
    for i, p in enumerate(phones):
        assert got[i].n_entities == 1 and re.sub(r"\d", "0", got[i].text) == re.sub(r"\d", "0", f"call {p}, now") and p[4:] not in got[i].text, got[i].text
    a, b = re.fullmatch(r"card (\d{4} \d{6} \d{5}) or (\d{4}-\d{6}-\d{5})", got[6].text).groups()
    assert a.replace(" ", "-") == b != "3782-822463-10005"
    a, b = re.fullmatch(r"at ((?:[0-9a-f]{4}:){7}[0-9a-f]{4}) or (\S+)\.", got[7].text).groups()
    assert a == b and "8a2e" not in a
    assert got[8].n_entities == 0


def iban_ok(x):
    x = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def test_titles_do_not_part_an_entity_and_tell_the_gender(spark):
    got = run(spark, ["Mr John Smith", "Dr John Smith", "JOHN: Mr JOHN SMITH", "Mrs Anna Smith and Prof Anna Smith", "Dr Kim Lee", "Mr Robin Lee and Ms Robin Lee", "Mr Robin Lee"], key="k")
    names = [re.findall(r"(?:Mrs?|Ms|Dr|Prof) (\w+) (\w+)", got[i].text) for i in range(7)]
    assert names[0] == names[1] and [tuple(x.lower() for x in n) for n in names[2]] == [tuple(x.lower() for x in n) for n in names[0]]
    assert names[3][0] == names[3][1] and names[3][0][1] == names[0][0][1]
    assert names[0][0][0].endswith(tuple(s.ENDINGS["latin"]["m"])) and names[3][0][0].endswith(tuple(s.ENDINGS["latin"]["f"]))
    assert names[4][0][0].endswith(tuple(s.ENDINGS["latin"]["n"])) and len(set(names[5] + names[6])) == 1 and names[5][0][0].endswith(tuple(s.ENDINGS["latin"]["m"]))


def test_names_keep_their_script(spark):
    got = run(spark, ["Mr Արամ Խաչատրյան said", "Dr Νίκος Παππάς said", "Mr Ⲁⲃⲅⲇ Ⲇⲉⲍ said"], key="k")
    for i, letters in enumerate((r"[\u0530-\u058f]+", r"[\u0370-\u03ff]+", r"[\u2c80-\u2cff]+")):
        given, family = re.fullmatch(rf"\w+ ({letters}) ({letters}) said", got[i].text).groups()
        assert given[0].isupper() and family[0].isupper() and given not in ("Արամ", "Νίκος") and family not in ("Խաչատրյան", "Παππάς")


def test_valid_ibans_stay_valid_and_keep_their_country(spark):
    real = ["DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "FR1420041010050500013M02606"]
    got = run(spark, [*(f"pay {x} now" for x in real), "pay DE00 3704 0044 0532 0130 00 now"], key="k")
    for i, x in enumerate(real):
        new = got[i].text.removeprefix("pay ").removesuffix(" now")
        assert iban_ok(x) and iban_ok(new) and new[:2] == x[:2] and new != x and re.sub(r"\d", "0", re.sub("[A-Z]", "A", new)) == re.sub(r"\d", "0", re.sub("[A-Z]", "A", x))
    assert not iban_ok(got[3].text.removeprefix("pay ").removesuffix(" now"))


def test_the_draw_is_an_hmac(spark):
    for key in ("k", "long key " * 30):
        got = spark.range(1).select(s._hmac(key, F.lit("mésßage"))).first()[0]
        assert got == hmac.new(key.encode(), "mésßage".encode(), hashlib.sha512).hexdigest()


def test_distinctness_and_coreference_over_a_table(spark):
    """Every entity has one surrogate wherever it stands, different ones have different ones, and the text around them stays."""
    import random

    rng = random.Random(5)
    mails = [f"u{i}.{rng.choice('abc')}@host{i % 7}.example.org" for i in range(60)]
    phones = [f"+1 (0{rng.randrange(10, 99)}) 555-{i:04d}" for i in range(60)]
    people = [f"{rng.choice(['Mr', 'Dr'])} {rng.choice('ABCDEF')}{rng.choice('aeiou')}n{rng.choice('aeiou')} {rng.choice('KLMNOP')}{rng.choice('aeiou')}ss{rng.choice('aeiou')}" for _ in range(60)]
    pools = mails + phones + people
    docs = [[rng.choice(pools) for _ in range(rng.randrange(1, 6))] for _ in range(300)]
    got = run(spark, [" | ".join(f"at {e} end" for e in d) for d in docs], key="k")
    bare = lambda x: re.sub(r"^(Mr|Dr) ", "", x)
    seen = {}
    for i, d in enumerate(docs):
        new = [p.removeprefix("at ").removesuffix(" end") for p in got[i].text.split(" | ")]
        assert len(new) == len(d) and got[i].n_entities == len(d)
        for a, b in zip(d, new, strict=True):
            assert a != b and seen.setdefault(bare(a), bare(b)) == bare(b)
    assert len(set(seen.values())) == len(seen)
