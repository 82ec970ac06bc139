import pytest

from granary.llm import personal_data as pd_

LIST = [(g, "given") for g in ("Emil", "Alba", "Hugo")] + [(a + b, "family") for a in ("Brevo", "Corrun", "Vasku", "Zamir") for b in ("drup", "lane", "moor", "nick")]
NAMES = pd_.Names(LIST)


def found(text):
    return [(k, text[s:e]) for k, s, e, *_ in pd_.mentions(text, NAMES)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Write to <emil.brevolane+hr@docks.example> now", [("email", "emil.brevolane+hr@docks.example")]),
        ("at hugo[at]freight[dot]example[dot]net, or a.b (at) x (dot) org", [("email", "hugo[at]freight[dot]example[dot]net"), ("email", "a.b (at) x (dot) org")]),
        ("Install combiner@16.1.2, see watch@relay-77:~ and @dock", []),
        ("call 01632 960 807, tel:+1 555 555 0168 or (030) 23125-245.", [("phone", "01632 960 807"), ("phone", "+1 555 555 0168"), ("phone", "(030) 23125-245")]),
        ("appeler le 01.99.00.09.31 ou 0034 555003202", [("phone", "01.99.00.09.31"), ("phone", "0034 555003202")]),
        ("Counter went from 0049 933947 to 0050 815012; lot 01-303-264; Batch 912-530-55; Waybill 2031-09-4471-88", []),
        ("serial WP4475412 at 10:45, drawing 555-42", []),
        ("social security number 931-30-6663, Passport no. PX9158040, DNI 99342780-R", [("id_number", "931-30-6663"), ("id_number", "PX9158040"), ("id_number", "99342780-R")]),
        ("Steuer-ID: 062 579 55273; sécurité sociale : 9 82 58 99 267 783 68", [("id_number", "062 579 55273"), ("id_number", "9 82 58 99 267 783 68")]),
        ("lives at 7B Ferry St., Dunmarsh, ZQ 00816 by", [("address", "7B Ferry St., Dunmarsh, ZQ 00816")]),
        ("wohnt in Lindenstraße 83 b, 02258 Altwerda und Am Speicher 71", [("address", "Lindenstraße 83 b, 02258 Altwerda"), ("address", "Am Speicher 71")]),
        ("habite 3 bis, rue des Voiles et vive en C/ Olmo Viejo, 155", [("address", "3 bis, rue des Voiles"), ("address", "C/ Olmo Viejo, 155")]),
        ("cuesta unos 6,779 créditos; Route 14 crosses; Gang 8", []),
        ("hi, kofi vaskudrup here; Dr. ZAMIRNICK, Emil; Ms Alba B. Corrunmoor-Brevonick", [("person", "kofi vaskudrup"), ("person", "ZAMIRNICK, Emil"), ("person", "Alba B. Corrunmoor-Brevonick")]),
        ("The tug Emil Brevolane left. The Brevolane sled and the Alba clamp. Der Schlepper Hugo Zamirmoor fuhr", []),
        ("Regards,\nH. Brevomoor\nM. Corrundrup, Alba signed; Outer Quay. Vaskulane, Hugo", [("person", "H. Brevomoor"), ("person", "Corrundrup, Alba"), ("person", "Vaskulane, Hugo")]),
        ("", []), ("İİİ Emil Brevolane", [("person", "Emil Brevolane")]),
    ],
)
def test_mentions(text, want):
    assert found(text) == want


def frames(spark):
    docs = spark.createDataFrame(
        [(1, "Emil Brevolane, emil@docks.example, met BREVOLANE, Emil and Alba Brevolane.", "a"), (2, None, "b"), (3, "", "c"), (4, "nothing here", "d"), (None, "Hugo Zamirnick", "e"), (5, "x" * 300_000 + " Hugo Zamirnick", "f")],
        "doc_id long, text string, id string",
    )
    return docs, spark.createDataFrame([*LIST, (None, "given"), ("Emil", "given")], "name string, name_kind string")


def test_table(spark, rows_of):
    docs, names = frames(spark)
    assert [r for r in rows_of(pd_.found_mentions(docs, names).where("doc_id is not null"))] == [(1, "email", 16), (1, "person", 0), (1, "person", 40), (1, "person", 60), (5, "person", 300_001)]
    assert pd_.find(docs.limit(0), names).count() == 0
    assert pd_.find(docs, names.limit(0)).where("kind <> 'person'").count() == 1


@pytest.mark.parametrize("style", ["placeholder", "surrogate"])
def test_replacement_keeps_the_rest(spark, style):
    docs, names = frames(spark)
    out = {r.doc_id: r for r in pd_.replace(docs, names, "k", style=style).collect()}
    text = out[1].text
    assert out[1].replaced == 4 and "Brevolane" not in text and "BREVOLANE" not in text and " met " in text and " and " in text and text.endswith(".")
    assert "Zamirnick" not in out[None].text and pd_.replace(docs.unionByName(docs), names, "k", style=style).where("doc_id = 1").select("text").distinct().count() == 1
    assert pd_.replace(docs.unionByName(docs), names, "k", style=style).count() == 12
    assert out[2].text is None and out[3].text == "" and out[4].text == "nothing here" and len(out) == 6
    if style == "surrogate":
        first, second = text.split(", ")[0], text.split(" met ")[1].split(" and ")[0]
        assert first.split()[1].upper() == second.split(",")[0] and first.split()[0] == second.split(", ")[1]  # one person, two formats


def test_surrogates_stay_distinct(spark):
    def narrow(kind, canonical, key, attempt=0, gender=""):
        return f"{(int(canonical) * 7 + attempt * 13) % 64}"

    rows = spark.createDataFrame([("phone", str(i), "") for i in range(100, 140)], "kind string, canonical string, gender string")
    out = pd_.entity_table(rows, "k", invent=narrow)
    assert out.count() == 40 == out.select("surrogate").distinct().count()
    crowded = spark.createDataFrame([("phone", str(i), "") for i in range(100, 180)], "kind string, canonical string, gender string")
    with pytest.raises(ValueError, match="collide"):
        pd_.entity_table(crowded, "k", rounds=2, invent=narrow)


def test_no_surrogate_is_an_original(spark):
    def narrow(kind, canonical, key, attempt=0, gender=""):
        return f"{(int(canonical) + 1 + attempt) % 100}"

    rows = spark.createDataFrame([("phone", str(i), "") for i in range(10, 30)], "kind string, canonical string, gender string")
    out = {r.canonical: r.surrogate for r in pd_.entity_table(rows, "k", invent=narrow).collect()}
    assert not set(out) & set(out.values()) and len(set(out.values())) == 20


def test_formats():
    canonical = pd_.phone_number("+1 (555) 678-0168")
    assert canonical == "1:5556780168" == pd_.phone_number("555-678-0168") == pd_.phone_number("001 555 678 0168")
    assert pd_.phone_number("0044 1632 960807") == pd_.phone_number("+44 (0)1632 960807") == pd_.phone_number("01632 960 807") == "44:1632960807"
    out = pd_.formatted("phone", "+1 (555) 678-0168", pd_.entity_surrogate("phone", canonical, b"k"))
    assert [c for c in out if not c.isdigit()] == list("+ () -") and out.startswith("+1 (") and out != "+1 (555) 678-0168"
    assert pd_.formatted("phone", "0044 1632 960807", "44:7000000001") == "0044 7000 000001"
    assert pd_.formatted("person", "Emil B. Brevolane", "Arno Bacedi") == "Arno A. Bacedi"
    assert pd_.formatted("email", "A.B@X.ORG", "u1@mail2.example") == "U1@MAIL2.EXAMPLE"
    assert pd_.formatted("email", "a[at]b[dot]org", "u1@mail2.example") == "u1[at]mail2[dot]example"
    assert pd_.formatted("person", "BREVOLANE, Emil", "Arno Bacedi") == "BACEDI, Arno" and pd_.formatted("person", "E.\nBrevolane", "Arno Bacedi") == "A.\nBacedi"


@pytest.mark.parametrize(
    "text, want",
    [
        ("Please contact Maria Gonzalez or call +81 3-1234-5678", [("person", "Maria Gonzalez"), ("phone", "+81 3-1234-5678")]),
        ("+81 3-1234-5678", [("phone", "+81 3-1234-5678")]),
        ("John Smith called; Jean Dupont habite 12 rue Victor Hugo", [("person", "John Smith"), ("person", "Jean Dupont"), ("address", "12 rue Victor Hugo")]),
        ("mobile: 98765 43210, CNI 123456789012, SIN 046 454 286", [("phone", "98765 43210"), ("id_number", "123456789012"), ("id_number", "046 454 286")]),
        ("Mrs. Oluchi O'Hara met Dr Wei van Dam", [("person", "Oluchi O'Hara"), ("person", "Wei van Dam")]),
        ("The tug Maria Gonzalez and Anna Station; Dr. Who of Rosa Street", []),
    ],
)
def test_names_and_numbers_outside_of_the_list(text, want):
    assert found(text) == want


def test_entities_of_a_text():
    got = [x[3] for x in pd_.mentions("Alba Brevodrup wrote. A. Brevodrup signed; H. Brevodrup not. Frau Noor Corrunlane", NAMES)]
    assert got == ["alba brevodrup", "alba brevodrup", "h brevodrup", "noor corrunlane"]
    assert pd_.mentions("Frau Sasha Corrunlane", NAMES)[0][4] == "f"


def test_surrogates_of_a_corpus(spark):
    texts = ["Alba Brevodrup, +44 1632 960807", "A. Brevodrup, 01632 960 807", "Frau Xeni Brevodrup and X. BREVODRUP", "Emil Corrunlane, Emil Brevodrup", "12 Harbor Street, Dunmarsh, ZQ 00816"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    names = spark.createDataFrame(LIST, "name string, name_kind string")
    made = pd_.replace(docs, names, "k", "surrogate")
    out = {r.doc_id: r.text for r in made.collect()}
    (given, family), number = out[0].split(", ")[0].split(), out[0].split(", ")[1]
    assert out[1].startswith(f"{given[0]}. {family}, 0") and number.startswith("+44 ") and number[4:].replace(" ", "") == out[1].split(", 0")[1].replace(" ", "")
    assert out[2].endswith(f". {family.upper()}") and out[2].split()[1][-1] == "a" and out[3].split(", ")[1].split()[1] == family
    assert out[3].split()[0] == out[3].split(", ")[1].split()[0]
    assert tuple(pd_.check(docs, made, names).first()) == (5, 0, 0, 0)
    same = docs.withColumn("replaced", docs["doc_id"])
    assert tuple(pd_.check(docs, same, names).first())[1] == 9
    with pytest.raises(ValueError):
        pd_.replace(docs, names, "")


def test_scripts():
    for name, script in (("иван", "CYRILLIC"), ("ελενη", "GREEK"), ("emil", "LATIN")):
        for kind in ("given", "family"):
            assert pd_._script(pd_.entity_surrogate(kind, name, b"k").lower()) == script
    letters = [pd_._initial(c, b"k") for c in "abcdefghijklmnopqrstuvwxyz"]
    assert sorted(letters) == list("abcdefghijklmnopqrstuvwxyz") and all(a != b for a, b in zip("abcdefghijklmnopqrstuvwxyz", letters))
