import pytest

from threadloom.llm import privacy as P

GIVEN, ENDINGS = ["Alice", "Zoé", "Óscar", "Gérard"], ["holt", "ozan", "nier"]
NAMES = P.Names(GIVEN, ENDINGS)


def items(text):
    return {(k, text[a:b]) for a, b, k in P.entities(text, NAMES)}


@pytest.mark.parametrize(
    "text, want",
    [
        ("Mail a.b-c@x.example.", {("email", "a.b-c@x.example")}), ("mailto:a1@x.test now", {("email", "a1@x.test")}), ("a_b AT x.test", {("email", "a_b AT x.test")}), ("a.b [at] x [dot] test please", {("email", "a.b [at] x [dot] test")}), ("a.b(at)x-y.test", {("email", "a.b(at)x-y.test")}),
        ("See <1533.k15x@mta.example> here", set()), ("id <2010.0a.bc@mx5.example>", set()),
        ("Tel: 1-312-555-0165 ext. 06", {("phone", "1-312-555-0165")}), ("(212) 555-0188", {("phone", "(212) 555-0188")}), ("+44 (7700) 900 618", {("phone", "+44 (7700) 900 618")}), ("07700 900512", {("phone", "07700 900512")}), ("0033 639 98 78 64", {("phone", "0033 639 98 78 64")}), ("au 06.39.98.44.79 le soir", {("phone", "06.39.98.44.79")}), ("600-00-06-62", {("phone", "600-00-06-62")}), ("030/23125042", {("phone", "030/23125042")}), ("+49 30 23125-750", {("phone", "+49 30 23125-750")}),
        ("Address is 192.0.2.24, mask 255.255.255.0.", set()), ("On 2008-06-08 23:33, total 40 28 40 40", set()), ("offset 0x66, block 66-34-6634", set()),
        ("SSN 994-49-5800", {("id_number", "994-49-5800")}), ("QQ 04 70 15 D", {("id_number", "QQ 04 70 15 D")}), ("1 87 01 99 858 017 91", {("id_number", "1 87 01 99 858 017 91")}), ("Steuer-ID 66 673 288 691 ab", {("id_number", "66 673 288 691")}), ("DNI 40.724.855-W sin", {("id_number", "40.724.855-W")}),
        ("188 Willow Avenue please", {("street", "188 Willow Avenue")}), ("au 9 bis rue des Rosiers si", {("street", "9 bis rue des Rosiers")}), ("Mühlenstraße 180, 96235 Ort", {("street", "Mühlenstraße 180")}), ("C/ de los Naranjos, 15 el", {("street", "C/ de los Naranjos, 15")}), ("version 7.24 of 12 files", set()),
        ("Ask Alice Yariholt, who", {("name", "Alice Yariholt")}), ("As CORINIER Gérard said", {("name", "CORINIER Gérard")}), ("ZoÃ© de la Garozan", {("name", "ZoÃ© de la Garozan")}), ("Yariholt, Alice", {("name", "Yariholt, Alice")}), ("P. Garozan wrote", {("name", "P. Garozan")}), ("alice yariholt wrote", {("name", "alice yariholt")}), ("Regards,\nAlice", set()), ("Alice Instruments", set()), ("", set()),
    ],
)
def test_items(text, want):
    assert items(text) == want


def _senders():
    return [{"seq": i, "from_name": n, "text": None} for i, n in enumerate(["Alice Yariholt", "Alice Garozan", '"Corinier, Zoé"', "Zoé Wesiholt", "ÓSCAR", None, "Óscar Balunier", "Óscar Pelozan"])]


def test_find_and_replace(messages):
    rows = [*_senders(), {"seq": 20, "from_name": "Alice Yariholt", "from_email": "ay@x.test", "text": "Ask ALICE YARIHOLT or Alice  Yariholt\nay@x.test, call 600000492"}, {"seq": 21, "text": ""}, {"seq": 22, "text": "x" * 200_000}]
    m = messages(rows, ", kind STRING, item STRING, code STRING")
    got = {(r.seq, r.kind, r.item) for r in P.find(m).collect()}
    assert got == {(20, "name", "aliceyariholt"), (20, "email", "ayxtest"), (20, "phone", "600000492")}
    r = P.replace(m, "k").where("seq = 20").collect()[0]
    assert "YARIHOLT" not in r.text and "600000492" not in r.text and r.from_name in r.text and r.from_email in r.text and r.text.startswith("Ask [NAME_")
    s = P.replace(m, "k", style="surrogate").where("seq = 20").collect()[0]
    assert s.from_email.endswith(".test") and "@x." not in s.from_email and "ay@" not in s.text and s.from_email in s.text
    assert s.text.startswith(f"Ask {s.from_name.upper()} or ")
    assert P.replace(m, "k").where("seq = 21").collect()[0].text == "" and P.find(messages([])).count() == 0


def test_surrogates_keep_the_form():
    assert P.surrogate("phone", "(212) 555-0188", "2125550188", "k")[:5] == "(212)"
    assert P.surrogate("street", "188 Willow Avenue", "x", "k").endswith(" Avenue")
    host = lambda w: P.surrogate("email", w, P.item(w), "k")
    assert host("a.b@news.x.test") == host("a.b [at] news [dot] x [dot] test").replace(" [at] ", "@").replace(" [dot] ", ".") and "news" not in host("a.b@news.x.test")
    with pytest.raises(ValueError):
        P.replace(None, "")


def test_a_person_stays_one():
    one = lambda w: P.surrogate_name(w, NAMES, "k", {})
    given, family = one("Alice Yariholt").split(" ")
    assert one("Yariholt, Alice") == f"{family}, {given}" and one("YARIHOLT Alice") == f"{family.upper()} {given}" and one("ALICE YARIHOLT") == f"{given} {family}".upper() and one("alice yariholt") == f"{given} {family}".lower()
    assert one("A. Yariholt") == f"{given[0]}. {family}" and one("Alice\n> Yariholt") == f"{given}\n> {family}" and one("Alice de la Yariholt") == f"{given} de la {family}" and one("Zoé Yariholt").endswith(" " + family)
    assert one("Alice Yariholt-Garozan").split(" ")[1] == f"{family}-{one('Zoé Garozan').split(' ')[1]}"
    assert given.endswith("a") and one("Gérard Yariholt").split(" ")[0].endswith("o") and one("Luca Yariholt").split(" ")[0].endswith("o")
    assert one("Анна Петрова") != "Анна Петрова" and all("\u0400" <= c <= "\u04ff" for c in one("Анна Петрова") if c != " ") and len(one("山田")) >= 2 and not one("山田").isascii()
    assert len({one(f"{c}. Yariholt") for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZÉ"}) == 27


def test_short_family_names(messages):
    names = P.Names(["Alice", "Jan"], ["holt", "^kim", "^diaz"])
    text = "Ask Alice Kim or DIAZ, Jan. Kimono and A. Kim, not kim alone, nor Alice Kimble."
    assert {text[a:b] for a, b in names.find(text)} == {"Alice Kim", "DIAZ, Jan", "A. Kim"}
    m = messages([{"seq": i, "from_name": f"{g} {f}"} for i, (g, f) in enumerate((g, f) for g in ("Alice", "Jan") for f in ("Kim", "Diaz", "Yariholt", "Wesiholt", "Po"))])
    assert [set(x) for x in P.learn_names(m)] == [{"Alice", "Jan"}, {"holt", "^kim", "^diaz", "^po"}]


def test_many_names_are_the_same_as_few(monkeypatch):
    text = "Alice Yariholt, CORINIER Gérard and ZoÃ© de la Garozan; Garozan, Óscar. P. Garozan, Bob Yariholt"
    few = [text[a:b] for a, b in NAMES.find(text)]
    monkeypatch.setattr(P, "PATTERN", 1)
    many = P.Names(GIVEN, ENDINGS)
    assert [text[a:b] for a, b in many.find(text)] == few and len(few) == 5 and many.is_given("Zoé") and not many.is_given("Zoé b") and not many.is_given("Bob")


def test_clashes(spark):
    df = spark.createDataFrame([("phone", str(i)) for i in range(600)] * 2, "kind STRING, item STRING")
    assert P.clashes(df, "k").count() == 0
    shared = P.clashes(df, "k", size=1).collect()  # 600 items on 256 codes
    assert len(shared) > 100 and all(r["items"] > 1 for r in shared)


def test_surrogates_are_distinct(spark, messages):
    people = [f"{g} {chr(65 + i // 26 % 26)}{chr(97 + i % 26)}{'abcdefg'[i // 676]}riholt" for i in range(4500) for g in ("Alice", "Zoé")]
    m = messages([{"seq": i, "from_name": n, "from_email": f"a{i}@x.test", "text": None} for i, n in enumerate([*people, "山田", "田中"])])
    got = P.replace(m, "k", style="surrogate").collect()
    assert len({r.from_name for r in got}) == len({r.from_email for r in got}) == 9002
    assert len({P.surrogate("phone", f"(212) 555-{i:04d}", f"212555{i:04d}", "k") for i in range(10_000)}) == 10_000
    assert len({P.surrogate("id_number", f"AB {i:03d} C", f"ab{i:03d}c", "k") for i in range(1000)}) == 1000
    items = spark.createDataFrame([("name", f"p{i}") for i in range(300)], "kind STRING, item STRING")
    again = P.redraws(items, "k", 500)
    assert again and len({P.drawn("name", f"p{i}", "k", again.get(("name", f"p{i}"), 0), 500) for i in range(300)}) == 300


def test_streets_are_distinct():
    street = lambda w: P.surrogate("street", w, P.item(w), "k")
    assert len({street(f"{n} {w} Avenue") for n in range(1, 100) for w in ("Willow", "Maple", "Elm", "Oak", "Old Mill")}) == 495
