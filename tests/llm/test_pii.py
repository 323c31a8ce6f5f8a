from __future__ import annotations

import pytest

from carryover.llm import pii
from tests.conftest import rows

LEXICON = [("given", x) for x in ("Alvida", "Halvek", "Rose", "August", "Will", "Elsavi", "Orsavi", "Tamvek", "Ulvek", "Halsavi")] + [
    ("family", x) for x in ("Branaby", "Ostraby", "Quelaby", "Vondaby", "Wexwickel", "Branwickel", "Ostrwickel", "Queloskarn", "Branoskarn", "Ystoskarn")
]

CASES = [
    ("Mail a.b+c@mail.example.org now", [("email", "a.b+c@mail.example.org")]),
    ("x [at] mail [dot] host [dot] example", [("email", "x [at] mail [dot] host [dot] example")]),
    ("kel at example dot com and", [("email", "kel at example dot com")]),
    ("a-b(at)host.invalid.", [("email", "a-b(at)host.invalid")]),
    ("联系邮箱是abc＠example.com。", [("email", "abc＠example.com")]),
    ("<q+r@x.example>, ok", [("email", "q+r@x.example")]),
    ("Open notes@2x.png next to icon@3x.png.", []),
    ("look at the dot matrix, answers at the end", []),
    ("Ping @cornacix about build 20240619.4.", []),
    ("Call +49 (0)30 23125-884 when", [("phone", "+49 (0)30 23125-884")]),
    ("Call 1 (415) 555 0143 ext. 63 when", [("phone", "1 (415) 555 0143")]),
    ("T: (02) 5550 9021; 617 5550103, 202.555.0191", [("phone", "(02) 5550 9021"), ("phone", "617 5550103"), ("phone", "202.555.0191")]),
    ("01.99.00.77.55 or 0049 30 23125 698", [("phone", "01.99.00.77.55"), ("phone", "0049 30 23125 698")]),
    ("请致电+４９ (０)３０ ２３１２５-７５３找", [("phone", "+４９ (０)３０ ２３１２５-７５３")]),
    ("((312) 555-0143) before", [("phone", "(312) 555-0143")]),
    ("Order number 447-8181-9023 is closed.", []),
    ("Ratio 3.141592653 at 10.0.2.4/24 stays. Epoch value 1714080280. ISBN 000-0-0054-737-0", []),
    ("666-17 remain open. Read chapter 9, lines 202-555.", []),
    ("My SSN 666-40-6914, social security no. 666 51 5621", [("id_number", "666-40-6914"), ("id_number", "666 51 5621")]),
    ("NI number QQ 45 48 45 D; NINO: QQ170191D", [("id_number", "QQ 45 48 45 D"), ("id_number", "QQ170191D")]),
    ("tax ID 061 953 290 70, DNI 00001830-U, passport C08356600", [("id_number", "061 953 290 70"), ("id_number", "00001830-U"), ("id_number", "C08356600")]),
    ("Commit 9f3e31a1c7 came after v2.9.6. Ticket QQ-548", []),
    ("lives at 97a Vexfel Junfevi Crescent, Quellin 56327.", [("address", "97a Vexfel Junfevi Crescent")]),
    ("at 204 GLONTOX ROAD, Apt 37", [("address", "204 GLONTOX ROAD")]),
    ("au 183, rue de Sollon.", [("address", "183, rue de Sollon")]),
    ("en Via Brapusk 157, in Calle Ot, 210B und Korxomitonstr. 172", [("address", "Via Brapusk 157"), ("address", "Calle Ot, 210B"), ("address", "Korxomitonstr. 172")]),
    ("包裹寄到173 Ulkix Row, 66885 Port", [("address", "173 Ulkix Row")]),
    ("ул. Тихая, д. 85.", [("address", "ул. Тихая, д. 85")]),
    ("There are 7 Drive folders and 4 Court dockets. Section 2 of the Hex Street Style guide.", []),
    ("Ask Dr. Alvida Branaby about", [("name", "Alvida Branaby")]),
    ("Signed, Ostraby, Halvek", [("name", "Ostraby, Halvek")]),
    ("Elsavi B. Queloskarn-Vondaby asked", [("name", "Elsavi B. Queloskarn-Vondaby")]),
    ("Rose Branwickelさんの電話は", [("name", "Rose Branwickel")]),
    ("TAMVEK OSTRWICKEL", [("name", "TAMVEK OSTRWICKEL")]),
    ("Herr Mark Ystoskarn wohnt", [("name", "Mark Ystoskarn")]),
    ("Will August be too late for the Rose branch?", []),
    ("Halvek.branaby@example.org", [("email", "Halvek.branaby@example.org")]),
    # true edges, however far
    ("x " + "a.b-" * 40 + "c@mail.example", [("email", "a.b-" * 40 + "c@mail.example")]),
    ("to " + "kel dot " * 30 + "om at example dot com", [("email", "kel dot " * 30 + "om at example dot com")]),
    (f"at 12 {'Vex' * 40} {'Jun' * 40} Crescent.", [("address", f"12 {'Vex' * 40} {'Jun' * 40} Crescent")]),
    (f"in {'Kor' * 30} Straße 5 wohnt", [("address", f"{'Kor' * 30} Straße 5")]),
    (f"Elsavi-{'Halvek-' * 8}Rose Branaby asked", [("name", f"Elsavi-{'Halvek-' * 8}Rose Branaby")]),
    ("Call +49 " + "(30) " * 2 + "-" + " 0 1 2 3 4 5 6".replace(" ", " ( ") + " ok", []),
    # schemes
    ("see https://user:pw@host.example/x and http://a@b.example", []),
    ("mailto:a@b.example, https://host.example/?m=c@d.example", [("email", "a@b.example"), ("email", "c@d.example")]),
    ("tel:0301234567 or x:0301234567", [("phone", "0301234567")]),
]


@pytest.fixture(scope="module")
def finder():
    return pii.Finder(LEXICON)


@pytest.mark.parametrize("text,expected", CASES)
def test_items(finder, text, expected):
    assert [(k, text[s:e]) for s, e, k in finder.find(text)] == expected


def test_replace(finder):
    text = "Ask Alvida Branaby, +44 7700 900572, a@b.example; done."
    assert pii.replace(text, finder.find(text)) == "Ask [NAME], [PHONE], [EMAIL]; done."


def test_long_texts(finder):
    for text in ("@" * 50_000, "a" * 300_000, "1 " * 100_000, "A-" * 50_000, "Alvida " * 40_000, "+" * 100_000, "SSN " * 30_000 + "1" * 100_000, "Street " * 40_000, "(at)" * 50_000, "://@" * 50_000, "1" + "( " * 50_000 + "1", "x at " * 40_000, "a[dot]" * 30_000 + "[at]b", "12 345 " * 30_000, "St " * 50_000, "weg 1" * 40_000, "İ" * 1000 + " a@b.example"):
        finder.find(text)


def test_operator(spark):
    lexicon = spark.createDataFrame([*LEXICON, (None, None), ("given", None)], "name_part string, name_value string")
    text = "Ask Alvida Branaby, a@b.example"
    df = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, None, None), (None, "", None), (None, "plain", None)], "start_pos int, text string, pii_kind string")
    got = pii.find_pii(df, ["start_pos", "pii_kind"], "text", lexicon)
    assert got.columns == ["start_pos", "pii_kind", "pii_pii_kind", "pii_start_pos", "end_pos"]
    assert rows(got) == sorted([(1, "x", "name", 5, 18), (1, "x", "email", 21, 31)] * 2, key=repr)
    red = pii.redact(df, "text", lexicon)
    assert rows(red, "redacted") == sorted([("Ask [NAME], [EMAIL]",)] * 2 + [(None,), ("",), ("plain",)], key=repr)
    assert pii.find_pii(df.limit(0), ["start_pos"], "text", lexicon).count() == 0
    assert pii.find_pii(df, ["start_pos"], "text", lexicon.limit(0)).where("pii_kind = 'email'").count() == 2
