import pytest

from docstrata.llm import personal as pe


@pytest.fixture(scope="module")
def field():
    return pe.model()


#: Names, templates and streets that no training sentence is composed with.
HELD_NAMES = (
    "Yuki Tanaka|Kwame Nkrumah-Osei|Aoife O'Brien|Priya Raghunathan|Maria van der Berg|Jean-Luc Picard|Tomasz W. Lewandowski|Ngozi Adichie|Rohan Mehta|"
    "Sinéad McKenna|Bartholomew Quigley|Hedda Gablersen|Leif Ragnarsson|Xiomara Castellanos|Fyodor Karamazin|Giulietta di Rocco|남궁민수|허준|김서연"
).split("|")
HELD_STREETS = "221B Baker Street|14 Elm Grove Road|Kastanienallee 12|Goethestraße 5a|8 rue de Rivoli|Calle Mayor, 31|77 Sunset Boulevard|Am Markt Platz 3".split("|")
HELD_LINES = [
    ("Code review done by {} yesterday", HELD_NAMES), ("Author - {}", HELD_NAMES), ("Reviewer: {}", HELD_NAMES), ("// Contact {} about failures", HELD_NAMES),
    ("our office is at {}", HELD_STREETS), ("Postal address: {}", HELD_STREETS), ("Delivery address: {}", HELD_STREETS),
]


def test_held_out_names_and_templates(field):
    """Recall on names, streets and sentences of other make than the training's; no name is known from a list."""
    wanted = found = 0
    for template, values in HELD_LINES:
        for value in values:
            line = template.format(value)
            wanted += 1
            found += value in [line[a:b] for a, b, _ in field.decode(line)]
    assert found / wanted > 0.85


def test_training_holds_no_held_out_name():
    text = "\n".join(line for line, _ in pe.sentences(3_000, 1))
    assert not any(value in text for value in HELD_NAMES + HELD_STREETS if "가" > value[0])


def test_composed_sentences_of_another_seed(field):
    right = wrong = missed = 0
    for line, gold in pe.sentences(800, 4321):
        got = set(field.decode(line))
        right, wrong, missed = right + len(got & gold), wrong + len(got - gold), missed + len(gold - got)
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.93


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("Signed: Dr. Clara K. Holmström", [("name", "Clara K. Holmström")]),
        (" * thanks to Pablo Velova-Lindquist for the traces", [("name", "Pablo Velova-Lindquist")]),
        ("담당자: 김민수", [("name", "김민수")]),
        ("write to c.holm+x@lab.example.org, or mira (at) lab (dot) test.", [("email", "c.holm+x@lab.example.org"), ("email", "mira (at) lab (dot) test")]),
        ("Call +49 (0)171 3920083 when it trips.", [("phone", "+49 (0)171 3920083")]),
        ("Tel. (312) 555-0187.", [("phone", "(312) 555-0187")]),
        ("Social security number: 920-49-0318", [("id_number", "920-49-0318")]),
        ("Lab: 147 Fenn Ave.", [("street_address", "147 Fenn Ave.")]),
        ("Lieferanschrift: Silberstraße 107", [("street_address", "Silberstraße 107")]),
        ("The Kalman filter runs before the Wien bridge.", []),
        ("Fetch git@forge.lab.example:fw/boot.git first.", []),
        ("package rehadrork@2.55.4 pinned.", []),
        ("Part no. 0555-65-2784-B, lot 2019-04-11/025.", []),
        ("Rack Street Side, slot 64.", []),
        ("Route 14 Layer Road Map: 2596 nets.", []),
        ("uint32_t x = 0x59575550123;", []),
        ("Reviewed-by: Yuki Tanaka", [("name", "Yuki Tanaka")]),
        ("Signed: Kwame Nkrumah-Osei", [("name", "Kwame Nkrumah-Osei")]),
        ("thanks to Maria van der Berg", [("name", "Maria van der Berg")]),
        ("contact Aoife O'Brien for it", [("name", "Aoife O'Brien")]),
        ("Автор: Сергей Кузнецов", [("name", "Сергей Кузнецов")]),
        ("Lab: 221B Baker Street", [("street_address", "221B Baker Street")]),
        ("call tel:+49 30 1234567", [("phone", "+49 30 1234567")]),
        ("DNI 12345678Z", [("id_number", "12345678Z")]),
        ("IBAN DE89 3704 0044 0532 0130 00", [("id_number", "DE89 3704 0044 0532 0130 00")]),
        ("AUTHOR OF THE SECOND MANUAL PAGE", []),
        ("", []),
    ],
)
def test_lines(field, line, want):
    assert [(k, line[a:b]) for a, b, k in field.decode(line)] == want


def test_choice_is_the_best_of_all(field):
    """The dynamic program against all sets of non-overlapping candidates."""
    import itertools

    for line, _ in pe.sentences(150, 77):
        found = pe.candidates(line)
        if not 2 <= len(found) <= 11:
            continue
        best = 0.0
        for n in range(len(found) + 1):
            for some in itertools.combinations(found, n):
                if all(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations(some, 2)):
                    best = max(best, sum(field.score(line, s) for s in some))
        got = field.decode(line)
        assert sum(field.score(line, s) for s in got) == pytest.approx(best)


def test_in_spark(spark, field):
    text = "one\n# Author: Hugo Marard, call 07700 900328\nthree"
    rows = [(1, text, "clash"), (2, None, ""), (3, "", ""), (1, text, "clash")]
    table = spark.createDataFrame(rows, "doc_id long, text string, pii_type string")
    got = pe.personal_data(table, field).collect()
    assert len(got) == 4 and {(r.pii_type, r.pii_text) for r in got} == {("name", "Hugo Marard"), ("phone", "07700 900328")}
    assert all(text[r.start :].startswith(r.pii_text) for r in got)
    shown = {r.doc_id: r.text for r in pe.without_personal_data(table, field).collect()}
    assert shown == {1: "one\n# Author: [NAME], call [PHONE]\nthree", 2: None, 3: ""}
    assert pe.personal_data(table.limit(0), field).count() == 0


def test_very_long_text(field):
    assert len(field.decode("x = 1; // nothing here\n" * 20_000 + "Author: Nina Lindwick")) == 1
