import pytest

from docstrata.llm import encoding as en

GOOD = "Größe prüfen für den Zähler – Lüfter läuft, l’état protégé à 25 °C"
SCHEMA = "id string, text string, piece string"


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"g{i}", GOOD, "clash") for i in range(200)]
    damaged = {
        "utf8 as cp1252": "für den Zähler".encode().decode("cp1252"),
        "utf8 as latin1": "à 25 °C".encode().decode("latin-1"),
        "utf8 as cp437": "Lüfter läuft".encode().decode("cp437"),
        "twice": "prüfen".encode().decode("cp1252").encode().decode("cp1252"),
        "cp1252 as cp1251": "Größe für den".encode("cp1252").decode("cp1251"),
        "lost": "f�r den Z�hler",
        "mark": "\ufeffBoard".encode().decode("latin-1"),
        "lines": "│".encode().decode("cp437"),
    }
    right = {
        "decoy letters": "Legend: Ä Ö Ü ß Ã Â â é ñ – all printable.",
        "decoy caps": "CHÂTEAU-ÂGÉ / NÃO / AÇÃO are legal labels.",
        "decoy script": "Частота 50 Гц, Ελάχιστη τάση",
        "boxes": "┌────┬────┐ │ x",
        "null": None,
        "empty": "",
        "ascii": "plain text only",
    }
    rows += [(k, v, "x") for k, v in {**damaged, **right}.items()]
    rows.append(("twice", damaged["twice"], "x"))
    texts = spark.createDataFrame(rows, SCHEMA)
    damage = en.damaged_pieces(texts)
    return (
        set(damaged),
        {r.id for r in en.damaged_records(texts, damage).collect()},
        {r.id: (r.text, r.lost) for r in en.restored(texts, damage).collect()},
    )


def test_damaged_records_and_only_they_are_found(found):
    assert found[1] == found[0]


def test_texts_are_restored(found):
    text = {k: t for k, (t, _) in found[2].items()}
    assert text["utf8 as cp1252"] == "für den Zähler"
    assert text["utf8 as cp437"] == "Lüfter läuft"
    assert text["twice"] == "prüfen"
    assert text["cp1252 as cp1251"] == "Größe für den"
    assert text["lost"] == "für den Zähler"


def test_viterbi_fills_lost_bytes():
    weight = {"ü": -1.0, "é": -2.0, "가": -1.5, "각": -3.0}
    assert en.viterbi([b"f", None, b"r"], "cp1252", weight) == "für"
    assert en.viterbi(["가".encode()[:1], None, "가".encode()[2:]], "utf-8", weight) == "가"
    assert en.viterbi([b"\xff", b"\xfe"], "utf-8", weight) is None


def test_no_texts(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert en.damaged_pieces(none).count() == 0


def test_copies_do_not_argue_for_their_damage(spark):
    bad, short = "le réseau".encode().decode("latin-1"), "für 25".encode().decode("latin-1")
    rows = [(f"g{i}", f"le réseau {i}, für 25", "") for i in range(3)]
    rows += [(f"c{i}", bad, "") for i in range(300)] + [(f"n{i}", f"{bad} {i}", "") for i in range(30)] + [(f"s{i}", f"{short} {i}", "") for i in range(30)]
    texts = spark.createDataFrame(rows, SCHEMA)
    found = {r.id: r.text for r in en.restored(texts, en.damaged_pieces(texts)).collect()}
    assert len(found) == 360 and found["c7"] == "le réseau" and found["n7"] == "le réseau 7" and found["s7"] == "für 25 7"


def test_lost_bytes_are_not_invented(spark):
    rows = [(f"g{i}", f"가가 나무 tâche réseau {i}", "") for i in range(40)]
    rows += [("all", "x ���� y", ""), ("eight", "x �������� y", ""), ("word", "le rÃ�seau", ""), ("none", "le zqÃ�vbx", "")]
    texts = spark.createDataFrame(rows, SCHEMA)
    found = {r.id: (r.text, r.lost) for r in en.restored(texts, en.damaged_pieces(texts)).collect()}
    assert found["all"] == ("x ���� y", True) and found["eight"] == ("x �������� y", True)
    assert found["word"] == ("le réseau", False)
    assert found["none"] == ("le zqÃ�vbx", True)


def test_all_likely_texts_of_a_lattice():
    chars = en.Characters({"ü": -1.0, "é": -2.0, "가": -1.5})
    assert en.paths([b"f", None, b"r"], "cp1252", chars) == ["für", "fér"]
    assert en.paths([None, None, None], "utf-8", chars) == ["가"]


def test_rare_characters_fill_lost_bytes(spark):
    words = " ".join(f"é{a}{b}xyz" for a in "abcdefgh" for b in "abcdefgh")
    rows = [(f"g{i}", f"{words} {i}", "") for i in range(1000)] + [(f"r{i}", f"le goûter {i}", "") for i in range(5)] + [("lost", "le goÃ�ter", "")]
    texts = spark.createDataFrame(rows, SCHEMA)
    found = {r.id: (r.text, r.lost) for r in en.restored(texts, en.damaged_pieces(texts)).collect()}
    assert found == {"lost": ("le goûter", False)}


def test_two_words_of_one_mask_fill_nothing(spark):
    rows = [(f"g{i}", f"la p\u00e2te et le p\u00f4te {i}, un r\u00e9seau", "") for i in range(40)]
    rows += [("unclear", "la p\ufffdte", ""), ("clear", "un r\ufffdseau", ""), ("half", "la p\u00c3\ufffdte", "")]
    texts = spark.createDataFrame(rows, SCHEMA)
    found = {r.id: (r.text, r.lost) for r in en.restored(texts, en.damaged_pieces(texts)).collect()}
    assert found == {"unclear": ("la p\ufffdte", True), "clear": ("un r\u00e9seau", False), "half": ("la p\u00c3\ufffdte", True)}


def test_words_that_are_paths_of_a_lattice():
    assert en.stands_for("r\u00c3\ufffdseau", "r\u00e9seau") and en.stands_for("r\ufffdseau", "r\u00e9seau")
    assert not en.stands_for("r\u00c3\ufffdseau", "resseau") and not en.stands_for("r\ufffdseau", "r\uac00seau")


def test_restoration_rate_on_damaged_lines(spark):
    """Lines of the test tables' own kind, each damaged in one known way; nothing may come out wrong and unmarked."""
    words = "Gr\u00f6\u00dfe pr\u00fcfen Z\u00e4hler L\u00fcfter l\u00e4uft r\u00e9seau cl\u00e9 \u00e9tat prot\u00e9g\u00e9 r\u00e9serve se\u00f1al l\u00ednea dise\u00f1o a\u00f1o".split()
    lines = {i: f"{words[i % 14]} {words[(i * 5 + 1) % 14]} und {words[(i * 3 + 2) % 14]} {i}" for i in range(210)}
    ways = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("cp1252", "cp1251"), ("cp1252", "cp437")]
    rows = [(f"g{i}-{k}", f"{line}{k}", "") for i, line in lines.items() for k in range(8)]
    rows += [(f"d{i}", line.encode(ways[i // 14 % 7][0]).decode(ways[i // 14 % 7][1]) if i // 14 % 7 < 6 else line.encode("cp1252").decode("utf-8", "replace"), "") for i, line in lines.items()]
    texts = spark.createDataFrame(rows, SCHEMA)
    found = {r.id: (r.text, r.lost) for r in en.restored(texts, en.damaged_pieces(texts)).collect()}
    right = sum(found.get(f"d{i}", ("", True))[0] == line for i, line in lines.items())
    wrong = sum(f"d{i}" in found and not found[f"d{i}"][1] and found[f"d{i}"][0] != line for i, line in lines.items())
    assert right >= 0.9 * len(lines) and wrong <= 2
    assert not any(k[0] == "g" for k in found)
