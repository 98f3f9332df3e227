import random

import numpy as np
import pytest

from docstrata.llm import handwritten as hw

R = random.Random(2)


def word():
    return "".join(R.choice("bdfgklmnprst") + R.choice("aeiou") for _ in range(3))


def hand(decoy=False):
    note = R.choice(["This script writes the tables marked as generated; keep it tidy.", "Hand-tuned. The generated copy lives elsewhere, do not edit that one."]) if decoy else f"The {word()} checks the {word()}."
    return f"/*\n * {note}\n */\nint {word()}(int {word()})\n{{\n    // {word()} {word()} now\n    return {R.randint(1, 99)};\n}}\n" * R.randint(1, 3)


def generated():
    return f"/* Code generated from {word()}.svd; DO NOT EDIT */\n" + "".join(f"    {{'{word()}', 0x{R.getrandbits(32):08X}}},\n" for _ in range(30))


def blob():
    return "const unsigned char x[] = {\n" + "".join(", ".join(f"0x{R.getrandbits(8):02X}" for _ in range(16)) + ",\n" for _ in range(20)) + "};\n"


def rows():
    out = []
    for i in range(240):
        kind = i % 6
        path = {4: f"lib/vendor/{word()}_{i:x}.c", 5: f"src/{word()}_{i:x}_pb2.py"}.get(kind, f"src/{R.choice(['vendors_info', 'core', 'distance'])}/{word()}_generator_{i:x}.c")
        text = (hand, lambda: hand(True), generated, blob, hand, hand)[kind]()
        out.append((str(i), f"repo{i % 12}", path, text, "c", "clash"))
    return [*out, ("n1", None, None, None, None, ""), ("n2", "repo1", "docs/a.md", "", None, ""), ("n3", "repo1", "src/e_1.c", "", "c", "")]


@pytest.fixture(scope="module")
def found(spark):
    table = spark.createDataFrame(rows(), "id string, repo string, path string, text string, lang string, seed string")
    models = hw.train(table.select("repo", "path"), table)
    return table, models


def test_found_by_path_and_text(found):
    table, models = found
    by_path = {r.id for r in hw.not_handwritten_paths(table, models).collect()}
    by_text = {r.id for r in hw.not_handwritten_texts(table, models).collect()}
    assert by_path == {str(i) for i in range(240) if i % 6 in (4, 5)}
    assert by_text == {str(i) for i in range(240) if i % 6 in (2, 3)}


def test_accuracy_on_unseen_repositories(found):
    assert min(found[1].held_out.values()) >= 0.95


def test_body_shows_it_without_its_header(found):
    models = found[1]
    text = hw.masked(generated())
    assert "DO NOT EDIT" not in text and models.body.margin(hw.body_features(text)) > 0


def test_empty_tables(spark, found):
    none = found[0].limit(0)
    models = hw.train(none.select("repo", "path"), none)
    assert not models.by_path("src/a.c")
    assert hw.not_handwritten_texts(none, models).count() == 0


def test_svm_separates():
    rows = [np.array([1, 5]), np.array([1, 6]), np.array([2, 5]), np.array([2, 6])]
    svm = hw.LinearSVM.fit(rows, [True, True, False, False])
    assert [svm.margin(r) > 0 for r in rows] == [True, True, False, False]


def test_very_long_and_odd_texts():
    assert len(hw.body_features("a" * 200_000)) > 0 and len(hw.gram_features("")) > 0
    assert hw.seed_body("\n \n") is None
