from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylight.llm import mojibake as M

CLEAN = [
    "Für lange Gespräche gibt es bei größerer Last keine Lösung.", "La configuración está dañada y la cola de salida no arrancó.", "Où sont passés les fragments périmés ? Peut-être après.", "São 948 registros; a verificação não os vê. ATENÇÃO: NÃO apague.",
    "Została jeszcze część: 250 wpisów.", "Индексатор пропускает пустые строки ночью.", "再起動の後、空の行が6560件残りました。", "The naïve café build took ≥ 30 µs — “quoted” it’s fine…", "├── src\n│   └── index.rs", "plain",
]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_stay(text):
    assert M.repair(text) == (text, False)


@pytest.mark.parametrize("text", CLEAN[:8])
@pytest.mark.parametrize("encoding", ["cp1252", "latin-1", "cp850", "mac_roman"])
def test_utf8_read_as_something_else_is_restored(text, encoding):
    raw = text.encode()
    try:
        garbled = raw.decode(encoding)
    except UnicodeDecodeError:
        garbled = "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in raw)
    assert M.repair(garbled) == (text, True)


@pytest.mark.parametrize("text", CLEAN[:4])
def test_two_layers(text):
    once = text.encode().decode("latin-1")
    assert M.repair(once.encode().decode("latin-1")) == (text, True)


@pytest.mark.parametrize(
    ("text", "meant", "seen"),
    [("Die Warteschlange prüft auch das, und der Bereich ist nicht für überlappende Läufe.", "cp1252", "cp850"), ("Осталось проверить записей. Параметр равен.", "koi8_r", "cp1251"), ("Параметр равен нулю.", "cp1251", "latin-1"), ("Została jeszcze część działań.", "cp1250", "cp1252")],
)
def test_legacy_read_as_legacy(text, meant, seen):
    assert M.repair(text.encode(meant).decode(seen)) == (text, True)


def test_quotes_lost_signs_and_parts():
    assert not M.repair("Die Anzeige `Ã¼` statt ü war ein Fehler.")[1]
    assert M.repair("Es m�ssen Eintr�ge sein.")[1]
    assert M.repair("Gut: für alle. Schlecht: fÃ¼r alle.") == ("Gut: für alle. Schlecht: für alle.", True)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.characters(codec="ascii")))
def test_ascii_is_never_touched(text):
    assert M.repair(text) == (text, False)


def test_documents(spark):
    rows = [(1, "fÃ¼r alle"), (1, "fÃ¼r alle"), (2, None), (3, ""), (None, "fÃ¼r"), (4, "für " * 50_000)]
    df = spark.createDataFrame([(i, t, "x", True) for i, t in rows], "doc_id long, text string, restored string, garbled boolean")
    out = M.repair_documents(df).collect()
    assert len(out) == 6 and {r.doc_id for r in out if r.garbled} == {1, None}
    assert {r.restored for r in out if r.doc_id == 1} == {"für alle"}
    assert M.repair_documents(df.where("false")).count() == 0


def test_any_number_of_layers_is_undone():
    text = garbled = "Größe der Schlüssel für Übergänge, naïve Prüfung"
    for _ in range(6):
        garbled = garbled.encode("utf-8").decode("latin-1")
    assert M.repair(garbled) == (text, True)
