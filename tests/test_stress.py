"""The stress module with toy models."""

import numpy as np
import pytest

from vocalis.kernel.frontend import BUNDLE, Entry, Options, bundle_of, process
from vocalis.kernel import stress


def backend(**more):
    last = lambda batch: np.tile(np.arange(10.0), (len(batch), 1))  # noqa: E731  the last vowel wins
    return stress.Backend({"<м": np.ones(16, np.float32)}, last, **more)


def test_accent():
    assert backend().accent("Мама и дом") == "Мам+а и дом"
    assert backend(exceptions={"мама": "м+ама"}).accent("МАМА, м+ама") == "М+АМА, м+ама"
    assert backend(phrases=[("во время", "во вр+емя")]).accent("это во время") == "эт+о во вр+емя"
    yo = lambda batch: np.tile([9.0, 0.0, 0.0], (len(batch), 1))
    assert backend(yo=yo).accent("Зеленый") == "З+ёленый"


def test_homographs():
    vocabulary = {"[UNK]": 0, "за": 1, "##мок": 2, "старый": 3}
    b = backend(homographs={"замок": ("з+амок", "зам+ок")}, homograph=lambda ids, at: 0.9 if 3 in ids else 0.1, vocabulary=vocabulary)
    assert b.accent("старый Замок").endswith("Зам+ок")
    assert b.accent("замок") == "з+амок"


def test_pieces_and_vectors():
    v = {"[UNK]": 0, "за": 1, "##мок": 2, "замо": 3, "##к": 4}
    assert stress.pieces("замок", v) == [3, 4] and stress.pieces("xyz", v) == [0]
    assert stress.grams("аб", 2, 3) == ["<а", "аб", "б>", "<аб", "аб>"]
    assert stress.embed("м", {"<м": np.full(16, 2.0), "м>": np.zeros(16)}).tolist() == [1.0] * 16
    assert np.allclose(stress.softmax(np.array([0.0, 0.0])), 0.5)


def test_hash(tmp_path):
    (tmp_path / "a").write_bytes(b"abc")
    assert stress.file_hash(str(tmp_path / "a"), 2).startswith("ba7816bf")
    with pytest.raises(ValueError):
        stress.file_hash(str(tmp_path / "a"), 0)


def test_over_batches(spark):
    def make():
        import numpy

        from vocalis.kernel.stress import Backend

        return Backend({}, lambda batch: numpy.tile(numpy.arange(10.0), (len(batch), 1)))

    df = spark.createDataFrame([("мама",), (None,)], "t string")
    got = {r.t: r.accented for r in df.mapInPandas(stress.over_batches(make, "t"), "t string, accented string").collect()}
    assert got == {"мама": "мам+а", None: None}


def _toy(bundle):
    assert bundle == "somewhere"
    return lambda s: s.replace("елка", "+ёлка").replace("мама", "м+ама")


def _auto(**more):
    return Options(language="russian", stress="automatic", bundle="somewhere", **more)


def test_automatic_stress_marks_what_nothing_else_rewrote():
    got = process("елка мама кот a+b", _auto(open_bundle=_toy, entries=(Entry("кот", "к+от"),)))
    assert got.pronunciation == "+ёлка м+ама к+от a+b"
    assert [(w[0], w[1], w[4]) for w in got.words] == [("елка", "+ёлка", 0), ("мама", "м+ама", 0), ("кот", "к+от", None), ("a+b", "a+b", None)]
    assert got.decisions == [("елка", 0, False, "automatic"), ("мама", 0, False, "automatic")]
    assert not got.warnings


def _breaks(bundle):
    raise OSError("no such file")


def _changes(bundle):
    return lambda s: s + "!"


@pytest.mark.parametrize("opener, why", [(_breaks, "no such file"), (_changes, "the text came back changed")])
def test_a_failing_backend_changes_nothing(opener, why):
    got = process("мама", _auto(open_bundle=opener))
    assert got.pronunciation == "мама" and not got.decisions
    assert got.warnings == [("stress_backend_unavailable", f"Automatic stress backend unavailable: {why}", 0, 0)]


def test_the_bundle_comes_from_options_or_environment(monkeypatch):
    monkeypatch.delenv(BUNDLE, raising=False)
    assert bundle_of(Options()) is None
    assert [w[1] for w in process("а", Options(language="russian", stress="automatic", open_bundle=_toy)).warnings] == [f"Automatic stress bundle is not configured (set {BUNDLE} or Options.bundle)"]
    monkeypatch.setenv(BUNDLE, "there")
    assert bundle_of(Options()) == "there" and bundle_of(Options(bundle="here")) == "here"
