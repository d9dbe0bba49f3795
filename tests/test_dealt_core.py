"""Problems 5 and 6 on whole and defective tables."""

from __future__ import annotations

from types import SimpleNamespace

import pytest
from pyspark.sql import Row

from reefglass.functions import units as U
from reefglass.operators import eav_wide, units
from reefglass.operators.spec_keys import Registry, key_votes
from reefglass.plans import catalog

P = [n for n in catalog.queries() if n.startswith("p")and n[1].isdigit()]


@pytest.mark.parametrize("variant", ["plain", "empty", "all_empty", "nulls", "extra", "one_key"])
@pytest.mark.parametrize("name", P)
def test_variants(spark, variants, name, variant):
    rows = catalog.queries()[name](spark, variants[variant]).collect()
    if "empty" in variant:
        assert not rows
    if variant in ("plain", "extra"):
        assert rows
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))


def test_extra_columns_change_nothing(spark, variants):
    for name in ("p5_found", "p6_found"):
        q = catalog.queries()[name]
        assert set(q(spark, variants["plain"]).collect()) == set(q(spark, variants["extra"]).collect())


@pytest.mark.parametrize(
    ("text", "number", "unit"),
    [
        ("9.9 kg", 9.9, "kg"), ("kg 12", 12.0, "kg"), ("1,760", 1760.0, ""), ("385,7", 385.7, ""), ("0,434 L", 0.434, "l"), ("1,234,567 MB", 1234567.0, "mb"),
        ("about ٦ Mo.", 6.0, "mo"), ("(62.7 square metres)", 62.7, "squaremetres"), ("12m2 only", 12.0, "m2"), ("m2 45.5", 45.5, "m2"), ("-9,9 °C", -9.9, "°c"),
        ("gallons (US) 9.9", 9.9, "gallonsus"), ("three beds", 3.0, "threebeds"), ("as per drawing", None, "asperdrawing"), ("28-months", 28.0, "months"), ("", None, ""), (None, None, None),
    ],
)
def test_read_quantity(spark, text, number, unit):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([(text,)], "t string").select(U.read_number(F.col("t")).alias("n"), U.text_unit_key(F.col("t")).alias("u")).first()
    assert r.n == number
    if number is not None and text != "three beds":
        assert r.u == unit


@pytest.mark.parametrize(("num", "text", "want"), [(1.0, None, 1.0), (0.0, "", 0.0), (2.0, None, None), (None, " Yes ", 1.0), (None, "ނޫން", 0.0), (None, "maybe", None), (None, "not available", 0.0)])
def test_read_bool(spark, num, text, want):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(num, text)], "n double, t string").select(U.read_bool(F.col("n"), F.col("t")).alias("b")).first().b == want


def test_widen_round_trip(spark):
    """Every cell is found again in the wide table, in its type, over several buckets."""
    registry = [SimpleNamespace(spec_key="w", datatype="numeric"), SimpleNamespace(spec_key="b", datatype="enum"), SimpleNamespace(spec_key="l", datatype="bool")]
    cells = [(i, k, float(i % 2) if k == "l" else i / 3 if k == "w" else None, f"v{i}" if k == "b" else None) for i in range(200) for j, k in enumerate("wbl") if (i + j) % 3]
    df = spark.createDataFrame([*cells, (7, "other", 1.0, None)], "document_id long, spec_key string, num double, text string")
    got = {r.document_id: r for r in eav_wide.widen(df, registry, 5).collect()}
    back = {(i, k) for i, r in got.items() for k in "wbl" if r[k] is not None}
    assert back == {(i, k) for i, k, *_ in cells}
    assert all(got[i][k] == (bool(n) if k == "l" else n if k == "w" else t) for i, k, n, t in cells)


def test_keys_are_learned_by_vote(spark):
    reg = Registry([Row(key_id=1, spec_key="brand", label_en="Brand", label_dv="x", datatype="enum", unit="", unit_code=None, unit_aliases=[], value_aliases="{}")], {}, {"kg": {"kg"}})
    rows = [("maker", 1)] * 3 + [("maker", None), ("Weight [kg]", None), (None, 1)]
    got = {r.vote_form: r.vote_id for r in key_votes(spark.createDataFrame(rows, "key_raw string, key_id long"), reg).collect()}
    assert got == {"maker": 1}


def test_unit_mixture_follows_values_against_a_weak_prior():
    """Unitless values a thousand times too large for the default unit are given to the smaller one."""

    class Rows:
        def where(self, *_):
            return self

        groupBy = agg = where  # noqa: N815

        def collect(self):
            row = lambda key, unit, b, n: Row(spec_key=key, source="s", written_unit=unit, note_unit=None, common_unit="kg", bin=b, n=n)
            light = [row("light", "kg", b, 100) for b in (-2, 0, 2)] + [row("light", None, b, 5000) for b in (26, 28, 30)]
            heavy = [row("heavy", "kg", b, 100) for b in (26, 28, 30)] + [row("heavy", None, b, 5000) for b in (26, 28, 30)]
            return light + heavy

    import unittest.mock as mock

    attributes = [SimpleNamespace(spec_key=k, unit_code="kg") for k in ("light", "heavy")]
    reg = Registry(attributes, {"kg": ("mass", 1.0, 0.0), "g": ("mass", 0.001, 0.0)}, {})
    with mock.patch.object(units, "F"), mock.patch.object(units, "_bin"):
        fitted = units.fit_units(Rows(), reg, ["s"])
    best = {(key, b): max((p, c) for k, s, bb, c, p in fitted if bb == b and k == key)[1] for key in ("light", "heavy") for b in (26, 28, 30)}
    assert {k: {c for (key, _), c in best.items() if key == k} for k in ("light", "heavy")} == {"light": {"g"}, "heavy": {"kg"}}


def test_notes_name_units(spark):
    reg = Registry([], {"g": ("mass", 1, 0), "mm": ("length", 1, 0), "sqft": ("area", 1, 0), "ft": ("length", 1, 0), "in": ("length", 1, 0), "degf": ("temperature", 1, 0)}, U.spelling_codes([]))
    notes, known = units.note_units(spark.createDataFrame([("a", "Weights are grams, lengths millimetres."), ("b", "Floor area is in square feet."), ("c", "Registry units."), ("d", "degrees Fahrenheit meant"), ("e", None)], "source string, note string"), reg)
    assert notes == {"a|mass": "g", "a|length": "mm", "b|area": "sqft", "d|temperature": "degf"}
    assert known == list("abcde")
