from __future__ import annotations

import pytest

from carryover.plans.schemas import validate

GOOD = {"gate": "block", "allowlist": ["github-pat"], "satellites": [{"satellite_id": "abcdefgh", "path": "/x"}, {"satellite_id": "abcdefg2", "path": None, "label": "l"}]}


def test_settings():
    validate("settings", GOOD)
    validate("settings", {"gate": "pass"})


@pytest.mark.parametrize(
    "change,place",
    [({"gate": "maybe"}, "/gate"), ({"gate": None}, "/gate"), ({"other": 1}, "/other"), ({"allowlist": "x"}, "/allowlist"), ({"allowlist": [1]}, "/allowlist/0"), ({"satellites": [{"path": "x"}]}, "/satellites/0/satellite_id"), ({"satellites": [{"satellite_id": "a b", "path": "x"}]}, "/satellites/0/satellite_id"), ({"satellites": [{"satellite_id": "a", "path": 3}]}, "/satellites/0/path")],
)
def test_faults_name_the_place(change, place):
    with pytest.raises(ValueError, match=f"settings: {place} "):
        validate("settings", GOOD | change)


def test_no_object():
    for bad in (None, [], "x", 1):
        with pytest.raises(ValueError, match="report: / "):
            validate("report", bad)
    with pytest.raises(ValueError, match="report: /digest "):
        validate("report", {})
