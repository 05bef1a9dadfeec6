"""The catalogue against the list of counters in FIXTURES.md, names and units."""

from __future__ import annotations

import os
import re

import pytest

from netkpi.sources import catalog

LIST = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "FIXTURES.md")
NUMBERS = {
    "lte_daily": "R1", "lte_daily1": "R2", "lte_emtc": "R3", "lte_operator": "R4",
    "umts_daily": "R5", "umts_daily1": "R6", "umts_operator": "R7",
}


@pytest.mark.parametrize("name", sorted(NUMBERS))
def test_counters_of_a_report(name):
    with open(LIST) as f:
        text = f.read()
    [part] = re.findall(rf"^### {NUMBERS[name]} .*?\n(.*?)(?=^### |\Z)", text, re.M | re.S)
    listed = re.findall(r"^\| \d+ \| `(.*?)` \|", part, re.M)
    assert listed == [c.label for c in catalog.REPORTS[name].counters]
