"""No part of an address survives its surrogate; given names keep their gender where it is known."""

import re

import pytest

from granary.llm import personal_data as pd_

ADDRESSES = {
    "42 Cooper Road, Ashfirth, ZQ 00573": ["42", "Cooper", "Ashfirth", "ZQ", "00573"],
    "32 Lantern St., Harlowby, ZQ 00327": ["32", "Lantern", "Harlowby", "ZQ", "00327"],
    "110 Mill Hill Road, Apt 27 - Ashfirth ZZ1 3QQ": ["110", "Mill", "Hill", "27", "Ashfirth", "ZZ1", "3QQ"],
    "Lindenstrasse 83 b, 02258 Altwerda": ["Linden", "83", "02258", "Altwerda"],
    "Am Speicher 14\nD-04330 Altwerda": ["Speicher", "14", "04330", "Altwerda"],
    "8 bis, boulevard de la Cale, 99481 Saint-Oréal": ["Cale", "99481", "Saint", "Oréal"],
    "C/ Olmo Viejo, 155, 99928 Salvaterra": ["Olmo", "Viejo", "155", "99928", "Salvaterra"],
}


@pytest.mark.parametrize("surface", ADDRESSES)
def test_every_part_of_an_address(surface):
    canonical = " ".join(pd_._fold(surface).split())
    given = pd_.entity_surrogate("address", canonical, b"k")
    out = pd_.formatted("address", surface, given)
    assert [p for p in ADDRESSES[surface] if re.search(rf"(?<!\d){p}(?!\d)", out, re.I)] == []
    assert out == pd_.formatted("address", surface, given) and out.count(",") == surface.count(",") and out.count("\n") == surface.count("\n")
    assert out != pd_.formatted("address", surface, pd_.entity_surrogate("address", canonical, b"other"))


def test_gender():
    ends = {"f": ("ina", "ela", "ara", "isa"), "m": ("ino", "ert", "omar", "us")}
    for name, gender in (("carmen", "f"), ("ines", "f"), ("noor", "f"), ("luca", "m")):
        assert {pd_.entity_surrogate("given", name, str(i).encode()).endswith(ends[gender]) for i in range(40)} == {True}
    assert pd_.entity_surrogate("given", "sixte", b"k", 0, "m").endswith(ends["m"])
    assert len({pd_.entity_surrogate("given", "sixte", str(i).encode()).endswith(ends["m"]) for i in range(40)}) == 2
