"""Licence templates take whole mandatory wording: each is accepted as it is and rejected with one mandatory word changed, left out or added."""

import random
import re

import pytest

from tidemark.llm import license_scan

FULL = [(label, t) for label, t in license_scan.TEMPLATES if not label.startswith("name:") and len(t.split()) > 20]


def filled(template, rng):
    """A text of the template with its optional regions in or out, and the places of its mandatory words."""
    out, places, depth, keep = [], [], 0, True
    for part in re.findall(r"\[\[|\]\]|<<\d+-\d+>>|[^\s\[\]<>]+", template):
        if part == "[[":
            depth, keep = depth + 1, rng.random() < 0.5
        elif part == "]]":
            depth, keep = depth - 1, True
        elif not keep:
            continue
        elif part.startswith("<<"):
            low, high = map(int, part[2:-2].split("-"))
            out += [f"holder{k}" for k in range(rng.randint(low, high))]
        else:
            if not depth:
                places.append(len(out))
            out.append(part)
    return out, places


def labels(ws, nets=license_scan.automata()):
    text = "Before, the text. " + " ".join(w.upper() if k % 3 else w + "," for k, w in enumerate(ws)) + ". And after"
    return {s.label for s in license_scan.scan(text, nets)[1] if not s.base}


@pytest.mark.parametrize("label,template", FULL, ids=[label for label, _ in FULL])
def test_whole_wording_is_accepted_and_one_changed_word_is_not(label, template):
    rng = random.Random(7)
    for _ in range(6):
        ws, places = filled(template, rng)
        assert label in labels(ws)
        for at in [places[0], places[-1], *rng.sample(places, 12)]:
            assert label not in labels([*ws[:at], "zz9", *ws[at + 1:]])
        inner = [k for k in places[1:] if k - 1 in places]
        for at in rng.sample(inner, 6):
            assert label not in labels(ws[:at] + ws[at + 1:]) or ws[at] == ws[at - 1]
            assert label not in labels([*ws[:at], "zz9", *ws[at:]])


def test_texts_of_other_licences_with_the_same_opening():
    parts = dict(FULL)
    mit, zero, three = (filled(parts[k], random.Random(1))[0] for k in ("mit", "mit-0", "bsd-3"))
    assert labels(mit) == {"mit"} and labels(zero) == {"mit-0"} and labels(three) == {"bsd-3"}
    at = " ".join(mit).index(" the software is provided as is")
    evil = (" ".join(mit)[:at] + " the software shall be used for good not evil" + " ".join(mit)[at:]).split()
    assert labels(evil) == set() and labels(mit[:60]) == set()
    assert labels("the gnu lesser general public license".split()) == {"name:lgpl"}
