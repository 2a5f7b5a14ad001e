"""Notices count as lost, and long lines are judged too."""

from tidemark.llm import quality


def test_only_notices_are_rejected():
    lines = [f"Copyright (c) 20{k} by company number {k}, all rights reserved." for k in range(10, 20)]
    text, faults, kept = quality.clean("\n".join(lines))
    assert text == "" and {r for _, r in faults} == {"notice"} and not kept


def test_a_footer_of_both_kinds_is_boilerplate():
    assert quality.line_fault("All rights reserved. Privacy policy. Click here") == "boilerplate"


def test_long_lines():
    footer = "All rights reserved by the company. Read our privacy policy today. Click here for more. Accept all cookies now. " * 6
    assert quality.line_fault(footer) == "boilerplate" and not quality.clean(footer)[2]
    assert quality.line_fault(footer.replace(".", "")) == "boilerplate"
    prose = "This sentence tells something about the town and its people. " * 10 + "Click here for more."
    assert quality.line_fault(prose) is None
    for n in range(1, 12):  # one phrase among sentences condemns none of them, at any length
        line = "This sentence tells something about the town and its people. " * n + "Click here for more now."
        assert quality.line_fault(line) is None
    assert quality.line_fault("Click here for more now. It is a town.") == "boilerplate"


def test_prose_without_any_mark():
    assert quality.line_fault("one two three four five six seven eight nine") == "unpunctuated"
    assert quality.line_fault("one two three, four five six seven eight nine") is None and quality.line_fault("one two three four five six seven.") is None
