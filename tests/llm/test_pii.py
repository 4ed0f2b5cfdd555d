import hashlib
import random
import re

import pytest

from claimweave.llm import pii

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(digits[::-1])) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        spans = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {0: True, 1: all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True, 2: 16 <= len(digits) <= 19 and luhn(digits or "0"), 3: 8 <= len(digits) <= 15}[kind]
            if good:
                spans.append(m.span())
        out.append(spans)
    return out


def test_base_patterns():
    chance = random.Random(3)
    for _ in range(20_000):
        text = "".join(chance.choice("ab1290.@+- ()%5") for _ in range(chance.randint(0, 40)))
        assert pii.find(text) == brute(text), text


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write to bob.smith [at] mail [dot] example [dot] com now", "email", "bob.smith [at] mail [dot] example [dot] com"),
        ("bob at example dot com", "email", "bob at example dot com"),
        ("x (AT) mail.org!", "email", "x (AT) mail.org"),
        ("jane.d at example.com ok", "email", "jane.d at example.com"),
        ("ask jаne@example.com", "email", "jаne@example.com"),  # a Cyrillic letter
        ("bob＠exаmple．com", "email", "bob＠exаmple．com"),
        ("bob​@mail.example.com", "email", "bob​@mail.example.com"),
        ("hsr.29&#64;mail5.example.com", "email", "hsr.29&#64;mail5.example.com"),
        ("at 192[.]168[.]1[.]20 now", "ip", "192[.]168[.]1[.]20"),
        ("one nine two dot one six eight dot one dot two zero", "ip", "one nine two dot one six eight dot one dot two zero"),
        ("card four zero four one eight nine four nine seven four six zero eight seven nine five", "card", "four zero four one eight nine four nine seven four six zero eight seven nine five"),
        ("４０４１８９４９７４６０８７９５", "card", "４０４１８９４９７４６０８７９５"),
        ("call plus one five five five one two three four five six seven", "phone", "plus one five five five one two three four five six seven"),
        ("+1 (nine eight eight) 555-2485", "phone", "+1 (nine eight eight) 555-2485"),
        ("+eins fünf fünf fünf zwei drei vier sechs sieben", "phone", "+eins fünf fünf fünf zwei drei vier sechs sieben"),
    ],
)
def test_disguises(text, kind, found):
    base, every = pii.spans(text)
    added = [text[a:b] for a, b in every[pii.KINDS.index(kind)] if (a, b) not in base[pii.KINDS.index(kind)]]
    assert added == [found]


@pytest.mark.parametrize("text", ["anna at firma dot cloud", "write to bob at work dot shop today", "ann AT example DOT berlin"])
def test_any_host_end_after_two_spelled_signs(text):
    _, every = pii.spans(text)
    assert [text[a:b].split()[1].lower() for a, b in every[0]] == ["at"]


@pytest.mark.parametrize("text", [
    "meet us at example.com please", "look at it dot by dot", "un un un un un un un un un un un un un un un un", "one two three four", "Привет, мир", "at 3.5 or 10.2.3 of it",
    "chapter one. two at a time.", "x@y", "no numbers", "été à la mer",
])
def test_clean_texts(text):
    assert pii.spans(text) == ([[], [], [], []], [[], [], [], []])


def test_offsets_are_of_the_source():
    text = "é東 " * 50 + "see bob [at] mail [dot] com​ and plus four nine one two three four five six seven eight, " + "jane@x.org"
    base, every = pii.spans(text)
    assert [text[a:b] for a, b in every[0]] == ["bob [at] mail [dot] com", "jane@x.org"] and [text[a:b] for a, b in base[0]] == ["jane@x.org"]
    assert [text[a:b] for a, b in every[3]] == ["plus four nine one two three four five six seven eight"]


def test_query_columns(make_docs, odd_rows):
    rows = [*odd_rows, (20, "a@b.c, 1.2.3.4 and +1 234 567 89 10; 4041 8949 7460 8795"), (20, "a@b.c")]
    found = pii.personal_data(make_docs(rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        parts = [s for s in r.spans.split(",") if s]
        assert [sum(p.startswith(k) for p in parts) for k in pii.KINDS] == [r.n_email, r.n_ip, r.n_card, r.n_phone]
    nothing = hashlib.sha256(b"").hexdigest()
    assert sum(r.base_sha256 == nothing and r.spans == "" for r in found) == len(odd_rows)
    full = next(r for r in found if r.n_ip)
    assert full.base_sha256 == hashlib.sha256(full.spans.encode()).hexdigest() and (full.n_email, full.n_ip, full.n_card, full.n_phone) == (1, 1, 1, 1)
    assert pii.personal_data(make_docs([])).collect() == []


def test_long_runs_are_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1 " * 100_000 + "one two three", "+1" + " " * 100_000, "@" * 50_000, "one " * 50_000, "1." * 100_000):
        pii.spans(text)
