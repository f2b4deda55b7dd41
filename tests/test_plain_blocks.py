import random

import yaml

from tracewright.sources import markdown

ROWS = """status: accepted|tags: [A, N]|e: []|modality: 'MUST'|x: 'a: b # c'|n: 0012|d: 2024-01-01|y: yes|on: 1|k:|k:  |l: [a b, c/d]|t: [no, 1]|s: a  b|z: ''|q: a - b|w: 1.5e3|N: ~
v: a, b|z: a:b|p: - x|a-b: c |l2: [a]  |B: [yes]|f: a.b/c-d|g: [ a]|h: [a,b]|null: 1|r: Null|i: ' x '|c: .5|j: "a"|o: a #b|o: a#b|m: {a: b}|z: 'it''s'|  s: t|# note""".replace("\n", "|").split("|")


def test_plain_blocks_are_read_as_yaml_reads_them():
    rng, taken = random.Random(3), 0
    for _ in range(4000):
        block = "".join(row + "\n" for row in rng.sample(ROWS, rng.randint(1, 4)))
        got = markdown.plain(block)
        if got is not None:
            taken += 1
            want = markdown.decode_yaml(block)
            assert got == want and list(got[0]) == list(want[0]), block
    assert taken > 300


def test_plain_blocks_need_no_yaml(monkeypatch):
    monkeypatch.setattr(yaml, "compose", None)
    monkeypatch.setattr(yaml, "load", None)
    monkeypatch.setattr(markdown, "decode_yaml", None, raising=False)
    assert markdown.decode("status: 'accepted'\ntags: [A, N]\n") == ({"status": "accepted", "tags": ["A", "N"]}, {"status": 2, "tags": 3})
