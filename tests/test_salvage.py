"""Whole objects of broken responses, against json's decoder, one object after another."""

import json
import random
import re

from glossaria.operators import salvage as salvage_module
from glossaria.operators.parse import notes, parsed, rejects
from glossaria.operators.salvage import whole_elements
from test_flashcards import _documents

_GAP = re.compile(r"[ \t\n\r]*")


def one_after_another(text):
    """The texts of the objects and nulls before the first error, and whether there is an error."""
    at, out = _GAP.match(text).end(), []
    if text[at : at + 1] != "[":
        return out, True
    at = _GAP.match(text, at + 1).end()
    if text[at : at + 1] == "]":
        return out, _GAP.match(text, at + 1).end() != len(text)
    while True:
        if text[at : at + 1] not in ("{", "n"):
            return out, True
        try:
            _, end = json.JSONDecoder(parse_constant=lambda x: json.loads("?")).raw_decode(text, at)
        except ValueError:
            return out, True
        out.append(text[at:end])
        at = _GAP.match(text, end).end()
        if text[at : at + 1] == "]":
            return out, _GAP.match(text, at + 1).end() != len(text)
        if text[at : at + 1] != ",":
            return out, True
        at = _GAP.match(text, at + 1).end()


def test_every_prefix_of_responses():
    rng = random.Random(2)
    for text in [*_documents(rng, 60), '[{"a":{"b":[1,-2.5e+3,true,"x\\u00e9\\"]"]}},null,{"c":"\\\\"},{}] ', '[{"é":"🙂\\ud83d"},{"a":[]}]']:
        for cut in range(len(text) + 1):
            spans, at = whole_elements(text[:cut])
            want, broken = one_after_another(text[:cut])
            assert ([text[a:b] for a, b in spans], at is not None) == (want, broken), text[:cut]
            assert at is None or (spans[-1][1] if spans else 0) <= at <= cut


def test_broken_responses():
    rng = random.Random(3)
    for text in _documents(rng, 4000):
        spans, at = whole_elements(text)
        assert ([text[a:b] for a, b in spans], at is not None) == one_after_another(text), text


def test_places_of_errors():
    good = '[{"Word":"a","n":1}'
    for rest, at in ((",", 1), ("", 0), (" x", 1), (',{"b"', 5), (',{"b', 2), (',{"b":tru', 6), (',{"b":tru}', 6), (",3]", 1), ("]]", 1), ("}", 0), (',{"b":"\\q"}]', 7), (',{"b":"\x01"}]', 7), (",{'b':1}]", 2), (',{"b" 1}]', 6)):
        assert whole_elements(good + rest) == ([(1, len(good))], len(good) + at), rest
    assert whole_elements(good + "]") == ([(1, len(good))], None)
    assert whole_elements("") == ([], 0) and whole_elements("  ") == ([], 2) and whole_elements('```json\n[]') == ([], 0)


def test_an_error_is_where_no_continuation_helps():
    """What stands before the error can be continued to a valid array, unless a token is cut short at the end."""
    rng = random.Random(6)
    closers = ['"}]', "}]", "]", ":1}]", "1}]", '{"a":1}]', '"a":1}]', '":1}]', "null]", "[]", "[{}]", "]}]", "1]}]", "", '"b":2}]', "}}]", '"}}]', "1}}]", ":1}}]", '":1}}]', '"x":1}}]']
    checked = 0
    for text in _documents(rng, 3000):
        _, at = whole_elements(text)
        if at is None or at == len(text) or not text[:at].isascii():
            continue
        checked += any(not one_after_another(text[:at] + c)[1] for c in closers)
        assert one_after_another(text[: at + 1] + "")[1] or text[at : at + 1].isspace()
    assert checked > 500


def test_salvage_in_spark(spark):
    texts = list(_documents(random.Random(7), 300)) + [None, '[{"Word":"a","Word":"b","Sentences":"s","Meaning":"m","Pronunciation":"p"}']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, response string")
    for parser in ("native", "python"):
        got = {}
        for r in parsed(rows, parser, ("i",), True).orderBy("i", "pos").collect():
            got.setdefault(r["i"], []).append((r["pos"], r["Word"], r["problem"], r["at"]))
        for i, text in enumerate(texts):
            items, broken = one_after_another(text) if text is not None else ([], True)
            want = [(k, (x or {}).get("Word"), None if x and all(f in x for f in ("Word", "Sentences", "Meaning", "Pronunciation")) else "?") for k, x in enumerate(map(json.loads, items))]
            found = got.get(i, [])
            assert len(found) == len(want) + broken, (parser, text)
            assert [(p, w if w is None or isinstance(w, str) else w, q and "?") for p, w, q, _ in found[: len(want)]] == [(p, w if w is None or isinstance(w, str) else json.dumps(w), q) for p, w, q in want], (parser, text)
            if broken:
                assert found[-1][2] == "document" and (found[-1][3] is None) == (text is None)
    kept = notes(rows, "salvage", carry=("i",)).where(f"i = {len(texts) - 1}").collect()
    assert [r["Word"] for r in kept] == ["b"]
    left = rejects(rows, carry=("i",), salvaging=True).where(f"i = {len(texts) - 1}").collect()
    assert [(r["pos"], r["reason"], r["raw"], r["at"]) for r in left] == [(1, "document", "", len(texts[-1]))]


def test_members_given_twice(spark):
    rows = spark.createDataFrame([(0, '[{"Word":"a","Word":null,"Sentences":"s","Meaning":"m","Meaning":"n","Pronunciation":"p"}]')], "i int, response string")
    for parser in ("native", "python"):
        r = parsed(rows, parser, ("i",)).first()
        assert (r["Word"], r["Meaning"], r["problem"]) == (None, "n", None)


def test_responses_of_one_file_are_salvaged_by_several_tasks(spark):
    rows = spark.createDataFrame([(i, '[{"Word":"a"},{"b') for i in range(100)], "i int, response string").coalesce(1)
    found = parsed(rows, carry=("i",), salvaging=True)
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and found.count() == 200


def test_plain_objects_are_not_taken_apart(monkeypatch):
    """A response of many objects costs a few tokens for each, and gives what goes token by token in nested ones too."""
    seen = []

    class Counted:
        @staticmethod
        def match(text, at):
            seen.append(at)
            return token.match(text, at)

    token = salvage_module._TOKEN
    monkeypatch.setattr(salvage_module, "_TOKEN", Counted)
    plain, nested = '{"a":"b\\"","c":-1.5}', '{"a":["b"]}'
    text = "[" + ",".join([plain] * 50 + [nested] + [plain] * 50) + ',{"a'
    spans, at = whole_elements(text)
    assert [text[a:b] for a, b in spans] == [plain] * 50 + [nested] + [plain] * 50 and at == len(text) - 2
    assert len(seen) < 220
