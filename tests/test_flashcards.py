"""The flashcard operators: against SQL, against json.loads, and on fixtures of their own."""

import json
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from glossaria.functions.cards import back_html, front_html
from glossaria.functions.text import needs_choice, plain_text, random_pick, seeded_pick, sentence_list
from glossaria.operators.parse import accumulated, notes, parsed, rejects
from glossaria.operators.respond import answers as answers_at
from glossaria.operators.respond import compose, replay, respond, with_key
from glossaria.operators.state import shown
from glossaria.plans.queries import CASES, ORACLE_SQL, QUERIES
from glossaria.sources import files, sinks
from glossaria.streaming.session_state import stream_choices

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    ours = QUERIES[name](spark, SF)
    columns = sorted(ours.columns)
    want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in ours.collect()))) == sorted(map(repr, want))


def test_strict_parse_cases(spark):
    found = {r["name"]: r["outcome"] for r in QUERIES["strict_parse_cases"](spark, SF).collect()}
    assert found == {name: outcome for name, _, outcome in CASES}


def _outcomes(spark, texts, parser):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, response string")
    out = {}
    for r in parsed(rows, parser, ("i",)).collect():
        out.setdefault(r["i"], []).append((r["pos"], r["Word"], r["Meaning"], r["problem"] if r["problem"] != "element" else "document"))
    return [sorted(out.get(i, []), key=repr) for i in range(len(texts))]


def _documents(rng, n):
    """JSON of word definitions, some of it broken: cut, or with pieces put in, or with something before or after."""
    letters = 'ab"\\é\n\t{}[],:|<\u2028🙂'
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(5)))
    for _ in range(n):
        items = [{k: word() for k in ("Word", "Sentences", "Meaning", "Pronunciation", "x") if rng.random() < 0.85} for _ in range(rng.randrange(4))]
        text = json.dumps(items, ensure_ascii=rng.random() < 0.5)
        kind, cut = rng.random(), rng.randrange(len(text) + 1)
        if kind < 0.25:
            text = text[:cut] + rng.choice(["x", ",", "]", "[", "}", "{", '"', ":", " ", "\n", "null", "1"]) + text[cut:]
        elif kind < 0.4:
            text = text[:cut] + text[cut + 1 + rng.randrange(3) :]
        elif kind < 0.65:
            text = rng.choice(["", "", " ", "\n"]) + text + rng.choice(["]", "}", "]]", "] junk", "} junk", ",", " \t\n", ',"a":[]', "},[", "],[", "] ],[ [", ":1", "[]", ' "x"', "//", "#", "\x00"])
        elif kind < 0.7:
            text = rng.choice(['{"a":[]}', '[],"b":[]', "[[]]", '[[{"Word":"a"}]]', "[1]", '["a"]', "[null]", "[{},null]", "[] ],[ []", "[}", "]", "}", '[{"Word":1,"Sentences":[],"Meaning":{},"Pronunciation":true}]'])
        yield text


def test_native_parser_equals_json_loads(spark):
    texts = list(_documents(random.Random(4), 600))
    native, python = (_outcomes(spark, texts, parser) for parser in ("native", "python"))
    assert [(t, a, b) for t, a, b in zip(texts, native, python) if a != b] == []
    broken = sum(any(r[3] == "document" for r in x) for x in python)
    assert 150 < broken < 450 and len({repr(x) for x in python}) > 200


def test_modes_of_failure(spark):
    good = json.dumps([dict(Word="a", Sentences="b|c", Meaning="m", Pronunciation="")] * 2)
    bad = json.dumps([dict(Word="a")])
    rows = spark.createDataFrame([("1", good), ("2", bad), ("3", None)], "batch_id string, response string")
    assert notes(rows, "permissive").count() == 2
    assert {(r["batch_id"], r["reason"], r["raw"]) for r in rejects(rows).collect()} == {("2", "missing Sentences,Meaning,Pronunciation", '{"Word":"a"}'), ("3", "document", None)}
    with pytest.raises(Exception, match="bad response"):
        notes(rows).collect()
    assert notes(rows.where("batch_id = '1'")).select("note_key").distinct().count() == 1  # duplicates are kept
    batches = [notes(rows.where("batch_id = '1'"))] * 2
    assert accumulated(batches).count() == 4 and accumulated(batches, False).count() == 2


def test_sentences_and_choices(spark):
    values = [" a |\tb ||﻿c ", "", "||", "one", "​", "a`\\${x}|<strong>b</strong>", None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    found = rows.select("i", "s", sentence_list(F.col("s")).alias("l"), plain_text(F.col("s")).alias("p")).orderBy("i")
    got = found.withColumn("c", seeded_pick(F.col("l"), F.col("i"))).withColumn("r", random_pick(F.col("l"))).collect()
    assert [r["l"] for r in got] == [["a", "b", "c"], [], [], ["one"], ["​"], ["a`\\${x}", "<strong>b</strong>"], None]
    for r in got:
        assert (r["c"] is None) == (not r["l"]) and (r["r"] is None) == (not r["l"])
        assert not r["l"] or (r["c"] in r["l"] and r["r"] in r["l"])
    checks = spark.createDataFrame([(None, ["a"], True), ("", ["a"], True), ("a", ["a"], False), ("z", ["a"], True)], "s string, l array<string>, want boolean")
    assert checks.where(needs_choice(F.col("s"), F.col("l")) != F.col("want")).count() == 0


def test_rendering(spark):
    rows = spark.createDataFrame([("x", None, "m"), (None, "", None), ("<strong>y</strong>", "p", "m")], "c string, p string, m string")
    got = [r[0] for r in rows.select(back_html(front_html(F.col("c")), F.col("p"), F.col("m"))).collect()]
    assert ['class="notes"' in g for g in got] == [False, False, True] and "<strong>y</strong>" in got[2] and not any("<script" in g for g in got)


def test_sources_providers_and_sinks(spark, tmp_path):
    (tmp_path / "words").write_bytes("café\r\nb".encode())
    read = files.whole_text(spark, str(tmp_path / "words")).first()
    assert (read["batch_id"], read["words"]) == ("words", "café\nb")
    composed = compose(files.from_strings(spark, [("1", "a"), ("2", None), ("3", "a")]), "P:")
    answers = respond(composed, lambda: lambda text: f"[] {text}", str(tmp_path / "responses"))
    assert {r["batch_id"]: r["response"] for r in answers.collect()} == {"1": "[] P:a", "2": None, "3": "[] P:a"}
    more = compose(files.from_strings(spark, [("1", "a"), ("4", "b")]), "P:")
    again = respond(more, lambda: lambda text: "later", str(tmp_path / "responses"), calls=1)
    assert {r["batch_id"]: r["response"] for r in again.collect()} == {"1": "[] P:a", "4": "later"}
    assert answers_at(spark, str(tmp_path / "responses")).count() == 2  # equal prompts share an answer
    assert {r["response"] for r in replay(composed, answers).collect()} == {"[] P:a", None}
    sinks.write_latest(answers, str(tmp_path / "latest"))
    for batch in ([("2", "x\ny\n"), ("1", ""), ("3", None)], [("9", "é <break> z")]):
        sinks.append_log(spark.createDataFrame(batch, "batch_id string, response string"), str(tmp_path / "log"))
    assert [r["response"] for r in files.read_log(spark, str(tmp_path / "log")).orderBy("place").collect()] == ["", "x\ny\n", "é <break> z"]
    (tmp_path / "logtext").write_text("\n<break>\nx\n<break>\ny\nz")
    assert [r["response"] for r in files.read_log_text(spark, str(tmp_path / "logtext")).orderBy("place").collect()] == ["x", "y\nz"]
    with pytest.raises(KeyError):
        with_key("NO_SUCH_SETTING", lambda key: lambda text: key)
    os.environ["SOME_SETTING"] = "secret"
    assert with_key("SOME_SETTING", lambda key: lambda text: key + text)()("!") == "secret!"
    sinks.write_package(spark.createDataFrame([("1", 0, "w")], "batch_id string, pos int, Word string"), str(tmp_path / "deck"))
    assert spark.read.json(str(tmp_path / "deck/note_type")).first()["note_type_id"] == 1607392319


EVENTS = [("k", 1, "front"), ("k", 2, "front"), ("k", 3, "back"), ("k", 4, "front"), ("o", 5, "back"), ("o", 6, "front")]


def test_session_window(spark):
    views = spark.createDataFrame([(k, i, i, s) for k, i, s in EVENTS], "key string, ts long, event_id long, side string")
    items = spark.createDataFrame([("k", list("abcdefgh")), ("o", [])], "key string, sentence_list array<string>")
    got = {r["event_id"]: (r["epoch"], r["chosen"]) for r in shown(views, items).collect()}
    assert [got[i][0] for i in range(1, 7)] == [0, 0, 0, 1, 0, 1]
    assert got[1] == got[2] == got[3] and got[1][1] in "abcdefgh" and got[5][1] is None
    stretched = spark.createDataFrame([(k, i * 50_000, i, s) for k, i, s in EVENTS], "key string, ts long, event_id long, side string")
    assert {r["event_id"]: (r["epoch"], r["chosen"]) for r in shown(stretched, items).collect()} == got  # a day's views are one stretch


def test_session_stream(spark, tmp_path):
    rows = [(k, i, s, ["a", "b", "c"] if k == "k" else []) for k, i, s in EVENTS]
    kinds = "key string, event_id long, side string, sentences array<string>"
    spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stream_choices(spark.readStream.schema(kinds).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("choices").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r["event_id"]: r["chosen"] for r in spark.table("choices").collect()}
    assert got[1] == got[2] == got[3] and got[4] in "abc" and got[5] is None and len(got) == 6
    kept = spark.read.format("statestore").load(str(tmp_path / "state")).select("key.key").collect()
    assert [r["key"] for r in kept] == ["k"]  # the last back removed the state of the other


def test_run_keeps_good_notes_and_rejects(spark, tmp_path):
    from glossaria.plans.run import deck_from_responses, make_deck

    good = json.dumps([dict(Word="a", Sentences="<strong>a</strong> b|c", Meaning="m", Pronunciation="p")])
    replies = {"P:1": good, "P:2": "[] trailing", "P:3": "[]"}
    words = files.from_strings(spark, [(w, w) for w in "123"])
    with pytest.raises(Exception, match="bad response"):
        make_deck(words, "P:", lambda: replies.__getitem__, str(tmp_path))
    cards = make_deck(words, "P:", lambda: replies.__getitem__, str(tmp_path), "permissive").collect()
    assert [(r["batch_id"], r["pos"], r["Word"]) for r in cards] == [("1", 0, "a")] and cards[0]["chosen"] in ("<strong>a</strong> b", "c") and cards[0]["front_html"] in cards[0]["back_html"]
    assert [(r["batch_id"], r["raw"]) for r in spark.read.parquet(str(tmp_path / "rejects")).collect()] == [("2", "[] trailing")]
    assert deck_from_responses(spark, str(tmp_path), "permissive").count() == 1
    assert sorted(r["response"] for r in files.read_log(spark, str(tmp_path / "log")).collect()) == sorted(replies.values())  # what the second run didn't ask for isn't logged again
