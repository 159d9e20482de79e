"""The flashcard queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaria.functions.text import needs_choice, random_pick, sentence_list, state_key
from glossaria.operators.cards import cards
from glossaria.operators.contract import checked, checked_forms
from glossaria.operators.coverage import coverage
from glossaria.operators.parse import accumulated, json_rows, notes, parsed, rejects
from glossaria.operators.respond import ask, compose, log_answers, replay, respond, with_key
from glossaria.operators.state import epochs, replayed, shown
from glossaria.plans.run import deck_from_file, make_deck_from_files
from glossaria.schema import DECK_ID, DECK_NAME, FIELDS, NOTE_TYPE_ID, NOTE_TYPE_NAME, TEMPLATE_NAME
from glossaria.sources.files import from_strings, read_log, read_package, whole_text, with_positions
from glossaria.sources.scratch import fresh_folder
from glossaria.sources.sinks import add_to_deck, append_log, read_deck, read_latest, write_latest, write_package
from glossaria.streaming.session_processor import STORE
from glossaria.streaming.session_processor import session_choices as timed_choices
from glossaria.streaming.session_state import stream_choices

PROMPT = "Define each of the following words and answer as a JSON array.\nWords:\n\n"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word definition for every part: sentences with blanks around them, an empty one, and one in bold."""
    part = _table(spark, sf_dir, "part")
    sentences = F.concat_ws("|", F.concat(F.lit(" "), "p_name", F.lit("\t")), "p_type", F.lit(""), F.concat(F.lit("<strong>"), "p_name", F.lit("</strong> "), "p_brand"))
    more = F.when(F.col("p_size") % 4 == 0, F.lit("")).otherwise(F.concat(sentences, F.when(F.col("p_size") % 2 == 0, "|a <strong>b</strong>").otherwise("")))
    spoken = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand"))
    return part.select("p_partkey", "p_size", F.col("p_name").alias("Word"), more.alias("Sentences"), F.col("p_type").alias("Meaning"), spoken.alias("Pronunciation"))


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response for every part: its definition, for some a second meaning of the same word, for some the first again."""
    one = F.struct(*FIELDS)
    other = F.struct("Word", "Sentences", F.concat(F.lit("other "), "Meaning").alias("Meaning"), "Pronunciation")
    objects = F.when(F.col("p_size") % 6 == 0, F.array(one, other, one)).when(F.col("p_size") % 2 == 0, F.array(one, other)).otherwise(F.array(one))
    return _definitions(spark, sf_dir).select("p_partkey", F.to_json(objects).alias("response"))


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(_responses(spark, sf_dir), carry=("p_partkey",))


_DEFINITIONS_SQL = r"""
WITH one AS (
  SELECT p_partkey, p_size, 0 AS pos, p_name AS "Word", p_type AS "Meaning",
    CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS "Pronunciation",
    CASE WHEN p_size % 4 = 0 THEN '' ELSE ' ' || p_name || chr(9) || '|' || p_type || '||<strong>' || p_name || '</strong> ' || p_brand
      || CASE WHEN p_size % 2 = 0 THEN '|a <strong>b</strong>' ELSE '' END END AS "Sentences"
  FROM part),
raw AS (
  SELECT * FROM one
  UNION ALL SELECT * REPLACE (1 AS pos, 'other ' || "Meaning" AS "Meaning") FROM one WHERE p_size % 2 = 0
  UNION ALL SELECT * REPLACE (2 AS pos) FROM one WHERE p_size % 6 = 0),
defs AS (
  SELECT *, list_filter(list_transform(string_split("Sentences", '|'),
    lambda x: regexp_replace(x, '^[\t\n\x0B\f\r\p{Z}\x{FEFF}]+|[\t\n\x0B\f\r\p{Z}\x{FEFF}]+$', '', 'g')), lambda x: x <> '') AS items FROM raw),
picked AS (
  SELECT *, CASE WHEN len(items) > 0 THEN items[1 + ('0x' || substr(md5("Word"), 1, 8))::BIGINT % len(items)] END AS chosen FROM defs),
fronts AS (
  SELECT *, '<div class="sentence" style="text-align: center;">' || coalesce(chosen, '') || '</div>' AS front_html FROM picked),
backs AS (
  SELECT *, '<div style="text-align: center;">' || chr(10) || front_html || chr(10) || '<hr>' || chr(10)
    || CASE WHEN "Pronunciation" <> '' THEN '<div class="notes"><i>' || "Pronunciation" || '</i></div>' || chr(10) ELSE '' END
    || '<div class="meaning">' || "Meaning" || '</div>' || chr(10) || '</div>' AS back_html FROM fronts)
"""


def prompt_compose(spark, sf_dir):
    return compose(_table(spark, sf_dir, "benchmark"), PROMPT, "text").select("item_id", "model_input", "prompt_sha")


def json_explode_events(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("["), "props", F.lit("]")).alias("items"))
    return json_rows(events, "items", "struct<k:bigint>", ("event_id",)).select("event_id", "pos", F.col("item.k").alias("k"))


def notes_from_response(spark, sf_dir):
    return _notes(spark, sf_dir).select("p_partkey", "pos", *FIELDS)


def sentence_split(spark, sf_dir):
    items = _table(spark, sf_dir, "documents").select("doc_id", sentence_list(F.col("text")).alias("items"))
    return items.select("doc_id", F.posexplode("items").alias("pos", "sentence"))


def sentence_choice(spark, sf_dir):
    return cards(_notes(spark, sf_dir)).select("p_partkey", "pos", "chosen")


def random_choice(spark, sf_dir):
    """Whether a random pick is one of the sentences, or none where there is none: the pick itself differs in each run."""
    items = _definitions(spark, sf_dir).withColumn("items", sentence_list(F.col("Sentences"))).withColumn("pick", random_pick(F.col("items")))
    member = F.coalesce(F.array_contains("items", F.col("pick")), F.size("items") == 0)
    return items.select("p_partkey", member.alias("member"))


def sentence_membership(spark, sf_dir):
    items = _definitions(spark, sf_dir).withColumn("sentence_list", sentence_list(F.col("Sentences")))
    stored = F.when(F.col("p_size") % 5 == 0, F.lit(None)).when(F.col("p_size") % 5 == 1, "").when(F.col("p_size") % 5 == 2, "stale").otherwise(F.col("Meaning"))
    return items.select("p_partkey", needs_choice(stored, F.col("sentence_list")).alias("redraw"))


def state_key_plain_text(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", state_key(F.col("html")).alias("key"))


def front_render(spark, sf_dir):
    return cards(_notes(spark, sf_dir)).select("p_partkey", "pos", "Word", "front_html")


def back_render(spark, sf_dir):
    return cards(_notes(spark, sf_dir)).select("p_partkey", "pos", "template_name", "back_html")


def deck_accumulate(spark, sf_dir):
    every = _notes(spark, sf_dir)
    return accumulated([every.where("p_partkey % 2 = 0"), every]).select("batch_order", "p_partkey", "pos", "Word")


def log_entries(spark, sf_dir):
    """A log appended to twice, in four files each time, and read back in order."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("response"))
    path = fresh_folder(spark, "log")
    for rest in (0, 1):
        append_log(turns.where(F.col("conv_id") % 2 == rest), path, ("conv_id", "turn", "response"), files=4)
    return with_positions(read_log(spark, path)).select(F.col("pos").cast("int").alias("pos"), F.col("response").alias("entry"))


def log_of_calls(spark, sf_dir):
    """The log of three calls, of which the second asks for a third of the prompts and the last for nothing new."""
    items = _table(spark, sf_dir, "benchmark").select(F.lpad(F.col("item_id").cast("string"), 12, "0").alias("batch_id"), "item_id", F.col("text").alias("words"))
    composed, path = compose(items, PROMPT), fresh_folder(spark, "calls")
    for some in (composed.where("item_id % 3 <> 0"), composed, composed):
        ask(some, lambda: lambda text: f"{len(text)} {text[-40:]}", f"{path}/answers")
        log_answers(some, f"{path}/answers", f"{path}/log")
    return with_positions(read_log(spark, f"{path}/log")).select("pos", F.col("response").alias("entry"))


def latest_responses(spark, sf_dir):
    """Responses published twice: the second ones are read."""
    path, responses = fresh_folder(spark, "latest"), _responses(spark, sf_dir)
    write_latest(responses.where("p_partkey % 2 = 0"), path)
    write_latest(responses.where("p_partkey % 2 = 1"), path)
    return notes(read_latest(spark, path), carry=("p_partkey",)).select("p_partkey", "pos", "Word")


def deck_growth(spark, sf_dir):
    """A deck that lives on: two batches are added, and the first of them again."""
    every, path = _notes(spark, sf_dir), fresh_folder(spark, "deck")
    for key, rows in (("even", every.where("p_partkey % 2 = 0")), ("all", every), ("even", every.where("p_partkey % 2 = 0"))):
        add_to_deck(rows, path, key)
    return read_deck(spark, path).select("batch_order", "batch_key", "p_partkey", "pos", "Word")


def notes_from_file(spark, sf_dir):
    """Saved responses, a JSON file for the parts of each size, to notes and cards."""
    path = fresh_folder(spark, "saved")
    rows = F.sort_array(F.collect_list(F.struct("p_partkey", *FIELDS)))
    saved = _definitions(spark, sf_dir).groupBy("p_size").agg(F.to_json(F.transform(rows, lambda r: F.struct(*(r[f].alias(f) for f in FIELDS)))).alias("value"))  # a file holds what its size has
    saved.repartition("p_size").write.partitionBy("p_size").text(f"{path}/responses")
    return deck_from_file(spark, f"{path}/responses", path).select("pos", "Word", "Meaning", "chosen", "front_html")


def keyed_provider(spark, sf_dir):
    """A provider that takes its key from a named setting, and the strings asked about given from memory."""
    os.environ.setdefault("GLOSSARIA_TRIAL_KEY", "trial")
    regions = [(str(r["r_regionkey"]), r["r_name"]) for r in _table(spark, sf_dir, "region").collect()]  # five rows
    composed = compose(from_strings(spark, regions), PROMPT)
    answered = respond(composed, with_key("GLOSSARIA_TRIAL_KEY", lambda key: lambda text: f"{key[:0]}{len(text)}"), fresh_folder(spark, "keyed"))
    return answered.select("batch_id", "words", "response")


def package_status(spark, sf_dir):
    """What writing the package returns, and how many notes are then there for each word."""
    path = fresh_folder(spark, "package")
    status = write_package(_notes(spark, sf_dir).withColumnRenamed("p_partkey", "batch_id"), path)
    found = read_package(spark, path)[0].groupBy("Word").agg(F.count(F.lit(1)).alias("n"))
    return found.select("Word", "n", F.lit(status.removeprefix(path)).alias("status"))


def text_sources(spark, sf_dir):
    """Files of words with line ends of two characters, a folder for each item, read whole."""
    path = fresh_folder(spark, "words")
    lines = _table(spark, sf_dir, "benchmark").select("item_id", F.concat("text", F.lit("\r\nsecond\rthird")).alias("value"))
    lines.repartition("item_id").write.partitionBy("item_id").text(path)
    return whole_text(spark, path).select(F.col("item_id").cast("long").alias("item_id"), "words")


def _write_text(df: DataFrame, path: str) -> str:
    df.coalesce(1).write.text(path)
    return path


def recorded_definitions(model_input: str) -> str:
    """A provider that needs no network: two meanings for each line of words after the prompt's last blank line."""
    words = [w for w in model_input.rpartition("\n\n")[2].split("\n") if w]
    return json.dumps([{"Word": w, "Sentences": f"A <strong>{w}</strong>.|The {w} here", "Meaning": f"{kind} {w}", "Pronunciation": "" if kind == "first" else w.lower()} for w in words for kind in ("first", "second")])


def run_deck(spark, sf_dir):
    """The whole run over files: the nations of each region are a list of words, from the prompt's file to the cards."""
    path = fresh_folder(spark, "run")
    nations = _table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.array_join(F.sort_array(F.collect_list("n_name")), "\n").alias("value"))  # five regions
    nations.repartition("region").write.partitionBy("region").text(f"{path}/words")
    _write_text(spark.createDataFrame([(PROMPT.rstrip("\n") + "\n",)], "value string"), f"{path}/prompt")
    out = make_deck_from_files(spark, f"{path}/words", f"{path}/prompt", lambda: recorded_definitions, f"{path}/out")
    return out.select("pos", "Word", "Meaning", "chosen", "front_html", "back_html")


def deck_package(spark, sf_dir):
    """The deck as written and read back: every note with its note type and deck."""
    path = fresh_folder(spark, "deck")
    write_package(_notes(spark, sf_dir).withColumnRenamed("p_partkey", "batch_id"), path)
    found, kind, deck = read_package(spark, path)
    kind = kind.select("note_type_id", F.col("name").alias("note_type"), F.array_join("fields", ",").alias("fields"), "template_name")
    return found.crossJoin(F.broadcast(kind)).crossJoin(F.broadcast(deck.withColumnRenamed("name", "deck"))).select(F.col("batch_id").alias("p_partkey"), "pos", "Word", "note_key", "note_type_id", "note_type", "fields", "template_name", "deck_id", "deck")


def rejected_responses(spark, sf_dir):
    """Broken responses, one for each part, and why they are rejected, with what was rejected."""
    good = F.regexp_replace(F.col("response"), r"^\[|\]$", "")
    broken = [
        F.col("response"), F.concat("response", F.lit("]")), F.concat("response", F.lit("] junk")), F.concat(F.lit("["), good, F.lit("] ],[ ["), good, F.lit("]")), F.concat("response", F.lit(" \n\t")),
        F.concat("response", F.lit("}")), F.expr("substr(response, 1, length(response) - 1)"), F.concat(F.lit("[null,"), good, F.lit("]")), F.lit('[{"Word":"a","Meaning":"b"}]'), F.concat("response", F.lit(',"a":[]')), F.lit("[] ],[ []"),
    ]
    which = F.element_at(F.array(*broken), (F.col("p_partkey") % len(broken) + 1).cast("int"))
    return rejects(_responses(spark, sf_dir).select("p_partkey", which.alias("response")), carry=("p_partkey",))


def required_keys(spark, sf_dir):
    kept = F.to_json(F.array(F.struct("Word", "Sentences", F.when(F.col("p_size") % 5 != 0, F.col("Meaning")).alias("Meaning"), F.when(F.col("p_size") % 7 != 0, F.col("Pronunciation")).alias("Pronunciation"))))
    found = parsed(_definitions(spark, sf_dir).select("p_partkey", kept.alias("response")), carry=("p_partkey",))
    return found.select("p_partkey", F.coalesce("problem", F.lit("ok")).alias("problem"))


def contract_checks(spark, sf_dir):
    bold = F.concat(F.lit("<strong>"), F.initcap("p_name"), F.lit("</strong> a|b <strong>"), F.upper("p_name"), F.lit("</strong>"))
    part = _table(spark, sf_dir, "part")
    sentences = F.when(F.col("p_size") % 5 == 0, F.concat(bold, F.lit("|c "), "p_name")).when(F.col("p_size") % 5 == 1, "").when(F.col("p_size") % 5 == 2, F.concat(bold, F.lit("|"), bold)).otherwise(bold)
    rows = part.select("p_partkey", F.col("p_name").alias("Word"), sentences.alias("Sentences"), F.when(F.col("p_size") % 3 > 0, F.expr("repeat(p_brand, p_size % 3 - 1)")).alias("Pronunciation"))
    return checked(rows).select("p_partkey", "four_sentences", "all_bold", "has_pronunciation")


def contract_forms(spark, sf_dir):
    """Sentences that embolden a form of the word, one that a table lists, or another word; transcriptions and others."""
    part, kind = _table(spark, sf_dir, "part"), F.col("p_partkey") % 5
    bold = F.when(kind == 0, F.concat("p_name", F.lit("s"))).when(kind == 1, F.upper("p_name")).when(kind == 2, F.concat("p_name", F.lit("zz"))).when(kind == 3, F.concat(F.lit("old "), "p_name")).otherwise(F.concat("p_name", F.lit("'s")))
    letters = F.translate(F.col("p_name"), "aeioucgqy", "æɛɪɒʌkɡki")
    spoken = F.when(kind == 0, F.concat(F.lit("/"), letters, F.lit("/"))).when(kind == 1, F.upper("p_name")).when(kind == 2, F.concat(F.lit("/"), letters)).when(kind == 3, F.concat(letters, F.lit("ˈ"))).otherwise(F.concat(F.lit("ˈ"), letters))
    rows = part.select("p_partkey", F.col("p_name").alias("Word"), F.concat(F.lit("A <strong>"), bold, F.lit("</strong> here|<strong>"), "p_name", F.lit("</strong>")).alias("Sentences"), spoken.alias("Pronunciation"))
    listed = part.where("p_size % 2 = 0").select(F.col("p_name").alias("word"), F.concat(F.lit("old "), "p_name").alias("form")).distinct()
    return checked_forms(rows, listed).select("p_partkey", "bold_forms", "is_ipa")


def session_epochs(spark, sf_dir):
    side = F.when(F.col("event_type") == "view", "front").when(F.col("event_type") == "click", "back")
    views = _table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("key"), side.alias("side")).where("side is not null")
    return epochs(views).select("event_id", "key", "side", "epoch")


def _views(spark, sf_dir):
    """Views of cards in the order of event_id; a key's card has up to three sentences."""
    side = F.when(F.col("event_type") == "view", "front").when(F.col("event_type") == "click", "back")
    views = _table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("ts"), F.concat(F.lit("k"), "user_id").alias("key"), side.alias("side"), (F.col("user_id") % 4).cast("int").alias("n"))
    return views.where("side is not null").withColumn("sentences", F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 1, F.col("n"))).drop("n")


def session_choices(spark, sf_dir):
    views = _views(spark, sf_dir)
    items = views.select("key", F.col("sentences").alias("sentence_list")).distinct()
    return shown(views.drop("sentences"), items).select("event_id", "key", "side", "chosen")


def session_stream(spark, sf_dir):
    """The same, by keyed state in a stream over files."""
    path, views = fresh_folder(spark, "stream"), _views(spark, sf_dir).select("key", "event_id", "side", "sentences")
    views.write.parquet(f"{path}/in")
    stream = stream_choices(spark.readStream.schema(views.schema).parquet(f"{path}/in"))
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out").select("event_id", "key", "side", "chosen")


#: Responses that a strict parse accepts or rejects, with what is expected: the number of notes, or the problem.
CASES = [
    ("one", '[{"Word":"a","Sentences":"b","Meaning":"c","Pronunciation":"d"}]', "1"),
    ("empty array", "[]", "0"),
    ("empty", "", "document"),
    ("trailing text", '[{"Word":"a","Sentences":"b","Meaning":"c","Pronunciation":"d"}] ok', "document"),
    ("fence", '```json\n[]\n```', "document"),
    ("truncated", '[{"Word":"a"', "document"),
    ("two arrays", "[],[]", "document"),
    ("root object", '{"Word":"a","Sentences":"b","Meaning":"c","Pronunciation":"d"}', "document"),
    ("root null", "null", "document"),
    ("root number", "3", "document"),
    ("string element", '["x"]', "document"),
    ("null element", "[null]", "element"),
    ("missing member", '[{"Word":"a","Sentences":"b","Meaning":"c"}]', "missing Pronunciation"),
    ("other case", '[{"word":"a","Sentences":"b","Meaning":"c","Pronunciation":"d"}]', "missing Word"),
    ("null value", '[{"Word":null,"Sentences":"b","Meaning":"c","Pronunciation":"d"}]', "1"),
    ("extra member", '[{"Word":"a","Sentences":"b","Meaning":"c","Pronunciation":"d","x":1}]', "1"),
    ("single quotes", "[{'Word':'a','Sentences':'b','Meaning':'c','Pronunciation':'d'}]", "document"),
    ("trailing comma", '[{"Word":"a","Sentences":"b","Meaning":"c","Pronunciation":"d"},]', "document"),
    ("byte-order mark", "﻿[]", "document"),
]


def strict_parse_cases(spark, sf_dir):
    """A case for every part, with the part's name as the word: what the parse makes of it."""
    part = _table(spark, sf_dir, "part")
    case = F.element_at(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(r).alias("text")) for n, r, _ in CASES)), (F.col("p_partkey") % len(CASES) + 1).cast("int"))
    cases = part.select("p_partkey", case.alias("case"), F.concat(F.lit('"Word":"'), "p_name", F.lit('"')).alias("word"))
    responses = cases.select("p_partkey", "case.name", F.replace("case.text", F.lit('"Word":"a"'), F.col("word")).alias("response"))
    found = parsed(responses, carry=("p_partkey",)).groupBy("p_partkey").agg(F.max("problem").alias("problem"), F.count(F.lit(1)).cast("string").alias("n"))
    return responses.join(found, "p_partkey", "left").select("p_partkey", "name", F.coalesce("problem", "n", F.lit("0")).alias("outcome"))


def replay_provider(spark, sf_dir):
    composed = compose(_table(spark, sf_dir, "benchmark"), PROMPT, "text")
    recorded = composed.where("item_id % 3 <> 0").select("prompt_sha", F.concat(F.lit("[] for "), F.md5("model_input")).alias("response"))
    return replay(composed, recorded).select("item_id", "response")


def provider_answers(spark, sf_dir):
    """A provider asked for two thirds of the prompts, and another for all of them: answered prompts aren't asked again."""
    composed, path = compose(_table(spark, sf_dir, "benchmark"), PROMPT, "text"), fresh_folder(spark, "answers")
    respond(composed.where("item_id % 3 <> 0"), lambda: lambda text: f"first {len(text)}", path)
    return respond(composed, lambda: lambda text: f"second {len(text)}", path).select("item_id", "response")


def _note_views(spark, sf_dir):
    """Views of words that have three notes each, whose lists differ and change: some views have a sentence more."""
    side = F.when(F.col("event_type") == "view", "front").when(F.col("event_type") == "click", "back")
    letters, shift = F.array(*map(F.lit, "abcdef")), (F.col("event_id") % 3).cast("int")
    lists = F.slice(letters, shift + 1, (F.col("user_id") % 3).cast("int") + F.when(F.col("event_id") % 5 > 2, 1).otherwise(0) + 1)
    views = _table(spark, sf_dir, "events").select("event_id", "ts", F.concat(F.lit("k"), F.col("user_id") % 10).alias("key"), side.alias("side"), lists.alias("sentences"))
    return views.where("side is not null")


def session_notes(spark, sf_dir):
    """The sentences that views show, by stretches of views of which each is a function of the state before it."""
    return replayed(_note_views(spark, sf_dir), stretch=1000).select("event_id", "key", "side", "chosen")


def session_timed_stream(spark, sf_dir):
    """The same by keyed state in event time, over a stream of several files that don't come in the order of time."""
    path, views = fresh_folder(spark, "timed"), _note_views(spark, sf_dir)
    end = views.agg((F.max("ts") + F.expr("interval 2 days")).alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), "ts", F.lit("end").alias("key"), F.lit("front").alias("side"), F.array(F.lit("a")).alias("sentences"))
    views.repartition(4, "event_id").write.parquet(f"{path}/in")
    end.write.mode("append").parquet(f"{path}/in")
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, STORE)
    try:
        stream = timed_choices(spark.readStream.schema(views.schema).parquet(f"{path}/in"), "1 day")
        query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(store, before)
    return spark.read.parquet(f"{path}/out").where("key <> 'end'").select("event_id", "key", "side", "chosen")


def salvaged_notes(spark, sf_dir):
    """Notes of responses of which some are cut off, anywhere."""
    cut = F.floor(F.length("response") * (F.col("p_partkey") % 11) / 10).cast("int")
    responses = _responses(spark, sf_dir).select("p_partkey", F.substring(F.col("response"), F.lit(1), cut).alias("response"))
    return notes(responses, "salvage", carry=("p_partkey",)).select("p_partkey", "pos", *FIELDS)


def salvage_rejects(spark, sf_dir):
    """How many objects of each response that was cut off are whole."""
    cut = F.floor(F.length("response") * (F.col("p_partkey") % 11) / 10).cast("int")
    responses = _responses(spark, sf_dir).select("p_partkey", F.substring(F.col("response"), F.lit(1), cut).alias("response"))
    return rejects(responses, carry=("p_partkey",), salvaging=True).select("p_partkey", "pos", "reason")


def word_coverage(spark, sf_dir):
    """Which words got a card, where answers lack words, have others, or have them with letters missing, changed or added."""
    word = F.concat("p_name", F.lit(" "), F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 4))
    asked = _table(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("batch_id"), word.alias("word"), (F.col("p_partkey") % 8).alias("kind"))
    w = F.col("word")
    given = F.when(F.col("kind") == 1, F.concat(w.substr(1, 1), F.substring(w, 3, 99))).when(F.col("kind") == 2, F.concat(w.substr(2, 1), w.substr(1, 1), F.substring(w, 3, 99)))
    given = given.when(F.col("kind") == 3, F.concat(w, F.lit("x"))).when(F.col("kind") == 4, F.reverse(w)).when(F.col("kind") == 5, F.upper(w)).otherwise(w)
    return coverage(asked, asked.where("kind > 0").select("batch_id", given.alias("Word")))


QUERIES = {f.__name__: f for f in (
    prompt_compose, json_explode_events, notes_from_response, sentence_split, sentence_choice, random_choice, sentence_membership, state_key_plain_text, front_render, back_render,
    deck_accumulate, deck_package, log_entries, text_sources, run_deck, required_keys, rejected_responses, contract_checks, session_epochs, session_choices, session_stream,
    strict_parse_cases, replay_provider, provider_answers, log_of_calls, latest_responses, deck_growth, notes_from_file, keyed_provider, package_status,
    contract_forms, session_notes, session_timed_stream, salvaged_notes, salvage_rejects, word_coverage,
)}

_PROMPT_SQL = "'" + PROMPT.replace("'", "''") + "'"

#: The first view of an epoch draws by its event_id.
_SESSIONS_SQL = """WITH v AS (SELECT event_id, 'k' || user_id AS key, user_id % 4 AS n, CASE event_type WHEN 'view' THEN 'front' ELSE 'back' END AS side FROM events WHERE event_type IN ('view', 'click')),
e AS (SELECT *, coalesce(sum(CASE side WHEN 'back' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM v),
d AS (SELECT *, min(event_id) OVER (PARTITION BY key, epoch) AS drawn FROM e)
SELECT event_id, key, side, CASE WHEN n > 0 THEN chr((97 + ('0x' || substr(md5('#' || key || '#' || drawn), 1, 8))::BIGINT % n)::INT) END AS chosen FROM d"""


#: One view after another of each key.
_NOTES_SQL = """WITH RECURSIVE v AS (SELECT event_id, 'k' || user_id % 10 AS key, CASE event_type WHEN 'view' THEN 'front' ELSE 'back' END AS side,
  ['a', 'b', 'c', 'd', 'e', 'f'][event_id % 3 + 1 : event_id % 3 + 1 + user_id % 3 + CASE WHEN event_id % 5 > 2 THEN 1 ELSE 0 END] AS l,
  row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS i FROM events WHERE event_type IN ('view', 'click')),
d AS (SELECT *, l[1 + ('0x' || substr(md5('#' || key || '#' || event_id), 1, 8))::BIGINT % len(l)] AS drawn FROM v),
r AS (SELECT event_id, key, side, i, drawn AS chosen FROM d WHERE i = 1
  UNION ALL SELECT d.event_id, d.key, d.side, d.i, CASE WHEN r.side = 'front' AND list_contains(d.l, r.chosen) THEN r.chosen ELSE d.drawn END FROM r JOIN d ON d.key = r.key AND d.i = r.i + 1)
SELECT event_id, key, side, chosen FROM r"""

#: Where each object of a response ends, and how much of the response is kept.
_CUT_SQL = """, objects AS (SELECT *, length(to_json({'Word': "Word", 'Sentences': "Sentences", 'Meaning': "Meaning", 'Pronunciation': "Pronunciation"})::VARCHAR) + 1 AS n FROM raw),
cut AS (SELECT *, sum(n) OVER (PARTITION BY p_partkey ORDER BY pos) AS upto, ((sum(n) OVER (PARTITION BY p_partkey) + 1) * (p_partkey % 11)) // 10 AS keep FROM objects)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE_SQL = {
    "prompt_compose": f"SELECT item_id, {_PROMPT_SQL} || text AS model_input, sha256({_PROMPT_SQL} || text) AS prompt_sha FROM benchmark",
    "json_explode_events": """SELECT event_id, (unnest(generate_series(0, len(items) - 1)))::INT AS pos, unnest(items).k AS k
FROM (SELECT event_id, from_json('[' || props || ']', '[{"k":"BIGINT"}]') AS items FROM events)""",
    "notes_from_response": _DEFINITIONS_SQL + 'SELECT p_partkey, pos, "Word", "Sentences", "Meaning", "Pronunciation" FROM raw',
    "sentence_split": r"""SELECT doc_id, (unnest(generate_series(0, len(items) - 1)))::INT AS pos, unnest(items) AS sentence
FROM (SELECT doc_id, list_filter(list_transform(string_split(text, '|'),
  lambda x: regexp_replace(x, '^[\t\n\x0B\f\r\p{Z}\x{FEFF}]+|[\t\n\x0B\f\r\p{Z}\x{FEFF}]+$', '', 'g')), lambda x: x <> '') AS items FROM documents)
WHERE len(items) > 0""",
    "sentence_choice": _DEFINITIONS_SQL + "SELECT p_partkey, pos, chosen FROM picked",
    "random_choice": "SELECT p_partkey, TRUE AS member FROM part",
    "sentence_membership": _DEFINITIONS_SQL + """SELECT p_partkey, stored IS NULL OR stored = '' OR NOT list_contains(items, stored) AS redraw
FROM (SELECT *, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'stale' ELSE "Meaning" END AS stored FROM defs WHERE pos = 0)""",
    "state_key_plain_text": "SELECT page_id, 'vocab-sentence-' || regexp_replace(html, '<[^>]*>', '', 'g') AS key FROM pages",
    "front_render": _DEFINITIONS_SQL + 'SELECT p_partkey, pos, "Word", front_html FROM fronts',
    "back_render": _DEFINITIONS_SQL + f"SELECT p_partkey, pos, '{TEMPLATE_NAME}' AS template_name, back_html FROM backs",
    "deck_accumulate": _DEFINITIONS_SQL + """SELECT 0 AS batch_order, p_partkey, pos, "Word" FROM raw WHERE p_partkey % 2 = 0
UNION ALL SELECT 1, p_partkey, pos, "Word" FROM raw""",
    "deck_package": _DEFINITIONS_SQL + f"""SELECT p_partkey, pos, "Word", sha256("Word" || chr(31) || "Sentences" || chr(31) || "Meaning" || chr(31) || "Pronunciation") AS note_key,
{NOTE_TYPE_ID}::BIGINT AS note_type_id, '{NOTE_TYPE_NAME}' AS note_type, '{",".join(FIELDS)}' AS fields, '{TEMPLATE_NAME}' AS template_name, {DECK_ID}::BIGINT AS deck_id, '{DECK_NAME}' AS deck FROM raw""",
    "log_entries": "SELECT (row_number() OVER (ORDER BY conv_id % 2, conv_id, turn, text) - 1)::INT AS pos, text AS entry FROM conversations",
    "log_of_calls": f"""WITH runs AS (SELECT 0 AS run, text, min(item_id) AS i FROM benchmark WHERE item_id % 3 <> 0 GROUP BY text
UNION ALL SELECT 1, text, min(item_id) FROM benchmark WHERE text NOT IN (SELECT text FROM benchmark WHERE item_id % 3 <> 0) GROUP BY text)
SELECT row_number() OVER (ORDER BY run, i) - 1 AS pos, (length(text) + {len(PROMPT)}) || ' ' || right({_PROMPT_SQL} || text, 40) AS entry FROM runs""",
    "latest_responses": _DEFINITIONS_SQL + 'SELECT p_partkey, pos, "Word" FROM raw WHERE p_partkey % 2 = 1',
    "deck_growth": _DEFINITIONS_SQL + """SELECT 0 AS batch_order, 'even' AS batch_key, p_partkey, pos, "Word" FROM raw WHERE p_partkey % 2 = 0
UNION ALL SELECT 1, 'all', p_partkey, pos, "Word" FROM raw""",
    "notes_from_file": _DEFINITIONS_SQL + """SELECT (row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1)::INT AS pos, "Word", "Meaning", chosen, front_html FROM fronts WHERE pos = 0""",
    "keyed_provider": f"SELECT r_regionkey::VARCHAR AS batch_id, r_name AS words, (length(r_name) + {len(PROMPT)})::VARCHAR AS response FROM region",
    "session_notes": _NOTES_SQL,
    "session_timed_stream": _NOTES_SQL,
    "salvaged_notes": _DEFINITIONS_SQL + _CUT_SQL + """SELECT p_partkey, pos, "Word", "Sentences", "Meaning", "Pronunciation" FROM cut WHERE upto <= keep""",
    "salvage_rejects": _DEFINITIONS_SQL + _CUT_SQL + """SELECT p_partkey, (count(*) FILTER (WHERE upto <= keep))::INT AS pos, 'document' AS reason FROM cut WHERE p_partkey % 11 < 10 GROUP BY p_partkey""",
    "word_coverage": """WITH a AS (SELECT p_size::VARCHAR AS batch_id, p_name || ' ' || substr(md5(p_partkey::VARCHAR), 1, 4) AS w, p_partkey % 8 AS kind FROM part),
want AS (SELECT DISTINCT batch_id, w AS word FROM a),
have AS (SELECT DISTINCT batch_id, lower(CASE kind WHEN 1 THEN w[1] || substr(w, 3) WHEN 2 THEN w[2] || w[1] || substr(w, 3) WHEN 3 THEN w || 'x' WHEN 4 THEN reverse(w) ELSE w END) AS answer FROM a WHERE kind > 0),
pairs AS (SELECT batch_id, word, answer, levenshtein(word, answer)::INT AS edits FROM want JOIN have USING (batch_id)
  WHERE (batch_id, word) NOT IN (SELECT (batch_id, answer) FROM have) AND (batch_id, answer) NOT IN (SELECT (batch_id, word) FROM want)),
best AS (SELECT batch_id, word, answer, edits FROM pairs WHERE edits <= CASE WHEN greatest(length(word), length(answer)) >= 6 THEN 2 ELSE 1 END QUALIFY row_number() OVER (PARTITION BY batch_id, word ORDER BY edits, answer) = 1)
SELECT batch_id, word, word AS answer, 'answered' AS status, 0 AS edits FROM want WHERE (batch_id, word) IN (SELECT (batch_id, answer) FROM have)
UNION ALL SELECT batch_id, word, answer, CASE WHEN answer IS NULL THEN 'skipped' ELSE 'corrected' END, edits FROM want LEFT JOIN best USING (batch_id, word) WHERE (batch_id, word) NOT IN (SELECT (batch_id, answer) FROM have)
UNION ALL SELECT batch_id, NULL, answer, 'unasked', NULL FROM have WHERE (batch_id, answer) NOT IN (SELECT (batch_id, word) FROM want) AND (batch_id, answer) NOT IN (SELECT (batch_id, answer) FROM best)""",
    "package_status": _DEFINITIONS_SQL + """SELECT "Word", count(*) AS n, ': deck written' AS status FROM raw GROUP BY "Word\"""",
    "text_sources": "SELECT item_id, replace(text, chr(13) || chr(10), chr(10)) || chr(10) || 'second' || chr(10) || 'third' || chr(10) AS words FROM benchmark",
    "run_deck": """WITH n AS (SELECT n_name AS w, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS i FROM nation),
d AS (SELECT (2 * i + k)::INT AS pos, w AS "Word", CASE k WHEN 0 THEN 'first ' ELSE 'second ' END || w AS "Meaning", CASE k WHEN 0 THEN '' ELSE lower(w) END AS p,
  CASE ('0x' || substr(md5(w), 1, 8))::BIGINT % 2 WHEN 0 THEN 'A <strong>' || w || '</strong>.' ELSE 'The ' || w || ' here' END AS chosen FROM n, range(2) AS r(k)),
f AS (SELECT *, '<div class="sentence" style="text-align: center;">' || chosen || '</div>' AS front_html FROM d)
SELECT pos, "Word", "Meaning", chosen, front_html, '<div style="text-align: center;">' || chr(10) || front_html || chr(10) || '<hr>' || chr(10)
  || CASE WHEN p <> '' THEN '<div class="notes"><i>' || p || '</i></div>' || chr(10) ELSE '' END || '<div class="meaning">' || "Meaning" || '</div>' || chr(10) || '</div>' AS back_html FROM f""",
    "rejected_responses": _DEFINITIONS_SQL + """, objects AS (
  SELECT p_partkey, string_agg(to_json({'Word': "Word", 'Sentences': "Sentences", 'Meaning': "Meaning", 'Pronunciation': "Pronunciation"})::VARCHAR, ',' ORDER BY pos) AS o FROM raw GROUP BY p_partkey),
broken AS (SELECT p_partkey, CASE p_partkey % 11 WHEN 1 THEN '[' || o || ']]' WHEN 2 THEN '[' || o || ']] junk' WHEN 3 THEN '[' || o || '] ],[ [' || o || ']' WHEN 5 THEN '[' || o || ']}'
  WHEN 6 THEN '[' || o WHEN 7 THEN 'null' WHEN 8 THEN '{"Word":"a","Meaning":"b"}' WHEN 9 THEN '[' || o || '],"a":[]' WHEN 10 THEN '[] ],[ []' END AS raw FROM objects)
SELECT p_partkey, 0 AS pos, CASE p_partkey % 11 WHEN 7 THEN 'element' WHEN 8 THEN 'missing Sentences,Pronunciation' ELSE 'document' END AS reason, raw FROM broken WHERE raw IS NOT NULL""",
    "required_keys": """SELECT p_partkey, CASE WHEN p_size % 35 = 0 THEN 'missing Meaning,Pronunciation' WHEN p_size % 5 = 0 THEN 'missing Meaning'
WHEN p_size % 7 = 0 THEN 'missing Pronunciation' ELSE 'ok' END AS problem FROM part""",
    "contract_checks": """SELECT p_partkey, p_size % 5 = 2 AS four_sentences, p_size % 5 >= 2 AS all_bold, p_size % 3 = 2 AS has_pronunciation FROM part""",
    "contract_forms": """SELECT p_partkey, CASE p_partkey % 5 WHEN 2 THEN FALSE WHEN 3 THEN p_name IN (SELECT p_name FROM part WHERE p_size % 2 = 0) ELSE TRUE END AS bold_forms,
p_partkey % 5 IN (0, 4) AS is_ipa FROM part""",
    "session_epochs": """SELECT event_id, user_id AS key, CASE event_type WHEN 'view' THEN 'front' ELSE 'back' END AS side,
coalesce(sum(CASE event_type WHEN 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS epoch
FROM events WHERE event_type IN ('view', 'click')""",
    "session_choices": _SESSIONS_SQL,
    "session_stream": _SESSIONS_SQL,
    "strict_parse_cases": f"SELECT p_partkey, name, outcome FROM part JOIN (VALUES {', '.join(f'({i}, {_quoted(n)}, {_quoted(o)})' for i, (n, _, o) in enumerate(CASES))}) AS t(i, name, outcome) ON i = p_partkey % {len(CASES)}",
    "provider_answers": f"SELECT item_id, CASE WHEN item_id % 3 <> 0 THEN 'first ' ELSE 'second ' END || (length(text) + {len(PROMPT)}) AS response FROM benchmark",
    "replay_provider": f"SELECT item_id, CASE WHEN item_id % 3 <> 0 THEN '[] for ' || md5({_PROMPT_SQL} || text) END AS response FROM benchmark",
}
