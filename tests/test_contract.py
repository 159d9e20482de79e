"""Forms of headwords and transcriptions, against rows labelled by hand."""

from pyspark.sql import functions as F

from glossaria.functions.forms import forms, ipa
from glossaria.operators.contract import checked_forms

#: Headword and its forms; after the bar what are no forms of it.
FORMS = """run: run runs running | ruin runing rung runt
stop: stops stopped stopping stopper | stoped stoping stoop
make: makes making maker | makeing makng
hope: hopes hoped hoping | hopping hopeed
hop: hops hopped hopping | hoped hoping
carry: carries carried carrying carrier | carryed carrys
play: plays played playing player | plaied plaies
watch: watches watched watching | watchs watchies
box: boxes boxed boxing | boxs boxxed
happy: happier happiest happily happiness | happyer happyly
gentle: gentler gentlest gently | gentlely
quick: quicker quickest quickly quickness | quickkly
leaf: leaves leafs | leavs
knife: knives | knifves
die: dies died dying | dieing
agree: agrees agreed agreeing | agring
potato: potatoes | potatoies
basic: basics basically | basicly
panic: panicked panicking | paniced
woman: women woman's | womans'es
crisis: crises | crisises'
visit: visits visited visiting | visitting visited's
admit: admitted admitting admits | admiting
wide: wider widest widely | wideer
big: bigger biggest | biger
give up: gives up giving up | give ups' gave upp
ice cream: ice creams ice cream's | ices creams
take: takes taking taken | taked tooked""".splitlines()
IPA = """/rʌn/ ˈdɪkʃəˌnɛri /ˈdɪk.ʃə.nər.i/ həˈloʊ [ˈbʌtn̩] /kæt/ tʃɜːtʃ /ˈt͡ʃɪldɹən/ ˌʌndərˈstænd /ɪɡˈzæmpəl/ ˈsɪŋɪŋ /əˈbaʊt/ ˈfaɪə(r) /ɡɪv_ʌp/ /jɛs/ stɹɛŋθs /ˈwɔːtə(r)/,_/ˈwɑːtər/
ʃiː /ˈɹɪðəm/ pit /θɪŋk/ /ˈbɒtl̩/""".split()
RESPELLED = """dik-shuh-ner-ee HEL-oh nay-shun RUN luhv kaht thing choo sheep quik /run /rʌn rʌn/ ˈ ˈˈrʌn rʌnˈ /rʌn// ʃʃʃʃʃʃʃ kt [rʌn/ book tree ay-BOWT rʌn1 see /ee/ /ˈ.rʌn/ caught ː ːrʌn""".split() + ["", "the same", "noun", "rhymes with cat"]


def test_forms_by_hand(spark):
    rows = [(head, form.strip(), good) for line in FORMS for head, _, rest in [line.partition(": ")] for part, good in zip(rest.split("|"), (True, False), strict=True) for form in (part.split() if " " not in head else [" ".join(x) for x in zip(*[iter(part.split())] * 2)])]
    got = spark.createDataFrame(rows, "head string, form string, good boolean").withColumn("found", F.array_contains(forms(F.col("head")), F.col("form"))).collect()
    wrong = [(r["head"], r["form"]) for r in got if r["found"] != r["good"]]
    # What the rules get wrong: a stressed last syllable and an irregular form need the table; English has more doublings than one pattern.
    assert len(wrong) <= 4 and len(got) > 110, wrong


def test_forms_from_a_table(spark):
    notes = spark.createDataFrame([("run", "She <strong>ran</strong>.|He <strong>runs</strong>", "/rʌn/"), ("Run", "a <strong>runner</strong>", "ruhn"), ("run", "no bold", ""), ("run", "", None), ("mouse", "<b>x</b> <strong>mice</strong> and <strong>men</strong>", "maʊs"), ("give up", "<strong>Gave up</strong>", "x")], "Word string, Sentences string, Pronunciation string")
    listed = spark.createDataFrame([("run", "ran"), ("mouse", "mice"), ("give up", "gave up"), ("give up", "given up")], "word string, form string")
    got = [(r["bold_forms"], r["is_ipa"]) for r in checked_forms(notes, listed).orderBy(F.monotonically_increasing_id()).collect()]
    assert sorted(got) == sorted([(True, True), (True, False), (False, False), (False, False), (True, True), (True, False)])
    assert sorted(r["bold_forms"] for r in checked_forms(notes).collect()) == [False] * 5 + [True]


def test_transcriptions_by_hand(spark):
    for words, want in ((IPA, True), (RESPELLED, False)):
        rows = spark.createDataFrame([(w.replace("_", " "),) for w in words], "p string")
        assert [r["p"] for r in rows.where(ipa(F.col("p")) != want).collect()] == []


def test_notes_of_one_file_are_checked_by_several_tasks(spark):
    rows = spark.createDataFrame([("run", "a <strong>runs</strong>|b <strong>ran</strong>", "/rʌn/"), ("run", "a <strong>runs</strong>|b <strong>walks</strong>", "ruhn"), (None, None, None)], "Word string, Sentences string, Pronunciation string").coalesce(1)
    listed = spark.createDataFrame([("run", "ran")], "word string, form string")
    found = checked_forms(rows, listed)
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert {(r["bold_forms"], r["is_ipa"]) for r in found.collect()} == {(True, True), (False, False)}
