"""Cleaning on literal examples: every example is a recording of one shared job."""

import pytest
from pyspark.sql import functions as F

from colloquy.functions import lexicons as lx
from colloquy.operators import clean as cl

SEG = "recording_id string, seg_no long, text string, start_ms long, end_ms long, speaker string"
BILANCIO = "adesso vediamo come si fa il bilancio della societa nel corso del tempo"
RUN = "questa cosa va fatta entro la fine del mese"
SEVEN = "uno due tre quattro cinque sei sette"
ONE = "io l'ho fatto o non l'ho fatto ma solo questo quindi campo e tabellini vanno insieme"
NINE = "ci vediamo domani alle nove in ufficio da noi per firmare"

EXAMPLES = {
    # what was heard, what is left
    "invented segment": (["Buongiorno, iniziamo la riunione.", "Grazie a tutti.", ""], ["Buongiorno, iniziamo la riunione."]),
    "edges": (["Grazie a tutti. Grazie. parliamo del progetto nuovo Ciao"], ["parliamo del progetto nuovo"]),
    "credit": ([f"{BILANCIO} Sottotitoli e revisione a cura di QTSS {BILANCIO} e poi andiamo avanti"], [f"{BILANCIO} e poi andiamo avanti"]),
    "credit alone": (["prima parte Autore dei sottotitoli e delle cose varie di QTSS poi altro discorso"], ["prima parte poi altro discorso"]),
    "overlap": ([ONE, "in l'ho fatto non l'ho fatto ma solo questo campo e tabellini vanno insieme e adesso proseguiamo con altro"],
                [ONE, "e adesso proseguiamo con altro"]),
    "short echo": (["ogni asset ha i suoi impatti", "certo ogni asset ha i suoi impatti"], ["ogni asset ha i suoi impatti", "certo ogni asset ha i suoi impatti"]),
    "repeat": ([f"{RUN} {RUN} e basta cosi"], [f"{RUN} e basta cosi"]),
    "three copies": ([f"{SEVEN} {SEVEN} {SEVEN} otto"], [f"{SEVEN} otto"]),
    "short repeat": (["no no no cioe la creazione cioe la creazione"], ["no no no cioe la creazione cioe la creazione"]),
    "plain": (["niente da togliere qui"], ["niente da togliere qui"]),
}


@pytest.fixture(scope="module")
def cleaned(spark):
    rows = [(name, i, t, i * 10_000, i * 10_000 + 9_000, None) for name, (said, _) in EXAMPLES.items() for i, t in enumerate(said)]
    out = cl.clean(spark.createDataFrame(rows, SEG), lx.phrases(spark)).orderBy("recording_id", "seg_no").collect()
    return {name: [(r["text"], r["start_ms"]) for r in out if r["recording_id"] == name] for name in EXAMPLES}


@pytest.mark.parametrize("name", EXAMPLES)
def test_example(cleaned, name):
    assert [t for t, _ in cleaned[name]] == EXAMPLES[name][1]


def test_a_cut_head_moves_the_start(cleaned):
    assert 0 < cleaned["edges"][0][1] < 9_000
    assert cleaned["plain"][0][1] == 0


def test_fillers_are_kept_when_asked(spark):
    out = cl.clean(spark.createDataFrame([("r", 0, "Grazie a tutti.", 0, 1000, None)], SEG), lx.phrases(spark), fillers=False).collect()
    assert [r["text"] for r in out] == ["Grazie a tutti."]


def test_duplicates_keep_the_fuller(spark):
    rows = [("r", 0, NINE, 0, 1, None), ("r", 1, NINE.capitalize() + " il contratto", 1, 2, None), ("r", 2, "altro", 3, 4, None)]
    out = cl.dedupe_neighbours(spark.createDataFrame(rows, SEG)).orderBy("seg_no").collect()
    assert [r["text"] for r in out] == [NINE.capitalize() + " il contratto", "altro"]


@pytest.mark.parametrize("text, clean", [("ciao ,  come va ?", "ciao, come va?"), ("  a\n b ", "a b"), ("x …", "x…")])
def test_clean_text(spark, text, clean):
    from colloquy.functions.text import clean_text
    assert spark.createDataFrame([(text,)], "t string").select(clean_text(F.col("t"))).first()[0] == clean


def test_word_timings_follow_the_words(spark):
    words = [{"word": w, "start_ms": i * 400, "end_ms": i * 400 + 400} for i, w in enumerate("Grazie mille. parliamo di bilancio".split())]
    df = spark.createDataFrame([("r", 0, "Grazie mille. parliamo di bilancio", 0, 2000, None, words)],
                               SEG + ", words array<struct<word:string,start_ms:long,end_ms:long>>")
    r, = cl.clean(df, lx.phrases(spark)).collect()
    assert r["text"] == "parliamo di bilancio" and r["start_ms"] == 800
    assert [w["word"] for w in r["words"]] == ["parliamo", "di", "bilancio"]
