"""Answers, headings, passes and trees on literal examples."""

import pytest
from pyspark.sql import functions as F

from colloquy.functions import lexicons as lx
from colloquy.operators import notes as no
from colloquy.operators import sections as se
from colloquy.plans import folds

ANSWERS = "recording_id long, chunk_idx long, answer string, span_start_ms long, span_end_ms long"


def test_headings_meant_and_not_meant(spark):
    written = {"Decisões": "decision", "Requisitos": "requirement", "Questioni apert": "open_question", "Requirements": "requirement",
               "Azioni": "action", "Riassunto": None, "Altro": None, "Note": None}
    h = spark.createDataFrame([(w,) for w in written], "heading string")
    got = {r["heading"]: r["kind"] for r in no.route_headings(h, lx.kinds(spark), "it").collect()}
    assert got == written


def test_notes_carry_heading_minute_and_speaker(spark):
    answer = "\n".join(["## Decisioni", "- [1:15] **Anna** si rinnova il contratto", "- senza minuto", "## Meteo", "* pioveva (SPEAKER_01) `[1:02:03]`",
                        "testo sciolto", "1. - "])
    n = no.parse_notes(spark.createDataFrame([(1, 2, answer, 60_000, 90_000)], ANSWERS), lx.kinds(spark)).orderBy("line_no").collect()
    assert [(r["type"], r["text"], r["ts_start_ms"], r["speaker"]) for r in n] == [
        ("decision", "si rinnova il contratto", 75_000, "Anna"), ("decision", "senza minuto", 75_000, None), ("fact", "pioveva", 3_723_000, "SPEAKER_01")]
    assert len({r["note_id"] for r in n}) == 3 and all(r["note_id"].startswith("n") for r in n)


def test_first_note_without_minute_takes_the_chunks(spark):
    n = no.parse_notes(spark.createDataFrame([(1, 0, "- qualcosa", 5_000, 9_000)], ANSWERS), lx.kinds(spark)).first()
    assert (n["type"], n["ts_start_ms"]) == ("fact", 5_000)


@pytest.mark.parametrize("answer, prompt, left", [
    ("<think>hm</think>\nLa riunione ha deciso.", None, "La riunione ha deciso."),
    ("Fine.<THINK>mai chiuso", None, "Fine."),
    ("Scrivi un\nriassunto\nBreve.", "Scrivi un riassunto", ""),
    ("Scrivi un\nriassunto\nIl gruppo ha approvato il bilancio e fissato la prossima data.", "Scrivi un riassunto", "Il gruppo ha approvato il bilancio e fissato la prossima data."),
    ("Il gruppo ha approvato il bilancio e poi ha chiuso.\n-----BEGIN TRANSCRIPT-----\n[0:00] ciao", None, "Il gruppo ha approvato il bilancio e poi ha chiuso."),
])
def test_clean_answers(spark, answer, prompt, left):
    df = spark.createDataFrame([(answer, prompt)], "answer string, prompt string")
    assert no.clean_answers(df).first()["answer"] == left


def test_parse_sections(spark):
    page = "\n".join(["## In breve", "Si e' parlato", "di bilancio.", "**Punti chiave**", "- [0:30] **Anna** primo", "riga sciolta", "Decisioni: approvare", "## Termini ricorrenti", "- a, b"])
    rows = no.parse_sections(spark.createDataFrame([(1, 0, page)], "recording_id long, chunk_idx long, answer string"), "it").collect()
    got = {(r["field"], r["text"], r["start_ms"], r["speaker"]) for r in rows}
    assert got == {("abstract", "Si e' parlato", None, None), ("abstract", "di bilancio.", None, None), ("points", "primo", 30_000, "Anna"),
                   ("decisions", "approvare", None, None), ("keywords", "a", None, None), ("keywords", "b", None, None)}


def plain_chunks(costs, budget, carry):
    made, current = [], []
    for i, c in enumerate(costs):
        if current and sum(costs[j] for j in current) + c > budget:
            made.append(current)
            kept = []
            for j in reversed(current[1:]):
                if carry <= 0 or sum(costs[x] for x in kept) + costs[j] > carry:
                    break
                kept.insert(0, j)
            current = kept
        current = [*current, i]
    return [*made, current]


@pytest.mark.parametrize("overlap", [0.0, 0.3])
@pytest.mark.parametrize("block", [13, 16384])
def test_chunks_with_overlap(spark, overlap, block, monkeypatch):
    monkeypatch.setattr(folds.fold_blocks, "__kwdefaults__", {**folds.fold_blocks.__kwdefaults__, "block_rows": block})
    texts = ["x" * (17 * i % 90) for i in range(120)]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "recording_id long, sent_no long, text string")
    got: dict = {}
    for r in no.chunk_sentences(df, 120, overlap).orderBy("chunk_start", "sent_no").collect():
        got.setdefault(r["chunk_start"], []).append(r["sent_no"])
    assert list(got.values()) == plain_chunks([int(len(t) / 2.8) + 8 for t in texts], 120, overlap * 120)


@pytest.mark.parametrize("count, depth, levels", [(1, 3, 1), (6, 3, 1), (7, 3, 2), (36, 3, 2), (50, 3, 2), (300, 4, 3)])
def test_fold_tree_depth(spark, count, depth, levels):
    df = spark.range(count).select(F.lit(1).alias("recording_id"), F.col("id").alias("idx"))
    rows = no.fold_tree(df, 6, depth).collect()
    assert max(r["level"] for r in rows) == levels
    top = [r for r in rows if r["level"] == levels]
    assert len({r["group_no"] for r in top}) == 1
    assert sorted(r["member"] for r in rows if r["level"] == 1) == list(range(count))


def test_example_copies_go(spark):
    n = spark.createDataFrame([(1, "a", "Il tecnico cambia la caldaia entro venerdi"), (1, "b", "Il bilancio della societa viene approvato")],
                              "recording_id long, note_id string, text string")
    ex = spark.createDataFrame([(0, "la caldaia va cambiata dal tecnico entro venerdi")], "line_no long, text string")
    assert [r["note_id"] for r in no.drop_example_copies(n, ex).collect()] == ["b"]


def test_dates_and_figures(spark):
    n = spark.createDataFrame([("Il 12 marzo costa 30 euro, lunedi 5% e 3/4/2026",)], "text string")
    r = no.enrich_notes(n).first()
    assert r["dates"] == ["12 marzo", "lunedi", "3/4/2026"] and "30 euro" in r["numbers"]


def test_review_doubts_the_reviewer(spark):
    body = "- il contratto viene rinnovato per un anno\n- la sede si sposta a Milano in primavera\n- il bilancio e' stato approvato\n- si assume un tecnico nuovo"
    w = spark.createDataFrame([(1, 0, body)], "recording_id long, section_no long, body string")
    said = "INVENTATA: la sede si sposta a Milano in primavera\nDOPPIA: il bilancio e' stato approvato\nSCORRETTA: una riga che non esiste da nessuna parte"
    a = spark.createDataFrame([(1, 0, said)], "recording_id long, section_no long, answer string")
    got = [(r["line"], r["kind"]) for r in se.review_findings(a, w).collect()]
    assert got == [("la sede si sposta a Milano in primavera", "unsupported")]
