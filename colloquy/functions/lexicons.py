"""Word lists and limits the rules are defined by, and their small lookup tables.

Everything here is a fixed value: changing one changes results. Each table is a few
hundred rows at most whatever the corpus size, so joining it by broadcast is safe.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: phrases a recogniser invents over silence -----------------
INVENTED_PHRASES = {
    "it": [
        "grazie", "grazie a tutti", "grazie mille", "grazie a te", "grazie a voi",
        "grazie per l'attenzione", "grazie per la visione", "grazie di cuore",
        "sottotitoli e revisione a cura di qtss",
        "autore dei sottotitoli e revisione a cura di qtss",
        "autore dei sottotitoli e delle caratteristiche di qtss",
        "sottotitoli creati dalla comunita amara.org",
        "ciao", "buongiorno a tutti", "buona giornata",
    ],
    "en": [
        "thank you", "thanks for watching", "thank you for watching",
        "thanks for watching!", "please subscribe", "subscribe to my channel",
        "you", "bye", "goodbye", "see you next time",
    ],
}

# --- fixed values: words that carry no topic, accents folded ------------------
STOP_WORDS = {
    "it": """a abbiamo ad adesso agli ai al alcuni all alla alle allo allora altre altri
        altro anche ancora appunto avere avete aveva avevo avuto basta beh bene boh c certo che
        chi chiaro ci cio cioe come comunque con cosa cosi cui da dai dal dalla dallo degli dei
        del della delle dello dentro detto deve devi devo devono di dice dici diciamo dico
        dicono dite dobbiamo dopo dove dovete due dunque durante e eccetera ecco ed entro era
        erano esatto essere fa facciamo faccio fai fanno fare fate fatto fino forse fra gia
        giusto gli grazie guarda ha hai hanno ho i il in insomma invece io l la le lei li lo
        loro lui ma magari mah mai me mentre mi mia mie miei mio molto ne negli nei nel nella
        nelle nello niente no noi non nostro o ogni ok okay oltre oppure ora per perche percio
        perfetto pero piu po poi possiamo posso possono potete praticamente prima puo puoi qua
        quale quando quanto quasi quella quelle quelli quello questa queste questi questo qui
        quindi roba s sara se sei sempre senti senza si sia siamo solo sono sopra sotto sta stai
        stanno state stato stiamo sto su sua sue sui sul sulla suo t tanto te tipo tra tu tuo
        tutti tutto un una uno va vabbe vedi vi vogliamo voglio vogliono voi volete vuoi
        vuole""".split(),
    "en": """a about actually after all also an and any are as at back be because been before
        being but by can come could did do does doing done down each even every for from get go
        going good got had has have he her here him his how i if in into is it its just keep
        know like look make many may me mean might more most much must my need no not now of off
        ok on one only or other our out over really right said say see she should so some
        something still such sure take than that the their them then there these they thing
        think this those through to too up use very want was way we well were what when where
        which while who why will with would yeah yes you your""".split(),
}

# --- fixed values: articles and prepositions that lose their vowel ------------
ELIDED = ["all", "anch", "bell", "c", "coll", "d", "dall", "dell", "gl", "l", "m", "n",
          "nell", "quell", "s", "sant", "senz", "sull", "t", "tutt", "un", "v"]

# --- fixed values: abbreviations whose full stop ends no sentence -------------
ABBREVIATIONS = ["avv", "dott", "dr", "e.g", "ecc", "etc", "i.e", "ing", "mr", "mrs", "ms",
                 "prof", "sig", "sig.ra", "vs"]

# --- fixed values: words a subtitle line must not end with --------------------
NO_BREAK_AFTER = {
    "it": """il lo la i gli le un uno una l' un' del dello della dell' dei degli delle
        al allo alla all' ai agli alle dal dallo dalla dall' dai dagli dalle
        nel nello nella nell' nei negli nelle sul sullo sulla sull' sui sugli sulle
        col coi quel quello quella quei quegli quelle di a da in con su per tra fra
        ho hai ha abbiamo avete hanno avevo aveva avevamo avevano avrei avrebbe avremmo avranno
        sono sei e' è siamo siete ero era eravamo erano sara' sarà sarei sarebbe essere stato
        non ne' né""".split(),
    "en": """a an the of to in on at by for with from into about as is are was were be been
        being have has had will would can could should may might must not no my your his her
        its our their this that these those""".split(),
}

# --- fixed values: words a subtitle line must not start with ------------------
NO_BREAK_BEFORE = {
    "it": "mi ti si ci vi lo la li le ne gli glielo gliela glieli gliele gliene".split(),
    "en": [],
}

# --- fixed values: words worth breaking a subtitle before ---------------------
BREAK_BEFORE = {
    "it": """e ed ma pero' però perche' perché che quando mentre oppure o se come quindi
        dunque anche poi invece cioe' cioè""".split(),
    "en": "and but or because that which while when so then however although if".split(),
}

# --- fixed values: capitalised only because they start a sentence -------------
COMMON_WORDS = """il lo la i gli le un uno una e ed o oppure ma se perche quando come dove
    chi che cosa non ne ci vi si mi ti piu meno molto poco tutto tutti questo questa quello
    quella noi voi loro io tu lui lei sono siamo era erano ho hai ha abbiamo hanno essere
    avere fare dire adesso allora dopo prima poi anche solo gia ancora sempre mai
    the a an and or but if because when how where who what not no we you they he she it is
    are was were have has had be been do does did this that these those there here then now
    also only just still always never""".split()

# --- fixed values: sentence openings that make no title -----------------------
OPENERS = {
    "it": ["allora", "ecco", "quindi", "dunque", "insomma", "comunque", "beh", "bene", "ok",
           "okay", "cioe", "diciamo", "praticamente", "senti", "sentite", "guarda", "guardate",
           "niente", "ciao", "buongiorno", "buonasera", "salve", "perfetto", "esatto", "va bene"],
    "en": ["so", "well", "right", "okay", "ok", "now", "anyway", "basically", "actually",
           "yeah", "hello", "hi", "good morning", "good evening", "alright", "look", "listen"],
}

# --- fixed values: words a title must not start or end with -------------------
DANGLING = {
    "it": """di a da in con su per tra fra e o ma che il lo la i gli le un uno una del della
        dei delle al alla nel nella come se quando dove perche non ci si""".split(),
    "en": """of to from in with on for and or but that the a an as at by is are was were not
        if when where because this these""".split(),
}

# --- fixed values: the kinds of note, in the order they are printed -----------
NOTE_KINDS = [
    # name, English heading, Italian heading
    ("requirement", "Requirements", "Requisiti"),
    ("fact", "Facts", "Fatti"),
    ("decision", "Decisions", "Decisioni"),
    ("proposal", "Proposals", "Proposte"),
    ("action", "Actions", "Azioni"),
    ("problem", "Problems", "Problemi"),
    ("open_question", "Open questions", "Questioni aperte"),
    ("opinion", "Opinions", "Opinioni"),
]
TAIL_KINDS = ["decision", "action"]

# --- fixed values: the subtitle presets (milliseconds, characters) ------------
PRESET_DEFAULTS = {"sync_lead_in_ms": 100, "tail_ms": {"min": 200, "max": 500}}
PRESETS = {
    "netflix": {"max_chars_per_line": 42, "max_lines": 2, "max_chars_per_second": 17,
                "min_duration_ms": 833, "max_duration_ms": 7000, "min_gap_ms": 83,
                "gap_chaining": {"snap_below_ms": 458, "snap_to_ms": 83}},
    "bbc": {"max_chars_per_line": 37, "max_lines": 2, "max_words_per_minute": 180,
            "max_chars_per_second": 14, "min_duration_ms": 1000, "max_duration_ms": 6000,
            "min_gap_ms": 80},
    "ebu_broadcast": {"max_chars_per_line": 37, "max_lines": 2, "max_chars_per_second": 15,
                      "min_duration_ms": 1000, "max_duration_ms": 6000, "min_gap_ms": 80},
    "fcc_verbatim": {"max_chars_per_line": 32, "max_lines": 2, "max_chars_per_second": 20,
                     "min_duration_ms": 800, "max_duration_ms": 7000, "min_gap_ms": 66},
    "social_vertical": {"max_chars_per_line": 34, "max_lines": 2, "max_chars_per_second": 15,
                        "min_duration_ms": 700, "max_duration_ms": 5000, "min_gap_ms": 60},
    "social_karaoke": {"max_chars_per_line": 20, "max_lines": 1, "max_chars_per_second": 15,
                       "min_duration_ms": 300, "max_duration_ms": 2000, "min_gap_ms": 0,
                       "segment_by_words": {"min": 1, "max": 4}},
    "kids_accessible": {"max_chars_per_line": 34, "max_lines": 2, "max_chars_per_second": 13,
                        "min_duration_ms": 1200, "max_duration_ms": 6000, "min_gap_ms": 80},
}

# --- fixed values: lint remarks by who can act on them ------------------------
PROBLEM_GROUPS = {
    "speech": ["too_fast", "too_many_words"],
    "timing": ["too_short", "too_long", "overlap", "gap_too_small", "backwards"],
    "layout": ["too_wide", "too_many_lines", "empty"],
}

# --- accents over one plain Latin letter: all lower-case letters that decompose into one --------------------
_FOLDED = {c: plain[0] for c in map(chr, range(0xC0, 0x250))
           if c.islower() and len(plain := unicodedata.normalize("NFD", c)) > 1 and "a" <= plain[0] <= "z"}
ACCENTED, PLAIN = "".join(_FOLDED), "".join(_FOLDED.values())

# --- letters whose upper case is written as several, and the one letter that is their capital (or they themselves) ---
_CAPITAL = {c: t if len(t := "ẞ" if c == "ß" else c.title()) == 1 else c for c in map(chr, range(0xC0, 0x10000)) if len(c.upper()) > 1}
WIDENED, CAPITALS = "".join(_CAPITAL), "".join(_CAPITAL.values())

# --- fixed values: characters per model token ---------------------------------
CHARS_PER_TOKEN = {"it": 2.8, "en": 4.4}
CHARS_PER_TOKEN_UNKNOWN = 2.8

# --- fixed values: summary lengths, (share, fewest, most) ---------------------
SUMMARY_LENGTHS = {"short": (0.05, 3, 8), "medium": (0.10, 5, 15), "long": (0.18, 8, 30)}

# --- fixed values: headings of a written page ---------------------------------
PAGE_WORDS = {
    "en": {"title": "Summary", "abstract": "In brief", "points": "Key points",
           "decisions": "Decisions", "actions": "Actions", "keywords": "Recurring terms",
           "made_by": "{engine}, {when} — from a {minutes}-minute recording",
           "made_by_untimed": "{engine}, {when}"},
    "it": {"title": "Riassunto", "abstract": "In breve", "points": "Punti chiave",
           "decisions": "Decisioni", "actions": "Azioni", "keywords": "Termini ricorrenti",
           "made_by": "{engine}, {when} — da una registrazione di {minutes} minuti",
           "made_by_untimed": "{engine}, {when}"},
}


def phrases(spark: SparkSession) -> DataFrame:
    """Invented phrases of every language, as one set: ``key``."""
    it = spark.createDataFrame([(p,) for p in INVENTED_PHRASES["it"]], "key string")
    en = spark.createDataFrame([(p,) for p in INVENTED_PHRASES["en"]], "key string")
    return it.union(en).distinct()


def kinds(spark: SparkSession) -> DataFrame:
    """Note kinds with their heading per language: ``language, ord, name, heading``."""
    rows = [(lang, i, name, heading)
            for i, (name, en, it) in enumerate(NOTE_KINDS)
            for lang, heading in (("en", en), ("it", it))]
    return spark.createDataFrame(rows, "language string, ord int, name string, heading string")


def words_of(table: dict[str, list[str]], language: str) -> list[str]:
    """The list for ``language``; the English one for a language without its own."""
    return list(table.get(language, table["en"]))


def literal_array(words: list[str]):
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
