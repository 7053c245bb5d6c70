"""Sentences of ``prose`` in SQL: the abbreviation guard without lookbehind."""

from colloquy.functions import lexicons as lx

_ABBR = "|".join(a.replace(".", "\\.") for a in sorted(lx.ABBREVIATIONS, key=lambda a: (-len(a), a)))
_KEEP = f"(?i)((?:^|[ \\x1e''])(?:{_ABBR})[.!?…]+) "


def sentences(view: str, out: str, extra: str = "") -> str:
    """CTEs ending in ``out(recording_id, n, text)`` over ``view(recording_id, text)``.

    The space after an abbreviation is hidden first; twice, as matches share a space.
    """
    flat = "trim(regexp_replace(text,'\\s+',' ','g'))"
    kept = f"regexp_replace(regexp_replace({flat},'{_KEEP}','\\1'||chr(30),'g'),'{_KEEP}','\\1'||chr(30),'g')"
    return f"""{out}_0 as (select recording_id{extra}, string_split(regexp_replace({kept},'([.!?…]) ','\\1'||chr(31),'g'),chr(31)) as a from {view}),
 {out}_1 as (select recording_id{extra}, unnest(a) as text, generate_subscripts(a,1)-1 as n from {out}_0),
 {out} as (select recording_id{extra}, n, replace(text,chr(30),' ') as text from {out}_1 where text<>'')"""


SENTENCES = sentences("prose", "sents", ", language")
