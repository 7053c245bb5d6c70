"""Personal data replaced by keyed surrogates of the same type, gender, script and format.

The same person's entry gets the same surrogate in every document, two entries never share one, and no surrogate
is an entry that really occurs. Built from SQL functions alone: a text is split at its matches, each
match is looked up by what it means (a card by its digits, an address in lower case), and the
pieces are put together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.plans.store import materialise

MALE, FEMALE = ("Mr", "Herr", "Monsieur", "Señor", "Господин", "Κύριος"), ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Госпожа", "Κυρία")
NEUTRAL = ("Dr", "Prof")
_TITLE = f"(?:{'|'.join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))})"
_WORD = r"\p{Lu}[\p{L}'’-]{1,40}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"

#: Each type with its pattern; in a text the first that fits at a place wins. The patterns consume no unbounded
#: run twice, so that very long texts cost no more a character than short ones, and begin with a look at the
#: first character, which spares most words the rest.
PATTERNS = {
    "secret": r"""(?=[AaPpSsTt])(?i:password|passwd|pwd|secret|token|api[_-]?key)["']?\s{0,3}[=:]\s{0,3}["']?[^\s"']{6,}+""",
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,127}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "cloudkey": r"(?=A)(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?=[A-Z]{2}\d{2})[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip6": r"(?=[0-9A-Fa-f]{0,4}:)(?=[0-9A-Fa-f:]{0,38}\d)(?<![:.\w])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![:\w]|\.\d)",
    "ip": rf"(?=\d)(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "phone": r"(?=[\d+(])(?<![\d+])(?:(?:\+?\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|\+[1-9](?:[ .()/-]{0,2}\d){7,14}(?!\d))",
    "ssn": r"(?=\d)(?<!-)\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?=\d)\d(?:[ -]?\d){12,}+",       # a whole run of groups; cards are looked for in it
    "name": rf"(?=[MHSDPFГΚ])(?<!\p{{L}}){_TITLE}\.?\s{_WORD}(?:\s{_WORD})?",
}
PATTERN = r"(?<![A-Za-z0-9])(?:" + "|".join(PATTERNS.values()) + ")"
#: For what is left of a run of digits, and the text around it.
WITHOUT_CARDS = r"(?<![A-Za-z0-9])(?:" + "|".join(p for name, p in PATTERNS.items() if name != "card") + ")"
#: A phone number of ten digits, which is the same with or without a country before it.
TEN_DIGITS = r"^(?:\+?\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}$"
#: Texts without any of these have no match; most texts are done with that.
SIGNS = ("@", "=", ":", "AKIA", "ASIA", *(t for t in MALE + FEMALE + NEUTRAL if not any(o != t and o in t for o in MALE + FEMALE + NEUTRAL)))
DIGITS = r"[0-9]\.[0-9]|[0-9]{2}"


def rough(text: Column) -> Column:
    """Whether a text may have a match; cheap."""
    found = text.rlike(DIGITS)
    for sign in SIGNS:
        found = F.contains(text, F.lit(sign)) | found
    return found


#: Alphabets that letters keep to: digits, and lower and upper case of each script.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщыэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЫЭЮЯ",
             "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "àâäáçèéêëíîïñóôöùûüúß", "ÀÂÄÁÇÈÉÊËÍÎÏÑÓÔÖÙÛÜÚ")
#: Names are made of syllables; the ending tells the gender. Fixed values of this module.
SYLLABLES = {"latin": ("bdfglmnprstv", "aeiou", {"m": ("ro", "rt", "ld"), "f": ("na", "la", "lia"), "n": ("il", "en", "is"), "family": ("son", "mann", "ert", "ley")}),
             "cyrillic": ("бвгдклмнпрст", "аеиоу", {"m": ("н", "р", "слав"), "f": ("на", "ла", "ша"), "n": ("ли", "ни"), "family": ("енко", "ич", "ко")}),
             "greek": ("βγδκλμνπρστ", "αεηιο", {"m": ("ος", "ης", "ας"), "f": ("ια", "να", "ρα"), "n": ("ιν", "ον"), "family": ("ιδης", "ακης", "ου")})}


def _pick(options: str | tuple, number: Column) -> Column:
    return F.get(F.array(*[F.lit(o) for o in options]), (number % len(options)).cast("int"))


def _mapped(text: Column, stream: Column, alphabets: tuple[str, ...] = ALPHABETS) -> Column:
    """Every letter and digit replaced within its alphabet; anything else stays."""
    def one(char: Column, i: Column) -> Column:
        out = char
        for letters in alphabets:
            out = F.when(F.instr(F.lit(letters), char) > 0, F.substring(F.lit(letters), F.get(stream, i) % len(letters) + 1, 1)).otherwise(out)
        return F.when(char == "", "").otherwise(out)
    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(body: Column) -> Column:
    """The check digit behind the digits of ``body``."""
    digits = F.transform(F.split(F.reverse(body), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2).otherwise(c.cast("int")))
    total = F.aggregate(digits, F.lit(0), lambda acc, d: acc + F.when(d > 9, d - 9).otherwise(F.coalesce(d, F.lit(0))))
    return ((10 - total % 10) % 10).cast("string")


def _iban_check(country: Column, account: Column) -> Column:
    chars = F.split(F.concat(account, country, F.lit("00")), "")
    rest = F.aggregate(chars, F.lit(0), lambda acc, c: F.when(c == "", acc).when(c.rlike("[A-Z]"), (acc * 100 + F.ascii(c) - 55) % 97)
                       .otherwise((acc * 10 + F.coalesce(c.cast("int"), F.lit(0))) % 97))
    return F.lpad((98 - rest).cast("string"), 2, "0")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _is_luhn(text: Column) -> Column:
    """Whether a text has 13 to 19 digits, the last of which checks the others."""
    digits = _digits(text)
    return F.length(digits).between(13, 19) & (_luhn(digits.substr(F.lit(1), F.length(digits) - 1)) == digits.substr(F.length(digits), F.lit(1)))


def _cards_in(run: Column) -> Column:
    """A run of digit groups as pieces: from each group on the longest row of groups that passes the card check, the rest as kind ``run``."""
    def piece(kind, text):
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    def joined(groups, first, n):
        return F.array_join(F.slice(groups, first + 1, n), "")

    def found(groups):
        size = F.size(groups)

        def step(state, i):
            # Groups have a digit at least: a card has 19 groups at most.
            lengths = F.filter(F.sequence(F.least(F.lit(19), size - i), F.lit(1), F.lit(-1)), lambda n: _is_luhn(joined(groups, i, n)))
            n = F.when(i >= state["at"], F.get(lengths, F.lit(0)))
            return F.transform(F.array(n), lambda n: F.when(n.isNull(), state).otherwise(F.struct(
                (i + n).alias("at"), F.concat(state["out"], F.array(F.struct(i.alias("first"), n.alias("n")))).alias("out"))))[0]
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,n:int>>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), size - 1), start, step, lambda state: state["out"])

    def cut(groups):
        def pieces(cards):
            upto = lambda k: F.when(k < 0, 0).otherwise(F.get(cards, k)["first"] + F.get(cards, k)["n"])
            each = F.transform(cards, lambda c, k: F.array(piece("run", joined(groups, upto(k - 1), c["first"] - upto(k - 1))),
                                                           piece("card", F.regexp_replace(joined(groups, c["first"], c["n"]), "[ -]$", "")),
                                                           piece("run", F.regexp_extract(joined(groups, c["first"], c["n"]), "[ -]?$", 0))))
            last = upto(F.size(cards) - 1)
            return F.concat(F.flatten(each), F.array(piece("run", joined(groups, last, F.size(groups) - last))))
        return F.flatten(F.transform(F.array(found(groups)), pieces))
    return F.flatten(F.transform(F.array(F.regexp_extract_all(run, F.lit("[0-9]+[ -]?"), F.lit(0))), cut))


def _ip6(text: Column) -> Column:
    """The eight groups of an IPv6 address, in lower case and without zeros at their beginning."""
    half = lambda n: F.filter(F.split(F.substring_index(F.lower(text), "::", n), ":"), lambda g: g != "")
    zeros = F.array_repeat(F.lit("0"), F.greatest(8 - F.size(half(1)) - F.size(half(-1)), F.lit(0)))
    groups = F.when(F.contains(text, F.lit("::")), F.concat(half(1), zeros, half(-1))).otherwise(F.split(F.lower(text), ":"))
    return F.array_join(F.transform(groups, lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")


def kind_of(match: Column) -> Column:
    """The type of a match; null for runs of digits that fail the card check."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        found = match.rlike(f"^(?:{pattern})$")
        kind = F.when(found & _is_luhn(match) if name == "card" else found, name).otherwise(kind)
    return kind


def parts_of(match: Column) -> Column:
    """A match as pieces ``(kind, text)``: entries to replace, and text to keep (kind null)."""
    def piece(kind, text):
        return F.struct(F.lit(kind).cast("string").alias("kind") if not isinstance(kind, Column) else kind.alias("kind"), text.alias("text"))
    kind = kind_of(match)
    lead = r"""^(?s)(.{0,40}?["']?\s{0,3}[=:]\s{0,3}["']?)(.*)$"""
    named = rf"^({_TITLE}\.?\s)({_WORD})(?:(\s)({_WORD}))?$"
    title = F.regexp_extract(match, named, 1)
    gender = F.when(title.rlike(rf"^(?:{'|'.join(MALE)})\b"), "m").when(title.rlike(rf"^(?:{'|'.join(FEMALE)})\b"), "f").otherwise("n")
    first, second = F.regexp_extract(match, named, 2), F.regexp_extract(match, named, 4)
    two = second != ""
    name = F.when(two, F.array(piece(None, title), piece(F.concat(F.lit("given_"), gender), first), piece(None, F.regexp_extract(match, named, 3)), piece("family", second))
                  ).otherwise(F.array(piece(None, title), piece("family", first)))
    secret = F.array(piece(None, F.regexp_extract(match, lead, 1)), piece("secret", F.regexp_extract(match, lead, 2)))
    return F.when(kind == "name", name).when(kind == "secret", secret).when(kind.isNull(), _cards_in(match)).otherwise(F.array(piece(kind, match)))


def meaning(kind: Column, text: Column) -> Column:
    """What makes two entries the same: digits, lower case, or the text itself."""
    phone = F.when(text.rlike(TEN_DIGITS), F.right(_digits(text), F.lit(10))).otherwise(F.concat(F.lit("+"), _digits(text)))
    return (F.when(kind == "phone", phone).when(kind == "ip6", _ip6(text)).when(kind.isin("card", "ssn"), _digits(text)).when(kind == "iban", F.replace(text, F.lit(" "), F.lit("")))
            .when(kind == "email", F.lower(text)).when(kind.startswith("given_") | (kind == "family"), F.lower(text)).otherwise(text))


#: Rounds of drawing; spaces widen in the first sixteen.
ATTEMPTS = 64


def surrogates(entries: DataFrame, key: str) -> DataFrame:
    """``entries(kind, entry, attempt)`` with ``made``: the surrogate drawn at an attempt, a pure function of the row and the key.

    The keyed stream of numbers (0 to 65535, more than one for each character) is a column of its own, so that it is made once a row.
    """
    seed, size = F.concat_ws("|", F.lit(key), "kind", F.col("attempt").cast("string"), "entry"), F.length("entry") + 24
    # Numbers are cut from the hash they lie in: from one joined string, each cut would walk there from the start.
    hashes = F.transform(F.sequence(F.lit(0), F.floor(size / 16).cast("int")), lambda i: F.sha2(F.concat(seed, F.lit("|"), i.cast("string")), 256))
    numbers = F.flatten(F.transform(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: F.conv(F.substring(h, j * 4 + 1, 4), 16, 10).cast("int"))))
    drawn = entries.withColumn("stream", F.slice(numbers, F.lit(1), size + 1))
    return drawn.withColumn("made", _drawn(F.col("kind"), F.col("entry"), F.col("attempt"), F.col("stream"))).drop("stream")


def _drawn(kind: Column, entry: Column, attempt: Column, s: Column) -> Column:
    at = lambda i: F.get(s, F.lit(i))
    tail = F.when(attempt < 8, "").otherwise(attempt.cast("string"))      # where a short form has too few surrogates
    local, domain = F.substring_index(entry, "@", 1), F.substring_index(entry, "@", -1)
    top = F.substring_index(domain, ".", -1)
    under = F.regexp_extract(domain, r"^(.*\.)[^.]+\.[^.]+$", 1)
    email = F.concat(_mapped(local, s), tail, F.lit("@"), _mapped(under, F.reverse(s)), F.lit("example."), top)
    octets = F.split(entry, r"\.")
    a, b = F.get(octets, F.lit(0)).cast("int"), F.get(octets, F.lit(1)).cast("int")
    inside = (a == 10) | (a == 127) | ((a == 192) & (b == 168))
    shared = (a == 172) & b.between(16, 31)
    public = at(0) % 100 + 11       # 11 to 110: neither private nor local
    # A private address keeps its block while that is likely to have room, then moves to the largest private one, then to public ones.
    stays = attempt < 4
    ip = F.concat_ws(".", F.when(inside | shared, F.when(stays, a).when(attempt < 16, F.lit(10)).otherwise(public)).otherwise(public).cast("string"),
                     F.when((a == 192) & inside & stays, b).when(shared & stays, at(1) % 16 + 16).otherwise(at(1) % 256).cast("string"), (at(2) % 256).cast("string"), (at(3) % 254 + 1).cast("string"))
    mapped = _mapped(entry, s)
    body = F.concat(F.left(entry, F.lit(1)), mapped.substr(F.lit(2), F.length(entry) - 2))
    phone = F.concat((at(20) % 8 + 2).cast("string"), mapped.substr(2, 2), (at(21) % 8 + 2).cast("string"), mapped.substr(F.lit(5), F.length(entry)))
    # International numbers keep the first two digits while that gives enough numbers.
    abroad = F.when(attempt < 8, F.concat(F.left(entry, F.lit(3)), mapped.substr(F.lit(4), F.length(entry)))).otherwise(
        F.concat(F.lit("+"), (at(20) % 9 + 1).cast("string"), mapped.substr(F.lit(3), F.length(entry))))
    phone = F.when(entry.startswith("+"), abroad).otherwise(phone)
    # Groups of an IPv6 address keep their length, and zeros stay, while that gives enough addresses.
    low = lambda g: F.when(attempt < 8, F.pow(F.lit(16), F.length(g) - 1)).otherwise(4096).cast("int")
    ip6 = F.array_join(F.transform(F.split(entry, ":"), lambda g, i: F.when((attempt < 8) & ((g == "0") | ((i == 0) & g.rlike("^f[c-f]"))), g)
                                   .otherwise(F.lower(F.hex(low(g) + F.get(s, i) % (low(g) * 15))))), ":")
    ssn = F.concat((at(10) % 5 + 1).cast("string"), mapped.substr(2, 2), _pick(tuple("123456789"), at(11)), mapped.substr(5, 1), mapped.substr(6, 3), _pick(tuple("123456789"), at(12)))
    country, account = F.left(entry, F.lit(2)), mapped.substr(F.lit(5), F.length(entry))
    iban = F.concat(country, _iban_check(country, account), account)
    secret = F.concat(F.when(entry.rlike("^[0-9a-f]+$"), _mapped(entry, s, ("0123456789abcdef",))).otherwise(mapped), tail)
    cloud = F.concat(F.left(entry, F.lit(4)), _mapped(entry.substr(F.lit(5), F.length(entry)), s, ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0189")))
    role = F.regexp_replace(kind, "^given_", "")
    name = None
    for script, (onsets, vowels, endings) in SYLLABLES.items():
        ending = F.when(role == "m", _pick(endings["m"], at(6))).when(role == "f", _pick(endings["f"], at(6))).when(role == "n", _pick(endings["n"], at(6))).otherwise(_pick(endings["family"], at(6)))
        more = F.when(attempt < 1, "").otherwise(F.concat(_pick(tuple(onsets), at(7)), _pick(tuple(vowels), at(8)), F.when(attempt < 4, "").otherwise(_mapped(F.repeat(F.lit(onsets[0]), (attempt / 4).cast("int")), s, (onsets,)))))
        made = F.concat(_pick(tuple(onsets), at(0)), _pick(tuple(vowels), at(1)), _pick(tuple(onsets), at(2)), _pick(tuple(vowels), at(3)), more, _pick(tuple(onsets), at(4)), _pick(tuple(vowels), at(5)), ending)
        name = made if name is None else F.when(entry.rlike(r"\p{IsCyrillic}" if script == "cyrillic" else r"\p{IsGreek}"), made).otherwise(name)
    return (F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "ip6", ip6).when(kind == "card", F.concat(body, _luhn(body))).when(kind == "phone", phone).when(kind == "ssn", ssn)
            .when(kind == "iban", iban).when(kind == "cloudkey", cloud).when(kind == "secret", secret).otherwise(name))


def render(kind: Column, text: Column, made: Column) -> Column:
    """A surrogate in the format of the mention: its separators and letter case."""
    back = F.reverse(made)
    numbers = F.aggregate(F.split(F.reverse(text), ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), lambda acc, c: F.struct(
        F.concat(acc["out"], F.when(c.rlike(r"\d") & (acc["at"] <= F.length(back)), F.substring(back, acc["at"], 1)).otherwise(c)).alias("out"),
        F.when(c.rlike(r"\d"), acc["at"] + 1).otherwise(acc["at"]).alias("at")), lambda acc: F.reverse(acc["out"]))
    spaced = F.when(F.contains(text, F.lit(" ")), F.trim(F.regexp_replace(made, "(.{4})", "$1 "))).otherwise(made)
    short = F.regexp_replace(made, "^(.*?)(?:^|:)0(?::0)*(?:$|:)(.*)$", "$1::$2")
    padded = F.array_join(F.transform(F.split(made, ":"), lambda g: F.lpad(g, 4, "0")), ":")
    ip6 = F.when(F.contains(text, F.lit("::")), short).when(F.length(text) == 39, padded).otherwise(made)
    caps = (F.upper(text) == text) & (F.lower(text) != text)
    return (F.when(kind.isin("phone", "card", "ssn"), numbers).when(kind == "iban", spaced).when(kind == "ip6", F.when(caps, F.upper(ip6)).otherwise(ip6)).when((kind == "email") & caps, F.upper(made))
            .when(kind.startswith("given_") | (kind == "family"), F.when(caps & (F.length(text) > 1), F.upper(made)).otherwise(F.initcap(made))).otherwise(made))


def draw(entries: DataFrame, key: str) -> DataFrame:
    """``(kind, entry, made)``: a distinct surrogate for each of the distinct ``entries(kind, entry)``.

    All entries draw; an entry whose draw is a real entry, or was drawn by another with fewer
    attempts (or a smaller entry), draws again, until none has to. Every round is written. An error says if a kind's
    surrogates run out: after ``ATTEMPTS`` rounds, of which each leaves a share of the clashes that only a nearly full space keeps.
    """
    # Entries are few bytes but work to draw: they are spread over all tasks.
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = entries.select("kind", "entry", F.lit(0).alias("attempt")).repartition(parts, "kind", "entry")
    state, attempts = materialise(surrogates(spread, key)), 0
    while True:
        real = state.select("kind", F.col("entry").alias("made")).withColumn("real", F.lit(True))
        first = state.groupBy("kind", "made").agg(F.min(F.struct("attempt", "entry")).alias("first"), F.count("*").alias("drawn"))
        # Draws that clash are rare: only they are joined back to the entries.
        clash = first.join(real, ["kind", "made"], "left").where("real or drawn > 1").select("kind", "made", "first", F.coalesce("real", F.lit(False)).alias("real"))
        clash = materialise(clash)
        if clash.isEmpty():
            return state.select("kind", "entry", "made")
        attempts += 1
        if attempts > ATTEMPTS:
            kinds = [r["kind"] for r in clash.select("kind").distinct().collect()]      # a few names
            raise RuntimeError(f"no distinct surrogates are left for {', '.join(sorted(kinds))}")
        loses = F.coalesce(F.col("real") | (F.col("first.entry") != F.col("entry")), F.lit(False))
        judged = materialise(state.join(clash, ["kind", "made"], "left").select("kind", "entry", "attempt", "made", loses.alias("loses")))
        again = surrogates(judged.where("loses").select("kind", "entry", (F.col("attempt") + 1).alias("attempt")), key)
        state = materialise(judged.where("not loses").drop("loses").unionByName(again))


def pseudonymise(df: DataFrame, text: str = "text", key: str = "colloquy", count: str | None = None) -> DataFrame:
    """``df`` with the personal data of column ``text`` replaced; ``count`` names a column for how many entries were.

    Null and empty texts stay as they are. All other columns and repeated rows are kept, whatever their
    names. Texts without an entry are not shuffled; of the others, entries meet as distinct meanings, and a
    text's surrogates are looked up once for all its copies.
    """
    counted = [F.lit(0).alias(count)] if count else []
    has = F.coalesce(rough(F.col(f"`{text}`")) & F.col(f"`{text}`").rlike(PATTERN), F.lit(False))
    dirty = df.where(has).select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(text).alias("t")).withColumn("digest", F.sha2("t", 256))
    literal = lambda x: F.array(F.struct(F.lit(None).cast("string").alias("kind"), x.alias("text")))


    def cut(t, pattern):
        matches, gaps = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.split(t, pattern, -1)
        return F.flatten(F.transform(F.arrays_zip(gaps.alias("gap"), matches.alias("match")), lambda p: F.when(p["match"].isNull(), literal(p["gap"])).otherwise(F.concat(literal(p["gap"]), parts_of(p["match"])))))

    def joined(state, p):
        own = F.concat(state["open"], p["text"])
        return F.when(p["kind"].isNull() | (p["kind"] == "run"), F.struct(own.alias("open"), state["out"].alias("out"))).otherwise(
            F.struct(F.lit("").alias("open"), F.concat(state["out"], literal(state["open"]), F.array(p)).alias("out")))
    # What a run of digits leaves is joined to the text around it again, and may hold other entries.
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<struct<kind:string,text:string>>").alias("out"))
    whole = F.aggregate("first", start, joined, lambda state: F.concat(state["out"], literal(state["open"])))
    again = F.flatten(F.transform(whole, lambda p: F.when(p["kind"].isNull(), cut(p["text"], WITHOUT_CARDS)).otherwise(F.array(p))))
    dirty = dirty.withColumn("first", cut(F.col("t"), PATTERN))
    pieces = F.when(F.exists("first", lambda p: F.coalesce(p["kind"] == "run", F.lit(False))), again).otherwise(F.col("first"))
    mentions = (dirty.select("digest", F.explode(pieces).alias("p")).where("p.kind is not null")
                .select("digest", "p.kind", meaning(F.col("p.kind"), F.col("p.text")).alias("entry")).distinct())
    mentions = materialise(mentions)
    drawn = draw(mentions.select("kind", "entry").distinct(), key)
    maps = (mentions.join(drawn, ["kind", "entry"]).groupBy("digest")
            .agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "entry").alias("k"), F.col("made").alias("v")))).alias("made")))
    made = lambda p: F.element_at("made", F.concat_ws("|", p["kind"], meaning(p["kind"], p["text"])))
    done = F.array_join(F.transform("pieces", lambda p: F.when(p["kind"].isNull(), p["text"]).otherwise(render(p["kind"], p["text"], made(p)))), "")
    joined = dirty.join(maps, "digest", "left").withColumn("pieces", pieces)
    number = F.size(F.filter("pieces", lambda p: p["kind"].isNotNull()))
    replaced = joined.select(*[(F.when(F.col("made").isNull(), F.col("t")).otherwise(done) if c == text else F.col(f"row.`{c}`")).alias(c) for c in df.columns],
                             *([number.alias(count)] if count else []))
    return df.where(~has).select(*[F.col(f"`{c}`") for c in df.columns], *counted).unionByName(replaced)
