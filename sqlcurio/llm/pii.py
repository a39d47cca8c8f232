"""PII surrogates: keyed, type-consistent replacements with collision checks, in SQL expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlcurio.llm.common import discard, discard_all, materialise

#: Titles of persons by gender.
MALE_TITLES = ["Mr", "Herr", "Señor", "Sr", "Sir", "Monsieur", "Господин", "Κύριος"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Señorita", "Lady", "Madame", "Mme", "Mademoiselle", "Госпожа", "Κυρία"]
NEUTRAL_TITLES = ["Dr", "Prof", "Professor", "Doctor"]
_either = lambda words: "|".join(sorted(words, key=len, reverse=True))
_ALL_TITLES = [*MALE_TITLES, *FEMALE_TITLES, *NEUTRAL_TITLES]
#: Behind a look at the first letter, which spares most places the alternatives.
_TITLES = f"(?=[{''.join(sorted({t[0] for t in _ALL_TITLES}))}])(?:{_either(_ALL_TITLES)})\\.?(?: (?:{_either(NEUTRAL_TITLES)})\\.?){{0,4}}"
#: What stands small between a title or given name and a family's name.
PARTICLES = ["von", "van", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "zu", "zum", "ter"]
#: Initials and particles before a name; they stay.
_BEFORE = rf"(?:(?:\p{{Lu}}\.|{'|'.join(PARTICLES)}) ){{0,4}}"
_NAME = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}+(?:\p{Lu}\p{Ll}+)?"
_KEYS = "(?:AKIA|ghp_|sk-|xox[bp]-)"
_PASSWORD = r"(?i:passw(?:or)?d|pwd|api[_-]?key)[\"']? ?[=:] ?[\"']?"

#: Private characters that part cells and fields while a text is taken apart; those that a text has are escaped.
CELL, FIELD, ESCAPE = "\uf8f0", "\uf8f1", "\uf8f2"

#: In order of precedence: a match is of the first kind that fits at its place. Every repeat of a group,
#: and every run that may start at many places, is bounded, so that no text overflows the stack of the
#: matcher or takes more than time in proportion to its length.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}])[\p{L}\p{N}](?:[\p{L}\p{N}._%+-]{0,252}[\p{L}\p{N}_%+-])?@[A-Za-z0-9-]{1,252}(?:\.[A-Za-z0-9-]{1,63}){0,126}\.[A-Za-z]{2,63}",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "ip6": r"(?<![\w:])(?=[A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})(?![\w:])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)|(?<![\w.,:/+-])0\d{2,4}[ /-]\d{5,8}(?![\w-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "iban": r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\d])",
    "secret": rf"(?<![\p{{L}}\d])(?:(?=[A-Fa-f]*\d)(?:[a-f0-9]{{32,}}|[A-F0-9]{{32,}})|{_KEYS}[A-Za-z0-9_-]{{16,}})(?![\p{{L}}\d])|(?<!\p{{L}}){_PASSWORD}[^\s\"'{CELL}-{ESCAPE}]{{6,}}",
    "card": r"(?<!\d)(?<!\d[.-])\d(?:[ -]?\d){12,18}(?!-?\d)",
    "name": rf"(?<!\p{{L}}){_TITLES} {_BEFORE}{_NAME}(?:[ -]{_BEFORE}{_NAME}){{0,2}}",
}
ANY = "|".join(f"({p})" for p in PATTERNS.values())
#: What every match holds; most texts hold none and skip the long pattern.
SIGN = rf"[0-9@]|{_TITLES} [\p{{Lu}}{''.join(sorted({p[0] for p in PARTICLES}))}]|{_KEYS}|{_PASSWORD}"
#: Attempts after which a surrogate grows by one more character.
WIDER = 4
MOST_ROUNDS = 200
#: Longer matches get the digits of a hash in place of a swap for each character.
LONG_RUN = 512
NAMES = ["family", "given_f", "given_m", "given_n"]

#: Syllables and endings of made-up names by script.
SCRIPTS = {
    "latin": {
        "syllables": ["ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "go", "ha", "he", "ka", "ke", "ko", "la", "le", "li", "lo", "ma", "me", "mi", "na", "ne", "no", "pa", "ra", "re", "ri", "ro", "sa", "se", "ta", "te", "ti", "to", "va", "ve", "vi", "za"],
        "m": ["n", "r", "s"], "f": ["na", "ra", "la"], "n": ["n", "l", "m"], "upper": "[A-Z]",
    },
    "cyrillic": {
        "syllables": ["ба", "бе", "бо", "ва", "ве", "во", "га", "го", "да", "де", "до", "за", "ка", "ко", "ла", "ле", "ли", "ло", "ма", "ме", "ми", "на", "не", "но", "па", "по", "ра", "ре", "ри", "ро", "са", "се", "та", "те", "ти", "то"],
        "m": ["н", "р", "с"], "f": ["на", "ра", "ла"], "n": ["н", "л", "м"], "upper": "[А-Я]",
    },
    "greek": {
        "syllables": ["βα", "βε", "γα", "γο", "δα", "δε", "δο", "κα", "κο", "λα", "λε", "λι", "λο", "μα", "με", "μι", "να", "νε", "νο", "πα", "πο", "ρα", "ρε", "ρι", "ρο", "σα", "σε", "τα", "τε", "τι", "το"],
        "m": ["ς", "ν"], "f": ["να", "ρα", "λα"], "n": ["ν", "ρ"], "upper": "[Α-Ω]",
    },
}


def normal(match: Column, kind: Column) -> Column:
    """What makes two mentions one entity: digits of numbers, parts of names as they are, else lower case."""
    digits = F.regexp_replace(match, r"\D", "")
    return (
        F.when(kind.isin("card", "phone", "ssn"), digits)
        .when(kind == "iban", F.replace(match, F.lit(" "), F.lit("")))
        .when(kind.isin("secret", *NAMES), match)
        .otherwise(F.lower(match))
    )


def taken_apart(text: Column) -> Column:
    """Cells of a text: what lies between matches at even places, matches as a field per kind at odd ones."""
    safe = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0"))
    for number, mark in ((1, CELL), (2, FIELD)):
        safe = F.replace(safe, F.lit(mark), F.lit(f"{ESCAPE}{number}"))
    fields = FIELD.join(f"${k + 1}" for k in range(len(PATTERNS)))
    return F.split(F.regexp_replace(safe, F.lit(ANY), F.lit(f"{CELL}{fields}{CELL}")), CELL, -1)


def unescaped(text: Column) -> Column:
    for number, mark in ((2, FIELD), (1, CELL), (0, ESCAPE)):
        text = F.replace(text, F.lit(f"{ESCAPE}{number}"), F.lit(mark))
    return text


def _kind(cell: Column) -> Column:
    place = F.array_position(F.transform(F.split(cell, FIELD, -1), lambda x: x != ""), True)
    return F.element_at(F.array(*map(F.lit, [*PATTERNS, "mention"])), place.cast("int"))


def _tokens(match: Column) -> tuple[Column, Column]:
    """Title and the further names with what lies between them."""
    title = F.regexp_extract(match, rf"\A({_TITLES} {_BEFORE})", 1)
    return title, F.split(F.substr(match, F.length(title) + 1, F.length(match)), "(?<=[ -])|(?=[ -])", -1)


def name_roles(cells: Column) -> Column:
    """(token, role) of the names behind titles: the last is the family's, those before are given, by gender."""

    def of(cell: Column) -> Column:
        title, tokens = _tokens(F.replace(cell, F.lit(FIELD), F.lit("")))
        says = lambda words: F.regexp_extract(title, rf"\b(?:{_either(words)})\b", 0) != ""
        given = F.when(says(FEMALE_TITLES), "given_f").when(says(MALE_TITLES), "given_m").otherwise("given_n")
        role = lambda k: F.when(k == F.size(tokens) - 1, "family").otherwise(given)
        return F.filter(F.transform(tokens, lambda t, k: F.struct(t.alias("token"), role(k).alias("role"))), lambda x: x["token"].rlike(r"\A\p{Lu}\p{L}|\A\p{Lu}['’]"))

    odd = F.filter(cells, lambda c, k: (k % 2 == 1) & (_kind(c) == "name"))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(odd, of))))


def with_mentions(cells: Column, roles: Column) -> Column:
    """Cells in which later mentions of the names, whole or in part, are matches as well."""
    names = F.array_join(F.array_distinct(F.transform(roles, lambda r: r["token"])), "|")
    one = F.concat(F.lit("(?:"), names, F.lit(")"))
    pattern = F.concat(F.lit(r"(?<!\p{L})"), one, F.lit("(?:[ -]"), one, F.lit(r"){0,8}(?!\p{L})"))
    marked = f"{CELL}{FIELD * len(PATTERNS)}$0{CELL}"
    again = F.transform(cells, lambda c, k: F.when(k % 2 == 0, F.regexp_replace(c, pattern, F.lit(marked))).otherwise(c))
    return F.when(F.size(roles) > 0, F.split(F.array_join(again, CELL), CELL, -1)).otherwise(cells)


def parts_of(cells: Column, roles: Column) -> Column:
    """(kind, text) in order, kind null for what stays; each name is a part of its own."""
    part = lambda kind, text: F.struct(kind.alias("kind"), text.alias("text"))
    stays = F.lit(None).cast("string")

    def split(cell: Column, k: Column) -> Column:
        kind, match = _kind(cell), F.replace(cell, F.lit(FIELD), F.lit(""))
        title, tokens = _tokens(match)
        female, male = (F.regexp_extract(title, rf"\b(?:{_either(w)})\b", 0) != "" for w in (FEMALE_TITLES, MALE_TITLES))
        given = F.when(female, "given_f").when(male, "given_m").otherwise("given_n")
        known = lambda t: F.filter(roles, lambda r: r["token"] == t)[0]["role"]
        role = lambda t, n: F.when(kind == "mention", known(t)).when(n == F.size(tokens) - 1, "family").otherwise(given)
        named = F.transform(tokens, lambda t, n: part(F.when(t.rlike(r"\A\p{Lu}\p{L}|\A\p{Lu}['’]"), role(t, n)), t))
        plain = F.array(part(stays, unescaped(cell)))
        return F.when(k % 2 == 0, plain).when(kind.isin("name", "mention"), F.concat(F.array(part(stays, title)), named)).otherwise(F.array(part(kind, match)))

    return F.flatten(F.transform(cells, split))


def _draw(stream: Column, k: Column | int) -> Column:
    """A number below 65536 for place k (from 0) out of a hex digest of 128 digits."""
    return F.conv(F.substr(stream, (F.lit(k) * 3) % 124 + 1, F.lit(4)), 16, 10).cast("int")


def _masked(text: Column, stream: Column, hexadecimal: Column) -> Column:
    """Every letter or digit replaced by one of its kind, script and case (or hexadecimal); the rest stays."""
    low = F.when(hexadecimal, "0123456789abcdef").otherwise("abcdefghijklmnopqrstuvwxyz")
    high = F.when(hexadecimal, "0123456789ABCDEF").otherwise("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    digits = F.when(hexadecimal, "0123456789abcdef").otherwise("0123456789")
    alphabets = {"[0-9]": digits, "[a-z]": low, "[A-Z]": high, "[а-яё]": "абвгдежзиклмнопрстуфхцчшэюя", "[А-ЯЁ]": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"}
    alphabets |= {"[α-ω]": "αβγδεζηθικλμνξοπρστυφχψω", "[Α-Ω]": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", r"\p{Ll}": low, r"\p{Lu}": high}

    def swap(c: Column, k: Column) -> Column:
        alphabet = F.coalesce(*[F.when(c.rlike(p), a if isinstance(a, Column) else F.lit(a)) for p, a in alphabets.items()])
        return F.coalesce(F.substr(alphabet, _draw(stream, k) % F.length(alphabet) + 1, F.lit(1)), c)

    # a run too long for a key is hexadecimal digits of its stream, as a swap for each character takes microseconds
    digest = F.substr(F.repeat(stream, F.floor(F.length(text) / 128).cast("int") + 1), F.lit(1), F.length(text))
    cased = F.when(text == F.upper(text), F.upper(digest)).otherwise(digest)
    return F.when(F.length(text) > LONG_RUN, cased).otherwise(F.array_join(F.transform(F.split(text, "(?!^)(?!$)"), swap), ""))


def _digits_masked(text: Column, stream: Column, skip: int = 0) -> Column:
    """Digits replaced by the k-th digits of the stream, whatever stands between them; the first ``skip`` stay."""
    chars = F.split(text, "(?!^)(?!$)")
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def step(s: Column, c: Column) -> Column:
        is_digit = c.rlike(r"\d")
        new = F.when(is_digit & (s["k"] >= skip), (_draw(stream, s["k"]) % 10).cast("string")).otherwise(c)
        return F.struct(F.concat(s["out"], new).alias("out"), (s["k"] + is_digit.cast("int")).alias("k"))

    return F.aggregate(chars, state, step, lambda s: s["out"])


def _luhn_digit(body: Column) -> Column:
    """The check digit that completes the digits ``body``."""
    places = F.transform(F.split(F.reverse(body), "(?!^)(?!$)"), lambda c, k: F.when(k % 2 == 0, 2 * c.cast("int")).otherwise(c.cast("int")))
    total = F.aggregate(places, F.lit(0), lambda t, x: t + F.when(x > 9, x - 9).otherwise(x))
    return F.pmod(-total, F.lit(10))


def _card(match: Column, stream: Column) -> Column:
    """New digits behind the first one; the last keeps the number valid, or invalid, by Luhn."""
    old, new = F.regexp_replace(match, r"\D", ""), F.regexp_replace(_digits_masked(match, stream, 1), r"\D", "")
    head = lambda d: F.substr(d, F.lit(1), F.length(d) - 1)
    valid = _luhn_digit(head(old)) == F.substr(old, F.length(old), F.lit(1)).cast("int")
    last = F.pmod(_luhn_digit(head(new)) + F.when(valid, F.lit(0)).otherwise(1 + _draw(stream, 40) % 9), F.lit(10))
    masked = _digits_masked(match, stream, 1)
    return F.concat(F.substr(masked, F.lit(1), F.length(masked) - 1), last.cast("string"))


def _mod97(digits: Column) -> Column:
    """The remainder of an account number, letters as 10 to 35."""
    step = lambda r, c: F.when(c.rlike(r"\d"), (r * 10 + c.try_cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(digits, "(?!^)(?!$)"), F.lit(0), step)


def _iban(match: Column, account: Column, stream: Column) -> Column:
    """A new account of the country; its check digits are valid, or not, as before, and the blanks stand where they stood."""
    country, old, given = F.substr(match, F.lit(1), F.lit(2)), F.replace(match, F.lit(" "), F.lit("")), F.substr(match, F.lit(5), F.length(match))
    valid = _mod97(F.concat(F.substr(old, F.lit(5), F.length(old)), F.substr(old, F.lit(1), F.lit(4)))) == 1
    check = 98 - _mod97(F.concat(account, country, F.lit("00")))
    check = F.when(valid, check).otherwise((check - 2 + 1 + _draw(stream, 40) % 96) % 97 + 2)
    state = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    step = lambda s, c: F.struct(F.concat(s["out"], F.when(c == " ", c).otherwise(F.substr(account, s["k"], F.lit(1)))).alias("out"), (s["k"] + (c != " ").cast("int")).alias("k"))
    spaced = F.aggregate(F.split(given, "(?!^)(?!$)"), state, step, lambda s: s["out"])
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), spaced)


def _token(token: Column, role: Column, key: str, attempt: Column) -> Column:
    """A name made from syllables of its script, a given one by gender; of another script by its letters."""
    stream = F.sha2(F.concat_ws("\x01", F.lit(key), role, token, attempt.cast("string")), 512)
    own = lambda what: F.split(F.coalesce(*[F.when(token.rlike(rf"\A{x['upper']}"), " ".join(x[what])) for x in SCRIPTS.values()]), " ")
    pick = lambda values, n: F.element_at(values, _draw(stream, n) % F.size(values) + 1)
    syllables, male = own("syllables"), own("m")
    ending = F.when(role == "given_f", pick(own("f"), 3)).when(role == "given_m", pick(male, 3)).when(role == "given_n", pick(own("n"), 3)).otherwise(F.concat(pick(syllables, 4), pick(male, 5)))
    stem = F.transform(F.sequence(F.lit(0), 2 + F.floor(attempt / WIDER).cast("int")), lambda n: pick(syllables, F.when(n < 3, n).otherwise(n + 5)))
    return F.coalesce(F.initcap(F.concat(F.array_join(stem, ""), ending)), _masked(token, stream, F.lit(False)))


def surrogate(match: Column, kind: Column, key: str, attempt: Column) -> Column:
    """The replacement of ``match``: the same for all mentions of an entity, in the mention's own format.

    After each WIDER attempts it has one character more than the mention: where a format is used up it gives way.
    """
    stream = F.sha2(F.concat_ws("\x01", F.lit(key), kind, normal(match, kind), attempt.cast("string")), 512)
    more = F.floor(attempt / WIDER).cast("int")
    wide = F.when(kind.isin("phone", "ssn", "iban", "card"), F.concat(match, F.repeat(F.lit("0"), more))).when(kind == "secret", F.concat(match, F.repeat(F.lit("a"), more))).otherwise(match)
    domain = F.regexp_extract(match, "@(.*)$", 1)
    tail = F.regexp_extract(domain, r"(\.[A-Za-z]+)$", 1)
    by_domain = F.sha2(F.concat_ws("\x01", F.lit(key), F.lit("domain"), F.lower(domain)), 512)
    country = F.when(kind == "phone", F.regexp_extract(match, r"^(\+\d{1,3}[ .(-]|0(?=\d))", 1)).otherwise("")
    prefix = F.regexp_extract(match, rf"^({_KEYS}|{_PASSWORD})", 1)
    local = F.concat(F.regexp_extract(match, "^(.*)@", 1), F.repeat(F.lit("a"), more))
    account = F.replace(F.substr(wide, F.lit(5), F.length(wide)), F.lit(" "), F.lit(""))
    subject = F.when(kind == "email", local).when(kind == "iban", account).when(kind == "secret", F.substr(wide, F.length(prefix) + 1, F.length(wide))).when(kind == "ip6", match)
    masked = _masked(subject, stream, (kind == "ip6") | ((kind == "secret") & (prefix == "")))
    host = _masked(F.substr(domain, F.lit(1), F.length(domain) - F.length(tail)), by_domain, F.lit(False))
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: (_draw(stream, k) % 254 + 1).cast("string")), ".")
    numbers = F.concat(country, _digits_masked(F.substr(wide, F.length(country) + 1, F.length(wide)), stream))
    return (
        F.when(kind == "email", F.concat(masked, F.lit("@"), host, tail)).when(kind == "ip", octets).when(kind == "ip6", masked).when(kind.isin("phone", "ssn"), numbers)
        .when(kind == "iban", _iban(wide, masked, stream)).when(kind == "secret", F.concat(prefix, masked)).when(kind == "card", _card(wide, stream)).otherwise(_token(match, kind, key, attempt))
    )


def entities(found: DataFrame) -> DataFrame:
    """(space, kind, norm, mention): the distinct entities of the column ``parts``; all names share a space."""
    rows = found.select(F.explode(F.filter("parts", lambda p: p["kind"].isNotNull())).alias("p")).select(F.col("p.kind").alias("kind"), F.col("p.text").alias("mention"))
    rows = rows.groupBy("kind", normal(F.col("mention"), F.col("kind")).alias("norm")).agg(F.min("mention").alias("mention"))
    return rows.select(F.when(F.col("kind").isin(NAMES), "name").otherwise(F.col("kind")).alias("space"), "kind", "norm", "mention")


def later_attempts(known: DataFrame, key: str) -> DataFrame:
    """(kind, norm, attempt) of the entities whose first surrogate will not do.

    A surrogate must be no other entity's, and no entity found in the texts. Of those that clash
    the first by attempt, kind and norm keeps it; the others draw again until all differ. Each round
    works on the clashing entities alone, joined to what is taken. As surrogates grow with the
    attempts no format is ever used up.
    """
    made = lambda d: d.withColumn("sur", normal(surrogate(F.col("mention"), F.col("kind"), key, F.col("attempt")), F.col("kind")))
    state = materialise(made(known.withColumn("attempt", F.lit(0))), "pii-drawn")
    real = known.select("space", F.col("norm").alias("sur")).distinct()
    for _ in range(MOST_ROUNDS):
        keeper = state.groupBy("space", "sur").agg(F.min(F.struct("attempt", "kind", "norm")).alias("keep"), F.count("*").alias("n"))
        shared = state.join(keeper.where("n > 1"), ["space", "sur"]).where("kind <> keep.kind or norm <> keep.norm").select("kind", "norm")
        taken = state.join(real, ["space", "sur"], "left_semi").select("kind", "norm")
        again = materialise(shared.unionAll(taken).distinct(), "pii-clashes")
        if again.isEmpty():
            discard(again)
            return state.where("attempt > 0").select("kind", "norm", "attempt")
        moved = state.join(again, ["kind", "norm"], "left_semi").withColumn("attempt", F.col("attempt") + 1)
        old, state = state, materialise(state.join(again, ["kind", "norm"], "left_anti").unionByName(made(moved.drop("sur"))), "pii-drawn")
        discard_all([old, again])
    raise RuntimeError("surrogates still clash")


def replace_pii(docs: DataFrame, key: str = "sqlcurio") -> DataFrame:
    """doc_id, text with surrogates, n_entities and kinds of each row of ``docs`` (doc_id, text).

    An entity keeps one surrogate in all documents, whatever the case or spacing of its mentions;
    two entities never share one, and none is a value found in the texts. Emails of one domain stay
    of one domain; phone numbers keep their country, cards their first digit, cards and account
    numbers their validity, names title, gender and script. A name is an entity behind a title;
    within the document its parts are then replaced wherever they stand, and each part has its own
    surrogate, so that relatives keep sharing a family name. Where a format has too few values left
    surrogates grow by a character.

    The long pattern runs once over each text. Texts are not shuffled, but for those with an entity
    that had to draw again. Text without entities, empty or null comes back as it is, with 0
    entities. A very long text is one row like others. Repeated rows are each replaced alike. A null
    doc_id is kept. Other columns are ignored; no rows in, no rows out.
    """
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    cells = base.withColumn("cells", F.when(F.col("text").rlike(SIGN), taken_apart(F.col("text"))))
    cells = cells.withColumn("cells", F.when(F.size("cells") > 1, F.col("cells")))
    cells = cells.withColumn("roles", F.when(F.col("cells").isNotNull(), name_roles(F.col("cells"))))
    cells = cells.withColumn("cells", F.when(F.col("cells").isNotNull(), with_mentions(F.col("cells"), F.col("roles"))))
    parts = F.when(F.col("cells").isNotNull(), parts_of(F.col("cells"), F.col("roles")))
    held = F.when(F.col("cells").isNull(), F.col("text"))  # the parts hold the text
    marked = materialise(cells.select("doc_id", held.alias("text"), F.coalesce(F.floor(F.size("cells") / 2), F.lit(0)).cast("long").alias("n_entities"), parts.alias("parts")), "pii-marked")
    found = marked.where("parts is not null").select("doc_id", "n_entities", "parts").withColumn("digest", F.md5(F.array_join(F.transform("parts", lambda p: p["text"]), "")))
    redrawn = later_attempts(materialise(entities(found), "pii-entities"), key)
    name = lambda kind, norm: F.concat(kind, F.lit("\x01"), norm)
    spots = found.select("digest", F.explode("parts").alias("p")).select("digest", F.col("p.kind").alias("kind"), normal(F.col("p.text"), F.col("p.kind")).alias("norm")).where("kind is not null")
    again = spots.distinct().join(redrawn, ["kind", "norm"]).groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct(name(F.col("kind"), F.col("norm")), "attempt"))).alias("again"))
    again = materialise(again, "pii-again")

    attempt = lambda p: F.coalesce(F.try_element_at("again", name(p["kind"], normal(p["text"], p["kind"]))), F.lit(0))
    new = F.transform("parts", lambda p: F.when(p["kind"].isNull(), p["text"]).otherwise(surrogate(p["text"], p["kind"], key, attempt(p))))
    kinds = F.array_distinct(F.transform(F.filter("parts", lambda p: p["kind"].isNotNull()), lambda p: F.when(p["kind"].isin(NAMES), "name").otherwise(p["kind"])))
    changed = found.join(again, "digest", "left").select("doc_id", F.array_join(new, "").alias("text"), "n_entities", F.array_join(F.array_sort(kinds), ",").alias("kinds"))
    same = marked.where("parts is null").select("doc_id", "text", "n_entities", F.lit("").alias("kinds"))
    return same.unionAll(changed)
