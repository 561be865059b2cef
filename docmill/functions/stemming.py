"""French word stems as SQL expressions, to be run once per distinct word.

The steps are plain SQL (``CASE``, ``regexp_extract`` without look-around, ``substr``), each of
which reads the columns of the step before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# The vowels, the endings of each step, and the words that carry no meaning.
VOWELS = "aeiouyâàëéêèïîôûù"
STANDARD = [
    "ance", "ances", "iqUe", "iqUes", "isme", "ismes", "able", "ables", "iste", "istes", "eux",
    "atrice", "atrices", "ateur", "ateurs", "ation", "ations", "logie", "logies", "usion", "usions",
    "ution", "utions", "ence", "ences", "ement", "ements", "ité", "ités", "if", "ifs", "ive", "ives",
    "eaux", "aux", "euse", "euses", "issement", "issements", "amment", "emment", "ment", "ments",
]
I_VERBS = [
    "îmes", "ît", "îtes", "i", "ie", "Ie", "ies", "ir", "ira", "irai", "iraIent", "irais", "irait", "iras",
    "irent", "irez", "iriez", "irions", "irons", "iront", "is", "issaIent", "issais", "issait", "issant",
    "issante", "issantes", "issants", "isse", "issent", "isses", "issez", "issiez", "issions", "issons", "it",
]
VERBS = [
    "é", "ée", "ées", "és", "èrent", "er", "era", "erai", "eraIent", "erais", "erait", "eras", "erez", "eriez",
    "erions", "erons", "eront", "ez", "iez",
]
A_VERBS = [
    "âmes", "ât", "âtes", "a", "ai", "aIent", "ais", "ait", "ant", "ante", "antes", "ants", "as", "asse",
    "assent", "asses", "assiez", "assions",
]
STOP = (
    "au aux avec ce ces dans de des du elle en et eux il je la le leur lui ma mais me même mes moi mon ne nos "
    "notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous c d j "
    "l à m n s t y été étée étées étés étant suis es est sommes êtes sont serai seras sera serons serez seront "
    "serais serait serions seriez seraient étais était étions étiez étaient fus fut fûmes fûtes furent sois soit "
    "soyons soyez soient fusse fusses fût fussions fussiez fussent ayant eu eue eues eus ai as avons avez ont "
    "aurai auras aura aurons aurez auront aurais aurait aurions auriez auraient avais avait avions aviez avaient "
    "eut eûmes eûtes eurent aie aies ait ayons ayez aient eusse eusses eût eussions eussiez eussent"
).split()


def _in(column: str, values: list[str]) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


def _ending(column: str, values: list[str]) -> str:
    """The longest of ``values`` that ``column`` ends with, or the empty string."""
    return f"regexp_extract({column}, '({'|'.join(values)})$', 1)"


def _cut(column: str, letters: int | str) -> str:
    return f"substr({column}, 1, length({column}) - {letters})"


def _region(column: str) -> str:
    """Letters up to and with the first consonant behind a vowel; all if there is none."""
    head = f"length(regexp_extract({column}, '^([^{VOWELS}]*[{VOWELS}][{VOWELS}]*[^{VOWELS}])', 1))"
    return f"CASE WHEN {head} = 0 THEN length({column}) ELSE {head} END"


def _standard() -> str:
    """First step on ``w``: its ending ``s`` begins behind ``b`` letters, ``stem`` long."""

    def then(rules: list[tuple[str, int, str, str]], default: str = "stem") -> str:
        """What becomes of ``stem``: (its ending, letters of it, deleted in r2, else)."""
        cases = " ".join(
            f"WHEN stem LIKE '%{end}' THEN CASE WHEN b - {size} >= r2 THEN {gone} ELSE {other} END"
            for end, size, gone, other in rules
        )
        return f"CASE {cases} ELSE {default} END" if rules else default

    two, four = _cut("stem", 2), _cut("stem", 4)
    iv = f"CASE WHEN {two} LIKE '%at' AND b - 4 >= r2 THEN {four} ELSE {two} END"
    at = (f"CASE WHEN {two} LIKE '%ic' THEN CASE WHEN b - 4 >= r2 THEN {four} ELSE {four} || 'iqU' END ELSE {two} END")
    adverb = then([
        ("iv", 2, iv, "stem"),
        ("eus", 3, _cut("stem", 3), f"CASE WHEN b - 3 >= r1 THEN {_cut('stem', 3)} || 'eux' ELSE stem END"),
        ("abl", 3, _cut("stem", 3), "stem"), ("iqU", 3, _cut("stem", 3), "stem"),
    ], f"CASE WHEN (stem LIKE '%ièr' OR stem LIKE '%Ièr') AND b - 3 >= rv THEN {_cut('stem', 3)} || 'i' ELSE stem END")
    ity = then([("abil", 4, four, f"{four} || 'abl'"), ("ic", 2, two, f"{two} || 'iqU'"), ("iv", 2, two, "stem")])
    rules = [
        (STANDARD[:11], "b >= r2", "stem"),
        (STANDARD[11:17], "b >= r2", then([("ic", 2, two, f"{two} || 'iqU'")])),
        (["logie", "logies"], "b >= r2", "stem || 'log'"),
        (STANDARD[19:23], "b >= r2", "stem || 'u'"),
        (["ence", "ences"], "b >= r2", "stem || 'ent'"),
        (["ement", "ements"], "b >= rv", adverb),
        (["ité", "ités"], "b >= r2", ity),
        (["if", "ifs", "ive", "ives"], "b >= r2", then([("at", 2, at, "stem")])),
        (["eaux"], "true", "stem || 'eau'"),
        (["aux"], "b >= r1", "stem || 'al'"),
        (["euse", "euses"], "b >= r1", "CASE WHEN b >= r2 THEN stem ELSE stem || 'eux' END"),
        (["issement", "issements"], f"b >= r1 AND regexp_extract(stem, '([^{VOWELS}])$', 1) <> ''", "stem"),
        (["amment"], "b >= rv", "stem || 'ant'"),
        (["emment"], "b >= rv", "stem || 'ent'"),
        (["ment", "ments"], f"b - 1 >= rv AND regexp_extract(stem, '([{VOWELS}])$', 1) <> ''", "stem"),
    ]
    cases = " ".join(f"WHEN {_in('s', ends)} AND {where} THEN {value}" for ends, where, value in rules)
    return f"CASE {cases} ELSE w END"


def _verb_i() -> str:
    before = "substr(w1, length(w1) - length(s2), 1)"
    fits = f"length(w1) - length(s2) > rv AND regexp_extract({before}, '([{VOWELS}])', 1) = ''"
    return f"CASE WHEN s2 <> '' AND {fits} THEN {_cut('w1', 'length(s2)')} ELSE w1 END"


def _verb() -> str:
    stem = _cut("w2", "length(s3)")
    return (
        f"CASE WHEN s3 = 'ions' THEN CASE WHEN length(w2) - 4 >= r2 THEN {_cut('w2', 4)} ELSE w2 END "
        f"WHEN {_in('s3', VERBS)} THEN {stem} "
        f"WHEN {_in('s3', A_VERBS)} THEN CASE WHEN {stem} LIKE '%e' AND length({stem}) > rv "
        f"THEN {_cut('w2', 'length(s3) - 1')} ELSE {stem} END ELSE w2 END"
    )


def _residual() -> str:
    stem = _cut("w4", "length(s4)")
    return (
        f"CASE WHEN s4 = 'ion' THEN CASE WHEN length(w4) - 3 >= r2 AND length(w4) - 4 >= rv "
        f"AND ({stem} LIKE '%s' OR {stem} LIKE '%t') THEN {stem} ELSE w4 END "
        f"WHEN {_in('s4', ['ier', 'ière', 'Ier', 'Ière'])} THEN {stem} || 'i' WHEN s4 = 'e' THEN {stem} "
        f"WHEN s4 = 'ë' AND {stem} LIKE '%gu' AND length({stem}) - 2 >= rv THEN {stem} ELSE w4 END"
    )


def steps(group: str) -> list[dict[str, str]]:
    """The steps in order, each with its new columns; the first reads ``word``, the last gives
    ``stem_of``. ``group`` is how the dialect names the n-th group of a replacement."""

    def marked(text: str) -> str:
        v, one, two = f"[{VOWELS}]", group.format(1), group.format(2)
        for pattern, new in [
            ("qu", "qU"), (f"({v})u({v})", f"{one}U{two}"), (f"({v})u({v})", f"{one}U{two}"), (f"({v})i({v})", f"{one}I{two}"),
            (f"({v})i({v})", f"{one}I{two}"), (f"({v})y", f"{one}Y"), (f"y({v})", f"Y{one}"),
        ]:
            text = f"regexp_replace({text}, '{pattern}', '{new}'{', {g}' if group.startswith(chr(92)) else ''})"
        return text.replace("{g}", "'g'")

    start = f"length(regexp_extract(w, '^(.[^{VOWELS}]*[{VOWELS}])', 1))"
    rv = (
        f"CASE WHEN regexp_extract(w, '^([{VOWELS}][{VOWELS}].)', 1) <> '' OR "
        f"regexp_extract(w, '^(par|col|tap)', 1) <> '' THEN 3 WHEN {start} = 0 THEN length(w) ELSE {start} END"
    )
    altered = "(done1 OR w2 <> w1 OR w3 <> w2)"
    last = "regexp_extract(w3, '(.)$', 1)"
    tail = f"regexp_extract(w6, '[éè]([^{VOWELS}][^{VOWELS}]*)$', 1)"
    return [
        {"w": marked("word")},
        {"rv": rv, "r1": _region("w")},
        {"r2": f"r1 + ({_region('substr(w, r1 + 1)')})", "s": _ending("w", STANDARD)},
        {"b": "length(w) - length(s)"},
        {"stem": "substr(w, 1, b)"},
        {"w1": _standard()},
        {"done1": f"w1 <> w AND NOT {_in('s', ['amment', 'emment', 'ment', 'ments'])}"},
        {"s2": f"CASE WHEN done1 THEN '' ELSE {_ending('substr(w1, rv + 1)', I_VERBS)} END"},
        {"w2": _verb_i()},
        {"s3": f"CASE WHEN done1 OR w2 <> w1 THEN '' ELSE {_ending('substr(w2, rv + 1)', ['ions', *VERBS, *A_VERBS])} END"},
        {"w3": _verb()},
        {"w4": f"CASE WHEN {altered} AND {last} = 'Y' THEN {_cut('w3', 1)} || 'i' "
               f"WHEN {altered} AND {last} = 'ç' THEN {_cut('w3', 1)} || 'c' "
               f"WHEN NOT {altered} AND regexp_extract(w3, '([^aiouès]s)$', 1) <> '' THEN {_cut('w3', 1)} ELSE w3 END"},
        {"s4": f"CASE WHEN {altered} THEN '' ELSE {_ending('substr(w4, rv + 1)', ['ion', 'ier', 'ière', 'Ier', 'Ière', 'e', 'ë'])} END"},
        {"w5": _residual()},
        {"w6": f"CASE WHEN {_ending('w5', ['enn', 'onn', 'ett', 'ell', 'eill'])} <> '' THEN {_cut('w5', 1)} ELSE w5 END"},
        {"t": tail},
        {"w7": f"CASE WHEN t <> '' THEN {_cut('w6', 'length(t) - 1')} || 'e' || t ELSE w6 END"},
        {"stem_of": f"CASE WHEN {_in('word', STOP)} THEN '' ELSE lower(w7) END"},
    ]


def french_stems(words: DataFrame) -> DataFrame:
    """``word``, ``stem`` of distinct lower-case words; a stop word has the empty stem."""
    rows = words.select("word")
    for step in steps("${}"):
        rows = rows.select("*", *(F.expr(text).alias(name) for name, text in step.items()))
    # generated, so that a filter on the stem is not written into every step that it depends on
    return rows.select("word", F.explode_outer(F.array("stem_of")).alias("stem"))


def stems_sql(words: str) -> str:
    """The same as a chain of selects from ``words(word)``, for checks in another engine."""
    text = f"(SELECT word FROM {words})"
    for step in steps("\\{}"):
        text = f"(SELECT *, {', '.join(f'{value} AS {name}' for name, value in step.items())} FROM {text})"
    return f"(SELECT word, stem_of AS stem FROM {text})"
