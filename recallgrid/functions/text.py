"""Text functions as Column expressions (no Python at run time but for term()).

Scalars that both engines can run are kept as SQL templates with {t} for the argument, so that a
query and its check share the rule but not the engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words too common to be search terms.
STOPWORDS = (
    "a an the and or of to in on for with is are was were be been being it its this that these those what which who whom how do does did can could "
    "should would will shall may might must i you he she we they me my your our us them their his her at by from as about into over not no yes so if "
    "then than there here when where why just also any all some more most very use using used get got have has had please want need make made like one two"
).split()
# Irregular forms.
IRREGULAR = {
    "broken": "break", "broke": "break", "built": "build", "made": "make", "went": "go", "ran": "run", "running": "run", "written": "write",
    "wrote": "write", "chosen": "choose", "chose": "choose", "taken": "take", "took": "take", "given": "give", "gave": "give",
}
LETTERS = "abcdefghijklmnopqrstuvwxyz"
WORD_GAP = "[^\\p{L}\\p{Nd}]+"


def _once(s: str) -> str:
    """s without one of two equal last consonants (l, s and z stay)."""
    return f"CASE WHEN length({s}) >= 2 AND right({s}, 1) = substr({s}, length({s}) - 1, 1) AND right({s}, 1) NOT IN ('a', 'e', 'i', 'o', 'u', 'l', 's', 'z') THEN left({s}, length({s}) - 1) ELSE {s} END"


#: A rough base form: irregular verbs, then the first suffix that leaves three letters.
STEM = (
    "CASE "
    + " ".join(f"WHEN {{t}} = '{a}' THEN '{b}'" for a, b in IRREGULAR.items())
    + f" WHEN length({{t}}) < 5 OR translate({{t}}, '{LETTERS}', '') <> '' THEN {{t}}"
    + " WHEN {t} LIKE '%ies' THEN concat(left({t}, length({t}) - 3), 'y')"
    + " WHEN {t} LIKE '%ing' AND length({t}) >= 6 THEN " + _once("left({t}, length({t}) - 3)")
    + " WHEN {t} LIKE '%ed' THEN " + _once("left({t}, length({t}) - 2)")
    + " WHEN {t} LIKE '%sses' OR {t} LIKE '%xes' OR {t} LIKE '%ches' OR {t} LIKE '%shes' THEN left({t}, length({t}) - 2)"
    + " WHEN {t} LIKE '%s' AND NOT ({t} LIKE '%ss' OR {t} LIKE '%us' OR {t} LIKE '%is') THEN left({t}, length({t}) - 1)"
    + " ELSE {t} END"
)
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def stem_sql(t: str) -> str:
    return STEM.format(t=t)


def tokens(text: str) -> Column:
    """Search terms of a column: runs of letters and digits, without short words and stopwords, stemmed; order and repeats stay."""
    return F.expr(f"transform(filter(split(lower({text}), '{WORD_GAP.replace(chr(92), chr(92) * 2)}'), x -> length(x) >= 2 AND x NOT IN ({_STOP})), x -> {stem_sql('x')})")


def tokens_sql(text: str) -> str:
    """The same for DuckDB."""
    return f"list_transform(list_filter(regexp_split_to_array(lower({text}), '{WORD_GAP}'), lambda x: length(x) >= 2 AND x NOT IN ({_STOP})), lambda x: {stem_sql('x')})"


_STOPPED, _PLAIN = frozenset(STOPWORDS), frozenset(LETTERS)


def term(word: str) -> str | None:
    """The search term of a word, None if it is too short or common: STEM's rule for a word at a time, for tasks that meet each word once."""
    if len(word) < 2 or word in _STOPPED:
        return None
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) < 5 or not _PLAIN.issuperset(word):
        return word
    once = lambda s: s[:-1] if len(s) >= 2 and s[-1] == s[-2] and s[-1] not in "aeioulsz" else s
    if word.endswith("ies"):
        return word[:-3] + "y"
    if word.endswith("ing") and len(word) >= 6:
        return once(word[:-3])
    if word.endswith("ed"):
        return once(word[:-2])
    if word.endswith(("sses", "xes", "ches", "shes")):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith(("ss", "us", "is")) else word


def digit_runs(text: Column) -> Column:
    """The set of runs of ASCII digits, leading zeros kept."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("([0-9]+)"), 1)))


def one_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


#: What an identifier holds: a digit, an underscore, or a sign other than an apostrophe between letters or digits. Outer punctuation has no part in it.
SIGNED = "[\\p{Nd}_]|[\\p{L}\\p{Nd}][^\\p{L}\\p{Nd}\\s'’][\\p{L}\\p{Nd}]"


def looks_like_identifier(word: Column) -> Column:
    """A digit, an underscore, or a sign other than an apostrophe between letters or digits."""
    return word.rlike(SIGNED)


def first_identifier(text: Column) -> Column:
    """The first word (between spaces) that looks like an identifier, null without one: the one that the first match in the text lies in, as no match holds a space."""
    pieces = F.split(text, SIGNED, 2)
    before = F.get(pieces, F.lit(0))
    start = F.length(before) - F.length(F.substring_index(before, " ", -1)) + 1
    return F.when(F.size(pieces) > 1, F.substring_index(F.substring(text, start, F.length(text)), " ", 1))


def name_tokens(name: Column) -> Column:
    """Lower-case words without outer punctuation; version labels go unless nothing else is there."""
    words = F.filter(F.transform(F.split(F.lower(name), "\\s+"), lambda w: F.regexp_replace(w, "^[.,;:!?\"'()\\[\\]{}]+|[.,;:!?\"'()\\[\\]{}]+$", "")), lambda w: w != "")
    kept = F.filter(words, lambda w: ~w.rlike("^(v[0-9]+([.][0-9]+){0,2}|[0-9]+[.][0-9]+([.][0-9]+)?)$"))
    return F.when(F.size(kept) > 0, kept).otherwise(words)


#: Punctuation and spaces at either end.
EDGES = "^[ .,;:!?\"'()\\[\\]{}]+|[ .,;:!?\"'()\\[\\]{}]+$"


def normalised(text: str) -> Column:
    """Lower case, white space collapsed, no outer punctuation."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "\\s+", " "), EDGES, "")


def endpoints_match(a1: Column, b1: Column, a2: Column, b2: Column) -> Column:
    """One pair of ends is equal by normalised name, the other names the same entity."""
    equal = lambda x, y: name_tokens(x) == name_tokens(y)
    return (equal(a1, a2) & same_entity(b1, b2)) | (same_entity(a1, a2) & equal(b1, b2))


def owned(users: list[str], agent: str, nobody: bool = False, exact: bool = False) -> Column:
    """Rows of the users (none: of any) and the agent (empty: of any, unless exact); nobody adds rows without both."""
    own = (F.col("user_id").isin(users) if users else F.lit(True)) & ((F.col("agent_id") == agent) if agent or exact else F.lit(True))
    return own | ((F.col("user_id") == "") & (F.col("agent_id") == "")) if nobody else own


def same_entity(a: Column, b: Column) -> Column:
    """The words of one name all stand in the other."""
    x, y = name_tokens(a), name_tokens(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & ((F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0))


def clauses(text: Column, least: int = 40, most: int = 6) -> Column:
    """Pieces of a long text: cut after '. ', '; ' and at line ends; short pieces go on with the next."""
    marked = F.regexp_replace(text, "([.;]) ", "$1\n")
    pieces = F.filter(F.transform(F.split(marked, "\n"), F.trim), lambda p: p != "")
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("carry"))

    def step(a: Column, p: Column) -> Column:
        piece = F.when(a["carry"] == "", p).otherwise(F.concat(a["carry"], F.lit(" "), p))
        short = F.length(piece) < least
        return F.struct(F.when(short, a["out"]).otherwise(F.concat(a["out"], F.array(piece))).alias("out"), F.when(short, piece).otherwise(F.lit("")).alias("carry"))

    def end(a: Column) -> Column:
        n = F.size(a["out"])
        joined = F.concat(F.slice(a["out"], 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.element_at(a["out"], -1), F.lit(" "), a["carry"])))
        out = F.when(a["carry"] == "", a["out"]).when(n == 0, F.array(a["carry"])).otherwise(joined)
        return F.when(F.size(out) > most, F.concat(F.slice(out, 1, most - 1), F.array(F.array_join(F.slice(out, most, F.greatest(F.size(out), F.lit(1))), " ")))).otherwise(out)

    return F.aggregate(pieces, zero, step, end)


def cut_bytes(text: Column, most: int) -> Column:
    """At most so many bytes of UTF-8, ending with a whole character, then an ellipsis if anything is gone."""
    # a character is kept if the bytes up to its end fit: a fold over at most `most` characters
    chars = F.split(F.substring(text, 1, most), "(?!^)")
    zero = F.struct(F.lit(0).alias("n"), F.lit("").alias("s"))

    def step(a: Column, c: Column) -> Column:
        n = a["n"] + F.octet_length(c)
        return F.struct(n.alias("n"), F.when(n <= most, F.concat(a["s"], c)).otherwise(a["s"]).alias("s"))

    return F.when(F.octet_length(text) <= most, text).otherwise(F.aggregate(chars, zero, step, lambda a: F.concat(a["s"], F.lit("…"))))


def event_span(date: Column) -> tuple[Column, Column]:
    """[from, to) of YYYY-MM-DD (first ten characters) or exactly YYYY-MM; null if neither."""
    day = F.try_to_date(F.substring(date, 1, 10), "yyyy-MM-dd")
    month = F.when(date.rlike("^[0-9]{4}-[0-9]{2}$"), F.try_to_date(F.concat(date, F.lit("-01")), "yyyy-MM-dd"))
    return F.coalesce(day, month), F.coalesce(F.date_add(day, 1), F.add_months(month, 1))


def event_date(written: Column) -> Column:
    """YYYY-MM-DD (of the first ten characters) or YYYY-MM of a written date; blank if it is neither."""
    t = F.trim(written)
    day = F.substring(t, 1, 10)
    whole = day.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(day, "yyyy-MM-dd").isNotNull()
    month = t.rlike("^[0-9]{4}-(0[1-9]|1[0-2])$")
    return F.when(whole, day).when(month, t).otherwise("")


# Relations of a link.
RELATIONS = ("related", "contrasts", "same_series")


def links(text: Column) -> Column:
    """[(id, relation)] of 'id:relation,...'; malformed items and unknown relations go, the first of each id stays."""
    items = F.transform(F.split(text, ","), lambda x: F.split(F.trim(x), ":", 2))
    pairs = F.transform(items, lambda x: F.struct(F.trim(F.get(x, F.lit(0))).alias("id"), F.lower(F.trim(F.get(x, F.lit(1)))).alias("relation")))
    pairs = F.filter(pairs, lambda x: (x["id"] != "") & F.coalesce(x["relation"].isin(*RELATIONS), F.lit(False)))
    zero = F.array().cast("array<struct<id:string,relation:string>>")
    return F.aggregate(pairs, zero, lambda a, x: F.when(F.exists(a, lambda y: y["id"] == x["id"]), a).otherwise(F.concat(a, F.array(x))))


def clamped(text: Column, lines: int, most: int, space: str = "\\s") -> Column:
    """The first lines, without space (a pattern of one character) around them, of at most so many bytes, ending with a whole character."""
    t = F.regexp_replace(F.array_join(F.slice(F.split(text, "\n", -1), 1, lines), "\n"), f"^{space}+|{space}+\\z", "")
    return F.regexp_replace(F.regexp_replace(cut_bytes(t, most), "…\\z", ""), f"{space}+\\z", "")


def unix_seconds(written: Column) -> Column:
    """Seconds since 1970 of a written time, 0 if it can't be read."""
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(written)), F.lit(0)).cast("long")


def confidence(share: Column) -> Column:
    return F.when(share > 0.66, "high").when(share > 0.33, "medium").otherwise("low")


def retry_delay(failures: Column) -> Column:
    """Seconds until the next try: five minutes, doubled for each failure, two hours at most."""
    return F.least(300 * F.pow(F.lit(2.0), failures - 1), F.lit(7200.0))


def experience(task: Column, solution: Column, environment: Column) -> Column:
    """An experience as text; the environment is left out where it is blank."""
    env = F.when(F.trim(F.coalesce(environment, F.lit(""))) != "", F.concat(F.lit(" Environment: "), environment)).otherwise("")
    return F.concat(F.lit("Task: "), task, F.lit(" Solution: "), solution, env)


# Letters whose one-letter upper case isn't the first choice of Java, which writes several letters.
_SMALL = "ß" + "".join(chr(b + i) for b in (0x1F80, 0x1F90, 0x1FA0) for i in range(8)) + "ᾳῃῳ"
_LARGE = "ẞ" + "".join(chr(b + i) for b in (0x1F88, 0x1F98, 0x1FA8) for i in range(8)) + "ᾼῌῼ"


def upper(text: Column) -> Column:
    """Upper case letter by letter: a letter that only several ones stand for in upper case stays."""
    chars = F.split(F.translate(text, _SMALL, _LARGE), "(?!^)")
    return F.array_join(F.transform(chars, lambda c: F.when(F.length(F.upper(c)) == F.length(c), F.upper(c)).otherwise(c)), "")
