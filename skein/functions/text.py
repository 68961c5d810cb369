"""Text expressions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The benchmark normaliser's tables.
NUMBERS = {"none": "0", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}
ARTICLES = ["a", "an", "the"]
PUNCTUATION = [";", "/", "[", "]", '"', "{", "}", "(", ")", "=", "+", "\\", "_", "-", ">", "<", "@", "`", ",", "?", "!"]
CONTRACTIONS = {
    "aint": "ain't", "arent": "aren't", "cant": "can't", "couldve": "could've", "couldnt": "couldn't", "couldn'tve": "couldn't've", "couldnt've": "couldn't've",
    "didnt": "didn't", "doesnt": "doesn't", "dont": "don't", "hadnt": "hadn't", "hadnt've": "hadn't've", "hadn'tve": "hadn't've", "hasnt": "hasn't",
    "havent": "haven't", "hed": "he'd", "hed've": "he'd've", "he'dve": "he'd've", "hes": "he's", "howd": "how'd", "howll": "how'll", "hows": "how's",
    "Id've": "I'd've", "I'dve": "I'd've", "Im": "I'm", "Ive": "I've", "isnt": "isn't", "itd": "it'd", "itd've": "it'd've", "it'dve": "it'd've", "itll": "it'll",
    "let's": "let's", "maam": "ma'am", "mightnt": "mightn't", "mightnt've": "mightn't've", "mightn'tve": "mightn't've", "mightve": "might've", "mustnt": "mustn't",
    "mustve": "must've", "neednt": "needn't", "notve": "not've", "oclock": "o'clock", "oughtnt": "oughtn't", "ow's'at": "'ow's'at", "'ows'at": "'ow's'at",
    "'ow'sat": "'ow's'at", "shant": "shan't", "shed've": "she'd've", "she'dve": "she'd've", "she's": "she's", "shouldve": "should've", "shouldnt": "shouldn't",
    "shouldnt've": "shouldn't've", "shouldn'tve": "shouldn't've", "somebody'd": "somebodyd", "somebodyd've": "somebody'd've", "somebody'dve": "somebody'd've",
    "somebodyll": "somebody'll", "somebodys": "somebody's", "someoned": "someone'd", "someoned've": "someone'd've", "someone'dve": "someone'd've",
    "someonell": "someone'll", "someones": "someone's", "somethingd": "something'd", "somethingd've": "something'd've", "something'dve": "something'd've",
    "somethingll": "something'll", "thats": "that's", "thered": "there'd", "thered've": "there'd've", "there'dve": "there'd've", "therere": "there're",
    "theres": "there's", "theyd": "they'd", "theyd've": "they'd've", "they'dve": "they'd've", "theyll": "they'll", "theyre": "they're", "theyve": "they've",
    "twas": "'twas", "wasnt": "wasn't", "wed've": "we'd've", "we'dve": "we'd've", "weve": "we've", "werent": "weren't", "whatll": "what'll", "whatre": "what're",
    "whats": "what's", "whatve": "what've", "whens": "when's", "whered": "where'd", "wheres": "where's", "whereve": "where've", "whod": "who'd",
    "whod've": "who'd've", "who'dve": "who'd've", "wholl": "who'll", "whos": "who's", "whove": "who've", "whyll": "why'll", "whyre": "why're", "whys": "why's",
    "wont": "won't", "wouldve": "would've", "wouldnt": "wouldn't", "wouldnt've": "wouldn't've", "wouldn'tve": "wouldn't've", "yall": "y'all",
    "yall'll": "y'all'll", "y'allll": "y'all'll", "yall'd've": "y'all'd've", "y'alld've": "y'all'd've", "y'all'dve": "y'all'd've", "youd": "you'd",
    "youd've": "you'd've", "you'dve": "you'd've", "youll": "you'll", "youre": "you're", "youve": "you've",
}


def lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def py_strip(c: Column | str) -> Column:
    """Strip Unicode white space, as Python does (Spark's trim takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def listed(table: dict[str, str], word: Column) -> Column:
    """The table's value, or the word itself. Membership is a hash lookup, so only words of the table search it."""
    return F.when(word.isin(list(table)), F.try_element_at(lookup(table), word)).otherwise(word)


def normalise_answer(c: Column) -> Column:
    """The benchmark answer normaliser. As in the original only the first 32 periods go. (Its rule for commas between
    digits never holds: commas have gone before it.)"""
    x = F.replace(F.replace(F.replace(F.lower(c), F.lit(","), F.lit("")), F.lit("?"), F.lit("")), F.lit("'s"), F.lit(" 's"))
    x = py_strip(F.translate(py_strip(x), "\n\t", "  "))

    def bare(text: Column) -> Column:
        out = text
        for p in PUNCTUATION:
            glued = F.contains(text, F.lit(p + " ")) | F.contains(text, F.lit(" " + p))
            out = F.replace(out, F.lit(p), F.when(glued, "").otherwise(" "))
        return out

    # An array of one: the text is made once, though forty conditions ask for it.
    out = F.get(F.transform(F.array(x), bare), F.lit(0))
    out = F.array_join(F.split(out, r"\.(?!\d)", 33), "")
    words = F.filter(F.split(F.lower(out), r"(?U)\s+"), lambda w: w != "")
    words = F.filter(F.transform(words, lambda w: listed(NUMBERS, w)), lambda w: ~w.isin(ARTICLES))
    return F.array_join(F.transform(words, lambda w: listed(CONTRACTIONS, w)), " ")


def yes_no(c: Column) -> Column:
    """the first sentence without commas holds the word No, not or no -> 'no', else 'yes'."""
    words = F.split(F.replace(F.split_part(c, F.lit("."), F.lit(1)), F.lit(","), F.lit("")), " ")
    return F.when(F.arrays_overlap(words, F.array(F.lit("No"), F.lit("not"), F.lit("no"))), "no").otherwise("yes")


def single_answer(c: Column) -> Column:
    """lower-cased first word of what follows the last answer marker, without periods at the end; empty -> ''."""
    x = py_strip(F.lower(c))
    for mark in ("answer is", "answer is:", "answer:"):
        x = py_strip(F.element_at(F.split(x, mark), -1))
    return F.coalesce(F.get(F.filter(F.split(F.regexp_replace(x, r"\.+$", ""), r"(?U)\s+"), lambda w: w != ""), F.lit(0)), F.lit(""))


def prompt_question(c: Column) -> Column:
    """the question inside a prompt, three layouts; NULL for any other."""
    lines = F.split(c, "\n")
    return F.lower(
        F.when(c.startswith("OCR tokens: "), F.regexp_extract(c, r"(?s)Question: (.*?) Short answer:", 1))
        .when(F.contains(c, F.lit("Reference OCR token: ")) & (F.size(lines) == 3), F.when(c.startswith("Reference OCR token:"), F.get(lines, F.lit(1))).otherwise(F.get(lines, F.lit(0))))
        .when(F.size(lines) == 2, F.get(lines, F.lit(0)))
    )


def choice_letter(c: Column) -> Column:
    """F8: a lone letter, a leading letter with a full stop, or exactly one 'The answer is X.'; else FAILED."""
    found = F.regexp_extract_all(c, F.lit(r"The answer is ([A-Z])\."), F.lit(1))
    return F.when(c.rlike("^[A-Z]$"), c).when(c.rlike(r"(?s)^[A-Z]\. .*"), F.substring(c, 1, 1)).when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise("FAILED")


def letter_index(letter: Column, choices: Column | int) -> Column:
    """0-based place of a letter among the first choices, else -1."""
    at = F.ascii(letter) - F.ascii(F.lit("A"))
    return F.when((F.length(letter) == 1) & (at >= 0) & (at < choices), at).otherwise(-1)


def judge_scores(c: Column) -> Column:
    """map of metric -> single digit; the last mention of a metric counts."""
    pattern = F.lit(r"(?i)\*{0,2}(Consistency|Realism|Aesthetic Quality)\*{0,2}\s*[::]?\s*(\d)")
    names = F.transform(F.regexp_extract_all(c, pattern, F.lit(1)), lambda n: F.replace(F.lower(n), F.lit(" "), F.lit("_")))
    values = F.regexp_extract_all(c, pattern, F.lit(2))
    return F.aggregate(
        F.arrays_zip(names.alias("k"), values.alias("v")),
        F.create_map().cast("map<string,double>"),
        lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"].cast("double"))),
    )


def pair_score(c: Column) -> Column:
    """two numbers on the first line (commas count as spaces), else [-1, -1]."""
    parts = F.split(F.replace(F.split_part(c, F.lit("\n"), F.lit(1)), F.lit(","), F.lit(" ")), " ")
    numbers = F.transform(parts, lambda p: F.expr("1") * p.try_cast("double"))
    return F.when((F.size(parts) == 2) & F.forall(numbers, lambda n: n.isNotNull()), numbers).otherwise(F.array(F.lit(-1.0), F.lit(-1.0)))


def gqa_answer(c: Column) -> Column:
    """F12."""
    return F.lower(F.regexp_replace(c, r"\.+$", ""))


def clean_html(c: Column) -> Column:
    """F13 in expressions: six named references and one decimal one unescaped twice, white space collapsed, lower-cased.
    ``functions.clean`` knows all references and repairs encodings, in Arrow batches."""
    named = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}
    x = c
    for _ in range(2):
        for k, v in named.items():
            x = F.replace(x, F.lit(k), F.lit(v))
    return py_strip(F.lower(F.regexp_replace(x, r"(?U)\s+", " ")))


def is_none(c: Column) -> Column:
    """NULL or one of the words that stand for nothing."""
    return c.isNull() | F.lower(c).isin("nan", "none")


def options_before_none(options: Column) -> Column:
    """The options before the first that is missing."""
    first = F.array_position(F.transform(options, is_none), F.lit(True))
    return F.when(first > 0, F.slice(options, 1, (first - 1).cast("int"))).otherwise(options)


def int_ranges(c: Column) -> Column:
    """P20: '32-123, 256' -> sorted integers, upper bounds exclusive."""
    parts = F.split(F.regexp_replace(c, r"\s", ""), ",")
    spans = F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.when(F.contains(p, F.lit("-")), F.when(F.split_part(p, F.lit("-"), F.lit(1)).cast("int") < F.split_part(p, F.lit("-"), F.lit(2)).cast("int"), F.sequence(F.split_part(p, F.lit("-"), F.lit(1)).cast("int"), F.split_part(p, F.lit("-"), F.lit(2)).cast("int") - 1)).otherwise(F.array().cast("array<int>"))).otherwise(F.array(p.try_cast("int"))))
    return F.array_sort(F.flatten(spans))


def source_dataset(c: Column) -> Column:
    """The images' data set of a JSON source, or the plain name."""
    return F.when(c.startswith("{"), F.get_json_object(c, "$.images")).otherwise(c)


def path_dataset(c: Column) -> Column:
    """Data set by path substring."""
    x = F.lower(c)
    return F.when(F.contains(x, F.lit("journeydb")), "journeydb").when(F.contains(x, F.lit("laion")), "laion").when(F.contains(x, F.lit("blip3o")), "blip3o").otherwise("benchmark")


def trim_hanging(c: Column) -> Column:
    """without blank lines at both ends, and without a first line that is a pair of numbers."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s*\n|\n\s*$", ""), r"^\d+(\.\d+)?[ ,]+\d+(\.\d+)?\s*(\n|$)", "")


def image_token_code(c: Column) -> Column:
    """the code behind a name such as IMGIMGBCDZ (letters A-J are digits)."""
    return F.translate(F.regexp_extract(c, r"^IMGIMG([A-J]+)Z$", 1), "ABCDEFGHIJ", "0123456789").try_cast("int")


def code_image_token(code: Column) -> Column:
    return F.concat(F.lit("IMGIMG"), F.translate(code.cast("string"), "0123456789", "ABCDEFGHIJ"), F.lit("Z"))


def brace_list(names: list[str]) -> str:
    """K6: a brace range for names numbered in one run, else an explicit list."""
    import re

    parts = [re.fullmatch(r"(.*?)(\d+)(\D*)", n) for n in names]
    if parts and all(parts) and len({(p[1], p[3], len(p[2])) for p in parts}) == 1 and [int(p[2]) for p in parts] == list(range(int(parts[0][2]), int(parts[0][2]) + len(parts))):
        return f"{parts[0][1]}{{{parts[0][2]}..{parts[-1][2]}}}{parts[0][3]}" if len(parts) > 1 else names[0]
    return "{" + ",".join(names) + "}"
