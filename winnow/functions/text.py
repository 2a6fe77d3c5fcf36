"""Scalar text functions as Catalyst expressions. White space and letters are Unicode's; a null stays null unless said otherwise."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

QA_TYPES = ("objects", "spatial", "actions", "counting", "text_ocr", "reasoning")

#: Rules in the order in which they are tried: type, substrings, patterns.
TYPE_RULES = (
    ("counting", "count of|how many|number of", r"\bhow\s+many\b"),
    ("reasoning", "compare|explain|how does|what would happen|why", r"^\s*why\b|\bhow\s+does\b"),
    ("spatial", "above|behind|below|between|in front of|next to|to the left|to the right", r"\bwhere\b.*\bis\b"),
    ("text_ocr", "caption|label|letter|say|sign|text|word|written", r"\bwhat\b.*\b(label|sign|text)\b.*\bsay"),
    ("actions", "doing|what are|what is", r"\bwhat\s+(are|is)\b.*\bdoing\b"),
    ("objects", "list the|name the|what items|what objects|what things|which items", r"\bwhat\b.*\b(item|object|thing)s?\b"),
)

#: Risk groups in the order in which they are reported.
RISK_RULES = (
    ("counting", "count|how many|number of|total number"),
    ("math", "%|compare|difference|kinetic energy|percent|probability|ratio|total"),
    ("diagram", "allele|chart|diagram|food web|genotype|lattice|phenotype|punnett|table"),
    ("inference", "cause|environment|function|habitat|indicating|kind of|likely|might|purpose|type of|use for|used for|why"),
)

CONTRADICTION = r"(?i)\b(contradicts?|differs|different|in(consistent|correct)|instead of|not (correct|supported)|rather than|should be|wrong)\b"

STOP_WORDS = frozenset("about above around been being below between does doing done from have image into least less many more most much no none not onto over photo picture said says scene showing shown some that their them there these they this those under visible what when where which with yes".split())


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def has_text(c: Column) -> Column:
    """Whether there is anything but white space; stops at the first such character."""
    return F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def normalise_question(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), r"(?U)\s+", " ")


def normalise_answer(c: Column) -> Column:
    """Lower case without the marks . , ! ? and quotes, single spaces."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "[.,!?\"']", " "), r"(?U)\s+", " "))


def first_line(c: Column) -> Column:
    """The first line that is not blank, stripped; "" where there is none."""
    lines = F.filter(F.transform(F.split(c, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"), strip), lambda x: x != "")
    return F.when(c.isNotNull(), F.coalesce(F.get(lines, F.lit(0)), F.lit("")))


def choice_letter(c: Column, choices: Column | None = None) -> Column:
    """The first single letter A to F in any case that is among choices (an array of upper-case letters); null if none."""
    letters = F.regexp_extract_all(F.upper(c), F.lit(r"(?U)\b([A-F])\b"), F.lit(1))
    return F.get(letters if choices is None else F.filter(letters, lambda x: F.array_contains(choices, x)), F.lit(0))


def mmlu_letter(c: Column) -> Column:
    """A single letter A to D, else the first character if it is one of these, else ""."""
    alone = F.regexp_extract(F.upper(strip(c)), r"\b([ABCD])\b", 1)
    head = F.left(F.upper(strip(c)), F.lit(1))
    return F.when(alone != "", alone).when(head.isin("A", "B", "C", "D"), head).otherwise(F.lit(""))


def _yes_no(c: Column, yes: Iterable[str], no: Iterable[str]) -> Column:
    t = F.regexp_replace(F.lower(first_line(c)), r"[.!?,]+$", "")
    return F.when(t.isin(*yes), "yes").when(t.isin(*no), "no").when(t.startswith("yes"), "yes").when(t.startswith("no"), "no")


def pope_yes_no(c: Column) -> Column:
    return _yes_no(c, ("yes", "yeah", "yep", "correct"), ("no", "nope", "incorrect"))


def hallusion_yes_no(c: Column) -> Column:
    return _yes_no(c, ("yes", "yeah", "yep"), ("no", "nope"))


def hallusion_gold(c: Column) -> Column:
    g = F.lower(strip(c.cast("string")))
    return F.when(g.isin("1", "true", "yes"), "yes").when(g.isin("0", "false", "no"), "no")


def nls(a: Column, b: Column) -> Column:
    """1 - edit distance / length of the longer; two empty texts are equal."""
    x, y = F.lower(strip(a)), F.lower(strip(b))
    most = F.greatest(F.length(x), F.length(y))
    return F.when(most == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y) / most)


def qa_type(c: Column) -> Column:
    """The first rule that matches; "objects" where none does."""
    q, out = strip(F.lower(c)), F.lit(None).cast("string")
    for name, words, pattern in reversed(TYPE_RULES):
        hit = q.rlike(pattern)
        for w in words.split("|"):
            hit = hit | q.contains(w)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return F.coalesce(out, F.lit("objects"))


def words(c: Column, lower: bool = True) -> Column:
    return F.regexp_extract_all(F.lower(c) if lower else c, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def nouns(c: Column) -> Column:
    """Sorted distinct ASCII words of four letters or more, without stop words."""
    found = F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), F.lit(0))
    return F.array_sort(F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in sorted(STOP_WORDS)])))


def after_think(c: Column) -> Column:
    at = F.locate("</think>", c)
    return strip(F.when(at > 0, F.substring(c, at + F.lit(8), F.length(c))).otherwise(c))


def qa_pair(c: Column) -> Column:
    """struct(question, answer) from "Q: ... A: ..."; else the first line and the rest; else the text and ""."""
    pattern = r"(?s)Q:\s*(.+?)\s*\nA:\s*(.+)"
    lines = F.filter(F.transform(F.split(strip(c), "\n"), strip), lambda x: x != "")
    many = F.size(lines) >= 2
    q = F.when(c.rlike(pattern), strip(F.regexp_extract(c, pattern, 1))).when(many, F.get(lines, F.lit(0))).otherwise(strip(c))
    a = F.when(c.rlike(pattern), strip(F.regexp_extract(c, pattern, 2))).when(many, F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), " ")).otherwise(F.lit(""))
    return F.struct(q.alias("question"), a.alias("answer"))


def numbers(c: Column) -> Column:
    """Sorted distinct numbers, fractions and percentages of a text, as strings; none of a null."""
    return F.array_sort(F.array_distinct(F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(r"\b\d+/\d+\b|\d+(?:\.\d+)?%?"), F.lit(0)), F.array().cast("array<string>"))))


def risk_types(question: Column, answer: Column) -> Column:
    text = F.lower(F.concat(F.coalesce(question, F.lit("")), F.lit("\n"), F.coalesce(answer, F.lit(""))))
    out = []
    for name, parts in RISK_RULES:
        hit = F.lit(False)
        for p in parts.split("|"):
            hit = hit | text.contains(p)
        out.append(F.when(hit, F.lit(name)))
    return F.array_compact(F.array(*out))


def contradicts(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(CONTRADICTION)


def caption(c: Column) -> Column:
    """The first line that names a figure or table, else the first 200 characters, else null."""
    t = strip(c)
    named = F.get(F.filter(F.transform(F.split(t, "\n"), strip), lambda x: x.rlike(r"(?i)^(\u56fe|\u8868|fig\.?|figure|table)\s*\d")), F.lit(0))
    return F.coalesce(named, F.when(t != "", F.left(t, F.lit(200))))


def short_hash(c: Column, n: int = 12, first_bytes: int | None = None) -> Column:
    """The first n hexadecimal digits of the md5 of a text or binary, or of its first bytes in UTF-8."""
    return F.left(F.md5(c if first_bytes is None else F.substring(c.cast("binary"), 1, first_bytes)), F.lit(n))


def rater_label(c: Column) -> Column:
    t = F.lower(strip(c))
    return F.when(t.isin("a", "b", "tie"), t)


def cell(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%.3f", c)).otherwise(F.lit("--"))


def delta_cell(c: Column, reference: Column) -> Column:
    return F.when(reference.isNull() | c.isNull(), cell(c)).otherwise(F.format_string("%.3f (%+.3f)", c, c - reference))


def coco_name(split: str, image_id: Column) -> Column:
    return F.format_string(f"COCO_{split}_%012d.jpg", image_id)


def sample_key(image_id: Column, question: Column) -> Column:
    """Identity of a sample: image and normalised question, without image marks."""
    return F.md5(F.concat(F.coalesce(image_id, F.lit("")), F.lit("||"), normalise_question(F.regexp_replace(F.coalesce(question, F.lit("")), r"<image>\s*", ""))))


def shingles(c: Column) -> Column:
    """Distinct runs of three characters of the stripped text; of a shorter one the text itself. Null counts as empty."""
    t = strip(F.coalesce(c, F.lit("")))
    return F.when(F.length(t) < 3, F.array(t)).otherwise(F.array_distinct(F.regexp_extract_all(t, F.lit("(?s)(?=(.{3}))"), F.lit(1))))


def sentences(c: Column) -> Column:
    """Split after the marks that end sentences in Chinese or Western text (not the full stop) and at line breaks."""
    return F.filter(F.transform(F.split(c, r"(?<=[\u3002\uff01\uff1f\uff1b?!])\s*|\n+"), strip), lambda x: x != "")


def paragraphs(c: Column, least: int = 10) -> Column:
    return F.filter(F.transform(F.split(c, r"\n+"), strip), lambda x: F.length(x) >= least)


def _turn(role: str, messages: Column) -> Column:
    return F.get(F.filter(messages, lambda m: m["role"] == role), F.lit(0))["content"]


def sample_question(question: Column, messages: Column) -> Column:
    """A sample's question, else its user's turn without image marks; "" where neither is there. For the metrics' order."""
    return F.coalesce(F.nullif(question, F.lit("")), strip(F.regexp_replace(_turn("user", messages), r"<image>\s*", "")), F.lit(""))


def sample_answer(answer: Column, messages: Column) -> Column:
    return F.coalesce(F.nullif(answer, F.lit("")), _turn("assistant", messages), F.lit(""))


def sample_image(image_path: Column, images: Column) -> Column:
    return F.coalesce(F.nullif(image_path, F.lit("")), F.get(images, F.lit(0)), F.lit(""))


def first_field(*columns: Column) -> Column:
    """The first that is neither null nor "", stripped afterwards: one of blanks only counts and gives ""."""
    return strip(F.coalesce(*[F.nullif(c, F.lit("")) for c in columns]))
